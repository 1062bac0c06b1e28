"""The command language as column expressions: no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number of words of each command, its name included.
ARITY = {"p": 3, "g": 2, "r": 3, "d": 2, "l": 2, "s": 1, "f": 1, "q": 1}
INTEGER = r"^[+-]?[0-9]+$"


def _integer(word: Column) -> Column:
    """A 64-bit integer, or null for any other word."""
    return F.when(word.rlike(INTEGER), word.try_cast("bigint"))


def parse(line: Column) -> Column:
    """struct<op, key, value, key_end, path, valid>. Words are parted by white space and their
    number is exact; keys and values are 64-bit integers."""
    words = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    op = words[0]
    word = lambda i: F.get(words, F.lit(i))
    a, b = _integer(word(1)), _integer(word(2))
    arity = F.create_map([F.lit(x) for p in ARITY.items() for x in p])[op]
    ints = F.when(op.isin("p", "r"), a.isNotNull() & b.isNotNull()).when(op.isin("g", "d"), a.isNotNull()).otherwise(F.lit(True))
    valid = F.coalesce((F.size(words) == arity) & ints, F.lit(False))
    keyed = valid & op.isin("p", "g", "r", "d")
    return F.struct(
        F.when(valid, op).alias("op"),
        F.when(keyed, a).alias("key"),
        F.when(valid & (op == "p"), b).alias("value"),
        F.when(valid & (op == "r"), b).alias("key_end"),
        F.when(valid & (op == "l"), F.regexp_replace(word(1), r'^"|"$', "")).alias("path"),
        valid.alias("valid"),
    )


def reply(pairs: Column) -> Column:
    """``k:v k:v ...`` in ascending key order from an array of structs (key, value)."""
    return F.concat_ws(" ", F.transform(F.array_sort(pairs), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"].cast("string"))))
