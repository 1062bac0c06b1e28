"""Small documents with every awkward case, and plain-Python versions of the operators."""

import hashlib
import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # further columns with the names that operators use themselves
    T.StructField("score", T.StringType()), T.StructField("node", T.StringType()), T.StructField("hits", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("n_words", T.DoubleType()), T.StructField("digest", T.StringType()),
])

SYLLABLES = "the an re in on er nd st en at ou ti ha th ed is or es ing ly be and of to".split()


def sentence(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def edit(rng, text, share):
    words = text.split(" ")
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = "".join(rng.choices(SYLLABLES, k=4))
    return " ".join(words)


def texts(seed=5):
    rng = random.Random(seed)
    shared = sentence(rng, 40)
    base = "\n".join(sentence(rng, 30) for _ in range(4))
    out = [None, "", "   \n\t ", "word", "two words", "a b c d", "!!! 123 ...", "x" * 5000]
    out += [sentence(rng, n) for n in (1, 4, 5, 6, 12, 13, 14, 60)]
    out += [base, base, base.upper(), base + "\n"] + [edit(rng, base, s) for s in (0.01, 0.02, 0.03, 0.05, 0.2) for _ in range(4)]
    out += [sentence(rng, 25) + " " + shared + " " + sentence(rng, 25) for _ in range(12)]
    out += ["same line here again\n" + sentence(rng, 20) + "\nSame  line here AGAIN" for _ in range(6)]
    out += [" ".join([sentence(rng, 15)] * 3), "spam " * 300, sentence(rng, 12_000)]
    out += ["Été à la plage, naïve 日本語 " + sentence(rng, 20) + " end\x0bof\x1cit"]
    return out


def rows(seed=5):
    out = [(i * 3 % 101, t, ["en", "fr", None][i % 3], None if i % 5 == 0 else "src0", None if t is None else len(t), "s", "n", None, "r", 1.5, "d") for i, t in enumerate(texts(seed))]
    out.append((None, "a text without a number of its own and some more words to it", None, None, None, None, None, None, None, None, None))
    out.append(out[20])  # a whole row again
    out.append((out[21][0], "another text under a doc_id that exists", *out[21][2:]))
    return out


def split(text, lower=False, pattern=r"[^\x20\x09-\x0D]+"):
    if text is None:
        return []
    if lower:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(pattern, text)


def alnum(text):
    return split(text, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, size=5):
    w = split(text, True)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
