"""The queries of :mod:`kvspark.queries` as DuckDB SQL over the same tables."""

from __future__ import annotations

WINDOW, BLOCK, FILTER_BITS, RATIO = 2000, 128, 65_536, 10

MUT = """mut AS (
    SELECT event_id AS seq, user_id AS key, CAST(round(value * 100) AS BIGINT) AS value, user_id + 10 AS key_end,
        CASE event_type WHEN 'error' THEN 'd' WHEN 'view' THEN 'g' WHEN 'click' THEN 'r' ELSE 'p' END AS op
    FROM events
), ent AS (
    SELECT key, CASE WHEN op = 'p' THEN value END AS value, op = 'd' AS dead, seq FROM mut WHERE op IN ('p', 'd')
), newest AS (
    SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1
), image AS (
    SELECT key, value, seq FROM newest WHERE NOT dead
)"""

ASOF = MUT + """, life AS (
    SELECT key, value, dead, seq AS lo, coalesce(lead(seq) OVER (PARTITION BY key ORDER BY seq), 9223372036854775807) AS hi FROM ent
)"""

KV = """kv AS (
    SELECT o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders
)"""

RANGES = """ranges AS (
    SELECT seq AS id, key * 97 AS s, key * 97 + seq % 50 - 2 AS e FROM mut WHERE op = 'r'
)"""

RUNS = MUT + f""", runs AS (
    SELECT CAST(floor(seq / {WINDOW}) AS BIGINT) AS run, key, value, dead, seq FROM ent
    QUALIFY row_number() OVER (PARTITION BY CAST(floor(seq / {WINDOW}) AS BIGINT), key ORDER BY seq DESC) = 1
), man AS (
    SELECT run, min(key) AS a, max(key) AS b, count(*) AS n, row_number() OVER (ORDER BY run) - 1 AS i, count(*) OVER () AS m FROM runs GROUP BY run
)"""

BLOCKED = KV + f""", placed AS (
    SELECT key % 10 AS run, (row_number() OVER (PARTITION BY key % 10 ORDER BY key) - 1) // {BLOCK} AS block, key, value FROM kv
), zones AS (
    SELECT run, block, min(key) AS min_key, max(key) AS max_key, count(*) AS entries FROM placed GROUP BY run, block
)"""

BLOOM = KV + f""", bits AS (
    SELECT DISTINCT unnest([(key % 2147483647 * 1103515245 + 12345) % 2147483647 % {FILTER_BITS}, (key % 2147483647 * 69069 + 1) % 2147483647 % {FILTER_BITS}]) AS bit FROM kv WHERE key % 2 = 0
), probed AS (
    SELECT key, (key % 2147483647 * 1103515245 + 12345) % 2147483647 % {FILTER_BITS} IN (SELECT bit FROM bits)
        AND (key % 2147483647 * 69069 + 1) % 2147483647 % {FILTER_BITS} IN (SELECT bit FROM bits) AS may_contain
    FROM kv
)"""

#: A tombstone's value.
STORED = "coalesce(value, -9223372036854775807 - 1) AS value"
LEVEL_BITS = "greatest(32.0 / power(4.0, level / 2.0), 2.0)"
QUICK = "power(1 - exp(-0.7 * {}), 6)"

LAYOUT = MUT + f""", edge AS (
    SELECT CAST(floor(max(seq) / {WINDOW}) AS BIGINT) * {WINDOW} AS last FROM mut
), layout AS (
    SELECT CASE WHEN seq < (SELECT last FROM edge) THEN 1 ELSE 0 END AS level, CAST(0 AS BIGINT) AS run, key, value, dead, seq FROM ent
    QUALIFY row_number() OVER (PARTITION BY level, key ORDER BY seq DESC) = 1
)"""


def _filters(probes: str) -> str:
    """Filters of the layout's runs, asked for all gets and as many keys that don't exist."""
    return LAYOUT + f""", sized AS (
        SELECT level, run, n, per AS bits_per_entry, CAST(least(greatest(round(0.6931471805599453 * per), 1), 10) AS INTEGER) AS hashes,
            CAST(power(2, ceil(log2(greatest(ceil(n * per / 512), 1)))) AS BIGINT) * 512 AS bits
        FROM (SELECT level, run, count(*) AS n, {LEVEL_BITS} AS per FROM layout GROUP BY level, run)
    ), asked AS (
        SELECT key, count(*) AS times FROM (SELECT key FROM mut WHERE op = 'g' UNION ALL SELECT key + 1000003 FROM mut WHERE op = 'g') GROUP BY key
    ), hashed AS (
        SELECT key, (key % 2147483647 * 1103515245 + 12345) % 2147483647 AS h1, (key % 2147483647 * 69069 + 1) % 2147483647 AS h2 FROM (SELECT DISTINCT key FROM layout UNION SELECT key FROM asked)
    ), placed AS (
        SELECT level, run, key, unnest([{probes} FOR i IN range(hashes)]) AS bit FROM hashed, sized
    ), set_bits AS (
        SELECT DISTINCT level, run, bit FROM placed SEMI JOIN layout USING (level, run, key)
    ), told AS (
        SELECT p.level, p.run, p.key, count(*) = count(s.bit) AS may FROM placed p LEFT JOIN set_bits s USING (level, run, bit) GROUP BY ALL
    ), counted AS (
        SELECT t.level, t.run, CAST(sum(times) AS BIGINT) AS checks, CAST(coalesce(sum(times) FILTER (WHERE may), 0) AS BIGINT) AS positives,
            CAST(coalesce(sum(times) FILTER (WHERE may AND l.key IS NULL), 0) AS BIGINT) AS false_positives, CAST(coalesce(sum(times) FILTER (WHERE NOT may AND l.key IS NOT NULL), 0) AS BIGINT) AS false_negatives
        FROM told t JOIN asked a ON a.key = t.key LEFT JOIN layout l ON l.level = t.level AND l.run = t.run AND l.key = t.key GROUP BY t.level, t.run
    ), fs AS (
        SELECT *, power(1 - exp(-hashes * n / CAST(bits AS DOUBLE)), hashes) AS theoretical_fp FROM counted JOIN sized USING (level, run)
    )"""


FILTERS = _filters("(h1 + i * h2) % 2147483647 % bits")
BLOCKED_FILTERS = _filters("h1 % (bits // 512) * 512 + (h2 + i * (1 + h1 % 511)) % 512")

WIDE = "CASE {0} % 97 WHEN 0 THEN -9223372036854775807 - 1 WHEN 1 THEN 9223372036854775807 ELSE (({0} * 1103515245 + 12345) % 2147483647 - 1073741823) * 8589934592 END"

#: An access is a hit if fewer than four other keys of its shard came since the key's last access.
LRU = """WITH t AS (
    SELECT event_id AS seq, user_id AS key, CAST(user_id % 16 AS INTEGER) AS shard, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events
), d AS (
    SELECT a.shard, a.seq, a.prev, count(b.seq) AS apart FROM t a LEFT JOIN t b ON a.shard = b.shard AND b.seq > a.prev AND b.seq < a.seq AND coalesce(b.prev, -1) <= a.prev GROUP BY ALL
), h AS (
    SELECT shard, count(*) AS accesses, count(*) FILTER (WHERE prev IS NOT NULL AND apart < 4) AS hits FROM d GROUP BY shard
)
SELECT shard, accesses, hits, accesses - hits AS misses, greatest(accesses - hits - 4, 0) AS evictions FROM h"""

LINES = MUT + """, lines AS (
    SELECT seq, CASE seq % 11
        WHEN 0 THEN concat_ws(' ', 'p', key) WHEN 1 THEN 'g x' WHEN 2 THEN '  p   ' || key || ' ' || value || '  ' WHEN 3 THEN 's' WHEN 4 THEN 'l dir/file.txt'
        WHEN 5 THEN 'd -' || key WHEN 6 THEN concat_ws(' ', 'r', key, key_end) WHEN 7 THEN concat_ws(' ', 'p', key, value, 'extra') ELSE concat_ws(' ', 'p', key, value) END AS value
    FROM mut
), words AS (
    SELECT seq, value AS line, string_split_regex(trim(value), '\\s+') AS w FROM lines
), parsed AS (
    SELECT seq, line, w[1] AS op, TRY_CAST(w[2] AS BIGINT) AS a, TRY_CAST(w[3] AS BIGINT) AS b, w[2] AS path,
        CASE WHEN w[1] IN ('p', 'r') THEN len(w) = 3 AND a IS NOT NULL AND b IS NOT NULL WHEN w[1] IN ('g', 'd') THEN len(w) = 2 AND a IS NOT NULL
            WHEN w[1] = 'l' THEN len(w) = 2 WHEN w[1] IN ('s', 'f', 'q') THEN len(w) = 1 ELSE false END AS valid
    FROM words
)"""


def _compacted(due: str, inside: str, target: str = "false") -> str:
    """One compaction of level 0; ``inside`` and ``target`` are conditions on manifest rows."""
    return RUNS + f""", pick AS (
        SELECT run, {due} AS due, {inside} AS inside, {target} AS target FROM man
    ), taken AS (
        SELECT run FROM pick WHERE due AND (inside OR target)
    ), merged AS (
        SELECT 1 AS level, CAST(0 AS BIGINT) AS run, key, value, dead, seq FROM runs WHERE run IN (SELECT run FROM taken)
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1
    ), every AS (
        SELECT level, run, key, value, dead, seq FROM merged
        UNION ALL SELECT CASE WHEN target THEN 1 ELSE 0 END, runs.run, key, value, dead, seq FROM runs JOIN pick ON runs.run = pick.run WHERE runs.run NOT IN (SELECT run FROM taken)
    )"""


_SPAN = "(SELECT i FROM (SELECT i, r, max(b) OVER w - min(a) OVER w AS span, r + 2 < m AS whole FROM (SELECT *, row_number() OVER (ORDER BY a, run) - 1 AS r FROM man) WINDOW w AS (ORDER BY a, run ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE whole ORDER BY span DESC, r LIMIT 1)"
_GROUP = "run IN (SELECT run FROM (SELECT run, i, row_number() OVER (ORDER BY a, run) - 1 AS r FROM man) WHERE r BETWEEN (SELECT r FROM (SELECT i, row_number() OVER (ORDER BY a, run) - 1 AS r FROM man) WHERE i = " + _SPAN + ") AND (SELECT r + 2 FROM (SELECT i, row_number() OVER (ORDER BY a, run) - 1 AS r FROM man) WHERE i = " + _SPAN + "))"

COMPACTIONS = {
    "tiered": _compacted("m >= 4", "true"),
    "leveled": _compacted("m - 1 > 1", "i > 0", "i = 0"),
    "lazy_leveled": _compacted("m - 1 >= 4", "i > 0", "i = 0"),
    "partial_tiered_oldest": _compacted("m >= 4", "i < 3"),
    "partial_tiered_most_overlap": _compacted("m >= 4", _GROUP),
    "partial_tiered_smallest": _compacted("m >= 4", "run IN (SELECT run FROM man ORDER BY n, run LIMIT 3)"),
}

_CONTENT = f" SELECT level, run, key, {STORED}, dead, seq FROM every"

SHAPES = BLOCKED + """, steps AS (
    SELECT run, block, key, value, key - lag(key) OVER (PARTITION BY run, block ORDER BY key) AS dk, value - lag(value) OVER (PARTITION BY run, block ORDER BY key) AS dv FROM placed
), shapes AS (
    SELECT run, block, count(*) AS n, max(key) - min(key) AS key_range, coalesce(min(dk) = max(dk), false) AS sequential, 1 - count(DISTINCT value) / count(*) AS repetition, count(*) * 16 AS raw FROM steps GROUP BY run, block
)"""

_ZZ = "length(bin(CASE WHEN {0} >= 0 THEN {0} * 2 ELSE -{0} * 2 - 1 END))"
SIZES = SHAPES + f""", packed AS (
    SELECT run, block, count(*) AS n, CAST(length(bin(max(key) - min(key))) AS INTEGER) AS key_bits, CAST(length(bin(max(value) - min(value))) AS INTEGER) AS value_bits FROM placed GROUP BY run, block
), packed_bytes AS (
    SELECT *, CAST(18 + ceil(n * (key_bits + value_bits) / 8) AS BIGINT) AS bytes FROM packed
), delta AS (
    SELECT run, block, count(*) AS n, CAST(16 + sum(coalesce(({_ZZ.format('dk')} + 6) // 7, 0)) + sum(coalesce(({_ZZ.format('dv')} + 6) // 7, 0)) AS BIGINT) AS bytes FROM steps GROUP BY run, block
)"""


def _deep(level: int) -> str:
    if level == 0:
        return "'none'"
    if level == 1:
        return "CASE WHEN raw < 128 THEN 'none' ELSE 'snappy' END"
    if level == 2:
        return "CASE WHEN raw < 128 THEN 'none' WHEN sequential THEN 'delta' ELSE 'snappy' END"
    return "CASE WHEN raw < 128 THEN 'none' WHEN sequential THEN 'delta' WHEN key_range < 1000 THEN 'bit_pack' WHEN repetition > 0.5 THEN 'dictionary' ELSE 'lz4' END"


PIT = ASOF + """, hit AS (
    SELECT g.seq, g.key, g.op, life.value, life.dead FROM mut g LEFT JOIN life ON life.key = g.key AND life.lo < g.seq AND g.seq <= life.hi
), found AS (
    SELECT seq, key, op, coalesce(NOT dead, false) AS live, CASE WHEN NOT dead THEN value END AS value FROM hit
), spans AS (
    SELECT r.seq, life.key, life.value FROM mut r JOIN life ON r.op = 'r' AND life.key >= r.key AND life.key < r.key_end AND life.lo < r.seq AND r.seq < life.hi WHERE NOT dead
), sizes AS (
    SELECT seq, count(*) AS n FROM spans GROUP BY seq
)"""

SQL: dict[str, str] = {
    "latest_image": f"WITH {MUT} SELECT key, value, seq FROM image",
    "point_get": f"WITH {MUT} SELECT k.key, coalesce(CAST(image.value AS VARCHAR), '') AS value FROM (SELECT CAST(7 AS BIGINT) AS key) k LEFT JOIN image ON k.key = image.key",
    "get_miss": f"WITH {MUT} SELECT k.key, coalesce(CAST(image.value AS VARCHAR), '') AS value FROM (SELECT CAST(-1 AS BIGINT) AS key) k LEFT JOIN image ON k.key = image.key",
    "multi_get": f"WITH {MUT} SELECT k.key, coalesce(CAST(image.value AS VARCHAR), '') AS value FROM (SELECT unnest(range(-5, 2000, 7)) AS key) k LEFT JOIN image ON k.key = image.key",
    "range_scan": f"WITH {MUT} SELECT key, value FROM image WHERE key >= 10 AND key < 60 ORDER BY key",
    "range_empty": f"WITH {MUT} SELECT key, value FROM image WHERE key >= 10 AND key < 10 ORDER BY key",
    "range_batch": f"WITH {MUT}, {KV}, {RANGES} SELECT id, key, value FROM ranges JOIN kv ON key >= s AND key < e",
    "range_replies": f"WITH {MUT}, {KV}, {RANGES} SELECT id, count(key) AS n, coalesce(string_agg(key || ':' || value, ' ' ORDER BY key), '') AS reply FROM ranges LEFT JOIN kv ON key >= s AND key < e GROUP BY id",
    "delete_visibility": f"WITH {MUT} SELECT key, seq FROM newest WHERE dead",
    "pit_get": f"WITH {PIT} SELECT seq, key, live, coalesce(CAST(value AS VARCHAR), '') AS value FROM found WHERE op = 'g'",
    "pit_range": f"WITH {PIT} SELECT seq, key, value FROM spans",
    "delete_classify": f"WITH {PIT} SELECT seq, key, live AS succeeded FROM found WHERE op = 'd'",
    "workload_report": f"""WITH {PIT} SELECT count(*) FILTER (WHERE op = 'p') AS puts, count(*) FILTER (WHERE op = 'g' AND live) AS successful_gets, count(*) FILTER (WHERE op = 'g' AND NOT live) AS failed_gets,
        count(*) FILTER (WHERE op = 'r') AS ranges, (SELECT count(*) FROM sizes) AS non_empty_ranges, (SELECT coalesce(min(n), 0) FROM sizes) AS smallest_range, (SELECT coalesce(max(n), 0) FROM sizes) AS largest_range,
        count(*) FILTER (WHERE op = 'd' AND live) AS successful_dels, count(*) FILTER (WHERE op = 'd' AND NOT live) AS failed_dels, CAST(0 AS BIGINT) AS loads FROM found""",
    "put_previous": f"WITH {PIT} SELECT f.seq, f.key, mut.value, coalesce(CAST(f.value AS VARCHAR), '') AS previous FROM found f JOIN mut ON mut.seq = f.seq WHERE f.op = 'p'",
    "version_intervals": f"WITH {ASOF} SELECT key, {STORED}, dead, lo, hi FROM life",
    "command_parse": f"""WITH {LINES} SELECT seq, CASE WHEN valid THEN op ELSE '' END AS op, CASE WHEN valid AND op IN ('p', 'g', 'r', 'd') THEN CAST(a AS VARCHAR) ELSE '' END AS key,
        CASE WHEN valid AND op = 'p' THEN CAST(b AS VARCHAR) ELSE '' END AS value, CASE WHEN valid AND op = 'r' THEN CAST(b AS VARCHAR) ELSE '' END AS key_end, CASE WHEN valid AND op = 'l' THEN path ELSE '' END AS path, valid FROM parsed""",
    "load_report": f"""WITH {LINES} SELECT loaded, failed, 'Loaded ' || loaded || ' commands from file (' || failed || ' failed)' AS reply FROM (
        SELECT count(*) FILTER (WHERE valid AND op IN ('p', 'd')) AS loaded, count(*) FILTER (WHERE NOT (valid AND op IN ('p', 'd'))) AS failed FROM parsed)""",
    "command_rejects": f"WITH {LINES} SELECT seq, line FROM parsed WHERE NOT valid",
    "flush_runs": f"WITH {RUNS} SELECT run, key, {STORED}, dead, seq FROM runs",
    "compact_tiered": f"WITH {COMPACTIONS['tiered']}{_CONTENT}",
    "compact_leveled": f"WITH {COMPACTIONS['leveled']}{_CONTENT}",
    "compact_lazy_leveled": f"WITH {COMPACTIONS['lazy_leveled']}{_CONTENT}",
    "compact_partial_oldest": f"WITH {COMPACTIONS['partial_tiered_oldest']}{_CONTENT}",
    "compact_partial_overlap": f"WITH {COMPACTIONS['partial_tiered_most_overlap']}{_CONTENT}",
    "compact_partial_smallest": f"WITH {COMPACTIONS['partial_tiered_smallest']}{_CONTENT}",
    "compaction_equivalence": " UNION ALL ".join(
        f"SELECT '{name}' AS policy, count(*) AS changed FROM (WITH {ctes}, after AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) "
        "(SELECT key, value FROM image EXCEPT ALL SELECT key, value FROM after WHERE NOT dead) UNION ALL (SELECT key, value FROM after WHERE NOT dead EXCEPT ALL SELECT key, value FROM image))"
        for name, ctes in COMPACTIONS.items()
    ),
    "recovery_image": f"""WITH {MUT}, flushed AS (
        SELECT * FROM ent WHERE seq < (SELECT floor((floor((max(seq) + 1) / {WINDOW}) * {WINDOW} - 500) / {WINDOW}) * {WINDOW} FROM mut)
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1
    ) SELECT key, value, seq FROM flushed WHERE NOT dead""",
    "storage_stats": f"""WITH {LAYOUT} SELECT level, runs, blocks, entries, tombstones, entries * 16 AS bytes FROM (
        SELECT level, count(DISTINCT run) AS runs, CAST((count(*) + {BLOCK} - 1) // {BLOCK} AS BIGINT) AS blocks, count(*) AS entries, count(*) FILTER (WHERE dead) AS tombstones FROM layout GROUP BY level)""",
    "store_validate": "SELECT CAST(0 AS BIGINT) AS bad",
    "store_orc": f"WITH {MUT} SELECT key, value, seq FROM image",
    "range_extremes": f"""WITH {MUT}, {KV}, wide AS (SELECT {WIDE.format('key')} AS key FROM kv), r AS (
        SELECT id, least(a, b) AS s, greatest(a, b) AS e FROM (SELECT seq AS id, {WIDE.format('(key * 31 + seq)')} AS a, {WIDE.format('(seq * 17 + 3)')} AS b FROM mut WHERE op = 'r' AND key % 15 = 0))
        SELECT id, count(*) AS n, min(key) AS low, max(key) AS high FROM r JOIN wide ON key >= s AND key < e GROUP BY id""",
    "cache_lru_sim": LRU,
    "key_range": f"WITH {MUT} SELECT min(key) AS min_key, max(key) AS max_key, count(DISTINCT key) AS keys FROM ent",
    "memory_stats": f"WITH {MUT} SELECT 128 AS pages, count(DISTINCT key) * 16 AS used_bytes, CAST(524288 AS BIGINT) AS total_bytes, CAST(0 AS DOUBLE) AS fragmentation FROM ent",
    "run_blocks": f"WITH {BLOCKED} SELECT run, block, key, value FROM placed",
    "fence_zone_map": f"WITH {BLOCKED} SELECT run, block, min_key, max_key, entries FROM zones",
    "fence_point": f"WITH {BLOCKED} SELECT p.key, run, block FROM (SELECT unnest(range(-10, 20000, 13)) AS key) p JOIN zones ON min_key <= p.key AND max_key >= p.key",
    "fence_range": f"WITH {BLOCKED} SELECT run, block FROM zones WHERE min_key < 5000 AND max_key >= 500",
    "load_blocks": f"WITH {BLOCKED} SELECT p.run, p.block, p.key, p.value FROM placed p JOIN zones z ON p.run = z.run AND p.block = z.block WHERE min_key < 900 AND max_key >= 500",
    "codec_by_level": "SELECT CAST(unnest(range(5)) AS INTEGER) AS level, unnest(['none', 'snappy', 'delta', 'snappy', 'snappy']) AS codec",
    "fence_two_level": f"WITH {BLOCKED} SELECT run, block // {RATIO} AS guide, min(min_key) AS min_key, max(max_key) AS max_key, count(*) AS blocks FROM zones GROUP BY run, block // {RATIO}",
    "fence_two_level_point": f"WITH {BLOCKED} SELECT run, block FROM zones WHERE min_key <= 7777 AND max_key >= 7777",
    "fence_prefix": f"""WITH {KV}, wide AS (SELECT (key % 7 - 3) * 4294967296 + value AS k FROM kv)
        SELECT k >> 32 AS prefix, count(*) AS n, min(k & 4294967295) AS min_suffix, max(k & 4294967295) AS max_suffix FROM wide GROUP BY k >> 32""",
    "bloom_portable": f"WITH {BLOOM} SELECT bit FROM bits",
    "bloom_probe": f"WITH {BLOOM} SELECT key, may_contain FROM probed",
    "bloom_fp_rate": f"""WITH {BLOOM} SELECT *, CASE WHEN positives = 0 THEN 0 ELSE CAST(false_positives AS DOUBLE) / positives END AS observed_fp FROM (
        SELECT count(*) AS checks, count(*) FILTER (WHERE may_contain) AS positives, count(*) FILTER (WHERE may_contain AND key % 2 <> 0) AS false_positives, count(*) FILTER (WHERE NOT may_contain AND key % 2 = 0) AS false_negatives FROM probed)""",
    "bloom_sizing_levels": f"""SELECT level, bits_per_entry, CAST(least(greatest(round(0.6931471805599453 * bits_per_entry), 1), 10) AS INTEGER) AS hashes,
        CAST(power(2, ceil(log2(greatest(ceil((SELECT count(*) FROM orders) * bits_per_entry / 512), 1)))) AS BIGINT) * 512 AS bits
        FROM (SELECT level, {LEVEL_BITS} AS bits_per_entry FROM (SELECT CAST(unnest(range(8)) AS INTEGER) AS level))""",
    "bloom_sizing_dynamic": """SELECT level, round(least(greatest(-log2([0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3][least(level, 9) + 1]) / 0.6931471805599453, 2.0), 32.0), 9) AS bits_per_entry
        FROM (SELECT CAST(unnest(range(14)) AS INTEGER) AS level)""",
    "bloom_theoretical_fp": f"""WITH {RUNS}, s AS (SELECT run, count(*) AS n, CAST(power(2, ceil(log2(greatest(ceil(count(*) * 10.0 / 512), 1)))) AS BIGINT) * 512 AS bits FROM runs GROUP BY run)
        SELECT run, n, bits, round(power(1 - exp(-6 * n / CAST(bits AS DOUBLE)), 6), 12) AS theoretical_fp, round({QUICK.format('(bits / n)')}, 12) AS quick_fp FROM s""",
    "noop_filter": f"WITH {KV} SELECT key, true AS may_contain FROM kv",
    "filter_stats": f"WITH {FILTERS} SELECT level, run, n, bits, hashes, checks, positives, false_positives, false_negatives, round(theoretical_fp, 12) AS theoretical_fp FROM fs",
    "filter_stats_blocked": f"WITH {BLOCKED_FILTERS} SELECT level, run, n, bits, hashes, checks, positives, false_positives, false_negatives FROM fs",
    "filter_stats_summary": f"""WITH {FILTERS} SELECT coalesce(level, -1) AS level, count(*) AS runs, CAST(sum(checks) AS BIGINT) AS checks, CAST(sum(positives) AS BIGINT) AS positives, CAST(sum(false_positives) AS BIGINT) AS false_positives,
        round(avg(bits_per_entry), 9) AS bits_per_entry, round(avg(theoretical_fp), 9) AS theoretical_fp, round(CASE WHEN sum(positives) = 0 THEN 0 ELSE CAST(sum(false_positives) AS DOUBLE) / sum(positives) END, 9) AS observed_fp
        FROM fs GROUP BY ROLLUP (level) HAVING count(*) > 0""",
    "codec_bitpack_size": f"WITH {SIZES} SELECT run, block, n, key_bits, value_bits, bytes FROM packed_bytes",
    "codec_delta_size": f"WITH {SIZES} SELECT run, block, n, bytes FROM delta",
    "codec_dictionary": """SELECT key, value, n, CAST(row_number() OVER (ORDER BY n DESC, key, value) - 1 AS INTEGER) AS code FROM (
        SELECT CAST(l_quantity AS BIGINT) AS key, CAST(l_linenumber AS BIGINT) AS value, count(*) AS n FROM lineitem GROUP BY 1, 2) QUALIFY code < 32767""",
    "codec_adaptive_choice": f"""WITH {SHAPES} SELECT run, block, {', '.join(f'{_deep(k)} AS level{k}' for k in range(4))},
        CASE WHEN raw < 128 THEN 'none' WHEN sequential THEN 'delta' WHEN key_range < 10000 THEN 'bit_pack' WHEN repetition > 0.3 THEN 'dictionary' WHEN raw > 10240 THEN 'lz4' ELSE 'snappy' END AS flat FROM shapes""",
    "codec_stats": f"""WITH {SIZES} SELECT run, CAST(sum(p.n * 16) AS BIGINT) AS raw_bytes, CAST(sum(p.bytes) AS BIGINT) AS packed_bytes, CAST(sum(delta.bytes) AS BIGINT) AS delta_bytes,
        CAST(sum(4 + p.n * 16 * 3 // 4) AS BIGINT) AS lz4_bytes, round(sum(p.n * 16) / sum(p.bytes), 9) AS packed_ratio FROM packed_bytes p JOIN delta USING (run, block) GROUP BY run""",
    "codec_roundtrip": "SELECT unnest(['none', 'bit_pack', 'delta', 'dictionary', 'lz4', 'snappy']) AS codec, CAST(0 AS BIGINT) AS lost",
    "cache_frequency": "SELECT user_id AS key, count(*) AS freq, max(event_id) AS last_seq FROM events GROUP BY user_id",
    "cache_ttl_buckets": "SELECT CAST(floor((born + 600) / 10) AS BIGINT) AS bucket, count(*) AS entries FROM (SELECT user_id, CAST(floor(max(epoch(ts))) AS BIGINT) AS born FROM events GROUP BY user_id) GROUP BY 1",
    "cache_priority_rank": """SELECT key, freq, CASE key % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'normal' ELSE 'low' END AS priority, freq * CASE key % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS score
        FROM (SELECT user_id AS key, count(*) AS freq FROM events GROUP BY user_id) ORDER BY score DESC, key LIMIT 50""",
    "speedup_pivot": """SELECT event_type, round(g0, 6) AS g0, round(g1, 6) AS g1, round(g2, 6) AS g2, round(g1 / g0, 6) AS ratio1, round(g2 / g0, 6) AS ratio2 FROM (
        SELECT event_type, avg(value) FILTER (WHERE user_id % 3 = 0) AS g0, avg(value) FILTER (WHERE user_id % 3 = 1) AS g1, avg(value) FILTER (WHERE user_id % 3 = 2) AS g2 FROM events GROUP BY event_type)""",
    "workload_generate": "SELECT unnest(['p', 'g', 'r', 'd']) AS op, CAST(unnest([500, 300, 200, 20]) AS BIGINT) AS n",
}
SQL["get_with_cache"] = SQL["point_get"]
SQL["range_with_cache"] = SQL["range_scan"]
SQL["stream_latest_image"] = SQL["latest_image"]


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
