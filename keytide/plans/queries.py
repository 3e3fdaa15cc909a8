"""The read and maintenance queries over two changelogs derived from the driver's tables."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from keytide.functions.folders import scratch
from keytide.functions.schema import DELETE, PUT
from keytide.operators import compaction as C, readview as R
from keytide.operators.asof import as_of_join
from keytide.sources.table import Config, KVTable

S, LATE, HOT, GONE = 5000, 7500, "user:00000007", "user:99999999"
A, B = "user:00000020", "user:00000060"


def events_log(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    dead = F.col("event_type") == "signup"
    return e.select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(dead, F.lit(DELETE)).otherwise(F.lit(PUT)).alias("op"),
        F.when(~dead, F.col("props")).alias("value"),
    )


def orders_log(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("key"), (F.col("o_orderkey") + 1).alias("seq"), F.lit(PUT).alias("op"), F.col("o_orderstatus").alias("value"))


LOG = """log AS (SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_id + 1 AS seq,
 CASE WHEN event_type = 'signup' THEN 2 ELSE 1 END AS op, CASE WHEN event_type = 'signup' THEN NULL ELSE props END AS value FROM events)"""
ORDERS = "log AS (SELECT 'order:' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key, o_orderkey + 1 AS seq, 1 AS op, o_orderstatus AS value FROM orders)"


def read_sql(where: str = "true", log: str = LOG, source: str = "log", out: str = "key, seq, value", op: int = 1) -> str:
    return f"WITH {log}, v AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, op) AS rn FROM {source} WHERE {where}) SELECT {out} FROM v WHERE rn = 1 AND op = {op}"


BATCH = [("user:batch-1", 1, "first"), ("user:batch-2", 1, "second"), ("user:00000007", 2, None), ("user:batch-1", 1, "third")]
BATCH_SQL = "(SELECT * FROM log UNION ALL SELECT k, (SELECT max(seq) FROM log) + i, o, v FROM (VALUES " + ", ".join(f"('{k}', {i}, {o}, {'NULL' if v is None else repr(v)})" for i, (k, o, v) in enumerate(BATCH, 1)) + ") b(k, i, o, v))"

LAST = ("user:batch-2", "last")
LAST_SQL = f"(SELECT * FROM {BATCH_SQL} UNION ALL SELECT '{LAST[0]}', (SELECT max(seq) FROM log) + {len(BATCH) + 1}, 1, '{LAST[1]}')"


def with_batch(spark: SparkSession, sf: str, batch: list[tuple]) -> DataFrame:
    """The log with one more batch: consecutive numbers after its head."""
    log = events_log(spark, sf)
    rows = spark.createDataFrame([(k, i, o, v) for i, (k, o, v) in enumerate(batch, 1)], "key string, i long, op int, value string")
    return log.unionByName(rows.crossJoin(F.broadcast(R.head_seq(log))).select("key", (F.col("read_seq") + F.col("i")).alias("seq"), "op", "value"))


#: file_num, level, smallest_seq, largest_seq, smallest_key, largest_key, file_size
MANIFEST = [
    (1, 0, 1, 10, "a", "m", 1000), (2, 0, 11, 20, "c", "z", 2000), (3, 0, 21, 30, "b", "k", 1500), (4, 0, 31, 40, "e", "t", 900), (5, 0, 41, 50, "a", "c", 700),
    (6, 1, 1, 5, "a", "b", 60 << 20), (7, 1, 2, 6, "d", "e", 30 << 20), (8, 1, 3, 7, "g", "h", 0), (9, 2, 1, 2, "a", "f", 200 << 20), (10, 2, 1, 2, "g", "q", 10 << 20), (11, 3, 1, 1, "a", "z", 5 << 20),
]
MANIFEST_COLS = ["file_num", "level", "smallest_seq", "largest_seq", "smallest_key", "largest_key", "file_size"]
MANIFEST_SQL = "m AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in MANIFEST) + f") t({', '.join(MANIFEST_COLS)}))"
SCORES_SQL = f"""WITH {MANIFEST_SQL}, p AS (SELECT level, count(*) AS n_files, CAST(sum(CASE WHEN file_size > 0 THEN file_size ELSE {C.UNKNOWN_SIZE} END) AS BIGINT) AS n_bytes FROM m WHERE level < 6 GROUP BY level),
 s AS (SELECT level, n_files, n_bytes, CASE WHEN level = 0 THEN n_files / CAST(4 AS DOUBLE) ELSE n_bytes / (CAST({64 << 20} AS DOUBLE) * pow(CAST(2 AS DOUBLE), level - 1)) END AS score FROM p)"""
ACTIONS = [(1, "add", 1, 10), (2, "add", 2, 20), (3, "remove", 1, None), (4, "add", 3, 30), (5, "cutoff", None, 10), (6, "remove", 9, None), (7, "add", 1, 11), (8, "remove", 3, None)]


File = namedtuple("File", MANIFEST_COLS)
FILES = [File(*r) for r in MANIFEST]


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _live(spark: SparkSession) -> DataFrame:
    live, _ = C.live_files({"action": a, "file": f, "largest_seq": s} for _, a, f, s in ACTIONS)
    return _rows(spark, [(f, a["largest_seq"]) for f, a in live.items()], "file_num long, largest_seq long")


def gc_sql(oldest: str) -> str:
    return f"""WITH {LOG}, g AS (SELECT *, max(CASE WHEN op = 2 AND seq <= {oldest} THEN seq END) OVER (PARTITION BY key) AS gc FROM log)
 SELECT key, seq, op FROM g WHERE gc IS NULL OR seq > gc OR (seq = gc AND op = 1)"""


def _simulated_files(spark: SparkSession, sf: str) -> DataFrame:
    return C.file_stats(events_log(spark, sf).withColumn("file_num", F.floor((F.col("seq") - 1) / 1000).cast("long")))


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    return R.visible(C.replay(events_log(spark, sf).withColumn("batch", F.floor((F.col("seq") - 1) / 100)), LATE))


def _as_of(spark: SparkSession, sf: str) -> DataFrame:
    """For each order, by number, the version of one user's key that is visible there."""
    probes = orders_log(spark, sf).select(F.lit(HOT).alias("key"), "seq")
    return as_of_join(probes, events_log(spark, sf).filter(F.col("key") == HOT)).select("seq", "as_of_seq")


def _as_of_keys(spark: SparkSession, sf: str) -> DataFrame:
    """For each order, the version of its customer's user key that a snapshot at its number sees."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    key = F.concat(F.lit("user:"), F.lpad((F.col("o_custkey") % 200).cast("string"), 8, "0"))
    return as_of_join(orders.select("o_orderkey", key.alias("key"), (F.col("o_orderkey") + 1).alias("seq")), events_log(spark, sf))


def _written(spark: SparkSession, sf: str) -> KVTable:
    """The events and a batch, written through a stored table."""
    t = KVTable.open(spark, scratch(spark), Config(auto_compact=False))
    t.load_changelog(events_log(spark, sf))
    t.write([("delete", k) if o == DELETE else ("put", k, v) for k, o, v in BATCH])
    return t


def _round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Bulk load, batch, flush, scan."""
    t = _written(spark, sf)
    t.flush()
    return t.scan()


def _compact_reopen(spark: SparkSession, sf: str) -> DataFrame:
    """Bulk load, batch, flush, compaction, a put that only the write log has, reopening, scan."""
    t = _written(spark, sf)
    t.flush()
    t.compact(0)
    t.put(*LAST)
    return KVTable.open(spark, t.path).scan()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on(f, log=events_log):
        return lambda spark, sf: f(log(spark, sf))

    return {
        "get_latest": on(lambda x: R.get(x, HOT)),
        "get_missing": on(lambda x: R.get(x, GONE)),
        "get_deleted": lambda spark, sf: R.get(with_batch(spark, sf, BATCH), HOT),
        "get_at_snapshot": on(lambda x: R.get(x, HOT, S)),
        "scan_all": on(R.scan_all),
        "scan_all_at_snapshot": on(lambda x: R.scan_all(x, S)),
        "scan_all_orders": on(R.scan_all, orders_log),
        "scan_range": on(lambda x: R.scan_range(x, A, B)),
        "scan_range_open_start": on(lambda x: R.scan_range(x, None, B)),
        "scan_range_open_end": on(lambda x: R.scan_range(x, A, None)),
        "scan_range_empty": on(lambda x: R.scan_range(x, A, A)),
        "scan_range_at_snapshot": on(lambda x: R.scan_range(x, A, B, S)),
        "scan_range_orders": on(lambda x: R.scan_range(x, "order:000000000100", "order:000000000900"), orders_log),
        "scan_prefix": on(lambda x: R.scan_prefix(x, "user:0000001")),
        "scan_prefix_none": on(lambda x: R.scan_prefix(x, "nobody:")),
        "scan_prefix_at_snapshot": on(lambda x: R.scan_prefix(x, "user:0000001", S)),
        "history_all_versions": on(R.history),
        "history_of_key": on(lambda x: R.history(x, F.col("key") == HOT)),
        "exact_duplicate_collapse": on(lambda x: R.collapse_exact(x.unionByName(x)).select("key", "seq", "op", "value")),
        "merge_two_runs": on(lambda x: R.merge_runs(x.filter("seq % 2 = 0"), x.filter("seq % 2 = 1")).filter("op = 1").select("key", "seq", "value")),
        "batch_write_visible": lambda spark, sf: R.scan_all(with_batch(spark, sf, BATCH)),
        "delete_then_put": lambda spark, sf: R.get(with_batch(spark, sf, [("user:00000007", 2, None), ("user:00000007", 1, "again")]), HOT),
        "tombstone_keys": on(R.tombstones),
        "compact_no_snapshot": on(lambda x: C.survivors(x, (1 << 56) - 1).select("key", "seq", "op")),
        "compact_with_snapshot": on(lambda x: C.survivors(x, S).select("key", "seq", "op")),
        "compaction_preserves_reads": on(lambda x: R.scan_all(C.survivors(x, S), LATE)),
        "flush_file_stats": _simulated_files,
        "level_scores": lambda spark, sf: _rows(spark, C.level_scores(FILES), "level int, n_files long, n_bytes long, score double"),
        "pick_compaction": lambda spark, sf: _rows(spark, [C.pick_compaction(FILES)], "level int, score double"),
        "overlapping_files": lambda spark, sf: _rows(spark, [(f.file_num, f.level, f.smallest_key, f.largest_key) for f in C.overlapping(FILES, 1, "b", "d")], "file_num long, level int, smallest_key string, largest_key string"),
        "manifest_live_files": lambda spark, sf: _live(spark),
        "wal_replay_above_cutoff": _replayed,
        "snapshot_read_seq": on(R.head_seq),
        "ext_multi_get": lambda spark, sf: R.multi_get(events_log(spark, sf), orders_log(spark, sf).select(F.regexp_replace("key", "order:0000", "user:").alias("key"))),
        "ext_snapshot_diff": on(lambda x: R.changes(x, S, LATE)),
        "ext_top_versioned_keys": on(lambda x: R.top_versioned(x, 10)),
        "ext_prefix_counts": on(lambda x: R.prefix_counts(x, 12)),
        "ext_as_of_join": _as_of,
        "ext_as_of_join_keys": _as_of_keys,
        "table_round_trip": _round_trip,
        "table_compact_reopen": _compact_reopen,
    }


def oracle_sql() -> dict[str, str]:
    r, key = read_sql, f"key = '{HOT}'"
    over = r("true", source=BATCH_SQL)
    actions = ", ".join(f"({v}, '{a}', {'NULL' if f is None else f}, {'NULL' if s is None else s})" for v, a, f, s in ACTIONS)
    gone = BATCH_SQL.replace(BATCH_SQL[BATCH_SQL.index("VALUES ") : BATCH_SQL.index(") b(")], f"VALUES ('{HOT}', 1, 2, NULL), ('{HOT}', 2, 1, 'again')")
    return {
        "get_latest": r(key),
        "get_missing": r(f"key = '{GONE}'"),
        "get_deleted": r(key, source=BATCH_SQL),
        "get_at_snapshot": r(f"{key} AND seq <= {S}"),
        "scan_all": r(),
        "scan_all_at_snapshot": r(f"seq <= {S}"),
        "scan_all_orders": r(log=ORDERS),
        "scan_range": r(f"key >= '{A}' AND key < '{B}'"),
        "scan_range_open_start": r(f"key < '{B}'"),
        "scan_range_open_end": r(f"key >= '{A}'"),
        "scan_range_empty": r(f"key >= '{A}' AND key < '{A}'"),
        "scan_range_at_snapshot": r(f"key >= '{A}' AND key < '{B}' AND seq <= {S}"),
        "scan_range_orders": r("key >= 'order:000000000100' AND key < 'order:000000000900'", log=ORDERS),
        "scan_prefix": r("starts_with(key, 'user:0000001')"),
        "scan_prefix_none": r("starts_with(key, 'nobody:')"),
        "scan_prefix_at_snapshot": r(f"starts_with(key, 'user:0000001') AND seq <= {S}"),
        "history_all_versions": f"WITH {LOG} SELECT key, seq, op, value FROM log",
        "history_of_key": f"WITH {LOG} SELECT key, seq, op, value FROM log WHERE {key}",
        "exact_duplicate_collapse": f"WITH {LOG} SELECT key, seq, op, value FROM log UNION SELECT key, seq, op, value FROM log",
        "merge_two_runs": r(),
        "batch_write_visible": over,
        "delete_then_put": r(key, source=gone),
        "tombstone_keys": r(out="key, seq", op=2),
        "compact_no_snapshot": gc_sql(str((1 << 56) - 1)),
        "compact_with_snapshot": gc_sql(str(S)),
        "compaction_preserves_reads": r(f"seq <= {LATE}"),
        "flush_file_stats": f"WITH {LOG} SELECT CAST(floor((seq - 1) / 1000) AS BIGINT) AS file_num, min(key) AS smallest_key, max(key) AS largest_key, min(seq) AS smallest_seq, max(seq) AS largest_seq, count(*) AS n_entries FROM log GROUP BY 1",
        "level_scores": f"{SCORES_SQL} SELECT * FROM s",
        "pick_compaction": f"{SCORES_SQL} SELECT level, score FROM s WHERE score >= 1 ORDER BY score DESC, level LIMIT 1",
        "overlapping_files": f"WITH {MANIFEST_SQL} SELECT CAST(file_num AS BIGINT) AS file_num, level, smallest_key, largest_key FROM m WHERE level = 1 AND smallest_key <= 'd' AND largest_key >= 'b'",
        "manifest_live_files": f"""WITH a AS (SELECT * FROM (VALUES {actions}) t(version, action, file_num, largest_seq)), l AS (SELECT *, row_number() OVER (PARTITION BY file_num ORDER BY version DESC) AS rn FROM a WHERE file_num IS NOT NULL)
 SELECT CAST(file_num AS BIGINT) AS file_num, CAST(largest_seq AS BIGINT) AS largest_seq FROM l WHERE rn = 1 AND action = 'add'""",
        "wal_replay_above_cutoff": r(f"floor((seq - 1) / 100) IN (SELECT floor((seq - 1) / 100) FROM log GROUP BY 1 HAVING max(seq) > {LATE})"),
        "snapshot_read_seq": f"WITH {LOG} SELECT coalesce(max(seq), 0) AS read_seq FROM log",
        "ext_multi_get": r("key IN (SELECT 'user:' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') FROM orders)"),
        "ext_snapshot_diff": f"""WITH {LOG}, a AS (SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, op) rn FROM log WHERE seq <= {S}) WHERE rn = 1 AND op = 1),
 b AS (SELECT key, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC, op) rn FROM log WHERE seq <= {LATE}) WHERE rn = 1 AND op = 1)
 SELECT coalesce(a.key, b.key) AS key, a.seq AS old_seq, b.seq AS new_seq, CASE WHEN a.seq IS NULL THEN 'added' WHEN b.seq IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key WHERE a.seq IS DISTINCT FROM b.seq""",
        "ext_top_versioned_keys": f"WITH {LOG} SELECT key, count(*) AS n_versions FROM log GROUP BY key ORDER BY n_versions DESC, key LIMIT 10",
        "ext_prefix_counts": r().replace("SELECT key, seq, value FROM v", "SELECT substr(key, 1, 12) AS prefix, count(*) AS n_keys, max(seq) AS newest_seq FROM v") + " GROUP BY 1",
        "ext_as_of_join": f"""WITH {LOG}, o AS (SELECT o_orderkey + 1 AS seq FROM orders), h AS (SELECT seq AS vseq, op FROM log WHERE {key})
 SELECT o.seq, CASE WHEN h.op = 1 THEN h.vseq END AS as_of_seq FROM o ASOF LEFT JOIN h ON o.seq >= h.vseq""",
        "ext_as_of_join_keys": f"""WITH {LOG}, o AS (SELECT o_orderkey, 'user:' || lpad(CAST(o_custkey % 200 AS VARCHAR), 8, '0') AS key, o_orderkey + 1 AS seq FROM orders)
 SELECT o.o_orderkey, o.key, o.seq, CASE WHEN h.op = 1 THEN h.seq END AS as_of_seq, CASE WHEN h.op = 1 THEN h.value END AS as_of_value FROM o ASOF LEFT JOIN log h ON o.key = h.key AND o.seq >= h.seq""",
        "table_round_trip": over,
        "table_compact_reopen": r("true", source=LAST_SQL),
    }
