"""Queries by operator, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import NotFound, Status, StoreError, strerror
from ..operators import aggregates, batch, merge, point, scan
from ..sources.cursor import Cursor
from ..sources.files import scratch_dir
from ..sources.store import FORMAT, VERSION, Batch, Store
from ..streaming.ingest import ingest, tail, windowed_counts
from . import tables as t

USER, USERS = 3, [3, 5, 8]
LOW, HIGH = datetime(2024, 1, 8), datetime(2024, 1, 14, 23, 59, 59)
MIDDLE, EARLY, LATE = datetime(2024, 1, 11, 12), datetime(2023, 12, 31), datetime(2024, 2, 1)
NOON = datetime(2024, 1, 11, 12)
PAGE = 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def ts(x: datetime) -> str:
    return f"TIMESTAMP '{x}'"


def at(x: datetime):
    return F.lit(x).cast("timestamp_ntz")


def register(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


LISTED, IN_WEEK = ", ".join(map(str, USERS)), f"time BETWEEN {ts(LOW)} AND {ts(HIGH)}"
FORWARD, MERGED = "ORDER BY time, seq", "ORDER BY time, seq, symbol"


def day(time="time"):
    return F.date_trunc("day", time)


def week(frame: DataFrame, symbol=USER) -> DataFrame:
    return scan.bounded(frame, symbol, LOW, HIGH)


# Point lookups


@register(f"SELECT * FROM {t.TURNS} WHERE symbol = {USER} AND time = 1 AND seq = 0")
def get_exact(spark, sf_dir):
    return point.get(t.turns(spark, sf_dir), USER, 1)


@register(f"SELECT * FROM {t.ORDERS} WHERE (symbol, time, seq) IN (SELECT o_custkey, max(o_orderdate), max_by(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey % 10 = 1 GROUP BY o_custkey)")
def get_seq_exact(spark, sf_dir):
    """Exact lookup, with the sequence, of the newest order of every tenth customer."""
    rows = t.orders(spark, sf_dir)
    newest = rows.where("symbol % 10 = 1").groupBy("symbol").agg(F.max(F.struct("time", "seq")).alias("at")).select("symbol", "at.time", "at.seq")
    return point.get_many(newest, rows).where("found").drop("found")


@register(f"SELECT symbol, time, max(CASE WHEN seq = 0 THEN 1 ELSE 0 END) = 1 AS plain_found, count(*) AS records FROM {t.HOURLY} GROUP BY symbol, time")
def get_seq0_misses(spark, sf_dir):
    """Times at which the plain form finds nothing although there are records."""
    rows = t.hourly(spark, sf_dir)
    times = rows.groupBy("symbol", "time").agg(F.count(F.lit(1)).alias("records"))
    return point.get_many(times, rows).select("symbol", "time", F.col("found").alias("plain_found"), "records")


@register(f"SELECT * FROM {t.EVENTS} WHERE symbol = {USER} AND time <= {ts(MIDDLE)} ORDER BY time DESC, seq DESC LIMIT 1")
def get_le_scalar(spark, sf_dir):
    return point.get_le(t.events(spark, sf_dir), USER, MIDDLE)


@register(f"SELECT * FROM {t.EVENTS} WHERE symbol = {USER} AND time >= {ts(MIDDLE)} ORDER BY time, seq LIMIT 1")
def get_ge_scalar(spark, sf_dir):
    return point.get_ge(t.events(spark, sf_dir), USER, MIDDLE)


@register(f"SELECT * FROM {t.EVENTS} WHERE symbol = {USER} AND time <= {ts(EARLY)} ORDER BY time DESC, seq DESC LIMIT 1")
def get_le_before_first(spark, sf_dir):
    return point.get_le(t.events(spark, sf_dir), USER, EARLY)


_TIED = f"SELECT symbol, time, {{}}(seq) AS seq FROM {t.ORDERS} GROUP BY symbol, time HAVING count(*) > 1"


def _tied(spark, sf_dir, direction: str) -> DataFrame:
    rows = t.orders(spark, sf_dir)
    days = rows.groupBy("symbol", "time").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("symbol", "time")
    return point.asof_join(days, rows, direction).select("symbol", "time", F.col("found.seq").alias("seq"))


@register(_TIED.format("max"))
def get_le_tie_highest_seq(spark, sf_dir):
    return _tied(spark, sf_dir, "le")


@register(_TIED.format("min"))
def get_ge_tie_lowest_seq(spark, sf_dir):
    return _tied(spark, sf_dir, "ge")


def _probes(spark, sf_dir) -> DataFrame:
    """Each order asks for its customer's (as a user) nearest event at that hour of the month."""
    minutes = (F.col("o_orderkey") * 37) % 1440 + (F.col("o_orderkey") % 29) * 1440
    when = at(datetime(2024, 1, 1)) + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
    return t.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 150).alias("symbol"), when.cast("timestamp_ntz").alias("time"), F.col("o_orderkey").alias("probe"))


_PROBES = "(SELECT o_custkey % 150 AS symbol, TIMESTAMP '2024-01-01' + to_minutes(CAST((o_orderkey * 37) % 1440 + (o_orderkey % 29) * 1440 AS INTEGER)) AS time, o_orderkey AS probe FROM orders)"
_ASOF = f"""
SELECT p.symbol, p.time, p.probe, r.time AS found_time, r.seq AS found_seq, r.value AS found_value FROM {_PROBES} p
LEFT JOIN LATERAL (SELECT time, seq, value FROM {t.EVENTS} e WHERE e.symbol = p.symbol AND e.time {{op}} p.time ORDER BY e.time {{way}}, e.seq {{way}} LIMIT 1) r ON true"""


def _near(found: DataFrame) -> DataFrame:
    return found.select("symbol", "time", "probe", F.col("found.time").alias("found_time"), F.col("found.seq").alias("found_seq"), F.col("found.value").alias("found_value"))


@register(_ASOF.format(op="<=", way="DESC"))
def asof_join_le(spark, sf_dir):
    return _near(point.asof_join(_probes(spark, sf_dir), t.events(spark, sf_dir), "le"))


@register(_ASOF.format(op=">=", way="ASC"))
def asof_join_ge(spark, sf_dir):
    return _near(point.asof_join(_probes(spark, sf_dir), t.events(spark, sf_dir), "ge"))


@register(_ASOF.format(op="<=", way="DESC"))
def asof_join_bucketed(spark, sf_dir):
    """As asof_join_le, with each user's time cut into days so that no user needs one task."""
    return _near(point.asof_join(_probes(spark, sf_dir), t.events(spark, sf_dir), "le", bucket=lambda time: F.date_trunc("day", time).cast("timestamp_ntz")))


# Range scans


@register(f"SELECT row_number() OVER (PARTITION BY symbol {FORWARD}) AS pos, * FROM {t.EVENTS}")
def scan_full(spark, sf_dir):
    return t.events(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("time", "seq")).cast("long"))


@register(f"SELECT row_number() OVER ({FORWARD}) AS pos, * FROM {t.EVENTS} WHERE symbol = {USER} AND {IN_WEEK}")
def scan_bounded(spark, sf_dir):
    return scan.numbered(week(t.events(spark, sf_dir)), "time", "seq", bucket=day())


@register(f"SELECT h.* FROM {t.HOURLY} h JOIN (SELECT user_id, min(date_trunc('hour', ts)) AS hour FROM events WHERE user_id = {USER} GROUP BY user_id) f ON h.symbol = f.user_id AND h.time = f.hour")
def scan_point_range(spark, sf_dir):
    """A range of one instant, that of the user's first record: every sequence of it."""
    first = t.hourly(spark, sf_dir).where(F.col("symbol") == USER).agg(F.min("time")).first()[0]
    return scan.bounded(t.hourly(spark, sf_dir), USER, first, first)


@register(f"SELECT * FROM {t.EVENTS} WHERE symbol = {USER} AND time BETWEEN {ts(LATE)} AND {ts(LATE)}")
def scan_empty_gap(spark, sf_dir):
    return scan.scan(t.events(spark, sf_dir), USER, LATE, LATE)


@register(f"SELECT * FROM {t.EVENTS} WHERE symbol = 999999999")
def scan_unknown_symbol(spark, sf_dir):
    return scan.scan(t.events(spark, sf_dir), 999_999_999)


@register(f"SELECT row_number() OVER (ORDER BY time DESC, seq DESC) AS pos, * FROM {t.HOURLY} WHERE symbol = {USER} AND {IN_WEEK}")
def scan_reverse(spark, sf_dir):
    return scan.numbered(week(t.hourly(spark, sf_dir)), F.desc("time"), F.desc("seq"))


@register(f"SELECT * FROM {t.EVENTS} WHERE symbol = {USER} ORDER BY time DESC, seq DESC LIMIT 10")
def scan_last_n(spark, sf_dir):
    return scan.scan(t.events(spark, sf_dir), USER, reverse=True, limit=10)


@register(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC, seq DESC) AS rank FROM {t.HOURLY}) WHERE rank <= 5")
def last_n_per_symbol(spark, sf_dir):
    return scan.last_n(t.hourly(spark, sf_dir), 5)


@register(f"SELECT * FROM {t.HOURLY} WHERE symbol = {USER} AND (time > {ts(NOON)} OR (time = {ts(NOON)} AND seq > 50)) {FORWARD} LIMIT {PAGE}")
def scan_resume_after_key(spark, sf_dir):
    return scan.page(t.hourly(spark, sf_dir), USER, PAGE, (NOON, 50))


@register(f"SELECT * FROM {t.HOURLY} WHERE symbol = {USER} AND (time < {ts(NOON)} OR (time = {ts(NOON)} AND seq < 50)) ORDER BY time DESC, seq DESC LIMIT {PAGE}")
def scan_resume_rev(spark, sf_dir):
    return scan.page(t.hourly(spark, sf_dir), USER, PAGE, (NOON, 50), reverse=True)


@register(f"SELECT row_number() OVER ({FORWARD}) AS pos, * FROM {t.EVENTS} WHERE symbol = {USER} AND {IN_WEEK} AND (time > {ts(MIDDLE)} OR (time = {ts(MIDDLE)} AND seq >= 0))")
def iter_seek_gap(spark, sf_dir):
    return scan.numbered(scan.seek(t.events(spark, sf_dir), USER, MIDDLE, 0, LOW, HIGH), "time", "seq")


@register(f"SELECT *, (pos - 1) // 16 AS chunk FROM (SELECT row_number() OVER ({FORWARD}) AS pos, * FROM {t.EVENTS} WHERE symbol = {USER})")
def scan_chunked(spark, sf_dir):
    return scan.chunked(scan.bounded(t.events(spark, sf_dir), USER), 16, "time", "seq")


@register(f"SELECT event_type, value FROM {t.EVENTS} WHERE symbol = {USER} AND {IN_WEEK}")
def read_range_payload(spark, sf_dir):
    return scan.read_range(t.events(spark, sf_dir), USER, LOW, HIGH)


@register(f"SELECT count(*) AS n FROM {t.EVENTS} WHERE symbol = {USER} AND {IN_WEEK}")
def read_range_count(spark, sf_dir):
    return scan.range_count(t.events(spark, sf_dir), USER, LOW, HIGH)


@register(f"SELECT event_type, value, (SELECT count(*) > 3 FROM {t.EVENTS} WHERE symbol = {USER} AND {IN_WEEK}) AS overflow FROM {t.EVENTS} WHERE symbol = {USER} AND {IN_WEEK} {FORWARD} LIMIT 3")
def read_range_capped(spark, sf_dir):
    """The first three payloads of the range, and whether there are more."""
    first = scan.scan(t.events(spark, sf_dir), USER, LOW, HIGH, limit=4)
    more = first.agg((F.count(F.lit(1)) > 3).alias("overflow"))
    return first.orderBy("time", "seq").limit(3).crossJoin(F.broadcast(more)).select("event_type", "value", "overflow")


# Merges


def _merge(name: str, where: str, build, source: str = t.EVENTS) -> None:
    def run(spark, sf_dir):
        return scan.numbered(build(spark, sf_dir), "time", "seq", "symbol", bucket=day())

    run.__name__ = name
    register(f"SELECT row_number() OVER ({MERGED}) AS pos, * FROM {source} WHERE {where}")(run)


_merge("scan_multi_merge", f"symbol IN ({LISTED})", lambda s, d: merge.scan_multi(t.events(s, d), USERS))
_merge("scan_multi_bounded", f"symbol IN ({LISTED}) AND {IN_WEEK}", lambda s, d: merge.scan_multi(t.events(s, d), USERS, LOW, HIGH))
_merge("scan_multi_ties", f"symbol IN ({LISTED}) AND {IN_WEEK}", lambda s, d: merge.scan_multi(t.hourly(s, d), USERS, LOW, HIGH), t.HOURLY)
_merge("scan_multi_unknown", f"symbol IN ({USER}) AND {IN_WEEK}", lambda s, d: merge.scan_multi(t.events(s, d), [999_999_999, USER], LOW, HIGH))


@register(f"SELECT e.* FROM {t.EVENTS} e JOIN (VALUES (3), (3), (5)) AS l(symbol) ON e.symbol = l.symbol")
def scan_multi_dup_symbols(spark, sf_dir):
    return merge.scan_multi(t.events(spark, sf_dir), [3, 3, 5])


@register(f"SELECT * FROM {t.HOURLY} WHERE symbol IN ({LISTED}) AND (time, seq, symbol) > ({ts(NOON)}, 50, 5) {MERGED} LIMIT {PAGE}")
def scan_multi_resume(spark, sf_dir):
    return merge.merge_page(t.hourly(spark, sf_dir), USERS, PAGE, (NOON, 50, 5))


@register(f"SELECT * FROM {t.EVENTS} WHERE {IN_WEEK}")
def merged_replay(spark, sf_dir):
    """All users' week in merged order: a range exchange and a sort."""
    return scan.bounded(t.events(spark, sf_dir), None, LOW, HIGH).orderBy(*merge.ORDER)


# Facts


@register(f"SELECT symbol, min(time) AS min_time FROM {t.EVENTS} WHERE symbol = {USER} GROUP BY symbol")
def min_time(spark, sf_dir):
    return aggregates.min_time(t.events(spark, sf_dir), USER)


@register(f"SELECT symbol, max(time) AS max_time FROM {t.EVENTS} WHERE symbol = {USER} GROUP BY symbol")
def max_time(spark, sf_dir):
    return aggregates.max_time(t.events(spark, sf_dir), USER)


@register(f"SELECT count(*) AS record_count FROM {t.EVENTS} WHERE symbol = {USER}")
def count(spark, sf_dir):
    return aggregates.count(t.events(spark, sf_dir), USER)


@register(f"SELECT symbol, min(time) AS min_time, max(time) AS max_time, count(*) AS record_count FROM {t.LINES} GROUP BY symbol")
def symbol_info(spark, sf_dir):
    return aggregates.symbol_info(t.lines(spark, sf_dir))


@register(f"SELECT l.idx, l.symbol, coalesce((SELECT max(time) FROM {t.TURNS} s WHERE s.symbol = l.symbol), 0) AS max_time FROM (VALUES (CAST(0 AS BIGINT), CAST(5 AS BIGINT)), (1, 999999999), (2, 3), (3, 5)) AS l(idx, symbol)")
def max_times_watchlist(spark, sf_dir):
    rows = t.turns(spark, sf_dir)
    return aggregates.max_times(rows, merge.watchlist(spark, [5, 999_999_999, 3, 5], rows.schema["symbol"].dataType))


@register(f"SELECT DISTINCT symbol FROM {t.EVENTS}")
def list_symbols(spark, sf_dir):
    return aggregates.list_symbols(t.events(spark, sf_dir))


@register(f"SELECT e.* FROM {t.EVENTS} e LEFT JOIN (SELECT symbol, max(time) AS last_time FROM {t.EVENTS} WHERE time <= {ts(HIGH)} GROUP BY symbol) s USING (symbol) WHERE s.last_time IS NULL OR e.time > s.last_time")
def new_since(spark, sf_dir):
    rows = t.events(spark, sf_dir)
    seen = rows.where(F.col("time") <= F.lit(HIGH)).groupBy("symbol").agg(F.max("time").alias("last_time"))
    return aggregates.new_since(rows, seen)


# Batches: operations come from the tables by rules on their keys


def _ops(spark, sf_dir, kinds: str) -> tuple[DataFrame, DataFrame]:
    """Base: events with even numbers. Operations: others, and some of the base again."""
    rows = t.events(spark, sf_dir).select("symbol", "time", "seq", "value")
    ops = rows.withColumn("op", F.expr(kinds)).where("op IS NOT NULL").withColumn("idx", F.col("seq"))
    return rows.where("seq % 2 = 0"), ops.withColumn("value", F.col("value") + 1000)


_BASE = f"(SELECT symbol, time, seq, value FROM {t.EVENTS} WHERE seq % 2 = 0)"
_ALL = f"(SELECT symbol, time, seq, value FROM {t.EVENTS})"


def _batch(kinds: str):
    def run(spark, sf_dir):
        return batch.apply_batch(*_ops(spark, sf_dir, kinds))

    return run


def _batch_sql(kinds: str) -> str:
    return f"""
WITH ops AS (SELECT symbol, time, seq, value + 1000 AS value, {kinds} AS op FROM {_ALL})
SELECT * FROM {_BASE} b WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.op IS NOT NULL AND o.symbol = b.symbol AND o.time = b.time AND o.seq = b.seq)
UNION ALL SELECT symbol, time, seq, value FROM ops WHERE op IN ('put', 'upsert')"""


for _name, _kinds in (
    ("batch_put", "CASE WHEN seq % 2 = 1 AND seq % 10 = 1 THEN 'put' END"),
    ("batch_upsert", "CASE WHEN seq % 5 = 0 THEN 'upsert' END"),
    ("batch_delete", "CASE WHEN seq % 3 = 0 THEN 'del' END"),
):
    _run = _batch(_kinds)
    _run.__name__ = _name
    register(_batch_sql(_kinds))(_run)


def _mixed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two operations on some keys: the first by rest of 3, the second by rest of 4."""
    base, _ = _ops(spark, sf_dir, "CAST(NULL AS STRING)")
    rows = t.events(spark, sf_dir).select("symbol", "time", "seq", "value")
    first = rows.where("seq % 3 = 0").select("symbol", "time", "seq", (F.col("value") + 1).alias("value"), F.lit("upsert").alias("op"), F.col("seq").alias("idx"))
    second = rows.where("seq % 4 = 0").select("symbol", "time", "seq", (F.col("value") + 2).alias("value"), F.when(F.col("seq") % 8 == 0, "del").otherwise("upsert").alias("op"), (F.col("seq") + 1_000_000_000).alias("idx"))
    return base, first.unionByName(second)


_MIXED = f"""
WITH ops AS (SELECT symbol, time, seq, value + 1 AS value, 'upsert' AS op, 0 AS o FROM {_ALL} WHERE seq % 3 = 0
  UNION ALL SELECT symbol, time, seq, value + 2, CASE WHEN seq % 8 = 0 THEN 'del' ELSE 'upsert' END, 1 FROM {_ALL} WHERE seq % 4 = 0),
net AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, time, seq ORDER BY o DESC) AS n FROM ops) WHERE n = 1)
SELECT * FROM {_BASE} b WHERE NOT EXISTS (SELECT 1 FROM net o WHERE o.symbol = b.symbol AND o.time = b.time AND o.seq = b.seq)
UNION ALL SELECT symbol, time, seq, value FROM net WHERE op <> 'del'"""


@register(_MIXED)
def batch_mixed_last_wins(spark, sf_dir):
    return batch.apply_batch(*_mixed(spark, sf_dir))


@register(f"SELECT symbol, time, seq, seq AS idx, 'duplicate' AS rule FROM {_BASE} WHERE seq % 7 = 0 UNION ALL SELECT symbol, time, seq, seq + 1000000000 AS idx, 'duplicate' AS rule FROM {_ALL} WHERE seq % 7 = 0 AND seq % 11 <> 0")
def batch_violations(spark, sf_dir):
    """Puts of every seventh event, each put again unless it was deleted meanwhile."""
    base, puts = _ops(spark, sf_dir, "CASE WHEN seq % 7 = 0 THEN 'put' END")
    gone = puts.where("seq % 11 = 0").withColumn("op", F.lit("del")).withColumn("idx", F.col("idx") + 500_000_000)
    again = puts.withColumn("idx", F.col("idx") + 1_000_000_000)
    return batch.violations(base, puts.unionByName(gone).unionByName(again))


@register(f"SELECT * FROM {t.EVENTS} WHERE NOT (symbol = {USER} AND {IN_WEEK})")
def delete_range(spark, sf_dir):
    return batch.delete_range(t.events(spark, sf_dir), USER, LOW, HIGH)


@register(f"SELECT * FROM {t.EVENTS} WHERE NOT (symbol = {USER} AND time < {ts(MIDDLE)})")
def truncate_before(spark, sf_dir):
    return batch.truncate_before(t.events(spark, sf_dir), USER, MIDDLE)


@register(f"SELECT * FROM {t.EVENTS} WHERE symbol <> {USER}")
def symbol_drop(spark, sf_dir):
    return batch.symbol_drop(t.events(spark, sf_dir), USER)


@register(f"SELECT symbol, min(time) AS min_time, max(time) AS max_time, count(*) AS record_count FROM {t.EVENTS} WHERE NOT (symbol = {USER} AND time < {ts(MIDDLE)}) GROUP BY symbol")
def truncate_then_stats(spark, sf_dir):
    return aggregates.symbol_info(batch.truncate_before(t.events(spark, sf_dir), USER, MIDDLE))


@register("SELECT user_id AS symbol, ts AS time, event_id AS seq, event_id AS idx, 'width' AS rule FROM events WHERE user_id % 2 = 0 AND octet_length(encode(props)) <> 9")
def width_check(spark, sf_dir):
    """Upserts of the props text, where users with even numbers take values of nine bytes only."""
    rows = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.col("ts").alias("time"), F.col("event_id").alias("seq"), F.encode("props", "UTF-8").alias("value"))
    widths = rows.select("symbol").distinct().withColumn("record_size", F.when(F.col("symbol") % 2 == 0, 9).otherwise(0))
    return batch.violations(rows.limit(0), rows.withColumn("op", F.lit("upsert")).withColumn("idx", F.col("seq")), widths)


_DAMAGED = "(SELECT user_id AS symbol, CASE WHEN event_id % 11 = 0 THEN TIMESTAMP '2024-01-01' ELSE ts END AS time, CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id END AS seq FROM events)"


@register(f"""
SELECT count(*) AS records, count(DISTINCT symbol) + 1 AS symbols,  -- and the one that only the catalog has
  (SELECT count(*) FROM (SELECT 1 FROM {_DAMAGED} GROUP BY symbol, time, seq HAVING count(*) > 1)) AS repeated_keys,
  (SELECT count(*) FROM (SELECT symbol, count(*) AS n, min(time) AS lo, max(time) AS hi FROM {_DAMAGED} GROUP BY symbol) d
   FULL JOIN (SELECT user_id AS symbol, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events WHERE user_id <> 5 GROUP BY user_id UNION ALL SELECT 987654321, 0, NULL, NULL) c ON c.symbol = d.symbol
   WHERE coalesce(d.n, 0) <> coalesce(c.n, -1) OR d.lo IS DISTINCT FROM c.lo OR d.hi IS DISTINCT FROM c.hi) AS bad_symbols,
  CAST(0 AS BIGINT) AS bad_order FROM {_DAMAGED}""")
def verify_report(spark, sf_dir):
    """Records of which some are moved onto one key, against a catalog from before that lacks a symbol and has one without records."""
    rows = t.events(spark, sf_dir)
    moved = F.col("seq") % 11 == 0
    damaged = rows.select("symbol", F.when(moved, at(datetime(2024, 1, 1))).otherwise(F.col("time")).alias("time"), F.when(moved, 0).otherwise(F.col("seq")).cast("long").alias("seq"))
    catalog = aggregates.symbol_info(rows).where("symbol <> 5")
    none = spark.range(1).select(F.lit(987654321).cast("long").alias("symbol"), F.lit(0).cast("long").alias("record_count"))
    return batch.verify(damaged, catalog.unionByName(none, allowMissingColumns=True))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_join_le(spark, sf_dir)


# Queries of a store made for the purpose in the shared folder


def _new_store(spark) -> Store:
    return Store.open(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")


def _records(spark, sf_dir) -> DataFrame:
    """Events as records with a number of submission."""
    return t.table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), F.col("event_id").alias("seq"), F.encode("event_type", "UTF-8").alias("value"), F.col("event_id").alias("idx"))


def _store(spark, sf_dir):
    """A store with the events of the first users, in three commits: a put, an upsert, a delete."""
    store = _new_store(spark)
    rows = _records(spark, sf_dir)
    store.write(Batch(frame=rows.withColumn("op", F.lit("put"))))
    store.write(Batch(frame=rows.where("seq % 5 = 0").withColumn("value", F.encode(F.lit("changed"), "UTF-8")).withColumn("op", F.lit("upsert"))))
    store.write(Batch(frame=rows.where("seq % 7 = 0").withColumn("op", F.lit("del"))))
    store.truncate_before(USER, 1_704_585_600_000_000)
    return store


_read_only: dict[tuple[str, str], Store] = {}


def _one_store(spark, sf_dir) -> Store:
    """The store of ``_store`` for queries that don't change it: made once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _read_only or not _read_only[key].files.exists("versions"):
        _read_only[key] = _store(spark, sf_dir)
    return Store.open(spark, _read_only[key].files.root)


_STORE = "(SELECT user_id AS symbol, epoch_us(ts) AS time, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'changed' ELSE event_type END AS value FROM events WHERE event_id % 7 <> 0 AND NOT (user_id = 3 AND epoch_us(ts) < 1704585600000000))"


@register(f"SELECT * FROM {_STORE}")
def store_after_commits(spark, sf_dir):
    return _one_store(spark, sf_dir).snapshot().frame().withColumn("value", F.decode("value", "UTF-8"))


@register(f"SELECT symbol, count(*) AS record_count, min(time) AS min_time, max(time) AS max_time FROM {_STORE} GROUP BY symbol")
def store_catalog(spark, sf_dir):
    return _one_store(spark, sf_dir).snapshot().catalog().where("record_count > 0").select("symbol", "record_count", "min_time", "max_time")


@register(f"SELECT symbol, count(*) AS record_count FROM {_STORE} GROUP BY symbol")
def backup_compare(spark, sf_dir):
    store = _one_store(spark, sf_dir)
    to = f"{store.files.root}-copy-{uuid.uuid4().hex}"
    store.backup(to)
    return Store.open(spark, to, "r").snapshot().frame().groupBy("symbol").agg(F.count(F.lit(1)).alias("record_count"))


_BY_SYMBOL = "SELECT symbol, count(*) AS record_count, min(time) AS min_time, max(time) AS max_time FROM {} GROUP BY symbol"


def _by_symbol(store: Store) -> DataFrame:
    """What the catalog says, only if the records say the same."""
    now = store.snapshot()
    facts = now.frame().groupBy("symbol").agg(F.count(F.lit(1)).alias("record_count"), F.min("time").alias("min_time"), F.max("time").alias("max_time"))
    return now.catalog().select("symbol", "record_count", "min_time", "max_time").join(facts, facts.columns)


@register(_BY_SYMBOL.format(f"{_STORE} WHERE NOT (symbol = 5 AND time BETWEEN 1704672000000000 AND 1705276799000000)"))
def store_delete_range(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.delete_range(5, 1_704_672_000_000_000, 1_705_276_799_000_000)
    return _by_symbol(store)


@register(_BY_SYMBOL.format(f"{_STORE} WHERE NOT (symbol = 8 AND time < 1704974400000000)"))
def store_truncate_before(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.truncate_before(8, 1_704_974_400_000_000)
    return _by_symbol(store)


@register(_BY_SYMBOL.format(f"{_STORE} WHERE symbol <> 8"))
def store_symbol_drop(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.symbol_drop(8)
    return _by_symbol(store)


@register("SELECT * FROM (VALUES ('empty batch', 1), ('three operations', 2), ('the same batch again', 3), ('cleared', 3), ('metadata only', 4)) AS x(step, txn)")
def store_batch_lifecycle(spark, sf_dir):
    """The commit counter after each step of a batch's life."""
    store, b, out = _new_store(spark), Batch(), []
    out.append(("empty batch", store.write(b)))
    b.upsert(1, 1, b"a").upsert(1, 2, b"b").delete(1, 9)
    out += [("three operations", store.write(b)), ("the same batch again", store.write(b))]
    b.clear()
    out.append(("cleared", store.write(b)))
    out.append(("metadata only", store.write(Batch().put_meta("k", b"v"))))
    return spark.createDataFrame(out, "step string, txn int")


@register("SELECT * FROM (VALUES ('cursor', '43'), ('kept', 'x'), ('erased', NULL), ('unknown', NULL)) AS x(key, value)")
def store_meta(spark, sf_dir):
    store = _new_store(spark)
    store.write(Batch().put(1, 1, b"a").put_meta("cursor", b"41").put_meta("kept", b"x").put_meta("erased", b"y"))
    store.write(Batch().put_meta("cursor", b"42").put_meta("cursor", b"43").put_meta("erased", b""))

    def value(key):
        try:
            return store.snapshot().get_meta(key).decode()
        except NotFound:
            return None

    return spark.createDataFrame([(k, value(k)) for k in ("cursor", "kept", "erased", "unknown")], "key string, value string")


@register("SELECT * FROM (VALUES ('at first', 1), ('behind', 3), ('timeout', 3), ('other process', 3)) AS x(step, txn)")
def store_txn_wait(spark, sf_dir):
    """Commit counters as read, waited for and not reached in time."""
    store = _new_store(spark)
    out = [("at first", store.txn_id())]
    store.write(Batch().put(1, 1, b"a"))
    store.write(Batch().put(1, 2, b"b"))
    out.append(("behind", store.wait_for_txn(1, 1.0)))
    try:
        store.wait_for_txn(3, 0.01)
    except NotFound as e:
        out.append(("timeout", e.details["txn"]))
    out.append(("other process", Store.open(spark, store.files.root, "r").txn_id()))
    return spark.createDataFrame(out, "step string, txn int")


@register("SELECT * FROM (VALUES (7, 4, 2), (9, 8, 0)) AS x(symbol, record_size, record_count)")
def store_define_sync(spark, sf_dir):
    """Declared widths, a commit that isn't synced at first, and a value of another width that is refused."""
    store = _new_store(spark)
    store.symbol_define(7, 4)
    store.symbol_define(9, 8)
    store.write(Batch().put(7, 1, b"0001").put(7, 2, b"0002"), sync=False)
    store.sync()
    try:
        store.write(Batch().put(9, 1, b"short"))
    except StoreError:
        return store.snapshot().catalog().select(F.col("symbol").cast("int").alias("symbol"), F.col("record_size").cast("int").alias("record_size"), F.col("record_count").cast("int").alias("record_count"))


@register(f"SELECT count(*) AS records, count(DISTINCT symbol) AS symbols, CAST(0 AS BIGINT) AS errors FROM {_STORE}")
def store_verify(spark, sf_dir):
    report = _one_store(spark, sf_dir).verify()
    return spark.createDataFrame([(report["records"], report["symbols"], len(report["errors"]))], "records long, symbols long, errors long")


@register(f"SELECT count(*) AS records, count(DISTINCT symbol) AS symbols, CAST(5 AS BIGINT) AS txn, true AS has_bytes, {FORMAT} AS format, {VERSION} AS version FROM {_STORE}")
def store_stats(spark, sf_dir):
    found = _one_store(spark, sf_dir).stats()
    return spark.createDataFrame([(found["records"], found["symbols"], found["txn"], 0 < found["data_bytes"] <= found["store_bytes"], found["format"], found["version"])], "records long, symbols long, txn long, has_bytes boolean, format int, version int")


@register(f"SELECT time, seq, value FROM {_STORE} WHERE symbol = 5")
def store_prefetch(spark, sf_dir):
    rows = _one_store(spark, sf_dir).snapshot().prefetch(5)
    return rows.select("time", "seq", F.decode("value", "UTF-8").alias("value"))


@register(f"SELECT 'closed' AS what, CAST(-2 AS BIGINT) AS n UNION ALL SELECT 'opened again', count(*) FROM {_STORE} UNION ALL SELECT 'read only', -2")
def store_open_close(spark, sf_dir):
    """Statuses of a closed store and of a write to one that is open for reading, and the records of one opened again."""
    store = _one_store(spark, sf_dir)
    out = []
    with store:
        pass
    for what, call in (("closed", store.snapshot), ("read only", lambda: Store.open(spark, store.files.root, "r").write(Batch().put(1, 1, b"")))):
        try:
            call()
        except StoreError as e:
            out.append((what, int(e.status)))
    out.append(("opened again", Store.open(spark, store.files.root).snapshot().frame().count()))
    return spark.createDataFrame(out, "what string, n long")


@register("SELECT * FROM (VALUES " + ", ".join(f"({int(x)}, '{strerror(x)}')" for x in Status) + ") AS x(status, meaning)")
def status_meanings(spark, sf_dir):
    return spark.createDataFrame([(int(x), strerror(x)) for x in Status], "status int, meaning string")


def _walked(spark, cursor: Cursor) -> DataFrame:
    """The records that a cursor hands out, numbered; a page at a time reaches the driver."""
    return spark.createDataFrame([(i, int(r["symbol"]), int(r["time"]), r["seq"], bytes(r["value"]).decode()) for i, r in enumerate(cursor, 1)], "pos long, symbol long, time long, seq long, value string")


@register(f"SELECT row_number() OVER ({FORWARD}) AS pos, * FROM {_STORE} WHERE symbol = 5")
def cursor_walk(spark, sf_dir):
    with Cursor(_one_store(spark, sf_dir), 5, chunk=32) as cursor:
        return _walked(spark, cursor)


@register(f"SELECT row_number() OVER ({MERGED}) AS pos, * FROM {_STORE} WHERE symbol IN ({LISTED})")
def cursor_merged(spark, sf_dir):
    with Cursor(_one_store(spark, sf_dir), USERS, chunk=64) as cursor:
        return _walked(spark, cursor)


@register(f"SELECT row_number() OVER (ORDER BY time DESC, seq DESC) AS pos, * FROM {_STORE} WHERE symbol = 5 AND time <= 1704974400000000")
def cursor_reverse_seek(spark, sf_dir):
    with Cursor(_one_store(spark, sf_dir), 5, chunk=32, reverse=True) as cursor:
        cursor.next()
        cursor.seek(1_704_974_400_000_000, (1 << 32) - 1)
        return _walked(spark, cursor)


@register(f"SELECT (pos - 1) // 16 AS batch, count(*) AS records, min(time) AS first_time FROM (SELECT row_number() OVER ({FORWARD}) AS pos, time FROM {_STORE} WHERE symbol = 5) GROUP BY batch")
def cursor_batches(spark, sf_dir):
    """Sizes and first times of the batches of a cursor, each a chunk."""
    out = []
    with Cursor(_one_store(spark, sf_dir), 5, chunk=16) as cursor:
        while rows := cursor.next_batch(1000):
            out.append((len(out), len(rows), int(rows[0]["time"])))
    return spark.createDataFrame(out, "batch long, records long, first_time long")


@register(f"""
WITH old AS (SELECT row_number() OVER ({FORWARD}) AS pos, time, seq, value FROM {_STORE} WHERE symbol = 5),
rest AS (SELECT time, seq, value FROM old WHERE pos > 10 AND pos <> 12 UNION ALL SELECT 9000000000000000, 1, 'late')
SELECT pos, time, seq, value FROM old WHERE pos <= 10 UNION ALL SELECT 10 + row_number() OVER (ORDER BY time, seq), time, seq, value FROM rest""")
def cursor_live(spark, sf_dir):
    """A read-committed cursor past a commit that removes a record ahead, adds one at the end, and one behind it."""
    store = _store(spark, sf_dir)
    cursor = Cursor(store, 5, live=True, chunk=10)
    out = cursor.next_batch(10)
    ahead = store.snapshot().scan(5, limit=12).collect()[11]  # twelve rows
    store.write(Batch().delete(5, ahead["time"], ahead["seq"]).put(5, 9_000_000_000_000_000, b"late", seq=1).put(5, 1, b"behind"))
    out += list(cursor)
    return spark.createDataFrame([(i, int(r["time"]), r["seq"], bytes(r["value"]).decode()) for i, r in enumerate(out, 1)], "pos long, time long, seq long, value string")


def _streamed(spark, sf_dir) -> Store:
    """A store that a stream of the events fills: the files of a folder, then one more with changed values."""
    store, at_ = _new_store(spark), f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = _records(spark, sf_dir)
    for part in (rows, rows.where("seq % 4 = 0").withColumn("value", F.encode(F.lit("again"), "UTF-8"))):
        part.write.mode("append").parquet(f"{at_}/in")
        ingest(spark.readStream.schema(rows.schema).parquet(f"{at_}/in"), store, "events", f"{at_}/checkpoint", order="idx").awaitTermination()
    return store


_STREAMED = "SELECT user_id AS symbol, epoch_us(ts) AS time, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'again' ELSE event_type END AS value FROM events"


@register(_STREAMED)
def stream_ingest(spark, sf_dir):
    return _streamed(spark, sf_dir).snapshot().frame().withColumn("value", F.decode("value", "UTF-8"))


@register(f"{_STREAMED} WHERE event_id % 4 = 0")
def stream_tail(spark, sf_dir):
    """What the second micro-batch brought, without the other records of the files that it wrote again."""
    store, seen = _streamed(spark, sf_dir), []
    newest = store.snapshot
    store.snapshot = lambda: newest() if seen else seen.append(None) or _earlier(store, 2)  # as of the first one
    rows = []
    tail(store, 2, lambda df, txn: rows.append(df), 0.05, commits=1)
    return rows[0].select("symbol", "time", "seq", F.decode("value", "UTF-8").alias("value"))


def _earlier(store: Store, txn: int):
    import json

    from ..sources.store import Snapshot

    return Snapshot(store, json.loads(store.files.read(store._name(txn))))


@register("SELECT date_trunc('hour', ts) AS hour, user_id AS symbol, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("time"))
    return windowed_counts(rows).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "symbol", "n")


def bench_write(spark, sf_dir) -> DataFrame:
    """Ingest: all events in one commit of a new store; its records by the catalog."""
    store = _new_store(spark)
    store.write(Batch(frame=_records(spark, sf_dir).withColumn("op", F.lit("put"))))
    return store.snapshot().catalog()


def bench_scan(spark, sf_dir) -> DataFrame:
    """All records of a snapshot."""
    return _one_store(spark, sf_dir).snapshot().frame()
