"""Operators against small series and a plain Python model."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.errors import CapacityError, InvalidError
from tidemark.operators import aggregates, batch, merge, point, scan

SCHEMA = "symbol long, time long, seq long, value string"


def frame(spark, rows):
    return spark.createDataFrame([(s, t, q, f"v{s}.{t}.{q}") for s, t, q in rows], SCHEMA)


def keys(df):
    return [(r["symbol"], r["time"], r["seq"]) for r in df.collect()]


def test_asof_scalar(spark):
    df = frame(spark, [(5, 1000, 0), (5, 2000, 0), (5, 3000, 0), *((6, 500, q) for q in range(4))])
    assert keys(point.get_le(df, 5, 500)) == []
    assert keys(point.get_le(df, 5, 2500)) == [(5, 2000, 0)]
    assert keys(point.get_ge(df, 5, 2500)) == [(5, 3000, 0)]
    assert keys(point.get_ge(df, 5, 3001)) == []
    assert keys(point.get_le(df, 6, 500)) == [(6, 500, 3)]
    assert keys(point.get_ge(df, 6, 500)) == [(6, 500, 0)]
    assert keys(point.get(df, 6, 500)) == [(6, 500, 0)]
    assert keys(point.get(df, 6, 500, 3)) == [(6, 500, 3)]
    assert keys(point.get(df, 77, 500)) == []


@pytest.mark.parametrize("direction", ["le", "ge"])
@pytest.mark.parametrize("bucket", [None, 10])
def test_asof_join_model(spark, direction, bucket):
    rng = random.Random(4)
    records = {(rng.randrange(4), rng.randrange(60), rng.randrange(3)) for _ in range(90)}
    probes = [(rng.randrange(5), rng.randrange(-5, 70), i) for i in range(80)]
    out = point.asof_join(spark.createDataFrame(probes, "symbol long, time long, probe long"), frame(spark, records), direction, bucket=(lambda t: F.floor(t / bucket)) if bucket else None)
    got = {r["probe"]: (r["found"]["time"], r["found"]["seq"]) if r["found"] else None for r in out.collect()}
    for s, t, i in probes:
        near = [(a, q) for x, a, q in records if x == s and (a <= t if direction == "le" else a >= t)]
        assert got[i] == ((max(near) if direction == "le" else min(near)) if near else None)


def test_scan_and_pages(spark):
    df = frame(spark, [(30, i // 2, i % 2) for i in range(500)])
    assert len(keys(scan.scan(df, 30, 100, 200))) == 202
    assert keys(scan.scan(df, 30, reverse=True, limit=3)) == [(30, 249, 1), (30, 249, 0), (30, 248, 1)]
    assert keys(scan.page(df, 30, 2, (10, 0))) == [(30, 10, 1), (30, 11, 0)]
    assert keys(scan.page(df, 30, 2, (10, 0), reverse=True)) == [(30, 9, 1), (30, 9, 0)]
    assert keys(scan.seek(df, 30, 10, 1, 0, 11)) == [(30, 10, 1), (30, 11, 0), (30, 11, 1)]
    assert keys(scan.seek(df, 30, 0, 0, 248, 300))[0] == (30, 248, 0)  # clamped to the bounds
    assert scan.range_count(df, 30, 100, 200).first()["n"] == 202
    assert scan.read_range(df, 30, 0, 1, cap=4).count() == 4
    with pytest.raises(CapacityError) as e:
        scan.read_range(df, 30, 0, 1, cap=3)
    assert e.value.details["rows"].count() == 3
    with pytest.raises(InvalidError):
        scan.scan(df, 30, 2, 1)
    assert [r["chunk"] for r in scan.chunked(scan.bounded(df, 30, 0, 2), 4, "time", "seq").orderBy("pos").collect()] == [0, 0, 0, 0, 1, 1]


def test_merge(spark):
    df = frame(spark, [(s, 5000, q) for s in (303, 101, 202) for q in (0, 1)])
    assert keys(merge.scan_multi(df, [303, 101, 9, 202])) == [(101, 5000, 0), (202, 5000, 0), (303, 5000, 0), (101, 5000, 1), (202, 5000, 1), (303, 5000, 1)]
    assert keys(merge.scan_multi(df, [101, 202], 0, 4999)) == []
    assert keys(merge.scan_multi(df, [])) == []
    assert len(keys(merge.scan_multi(df, [101, 101]))) == 4
    assert keys(merge.merge_page(df, [101, 202, 303], 2, (5000, 0, 202))) == [(303, 5000, 0), (101, 5000, 1)]
    for bad in ({"symbols": None}, {"symbols": [1], "reverse": True}, {"symbols": [1], "low": 2, "high": 1}):
        with pytest.raises(InvalidError):
            merge.scan_multi(df, **bad)


def test_facts(spark):
    df = frame(spark, [(s, i * (k + 1), 0) for k, s in enumerate((100, 200, 300)) for i in range(1, 11)])
    assert tuple(aggregates.symbol_info(df, 200).first()) == (200, 2, 20, 10)
    watched = merge.watchlist(spark, [100, 4242, 300, 100], df.schema["symbol"].dataType)
    assert [r["max_time"] for r in aggregates.max_times(df, watched).orderBy("idx").collect()] == [10, 0, 30, 10]
    assert aggregates.count(df, 4242).first()["record_count"] == 0
    assert aggregates.max_time(df, 4242).first() is None


def test_batch_model(spark):
    """Many small batches, each in a symbol of its own, against the rules played one by one."""
    rng = random.Random(1)
    base, ops, want, first_bad = [], [], {}, {}
    for case in range(150):
        held = {(t, 0): "b" for t in range(3) if rng.random() < 0.5}
        base += [(case, t, 0, "b") for t, _ in held]
        steps = [(rng.choice(["put", "upsert", "del"]), rng.randrange(4), f"x{i}") for i in range(rng.randrange(1, 7))]
        ops += [(op, case, t, 0, None if op == "del" else v, i) for i, (op, t, v) in enumerate(steps)]
        for i, (op, t, v) in sorted(enumerate(steps), key=lambda x: (x[1][1], x[0])):
            if op == "put" and (t, 0) in held and case not in first_bad:
                first_bad[case] = (t, i)
            if op == "del":
                held.pop((t, 0), None)
            else:
                held[t, 0] = v
        want[case] = held
    base, ops = spark.createDataFrame(base, SCHEMA), spark.createDataFrame(ops, "op string, symbol long, time long, seq long, value string, idx long")
    bad = {}
    for r in batch.violations(base, ops).orderBy("symbol", "time", "seq", "idx").collect():
        bad.setdefault(r["symbol"], (r["time"], r["idx"]))
    assert bad == first_bad
    got = {}
    for r in batch.apply_batch(base, ops).collect():
        got.setdefault(r["symbol"], {})[r["time"], r["seq"]] = r["value"]
    for case, held in want.items():
        if case not in first_bad:
            assert got.get(case, {}) == held


def test_deletes(spark):
    df = frame(spark, [*((13, 10 * i, 0) for i in range(2000)), (13, 5000, 1), (14, 5000, 0)])
    assert batch.delete_range(df, 13, 5000, 9990).count() == 2002 - 501
    assert batch.truncate_before(df, 13, 10000).agg(F.min("time")).first()[0] == 5000  # symbol 14 stays
    assert keys(batch.symbol_drop(df, 13)) == [(14, 5000, 0)]
    with pytest.raises(InvalidError):
        batch.delete_range(df, 13, 2, 1)
    assert tuple(batch.verify(df, aggregates.symbol_info(df)).first()) == (2002, 2, 0, 0, 0)
    assert batch.verify(df.union(df.limit(1))).first()["repeated_keys"] == 1


def test_codec(spark):
    from pyspark.sql import types as T

    from tidemark.functions import codec

    bar = T.StructType([T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close")] + [T.StructField("volume", T.LongType()), T.StructField("pad", T.LongType())])
    df = spark.range(20).select("id", F.col("id").cast("double").alias("open"), (F.col("id") + 1.0).alias("high"), (F.col("id") - 1.0).alias("low"), (F.col("id") + 0.5).alias("close"), (F.col("id") + 1000).alias("volume"), F.lit(0).cast("long").alias("pad"))
    packed = codec.pack(df, bar)
    assert packed.select(F.max(F.octet_length("value"))).first()[0] == 48
    assert sorted(map(tuple, codec.unpack(packed, bar).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(InvalidError):
        codec.layout(T.StructType([T.StructField("x", T.StringType())]))
