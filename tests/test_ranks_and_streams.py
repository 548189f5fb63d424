"""Ranks, running values and quantiles over placed parts; snapshots in buckets; stream statistics with late rows; SQL functions."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import ranks, stats
from gridloom.operators.rounds import Rounds


def rows(seed, n=300):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["a", "b", None]), rnd.choice([None, *[round(rnd.uniform(-5, 5), 1)] * 4]), rnd.randint(0, 9)) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(1), "i long, g string, v double, n int").repartition(5)


def test_running_sums_largest_after_and_next_row(spark, table):
    placed = ranks.placed(table, ["g", "n", "i"], Rounds(spark, "test"))
    out = ranks.running_sums(placed, ["g"], {"total": "n", "count": F.lit(1)})
    out = ranks.next_row(ranks.largest_after(out, ["g"], "v", "top"), ["g"], ["i"], "then").collect()
    got = {r.i: (r.total, r["count"], r.top, r.then.i if r.then else None) for r in out}
    for g in ("a", "b", None):
        mine = sorted((r for r in rows(1) if r[1] == g), key=lambda r: (r[3], r[0]))
        for k, r in enumerate(mine):
            after = [x[2] for x in mine[k:] if x[2] is not None]
            assert got.pop(r[0]) == (sum(x[3] for x in mine[: k + 1]), k + 1, max(after, default=None), mine[k + 1][0] if k + 1 < len(mine) else None)
    assert not got


def test_global_rank_has_no_window_over_all_rows(spark, table):
    ranked = ranks.global_rank(table, [F.desc("i")], "rank", Rounds(spark, "test"))
    assert {r.i: r["rank"] for r in ranked.collect()} == {i: 300 - i for i in range(300)}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_equal_numpy(spark, table, by):
    shares = [0.0, 0.02, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g if by else 0): r.q for r in ranks.quantiles(table, by, "v", shares, Rounds(spark, "test")).collect()}
    for g in ("a", "b", None) if by else (0,):
        v = [r[2] for r in rows(1) if r[2] is not None and (not by or r[1] == g)]
        assert np.allclose(got.pop(g), np.quantile(v, shares), atol=1e-12)
    assert not got
    nothing = ranks.quantiles(table.limit(0), by, "v", shares, Rounds(spark, "test")).collect()
    assert nothing == [] if by else [list(r.q) for r in nothing] == [[None] * 6]


def test_describe_equals_the_single_buffer(spark, table):
    r = stats.describe(table, ["v"]).first()
    q = table.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    assert [r.q25, r.q50, r.q75] == q
    empty = stats.describe(table.filter("v is null"), ["v", "n"]).filter("column = 'v'").first()
    assert (empty.n, empty.q50) == (0, None)


def snapshot(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_batch_touches_only_its_buckets(spark, tmp_path):
    from gridloom.streaming import files

    schema = spark.createDataFrame([(1, 5)], "k int, at int").schema
    held = None
    for n, batch in enumerate([[(k, 5) for k in range(40)], [(7, 9)], [(7, 1)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        files.upsert_latest(files.read_drops(spark, f"{tmp_path}/in", schema, 1), ["k"], "at", f"{tmp_path}/out", f"{tmp_path}/progress", 8).awaitTermination()
        now = snapshot(f"{tmp_path}/out/rows")
        if held is not None:
            assert all(now[f] == t for f, t in held.items()) and len(now) == len(held) + 1
        held = now
        listed = files.manifest(spark, f"{tmp_path}/out")
        assert len(listed) == 8 and sum(v == n for v in listed.values()) == (8 if n == 0 else 1)
    assert {tuple(r) for r in files.newest(spark, f"{tmp_path}/out").select("k", "at").collect()} == {(k, 9 if k == 7 else 5) for k in range(40)}


def test_late_rows_are_dropped_from_stream_statistics(spark, tmp_path):
    from gridloom.streaming import files

    schema = "ts timestamp, value double"
    batches = [[("2024-01-01 10:00:00", 1.0), ("2024-01-01 11:00:00", 3.0)], [("2024-01-09 10:00:00", 5.0)], [("2024-01-01 12:00:00", 100.0), ("2024-01-09 12:00:00", 7.0)]]
    for batch in batches:
        df = spark.createDataFrame(batch, "t string, value double").select(F.col("t").cast("timestamp").alias("ts"), "value")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = files.read_drops(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1)
        files.keep_daily_statistics(stream, "ts", "value", f"{tmp_path}/out", f"{tmp_path}/progress", "2 days").awaitTermination()
    got = {str(r.day)[:10]: (r.n, r.mean) for r in files.newest_days(spark, f"{tmp_path}/out").collect()}
    assert got == {"2024-01-01": (2, 2.0), "2024-01-09": (2, 6.0)}


def test_sql_functions_have_no_python(spark):
    from gridloom.functions import sql

    sql.register(spark)
    made = spark.sql("SELECT ndvi(1, 3) AS a, box_iou(0, 0, 2, 2, 1, 0, 3, 2) AS b, haversine_km(0, 0, 0, 1) AS c FROM range(3)")
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    r = made.first()
    assert abs(r.a - 0.5) < 1e-9 and abs(r.b - 1 / 3) < 1e-9 and abs(r.c - 111.19) < 0.01
