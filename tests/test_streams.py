"""Recurrences along streams that stop and go on, against the same over tables."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import recurrences, simulation
from millrace.streaming import events, paths


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(paths.PROVIDER)
    spark.conf.set(paths.PROVIDER, paths.ROCKS)
    yield spark
    spark.conf.set(paths.PROVIDER, before)


def arrivals(spark, sf, folder):
    """Events in eight files by time; returns all of them and a function that adds files."""
    table = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") + 1).alias("px"))
    rows = table.orderBy("ts", "event_id").toPandas()
    size = -(-len(rows) // 8)

    def add(k, part=None):
        own = rows.iloc[k * size : (k + 1) * size] if part is None else part
        spark.createDataFrame(own, table.schema).coalesce(1).write.mode("append").parquet(folder)

    return table, rows, add


def in_order(table):
    return table.withColumn("s", F.row_number().over(Window.orderBy("ts", "event_id")))


def same(got, want, name):
    a = {(r["user_id"], r["event_id"]): r[name] for r in got.collect()}
    b = {(r["user_id"], r["event_id"]): r[name] for r in want.collect()}
    assert got.count() == len(a) == len(b) and set(a) == set(b) and all(a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12) for k in b)


@pytest.mark.parametrize("rule,options", [("ewma", {"keep": 0.94}), ("drawdown", {})])
def test_a_stream_that_stops_and_goes_on(rocks, sf, tmp_path, rule, options):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    table, _, add = arrivals(rocks, sf, source)
    add(0)
    made = lambda: paths.along_stream(events.read_stream(rocks, source, table.schema, 1), "user_id", "ts", "event_id", "px", rule, **options)
    for some in ([1, 2], [3], [4, 5, 6, 7]):
        for k in some:
            add(k)
        query = paths.to_folder(made(), out, mark)  # each time from the checkpoint
        query.awaitTermination(300)
        assert query.exception() is None
    ordered = in_order(table)
    want = recurrences.ewma(ordered, "user_id", "s", "px", 0.94) if rule == "ewma" else simulation.drawdowns(ordered, "user_id", "s", "px")
    want = want.join(ordered.select("s", "event_id"), "s") if rule == "ewma" else want
    same(paths.read_folder(rocks, out), want, rule)


def test_late_rows_wait_for_the_watermark(rocks, sf, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    table, rows, add = arrivals(rocks, sf, source)
    mixed = rows.sample(frac=1, random_state=1)  # in any order; no row is later than the whole time
    size = -(-len(rows) // 3)
    end = rows.iloc[-1:].assign(user_id=-1, ts=rows["ts"].max() + pd.Timedelta(days=2000), event_id=10**9)
    for k in range(3):
        add(0, mixed.iloc[k * size : (k + 1) * size])
        if k == 1:  # stops here
            paths.to_folder(paths.along_stream(events.read_stream(rocks, source, table.schema, 1), "user_id", "ts", "event_id", "px", "held", "1000 days", band=5.0), out, mark).awaitTermination(300)
    add(0, end)
    query = paths.to_folder(paths.along_stream(events.read_stream(rocks, source, table.schema, 1), "user_id", "ts", "event_id", "px", "held", "1000 days", band=5.0), out, mark)
    query.awaitTermination(300)
    assert query.exception() is None
    ordered = in_order(table)
    want = recurrences.banded(ordered, "user_id", "s", "px", 5.0).join(ordered.select("s", "event_id"), "s")
    same(paths.read_folder(rocks, out).where("user_id <> -1"), want, "held")


def test_a_batch_that_comes_again_is_there_once(spark, sf, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    table, rows, add = arrivals(spark, sf, source)
    add(0)
    seen = []
    stream = lambda: events.read_stream(spark, source, table.schema, 1)
    paths.each_batch(stream(), lambda df, k: seen.append((k, df.count())), str(tmp_path / "a")).awaitTermination(120)
    assert [k for k, _ in seen] == [0] and seen[0][1] == -(-len(rows) // 8)
    for k in "bc":  # two checkpoints, so that batch 0 comes twice
        paths.to_folder(stream(), out, str(tmp_path / k)).awaitTermination(120)
    assert paths.read_folder(spark, out).count() == seen[0][1]


def test_other_state_stores_are_refused(spark, sf):
    with pytest.raises(ValueError):
        paths.along_stream(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts", "event_id", "value", "ewma")
