"""Queries of constructors, slices, axis variants and vectors, of CSV files, and of dates as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dates, text
from millrace.operators import construct, matrix, recurrences, reduce, relational, simulation
from millrace.plans.registry import query, r
from millrace.sources import csv
from millrace.sources.shared import shared_dir
from millrace.sources.tables import table

_CELLS = "WITH m AS (SELECT vec_id AS i, unnest(generate_series(0, 63)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) "
_ROW = "(PARTITION BY i ORDER BY j"


def _cells(spark, sf):
    return matrix.cells(table(spark, sf, "embeddings"), "vec_id", "embedding").withColumn("j", F.col("j").cast("long"))


@query("cumulative_along_rows", _CELLS + f"SELECT i, CAST(j AS BIGINT) AS j, round(sum(v) OVER {_ROW} ROWS UNBOUNDED PRECEDING), 6) AS total, max(v) OVER {_ROW} ROWS UNBOUNDED PRECEDING) AS top FROM m")
def cumulative_along_rows(spark, sf):
    m = _cells(spark, sf)
    return matrix.elementwise(matrix.cumulative(m, 1), matrix.cumulative(m, 1, "max"), lambda a, b: F.struct(a.alias("total"), b.alias("top"))).select("i", "j", r(F.col("v.total"), 6, "total"), "v.top")


@query("differences_along_rows", _CELLS + f"SELECT i, CAST(j - 1 AS BIGINT) AS j, round(d, 6) AS v FROM (SELECT i, j, v - lag(v) OVER {_ROW}) AS d FROM m) WHERE j > 0")
def differences_along_rows(spark, sf):
    return matrix.difference(_cells(spark, sf), 1).select("i", "j", r("v", 6))


@query("pct_change_along_rows", _CELLS + f"SELECT i, CAST(j AS BIGINT) AS j, CASE WHEN p IS NULL OR p = 0 THEN 'nan'::DOUBLE ELSE round((v - p) / p, 4) END AS v FROM (SELECT i, j, v, lag(v) OVER {_ROW}) AS p FROM m)")
def pct_change_along_rows(spark, sf):
    return matrix.pct_change(_cells(spark, sf), 1).select("i", "j", r("v", 4))


@query("shifted_along_rows", _CELLS + f"SELECT i, CAST(j AS BIGINT) AS j, lag(v, 2, -1) OVER {_ROW}) AS v FROM m")
def shifted_along_rows(spark, sf):
    return matrix.shifted(_cells(spark, sf), 2, 1, -1.0)


@query("sorted_along_rows", _CELLS + "SELECT i, row_number() OVER (PARTITION BY i ORDER BY v, j) - 1 AS j, v FROM m")
def sorted_along_rows(spark, sf):
    return matrix.ordered(_cells(spark, sf), 1)


@query("variance", "SELECT round(var_pop(l_quantity), 5) AS l_quantity, round(var_pop(l_extendedprice), 0) AS l_extendedprice, round(var_pop(l_tax), 9) AS l_tax FROM lineitem")
def variance(spark, sf):
    return reduce.variance(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]).select(r("l_quantity", 5), r("l_extendedprice", 0), r("l_tax", 9))


@query("histogram_of_edges", """WITH e AS (SELECT * FROM (VALUES (0, 1000.0::DOUBLE, 5000.0::DOUBLE), (1, 5000.0, 20000.0), (2, 20000.0, 21000.0), (3, 21000.0, 90000.0)) t(bin, left_edge, right_edge))
    SELECT bin, left_edge, right_edge, (SELECT count(*) FROM lineitem WHERE l_extendedprice >= left_edge AND (l_extendedprice < right_edge OR bin = 3 AND l_extendedprice = right_edge)) AS n FROM e""")
def histogram_of_edges(spark, sf):
    return reduce.histogram_of(table(spark, sf, "lineitem"), "l_extendedprice", [1000.0, 5000.0, 20000.0, 21000.0, 90000.0])


@query("identity", "SELECT i, i + 2 AS j, 1.0::DOUBLE AS v FROM range((SELECT count(*) FROM customer)) t(i) WHERE i + 2 < (SELECT count(*) FROM customer)")
def identity(spark, sf):
    return construct.eye(spark, table(spark, sf, "customer").count(), 2)


@query("diagonal_matrix", "SELECT c_custkey AS i, c_custkey AS j, c_acctbal AS v FROM customer")
def diagonal_matrix(spark, sf):
    return construct.diag(table(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("v")))


@query("filled_like", _CELLS + "SELECT i, CAST(j AS BIGINT) AS j, 7.5::DOUBLE AS v FROM m")
def filled_like(spark, sf):
    return construct.full_like(_cells(spark, sf), 7.5)


@query("tabulated", "SELECT k // 25 AS i, k % 25 AS j, CAST((k // 25) * 3 + k % 25 AS DOUBLE) AS v FROM range((SELECT count(*) FROM supplier) * 25) t(k)")
def tabulated(spark, sf):
    """A row for each supplier and a column for each nation."""
    return construct.tabulate(spark, table(spark, sf, "supplier").count(), 25, lambda i, j: i * 3 + j)


@query("price_grid", "SELECT k AS i, round(lo + k * (hi - lo) / (n - 1), 4) AS even, round(lo + k * 2.5, 4) AS step FROM (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders), range((SELECT count(*) FROM orders)) t(k) WHERE lo + k * 2.5 < hi")
def price_grid(spark, sf):
    """As many points as orders over the range of their prices, and steps of 2.5 from the least one."""
    lo, hi, n = table(spark, sf, "orders").agg(F.min("o_totalprice"), F.max("o_totalprice"), F.count(F.lit(1))).first()
    even, step = construct.linspace(spark, lo, hi, n), construct.arange(spark, lo, hi, 2.5)
    return even.withColumnRenamed("v", "even").join(step.withColumnRenamed("v", "step"), "i").select("i", r("even", 4), r("step", 4))


def _pair(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    return a, table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("double").alias("v"))


@query("outer_product", "SELECT s_suppkey AS i, CAST(n_nationkey AS BIGINT) AS j, s_acctbal * n_regionkey AS v FROM supplier, nation")
def outer_product(spark, sf):
    return matrix.outer(*_pair(spark, sf))


@query("grid_of_two", "SELECT CAST(n_nationkey AS BIGINT) AS i, s_suppkey AS j, s_acctbal AS x, CAST(n_regionkey AS DOUBLE) AS y FROM supplier, nation")
def grid_of_two(spark, sf):
    return construct.meshgrid(*_pair(spark, sf)).select("i", "j", "x", "y")


@query("cross_product", "SELECT vec_id, round(a[2] * b[3] - a[3] * b[2], 6) AS x, round(a[3] * b[1] - a[1] * b[3], 6) AS y, round(a[1] * b[2] - a[2] * b[1], 6) AS z FROM (SELECT vec_id, CAST(embedding[1:3] AS DOUBLE[]) AS a, CAST(embedding[4:6] AS DOUBLE[]) AS b FROM embeddings)")
def cross_product(spark, sf):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", matrix.cross(F.slice(v, 1, 3), F.slice(v, 4, 3)).alias("c")).select("vec_id", r(F.col("c")[0], 6, "x"), r(F.col("c")[1], 6, "y"), r(F.col("c")[2], 6, "z"))


@query("picked_columns", _CELLS + "SELECT i, k AS j, v FROM m JOIN (VALUES (0, 63), (1, 5), (2, 5), (3, 0)) t(k, c) ON j = c")
def picked_columns(spark, sf):
    return matrix.pick(_cells(spark, sf), None, [63, 5, 5, 0]).select("i", F.col("j").cast("int").alias("j"), "v")


@query("last_columns", _CELLS + "SELECT i, CAST(j - 60 AS BIGINT) AS j, v FROM m WHERE j BETWEEN 60 AND 62")
def last_columns(spark, sf):
    m = _cells(spark, sf)
    return matrix.part(m, (table(spark, sf, "embeddings").count(), 64), columns=(-4, -1))


@query("split_columns", _CELLS + "SELECT CAST(j // 16 AS INT) AS part, i, CAST(j % 16 AS BIGINT) AS j, v FROM m")
def split_columns(spark, sf):
    return matrix.split_evenly(_cells(spark, sf), 4, 64, 1)


@query("broadcast_column", "SELECT c_custkey AS i, CAST(j AS BIGINT) AS j, c_acctbal AS v FROM customer, range(3) t(j)")
def broadcast_column(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.lit(0).cast("long").alias("j"), F.col("c_acctbal").alias("v"))
    n = 10**9  # the rows stay as they are
    return matrix.broadcast_to(c, (n, 1), (n, 3))


@query("times_each_column", _CELLS + ", a AS (SELECT j, avg(v) AS w FROM m GROUP BY j) SELECT i, CAST(j AS BIGINT) AS j, round(v * w, 8) AS v FROM m JOIN a USING (j)")
def times_each_column(spark, sf):
    m = _cells(spark, sf)
    return matrix.with_each(m, matrix.along(m, 0, F.avg("v")), 1, lambda v, w: v * w).select("i", "j", r("v", 8))


@query("row_spans", _CELLS + "SELECT i, round(max(v) - min(v), 6) AS v FROM m GROUP BY i")
def row_spans(spark, sf):
    return matrix.along(_cells(spark, sf), 1, F.max("v") - F.min("v")).select("i", r("v", 6))


@query("mapped_rows", _CELLS + "SELECT i, CAST(j AS BIGINT) AS j, round(v / sum(abs(v)) OVER (PARTITION BY i), 6) AS v FROM m")
def mapped_rows(spark, sf):
    size = lambda row: F.aggregate(row, F.lit(0.0), lambda s, x: s + F.abs(x))
    return matrix.lanes(_cells(spark, sf), 1, lambda row: matrix.let(size(row), lambda t: F.transform(row, lambda x: x / t))).select("i", "j", r("v", 6))


@query("convolution_same", "WITH s AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_totalprice AS v FROM orders) SELECT i, round(coalesce(lag(v) OVER w, 0) * 0.25 + v * 0.5 + coalesce(lead(v) OVER w, 0) * 0.25, 4) AS v FROM s WINDOW w AS (ORDER BY i)")
def convolution_same(spark, sf):
    from millrace.operators import ordered

    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    return matrix.convolve(ordered.dense_index(o, "o_orderkey").select("i", "v"), [0.25, 0.5, 0.25], "same", o.count()).select("i", r("v", 4))


@query("bad_cells", """WITH e AS (SELECT lang, CASE WHEN doc_id % 7 = 0 THEN 'nan'::DOUBLE ELSE n_chars END AS size FROM documents)
    SELECT 'lang' AS "column", count(*) AS n, count(*) FILTER (lang IS NULL OR trim(lang) = '') AS bad FROM e UNION ALL SELECT 'size', count(*), count(*) FILTER (size IS NULL OR isnan(size)) FROM e""")
def bad_cells(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.when(F.col("doc_id") % 7 == 0, float("nan")).otherwise(F.col("n_chars").cast("double")).alias("size"))
    return relational.bad_cells(d, ["lang", "size"])


@query("nan_column_statistics", "SELECT round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS std, count(*) AS n FROM (SELECT value AS x FROM events WHERE event_id % 10 <> 0)")
def nan_column_statistics(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("value")).alias("x"))
    return reduce.nan_statistics(e, ["x"]).select(r("mean", 5), r("std", 5), "n")


@query("csv_round_trip", "SELECT CAST(l_orderkey AS DOUBLE) AS col1, CAST(l_linenumber AS DOUBLE) AS col2, l_quantity AS col3, l_extendedprice AS col4, l_discount AS col5, l_extendedprice * 1e22 AS col6, CASE WHEN l_linenumber = 3 THEN 'nan'::DOUBLE ELSE l_tax END AS col7 FROM lineitem")
def csv_round_trip(spark, sf):
    """Numbers written as text and read back: NaN, and what is too large for a decimal."""
    path = shared_dir(spark, "csv")
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", (F.col("l_extendedprice") * 1e22).alias("big"), F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_tax")).alias("tax"))
    csv.write_matrix(t, path, t.columns)
    return csv.read_smart(spark, path)


@query("csv_ragged", """SELECT CAST(2 + c_custkey % 3 AS INT) AS width, CAST(c_custkey AS VARCHAR) AS f0, 'a, "b"' || chr(10) || c_name AS f1, CASE WHEN c_custkey % 3 <> 0 THEN 'x' END AS f2, CASE WHEN c_custkey % 3 = 2 THEN 'y' END AS f3 FROM customer""")
def csv_ragged(spark, sf):
    """Rows of two to four fields, one of which holds the delimiter, a line end and quotes."""
    path = shared_dir(spark, "ragged")
    c = table(spark, sf, "customer").withColumn("note", F.concat(F.lit('a, "b"\n'), "c_name"))
    more = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).when(F.col("c_custkey") % 3 == 1, F.lit(",x")).otherwise(F.lit(",x,y"))
    c.select(F.concat(csv.format_row(["c_custkey", "note"]), more).alias("value")).write.text(path)
    return csv.read_ragged(spark, path, ",").select(F.size("fields").alias("width"), *[F.get("fields", F.lit(k)).alias(f"f{k}") for k in range(4)])


@query("csv_rectangular", "SELECT CAST(c_custkey AS VARCHAR) AS f0, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE '' END AS f1, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE '' END AS f2 FROM customer")
def csv_rectangular(spark, sf):
    path = shared_dir(spark, "rectangular")
    c = table(spark, sf, "customer")
    c.select(F.concat_ws("\t", F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), F.when(F.col("c_custkey") % 3 == 2, F.col("c_mktsegment"))).alias("value")).write.text(path)
    return csv.rectangular(csv.read_ragged(spark, path, "\t")).select(*[F.col("fields")[k].alias(f"f{k}") for k in range(3)])


@query("typed_table", "SELECT CAST(o_orderkey AS INTEGER) AS orderKey, CAST(o_custkey AS INTEGER) AS customer, o_totalprice AS totalPrice, o_orderdate AS placed, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority, o_orderkey % 2 = 0 AS even FROM orders")
def typed_table(spark, sf):
    """Orders written as text with a header in every file, and read back with their types."""
    path = shared_dir(spark, "typed")
    o = table(spark, sf, "orders")
    text = o.select(F.col("o_orderkey").alias("Order key"), F.col("o_custkey").alias("Customer"), F.col("o_totalprice").alias("total_price"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("placed"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("EVEN"))
    text.write.option("header", True).csv(path)
    return csv.read_typed(spark, path)


@query("date_texts", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS full_text, strftime(o_orderdate, '%A %-d %B %Y') AS long_text, strftime(o_orderdate, '%a') AS day,
    CAST(date_diff('second', TIMESTAMP '1995-06-15 18:30:10', o_orderdate) // 86400 AS BIGINT) AS whole_days, round(date_diff('second', TIMESTAMP '1995-06-15 18:30:10', o_orderdate) / 86400, 6) AS days FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-16'
    UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), strftime(o_orderdate, '%A %-d %B %Y'), strftime(o_orderdate, '%a'),
    CAST(-(date_diff('second', o_orderdate, TIMESTAMP '1995-06-15 18:30:10') // 86400) AS BIGINT), round(date_diff('second', TIMESTAMP '1995-06-15 18:30:10', o_orderdate) / 86400, 6) FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-16'""")
def date_texts(spark, sf):
    d, fixed = F.col("o_orderdate"), F.expr("timestamp_ntz'1995-06-15 18:30:10'")
    return table(spark, sf, "orders").select("o_orderkey", dates.ymdhms(d).alias("full_text"), dates.formatted(d, "EEEE d MMMM yyyy").alias("long_text"), dates.day_name(d, True).alias("day"), dates.duration(fixed, d)["days"].alias("whole_days"), r(dates.days_rounded(fixed, d), 6, "days"))


@query("date_shifts", """SELECT o_orderkey, o_orderdate + INTERVAL 36 HOUR AS hours, o_orderdate - INTERVAL 1 YEAR AS year_before, o_orderdate + INTERVAL 2 WEEK AS weeks, o_orderdate + INTERVAL 90 SECOND AS seconds,
    make_timestamp(CAST(year(o_orderdate) AS BIGINT), CAST(1 AS BIGINT), CAST(day(o_orderdate) AS BIGINT), 7, 30, 0) AS set_fields, CASE WHEN month(o_orderdate) = 2 OR day(o_orderdate) < 31 THEN make_timestamp(CAST(year(o_orderdate) AS BIGINT), CAST(4 AS BIGINT), CAST(least(day(o_orderdate), 30) AS BIGINT), 0, 0, 0) END AS april FROM orders""")
def date_shifts(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", dates.plus(d, 36, "hour").alias("hours"), dates.plus(d, -1, "year").alias("year_before"), dates.plus(d, 2, "week").alias("weeks"), dates.plus(d, 90, "second").alias("seconds"), dates.with_field(d, month=1, hour=7, minute=30, second=0).alias("set_fields"), dates.with_field(dates.at_start_of_day(d), month=4).alias("april"))


@query("strict_dates", "SELECT o_orderkey, CAST(o_orderdate::DATE AS TIMESTAMP) AS compact, date_trunc('second', o_orderdate) AS separated, CAST(o_orderdate::DATE AS TIMESTAMP) AS of_day FROM orders")
def strict_dates(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", dates.strict(F.date_format(d, "yyyyMMdd")).alias("compact"), dates.strict(F.date_format(d, "yyyy.MM.dd HH:mm:ss")).alias("separated"), dates.of_epoch_day(dates.day_number(d)).alias("of_day"))


@query("signed_numbers", "SELECT c_custkey, CASE WHEN round(c_acctbal::DECIMAL(18,2), 0) = 0 THEN '0' ELSE printf('%+d', CAST(round(c_acctbal::DECIMAL(18,2), 0) AS BIGINT)) END AS shown FROM customer")
def signed_numbers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.signed("c_acctbal", 0).alias("shown"))


def _user_paths(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", (F.col("value") + 1).alias("px"))


_PATHS = "WITH p AS (SELECT user_id, event_id, value + 1 AS px, row_number() OVER u AS rn, max(value + 1) OVER (u ROWS UNBOUNDED PRECEDING) AS peak FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id)) "


@query("depth_at_exhaustion", _PATHS + ", s AS (SELECT *, sum(CASE WHEN px >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - 1 AS place FROM s) SELECT user_id, min(event_id) AS peak_at, round(max(CASE WHEN place >= 3 THEN 1 - px / peak END), 6) AS depth FROM k GROUP BY user_id, island HAVING count(*) > 1")
def depth_at_exhaustion(spark, sf):
    return simulation.depth_at_exhaustion(_user_paths(spark, sf), "user_id", "event_id", "px", 3).select("user_id", "peak_at", r("depth", 6))


@query("exposures", _PATHS + "SELECT user_id, event_id, CASE WHEN px >= avg(px) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING) THEN 1.0::DOUBLE ELSE 0.3 END AS trend, CASE WHEN (1 - px / peak) * 100 > 20 THEN 0.5::DOUBLE ELSE 1.0 END AS careful FROM p")
def exposures(spark, sf):
    p = _user_paths(spark, sf)
    return simulation.trend_exposure(p, "user_id", "event_id", "px", 10, 0.3).withColumnRenamed("exposure", "trend").join(simulation.drawdown_exposure(p, "user_id", "event_id", "px", 20, 0.5).withColumnRenamed("exposure", "careful"), ["user_id", "event_id"]).select("user_id", "event_id", "trend", "careful")


@query("volatility", _PATHS + ", q AS (SELECT user_id, event_id, rn - 1 AS t, coalesce(pow(ln(px / lag(px) OVER (PARTITION BY user_id ORDER BY event_id)), 2), 0) AS rr FROM p) SELECT user_id, event_id, CASE WHEN t = 0 THEN 0.0::DOUBLE ELSE round(sqrt(252 * pow(0.94, t) * (0.0001 + sum(CASE WHEN t > 0 THEN 0.06 * rr / pow(0.94, t) ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))), 5) END AS vol FROM q")
def volatility(spark, sf):
    return recurrences.volatility(_user_paths(spark, sf), "user_id", "event_id", "px").select("user_id", "event_id", r("vol", 5))
