"""Queries of the relational operators: grouping, merging, masks, projection, ordering, stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import ieee
from millrace.operators import ordered, reduce, relational
from millrace.plans.registry import query, r
from millrace.sources.tables import table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("flag_summary", """
    WITH g AS (SELECT l_returnflag, avg(l_quantity) AS m, sum(l_quantity) AS s, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n, stddev_pop(l_extendedprice) AS d, min(l_orderkey) AS first_seen FROM lineitem GROUP BY 1),
         h AS (SELECT l_returnflag, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(m, 4) AS mean_quantity, round(s, 2) AS sum_quantity, lo AS min_price, hi AS max_price, n AS n_rows, round(d, 3) AS std_price, first_seen, round(revenue, 1) AS revenue FROM g JOIN h USING (l_returnflag)""")
def flag_summary(spark, sf):
    items = table(spark, sf, "lineitem")
    found = items.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m"), F.sum("l_quantity").alias("s"), F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"), F.count(F.lit(1)).alias("n_rows"), F.stddev_pop("l_extendedprice").alias("d"), F.min("l_orderkey").alias("first_seen"))
    revenue = relational.group_by(items.select("l_returnflag", F.col("l_extendedprice").alias("revenue")), "l_returnflag", "sum")
    both = relational.merge(found, revenue, "l_returnflag")
    return both.select("l_returnflag", r("m", 4, "mean_quantity"), r("s", 2, "sum_quantity"), "min_price", "max_price", "n_rows", r("d", 3, "std_price"), "first_seen", r("revenue", 1))


for _op, _sql in {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_pop"}.items():
    @query(f"group_by_{_op}", f"SELECT l_suppkey, {', '.join(f'round({_sql}({c}), 3) AS {c}' for c in NUMBERS)} FROM lineitem GROUP BY 1")
    def _(spark, sf, op=_op):
        found = relational.group_by(table(spark, sf, "lineitem").select("l_suppkey", *NUMBERS), "l_suppkey", op)
        return found.select("l_suppkey", *[r(c, 3) for c in NUMBERS])


@query("group_by_count", "SELECT o_custkey, count(*) AS o_totalprice FROM orders GROUP BY 1")
def group_by_count(spark, sf):
    return relational.group_by(table(spark, sf, "orders").select("o_custkey", "o_totalprice"), "o_custkey", "count")


@query("group_by_map", "SELECT l_returnflag, round(avg(l_quantity), 4) AS l_quantity_mean, max(l_extendedprice) AS l_extendedprice_max, round(stddev_pop(l_tax), 6) AS l_tax_std, min(l_orderkey) AS first_seen FROM lineitem GROUP BY 1")
def group_by_map(spark, sf):
    found = relational.group_by(table(spark, sf, "lineitem"), "l_returnflag", {"l_quantity": "mean", "l_tax": "std", "l_extendedprice": "max"}, order="l_orderkey")
    return found.select("l_returnflag", r("l_quantity_mean"), "l_extendedprice_max", r("l_tax_std", 6), "first_seen")



def _sides(spark, sf):
    a = table(spark, sf, "customer").select((F.col("c_custkey") + 10).cast("double").alias("k"), F.col("c_acctbal").alias("v"))
    b = table(spark, sf, "orders").select(F.col("o_custkey").cast("double").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").cast("double").alias("id"))
    return a, b


for _how in ("inner", "left", "right"):
    @query(f"merge_{_how}", f"""
        WITH a AS (SELECT CAST(c_custkey + 10 AS DOUBLE) AS k, c_acctbal AS v FROM customer), b AS (SELECT CAST(o_custkey AS DOUBLE) AS k, o_totalprice AS v, CAST(o_orderkey AS DOUBLE) AS id FROM orders)
        SELECT coalesce(a.k, b.k) AS k, {"coalesce(a.v, 'nan'::DOUBLE)" if _how != "inner" else "a.v"} AS v_x, {"coalesce(b.v, 'nan'::DOUBLE)" if _how != "inner" else "b.v"} AS v_y, {"coalesce(b.id, 'nan'::DOUBLE)" if _how != "inner" else "b.id"} AS id FROM a {_how} JOIN b ON a.k = b.k""")
    def _(spark, sf, how=_how):
        return relational.merge(*_sides(spark, sf), "k", how)


@query("row_statistics", f"""
    SELECT vec_id, round(list_sum(v), 5) AS row_sum, round(list_avg(v), 6) AS row_mean, round(list_stddev_pop(v), 6) AS row_std, list_min(v) AS row_min, list_max(v) AS row_max, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS row_argmax, CAST(list_position(v, list_min(v)) - 1 AS BIGINT) AS row_argmin
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def row_statistics(spark, sf):
    v = F.col("embedding").cast("array<double>")
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    mean = total / F.size(v)
    var = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(v)
    return table(spark, sf, "embeddings").select("vec_id", r(total, 5, "row_sum"), r(mean, 6, "row_mean"), r(F.sqrt(var), 6, "row_std"), F.array_min(v).alias("row_min"), F.array_max(v).alias("row_max"), (F.array_position(v, F.array_max(v)) - 1).alias("row_argmax"), (F.array_position(v, F.array_min(v)) - 1).alias("row_argmin"))


@query("column_statistics", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS count, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, max({c}) AS max FROM lineitem" for c in NUMBERS))
def column_statistics(spark, sf):
    found = reduce.describe(table(spark, sf, "lineitem"), NUMBERS)
    return found.select("name", "count", r("mean"), r("std"), "min", r("p25"), r("p50"), r("p75"), "max")


@query("arg_extremes", "SELECT (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS argmax, (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS argmin, (SELECT max(o_totalprice) FROM orders) AS top, (SELECT min(o_totalprice) FROM orders) AS low")
def arg_extremes(spark, sf):
    orders = table(spark, sf, "orders")
    a, b = reduce.arg_extreme(orders, "o_totalprice", "o_orderkey", True), reduce.arg_extreme(orders, "o_totalprice", "o_orderkey", False)
    return a.select(F.col("at").alias("argmax"), F.col("value").alias("top")).crossJoin(b.select(F.col("at").alias("argmin"), F.col("value").alias("low")))


@query("percentiles", " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, round(quantile_cont(o_totalprice, {p / 100!r}), 3) AS value FROM orders" for p in (0.0, 1.0, 12.5, 50.0, 90.0, 100.0)))
def percentiles(spark, sf):
    return ordered.percentiles(table(spark, sf, "orders"), "o_totalprice", [0.0, 1.0, 12.5, 50.0, 90.0, 100.0]).select("p", r("value", 3))


@query("histogram", "SELECT CAST(b AS INT) AS bin, (SELECT count(*) FROM lineitem WHERE l_quantity >= 1 AND l_quantity <= 50 AND least(CAST(floor((l_quantity - 1) / 4.9) AS INT), 9) = b) AS n, CAST(round(1 + b * 4.9, 6) AS DOUBLE) AS left_edge, CAST(round(1 + (b + 1) * 4.9, 6) AS DOUBLE) AS right_edge FROM range(10) t(b)")
def histogram(spark, sf):
    return reduce.histogram(table(spark, sf, "lineitem"), "l_quantity", 10, 1.0, 50.0).select("bin", "n", r("left_edge", 6), r("right_edge", 6))


@query("value_counts", "SELECT l_shipdate AS value, count(*) AS n FROM lineitem GROUP BY 1")
def value_counts(spark, sf):
    return relational.value_counts(table(spark, sf, "lineitem"), "l_shipdate")


@query("nunique", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_quantity) AS quantities FROM lineitem")
def nunique(spark, sf):
    return table(spark, sf, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_quantity").alias("quantities"))


@query("covariance", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) AS cov, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in NUMBERS for b in NUMBERS))
def covariance(spark, sf):
    return reduce.covariance(table(spark, sf, "lineitem"), NUMBERS).select("a", "b", r("cov", 4), r("corr", 6))


@query("scaled", "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS o_totalprice FROM orders")
def scaled(spark, sf):
    return reduce.scale(table(spark, sf, "orders"), ["o_totalprice"], ["o_orderkey"]).select("o_orderkey", r("o_totalprice", 6))


_NAN = "CASE WHEN event_id % 10 = 0 THEN 'nan'::DOUBLE ELSE value END"


def _with_nan(spark, sf):
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, float("nan")).otherwise(F.col("value")).alias("x"))


@query("masks", f"""SELECT event_id, NOT isnan(x) AND x > 20 AS gt, NOT isnan(x) AND x <= 5 AS le, isnan(x) OR x <> 6.55 AS ne, x >= 5 AND x <= 20 AS mid, isnan(x) AS nan, NOT isnan(x) AS finite
    FROM (SELECT event_id, {_NAN} AS x FROM events)""")
def masks(spark, sf):
    return _with_nan(spark, sf).select("event_id", ieee.gt("x", 20.0).alias("gt"), ieee.le("x", 5.0).alias("le"), ieee.ne("x", 6.55).alias("ne"), ieee.between("x", 5.0, 20.0).alias("mid"), F.isnan("x").alias("nan"), ieee.is_finite("x").alias("finite"))


@query("mask_counts", f"SELECT count(*) FILTER (NOT isnan(x) AND x > 20) AS n_above, bool_and(NOT isnan(x) AND x > -1) AS all_above, bool_or(isnan(x)) AS any_nan FROM (SELECT {_NAN} AS x FROM events)")
def mask_counts(spark, sf):
    return _with_nan(spark, sf).agg(F.count_if(ieee.gt("x", 20.0)).alias("n_above"), F.bool_and(ieee.gt("x", -1.0)).alias("all_above"), F.bool_or(F.isnan("x")).alias("any_nan"))


@query("filter_rows", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.05 AND 0.07")
def filter_rows(spark, sf):
    return table(spark, sf, "lineitem").where(ieee.gt("l_quantity", 45.0) & ieee.between("l_discount", 0.05, 0.07)).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("fill_clip", f"SELECT event_id, CASE WHEN isnan(x) THEN -1 ELSE x END AS filled, CASE WHEN isnan(x) THEN 0 ELSE x END AS num, CASE WHEN isnan(x) THEN x ELSE least(greatest(x, 5), 20) END AS clipped, CASE WHEN NOT isnan(x) AND x > 20 THEN 1.0::DOUBLE ELSE 0.0 END AS chosen FROM (SELECT event_id, {_NAN} AS x FROM events)")
def fill_clip(spark, sf):
    return _with_nan(spark, sf).select("event_id", ieee.fill_nan("x", -1.0).alias("filled"), ieee.nan_to_num("x").alias("num"), ieee.clip("x", 5.0, 20.0).alias("clipped"), F.when(ieee.gt("x", 20.0), 1.0).otherwise(0.0).alias("chosen"))


@query("arithmetic", """SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity + l_discount, 4) AS added, round(l_extendedprice * (1 - l_discount), 4) AS product, round(CASE WHEN l_tax = 0 THEN 'inf'::DOUBLE ELSE l_quantity / l_tax END, 4) AS quotient, round(-l_quantity, 2) AS negative, greatest(l_discount, l_tax) AS larger, least(l_discount, l_tax) AS smaller FROM lineitem""")
def arithmetic(spark, sf):
    """By its SQL, what is divided by 0 is plus infinity, whatever it is; ieee.divide() has NaN and signs there. Ties and large values are rounded as there too."""
    c, r = F.col, lambda x, digits, name: ieee.round_away(x, digits).alias(name)
    quotient = F.when(c("l_tax") == 0, ieee.INF).when(c("l_quantity").isNotNull() & c("l_tax").isNotNull(), ieee.divide("l_quantity", "l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(c("l_quantity") + c("l_discount"), 4, "added"), r(c("l_extendedprice") * (1 - c("l_discount")), 4, "product"), r(quotient, 4, "quotient"), r(-c("l_quantity"), 2, "negative"), ieee.maximum("l_discount", "l_tax").alias("larger"), ieee.minimum("l_discount", "l_tax").alias("smaller"))


@query("elementwise_math", """SELECT event_id, round(sqrt(x), 6) AS sqrt, round(exp(-x / 50), 6) AS exp, round(ln(x + 1), 6) AS ln, round(log10(x + 1), 6) AS log10, round(log2(x + 1), 6) AS log2, round(pow(x, 2), 4) AS power, sign(x - 10) AS sign, floor(x * 10 + 0.5) / 10 AS rounded, trunc(x) AS trunc, floor(x) AS floor, ceil(x) AS ceil
    FROM (SELECT event_id, value AS x FROM events)""")
def elementwise_math(spark, sf):
    e, x = table(spark, sf, "events"), F.col("value")
    return e.select("event_id", r(ieee.sqrt("value"), 6, "sqrt"), r(F.exp(-x / 50), 6, "exp"), r(ieee.ln(x + 1), 6, "ln"), r(ieee.log10(x + 1), 6, "log10"), r(ieee.log2(x + 1), 6, "log2"), r(F.pow(x, F.lit(2.0)), 4, "power"), ieee.sign(x - 10).cast("tinyint").alias("sign"), ieee.round_half_up("value", 1).alias("rounded"), ieee.trunc("value").alias("trunc"), F.floor(x).cast("double").alias("floor"), F.ceil(x).cast("double").alias("ceil"))


@query("trigonometry", """SELECT event_id, round(sin(x), 6) AS sin, round(cos(x), 6) AS cos, round(tan(x / 100), 6) AS tan, round(asin(x / 1000), 6) AS arcsin, round(acos(x / 1000), 6) AS arccos, round(atan(x), 6) AS arctan, round(atan2(x, 3), 6) AS arctan2, round(sinh(x / 100), 6) AS sinh, round(cosh(x / 100), 6) AS cosh, round(tanh(x / 100), 6) AS tanh
    FROM (SELECT event_id, value AS x FROM events)""")
def trigonometry(spark, sf):
    x = F.col("value")
    return table(spark, sf, "events").select("event_id", r(F.sin(x), 6, "sin"), r(F.cos(x), 6, "cos"), r(F.tan(x / 100), 6, "tan"), r(F.asin(x / 1000), 6, "arcsin"), r(F.acos(x / 1000), 6, "arccos"), r(F.atan(x), 6, "arctan"), r(F.atan2(x, F.lit(3.0)), 6, "arctan2"), r(F.sinh(x / 100), 6, "sinh"), r(F.cosh(x / 100), 6, "cosh"), r(F.tanh(x / 100), 6, "tanh"))


@query("activations", """SELECT event_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, greatest(x, 0) AS relu, round(CASE WHEN x > 0 THEN x ELSE 0.01 * x END, 6) AS leaky, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 6) AS elu, round(0.5 * x * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))), 6) AS gelu
    FROM (SELECT event_id, (value - 20) / 10 AS x FROM events)""")
def activations(spark, sf):
    e = table(spark, sf, "events").select("event_id", ((F.col("value") - 20) / 10).alias("x"))
    return e.select("event_id", r(ieee.sigmoid("x"), 6, "sigmoid"), ieee.relu("x").alias("relu"), r(ieee.leaky_relu("x"), 6, "leaky"), r(ieee.elu("x"), 6, "elu"), r(ieee.gelu("x"), 6, "gelu"))


@query("top_k", "SELECT * FROM (SELECT o_orderkey, o_totalprice, 'largest' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25) UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice, 'smallest' AS side FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25)")
def top_k(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return relational.largest(orders, "o_totalprice", 25, "o_orderkey").withColumn("side", F.lit("largest")).unionByName(relational.largest(orders, "o_totalprice", 25, "o_orderkey", True).withColumn("side", F.lit("smallest")))


@query("argsort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def argsort(spark, sf):
    return ordered.dense_index(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], name="place").select("o_orderkey", "place")


@query("stacked_tables", "SELECT 0 AS part, s_suppkey AS id, s_acctbal AS balance FROM supplier UNION ALL SELECT 1, c_custkey, c_acctbal FROM customer")
def stacked_tables(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return relational.vstack([a, b], "id")


@query("side_by_side", "SELECT o_orderkey, o_totalprice, o_custkey, ln(o_totalprice) > 12 AS big FROM orders")
def side_by_side(spark, sf):
    orders = table(spark, sf, "orders")
    return relational.hstack(orders.select("o_orderkey", "o_totalprice"), orders.select("o_orderkey", "o_custkey", (ieee.ln("o_totalprice") > 12).alias("big")), "o_orderkey")


@query("head_tail", "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 7) UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 7)")
def head_tail(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy("o_orderkey").limit(7).unionByName(orders.orderBy(F.desc("o_orderkey")).limit(7))


@query("add_to_each_column", f"SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'round({c} - m_{c}, 7) AS {c}' for c in NUMBERS)} FROM lineitem, (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in NUMBERS)} FROM lineitem)")
def add_to_each_column(spark, sf):
    items = table(spark, sf, "lineitem")
    means = F.broadcast(items.agg(*[F.avg(c).alias(f"m_{c}") for c in NUMBERS]))  # one row
    return items.crossJoin(means).select("l_orderkey", "l_linenumber", "l_partkey", *[r(F.col(c) - F.col(f"m_{c}"), 7, c) for c in NUMBERS])


@query("size_by_type", "SELECT p_type AS ext, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1")
def size_by_type(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total"))


@query("revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1""")
def revenue_by_nation(spark, sf):
    items = table(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz'1998-01-01'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    sums = items.groupBy("l_orderkey").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("k"))  # before the joins: fewer rows are shuffled
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    found = sums.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return found.groupBy("n_name").agg(F.round(F.sum("v"), 1).alias("revenue"), F.sum("k").alias("n"))
