"""A: aggregations."""

from pyspark.sql import functions as F

from spanloom.functions import scalar as S
from spanloom.operators import joins as J
from spanloom.operators import ranks as W
from spanloom.operators import reshape as R
from spanloom.operators import summaries as A
from spanloom.plans.registry import query


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def n():
    return F.count(F.lit(1))


@query("a01_mean_sd_n", """
WITH d AS (SELECT l_returnflag, l_linestatus, l_linenumber, extract(year FROM l_shipdate) AS yr, l_suppkey, NULLIF(l_discount, 0) AS x FROM lineitem)
SELECT l_returnflag, l_linestatus, l_linenumber, CAST(yr AS INTEGER) AS yr, l_suppkey, round(avg(x), 6) AS x_mean, round(stddev_samp(x), 6) AS x_sd, count(*) AS x_n
FROM d GROUP BY ALL""")
def _(t):
    d = t.lineitem.select(
        "l_returnflag", "l_linestatus", "l_linenumber", F.year("l_shipdate").alias("yr"), "l_suppkey",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("x"),
    )
    keys = ["l_returnflag", "l_linestatus", "l_linenumber", "yr", "l_suppkey"]
    return rounded(A.summarise(d, keys, ["x"]), "x_mean", "x_sd")


@query("a02_columns_by_functions", """
SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_sd,
  count(*) AS l_quantity_n, round(avg(l_extendedprice), 6) AS l_extendedprice_mean,
  round(stddev_samp(l_extendedprice), 6) AS l_extendedprice_sd, count(*) AS l_extendedprice_n FROM lineitem GROUP BY ALL""")
def _(t):
    cols = ["l_quantity", "l_extendedprice"]
    out = A.summarise(t.lineitem, ["l_returnflag", "l_linestatus"], cols)
    return rounded(out, *[f"{c}_{f}" for c in cols for f in ("mean", "sd")])


@query("a03_daily_max_mean", """
SELECT user_id, event_type, round(avg(m), 6) AS value FROM (
  SELECT user_id, event_type, CAST(ts AS DATE) AS d, max(value) AS m FROM events WHERE event_type <> 'error' GROUP BY ALL)
GROUP BY ALL""")
def _(t):
    kept = t.events.where("event_type <> 'error'")
    return rounded(A.rollup_max_mean(kept, ["user_id", "event_type"], "ts", "value"), "value")


@query("a04_min_max_mean_n", """
SELECT l_partkey, l_returnflag, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
  round(avg(l_quantity), 6) AS l_quantity_mean, count(*) AS l_quantity_n FROM lineitem GROUP BY ALL""")
def _(t):
    out = A.summarise(t.lineitem, ["l_partkey", "l_returnflag"], ["l_quantity"], ("min", "max", "mean", "n"))
    return rounded(out, "l_quantity_mean")


@query("a05_mean_over_occurrences", """
WITH dim AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS x FROM customer)
SELECT o_orderpriority, round(avg(x), 6) AS x_mean, round(stddev_samp(x), 6) AS x_sd, count(*) AS x_n
FROM orders LEFT JOIN dim ON o_custkey = c_custkey GROUP BY ALL""")
def _(t):
    dim = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("x"))
    seen = J.join_null_safe(t.orders, dim, [("o_custkey", "c_custkey")])
    return rounded(A.summarise(seen, ["o_orderpriority"], ["x"]), "x_mean", "x_sd")


_WEIGHTED = """
WITH d AS (SELECT p_brand, p_retailprice AS x, l_quantity AS w FROM lineitem JOIN part ON l_partkey = p_partkey),
     m AS (SELECT p_brand, sum(x * w) / sum(w) AS mean, sum(w) AS tot FROM d GROUP BY 1)
SELECT p_brand, round(mean, 6) AS x_mean, round(sqrt(sum(w * pow(x - mean, 2)) / (tot - 1)), 6) AS x_sd, CAST(tot AS BIGINT) AS x_n
FROM d JOIN m USING (p_brand) GROUP BY p_brand, mean, tot"""


@query("a06_weighted_summary", _WEIGHTED)
def _(t):
    d = J.join_null_safe(t.lineitem, t.part, [("l_partkey", "p_partkey")], "inner").select(
        "p_brand", F.col("p_retailprice").alias("x"), F.col("l_quantity").alias("w")
    )
    return rounded(A.weighted_summary(d, ["p_brand"], "x", "w"), "x_mean", "x_sd")


@query("a07_mean_sd_four_keys", """
SELECT l_returnflag, l_linestatus, l_suppkey, l_linenumber, round(avg(l_tax), 6) AS l_tax_mean, round(stddev_samp(l_tax), 6) AS l_tax_sd
FROM lineitem GROUP BY ALL""")
def _(t):
    keys = ["l_returnflag", "l_linestatus", "l_suppkey", "l_linenumber"]
    return rounded(A.summarise(t.lineitem, keys, ["l_tax"], ("mean", "sd")), "l_tax_mean", "l_tax_sd")


@query("a08_average_replicates", """
WITH long AS (SELECT l_orderkey AS unit, l_returnflag AS condition, NULLIF(l_discount, 0) AS v FROM lineitem
              UNION ALL SELECT l_orderkey, l_returnflag, NULLIF(l_tax, 0) FROM lineitem)
SELECT unit, round(avg(CASE WHEN condition = 'A' THEN v END), 6) AS "rate_A", round(avg(CASE WHEN condition = 'N' THEN v END), 6) AS "rate_N",
  round(avg(CASE WHEN condition = 'R' THEN v END), 6) AS "rate_R" FROM long GROUP BY 1""")
def _(t):
    zero = F.lit(0.0)
    wide = t.lineitem.select(
        F.col("l_orderkey").alias("unit"), F.col("l_returnflag").alias("condition"),
        F.nullif(F.col("l_discount"), zero).alias("rate_1"), F.nullif(F.col("l_tax"), zero).alias("rate_2"),
    )
    long = R.split_column(R.to_long(wide, ["unit", "condition"], "^rate_", "var", "v"), "var", ["rate", "replicate"], "_")
    means = long.groupBy("unit", "condition").agg(F.avg("v").alias("rate"))
    out = R.to_wide(means, ["unit"], "condition", ["rate"], ["A", "N", "R"])
    return rounded(out, "rate_A", "rate_N", "rate_R")


@query("a09_mean_of_means", """
WITH m AS (SELECT c_mktsegment, o_custkey, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_mktsegment, printf('%.1f', round(avg(m), 1)) || ' ± ' || printf('%.1f', round(stddev_samp(m), 1)) AS label, count(*) AS n_groups
FROM m GROUP BY 1""")
def _(t):
    joined = J.join_null_safe(t.orders, t.customer, [("o_custkey", "c_custkey")], "inner")
    out = A.mean_of_means(joined, ["c_mktsegment", "o_custkey"], ["c_mktsegment"], "o_totalprice")
    label = S.mean_sd_text("o_totalprice_mean", "o_totalprice_sd", 1)
    return out.select("c_mktsegment", label.alias("label"), "n_groups")


@query("a10_nested_counts", """
WITH b AS (SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type = 'signup') AND bool_or(event_type = 'purchase'))
SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT CAST(ts AS DATE)) AS n_days
FROM events WHERE user_id IN (SELECT user_id FROM b) GROUP BY 1""")
def _(t):
    both = A.groups_with_all(t.events, ["user_id"], "event_type", ["signup", "purchase"])
    return J.semi(t.events, both, "user_id").groupBy("event_type").agg(
        n().alias("n_rows"), F.countDistinct("user_id").alias("n_users"), F.countDistinct(F.to_date("ts")).alias("n_days")
    )


@query("a11_whole_table", """
SELECT round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_sd, min(value) AS value_min, max(value) AS value_max FROM events""")
def _(t):
    return rounded(A.summarise(t.events, [], ["value"], ("mean", "sd", "min", "max")), "value_mean", "value_sd")


@query("a12_group_max_of_sum", """
WITH s AS (SELECT l_returnflag, l_suppkey, avg(l_tax) AS m, stddev_samp(l_tax) AS d FROM lineitem GROUP BY ALL)
SELECT l_returnflag, CASE WHEN count(*) = count(m + d) THEN round(max(m + d), 6) END AS top FROM s GROUP BY 1""")
def _(t):
    s = A.summarise(t.lineitem, ["l_returnflag", "l_suppkey"], ["l_tax"], ("mean", "sd"))
    s = s.withColumn("reach", F.col("l_tax_mean") + F.col("l_tax_sd"))
    return s.groupBy("l_returnflag").agg(F.round(A.strict(F.max("reach"), "reach"), 6).alias("top"))


@query("a13_drop_groups_where_all", """
SELECT event_id, user_id FROM (SELECT *, bool_and(value < 100) OVER (PARTITION BY user_id, event_type) AS whole FROM events) WHERE NOT whole""")
def _(t):
    return A.drop_groups_where_all(t.events, ["user_id", "event_type"], F.col("value") < 100).select("event_id", "user_id")


@query("a14_box_stats", """
WITH q AS (SELECT o_orderstatus, o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
             quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY ALL),
     d AS (SELECT o.o_totalprice AS x, q.*, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
           FROM orders o JOIN q ON o.o_orderstatus = q.o_orderstatus AND o.o_orderpriority = q.o_orderpriority)
SELECT o_orderstatus, o_orderpriority, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  min(CASE WHEN inside THEN x END) AS whisker_low, max(CASE WHEN inside THEN x END) AS whisker_high,
  count(*) FILTER (NOT inside) AS n_outliers FROM d GROUP BY o_orderstatus, o_orderpriority, q1, median, q3""")
def _(t):
    out = A.box_stats(t.orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    return rounded(out, "q1", "median", "q3", digits=4)


@query("a15_mean_timestamp", """
SELECT user_id, event_type, make_timestamp(CAST(sum(CAST(epoch_us(ts) AS HUGEINT)) // count(*) AS BIGINT)) AS ts FROM events GROUP BY ALL""")
def _(t):
    return A.mean_time(t.events, ["user_id", "event_type"], ["ts"])


@query("a16_block_bounds", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY n_regionkey, n_name, n_nationkey) AS rn FROM nation)
SELECT n_regionkey, min(rn) AS first_row, max(rn) AS last_row FROM r GROUP BY 1""")
def _(t):
    rows = W.row_numbers(t.nation, [], ["n_regionkey", "n_name", "n_nationkey"], "rn")
    return rows.groupBy("n_regionkey").agg(F.min("rn").alias("first_row"), F.max("rn").alias("last_row"))


@query("a17_range_label", """
SELECT p_brand, p_type, CASE WHEN min(p_size) = max(p_size) THEN CAST(min(p_size) AS VARCHAR) ELSE min(p_size) || '-' || max(p_size) END AS label
FROM part GROUP BY ALL""")
def _(t):
    return A.range_label(t.part, ["p_brand", "p_type"], "p_size")


@query("a18_distinct_rows", """SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem""")
def _(t):
    return t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag").distinct()


@query("a19_split_moments", """
WITH d AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'A' THEN l_tax END AS a, CASE WHEN l_returnflag = 'R' THEN l_tax END AS b FROM lineitem)
SELECT l_suppkey, count(a) AS n_a, round(avg(a), 6) AS mean_a, round(var_samp(a), 6) AS var_a,
  count(b) AS n_b, round(avg(b), 6) AS mean_b, round(var_samp(b), 6) AS var_b FROM d GROUP BY 1""")
def _(t):
    out = A.split_moments(t.lineitem, ["l_suppkey"], "l_returnflag", ["A", "R"], "l_tax")
    return rounded(out, "mean_a", "var_a", "mean_b", "var_b")
