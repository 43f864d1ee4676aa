"""W, O, U: group values on rows, ordering, set operations."""

from pyspark.sql import functions as F

from spanloom.operators import columns as C
from spanloom.operators import joins as J
from spanloom.operators import ranks as W
from spanloom.operators import reshape as R
from spanloom.plans.registry import query


@query("w01_group_max", """
SELECT event_id, max(value) OVER (PARTITION BY user_id) AS top FROM events""")
def _(t):
    return W.with_group_max(t.events, ["user_id"], "value", "top").select("event_id", "top")


@query("w02_group_count_filter", """
SELECT event_id, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE n > 4 AND n < 20""")
def _(t):
    counted = W.with_group_count(t.events, ["user_id", "event_type"])
    return counted.where("n > 4 and n < 20").select("event_id", "n")


@query("w03_delta_from_min", """
SELECT event_id, round(value - min(value) OVER (PARTITION BY event_type), 6) AS delta FROM events""")
def _(t):
    out = W.with_delta_min(t.events, ["event_type"], "value", "delta")
    return out.select("event_id", F.round("delta", 6).alias("delta"))


@query("w04_dense_id", """
SELECT c_custkey, dense_rank() OVER (ORDER BY c_nationkey, c_mktsegment) AS id FROM customer""")
def _(t):
    return W.dense_id(t.customer, ["c_nationkey", "c_mktsegment"], "id").select("c_custkey", "id")


@query("w05_ordinal_in_group", """
SELECT l_orderkey, l_linenumber, l_shipdate, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) AS ordinal FROM lineitem""")
def _(t):
    out = W.ordinal(t.lineitem, ["l_suppkey"], "l_shipdate", "ordinal")
    return out.select("l_orderkey", "l_linenumber", "l_shipdate", "ordinal")


@query("w06_first_duplicate", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return W.first_of(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_extendedprice"])


@query("w07_occurring_once", """
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return W.occurring_once(li, ["l_orderkey", "l_linenumber"])


@query("w08_row_number_in_order", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_no FROM orders""")
def _(t):
    return W.row_numbers(t.orders, [], ["o_orderdate", "o_orderkey"], "row_no").select("o_orderkey", "row_no")


@query("w08b_row_number_segmented", """
SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS row_no FROM events""")
def _(t):
    # Low threshold so that the hot-group path runs on these tables too.
    out = W.row_numbers(t.events, ["event_type"], ["ts", "event_id"], "row_no", hot_rows=100, segments=16)
    return out.select("event_id", "row_no")


@query("w09_top_one_with_ties", """
SELECT p_partkey, p_brand, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) WHERE r = 1""")
def _(t):
    return W.keep_extreme(t.part, ["p_brand"], "p_size").select("p_partkey", "p_brand", "p_size")


@query("w10_number_duplicates", """
SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE p_name || '.' || (rn - 1) END AS unique_name FROM (
  SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)""")
def _(t):
    return W.number_duplicates(t.part, "p_name", ["p_partkey"], "unique_name").select("p_partkey", "unique_name")


@query("w11_pair_events", """
WITH e AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
           FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT user_id, CAST((rn + 1) // 2 AS BIGINT) AS pair_id, max(CASE WHEN rn % 2 = 1 THEN ts END) AS "start", max(CASE WHEN rn % 2 = 0 THEN ts END) AS "end",
  count(*) = 2 AND bool_and(event_type = CASE WHEN rn % 2 = 1 THEN 'signup' ELSE 'purchase' END) AS alternates
FROM e GROUP BY 1, 2""")
def _(t):
    return W.pair_events(t.events, ["user_id"], "ts", "event_type", "signup", "purchase", tie=["event_id"])


@query("w12_bracketing_neighbours", """
WITH p AS (SELECT l_suppkey, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY ALL),
     m AS (SELECT *, 0.5 * max(y) OVER (PARTITION BY l_suppkey) AS target FROM p)
SELECT l_suppkey, round(max(CASE WHEN y <= target THEN y END), 6) AS below, round(min(CASE WHEN y >= target THEN y END), 6) AS above FROM m GROUP BY 1""")
def _(t):
    p = t.lineitem.groupBy("l_suppkey", F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    m = W.attach(p, ["l_suppkey"], target=F.max("y") * 0.5)
    return m.groupBy("l_suppkey").agg(
        F.round(F.max(F.when(F.col("y") <= F.col("target"), F.col("y"))), 6).alias("below"),
        F.round(F.min(F.when(F.col("y") >= F.col("target"), F.col("y"))), 6).alias("above"),
    )


@query("w13_distinct_count_attached", """
SELECT o_orderkey, n_customers FROM orders JOIN (SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1) USING (o_orderpriority)""")
def _(t):
    out = W.attach(t.orders, ["o_orderpriority"], n_customers=F.countDistinct("o_custkey"))
    return out.select("o_orderkey", "n_customers")


@query("w14_best_with_ties", """
SELECT s_suppkey, s_nationkey FROM (SELECT *, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS r FROM supplier) WHERE r = 1""")
def _(t):
    return W.keep_extreme(t.supplier, ["s_nationkey"], "s_acctbal", largest=False).select("s_suppkey", "s_nationkey")


@query("o01_multi_key_sort", """
SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders ORDER BY o_orderstatus, o_orderdate DESC, o_orderkey""")
def _(t):
    cols = ["o_orderkey", "o_orderstatus", "o_orderdate"]
    return t.orders.select(*cols).orderBy("o_orderstatus", F.desc("o_orderdate"), "o_orderkey")


@query("o02_level_order_sort", """
SELECT o_orderkey, level_order FROM orders JOIN (SELECT o_orderpriority, row_number() OVER (ORDER BY avg(o_totalprice), o_orderpriority) AS level_order
  FROM orders GROUP BY 1) USING (o_orderpriority) ORDER BY level_order, o_orderkey""")
def _(t):
    levels = t.orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    levels = W.row_numbers(levels, [], ["m", "o_orderpriority"], "level_order").drop("m")
    out = J.join_null_safe(t.orders, levels, "o_orderpriority")
    return out.select("o_orderkey", "level_order").orderBy("level_order", "o_orderkey")


@query("o03_top_k", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("u01_union_by_name", """
SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS name FROM customer
UNION ALL SELECT s_suppkey, s_nationkey, NULL, s_name FROM supplier""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    return R.bind_rows(c, s)


@query("u02_union_distinct", """
SELECT c_nationkey AS nation, c_mktsegment AS tag FROM customer UNION SELECT s_nationkey, 'MACHINERY' FROM supplier""")
def _(t):
    c = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("tag"))
    s = t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("MACHINERY").alias("tag"))
    return R.bind_distinct(c, s)


@query("u03_key_difference", """
SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000""")
def _(t):
    big = t.orders.where("o_totalprice > 100000")
    return J.anti(t.customer.select("c_custkey").distinct(), big, [("c_custkey", "o_custkey")])


@query("u04_copy_per_treatment", """
SELECT l_orderkey, l_linenumber, 2 AS dry_time, l_tax AS weight FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT l_orderkey, l_linenumber, 15, l_discount FROM lineitem WHERE l_returnflag = 'A'""")
def _(t):
    control = t.lineitem.where("l_returnflag = 'A'")
    out = C.copy_per_treatment(control, "dry_time", [2, 15], {"weight": {2: "l_tax", 15: "l_discount"}})
    return out.select("l_orderkey", "l_linenumber", "dry_time", "weight")
