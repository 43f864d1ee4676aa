"""J: joins."""

from pyspark.sql import functions as F

from spanloom.operators import columns as C
from spanloom.operators import joins as J
from spanloom.operators import ranks as W
from spanloom.plans.registry import query

def status():
    return F.nullif("o_orderstatus", F.lit("P")).alias("status")


@query("j01_left_join_one_key", """
SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def _(t):
    joined = J.join_null_safe(t.orders, t.customer, [("o_custkey", "c_custkey")])
    return joined.select("o_orderkey", "c_name", "c_mktsegment")


@query("j02_left_join_multi_key", """
WITH m AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS mean_price FROM orders GROUP BY ALL)
SELECT o_orderkey, round(mean_price, 6) AS mean_price FROM orders LEFT JOIN m USING (o_orderstatus, o_orderpriority)""")
def _(t):
    keys = ["o_orderstatus", "o_orderpriority"]
    means = t.orders.groupBy(*keys).agg(F.round(F.avg("o_totalprice"), 6).alias("mean_price"))
    return J.join_null_safe(t.orders, means, keys).select("o_orderkey", "mean_price")


_NULLABLE = """
WITH o AS (SELECT o_orderkey, o_orderpriority, NULLIF(o_orderstatus, 'P') AS status FROM orders),
     s AS (SELECT status, o_orderpriority, count(*) AS n FROM o GROUP BY ALL)
SELECT o.o_orderkey, o.status, s.n FROM o LEFT JOIN s
ON o.status IS NOT DISTINCT FROM s.status AND o.o_orderpriority = s.o_orderpriority"""


@query("j03_null_matching_join", _NULLABLE)
def _(t):
    o = t.orders.select("o_orderkey", "o_orderpriority", status())
    sizes = o.groupBy("status", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return J.join_null_safe(o, sizes, ["status", "o_orderpriority"]).select("o_orderkey", "status", "n")


@query("j04_natural_join", _NULLABLE)
def _(t):
    o = t.orders.select("o_orderkey", "o_orderpriority", status())
    sizes = o.groupBy("status", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return J.natural_join(o, sizes).select("o_orderkey", "status", "n")


@query("j05_differently_named_keys", """
SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    return J.join_null_safe(t.customer, t.nation, [("c_nationkey", "n_nationkey")]).select("c_custkey", "n_name")


@query("j06_full_outer_join", """
WITH c AS (SELECT c_nationkey AS nation, count(*) AS n_customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1),
     s AS (SELECT s_nationkey AS nation, count(*) AS n_suppliers FROM supplier GROUP BY 1)
SELECT coalesce(c.nation, s.nation) AS nation, n_customers, n_suppliers FROM c FULL JOIN s ON c.nation = s.nation""")
def _(t):
    n = F.count(F.lit(1))
    c = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(n.alias("n_customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(n.alias("n_suppliers"))
    return J.join_null_safe(c, s, "nation", "full")


@query("j07_fold_joins", """
WITH c AS (SELECT c_nationkey AS nation, count(*) AS n_customers FROM customer GROUP BY 1),
     s AS (SELECT s_nationkey AS nation, round(avg(s_acctbal), 6) AS mean_balance FROM supplier GROUP BY 1),
     n AS (SELECT n_nationkey AS nation, n_name FROM nation)
SELECT coalesce(n.nation, c.nation, s.nation) AS nation, n_name, n_customers, mean_balance
FROM n FULL JOIN c ON n.nation = c.nation FULL JOIN s ON coalesce(n.nation, c.nation) = s.nation""")
def _(t):
    n = t.nation.select(F.col("n_nationkey").alias("nation"), "n_name")
    c = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.round(F.avg("s_acctbal"), 6).alias("mean_balance"))
    return J.join_all([n, c, s], "nation", "full")


@query("j08_membership_semi_join", """
SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def _(t):
    return J.semi(t.documents, t.labels.where("quality = 1"), "doc_id").select("doc_id", "lang", "source")


@query("j09_interval_left_join", """
WITH s AS (SELECT event_id AS session_id, user_id, ts AS t0, ts + INTERVAL 6 HOUR AS t1 FROM events WHERE event_type = 'signup')
SELECT e.event_id, s.session_id FROM events e LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.t0 AND e.ts <= s.t1""")
def _(t):
    sessions = t.events.where("event_type = 'signup'").select(
        F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("t0"), F.expr("ts + interval 6 hours").alias("t1")
    )
    points = t.events.select("event_id", "user_id", "ts")
    return J.interval_join(points, sessions, "ts", "t0", "t1", ["user_id"]).select("event_id", "session_id")


@query("j09b_interval_join_mixed_lengths", """
WITH s AS (SELECT event_id AS session_id, user_id, ts AS t0, ts + to_minutes(CAST(floor(pow(value, 2)) AS INTEGER)) AS t1
           FROM events WHERE event_type = 'purchase')
SELECT e.event_id, s.session_id FROM events e LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.t0 AND e.ts <= s.t1""")
def _(t):
    sessions = t.events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("session_id"),
        "user_id",
        F.col("ts").alias("t0"),
        F.expr("ts + make_dt_interval(0, 0, int(floor(pow(value, 2))))").alias("t1"),
    )
    points = t.events.select("event_id", "user_id", "ts")
    joined = J.interval_join(points, sessions, "ts", "t0", "t1", ["user_id"])
    return joined.select("event_id", "session_id")


@query("j10_two_hop_lookup", """
WITH fix AS (SELECT s_suppkey, s_nationkey AS corrected, s_name FROM supplier)
SELECT l.l_orderkey, l.l_linenumber, fix.corrected, n.n_name FROM lineitem l
LEFT JOIN fix ON l.l_suppkey = fix.s_suppkey LEFT JOIN nation n ON fix.corrected = n.n_nationkey""")
def _(t):
    fix = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("corrected"), "s_name")
    hops = J.two_hop_lookup(
        t.lineitem, fix, t.nation, [("l_suppkey", "s_suppkey")], [("corrected", "n_nationkey")]
    )
    return hops.select("l_orderkey", "l_linenumber", "corrected", "n_name")


@query("j11_anti_join", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    return J.anti(t.documents, t.labels, "doc_id").select("doc_id", "lang")


@query("j12_replace_corrected_rows", """
WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders),
     fixed AS (SELECT o_orderkey, o_orderstatus, round(o_totalprice / 10, 6) AS o_totalprice FROM o WHERE o_totalprice > 400000)
SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM fixed) UNION ALL SELECT * FROM fixed""")
def _(t):
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    fixed = o.where("o_totalprice > 400000").withColumn("o_totalprice", F.round(F.col("o_totalprice") / 10, 6))
    return J.replace_rows(o, fixed, "o_orderkey")


@query("j13_fill_missing_groups", """
WITH a AS (SELECT l_partkey AS part, l_returnflag AS stage, min(l_quantity) AS low, 'line' AS src FROM lineitem
           WHERE l_linestatus = 'F' AND l_quantity > 45 GROUP BY ALL),
     b AS (SELECT l_partkey AS part, l_returnflag AS stage, min(l_quantity) AS low, 'fill' AS src FROM lineitem GROUP BY ALL)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.part = b.part AND a.stage = b.stage)""")
def _(t):
    keys = [F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("stage")]

    def lows(df, source):
        return df.groupBy(*keys).agg(F.min("l_quantity").alias("low")).withColumn("src", F.lit(source))

    first = lows(t.lineitem.where("l_linestatus = 'F' and l_quantity > 45"), "line")
    return J.fill_missing_groups(first, lows(t.lineitem, "fill"), ["part", "stage"])


@query("j14_option_grid", """
SELECT n_nationkey, spec, response FROM nation
CROSS JOIN (VALUES ('habit'), ('stage'), ('both'), ('interaction'), ('null')) a(spec)
CROSS JOIN (VALUES ('etr'), ('par'), ('recovery')) b(response)""")
def _(t):
    specs = ["habit", "stage", "both", "interaction", "null"]
    return J.grid(t.nation.select("n_nationkey"), spec=specs, response=["etr", "par", "recovery"])


@query("j15_guarded_join", """
SELECT o_orderkey, c_mktsegment, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def _(t):
    people = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return J.join_guarded(t.orders.select("o_orderkey", "o_custkey"), people, [("o_custkey", "c_custkey")]).drop("o_custkey")


@query("j16_band_filter", """
WITH b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type = 'purchase' AND value > 40)
SELECT event_id, event_type FROM events, b WHERE ts BETWEEN lo AND hi""")
def _(t):
    spans = t.events.where("event_type = 'purchase' and value > 40")
    return J.band_filter(t.events, spans, "ts", "ts", "ts").select("event_id", "event_type")


@query("j16b_band_filter_by_group", """
WITH b AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT event_id, e.user_id FROM events e JOIN b ON e.user_id = b.user_id WHERE ts BETWEEN lo AND hi""")
def _(t):
    spans = t.events.where("event_type = 'purchase'")
    return J.band_filter(t.events, spans, "ts", "ts", "ts", ["user_id"]).select("event_id", "user_id")


@query("j17_align_to_key_list", """
WITH m AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1)
SELECT n_nationkey AS nation, n_regionkey AS pos, n FROM nation LEFT JOIN m ON n_nationkey = c_nationkey""")
def _(t):
    rich = t.customer.where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    keys = t.nation.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("pos"))
    return J.align_to(rich, keys, "nation", "pos")


@query("j18_spread_group_label", """
SELECT l_orderkey, l_linenumber, l_shipdate, max(CASE WHEN l_returnflag = 'R' THEN l_linestatus END) OVER (PARTITION BY l_orderkey) AS label
FROM lineitem""")
def _(t):
    label = F.max(F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")))
    return W.attach(t.lineitem, ["l_orderkey"], label=label).select("l_orderkey", "l_linenumber", "l_shipdate", "label")


@query("j19_device_rule_lookup", """
WITH r AS (SELECT c_mktsegment AS seg, max(c_nationkey) AS top FROM customer GROUP BY 1)
SELECT o_orderkey, CASE WHEN extract(year FROM o_orderdate) BETWEEN 1993 AND 1997 AND c_nationkey <= top - 5
       THEN concat('dev_', seg) ELSE 'missing' END AS device
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN r ON c_mktsegment = seg""")
def _(t):
    rules = t.customer.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.max("c_nationkey").alias("top"))
    joined = J.join_null_safe(t.orders, t.customer, [("o_custkey", "c_custkey")], "inner")
    joined = J.join_null_safe(joined, rules, [("c_mktsegment", "seg")])
    hit = F.year("o_orderdate").between(1993, 1997) & (F.col("c_nationkey") <= F.col("top") - 5)
    device = C.rule_value([(hit, F.concat(F.lit("dev_"), F.col("c_mktsegment")))], "missing")
    return joined.select("o_orderkey", device.alias("device"))
