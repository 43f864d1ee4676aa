"""D: composite measures."""

from pyspark.sql import functions as F

from spanloom.functions import scalar as S
from spanloom.operators import columns as C
from spanloom.operators import joins as J
from spanloom.operators import measures as M
from spanloom.operators import ranks as W
from spanloom.operators import reshape as R
from spanloom.operators import summaries as A
from spanloom.operators.curves import fit_saturation, good_fits
from spanloom.operators.expect import expect, not_null, within
from spanloom.plans.aggregates import rounded
from spanloom.plans.registry import query
from spanloom.plans.stats import DAY, cuts_sql

_WIDE = """
WITH w AS (SELECT l_orderkey, sum(l_extendedprice) FILTER (l_linenumber = 1) AS price_1, sum(l_extendedprice) FILTER (l_linenumber = 2) AS price_2,
  sum(l_extendedprice) FILTER (l_linenumber = 3) AS price_3, sum(l_extendedprice) FILTER (l_linenumber = 4) AS price_4 FROM lineitem GROUP BY 1)"""
_RECOVERY = _WIDE + """,
 r AS (SELECT l_orderkey, '2' AS time, price_2 / price_1 AS ratio FROM w WHERE price_1 > 20000
  UNION ALL SELECT l_orderkey, '3', price_3 / price_1 FROM w WHERE price_1 > 20000
  UNION ALL SELECT l_orderkey, '4', price_4 / price_1 FROM w WHERE price_1 > 20000)"""


def wide_prices(t):
    cells = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_extendedprice").alias("price"))
    return R.to_wide(cells, ["l_orderkey"], "l_linenumber", ["price"], [1, 2, 3, 4])


def recovery(t):
    able = M.eligible(wide_prices(t), "price_1", 20000)
    return M.ratio_to_baseline(able, ["l_orderkey"], "price_1", ["price_2", "price_3", "price_4"], "price_")


@query("d01_ratio_to_baseline", _RECOVERY + " SELECT l_orderkey, time, round(ratio, 6) AS ratio FROM r")
def _(t):
    return rounded(recovery(t), "ratio")


@query("d02_eligibility", _WIDE + """
SELECT l_orderkey, round(price_1, 4) AS price_1 FROM w WHERE price_1 IS NOT NULL AND price_1 > 20000""")
def _(t):
    return rounded(M.eligible(wide_prices(t), "price_1", 20000), "price_1", digits=4).select("l_orderkey", "price_1")


_CONTENT = """
WITH w AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag, l_linestatus, l_extendedprice / 1000 AS pre, l_tax * 100 AS dry, l_quantity AS w1, l_discount * 200 AS w2 FROM lineitem),
 c AS (SELECT *, 'w1' AS time, (w1 - dry) / NULLIF(pre - dry, 0) AS content FROM w UNION ALL SELECT *, 'w2', (w2 - dry) / NULLIF(pre - dry, 0) FROM w)"""


def content(t):
    li = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus", (F.col("l_extendedprice") / 1000).alias("pre"),
        (F.col("l_tax") * 100).alias("dry"), F.col("l_quantity").alias("w1"), (F.col("l_discount") * 200).alias("w2"),
    )
    keys = ["l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus"]
    return M.relative_content(li, keys, "pre", "dry", ["w1", "w2"])


@query("d03_relative_content", _CONTENT + """
SELECT l_orderkey, l_linenumber, l_shipdate, time, round(content, 6) AS content FROM c WHERE content < 1.25 AND content > -0.25""")
def _(t):
    return rounded(content(t), "content").drop("l_returnflag", "l_linestatus")


@query("d04_reference_treatment", """
WITH r AS (SELECT l_suppkey, l_returnflag, l_linestatus, avg(l_tax) AS tax_mean, count(*) AS tax_n FROM lineitem GROUP BY ALL),
     o AS (SELECT s_suppkey, s_acctbal FROM supplier)
SELECT l_suppkey, l_returnflag, round(tax_mean, 6) AS tax_mean, tax_n, s_acctbal FROM r LEFT JOIN o ON l_suppkey = s_suppkey
WHERE (l_linestatus = 'F' AND l_returnflag = 'R') OR (l_suppkey = 7 AND l_linestatus = 'O' AND l_returnflag = 'A')""")
def _(t):
    keys = ["l_suppkey", "l_returnflag", "l_linestatus"]
    summary = A.summarise(t.lineitem.withColumnRenamed("l_tax", "tax"), keys, ["tax"], ("mean", "n"))
    flag, state = F.col("l_returnflag"), F.col("l_linestatus")
    keep = [(state == "F") & (flag == "R"), (F.col("l_suppkey") == 7) & (state == "O") & (flag == "A")]
    other = t.supplier.select("s_suppkey", "s_acctbal")
    out = M.reference_treatment(summary, other, [("l_suppkey", "s_suppkey")], keep)
    return rounded(out, "tax_mean").select("l_suppkey", "l_returnflag", "tax_mean", "tax_n", "s_acctbal")


_SITE = """
WITH d AS (SELECT user_id % 25 AS site, event_type AS habit, CAST(ts AS DATE) AS day, max(value) AS m FROM events WHERE event_type <> 'error' GROUP BY ALL),
     v AS (SELECT site, habit, avg(m) AS vpd FROM d GROUP BY ALL)"""


def site_exposure(t):
    ev = t.events.where("event_type <> 'error'").select((F.col("user_id") % 25).alias("site"), F.col("event_type").alias("habit"), "ts", F.col("value").alias("vpd"))
    return A.rollup_max_mean(ev, ["site", "habit"], "ts", "vpd")


_HABIT = "CASE c_mktsegment WHEN 'MACHINERY' THEN 'click' WHEN 'FURNITURE' THEN 'view' WHEN 'BUILDING' THEN 'error' ELSE 'purchase' END"


def habit_of(col):
    return F.coalesce(S.recode(col, {"MACHINERY": "click", "FURNITURE": "view", "BUILDING": "error"}), F.lit("purchase"))


@query("d05_exposure_by_occurrence", _SITE + f"""
SELECT c_mktsegment, round(avg(vpd), 6) AS vpd_mean, round(stddev_samp(vpd), 6) AS vpd_sd, count(*) AS vpd_n
FROM customer LEFT JOIN v ON c_nationkey = site AND habit = {_HABIT} GROUP BY 1""")
def _(t):
    seen = t.customer.select("c_mktsegment", F.col("c_nationkey").cast("long").alias("site"), habit_of("c_mktsegment").alias("habit"))
    return rounded(M.exposure_by_occurrence(seen, site_exposure(t), ["site", "habit"], ["c_mktsegment"], "vpd"), "vpd_mean", "vpd_sd")


@query("d06_exposure_by_abundance", _SITE + f""",
 c AS (SELECT c_mktsegment, c_nationkey, count(*) AS w FROM customer GROUP BY ALL),
 j AS (SELECT c_mktsegment, vpd, w FROM c JOIN v ON c_nationkey = site AND habit = {_HABIT}),
 m AS (SELECT c_mktsegment, sum(vpd * w) / sum(w) AS mean, sum(w) AS tot FROM j GROUP BY 1)
SELECT c_mktsegment, round(mean, 6) AS vpd_mean, round(sqrt(sum(w * pow(vpd - mean, 2)) / (tot - 1)), 6) AS vpd_sd, CAST(tot AS BIGINT) AS vpd_n
FROM j JOIN m USING (c_mktsegment) GROUP BY c_mktsegment, mean, tot""")
def _(t):
    c = t.customer.groupBy("c_mktsegment", F.col("c_nationkey").cast("long").alias("site")).agg(F.count(F.lit(1)).alias("w"))
    c = c.withColumn("habit", habit_of("c_mktsegment"))
    return rounded(M.exposure_by_abundance(c, site_exposure(t), ["site", "habit"], ["c_mktsegment"], "vpd", "w"), "vpd_mean", "vpd_sd")


_RANGES = """
WITH a AS (SELECT l_partkey AS part, l_returnflag AS stage, min(d) AS low, max(d) AS high, avg(d) AS mid, count(*) AS n FROM (
   SELECT *, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem WHERE l_quantity > 25) WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
 b AS (SELECT l_partkey AS part, 'A' AS stage, min(d) AS low, max(d) AS high, avg(d) AS mid, count(*) AS n FROM (
   SELECT *, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem WHERE l_returnflag = 'N') GROUP BY ALL),
 r AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.part = b.part AND a.stage = b.stage)),
 w AS (SELECT part, max(low) FILTER (stage = 'A') AS "A_low", max(high) FILTER (stage = 'A') AS "A_high", max(low) FILTER (stage = 'R') AS "R_low", max(high) FILTER (stage = 'R') AS "R_high" FROM r GROUP BY 1)"""


def part_ranges(t):
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long")
    li = t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("stage"), "l_quantity", day.alias("d"))
    plots = M.stage_ranges(li.where("l_quantity > 25 and stage in ('A', 'R')"), ["part"], "stage", "d")
    other = M.stage_ranges(li.where("stage = 'N'").withColumn("stage", F.lit("A")), ["part"], "stage", "d")
    return M.range_overhang(J.fill_missing_groups(plots, other, ["part", "stage"]), ["part"], "stage", "A", "R")


@query("d07_range_overhang", _RANGES + """
SELECT part, "A_low", "A_high", "R_low", "R_high", CASE WHEN "R_low" IS NULL THEN 0.0 ELSE CAST(CASE WHEN "A_low" - "R_low" < 0 THEN 0 ELSE "A_low" - "R_low" END
  + CASE WHEN "R_high" - "A_high" < 0 THEN 0 ELSE "R_high" - "A_high" END AS DOUBLE) END AS overhang FROM w""")
def _(t):
    return part_ranges(t).select("part", "A_low", "A_high", "R_low", "R_high", "overhang")


@query("d08_extend_ranges", _RANGES + """
SELECT part, least("A_low", "R_low") AS "A_low", greatest("A_high", "R_high") AS "A_high" FROM w""")
def _(t):
    return M.extend_ranges(part_ranges(t), "A", "R").select("part", "A_low", "A_high")


@query("d09_batch_membership", cuts_sql(f"""u AS (SELECT c_custkey, c_nationkey, c_mktsegment, min(o_orderdate) AS pre, max(o_orderdate) AS post
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
 o AS (SELECT c_custkey, c_mktsegment, pre, post, 0 AS g, {DAY.format('pre')} AS x FROM u WHERE NOT (c_nationkey >= 0 AND c_nationkey < 10) AND pre IS NOT NULL)""", 9) + """,
 b AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS cluster, min(o_orderdate) AS pre, max(o_orderdate) AS post FROM orders GROUP BY 1)
SELECT c_custkey, pre, post, cluster + 2 AS cluster, c_mktsegment FROM j
UNION ALL SELECT c_custkey, b.pre, b.post, b.cluster, c_mktsegment FROM u JOIN b ON b.cluster = CASE WHEN c_nationkey < 5 THEN 1 ELSE 2 END WHERE c_nationkey >= 0 AND c_nationkey < 10""")
def _(t):
    span = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("t0"), F.max("o_orderdate").alias("t1"))
    units = J.join_null_safe(t.customer.select("c_custkey", "c_nationkey"), span, [("c_custkey", "o_custkey")])
    batches = t.orders.groupBy(F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("cluster")).agg(
        F.min("o_orderdate").alias("pre"), F.max("o_orderdate").alias("post")
    )
    labels = t.customer.select("c_custkey", "c_mktsegment")
    return M.batch_membership(units, "c_custkey", "c_nationkey", [(0, 5, 1), (5, 10, 2)], batches, "t0", "t1", 9, labels)


@query("d10_session_times", cuts_sql(f"""o AS (SELECT o_orderstatus AS g, min(o_orderdate) AS t0, max(o_orderdate) AS t1, {DAY.format('min(o_orderdate)')} AS x
  FROM orders GROUP BY o_orderstatus, o_custkey)""", 4) + """
SELECT g AS o_orderstatus, cluster, make_timestamp(CAST(sum(CAST(epoch_us(t0) AS HUGEINT)) // count(*) AS BIGINT)) AS t0,
  make_timestamp(CAST(sum(CAST(epoch_us(t1) AS HUGEINT)) // count(*) AS BIGINT)) AS t1 FROM j GROUP BY ALL""")
def _(t):
    span = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderdate").alias("t0"), F.max("o_orderdate").alias("t1"))
    return M.session_times(span, ["o_orderstatus"], "t0", "t1", 4)


@query("d11_chart_segments", """
SELECT event_id, 1 + CAST(CAST(ts AS DATE) >= DATE '2024-01-08' AS INTEGER) + CAST(CAST(ts AS DATE) >= DATE '2024-01-21' AS INTEGER) AS segment FROM events""")
def _(t):
    return M.segment_by_date(t.events, "ts", ["2024-01-08", "2024-01-21"]).select("event_id", "segment")


@query("d12_tidy_specimens", """
SELECT part.p_partkey, replace(p_name, ' ', '_') AS taxon, p_brand, p_size FROM part
WHERE p_type IN ('ECONOMY', 'SMALL') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""")
def _(t):
    gated, _ = expect(t.part, [*not_null("p_type"), within("p_size", 1, 50)])
    named = gated.select("p_partkey", F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("taxon"), "p_brand", "p_size", "p_type")
    wanted = J.semi(named, t.lineitem.where("l_quantity >= 49"), [("p_partkey", "l_partkey")])
    return wanted.where(S.is_in("p_type", ["ECONOMY", "SMALL"])).drop("p_type")


_COMMUNITY = """
WITH c AS (SELECT n_name AS site, c_mktsegment AS taxon, count(*) AS abundance, 'sporophyte' AS stage FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 4 GROUP BY ALL
  UNION ALL SELECT n_name, c_mktsegment, count(*) FILTER (c_acctbal > 5000), 'gametophyte' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 4 GROUP BY ALL)"""


@query("d13_community_long", """
WITH s AS (SELECT n_name AS site, n_regionkey, c_mktsegment AS taxon, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey),
 k AS (SELECT DISTINCT site FROM s WHERE n_regionkey <> 4), x AS (SELECT unnest(['MACHINERY', 'FURNITURE', 'BUILDING']) AS taxon)
SELECT k.site, x.taxon, st AS stage, (SELECT count(*) FROM s WHERE s.site = k.site AND s.taxon = x.taxon AND (st = 'sporophyte' OR c_acctbal > 5000)) AS abundance
FROM k, x, (SELECT unnest(['sporophyte', 'gametophyte']) AS st)""")
def _(t):
    people = J.join_null_safe(t.customer, t.nation, [("c_nationkey", "n_nationkey")], "inner")
    taxa = ["MACHINERY", "FURNITURE", "BUILDING"]
    counts = [F.count(F.when(F.col("c_mktsegment") == v, F.lit(1))).alias(v) for v in taxa]
    all_rows = people.groupBy(F.concat("n_name", F.lit("_S")).alias("X1")).agg(*counts)
    some = people.where("c_acctbal > 5000").groupBy(F.concat("n_name", F.lit("_G")).alias("X1")).agg(*counts)
    sites = t.nation.where("n_regionkey <> 4").select(F.col("n_name").alias("site"))
    matrix = R.bind_rows(all_rows, some).withColumnRenamed("X1", "site")
    return M.community_long(matrix, "site", sites, {"_S": "sporophyte", "_G": "gametophyte"}, "taxon", "abundance")


@query("d14_control_recovery", _RECOVERY + """,
 g AS (SELECT o_orderpriority, o_orderstatus, time, avg(ratio) AS ratio_mean, stddev_samp(ratio) AS ratio_sd, count(*) AS ratio_n
       FROM r JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O' GROUP BY ALL),
 c AS (SELECT *, count(*) OVER (PARTITION BY o_orderstatus) AS k FROM g)
SELECT o_orderpriority, CASE WHEN k <= 12 THEN o_orderstatus || '_few' ELSE o_orderstatus END AS o_orderstatus, time,
  round(ratio_mean, 6) AS ratio_mean, round(ratio_sd, 6) AS ratio_sd, ratio_n FROM c""")
def _(t):
    control = t.orders.where("o_orderstatus <> 'O'").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    rec = J.join_null_safe(recovery(t), control, [("l_orderkey", "o_orderkey")], "inner")
    means = A.summarise(rec, ["o_orderpriority", "o_orderstatus", "time"], ["ratio"])
    return rounded(M.relabel_by_count(means, ["o_orderstatus"], "o_orderstatus", 12, "_few"), "ratio_mean", "ratio_sd")


@query("d15_recompute_yield", """
WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS f, l_quantity * 1999.7 AS fm, CASE WHEN l_returnflag = 'A' THEN '-' WHEN l_returnflag = 'R' THEN '0.7' END AS reported FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN reported IS NULL THEN NULL ELSE reported = '-' END AS yield_error,
  round(CASE WHEN (fm - f) / fm < 0 THEN 0 ELSE (fm - f) / fm END, 6) AS yield FROM d""")
def _(t):
    reported = S.recode("l_returnflag", {"A": "-", "R": "0.7"})
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("f"), (F.col("l_quantity") * 1999.7).alias("fm"), reported.alias("r"))
    return rounded(M.recompute_yield(d, "f", "fm", "r"), "yield").select("l_orderkey", "l_linenumber", "yield_error", "yield")


_CHECK = """
WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity * 20 AS manual, CASE WHEN l_linestatus = 'O' THEN l_quantity * 20 + l_tax * 400 END AS device,
  CASE l_returnflag WHEN 'A' THEN 'use manual' WHEN 'R' THEN 'use device' END AS note FROM lineitem)"""


@query("d16_reconcile_sources", _CHECK + """
SELECT l_orderkey, l_linenumber, round(CASE WHEN note = 'use manual' THEN manual WHEN note = 'use device' THEN device WHEN device IS NULL THEN manual ELSE device END, 6) AS yield,
  NOT coalesce(abs(device - manual) > 20 AND note IS NULL, false) AS pass_check FROM d""")
def _(t):
    note = S.recode("l_returnflag", {"A": "use manual", "R": "use device"})
    manual = F.col("l_quantity") * 20
    d = t.lineitem.select(
        "l_orderkey", "l_linenumber", manual.alias("manual"), note.alias("note"),
        F.when(F.col("l_linestatus") == "O", manual + F.col("l_tax") * 400).alias("device"),
    )
    out = M.reconcile(d, "manual", "device", "note", 20, "yield", strict=False)
    return rounded(out, "yield").select("l_orderkey", "l_linenumber", "yield", "pass_check")


@query("d17_correction_table", """
WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN l_partkey END AS memory, CASE WHEN l_returnflag = 'A' THEN l_linenumber END AS fix, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS manual FROM lineitem)
SELECT l_orderkey, l_linenumber, memory, coalesce(manual, memory + coalesce(fix, 0)) AS corrected FROM d WHERE memory IS NOT NULL""")
def _(t):
    flag = F.col("l_returnflag")
    d = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", F.col("l_partkey")).alias("memory"),
        F.when(flag == "A", F.col("l_linenumber")).alias("fix"), F.when(flag == "R", F.col("l_suppkey")).alias("manual"),
    )
    return M.correction_table(d, "memory", "fix", "manual", "corrected").select("l_orderkey", "l_linenumber", "memory", "corrected")


@query("d18_assemble_series", """
WITH m AS (SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 0 THEN 'keep' ELSE 'skip' END AS use_status, c_mktsegment AS generation FROM customer),
 s AS (SELECT event_id, ts, user_id, value AS rh, 'a' AS src FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, ts, user_id, value / 2, 'b' FROM events WHERE event_type = 'view')
SELECT event_id, round(rh, 6) AS rh, src, CASE WHEN generation = 'MACHINERY' AND ts > TIMESTAMP '2024-01-15' THEN 'late' WHEN generation = 'MACHINERY' AND ts < TIMESTAMP '2024-01-15' THEN 'early' ELSE generation END AS generation
FROM s LEFT JOIN m USING (user_id) WHERE CASE WHEN src = 'b' AND ts > TIMESTAMP '2024-01-25' THEN 'exclude' ELSE use_status END = 'keep'""")
def _(t):
    base = t.events.select("event_id", "ts", "user_id", "value", "event_type")
    a = base.where("event_type = 'click'").select("event_id", "ts", "user_id", F.col("value").alias("rh"), F.lit("a").alias("src"))
    b = base.where("event_type = 'view'").select("event_id", "ts", "user_id", (F.col("value") / 2).alias("rh"), F.lit("b").alias("src"))
    status = F.when(F.col("c_acctbal") > 0, "keep").otherwise("skip")
    meta = t.customer.select(F.col("c_custkey").alias("user_id"), status.alias("use_status"), F.col("c_mktsegment").alias("generation"))

    def day(text):
        return F.lit(text).cast("timestamp_ntz")

    special = F.col("generation") == "MACHINERY"
    rules = [(special & (F.col("ts") > day("2024-01-15 00:00:00")), "late"), (special & (F.col("ts") < day("2024-01-15 00:00:00")), "early")]
    drop = (F.col("src") == "b") & (F.col("ts") > day("2024-01-25 00:00:00"))
    out = M.assemble_series([a, b], meta, ["user_id"], "use_status", [drop], {"generation": rules})
    return rounded(out, "rh").select("event_id", "rh", "src", "generation")


@query("d20_outlier_flags", """
SELECT event_id, EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'error' AND b.value > 60 AND b.user_id = a.user_id AND CAST(b.ts AS DATE) = CAST(a.ts AS DATE)) AS outlier FROM events a""")
def _(t):
    ev = t.events.withColumn("day", F.to_date("ts"))
    listed = ev.where("event_type = 'error' and value > 60")
    return M.flag_listed(ev, listed, ["user_id", "day"]).select("event_id", "outlier")
