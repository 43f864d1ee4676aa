"""S19, E and T07-T10 on a forest: region -> nation -> supplier."""

from pyspark.sql import functions as F

from spanloom.operators import hierarchy as H
from spanloom.operators import signal as G
from spanloom.operators.expect import same_order
from spanloom.plans.aggregates import rounded
from spanloom.plans.registry import query
from spanloom.sources.trees import edges_of

_NL, _SL = "CAST(1 + n_nationkey % 4 * 0.5 AS DOUBLE)", "CAST(0.5 + s_suppkey % 7 * 0.25 AS DOUBLE)"
_FOREST = f"""
WITH RECURSIVE tips AS (SELECT n_regionkey AS tree_id, 'n' || n_nationkey AS nation, 's' || s_suppkey AS tip, {_NL} AS nl, {_SL} AS sl, s_acctbal AS x
   FROM supplier JOIN nation ON s_nationkey = n_nationkey),
 edges AS (SELECT DISTINCT tree_id, 'r' AS parent, nation AS child, nl AS length, false AS is_tip FROM tips
   UNION ALL SELECT tree_id, nation, tip, sl, true FROM tips UNION ALL SELECT DISTINCT tree_id, NULL, 'r', NULL, false FROM tips)"""


def forest(t):
    """One tree per region; inner nodes are nations that have suppliers."""
    nl = 1 + F.col("n_nationkey") % 4 * 0.5
    sl = 0.5 + F.col("s_suppkey") % 7 * 0.25
    tips = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("tree_id"), F.concat(F.lit("n"), "n_nationkey").alias("nation"),
        F.concat(F.lit("s"), "s_suppkey").alias("tip"), nl.alias("nl"), sl.alias("sl"),
    )
    empty = F.lit(None).cast("double").alias("support")
    leaf = tips.select("tree_id", F.col("nation").alias("parent"), F.col("tip").alias("child"), F.col("sl").alias("length"), F.col("tip").alias("label"), empty, F.lit(True).alias("is_tip"))
    inner = tips.select("tree_id", F.lit("r").alias("parent"), F.col("nation").alias("child"), F.col("nl").alias("length"), F.col("nation").alias("label"), (F.length("nation") * 25.0).alias("support"), F.lit(False).alias("is_tip")).distinct()
    root = tips.select("tree_id", F.lit(None).cast("string").alias("parent"), F.lit("r").alias("child"), F.lit(None).cast("double").alias("length"), F.lit("r").alias("label"), empty, F.lit(False).alias("is_tip")).distinct()
    return leaf.unionByName(inner).unionByName(root)


def traits(t):
    y = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("y"))
    joined = t.supplier.join(y, F.col("s_suppkey") == F.col("l_suppkey"))
    return joined.select(F.concat(F.lit("s"), "s_suppkey").alias("tip"), F.col("s_acctbal").alias("x"), "y")


@query("s19_read_trees", """
WITH tip AS (SELECT l_orderkey AS tree_id, l_returnflag AS flag, l_returnflag || l_linenumber AS tip, sum(l_quantity) AS len FROM lineitem GROUP BY 1, 2, l_linenumber),
 mid AS (SELECT tree_id, flag, CAST(count(*) AS DOUBLE) AS len FROM tip GROUP BY ALL)
SELECT tree_id, tip AS label, len AS length, true AS is_tip, false AS is_root FROM tip
UNION ALL SELECT tree_id, flag, len, false, false FROM mid UNION ALL SELECT DISTINCT tree_id, 'root', NULL, false, true FROM mid""")
def _(t):
    # One small tree per order, order -> flag -> line, written as text and read back.
    # A tree has at most one tip per flag and line number.
    tips = t.lineitem.groupBy(F.col("l_orderkey").alias("tree_id"), "l_returnflag", "l_linenumber").agg(F.sum("l_quantity").alias("len"))
    mark = F.concat("l_returnflag", F.col("l_linenumber").cast("string"), F.lit(":"), F.col("len").cast("string"))
    inner = tips.groupBy("tree_id", "l_returnflag").agg(F.array_join(F.collect_list(mark), ",").alias("body"), F.count(F.lit(1)).alias("n"))
    clause = F.concat(F.lit("("), "body", F.lit(")"), "l_returnflag", F.lit(":"), F.col("n").cast("string"))
    trees = inner.groupBy("tree_id").agg(F.concat(F.lit("("), F.array_join(F.collect_list(clause), ","), F.lit(")root;")).alias("text"))
    return edges_of(trees, "tree_id", "text").select("tree_id", "label", "length", "is_tip", F.col("parent").isNull().alias("is_root"))


_KEPT = _FOREST + """,
 k AS (SELECT * FROM tips WHERE x > 3000), c AS (SELECT tree_id, nation, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT tree_id, count(*) AS m FROM c GROUP BY 1)"""


@query("e01_keep_tips", _KEPT + """
SELECT k.tree_id, tip AS child, CASE WHEN n = 1 AND m = 1 THEN NULL WHEN n = 1 THEN 'r' ELSE k.nation END AS parent, CASE WHEN n = 1 THEN sl + nl ELSE sl END AS length
 FROM k JOIN c ON k.tree_id = c.tree_id AND k.nation = c.nation JOIN r ON k.tree_id = r.tree_id
UNION ALL SELECT DISTINCT k.tree_id, k.nation, CASE WHEN m > 1 THEN 'r' END, CASE WHEN m > 1 THEN nl END FROM k JOIN c ON k.tree_id = c.tree_id AND k.nation = c.nation JOIN r ON k.tree_id = r.tree_id WHERE n > 1
UNION ALL SELECT tree_id, 'r', NULL, NULL FROM r WHERE m > 1""")
def _(t):
    rich = t.supplier.where("s_acctbal > 3000").select(F.concat(F.lit("s"), "s_suppkey").alias("label"))
    return H.keep_tips(forest(t), rich).select("tree_id", "child", "parent", "length")


@query("e02_match_traits", _KEPT + """
SELECT k.tree_id, tip, x, row_number() OVER (PARTITION BY k.tree_id ORDER BY CASE WHEN n = 1 THEN tip ELSE k.nation END, tip) AS position
FROM k JOIN c ON k.tree_id = c.tree_id AND k.nation = c.nation""")
def _(t):
    rich = t.supplier.where("s_acctbal > 3000").select(F.concat(F.lit("s"), "s_suppkey").alias("tip"), F.col("s_acctbal").alias("x"))
    return H.match_traits(forest(t), rich, "tip")[0]


@query("e03_transfer_support", _FOREST + """
SELECT tree_id, child, CASE WHEN child LIKE 'n%' THEN length(child) * 25.0::DOUBLE END AS support, true AS matched FROM edges""")
def _(t):
    e = forest(t)
    plain = e.withColumn("support", F.lit(None).cast("double"))
    return H.transfer_support(e, plain).select("tree_id", "child", "support", "matched")


@query("e04_common_ancestor", _FOREST + """
SELECT tree_id, CASE WHEN count(*) = 1 THEN min(tip) WHEN count(DISTINCT nation) = 1 THEN min(nation) ELSE 'r' END AS node FROM tips WHERE x > 9000 GROUP BY 1""")
def _(t):
    rich = t.supplier.where("s_acctbal > 9000").select(F.concat(F.lit("s"), "s_suppkey").alias("label"))
    return H.common_ancestor(forest(t), rich)


@query("e05_covariance", _FOREST + """,
 o AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY nation, tip) AS pos FROM tips)
SELECT a.tree_id, a.tip AS tip_i, b.tip AS tip_j, round(CASE WHEN a.nation = b.nation THEN a.nl ELSE 0::DOUBLE END, 6) AS shared FROM o a JOIN o b ON a.tree_id = b.tree_id AND b.pos = a.pos + 1
UNION ALL SELECT tree_id, tip, tip, round(nl + sl, 6) FROM tips""")
def _(t):
    # Variances and the covariances of neighbouring tips; the pairs grow with the tips.
    e = forest(t)
    order = H.tip_order(e)
    here = order.select("tree_id", F.col("label").alias("tip_i"), F.explode(F.array(F.col("position"), F.col("position") + 1)).alias("position"))
    pairs = here.join(order.withColumnRenamed("label", "tip_j"), ["tree_id", "position"]).drop("position")
    return rounded(H.shared_length(e, pairs), "shared")


_PEEL = _FOREST + """,
 n1 AS (SELECT tree_id, nation, nl, sum(1 / sl) AS w, sum(x / sl) / sum(1 / sl) AS m, sum(x * x / sl) - pow(sum(x / sl), 2) / sum(1 / sl) AS q, count(*) AS n, sum(ln(sl)) + ln(sum(1 / sl)) AS ld FROM tips GROUP BY ALL),
 n2 AS (SELECT tree_id, sum(1 / (nl + 1 / w)) AS w, sum(m / (nl + 1 / w)) / sum(1 / (nl + 1 / w)) AS root, sum(q) + sum(m * m / (nl + 1 / w)) - pow(sum(m / (nl + 1 / w)), 2) / sum(1 / (nl + 1 / w)) AS q,
   CAST(sum(n) AS BIGINT) AS n, sum(ld) + sum(ln(nl + 1 / w)) AS logdet FROM n1 GROUP BY 1)"""


@query("e05b_tree_sums", _PEEL + "SELECT tree_id, n, round(w, 6) AS root_weight, round(root, 4) AS root_x, round(q, 0) AS q_x_x, round(logdet, 6) AS logdet FROM n2")
def _(t):
    e = forest(t)
    values = traits(t).select("tip", "x").withColumnRenamed("tip", "label").join(e.where("is_tip").select("tree_id", "label"), "label")
    sums = H.tree_sums(e, values, ["x"])
    out = rounded(rounded(sums, "root_weight", "logdet"), "root_x", digits=4)
    return rounded(out, "q_x_x", digits=0)


@query("e05c_contrast_weights", _PEEL + """
SELECT tips.tree_id, tips.nation AS contrast, tip, round(1 / sl / w, 6) AS coef FROM tips JOIN n1 ON tips.tree_id = n1.tree_id AND tips.nation = n1.nation""")
def _(t):
    w = H.contrast_weights(forest(t)).where("contrast != tip and contrast != 'r'")
    return rounded(w.select("tree_id", "contrast", "tip", "coef"), "coef")


@query("e06_lambda_branches", _FOREST + """
SELECT tree_id, child, lam, round(CASE WHEN NOT is_tip THEN length * lam ELSE (SELECT nl + sl - lam * nl FROM tips WHERE tips.tip = edges.child) END, 6) AS length
FROM edges, (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS lam) WHERE parent IS NOT NULL""")
def _(t):
    e = forest(t)
    grid = e.select("tree_id").distinct().withColumn("lam", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    scaled = H.scale_by_lambda(e, grid).where(F.col("parent").isNotNull())
    return rounded(scaled.select("tree_id", "child", "lam", "length"), "length")


@query("e07_tip_order", _FOREST + "SELECT tree_id, tip AS label, row_number() OVER (PARTITION BY tree_id ORDER BY nation, tip) AS position FROM tips")
def _(t):
    return H.tip_order(forest(t))


@query("e07b_node_attributes", _FOREST + """
SELECT tree_id, child, CASE WHEN child LIKE 'n%' AND length(child) * 25.0 >= 60 THEN length(child) * 25.0::DOUBLE END AS support, x AS acctbal
FROM edges LEFT JOIN (SELECT tip, x FROM tips) ON child = tip""")
def _(t):
    table = traits(t).select("tip", F.col("x").alias("acctbal"))
    return H.with_node_attributes(forest(t), table, "tip", 60.0).select("tree_id", "child", "support", "acctbal")


@query("g10_same_order", _FOREST + "SELECT count(*) AS n_rows, CAST(2 * count(DISTINCT tree_id) AS BIGINT) AS n_failed, false AS passed FROM tips")
def _(t):
    order = H.tip_order(forest(t)).withColumn("slot", F.struct("tree_id", "position"))
    # the first two tips of every tree change places
    moved = F.when(F.col("position") == 1, 2).when(F.col("position") == 2, 1).otherwise(F.col("position")).cast("long")
    other = order.withColumn("slot", F.struct("tree_id", moved.alias("position")))
    return same_order(order, other, "slot", "label")


_K = _PEEL + """,
 s AS (SELECT t.tree_id, sum(pow(x - root, 2)) AS ss, sum(nl + sl) AS diag FROM tips t JOIN n2 ON t.tree_id = n2.tree_id GROUP BY 1)"""


@query("t07_signal_k", _K + "SELECT s.tree_id, 'x' AS trait, round(ss / q / ((diag - n / w) / (n - 1)), 6) AS k FROM s JOIN n2 ON s.tree_id = n2.tree_id")
def _(t):
    # K itself needs no other orders; t07b has them
    return rounded(G.signal_k(forest(t), traits(t), "tip", ["x"], nsim=1).select("tree_id", "trait", "k"), "k")


@query("t07b_signal_k_permutation")
def _(t):
    return G.signal_k(forest(t), traits(t), "tip", ["x", "y"], seed=7)


def _lambda_sql(points=21, rounds=4):
    """Four grids of lambda, each around the best point of the one before, and the normal tail by Simpson's rule."""
    text = _FOREST + ", lim0 AS (SELECT tree_id, 0.0::DOUBLE AS lo, coalesce(min((nl + sl) / nullif(nl, 0)), 1) * (1 - 1e-9) AS hi FROM tips GROUP BY 1)"
    for i in range(rounds):
        text += f""",
 g{i} AS (SELECT tree_id, lo + (hi - lo) * i / {points - 1} AS lam FROM lim{i}, range({points}) r(i)),
 tl{i} AS (SELECT tips.tree_id, lam, nation, nl * lam AS nl, nl + sl - lam * nl AS sl, x FROM tips JOIN g{i} ON tips.tree_id = g{i}.tree_id),
 na{i} AS (SELECT tree_id, lam, nation, nl, sum(1 / sl) AS w, sum(x / sl) / sum(1 / sl) AS m, sum(x * x / sl) - pow(sum(x / sl), 2) / sum(1 / sl) AS q, count(*) AS n, sum(ln(sl)) + ln(sum(1 / sl)) AS ld FROM tl{i} GROUP BY ALL),
 nb{i} AS (SELECT tree_id, lam, sum(q) + sum(m * m / (nl + 1 / w)) - pow(sum(m / (nl + 1 / w)), 2) / sum(1 / (nl + 1 / w)) AS q, sum(n) AS n, sum(ld) + sum(ln(nl + 1 / w)) AS logdet FROM na{i} GROUP BY ALL),
 ll{i} AS (SELECT tree_id, lam, -0.5 * (n * ln(2 * pi()) + n * ln(q / n) + logdet + n) AS ll FROM nb{i}),
 lim{i + 1} AS (SELECT tree_id, greatest(lo, b - (hi - lo) / {points - 1}) AS lo, least(hi, b + (hi - lo) / {points - 1}) AS hi
   FROM lim{i} JOIN (SELECT tree_id, arg_max(lam, ll) AS b FROM ll{i} GROUP BY 1) USING (tree_id))"""
    every = " UNION ALL ".join(f"SELECT * FROM ll{i}" for i in range(rounds))
    return text + f""",
 o AS (SELECT tree_id, arg_max(lam, ll) AS lam, max(ll) AS log_lik, sqrt(greatest(2 * (max(ll) - max(ll) FILTER (lam = 0)), 0)) AS z FROM ({every}) GROUP BY 1)
SELECT tree_id, round(lam, 3) AS lam, round(log_lik, 4) AS log_lik, round(1 - 2 * (SELECT sum(CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * i / 400, 2) / 2)) FROM range(401) r(i)) * z / 1200 / sqrt(2 * pi()), 4) AS p_value FROM o"""


@query("t08_signal_lambda", _lambda_sql())
def _(t):
    return rounded(rounded(G.signal_lambda(forest(t), traits(t), "tip", "x"), "lam", digits=3), "log_lik", "p_value", digits=4)


@query("t08b_lambda_profile", _FOREST + """,
 g AS (SELECT unnest([0.0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS lam),
 tl AS (SELECT tree_id, lam, nation, nl * lam AS nl, nl + sl - lam * nl AS sl, x FROM tips, g),
 n1 AS (SELECT tree_id, lam, nation, nl, sum(1 / sl) AS w, sum(x / sl) / sum(1 / sl) AS m, sum(x * x / sl) - pow(sum(x / sl), 2) / sum(1 / sl) AS q, count(*) AS n, sum(ln(sl)) + ln(sum(1 / sl)) AS ld FROM tl GROUP BY ALL),
 n2 AS (SELECT tree_id, lam, sum(q) + sum(m * m / (nl + 1 / w)) - pow(sum(m / (nl + 1 / w)), 2) / sum(1 / (nl + 1 / w)) AS q, sum(n) AS n, sum(ld) + sum(ln(nl + 1 / w)) AS logdet FROM n1 GROUP BY ALL)
SELECT tree_id, lam, round(-0.5 * (n * ln(2 * pi()) + n * ln(q / n) + logdet + n), 4) AS log_lik FROM n2""")
def _(t):
    e = forest(t)
    grid = e.select("tree_id").distinct().withColumn("lam", F.explode(F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 1.0)])))
    values = traits(t).select(F.col("tip").alias("label"), "x").join(e.where("is_tip").select("tree_id", "label"), "label")
    return rounded(G.lambda_profile(e, values, "x", grid), "log_lik", digits=4)


_GLS = _FOREST + """,
 d AS (SELECT tips.*, y FROM tips JOIN (SELECT 's' || l_suppkey AS tip, avg(l_quantity) AS y FROM lineitem GROUP BY 1) USING (tip)),
 n1 AS (SELECT tree_id, nation, nl, sum(1 / sl) AS w, sum(x / sl) / sum(1 / sl) AS mx, sum(y / sl) / sum(1 / sl) AS my, sum(x * x / sl) - pow(sum(x / sl), 2) / sum(1 / sl) AS qxx,
   sum(x * y / sl) - sum(x / sl) * sum(y / sl) / sum(1 / sl) AS qxy, sum(y * y / sl) - pow(sum(y / sl), 2) / sum(1 / sl) AS qyy, count(*) AS n FROM d GROUP BY ALL),
 v AS (SELECT *, 1 / (nl + 1 / w) AS u FROM n1),
 n2 AS (SELECT tree_id, sum(u * mx) / sum(u) AS rx, sum(u * my) / sum(u) AS ry, sum(qxx) + sum(u * mx * mx) - pow(sum(u * mx), 2) / sum(u) AS qxx, sum(qxy) + sum(u * mx * my) - sum(u * mx) * sum(u * my) / sum(u) AS qxy,
   sum(qyy) + sum(u * my * my) - pow(sum(u * my), 2) / sum(u) AS qyy, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY 1)"""


@query("t09_tree_gls", _GLS + """
SELECT tree_id, n, round(ry - qxy / qxx * rx, 4) AS intercept, round(qxy / qxx, 8) AS slope, round(sqrt((qyy - qxy * qxy / qxx) / (n - 2)), 5) AS sigma,
  round(qxy * qxy / qxx / qyy, 5) AS r_squared, round(qxy * qxy / qxx / ((qyy - qxy * qxy / qxx) / (n - 2)), 4) AS f_value FROM n2""")
def _(t):
    m = G.tree_gls(forest(t), traits(t), "tip", "y", "x")
    m = rounded(rounded(m, "intercept", "f_value", digits=4), "sigma", "r_squared", digits=5)
    return rounded(m, "slope", digits=8).select("tree_id", "n", "intercept", "slope", "sigma", "r_squared", "f_value")


@query("t10_gls_fitted", _GLS + """
SELECT tips.tree_id, tip AS label, round(ry + qxy / qxx * (x - rx), 4) AS fitted FROM tips JOIN n2 ON tips.tree_id = n2.tree_id""")
def _(t):
    e, d = forest(t), traits(t)
    return rounded(G.gls_fitted(e, d, "tip", "x", G.tree_gls(e, d, "tip", "y", "x")), "fitted", digits=4)
