"""T01-T06, T14-T16: tests, curves, clustering."""

from pyspark.sql import functions as F

from spanloom.functions import tails
from spanloom.operators import cluster, curves, welch
from spanloom.operators import summaries as A
from spanloom.plans.aggregates import rounded
from spanloom.plans.registry import query

# Two-sided t tail by Simpson's rule on the density, 400 steps.
_P = """2 * (0.5 - CASE WHEN t IS NULL THEN NULL ELSE (SELECT sum(CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(pi() * df) - (df + 1) / 2 * ln(1 + pow(abs(t) * i / 400, 2) / df)) * abs(t) / 400 / 3) FROM range(401) r(i)) END)"""
_WELCH = """
WITH long AS (SELECT l_suppkey, l_returnflag AS side, 'l_extendedprice' AS response, l_extendedprice AS v FROM lineitem
   UNION ALL SELECT l_suppkey, l_returnflag, 'l_discount', l_discount FROM lineitem UNION ALL SELECT l_suppkey, l_returnflag, 'l_tax', l_tax FROM lineitem),
 m AS (SELECT l_suppkey, response, count(*) FILTER (side = 'A') AS na, count(*) FILTER (side = 'R') AS nb, avg(v) FILTER (side = 'A') AS ma, avg(v) FILTER (side = 'R') AS mb,
   var_samp(v) FILTER (side = 'A') AS va, var_samp(v) FILTER (side = 'R') AS vb FROM long GROUP BY ALL),
 w AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df FROM m WHERE na >= 2 AND nb >= 2)"""
VALUES = ["l_extendedprice", "l_discount", "l_tax"]


def welch_tests(t):
    return welch.welch_by_group(t.lineitem, ["l_suppkey"], "l_returnflag", ("A", "R"), VALUES)


@query("t01_welch_by_group", _WELCH + f"""
SELECT l_suppkey, response, round(ma - mb, 4) AS difference, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round(t, 5) AS statistic, round(df, 4) AS df, round({_P}, 5) AS p_value FROM w""")
def _(t):
    out = rounded(welch_tests(t), "difference", "mean_a", "mean_b", "df", digits=4)
    return rounded(out, "statistic", "p_value", digits=5).drop("conf_low", "conf_high")


# The quantile by Newton's steps on the tail, from the left, where they only rise.
_LOG_DENSITY = "lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(pi() * df) - (df + 1) / 2 * ln(1 + pow({}, 2) / df)"


@query("t01b_welch_interval", _WELCH.replace("WITH", "WITH RECURSIVE", 1) + f""",
 it AS (SELECT l_suppkey, response, df, 1.0::DOUBLE AS q, 0 AS i FROM w UNION ALL
   SELECT l_suppkey, response, df, q + (0.475 - sum(CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * exp({_LOG_DENSITY.format("q * j / 2000")})) * q / 6000) / exp({_LOG_DENSITY.format("q")}), i + 1
   FROM it, range(2001) r(j) WHERE i < 25 GROUP BY l_suppkey, response, df, q, i)
SELECT l_suppkey, response, round(ma - mb - q * sqrt(va / na + vb / nb), 3) AS conf_low, round(ma - mb + q * sqrt(va / na + vb / nb), 3) AS conf_high
FROM w LEFT JOIN (SELECT * FROM it WHERE i = 25) USING (l_suppkey, response)""")
def _(t):
    return rounded(welch_tests(t).select("l_suppkey", "response", "conf_low", "conf_high"), "conf_low", "conf_high", digits=3)


# Saturating response with a supplier-specific rate, plus scatter from the discounts.
_POINTS = """SELECT l_suppkey, l_quantity AS x, avg((1000 + 10 * l_suppkey) * (1 - exp(-l_quantity * (0.05 + 0.0005 * (l_suppkey % 100)))) + 500 * (l_discount - 0.05)) AS y
  FROM lineitem GROUP BY ALL"""
_FIT = f"""
WITH RECURSIVE p AS ({_POINTS}), a AS (SELECT l_suppkey, max(y) AS a, count(*) AS n FROM p GROUP BY 1),
 it(l_suppkey, k, i) AS (SELECT l_suppkey, 0.04::DOUBLE, 0 FROM a UNION ALL
   SELECT it.l_suppkey, it.k + sum(a * x * exp(-it.k * x) * (y - a * (1 - exp(-it.k * x)))) / sum(pow(a * x * exp(-it.k * x), 2)), it.i + 1
   FROM it JOIN p ON it.l_suppkey = p.l_suppkey JOIN a ON it.l_suppkey = a.l_suppkey WHERE it.i < 60 GROUP BY it.l_suppkey, it.k, it.i),
 k AS (SELECT l_suppkey, k FROM it WHERE i = 60),
 f AS (SELECT p.l_suppkey, x, y, a.a, a.n, k.k, a.a * (1 - exp(-k.k * x)) AS fitted FROM p JOIN a USING (l_suppkey) JOIN k USING (l_suppkey))"""


def points(t):
    rate = 0.05 + 0.0005 * (F.col("l_suppkey") % 100)
    response = (1000 + 10 * F.col("l_suppkey")) * (1 - F.exp(-F.col("l_quantity") * rate)) + 500 * (F.col("l_discount") - 0.05)
    return t.lineitem.groupBy("l_suppkey", F.col("l_quantity").alias("x")).agg(F.avg(response).alias("y"))


def fits(t):
    p = points(t)
    return p, curves.fit_saturation(p, ["l_suppkey"], "x", "y")


@query("t02_saturating_fit", _FIT + """
SELECT l_suppkey, n, round(a, 4) AS a, round(k, 7) AS k, round(sqrt(sum(pow(y - fitted, 2)) / (n - 1) / sum(pow(a * x * exp(-k * x), 2))), 7) AS se FROM f GROUP BY l_suppkey, n, a, k""")
def _(t):
    out = rounded(fits(t)[1], "k", "se", digits=7)
    return rounded(out, "a", digits=4).select("l_suppkey", "n", "a", "k", "se")


@query("t03_fitted_values", _FIT + "SELECT l_suppkey, x, round(fitted, 2) AS fitted FROM f")
def _(t):
    p, params = fits(t)
    return rounded(curves.with_fitted(p, params, ["l_suppkey"], "x"), "fitted", digits=2).select("l_suppkey", "x", "fitted")


@query("t03b_fitted_max", _FIT + "SELECT l_suppkey, round(max(fitted), 2) AS fitted_max FROM f GROUP BY 1")
def _(t):
    p, params = fits(t)
    return rounded(curves.fitted_max(curves.with_fitted(p, params, ["l_suppkey"], "x"), ["l_suppkey"]), "fitted_max", digits=2)


@query("t04_inverse_at_95", _FIT + """,
 o AS (SELECT *, 0.95 * max(fitted) OVER (PARTITION BY l_suppkey) AS target, lead(fitted) OVER w AS f1, lead(x) OVER w AS x1 FROM f WINDOW w AS (PARTITION BY l_suppkey ORDER BY fitted))
SELECT l_suppkey, round(x + (target - fitted) / (f1 - fitted) * (x1 - x), 4) AS x_at FROM o WHERE fitted <= target AND f1 > target""")
def _(t):
    p, params = fits(t)
    fitted = curves.with_fitted(p, params, ["l_suppkey"], "x")
    return rounded(curves.inverse_at(fitted, ["l_suppkey"], "x"), "x_at", digits=4)


@query("t05_critical_x", _FIT + "SELECT l_suppkey, round(-ln(0.05) / k, 3) AS x_critical FROM k")
def _(t):
    return fits(t)[1].select("l_suppkey", F.round(curves.critical_x(F.col("k")), 3).alias("x_critical"))


def cuts_sql(rows, clusters):
    """Optimal cuts of the days x by group g of ``rows`` (the tables ending in o): dynamic programming over the distinct days, one table of least sums of squares per cluster; ends in j(…, cluster)."""
    square = "(b.cxx - a.cxx) - (b.cx - a.cx) * (b.cx - a.cx) / (b.cn - a.cn)::DOUBLE"
    text = f"""
WITH {rows},
 v AS (SELECT g, x, count(*) AS n FROM o GROUP BY ALL),
 c AS (SELECT g, x, row_number() OVER w AS j, sum(n) OVER w AS cn, sum(n * x) OVER w AS cx, sum(n * x * x) OVER w AS cxx FROM v WINDOW w AS (PARTITION BY g ORDER BY x)),
 k1 AS (SELECT g, j, cn, cx, cxx, cxx - cx * cx / cn::DOUBLE AS s, 0 AS cut FROM c)"""
    for k in range(2, clusters + 1):
        text += f""",
 k{k} AS (SELECT b.g, b.j, any_value(b.cn) AS cn, any_value(b.cx) AS cx, any_value(b.cxx) AS cxx, min(a.s + {square}) AS s, arg_min(a.j, a.s + {square}) AS cut
   FROM c b JOIN k{k - 1} a ON a.g = b.g AND a.j < b.j GROUP BY b.g, b.j)"""
    text += f", z{clusters + 1} AS (SELECT g, max(j) AS cut FROM c GROUP BY 1)"
    for k in range(clusters, 1, -1):
        text += f", z{k} AS (SELECT g, k{k}.cut FROM k{k} JOIN z{k + 1} z USING (g) WHERE k{k}.j = z.cut)"
    places = " + ".join(f"(c.j > z{k}.cut)::INT" for k in range(2, clusters + 1))
    joins = " ".join(f"JOIN z{k} ON z{k}.g = c.g" for k in range(2, clusters + 1))
    return text + f", j AS (SELECT o.*, 1 + {places} AS cluster FROM o JOIN c ON o.g = c.g AND o.x = c.x {joins})"


DAY = "date_diff('day', DATE '1995-01-01', CAST({} AS DATE))"


@query("t06_kmeans_1d", cuts_sql(f"o AS (SELECT o_orderkey, o_orderstatus AS g, {DAY.format('o_orderdate')} AS x FROM orders)", 5)
       + " SELECT o_orderkey, g AS o_orderstatus, cluster FROM j")
def _(t):
    return cluster.kmeans_1d(t.orders, ["o_orderstatus"], "o_orderdate", 5).select("o_orderkey", "o_orderstatus", "cluster")


@query("t14_tail_probabilities", f"""
WITH g AS (SELECT l_suppkey, avg(l_tax - 0.04) / (stddev_samp(l_tax) / sqrt(count(*))) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM lineitem GROUP BY 1)
SELECT l_suppkey, round({_P}, 5) AS t_tail, round({_P}, 5) AS f_tail FROM g""")
def _(t):
    n = F.count(F.lit(1))
    g = t.lineitem.groupBy("l_suppkey").agg(
        (F.avg(F.col("l_tax") - 0.04) / (F.stddev_samp("l_tax") / F.sqrt(n))).alias("t"), (n - 1).alias("df")
    )
    return g.select(
        "l_suppkey", F.round(tails.t_p_value(F.col("t"), F.col("df")), 5).alias("t_tail"),
        F.round(tails.f_p_value(F.col("t") * F.col("t"), F.lit(1.0), F.col("df")), 5).alias("f_tail"),
    )


@query("t15_significance_gate", _WELCH + f"""
SELECT l_suppkey, response FROM (SELECT *, {_P} AS p FROM w) WHERE p < 0.05""")
def _(t):
    return welch_tests(t).where("p_value < 0.05").select("l_suppkey", "response")


@query("t16_formatted_p", _WELCH + f"""
SELECT l_suppkey, response, CASE WHEN p < 0.001 THEN '< 0.001' ELSE printf('%.3f', round(p, 3)) END AS p_text FROM (SELECT *, {_P} AS p FROM w) WHERE l_suppkey = 3 AND response = 'l_tax'""")
def _(t):
    return welch.formatted_p(welch_tests(t), "l_suppkey", 3, "l_tax", alpha=None)


@query("d19_poor_fit_filter", f"""
WITH RECURSIVE {_FIT.split("WITH RECURSIVE ")[1]},
 w AS (SELECT l_suppkey, k / sqrt(sum(pow(y - fitted, 2)) / (n - 1) / sum(pow(a * x * exp(-k * x), 2))) AS t, CAST(n - 1 AS DOUBLE) AS df FROM f GROUP BY l_suppkey, n, a, k)
SELECT l_suppkey, x FROM p WHERE l_suppkey IN (SELECT l_suppkey FROM (SELECT *, {_P} AS p FROM w) WHERE t > 40 OR p < 0.05)""")
def _(t):
    p, params = fits(t)
    return curves.good_fits(p, params, ["l_suppkey"]).select("l_suppkey", "x")
