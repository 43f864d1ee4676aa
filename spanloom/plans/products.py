"""K04, V and T11-T13: report tables and mixed-model summaries."""

from pyspark.sql import functions as F

from spanloom.functions import scalar as S
from spanloom.operators import joins as J
from spanloom.operators import mixed as X
from spanloom.operators import ranks as W
from spanloom.operators import report as P
from spanloom.operators import reshape as R
from spanloom.operators import summaries as A
from spanloom.operators import tree_grid
from spanloom.operators import variance_grid as G
from spanloom.operators import welch
from spanloom.operators.curves import critical_x, fitted_max, inverse_at, with_fitted
from spanloom.plans.aggregates import rounded
from spanloom.plans.measures import _RECOVERY, recovery, site_exposure
from spanloom.plans.registry import query
from spanloom.plans.stats import _FIT, _P, fits
from spanloom.plans.trees import forest

_TEXT = "printf('%.2f', round(avg(l_tax * 100), 2)) || CASE WHEN count(*) > 1 THEN ' ± ' || printf('%.2f', round(stddev_samp(l_tax * 100), 2)) ELSE '' END"


@query("k04_formatted_table", f"""
WITH s AS (SELECT l_returnflag, l_linestatus, l_linenumber, {_TEXT} AS text, count(*) AS n FROM lineitem GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (ORDER BY l_returnflag, l_linestatus, l_linenumber) AS row_no FROM s)
SELECT *, min(row_no) OVER (PARTITION BY l_returnflag) AS first_row, max(row_no) OVER (PARTITION BY l_returnflag) AS last_row FROM r""")
def _(t):
    li = t.lineitem.withColumn("rate", F.col("l_tax") * 100)
    table = P.formatted_summary(li, ["l_returnflag", "l_linestatus", "l_linenumber"], "rate")
    return P.block_index(table, "l_returnflag", ["l_linestatus", "l_linenumber"])


@query("v01_recovery_panels", _RECOVERY + """,
 g AS (SELECT c_mktsegment, o_orderpriority, time, avg(ratio) AS m, count(*) AS n FROM r JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 l AS (SELECT o_orderpriority, CASE WHEN min(n) = max(n) THEN CAST(min(n) AS VARCHAR) ELSE min(n) || '-' || max(n) END AS n_label FROM g GROUP BY 1)
SELECT c_mktsegment, g.o_orderpriority, time, round(m, 6) AS ratio_mean, n AS ratio_n, upper(left(c_mktsegment, 1)) || '. ' || lower(substr(c_mktsegment, 2)) AS label, 'n = ' || n_label AS n_label,
  dense_rank() OVER (ORDER BY g.o_orderpriority) AS level_order FROM g JOIN l ON g.o_orderpriority = l.o_orderpriority""")
def _(t):
    keys = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "c_mktsegment")
    rec = J.join_null_safe(recovery(t), keys, [("l_orderkey", "o_orderkey")], "inner")
    means = A.summarise(rec, ["c_mktsegment", "o_orderpriority", "time"], ["ratio"], ("mean", "n"))
    labels = P.size_labels(rec, ["c_mktsegment", "time"], ["o_orderpriority"])
    out = J.join_null_safe(means, labels, "o_orderpriority").withColumns(
        {
            "label": F.concat(F.upper(F.substring("c_mktsegment", 1, 1)), F.lit(". "), F.lower(F.substr("c_mktsegment", F.lit(2)))),
            "n_label": F.concat(F.lit("n = "), "n_label"),
        }
    )
    return rounded(W.dense_id(out, ["o_orderpriority"], "level_order"), "ratio_mean")


@query("v02_significance_labels", f"""
WITH m AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nb, avg(l_tax) FILTER (l_returnflag = 'A') AS ma, avg(l_tax) FILTER (l_returnflag = 'R') AS mb,
   var_samp(l_tax) FILTER (l_returnflag = 'A') AS va, var_samp(l_tax) FILTER (l_returnflag = 'R') AS vb FROM lineitem GROUP BY ALL),
 w AS (SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df FROM m WHERE na >= 2 AND nb >= 2),
 p AS (SELECT l_suppkey, {_P} AS p FROM w),
 h AS (SELECT l_suppkey, CASE WHEN count(*) = count(x) THEN max(x) END AS height FROM (SELECT l_suppkey, avg(l_tax) + stddev_samp(l_tax) AS x FROM lineitem GROUP BY l_suppkey, l_returnflag) GROUP BY 1)
SELECT l_suppkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS label, round(height, 6) AS height FROM p JOIN h USING (l_suppkey)""")
def _(t):
    tests = welch.welch_by_group(t.lineitem, ["l_suppkey"], "l_returnflag", ("A", "R"), ["l_tax"])
    summary = A.summarise(t.lineitem, ["l_suppkey", "l_returnflag"], ["l_tax"], ("mean", "sd"))
    return rounded(P.significance_labels(tests, summary, ["l_suppkey"], "l_tax", "l_tax"), "height")


@query("v03_wide_comparison", """
WITH r AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY ALL),
 w AS (SELECT c_nationkey AS nation, max(m) FILTER (c_mktsegment = 'MACHINERY') AS "recovery_MACHINERY", max(m) FILTER (c_mktsegment = 'FURNITURE') AS "recovery_FURNITURE" FROM r GROUP BY 1),
 d AS (SELECT user_id % 25 AS site, event_type, CAST(ts AS DATE) AS day, max(value) AS m FROM events WHERE event_type <> 'error' GROUP BY ALL),
 e AS (SELECT site, event_type, avg(m) AS v FROM d GROUP BY ALL),
 x AS (SELECT site, max(v) FILTER (event_type = 'click') AS "vpd_click", max(v) FILTER (event_type = 'view') AS "vpd_view" FROM e GROUP BY 1),
 s AS (SELECT s_nationkey, count(*) AS n_sites FROM supplier GROUP BY 1)
SELECT CAST(nation AS BIGINT) AS nation, round("recovery_MACHINERY", 6) AS "recovery_MACHINERY", round("recovery_FURNITURE", 6) AS "recovery_FURNITURE", round("vpd_click", 6) AS "vpd_click", round("vpd_view", 6) AS "vpd_view", n_sites
FROM w LEFT JOIN x ON nation = site LEFT JOIN s ON nation = s_nationkey""")
def _(t):
    nation = F.col("c_nationkey").cast("long").alias("nation")
    means = t.customer.groupBy(nation, "c_mktsegment").agg(F.avg("c_acctbal").alias("recovery"))
    rec = R.to_wide(means, ["nation"], "c_mktsegment", ["recovery"], ["MACHINERY", "FURNITURE"])
    vpd = R.to_wide(site_exposure(t), ["site"], "habit", ["vpd"], ["click", "view"]).withColumnRenamed("site", "nation")
    sites = t.supplier.groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.count(F.lit(1)).alias("n_sites"))
    out = J.join_all([rec, vpd, sites], "nation", "left")
    return rounded(out, "recovery_MACHINERY", "recovery_FURNITURE", "vpd_click", "vpd_view")


@query("v04_series_in_session_bounds", """
WITH b AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT event_id, 'bounded' AS series FROM events e JOIN b ON e.user_id = b.user_id AND e.ts BETWEEN lo AND hi WHERE event_type IN ('click', 'view')
UNION ALL SELECT event_id, 'all' FROM events WHERE event_type = 'purchase' AND ts BETWEEN (SELECT min(ts) FROM events WHERE event_type = 'error' AND value > 50) AND (SELECT max(ts) FROM events WHERE event_type = 'error' AND value > 50)""")
def _(t):
    ev = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    series = ev.where("event_type in ('click', 'view')")
    one = J.band_filter(series, ev.where("event_type = 'signup'"), "ts", "ts", "ts", ["user_id"])
    two = J.band_filter(ev.where("event_type = 'purchase'"), ev.where("event_type = 'error' and value > 50"), "ts", "ts", "ts")
    parts = [d.select("event_id", F.lit(name).alias("series")) for d, name in ((one, "bounded"), (two, "all"))]
    return R.bind_rows(*parts)


@query("v05_complete_groups", """
SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate, l_quantity FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 4)""")
def _(t):
    out = P.complete_groups(t.lineitem, ["l_orderkey"], "l_linenumber", F.col("l_linenumber") == 1, F.col("l_linenumber") > 4)
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_quantity")


@query("v06_curve_panels", _FIT + """,
 o AS (SELECT *, 0.95 * max(fitted) OVER (PARTITION BY l_suppkey) AS target, max(fitted) OVER (PARTITION BY l_suppkey) AS top, lead(fitted) OVER w AS f1, lead(x) OVER w AS x1 FROM f WINDOW w AS (PARTITION BY l_suppkey ORDER BY fitted))
SELECT l_suppkey, round(top, 2) AS fitted_max, round(x + (target - fitted) / (f1 - fitted) * (x1 - x), 4) AS x_at, round(-ln(0.05) / k, 3) AS x_critical, CAST(ceil(dense_rank() OVER (ORDER BY l_suppkey) / 24) AS BIGINT) AS page FROM o WHERE fitted <= target AND f1 > target""")
def _(t):
    p, params = fits(t)
    fitted = with_fitted(p, params, ["l_suppkey"], "x")
    lines = params.select("l_suppkey", critical_x(F.col("k")).alias("x_critical"))
    table = J.join_all([fitted_max(fitted, ["l_suppkey"]), inverse_at(fitted, ["l_suppkey"], "x"), lines], "l_suppkey", "left")
    table = rounded(rounded(rounded(table, "fitted_max", digits=2), "x_at", digits=4), "x_critical", digits=3)
    return P.pages(table, ["l_suppkey"], 24)


@query("v07_text_statistics", """
WITH m AS (SELECT user_id, avg(value) AS m FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT (SELECT count(DISTINCT user_id) FROM events) || ' users' AS n_text, printf('%.2f', round(avg(m), 2)) || ' ± ' || printf('%.2f', round(stddev_samp(m), 2)) AS mean_text,
  printf('%.1f', round(min(m), 1)) || '-' || printf('%.1f', round(max(m), 1)) AS range_text, (SELECT array_to_string(list(DISTINCT event_type ORDER BY event_type)[1:4], ', ') || ', and ' || max(event_type) FROM events) AS kinds FROM m""")
def _(t):
    kept = t.events.where("event_type <> 'error'").groupBy("user_id").agg(F.avg("value").alias("m"))
    text = kept.agg(
        S.mean_sd_text(F.avg("m"), F.stddev_samp("m")).alias("mean_text"),
        F.concat(S.fixed(F.min("m"), 1), F.lit("-"), S.fixed(F.max("m"), 1)).alias("range_text"),
    )
    kinds = t.events.agg(
        F.concat(F.countDistinct("user_id").cast("string"), F.lit(" users")).alias("n_text"),
        S.word_list(F.array_sort(F.collect_set("event_type"))).alias("kinds"),
    )
    return text.withColumns({"n_text": kinds.select("n_text").scalar(), "kinds": kinds.select("kinds").scalar()})


@query("v08_reference_recovery", _RECOVERY + """
SELECT o_orderpriority, time, round(avg(ratio), 6) AS ratio_mean, round(stddev_samp(ratio), 6) AS ratio_sd, count(*) AS ratio_n FROM r JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL""")
def _(t):
    ref = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")
    rec = J.join_null_safe(recovery(t), ref, [("l_orderkey", "o_orderkey")], "inner")
    return rounded(A.summarise(rec, ["o_orderpriority", "time"], ["ratio"]), "ratio_mean", "ratio_sd")


SPECS = {
    "habit": [("c_mktsegment",)],
    "generation": [("stage",)],
    "both": [("c_mktsegment",), ("stage",)],
    "interaction": [("c_mktsegment",), ("stage",), ("c_mktsegment", "stage")],
    "null": [],
}


def modelled(t):
    """Moments and posterior grid of five specs for two responses; group = nation, whole customer table."""
    stage = F.when(F.col("c_acctbal") > 5000, "rich").otherwise("plain")
    spend = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"))
    people = J.join_null_safe(t.customer.withColumn("stage", stage), spend, [("c_custkey", "o_custkey")])
    people = people.withColumns({"spend": F.log1p("spend"), "balance": F.col("c_acctbal") / 1000})
    models = G.model_moments(people, ["spend", "balance"], ["c_mktsegment", "stage"], SPECS, "c_nationkey")
    return G.posterior_grid(models), models


_SEGMENTS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_COLUMNS = {"(Intercept)": "1"} | {f"c_mktsegment{v}": f"(seg = '{v}')::INT" for v in _SEGMENTS} | {"stagerich": "rich"}
_COLUMNS |= {f"c_mktsegment{v}:stagerich": f"(seg = '{v}')::INT * rich" for v in _SEGMENTS}
_USES = {"habit": range(5), "generation": (0, 5), "both": range(6), "interaction": range(10), "null": (0,)}


def _customer_ctes(x, pairs, each):
    y = len(x)
    return [
        "c AS (SELECT c_nationkey AS g, c_mktsegment AS seg, (c_acctbal > 5000)::INT AS rich, ln(1 + spend) AS spend, c_acctbal / 1000 AS balance"
        " FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spend FROM orders GROUP BY 1) ON c_custkey = o_custkey)",
        "l AS (SELECT 'spend' AS response, *, spend AS v FROM c WHERE spend IS NOT NULL UNION ALL SELECT 'balance', *, balance FROM c WHERE balance IS NOT NULL)",
        "d AS (SELECT response, g, avg(v) OVER (PARTITION BY response) AS shift, "
        + ", ".join(f"({text})::DOUBLE AS x{i}" for i, text in enumerate(x.values())) + f", v - avg(v) OVER (PARTITION BY response) AS x{y} FROM l)",
        "gs AS (SELECT response, g, count(*) AS n, " + ", ".join(f"sum(x{i}) AS s{i}" for i in range(y + 1)) + " FROM d GROUP BY ALL)",
        "tt AS (SELECT response, count(*) AS nr, max(shift) AS shift, " + each("sum(x{i} * x{j}) AS t{i}_{j}") + " FROM d GROUP BY 1)",
        "bt AS (SELECT response, " + each("sum(s{i} * s{j} / n) AS b{i}_{j}") + " FROM gs GROUP BY 1)",
        "ss AS (SELECT response, lr, sum(ln(1 + n * exp(lr))) AS ldv, sum(n * exp(lr) / (1 + n * exp(lr))) AS sv, "
        + each("sum(s{i} * s{j} / (n * (1 + n * {e}))) AS p{i}_{j}, sum(-{e} * s{i} * s{j} / ((1 + n * {e}) * (1 + n * {e}))) AS d{i}_{j}") + " FROM gs, gr GROUP BY ALL)",
        "a AS (SELECT ss.response, lr, ldv, sv, nr, shift, 0.0::DOUBLE AS ld, " + each("t{i}_{j} - b{i}_{j} + p{i}_{j} AS a{i}_{j}, d{i}_{j}") + " FROM ss JOIN tt USING (response) JOIN bt USING (response))",
    ]


def _grid_sql(x, uses, sums, low=-14, high=14):
    """The posterior of every spec on a fixed grid, by symmetric sweeps written out; numbers name the columns of the full design.

    ``sums`` writes the queries down to ``a``, the cross products at every grid point.
    """
    names, y = list(x), len(x)
    pairs = [(i, j) for i in range(y + 1) for j in range(i, y + 1)]

    def each(text, of=pairs):
        return ", ".join(text.format(i=i, j=j, e="exp(lr)") for i, j in of)

    def at(i, j, name="a"):
        return f"{name}{min(i, j)}_{max(i, j)}"

    ctes = [f"gr AS (SELECT {low} + i * 0.025::DOUBLE AS lr FROM range({round((high - low) * 40) + 1}) r(i))", *sums(x, pairs, each)]
    for spec, use in uses.items():
        source, inside = "a", [*use, y]
        of = [(i, j) for i, j in pairs if i in inside and j in inside]
        for k in use:
            d = at(k, k)
            new = [
                f"-1 / {d}" if i == j == k else f"{at(i, j)} / {d}" if k in (i, j) else f"{at(i, j)} - {at(i, k)} * {at(k, j)} / {d}" for i, j in of
            ]
            ctes.append(
                f"{spec}{k} AS (SELECT response, lr, ldv, sv, nr, shift, ld + ln({d}) AS ld, " + each("d{i}_{j}", of) + ", "
                + ", ".join(f"{v} AS {at(i, j)}" for v, (i, j) in zip(new, of)) + f" FROM {source})"
            )
            source = f"{spec}{k}"
        square = " + ".join(f"{at(i, j, 'd')} * {f'-{at(i, y)}' if i != y else '1'} * {f'-{at(j, y)}' if j != y else '1'}" for i in inside for j in inside)
        trace = " + ".join(f"-{at(i, j)} * {at(i, j, 'd')}" for i in use for j in use)
        beta, unit = (", ".join(t.format(i=i, y=y) for i in use) for t in ("a{i}_{y}", "-a{i}_{i}"))
        param = ", ".join(f"'{names[i]}'" for i in use)
        zero = ", ".join(f"a{i}_{y}" if i in use else "0" for i in range(y))
        ctes.append(
            f"f_{spec} AS (SELECT '{spec}' AS spec, response, lr, nr, shift, ldv + ld AS ld, {len(use)} AS rank, a{y}_{y} AS rss, a{y}_{y} + {square} AS fit,"
            f" {len(use)} + sv + {trace} AS hat, [{beta}] AS beta, [{unit}] AS unit, [{param}] AS params, [{zero}] AS full_ FROM {source})"
        )
    ctes += [
        "u AS (" + " UNION ALL ".join(f"SELECT * FROM f_{s}" for s in uses) + ")",
        "v AS (SELECT *, (nr - rank) / 2 + 0.02::DOUBLE AS sh, (rss + 0.02::DOUBLE * (1 + exp(-lr))) / 2 AS ra FROM u)",
        "lw AS (SELECT *, -0.01::DOUBLE * lr - ld / 2 - sh * ln(ra) AS lw FROM v)",
        "mx AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY response, spec)) AS e FROM lw)",
        "w AS (SELECT *, e / sum(e) OVER (PARTITION BY response, spec) AS w FROM mx)",
    ]
    return "WITH " + ", ".join(ctes), y


_GRID, _Y = _grid_sql(_COLUMNS, _USES, _customer_ctes)


_MEANS = """,
 e AS (SELECT response, spec, w, sh, ra, shift, unnest(params) AS param, unnest(beta) AS b, unnest(unit) AS uv FROM w),
 m AS (SELECT response, spec, param, w, b + CASE WHEN param = '(Intercept)' THEN shift ELSE 0 END AS one, uv * ra / (sh - 1) AS var FROM e
  UNION ALL SELECT response, spec, 'units_var', w, ra / (sh - 1), ra * ra / ((sh - 1) * (sh - 1) * (sh - 2)) FROM w
  UNION ALL SELECT response, spec, 'group_var', w, exp(lr) * ra / (sh - 1), exp(2 * lr) * ra * ra / ((sh - 1) * (sh - 1) * (sh - 2)) FROM w)
SELECT response, spec, param, round(sum(w * one), 6) AS mean, round(sqrt(sum(w * (var + one * one)) - sum(w * one) * sum(w * one)), 6) AS sd FROM m GROUP BY ALL"""


@query("t11_mixed_grid", _GRID + _MEANS)
def _(t):
    return rounded(G.posterior_means(*modelled(t)), "mean", "sd")


@query("t11b_mixed_scores", _GRID + f""",
 bm AS (SELECT response, spec, sum(w * ra / (sh - 1)) AS units, max(nr) AS nr,
   sum(w * (nr * (ln(2 * pi()) + ln(ra) - (ln(sh) - 1 / (2 * sh) - 1 / (12 * sh * sh) + 1 / (120 * sh * sh * sh * sh))) + sh / ra * fit + hat)) AS dm,
   {", ".join(f"sum(w * full_[{i + 1}]) AS m{i}" for i in range(_Y))} FROM w GROUP BY ALL),
 um AS (SELECT w.response, spec, g, sum(w * exp(lr) / (1 + n * exp(lr)) * (s{_Y}{"".join(f" - s{i} * full_[{i + 1}]" for i in range(_Y))})) AS um FROM w JOIN gs ON w.response = gs.response GROUP BY ALL),
 r AS (SELECT d.response, um.spec, sum((x{_Y}{"".join(f" - x{i} * m{i}" for i in range(_Y))} - um) ** 2) AS rss
  FROM d JOIN um ON d.response = um.response AND d.g = um.g JOIN bm ON bm.response = um.response AND bm.spec = um.spec GROUP BY ALL),
 dic AS (SELECT response, spec, 2 * dm - (nr * (ln(2 * pi()) + ln(units)) + rss / units) AS dic FROM bm JOIN r USING (response, spec))
SELECT response, spec, round(dic, 4) AS dic, round(dic - min(dic) OVER (PARTITION BY response), 4) AS delta_dic FROM dic""")
def _(t):
    return rounded(G.grid_dic(*modelled(t)), "dic", "delta_dic", digits=4)


@query("t11c_mixed_parameters")
def _(t):
    return G.best_effects(*modelled(t))

TREE_SPECS = {
    "habit": [("l_linestatus",)], "generation": [("band",)], "both": [("l_linestatus",), ("band",)],
    "interaction": [("l_linestatus",), ("band",), ("l_linestatus", "band")], "null": [],
}


def tree_modelled(t):
    """Moments and posterior grid of five specs for two responses of all order lines; effects of suppliers along the forest of region and nation."""
    lines = t.lineitem.select(
        F.concat(F.lit("s"), "l_suppkey").alias("tip"), "l_linestatus", F.when(F.col("l_tax") > 0.04, "high").otherwise("low").alias("band"),
        F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_discount") * 100).cast("double").alias("discount"),
    )
    models = tree_grid.tree_moments(lines, ["quantity", "discount"], ["l_linestatus", "band"], TREE_SPECS, "tip", forest(t))
    return tree_grid.tree_posterior_grid(models), models


def _tree_ctes(x, pairs, each):
    y = len(x)
    return [
        # trees cut to the tips in use: a root with one branch moves down
        "tp AS (SELECT DISTINCT n_regionkey AS tree, n_nationkey AS nation, s_suppkey AS tip, 1 + n_nationkey % 4 * 0.5::DOUBLE AS nl, 0.5::DOUBLE + s_suppkey % 7 * 0.25::DOUBLE AS sl"
        " FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem))",
        "cu AS (SELECT tree, nation, tip, CASE WHEN min(nation) OVER t = max(nation) OVER t THEN 0 ELSE nl END AS nl, CASE WHEN count(*) OVER t = 1 THEN 0 ELSE sl END AS sl FROM tp WINDOW t AS (PARTITION BY tree))",
        "br AS (SELECT nation, tip, coalesce(nl / nullif(max(nl + sl) OVER (PARTITION BY tree), 0), 0) AS nl, coalesce(sl / nullif(max(nl + sl) OVER (PARTITION BY tree), 0), 0) AS sl FROM cu)",
        "l AS (SELECT r.response, l_suppkey AS g, (l_linestatus = 'O')::INT AS o, (NOT coalesce(l_tax > 0.04, false))::INT AS t,"
        " CASE r.response WHEN 'quantity' THEN l_quantity ELSE l_discount * 100 END::DOUBLE AS v FROM lineitem, (VALUES ('quantity'), ('discount')) r(response))",
        "d AS (SELECT response, g, avg(v) OVER (PARTITION BY response) AS shift, "
        + ", ".join(f"({text})::DOUBLE AS x{i}" for i, text in enumerate(x.values())) + f", v - avg(v) OVER (PARTITION BY response) AS x{y} FROM l)",
        "gs AS (SELECT response, g, count(*) AS n, " + ", ".join(f"sum(x{i}) AS s{i}" for i in range(y + 1)) + " FROM d GROUP BY ALL)",
        "tt AS (SELECT response, count(*) AS nr, max(shift) AS shift, " + each("sum(x{i} * x{j}) AS t{i}_{j}") + " FROM d GROUP BY 1)",
        "tl AS (SELECT response, nation, lr, nl * exp(lr) AS b, n, sl * exp(lr) AS tb, " + ", ".join(f"s{i}" for i in range(y + 1)) + " FROM gs JOIN br ON g = tip, gr)",
        # tips below their branches, then nations below theirs
        "na AS (SELECT response, nation, lr, max(b) AS b, sum(n / (1 + n * tb)) AS w, sum(ln(1 + n * tb)) AS ldv, "
        + ", ".join(f"sum(s{i} / (1 + n * tb)) AS s{i}" for i in range(y + 1)) + ", " + each("sum(s{i} * s{j} / (1 + n * tb) / n - s{i} * s{j} / n) AS p{i}_{j}") + " FROM tl GROUP BY ALL)",
        "ss AS (SELECT response, lr, sum(ldv + ln(1 + b * w)) AS ldv, " + each("sum(p{i}_{j} - b / (1 + b * w) * s{i} * s{j}) AS p{i}_{j}") + " FROM na GROUP BY ALL)",
        "a AS (SELECT ss.response, lr, ldv, 0.0::DOUBLE AS sv, nr, shift, 0.0::DOUBLE AS ld, " + each("t{i}_{j} + p{i}_{j} AS a{i}_{j}, 0.0::DOUBLE AS d{i}_{j}") + " FROM ss JOIN tt USING (response))",
    ]


_TREE_GRID, _ = _grid_sql(
    {"(Intercept)": "1", "l_linestatusO": "o", "bandlow": "t", "l_linestatusO:bandlow": "o * t"},
    {"habit": (0, 1), "generation": (0, 2), "both": (0, 1, 2), "interaction": range(4), "null": (0,)}, _tree_ctes,
)


@query("t11d_tree_grid", _TREE_GRID + _MEANS.replace(", 6)", ", 5)"))
def _(t):
    # effects along trees; means and spreads of all effects and both variances
    return rounded(G.posterior_means(*tree_modelled(t)), "mean", "sd", digits=5)


@query("t11e_tree_scores")
def _(t):
    return tree_grid.tree_grid_dic(*tree_modelled(t))


def stored_draws(t):
    """A deterministic table shaped like draws: one parameter per supplier and status."""
    return t.lineitem.select(
        F.col("l_returnflag").alias("response"), F.col("l_linestatus").alias("spec"), F.lit(1).alias("chain"), F.col("l_orderkey").alias("iter"),
        F.col("l_linenumber").cast("string").alias("param"), (F.col("l_extendedprice") - 20000).alias("value"),
    )


@query("t12_score_models", """
WITH c AS (SELECT o_orderstatus AS response, o_orderpriority AS spec, 2 * avg(o_totalprice) - max(o_totalprice) AS dic FROM orders GROUP BY ALL)
SELECT response, spec, round(dic, 4) AS dic, round(dic - min(dic) OVER (PARTITION BY response), 4) AS delta_dic FROM c""")
def _(t):
    base = t.orders.select(F.col("o_orderstatus").alias("response"), F.col("o_orderpriority").alias("spec"), F.lit(1).alias("chain"), F.col("o_totalprice").alias("value"))
    top = base.groupBy("response", "spec", "chain").agg(F.max("value").alias("value")).withColumn("param", F.lit("deviance_at_mean"))
    scored = X.score_dic(base.withColumn("param", F.lit("deviance")).unionByName(top))
    return rounded(scored, "dic", "delta_dic", digits=4)


@query("t13_hpd_interval", """
WITH d AS (SELECT l_returnflag AS response, l_linestatus AS spec, CAST(l_linenumber AS VARCHAR) AS param, l_extendedprice - 20000 AS value FROM lineitem),
 r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY response, spec, param) AS n FROM d WINDOW w AS (PARTITION BY response, spec, param ORDER BY value)),
 p AS (SELECT a.response, a.spec, a.param, a.value AS lower, b.value AS upper, row_number() OVER (PARTITION BY a.response, a.spec, a.param ORDER BY b.value - a.value, a.rn) AS pick
  FROM r a JOIN r b ON a.response = b.response AND a.spec = b.spec AND a.param = b.param AND b.rn = a.rn + greatest(1, least(a.n - 1, CAST(round_even(a.n * 0.95, 0) AS BIGINT))))
SELECT response, spec, param, round(lower, 4) AS lower, round(upper, 4) AS upper FROM p WHERE pick = 1""")
def _(t):
    return rounded(X.hpd_interval(stored_draws(t), ["response", "spec", "param"]), "lower", "upper", digits=4)


@query("t13b_effective_size")
def _(t):
    draws = t.events.select(F.col("event_type").alias("param"), F.lit(1).alias("chain"), F.col("event_id").alias("iter"), "value")
    return X.effective_size(draws, ["param"])
