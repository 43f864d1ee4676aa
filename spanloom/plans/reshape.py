"""R: reshaping."""

from pyspark.sql import functions as F

from spanloom.operators import joins as J
from spanloom.operators import ranks as W
from spanloom.operators import reshape as R
from spanloom.operators import summaries as A
from spanloom.plans.aggregates import _WEIGHTED, rounded
from spanloom.plans.registry import query

KEYS = ["l_orderkey", "l_linenumber", "l_shipdate"]
_LONG = """
SELECT l_orderkey, l_linenumber, l_shipdate, 'l_discount' AS var, NULLIF(l_discount, 0) AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_shipdate, 'l_tax', l_tax FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, l_shipdate, 'l_quantity', l_quantity FROM lineitem"""


@query("r01_wide_to_long", _LONG)
def _(t):
    li = t.lineitem.withColumn("l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
    return R.to_long(li, KEYS, "discount|tax|quantity", "var", "value")


@query("r02_matrix_to_long", """
WITH m AS (SELECT c_nationkey AS site, count(*) FILTER (c_mktsegment = 'MACHINERY') AS a, count(*) FILTER (c_mktsegment = 'FURNITURE') AS b FROM customer GROUP BY 1)
SELECT site, 'MACHINERY' AS taxon, a AS abundance FROM m UNION ALL SELECT site, 'FURNITURE', b FROM m""")
def _(t):
    counts = [F.count(F.when(F.col("c_mktsegment") == v, F.lit(1))).alias(v) for v in ("MACHINERY", "FURNITURE")]
    matrix = t.customer.groupBy(F.col("c_nationkey").alias("site")).agg(*counts)
    return R.to_long(matrix, ["site"], [c for c in matrix.columns if c != "site"], "taxon", "abundance")


@query("r03_long_to_wide", """
SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN q END) AS "A", max(CASE WHEN l_returnflag = 'N' THEN q END) AS "N",
  max(CASE WHEN l_returnflag = 'R' THEN q END) AS "R" FROM (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY 1""")
def _(t):
    cells = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return R.to_wide(cells, ["l_orderkey"], "l_returnflag", ["q"], ["A", "N", "R"], name="{level}")


@query("r04_long_to_wide_several", """
SELECT l_orderkey, max(q) FILTER (l_linestatus = 'F') AS "q_F", max(q) FILTER (l_linestatus = 'O') AS "q_O",
  max(d) FILTER (l_linestatus = 'F') AS "d_F", max(d) FILTER (l_linestatus = 'O') AS "d_O"
FROM (SELECT l_orderkey, l_linestatus, sum(l_quantity) AS q, max(l_shipdate) AS d FROM lineitem GROUP BY ALL) GROUP BY 1""")
def _(t):
    cells = t.lineitem.groupBy("l_orderkey", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.max("l_shipdate").alias("d"))
    return R.to_wide(cells, ["l_orderkey"], "l_linestatus", ["q", "d"], ["F", "O"])


@query("r05_conditional_aggregate", """
SELECT l_partkey, min(l_shipdate) FILTER (l_returnflag = 'A') AS a_first, max(l_shipdate) FILTER (l_returnflag = 'A') AS a_last,
  min(l_shipdate) FILTER (l_returnflag = 'R') AS r_first, max(l_shipdate) FILTER (l_returnflag = 'R') AS r_last FROM lineitem GROUP BY 1""")
def _(t):
    cols = []
    for flag in ("A", "R"):
        day = F.when(F.col("l_returnflag") == flag, F.col("l_shipdate"))
        cols += [F.min(day).alias(f"{flag.lower()}_first"), F.max(day).alias(f"{flag.lower()}_last")]
    return t.lineitem.groupBy("l_partkey").agg(*cols)


@query("r06_replicate_rows", _WEIGHTED)
def _(t):
    d = J.join_null_safe(t.lineitem, t.part, [("l_partkey", "p_partkey")], "inner").select(
        "p_brand", F.col("p_retailprice").alias("x"), F.col("l_quantity").alias("w")
    )
    return rounded(A.summarise(R.replicate(d, "w"), ["p_brand"], ["x"]), "x_mean", "x_sd")


@query("r07_nest_unnest", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem""")
def _(t):
    nested = R.nest(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_quantity"])
    return R.unnest(nested, "data").drop("part")


@query("r08_split_column", """
SELECT p_partkey, NULLIF(split_part(p_name, ' ', 1), '') AS first, NULLIF(split_part(p_name, ' ', 2), '') AS second, NULLIF(split_part(p_name, ' ', 3), '') AS third FROM part""")
def _(t):
    return R.split_column(t.part.select("p_partkey", "p_name"), "p_name", ["first", "second", "third"], " ")


@query("r09_unite_columns", """
SELECT p_partkey, p_brand || '_' || p_type || '_' || p_size AS label FROM part""")
def _(t):
    return R.unite(t.part.select("p_partkey", "p_brand", "p_type", "p_size"), "label", ["p_brand", "p_type", "p_size"])


@query("r10_split_cell_into_rows", """
SELECT user_id, trim(unnest(string_split(kinds, ','))) AS kind FROM (
  SELECT user_id, string_agg(DISTINCT event_type, ', ') AS kinds FROM events GROUP BY 1)""")
def _(t):
    kinds = F.array_join(F.collect_set("event_type"), ", ")
    return R.split_rows(t.events.groupBy("user_id").agg(kinds.alias("kind")), "kind", ",")
