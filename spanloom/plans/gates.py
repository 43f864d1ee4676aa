"""G: data-quality gates, as report rows over the driver tables."""

from pyspark.sql import functions as F

from spanloom.operators import expect as X
from spanloom.operators import ranks as W
from spanloom.operators.joins import anti
from spanloom.plans.registry import query


def orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.nullif("o_orderstatus", F.lit("P")).alias("status"))


_O = "WITH o AS (SELECT *, NULLIF(o_orderstatus, 'P') AS status FROM orders)"


def row(rule, column, failed, table="o"):
    return f"SELECT '{rule}' AS rule, '{column}' AS \"column\", count(*) AS n_rows, CAST({failed} AS BIGINT) AS n_failed, {failed} = 0 AS passed FROM {table}"


@query("g01_not_null", _O + row("not_null", "status", "count(*) FILTER (status IS NULL)") + " UNION ALL " + row("not_null", "o_custkey", "count(*) FILTER (o_custkey IS NULL)"))
def _(t):
    return X.report(orders(t), X.not_null("status", "o_custkey"))


@query("g02_in_set", _O + row("in_set", "status", "count(*) FILTER (NOT coalesce(status IN ('O'), false))") + " UNION ALL " + row("in_set", "o_orderpriority", "count(*) FILTER (NOT coalesce(o_orderpriority IN ('5-LOW', '2-HIGH'), true))"))
def _(t):
    return X.report(orders(t), [X.in_set("status", ["O"], allow_null=False), X.in_set("o_orderpriority", ["5-LOW", "2-HIGH"])])


@query("g03_unique", row("unique", "o_orderkey", "count(*) - count(DISTINCT o_orderkey)", "orders"))
def _(t):
    return X.report(t.orders, [X.unique("o_orderkey")])


@query("g04_within_bounds", row("within", "o_totalprice", "count(*) FILTER (NOT o_totalprice BETWEEN 2000 AND 490000)", "orders") + " UNION ALL " + row("has_type", "o_totalprice", "0", "(SELECT 1 FROM orders)"))
def _(t):
    return X.report(t.orders, [X.within("o_totalprice", 2000, 490000), X.has_type(t.orders, "o_totalprice", "double")])


@query("g05_row_predicate", row("holds", "price", "count(*) FILTER (NOT coalesce(NULLIF(l_tax, 0) > 0.01, false))", "lineitem"))
def _(t):
    return X.report(t.lineitem, [X.holds("price", F.nullif(F.col("l_tax"), F.lit(0.0)) > 0.01)])


@query("g06_composite_key", """
SELECT 'unique' AS rule, 'l_orderkey,l_linenumber' AS "column", CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_failed, sum(CASE WHEN n > 1 THEN n ELSE 0 END) = 0 AS passed
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)""")
def _(t):
    return X.report(t.lineitem, [X.unique("l_orderkey", "l_linenumber")])


@query("g07_row_count", """SELECT 'row_count' AS rule, '0' AS "column", count(*) AS n_rows, count(*) AS n_failed, count(*) = 0 AS passed FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def _(t):
    return X.report(anti(t.orders, t.customer, [("o_custkey", "c_custkey")]), [X.row_count(0)])


@query("g08_tolerance", row("holds", "tolerance", "count(*) FILTER (NOT coalesce(abs(l_tax - l_discount) <= 0.09, false))", "lineitem"))
def _(t):
    return X.report(t.lineitem, [X.holds("tolerance", F.abs(F.col("l_tax") - F.col("l_discount")) <= 0.09)])


@query("g09_alternation", """
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('signup', 'purchase')),
 p AS (SELECT user_id, (rn + 1) // 2 AS pair, count(*) = 2 AND bool_and(event_type = CASE WHEN rn % 2 = 1 THEN 'signup' ELSE 'purchase' END) AS ok FROM e GROUP BY ALL)
SELECT 'holds' AS rule, 'alternates' AS "column", count(*) AS n_rows, count(*) FILTER (NOT ok) AS n_failed, count(*) FILTER (NOT ok) = 0 AS passed FROM p""")
def _(t):
    pairs = W.pair_events(t.events, ["user_id"], "ts", "event_type", "signup", "purchase", tie=["event_id"])
    return X.report(pairs, [X.holds("alternates", F.col("alternates"))])


@query("g11_single_value", row("single_value", "o_orderstatus", "CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN 0 ELSE 1 END", "orders"))
def _(t):
    return X.report(t.orders, [X.single_value("o_orderstatus")])


_KEYS = "{0} AS rule, '{1}' AS \"column\", CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS n_failed, sum(CASE WHEN n > 1 THEN n ELSE 0 END) = 0 AS passed FROM (SELECT {1}, count(*) AS n FROM lineitem GROUP BY ALL)"


@query("g12_rules_in_one_scan", " UNION ALL ".join([
    row("within", "l_quantity", "count(*) FILTER (NOT l_quantity BETWEEN 1 AND 45)", "lineitem"),
    row("holds", "tolerance", "count(*) FILTER (NOT coalesce(abs(l_tax - l_discount) <= 0.09, false))", "lineitem"),
    row("single_value", "l_returnflag", "CASE WHEN count(DISTINCT l_returnflag) = 1 THEN 0 ELSE 1 END", "lineitem"),
    *["SELECT " + _KEYS.format("'unique'", k) for k in ("l_orderkey,l_linenumber", "l_orderkey", "l_partkey,l_suppkey,l_orderkey")],
]))
def _(t):
    rules = [
        X.within("l_quantity", 1, 45),
        X.holds("tolerance", F.abs(F.col("l_tax") - F.col("l_discount")) <= 0.09),
        X.single_value("l_returnflag"),
        X.unique("l_orderkey", "l_linenumber"),
        X.unique("l_orderkey"),
        X.unique("l_partkey", "l_suppkey", "l_orderkey"),
    ]
    return X.report(t.lineitem, rules)
