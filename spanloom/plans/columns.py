"""P: projections, filters, predicates."""

from pyspark.sql import functions as F

from spanloom.functions import scalar as S
from spanloom.operators import columns as C
from spanloom.operators import joins as J
from spanloom.plans.registry import query


@query("p01_select_rename", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total FROM orders""")
def _(t):
    return t.orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("total")
    )


@query("p02_select_by_pattern", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linestatus FROM lineitem""")
def _(t):
    li = t.lineitem
    return li.select(*C.names_matching(li, "key$|^l_line"))


@query("p03_select_range", """
SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""")
def _(t):
    li = t.lineitem
    return li.select(*C.names_between(li, "l_quantity", "l_tax"))


@query("p04_transmute", """
SELECT l_orderkey AS id, round(l_extendedprice * (1 - l_discount), 6) AS net,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross FROM lineitem""")
def _(t):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"), F.round(net, 6).alias("net"), F.round(net * (1 + F.col("l_tax")), 6).alias("gross")
    )


@query("p05_rename_by_rules", """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_extendedprice AS price, l_discount AS reduction FROM lineitem""")
def _(t):
    rules = [(["order", "key$"], "order_id"), (["line", "number"], "line_no"), (["price"], "price"), (["disc"], "reduction")]
    return C.rename_by_rules(t.lineitem, rules).select("order_id", "line_no", "price", "reduction")


@query("p06_rename_by_function", """
SELECT p_partkey AS partkey_src, p_name AS name_src, p_brand AS brand_src, p_type AS type_src,
       p_size AS size_src, p_retailprice AS retailprice_src FROM part""")
def _(t):
    return C.rename_with(t.part, lambda c: c.removeprefix("p_") + "_src")


@query("p07_mutate_across", """
SELECT l_orderkey, l_linenumber, round(l_quantity * 1000, 6) AS l_quantity, round(l_extendedprice * 1000, 6) AS l_extendedprice,
       round(l_discount * 1000, 6) AS l_discount, round(l_tax * 1000, 6) AS l_tax FROM lineitem""")
def _(t):
    li = t.lineitem
    cols = C.columns_of_type(li, "double")
    return C.mutate_across(li, cols, lambda c: F.round(c * 1000, 6)).select("l_orderkey", "l_linenumber", *cols)


@query("p08_compare_and_time_bounds", """
SELECT event_id, user_id, ts, value FROM events
WHERE ts > TIMESTAMP '2024-01-05 01:00:00' AND ts < TIMESTAMP '2024-01-20 01:00:00' AND value > 0.4""")
def _(t):
    low, high = (F.lit(s).cast("timestamp_ntz") for s in ("2024-01-05 01:00:00", "2024-01-20 01:00:00"))
    kept = t.events.where((F.col("ts") > low) & (F.col("ts") < high) & (F.col("value") > 0.4))
    return kept.select("event_id", "user_id", "ts", "value")


@query("p09_any_measure_present", """
SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0) AS a, NULLIF(l_tax, 0) AS b FROM lineitem
WHERE coalesce(NULLIF(l_discount, 0), NULLIF(l_tax, 0)) IS NOT NULL""")
def _(t):
    zero = F.lit(0.0)
    li = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.nullif(F.col("l_discount"), zero).alias("a"), F.nullif(F.col("l_tax"), zero).alias("b")
    )
    return li.where(F.coalesce("a", "b").isNotNull())


@query("p10_literal_membership", """
SELECT p_partkey, p_size, p_brand FROM part WHERE p_size IN (3, 10, 11, 12, 13, 14, 15)""")
def _(t):
    return t.part.where(S.is_in("p_size", [3, *range(10, 16)])).select("p_partkey", "p_size", "p_brand")


@query("p11_regex_predicates", """
SELECT p_partkey, p_name FROM part
WHERE regexp_matches(lower(p_name), 'ring|bolt') AND NOT regexp_matches(lower(p_name), '^red')""")
def _(t):
    words = S.any_pattern(["RING", "bolt"])
    return t.part.where(S.detect("p_name", words, ignore_case=True) & S.detect("p_name", "^RED", True, negate=True)).select(
        "p_partkey", "p_name"
    )


@query("p12_negated_exclusions", """
WITH o AS (SELECT o_orderkey, o_totalprice, NULLIF(o_orderstatus, 'P') AS status FROM orders)
SELECT * FROM o WHERE NOT coalesce(status IN ('F') AND o_totalprice < 100000, false)""")
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return C.exclude(o, F.col("status").isin("F") & (F.col("o_totalprice") < 100000))


@query("p13_conditional_value", """
WITH o AS (SELECT o_orderkey, o_totalprice, NULLIF(o_orderstatus, 'P') AS status FROM orders)
SELECT o_orderkey, CASE WHEN status = 'F' THEN 'closed' WHEN o_totalprice > 200000 THEN 'large' ELSE 'rest' END AS class,
       CASE WHEN status IS NULL THEN NULL WHEN status = 'F' THEN 1 ELSE 0 END AS is_closed FROM o""")
def _(t):
    status = F.nullif("o_orderstatus", F.lit("P"))
    return t.orders.select(
        "o_orderkey",
        C.rule_value([(status == "F", "closed"), (F.col("o_totalprice") > 200000, "large")], "rest").alias("class"),
        C.if_else(status == "F", 1, 0).alias("is_closed"),
    )


@query("p14_rule_tagging", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'si'
  WHEN o_orderpriority = '5-LOW' THEN 'si' WHEN o_orderstatus = 'P' THEN 'hold' ELSE 'main' END AS section FROM orders""")
def _(t):
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")
    rules = [(urgent, "si"), (F.col("o_orderpriority") == "5-LOW", "si"), (F.col("o_orderstatus") == "P", "hold")]
    return C.tag_rules(t.orders, "section", rules, "main").select("o_orderkey", "section")


@query("p15_exclusion_flag", """
SELECT event_id, user_id, event_type, value FROM events
WHERE NOT coalesce(NULLIF(event_type, 'view') = 'error', false) AND NOT coalesce(event_type = 'click' AND value < 5, false)""")
def _(t):
    known = F.nullif("event_type", F.lit("view"))
    kept = C.exclude(t.events, known == "error", (F.col("event_type") == "click") & (F.col("value") < 5))
    return kept.select("event_id", "user_id", "event_type", "value")


@query("p16_clean_names", """
SELECT s_suppkey AS supplier_key, s_name AS supplier_name, s_acctbal AS balance_percent_1 FROM supplier""")
def _(t):
    messy = t.supplier.select(
        F.col("s_suppkey").alias("Supplier Key"), F.col("s_name").alias("supplierName"), F.col("s_acctbal").alias("Balance %(1)")
    )
    return C.clean_names(messy)


@query("p17_drop_empty", """
SELECT l_orderkey, l_tax FROM (SELECT NULLIF(l_orderkey, l_orderkey - l_linenumber + 1) AS l_orderkey, NULLIF(l_tax, 0) AS l_tax FROM lineitem)
WHERE l_orderkey IS NOT NULL OR l_tax IS NOT NULL""")
def _(t):
    first = F.col("l_orderkey") - F.col("l_linenumber") + 1
    li = t.lineitem.select(
        F.nullif(F.col("l_orderkey"), first).alias("l_orderkey"),
        F.nullif(F.col("l_returnflag"), F.col("l_returnflag")).alias("nothing"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"),
    )
    return C.drop_empty_rows(C.drop_empty_columns(li))


@query("p18_drop_incomplete_rows", """
SELECT * FROM (SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0) AS a, NULLIF(l_tax, 0) AS b FROM lineitem)
WHERE a IS NOT NULL AND b IS NOT NULL""")
def _(t):
    zero = F.lit(0.0)
    return C.drop_incomplete_rows(
        t.lineitem.select(
            "l_orderkey", "l_linenumber", F.nullif(F.col("l_discount"), zero).alias("a"), F.nullif(F.col("l_tax"), zero).alias("b")
        )
    )


@query("p19_fill_missing_ids", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS id FROM orders)
SELECT o_orderkey, coalesce(id, row_number() OVER (PARTITION BY id IS NULL ORDER BY o_orderkey)) AS id FROM o""")
def _(t):
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("id"))
    return C.fill_ids(o, "id", ["o_orderkey"])


@query("p20_unit_repair", """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'A' AND l_linestatus <> 'O' THEN l_quantity * 1000 ELSE l_quantity END, 6) AS quantity
FROM lineitem""")
def _(t):
    small = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") != "O")
    fixed = F.when(small, F.col("l_quantity") * 1000).otherwise(F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(fixed, 6).alias("quantity"))


@query("p21_source_precedence", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN NULLIF(l_tax, 0) WHEN l_returnflag = 'R' THEN NULLIF(l_discount, 0)
  ELSE coalesce(NULLIF(l_discount, 0), NULLIF(l_tax, 0)) END AS final FROM lineitem""")
def _(t):
    manual, device = F.nullif(F.col("l_tax"), F.lit(0.0)), F.nullif(F.col("l_discount"), F.lit(0.0))
    flag = F.col("l_returnflag")
    final = C.rule_value([(flag == "A", manual), (flag == "R", device)], F.coalesce(device, manual))
    return t.lineitem.select("l_orderkey", "l_linenumber", final.alias("final"))


@query("p22_row_combine", """
SELECT l_orderkey, l_linenumber, round(NULLIF(l_discount, 0) + l_tax, 6) AS total,
       NULLIF(concat_ws(' ', NULLIF(l_returnflag, 'N'), l_linestatus), '') AS notes FROM lineitem""")
def _(t):
    total = F.nullif(F.col("l_discount"), F.lit(0.0)) + F.col("l_tax")
    notes = S.paste_present(F.nullif("l_returnflag", F.lit("N")), "l_linestatus")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(total, 6).alias("total"), notes.alias("notes"))


@query("p23_override_by_key", """
SELECT c_custkey, c_nationkey, coalesce(n_name, c_mktsegment) AS c_mktsegment FROM customer
LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2) ON c_nationkey = n_nationkey""")
def _(t):
    table = t.nation.where("n_regionkey = 2")
    fixed = J.override(t.customer, table, [("c_nationkey", "n_nationkey")], "c_mktsegment", "n_name")
    return fixed.select("c_custkey", "c_nationkey", "c_mktsegment")


@query("p25_reorder_columns", """
SELECT c_mktsegment, c_name, c_custkey, c_acctbal FROM customer""")
def _(t):
    return t.customer.select("c_mktsegment", "c_name", "c_custkey", "c_acctbal")


@query("p24_index_to_column", """
SELECT row_number() OVER (ORDER BY c_name, c_custkey) AS "index", c_custkey, c_name FROM customer""")
def _(t):
    return C.index_to_column(t.customer.select("c_custkey", "c_name"), ["c_name", "c_custkey"])


@query("p24b_column_to_index", "SELECT c_name, c_acctbal FROM customer")
def _(t):
    return C.column_to_index(t.customer.select("c_custkey", "c_name", "c_acctbal"), "c_custkey")
