"""S, K: sources and sinks on text that Spark writes from the driver tables.

The parsers work on line tables, so each query turns a whole table into log
lines, parses them back, and must return the table's own values.
"""

from pyspark.sql import functions as F

from spanloom.functions import scalar as S
from spanloom.operators import joins as J
from spanloom.operators import reshape as R
from spanloom.operators.columns import tag_rules
from spanloom.operators.formula import formula_columns, parse_formula
from spanloom.operators.mixed import design, factor_levels
from spanloom.operators.text import rewrite_lines
from spanloom.plans.aggregates import rounded
from spanloom.plans.registry import query
from spanloom.session import new_path
from spanloom.sinks.files import csv_with_header, write_csv, write_lines
from spanloom.sources import lines as L
from spanloom.sources import logs as G
from spanloom.sources import tables as T

DDL = "event_id long, ts timestamp, user_id long, event_type string, value double"


def csv_back(df, ddl):
    """Written as CSV files with missing-value tokens, read with a declared schema."""
    path = new_path(df.sparkSession, "csv")
    write_csv(df, path)
    return T.read_csv_typed(df.sparkSession, path, ddl)


@query("s01_typed_wide_csv", """
SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0) AS yield_pre, l_tax AS yield_24hr, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'si' WHEN l_returnflag = 'R' THEN 'si' ELSE 'main' END AS section FROM lineitem""")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("yield_pre"), F.col("l_tax").alias("yield_24hr"))
    back = csv_back(li, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, yield_pre double, yield_24hr double")
    flag = F.col("l_returnflag")
    tagged = tag_rules(back, "section", [((flag == "A") & (F.col("l_linestatus") == "F"), "si"), (flag == "R", "si")], "main")
    return tagged.select("l_orderkey", "l_linenumber", "yield_pre", "yield_24hr", "section")


@query("s02_sensor_csv", "SELECT event_id, ts, user_id, event_type, value FROM events")
def _(t):
    e = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type", "value")
    back = csv_back(e, DDL.replace("ts timestamp", "ts string"))
    return back.withColumn("ts", S.parse_time("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").cast("timestamp_ntz"))


@query("s06_event_bounds", """
SELECT o_custkey, max(o_orderdate) FILTER (event = 'start') AS pre, max(o_orderdate) FILTER (event = 'end') AS post FROM (
  SELECT o_custkey, 'start' AS event, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'end', max(o_orderdate) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) GROUP BY 1""")
def _(t):
    first = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("date_time")).withColumn("event", F.lit("start"))
    last = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("date_time")).withColumn("event", F.lit("end"))
    return T.event_bounds(first.unionByName(last), ["o_custkey"])


@query("s07_multi_key_event_bounds", """
SELECT kind, max(t) FILTER (e = 'start') AS pre, max(t) FILTER (e = 'end') AS post FROM (
  SELECT event_type AS kind, 'start' AS e, (SELECT min(ts) FROM events) AS t FROM events UNION ALL SELECT event_type, 'end', (SELECT max(ts) FROM events) FROM events) GROUP BY 1""")
def _(t):
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ", ")
    start = t.events.agg(kinds.alias("kind"), F.min("ts").alias("date_time")).withColumn("event", F.lit("start"))
    end = t.events.agg(kinds.alias("kind"), F.max("ts").alias("date_time")).withColumn("event", F.lit("end"))
    return T.event_bounds_multi(start.unionByName(end), "kind", [])


def logger_lines(t):
    """One logger file per user: title on odd users, ISO dates on even ones."""
    e = t.events.select("user_id", "event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "value", "event_type")
    odd = F.col("user_id") % 2 == 1
    rh = F.when(F.col("event_type") != "error", F.format_string("%.3f", F.col("value") / 2)).otherwise("")
    temp = F.format_string("%.2f", F.col("value"))
    iso = F.concat_ws(",", F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss"), temp, rh)
    us = F.concat_ws(",", F.col("event_id").cast("string"), F.date_format("ts", "MM/dd/yyyy HH:mm:ss"), temp, rh)
    body = e.select("user_id", (F.col("event_id") + 3).alias("line_no"), F.when(odd, us).otherwise(iso).alias("line"))
    users = e.select("user_id").distinct()
    mark = F.concat(F.lit(" (S/N: 10"), F.col("user_id").cast("string"), F.lit(")"))
    head_us = F.concat(F.lit('"#","Date Time, GMT-10:00","Temp, °C'), mark, F.lit('","RH, %"'))
    head_iso = F.concat(F.lit('"#","Date","Time","Temp'), mark, F.lit('","RH"'))
    head = users.select("user_id", F.lit(2).cast("long").alias("line_no"), F.when(odd, head_us).otherwise(head_iso).alias("line"))
    title = users.where(odd).select("user_id", F.lit(1).cast("long").alias("line_no"), F.lit('"Plot Title: run"').alias("line"))
    all_lines = body.unionByName(head).unionByName(title)
    return all_lines.withColumn("file", F.concat(F.lit("u"), F.col("user_id").cast("string"))).drop("user_id")


@query("s08_logger_export", """
SELECT 'u' || user_id AS file, date_trunc('second', ts) AS date_time, round(value, 2) AS temp, round(value / 2, 3) AS rh, '10' || user_id AS serial_no FROM events WHERE event_type <> 'error'""")
def _(t):
    out = G.parse_logger_lines(logger_lines(t))
    return out.withColumn("date_time", F.col("date_time").cast("timestamp_ntz"))


@query("s09_second_logger_layout", """SELECT date_trunc('second', ts) AS date_time, value AS temp, CASE WHEN event_type <> 'error' THEN value / 2 END AS rh FROM events""")
def _(t):
    messy = t.events.select(
        F.date_format("ts", "MM/dd/yyyy HH:mm:ss").alias("Time (MM/dd/yyyy HH:mm:ss)"), F.col("value").cast("string").alias("Chan 1 - Deg C"),
        F.when(F.col("event_type") != "error", (F.col("value") / 2).cast("string")).alias("Chan 2 - %RH"), F.nullif("event_type", F.col("event_type")).alias("Empty"),
    )
    out = G.read_logger_table(messy, "time_mm_dd_yyyy_hh_mm_ss", "chan_1_deg_c", "chan_2_percent_rh")
    return out.withColumn("date_time", F.col("date_time").cast("timestamp_ntz"))


def record_lines(t):
    """Mixed-record log per user: clicks are readings, signup/purchase open and close a session."""
    second = F.date_trunc("second", "ts")
    e = t.events.select("event_id", "user_id", "event_type", "value", F.date_format(second, "yyyy-MM-dd").alias("d"), F.date_format(second, "HH:mm:ss").alias("h"))
    kind = F.col("event_type")
    reading = F.concat_ws("; ", "d", "h", F.lit("F"), F.col("event_id").cast("string"), F.lit("0"), F.lit("0"), F.format_string("%.2f", F.col("value")),
                          F.format_string("%.2f", F.col("value") * 3), F.lit("50"), F.when(F.col("value") < 5, "-").otherwise("0.667"), F.lit("12.5"), F.lit("x"))
    begin = F.concat_ws("; ", "d", "h", F.lit("SLCS"), F.lit("Light Curve start"), F.concat(F.lit("spec_"), F.col("event_id").cast("string")))
    finish = F.concat_ws("; ", "d", "h", F.lit("SLCE"), F.lit("Light Curve end"), F.lit(""))
    line = F.when(kind == "click", reading).when(kind == "signup", begin).when(kind == "purchase", finish).otherwise(F.concat_ws("; ", "d", "h", F.lit("C"), F.lit("info")))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))


@query("s10_record_log_readings", """
SELECT 'u' || user_id AS file, CAST(event_id AS DOUBLE) AS no, CAST(printf('%.2f', value) AS DOUBLE) AS f, date_trunc('second', ts) AS date_time, value < 5 AS yield_error,
  round((CAST(printf('%.2f', value * 3) AS DOUBLE) - CAST(printf('%.2f', value) AS DOUBLE)) / NULLIF(CAST(printf('%.2f', value * 3) AS DOUBLE), 0), 6) AS yield FROM events WHERE event_type = 'click'""")
def _(t):
    out = G.fluorescence(record_lines(t), recalculate=True)
    out = out.withColumn("date_time", F.col("date_time").cast("timestamp_ntz"))
    return rounded(out, "yield").select("file", "no", "f", "date_time", "yield_error", "yield")


@query("s10b_record_log_sessions", """
WITH e AS (SELECT user_id, date_trunc('second', ts) AS ts, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts), event_id) AS rn FROM events WHERE event_type IN ('signup', 'purchase')),
 p AS (SELECT user_id, (rn + 1) // 2 AS pair, max(ts) FILTER (rn % 2 = 1) AS s, max(ts) FILTER (rn % 2 = 0) AS e, count(*) = 2 AND bool_and(event_type = CASE WHEN rn % 2 = 1 THEN 'signup' ELSE 'purchase' END) AS ok,
  max('spec_' || event_id) FILTER (event_type = 'signup' AND rn % 2 = 1) AS c1, max('spec_' || event_id) FILTER (event_type = 'signup' AND rn % 2 = 0) AS c2 FROM e GROUP BY ALL)
SELECT 'u' || user_id AS file, coalesce(c1, c2, CAST(pair AS VARCHAR)) AS id, s AS "start", e AS "end", ok AS alternates FROM p""")
def _(t):
    out = G.sessions(record_lines(t))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("s11_drop_listed_lines", "SELECT 'u' || user_id AS file, event_id AS line_no FROM events WHERE NOT (event_type = 'error' AND value > 20)")
def _(t):
    listed = t.events.where("event_type = 'error' and value > 20").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").alias("line_no"))
    return L.drop_lines(record_lines(t), listed).select("file", "line_no")


@query("s12_tag_rows_with_file", "SELECT 'u' || user_id || '.pam' AS file_name, count(*) AS n_lines FROM events GROUP BY 1")
def _(t):
    pathed = record_lines(t).withColumn("file", F.concat(F.lit("dir/sub/"), "file", F.lit(".pam")))
    return pathed.groupBy(L.base_name().alias("file_name")).agg(F.count(F.lit(1)).alias("n_lines"))


@query("s13_control_table_scan", """
SELECT 'u' || user_id AS file, event_id AS line_no, CASE WHEN user_id >= 100 THEN 'lc' ELSE 'fl' END AS ret_type FROM events JOIN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 60) USING (user_id)""")
def _(t):
    name = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file")
    control = t.events.groupBy("user_id").count().where("count > 60").select(name, F.when(F.col("user_id") >= 100, "lc").otherwise("fl").alias("ret_type"))
    return L.with_file_options(record_lines(t), control).select("file", "line_no", "ret_type")


@query("s14_positional_sheet", "SELECT p_partkey AS plot, p_brand AS individual, p_retailprice AS yield_1 FROM part")
def _(t):
    path = new_path(t.spark, "sheet")
    write_csv(t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), path)
    sheet = T.read_sheet(t.spark, path, {1: "plot", 3: "individual", 5: "yield_1"}, skip=1)
    return sheet.select(F.col("plot").cast("long").alias("plot"), "individual", F.col("yield_1").cast("double").alias("yield_1"))


@query("s15_missing_tokens", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS v FROM lineitem""")
def _(t):
    token = F.when(F.col("l_returnflag") == "A", "#VALUE!").when(F.col("l_returnflag") == "R", "NA").otherwise(F.col("l_quantity").cast("string"))
    texts = t.lineitem.select("l_orderkey", "l_linenumber", token.alias("v"))
    blank = T.blank_tokens(texts, ["", "NA", "#VALUE!"])
    return blank.withColumn("v", F.col("v").cast("double"))


@query("s18_line_scan", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents")
def _(t):
    path = new_path(t.spark, "lines")
    each = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    write_lines(each.select(F.concat_ws(" ", F.col("doc_id").cast("string"), "text").alias("line")), path)
    lines = L.read_lines(t.spark, path).where("line_no > 0")
    doc = F.regexp_extract("line", "^([0-9]+)", 1).cast("long").alias("doc_id")
    return lines.groupBy(doc).agg(F.count(F.lit(1)).alias("n_lines"))


_NAMES = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
          "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@query("s20_table_shapes", " UNION ALL ".join(
    f"SELECT '{n}' AS name, count(*) AS n_rows, {k} AS n_cols FROM {n}" for n, k in _NAMES.items()))
def _(t):
    return R.bind_rows(*[L.table_shape(getattr(t, n), n) for n in _NAMES])


@query("s21_upstream_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    t.orders.select("o_orderkey", "o_orderstatus").createOrReplaceTempView("stage_orders")
    return T.upstream(t.spark, "stage_orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("s20b_file_manifest")
def _(t):
    files = L.manifest(t.spark, t.folder, "*.parquet")
    return files.select(L.base_name().alias("file_name"), "bytes", "md5")


@query("k02_csv_with_header", """
SELECT '# Title: parts' AS value UNION ALL SELECT '# p_brand: maker' UNION ALL SELECT 'p_partkey,p_brand,label' UNION ALL SELECT p_partkey || ',' || p_brand || ',' || CASE WHEN p_size > 25 THEN p_type ELSE 'NA' END FROM part""")
def _(t):
    part = t.part.select("p_partkey", "p_brand", F.when(F.col("p_size") > 25, F.col("p_type")).alias("label"))
    return csv_with_header(part, ["# Title: parts", "# p_brand: maker"], ["p_partkey"])


@query("k01_csv_lines", "SELECT s_suppkey || ',' || s_name || ',' || CASE WHEN s_acctbal > 0 THEN 'credit' ELSE 'NA' END AS value FROM supplier")
def _(t):
    s = t.supplier.select("s_suppkey", "s_name", F.when(F.col("s_acctbal") > 0, "credit").alias("state"))
    path = new_path(t.spark, "csv")
    write_csv(s, path)
    return t.spark.read.text(path).where("value != 's_suppkey,s_name,state'")


@query("s03_curve_csv", "SELECT l_orderkey, l_linenumber, l_quantity AS par, NULLIF(l_discount, 0) AS etr, CAST(l_shipdate AS DATE) AS date, l_returnflag = 'A' AS outlier FROM lineitem")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("par"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("etr"), F.to_date("l_shipdate").alias("date"), (F.col("l_returnflag") == "A").alias("outlier"))
    return csv_back(li, "l_orderkey long, l_linenumber int, par double, etr double, date date, outlier boolean")


@query("s04_dimension_csv", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(t):
    return csv_back(t.supplier, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("s05_declared_schema_csv", "SELECT c_custkey, c_name, c_nationkey, NULLIF(c_mktsegment, 'BUILDING') AS segment FROM customer")
def _(t):
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return csv_back(c, "c_custkey long, c_name string, c_nationkey int, segment string")


@query("s16_header_map", "SELECT p_partkey AS plot, p_brand AS individual, p_retailprice AS yield_pre FROM part")
def _(t):
    names = t.spark.createDataFrame([(1, "plot"), (2, "individual"), (3, "yield_pre")], "pos int, new_header string")
    return T.apply_header_map(t.part.select("p_partkey", "p_brand", "p_retailprice"), names, "pos", "new_header")


@query("s17_inline_table", """
SELECT o_orderkey, bonus FROM orders LEFT JOIN (VALUES ('1-URGENT', 10), ('2-HIGH', 5)) v(p, bonus) ON o_orderpriority = p""")
def _(t):
    table = t.spark.createDataFrame([("1-URGENT", 10), ("2-HIGH", 5)], "p string, bonus int")
    return J.join_null_safe(t.orders, table, [("o_orderpriority", "p")]).select("o_orderkey", "bonus")


@query("k03_rewritten_lines", r"""SELECT page_id, replace(regexp_replace(url, '^http://', 'https://'), 'www.', '') AS line FROM pages""")
def _(t):
    done = rewrite_lines(t.pages.withColumnRenamed("url", "line"), "line", [("^http://", "https://"), (r"www\.", "")])
    path = new_path(t.spark, "text")
    write_lines(done.select(F.concat_ws(" ", F.col("page_id").cast("string"), "line").alias("line")), path)
    pair = F.split("value", " ", 2)
    return t.spark.read.text(path).select(F.get(pair, F.lit(0)).cast("long").alias("page_id"), F.get(pair, F.lit(1)).alias("line"))


@query("y07_design_matrix", """
SELECT c_custkey, 1.0::DOUBLE AS "(Intercept)", CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS "c_mktsegmentBUILDING", CAST(c_mktsegment = 'FURNITURE' AS DOUBLE) AS "c_mktsegmentFURNITURE",
  CAST(c_mktsegment = 'HOUSEHOLD' AS DOUBLE) AS "c_mktsegmentHOUSEHOLD", CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS "c_mktsegmentMACHINERY" FROM customer""")
def _(t):
    columns = design(factor_levels(t.customer, ["c_mktsegment"]), [("c_mktsegment",)])
    return t.customer.select("c_custkey", *[value.alias(name) for name, value in columns.items()])


FORMULAS = ("price ~ status", "price ~ priority", "price ~ status + priority", "price ~ status * priority", "price ~ 1", "price ~ status + status:priority")
# Terms of each formula in the twin: column name, whether the reference level of a factor is left out.
_COLUMNS = {
    "one": "SELECT '(Intercept)' AS term, * FROM o",
    "status": "SELECT 'status' || status AS term, * FROM o WHERE status > (SELECT min(status) FROM o)",
    "priority": "SELECT 'priority' || priority AS term, * FROM o WHERE priority > (SELECT min(priority) FROM o)",
    "both": "SELECT 'status' || status || ':priority' || priority AS term, * FROM o WHERE status > (SELECT min(status) FROM o) AND priority > (SELECT min(priority) FROM o)",
    "nested": "SELECT 'status' || status || ':priority' || priority AS term, * FROM o WHERE priority > (SELECT min(priority) FROM o)",
}
_USES = (("one", "status"), ("one", "priority"), ("one", "status", "priority"), ("one", "status", "priority", "both"), ("one",), ("one", "status", "nested"))


@query("y07b_formula_designs", "WITH o AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders) " + " UNION ALL ".join(
    f"SELECT '{text}' AS formula, term, CAST(count(*) AS DOUBLE) AS n, round(sum(price), 2) AS total FROM ({_COLUMNS[use]}) GROUP BY ALL"
    for text, uses in zip(FORMULAS, _USES) for use in uses))
def _(t):
    """Sums of every design column, and of its products with the response, in one pass over the orders."""
    o = t.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    levels = factor_levels(o, ["status", "priority"])
    designs = [(text, name, value, parse_formula(text)[0]) for text in FORMULAS for name, value in formula_columns(text, levels).items()]
    sums = [F.struct(F.lit(text).alias("formula"), F.lit(name).alias("term"), F.sum(v).alias("n"), F.sum(v * F.col(y)).alias("total")) for text, name, v, y in designs]
    return rounded(o.agg(F.array(*sums).alias("s")).select(F.inline("s")), "total", digits=2)
