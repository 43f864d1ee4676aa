"""F: scalar functions."""

from pyspark.sql import functions as F

from spanloom.functions import scalar as S
from spanloom.plans.registry import query


@query("f01_detect", """
SELECT page_id, regexp_matches(url, 'example\\.(com|org)') AS hit, NOT regexp_matches(lower(url), 'ref=') AS no_ref FROM pages""")
def _(t):
    return t.pages.select(
        "page_id", S.detect("url", r"example\.(com|org)").alias("hit"), S.detect("url", "REF=", True, negate=True).alias("no_ref")
    )


@query("f02_replace_chain", """
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', '', 'g'), '[?#].*$', '', 'g'), '/+', '|', 'g') AS short FROM pages""")
def _(t):
    rules = [("^https?://", ""), ("[?#].*$", ""), ("/+", "|")]
    return t.pages.select("page_id", S.replace_all("url", rules).alias("short"))


@query("f03_capture_group", """
SELECT page_id, CASE WHEN regexp_matches(url, 'page=([0-9]+)') THEN regexp_extract(url, 'page=([0-9]+)', 1) END AS page FROM pages""")
def _(t):
    return t.pages.select("page_id", S.capture("url", "page=([0-9]+)").alias("page"))


@query("f04_split_take_nth", """
SELECT page_id, NULLIF(split_part(url, '/', 3), '') AS host, CASE WHEN len(string_split(url, '/')) >= 5 THEN split_part(url, '/', 5) END AS fifth FROM pages""")
def _(t):
    return t.pages.select("page_id", S.piece("url", "/", 3).alias("host"), S.piece("url", "/", 5).alias("fifth"))


@query("f05_trim_and_case", """
SELECT p_partkey, lower(p_brand) AS low, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS sentence, trim('  ' || p_name || ' ') AS trimmed FROM part""")
def _(t):
    return t.part.select(
        "p_partkey",
        F.lower("p_brand").alias("low"),
        S.sentence_case("p_type").alias("sentence"),
        F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"),
    )


@query("f06_left_pad", """
SELECT o_orderkey, lpad(CAST(extract(month FROM o_orderdate) AS VARCHAR), 2, '0') AS month FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", F.lpad(F.month("o_orderdate").cast("string"), 2, "0").alias("month"))


@query("f07_substring_length", """
SELECT c_custkey, substr(c_name, 10) AS digits, CAST(length(c_name) AS BIGINT) AS n FROM customer""")
def _(t):
    return t.customer.select("c_custkey", F.substr("c_name", F.lit(10)).alias("digits"), F.length("c_name").cast("long").alias("n"))


@query("f08_paste", """
WITH d AS (SELECT l_orderkey, l_linenumber, NULLIF(l_returnflag, 'N') AS a, NULLIF(l_linestatus, 'O') AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, NULLIF(concat_ws(' ', a, b), '') AS present, coalesce(a, 'NA') || '-' || coalesce(b, 'NA') AS plain FROM d""")
def _(t):
    a, b = F.nullif("l_returnflag", F.lit("N")), F.nullif("l_linestatus", F.lit("O"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", S.paste_present(a, b).alias("present"), S.paste(a, b, sep="-").alias("plain")
    )


@query("f09_parse_number", """
SELECT event_id, TRY_CAST(NULLIF(regexp_extract(replace(props, ',', ''), '-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)'), '') AS DOUBLE) AS k FROM events""")
def _(t):
    return t.events.select("event_id", S.parse_number("props").alias("k"))


@query("f10_abbreviate", """
SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN left(p_name, 1) || '_' || split_part(p_name, ' ', 2) END AS short,
  CASE WHEN contains(p_name, ' ') THEN '*' || left(p_name, 1) || '. ' || split_part(p_name, ' ', 2) || '*' END AS pretty FROM part""")
def _(t):
    return t.part.select("p_partkey", S.abbreviate("p_name").alias("short"), S.abbreviate("p_name", "*%s. %s*").alias("pretty"))


@query("f11_parse_datetime", """
SELECT o_orderkey, o_orderdate AS parsed FROM orders""")
def _(t):
    iso, us = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.date_format("o_orderdate", "MM/dd/yyyy HH:mm:ss")
    text = F.when(F.col("o_orderstatus") == "F", iso).otherwise(us)
    parsed = S.parse_time(text, "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss")
    return t.orders.select("o_orderkey", parsed.cast("timestamp_ntz").alias("parsed"))


@query("f12_date_parts", """
SELECT event_id, CAST(ts AS DATE) AS day, CAST(extract(year FROM ts) AS INTEGER) AS y, CAST(extract(month FROM ts) AS INTEGER) AS m,
  CAST(extract(day FROM ts) AS INTEGER) AS d, CAST(extract(doy FROM ts) AS INTEGER) AS doy FROM events""")
def _(t):
    return t.events.select(
        "event_id", F.to_date("ts").alias("day"), F.year("ts").alias("y"), F.month("ts").alias("m"),
        F.dayofmonth("ts").alias("d"), F.dayofyear("ts").alias("doy"),
    )


@query("f13_time_difference", """
SELECT l_orderkey, l_linenumber, round(date_diff('microsecond', o_orderdate, l_shipdate) / 86400000000.0, 6) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE date_diff('microsecond', o_orderdate, l_shipdate) / 86400000000.0 >= 3""")
def _(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = S.days_between("o_orderdate", "l_shipdate")
    return joined.where(days >= 3).select("l_orderkey", "l_linenumber", F.round(days, 6).alias("days"))


@query("f14_math", """
SELECT l_orderkey, l_linenumber, round(l_tax / NULLIF(l_discount, 0), 6) AS ratio, round(abs(l_tax - l_discount), 6) AS gap, round(ln(l_extendedprice), 6) AS lg,
  round(1 - exp(-0.04 * l_quantity), 6) AS sat, greatest(l_tax, l_discount) AS top FROM lineitem""")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(S.ratio("l_tax", "l_discount"), 6).alias("ratio"),
        F.round(F.abs(F.col("l_tax") - F.col("l_discount")), 6).alias("gap"), F.round(F.log("l_extendedprice"), 6).alias("lg"),
        F.round(1 - F.exp(-0.04 * F.col("l_quantity")), 6).alias("sat"), F.greatest("l_tax", "l_discount").alias("top"),
    )


@query("f15_number_text", """
SELECT l_orderkey, l_linenumber, printf('%.3f', round(l_extendedprice, 3)) AS fixed, printf('%.0f', round(l_tax * 100, 0)) || '%' AS pct,
  CASE WHEN l_discount < 0.001 THEN '< 0.001' ELSE printf('%.3f', round(l_discount, 3)) END AS p FROM lineitem""")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", S.fixed("l_extendedprice", 3).alias("fixed"), S.percent_text("l_tax").alias("pct"),
        S.p_text("l_discount").alias("p"),
    )


@query("f16_significance_bands", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount / 2 < 0.001 THEN '***' WHEN l_discount / 2 < 0.01 THEN '**' WHEN l_discount / 2 < 0.05 THEN '*' ELSE '' END AS stars FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.stars(F.col("l_discount") / 2).alias("stars"))


@query("f17_word_list", """
WITH g AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS w FROM part WHERE p_size > 40 GROUP BY 1)
SELECT p_brand, CASE len(w) WHEN 1 THEN w[1] WHEN 2 THEN w[1] || ' and ' || w[2]
  ELSE array_to_string(w[1:len(w) - 1], ', ') || ', and ' || w[len(w)] END AS words FROM g""")
def _(t):
    kinds = F.array_sort(F.collect_set("p_type"))
    return t.part.where("p_size > 40").groupBy("p_brand").agg(S.word_list(kinds).alias("words"))


@query("f18_missing_values", """
SELECT o_orderkey, coalesce(NULLIF(o_orderstatus, 'P'), 'none') AS status, CASE WHEN o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') THEN o_orderpriority END AS priority FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("none")).alias("status"),
        S.as_missing("o_orderpriority", "5-LOW", "4-NOT SPECIFIED").alias("priority"),
    )


@query("f19_casts", """
SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_text, TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand_no, TRY_CAST(p_name AS DOUBLE) AS not_a_number FROM part""")
def _(t):
    return t.part.select(
        "p_partkey", F.col("p_size").cast("string").alias("size_text"),
        S.piece("p_brand", "#", 2).try_cast("int").alias("brand_no"), F.col("p_name").try_cast("double").alias("not_a_number"),
    )


@query("f20_dms_to_degrees", """
WITH d AS (SELECT o_orderkey, printf('%02d%02d%02d', 10 + extract(day FROM o_orderdate), extract(month FROM o_orderdate), extract(year FROM o_orderdate) % 60) AS a FROM orders)
SELECT o_orderkey, round(-(CAST(substr(a, 1, 2) AS DOUBLE) + CAST(substr(a, 3, 2) AS DOUBLE) / 60 + CAST(substr(a, 5, 2) AS DOUBLE) / 3600), 6) AS lat,
  round(CAST(substr(a, 1, 2) AS DOUBLE) + CAST(substr(a, 3, 2) || '.25' AS DOUBLE) / 60, 6) AS lon FROM d""")
def _(t):
    day, month, year = F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate")
    digits = F.format_string("%02d%02d%02d", day + 10, month, year % 60)
    lat = S.dms_to_degrees(digits, 2, "S")
    lon = S.dms_to_degrees(F.concat(F.substring(digits, 1, 4), F.lit(".25")), 2, "E")
    return t.orders.select("o_orderkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("f21_recode", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS status FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", S.recode("o_orderstatus", {"F": "filled", "O": "open"}).alias("status"))
