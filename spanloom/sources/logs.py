"""Instrument logs: logger exports and mixed-record logs.

Parsers take a table of numbered lines, so any number of files is one job;
there is no loop over files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.scalar import parse_number, parse_time
from spanloom.operators.columns import clean_names, drop_empty_columns
from spanloom.operators.joins import interval_join, join_null_safe
from spanloom.operators.measures import recompute_yield
from spanloom.operators.ranks import pair_events
from spanloom.sources.lines import read_lines

# Field order of fluorescence and curve records in a record log.
FLUORESCENCE = ("date", "time", "type", "no", "x1", "x2", "f", "fm", "par", "yield", "etr")
CURVE = ("date", "time", "type", "status", "comment")
# A comma with whole pairs of quotes behind it.
BETWEEN_CELLS = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
# Date layouts of logger exports.
ISO_TIME, US_TIME = "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss"


def parse_logger_lines(lines: DataFrame, title: str = "Plot Title", serial: str = r"(?i)s/?_?n[^0-9]*([0-9]+)") -> DataFrame:
    """Readings of logger exports: ``file, date_time, temp, rh, serial_no``.

    The first line of a file may be a title. Its header names the serial number and
    says whether date and time are one column (month first) or two (ISO).
    Rows without all of time, temperature and humidity are dropped.
    """
    body = lines.where((F.col("line_no") != 1) | ~F.contains("line", F.lit(title)))
    # The header is the first remaining line, by a map-side minimum per file.
    heads = body.groupBy("file").agg(F.min(F.struct("line_no", "line")).alias("__h")).select(
        "file",
        F.col("__h.line_no").alias("__head"),
        F.nullif(F.regexp_extract("__h.line", serial, 1), F.lit("")).alias("serial_no"),
        F.transform(F.split(F.lower("__h.line"), BETWEEN_CELLS, -1), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit("")))).alias("__names"),
    )

    def column(word: str):
        hits = F.filter("__names", lambda c: F.contains(c, F.lit(word)))
        return F.array_position("__names", F.get(hits, F.lit(0))).cast("int")

    heads = heads.select(
        "file", "__head", "serial_no", column("date").alias("__d"), column("temp").alias("__t"), column("rh").alias("__r"),
        F.array_position("__names", F.lit("time")).cast("int").alias("__c"),
    )
    rows = join_null_safe(body, heads, "file", null_safe=False).where(F.col("line_no") > F.col("__head"))
    cells = F.transform(F.split("line", BETWEEN_CELLS, -1), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))
    at = {n: F.when(F.col(n) > 0, F.try_element_at(cells, F.col(n))) for n in ("__d", "__t", "__r", "__c")}
    two = F.col("__c") > 0
    when = F.when(two, parse_time(F.concat_ws(" ", at["__d"], at["__c"]), ISO_TIME)).otherwise(
        parse_time(at["__d"], US_TIME, "MM/dd/yy hh:mm:ss a")
    )
    out = rows.select(
        "file", when.alias("date_time"), at["__t"].try_cast("double").alias("temp"), at["__r"].try_cast("double").alias("rh"), "serial_no"
    )
    return out.dropna(subset=["date_time", "temp", "rh"])


def read_logger(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    return parse_logger_lines(read_lines(spark, path, glob))


def read_logger_table(df: DataFrame, time: str, temp: str, rh: str) -> DataFrame:
    """Second layout: a plain table with messy names, empty columns and US dates."""
    tidy = drop_empty_columns(clean_names(df))
    return tidy.select(
        parse_time(time, US_TIME).alias("date_time"), F.col(temp).try_cast("double").alias("temp"), F.col(rh).try_cast("double").alias("rh")
    )


def _records(lines: DataFrame, kinds: Sequence[str], names: Sequence[str], delimiter: str) -> DataFrame:
    split = lines.withColumn("__f", F.transform(F.split("line", F.lit(delimiter)), lambda c: F.trim(c)))
    picked = split.where(F.try_element_at("__f", F.lit(3)).isin(*kinds))
    cols = [F.nullif(F.try_element_at("__f", F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)]
    out = picked.select("file", "line_no", *cols)
    return out.withColumn("date_time", parse_time(F.concat_ws(" ", "date", "time"), ISO_TIME)).drop("date", "time")


def fluorescence(lines: DataFrame, recalculate: bool = False, delimiter: str = ";") -> DataFrame:
    """Fluorescence records (``F``, ``FO``) of record logs."""
    fl = _records(lines, ("F", "FO"), FLUORESCENCE, delimiter).drop("x1", "x2")
    fl = fl.withColumns({c: parse_number(c) for c in ("no", "f", "fm", "par", "etr")})
    if recalculate:
        return recompute_yield(fl, "f", "fm", "yield")
    return fl.withColumn("yield", parse_number("yield"))


def sessions(lines: DataFrame, delimiter: str = ";") -> DataFrame:
    """Curve sessions: ``file, id, start, end, alternates``.

    Start and end records pair up in time order; the id is the comment of
    either record of the pair, or the pair number where there is none.
    """
    marks = _records(lines, ("SLCS", "SLCE"), CURVE, delimiter)
    marks = marks.withColumn("status", F.replace(F.col("status"), F.lit("Light Curve "), F.lit("")))
    pairs = pair_events(marks, ["file"], "date_time", "status", "start", "end", tie=["line_no"], carry=["comment"])
    name = F.coalesce("start_comment", "end_comment", F.col("pair_id").cast("string"))
    return pairs.select("file", name.alias("id"), "start", "end", "alternates")


def response_curves(lines: DataFrame, delimiter: str = ";") -> DataFrame:
    """Fluorescence records with the session they fall into."""
    spans = sessions(lines, delimiter).select("file", "id", "start", "end")
    joined = interval_join(fluorescence(lines, delimiter=delimiter), spans, "date_time", "start", "end", ["file"])
    return joined.select("file", "type", "no", "f", "fm", "par", "yield", "etr", "date_time", "id")


def read_record_log(
    spark: SparkSession, path: str | Sequence[str], excluded: DataFrame | None = None, glob: str | None = None
) -> DataFrame:
    """Numbered lines of record logs, listed lines dropped, ready for the parsers."""
    from spanloom.sources.lines import drop_lines

    lines = read_lines(spark, path, glob)
    return drop_lines(lines, excluded) if excluded is not None else lines
