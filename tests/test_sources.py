"""Sources and sinks on small files."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from spanloom.operators import text as X
from spanloom.sinks import files as K
from spanloom.sources import lines as L
from spanloom.sources import logs as G
from spanloom.sources import tables as T
from spanloom.sources.trees import read_trees


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(1, 501)))
    (tmp_path / "b c.txt").write_text("x\ny\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        df = L.read_lines(spark, str(tmp_path)).withColumn("name", L.base_name()).cache()
        got = df.where("name = 'a.txt'").collect()
        assert len(got) == 500 and all(r.line == f"line {r.line_no}" for r in got)
        assert {r.name for r in df.select("name").distinct().collect()} == {"a.txt", "b c.txt"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_typed_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v,s\n1,2.5,a\nNA,#VALUE!,\n")
    df = T.read_csv_typed(spark, str(tmp_path), "k int, v double, s string", ("", "NA", "#VALUE!"), file_column="f")
    assert sorted(map(tuple, df.collect()), key=str) == sorted([(1, 2.5, "a", "t.csv"), (None, None, None, "t.csv")], key=str)
    with pytest.raises(Exception):
        T.read_csv_typed(spark, str(tmp_path), "k int, v double, s string").collect()
    sheet = T.read_sheet(spark, str(tmp_path), {1: "first", 3: "third"}, skip=1)
    assert {(r.first, r.third) for r in sheet.collect()} == {("1", "a"), (None, None)}


LOG = """2013-07-01;08:00:00;SLCS;Light Curve start;plant 1
2013-07-01;08:00:10;F;1;0;0;100;200;50;0.5;11.5;a;b
2013-07-01;08:00:20;FO;2;0;0;120;100;60;-;12
2013-07-01;08:01:00;SLCE;Light Curve end;
2013-07-01;09:00:00;F;3;0;0;1;2;50;0.5;11.5
2013-07-01;10:00:00;SLCS;Light Curve start;
2013-07-01;10:00:05;F;4;0;0;5;10;70;0.5;3
2013-07-01;10:01:00;SLCE;Light Curve end;
2013-07-01;11:00:00;C;noise
"""


def test_record_log(spark, tmp_path):
    (tmp_path / "x.pam").write_text(LOG)
    (tmp_path / "skip.txt").write_text("nothing")
    lines = G.read_record_log(spark, str(tmp_path), glob="*.pam")
    got = {int(r.no): r.id for r in G.response_curves(lines).collect()}
    assert got == {1: "plant 1", 2: "plant 1", 3: None, 4: "2"}
    fl = {int(r.no): (r["yield"], r.yield_error) for r in G.fluorescence(lines, recalculate=True).collect()}
    assert fl[1] == (0.5, False) and fl[2] == (0.0, True)
    drop = lines.where("line_no = 2").select("file", "line_no")
    assert G.read_record_log(spark, str(tmp_path), drop, "*.pam").count() == 8


def test_logger_layouts(spark, tmp_path):
    (tmp_path / "old.csv").write_text('"Plot Title: a"\n"#","Date","Time","Temp, (S/N: 123)","RH"\n' + "1,2013-07-01,08:00:00,21.5,80.1\n2,2013-07-01,08:10:00,,81\n")
    (tmp_path / "new.csv").write_text('"#","Date Time, GMT-10:00","Temp, °C (LGR S/N: 456)","RH, %"\n1,07/02/2013 08:00:00,20.5,70\n')
    got = sorted((r.serial_no, str(r.date_time), r.temp, r.rh) for r in G.read_logger(spark, str(tmp_path)).collect())
    assert got == [("123", "2013-07-01 08:00:00", 21.5, 80.1), ("456", "2013-07-02 08:00:00", 20.5, 70.0)]


def test_sessions_that_touch(spark):
    marks = ["08:00:00;SLCS;Light Curve start;", "08:01:00;SLCE;Light Curve end;", "08:01:00;SLCS;Light Curve start;plant B", "08:02:00;SLCE;Light Curve end;"]
    lines = spark.createDataFrame([("f", i + 1, f"2013-07-01;{m}") for i, m in enumerate(marks)], "file string, line_no long, line string")
    assert sorted(r.id for r in G.sessions(lines).collect()) == ["1", "plant B"]


def test_title_only_in_the_first_line(spark):
    text = ['"Plot Title: x"', '"Date Time, GMT","Temp, C","RH, %"', '07/02/2013 08:00:00,20.5,70,"Plot Title noted"']
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(text)], "file string, line_no long, line string")
    assert [(r.temp, r.rh) for r in G.parse_logger_lines(lines).collect()] == [(20.5, 70.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "k int, v string")
    out = str(tmp_path / "doc")
    K.write_csv_with_header(df, out, {"ms": ["# one", "# two"], "pre": ["# one"]}, "ms", ["k"])
    lines = [r.value for r in spark.read.text(out).coalesce(1).collect()]
    assert sorted(lines) == sorted(["# one", "# two", "k,v", "1,x", "2,NA"])
    ordered = [r.value for r in K.csv_with_header(df, ["# one"], ["k"]).collect()]
    assert ordered == ["# one", "k,v", "1,x", "2,NA"]
    with pytest.raises(ValueError):
        K.write_csv_with_header(df, out + "2", {"ms": []}, "other", ["k"])
    K.write_csv(df, str(tmp_path / "csv"))
    back = T.read_csv_typed(spark, str(tmp_path / "csv"), "k int, v string")
    assert sorted(map(tuple, back.collect())) == [(1, "x"), (2, None)]
    assert L.manifest(spark, str(tmp_path / "csv"), "*.csv").where(F.length("md5") == 32).count() >= 1


def test_manifest_reads_large_files_line_by_line(spark, tmp_path):
    noise = bytes((i * i * 31 + i // 7) % 256 for i in range(200_000))
    mark = b"\xef\xbb\xbf"
    texts = {
        "a.bin": noise, "b.bin": noise + b"\n", "c.bin": b"\n" * 50_000, "d.bin": b"no line feed" * 9_000, "e.csv": mark + b"a,b\r\n" * 9_000, "f.csv": mark + b"x\n" * 9_000 + b"y",
        "g.csv.gz": gzip.compress(noise, mtime=0), "h i%20j.csv": b"\xff\xfe\x00" * 9_000, "k": noise[:50_000], "l.parquet": b"PAR1" + noise, "n.csv": mark, "o.bin": mark + b"\n" + mark * 9_000,
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    for whole in (0, 20_000, 1 << 20):
        files = L.manifest(spark, str(tmp_path), whole=whole)
        assert files.dtypes == [("file", "string"), ("bytes", "bigint"), ("md5", "string")]
        rows = files.collect()
        assert len(rows) == len(texts)
        assert {r.file.rsplit("/", 1)[1]: (r.bytes, r.md5) for r in rows} == {n: (len(x), hashlib.md5(x).hexdigest()) for n, x in texts.items()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    some = L.manifest(spark, str(tmp_path), "*.bin", whole=20_000)
    assert some.count() == 5 and "MapInArrow" in some._jdf.queryExecution().toString()  # in pieces


def test_trees_and_text(spark, tmp_path):
    (tmp_path / "t.tre").write_text("((A:1,B:1)90:1,C:2);\n\n(D:1,E:2);\n")
    assert read_trees(spark, str(tmp_path)).groupBy("tree_id").count().count() == 2
    docs = spark.createDataFrame([("see [@smith2001; -@lee_2] and mail a@b, (@smith2001).",)], "t string")
    tokens = X.extract_tokens(docs, "t", "[ ;]", "@", r"\[|\]|\)|\(|\.$|,|\{|\}", "^-?@")
    assert {r.token for r in tokens.collect()} == {"smith2001", "lee_2"}
    library = spark.createDataFrame([("smith2001",)], "token string")
    with pytest.raises(Exception, match="lee_2"):
        X.missing_keys(tokens, library, "token", strict=True)
