import corpus_pipeline
from pyspark.sql import functions as F

from spanloom.llm import plans
from tests.compare import DATA, compare, connect
from tests.llm.test_jaccard_join import plain_components


def test_queries_match_sql(spark):
    folder = f"{DATA}/sf0.001"
    con = connect(folder)
    for name, sql in plans.all_sql().items():
        status, _, _, note = compare(spark, con, folder, plans.QUERIES[name], sql)
        assert status == "ok", (name, note)


def test_stages_keep_columns_and_act(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    extra = spark.createDataFrame(
        [(9001, None, "en", "src0", 0), (9002, "", "en", None, 0), (9003, "Съешь ещё этих мягких французских булок да выпей чаю " * 8, None, "src1", 400),
         (9004, docs.first().text, "en", "src2", 10), (9004, docs.first().text, "en", "src2", 10)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    extra = extra.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])
    docs = docs.union(extra)
    steps = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, f"{DATA}/sf0.001")
        if i < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{i}")
        docs = steps[name] = spark.read.parquet(f"{tmp_path}/{i}")
    known = [(r.doc_id, r.text) for r in steps["language"].select("doc_id", "text").collect()]
    assert not {9001, 9002, 9003} & {i for i, _ in known} and len(known) >= 200
    roots = plain_components([k for k in known if k[0] != 9004])
    left = {r.doc_id for r in steps["near copies"].collect()}
    assert left == {i for i, (_, root) in roots.items() if i == root}
    assert steps["private data"].count() == steps["near copies"].count()
    assert steps["private data"].where("n_chars != length(text)").count() == 0
    mixed = {r.doc_id: r.n for r in steps["mixture"].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(mixed) <= left and max(mixed.values()) <= 3
    pieces = steps["packing"].where("piece = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == mixed


def test_empty_table_goes_through(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, f"{DATA}/sf0.001")
    assert docs.count() == 0
