"""Registered queries of the subpackage; each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import best_fit_lp, chosen_path, jaccard_join, lang_id, max_score, mixing, packed_rows, pu_toxicity, robust_outliers, site_templates, surrogates, turn_repair, turn_trie
from spanloom.llm.sql import SQL
from spanloom.session import tune

QUERIES = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(lambda name: tune(spark).read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[fn.__name__] = run
    return fn


def fold(parts: int):
    """A row without an id is in no fold that is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts, F.lit(-1))


@query
def op1_site_templates(table):
    return site_templates.extract(table("pages"))


@query
def op2_surrogates(table):
    return surrogates.replace_entities(table("documents")).select("doc_id", "text", "n_entities")


@query
def op3_max_score(table):
    vectors = table("embeddings")
    return max_score.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query
def op4_packed_rows(table):
    return packed_rows.pack_rows(table("documents"))


@query
def op5_curriculum(table):
    found = mixing.mixture(table("documents"))
    return found.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).alias("taken"), F.get("__places", F.lit(0)).alias("position"),
    )


@query
def op6_pu_toxicity(table):
    docs, held_out = table("documents"), fold(3) == 1
    model = pu_toxicity.learn(docs, table("labels"), ~held_out)
    found = pu_toxicity.score(docs, model, [F.col("doc_id"), held_out.alias("held_out")])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= pu_toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op7_best_fit_lp(table):
    return best_fit_lp.pack(table("documents"))


@query
def op8_robust_outliers(table):
    found = robust_outliers.judge(table("documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_jaccard_join(table):
    return jaccard_join.jaccard_components(table("documents"))


@query
def op10_kneser_ney(table):
    docs, held_out = table("documents"), fold(4) == 2
    models = lang_id.fit(docs, ~held_out)
    return lang_id.identify(docs, models, [F.col("doc_id"), held_out.alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score")


@query
def op11_turn_trie(table):
    turns = turn_trie.numbered_turns(table("conversations"))
    ids = table("conversations").select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id is not null").distinct()
    return turn_trie.prefix_trie(turn_trie.borrowed_starts(turns), ids)


@query
def op12_chosen_path(table):
    return chosen_path.similar_components(table("documents"))


@query
def op13_turn_repair(table):
    turns = table("conversations")
    ids = turns.select("conv_id").distinct()
    return turn_repair.whole_report(ids, turn_repair.damage(turns, F.col("conv_id"), F.col("turn")))


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
