"""X: text operators over documents."""

from pyspark.sql import functions as F

from spanloom.operators import text as X
from spanloom.plans.registry import query

_TOKENS = r"""
WITH tok AS (SELECT unnest(regexp_split_to_array(text, '[ ;\n]')) AS token FROM documents),
 a AS (SELECT regexp_replace(token, '[\[\](){},]|\.$', '', 'g') AS token FROM tok WHERE contains(token, '@')),
 cited AS (SELECT DISTINCT regexp_replace(token, '^-?[^@]*@', '') AS token FROM a WHERE regexp_matches(token, '^-?[^@]*@'))"""


def cited(t):
    return X.extract_tokens(t.documents, "text", r"[ ;\n]", "@", r"[\[\](){},]|\.$", "^-?[^@]*@")


@query("x01_extract_tokens", _TOKENS + " SELECT token FROM cited")
def _(t):
    return cited(t)


def library(t):
    kind = F.when(F.col("source") == "src0", "Online").when(F.col("lang") == "en", "Article").otherwise("Book")
    return t.documents.select("doc_id", "lang", "source", "n_chars", kind.alias("kind"), F.concat(F.lit("u"), "doc_id").alias("url"))


_LIB = """
WITH lib AS (SELECT doc_id, lang, source, n_chars, CASE WHEN source = 'src0' THEN 'Online' WHEN lang = 'en' THEN 'Article' ELSE 'Book' END AS kind, 'u' || doc_id AS url FROM documents)"""


@query("x02_missing_keys", _LIB + " SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM lib WHERE kind = 'Article')")
def _(t):
    return X.missing_keys(t.labels.select("doc_id"), library(t).where("kind = 'Article'"), "doc_id")


@query("x03_restrict_library", _LIB + " SELECT doc_id, kind, CASE WHEN kind <> 'Article' THEN url END AS url, n_chars FROM lib WHERE doc_id IN (SELECT doc_id FROM labels) AND kind <> 'Online'")
def _(t):
    return X.restrict_library(library(t), t.labels, "doc_id", "kind", "Online", {"url": "Article"}, ["doc_id", "kind", "url", "n_chars"])


@query("x04_rewrite_lines", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), 'tion', 't.', 'g'), '([aeiou])n', '<\1>n', 'g')) AS digest FROM documents""")
def _(t):
    rules = [("[0-9]+", "#"), ("tion", "t."), ("([aeiou])n", "<$1>n")]
    done = X.rewrite_lines(t.documents, "text", rules)
    return done.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("x05_matching_lines", r"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT DISTINCT line FROM l WHERE regexp_matches(line, '(?:^[A-Z][a-z]+\.$)|(?:license|License)')""")
def _(t):
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line"))
    return X.matching_lines(lines, "line", [r"^[A-Z][a-z]+\.$", "license|License"])
