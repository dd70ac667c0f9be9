"""The registered queries of this folder: each applies one operator, as in production, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statekit.llm import collocations, decontaminate, html_extract, jaccard_join, kneser_ney, language_id, packing, quality, secrets, suffix_dedup, toxicity, url_rules, whitening
from statekit.llm.common import fold as fold_of
from statekit.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


@query()
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, table(spark, sf_dir, "documents")).drop("kept")


@query()
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(spark, table(spark, sf_dir, "documents"), width=3, percent=90)


@query()
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(fold_of("doc_id"), F.lit(4))
    found = language_id.identify(spark, docs, language_id.learn(spark, docs.where(fold != 2)))
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.find_secrets(spark, docs, secrets.learn(spark, docs)).drop("found")


@query()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    return quality.judge(spark, table(spark, sf_dir, "documents"), trusted)


@query()
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(spark, table(spark, sf_dir, "pages"))


@query()
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark, table(spark, sf_dir, "pages"))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.pmod(fold_of("doc_id"), F.lit(3))
    model = toxicity.train(*toxicity.sample(docs, labels.where(fold != 1)))
    return toxicity.score(spark, docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", "predicted")


@query()
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(spark, vectors)
    error = whitening.identity_error(spark, vectors, model)
    rows = whitening.whiten(spark, vectors, model)
    return rows.withColumns({"deviation": F.expr("try_cast(deviation AS bigint)"), "identity_error": F.lit(error)})


@query("""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 100),
cut AS (
  SELECT c.lang, c.phrase, c.a, n, p.f AS l, q.f AS r, h,
    CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(p.f AS HUGEINT) * q.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS h FROM cand) c JOIN total USING (lang)
  JOIN f p ON p.lang = c.lang AND p.k = h AND p.phrase = array_to_string(w[1:h], ' ')
  JOIN f q ON q.lang = c.lang AND q.k = c.k - h AND q.phrase = array_to_string(w[h + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM cand))),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (
  SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000""")
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, table(spark, sf_dir, "documents"))


@query()
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(fold_of("doc_id"), F.lit(7))
    model = kneser_ney.fit(spark, docs.where(fold != 2))
    return kneser_ney.score(spark, docs, model).withColumn("held_out", fold == 2)
