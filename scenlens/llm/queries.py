"""The operators applied to the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenlens.llm import (
    alignment,
    ann,
    ball_search,
    language,
    line_dedup,
    mixing,
    near_dup,
    packing,
    pii,
    quality,
    token_counts,
    token_files,
    toxicity,
)

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), similarity=75, words=5)


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(
        table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, neighbours=10, tables=12, probes=10
    )


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that bring good text to nine tenths of the expected tokens, low quality to one, toxic text to none."""
    docs = table(spark, sf_dir, "documents")
    labelled = mixing.quality_domains(docs, table(spark, sf_dir, "labels"))
    return mixing.mixing_rates(docs, labelled, {"good": 0.9, "low": 0.1, "toxic": 0.0}).drop("key")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), end_id=0, capacity=2048
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the rows that are not held out, then applied to all; ids and labels are no inputs of a prediction."""
    docs = table(spark, sf_dir, "documents")
    field = language.train(docs.where(~language.held_out()))
    named = docs.withColumn("doc_id", F.struct("doc_id", language.held_out().alias("held_out")))
    return language.label_texts(named, field).select("doc_id.doc_id", "doc_id.held_out", "lang_pred", "score")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), end_id=2
    )
    return token_files.read_token_files(manifest)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op9_separator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the documents, from files written without special ids in the texts and read without offsets."""
    end = 50256
    manifest = token_files.write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), end, plain_text=True, by_id=False
    )
    counted = token_counts.token_counts(manifest, end, named=True)
    return counted.select("doc_id", "ordinal", "start", "n_tokens", "terminated")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on labels that are not held out, then applied to every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(toxicity.labelled_texts(docs, labels.where(~held_out)))
    named = docs.select(F.struct("doc_id", held_out.alias("held_out")).alias("doc_id"), "text")
    return toxicity.score_texts(named, model).select("doc_id.doc_id", "doc_id.held_out", "score", "predicted")


def op12_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=20)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_tokenizer_alignment(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_MODEL)
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_cross_polytope": op2_cross_polytope,
    "op3_soft_mixing": op3_soft_mixing,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_language": op5_language,
    "op6_token_files": op6_token_files,
    "op7_line_dedup": op7_line_dedup,
    "op8_pii": op8_pii,
    "op9_separator_counts": op9_separator_counts,
    "op10_quality_rules": op10_quality_rules,
    "op11_toxicity": op11_toxicity,
    "op12_ball_search": op12_ball_search,
    "op13_alignment": op13_alignment,
}

#: The others tokenise, search, fit or follow links; they are tested against plain Python.
ORACLES: dict[str, str] = {
    "op7_line_dedup": """
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM docs),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        f AS (SELECT key, TRUE AS often FROM (SELECT DISTINCT r, key FROM k WHERE key <> '') AS d GROUP BY key HAVING count(*) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE often) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN f USING (key) GROUP BY r, doc_id""",
    "op12_ball_search": """
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS terms FROM documents),
        asked AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS terms
            FROM (SELECT DISTINCT item_id, text FROM benchmark) AS b),
        held AS (SELECT r, doc_id, unnest(terms) AS term FROM docs),
        tf AS (SELECT r, doc_id, term, count(*) AS tf FROM held GROUP BY ALL),
        sizes AS (SELECT r, count(*) AS n FROM held GROUP BY r),
        whole AS (SELECT count(*) AS docs_n, CAST(sum(n) AS BIGINT) AS terms_n FROM sizes),
        weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM tf, whole GROUP BY term, docs_n),
        wanted AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM asked) AS u GROUP BY ALL),
        factors AS (SELECT r, 100 - 25 + (25 * n * docs_n) // terms_n AS m FROM sizes, whole),
        scored AS (SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
            FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN factors USING (r) GROUP BY ALL),
        placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
        SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 20""",
}
