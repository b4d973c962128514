"""One query for each operator, over its whole table: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import (
    bpe,
    counts,
    decontaminate,
    language,
    lexical,
    lines,
    minhash,
    nearest,
    pii,
    simhash,
    spelling,
    substrings,
    toxicity,
)
from tracelake.llm.common import id_remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(kind) for kind in pii.BASE),
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels.where(id_remainder(3) != 1))
    found = toxicity.with_toxicity(docs, model)
    return found.select(
        "doc_id",
        F.coalesce(id_remainder(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    contents = language.dictionaries(docs.where(id_remainder(4) != 2))
    found = language.identify(docs, contents)
    held_out = F.coalesce(id_remainder(4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "margin", "rejected")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.leaks(docs, benchmark)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return lexical.lexical_search(docs, benchmark)


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_simhash_near_dedup,
        op3_pii,
        op4_toxicity,
        op5_substring_dedup,
        op6_line_dedup,
        op7_language_id,
        op8_token_counts,
        op9_nearest_neighbours,
        op10_decontamination,
        op11_spelling_variants,
        op12_lexical_search,
        op13_minhash_near_dedup,
    )
}
#: Answers in SQL, where it can express the operator.
ORACLES: dict[str, str] = {
    "op3_pii": pii.PII_SQL,
    "op5_substring_dedup": substrings.SUBSTRING_SQL,
    "op9_nearest_neighbours": nearest.NEAREST_SQL,
    "op10_decontamination": decontaminate.LEAKS_SQL,
    "op12_lexical_search": lexical.LEXICAL_SQL,
}
