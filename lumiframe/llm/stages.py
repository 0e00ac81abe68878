"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of ``docs``.

All take null texts and ids, repeated rows, empty tables and extra columns of any name; each says what becomes of them. No stage looks at doc_id but
near-dedup, which prefers the least, and language ID, which doesn't learn from held-out ids; different texts under one id are different documents.

Each bounds the batches of the session's Python functions (``small_batches``): executors that run all stages keep what the largest batch of any took."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe.llm import decontaminate, jaccard, language_id, packing, secret_scan
from lumiframe.llm.common import fresh, spread, table
from lumiframe.session import small_batches


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language can't be told (null text, no letters, or a probability under 0.3) go, all if no row has a language to learn from."""
    small_batches(spark)
    return language_id.keep_identified(spread(docs), language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup on 5-word shingles: of each component of Jaccard similarity 0.8 or more the document with the least doc_id stays.

    SimHash links by ball hashing first; orders of min-hashes complete it, each link confirmed. Texts without words are one component; documents without an id stay only if no copy has one."""
    small_batches(spark)
    return jaccard.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a passage of a benchmark item go; null texts hold none, an empty benchmark takes nothing."""
    small_batches(spark)
    return decontaminate.clean(spread(docs), table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every document stays, each secret in its text becomes ``[SECRET]``; ``n_chars`` follows where it is a column.

    Null texts stay null; repeated rows and ids stay."""
    small_batches(spark)
    spans, masked = fresh(docs, "__spans"), fresh(docs, "__masked")
    found = secret_scan.to_paths(docs, secret_scan.findings(docs, rules=secret_scan.MASKED), spans=spans)
    found = found.withColumn(masked, secret_scan.redact(F.col("text"), F.col(spans)))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col(masked).alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.size(spans) > 0, F.char_length(masked)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return found.select(*cols)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of every document in sequences of at most 2,048 tokens; a null text is the end id alone."""
    small_batches(spark)
    return packing.pack(spread(docs.select("doc_id", "text")))
