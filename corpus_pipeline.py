"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``, and the next one gets what it returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from exposcope.llm import boilerplate, bpe, decontaminate, neardup, toxicity
from exposcope.llm.common import broadcast_if_small, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the chain calls toxic go.  The chain learns from
    ``labels`` and the texts it is given; without labels all documents stay."""
    model = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=docs.columns).where(F.col("p_toxic") < toxicity.THRESHOLD).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, a source being a site: boilerplate lines go, n_chars follows the text.
    Equal texts of a source count as one page: copies are the next stage's work, and a
    large group of them must not lose all its lines here."""
    lines = boilerplate.split_lines(F.col("text"))
    out = boilerplate.drop_boilerplate(docs, F.col("source"), lines, page=boilerplate.content(lines))
    chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of near copies stays (the smallest id)."""
    gone = written(neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct())
    return docs.join(broadcast_if_small(gone, 24), "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold benchmark text go."""
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the token ids of what is left, and the digest of their decoding."""
    import public_tokenizers
    v = bpe.load_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(docs, v).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_copies),
          ("decontamination", drop_contaminated), ("bpe", tokens)]

#: The classifier and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
