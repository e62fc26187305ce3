"""Training documents from raw ones: language, repeated lines, near duplicates, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; it is written as Parquet to the shared
folder and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepwright.llm import decontaminate, language, lines, sentencepieces, simhash
from prepwright.llm.catalog import tokenizer
from prepwright.llm.common import join_few, release, stored, table, text_key

# A document is rejected if more of its letters are outside its largest language than in it: the one language it
# goes by would be wrong for most of it. Two languages may share a text, three even parts may not.
MIN_SCORE = 0.5


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: a missing text, a text without letters and one that is a mixture in which
    no language has MIN_SCORE of the letters go, as does one in a script that no learned language has. An empty
    table stays empty."""
    wanted = docs.withColumnsRenamed({c: f"doc_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang")})
    found = language.predicted(wanted, language.learn(wanted), carry=tuple(wanted.columns))
    kept = found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return kept.select(*[F.col(new).alias(old) for new, old in zip(wanted.columns, docs.columns)])


def by_line(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has, n_chars counted anew. Documents of which nothing is left go."""
    found = lines.without_repeats(docs, short=True)
    kept = found.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        # In the type that the column has, which need not be a number.
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, n_chars).otherwise(F.col("n_chars")))
    return kept.select(*_columns(docs))


def by_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: the smallest by doc_id, a missing one last, then by a hash of the
    text; of rows equal in both the smallest by all columns."""
    order = F.struct(F.col("doc_id").isNull().alias("without_id"), "doc_id", "text_hash")
    found = stored(simhash.groups(docs, hashed=True).groupBy("doc_id", "text_hash")
                   .agg(F.first("root").alias("root"), F.count("*").alias("n")), "near-groups")
    least = stored(found.groupBy("root").agg(F.min(order).alias("least")), "near-least")
    marked = found.join(least, "root").select("doc_id", "text_hash", "n", order.eqNullSafe(F.col("least")).alias("stays"))
    marked = stored(marked.filter("not stays or n > 1"), "near-copies")
    repeats = stored(marked.filter("stays").select("doc_id", "text_hash"), "near-repeats")
    rows = docs.select(F.struct(*_columns(docs)).alias("doc"), *text_key())
    alone = join_few(rows, marked, "left_anti").select("doc.*")
    return alone.unionAll(join_few(rows, repeats, "inner").groupBy("doc_id", "text_hash").agg(F.min("doc").alias("doc")).select("doc.*"))


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = stored(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
                   .select("doc_id", "text_hash").distinct(), "contaminated")
    hashed = docs.select(F.struct(*_columns(docs)).alias("doc"), *text_key())
    return join_few(hashed, found, "left_anti").select("doc.*")


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to."""
    rows = sentencepieces.round_trips(docs, tokenizer("piece_bpe_32k.model"), carry=("doc_id", "lang", "source"))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [("language", by_language), ("lines", by_line), ("simhash", by_simhash), ("benchmark", by_benchmark), ("pieces", in_pieces)]

# XXH64, the language model and piece encoding are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs
