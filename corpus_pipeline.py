"""The training-data pipeline: five stages over the documents, each by one operator.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns
of ``docs``; the last returns the packed pieces. Rows without a doc_id and repeated rows are handled
like others: a stage's decision belongs to a row's doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, packing, pii, quality_model, similar
from millrace.llm.common import stage as staged
from millrace.llm.common import table
from millrace.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_model.score(docs["text"], model) >= 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Near means at least 0.8 of all five-word shingles in common, directly or through others.
    Of several rows with that doc_id one stays; documents without a doc_id stay only where no
    document of their group has one, and then one of them does.
    """
    numbered = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    # Rows are numbered in order of doc_id, so that the smallest number of a group is its document.
    ids = numbered.select(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "__row").alias("__id"), "__row")
    found = similar.groups(numbered.select(F.col("__row").alias("row"), "text"))
    groups = found.select(F.col("row").alias("__row"), F.col("group").alias("__group")).join(ids, "__row")
    keep = groups.groupBy("__group").agg(F.min("__id").alias("__id")).select(F.col("__id.__row").alias("__row"))
    # Texts move once, at any size: what is kept grows with the documents and is never broadcast.
    kept = staged(keep, "keep").hint("merge")
    return numbered.join(kept, "__row", "left_semi").select(*[numbered[f"`{c}`"] for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    digest = F.xxhash64("text")
    marked = docs.select("doc_id", digest.alias("__digest"), "text")
    found = decontaminate.hits(marked, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    gone = staged(found.select(F.col("doc_id").alias("__id"), "__digest").distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__digest"])
    return docs.join(gone, same, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    found = pii.extract(docs, keep=tuple(docs.columns))
    text = pii.masked(F.col("doc.text"), F.concat("base", "more"))
    out = found.withColumn("__text", text).select("__text", "doc.*").withColumn("text", F.col("__text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed and written as sequences; their pieces are read back."""
    import public_tokenizers

    return packing.read_pieces(packing.pack(docs, public_tokenizers.path(TOKENIZER), end_id=1))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", packed),
]

#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = staged(function(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
