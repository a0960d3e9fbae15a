"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    arrow_tokens, chat, decontaminate, hard_negatives, license_model, line_rules, packing, pii, quality_model, secrets,
    simhash, vector_groups, whitening,
)
from millrace.llm.common import table
from millrace.llm.vectors import finite, whole

TOKENIZER = "word_bpe_49k.json"
ESCAPE_TEST = "\\### Assistant: </turn> ok"


def _hex(text: Column) -> Column:
    return F.sha2(text, 256)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that tries to forge marks, formatted and read back."""
    forged = [(-7, 0, "user", ESCAPE_TEST), (-7, 1, "assistant", ESCAPE_TEST)]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(forged, "conv_id long, turn long, role string, text string"))
    out = chat.render(chat.messages(chat.turn_events(turns)))
    read = out.withColumns({"turns": chat.parse(F.col("formatted")), "trained": chat.trained_text(F.col("formatted"), F.col("loss"))})
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _hex(whole).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        _hex(F.col("trained")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        _hex(F.array_join("item_ids", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents packed and written as sequences; the pieces are read back from these."""
    docs = table(spark, sf_dir, "documents")
    return packing.read_pieces(packing.pack(docs, public_tokenizers.path(TOKENIZER), end_id=1))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(table(spark, sf_dir, "documents"))
    both = F.array_sort(F.concat("base", "more"))
    return found.select(
        "doc.doc_id",
        *[_count("base", kind).alias(f"n_{kind}") for kind in pii.KINDS],
        _hex(_joined(F.col("base"))).alias("base_sha256"),
        _joined(both).alias("spans"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.withColumn("base", base).select(
        "doc_id",
        *[_count("base", kind).alias(f"n_{kind}") for kind in kinds],
        _hex(_joined(F.col("base"))).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return arrow_tokens.read(arrow_tokens.write(docs, public_tokenizers.path(TOKENIZER), end_id=2))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.rate(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return line_rules.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *wanted)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_model.scan(docs, license_model.train(docs))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))
    return found.select("doc_id", "n_paragraphs", "n_licences", F.array_join(families, ",").alias("families"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings").where(finite(F.col("embedding"))).select(
        vec_id, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole(F.col("embedding"), 256).alias("x")
    )
    return hard_negatives.mine(rows, anchors=vec_id % 100 == 0)


def op12_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.usable(table(spark, sf_dir, "embeddings"))
    model = whitening.fit(rows)
    error = whitening.identity_error(rows, model) if model else 0.0
    return whitening.whitened(rows, model).withColumn("identity_error", F.lit(error))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_decontaminate, op3_pack, op4_personal_data, op5_secrets, op6_token_files, op7_simhash,
        op8_quality, op9_line_rules, op10_licences, op11_hard_negatives, op12_embedding_groups, op13_whitening, pipeline,
    )
}
