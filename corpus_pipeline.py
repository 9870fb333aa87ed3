"""From raw documents to a token mixture: quality rules, quality classifier, near-dedup, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage
is written as Parquet and read again before the next one, so a lost executor costs a part of one stage.

Defined cases, for every stage: a null text is an empty one; null ids, languages and sources are values as any other;
repeated rows are judged each (near_dedup keeps one); an empty table gives an empty one; further columns, whatever their
names, come through with their values, but for columns of the last stage's own names, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm import bpe, gam, minhash, mixing, rules
from veridoc.llm.shared import drop_written, table, unused, written, written_so_far


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted votes of the rules, and the base rule, keep: an empty text goes."""
    into = unused(docs, "_rules")
    return rules.score_rules(docs, into=into).where(F.col(into)["kept"]).drop(into)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be good; learned from the labelled ones of the raw table."""
    model = gam.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = unused(docs, "score"), unused(docs, "predicted")
    return gam.score(docs, model, names).where(F.col(names[1]) == 1).drop(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near-duplicates; texts without words are one class."""
    return minhash.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, once for each epoch they are taken in; a text without words has no tokens to take."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's token ids with their number and digests (ids, n_tokens, ids_sha256, decoded_sha256), in place of the
    texts; columns of these names are replaced."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: The classifier, the near-duplicates and the encoder are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote on the way, and its predecessor's output, go when it is written."""
    docs, mark = table(spark, sf_dir, "documents"), written_so_far()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", texts=True)
        drop_written(spark, mark, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
