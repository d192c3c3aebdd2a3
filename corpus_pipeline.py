"""The corpus pipeline: language ID, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last, which
returns packed pieces.  The driver of the pipeline writes each stage's rows as Parquet and reads them
again as the next one's docs; ``run`` does the same under spark.checkpoint.dir, and what a stage wrote
besides goes as it ends.

In all stages every row is a document of its own: doc_ids may repeat or be null.  Other columns pass
unread, whatever their names but those that begin with two underscores.  Texts are read whole, one at
a time a worker.  Empty input: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import jaccard, langid, mixing, pii, tokens
from keyloom.llm.common import materialize, scratch
from keyloom.llm.queries import table, tokenizer_path


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; ``und`` and texts of unknown language go.

    Null and empty texts and texts without letters are ``und``; a null lang is no label and no reason to go.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of linked documents, null last; of equal rows any one.

    Null and empty texts and texts without words link with nothing and stay.
    """
    return jaccard.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by its kind; n_chars follows the new text.

    Null and empty texts and those without personal data stay as they are, n_chars too.
    """
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents by their sources' targets.

    A null source is a source of its own, last; null and empty texts have size 0 and follow their
    source's rate.  Ties in size are ordered by a digest of doc_id, then by row.
    """
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens.

    Null and empty texts are a piece of the end id alone; longer documents than a sequence are cut.
    """
    return tokens.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", identify), ("jaccard_dedup", deduplicate), ("pii", redact), ("mixing", mix), ("packing", pack)]

#: Language ID, personal data and packing aren't SQL-expressible; tests/llm compares with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
