"""From raw documents to token ids: language, repeated lines, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` writes each stage's rows to the shared folder and reads them again for the next one, so a
lost executor costs no more than the stage at hand; what a stage has left there goes when the next one is written.

Defined results, whatever the columns: an empty table stays empty; other columns than text and n_chars pass through
unchanged, whatever their names; rows with equal id and text are one document from the third stage on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import bpe, langid, linededup, mixing, simhash_gray
from affinis.llm.common import checkpoint_dir, delete, scratch, table
from affinis.llm.queries import bpe_files

#: Documents whose language has less than this share of the posterior are rejected, as are those without a letter.
LEAST_SHARE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a language that the model tells.

    Null and empty texts and texts without a letter have none and go; nulls in other columns do not matter, but that a
    null lang teaches nothing. Equal texts have equal languages, so repeated rows stay or go together, also of very long
    texts, which are scored whole. Without a document that has a lang, all go.
    """
    found = langid.identify(docs).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return found.select("doc.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without the lines that stand earlier, equal or nearly so; n_chars follows the text.

    A null text stays null, and a text that loses all its lines becomes empty. Of equal lines, and of the lines of a class,
    the first by id and place stays; null ids come first. Rows of equal id and text keep the same lines.
    """
    done = linededup.drop_repeated_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_gone") > 0, F.length("text")).otherwise(F.col("doc.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return done.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Null, empty and blank texts are copies of each other. Documents without an id all stay. Of rows with equal id and
    text one stays; different texts under one id are judged each by its own copies.
    """
    return simhash_gray.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the sources' target weights take them.

    A null source is a source of its own, the last one; a null text has no words but is taken as others of its source are.
    Rows with equal ids share their draw.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each taken document's token ids, with digests of the ids and of the bytes that they decode to.

    A null or empty text has no ids and the digests of nothing. Repeated rows have equal ids each, and long texts all of theirs.
    """
    done = bpe.round_trip(docs, *bpe_files(), keep=["doc_id", "source"], with_ids=True)
    return done.select("doc.doc_id", "doc.source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("language", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: The first stage's model and the third one's fingerprints have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}_{name}"
        with scratch(spark):
            done = stage(spark, docs, sf_dir)
            done.write.parquet(out)
        docs = spark.read.schema(done.schema).parquet(out)
        if before is not None:
            delete(spark, before)
        before = out
    return docs
