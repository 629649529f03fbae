"""A corpus from raw documents to packed sequences, stage by stage; each stage's rows are written and read again."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import language_id, ngram_join, packing, pii, suffix_dedup
from stratum.llm.common import col, configure, materialize, read, sized_join
from stratum.llm.queries import held_out

#: Mean over words of the greatest marginal below which a document is in none of the learned languages, nor in a mix of them.
LEAST_SCORE = 0.4


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _stage(keeps: bool = True):
    """A stage that first bounds the session's Arrow batches, and whose own columns clash with none of the documents'.

    Columns beyond those of documents go by numbers while the stage works, and come back under their names if it keeps them.
    """

    def wrap(stage):
        @functools.wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            configure(spark)
            names = {c if c in COLUMNS else f"__column{i}": c for i, c in enumerate(docs.columns)}
            out = stage(spark, docs.select(*[col(c).alias(own) for own, c in names.items()]), sf_dir)
            return out.select(*[col(own).alias(c) for own, c in names.items()]) if keeps else out

        return run

    return wrap


@_stage()
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter (null and empty ones too) or too uncertain go.

    Rows that repeat are judged alike. Where no row has both text and language nothing can be told, and none is kept.
    """
    model = language_id.train(docs, usable=~held_out())
    labelled = language_id.identify(docs, model)
    return labelled.where((F.col("lang_pred") != language_id.UNDECIDED) & (F.col("sureness") >= LEAST_SCORE)).select(*docs.columns)


@_stage()
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a similarity of 0.8 or more, the one of least id.

    Rows whose id is null are in no class, and stay. Rows that share an id share a class; of those that share the text too
    the least row stays. Texts that are null or without a word are in no class.
    """
    classes = ngram_join.jaccard_classes(docs)
    dropped = materialize(spark, classes.where("doc_id <> class_id").select("doc_id").distinct(), "near-copies")
    kept = sized_join(docs, dropped, "doc_id", "left_anti", 32 * dropped.count())
    twice = materialize(spark, docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    n = twice.count()
    if not n:
        return kept
    least = sized_join(kept, twice, "doc_id", "left_semi", 32 * n).groupBy("doc_id", F.col("text").alias("__text")).agg(F.min(F.struct(*docs.columns)).alias("r"))
    return sized_join(kept, twice, "doc_id", "left_anti", 32 * n).unionByName(least.select("r.*"))


@_stage()
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters that lie wholly in strings of 100 bytes with an earlier start; n_chars follows.

    Null texts stay null. Rows that repeat id and text take nothing from each other; rows with one id but two texts are
    documents of their own.
    """
    out = suffix_dedup.remove_repeats(docs, characters=True)
    return _with_text(docs, out, F.when(F.col("text").isNotNull(), F.decode("kept", "UTF-8")))


@_stage()
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows. Null texts stay null; rows that repeat stay alike."""
    return _with_text(docs, pii.redact(docs, pii.train(docs)), F.col("text"))


@_stage(keeps=False)
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 2048 tokens; null texts are documents of the end id
    alone, rows that repeat are packed each by itself."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


def _with_text(docs: DataFrame, made: DataFrame, text) -> DataFrame:
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return made.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]
#: No stage but the last could be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return docs
