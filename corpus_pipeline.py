"""The corpus pipeline: each stage's rows are written as Parquet and read again by the next.

Stages take ``(spark, docs, sf_dir)`` and, but for the last, return the columns of
``documents``. Nulls are no reason to reject but where a stage says so: a document
without text has no toxic words and no benchmark passages, and goes as no language is
found in it. Documents without an id are no copies. Rows that repeat an id and its text are
one document (the first by all its columns as JSON stays); an id with several texts goes
only if each of them is a copy, so no clean text is lost. Ties between near copies go to
the smallest id. Texts of any length are judged whole. Columns may have any name, those
that the stages use themselves or with dots included. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm import core, crf, queries, toxicity
from zonalis.llm.decontaminate import decontaminate
from zonalis.llm.minhash_join import near_duplicates

#: A document with this chance of being toxic is rejected.
TOXIC = 0.7
#: A document whose language holds a smaller share of its words is rejected, as is one without any.
LEAST_SHARE = 0.3


def _unused(docs: DataFrame, *names: str) -> str:
    """A prefix with which none of the names is a column."""
    prefix, taken = "_", {c.lower() for c in docs.columns}
    while any(prefix + n in taken for n in names):
        prefix += "_"
    return prefix


def _quoted(docs: DataFrame) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in docs.columns]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic."""
    weights = queries.toxicity_weights(docs, queries.table(spark, sf_dir, "labels"))
    own = _unused(docs, "score") + "score"
    return toxicity.score(docs, weights, column=own).where(F.col(own) < TOXIC).drop(own)


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language, or in none that holds ``LEAST_SHARE`` of the words."""
    p = _unused(docs, "lang_pred", "score")
    found = crf.predict(docs, queries.language_model(docs), prefix=p)
    return found.where((F.col(f"{p}lang_pred") != "und") & (F.col(f"{p}score") >= LEAST_SHARE)).drop(f"{p}lang_pred", f"{p}score")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (5-word shingles, 0.8) the smallest id."""
    found = core.stage(near_duplicates(docs).select("doc_id", "kept"), "kept")
    n, ids = found.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    # an id goes if none of its texts is kept
    gone = found.where("NOT kept").select("doc_id").distinct()
    if n != ids:
        gone = gone.join(found.where("kept").select("doc_id"), "doc_id", "left_anti")
    out = docs.join(gone, "doc_id", "left_anti").select(_quoted(docs))
    if n != ids:
        whole = F.struct(*_quoted(docs))
        once = out.where("doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("row"))
        once = once.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
        out = once.unionByName(out.where("doc_id IS NULL"))
    return out


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a window of a benchmark item."""
    found = decontaminate(docs, queries.table(spark, sf_dir, "benchmark"), keep=True)
    return found.where("n_hit = 0").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 4096 tokens."""
    return queries.packed(docs)


STAGES = [("toxicity", without_toxic), ("language", with_language), ("near_duplicates", without_copies), ("decontamination", without_benchmark), ("packing", packing)]

#: No stage but the fourth can be told in SQL; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents`` in ``sf_dir``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = core.stage(stage(spark, docs, sf_dir), name)
    return docs
