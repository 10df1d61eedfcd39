"""Training-data pipeline over documents: language, near duplicates, benchmark leaks, secrets, packing.

``run(spark, sf_dir)`` applies the stages in order. Each stage reads what its predecessor kept as a Parquet table in the
folder named in spark.checkpoint.dir. All but the last return the columns of documents; a column that documents lacks
(lang, source or n_chars) counts as null, further columns are left out.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.decontaminate import decontaminated
from spanloom.llm.language import identify
from spanloom.llm.neardup import may_be_named, named, near_rows
from spanloom.llm.packing import pack_documents
from spanloom.llm.secrets import redacted, scan
from spanloom.llm.shared import held_out, written

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
#: A text of which the best language holds a smaller part of the n-grams is in none of the languages.
KNOWN = 0.4
#: Rows to learn from below which a text's n-grams prove nothing, and no lettered text goes.
LEARNED = 100
#: Longest sequence of the packed corpus, in tokens.
SEQUENCE = 2048
#: Words with their ids that a Python worker keeps, some 100 MB: the executors also hold what earlier stages have grown.
WORDS = 300_000


def _documents(docs: DataFrame) -> DataFrame:
    have = {c.lower(): c for c in docs.columns}
    return docs.select(*[(F.col(have[c]) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that was learned; ``und`` (null text, no letters) and texts that no language's n-grams
    cover go. Where fewer than ``LEARNED`` labelled texts lie outside the held-out fold, the filter covers too little to
    reject by it, and only texts without letters go."""
    docs = _documents(docs)
    found = identify(docs)
    known = (F.col("lang_pred") != "und") & (F.col("known") >= KNOWN)
    lettered = F.coalesce(F.col("text").rlike(r"\pL"), F.lit(False))
    learned = docs.filter("lang is not null and text is not null").filter(~held_out()).limit(LEARNED).count() == LEARNED
    return found.filter(known if learned else lettered).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest doc_id: five words, 0.8 or more.

    It is so whatever the doc_ids are: null ids come last, a doc_id that repeats with texts that differ keeps one row of
    each group, and a tie goes by a hash of the text. Rows that repeat doc_id and text become one row, the one with the
    least lang, source and n_chars; texts without words are in no group."""
    docs = _documents(docs)
    rows = near_rows(docs, k=5, percent=80)
    stays = F.col("top").isNull() | (F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("text_hash") == F.col("top.text_hash")))
    mark = F.when(~F.first("stays"), 2).when(F.count(F.lit(1)) > 1, 1)
    marks = rows.withColumn("stays", stays).groupBy("doc_id", "text_hash").agg(mark.alias("mark")).filter("mark is not null")
    marks = written(marks, slim=True)
    maybe, unmarked = may_be_named(docs, marks)  # most texts are in no group; they are not shuffled to meet the marks
    marked = written(named(maybe, marks, "left"))
    once = unmarked.select(*COLUMNS).unionByName(marked.filter("mark is null").select(*COLUMNS))
    merged = marked.filter("mark = 1").groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("x")).select("doc_id", "x.*")
    return once.unionByName(merged)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths or more of a benchmark item's five-word shingles go."""
    return decontaminated(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values that look live and belong to few owners are replaced by their kind in brackets; copied examples stay.
    A value counts from the least length of its kind on (8 characters for assignments), unless it is a placeholder.
    n_chars is the length of the text as it is then. No document goes."""
    found = scan(_documents(docs), least=8)
    clean = redacted(F.col("text"), F.col("spans"))
    changed = F.exists("spans", lambda s: s["verdict"] == "live")
    return found.select("doc_id", clean.alias("text"), "lang", "source", F.when(changed, F.length(clean).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most ``SEQUENCE``; see spanloom.llm.packing."""
    import public_tokenizers
    return pack_documents(_documents(docs), str(public_tokenizers.path("word_bpe_49k.json")), SEQUENCE, WORDS)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Languages, signatures and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` in ``sf_dir`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
