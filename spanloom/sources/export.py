"""Writing the tables."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.sources.corpus import _exists

# What each exported table holds; the comments go into the data dictionary.
DICTIONARY = {
    "labels": {"text_id": "text", "start": "first character", "end": "character after the last", "label": "as written",
               "string": "lower case, markup and article removed", "source": "quote or line", "model": "writer", "flag": "why not counted"},
    "strings": {"string": "the string", "as_written": "most frequent form", "texts": "counted texts", "models": "writers", "labels": "labels",
                "texts_from_quote": "texts from a quote", "texts_from_line": "texts from a line", "best_pattern_score": "best score anywhere"},
    "texts": {"text_id": "text", "model": "writer", "length": "characters", "kind": "kind of answer", "flag": "why not counted"},
    "text_names": {"text_id": "text", "norm": "string", "display": "as written", "score": "best precision", "patterns": "patterns",
                   "n_mentions": "hits", "first_pos": "first hit", "occurrences": "times in the text"},
    "names": {"norm": "string", "display": "as written", "n_texts": "texts", "expected": "sum of scores", "best": "best score",
              "n_models": "writers", "top_model": "writer with most texts", "n_mentions": "hits", "df": "share of all texts with the word", "patterns": "patterns"},
    "patterns": {"id": "pattern", "version": "version", "round": "round", "yields": "what a hit is", "family": "form", "regex": "pattern", "what": "what it catches",
                 "flags": "m: line by line, i: case ignored", "stop": "stoplist", "reject": "captures that are refused", "mask": "lines left out", "max_words": "most words",
                 "min_occ": "least occurrences in the text", "max_df": "greatest share of texts with the word", "title": "kind of title line", "body": "what the body must do with it",
                 "position": "title where it reads titles", "labels_from": "earlier versions whose verdicts count", "added": "date", "note": "note", "remark": "remark",
                 "origin_text": "text it was drawn from", "origin_excerpt": "words it was drawn from", "status": "active or retired", "retired_reason": "why retired"},
    "models": {"model": "writer", "texts": "counted texts", "flagged": "left out"},
    "text_cov": {"text_id": "text", "n_hits": "hits", "n_names": "strings"},
}


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no arrays; they become comma lists, structs become JSON."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col("`%s`" % f.name)
        if kind.startswith("array<string"):
            c = F.array_join(c, ",")
        elif kind.startswith(("array", "struct", "map")):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def export_tables(tables: dict, directory: str, compressed=("labels", "strings"), comments: dict | None = None) -> DataFrame:
    """Tables as CSV with a header, some gzipped; returns the data dictionary it also writes.

    Every column has a comment, from ``DICTIONARY`` or from ``comments`` {(table, column): text}."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        writer = _flat(df).write.mode("overwrite").option("header", True)
        if name in compressed:
            writer = writer.option("compression", "gzip")
        writer.csv(f"{directory}/{name}")
    rows = [(t, c, DICTIONARY.get(t, {}).get(c) or (comments or {}).get((t, c))) for t, df in tables.items() for c in df.columns]
    missing = [f"{t}.{c}" for t, c, comment in rows if not comment]
    if missing:
        raise ValueError("columns without a comment: " + ", ".join(missing))
    dictionary = spark.createDataFrame(rows, "table string, column string, comment string")
    dictionary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{directory}/dictionary")
    return dictionary


def spans_by_text(spans: DataFrame, key="text_id") -> DataFrame:
    """One row per text with its spans in order."""
    rest = [c for c in spans.columns if c not in (key, "start", "end")]
    return spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", *rest))).alias("spans"))


def export_spans(spans: DataFrame, directory: str, parts: int = 2, key="text_id") -> None:
    """Gzipped JSON lines, one per text, in parts by range of the text id."""
    ranged = spans_by_text(spans, key).repartitionByRange(parts, key).sortWithinPartitions(key)
    ranged.write.mode("overwrite").option("compression", "gzip").json(directory)


def bucket(key, scheme: str):
    """Serving bucket: 'sha1' first two hex digits of a string, 'div100' / 'div1000' of an id."""
    c = F.col(key) if isinstance(key, str) else key
    if scheme == "sha1":
        return F.substring(F.sha1(c), 1, 2)
    return F.floor(c / int(scheme[3:])).cast("string")


def write_buckets(df: DataFrame, directory: str, key: str, scheme: str, rows: int = 100_000) -> None:
    """JSON in one folder per bucket. A bucket is cut by a hash of its rows into files of
    about ``rows`` rows, by its measured size; a small one is a single file."""
    keyed = df.withColumn("b", bucket(key, scheme))
    sizes = keyed.groupBy(F.col("b").alias("_b")).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_files"))
    whole = F.xxhash64(*[F.to_json(F.struct("*"))])
    dealt = keyed.withColumn("_h", whole).join(sizes, F.col("b").eqNullSafe(F.col("_b"))).drop("_b")
    dealt = dealt.withColumn("_file", F.pmod("_h", F.col("_files")))
    dealt.repartition("b", "_file").drop("_h", "_file", "_files").write.option("maxRecordsPerFile", rows).mode("overwrite").partitionBy("b").json(directory)


def write_store(df: DataFrame, root: str, key: str, scheme: str, rows: int = 100_000) -> DataFrame:
    """A serving store that does not grow a folder for each bucket: JSON lines in files of about ``rows`` rows, in the order
    of the buckets, and an index, bucket -> file and rows, which is returned.

    Files follow the rows, not the buckets: small buckets share one, a large one has several, for rows are ranged by bucket
    and a hash. A null key is a bucket of its own. The store is written once; a new version is a new ``root``."""
    spark, keyed = df.sparkSession, df.withColumn("b", bucket(key, scheme))
    files = max(1, -(-df.count() // rows))
    whole = F.xxhash64(*[F.to_json(F.struct("*"))])
    dealt = keyed.withColumn("_h", whole).repartitionByRange(files, F.col("b"), F.col("_h")).sortWithinPartitions("b", "_h")
    dealt.drop("_h").write.mode("errorifexists").json(f"{root}/data")
    back = spark.read.schema(keyed.schema).json(f"{root}/data")
    index = back.groupBy("b", F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    index.repartitionByRange("b", "file").sortWithinPartitions("b", "file").write.mode("errorifexists").parquet(f"{root}/index")
    return spark.read.parquet(f"{root}/index")


def read_bucket(spark: SparkSession, root: str, value: str | None, schema) -> DataFrame:
    """Rows of one bucket of a store: the index names the files that hold it, and no other is opened."""
    named = spark.read.parquet(f"{root}/index").filter(F.col("b").eqNullSafe(F.lit(value))).select("file").collect()
    if not named:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{root}/data/{r.file}" for r in named]).filter(F.col("b").eqNullSafe(F.lit(value)))


def _pointer(spark, root):
    return root + "/CURRENT"


def current(spark: SparkSession, root: str) -> str | None:
    """The version a table's pointer names."""
    if not _exists(spark, _pointer(spark, root)):
        return None
    return root + "/" + spark.read.text(_pointer(spark, root)).first()[0]


def overwrite(df: DataFrame, root: str, version: str) -> str:
    """Write a new version beside the old one and switch the pointer at the end, so a reader
    never sees half a table and a failed job changes nothing. A version that exists is
    refused, for readers may be on it; the pointer is written beside and renamed over."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    beside = hadoop.Path(f"{root}/.CURRENT-{uuid.uuid4().hex}")
    files = beside.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(beside), files.makeQualified(hadoop.Path(_pointer(spark, root))), options)
    return f"{root}/{version}"


def write_if_changed(df: DataFrame, root: str, digest: str) -> bool:
    """Write only if the pointer does not already name this digest."""
    if current(df.sparkSession, root) == f"{root}/{digest}":
        return False
    overwrite(df, root, digest)
    return True
