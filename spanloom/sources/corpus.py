"""Reading a frozen corpus and JSON-lines records."""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom import schemas


@dataclass
class Corpus:
    texts: DataFrame
    places: DataFrame
    status: DataFrame
    release: DataFrame


def _exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def require_finalized(spark: SparkSession, directory: str, marker: str = "FINALIZED") -> None:
    """Refuse a snapshot whose marker file is missing. Any file system Spark reads will do."""
    if not _exists(spark, directory + "/" + marker):
        raise ValueError("snapshot is not finalized: " + directory)


def load_corpus(spark: SparkSession, directory: str, finalized: bool = True) -> Corpus:
    """A snapshot of parquet tables. Only the columns of the model are read, and only the
    places some text was written for."""
    if finalized:
        require_finalized(spark, directory)

    def read(name, ddl):
        return spark.read.schema(ddl).parquet(f"{directory}/{name}.parquet")

    texts = read("texts", schemas.TEXTS)
    return Corpus(texts, places_with_text(read("places", schemas.PLACES), texts), read("status", schemas.STATUS),
                  read("release", schemas.RELEASE))


def places_with_text(places: DataFrame, texts: DataFrame) -> DataFrame:
    return places.join(texts.select("place_id"), "place_id", "left_semi")


def read_records(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, see ``parse_records``."""
    return parse_records(spark.read.text(path), "value", schema, defaults)


def parse_records(lines: DataFrame, line: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """Lines of JSON as columns in place of ``line``. Blank lines go; missing keys take defaults.

    A line that is no object of this schema, or holds a value of another type, keeps its
    text in ``_corrupt_record``, which is NULL for all others, and takes no defaults.
    """
    others = [c for c in lines.columns if c != line]
    full = schema + ", _corrupt_record STRING"
    read = F.from_json(line, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    got = lines.filter(F.btrim(F.col(line)) != "").select(*others, F.col(line).alias("_line"), read.alias("_r"))
    broken = F.col("_r").isNull() | F.col("_r._corrupt_record").isNotNull() | ~F.btrim(F.col("_line")).startswith("{")
    out = got.select(*others, "_r.*", F.when(broken, F.col("_line")).alias("_bad")).drop("_corrupt_record").withColumnRenamed("_bad", "_corrupt_record")
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.when(F.col("_corrupt_record").isNull(), F.coalesce(F.col(name), F.lit(value).cast(out.schema[name].dataType))))
    return out


def content_digest(texts: DataFrame, key="text_id", text="text") -> DataFrame:
    """One row: number of texts and a digest that changes with any id or text.

    Row hashes are added word by word modulo 2^32, so the digest needs no order and no
    task sees more than its share. The sums are decimals, which hold any number of rows.
    """
    row = F.sha2(F.concat(F.col(key).cast("string"), F.lit("\u0000"), F.col(text), F.lit("\u0000")), 256)
    words = [F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = texts.select(row.alias("_h")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).alias("w%d" % i) for i, w in enumerate(words)])
    hexed = [F.lower(F.lpad(F.hex((F.col("w%d" % i) % F.lit(2 ** 32)).cast("long")), 8, "0")) for i in range(8)]
    return sums.select("n", F.concat(*hexed).alias("digest"))


def registry_digest(patterns) -> str:
    """Digest of the registry a run used."""
    return hashlib.sha256("\n".join(repr(p) for p in patterns).encode()).hexdigest()


def run_record(texts: DataFrame, patterns, stats: DataFrame, release: DataFrame | None = None) -> DataFrame:
    """Provenance of a run as key and value: digests, build time, stats as JSON."""
    digest = content_digest(texts).select(F.explode(F.map_from_arrays(
        F.array(F.lit("content_sha256"), F.lit("texts")), F.array("digest", F.col("n").cast("string")))).alias("key", "value"))
    fixed = texts.sparkSession.createDataFrame([("patterns_sha256", registry_digest(patterns))], "key string, value string")
    built = fixed.select(F.lit("built_at").alias("key"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("value"))
    out = digest.unionByName(fixed).unionByName(built).unionByName(
        stats.select(F.lit("stats").alias("key"), F.to_json(F.struct("*")).alias("value")))
    if release is not None:
        out = out.unionByName(release.select(F.concat(F.lit("release_"), "key").alias("key"), "value"))
    return out


def upsert_round(history: DataFrame, number: int, date: str, note: str, stats: DataFrame) -> DataFrame:
    """The round history with the row of one round appended or replaced."""
    row = stats.select(F.lit(number).alias("round"), F.lit(date).alias("date"), F.lit(note).alias("note"), "stats")
    return history.filter(F.col("round") != number).unionByName(row)
