"""Benchmark items inside documents: size-partitioned MinHash containment search, verified by exact containment."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import PUNCTUATION, distinct_sets, long_lists, mix, shingle_hashes, slices, small_batches, word_hashes, written

#: 64-bit words of a filter: 2 MB, 16.8 million bits, whatever the number of items.
FILTER_WORDS = 1 << 18
#: Bytes of text that are looked at together.
SLICE = 2 << 20


def _sets(texts, k):
    return distinct_sets(*shingle_hashes(*word_hashes(texts, PUNCTUATION), k))


def _text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def _bit(hashes: np.ndarray):
    spread = mix(hashes + np.uint64(0x2545F491))
    return (spread >> np.uint64(40)).astype(np.int64) % FILTER_WORDS, np.uint64(1) << (spread & np.uint64(63))


def item_table(items: DataFrame, k: int, percent: int) -> DataFrame:
    """(item_id, n_items, n_shingles, size_class, hash, signed): the shingles of each distinct item, as rows.

    An item of n shingles counts as contained when a text holds m = ceil(percent * n / 100) of them. Its MinHash
    signature is its n - m + 1 least hashes (``signed``): a text that holds m of n misses at most n - m, so it holds one
    of these. The signature's length thus follows the size; ``size_class`` is the power of two below the size. Items
    with equal sets are one, led by their smallest id and counted in ``n_items``; items without words are left out.
    """
    small_batches(items.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, SLICE):
                hashes, offsets = _sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([part.column("item_id"), long_lists(hashes, offsets)], names=["item_id", "hashes"])

    sets = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, hashes array<long>")
    sets = sets.filter(F.size("hashes") > 0).groupBy("hashes").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"))
    n = F.size("hashes").cast("long")
    sets = sets.select("item_id", "n_items", n.alias("n_shingles"), F.posexplode("hashes").alias("place", "hash"))
    least = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    # the hashes are in unsigned order, so the first places are the least
    return sets.select("item_id", "n_items", "n_shingles", F.floor(F.log2("n_shingles")).cast("int").alias("size_class"), "hash", (F.col("place") < least).alias("signed"))


def _filter(hashes: DataFrame) -> np.ndarray:
    """One bit for each hash, in a table of fixed size that Spark fills."""
    def run(batches):
        for batch in batches:
            word, bit = _bit(batch.column("hash").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], names=["word", "bits"])

    got = hashes.select("hash").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_WORDS, dtype=np.uint64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table


def _counted(docs: DataFrame, items: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows that may hold an item (doc_id, text_hash, digest, hashes), and for each (doc_id, digest) the items that it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    entries = written(item_table(items, k, percent), slim=True)
    signed = entries.filter("signed")
    classes = signed.groupBy("size_class").agg(F.max(F.expr("shiftrightunsigned(hash, 1)")).alias("cut")).collect()  # at most 63 rows
    cut = max([r["cut"] for r in classes], default=-1) * 2 + 1
    filters = spark.sparkContext.broadcast((_filter(signed), _filter(entries)))  # 2 MB each

    def run(batches):
        first, every = filters.value
        for batch in batches:
            for part in slices(batch, SLICE):
                hashes, offsets = _sets(part.column("text"), k)
                owner = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                low = np.flatnonzero(hashes <= np.uint64(max(cut, 0)))
                word, bit = _bit(hashes[low])
                candidates = np.zeros(part.num_rows, dtype=bool)
                candidates[owner[low[(first[word] & bit) != 0]]] = True
                inside = np.flatnonzero(candidates[owner])
                word, bit = _bit(hashes[inside])
                held = inside[(every[word] & bit) != 0]
                rows = np.flatnonzero(candidates)
                at = np.searchsorted(owner[held], np.append(rows, part.num_rows))
                total = np.zeros(len(hashes) + 1, dtype=np.uint64)
                np.cumsum(hashes, out=total[1:])
                digest = (total[offsets[1:]] - total[offsets[:-1]])[rows].view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows)) for c in ("doc_id", "text_hash")), pa.array(digest), long_lists(hashes[held], at)], names=["doc_id", "text_hash", "digest", "hashes"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_hash().alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, digest long, hashes array<long>")
    found = written(found if cut >= 0 else found.limit(0), slim=True)
    met = found.dropDuplicates(["doc_id", "digest"]).select("doc_id", "digest", F.explode("hashes").alias("hash")).join(entries, "hash")
    counted = met.groupBy("doc_id", "digest", "item_id").agg(F.count(F.lit(1)).alias("hits"), F.max("signed").alias("candidate"), F.first("n_shingles").alias("n_shingles"), F.first("n_items").alias("n_items"))
    return found, counted.filter(F.col("candidate") & (100 * F.col("hits") >= percent * F.col("n_shingles")))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_items, n_shingles, hits, containment): which items of ``items`` (item_id, text) stand in which
    texts of ``docs`` (doc_id, text), by k-word shingles over the whole text.

    Words are runs of letters and digits, A-Z lower-cased; ASCII punctuation and white space separate them. A text of
    fewer than k words has one shingle, its whole sequence. One row for each document and distinct item with
    ``100 * hits >= percent * n_shingles``; item_id is the smallest of the items with equal sets, n_items their number.

    Each size class of items has a cut, its signatures' greatest hash. A document's hashes up to the greatest cut are
    its MinHash side; those are looked up in a filter of the signatures. Documents without any are done. The others give
    out the hashes that pass a filter of all item shingles, and joins with the items' own hashes decide exactly, so
    no pair is lost and none is wrong. Neither side's rows are multiplied: a hot passage adds its own rows only.

    Null or empty texts hold nothing and no item without words is held. Rows repeating a doc_id count as one document
    whose best row decides; null doc_id is a document like others. Empty tables give an empty table. Extra columns are ignored.
    """
    counted = _counted(docs, items, k, percent)[1]
    best = counted.groupBy("doc_id", "item_id").agg(F.max("n_items").alias("n_items"), F.max("n_shingles").alias("n_shingles"), F.max("hits").alias("hits"))
    return best.withColumn("containment", F.round(F.col("hits") / F.col("n_shingles"), 6))


def decontaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose text holds an item. Rows with a null or a repeated doc_id are judged by their own texts."""
    found, counted = _counted(docs, items, k, percent)
    leaks = written(counted.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct(), slim=True)
    held = found.join(leaks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi")
    held = written(held.select(F.col("doc_id").alias("_held"), F.col("text_hash").alias("_hash")).distinct(), slim=True)
    return docs.join(held, F.col("doc_id").cast("long").eqNullSafe(F.col("_held")) & (_text_hash() == F.col("_hash")), "left_anti")
