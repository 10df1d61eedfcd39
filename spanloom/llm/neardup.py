"""Near-duplicate documents: MinHash signatures joined within a Hamming distance, links confirmed on the full sets."""
from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.components import components
from spanloom.llm.shared import BLANKS, distinct_sets, long_lists, mix, shingle_hashes, slices, small_batches, word_hashes, written

#: Symbols of a signature, of 16 bits each.
SYMBOLS = 96
#: Errors that a chunk of the signature may hold; each way to place them is one key.
CHUNK_ERRORS = 1
#: Standard deviations between the mean distance of a pair at the threshold and the distance that is still searched.
MARGIN = 5.0
#: Shingles of all sets that one task compares, or of each of two blocks that it compares.
GROUP = 1 << 20
#: Signatures whose keys one task makes.
KEYED = 5000
#: Bytes of text that are looked at together.
SLICE = 2 << 20


def search_distance(percent: int, symbols: int = SYMBOLS, margin: float = MARGIN) -> int:
    """The number of differing symbols up to which all pairs are found.

    Symbols of a pair with similarity s differ with probability 1 - s each. At the threshold a pair lies beyond the
    returned distance with a probability of about 1e-6 or less; more similar pairs still more rarely.
    """
    miss = 1 - percent / 100
    return min(symbols - 1, math.ceil(symbols * miss + margin * math.sqrt(symbols * miss * (1 - miss))))


def chunk_keys(symbols: int, distance: int, errors: int = CHUNK_ERRORS) -> list[tuple[int, ...]]:
    """The symbol positions of every key.

    By pigeonhole, two signatures that differ in at most ``distance`` symbols have a chunk with at most ``errors`` of
    them if there are more than distance / (errors + 1) chunks. Such a pair agrees on that chunk without some ``errors``
    positions, so the keys are the chunks with each choice of that many positions left out.
    """
    chunks = distance // (errors + 1) + 1
    bounds = [round(i * symbols / chunks) for i in range(chunks + 1)]
    keys = []
    for low, high in zip(bounds, bounds[1:]):
        left_out = min(errors, high - low - 1)
        keys += [tuple(p for p in range(low, high) if p not in gone) for gone in combinations(range(low, high), left_out)]
    return keys


def signatures(hashes: np.ndarray, offsets: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """One row of 16-bit symbols for each set: middle bits of the set's least hash under each of ``symbols`` orders."""
    factors = mix(np.arange(1, symbols + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros((len(offsets) - 1, symbols), dtype=np.uint16)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        starts = offsets[:-1][full]
        for i in range(symbols):
            out[full, i] = (np.minimum.reduceat(hashes * factors[i], starts) >> np.uint64(24)).astype(np.uint16)
    return out


def _digest(hashes, offsets, seed):
    """Order-free 64-bit digest of each set, for telling equal sets."""
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(seed)), out=total[1:])
    return mix(total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def _sets(texts: pa.Array, k: int):
    return distinct_sets(*shingle_hashes(*word_hashes(texts, BLANKS), k))


def text_hash():
    """With the doc_id, null or not, it names a row; rows of both alike are copies in everything that is compared."""
    return F.xxhash64("text").alias("text_hash")


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, h1, h2, signature): size and digest of each row's shingle set, and its signature."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, SLICE):
                hashes, offsets = _sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(np.diff(offsets).astype(np.int64)), *(pa.array(_digest(hashes, offsets, i)) for i in (1, 2)),
                     pa.array([s.tobytes() for s in signatures(hashes, offsets)], pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "signature"])

    return docs.select("doc_id", text_hash(), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, signature binary")


#: Words of 64 bits of a row filter, 64 MB at most, and the rows that this serves well; beyond them rows are joined instead.
FILTER_WORDS, FILTER_ROWS = 1 << 23, 1 << 25


def row_key():
    """A number for a row's name."""
    return F.xxhash64("doc_id", "text_hash").alias("row_key")


def row_filter(rows: DataFrame, n: int) -> np.ndarray:
    """Two bits of one word for each of ``n`` ``rows`` (doc_id, text_hash), 16 bits and more a row; its size follows ``n`` up to ``FILTER_WORDS``."""
    words = min(FILTER_WORDS, 1 << max(10, (n // 4).bit_length()))
    h = F.col("row_key")
    one = F.lit(1).cast("long")
    bits = F.expr("shiftleft(1L, cast(row_key & 63 as int)) | shiftleft(1L, cast(shiftright(row_key, 6) & 63 as int))")
    made = rows.select(row_key()).groupBy(F.pmod(F.shiftrightunsigned(h, 20), one * words).alias("word")).agg(F.bit_or(bits).alias("bits")).toArrow()
    table = np.zeros(words, dtype=np.uint64)
    table[made.column("word").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
    return table


def passing(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which row numbers the filter lets through: all that it was made from, and few others."""
    h = rows.view(np.uint64)
    bits = (np.uint64(1) << (h & np.uint64(63))) | (np.uint64(1) << ((h >> np.uint64(6)) & np.uint64(63)))
    word = (h >> np.uint64(20)) % np.uint64(len(table))
    return (table[word.astype(np.int64)] & bits) == bits


def shingle_sets(docs: DataFrame, k: int, chosen: DataFrame) -> DataFrame:
    """(h1, shingles): the sets, as sorted 64-bit hashes, and digests of the rows of ``docs`` that ``chosen`` (doc_id, text_hash) names, and
    of a few others that a filter of its rows lets through. So no text is shuffled to find them."""
    small_batches(docs.sparkSession)
    n = chosen.count()
    if n > FILTER_ROWS:
        docs, table = named(docs, chosen, "left_semi"), None
    else:
        table = docs.sparkSession.sparkContext.broadcast(row_filter(chosen, n))

    def run(batches):
        for batch in batches:
            if table is not None:
                batch = batch.filter(pa.array(passing(table.value, batch.column("row_key").to_numpy())))
            for part in slices(batch, SLICE):
                hashes, offsets = _sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([pa.array(_digest(hashes, offsets, 1)), long_lists(hashes, offsets)], names=["h1", "shingles"])

    return docs.select("doc_id", "text", text_hash()).select("text", row_key()).mapInArrow(run, "h1 long, shingles array<long>")


WORDS = [f"d{i}" for i in range(SYMBOLS // 8)]


def key_rows(leaders: DataFrame, percent: int) -> DataFrame:
    """(key, id): the 64-bit value of every key of every signature."""
    positions = chunk_keys(SYMBOLS, search_distance(percent))

    def run(batches):
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1).astype(np.uint64)
            ids = batch.column("id")
            for i, places in enumerate(positions):
                acc = np.full(batch.num_rows, i + 1, dtype=np.uint64)
                for p in places:
                    acc = mix(acc) + wide[:, p]
                yield pa.RecordBatch.from_arrays([pa.array(mix(acc).view(np.int64)), ids], names=["key", "id"])

    return leaders.select("id", "signature").mapInArrow(run, "key long, id long")


def packed(leaders: DataFrame) -> DataFrame:
    """(id, n, d0, d1, ...): the low byte of each symbol, eight in a long, for comparing signatures in a join's condition."""
    def run(batches):
        for batch in batches:
            low = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1).astype(np.uint8)
            longs = np.ascontiguousarray(low).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), *(pa.array(np.ascontiguousarray(longs[:, i])) for i in range(len(WORDS)))], names=["id", "n", *WORDS])

    return leaders.select("id", "n", "signature").mapInArrow(run, "id long, n long, " + ", ".join(f"{w} long" for w in WORDS))


def differing(x: str, y: str) -> str:
    """SQL for the number of differing symbols of two packed signatures: of each byte of the XOR, any bit set counts once."""
    def one(w):
        a = f"({x}.{w} ^ {y}.{w})"
        b = f"({a} | shiftrightunsigned({a} & {_BYTE_HIGH}, 4))"
        c = f"({b} | shiftrightunsigned({b} & {_BYTE_MID}, 2))"
        return f"bit_count(({c} | shiftrightunsigned({c} & {_BYTE_LOW}, 1)) & {_BYTE_ONE})"
    return " + ".join(one(w) for w in WORDS)


def _long(byte: int) -> str:
    value = int.from_bytes(bytes([byte]) * 8, "little", signed=False)
    return f"{value - (1 << 64) if value >> 63 else value}L"


_BYTE_HIGH, _BYTE_MID, _BYTE_LOW, _BYTE_ONE = (_long(x) for x in (0xF0, 0x0C, 0x02, 0x01))


def spanning_links(sizes: np.ndarray, flat: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (positions) that join the sets into the same components as all links would; ``flat`` holds the sets in a row.

    Breadth first: each set is compared, on full sets and all at once, with those not reached yet. Sets reached earlier
    are in its own component or were compared with it from there, so each pair is linked, refuted or known to be joined.
    """
    vocabulary, flat = np.unique(flat, return_inverse=True)
    left = np.arange(len(sizes))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    own = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    held, starts = flat, offsets[:-1]
    mark, alive, links, queue = np.zeros(len(vocabulary), np.int32), np.ones(len(sizes), bool), [], []
    while alive.any() or queue:
        if not queue:
            first = int(np.flatnonzero(alive)[0])
            alive[first] = False
            queue.append(first)
        at = queue.pop()
        if alive[left].sum() * 2 < len(left):  # forget what was reached
            left = np.flatnonzero(alive)
            held = np.concatenate([own[i] for i in left]) if len(left) else flat[:0]
            starts = np.concatenate(([0], np.cumsum(sizes[left])[:-1])) if len(left) else left
        if not len(left):
            continue
        mark[own[at]] = 1
        both = np.add.reduceat(mark[held], starts)
        mark[own[at]] = 0
        for i in left[alive[left] & (100 * both >= percent * (sizes[left] + sizes[at] - both))].tolist():
            alive[i] = False
            links.append((at, i))
            queue.append(i)
    return links


def confirmed(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the members (hub, id) of each group as all their links would, on the full sets (id, shingles).

    A group of more than ``GROUP`` shingles is cut into blocks by a hash of the id, and each pair of blocks is a task of
    its own; so no task grows with a group, and only links that join something are given out.
    """
    sized = members.join(sets.select("id", F.size("shingles").cast("long").alias("n")), "id")
    blocks = written(sized.groupBy("hub").agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("blocks")), slim=True)
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = members.join(blocks, "hub").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("hub", "id", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, sets = rows["id"].to_numpy(), rows["shingles"].tolist()
        links = spanning_links(np.array([len(s) for s in sets]), np.concatenate(sets), percent) if len(ids) > 1 else []
        return pd.DataFrame([(ids[i], ids[j]) for i, j in links], columns=["a", "b"], dtype="int64")

    return dealt.join(sets, "id").groupBy("hub", "low", "high").applyInPandas(run, "a long, b long")


def near_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, top) for each row of ``docs``: top (none, doc_id, text_hash) names the row that leads
    the group of near-duplicate texts, the one with the smallest doc_id, then hash; it is null where a text is alone.

    1. Equal sets become one class, whatever their doc_ids; its digest h1 is its id.
    2. Each class's signature gives its keys (``chunk_keys``); two signatures within the distance share a key. Keys that
       one class alone holds are dropped, then classes without a partner within the distance in any of their buckets:
       a semi join that stops at the first partner.
    3. For the others the full sets are built, from one row of each class. A bucket's group is named by its smallest id, so
       the buckets of a family of copies fall into a few groups instead of one for each key.
    4. In each group, cut into blocks where it is large, each set is compared on full sets with all that are not yet
       joined with it (``spanning_links``). So each pair within the distance is confirmed, refuted, or known to be in one
       component, and no pairs of a group are emitted, only links that join something.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    distance = search_distance(percent)
    table = written(set_table(docs, k))
    same = ["h1", "h2", "n_shingles"]
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    full = table.filter("n_shingles > 0").groupBy(*same)
    classes = written(full.agg(F.min(row).alias("lead"), F.count(F.lit(1)).alias("members"), F.first("signature").alias("signature")).withColumn("id", F.col("h1")))
    leaders = classes.select("id", F.col("n_shingles").alias("n"), "signature")
    # the keys are many times the rows, so tasks are cut by rows, not by the bytes of the signatures
    leaders = written(leaders.repartition(max(1, classes.count() // KEYED), "id"))
    # the keys are exchanged once: a key's least and greatest id tell, where it lies, whether it is shared
    same_key = Window.partitionBy("key")
    keys = key_rows(leaders, percent).withColumns({"low": F.min("id").over(same_key), "high": F.max("id").over(same_key)})
    shared = written(keys.filter("low < high").select("key", "id"))
    rows = written(shared.join(packed(leaders), "id"))
    near = f"x.key = y.key and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {differing('x', 'y')} <= {distance}"
    paired = written(rows.alias("x").join(rows.alias("y"), F.expr(near + " and x.id <> y.id"), "left_semi"))
    chosen = written(classes.join(paired.select("id").distinct(), "id", "left_semi").select("lead.*"), slim=True)
    sets = shingle_sets(docs, k, chosen)
    sets = written(sets.groupBy(F.col("h1").alias("id")).agg(F.first("shingles").alias("shingles")))
    hubs = paired.groupBy("key").agg(F.min("id").alias("hub"))
    members = written(paired.select("key", "id").join(written(hubs, slim=True), "key").select("hub", "id").distinct(), slim=True)
    labels = components(written(confirmed(members, sets, percent), slim=True))
    several = classes.drop("signature").join(labels, "id", "left").filter("members > 1 or label is not null").withColumn("label", F.coalesce("label", "id"))
    several = written(several, slim=True)
    tops = written(several.groupBy("label").agg(F.min("lead").alias("top")), slim=True)
    grouped = written(several.join(tops, "label").select(*same, "top"), slim=True)
    return table.select("doc_id", "text_hash", *same).join(grouped, same, "left").select("doc_id", "text_hash", "n_shingles", "top")


def named(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` (doc_id, text, ...) joined with ``rows`` (doc_id, text_hash, ...) by the name of a row; null ids are equal."""
    rows = rows.drop("none").withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    met = docs.join(rows, docs["doc_id"].eqNullSafe(rows["_id"]) & (F.xxhash64(docs["text"]) == rows["_hash"]), how)
    return met.drop("_id", "_hash")


def may_be_named(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: those that ``rows`` (doc_id, text_hash) may name, by a filter of its rows, and those it does not name.
    So a join with few rows shuffles few texts. Beyond ``FILTER_ROWS`` rows all of ``docs`` may be named."""
    n = rows.count()
    if n > FILTER_ROWS:
        return docs, docs.limit(0)
    table = docs.sparkSession.sparkContext.broadcast(row_filter(rows, n))

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        return pd.Series(passing(table.value, keys.to_numpy()))

    keyed = docs.withColumn("_maybe", hit(F.xxhash64("doc_id", F.xxhash64("text"))))
    return keyed.filter("_maybe").drop("_maybe"), keyed.filter("not _maybe").drop("_maybe")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text): groups of near-duplicate texts.

    Texts are linked when 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles (A-Z lower-cased, words
    between blanks, whole texts), by the steps of ``near_rows``. ``component_id`` is the smallest doc_id that links reach,
    ``kept`` marks that document.

    Null text, a text without words: empty set, linked with nothing, kept. A null doc_id groups with the other texts but
    names no group; one of null ids alone has none. Rows that repeat a doc_id with one text are copies of each other;
    where its texts differ, each is grouped by itself. Ids decide all ties. Extra columns are ignored. An empty table
    gives an empty table.
    """
    own = F.coalesce("top.doc_id", "doc_id")
    return near_rows(docs, k, percent).select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))
