"""Shards of equal bytes by histogram sort: probes are counted and refined until splitters stand, then rows move once."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.llm.shared import written

#: Probes for each interval of a round.
PROBES = 256
#: A splitter stands when it is off by at most this part of a shard's bytes.
TOLERANCE = 0.002
#: Rows that one task numbers.
CELL_ROWS = 20_000
#: Ranges into which a cell is divided at most, and sampled keys for each.
MOST_PARTS, STEP = 1024, 32
#: The parts of a key: hash of the text, doc_id, number of the row.
PARTS = ("h", "i", "r")
LEAST_ID = -(1 << 63)


@dataclass(frozen=True)
class Interval:
    """Keys that may hold a splitter: those with the leading parts ``at`` whose next part lies in low..high."""
    low: int
    high: int
    below: int
    at: tuple[int, ...] = ()


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def hash_of(text: Column) -> Column:
    """63 bits of the text's hash: equal texts are neighbours in key order, and hashes are spread evenly."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND((1 << 63) - 1)


def id_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LEAST_ID))


def _cell(interval: Interval) -> Column:
    """The probe cell of a key in its interval; it never falls as the key rises."""
    part = F.col(PARTS[len(interval.at)])
    if not interval.at:
        width = (interval.high - interval.low) // PROBES + 1
        return F.floor((part - interval.low) / width) if width < 1 << 40 else F.shiftright(part - interval.low, max(0, width.bit_length() - 1))
    width = (interval.high - interval.low) / PROBES
    return F.floor((part.cast("decimal(20,0)") - interval.low).cast("double") / (width or 1.0)).cast("long")


def _inside(interval: Interval) -> Column:
    inside = F.col(PARTS[len(interval.at)]).between(interval.low, interval.high)
    for part, value in zip(PARTS, interval.at):
        inside &= F.col(part) == value
    return inside


def _from(edge: tuple[int, ...]) -> Column:
    """Whether a key stands at the edge or after it; an edge of fewer parts stands before all keys that begin with them."""
    after = F.lit(True)
    for part, value in reversed(list(zip(PARTS, edge))):
        after = (F.col(part) > value) | ((F.col(part) == value) & after)
    return after


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """The least key of shards 1, 2, ... such that the bytes below each are near its share of all bytes.

    ``keys`` has size and the key's parts, h, i and r (or h and i). Each round counts the exact bytes in ``PROBES`` cells
    of every interval that may still hold a splitter (at most shards - 1 intervals, so the driver gets a bounded table), with
    each cell's least and greatest key; the cell around a target is its next interval. A hash that alone holds too much is
    divided by ids, an id by rows. Ends when a cell's edge is within the tolerance or the cell is a single key; then the nearer
    edge is taken. Ties go to the lower edge. A splitter gives as many parts of the key as it needs.
    """
    parts = [x for x in PARTS if x in keys.columns]
    whole = keys.agg(F.sum("size").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")).first()
    if not whole["bytes"]:
        return []
    total = whole["bytes"]
    slack = tolerance * total / shards
    open_ = {n: Interval(whole["low"], whole["high"], 0) for n in range(1, shards)}
    done: dict[int, tuple[int, ...]] = {}
    while open_:
        intervals = sorted(set(open_.values()), key=lambda x: (x.at, x.low, x.high))
        chosen = [F.when(_inside(x), F.struct(F.lit(n).alias("n"), _cell(x).cast("long").alias("cell"))) for n, x in enumerate(intervals)]
        rows = keys.select(F.explode(F.array_compact(F.array(*chosen))).alias("c"), *parts, "size")
        counted = rows.groupBy("c.n", "c.cell").agg(F.sum("size").alias("bytes"), *[f(x).alias(a + x) for x in parts for f, a in ((F.min, "low_"), (F.max, "high_"))]).collect()
        cells = {n: sorted((r for r in counted if r["n"] == n), key=lambda r: r["cell"]) for n in range(len(intervals))}
        for target, interval in list(open_.items()):
            want, below = total * target / shards, interval.below
            for r in cells[intervals.index(interval)]:
                if below + r["bytes"] >= want:
                    break
                below += r["bytes"]
            above = below + r["bytes"]
            level = len(interval.at)
            low, high = r["low_" + parts[level]], r["high_" + parts[level]]
            # the lower edge is the cell's least key, the upper edge the first key after its greatest
            edges = (*interval.at, low), (*interval.at, high + 1)
            if all(r["low_" + x] == r["high_" + x] for x in parts[level:]) or min(want - below, above - want) <= slack:
                done[target] = edges[0] if want - below <= above - want else edges[1]
                del open_[target]
            elif low == high:
                open_[target] = Interval(r["low_" + parts[level + 1]], r["high_" + parts[level + 1]], below, edges[0])
            else:
                open_[target] = Interval(low, high, below, interval.at)
    return [done[n] for n in sorted(done)]


def _bounds(placed: DataFrame, cell_rows: int) -> DataFrame:
    """(shard, cell, bounds): keys that divide each cell of more than twice ``cell_rows`` rows into ranges of about
    ``cell_rows``, or ``MOST_PARTS`` ranges of what it holds. Every ``STEP``-th key of an even sample is a bound, so a
    list holds some ``MOST_PARTS`` keys at most."""
    full = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * cell_rows)
    every = F.greatest(F.lit(max(1, cell_rows // STEP)).cast("long"), F.floor(F.col("n") / (STEP * MOST_PARTS)))
    full = written(full.select("shard", "cell", every.alias("every")), slim=True)
    drawn = placed.join(full, ["shard", "cell"]).filter(F.pmod(F.xxhash64("r"), F.col("every")) == 0)
    keys = drawn.groupBy("shard", "cell").agg(F.array_sort(F.collect_list(F.struct(*PARTS))).alias("keys"))
    return keys.select("shard", "cell", F.filter("keys", lambda _, n: n % STEP == STEP - 1).alias("bounds"))


def _part() -> Column:
    """How many of a row's ``bounds`` (in order, or null) are not above its key, by halving."""
    key = F.struct(*PARTS)
    steps = F.array(*[F.lit(1 << n) for n in reversed(range((2 * MOST_PARTS).bit_length()))])
    reach = lambda n, step: (n + step <= F.size("bounds")) & (F.get("bounds", n + step - 1) <= key)
    return F.when(F.col("bounds").isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), lambda n, step: F.when(reach(n, step), n + step).otherwise(n)))


def sharded(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE, cell_rows: int = CELL_ROWS, keep_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) with size, text_crc32, law, shard, slot and grown_shard: law ``bytes``, the shards
    hold near equal bytes of text plus one for each row. Without ``keep_text`` the text is left out.

    Rows are in order of (hash of the text, doc_id), and slots follow that order: equal texts are together, in one shard
    unless a splitter must divide them. Rows are written once with their number there, by which equal keys are told
    apart; their slim keys are counted in rounds (see ``splitters``). Then each row moves once, to the task that numbers its cell:
    a range of hashes of about ``cell_rows`` rows, divided at keys inside (see ``_bounds``) where a text holds more.
    Slots run on from cell to cell, so they are gapless in a shard and need no task that sees all of it.

    Null text: no bytes, size 1, crc32 of the empty text. Null doc_id comes first within its text. Rows that repeat are rows
    of their own, which a splitter may divide; they stand together in either order. Fewer rows than shards leave shards
    empty; an empty table gives an empty table. Columns of the six names in ``docs`` are replaced.
    """
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    text = F.col("text").cast("string")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if keep_text or c.lower() != "text"])
    rows = written(docs.select(own.alias("row"), size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
                               hash_of(text).alias("h"), id_of("doc_id").alias("i"), F.monotonically_increasing_id().alias("r")))
    keys = rows.select(*PARTS, "size")
    edges = splitters(keys, shards, tolerance)
    cells = max(1, keys.count() // cell_rows)
    cell = F.shiftright("h", 63 - (cells - 1).bit_length()) if cells > 1 else F.lit(0).cast("long")
    shard = sum((_from(edge).cast("int") for edge in edges), F.lit(0))
    placed = rows.withColumns({"shard": shard, "cell": cell})
    bounds = written(_bounds(placed.select("shard", "cell", *PARTS), cell_rows), slim=True)
    divided = placed.join(bounds, ["shard", "cell"], "left").withColumn("part", _part()).drop("bounds")
    sizes = divided.groupBy("shard", "cell", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("cell", "part").rowsBetween(W.unboundedPreceding, -1)
    first = written(sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n"), slim=True)
    place = F.row_number().over(W.partitionBy("shard", "cell", "part").orderBy(*PARTS))
    numbered = divided.withColumn("place", place).join(first, ["shard", "cell", "part"])
    return numbered.select("row.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                           (F.col("first") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """The rows as one folder for each shard, ordered by slot within files; each file holds a range of slots."""
    done = sharded(docs, shards)
    piece = F.floor(F.col("slot") / CELL_ROWS)
    done.withColumn("_piece", piece).repartition("shard", "_piece").sortWithinPartitions("shard", "slot").drop("_piece").write.partitionBy("shard").mode("errorifexists").parquet(path)
