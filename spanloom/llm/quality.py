"""Text quality by a factorisation machine over hashed words, structure statistics and metadata."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.shared import BLANKS, held_out, mix, slices, small_batches, string_bytes, word_hashes

#: Hashed word features, and the rank of their pairwise interactions.
WORDS, RANK = 1 << 13, 6
#: At most so many labelled rows are learned from, spread over all rows by a hash of the id.
FIT_ROWS = 6000
EPOCHS, STEP, DECAY, BATCH = 8, 0.02, 1e-4, 256
#: Bytes of text that are looked at together.
SLICE = 1 << 19
THRESHOLD = 0.3
STATS = ["chars", "words", "mean_word", "symbols", "digits", "upper", "blanks", "lines", "distinct", "top_word", "marks", "line_repeats", "non_ascii", "long_words", "n_chars", "n_chars_off"]


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


_CLASS = np.zeros(256, dtype=np.uint8)  # 1 letter, 2 upper, 3 digit, 4 blank, 5 line end, 6 sentence mark, 7 other symbol, 8 beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 8 if _b > 127 else 2 if "A" <= _c <= "Z" else 1 if "a" <= _c <= "z" else 3 if _c.isdigit() else 5 if _c == "\n" else 4 if _c.isspace() else 6 if _c in ".,;:!?'\"()-" else 7


def features(texts: pa.Array, n_chars: np.ndarray):
    """Of whole texts: statistics (a row for each text, columns as STATS) and hashed words as (row offsets, index, value).

    A text's word values are log(1 + count), scaled to length 1. ``n_chars`` is the metadata column, nan where null.
    """
    data, offsets = string_bytes(texts)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    kind = _CLASS[data]
    counts = [None] + [_sums(kind == i, offsets) for i in range(1, 9)]
    words, at = word_hashes(texts, BLANKS)
    n_words = np.diff(at)
    some = np.maximum(n_words, 1)
    owner = np.repeat(np.arange(len(n_words)), n_words).astype(np.uint64)
    bucket = (words >> np.uint64(20)) % np.uint64(WORDS)
    both, count = np.unique((owner << np.uint64(32)) | bucket, return_counts=True)
    row = (both >> np.uint64(32)).astype(np.int64)
    index = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.searchsorted(row, np.arange(len(n_words) + 1))
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, weights=value ** 2, minlength=len(n_words)))
    value = value / np.maximum(norm[row], 1e-12)
    top = np.zeros(len(n_words))
    np.maximum.at(top, row, count)
    distinct = np.diff(starts) / some
    # lines that repeat, by a hash of their bytes' running sum
    ends = np.flatnonzero(kind == 5)
    text_of = np.searchsorted(offsets, ends, side="right") - 1
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(7)), out=running[1:])
    begin = np.maximum(offsets[text_of], np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends)
    line = mix(running[ends] - running[begin]) ^ text_of.astype(np.uint64)
    _, seen, repeats = np.unique(line, return_inverse=True, return_counts=True)
    line_repeats = np.bincount(text_of, weights=(repeats[seen] > 1) if len(ends) else None, minlength=len(n_words)) / np.maximum(counts[5], 1)
    chars = np.diff(offsets) - 0.0
    off = np.where(np.isnan(n_chars), -1.0, np.log1p(np.abs(np.nan_to_num(n_chars) - chars)))
    stats = np.column_stack([
        np.log1p(chars), np.log1p(n_words), chars / some / 10, counts[7] / size, counts[3] / size, counts[2] / size, counts[4] / size, np.log1p(counts[5]),
        distinct, top / some, counts[6] / size, line_repeats, counts[8] / size, np.log1p(chars / some), np.log1p(np.nan_to_num(np.maximum(n_chars, 0))), off])
    return stats, starts, index, value


class Machine:
    """bias + weights . x + the sum over pairs of <v_i, v_j> x_i x_j, the latter as half of (sum of v x)^2 - sum of (v x)^2."""

    def __init__(self, size: int, rank: int, seed: int = 7):
        self.bias, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, rank))
        self.memory = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.w, self.v)]
        self.steps = 0

    def raw(self, starts, index, value):
        """Scores of rows given as (row offsets, index, value): linear time in the entries."""
        n = len(starts) - 1
        row = np.repeat(np.arange(n), np.diff(starts))
        linear = np.bincount(row, weights=self.w[index] * value, minlength=n)
        vx = self.v[index] * value[:, None]
        total = np.column_stack([np.bincount(row, weights=vx[:, f], minlength=n) for f in range(vx.shape[1])])
        square = np.bincount(row, weights=(vx ** 2).sum(axis=1), minlength=n)
        return self.bias + linear + 0.5 * ((total ** 2).sum(axis=1) - square), row, vx, total

    def learn(self, starts, index, value, y):
        z, row, vx, total = self.raw(starts, index, value)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        self.bias -= STEP * error.sum() * 10
        used, place = np.unique(index, return_inverse=True)
        scaled = error[row] * value
        gw = np.bincount(place, weights=scaled) + DECAY * self.w[used]
        pull = scaled[:, None] * (total[row] - vx)
        gv = np.column_stack([np.bincount(place, weights=pull[:, f]) for f in range(pull.shape[1])]) + DECAY * self.v[used]
        self.steps += 1
        for x, g, (m, s) in zip((self.w, self.v), (gw, gv), self.memory):
            m[used] = 0.9 * m[used] + 0.1 * g
            s[used] = 0.99 * s[used] + 0.01 * g * g
            x[used] -= STEP * (m[used] / (1 - 0.9 ** self.steps)) / (np.sqrt(s[used] / (1 - 0.99 ** self.steps)) + 1e-8)


def _rows(stats, starts, index, value, mean, spread):
    """Statistics, scaled by what was learned and cut to four spreads, before each row's hashed words."""
    scaled = np.clip((stats - mean) / spread, -4, 4) / 2
    n, k = scaled.shape
    sizes = np.diff(starts) + k
    out = np.concatenate(([0], np.cumsum(sizes)))
    idx, val = np.empty(out[-1], np.int64), np.empty(out[-1])
    lead = (out[:-1, None] + np.arange(k)).ravel()
    idx[lead], val[lead] = np.tile(np.arange(k), n), scaled.ravel()
    rest = np.ones(out[-1], bool)
    rest[lead] = False
    idx[rest], val[rest] = index + k, value
    return out, idx, val


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """The machine learned from labelled rows outside the held-out fold, at most about ``fit_rows`` of them.

    Beyond that number a hash of the id picks the share to learn from. Their features are made by Spark; what comes to
    the driver is bounded by ``fit_rows``, for a document whose row repeats is learned once. Labels that are null are no labels; where an id has several, the least counts.
    """
    small_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).filter("y is not null and doc_id is not null").filter(~held_out())
    total = marks.select("doc_id").distinct().count()
    part = int(min(1.0, fit_rows / max(total, 1)) * (1 << 20))
    marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part).groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("n_chars").cast("double").alias("n_chars")).join(marks, "doc_id")
    # one row for an id, however often it repeats: the least by hash, then text
    one = F.min(F.struct(F.xxhash64("text", "n_chars").alias("h"), "text", "n_chars", "y"))
    rows = rows.groupBy("doc_id").agg(one.alias("x")).select("doc_id", "x.text", "x.n_chars", "x.y")

    def run(batches):
        for batch in batches:
            for x in slices(batch, SLICE):
                stats, starts, index, value = features(x.column("text"), x.column("n_chars").to_numpy(zero_copy_only=False).astype(float))
                cut = pa.array(starts.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [x.column("doc_id"), x.column("y"), pa.array(list(stats), pa.list_(pa.float64())),
                     pa.ListArray.from_arrays(cut, pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(value.astype(np.float32)))],
                    names=["doc_id", "y", "stats", "index", "value"])

    made = rows.mapInArrow(run, "doc_id long, y int, stats array<double>, index array<int>, value array<float>").toArrow().combine_chunks().sort_by("doc_id")
    if not made.num_rows:
        nothing = Machine(len(STATS) + WORDS, RANK)
        nothing.v[:] = 0
        return {"machine": nothing, "mean": np.zeros(len(STATS)), "spread": np.ones(len(STATS))}
    stats = np.array(made.column("stats").to_pylist())
    index, value = (made.column(c).combine_chunks() for c in ("index", "value"))
    starts = np.concatenate(([0], np.cumsum([len(x) for x in index])))
    mean, spread = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    starts, index, value = _rows(stats, starts, index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(float), mean, spread)
    y = made.column("y").to_numpy().astype(float)
    machine, order = Machine(len(STATS) + WORDS, RANK), np.random.default_rng(11)
    machine.bias = float(np.log((y.mean() + 0.01) / (1.01 - y.mean())))
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(y))
        for low in range(0, len(y), BATCH):
            pick = shuffled[low: low + BATCH]
            sizes = starts[pick + 1] - starts[pick]
            cut = np.concatenate(([0], np.cumsum(sizes)))
            flat = np.arange(cut[-1]) + np.repeat(starts[pick] - cut[:-1], sizes)
            machine.learn(cut, index[flat], value[flat], y[pick])
    machine.memory = None
    return {"machine": machine, "mean": mean, "spread": spread}


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text, n_chars): the probability of label 1.

    Inputs of a score are the whole text and n_chars; labels, lang, source and doc_id are none. Null and empty texts
    score by their statistics like any text; null n_chars has a value of its own. Without labels each score is the same.
    Repeated rows have equal scores; an empty table gives an empty table. Extra columns are ignored.
    """
    model = fit(docs, labels, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WORDS * RANK numbers

    def run(batches):
        m = shared.value
        for batch in batches:
            for x in slices(batch, SLICE):
                made = features(x.column("text"), x.column("n_chars").to_numpy(zero_copy_only=False).astype(float))
                z = m["machine"].raw(*_rows(*made, m["mean"], m["spread"]))[0]
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("n_chars").cast("double").alias("n_chars"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
