"""What the operators of this subpackage share: written tables and hashes of words and shingles."""
from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Whole texts and vectors pass in batches, so a batch of long texts stays small.
BATCH_ROWS = 500
#: Bytes hashed at a time; the working arrays hold eight bytes for each.
BLOCK = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local session that names none (a test) gets one of its own.

    On a cluster executors do not see each other's folders, so a session there that names none raises an error."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, slim: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors, prunes columns on later reads.

    A ``slim`` table, small beside what it was made from, is rebalanced first: adaptive execution then writes few files of
    a fair size, whose number follows the rows, where each task of the last stage would write a tiny one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spanloom-{uuid.uuid4().hex}"
    out = df.hint("rebalance") if slim else df
    out.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch in this session; a smaller bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def held_out(doc_id: str = "doc_id"):
    """The fold that no model learns from: crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (shift, multiply, shift), so that near values spread over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fold_table(separators: bytes) -> np.ndarray:
    """Byte to byte: separators become blanks, A-Z become a-z, all else stays."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 32
    return table


BLANKS = fold_table(bytes([32, *range(9, 14)]))
#: Everything in ASCII that is no letter or digit separates words.
PUNCTUATION = fold_table(bytes(b for b in range(128) if not chr(b).isalnum()))

_BASE, _SEED = np.uint64(0x9E3779B97F4A7C15), 20240229
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SYMBOLS = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    have = _powers.get(name)
    if have is None or len(have) <= n:
        steps = np.full(max(n, BLOCK) + 1, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, from one running polynomial sum."""
    up = _power("up", _BASE, len(data))
    down = _power("down", _INVERSE, len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_SYMBOLS[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column in a row, and where each begins; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, most: int, column: str = "text"):
    """Slices of a batch of at most ``most`` bytes of text each, or one row."""
    ends = string_bytes(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def word_hashes(column: pa.Array, table: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's words begin.

    Words are the stretches between separators of ``table``. The bytes are hashed in blocks that end between words, so
    the working memory does not grow with a very long text.
    """
    data, offsets = string_bytes(column)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    folded = table[data]
    inside = folded != 32
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[offsets < n]] = True
    begins = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | first[1:n])))
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:] | first[1:n], [True]))) + 1
    parts, at = [], 0
    while at < len(begins):
        upto = max(at + 1, int(np.searchsorted(ends, begins[at] + BLOCK, side="right")))
        low = begins[at]
        parts.append(_hash_spans(folded[low: ends[upto - 1]], begins[at:upto] - low, ends[at:upto] - low))
        at = upto
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(begins, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all texts in a row (with repeats), and where each text's begin.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    counts = np.diff(offsets)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=out[1:])
    total = int(out[-1])
    if not total:
        return np.zeros(0, np.uint64), out
    factors = mix(np.arange(1, k + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    lead = np.arange(total) - np.repeat(out[:-1] - offsets[:-1], sizes)
    length = np.minimum(np.repeat(counts, sizes), k)
    acc = length.astype(np.uint64) * _BASE
    top = len(words) - 1
    for i in range(k):
        acc += np.where(i < length, mix(words[np.minimum(lead + i, top)] * factors[i]), np.uint64(0))
    return mix(acc), out


def distinct_sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted and without repeats."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    out = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=out[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), out


def long_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow column of lists of 64-bit integers."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
