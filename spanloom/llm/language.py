"""Language identification with n-gram filters whose slots hold one bit for each language."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.shared import held_out, mix, slices, small_batches, string_bytes

#: Slots of the filter (a power of two) and slots per n-gram.
SLOTS, PROBES = 1 << 20, 3
#: Bytes of an n-gram.
GRAM = 4
#: About so many labelled rows are learned from at most, dealt to the languages and spread over each one's rows by a hash.
FIT_ROWS = 40_000
#: An n-gram belongs to a language if its rate there is at least this part of its highest rate in any language ...
SHARE = 0.3
#: ... and it was seen there so many times.
SEEN = 3
#: Bytes of text that are looked at together; the working arrays hold some 50 bytes for each.
SLICE = 1 << 19
#: A slot is one 64-bit word, so a filter holds this many languages.
LANGUAGES = 63

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def _grams(texts: pa.Array):
    """All GRAM-byte windows of the lower-cased texts as one 32-bit number each, and where each text's begin.

    Everything in ASCII that is no letter counts as a blank; windows with two blanks in a row are left out.
    """
    data, offsets = string_bytes(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())))
    sizes = np.diff(offsets)
    # a blank stands before and after each text
    padded = np.full(len(data) + 2 * len(sizes), 32, dtype=np.uint8)
    shift = np.repeat(2 * np.arange(len(sizes)) + 1, sizes)
    padded[np.arange(len(data)) + shift] = _FOLD[data]
    starts = offsets[:-1] + 2 * np.arange(len(sizes))
    blank = padded == 32
    good = np.concatenate(([True], ~(blank[1:] & blank[:-1])))
    text_of = np.repeat(np.arange(len(sizes)), sizes + 2)
    padded, text_of = padded[good], text_of[good]
    n = len(padded) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(starts) + 1, np.int64)
    grams = np.zeros(n, dtype=np.uint32)
    for i in range(GRAM):
        grams = (grams << np.uint32(8)) | padded[i: i + n]
    inside = text_of[:n] == text_of[GRAM - 1:]
    grams, text_of = grams[inside], text_of[:n][inside]
    return grams, np.searchsorted(text_of, np.arange(len(starts) + 1))


def _places(grams: np.ndarray):
    """The slots of each n-gram."""
    h = mix(grams.astype(np.uint64) + np.uint64(0x51ED27))
    return [((h >> np.uint64(20 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]


def shares(sizes: dict, most: int) -> dict:
    """The part of each language's rows that is learned from: all of a small one, and equal numbers of rows of the others,
    about ``most`` in all. So a language keeps an equal part of ``most`` or all its rows, however many rows others have."""
    out, left = {}, most
    for i, lang in enumerate(sorted(sizes, key=sizes.get)):
        out[lang] = min(1.0, left / (len(sizes) - i) / sizes[lang])
        left -= out[lang] * sizes[lang]
    return out


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """The filter learned from ``docs`` (doc_id, text, lang): {"langs", "slots", "rates"}.

    Learns from rows with a language outside the held-out fold; beyond ``fit_rows`` of them, from a share of each
    language's rows (``shares``) that a hash of id and text picks. N-grams are counted per language by Spark; those that belong to a language set its
    bit in their slots; the slots, whose number is fixed, come to the driver. Languages are the learned values in order;
    more than ``LANGUAGES`` raise an error. Null languages and texts teach nothing.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null").filter(~held_out())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"a filter holds {LANGUAGES} languages, the labels have more")
    langs, total = sorted(sizes), sum(sizes.values())
    if total > fit_rows:
        parts = F.create_map(*[F.lit(x) for lang, part in shares(sizes, fit_rows).items() for x in (lang, math.ceil(part * (1 << 40)))])
        # a null id, or one that repeats, is told apart by the text
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.element_at(parts, F.col("lang")))

    def count(batches):
        held, number = {}, 0
        for batch in batches:
            for part in slices(batch, SLICE):
                grams, offsets = _grams(part.column("text"))
                names = np.asarray(part.column("lang").to_pylist(), dtype=object)
                owner = np.repeat(np.searchsorted(langs, names.astype(str)), np.diff(offsets)).astype(np.uint64)
                both, n = np.unique((owner << np.uint64(32)) | grams, return_counts=True)
                held[number], number = (both, n), number + 1
                if number >= 16:
                    held, number = {0: _summed(held)}, 1
        if held:
            both, n = _summed(held)
            yield pa.RecordBatch.from_arrays([pa.array((both >> np.uint64(32)).astype(np.int32)), pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], names=["l", "gram", "n"])

    counts = rows.select("text", "lang").mapInArrow(count, "l int, gram long, n long").groupBy("gram", "l").agg(F.sum("n").alias("n"))
    gathered = counts.groupBy("gram").agg(F.collect_list(F.struct("l", "n")).alias("seen"))  # at most one entry for each language
    all_n = {r["l"]: r["n"] for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()} if langs else {}
    if not all_n:
        return {"langs": [], "slots": np.zeros(SLOTS, np.uint64), "rates": np.zeros(0)}
    totals = F.create_map(*[F.lit(x) for pair in all_n.items() for x in pair])
    rated = F.transform("seen", lambda s: F.struct(s["l"].alias("l"), s["n"].alias("n"), (s["n"] / F.element_at(totals, s["l"])).alias("rate")))
    best = F.array_max(F.transform("rated", lambda s: s["rate"]))
    own = F.filter("rated", lambda s: (s["n"] >= SEEN) & (s["rate"] >= SHARE * F.col("best")))
    mask = F.aggregate(own, F.lit(0).cast("long"), lambda acc, s: acc.bitwiseOR(F.element_at(_bits(len(langs)), s["l"] + 1)))
    masks = gathered.withColumn("rated", rated).withColumn("best", best).select("gram", mask.alias("mask")).filter("mask <> 0")

    def slots(batches):
        for batch in batches:
            grams = batch.column("gram").to_numpy().astype(np.uint32)
            for place in _places(grams):
                yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("mask")], names=["slot", "mask"])

    filled = masks.mapInArrow(slots, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(SLOTS, dtype=np.uint64)
    table[filled.column("slot").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(table & np.uint64(1 << i)) for i in range(len(langs))]) / SLOTS
    return {"langs": langs, "slots": table, "rates": fill ** PROBES}


def _bits(n):
    return F.array(*[F.lit(1 << i).cast("long") for i in range(n)])


def _summed(held):
    both = np.concatenate([h[0] for h in held.values()])
    n = np.concatenate([h[1] for h in held.values()])
    keys, inverse = np.unique(both, return_inverse=True)
    return keys, np.bincount(inverse, weights=n).astype(np.int64)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred, score and known: the language of each whole text by its n-grams alone.

    The AND of an n-gram's slots has the bits of all languages that hold it. A language's hits are the n-grams with its
    bit; ``(hits - n * f) / (1 - f)`` takes out the expected false positives at the filter's rate f. The highest share
    wins (a tie goes to the first language in order); ``score`` is its part of all languages' corrected hits and
    ``known`` the part of the text's n-grams that it holds. A null text, one without a letter, or a model without
    languages gives ``und``, 0 and 0; so does a text of which no language holds an n-gram, unless it has a letter: then
    the first language with score 0. Columns of these names that ``docs`` has already are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("lang_pred", "score", "known")
    shared = spark.sparkContext.broadcast((model["slots"], model["langs"], model["rates"]))  # SLOTS * 8 bytes, whatever the corpus
    out = T.StructType(docs.schema.fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())])

    def run(batches):
        slots, langs, rates = shared.value
        for batch in batches:
            for part in slices(batch, SLICE):
                texts = part.column("text")
                grams, offsets = _grams(texts)
                n = np.diff(offsets)
                masks = np.full(len(grams), (1 << 64) - 1, dtype=np.uint64)
                for place in _places(grams):
                    masks &= slots[place]
                got = np.zeros((len(langs), len(n)))
                for i, f in enumerate(rates):
                    hits = np.zeros(len(grams) + 1, dtype=np.int64)
                    np.cumsum((masks >> np.uint64(i)) & np.uint64(1), out=hits[1:])
                    got[i] = np.maximum(0, (hits[offsets[1:]] - hits[offsets[:-1]] - n * f) / (1 - f))
                lettered = pc.match_substring_regex(texts.fill_null(""), r"\pL").to_numpy(zero_copy_only=False)
                best = got.argmax(axis=0) if len(langs) else np.zeros(len(n), int)
                top = got[best, np.arange(len(n))] if len(langs) else np.zeros(len(n))
                score = np.where(lettered, np.minimum(1, top / np.maximum(got.sum(axis=0), 1e-9)) if len(langs) else 0, 0)
                known = np.where(lettered, np.minimum(1, top / np.maximum(n, 1)), 0)
                named = [langs[b] if ok and langs else "und" for b, ok in zip(best, lettered)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], names=out.names)

    return docs.mapInArrow(run, out)


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with held_out, lang_pred, score and known; learned as ``fit`` says.

    An empty table gives an empty table. ``lang`` is read for learning only.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    model = fit(docs, fit_rows)
    return predict(docs, model).withColumn("held_out", held_out())
