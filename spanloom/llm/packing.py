"""Packing token sequences: best fit in cells, then a swap-based local search that empties underfull bins."""
from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import small_batches, written

#: Pieces that one task packs together. Cells are what is packed at once; their number follows the data.
CELL = 6000
#: Words that a Python worker remembers with their ids before it starts anew.
REMEMBERED = 1_600_000
#: A word of its own in the vocabulary, put between words that are encoded together.
BETWEEN = "|"
END = 0


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, the ids that end a run of letters or marks, and the words remembered so far."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(max(tokenizer.get_vocab().values()) + 1, dtype=bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    return tokenizer, ends, {}


def _encode(tokenizer, ends, words: list[str], letters: bool):
    """(word, ids as the bytes of 32-bit integers) of words without ``BETWEEN``: many are encoded as one text.

    A word of letters ends where a run ends; between others stands a word of its own.
    """
    mark = tokenizer.encode(BETWEEN, add_special_tokens=False).ids
    groups = [words[at: at + 2000] for at in range(0, len(words), 2000)]
    joined = [(" " if letters else f" {BETWEEN} ").join(g) for g in groups]
    for some, got in zip(groups, tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
        ids = np.array(got.ids, dtype="<u4")
        cuts = np.flatnonzero(ends[ids]) + 1 if letters else np.flatnonzero(ids == mark[0]) if len(mark) == 1 else []
        if len(cuts) != len(some) - (not letters):
            yield from _alone(tokenizer, some)
            continue
        raw, stops = ids.tobytes(), (4 * cuts).tolist()
        starts = [0, *(stops[:-1] if letters else (x + 4 for x in stops))]
        yield from ((w, raw[x:y]) for w, x, y in zip(some, starts, stops if letters else [*stops, len(raw)]))


def _alone(tokenizer, words):
    return ((w, np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in words)


def _learn(tokenizer, ends, cache: dict, words: list[str]) -> None:
    """Put the ids of ``words`` into ``cache``.

    The tokenizer lower-cases, and parts runs of letters from runs of marks. So a word of letters below U+0100, where case
    needs no context and nothing is composed, has the ids of its lower-case letters and then of the stops and commas after them.
    """
    parted, cores, others, odd = [], set(), set(), []
    for w in words:
        core = w.rstrip(".,")
        if core.isalpha() and (w.isascii() or max(w) < "\u0100"):
            lower = core.lower()
            if lower != w:
                tail = w[len(core):]
                parted.append((w, lower, tail))
                others.add(tail)
            cores.add(lower)
        elif BETWEEN in w:
            odd.append(w)
        else:
            others.add(w)
    cache.update(_encode(tokenizer, ends, [w for w in cores if w not in cache], True))
    cache.update(_encode(tokenizer, ends, [w for w in others if w not in cache], False))
    cache.update((w, cache[core] + cache[tail]) for w, core, tail in parted)
    cache.update(_alone(tokenizer, odd))


def _words(text: str) -> list[str]:
    """What stands between blanks. The four separators that only Python takes as blanks are left to the tokenizer."""
    return text.replace("\n", " ").split(" ") if any(x in text for x in "\x1c\x1d\x1e\x1f") else text.split()


def token_ids(texts: list[str], path: str, remembered: int | None = None) -> list[bytes]:
    """The ids of each whole text as bytes of 32-bit integers, without an end mark.

    The tokenizer's pattern never crosses a blank and its normaliser never joins over one, so a text's ids are its
    words' ids in a row; words are encoded once and remembered.
    """
    tokenizer, ends, cache = _tokenizer(path)
    split = [_words(t) for t in texts]
    if len(cache) > (remembered or REMEMBERED):
        cache.clear()
    new = list(set().union(*split).difference(cache))
    if new:
        _learn(tokenizer, ends, cache, new)
    return [b"".join(map(cache.__getitem__, words)) for words in split]


def pieces(docs: DataFrame, path: str, most: int = 2048, with_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and the end mark 0, cut into pieces of ``most``
    where they are more. Null is the empty text, which is the end mark alone."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            owner, number, start, length, crc, kept = [], [], [], [], [], []
            texts = batch.column("text").fill_null("").to_pylist()
            for low in range(0, len(texts), 100):
                for row, ids in enumerate(token_ids(texts[low: low + 100], path, remembered), low):
                    ids += END.to_bytes(4, "little")
                    for i, at in enumerate(range(0, len(ids), 4 * most)):
                        part = ids[at: at + 4 * most]
                        owner.append(row), number.append(i), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names=names + ["ids"] * with_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Bins of item numbers, longest items first, each into the fullest bin that it fits.

    Bins are found by what they have left: a bit for each amount that some bin has left.
    """
    bins, left, marks = [], [[] for _ in range(most + 1)], 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        above = marks >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            at = left[room].pop()
            if not left[room]:
                marks ^= 1 << room
            bins[at].append(item)
        else:
            room, at = most, len(bins)
            bins.append([item])
        room -= size
        if room:
            left[room].append(at)
            marks |= 1 << room
    return bins


class _Search:
    """Underfull bins of one cell: items, their bins, and what each bin has left."""

    def __init__(self, lengths, bins, most):
        self.lengths, self.most = lengths, most
        self.bins = {i: list(b) for i, b in enumerate(bins)}
        self.items = np.array([x for b in bins for x in b], dtype=np.int64)
        self.size = lengths[self.items]
        self.bin = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        self.room = np.array([most - int(lengths[b].sum()) for b in bins], dtype=np.int64)

    def move(self, slots, to):
        for s in slots:
            was = self.bin[s]
            self.room[was] += self.size[s]
            self.room[to] -= self.size[s]
            self.bin[s] = to

    def empty(self, source, open_bins) -> bool:
        """Move the source's items out by moves and exchanges that raise the squared fill; True if none is left."""
        for _ in range(200):
            own = np.flatnonzero(self.bin == source)
            if not len(own):
                return True
            own = own[np.argsort(-self.size[own], kind="stable")]
            if not (self.moved(source, own, open_bins) or self.swapped(source, own, open_bins) or self.two_for_one(source, own, open_bins)):
                return False
        return False

    def moved(self, source, own, open_bins):
        """A whole item to the fullest bin it fits, if that raises the squared fill."""
        for s in own:
            fits = open_bins & (self.room >= self.size[s]) & (self.size[s] > self.room - self.room[source])
            fits[source] = False
            if fits.any():
                at = np.flatnonzero(fits)
                self.move([s], at[np.argmin(self.room[at])])
                return True
        return False

    def swapped(self, source, own, open_bins):
        """One for one: the other bin gets the longer item."""
        other = open_bins[self.bin] & (self.bin != source)
        capacity = self.size + self.room[self.bin]
        for s in own:
            fits = np.flatnonzero(other & (self.size < self.size[s]) & (capacity >= self.size[s]) & (self.size[s] - self.size > self.room[self.bin] - self.room[source]))
            if len(fits):
                t = fits[np.argmin(self.size[fits])]
                to = self.bin[t]
                self.move([t], source)
                self.move([s], to)
                return True
        return False

    def two_for_one(self, source, own, open_bins):
        """Two of the source's for one that is shorter than both together, or one for two others."""
        other = open_bins[self.bin] & (self.bin != source)
        capacity = self.size + self.room[self.bin]
        for i in range(min(len(own), 12)):
            for j in range(i + 1, min(len(own), 12)):
                both = self.size[own[i]] + self.size[own[j]]
                fits = np.flatnonzero(other & (self.size < both) & (capacity >= both) & (both - self.size > self.room[self.bin] - self.room[source]))
                if len(fits):
                    t = fits[np.argmin(self.size[fits])]
                    to = self.bin[t]
                    self.move([t], source)
                    self.move([own[i], own[j]], to)
                    return True
        order = np.flatnonzero(other)
        order = order[np.lexsort((self.size[order], self.bin[order]))]
        near = order[:-1], order[1:]  # neighbours by size within a bin
        same = self.bin[near[0]] == self.bin[near[1]]
        a, b = near[0][same], near[1][same]
        together = self.size[a] + self.size[b]
        room = together + self.room[self.bin[a]]
        for s in own:
            fits = np.flatnonzero((together < self.size[s]) & (room >= self.size[s]) & (self.size[s] - together > self.room[self.bin[a]] - self.room[source]))
            if len(fits):
                x = fits[np.argmin(together[fits])]
                to = self.bin[a[x]]
                self.move([a[x], b[x]], source)
                self.move([s], to)
                return True
        return False


def local_search(lengths: np.ndarray, bins: list[list[int]], most: int, patience: int = 8) -> list[list[int]]:
    """Fewer or equal bins: the emptiest bin's items are moved, swapped one for one, or exchanged two for one with other
    underfull bins while that raises the sum of squared fills, until the bin is empty; then the next. Ends after
    ``patience`` bins in a row that cannot be emptied; full bins are left as they are."""
    full = [b for b in bins if int(lengths[b].sum()) == most]
    loose = [b for b in bins if int(lengths[b].sum()) < most]
    if len(loose) < 2:
        return bins
    search = _Search(lengths, loose, most)
    open_bins, tried, failed = np.ones(len(loose), dtype=bool), set(), 0
    while failed < patience:
        candidates = [i for i in np.flatnonzero(open_bins) if i not in tried]
        if len(candidates) < 2:
            break
        source = max(candidates, key=lambda i: (search.room[i], i))
        before = (search.room ** 2).sum()
        emptied = search.empty(source, open_bins)
        if emptied:
            open_bins[source] = False
        # what has changed may let others be emptied that could not be before
        changed = emptied or (search.room ** 2).sum() != before
        tried = {source} if changed and not emptied else set() if emptied else tried | {source}
        failed = 0 if emptied else failed + 1
    kept = [[] for _ in loose]
    for item, at in zip(search.items.tolist(), search.bin.tolist()):
        kept[at].append(item)
    return full + [b for b in kept if b]


def _packed(cells: DataFrame, most: int) -> DataFrame:
    """Pack each cell: adds bin (a number in the cell), place (in the bin) and room (what the bin has left)."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        bins = local_search(lengths, best_fit(lengths, most), most)
        bin_of, offset, room = (np.zeros(len(rows), dtype=np.int64) for _ in range(3))
        for i, b in enumerate(bins):
            sizes = lengths[b]
            bin_of[b], offset[b], room[b] = i, np.cumsum(sizes) - sizes, most - sizes.sum()
        return rows.assign(bin=bin_of, offset=offset, room=room)

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, cell long, bin long, offset long, room long"
    return cells.groupBy("cell").applyInPandas(run, fields)


def pack(parts: DataFrame, most: int = 2048, cell: int = CELL) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset: bins of at most ``most`` tokens.

    Pieces that are full are sequences of their own. The others are dealt by a hash of (doc_id, piece, content, row) to cells of
    about ``cell`` pieces, whose number follows the data, so no task grows with the corpus and no document, source or
    repeated row is hot: the pieces are written first, and a row is its place in that table. A
    cell is packed best fit decreasing, then by ``local_search``. The bins of every cell with more than a sixteenth left
    go through a second round of cells, in which what the cells could not use meets. Sequence ids are unique but not
    gapless; offsets within a sequence are gapless from 0. Ties in length go by doc_id and piece, so a rerun gives the
    same packing. Repeated rows are pieces of their own. An empty table gives an empty table.
    """
    parts = written(parts.select("doc_id", "piece", "start", "length", "ids_crc32"), slim=True)
    short = parts.filter(F.col("length") < most)
    # rows that repeat are equal in all that is known of them; their place in the written table tells them apart
    number = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "piece", "ids_crc32", F.monotonically_increasing_id())
    first = max(1, -(-short.count() // cell))
    once = written(_packed(short.withColumn("cell", F.pmod(number, F.lit(first))), most), slim=True)
    loose = once.filter(F.col("room") > most // 16)
    n = loose.count()
    second = max(1, -(-n // cell))
    again = _packed(loose.select(*parts.columns, F.pmod(F.xxhash64(number), F.lit(second)).alias("cell")), most)
    # an id: the round in the lowest two bits, the bin in 30 bits, the cell above
    place = F.shiftleft("cell", 32) + F.shiftleft("bin", 2)
    whole = parts.filter(F.col("length") >= most).select(*parts.columns, F.expr("4 * monotonically_increasing_id() + 2").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return (once.filter(F.col("room") <= most // 16).select(*parts.columns, place.alias("sequence_id"), "offset")
            .unionAll(again.select(*parts.columns, (place + 1).alias("sequence_id"), "offset")).unionAll(whole))


def pack_documents(docs: DataFrame, path: str, most: int = 2048, remembered: int | None = None) -> DataFrame:
    """Each piece of every text in its sequence; see ``pieces`` and ``pack``. ``remembered`` bounds the words that a
    worker keeps, some 300 bytes each; fewer words cost time and change no result."""
    return pack(pieces(docs, path, most, remembered=remembered), most)
