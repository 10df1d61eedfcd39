"""Places of many strings in one text at a cost of about the text plus the strings.

An index of anchors: the hashes of all stretches of eight characters are met with those at the beginning of the strings
looked for, so the text is walked once however many strings there are. Offsets in a folded text go back to the text by
halving over the running sums of what folding changed. These helpers run inside Arrow tasks, one text at a time.
"""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np

from spanloom.functions.spans import WHITESPACE
from spanloom.functions.text import FOLD_FROM, FOLD_TO, PROSE_WORD, SPACES

#: Characters of an anchor, and positions hashed at a time.
ANCHOR, BLOCK = 8, 1 << 20
#: Places of an anchor tried one by one; past them the text is searched from there on, so repeats cannot multiply.
TRIES = 16
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, ANCHOR, dtype=np.uint64) | np.uint64(1)

_PLAIN = [*zip(FOLD_FROM, FOLD_TO), ("…", "..."), *((c, "") for c in "*_`")]
_SPACES = SPACES.replace(r"\s", "\\t-\\r ")  # Java's \s, so that both sides fold alike
_RUN = re.compile(_SPACES + "+")
_BLANK = re.compile(_SPACES)
#: Stretches whose folded length differs: white space and emphasis marks together, an ellipsis, the one capital that
#: is two characters when lowered.
_UNEVEN = re.compile(_SPACES[:-1] + "*_`]{2,}|[*_`]|…|İ")
_WORD = re.compile(PROSE_WORD)
_STOP = re.compile(r"[.!?\n]")
_CLOSERS = re.compile(r"[*\"”’)]*")


def _hashes(text: str, k: int):
    """(first position, hashes of the stretches of k characters that begin from there on), in blocks."""
    for at in range(0, len(text) - k + 1, BLOCK):
        codes = np.frombuffer(text[at: at + BLOCK + k - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n = len(codes) - k + 1
        out = codes[:n] * _FACTORS[0]
        for i in range(1, k):
            out += codes[i: i + n] * _FACTORS[i]
        yield at, out


def places(text: str, wanted) -> dict[str, int]:
    """First offset of each string of ``wanted`` that stands in the text. Empty strings are left out."""
    found, by_length = {}, defaultdict(list)
    for w in set(wanted):
        if 0 < len(w) <= len(text):
            by_length[min(ANCHOR, len(w))].append(w)
    for k, strings in by_length.items():
        heads = np.frombuffer("".join(w[:k] for w in strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        keys, slots = np.unique((heads.reshape(-1, k).astype(np.uint64) * _FACTORS[:k]).sum(axis=1, dtype=np.uint64), return_inverse=True)
        hit_at, hit_key = [], []
        for at, hashes in _hashes(text, k):
            slot = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            here = np.flatnonzero(keys[slot] == hashes)
            hit_at.append(here + at)
            hit_key.append(slot[here])
        hit_at, hit_key = np.concatenate(hit_at), np.concatenate(hit_key)
        order = np.argsort(hit_key, kind="stable")
        hit_at, bounds = hit_at[order], np.searchsorted(hit_key[order], np.arange(len(keys) + 1))
        for w, slot in zip(strings, slots):
            tried = hit_at[bounds[slot]: bounds[slot + 1]]
            place = next((int(p) for p in tried[:TRIES] if text.startswith(w, int(p))), -1)
            if place < 0 and len(tried) > TRIES:
                place = text.find(w, int(tried[TRIES]))
            if place >= 0:
                found[w] = place
    return found


def folded(text: str) -> str:
    """The fold of ``spanloom.functions.text.fold``."""
    for mark, plain in _PLAIN:
        text = text.replace(mark, plain)
    return _RUN.sub(" ", text).lower()


class Fold:
    """A text's fold, and the way back from its offsets."""

    def __init__(self, text: str):
        self.text = folded(text)
        self.begins, self.sizes, self.at, self.shift, shift = [], [], [], [], 0
        for m in _UNEVEN.finditer(text):
            blank = _BLANK.search(m[0])
            size = 3 if m[0] == "…" else 2 if m[0] == "İ" else 1 if blank else 0
            self.begins.append(m.start() - shift)
            self.sizes.append(size)
            self.at.append(m.start() + (blank.start() if blank else 0))
            shift += m.end() - m.start() - size
            self.shift.append(shift)

    def back(self, position: int) -> int:
        """Offset in the text of the character that gave the folded character ``position``."""
        i = bisect_right(self.begins, position) - 1
        if i < 0:
            return position
        return self.at[i] if position < self.begins[i] + self.sizes[i] else position + self.shift[i]


class Words:
    """The words of a text with what the loose match needs: their offsets, and the sentences around them."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in _WORD.finditer(text)]
        self.low = [text[a:b].lower() for a, b in self.spans]
        self.stops = [m.start() for m in _STOP.finditer(text)]
        self.held = defaultdict(list)
        for i, w in enumerate(self.low):
            self.held[w].append(i)

    def opening(self, start: int) -> int:
        """Where the sentence around ``start`` begins."""
        i = bisect_left(self.stops, start)
        s = self.stops[i - 1] + 1 if i else 0
        while s < start and self.text[s] in " \t":
            s += 1
        return s

    def closing(self, end: int) -> int:
        """Where the sentence around the character before ``end`` ends, closing marks included."""
        i = bisect_left(self.stops, end - 1)
        stop = self.stops[i] + 1 if i < len(self.stops) else len(self.text)
        return _CLOSERS.match(self.text, stop).end()

    def around(self, place: int, reach: int) -> tuple[int, int]:
        """First word and words beyond the last of the stretch around a place."""
        return max(0, place - reach), min(len(self.low), place + reach)

    def windows(self, quote: list[str], letters: int, seeds: int, most: int, margin: int):
        """(number, first word, words beyond the last) of the stretches around the quote's rarest long words."""
        long_words = {w for w in quote if len(w) > letters and w in self.held}
        rare = sorted((len(self.held[w]), w) for w in long_words)[:seeds]
        for k, i in enumerate(i for _, w in rare for i in self.held[w][:most]):
            yield k, *self.around(i, len(quote) + margin)

    def crowded(self, quote: list[str], need: int, margin: int):
        """Every place, in order, of any word of the quote whose stretch holds ``need`` of the quote's words.

        Such a stretch holds one of any len(quote) - need + 1 of them, so the text is walked only around the rarest."""
        asked, reach = Counter(quote), len(quote) + margin
        spare, rare = len(quote) - need, []
        for w in sorted(asked, key=lambda w: len(self.held.get(w, ()))):
            rare += self.held.get(w, ())
            spare -= asked[w]
            if spare < 0:
                break
        rare.sort()
        n = 0
        while n < len(rare):
            first, last = rare[n] - reach + 1, rare[n] + reach
            while n < len(rare) and rare[n] - reach + 1 <= last + 1:
                last = rare[n] + reach
                n += 1
            low, high = self.around(first, reach)[0], self.around(last, reach)[1]
            here = [i for i in range(low, high) if self.low[i] in asked]
            held, both, begin, end = Counter(), 0, 0, 0
            for i in here[bisect_left(here, first): bisect_right(here, last)]:
                while end < len(here) and here[end] < i + reach:
                    w = self.low[here[end]]
                    held[w] += 1
                    both += held[w] <= asked[w]
                    end += 1
                while here[begin] < i - reach:
                    w = self.low[here[begin]]
                    both -= held[w] <= asked[w]
                    held[w] -= 1
                    begin += 1
                if both >= need:
                    yield i


def quote_words(quote: str) -> list[str]:
    return [m[0].lower() for m in _WORD.finditer(quote)]


def common(a: list[str], b: list[str]) -> int:
    """Words of a multiset that another holds: no alignment can match more."""
    return sum((Counter(a) & Counter(b)).values())


def in_order(a: list[str], b: list[str]) -> int:
    """Words of the longest common subsequence, a bit for each word of ``a``: no alignment can match more."""
    masks, full = defaultdict(int), (1 << len(a)) - 1
    for i, w in enumerate(a):
        masks[w] |= 1 << i
    free = full
    for w in b:
        if w in masks:
            met = free & masks[w]
            free = (free + met | free - met) & full
    return len(a) - free.bit_count()


def trimmed(quote: str) -> str:
    return quote.strip(WHITESPACE)
