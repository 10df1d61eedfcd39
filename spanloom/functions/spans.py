"""Spans of text: extraction, sentences, headings, masks, marks.

One pass of ``regexp_replace`` frames every match with marker characters; splitting at
them leaves gaps and matches in turn, and the running sum of their lengths gives the
offsets. Nothing leaves the JVM and nothing is exploded.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from spanloom.functions.regex import java_flags, line_bound, to_java

# Two Unicode non-characters; a text that holds one is read as if it held U+FFFD there.
MARK, FIELD = "﷐", "﷑"

# A sentence ends at a stop (with closers) before a capital, or at line end.
SENTENCE = r"""[^\n]+?(?:[.!?]["”’)*_]*(?=\s+["“*_(]*[A-Z])|$)"""
MARKER_ONLY = " \t-*_#=|"
# Markdown heading; line wholly bold or italic; bold phrase opening a line.
HEADING_LINE = (r"^[ \t]*(?:#{1,6}[ \t]+(?P<h>.+?)[ \t#]*|(?:[-*•][ \t]+|\d+[.)][ \t]+)?"
                r"(?P<b>\*\*[^*\n]{2,120}\*\*|__[^_\n]{2,120}__|\*[^*\n]{2,120}\*)"
                r"[ \t]*[:.]?[ \t]*(?P<rest>.*))$")
WHITESPACE = " \t\r\n\u000b\u000c\u0085      　" + "".join(
    chr(c) for c in range(0x2000, 0x200b))


def let(value, body) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replaced(text, marks: str, plain: str) -> Column:
    """``translate`` for a few characters that most texts lack: each is looked for, where translate copies every character."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), zip(marks, plain), _c(text))


def guarded(text) -> Column:
    return replaced(text, MARK + FIELD, "\ufffd\ufffd")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def framed(text: Column, java: str, *fields: str) -> Column:
    """``text`` cut into gap, record, gap, ... where a record is the match and ``fields``."""
    record = MARK + FIELD.join(("$0",) + fields) + MARK
    return F.split(F.regexp_replace(text, F.lit(java), F.lit(record)), MARK, -1)


def spans_of(pieces: Column, shape) -> Column:
    """Array of ``shape(start, end, record)`` over the records of ``framed`` pieces. Offsets are running sums of lengths."""
    # bound once: a lambda would otherwise run the regex again for every match
    return let(pieces, lambda bound: _spans_of(bound, shape))


def _spans_of(pieces, shape):
    def lengths(p, i):
        return F.when(i.bitwiseAND(1) == 1, F.length(F.substring_index(p, FIELD, 1))).otherwise(F.length(p))

    def indexes(ends):
        n = F.shiftright(F.size(ends), 1)
        return F.filter(F.sequence(F.lit(0), n), lambda i: i < n)

    return let(running(F.transform(pieces, lengths)), lambda ends: F.transform(indexes(ends), lambda i: shape(
        F.get(ends, F.shiftleft(i, 1)), F.get(ends, F.shiftleft(i, 1) + 1), F.get(pieces, F.shiftleft(i, 1) + 1))))


def span(start, end, surface) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), surface.alias("surface"))


def named_span(start, _end, record) -> Column:
    """The wanted group of a record framed as match, stretch before it, group."""
    def placed(fields):
        at = start + F.length(F.get(fields, F.lit(1)))
        return span(at, at + F.length(F.get(fields, F.lit(2))), F.get(fields, F.lit(2)))

    return let(F.split(record, FIELD, -1), placed)


def frame_named(text: Column, pattern: str, flags: str = "", wanted=("name", "name2")) -> Column:
    java = to_java(pattern, flags, wanted)
    joined = ["".join("$%d" % g for g in groups) for groups in (java.before, java.wanted)]
    return framed(text, java.text, *joined)


def find_spans(text, pattern: str, group=0, flags: str = "", lines=None, holds=None) -> Column:
    """All non-overlapping matches of a Python pattern as array<struct<start,end,surface>>.

    ``group`` is 0 for the whole match, a group number, a group name, or a tuple of names
    of which one takes part in a match. Where ``lines`` (see ``lines_of``) are given, a pattern whose matches lie in one line
    meets only lines for which ``holds`` is true; that must be so of every line with a match.
    """
    wanted = () if group == 0 else group if isinstance(group, tuple) else (group,)

    def cut(whole):
        return framed(whole, to_java(pattern, flags, ()).text) if group == 0 else frame_named(whole, pattern, flags, wanted)

    shape = span if group == 0 else named_span
    if lines is not None and line_bound(pattern, flags):
        return line_spans(lines, cut, shape, holds)
    return spans_of(cut(guarded(text)), shape)


def lines_of(text) -> Column:
    """Lines of a text that are not empty as array<struct<at,line>>, with the place where each begins."""
    def placed(parts):
        return let(running(F.transform(parts, lambda p: F.length(p))), lambda ends: F.filter(F.transform(parts, lambda p, i: F.struct(
            (F.get(ends, i) - F.length(p) + i).alias("at"), p.alias("line"))), lambda line: line["line"] != ""))

    return let(F.split(guarded(text), "\n", -1), placed)


def line_spans(lines, cut, shape, holds=None) -> Column:
    """``shape(start, end, record)`` of every match in the lines that ``holds`` lets through, ``cut`` framing one line."""
    kept = _c(lines) if holds is None else F.filter(_c(lines), holds)
    cuts = F.filter(F.transform(kept, lambda line: F.struct(line["at"].alias("at"), cut(line["line"]).alias("cut"))), lambda c: F.size(c["cut"]) > 1)

    def found(c):
        at, record = c["at"] + F.length(F.get(c["cut"], F.lit(0))), F.get(c["cut"], F.lit(1))
        single = F.array(shape(at, at + F.length(F.substring_index(record, FIELD, 1)), record))
        several = spans_of(c["cut"], lambda s, e, record: shape(c["at"] + s, c["at"] + e, record))
        # most lines with a match hold one: no sums are needed
        return F.when(F.size(c["cut"]) == 3, single).otherwise(several)

    return F.flatten(F.transform(cuts, found))


def find_groups(text, pattern: str, names, flags: str = "") -> Column:
    """Matches as array<struct<start,end,groups array<string>>>; an absent group is ''."""
    java = to_java(pattern, flags, tuple(names))
    pieces = framed(guarded(text), java.text, *("$%d" % g for g in java.wanted))
    return spans_of(pieces, lambda s, e, record: F.struct(
        s.alias("start"), e.alias("end"),
        F.slice(F.split(record, FIELD, -1), 2, len(names)).alias("groups")))


def sentences(text, keep_markers: bool = False) -> Column:
    """Sentences and heading lines as array<struct<no,start,end>>, numbered from 1."""
    found = find_spans(text, SENTENCE, flags="m")
    dropped = WHITESPACE if keep_markers else MARKER_ONLY
    kept = F.filter(found, lambda s: F.length(F.btrim(s["surface"], F.lit(dropped))) > 0)
    return F.transform(kept, lambda s, i: F.struct(
        (i + 1).alias("no"),
        (s["start"] + F.length(s["surface"]) - F.length(F.ltrim(s["surface"], F.lit(WHITESPACE)))).alias("start"),
        s["end"].alias("end")))


def cut(text, start, end) -> Column:
    """The text's own stretch."""
    return F.substring(_c(text), start + 1, end - start)


def headings(text) -> Column:
    """Headings as array<struct<start,title>>."""
    found = find_groups(text, HEADING_LINE, ("h", "b", "rest"), flags="m")

    def title(m):
        raw = F.when(F.get(m["groups"], F.lit(0)) != "", F.get(m["groups"], F.lit(0))).otherwise(
            F.get(m["groups"], F.lit(1)))
        return F.btrim(F.regexp_replace(raw, r"[*_#`]+", ""), F.lit(" :."))

    def italic_opener(m):
        bold = F.get(m["groups"], F.lit(1))
        return ((F.get(m["groups"], F.lit(0)) == "") & (F.get(m["groups"], F.lit(2)) != "")
                & ~bold.startswith("**") & ~bold.startswith("__"))

    titled = F.transform(F.filter(found, lambda m: ~italic_opener(m)),
                         lambda m: F.struct(m["start"].alias("start"), title(m).alias("title")))
    return F.filter(titled, lambda h: h["title"] != "")


def mask_lines(text, pattern: str, flags: str = "m") -> Column:
    """Blank out every match; the length, and so every offset, stays."""
    pieces = framed(guarded(text), to_java(pattern, flags, ()).text)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(
        i.bitwiseAND(1) == 1, F.rpad(F.lit(""), F.length(p), " ")).otherwise(p)), "")


def enclosing_sentence(text, start, end) -> Column:
    """Grow [start, end) to the sentence around it, as struct<start,end,surface>."""
    text = _c(text)

    def stops(x):
        return F.translate(x, "!?\n", "...")

    left = start - F.length(F.substring_index(stops(F.substring(text, F.lit(1), start)), ".", -1))
    right = end + F.length(F.substring_index(stops(F.substring(text, end + 1, F.length(text))), ".", 1))
    closed = right + F.when((right < F.length(text)) & (F.substring(text, right + 1, F.lit(1)) != "\n"), 1).otherwise(0)

    def trimmed(s, e):
        return let(cut(text, s, e), lambda raw: span(
            s + F.length(raw) - F.length(F.ltrim(raw, F.lit(" \t"))), e, F.btrim(raw, F.lit(WHITESPACE))))

    return let(left, lambda s: let(closed, lambda e: trimmed(s, e)))


def kwic(text, start, end, width: int = 70, newline: str = " / ") -> Column:
    """Keyword in context: ``left«hit»right`` with line ends shown."""
    text = _c(text)
    left = cut(text, F.greatest(F.lit(0), start - width), start)
    shown = [F.replace(x, F.lit("\n"), F.lit(newline))
             for x in (left, cut(text, start, end), F.substring(text, end + 1, F.lit(width)))]
    return F.concat(shown[0], F.lit("«"), shown[1], F.lit("»"), shown[2])


def running(values, block=None) -> Column:
    """Sums up to each element of an array of numbers, itself included. Each block is summed, then written out from the sum of
    those before it, so an element costs two additions and the copy of its part of a block. A block of n elements grows with
    the cube root of n, where the copies within blocks and those of the blocks' sums are fewest together."""
    zero = F.lit(0)

    def grown(acc, x):
        return F.concat(acc, F.array(F.element_at(acc, -1) + x.cast("int")))

    def blocks(bound, each):
        parts = F.transform(F.sequence(zero, F.size(bound) - 1, each), lambda at: F.slice(bound, at + 1, each))
        sums = lambda held: F.transform(held, lambda p: F.aggregate(p, zero, lambda acc, x: (acc + x).cast("int")))
        return let(parts, lambda held: let(F.aggregate(sums(held), F.array(zero), grown), lambda before: F.flatten(F.transform(
            held, lambda p, i: F.slice(F.aggregate(p, F.array(F.get(before, i)), grown), F.lit(2), each)))))

    def written(bound):
        # a few are one block
        single = F.slice(F.aggregate(bound, F.array(zero), grown), F.lit(2), F.size(bound))
        several = let(F.lit(block) if block else F.ceil(F.cbrt(F.size(bound) * 2)).cast("int"), lambda each: blocks(bound, each))
        return F.when(F.size(bound) > 16, several).when(F.size(bound) > 0, single).when(bound.isNotNull(), F.array().cast("array<int>"))

    return let(values, written)


#: Characters of a block of text from which marked pieces are cut; to cut from the whole text would walk it for every piece.
CUT = 1024


def mark_spans(text, spans, opens=("", "{w:", "[S:"), closes=("", "}", "]")) -> Column:
    """Text with marks around stretches; where spans overlap the higher rank shows.

    ``spans`` is array<struct<start,end,rank>> with rank 1, 2, ...; neighbouring
    stretches of equal rank are one mark. The bounds are swept once in order, with a running count of the open spans of
    each rank, so the cost is about that of the text and the spans.
    """
    ranks = range(1, len(opens))

    def event(at, rank, step, size):
        return F.struct(F.greatest(F.least(at.cast("int"), size), F.lit(0)).alias("at"), rank.cast("int").alias("rank"), F.lit(step).alias("step"))

    def swept(bound, size):
        cuts = F.transform(F.sequence(F.lit(0), size, F.lit(CUT)), lambda at: event(at, F.lit(0), 0, size))
        return F.sort_array(F.concat(F.transform(bound, lambda s: event(s["start"], s["rank"], 1, size)), F.transform(bound, lambda s: event(s["end"], s["rank"], -1, size)),
                                     cuts, F.array(event(size, F.lit(0), 0, size))))

    def pieces(events, size):
        open_ = F.struct(*[running(F.transform(events, lambda e: F.when(e["rank"] == r, e["step"]).otherwise(0))).alias("r%d" % r) for r in ranks])

        def piece(held, e, i):
            rank = F.coalesce(*[F.when(F.get(held["r%d" % r], i) > 0, r) for r in reversed(ranks)], F.lit(0))
            return F.struct(e["at"].alias("s"), F.coalesce(F.get(events, i + 1)["at"], size).alias("e"), rank.alias("r"))

        return let(open_, lambda held: F.filter(F.transform(events, lambda e, i: piece(held, e, i)), lambda p: p["s"] < p["e"]))

    def shown(runs, blocks):
        open_, close = F.array(*map(F.lit, opens)), F.array(*map(F.lit, closes))

        def one(p, i):
            before = F.coalesce(F.get(runs, i - 1)["r"], F.lit(0))
            after = F.coalesce(F.get(runs, i + 1)["r"], F.lit(0))
            own = F.substring(F.get(blocks, F.floor(p["s"] / CUT).cast("int")), p["s"] % CUT + 1, p["e"] - p["s"])
            return F.concat(F.when(before != p["r"], F.get(open_, p["r"])).otherwise(""), own, F.when(after != p["r"], F.get(close, p["r"])).otherwise(""))

        return F.array_join(F.transform(runs, one), "")

    def marked(whole, size):
        real = F.filter(spans, lambda s: s["start"] < s["end"])
        return let(real, lambda bound: let(swept(bound, size), lambda events: let(pieces(events, size), lambda runs: let(
            text_blocks(whole, size), lambda cut_: shown(runs, cut_)))))

    # the length is bound: it is counted anew wherever it stands, and every event asks for it
    return let(_c(text), lambda whole: let(F.length(whole), lambda size: marked(whole, size)))


def text_blocks(text, size) -> Column:
    """A text in blocks of ``CUT`` characters, empty ones at the end. A position is found by walking the text, so large parts
    are cut first and blocks from them."""
    part, each = CUT * 64, F.sequence(F.lit(0), F.lit(63))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(size / part).cast("int")), lambda n: let(
        F.substring(text, n * part + 1, F.lit(part)), lambda held: F.transform(each, lambda i: F.substring(held, i * CUT + 1, F.lit(CUT))))))


def with_cuts(text, spans, shape) -> Column:
    """``shape(span, stretch)`` of every span of a text, which is cut in blocks once and not walked for each span."""
    def stretch(blocks, s):
        first, last = F.floor(s["start"] / CUT).cast("int"), F.floor(s["end"] / CUT).cast("int")
        return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), s["start"] % CUT + 1, s["end"] - s["start"])

    return let(_c(text), lambda whole: let(text_blocks(whole, F.length(whole)), lambda blocks: F.transform(
        spans, lambda s: shape(s, stretch(blocks, s)))))


def count_matches(text, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(_c(text), F.lit(java_flags(flags) + pattern))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
