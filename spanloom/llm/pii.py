"""Personal data in texts: fixed forms as seeds, then words around them as patterns that discover further identifiers.

Seeds and other identifier-like strings are instances, the words around them patterns; both form a graph. Spark scores
patterns by the instances that they hold and instances by the best pattern that holds them, in rounds.
"""
from __future__ import annotations

import re
from functools import reduce
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import small_batches, written

#: Kinds of the fixed forms, in the order of the contract; what contexts add is of the same kinds, with a prefix.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, *(f"found_{k}" for k in BASE)]
#: The characters of an address before and after the at sign, and the other forms. Loops that cannot give
#: back with success are possessive, and a run of digits is tried from its first only: a later start fails as the first did.
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Identifier-like strings: figures in groups, or one word that holds a figure or an at sign.
_GROUPS = r"(?<![A-Za-z0-9@:+._%/-])[+(]?[0-9][0-9().:/-]*+(?:\x20[0-9(][0-9().:/-]*+)*+"
_WORD = r"(?<![A-Za-z0-9@:+._%/-])[A-Za-z:+._%/-]*+[0-9@][A-Za-z0-9@:+._%/-]*+"
_LIKE = re.compile(f"{_GROUPS}(?![A-Za-z@_%])|{_WORD}")
_EDGE = ".:/+%_-("
#: Least figures of an identifier without an at sign, and the lengths that count.
FIGURES, SHORT, LONG = 4, 5, 64
_LETTERS = re.compile(r"[^\W\d_]+")
#: Characters on either side in which a pattern's words are looked for.
REACH = 60
#: Thousandths from which a pattern is trusted; the instances of a kind it must hold; rounds of scoring.
TRUST, SUPPORT, ROUNDS = 750, 3, 3
#: A hot pattern's or value's rows are dealt to so many parts where they meet their scores.
PARTS = 16


def emails(text: str):
    """Leftmost addresses that do not overlap. Each at sign is looked at once, with the run before it that is still free."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = at - (len(before) - len(before.rstrip(_LOCAL)))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        # what follows an at sign may open the next address, but no address spans one
        free = found.end() if found else at + 1
        at = text.find("@", free)


def _luhn(digits: str) -> bool:
    twice = [(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed forms, by kind, then start; offsets in code points."""
    out = [(0, *s) for s in emails(text)]
    if not _DIGIT.search(text):
        return out
    small = lambda p: len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(small(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and the marks between
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]):
    """(start, end) of identifier-like strings that share no character with a fixed form."""
    if "@" not in text and not _DIGIT.search(text):
        return
    busy, k = sorted((a, b) for _, a, b in taken), 0
    for m in _LIKE.finditer(text):
        a, b = m.span()
        b -= len(m[0]) - len(m[0].rstrip(_EDGE))
        a += len(m[0]) - len(m[0].lstrip(".:/%_-"))
        if not SHORT <= b - a <= LONG or "@" not in m[0] and len(_DIGIT.findall(text, a, b)) < FIGURES:
            continue
        while k < len(busy) and busy[k][1] <= a:
            k += 1
        # spans of different kinds may overlap, so one that ends earlier may hide behind a longer one: two are looked at
        if not any(x < b and y > a for x, y in busy[max(0, k - 1): k + 2]):
            yield a, b


def contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns around a span: words before and after it, <> for the span. Without two words before it there is none."""
    left = _LETTERS.findall(text[max(0, start - REACH): start].lower())
    if start > REACH and left and text[start - REACH - 1].isalpha() and text[start - REACH].isalpha():
        left = left[1:]  # cut word
    right = _LETTERS.search(text[end: end + REACH].lower())
    out = [f"{left[-2]} {left[-1]} <>"] if len(left) > 1 else []
    if len(left) > 2:
        out.append(f"{left[-3]} {out[0]}")
    if left and right and right.end() < REACH:
        out.append(f"{left[-1]} <> {right[0]}")
    return out


SPAN = "struct<kind:int,start:bigint,end:bigint,value:binary,patterns:array<string>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary()), ("patterns", pa.list_(pa.string()))])


def _marks(text: str | None) -> list[dict]:
    """Fixed forms and candidates (kind -1) of a text, with a hash of the value and the patterns around it."""
    if not text:
        return []
    base = base_spans(text)
    return [{"kind": k, "start": a, "end": b, "value": md5(text[a:b].lower().encode("utf-8", "replace"), usedforsecurity=False).digest(), "patterns": contexts(text, a, b)}
            for k, a, b in [*base, *((-1, a, b) for a, b in candidates(text, base))]]


def marked(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and ``marks``: an array of ``SPAN`` for the whole text."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep)

    def scan(batches):
        for batch in batches:
            marks = pa.array([_marks(t) for t in batch.column(len(keep)).to_pylist()], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], marks], [*keep, "marks"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(scan, f"{fields}, marks array<{SPAN}>")


def edges(marks: DataFrame) -> DataFrame:
    """The graph: pattern, value, kind (-1: unknown), each pair once. Patterns that hold fewer than ``SUPPORT`` values go:
    they could never be trusted."""
    each = marks.select(F.explode("marks").alias("m")).select("m.value", "m.kind", F.explode("m.patterns").alias("pattern"))
    # seeds win; of two kinds the first
    kind = F.min(F.when(F.col("kind") >= 0, F.col("kind")))
    pairs = each.groupBy("pattern", "value").agg(F.coalesce(kind, F.lit(-1)).alias("kind"))
    pairs = written(pairs, slim=True)
    enough = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT).select("pattern")
    return written(met(pairs, enough, "pattern", "value"), slim=True)


def met(rows: DataFrame, scores: DataFrame, key: str, other: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``scores`` (each ``key`` once), dealt to ``PARTS`` parts by ``other``, so a hot key's rows do not meet in one task."""
    many = scores.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64(other), F.lit(PARTS)).cast("int")).join(many, [key, "_part"], how).drop("_part")


def trusted(pairs: DataFrame) -> DataFrame:
    """pattern, kind and score (thousandths) of the patterns that hold values of one kind nearly alone.

    ``pairs`` has value scores (null: unknown). A pattern's score for a kind is the sum of its values' scores over that
    sum, the scores of other kinds, half a point for each unknown value and one point; its best kind counts (ties: the first).
    """
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0))
    n = lambda k: F.count(F.when((F.col("kind") == k) & (F.col("score") > 0), 1))
    all_ = pairs.groupBy("pattern").agg(*[of(k).alias(f"s{k}") for k in range(4)], *[n(k).alias(f"n{k}") for k in range(4)], F.count(F.when(F.col("score").isNull(), 1)).alias("open"))
    total = reduce(Column.__add__, [F.col(f"s{k}") for k in range(4)]) + 500 * F.col("open") + 1000
    scored = [F.struct(F.floor(1000 * F.col(f"s{k}") / total).cast("long").alias("score"), F.lit(-k).alias("turn"), F.col(f"n{k}").alias("n")) for k in range(4)]
    best = all_.select("pattern", F.greatest(*scored).alias("b"))
    return best.filter((F.col("b.score") >= TRUST) & (F.col("b.n") >= SUPPORT)).select("pattern", (-F.col("b.turn")).alias("kind"), F.col("b.score").alias("score"))


def learned(marks: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The trusted patterns after ``rounds`` rounds: pattern, kind, score.

    Seeds have 1000 throughout. An unknown value gets the score and kind of the best trusted pattern that holds it, and
    counts with it in the next round. Scores are integers, so sums do not depend on the order of rows.
    """
    graph = edges(marks)
    seeds = graph.filter("kind >= 0").withColumn("score", F.lit(1000).cast("long"))
    unknown = graph.filter("kind < 0").select("pattern", "value")
    scored = unknown.withColumns({"kind": F.lit(-1), "score": F.lit(None).cast("long")})
    for turn in range(rounds):
        patterns = written(trusted(seeds.select("pattern", "value", "kind", "score").unionByName(scored.select("pattern", "value", "kind", "score"))), slim=True)
        if turn + 1 < rounds:
            held = met(unknown, patterns, "pattern", "value").groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("turn"))).alias("b"))
            held = written(held.select("value", (-F.col("b.turn")).alias("kind"), F.col("b.score").alias("score")), slim=True)
            scored = met(unknown, held, "value", "pattern", "left")
    return patterns


RESULT = "array<struct<rank:int,start:bigint,end:bigint,kind:string,score:bigint,pattern:string>>"


def scan(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with spans: an array of (rank, start, end, kind, score, pattern) for each row, by kind, then start.

    The fixed forms email, ip, card and phone are found in every whole text (null: empty), leftmost and not overlapping
    within a kind; they have score 1000 and no pattern. The words around them are patterns; a pattern that holds values of
    one kind nearly alone (``TRUST``, ``SUPPORT``) marks the other identifier-like strings that it holds anywhere as
    ``found_`` that kind, with its score. Such a string shares no character with a fixed form, has ``SHORT`` to ``LONG``
    characters, and holds an at sign or ``FIGURES`` figures.

    Values count once for a pattern however often they stand there, so copies of a text prove nothing. Pairs of pattern and
    value are made distinct before anything meets, and joins deal a hot pattern or value to ``PARTS`` parts. Rows that repeat
    stay rows, null ids stay, an empty table gives an empty table. Columns named spans, marks, _row or _text are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ("spans", "marks", "_row", "_text") and (keep_text or c != text)]
    spark = docs.sparkSession
    source = docs.drop(*[c for c in docs.columns if c not in keep and c != text]).withColumn("_row", F.monotonically_increasing_id())
    base = written(marked(source, text, [*keep, "_row"]))
    patterns = learned(base)
    fixed = F.transform(F.filter("marks", lambda m: m["kind"] >= 0), lambda m: F.struct(
        m["kind"].alias("rank"), m["start"].alias("start"), m["end"].alias("end"), F.element_at(F.array(*map(F.lit, BASE)), m["kind"] + 1).alias("kind"),
        F.lit(1000).cast("long").alias("score"), F.lit(None).cast("string").alias("pattern")))
    open_ = base.select("_row", F.explode(F.filter("marks", lambda m: m["kind"] < 0)).alias("m"))
    open_ = open_.select("_row", "m.start", "m.end", F.explode("m.patterns").alias("pattern"))
    hits = met(open_, patterns, "pattern", "_row").groupBy("_row", "start", "end").agg(F.max(F.struct("score", (-F.col("kind")).alias("turn"), "pattern")).alias("b"))
    kind = (-F.col("b.turn")).cast("int")
    found = hits.select("_row", F.struct((kind + 4).alias("rank"), "start", "end", F.element_at(F.array(*map(F.lit, KINDS)), kind + 5).alias("kind"), "b.score", "b.pattern").alias("s"))
    found = written(found.groupBy("_row").agg(F.collect_list("s").cast(RESULT).alias("more")), slim=True)
    joined = base.join(found, "_row", "left")
    spans = F.concat(fixed.cast(RESULT), F.coalesce("more", F.array().cast(RESULT)))
    return joined.select(*keep, F.array_sort(spans).alias("spans"))


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, the counts of the fixed forms, their digest, and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(listed(F.filter("spans", lambda s: s["rank"] < 4)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
