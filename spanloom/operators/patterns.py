"""Run the whole registry over a corpus in one narrow stage.

Each text is read once. Every distinct regex frames its matches in the text, the spans
are worked out inside the row, and what later tables need from the text (how often a
string occurs, in which case, in which title lines) is counted there too. Only slim rows
leave the stage, so no later shuffle carries text.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions.regex import java_flags
from spanloom.functions.spans import (any_of, enclosing_sentence, frame_named, framed, guarded, let,
                                      mask_lines, named_span, replaced, spans_of)
from spanloom.functions.text import clean, corpus_words, norm, occurrences, occurrences_cased
from spanloom.operators.registry import JAVA_READY, LIKE_ASCII, MASK_REGEX, REGISTRY, needed_words, needs, STOPLISTS, TITLE_REGEX


def doc_freq(texts: DataFrame, text="text", least: int = 3) -> DataFrame:
    """Share of texts that contain each word; words of fewer than ``least`` texts left out."""
    total = texts.select(F.count(F.lit(1))).scalar()
    counted = (texts.select(F.explode(corpus_words(text)).alias("word"))
               .groupBy("word").agg(F.count(F.lit(1)).alias("n_texts")).filter(F.col("n_texts") >= least))
    return counted.select("word", "n_texts", F.round(F.col("n_texts") / total, 5).alias("df"))


def _scans(registry):
    """Patterns that share a regex and its conditions are scanned once."""
    scans = {}
    for p in registry:
        key = (p.regex, p.flags, p.mask, p.yields, p.stop, p.reject, p.max_words)
        scans.setdefault(key, []).append(p)
    return list(scans.items())


def _strings(values):
    """A constant array, sent to the JVM as one literal."""
    return F.split(F.lit("\n".join(values)), "\n") if values else F.lit(None).cast("array<string>")


def run_patterns(texts: DataFrame, registry=None, stoplists=None, df: DataFrame | None = None,
                 key: str = "text_id", text: str = "text") -> DataFrame:
    """Mentions of every pattern.

    Columns: key, pattern_id, yields, start, end, surface, norm, clean, occ, occ_cased,
    n_title, n_title_cased, title_like. The first seven but ``yields`` are the span
    table; the rest feeds the per-text tables. ``df`` is the document frequency and is
    computed from ``texts`` where it is needed and not given.
    """
    registry = REGISTRY if registry is None else registry
    stoplists = STOPLISTS if stoplists is None else stoplists
    scans = _scans(registry)
    masks = sorted({p.mask for p in registry if p.mask})
    needs_titles = any(p.title for p in registry)

    src = texts.select(F.col(key).alias("text_id"), guarded(text).alias("text"))
    src = src.select("text_id", "text", straighten_right("text").alias("straight"),
                     *[F.when(holds_mark("text", MARKS["mask"]), mask_lines("text", MASK_REGEX[m])).otherwise(F.col("text")).alias("mask_" + m) for m in masks])
    src = src.withColumn("low", F.lower("straight"))
    # one walk over the words of a text answers for all patterns that need some; a small array stays
    asked = sorted({w for p in registry for group in needed_words(p) for w in group})
    src = src.withColumn("held", F.array_intersect(ascii_words(plain_lower("straight")), _strings(asked)) if asked else F.lit(None))

    # so does one test for each mark that some patterns need
    marks = sorted({(mask if not lower else None, lower, w) for (_, _, mask, *_), ps in scans for wanted, lower in [needs(ps[0])] if not needed_words(ps[0]) for w in wanted}, key=str)
    src = src.withColumn("marks", F.array(*[F.col("low" if lower else "mask_" + mask if mask else "text").contains(w) for mask, lower, w in marks]))

    # title lines are patterns as well as what a title pattern's counts leave out: framed once
    if needs_titles:
        src = src.withColumns({"title_" + kind: title_frame("text", kind) for kind in TITLE_REGEX})
    titles = {rx: "title_" + kind for kind, rx in TITLE_REGEX.items()} if needs_titles else {}

    pieces = []
    for n, ((regex, flags, mask, yields, stop, reject, max_words), ps) in enumerate(scans):
        source = F.col("mask_" + mask if mask else "text")
        ready = JAVA_READY.get(regex, regex)
        if regex in titles and flags == "m" and not mask:
            cut = F.col(titles[regex])
        elif yields == "statement":
            cut = framed(source, java_flags(flags) + ready)
        else:
            cut = frame_named(source, ready, flags)
        wanted, lower = needs(ps[0])
        groups = needed_words(ps[0])
        if regex in titles and flags == "m" and not mask:
            pass
        elif groups:
            cut = F.when(reduce(Column.__and__, [F.arrays_overlap("held", _strings(g)) for g in groups]), cut)
        elif wanted:
            cut = F.when(any_of(F.get("marks", F.lit(marks.index((mask if not lower else None, lower, w)))) for w in wanted), cut)
        pieces.append(F.struct(
            F.lit(n).alias("scan"), cut.alias("cut"), F.lit(yields).alias("yields"),
            _strings(stoplists.get(stop) if stop else ()).alias("stop"),
            F.lit(reject).cast("string").alias("reject"), F.lit(max_words).cast("int").alias("max_words")))

    def raw_hits(p):
        def shape(s, e, record):
            sentence = enclosing_sentence("text", s, e)
            found = F.when(p["yields"] == "statement", sentence).otherwise(named_span(s, e, record))
            return let(found, lambda h: let(F.when(p["yields"] == "statement", F.lit("")).otherwise(
                clean(h["surface"])), lambda c: F.struct(
                    p["scan"].alias("scan"), h["start"].alias("start"), h["end"].alias("end"),
                    h["surface"].alias("surface"), c.alias("clean"), F.lower(c).alias("norm"))))

        def kept(h):
            name = ((h["norm"] != "") & (p["stop"].isNull() | ~F.array_contains(p["stop"], h["norm"]))
                    & (p["reject"].isNull() | ~F.rlike(h["clean"], F.coalesce(p["reject"], F.lit(""))))
                    & (p["max_words"].isNull() | (F.size(F.split(h["norm"], " ")) <= p["max_words"]))
                    & h["norm"].rlike("[a-z]"))
            return (F.when(p["yields"] == "statement", h["surface"] != "")
                    .when(p["yields"] == "namer", h["norm"] != "").otherwise(name))

        def distinct(hits):
            # a sentence is one hit of its pattern however many phrases stand in it
            return F.filter(hits, lambda h, i: (p["yields"] != "statement") | (i == 0) | (
                F.get(hits, i - 1)["start"] != h["start"]))

        return F.filter(let(spans_of(p["cut"], shape), distinct), kept)

    with_match = F.filter(F.array(*pieces), lambda p: F.size(p["cut"]) > 1)
    src = src.select("text_id", "straight", "low", F.flatten(F.transform(with_match, raw_hits)).alias("hits"),
                     *([title_spans(["title_" + kind for kind in TITLE_REGEX]).alias("titles")] if needs_titles else []))
    named = [n for n, (k, _) in enumerate(scans) if k[3] == "name"]
    names = F.filter("hits", lambda h: h["scan"].isin(named))
    src = src.withColumn("norms", F.array_distinct(F.transform(names, lambda h: h["norm"])))
    src = src.withColumn("cleans", F.array_distinct(F.transform(names, lambda h: h["clean"])))
    src = src.select(
        "text_id", "hits", *(["titles"] if needs_titles else []),
        F.map_from_arrays("norms", F.transform("norms", lambda n: occurrences("low", n))).alias("occ"),
        F.map_from_arrays("cleans", F.transform("cleans", lambda c: occurrences_cased("straight", c))).alias("cased"))

    def rows(h):
        if needs_titles:
            spans = F.filter("titles", lambda t: t["norm"] == h["norm"])
            n_title, n_title_cased = F.size(spans), F.size(F.filter(spans, lambda t: t["clean"] == h["clean"]))
        else:
            n_title = n_title_cased = F.lit(0)
        return F.struct(h["scan"].alias("scan"), h["start"].alias("start"), h["end"].alias("end"),
                        h["surface"].alias("surface"), h["norm"].alias("norm"), h["clean"].alias("clean"),
                        F.element_at("occ", h["norm"]).alias("occ"), F.element_at("cased", h["clean"]).alias("occ_cased"),
                        n_title.alias("n_title"), n_title_cased.alias("n_title_cased"))

    out = src.select("text_id", F.inline(F.transform("hits", rows)))
    # a scan may serve several patterns that differ in what the body must do with a title
    settings = F.array(*[F.array(*[F.struct(
        F.lit(p.id).alias("pattern_id"), F.lit(p.yields).alias("yields"), F.lit(p.body if p.title else None).cast("string").alias("body"),
        F.lit(p.min_occ).cast("int").alias("min_occ"), F.lit(p.max_df).cast("double").alias("max_df"),
        F.lit(p.title_like).alias("title_like")) for p in ps]) for _, ps in scans])
    cell = (F.when(F.col("occ_cased") - F.col("n_title_cased") >= 1, "cased")
            .when(F.col("occ") - F.col("n_title") >= 1, "lower").otherwise("only"))
    out = out.withColumn("cell", cell)
    chosen = F.filter(F.get(settings, F.col("scan")), lambda p: (
        (p["body"].isNull() | (p["body"] == F.col("cell"))) & (p["min_occ"].isNull() | (F.col("occ") >= p["min_occ"]))))
    out = out.select("*", F.inline(chosen)).drop("scan", "cell", "body", "min_occ")
    thresholds = [p.max_df for p in registry if p.max_df]
    if thresholds:
        out = drop_common(out, doc_freq(texts, text) if df is None else df, min(thresholds))
    return out.drop("max_df").withColumnRenamed("text_id", key)


def line_test(pattern):
    """Whether a line may hold a match, by the strings and words that the registry knows for ``pattern``; None where it knows
    none. ``low`` of a line is ``plain_lower`` of it."""
    wanted, lower = needs(pattern)
    groups = sorted(needed_words(pattern), key=len)

    def holds(line):
        asked = [any_of(line["low" if lower else "line"].contains(w) for w in wanted)] if wanted else []
        return reduce(Column.__and__, asked + [any_of(line["low"].contains(w) for w in group) for group in groups])

    return holds if wanted or groups else None


def plain_lower(text):
    """Lower case, with ASCII for what a pattern that ignores case takes for ASCII."""
    return F.lower(replaced(text, *LIKE_ASCII))


def ascii_words(text):
    return F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))


#: What a line must hold to be masked or to be a title line of each kind.
MARKS = {"mask": ("#", "**"), "heading": ("#",), "bold_line": ("**",), "list_head": (".", ")", "-", "*", "•")}


def holds_mark(text, marks):
    return any_of(F.col(text).contains(m) for m in marks)


def straighten_right(col):
    return replaced(col, "’", "'")


def title_frame(text, kind: str):
    """A text framed by one kind of title line; whole where no line can be one."""
    return F.when(holds_mark(text, MARKS[kind]), frame_named(F.col(text), TITLE_REGEX[kind], "m")).otherwise(F.array(F.lit("")))


def title_spans(frames):
    """Title captures of a text as array<struct<norm,clean,start>>, one per place."""
    found = [spans_of(F.col(f) if isinstance(f, str) else f, named_span) for f in frames]
    shaped = F.transform(F.flatten(F.array(*found)), lambda t: F.struct(
        norm(t["surface"]).alias("norm"), clean(t["surface"]).alias("clean"), t["start"].alias("start")))
    return F.array_distinct(F.filter(shaped, lambda t: t["norm"] != ""))


def title_lines(text):
    """``title_spans`` of a text that is not framed yet."""
    return title_spans([title_frame(text, kind) for kind in TITLE_REGEX])


def drop_common(mentions: DataFrame, df: DataFrame, floor: float) -> DataFrame:
    """Drop one-word captures whose word is too frequent in the corpus.

    Only words above the lowest threshold are joined. A text has a bounded number of
    distinct words, so the number of words in more than a given share of texts is bounded
    whatever the corpus size; adaptive execution broadcasts them when they measure small.
    Rows that need no check get a key of their own, so they do not pile up on one task.
    """
    common = df.filter(F.col("df") > floor).select(F.col("word").alias("_word"), "df")
    asks = F.col("max_df").isNotNull() & ~F.col("norm").contains(" ")
    keyed = mentions.withColumn("_word", F.when(asks, F.col("norm")).otherwise(
        F.concat(F.lit("\u0000"), F.col("text_id").cast("string"))))
    joined = keyed.join(common, "_word", "left")
    return joined.filter(~(asks & (F.coalesce("df", F.lit(0.0)) > F.col("max_df")))).drop("_word", "df")


def spans_only(mentions: DataFrame, key: str = "text_id") -> DataFrame:
    """The span table without the counting columns."""
    return mentions.select(key, "pattern_id", "start", "end", "surface", "norm")
