"""Measuring extractors against people: precision, recall, agreement, calibration."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.functions.text import STEMS, band, fold_compare, holds_word, level_rank, norm, pct
from spanloom.operators.intervals import caught, merge_spans, overlap_flag
from spanloom.operators.tables import count_if

MIN_READ = 20
NAME_CODES = ("b", "p", "t", "s")
READ_CODES = ("b", "p", "t", "s", "x")


def inherit(verdicts: DataFrame, heirs: DataFrame, active: DataFrame) -> DataFrame:
    """Verdicts with the pattern they count for: their own while it is active, and every
    pattern that was split out of it (``heirs``: source, target)."""
    own = verdicts.join(active.select(F.col("id").alias("pattern")), "pattern", "left_semi").select(
        "*", F.col("pattern").alias("target"), F.lit(True).alias("own"))
    taken = verdicts.join(heirs.withColumnRenamed("source", "pattern"), "pattern").withColumn("own", F.lit(False))
    return own.unionByName(taken.select(*own.columns))


def pattern_eval(verdicts: DataFrame, mentions: DataFrame, heirs: DataFrame, active: DataFrame,
                 min_read: int = MIN_READ) -> DataFrame:
    """Counts per verdict code, precision, and verdicts whose hit is gone.

    A verdict stays attached while the pattern still catches an overlapping span.
    """
    v = inherit(verdicts, heirs, active).withColumnRenamed("text", "text_id").drop("pattern")
    v = v.withColumnRenamed("target", "pattern_id")
    live = mentions.select("pattern_id", "text_id", "start", "end")
    v = overlap_flag(v, live, ["pattern_id", "text_id"])
    alive, gone = F.col("alive"), ~F.col("alive") & F.col("own")
    names = dict(b="n_being", p="n_place", t="n_thing", s="n_statement", x="n_not", g="n_broken")
    out = v.groupBy("pattern_id").agg(
        count_if(alive & F.col("verdict").isin(*READ_CODES)).alias("n_read"),
        *[count_if(alive & (F.col("verdict") == code)).alias(c) for code, c in names.items()],
        count_if(gone).alias("n_gone"), count_if(gone & F.col("verdict").isin("x", "g")).alias("n_gone_not"))
    hits = F.col("n_being") + F.col("n_place") + F.col("n_thing") + F.col("n_statement")
    return out.withColumn("precision", F.when(F.col("n_read") >= min_read, F.round(hits / F.col("n_read"), 3)))


def recall_scores(recall: DataFrame, names: DataFrame) -> DataFrame:
    """Names seen by eye against the scores they have now; 0.0 where nothing caught them."""
    seen = recall.select("check", "date", F.coalesce("pool", F.lit("covered")).alias("pool"), F.col("text").alias("text_id"),
                         "read_chars", F.explode_outer("names").alias("name", "then_caught"), "forms_missed", "note")
    keyed = seen.withColumn("norm", norm("name"))
    now = names.select("text_id", "norm", F.col("score").alias("score_now"), F.col("patterns").alias("patterns_now"))
    joined = keyed.join(now, ["text_id", "norm"], "left").drop("norm")
    return joined.withColumn("score_now", F.when(F.col("name").isNotNull(), F.coalesce("score_now", F.lit(0.0))))


def recall_summary(scored: DataFrame) -> DataFrame:
    """Per check and pool: texts, texts without a name, names, caught then and now by band."""
    old = F.col("then_caught").try_cast("double")
    then = (F.when(F.col("then_caught") == "strict", "hi").when(F.col("then_caught") == "wide", "lo")
            .when(F.col("then_caught") == "missed", "none").otherwise(band(old)))
    now = band("score_now")
    named = F.col("name").isNotNull()

    def bands(x, prefix):
        return [count_if(named & (x == "hi")).alias(prefix + "_hi"), count_if(named & x.isin("mid", "lo")).alias(prefix + "_low"),
                count_if(named & (x == "none")).alias(prefix + "_none")]

    out = scored.groupBy("check", "pool").agg(
        F.max("date").alias("date"), F.countDistinct("text_id").alias("texts"),
        F.countDistinct(F.when(~named, F.col("text_id"))).alias("texts_no_name"), count_if(named).alias("names"),
        *bands(then, "then"), *bands(now, "now"))
    return out.withColumn("then_pct", pct("then_hi", "names")).withColumn("now_pct", pct("now_hi", "names"))


def no_name_share(scored: DataFrame) -> DataFrame:
    """Share of texts in which no name was seen, per check and pool."""
    out = scored.groupBy("check", "pool").agg(
        F.countDistinct("text_id").alias("texts"),
        F.countDistinct(F.when(F.col("name").isNull(), F.col("text_id"))).alias("no_name"))
    return out.withColumn("no_name_pct", pct("no_name", "texts"))


def agreement(df: DataFrame, first="first", second="second") -> DataFrame:
    """Two readers: exact code, name or not, being or not."""
    a, b = F.col(first), F.col(second)
    out = df.agg(F.count(F.lit(1)).alias("n"), count_if(a == b).alias("exact"),
                 count_if(a.isin(*NAME_CODES) == b.isin(*NAME_CODES)).alias("name_or_not"),
                 count_if((a == "b") == (b == "b")).alias("being_or_not"))
    return out.select("*", *[pct(c, "n").alias(c + "_pct") for c in ("exact", "name_or_not", "being_or_not")])


def disagreements(df: DataFrame, first="first", second="second") -> DataFrame:
    return df.filter(F.col(first) != F.col(second)).groupBy(first, second).agg(F.count(F.lit(1)).alias("n"))


def compare_levels(gold: DataFrame, pred: DataFrame, key="text_id") -> DataFrame:
    """Texts with both levels, side by side with their ranks."""
    both = gold.select(key, F.col("level").alias("gold")).join(pred.select(key, F.col("level").alias("pred")), key)
    return both.withColumn("gold_rank", level_rank("gold")).withColumn("pred_rank", level_rank("pred"))


def level_agreement(both: DataFrame) -> DataFrame:
    """Exact, part-or-more and is-agreement; shares; false positives and negatives."""
    g, p = F.col("gold_rank") >= 1, F.col("pred_rank") >= 1
    gi, pi = F.col("gold") == "is", F.col("pred") == "is"
    out = both.agg(F.count(F.lit(1)).alias("n"), count_if(F.col("gold") == F.col("pred")).alias("exact"),
                   count_if(g == p).alias("part_or_more"), count_if(gi == pi).alias("is_agrees"),
                   count_if(~g & p).alias("false_pos"), count_if(g & ~p).alias("false_neg"),
                   count_if(g).alias("gold_part"), count_if(p).alias("pred_part"), count_if(gi).alias("gold_is"),
                   count_if(pi).alias("pred_is"))
    return out.select("*", *[pct(c, "n").alias(c + "_pct") for c in ("gold_part", "pred_part", "gold_is", "pred_is")])


def confusion(both: DataFrame) -> DataFrame:
    return both.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def word_keys(col) -> Column:
    """The words, runs of a-z, of a string: where one string stands in another with no letter on either side, the other has
    all its words."""
    return F.array_distinct(F.regexp_extract_all(F.col(col), F.lit("[a-z]+"), F.lit(0)))


def gram_keys(col, n: int = 3) -> Column:
    """The stretches of ``n`` characters of a string: one that holds another has all its stretches."""
    at = F.when(F.length(col) >= n, F.sequence(F.lit(1), F.length(col) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(F.col(col), i, F.lit(n))))


def held_pairs(inner: DataFrame, outer: DataFrame, i: str, o: str, keys) -> DataFrame:
    """Pairs of strings of a text of which ``i`` may stand in ``o``: those where ``o`` has the key of ``i``, its longest one (ties:
    the first in order). A string without keys meets every string of its text."""
    longest = F.array_max(F.transform(keys(i), lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    asked = inner.withColumn("_k", F.coalesce(longest, F.lit("")))
    held = outer.withColumn("_k", F.explode(F.concat(keys(o), F.array(F.lit("")))))
    return asked.join(held, ["text_id", "_k"]).drop("_k")


def candidate_pairs(asked: DataFrame, labels: DataFrame, keys) -> DataFrame:
    """text_id, _s, _l and the other columns of ``labels``: pairs worth an exact test, in either direction."""
    near = labels.join(asked.select("text_id").distinct(), "text_id", "left_semi")
    one, two = held_pairs(asked, near, "_s", "_l", keys), held_pairs(near, asked, "_l", "_s", keys)
    return one.select("text_id", "_s", *[c for c in labels.columns if c != "text_id"]).unionByName(two.select("text_id", "_s", *[c for c in labels.columns if c != "text_id"]))


def match_label(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Judged strings with two flags: a label of the text equals it, holds it as a whole word,
    or stands in it as a whole word; by the first pass, by either pass.

    Only ``candidate_pairs`` that share a word are tested, each once: an index of the words of either side stands before the
    regex. ``verdicts`` is hand-made and small; ``labels`` is the large side.
    """
    # each is read several times below, and comes from a walk over all texts
    v = verdicts.select("*", fold_compare("surface", "verdict").alias("_s")).persist()
    l = labels.select("text_id", fold_compare("label", "verdict").alias("_l"), (F.col("source") == "quote").alias("_q"))
    l = l.groupBy("text_id", "_l").agg(F.max("_q").alias("_q")).persist()
    whole = lambda x, y: F.contains(x, y) & holds_word(x, y)
    match = (F.col("_s") == F.col("_l")) | whole(F.col("_l"), F.col("_s")) | ((F.col("_l") != "") & whole(F.col("_s"), F.col("_l")))
    keys = ["text_id", "_s"]
    hits = candidate_pairs(v.select(*keys).distinct(), l, word_keys).filter(match)
    hits = hits.groupBy(*keys).agg(F.max("_q").alias("first"), F.lit(True).alias("either"))
    return v.join(hits, keys, "left").fillna(False, ["first", "either"]).drop("_s")


def verdict_recall(matched: DataFrame) -> DataFrame:
    """Judged hits per code, held by the first pass, by either."""
    return matched.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("first")).alias("first"),
                                          count_if(F.col("either")).alias("both"))


def word_recall(texts: DataFrame, labels: DataFrame, stems=STEMS) -> DataFrame:
    """Per word: texts that hold it anywhere, and those with a label that holds it."""
    def found(col):
        return F.array_compact(F.array(*[F.when(F.col(col).rlike(r"(?i)(?<![A-Za-z])%ss?(?![A-Za-z])" % w), F.lit(w))
                                         for w in stems]))

    in_text = texts.select("text_id", F.explode(found("text")).alias("word"))
    in_label = labels.select("text_id", F.explode(found("label")).alias("word")).distinct().withColumn("held", F.lit(True))
    return in_text.join(in_label, ["text_id", "word"], "left").groupBy("word").agg(
        F.count(F.lit(1)).alias("texts"), count_if(F.col("held")).alias("in_a_label"))


def match_loose(hand: DataFrame, labels: DataFrame) -> DataFrame:
    """Hand-marked labels with ``found``: some label of the text contains it or stands in it. Only pairs that share the
    stretch of three characters that the shorter must bring are tested."""
    # each is read several times below, and comes from a walk over all texts
    h = hand.select("*", fold_compare(F.ltrim(F.col("label"), F.lit("!")), "hand").alias("_s")).persist()
    l = labels.select("text_id", fold_compare("label", "hand").alias("_l")).distinct().persist()
    keys = ["text_id", "_s"]
    near = F.col("_l").contains(F.col("_s")) | F.col("_s").contains(F.col("_l"))
    hit = candidate_pairs(h.select(*keys).distinct(), l, gram_keys).filter(near).select(*keys).distinct().withColumn("found", F.lit(True))
    return h.join(hit, keys, "left").fillna(False, ["found"]).drop("_s")


def pilot_recall(matched: DataFrame) -> DataFrame:
    """Marked, found, and missed denials (a leading ``!``)."""
    return matched.agg(F.count(F.lit(1)).alias("marked"), count_if(F.col("found")).alias("found"),
                       count_if(~F.col("found") & F.col("label").startswith("!")).alias("missed_denials"))


def answer_agreement(hand: DataFrame, model: DataFrame, questions) -> DataFrame:
    """Per question: texts in which hand marks and model agree that it is answered or not.
    Both: text_id and one array of sentence numbers per question, one row per being."""
    def flags(df, suffix):
        return df.groupBy("text_id").agg(*[F.max(F.size(q) > 0).alias(q + suffix) for q in questions])

    both = flags(hand, "_h").join(flags(model, "_m"), "text_id")
    long = both.select(F.explode(F.array(*[F.struct(F.lit(q).alias("question"), (F.col(q + "_h") == F.col(q + "_m")).alias("same"))
                                           for q in questions])).alias("r")).select("r.*")
    return long.groupBy("question").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("same")).alias("agree"))


def extractor_recall(anchors: DataFrame, quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Anchors (text_id, start, end, core) wholly inside a quote, and share of text kept.
    Only texts with an answer count."""
    answered = quotes.select("text_id").distinct()
    a = anchors.join(answered, "text_id", "left_semi")
    hit = caught(a, quotes, ["text_id"]).select("text_id", "start", "end").distinct().withColumn("hit", F.lit(True))
    scored = a.join(hit, ["text_id", "start", "end"], "left")
    asked = a.select("text_id").distinct()
    merged = merge_spans(quotes.join(asked, "text_id", "left_semi"), ["text_id"])
    chars = merged.select(F.sum(F.col("end") - F.col("start"))).scalar()
    length = texts.join(asked, "text_id", "left_semi").select(F.sum(F.length("text"))).scalar()
    got, core = F.col("hit").isNotNull(), F.col("core")
    return scored.agg(F.count(F.lit(1)).alias("anchors"), count_if(got).alias("got"), count_if(core).alias("core"),
                      count_if(core & got).alias("got_core")).select("*", pct(chars, length).alias("kept_pct"))


def missed_core(anchors: DataFrame, quotes: DataFrame) -> DataFrame:
    from spanloom.operators.intervals import not_covered
    return not_covered(anchors.filter("core"), quotes, ["text_id"])


def quote_context_stats(quotes: DataFrame, texts_with_heading: DataFrame, named: DataFrame) -> DataFrame:
    """Quotes under a heading, texts with one, names in a quote or its heading."""
    return quotes.agg(F.count(F.lit(1)).alias("quotes"), count_if(F.col("heading") != "").alias("under_heading")).select(
        "*", texts_with_heading.select(F.count(F.lit(1))).scalar().alias("texts_with_heading"),
        named.select(F.count(F.lit(1))).scalar().alias("names"),
        named.select(F.count_if(F.col("in_quote"))).scalar().alias("in_quote"),
        named.select(F.count_if(F.col("in_quote_or_heading"))).scalar().alias("in_quote_or_heading"))


def adjudicate(first: DataFrame, second: DataFrame, rulings: DataFrame, keys) -> DataFrame:
    """Two readings key by key, with rulings laid over the first."""
    def long(df, name):
        return df.unpivot(["text"], list(keys), "key", name)

    both = long(first, "first").join(long(second, "second"), ["text", "key"], "left")
    ruled = both.join(rulings.select("text", "key", "ruling"), ["text", "key"], "left")
    return ruled.withColumn("final", F.coalesce("ruling", "first")).withColumn("agree", F.col("first").eqNullSafe(F.col("second")))


def reading_agreement(adjudicated: DataFrame) -> DataFrame:
    return adjudicated.filter(F.col("second").isNotNull()).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("agree")).alias("agree"))


def first_read(readings: DataFrame) -> DataFrame:
    """First round in which a text was read."""
    return readings.groupBy("text_id").agg(F.min("round").alias("first_round"))


def record_verdicts(sample: DataFrame, codes: str, recorded: DataFrame, allowed="bptsxg") -> DataFrame:
    """One code per sampled hit, in the sample's order (column no from 1); only hits that
    carry no verdict yet come back."""
    codes = codes.replace(" ", "")
    if set(codes) - set(allowed):
        raise ValueError("unknown verdict code")
    n = sample.count()
    if len(codes) != n:
        raise ValueError("verdicts: %d, sample: %d" % (len(codes), n))
    coded = sample.withColumn("verdict", F.substring(F.lit(codes), F.col("no"), F.lit(1)))
    return coded.join(recorded.select("pattern", "text", "start", "end"), ["pattern", "text", "start", "end"], "left_anti")
