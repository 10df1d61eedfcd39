"""Questions over beings: shares, arrangements, co-occurrence, contrasts, trends.

A being is a row with id, text_id, model, words (array, no repeats), n_<question> counts
and whatever facts were joined to it. Nothing here pairs rows of a group; pair counts
come from counts per group.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.functions.text import ERAS, STEMS, era, half_year, pct
from spanloom.operators.answers import QUESTIONS
from spanloom.operators.sampling import before, top_k, upper_median
from spanloom.operators.tables import count_if

ARRANGEMENTS = ("solo", "stacked", "ensemble")


def share(cond, places: int = 1):
    """Percent of rows that pass."""
    return F.round(100.0 * count_if(cond) / F.count(F.lit(1)), places)


def lexicon_labels(labels: DataFrame, stems=STEMS) -> DataFrame:
    """Labels that hold a lexicon word, first written form per text and string."""
    hits = labels.filter(F.col("norm").rlike("(?<![a-z])(%s)s?(?![a-z])" % "|".join(stems)))
    return hits.groupBy("text_id", "norm").agg(F.min_by("label", F.struct("start", "end", "label")).alias("label"))


def arrangement(beings: DataFrame) -> DataFrame:
    """Per text with a worded being: solo, stacked or ensemble."""
    worded = beings.filter(F.size("words") > 0)
    per = worded.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("words")).alias("w"), F.min("model").alias("model"))
    kind = F.when(F.col("n") > 1, "ensemble").when(F.col("w") > 1, "stacked").otherwise("solo")
    return per.select("text_id", "model", F.col("n").alias("n_worded"), kind.alias("arrangement"))


def focus(sents: DataFrame) -> DataFrame:
    """Distinct sentences listed for a being under any question."""
    return sents.groupBy("being_id", "no").agg(F.lit(1)).groupBy(F.col("being_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_listed"))


def being_facts(beings: DataFrame, sents: DataFrame, care_texts: DataFrame, dates: DataFrame) -> DataFrame:
    """Beings with sentences of their text, arrangement, release date, period and focus."""
    kind = arrangement(beings).select("text_id", "arrangement")
    out = (beings.join(care_texts.select("text_id", "n_sentences"), "text_id", "left")
           .join(kind, "text_id", "left").join(focus(sents), "id", "left")
           .join(dates.select("model", F.col("date").alias("released")), "model", "left").fillna(0, ["n_listed"]))
    worded = F.when(F.size("words") > 0, F.col("arrangement"))
    return out.withColumn("arrangement", worded).withColumn("era", era("released")).withColumn(
        "focus", F.round(F.try_divide(F.col("n_listed"), F.col("n_sentences")), 3))


def question_shares(beings: DataFrame, questions=QUESTIONS) -> DataFrame:
    """Per question: beings with an answer, their share, sentences listed."""
    long = beings.select(F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col("n_" + q).alias("n")) for q in questions])).alias("r")).select("r.*")
    return long.groupBy("question").agg(count_if(F.col("n") > 0).alias("beings"), share(F.col("n") > 0).alias("pct"),
                                        F.sum("n").cast("long").alias("sentences"))


def writer_table(beings: DataFrame, care_texts: DataFrame, corpus: DataFrame, questions=QUESTIONS) -> DataFrame:
    """Per writer: texts in the corpus, lexicon texts and share, beings, median sentences,
    answer shares, arrangement shares. ``corpus``: model, texts."""
    b = beings.groupBy("model").agg(F.count(F.lit(1)).alias("beings"), F.countDistinct("text_id").alias("care_texts"),
                                    *[share(F.col("n_" + q) > 0).alias(q + "_pct") for q in questions])
    kinds = arrangement(beings).groupBy("model").agg(*[share(F.col("arrangement") == k).alias(k + "_pct") for k in ARRANGEMENTS])
    median = upper_median(care_texts, "model", "n_sentences", "median_sentences")
    out = b.join(corpus, "model", "left").join(kinds, "model", "left").join(median, "model", "left")
    return out.withColumn("care_pct", pct("care_texts", "texts"))


def word_table(beings: DataFrame, questions=QUESTIONS, low: int = 30, high: int = 60, contrast: str = "cost") -> DataFrame:
    """Per word: beings, texts, writers, answer shares, the contrast question inside a length
    band and against all other beings (totals minus the word's own). ``beings`` carries
    n_sentences."""
    yes = F.col("n_" + contrast) > 0
    inside = F.col("n_sentences").between(low, high)
    w = beings.withColumn("word", F.explode("words"))
    per = w.groupBy("word").agg(
        F.count(F.lit(1)).alias("beings"), F.countDistinct("text_id").alias("texts"), F.countDistinct("model").alias("writers"),
        *[share(F.col("n_" + q) > 0).alias(q + "_pct") for q in questions],
        count_if(yes).alias("_yes"), count_if(inside).alias("_in"), count_if(inside & yes).alias("_in_yes"))
    n, y = beings.select(F.count(F.lit(1))).scalar(), beings.select(F.count_if(yes)).scalar()
    own = F.col("_yes") / F.col("beings")
    others = F.try_divide(y - F.col("_yes"), n - F.col("beings"))
    return per.select("*", pct("_in_yes", "_in").alias(contrast + "_band_pct"),
                      F.round(100.0 * (own - others), 1).alias(contrast + "_diff")).drop("_yes", "_in", "_in_yes")


def within_contrast(df: DataFrame, group, side, value, least: int = 8, by=()) -> DataFrame:
    """Difference of shares between the two sides inside each group with at least ``least``
    rows on both, weighted by the smaller side and pooled, in points. NULL sides are left out."""
    by = list(by)
    v = F.when(value, 1.0).otherwise(0.0) if not isinstance(value, str) else F.col(value)
    per = df.withColumn("_side", side).groupBy(*by, group).agg(
        count_if(F.col("_side")).alias("na"), count_if(~F.col("_side")).alias("nb"),
        F.avg(F.when(F.col("_side"), v)).alias("ma"), F.avg(F.when(~F.col("_side"), v)).alias("mb"))
    k = F.least("na", "nb")
    fits = per.filter((F.col("na") >= least) & (F.col("nb") >= least)).withColumn("k", k)
    pooled = [F.count(F.lit(1)).alias("groups"), F.sum("k").alias("weight"),
              F.round(100.0 * F.try_divide(F.sum(F.col("k") * (F.col("ma") - F.col("mb"))), F.sum("k")), 1).alias("points")]
    return fits.groupBy(*by).agg(*pooled) if by else fits.agg(*pooled)


def word_contrast(beings: DataFrame, question: str, stems, least: int = 8) -> DataFrame:
    """``within_contrast`` of every word against the writer's other beings, in one pass: the
    other side of a word is the writer's total minus the word's."""
    yes = F.col("n_" + question) > 0
    total = beings.groupBy("model").agg(F.count(F.lit(1)).alias("n"), count_if(yes).alias("y"))
    own = beings.withColumn("word", F.explode("words")).filter(F.col("word").isin(*stems)).groupBy("model", "word").agg(
        F.count(F.lit(1)).alias("na"), count_if(yes).alias("ya"))
    both = own.join(total, "model").withColumn("nb", F.col("n") - F.col("na")).withColumn("yb", F.col("y") - F.col("ya"))
    fits = both.filter((F.col("na") >= least) & (F.col("nb") >= least)).withColumn("k", F.least("na", "nb"))
    diff = F.col("ya") / F.col("na") - F.col("yb") / F.col("nb")
    return fits.groupBy("word").agg(F.count(F.lit(1)).alias("writers"),
                                    F.round(100.0 * F.sum(F.col("k") * diff) / F.sum("k"), 1).alias("points"))


def arrangement_stats(facts: DataFrame) -> DataFrame:
    """Per arrangement: texts, beings, answer shares, mean focus, mean sentences."""
    return facts.filter(F.col("arrangement").isNotNull()).groupBy("arrangement").agg(
        F.countDistinct("text_id").alias("texts"), F.count(F.lit(1)).alias("beings"),
        *[share(F.col("n_" + q) > 0).alias(q + "_pct") for q in ("cost", "origin", "fate")],
        F.round(100.0 * F.avg(F.col("n_listed") / F.col("n_sentences")), 1).alias("focus_pct"),
        F.round(F.avg("n_sentences"), 0).cast("long").alias("sentences"))


def ensemble_uniformity(beings: DataFrame) -> DataFrame:
    """Ensembles, and those whose beings all carry the same words; one row."""
    per = beings.filter(F.size("words") > 0).withColumn("set", F.array_join("words", " ")).groupBy("text_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("set").alias("lo"), F.max("set").alias("hi"))
    ens = per.filter(F.col("n") > 1)
    return ens.agg(F.count(F.lit(1)).alias("ensembles"), count_if(F.col("lo") == F.col("hi")).alias("same_words"))


def ensemble_words(beings: DataFrame) -> DataFrame:
    """Distinct words across an ensemble -> number of ensembles."""
    many = arrangement(beings).filter(F.col("arrangement") == "ensemble").select("text_id")
    per = beings.join(many, "text_id", "left_semi").select("text_id", F.explode("words").alias("w")).distinct()
    return per.groupBy("text_id").agg(F.count(F.lit(1)).alias("distinct_words")).groupBy("distinct_words").agg(
        F.count(F.lit(1)).alias("ensembles"))


def word_by_arrangement(facts: DataFrame) -> DataFrame:
    """Per word: beings, share by arrangement, and cost, fate and focus in each."""
    rows = facts.filter(F.size("words") > 0).withColumn("word", F.explode("words"))
    cells = []
    for k in ARRANGEMENTS:
        here = F.col("arrangement") == k
        cells += [share(here).alias(k + "_pct"), F.round(100.0 * F.try_divide(count_if(here & (F.col("n_cost") > 0)), count_if(here)), 1).alias(k + "_cost_pct"),
                  F.round(100.0 * F.try_divide(count_if(here & (F.col("n_fate") > 0)), count_if(here)), 1).alias(k + "_fate_pct"),
                  F.round(100.0 * F.avg(F.when(here, F.col("n_listed") / F.col("n_sentences"))), 1).alias(k + "_focus_pct")]
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("beings"), *cells)


def word_pairs(words):
    """Pairs a < b of one row's words. The words of a row come from a fixed lexicon."""
    ordered = F.array_sort(F.array_distinct(words))
    return F.flatten(F.transform(ordered, lambda a, i: F.transform(
        F.slice(ordered, i + 2, F.size(ordered)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def pair_lift(df: DataFrame, words="words") -> DataFrame:
    """Pairs of words on one row: count, lift over independence, and shares given either."""
    rows = df.filter(F.size(words) > 0)
    n = rows.select(F.count(F.lit(1))).scalar()
    single = rows.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    pairs = rows.select(F.inline(word_pairs(F.col(words)))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab"))
    out = pairs.join(single.select(F.col("w").alias("a"), F.col("n").alias("n_a")), "a").join(
        single.select(F.col("w").alias("b"), F.col("n").alias("n_b")), "b")
    expected = F.col("n_a") * F.col("n_b") / n
    return out.select("a", "b", "n_ab", "n_a", "n_b", F.round(expected, 3).alias("expected"), F.round(F.col("n_ab") / expected, 3).alias("lift"),
                      pct("n_ab", "n_a").alias("given_a_pct"), pct("n_ab", "n_b").alias("given_b_pct"))


def lowest_lift(pairs: DataFrame, least_expected: float = 30, k: int = 8) -> DataFrame:
    return pairs.filter(F.col("expected") >= least_expected).orderBy("lift", "a", "b").limit(k)


def pairs_across(beings: DataFrame) -> DataFrame:
    """Per text and pair of unlike words a < b: unordered pairs of beings of which one carries
    a and the other b.

    With A and B beings carrying a word and AB carrying both, these are A*B - AB - AB(AB-1)/2:
    ordered choices of two beings, less the pairs met twice. No pair of beings is formed.
    """
    worded = beings.filter(F.size("words") > 0)
    single = worded.select("text_id", F.explode("words").alias("w")).groupBy("text_id", "w").agg(F.count(F.lit(1)).alias("n"))
    both = worded.select("text_id", F.inline(word_pairs(F.col("words")))).groupBy("text_id", "a", "b").agg(F.count(F.lit(1)).alias("ab"))
    # the words of a text come from a fixed lexicon, so its word counts fit one row
    table = single.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("w", "n"))).alias("ws"))
    pairs = table.select("text_id", F.inline(F.flatten(F.transform("ws", lambda x, i: F.transform(
        F.slice(F.col("ws"), i + 2, F.size("ws")), lambda y: F.struct(
            x["w"].alias("a"), y["w"].alias("b"), x["n"].alias("na"), y["n"].alias("nb")))))))
    out = pairs.join(both, ["text_id", "a", "b"], "left").fillna(0, ["ab"])
    n = F.col("na") * F.col("nb") - F.col("ab") - (F.col("ab") * (F.col("ab") - 1) / 2).cast("long")
    return out.select("text_id", "a", "b", n.alias("n")).filter(F.col("n") > 0)


def pair_across(beings: DataFrame) -> DataFrame:
    """Pairs of words on different beings of one text, counted over the corpus."""
    return pairs_across(beings).groupBy("a", "b").agg(F.sum("n").alias("n"))


def word_sets(beings: DataFrame, k: int = 14) -> DataFrame:
    """Most frequent sets of two or more words."""
    sets = beings.filter(F.size("words") > 1).groupBy(F.array_join("words", " ").alias("words")).agg(F.count(F.lit(1)).alias("n"))
    return sets.orderBy(F.desc("n"), "words").limit(k)


def fold_plural(tokens: DataFrame, vocabulary: DataFrame, col="noun") -> DataFrame:
    """token -> base: the first plural rule whose base is itself in the vocabulary, else the
    token. The vocabulary (column noun) is joined, not collected."""
    t = F.col(col)

    def stem(n):
        return F.expr(f"substring({col}, 1, length({col}) - {n})")

    rules = [(1, t.endswith("ies"), F.concat(stem(3), F.lit("y"))), (2, t.endswith("ves"), F.concat(stem(3), F.lit("f"))),
             (3, t.endswith("ves"), F.concat(stem(3), F.lit("fe"))), (4, t.rlike("(s|x|z|ch|sh|o)es$"), stem(2)),
             (5, t.endswith("s") & ~t.endswith("ss"), stem(1))]
    cands = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("rule"), b.alias("base"))) for n, c, b in rules]))
    distinct = tokens.select(col).distinct()
    known = vocabulary.select(F.col("noun").alias("base")).distinct()
    based = distinct.select(col, F.inline(cands)).join(known, "base", "left_semi")
    best = based.groupBy(col).agg(F.min_by("base", "rule").alias("base"))
    return distinct.join(best, col, "left").select(col, F.coalesce("base", col).alias("base"))


#: Texts of a name in one range of 32,768 text numbers from which they travel as a bitmap of 4 KB, not as rows.
CROWD = 512


def distinct_texts(members: DataFrame, texts: DataFrame, group: str, via: str) -> DataFrame:
    """Per ``group`` the distinct texts of its ``via`` values, exactly: group, texts. ``members``: group, via; ``texts``: via,
    text_id, both without repeats.

    Texts are numbered, and the numbers of a value lie in ranges of 32,768. Where a value has ``CROWD`` texts and more in a range, the
    range is one bitmap that is united bit by bit, so a value that stands in a third of all texts does not meet its groups text by
    text; elsewhere its few numbers travel as they are. A null text does not count.
    """
    held = texts.filter(F.col("text_id").isNotNull())
    numbers = before(held.select("text_id").distinct().withColumn("_one", F.lit(1)), "text_id", "_one", "_no").select("text_id", "_no")
    placed = held.join(numbers, "text_id").select(via, F.bitmap_bucket_number("_no").alias("_cell"), F.bitmap_bit_position("_no").alias("_bit"))
    # counted first: a bitmap has 4 KB however few texts it holds, so only crowded ranges get one
    crowds = placed.groupBy(via, "_cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= CROWD).select(via, "_cell")
    few = placed.join(crowds, [via, "_cell"], "left_anti")
    maps = placed.join(crowds, [via, "_cell"], "left_semi").groupBy(via, "_cell").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    united = members.join(maps, via).groupBy(group, "_cell").agg(F.bitmap_or_agg("_map").alias("_map"))
    single = members.join(few, via).groupBy(group, "_cell").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    both = united.unionByName(single).groupBy(group, "_cell").agg(F.bitmap_or_agg("_map").alias("_map"))
    return both.groupBy(group).agg(F.sum(F.bitmap_count("_map")).alias("texts"))


def kept_by_name(name_texts: DataFrame, kept: DataFrame, least: int = 2) -> DataFrame:
    """Per noun: texts, words that keep it, the three most frequent names. ``name_texts``:
    norm, text_id; ``kept``: norm, nouns, words."""
    rows = kept.select("norm", "words", F.explode(F.array_distinct("nouns")).alias("noun"))
    texts = name_texts.select("norm", "text_id").distinct()
    per = distinct_texts(rows.select("noun", "norm").distinct(), texts, "noun", "norm")
    words_ = rows.select("noun", F.explode("words").alias("w")).distinct().groupBy("noun").agg(F.count(F.lit(1)).alias("n_words"))
    # a name has as many rows for a noun as it has texts, so names are ranked without meeting the texts
    sizes = texts.groupBy("norm").agg(F.count(F.lit(1)).alias("_texts"))
    times = rows.groupBy("noun", "norm").agg(F.count(F.lit(1)).alias("_times"))
    names = times.join(sizes, "norm").select("noun", "norm", (F.col("_times") * F.col("_texts")).alias("n"))
    top = top_k(names, "noun", 3, [F.desc("n"), F.asc("norm")]).groupBy("noun").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "norm"))), lambda r: r["norm"]), "; ").alias("as_in"))
    return per.filter(F.col("texts") >= least).join(words_, "noun", "left").join(top, "noun").fillna(0, ["n_words"])


def word_matrix(df: DataFrame, unit: str, stems, noun="noun") -> DataFrame:
    """noun x word: distinct units (texts or beings); columns noun, words, unit."""
    cells = df.select(noun, unit, F.explode("words").alias("w")).distinct()
    return cells.groupBy(noun).pivot("w", list(stems)).agg(F.count(F.lit(1))).fillna(0)


def kept_phrase_table(phrases: DataFrame, least: int = 2) -> DataFrame:
    """X over all words and both forms: texts, words, texts by form. ``phrases``: text_id,
    word, form, x."""
    one = phrases.select("text_id", "word", "form", "x").distinct()
    text = one.groupBy("x", "text_id").agg(F.max(F.col("form") == "pre").alias("pre"), F.max(F.col("form") == "of").alias("of"))
    out = text.groupBy("x").agg(F.count(F.lit(1)).alias("texts"), count_if(F.col("pre")).alias("texts_pre"), count_if(F.col("of")).alias("texts_of"))
    kinds = one.select("x", "word").distinct().groupBy("x").agg(F.count(F.lit(1)).alias("n_words"))
    return out.filter(F.col("texts") >= least).join(kinds, "x")


def kept_phrase_forms(phrases: DataFrame, least: int = 2) -> DataFrame:
    """One row per word, form and X."""
    return phrases.select("text_id", "word", "form", "x").distinct().groupBy("word", "form", "x").agg(
        F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= least)


def sides(beings: DataFrame, kept: DataFrame, side: str) -> DataFrame:
    """Long form of one side: id, noun, words and the being's facts."""
    return kept.select(F.col("being_id").alias("id"), F.explode(F.array_distinct(side)).alias("noun")).join(beings, "id")


def side_table(beings: DataFrame, kept: DataFrame, side: str, least: int = 3) -> DataFrame:
    """Per noun of a side: beings, words."""
    rows = sides(beings, kept, side)
    n = rows.groupBy("noun").agg(F.count(F.lit(1)).alias("beings"))
    w = rows.select("noun", F.explode("words").alias("w")).distinct().groupBy("noun").agg(F.count(F.lit(1)).alias("n_words"))
    return n.filter(F.col("beings") >= least).join(w, "noun", "left").fillna(0, ["n_words"])


def scaled_least(total):
    """25 of 16,400 beings, halves upwards, and never under 4."""
    return F.greatest(F.lit(4), F.floor(25 * total / 16400 + 0.5))


def trend_table(beings: DataFrame, kept: DataFrame, side: str, least: int | None = 25, eras=ERAS) -> DataFrame:
    """Per noun: share of the beings of each period, change in points, ratio last to first.
    Counts and shares are of beings with a period that were read for sides. Where ``least``
    is None it follows the number of such beings, for tables over a selection."""
    dated = beings.filter(F.col("era").isNotNull())
    read = dated.join(kept.select(F.col("being_id").alias("id")), "id", "left_semi")
    total = read.groupBy().pivot("era", list(eras)).agg(F.count(F.lit(1)))
    rows = sides(dated, kept, side)
    if least is None:
        least = scaled_least(read.select(F.count(F.lit(1))).scalar())
    cols = [F.count(F.lit(1)).alias("beings")] + [count_if(F.col("era") == e).alias("_%d" % i) for i, e in enumerate(eras)]
    per = rows.groupBy("noun").agg(*cols).filter(F.col("beings") >= least)
    last = len(eras) - 1
    out = per.select("noun", "beings", *[F.round(F.try_divide(100.0 * F.col("_%d" % i), total.select(F.col("`%s`" % e)).scalar()), 2).alias("p%d" % i)
                                         for i, e in enumerate(eras)])
    return out.withColumn("change", F.round(F.col("p%d" % last) - F.col("p0"), 2)).withColumn(
        "times", F.round(F.try_divide(F.col("p%d" % last), F.col("p0")), 1))


def both_sides(side_for: DataFrame, side_against: DataFrame, least: int = 60, k: int = 10) -> DataFrame:
    """Nouns on both sides, by beings against."""
    joined = side_against.select("noun", F.col("beings").alias("against")).join(
        side_for.select("noun", F.col("beings").alias("for")), "noun")
    return joined.filter(F.col("against") >= least).orderBy(F.desc("against"), F.desc("for"), F.desc("noun")).limit(k)


def leading_noun(rows: DataFrame) -> DataFrame:
    """Per word: the noun with the most beings (the later in the alphabet on a tie)."""
    cells = rows.select("id", "noun", F.explode("words").alias("word")).distinct().groupBy("word", "noun").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("word").agg(F.max_by("noun", F.struct("n", "noun")).alias("noun"), F.max("n").alias("n"))


def family_share(rows: DataFrame, family) -> DataFrame:
    """Per word: beings with any noun of the side, and share of those with a noun of the family."""
    w = rows.select("id", F.explode("words").alias("word"), F.col("noun").isin(*family).alias("f"))
    per = w.groupBy("word", "id").agg(F.max("f").alias("f"))
    out = per.groupBy("word").agg(F.count(F.lit(1)).alias("beings"), count_if(F.col("f")).alias("family"))
    return out.withColumn("family_pct", pct("family", "beings"))


def cohort_writers(facts: DataFrame, least: int = 60, band=(30, 60), band_least: int = 40) -> DataFrame:
    """Writers of ``least`` beings: cost share, and the same inside the length band."""
    cost, inside = F.col("n_cost") > 0, F.col("n_sentences").between(*band)
    out = facts.groupBy("model").agg(F.count(F.lit(1)).alias("beings"), share(cost).alias("cost_pct"),
                                     count_if(inside).alias("band_beings"), count_if(inside & cost).alias("_y"))
    banded = F.when(F.col("band_beings") >= band_least, pct("_y", "band_beings"))
    return out.filter(F.col("beings") >= least).withColumn("band_pct", banded).drop("_y")


def cohort_halves(facts: DataFrame, words=("guardian", "keeper"), least: int = 60, band=(30, 60), band_least: int = 40) -> DataFrame:
    """Per half-year of release (dates from 2020): writers, cost share, the band, word shares."""
    big = facts.groupBy("model").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("model")
    dated = facts.filter(F.col("released") >= "2020-01-01").join(big, "model", "left_semi")
    cost, inside = F.col("n_cost") > 0, F.col("n_sentences").between(*band)
    rows = dated.withColumn("half", half_year("released"))
    per = rows.groupBy("half", "model").agg(
        F.count(F.lit(1)).alias("n"), count_if(cost).alias("y"), count_if(inside).alias("bn"), count_if(inside & cost).alias("by"),
        *[count_if(F.array_contains("words", w)).alias("w_" + w) for w in words])
    out = per.groupBy("half").agg(F.count(F.lit(1)).alias("writers"), F.sum("n").alias("beings"), F.sum("y").alias("_y"),
                                  F.sum("bn").alias("_bn"), F.sum("by").alias("_by"), *[F.sum("w_" + w).alias("w_" + w) for w in words])
    return out.select("half", "writers", "beings", pct("_y", "beings").alias("cost_pct"),
                      F.when(F.col("_bn") >= band_least, pct("_by", "_bn")).alias("band_pct"),
                      *[pct("w_" + w, "beings").alias(w + "_pct") for w in words])


def lineage(facts: DataFrame, prefix: str, words=("guardian", "keeper")) -> DataFrame:
    """Writers of one line in order of release, with the median length of their texts."""
    mine = facts.filter(F.col("model").startswith(prefix) & F.col("released").isNotNull())
    length = upper_median(mine.select("model", "text_id", "n_sentences").distinct(), "model", "n_sentences", "median_sentences")
    return mine.groupBy("model", "released").agg(
        F.count(F.lit(1)).alias("beings"), share(F.col("n_cost") > 0).alias("cost_pct"), share(F.col("n_fate") > 0).alias("fate_pct"),
        *[share(F.array_contains("words", w)).alias(w + "_pct") for w in words]).join(length, "model").orderBy("released", "model")


def level_tables(levels: DataFrame, by: str, least: int = 1) -> DataFrame:
    """Per value of ``by``: texts and shares of the four levels and of part or more.
    ``levels``: text_id, level and the grouping column."""
    more = F.col("level") != "in"
    out = levels.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("texts"), *[share(F.col("level") == x).alias(x + "_pct") for x in ("in", "part", "alive", "is")],
        share(more).alias("part_or_more_pct"))
    return out.filter(F.col("texts") >= least)


def level_totals(levels: DataFrame) -> DataFrame:
    """Texts per level and their share of all."""
    total = levels.select(F.count(F.lit(1))).scalar()
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("texts")).withColumn("pct", F.round(100.0 * F.col("texts") / total, 1))


def level_words(levels: DataFrame, least: int = 1) -> DataFrame:
    """``level_tables`` per lexicon word of a text (``levels``: text_id, level, words)."""
    return level_tables(levels.withColumn("word", F.explode(F.array_distinct("words"))), "word", least)


def level_contrast(levels: DataFrame, by: str, chosen) -> DataFrame:
    """Per value of ``by``: share of part or more among the chosen texts and among the rest."""
    more, c = F.col("level") != "in", F.coalesce(chosen, F.lit(False))
    return levels.filter(F.col(by).isNotNull()).groupBy(by).agg(
        count_if(c).alias("chosen"), count_if(~c).alias("rest"),
        F.round(F.try_divide(100.0 * count_if(c & more), count_if(c)), 1).alias("chosen_pct"),
        F.round(F.try_divide(100.0 * count_if(~c & more), count_if(~c)), 1).alias("rest_pct"))


def presence_lift(labels: DataFrame, groups: DataFrame, probes) -> DataFrame:
    """Share of texts holding a probe word in group P over the share in group I.
    ``groups``: text_id, in_p. Each text counts once per probe."""
    found = F.array_compact(F.array(*[F.when(F.col("norm").rlike("(?<![a-z])%s(s|es)?(?![a-z])" % w), F.lit(w)) for w in probes]))
    flags = labels.select("text_id", F.explode(found).alias("probe")).distinct().join(groups, "text_id")
    n_p, n_i = groups.select(F.count_if("in_p")).scalar(), groups.select(F.count_if(~F.col("in_p"))).scalar()
    per = flags.groupBy("probe").agg(count_if(F.col("in_p")).alias("n_p"), count_if(~F.col("in_p")).alias("n_i"))
    return per.select("probe", "n_p", "n_i", F.round(100.0 * F.col("n_p") / n_p, 1).alias("p_pct"), F.round(100.0 * F.col("n_i") / n_i, 1).alias("i_pct"),
                      F.round(F.try_divide(F.col("n_p") / n_p, F.col("n_i") / n_i), 1).alias("lift"))


def era_features(facts: DataFrame, kept: DataFrame, stems=STEMS, balance=("balance", "equilibrium", "harmony")) -> DataFrame:
    """Eight figures per period."""
    k = kept.select(F.col("being_id").alias("id"), "for", "against")
    rows = facts.filter(F.col("era").isNotNull()).join(k, "id", "left")
    none = F.array().cast("array<string>")
    word = "(?<![a-z])(%s)s?(?![a-z])" % "|".join(stems)
    hyphen = r"[a-z]-(%s)s?\b" % "|".join(stems)
    side = F.array(*map(F.lit, balance))
    return rows.groupBy("era").agg(
        F.count(F.lit(1)).alias("beings"), share(F.lower("called").rlike(word)).alias("called_pct"),
        share(F.lower(F.array_join("names", " ")).rlike(hyphen)).alias("hyphen_pct"),
        share(F.arrays_overlap(F.coalesce("for", none), side)).alias("balance_pct"),
        share(F.size(F.coalesce("against", none)) > 0).alias("against_pct"), share(F.col("n_role") <= 1).alias("short_role_pct"),
        share(F.col("n_cost") > 0).alias("cost_pct"), share(F.col("n_fate") > 0).alias("fate_pct"))


# Words looked for in all texts of dated writers.
PROBES = {"guardian": r"(?iU)\bguardians?\b", "keeper": r"(?iU)\bkeepers?\b",
          "tender": r"(?iU)\btenders\b|\b[Tt]he [Tt]ender\b|-tender\b",
          "balance": r"(?iU)\b(delicate|fragile) (balance|equilibrium)\b"}


def probe_prevalence(texts: DataFrame, probes=None, by="era") -> DataFrame:
    """Per period: texts, and share of texts in which each probe is found."""
    probes = PROBES if probes is None else probes
    return texts.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("texts"), *[share(F.col("text").rlike(rx)).alias(name + "_pct") for name, rx in probes.items()])


def term_counts(sents: DataFrame, term) -> DataFrame:
    """Beings with the term in a sentence: any, negated, plain. ``term`` is a struct<any,negated>."""
    per = sents.withColumn("_t", term).groupBy("being_id").agg(F.max("_t.any").alias("a"), F.max("_t.negated").alias("n"))
    return per.agg(count_if(F.col("a")).alias("any"), count_if(F.col("n")).alias("negated"),
                   count_if(F.col("a") & ~F.col("n")).alias("plain"))


def voices(voice: DataFrame, who: str) -> DataFrame:
    """Who says I or is you: counts."""
    return voice.groupBy(who).agg(F.count(F.lit(1)).alias("n"))


def voices_by_writer(voice: DataFrame, beings: DataFrame) -> DataFrame:
    """Per writer: beings that say I themselves, and that are spoken to."""
    return voice.withColumnRenamed("being_id", "id").join(beings.select("id", "model"), "id").groupBy("model").agg(
        count_if(F.col("i") == "keeper").alias("says_i"), count_if(F.col("you") == "keeper").alias("is_you"))


def portrait(facts: DataFrame, selected, questions=QUESTIONS) -> DataFrame:
    """The selection against the rest: beings, texts, median length, answer and arrangement shares."""
    rows = facts.withColumn("in_sel", F.coalesce(selected, F.lit(False)))
    return rows.groupBy("in_sel").agg(
        F.count(F.lit(1)).alias("beings"), F.countDistinct("text_id").alias("texts"),
        *[share(F.col("n_" + q) > 0).alias(q + "_pct") for q in questions],
        *[share(F.col("arrangement") == k).alias(k + "_pct") for k in ARRANGEMENTS]).join(
            upper_median(rows, "in_sel", "n_sentences", "median_sentences"), "in_sel")


def portrait_words(facts: DataFrame, selected) -> DataFrame:
    """Per word: share of the selection and of the rest that carry it."""
    rows = facts.withColumn("in_sel", F.coalesce(selected, F.lit(False)))
    n_s, n_r = rows.select(F.count_if("in_sel")).scalar(), rows.select(F.count_if(~F.col("in_sel"))).scalar()
    per = rows.withColumn("word", F.explode("words")).groupBy("word").agg(count_if(F.col("in_sel")).alias("s"), count_if(~F.col("in_sel")).alias("r"))
    return per.select("word", "s", "r", F.round(F.try_divide(100.0 * F.col("s"), n_s), 1).alias("sel_pct"),
                      F.round(F.try_divide(100.0 * F.col("r"), n_r), 1).alias("rest_pct"))


def portrait_nouns(rows: DataFrame, selected, k: int = 28) -> DataFrame:
    """Most frequent nouns of a side within the selection."""
    return rows.filter(selected).groupBy("noun").agg(F.count(F.lit(1)).alias("beings")).orderBy(F.desc("beings"), "noun").limit(k)


def share_extremes(beings: DataFrame, word: str, least: int = 40, top: int = 10, bottom: int = 5) -> DataFrame:
    """Writers with the highest and lowest share of a word."""
    per = beings.groupBy("model").agg(F.count(F.lit(1)).alias("beings"), count_if(F.array_contains("words", word)).alias("n"))
    per = per.filter(F.col("beings") >= least).withColumn("share", F.col("n") / F.col("beings"))
    high = per.orderBy(F.desc("share"), "model").limit(top).withColumn("end", F.lit("high"))
    low = per.orderBy("share", F.desc("model")).limit(bottom).withColumn("end", F.lit("low"))
    return high.unionByName(low).select("end", "model", "beings", "n", pct("n", "beings").alias("pct"))


def beings_per_text(care_texts: DataFrame) -> DataFrame:
    """Histogram of beings per text; NULL is unreadable, 0 is mentioned only."""
    return care_texts.groupBy("n_beings").agg(F.count(F.lit(1)).alias("texts"))


def siblings(beings: DataFrame, chosen: DataFrame) -> DataFrame:
    """Other beings in the texts of the chosen ones (a few ids a reader looks at)."""
    picked = chosen.select("text_id", F.col("id").alias("of"))
    return beings.join(picked, "text_id").filter(F.col("id") != F.col("of")).select("of", "text_id", "id", "called")
