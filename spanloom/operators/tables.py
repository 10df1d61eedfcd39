"""Per-text, per-string, per-writer and per-pattern tables of the first instrument."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.functions.text import band, holds_word, lab, n_lexicon_words, param_echo, pct, stems_in, text_flag
from spanloom.operators.sampling import top_k

KINDS = ("catalogue", "named", "place itself", "a process", "unnamed, said so", "ordinary biology", "undetermined")


def count_if(cond):
    return F.count_if(F.coalesce(cond, F.lit(False)))


def text_facts(texts: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """text_id, model, place_id, length, tagged, flag, n_species, n_param_echo: one narrow pass.

    A text is judged where it is read; only slim rows meet the statuses."""
    place = ["place_id"] if "place_id" in texts.columns else []
    slim = texts.select("text_id", "model", *place, F.length("text").alias("length"), text_flag("text", F.lit(None).cast("string")).alias("flag"),
                        n_lexicon_words("text").alias("n_species"), param_echo("text").alias("n_param_echo"))
    if status is not None:
        slim = slim.join(status.select("text_id", F.col("status").alias("tagged")), "text_id", "left")
    else:
        slim = slim.withColumn("tagged", F.lit(None).cast("string"))
    told = F.col("tagged").isNotNull() & ~F.col("tagged").isin("ok", "")
    return slim.select("text_id", "model", *place, "length", F.coalesce("tagged", F.lit("")).alias("tagged"),
                       F.when(told, F.col("tagged")).otherwise(F.col("flag")).alias("flag"), "n_species", "n_param_echo")


def text_names(mentions: DataFrame, precision: DataFrame, places: DataFrame | None = None,
               facts: DataFrame | None = None) -> DataFrame:
    """One row per text and string.

    Rows are placed once by (text_id, norm); the three aggregates below reuse that
    placement. The most frequent written form wins, then the earlier, then the smaller.
    """
    scored = mentions.filter(F.col("yields") == "name").join(
        precision.select("pattern_id", "precision"), "pattern_id", "left").repartition("text_id", "norm")
    keys = ["text_id", "norm"]
    spots = scored.groupBy(*keys, "start", "clean").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("pattern_id").alias("pats"), F.max("title_like").alias("title"),
        F.max(F.coalesce("precision", F.lit(0.0))).alias("score"), F.max("occ").alias("occ"),
        F.max("occ_cased").alias("cased"))
    forms = spots.groupBy(*keys, "clean").agg(
        F.sum("n").alias("n"), F.min("start").alias("start"), F.max("score").alias("score"), F.max("occ").alias("occ"),
        F.max("cased").alias("cased"), count_if(F.col("title")).alias("titles"),
        F.array_distinct(F.flatten(F.collect_list("pats"))).alias("pats"))
    best = F.struct(-F.col("n"), F.col("start"), F.col("clean"))
    out = forms.groupBy(*keys).agg(
        F.min_by(F.struct("clean", "cased", "titles"), best).alias("d"), F.sum("n").alias("n_mentions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pats")))).alias("patterns"),
        F.max("score").alias("score"), F.min("start").alias("first_pos"), F.max("occ").alias("occurrences"),
        F.sum("titles").alias("in_title"))
    out = out.select(
        *keys, F.col("d.clean").alias("display"), "n_mentions", "patterns", "score", "first_pos", "occurrences", "in_title",
        F.greatest(F.lit(0), F.col("occurrences") - F.col("in_title")).alias("body_occ"),
        F.greatest(F.lit(0), F.col("d.cased") - F.col("d.titles")).alias("body_cased"))
    if places is None:
        return out.withColumn("in_place_text", F.lit(0))
    return in_place(out, facts, places)


#: Strings that meet a place's text together.
STRINGS_AT_ONCE = 1000


def in_place(names: DataFrame, texts: DataFrame, places: DataFrame) -> DataFrame:
    """Adds in_place_text: the string also stands in the place text of its text.

    Each string is looked up once per place, not once per text of it. A place's strings meet
    its text in blocks, so the text is copied once per block, and a place with very many
    strings has many blocks.
    """
    # read twice, and what it comes from is a walk over all texts
    where = names.join(texts.select("text_id", "place_id"), "text_id", "left").persist()
    asked = where.filter("place_id is not null").select("place_id", "norm").distinct()
    parts = asked.groupBy("place_id").agg(F.ceil(F.count(F.lit(1)) / STRINGS_AT_ONCE).cast("int").alias("_parts"))
    block = F.pmod(F.xxhash64("norm"), F.col("_parts"))
    blocks = asked.join(parts, "place_id").groupBy("place_id", block.alias("_b")).agg(F.collect_list("norm").alias("_norms"))
    met = blocks.join(places.select("place_id", F.lower("text").alias("_place")), "place_id")
    found = met.select("place_id", F.explode(F.filter("_norms", lambda n: F.contains(F.col("_place"), n))).alias("norm"), F.lit(1).alias("in_place_text"))
    return where.join(found.distinct(), ["place_id", "norm"], "left").select(*names.columns, F.coalesce("in_place_text", F.lit(0)).alias("in_place_text"))


def title_only():
    return (F.col("in_title") > 0) & (F.col("body_occ") == 0)


def text_cov(facts: DataFrame, mentions: DataFrame, names: DataFrame) -> DataFrame:
    """One row per text, texts without a hit included."""
    statement = F.col("yields") == "statement"
    hits = mentions.groupBy("text_id").agg(
        count_if(F.col("yields") == "name").alias("n_hits"), count_if(statement).alias("n_statements"),
        *[count_if(statement & (F.col("pattern_id") == p)).alias(c) for c, p in (
            ("n_anti", "anti_name"), ("n_place_self", "place_is_inhabitant"), ("n_process", "being_is_process"))])
    only = title_only()
    per = names.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("n_names"), F.max("score").alias("best"), F.round(F.sum("score"), 3).alias("expected"),
        F.max(F.when(~only, F.col("score"))).alias("best_body"), F.max(F.when(only, F.col("score"))).alias("best_title_only"),
        count_if((F.col("score") >= 0.8) & ~only).alias("n_names_80"))
    counts = ["n_hits", "n_statements", "n_anti", "n_place_self", "n_process", "n_names", "n_names_80"]
    out = (facts.join(hits, "text_id", "left").join(per, "text_id", "left")
           .fillna(0, counts).fillna(0.0, ["best", "expected", "best_body", "best_title_only"]))
    return out.withColumn("kind", kind())


def kind():
    """Kind of answer: the first rule that fits."""
    return (F.when(F.col("flag") != "", "flagged").when(F.col("n_names_80") >= 3, "catalogue")
            .when(F.col("n_names_80") >= 1, "named").when(F.col("n_place_self") > 0, "place itself")
            .when(F.col("n_process") > 0, "a process").when(F.col("n_anti") > 0, "unnamed, said so")
            .when(F.col("n_species") >= 4, "ordinary biology").otherwise("undetermined"))


def names_table(names: DataFrame, cov: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """One row per string over unflagged texts: first per (string, writer), then per string."""
    rows = names.join(cov.filter(F.col("flag") == "").select("text_id", "model"), "text_id")
    score, only = F.col("score"), title_only()
    per = rows.groupBy("norm", "model").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(score).alias("exp"),
        F.sum(F.when(F.col("in_place_text") == 0, score).otherwise(0.0)).alias("exp_new"),
        F.sum(F.when(only, score).otherwise(0.0)).alias("exp_title"), F.sum("n_mentions").alias("n"),
        F.max("score").alias("best"), F.array_distinct(F.flatten(F.collect_set("patterns"))).alias("pats"),
        F.min_by("display", F.struct(-score, F.col("text_id"))).alias("display"),
        F.min(F.struct(-score, F.col("text_id"))).alias("first"))
    # the four leading writers are kept by a top-k, not by collecting all writers of a string
    lead = top_k(per.filter(F.col("exp") >= 0.5).select("norm", "model", F.round("exp", 0).alias("score")),
                 "norm", 4, [F.desc("score"), F.asc("model")])
    lead = lead.groupBy("norm").agg(F.array_sort(F.collect_list(F.struct("rank", "model", "score"))).alias("t"))
    lead = lead.select("norm", F.transform("t", lambda x: F.struct(
        x["model"].alias("model"), x["score"].alias("score"))).alias("top_models"))
    out = per.groupBy("norm").agg(
        F.min_by("display", "first").alias("display"), F.sum("texts").alias("n_texts"),
        F.round(F.sum("exp"), 2).alias("expected"), F.round(F.sum("exp_new"), 2).alias("expected_new"),
        F.max("best").alias("best"),
        F.when(count_if(F.col("exp") > 0) > 0, count_if(F.col("exp") > 0)).otherwise(F.count(F.lit(1))).alias("n_models"),
        F.sum("n").alias("n_mentions"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("pats")))).alias("patterns"),
        F.round(F.sum("exp_title"), 2).alias("expected_title_only"))
    out = out.join(lead, "norm", "left")
    if df is None:
        return out.withColumn("df", F.lit(None).cast("double"))
    return out.join(df.select(F.col("word").alias("norm"), "df"), "norm", "left")


def pattern_model(mentions: DataFrame, facts: DataFrame) -> DataFrame:
    """Hits and texts per pattern and writer; one row per (pattern, text) first, so the
    distinct count needs no second shuffle of hits."""
    per = mentions.groupBy("pattern_id", "text_id").agg(F.count(F.lit(1)).alias("n"))
    return (per.join(facts.select("text_id", "model"), "text_id").groupBy("pattern_id", "model")
            .agg(F.sum("n").alias("n_mentions"), F.count(F.lit(1)).alias("n_texts")))


def pattern_stats(mentions: DataFrame, facts: DataFrame) -> DataFrame:
    """Hits, texts, distinct strings, writers per pattern. Hits are counted once per pattern, string
    and text; each distinct count is then a count of groups."""
    per = mentions.groupBy("pattern_id", "norm", "text_id").agg(F.count(F.lit(1)).alias("n")).join(facts.select("text_id", "model"), "text_id")
    texts = per.groupBy("pattern_id", "model", "text_id").agg(F.sum("n").alias("n"))
    writers = texts.groupBy("pattern_id", "model").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("t"))
    counts = writers.groupBy("pattern_id").agg(F.sum("n").alias("n_hits"), F.sum("t").alias("n_texts"), F.count("model").alias("n_models"))
    strings = per.filter("norm is not null").select("pattern_id", "norm").distinct().groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n_strings"))
    return counts.join(strings, "pattern_id", "left").select("pattern_id", "n_hits", "n_texts", F.coalesce("n_strings", F.lit(0).cast("long")).alias("n_strings"), "n_models")


def pattern_captures(mentions: DataFrame, k: int = 300) -> DataFrame:
    """Most frequent captures per pattern with their text counts."""
    per = mentions.filter(F.col("norm") != "").groupBy("pattern_id", "norm", "text_id").agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy("pattern_id", "norm").agg(F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("n_texts"))
    return top_k(counts, "pattern_id", k, [F.desc("n_texts"), F.desc("n_hits"), F.asc("norm")])


def n80(names: DataFrame, cov: DataFrame) -> DataFrame:
    """Unflagged texts in which a string reaches 0.8."""
    ok = cov.filter(F.col("flag") == "").select("text_id")
    return names.filter(F.col("score") >= 0.8).join(ok, "text_id", "left_semi").groupBy("norm").agg(
        F.count(F.lit(1)).alias("n_texts_80"))


def run_stats(cov: DataFrame, mentions: DataFrame, strings: DataFrame, precision: DataFrame, verdicts: DataFrame,
              n_patterns: int, digest=None, revision=None) -> DataFrame:
    """The figures of a run as one row."""
    ok = F.col("flag") == ""
    best, body, title = F.col("best"), F.col("best_body"), F.col("best_title_only")
    none = F.col("n_names") == 0
    figures = {
        "texts": F.count(F.lit(1)), "flagged": count_if(~ok), "untagged": count_if(F.col("tagged") == ""),
        "best_80": count_if(ok & (best >= 0.8)), "best_50_80": count_if(ok & (best >= 0.5) & (best < 0.8)),
        "best_under_50": count_if(ok & ~none & (best < 0.5)), "best_none": count_if(ok & none),
        "body_80": count_if(ok & (body >= 0.8)), "body_under_50": count_if(ok & (body < 0.5)),
        "titled_not_named": count_if(ok & (body < 0.5) & (title >= 0.5)),
        "titled_any_not_named": count_if(ok & (body < 0.5) & (title > 0)),
        "place_self_texts": count_if(ok & (F.col("n_place_self") > 0)), "process_texts": count_if(ok & (F.col("n_process") > 0)),
        "anti_texts": count_if(ok & (F.col("n_anti") > 0)), "name_talk_texts": count_if(ok & (F.col("n_statements") > 0)),
        **{"kind_" + k.replace(",", "").replace(" ", "_"): count_if(F.col("kind") == k) for k in ("flagged", *KINDS)}}
    one = cov.agg(*[v.alias(k) for k, v in figures.items()])
    scalars = {
        "mentions": mentions.select(F.count(F.lit(1))), "distinct_strings": strings.select(F.count(F.lit(1))),
        "distinct_at_80": strings.select(F.count_if(F.col("best") >= 0.8)),
        "patterns_at_80": precision.filter(F.col("yields") == "name").select(count_if(F.col("precision") >= 0.8)),
        "verdicts": verdicts.select(F.count(F.lit(1)))}
    out = one.select("*", *[d.scalar().alias(k) for k, d in scalars.items()], F.lit(n_patterns).alias("patterns"),
                     F.lit(digest).cast("string").alias("content_sha256"), F.lit(revision).cast("string").alias("revision"))
    return out.withColumn("covered", F.col("best_80"))


def model_coverage(cov: DataFrame) -> DataFrame:
    """Per writer: score bands, flagged, statements, expected names, title only."""
    ok = F.col("flag") == ""
    b, body = band("best"), F.col("best_body")
    return cov.groupBy("model").agg(
        count_if(ok).alias("texts"), count_if(~ok).alias("flagged"),
        *[count_if(ok & (b == x)).alias(x) for x in ("hi", "mid", "lo", "none")],
        count_if(ok & (body < 0.5)).alias("body_lo"),
        count_if(ok & (body < 0.5) & (F.col("best_title_only") > 0)).alias("titled"),
        count_if(ok & (F.col("n_anti") > 0)).alias("anti"),
        count_if(ok & (F.col("n_anti") > 0) & (F.col("best") < 0.5)).alias("anti_lo"),
        count_if(ok & (F.col("n_statements") > 0)).alias("talk"),
        F.round(F.try_divide(F.sum(F.when(ok, F.col("expected"))), count_if(ok)), 3).alias("expected_per_text"))


def kind_by_model(cov: DataFrame) -> DataFrame:
    """Kinds per writer, with shares, and the place-itself sentence apart from the kind."""
    ok = cov.filter(F.col("flag") == "")
    counts = ok.groupBy("model").agg(
        F.count(F.lit(1)).alias("texts"), *[count_if(F.col("kind") == k).alias(k) for k in KINDS],
        count_if(F.col("n_place_self") > 0).alias("say_place"))
    return counts.withColumn("named_pct", pct(F.col("catalogue") + F.col("named"), "texts")).withColumn(
        "place_pct", pct("place itself", "texts")).withColumn("say_place_pct", pct("say_place", "texts"))


def string_stats(labels: DataFrame, cov: DataFrame) -> DataFrame:
    """Per string of the second instrument over counted texts: texts, labels, writers, texts
    by source (bit 1 quote, bit 2 line)."""
    per = label_texts(labels, cov)
    by_model = per.groupBy("norm", "model").agg(
        F.count(F.lit(1)).alias("t"), F.sum("n").alias("n"), F.sum(F.col("bits").bitwiseAND(1)).alias("q"),
        F.sum(F.shiftright("bits", 1)).alias("l"))
    return by_model.groupBy("norm").agg(
        F.sum("t").alias("texts"), F.sum("n").alias("labels"), F.count(F.lit(1)).alias("models"),
        F.sum("q").alias("texts_from_quote"), F.sum("l").alias("texts_from_line"))


def label_texts(labels: DataFrame, cov: DataFrame) -> DataFrame:
    """text x string with number of labels and source bits, counted texts only."""
    bit = F.when(F.col("source") == "quote", 1).otherwise(2)
    per = labels.groupBy("text_id", "norm").agg(F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("bits"))
    return per.join(cov.filter(F.col("flag") == "").select("text_id", "model"), "text_id")


def label_totals(labels: DataFrame, cov: DataFrame) -> DataFrame:
    """One row: labels, texts with one, distinct strings, strings in 2+ texts, median per text."""
    per = label_texts(labels, cov)
    text = per.groupBy("text_id").agg(F.sum("n").alias("n"))
    string = per.groupBy("norm").agg(F.count(F.lit(1)).alias("t"))
    return text.agg(F.sum("n").alias("labels"), F.count(F.lit(1)).alias("texts"),
                    F.floor(F.median("n")).cast("long").alias("median")).select(
        "*", string.select(F.count(F.lit(1))).scalar().alias("strings"),
        string.select(F.count_if(F.col("t") >= 2)).scalar().alias("strings2"))


def display_form(labels: DataFrame) -> DataFrame:
    """Most frequent written form of each string; the smaller string wins a tie."""
    counts = labels.groupBy("norm", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("norm").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("as_written"),
                                      F.max("n").alias("n"))


def model_strings(labels: DataFrame, cov: DataFrame) -> DataFrame:
    """Per writer: texts with a label, labels per counted text, distinct strings."""
    per = label_texts(labels, cov)
    texts = per.groupBy("model", "text_id").agg(F.sum("n").alias("n")).groupBy("model").agg(
        F.count(F.lit(1)).alias("texts_with_label"), F.sum("n").alias("labels"))
    strings = per.groupBy("model", "norm").agg(F.lit(1)).groupBy("model").agg(F.count(F.lit(1)).alias("strings"))
    counted = cov.filter(F.col("flag") == "").groupBy("model").agg(F.count(F.lit(1)).alias("texts"))
    return (counted.join(texts, "model", "left").join(strings, "model", "left").fillna(0)
            .withColumn("labels_per_text", F.round(F.col("labels") / F.col("texts"), 1)))


def top_strings(labels: DataFrame, cov: DataFrame, k: int = 2000) -> DataFrame:
    """The k most widespread strings of each writer."""
    counts = label_texts(labels, cov).groupBy("model", "norm").agg(F.count(F.lit(1)).alias("texts"))
    return top_k(counts, "model", k, [F.desc("texts"), F.asc("norm")])


def with_pattern_score(labels: DataFrame, names: DataFrame, strings: DataFrame) -> DataFrame:
    """Labels with the score of the same string in the same text, and its best anywhere."""
    return (labels.join(names.select("text_id", "norm", F.col("score").alias("pattern_score")), ["text_id", "norm"], "left")
            .join(strings.select("norm", F.col("best").alias("best_anywhere")), "norm", "left")
            .fillna(0.0, ["pattern_score"]))


def set_share(labels: DataFrame, cov: DataFrame, a, b=(), by: str = "string", words=None) -> DataFrame:
    """Per writer: counted texts, texts holding a string (or word) of set A, of set B, of both."""
    def member(values):
        if by == "string":
            return F.col("norm").isin(*values)
        return F.arrays_overlap(words("norm"), F.array(*map(F.lit, values)))

    marked = labels.withColumn("a", member(a)).withColumn("b", member(b) if b else F.lit(False)).filter("a or b")
    flags = marked.groupBy("text_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counted = cov.filter(F.col("flag") == "").select("text_id", "model").join(flags, "text_id", "left")
    out = counted.groupBy("model").agg(
        F.count(F.lit(1)).alias("texts"), count_if(F.col("a")).alias("n_a"), count_if(F.col("b")).alias("n_b"),
        count_if(F.col("a") & F.col("b")).alias("n_both"))
    return out.withColumn("a_pct", pct("n_a", "texts")).withColumn("b_pct", pct("n_b", "texts"))


def text_sets(texts: DataFrame, in_a: DataFrame, in_b: DataFrame) -> DataFrame:
    """Which texts hold A, B, both: one row per set, from one flag for each text."""
    def flag(df, bit):
        return df.select("text_id", F.lit(bit).alias("bit"))

    flags = flag(in_a, 1).unionAll(flag(in_b, 2)).unionAll(flag(texts, 4)).groupBy("text_id").agg(F.bit_or("bit").alias("bits"))
    sets = {"a": F.col("bits").bitwiseAND(1) > 0, "b": F.col("bits").bitwiseAND(2) > 0, "both": F.col("bits").bitwiseAND(3) == 3,
            "a_not_b": F.col("bits").bitwiseAND(3) == 1, "neither": F.col("bits") == 4}
    counts = flags.agg(*[F.count_if(test).alias(name) for name, test in sets.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("set"), F.col(name).alias("n")) for name in sets])).alias("s")).select("s.*")


def statement_list(mentions: DataFrame, cov: DataFrame, pattern: str, cap: int = 400) -> DataFrame:
    """Sentences of one statement pattern with writer and the text's best score."""
    rows = mentions.filter(F.col("pattern_id") == pattern).join(
        cov.filter(F.col("flag") == "").select("text_id", "model", "best"), "text_id")
    shown = F.when(F.length("surface") < cap, F.col("surface")).otherwise(F.concat(F.left("surface", F.lit(cap - 3)), F.lit("…")))
    return rows.select("text_id", "start", "model", "best", shown.alias("sentence"))


def name_index(labels: DataFrame, strings: DataFrame) -> DataFrame:
    """Inverted index string -> texts, kept long, for the strings of a given table."""
    return labels.join(strings.select("norm").distinct(), "norm", "left_semi").select("norm", "text_id").distinct()


def word_index(index: DataFrame, stems) -> DataFrame:
    """Inverted index lexicon word -> texts, from an index of strings (norm, text_id)."""
    words = index.select("norm").distinct().select("norm", F.explode(stems_in("norm", stems)).alias("word"))
    return index.join(words, "norm").select("word", "text_id").distinct()


def writer_rollup(df: DataFrame, model="model") -> DataFrame:
    """Counts per model, per lab and in all."""
    out = df.withColumn("lab", lab(model)).rollup("lab", model).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return out


def names_in_quotes(names: DataFrame, quotes: DataFrame) -> DataFrame:
    """Per text and name: does it stand inside a quote, or in a quote's heading."""
    # both sides are parts of one text, so what is gathered per text is bounded by it
    said = quotes.groupBy("text_id").agg(
        F.array_join(F.collect_list(F.lower("quote")), " \n ").alias("blob"),
        F.array_join(F.collect_set(F.lower("heading")), " \n ").alias("heads"))
    rows = names.groupBy("text_id").agg(F.collect_set("norm").alias("norms")).join(said, "text_id", "left")
    blob, heads = F.coalesce("blob", F.lit("")), F.coalesce("heads", F.lit(""))
    return rows.select("text_id", F.inline(F.transform("norms", lambda n: F.struct(
        n.alias("norm"), holds_word(blob, n).alias("in_quote"),
        (holds_word(blob, n) | holds_word(heads, n)).alias("in_quote_or_heading")))))
