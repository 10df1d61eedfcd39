"""Queries over beings: orders as beings, customer and year as text, part kinds as words."""
from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import beings as B, evaluate as E, sampling as G
from spanloom.plans.data import (ARR, CARE, STEMS, TEXTS, WITH_BEINGS, WITH_FACTS, WITH_KEPT, WITH_LABELS, being_rows, beings, care_texts, kept,
                                 labels, query, table, texts)

QS = ("role", "relation", "cost", "origin", "fate")


def shares(prefix="n_", names=QS):
    return ", ".join(f"round(100.0 * count(*) FILTER ({prefix}{q} > 0) / count(*), 1) AS {q}_pct" for q in names)


@query("f58_being_facts", f"{WITH_FACTS} SELECT id, text_id, model, array_to_string(words, ' ') AS words, n_sentences, arrangement, n_listed, released, era, focus FROM fr")
def f58(spark, d):
    return being_rows(spark, d).select("id", "text_id", "model", F.array_join("words", " ").alias("words"), "n_sentences", "arrangement", "n_listed", "released", "era", "focus")


@query("f21_question_shares", f"{WITH_BEINGS}, q AS (" + " UNION ALL ".join(f"SELECT '{q}' AS question, n_{q} AS n FROM beings" for q in QS)
       + ") SELECT question, count(*) FILTER (n > 0) AS beings, round(100.0 * count(*) FILTER (n > 0) / count(*), 1) AS pct, sum(n)::BIGINT AS sentences FROM q GROUP BY 1")
def f21(spark, d):
    return B.question_shares(beings(spark, d))


@query("f22_writer_table", f"""{WITH_BEINGS}, {CARE}, {ARR}, md AS (SELECT model, n_sentences AS median_sentences FROM (SELECT model, n_sentences, row_number() OVER (PARTITION BY model ORDER BY n_sentences) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM care) WHERE i = n // 2),
    cp AS (SELECT model, count(*) * 2 AS texts FROM care GROUP BY 1) SELECT b.*, cp.texts, k.solo_pct, k.stacked_pct, k.ensemble_pct, md.median_sentences, round(100.0 * b.care_texts / cp.texts, 1) AS care_pct
    FROM (SELECT model, count(*) AS beings, count(DISTINCT text_id) AS care_texts, {shares()} FROM beings GROUP BY 1) b JOIN cp USING (model) JOIN md USING (model) LEFT JOIN
    (SELECT model, round(100.0 * count(*) FILTER (arrangement = 'solo') / count(*), 1) AS solo_pct, round(100.0 * count(*) FILTER (arrangement = 'stacked') / count(*), 1) AS stacked_pct, round(100.0 * count(*) FILTER (arrangement = 'ensemble') / count(*), 1) AS ensemble_pct FROM arr GROUP BY 1) k USING (model)""")
def f22(spark, d):
    c = care_texts(spark, d)
    corpus = c.groupBy("model").agg((F.count(F.lit(1)) * 2).alias("texts"))
    return B.writer_table(beings(spark, d), c, corpus)


@query("f23_word_table", f"""{WITH_BEINGS}, w AS (SELECT b.*, unnest(words) AS word FROM beings b), tot AS (SELECT count(*) AS n, count(*) FILTER (n_cost > 0) AS y FROM beings)
    SELECT word, count(*) AS beings, count(DISTINCT text_id) AS texts, count(DISTINCT model) AS writers, {shares()}, round(100.0 * count(*) FILTER (n_cost > 0 AND n_sentences BETWEEN 30 AND 60) / count(*) FILTER (n_sentences BETWEEN 30 AND 60), 1) AS cost_band_pct,
    round(100.0 * (count(*) FILTER (n_cost > 0) / count(*) - ((SELECT y FROM tot) - count(*) FILTER (n_cost > 0)) / ((SELECT n FROM tot) - count(*))), 1) AS cost_diff FROM w GROUP BY word""")
def f23(spark, d):
    return B.word_table(beings(spark, d))


@query("f24_within_contrast", f"""WITH c AS (SELECT c_nationkey, c_mktsegment, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey), g AS (SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS na, count(*) FILTER (c_mktsegment <> 'BUILDING') AS nb,
    avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) FILTER (c_mktsegment = 'BUILDING') AS ma, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) FILTER (c_mktsegment <> 'BUILDING') AS mb FROM c GROUP BY 1)
    SELECT count(*) AS groups, sum(least(na, nb))::BIGINT AS weight, round(100.0 * sum(least(na, nb) * (ma - mb)) / sum(least(na, nb)), 1) AS points FROM g WHERE na >= 8 AND nb >= 8""")
def f24(spark, d):
    c = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return B.within_contrast(c, "c_nationkey", F.col("c_mktsegment") == "BUILDING", F.col("o_orderstatus") == "F")


@query("f24_word_contrast", f"""{WITH_BEINGS}, w AS (SELECT unnest({list(STEMS)}) AS word), g AS (SELECT w.word, model, count(*) FILTER (list_contains(words, w.word)) AS na, count(*) FILTER (NOT list_contains(words, w.word)) AS nb,
    avg(CASE WHEN n_cost > 0 THEN 1.0 ELSE 0.0 END) FILTER (list_contains(words, w.word)) AS ma, avg(CASE WHEN n_cost > 0 THEN 1.0 ELSE 0.0 END) FILTER (NOT list_contains(words, w.word)) AS mb FROM beings, w GROUP BY 1, 2)
    SELECT word, count(*) AS writers, round(100.0 * sum(least(na, nb) * (ma - mb)) / sum(least(na, nb)), 1) AS points FROM g WHERE na >= 8 AND nb >= 8 GROUP BY 1""")
def f24b(spark, d):
    return B.word_contrast(beings(spark, d), "cost", STEMS)


@query("f25_g14_octiles", """WITH r AS (SELECT n_chars, lang = 'en' AS en, row_number() OVER (ORDER BY n_chars, lang = 'en') - 1 AS i, (SELECT count(*) // 8 FROM documents) AS k FROM documents)
    SELECT i // k AS grp, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high, round(100.0 * count(*) FILTER (en) / count(*), 1) AS en_pct FROM r WHERE i < 8 * k GROUP BY 1""")
def f25(spark, d):
    x = table(spark, d, "documents").select("n_chars", (F.col("lang") == "en").alias("en"))
    return G.equal_groups(x, "n_chars", 8, ("en",)).withColumn("grp", F.col("grp").cast("long"))


@query("f26_arrangement_stats", f"""{WITH_FACTS} SELECT arrangement, count(DISTINCT text_id) AS texts, count(*) AS beings, {shares(names=('cost', 'origin', 'fate'))}, round(100.0 * avg(n_listed / n_sentences), 1) AS focus_pct, round(avg(n_sentences), 0)::BIGINT AS sentences
    FROM fr WHERE arrangement IS NOT NULL GROUP BY 1""")
def f26(spark, d):
    return B.arrangement_stats(being_rows(spark, d))


@query("f26_arrangement", f"{WITH_BEINGS}, {ARR} SELECT text_id, model, arrangement FROM arr")
def f26b(spark, d):
    return B.arrangement(beings(spark, d)).drop("n_worded")


@query("f27_ensemble_uniformity", f"{WITH_BEINGS}, e AS (SELECT text_id, count(*) AS n, count(DISTINCT array_to_string(words, ' ')) AS k FROM beings WHERE len(words) > 0 GROUP BY 1) SELECT count(*) AS ensembles, count(*) FILTER (k = 1) AS same_words FROM e WHERE n > 1")
def f27(spark, d):
    return B.ensemble_uniformity(beings(spark, d))


@query("f27_ensemble_words", f"{WITH_BEINGS}, {ARR}, e AS (SELECT text_id, count(DISTINCT w) AS distinct_words FROM (SELECT b.text_id, unnest(words) AS w FROM beings b JOIN arr USING (text_id) WHERE arrangement = 'ensemble') GROUP BY 1) SELECT distinct_words, count(*) AS ensembles FROM e GROUP BY 1")
def f27b(spark, d):
    return B.ensemble_words(beings(spark, d))


F28 = ", ".join(f"round(100.0 * count(*) FILTER (arrangement = '{k}') / count(*), 1) AS {k}_pct, round(100.0 * count(*) FILTER (arrangement = '{k}' AND n_cost > 0) / nullif(count(*) FILTER (arrangement = '{k}'), 0), 1) AS {k}_cost_pct, "
                f"round(100.0 * count(*) FILTER (arrangement = '{k}' AND n_fate > 0) / nullif(count(*) FILTER (arrangement = '{k}'), 0), 1) AS {k}_fate_pct, round(100.0 * avg(n_listed / n_sentences) FILTER (arrangement = '{k}'), 1) AS {k}_focus_pct" for k in B.ARRANGEMENTS)


@query("f28_word_by_arrangement", f"{WITH_FACTS}, w AS (SELECT fr.*, unnest(words) AS word FROM fr) SELECT word, count(*) AS beings, {F28} FROM w GROUP BY 1")
def f28(spark, d):
    return B.word_by_arrangement(being_rows(spark, d))


PAIRS = "sg AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM beings) GROUP BY 1), bw AS (SELECT id, text_id, unnest(words) AS w FROM beings), pr AS (SELECT x.w AS a, y.w AS b, count(*) AS n_ab FROM bw x JOIN bw y ON x.id = y.id AND x.w < y.w GROUP BY 1, 2), nn AS (SELECT count(*) AS n FROM beings WHERE len(words) > 0)"


@query("f29_pair_lift", f"""{WITH_BEINGS}, {PAIRS} SELECT a, b, n_ab, sa.n AS n_a, sb.n AS n_b, round(sa.n * sb.n / (SELECT n FROM nn), 3) AS expected, round(n_ab / (sa.n * sb.n / (SELECT n FROM nn)), 3) AS lift, round(100.0 * n_ab / sa.n, 1) AS given_a_pct, round(100.0 * n_ab / sb.n, 1) AS given_b_pct
    FROM pr JOIN sg sa ON sa.w = a JOIN sg sb ON sb.w = b""")
def f29(spark, d):
    return B.pair_lift(beings(spark, d))


@query("f29_lowest_lift", f"{WITH_BEINGS}, {PAIRS} SELECT a, b, round(n_ab / (sa.n * sb.n / (SELECT n FROM nn)), 3) AS lift FROM pr JOIN sg sa ON sa.w = a JOIN sg sb ON sb.w = b WHERE sa.n * sb.n / (SELECT n FROM nn) >= 30 ORDER BY lift, a, b LIMIT 8")
def f29b(spark, d):
    return B.lowest_lift(B.pair_lift(beings(spark, d))).select("a", "b", "lift")


ACROSS = "pp AS (SELECT DISTINCT x.text_id, x.id AS i, y.id AS j, least(x.w, y.w) AS a, greatest(x.w, y.w) AS b FROM bw x JOIN bw y ON x.text_id = y.text_id AND x.id < y.id AND x.w <> y.w)"


@query("e12_pairs_across", f"{WITH_BEINGS}, {PAIRS}, {ACROSS} SELECT text_id, a, b, count(*) AS n FROM pp GROUP BY 1, 2, 3")
def e12(spark, d):
    return B.pairs_across(beings(spark, d))


@query("f30_pair_across", f"{WITH_BEINGS}, {PAIRS}, {ACROSS} SELECT a, b, count(*) AS n FROM pp GROUP BY 1, 2")
def f30(spark, d):
    return B.pair_across(beings(spark, d))


@query("f31_word_sets", f"{WITH_BEINGS} SELECT array_to_string(words, ' ') AS words, count(*) AS n FROM beings WHERE len(words) > 1 GROUP BY 1 ORDER BY n DESC, words LIMIT 14")
def f31(spark, d):
    return B.word_sets(beings(spark, d))


# ---- what is kept ------------------------------------------------------------------------------
NAMED = ("nt AS (SELECT DISTINCT lower(p_brand) || ' ' || lower(p_type) || ' of ' || split_part(p_name, ' ', 2) AS norm, l_orderkey AS text_id, split_part(p_name, ' ', 2) AS noun, lower(p_type) AS w FROM lineitem JOIN part ON p_partkey = l_partkey)")


def named(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"), F.lower("p_type").alias("w"), F.lower("p_brand").alias("brand"))
    norm = F.concat_ws(" ", "brand", "w", F.lit("of"), "noun")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey").select(norm.alias("norm"), F.col("l_orderkey").alias("text_id"))
    kept_ = p.select(norm.alias("norm"), F.array("noun").alias("nouns"), F.array("w").alias("words")).distinct()
    return rows, kept_


@query("f32_kept_by_name", f"""WITH {NAMED}, c AS (SELECT noun, norm, count(*) AS n FROM nt GROUP BY 1, 2), t AS (SELECT noun, string_agg(norm, '; ' ORDER BY n DESC, norm) AS as_in FROM (SELECT *, row_number() OVER (PARTITION BY noun ORDER BY n DESC, norm) AS rn FROM c) WHERE rn <= 3 GROUP BY 1)
    SELECT noun, count(DISTINCT text_id) AS texts, count(DISTINCT w) AS n_words, any_value(as_in) AS as_in FROM nt JOIN t USING (noun) GROUP BY 1 HAVING count(DISTINCT text_id) >= 2""")
def f32(spark, d):
    return B.kept_by_name(*named(spark, d))


@query("f32_word_matrix", f"WITH {NAMED} SELECT noun, " + ", ".join(f"count(DISTINCT text_id) FILTER (w = '{w}') AS {w}" for w in STEMS) + " FROM nt GROUP BY 1")
def f32b(spark, d):
    rows, kept_ = named(spark, d)
    return B.word_matrix(rows.distinct().join(kept_, "norm").withColumn("noun", F.explode("nouns")), "text_id", STEMS)


PHRASES = ("ph AS (SELECT l_orderkey AS text_id, split_part(p_name, ' ', 2) AS word, unnest(['pre', 'of']) AS form, unnest([split_part(p_name, ' ', 1), lower(p_type) || ' hall']) AS x FROM lineitem JOIN part ON p_partkey = l_partkey)")


def phrases(spark, d):
    from spanloom.functions.text import kept_phrases
    nouns = ("ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("s of the "), F.lower("p_type"), F.lit(" hall")).alias("label"))
    rows = p.select("l_partkey", F.inline(kept_phrases("label", nouns)))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("text_id"), "l_partkey").join(rows, "l_partkey")


@query("f33_h5_kept_phrases", f"WITH {PHRASES} SELECT x, count(DISTINCT text_id) AS texts, count(DISTINCT text_id) FILTER (form = 'pre') AS texts_pre, count(DISTINCT text_id) FILTER (form = 'of') AS texts_of, count(DISTINCT word) AS n_words FROM ph GROUP BY 1 HAVING count(DISTINCT text_id) >= 2")
def f33(spark, d):
    return B.kept_phrase_table(phrases(spark, d))


@query("f33_kept_phrase_forms", f"WITH {PHRASES} SELECT word, form, x, count(DISTINCT text_id) AS texts FROM ph GROUP BY 1, 2, 3 HAVING count(DISTINCT text_id) >= 2")
def f33b(spark, d):
    return B.kept_phrase_forms(phrases(spark, d))


_KINDS = ("ring", "widget", "bolt", "gear")


@query("f33_kept_phrase_kinds", "WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS pre, split_part(p_name, ' ', 2) AS noun, p_partkey % 3 AS k FROM part) SELECT p_partkey, noun AS word, CASE WHEN k = 0 THEN pre END AS x, CASE WHEN k = 0 THEN 'high hall' END AS \"of\", "
       "k = 1 AS possessive, k = 2 AS bare FROM p WHERE noun IN ('ring', 'widget', 'bolt', 'gear')")
def f33c(spark, d):
    """A hyphened, a possessive and a bare form by turns."""
    from spanloom.functions.text import kept_phrase_kinds
    pre, noun, k = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey") % 3
    label = F.when(k == 0, F.concat(pre, F.lit("-"), noun, F.lit("s of the high hall"))).when(k == 1, F.concat(F.lit("the city's "), noun)).otherwise(F.concat(noun, F.lit("s")))
    said = table(spark, d, "part").select("p_partkey", label.alias("label")).select("p_partkey", F.inline(F.array(*[kept_phrase_kinds("label", w) for w in _KINDS])))
    return said.filter("holds").drop("holds")


def side_sql(t, name="beings"):
    return f"SELECT noun, count(DISTINCT id) AS {name}, count(DISTINCT w) AS n_words FROM (SELECT noun, id, unnest(words) AS w FROM {t}) GROUP BY 1"


@query("f35_side_table", f"{WITH_KEPT} SELECT 'for' AS side, * FROM ({side_sql('kf')}) WHERE beings >= 3 UNION ALL SELECT 'against', * FROM ({side_sql('ka')}) WHERE beings >= 3")
def f35(spark, d):
    b, k = beings(spark, d), kept(spark, d)
    return B.side_table(b, k, "for").withColumn("side", F.lit("for")).unionByName(B.side_table(b, k, "against").withColumn("side", F.lit("against")))


ERAS_SQL = "['2024 and before', 'first half of 2025', 'second half of 2025', '2026']"


@query("f36_trend_table", f"""{WITH_KEPT}, dn AS (SELECT era, count(*) AS n FROM fr WHERE era IS NOT NULL AND id IN (SELECT id FROM kl) GROUP BY 1), c AS (SELECT noun, count(*) AS beings, """
       + ", ".join(f"round(100.0 * count(*) FILTER (era = {ERAS_SQL}[{i + 1}]) / (SELECT n FROM dn WHERE era = {ERAS_SQL}[{i + 1}]), 2) AS p{i}" for i in range(4))
       + " FROM kf WHERE era IS NOT NULL GROUP BY 1) SELECT *, round(p3 - p0, 2) AS change, round(p3 / p0, 1) AS times FROM c WHERE beings >= 25")
def f36(spark, d):
    return B.trend_table(being_rows(spark, d), kept(spark, d), "for")


@query("f36_trend_selection", f"""{WITH_KEPT}, se AS (SELECT * FROM fr WHERE era IS NOT NULL AND model LIKE 'ASIA/%' AND id IN (SELECT id FROM kl)), dn AS (SELECT era, count(*) AS n FROM se GROUP BY 1), c AS (SELECT noun, count(*) AS beings, """
       + ", ".join(f"round(100.0 * count(*) FILTER (era = {ERAS_SQL}[{i + 1}]) / (SELECT n FROM dn WHERE era = {ERAS_SQL}[{i + 1}]), 2) AS p{i}" for i in range(4))
       + " FROM kf WHERE id IN (SELECT id FROM se) GROUP BY 1) SELECT *, round(p3 - p0, 2) AS change, round(p3 / nullif(p0, 0), 1) AS times FROM c WHERE beings >= (SELECT greatest(4, floor(25 * count(*) / 16400 + 0.5)) FROM se)")
def f36b(spark, d):
    """The same of one line of writers, with the minimum that its size gives."""
    return B.trend_table(being_rows(spark, d).filter(F.col("model").startswith("ASIA/")), kept(spark, d), "for", None)


@query("f37_both_sides", f"{WITH_KEPT} SELECT a.noun, a.beings AS against, f.beings AS \"for\" FROM ({side_sql('ka')}) a JOIN ({side_sql('kf')}) f USING (noun) WHERE a.beings >= 60 ORDER BY 2 DESC, 3 DESC, 1 DESC LIMIT 10")
def f37(spark, d):
    b, k = beings(spark, d), kept(spark, d)
    return B.both_sides(B.side_table(b, k, "for"), B.side_table(b, k, "against"))


@query("f37_leading_noun", f"{WITH_KEPT}, c AS (SELECT word, noun, count(DISTINCT id) AS n FROM (SELECT unnest(words) AS word, noun, id FROM kf) GROUP BY 1, 2) SELECT word, arg_max(noun, (n, noun)) AS noun, max(n) AS n FROM c GROUP BY 1")
def f37b(spark, d):
    return B.leading_noun(B.sides(beings(spark, d), kept(spark, d), "for"))


@query("f37_family_share", f"{WITH_KEPT}, c AS (SELECT word, id, max(CASE WHEN noun IN ('ring', 'rod', 'plate') THEN 1 ELSE 0 END) AS f FROM (SELECT unnest(words) AS word, noun, id FROM kf) GROUP BY 1, 2) SELECT word, count(*) AS beings, sum(f)::BIGINT AS family, round(100.0 * sum(f) / count(*), 1) AS family_pct FROM c GROUP BY 1")
def f37c(spark, d):
    return B.family_share(B.sides(beings(spark, d), kept(spark, d), "for"), ("ring", "rod", "plate"))


# ---- cohorts, levels, lifts -------------------------------------------------------------------------
@query("f38_cohort_writers", f"{WITH_FACTS} SELECT model, count(*) AS beings, round(100.0 * count(*) FILTER (n_cost > 0) / count(*), 1) AS cost_pct, count(*) FILTER (n_sentences BETWEEN 30 AND 60) AS band_beings, CASE WHEN band_beings >= 40 THEN round(100.0 * count(*) FILTER (n_cost > 0 AND n_sentences BETWEEN 30 AND 60) / band_beings, 1) END AS band_pct FROM fr GROUP BY 1 HAVING count(*) >= 60")
def f38(spark, d):
    return B.cohort_writers(being_rows(spark, d))


@query("f38_cohort_halves", f"""{WITH_FACTS}, h AS (SELECT fr.*, substr(released, 1, 4) || CASE WHEN substr(released, 6, 2) <= '06' THEN ' first half' ELSE ' second half' END AS half FROM fr WHERE released >= '2020-01-01' AND model IN (SELECT model FROM fr GROUP BY 1 HAVING count(*) >= 60))
    SELECT half, count(DISTINCT model) AS writers, count(*) AS beings, round(100.0 * count(*) FILTER (n_cost > 0) / count(*), 1) AS cost_pct, CASE WHEN count(*) FILTER (n_sentences BETWEEN 30 AND 60) >= 40 THEN round(100.0 * count(*) FILTER (n_cost > 0 AND n_sentences BETWEEN 30 AND 60) / count(*) FILTER (n_sentences BETWEEN 30 AND 60), 1) END AS band_pct,
    round(100.0 * count(*) FILTER (list_contains(words, 'promo')) / count(*), 1) AS promo_pct, round(100.0 * count(*) FILTER (list_contains(words, 'small')) / count(*), 1) AS small_pct FROM h GROUP BY 1""")
def f38b(spark, d):
    return B.cohort_halves(being_rows(spark, d), ("promo", "small"))


@query("f38_lineage", f"{WITH_FACTS} SELECT model, released, count(*) AS beings, {shares(names=('cost', 'fate'))}, round(100.0 * count(*) FILTER (list_contains(words, 'promo')) / count(*), 1) AS promo_pct, (SELECT list_sort(list(n))[count(*) // 2 + 1] FROM (SELECT DISTINCT text_id, n_sentences AS n FROM fr x WHERE x.model = fr.model AND released IS NOT NULL)) AS median_sentences FROM fr WHERE model LIKE 'ASIA/%' AND released IS NOT NULL GROUP BY 1, 2")
def f38c(spark, d):
    return B.lineage(being_rows(spark, d), "ASIA/", ("promo",))


LV = "lv AS (SELECT fr.*, split_part(model, '/', 1) AS lab, CASE WHEN n_fate > 1 THEN 'is' WHEN n_cost > 0 THEN 'alive' WHEN n_role > 1 THEN 'part' ELSE 'in' END AS level FROM fr)"


def leveled(spark, d):
    level = F.when(F.col("n_fate") > 1, "is").when(F.col("n_cost") > 0, "alive").when(F.col("n_role") > 1, "part").otherwise("in")
    return being_rows(spark, d).withColumn("lab", F.split_part("model", F.lit("/"), F.lit(1))).withColumn("level", level)


def level_sql(by):
    return (f"SELECT '{by}' AS by, {by}::VARCHAR AS value, count(*) AS texts, " + ", ".join(f"round(100.0 * count(*) FILTER (level = '{x}') / count(*), 1) AS {x}_pct" for x in ("in", "part", "alive", "is"))
            + f", round(100.0 * count(*) FILTER (level <> 'in') / count(*), 1) AS part_or_more_pct FROM lv WHERE {by} IS NOT NULL GROUP BY 2 HAVING count(*) >= 300")


@query("f39_level_tables", f"{WITH_FACTS}, {LV} {level_sql('era')} UNION ALL {level_sql('lab')} UNION ALL {level_sql('arrangement')}")
def f39(spark, d):
    out, x = None, leveled(spark, d)
    for by in ("era", "lab", "arrangement"):
        part = B.level_tables(x, by, 300).withColumnRenamed(by, "value").withColumn("by", F.lit(by))
        out = part if out is None else out.unionByName(part)
    return out


@query("f39_level_totals", f"{WITH_FACTS}, {LV} SELECT level, count(*) AS texts, round(100.0 * count(*) / (SELECT count(*) FROM lv), 1) AS pct FROM lv GROUP BY 1")
def f39b(spark, d):
    return B.level_totals(leveled(spark, d))


@query("f39_level_words", f"{WITH_FACTS}, {LV}, w AS (SELECT *, unnest(words) AS word FROM lv) SELECT word, count(*) AS texts, " + ", ".join(f"round(100.0 * count(*) FILTER (level = '{x}') / count(*), 1) AS {x}_pct" for x in ("in", "part", "alive", "is"))
       + ", round(100.0 * count(*) FILTER (level <> 'in') / count(*), 1) AS part_or_more_pct FROM w GROUP BY 1")
def f39c(spark, d):
    return B.level_words(leveled(spark, d))


@query("f39_level_contrast", f"""{WITH_FACTS}, {LV} SELECT lab, count(*) FILTER (list_contains(words, 'promo')) AS chosen, count(*) FILTER (NOT list_contains(words, 'promo')) AS rest,
    round(100.0 * count(*) FILTER (list_contains(words, 'promo') AND level <> 'in') / nullif(count(*) FILTER (list_contains(words, 'promo')), 0), 1) AS chosen_pct,
    round(100.0 * count(*) FILTER (NOT list_contains(words, 'promo') AND level <> 'in') / nullif(count(*) FILTER (NOT list_contains(words, 'promo')), 0), 1) AS rest_pct FROM lv WHERE lab IS NOT NULL GROUP BY 1""")
def f39d(spark, d):
    return B.level_contrast(leveled(spark, d), "lab", F.array_contains("words", "promo"))


@query("f40_presence_lift", f"""{WITH_LABELS}, g AS (SELECT text_id, text_id % 3 = 0 AS p FROM texts), w(probe) AS (VALUES ('thing'), ('ther'), ('hest'), ('oner')), h AS (SELECT DISTINCT w.probe, l.text_id FROM labels2 l, w WHERE regexp_matches(l.norm, '(^|[^a-z])' || w.probe || '(s|es)?([^a-z]|$)'))
    SELECT probe, count(*) FILTER (p) AS n_p, count(*) FILTER (NOT p) AS n_i, round(100.0 * n_p / (SELECT count(*) FROM g WHERE p), 1) AS p_pct, round(100.0 * n_i / (SELECT count(*) FROM g WHERE NOT p), 1) AS i_pct,
    round((n_p / (SELECT count(*) FROM g WHERE p)) / nullif(n_i / (SELECT count(*) FROM g WHERE NOT p), 0), 1) AS lift FROM h JOIN g USING (text_id) GROUP BY 1""")
def f40(spark, d):
    groups = texts(spark, d).select("text_id", (F.col("text_id") % 3 == 0).alias("in_p"))
    return B.presence_lift(labels(spark, d), groups, ("thing", "ther", "hest", "oner"))


@query("f41_era_features", f"""{WITH_KEPT}, s AS (SELECT fr.*, id IN (SELECT id FROM kl WHERE side = 'for' AND noun IN ('ring', 'rod')) AS bal, id IN (SELECT id FROM kl WHERE side = 'against') AS ag FROM fr WHERE era IS NOT NULL)
    SELECT era, count(*) AS beings, round(100.0 * count(*) FILTER (called LIKE '%high%') / count(*), 1) AS called_pct, round(100.0 * count(*) FILTER (list_contains(words, 'x')) / count(*), 1) AS hyphen_pct, round(100.0 * count(*) FILTER (bal) / count(*), 1) AS balance_pct,
    round(100.0 * count(*) FILTER (ag) / count(*), 1) AS against_pct, round(100.0 * count(*) FILTER (n_role <= 1) / count(*), 1) AS short_role_pct, {shares(names=('cost', 'fate'))} FROM s GROUP BY 1""")
def f41(spark, d):
    return B.era_features(being_rows(spark, d), kept(spark, d), ("high",), ("ring", "rod"))


@query("f42_probe_prevalence", f"WITH {TEXTS} SELECT place_id AS era, count(*) AS texts, round(100.0 * count(*) FILTER (regexp_matches(t, '(?i)\\bthing(s)?\\b')) / count(*), 1) AS thing_pct, round(100.0 * count(*) FILTER (regexp_matches(t, '(?i)\\b(that|this) (the|of)\\b')) / count(*), 1) AS that_pct FROM texts GROUP BY 1")
def f42(spark, d):
    return B.probe_prevalence(texts(spark, d).withColumnRenamed("place_id", "era"), {"thing": r"(?iU)\bthing(s)?\b", "that": r"(?iU)\b(that|this) (the|of)\b"})


@query("f44_voices", "SELECT CASE turn % 3 WHEN 0 THEN 'keeper' WHEN 1 THEN 'narrator' ELSE 'none' END AS i, count(*) AS n FROM conversations GROUP BY 1")
def f44(spark, d):
    v = table(spark, d, "conversations").select(F.col("conv_id").alias("being_id"), F.when(F.col("turn") % 3 == 0, "keeper").when(F.col("turn") % 3 == 1, "narrator").otherwise("none").alias("i"))
    return B.voices(v, "i")


@query("f44_voices_by_writer", f"{WITH_BEINGS} SELECT model, count(*) FILTER (n_role = 0) AS says_i, count(*) FILTER (n_relation = 0) AS is_you FROM beings GROUP BY 1")
def f44b(spark, d):
    b = beings(spark, d)
    v = b.select(F.col("id").alias("being_id"), F.when(F.col("n_role") == 0, "keeper").otherwise("none").alias("i"), F.when(F.col("n_relation") == 0, "keeper").otherwise("none").alias("you"))
    return B.voices_by_writer(v, b)


@query("f48_answer_agreement", f"{WITH_BEINGS}, p AS (SELECT text_id, max(n_cost > 0) AS hc, max(n_fate > 0) AS hf, max(n_origin > 0) AS mc, max(n_role > 0) AS mf FROM beings GROUP BY 1) SELECT 'cost' AS question, count(*) AS n, count(*) FILTER (hc = mc) AS agree FROM p UNION ALL SELECT 'fate', count(*), count(*) FILTER (hf = mf) FROM p")
def f48(spark, d):
    def arr(c):
        return F.filter(F.sequence(F.lit(0), F.col(c)), lambda x: x > 0)
    b = beings(spark, d)
    hand = b.select("text_id", arr("n_cost").alias("cost"), arr("n_fate").alias("fate"))
    model = b.select("text_id", arr("n_origin").alias("cost"), arr("n_role").alias("fate"))
    return E.answer_agreement(hand, model, ("cost", "fate"))


SEL = "(era = '2026' AND list_contains(words, 'promo'))"


@query("f51_portrait", f"{WITH_FACTS} SELECT coalesce({SEL}, false) AS in_sel, count(*) AS beings, count(DISTINCT text_id) AS texts, {shares()}, " + ", ".join(f"round(100.0 * count(*) FILTER (arrangement = '{k}') / count(*), 1) AS {k}_pct" for k in B.ARRANGEMENTS) + ", list_sort(list(n_sentences))[count(*) // 2 + 1] AS median_sentences FROM fr GROUP BY 1")
def f51(spark, d):
    return B.portrait(being_rows(spark, d), (F.col("era") == "2026") & F.array_contains("words", "promo"))


@query("f51_portrait_words", f"{WITH_FACTS}, s AS (SELECT coalesce({SEL}, false) AS z, words FROM fr) SELECT word, count(*) FILTER (z) AS s, count(*) FILTER (NOT z) AS r, round(100.0 * count(*) FILTER (z) / (SELECT count(*) FROM s WHERE z), 1) AS sel_pct, round(100.0 * count(*) FILTER (NOT z) / (SELECT count(*) FROM s WHERE NOT z), 1) AS rest_pct FROM (SELECT z, unnest(words) AS word FROM s) GROUP BY 1")
def f51b(spark, d):
    return B.portrait_words(being_rows(spark, d), (F.col("era") == "2026") & F.array_contains("words", "promo"))


@query("f51_portrait_nouns", f"{WITH_KEPT} SELECT noun, count(*) AS beings FROM kf WHERE {SEL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 28")
def f51c(spark, d):
    return B.portrait_nouns(B.sides(being_rows(spark, d), kept(spark, d), "for"), (F.col("era") == "2026") & F.array_contains("words", "promo"))


@query("f52_share_extremes", f"""{WITH_BEINGS}, p AS (SELECT model, count(*) AS beings, count(*) FILTER (list_contains(words, 'promo')) AS n FROM beings GROUP BY 1 HAVING count(*) >= 40)
    SELECT 'high' AS "end", model, beings, n, round(100.0 * n / beings, 1) AS pct FROM (SELECT * FROM p ORDER BY n / beings DESC, model LIMIT 10) UNION ALL SELECT 'low', model, beings, n, round(100.0 * n / beings, 1) FROM (SELECT * FROM p ORDER BY n / beings, model DESC LIMIT 5)""")
def f52(spark, d):
    return B.share_extremes(beings(spark, d), "promo")


@query("f56_beings_per_text", f"{WITH_BEINGS}, c AS (SELECT o_custkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE count(*) - 5 END AS n_beings FROM orders GROUP BY 1) SELECT n_beings, count(*) AS texts FROM c GROUP BY 1")
def f56(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) - 5).alias("n"))
    return B.beings_per_text(c.select(F.when(F.col("o_custkey") % 5 != 0, F.col("n")).alias("n_beings")))


@query("e21_siblings", f"{WITH_BEINGS} SELECT c.id AS \"of\", b.text_id, b.id, b.called FROM beings b JOIN beings c ON b.text_id = c.text_id AND b.id <> c.id WHERE c.called = '1-urgent' AND c.n_fate = 2")
def e21(spark, d):
    b = beings(spark, d)
    return B.siblings(b.select("id", "text_id", "called"), b.filter("called = '1-urgent' and n_fate = 2"))
