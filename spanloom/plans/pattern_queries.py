"""Queries over the pattern registry and the tables of the first and second instrument."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.functions.text import words
from spanloom.operators import evaluate as E, tables as T
from spanloom.operators.patterns import line_test, plain_lower, run_patterns
from spanloom.operators.registry import REGISTRY, registry_history, tuned
from spanloom.plans.data import (ACCENTED, SAMPLE, WITH_COV, WITH_LABELS, WITH_MENTIONS, WITH_NAMES, FACTS, TEXTS, cov, facts, labels, mentions,
                                 names, page_texts, places, precision, query, table, texts)


def joined(col):
    return F.array_join(col, ",")


# ---- D: the registry --------------------------------------------------------------------
@query("d_registry_hits")
def d_all(spark, d):
    """The whole registry over all texts. Patterns look around, which the checking engine
    cannot; tests compare every pattern with Python's own matches."""
    m = run_patterns(texts(spark, d))
    return m.select("text_id", "pattern_id", "start", "end", "surface", "norm")


@query("d_registry_titles")
def d_pages(spark, d):
    """The registry over pages, whose headings feed the title patterns."""
    m = run_patterns(page_texts(spark, d))
    return m.select("text_id", "pattern_id", "start", "end", "surface", "norm")


@query("d_sample_mentions", f"{WITH_MENTIONS} SELECT text_id, pattern_id, start, surface, norm, occ, occ_cased FROM mentions")
def d_sample(spark, d):
    """Stoplist, reject, recurrence, corpus rarity and sentence patterns in one run."""
    m = mentions(spark, d)
    name = F.col("yields") == "name"
    return m.select("text_id", "pattern_id", F.col("start").cast("long").alias("start"), "surface", "norm",
                    F.when(name, F.col("occ")).alias("occ"), F.when(name, F.col("occ_cased")).alias("occ_cased"))


@query("h2_registry_history", "SELECT p_brand AS family, CASE WHEN p_size >= 10 THEN 'active' ELSE 'retired' END AS status, count(*) AS n, count(DISTINCT p_name) AS ids, max(CASE WHEN p_size < 10 THEN 'split' END) AS reason FROM part GROUP BY 1, 2")
def h2(spark, d):
    """Active and retired versions in one table, with parts as pattern rows."""
    rows = table(spark, d, "part").select(F.col("p_name").alias("id"), F.col("p_partkey").alias("version"), F.col("p_brand").alias("family"), "p_size")
    active = rows.filter("p_size >= 10").drop("p_size").withColumn("status", F.lit("active"))
    old = rows.filter("p_size < 10").drop("p_size").withColumn("status", F.lit("retired")).withColumn("retired_reason", F.lit("split"))
    both = registry_history(active, old)
    return both.groupBy("family", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.max("retired_reason").alias("reason"))


# ---- first instrument ----------------------------------------------------------------------
@query("f5_e9_text_names", f"{WITH_NAMES} SELECT text_id, norm, display, n_mentions, patterns, score, first_pos, occurrences, in_title, body_occ, body_cased, in_place_text FROM names")
def f5(spark, d):
    n = names(spark, d)
    return n.select("text_id", "norm", "display", "n_mentions", joined("patterns").alias("patterns"), "score", F.col("first_pos").cast("long").alias("first_pos"),
                    F.col("occurrences").cast("long").alias("occurrences"), "in_title", F.col("body_occ").cast("long").alias("body_occ"), F.col("body_cased").cast("long").alias("body_cased"), "in_place_text")


COV_COLS = "text_id, model, length, tagged, flag, n_hits, n_names, best, expected, n_statements, n_anti, best_body, best_title_only, n_names_80, n_place_self, n_process, n_species, n_param_echo, kind"


@query("f6_f7_text_cov", f"{WITH_COV} SELECT {COV_COLS} FROM cov")
def f6(spark, d):
    return cov(spark, d).select(*COV_COLS.split(", "))


NAMES_SQL = f"""{WITH_COV}, nm AS (SELECT n.*, c.model, (n.in_title > 0 AND n.body_occ = 0) AS only_title FROM names n JOIN cov c USING (text_id) WHERE c.flag = ''),
    mw AS (SELECT norm, model, sum(score) AS k FROM nm GROUP BY 1, 2), top AS (SELECT norm, string_agg(model || ' ' || round(k, 0)::INT, ', ' ORDER BY round(k, 0) DESC, model) AS top_models FROM
    (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY round(k, 0) DESC, model) AS rn FROM mw WHERE k >= 0.5) WHERE rn <= 4 GROUP BY 1),
    st AS (SELECT norm, arg_min(display, (-score, text_id)) AS display, count(*) AS n_texts, round(sum(score), 2) AS expected, round(sum(CASE WHEN in_place_text = 0 THEN score ELSE 0 END), 2) AS expected_new,
    max(score) AS best, sum(n_mentions)::BIGINT AS n_mentions, round(sum(CASE WHEN only_title THEN score ELSE 0 END), 2) AS expected_title_only,
    array_to_string(list_sort(list_distinct(flatten(list(string_split(patterns, ','))))), ',') AS patterns FROM nm GROUP BY 1),
    strings AS (SELECT st.*, coalesce(top.top_models, '') AS top_models, (SELECT CASE WHEN count(*) FILTER (k > 0) > 0 THEN count(*) FILTER (k > 0) ELSE count(*) END FROM mw WHERE mw.norm = st.norm) AS n_models FROM st LEFT JOIN top ON top.norm = st.norm)"""


def strings(spark, d):
    m = mentions(spark, d).persist()
    n = T.text_names(m, precision(spark), places(spark, d), texts(spark, d))
    return m, n, T.names_table(n, T.text_cov(facts(spark, d), m, n))


@query("f8_names", NAMES_SQL + " SELECT norm, display, n_texts, expected, expected_new, best, n_models, n_mentions, patterns, top_models, expected_title_only FROM strings")
def f8(spark, d):
    s = strings(spark, d)[2]
    shown = F.array_join(F.transform(F.coalesce("top_models", F.array().cast("array<struct<model:string,score:double>>")), lambda x: F.concat_ws(
        " ", x["model"], x["score"].cast("int").cast("string"))), ", ")
    return s.select("norm", "display", "n_texts", "expected", "expected_new", "best", "n_models", "n_mentions", joined("patterns").alias("patterns"), shown.alias("top_models"), "expected_title_only")


@query("f4_pattern_model", f"{WITH_MENTIONS} SELECT pattern_id, model, count(*) AS n_mentions, count(DISTINCT text_id) AS n_texts FROM mentions JOIN texts USING (text_id) GROUP BY 1, 2")
def f4(spark, d):
    return T.pattern_model(mentions(spark, d), texts(spark, d))


@query("f14_pattern_stats", f"{WITH_MENTIONS} SELECT pattern_id, count(*) AS n_hits, count(DISTINCT text_id) AS n_texts, count(DISTINCT norm) AS n_strings, count(DISTINCT model) AS n_models FROM mentions JOIN texts USING (text_id) GROUP BY 1")
def f14(spark, d):
    return T.pattern_stats(mentions(spark, d), texts(spark, d))


@query("f14_g9_pattern_captures", f"{WITH_MENTIONS}, c AS (SELECT pattern_id, norm, count(*) AS n_hits, count(DISTINCT text_id) AS n_texts FROM mentions WHERE norm <> '' GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY n_texts DESC, n_hits DESC, norm) AS rank FROM c) WHERE rank <= 300")
def f14b(spark, d):
    return T.pattern_captures(mentions(spark, d))


@query("f15_n80", f"{WITH_COV} SELECT norm, count(*) AS n_texts_80 FROM names JOIN cov USING (text_id) WHERE score >= 0.8 AND flag = '' GROUP BY 1")
def f15(spark, d):
    return T.n80(names(spark, d), facts(spark, d))


@query("f9_run_stats", NAMES_SQL + """ SELECT count(*) AS texts, count(*) FILTER (flag <> '') AS flagged, count(*) FILTER (tagged = '') AS untagged, count(*) FILTER (flag = '' AND best >= 0.8) AS best_80,
    count(*) FILTER (flag = '' AND best >= 0.5 AND best < 0.8) AS best_50_80, count(*) FILTER (flag = '' AND n_names > 0 AND best < 0.5) AS best_under_50, count(*) FILTER (flag = '' AND n_names = 0) AS best_none,
    count(*) FILTER (flag = '' AND best_body >= 0.8) AS body_80, count(*) FILTER (flag = '' AND best_body < 0.5 AND best_title_only > 0) AS titled_any_not_named, count(*) FILTER (flag = '' AND n_statements > 0) AS name_talk_texts,
    count(*) FILTER (kind = 'catalogue') AS kind_catalogue, count(*) FILTER (kind = 'a process') AS kind_a_process, (SELECT count(*) FROM mentions) AS mentions, (SELECT count(*) FROM strings) AS distinct_strings,
    (SELECT count(*) FROM strings WHERE best >= 0.8) AS distinct_at_80, 1 AS patterns_at_80, (SELECT count(*) FROM labels) AS verdicts, count(*) FILTER (flag = '' AND best >= 0.8) AS covered FROM cov""")
def f9(spark, d):
    m, n, s = strings(spark, d)
    p = precision(spark).withColumn("yields", F.lit("name"))
    stats = T.run_stats(T.text_cov(facts(spark, d), m, n), m, s, p, table(spark, d, "labels"), len(SAMPLE))
    return stats.select("texts", "flagged", "untagged", "best_80", "best_50_80", "best_under_50", "best_none", "body_80", "titled_any_not_named", "name_talk_texts",
                        "kind_catalogue", "kind_a_process", "mentions", "distinct_strings", "distinct_at_80", "patterns_at_80", "verdicts", "covered")


@query("f10_model_coverage", f"""{WITH_COV} SELECT model, count(*) FILTER (flag = '') AS texts, count(*) FILTER (flag <> '') AS flagged, count(*) FILTER (flag = '' AND best >= 0.8) AS hi,
    count(*) FILTER (flag = '' AND best >= 0.5 AND best < 0.8) AS mid, count(*) FILTER (flag = '' AND best > 0 AND best < 0.5) AS lo, count(*) FILTER (flag = '' AND best = 0) AS none, count(*) FILTER (flag = '' AND best_body < 0.5) AS body_lo,
    count(*) FILTER (flag = '' AND best_body < 0.5 AND best_title_only > 0) AS titled, count(*) FILTER (flag = '' AND n_anti > 0) AS anti, count(*) FILTER (flag = '' AND n_anti > 0 AND best < 0.5) AS anti_lo,
    count(*) FILTER (flag = '' AND n_statements > 0) AS talk, round(sum(expected) FILTER (flag = '') / count(*) FILTER (flag = ''), 3) AS expected_per_text FROM cov GROUP BY model""")
def f10(spark, d):
    return T.model_coverage(cov(spark, d))


@query("f16_kind_by_model", f"""{WITH_COV} SELECT model, count(*) AS texts, count(*) FILTER (kind = 'catalogue') AS catalogue, count(*) FILTER (kind = 'named') AS named, count(*) FILTER (kind = 'place itself') AS "place itself",
    count(*) FILTER (kind = 'a process') AS "a process", count(*) FILTER (kind = 'unnamed, said so') AS "unnamed, said so", count(*) FILTER (kind = 'ordinary biology') AS "ordinary biology", count(*) FILTER (kind = 'undetermined') AS undetermined,
    count(*) FILTER (n_place_self > 0) AS say_place, round(100.0 * count(*) FILTER (kind IN ('catalogue', 'named')) / count(*), 1) AS named_pct, round(100.0 * count(*) FILTER (kind = 'place itself') / count(*), 1) AS place_pct,
    round(100.0 * count(*) FILTER (n_place_self > 0) / count(*), 1) AS say_place_pct FROM cov WHERE flag = '' GROUP BY model""")
def f16(spark, d):
    return T.kind_by_model(cov(spark, d))


@query("e23_statement_list", f"{WITH_COV} SELECT m.text_id, m.start, c.model, c.best, CASE WHEN length(m.surface) < 120 THEN m.surface ELSE left(m.surface, 117) || '…' END AS sentence FROM mentions m JOIN cov c USING (text_id) WHERE m.pattern_id = 'anti_name' AND c.flag = ''")
def e23(spark, d):
    m = mentions(spark, d).persist()
    c = T.text_cov(facts(spark, d), m, T.text_names(m, precision(spark)))
    return T.statement_list(m, c, "anti_name", 120).withColumn("start", F.col("start").cast("long"))


@query("e1_e11_hits_with_facts", f"{WITH_MENTIONS}, {FACTS} SELECT m.text_id, m.pattern_id, m.start, f.model, f.length, f.flag FROM mentions m JOIN facts f USING (text_id) WHERE f.model LIKE '%src1%'")
def e1(spark, d):
    f = facts(spark, d).filter(F.col("model").contains("src1")).select("text_id", "model", "length", "flag")
    return mentions(spark, d).join(f, "text_id").select("text_id", "pattern_id", F.col("start").cast("long").alias("start"), "model", "length", "flag")


# ---- verdicts on hits of the sample registry ---------------------------------------------------
VERDICTS = ("vd AS (SELECT x.pattern, x.text, x.start, x.e, CASE WHEN l.toxic = 1 THEN 'g' WHEN l.quality = 1 THEN CASE x.text % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'p' ELSE 't' END ELSE 'x' END AS verdict, l.quality, l.toxic FROM "
            "(SELECT pattern_id AS pattern, text_id AS text, min(start) + CASE WHEN text_id % 7 = 0 THEN 100000 ELSE 1 END AS start, min(start) + CASE WHEN text_id % 7 = 0 THEN 100000 ELSE 1 END + 3 AS e FROM mentions WHERE yields = 'name' GROUP BY 1, 2) x JOIN labels l ON l.doc_id = x.text), "
            "tg AS (SELECT vd.*, pattern AS target, true AS own FROM vd WHERE pattern <> 'after_stop' UNION ALL SELECT vd.*, 'a_word', false FROM vd WHERE pattern = 'the_plural'), "
            "al AS (SELECT tg.*, EXISTS (SELECT 1 FROM mentions m WHERE m.yields = 'name' AND m.pattern_id = tg.target AND m.text_id = tg.text AND m.start < tg.e AND m.e > tg.start) AS alive FROM tg)")


def verdicts(spark, d, m):
    first = m.filter("yields = 'name'").groupBy("pattern_id", "text_id").agg(F.min("start").alias("s"))
    v = first.join(table(spark, d, "labels").withColumnRenamed("doc_id", "text_id"), "text_id")
    start = F.col("s") + F.when(F.col("text_id") % 7 == 0, 100000).otherwise(1)
    code = F.when(F.col("toxic") == 1, "g").when(F.col("quality") == 1, F.get(F.array(F.lit("b"), F.lit("p"), F.lit("t")), (F.col("text_id") % 3).cast("int"))).otherwise("x")
    return v.select(F.col("pattern_id").alias("pattern"), F.col("text_id").alias("text"), start.alias("start"), (start + 3).alias("end"), code.alias("verdict"))


def heirs(spark):
    return spark.createDataFrame([("the_plural", "a_word")], "source string, target string")


def active(spark):
    return spark.createDataFrame([("the_plural",), ("a_word",)], "id string")


@query("e2_e3_f3_pattern_eval", f"""{WITH_MENTIONS}, {VERDICTS} SELECT target AS pattern_id, count(*) FILTER (alive AND verdict IN ('b', 'p', 't', 's', 'x')) AS n_read, count(*) FILTER (alive AND verdict = 'b') AS n_being, count(*) FILTER (alive AND verdict = 'p') AS n_place,
    count(*) FILTER (alive AND verdict = 't') AS n_thing, count(*) FILTER (alive AND verdict = 's') AS n_statement, count(*) FILTER (alive AND verdict = 'x') AS n_not, count(*) FILTER (alive AND verdict = 'g') AS n_broken,
    count(*) FILTER (NOT alive AND own) AS n_gone, count(*) FILTER (NOT alive AND own AND verdict IN ('x', 'g')) AS n_gone_not,
    CASE WHEN n_read >= 20 THEN round((n_being + n_place + n_thing + n_statement) / n_read, 3) END AS precision FROM al GROUP BY 1""")
def f3(spark, d):
    m = mentions(spark, d).persist()
    return E.pattern_eval(verdicts(spark, d, m), m.filter("yields = 'name'"), heirs(spark), active(spark))


@query("e8_recall_scores", f"{WITH_NAMES}, seen AS (SELECT text_id, unnest(list_distinct(list_transform(regexp_extract_all(t, '[.][ ]([A-Z][a-z]{{3,}})', 1), lambda x: x))) AS name FROM texts) SELECT s.text_id, s.name, coalesce(n.score, 0.0) AS score_now FROM seen s LEFT JOIN names n ON n.text_id = s.text_id AND n.norm = lower(s.name)")
def e8(spark, d):
    from spanloom.plans.data import ACCENTED
    t = F.translate("text", ACCENTED, "0" * len(ACCENTED))
    seen = texts(spark, d).select("text_id", F.array_distinct(F.regexp_extract_all(t, F.lit("[.][ ]([A-Z][a-z]{3,})"), F.lit(1))).alias("n"))
    recall = seen.select(F.lit(1).alias("check"), F.lit("d").alias("date"), F.lit(None).cast("string").alias("pool"), F.col("text_id").alias("text"), F.lit(0).alias("read_chars"),
                         F.map_from_arrays("n", F.transform("n", lambda x: F.lit("missed"))).alias("names"), F.lit(None).cast("array<string>").alias("forms_missed"), F.lit(None).cast("string").alias("note"))
    return E.recall_scores(recall, names(spark, d)).filter(F.col("name").isNotNull()).select("text_id", "name", "score_now")


SCORED = ("sc AS (SELECT o_custkey % 3 AS \"check\", CASE WHEN o_orderkey % 2 = 0 THEN 'all' ELSE 'covered' END AS pool, o_custkey AS text_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS name, "
          "CASE o_orderkey % 4 WHEN 0 THEN 'strict' WHEN 1 THEN 'wide' WHEN 2 THEN 'missed' ELSE '0.9' END AS then_caught, (o_orderkey % 11) / 10 AS score_now FROM orders)")


def scored(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        (F.col("o_custkey") % 3).alias("check"), F.lit("2026-01-01").alias("date"), F.when(k % 2 == 0, "all").otherwise("covered").alias("pool"), F.col("o_custkey").alias("text_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("name"),
        F.when(k % 4 == 0, "strict").when(k % 4 == 1, "wide").when(k % 4 == 2, "missed").otherwise("0.9").alias("then_caught"), ((k % 11) / 10).alias("score_now"))


@query("f17_recall_summary", f"""WITH {SCORED} SELECT "check", pool, '2026-01-01' AS date, count(DISTINCT text_id) AS texts, count(DISTINCT text_id) FILTER (name IS NULL) AS texts_no_name, count(name) AS names,
    count(*) FILTER (name IS NOT NULL AND then_caught IN ('strict', '0.9')) AS then_hi, count(*) FILTER (name IS NOT NULL AND then_caught = 'wide') AS then_low, count(*) FILTER (name IS NOT NULL AND then_caught = 'missed') AS then_none,
    count(*) FILTER (name IS NOT NULL AND score_now >= 0.8) AS now_hi, count(*) FILTER (name IS NOT NULL AND score_now < 0.8 AND score_now > 0) AS now_low, count(*) FILTER (name IS NOT NULL AND score_now = 0) AS now_none,
    round(100.0 * then_hi / names, 1) AS then_pct, round(100.0 * now_hi / names, 1) AS now_pct FROM sc GROUP BY 1, 2""")
def f17(spark, d):
    return E.recall_summary(scored(spark, d))


@query("f18_no_name_share", f"""WITH {SCORED} SELECT "check", pool, count(DISTINCT text_id) AS texts, count(DISTINCT text_id) FILTER (name IS NULL) AS no_name, round(100.0 * no_name / texts, 1) AS no_name_pct FROM sc GROUP BY 1, 2""")
def f18(spark, d):
    return E.no_name_share(scored(spark, d))


READERS = "rd AS (SELECT doc_id, CASE WHEN quality = 1 THEN CASE doc_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'p' ELSE 't' END ELSE 'x' END AS first, CASE WHEN toxic = 1 THEN 'x' ELSE CASE doc_id % 2 WHEN 0 THEN 'b' ELSE 'p' END END AS second FROM labels)"


def readers(spark, d):
    k = F.col("doc_id")
    first = F.when(F.col("quality") == 1, F.when(k % 3 == 0, "b").when(k % 3 == 1, "p").otherwise("t")).otherwise("x")
    second = F.when(F.col("toxic") == 1, "x").otherwise(F.when(k % 2 == 0, "b").otherwise("p"))
    return table(spark, d, "labels").select(k.alias("text"), first.alias("first"), second.alias("second"))


@query("f19_agreement", f"""WITH {READERS} SELECT count(*) AS n, count(*) FILTER (first = second) AS exact, count(*) FILTER ((first <> 'x') = (second <> 'x')) AS name_or_not, count(*) FILTER ((first = 'b') = (second = 'b')) AS being_or_not,
    round(100.0 * exact / n, 1) AS exact_pct, round(100.0 * name_or_not / n, 1) AS name_or_not_pct, round(100.0 * being_or_not / n, 1) AS being_or_not_pct FROM rd""")
def f19(spark, d):
    return E.agreement(readers(spark, d))


@query("f19_disagreements", f"WITH {READERS} SELECT first, second, count(*) AS n FROM rd WHERE first <> second GROUP BY 1, 2")
def f19b(spark, d):
    return E.disagreements(readers(spark, d))


LEVELS = "lv AS (SELECT doc_id AS text_id, CASE doc_id % 4 WHEN 0 THEN 'in' WHEN 1 THEN 'part' WHEN 2 THEN 'alive' ELSE 'is' END AS gold, CASE WHEN quality = 0 THEN 'in' WHEN toxic = 1 THEN 'is' ELSE CASE doc_id % 3 WHEN 0 THEN 'part' WHEN 1 THEN 'alive' ELSE 'is' END END AS pred FROM labels)"


def levels(spark, d):
    k = F.col("text_id")
    x = table(spark, d, "labels").withColumnRenamed("doc_id", "text_id")
    names4 = F.array(*map(F.lit, ("in", "part", "alive", "is")))
    gold = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), F.get(names4, (F.col("doc_id") % 4).cast("int")).alias("level"))
    pred = x.select("text_id", F.when(F.col("quality") == 0, "in").when(F.col("toxic") == 1, "is").otherwise(F.get(names4, (k % 3 + 1).cast("int"))).alias("level"))
    return E.compare_levels(gold, pred)


@query("e17_f34_level_agreement", f"""WITH {LEVELS} SELECT count(*) AS n, count(*) FILTER (gold = pred) AS exact, count(*) FILTER ((gold <> 'in') = (pred <> 'in')) AS part_or_more, count(*) FILTER ((gold = 'is') = (pred = 'is')) AS is_agrees,
    count(*) FILTER (gold = 'in' AND pred <> 'in') AS false_pos, count(*) FILTER (gold <> 'in' AND pred = 'in') AS false_neg, count(*) FILTER (gold <> 'in') AS gold_part, count(*) FILTER (pred <> 'in') AS pred_part, count(*) FILTER (gold = 'is') AS gold_is, count(*) FILTER (pred = 'is') AS pred_is,
    round(100.0 * gold_part / n, 1) AS gold_part_pct, round(100.0 * pred_part / n, 1) AS pred_part_pct, round(100.0 * gold_is / n, 1) AS gold_is_pct, round(100.0 * pred_is / n, 1) AS pred_is_pct FROM lv""")
def f34(spark, d):
    return E.level_agreement(levels(spark, d))


@query("f34_confusion", f"WITH {LEVELS} SELECT gold, pred, count(*) AS n FROM lv GROUP BY 1, 2")
def f34b(spark, d):
    return E.confusion(levels(spark, d))


@query("f55_first_read", "SELECT o_custkey AS text_id, min(year(o_orderdate) - 1994) AS first_round FROM orders GROUP BY 1")
def f55(spark, d):
    return E.first_read(table(spark, d, "orders").select(F.col("o_custkey").alias("text_id"), (F.year("o_orderdate") - 1994).alias("round")))


@query("f59_adjudicate", """WITH f AS (SELECT doc_id AS text, unnest(['relation', 'number']) AS key, unnest([quality::VARCHAR, (doc_id % 3)::VARCHAR]) AS first FROM labels),
    s AS (SELECT doc_id AS text, unnest(['relation', 'number']) AS key, unnest([toxic::VARCHAR, (doc_id % 2)::VARCHAR]) AS second FROM labels WHERE doc_id % 3 = 0)
    SELECT f.text, f.key, f.first, s.second, CASE WHEN f.key = 'relation' AND f.text % 9 = 0 THEN 'ruled' ELSE f.first END AS final, f.first IS NOT DISTINCT FROM s.second AS agree FROM f LEFT JOIN s ON s.text = f.text AND s.key = f.key""")
def f59(spark, d):
    x = table(spark, d, "labels").withColumnRenamed("doc_id", "text")
    first = x.select("text", F.col("quality").cast("string").alias("relation"), (F.col("text") % 3).cast("string").alias("number"))
    second = x.filter("text % 3 = 0").select("text", F.col("toxic").cast("string").alias("relation"), (F.col("text") % 2).cast("string").alias("number"))
    rulings = x.filter("text % 9 = 0").select("text", F.lit("relation").alias("key"), F.lit("ruled").alias("ruling"))
    return E.adjudicate(first, second, rulings, ["relation", "number"]).select("text", "key", "first", "second", "final", "agree")


@query("f59_reading_agreement", """WITH f AS (SELECT doc_id AS text, 'relation' AS key, quality = toxic AS agree FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'number', doc_id % 3 = doc_id % 2 FROM labels WHERE doc_id % 3 = 0)
    SELECT key, count(*) AS n, count(*) FILTER (agree) AS agree FROM f GROUP BY 1""")
def f59b(spark, d):
    return E.reading_agreement(f59(spark, d))


# ---- second instrument -------------------------------------------------------------------------
PER = "per AS (SELECT l.text_id, l.norm, ok.model, count(*) AS n, bit_or(CASE WHEN source = 'quote' THEN 1 ELSE 2 END) AS bits FROM labels2 l JOIN ok USING (text_id) GROUP BY 1, 2, 3)"


@query("f11_string_stats", f"{WITH_LABELS}, {PER} SELECT norm, count(*) AS texts, sum(n)::BIGINT AS labels, count(DISTINCT model) AS models, count(*) FILTER (bits & 1 = 1) AS texts_from_quote, count(*) FILTER (bits & 2 = 2) AS texts_from_line FROM per GROUP BY 1")
def f11(spark, d):
    return T.string_stats(labels(spark, d), facts(spark, d))


@query("f11_label_totals", f"{WITH_LABELS}, {PER}, pt AS (SELECT text_id, sum(n) AS n FROM per GROUP BY 1) SELECT sum(n)::BIGINT AS labels, count(*) AS texts, floor(median(n))::BIGINT AS median, (SELECT count(DISTINCT norm) FROM per) AS strings, (SELECT count(*) FROM (SELECT norm FROM per GROUP BY 1 HAVING count(*) >= 2)) AS strings2 FROM pt")
def f11b(spark, d):
    return T.label_totals(labels(spark, d), facts(spark, d))


@query("f12_display_form", f"{WITH_LABELS}, c AS (SELECT norm, label, count(*) AS n FROM labels2 GROUP BY 1, 2) SELECT norm, arg_min(label, (-n, label)) AS as_written, max(n) AS n FROM c GROUP BY 1")
def f12(spark, d):
    return T.display_form(labels(spark, d))


@query("f13_model_strings", f"""{WITH_LABELS}, {PER} SELECT model, texts, coalesce(texts_with_label, 0) AS texts_with_label, coalesce(labels, 0) AS labels, coalesce(strings, 0) AS strings, round(coalesce(labels, 0) / texts, 1) AS labels_per_text
    FROM (SELECT model, count(*) AS texts FROM ok GROUP BY 1) LEFT JOIN (SELECT model, count(DISTINCT text_id) AS texts_with_label, sum(n)::BIGINT AS labels, count(DISTINCT norm) AS strings FROM per GROUP BY 1) USING (model)""")
def f13(spark, d):
    return T.model_strings(labels(spark, d), facts(spark, d))


@query("f13_g9_top_strings", f"{WITH_LABELS}, {PER}, c AS (SELECT model, norm, count(*) AS texts FROM per GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY texts DESC, norm) AS rank FROM c) WHERE rank <= 20")
def f13b(spark, d):
    return T.top_strings(labels(spark, d), facts(spark, d), 20)


SET_A, SET_B = ("ands", "thens", "heres", "ares"), ("thes", "tions", "things", "eres")


@query("f20_set_share", f"""{WITH_LABELS}, fl AS (SELECT text_id, max(CASE WHEN norm IN {SET_A} THEN 1 ELSE 0 END) AS a, max(CASE WHEN norm IN {SET_B} THEN 1 ELSE 0 END) AS b FROM labels2 GROUP BY 1)
    SELECT model, count(*) AS texts, count(*) FILTER (a = 1) AS n_a, count(*) FILTER (b = 1) AS n_b, count(*) FILTER (a = 1 AND b = 1) AS n_both, round(100.0 * n_a / texts, 1) AS a_pct, round(100.0 * n_b / texts, 1) AS b_pct FROM ok LEFT JOIN fl USING (text_id) GROUP BY 1""")
def f20(spark, d):
    return T.set_share(labels(spark, d), facts(spark, d), SET_A, SET_B)


@query("f20_set_share_by_word", f"""{WITH_LABELS}, fl AS (SELECT text_id, max(CASE WHEN norm IN {SET_A} THEN 1 ELSE 0 END) AS a FROM labels2 GROUP BY 1)
    SELECT model, count(*) AS texts, count(*) FILTER (a = 1) AS n_a, 0 AS n_b, 0 AS n_both, round(100.0 * n_a / texts, 1) AS a_pct, 0.0::DOUBLE AS b_pct FROM ok LEFT JOIN fl USING (text_id) GROUP BY 1""")
def f20b(spark, d):
    return T.set_share(labels(spark, d), facts(spark, d), SET_A, (), "word", words)


@query("h3_text_sets", f"""{WITH_LABELS}, a AS (SELECT DISTINCT text_id FROM labels2 WHERE source = 'quote'), b AS (SELECT DISTINCT text_id FROM labels2 WHERE source = 'line')
    SELECT 'a' AS set, (SELECT count(*) FROM a) AS n UNION ALL SELECT 'b', (SELECT count(*) FROM b) UNION ALL SELECT 'both', (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b))
    UNION ALL SELECT 'a_not_b', (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL SELECT 'neither', (SELECT count(*) FROM (SELECT text_id FROM texts EXCEPT (SELECT * FROM a UNION SELECT * FROM b)))""")
def h3(spark, d):
    l = labels(spark, d)
    return T.text_sets(texts(spark, d), l.filter("source = 'quote'"), l.filter("source = 'line'"))


@query("h4_remaining_ids", f"{WITH_LABELS} SELECT text_id FROM ok EXCEPT SELECT doc_id FROM labels")
def h4(spark, d):
    ok = facts(spark, d).filter("flag = ''").select("text_id")
    return ok.subtract(table(spark, d, "labels").select(F.col("doc_id").alias("text_id")))


@query("e10_label_scores", f"{WITH_COV}, labels3 AS (SELECT text_id, norm FROM mentions WHERE yields = 'name') SELECT l.text_id, l.norm, coalesce(n.score, 0.0) AS pattern_score, b.best AS best_anywhere FROM labels3 l LEFT JOIN names n USING (text_id, norm) LEFT JOIN (SELECT norm, max(score) AS best FROM names JOIN cov USING (text_id) WHERE flag = '' GROUP BY 1) b ON b.norm = l.norm")
def e10(spark, d):
    m, n, s = strings(spark, d)
    return T.with_pattern_score(m.filter("yields = 'name'").select("text_id", "norm"), n, s)


@query("e15_name_index", f"{WITH_LABELS} SELECT DISTINCT norm, text_id FROM labels2 WHERE norm IN (SELECT norm FROM labels2 WHERE source = 'line')")
def e15(spark, d):
    l = labels(spark, d)
    return T.name_index(l, l.filter("source = 'line'"))


_STEMS = ("thing", "reed", "other", "oner")


@query("e15_word_index", f"{WITH_LABELS} SELECT DISTINCT word, text_id FROM labels2, (VALUES " + ", ".join(f"('{w}')" for w in _STEMS) + ") v(word) WHERE norm IN (SELECT norm FROM labels2 WHERE source = 'line') AND regexp_matches(norm, '(^|[^a-z])' || word || 's?([^a-z]|$)')")
def e15b(spark, d):
    l = labels(spark, d)
    return T.word_index(T.name_index(l, l.filter("source = 'line'")), _STEMS)


@query("f57_writer_rollup", "WITH m AS (SELECT r_name || '/' || n_name AS model FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) SELECT split_part(model, '/', 1) AS lab, model, count(*) AS n FROM m GROUP BY ROLLUP (split_part(model, '/', 1), model)")
def f57(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "r_name", "n_name").alias("model"))
    return T.writer_rollup(c).drop("level")


# ---- recall of labels ----------------------------------------------------------------------------
JUDGED = "jd AS (SELECT text_id, start, CASE WHEN text_id % 2 = 0 THEN 'The ' || surface || ' x' ELSE surface END AS surface, CASE pattern_id WHEN 'the_plural' THEN 'b' WHEN 'a_word' THEN 'p' ELSE 'x' END AS verdict FROM mentions WHERE yields = 'name')"
L2 = WITH_LABELS[len("WITH "):].split(", facts AS", 1)[0].split(", labels2 AS", 1)[1]
WITH_JUDGED = f"{WITH_MENTIONS}, labels2 AS{L2}, {JUDGED}"
HELD = "(l.norm = s OR regexp_matches(l.norm, '(^|[^a-z])' || s || '([^a-z]|$)') OR regexp_matches(s, '(^|[^a-z])' || l.norm || '([^a-z]|$)'))"


def judged(spark, d):
    m = mentions(spark, d).filter("yields = 'name'")
    s = F.when(F.col("text_id") % 2 == 0, F.concat(F.lit("The "), "surface", F.lit(" x"))).otherwise(F.col("surface"))
    v = F.when(F.col("pattern_id") == "the_plural", "b").when(F.col("pattern_id") == "a_word", "p").otherwise("x")
    return m.select("text_id", "start", s.alias("surface"), v.alias("verdict"))


@query("e18_f45_verdict_recall", f"""{WITH_JUDGED}, j AS (SELECT *, regexp_replace(lower(surface), '^(the|a|an) ', '') AS s FROM jd),
    m AS (SELECT verdict, EXISTS (SELECT 1 FROM labels2 l WHERE l.text_id = j.text_id AND l.source = 'quote' AND {HELD}) AS f, EXISTS (SELECT 1 FROM labels2 l WHERE l.text_id = j.text_id AND {HELD}) AS e FROM j)
    SELECT verdict, count(*) AS n, count(*) FILTER (f) AS first, count(*) FILTER (e) AS "both" FROM m GROUP BY 1""")
def e18(spark, d):
    return E.verdict_recall(E.match_label(judged(spark, d), labels(spark, d)))


@query("e19_f47_pilot_recall", f"""{WITH_JUDGED}, j AS (SELECT text_id, CASE WHEN verdict = 'p' THEN '!' ELSE '' END || surface AS label, regexp_replace(lower(surface), '^(the|a|an|its|their) ', '') AS h FROM jd),
    m AS (SELECT label, EXISTS (SELECT 1 FROM labels2 l WHERE l.text_id = j.text_id AND (contains(l.norm, h) OR contains(h, l.norm))) AS found FROM j) SELECT count(*) AS marked, count(*) FILTER (found) AS found, count(*) FILTER (NOT found AND label LIKE '!%') AS missed_denials FROM m""")
def e19(spark, d):
    hand = judged(spark, d).select("text_id", F.concat(F.when(F.col("verdict") == "p", "!").otherwise(""), "surface").alias("label"))
    return E.pilot_recall(E.match_loose(hand, labels(spark, d)))


@query("f46_word_recall", f"""{WITH_LABELS}, w(word) AS (VALUES ('thing'), ('reed'), ('other'), ('oner')), tx AS (SELECT w.word, x.text_id FROM texts x, w WHERE list_contains(string_split_regex(lower(t), '[^a-z]+'), w.word) OR list_contains(string_split_regex(lower(t), '[^a-z]+'), w.word || 's')),
    lb AS (SELECT DISTINCT w.word, l.text_id FROM labels2 l, w WHERE l.norm IN (w.word, w.word || 's')) SELECT tx.word, count(*) AS texts, count(lb.text_id) AS in_a_label FROM tx LEFT JOIN lb ON lb.word = tx.word AND lb.text_id = tx.text_id GROUP BY 1""")
def f46(spark, d):
    return E.word_recall(texts(spark, d), labels(spark, d), ("thing", "reed", "other", "oner"))


# ---- the registry on marked texts ------------------------------------------------------------------
# The given texts hold no marks. Every capitalised word of a whole text gives a line in one of twelve forms, so that patterns
# have something to find. W stands for the word, w for it in lower case.
FORMS = (
    "# The W: the W Ones", "**W**: pale, and w.", "**W W (The W):** they wait.", "- W: sheets of w", "A worm (“W W”) turns, or simply the W W.",
    "They call it the W W. The W of W rest. **The W — the W**", "It is known to itself as “w w”, and named *w*.", "A word that means roughly *those on w*.",
    "The w-keepers and w-makers pass — the w — and w.", "Those who never left the w watch. It has no name for itself. **W W**: w", "The \"W W,\" are small. The w ones wait, named w by the w.",
    "The ws, as they are known, drift. It is not a creature but a process. The hill is alive. 1. W")


def marked_texts(spark, d):
    def line(w, i):
        out = F.lit(None)
        for n, form in enumerate(FORMS):
            out = F.when(i % len(FORMS) == n, F.replace(F.replace(F.lit(form), F.lit("W"), F.lit("\u0001")), F.lit("w"), F.lit("\u0002"))).otherwise(out)
        return F.replace(F.replace(out, F.lit("\u0001"), w), F.lit("\u0002"), F.lower(w))

    plain = F.translate("text", ACCENTED, "0" * len(ACCENTED))
    found = F.regexp_extract_all(plain, F.lit("[A-Z][a-z]{3,}"), F.lit(0))
    return texts(spark, d).select("text_id", F.array_join(F.transform(found, line), "\n").alias("text"))


def _form_sql():
    cases = " ".join("WHEN {} THEN '{}'".format(n, form.replace("'", "''").replace("W", "\u0001").replace("w", "\u0002")) for n, form in enumerate(FORMS))
    return (f"{TEXTS}, marked AS (SELECT text_id, array_to_string(list_transform(regexp_extract_all(t, '[A-Z][a-z]{{3,}}'), lambda w, i: replace(replace(CASE (i - 1) % {len(FORMS)} {cases} END, "
            "'\u0001', w), '\u0002', lower(w))), chr(10)) AS text FROM texts)")


def _plain_patterns():
    """The registry's distinct regexes that do not look around, which DuckDB's engine can run as well."""
    return [p for p in {p.regex: p for p in REGISTRY}.values() if not re.search(r"\(\?<?[=!]", p.regex)]


def _found_sql(p):
    rx = "(?{}m-s){}".format("i" if "i" in p.flags else "", p.regex) if "m" in p.flags else "(?{}-s){}".format("i" if "i" in p.flags else "", p.regex)
    rx = rx.replace("'", "''")
    if "(?P<name2>" in p.regex:
        got = f"list_transform(list_zip(regexp_extract_all(text, '{rx}', 1), regexp_extract_all(text, '{rx}', 2)), lambda z: coalesce(z[1], '') || coalesce(z[2], ''))"
    else:
        got = f"regexp_extract_all(text, '{rx}', {int('(?P<name>' in p.regex)})"
    return f"SELECT text_id, '{p.id}' AS pattern_id, {got} AS found FROM marked"


@query("d_registry_marked", f"WITH {_form_sql()} SELECT text_id, pattern_id, len(found) AS n, md5(array_to_string(found, chr(10))) AS h FROM (" + " UNION ALL ".join(_found_sql(p) for p in _plain_patterns()) + ") WHERE len(found) > 0")
def d_marked(spark, d):
    """All captures of each such pattern in the marked texts."""
    def found(p):
        spans = S.find_spans("text", tuned(p.regex), ("name", "name2") if "(?P<name" in p.regex else 0, p.flags, "lines", line_test(p))
        return F.struct(F.lit(p.id).alias("pattern_id"), F.transform(spans, lambda s: s["surface"]).alias("found"))

    # cut once, so that a pattern meets only the lines that hold what it needs
    lines = F.transform(S.lines_of("text"), lambda line: F.struct(line["at"].alias("at"), line["line"].alias("line"), plain_lower(line["line"]).alias("low")))
    rows = marked_texts(spark, d).select("text_id", "text", lines.alias("lines")).select("text_id", F.inline(F.array(*[found(p) for p in _plain_patterns()])))
    return rows.filter(F.size("found") > 0).select("text_id", "pattern_id", F.size("found").cast("long").alias("n"), F.md5(F.array_join("found", "\n")).alias("h"))
