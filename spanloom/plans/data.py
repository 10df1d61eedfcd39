"""The given tables in the shape the operators read, and the same as SQL.

``documents`` are the texts (writer = lang/source), lines of ``pages`` give headings,
orders are beings (text = customer and year, words = kinds of part ordered), and events
give intervals. Every helper has a CTE of the same name for the checking SQL.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.spans import find_spans
from spanloom.functions.text import SPECIES_WORDS
from spanloom.operators.patterns import run_patterns
from spanloom.operators.registry import Pattern
from spanloom.operators.tables import text_cov, text_facts, text_names

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    """Register a query and the SQL that must give the same rows."""
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return put


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- texts ----------------------------------------------------------------------------
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
# In the SQL, accented letters become 0: still a word character, no longer a letter a to z.
TEXTS = ("texts AS (SELECT doc_id AS text_id, lang || '/' || source AS model, lang, source AS place_id, text, "
         f"translate(text, '{ACCENTED}', '{'0' * len(ACCENTED)}') AS t FROM documents)")


def texts(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("text_id"), F.concat_ws("/", "lang", "source").alias("model"), "lang",
        F.col("source").alias("place_id"), "text")


def places(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("place_id")).agg(F.min_by("text", "doc_id").alias("text"))


PLACES = "places AS (SELECT place_id, arg_min(text, text_id) AS text FROM texts GROUP BY place_id)"


# ---- a small registry whose patterns plain SQL can run too -------------------------------
SAMPLE = [
    Pattern("the_plural", 1, 1, "frame", r"\b[Tt]he[ \t]+(?P<name>[a-z]{4,}s)\b", min_occ=2, max_df=0.15),
    Pattern("a_word", 1, 1, "frame", r"\b[Aa]n?[ \t]+(?P<name>[a-z]{5,})\b", stop="few", max_words=1),
    Pattern("after_stop", 1, 1, "capitalisation", r"[.][ ](?P<name>[A-Z][a-z]{3,})\b", reject="^Th", position="title"),
    Pattern("anti_name", 1, 1, "statement", r"\bfrom[ ]+[a-z]+or\b", yields="statement", flags="i"),
    Pattern("place_is_inhabitant", 1, 1, "statement", r"\bwhich[ ]+[a-z]+ing\b", yields="statement", flags="i"),
    Pattern("being_is_process", 1, 1, "statement", r"\bhave[ ]+the\b", yields="statement", flags="i"),
]
SAMPLE_STOP = {"few": ["oning", "onand", "ering", "thing", "other"]}
PRECISION = [("the_plural", 0.85), ("a_word", 0.55), ("after_stop", None)]


def mentions(spark, d):
    return run_patterns(texts(spark, d), SAMPLE, SAMPLE_STOP)


def precision(spark):
    return spark.createDataFrame(PRECISION, "pattern_id string, precision double")


def span_rows(pattern, before, name, after="", flags=""):
    """SQL rows (text_id, i, start, e, surface) of one pattern: gaps, matches, prefix sums."""
    rx = f"{flags}({before})({name}){after}"
    return (f"SELECT text_id, '{pattern}' AS pattern_id, i, "
            f"(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + "
            f"coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) + length(pre[i]))::BIGINT AS start, "
            f"nm[i] AS surface FROM (SELECT text_id, gaps, ms, pre, nm, unnest(range(1, len(ms) + 1)) AS i FROM ("
            f"SELECT text_id, string_split_regex(t, '{rx}') AS gaps, regexp_extract_all(t, '{rx}', 0) AS ms, "
            f"regexp_extract_all(t, '{rx}', 1) AS pre, regexp_extract_all(t, '{rx}', 2) AS nm FROM texts))")


def sentence_rows(pattern, rx):
    """SQL rows of a statement pattern: sentences (pieces between stops) that hold the phrase."""
    return (f"SELECT text_id, '{pattern}' AS pattern_id, k AS i, "
            f"(coalesce(list_sum(list_transform(p[1:k-1], lambda x: length(x) + 1)), 0) + length(p[k]) - length(ltrim(p[k], ' ' || chr(9))))::BIGINT AS start, "
            f"trim(p[k] || CASE WHEN substr(t, (coalesce(list_sum(list_transform(p[1:k], lambda x: length(x) + 1)), 0))::BIGINT, 1) IN ('.', '!', '?') "
            f"THEN substr(t, (list_sum(list_transform(p[1:k], lambda x: length(x) + 1)))::BIGINT, 1) ELSE '' END, ' ' || chr(9) || chr(10)) AS surface "
            f"FROM (SELECT text_id, t, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT text_id, t, string_split_regex(t, '[.!?\\n]') AS p FROM texts)) "
            f"WHERE regexp_matches(p[k], '{rx}')")


WORDS = ("occ AS (SELECT text_id, w, count(*) AS n FROM (SELECT text_id, unnest(string_split_regex(lower(t), '[^a-z]+')) AS w FROM texts) WHERE w <> '' GROUP BY 1, 2), "
         "cased AS (SELECT text_id, w, count(*) AS n FROM (SELECT text_id, unnest(string_split_regex(t, '[^A-Za-z]+')) AS w FROM texts) WHERE w <> '' GROUP BY 1, 2), "
         "freq AS (SELECT w AS word, count(*) AS n_texts, round(count(*) / (SELECT count(*) FROM documents), 5) AS df FROM "
         "(SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''’-]*'))) AS w FROM documents) GROUP BY 1 HAVING count(*) >= 3)")
MENTIONS = (
    "raw AS (" + " UNION ALL ".join([
        span_rows("the_plural", r"\b[Tt]he[ \t]+", "[a-z]{4,}s", r"\b"), span_rows("a_word", r"\b[Aa]n?[ \t]+", "[a-z]{5,}", r"\b"),
        span_rows("after_stop", "[.][ ]", "[A-Z][a-z]{3,}", r"\b")]) + "), "
    "said AS (" + " UNION ALL ".join([
        sentence_rows("anti_name", r"(?i)\bfrom[ ]+[a-z]+or\b"), sentence_rows("place_is_inhabitant", r"(?i)\bwhich[ ]+[a-z]+ing\b"),
        sentence_rows("being_is_process", r"(?i)\bhave[ ]+the\b")]) + "), "
    "mentions AS (SELECT r.text_id, r.pattern_id, 'name' AS yields, r.start, r.start + length(r.surface) AS e, r.surface, lower(r.surface) AS norm, o.n AS occ, c.n AS occ_cased "
    "FROM raw r JOIN occ o ON o.text_id = r.text_id AND o.w = lower(r.surface) LEFT JOIN cased c ON c.text_id = r.text_id AND c.w = r.surface "
    "LEFT JOIN freq f ON f.word = lower(r.surface) WHERE CASE r.pattern_id WHEN 'the_plural' THEN o.n >= 2 AND coalesce(f.df, 0) <= 0.15 "
    "WHEN 'a_word' THEN r.surface NOT IN ('oning', 'onand', 'ering', 'thing', 'other') ELSE NOT regexp_matches(r.surface, '^Th') END "
    "UNION ALL SELECT text_id, pattern_id, 'statement', start, NULL, surface, '', NULL, NULL FROM said)")
WITH_MENTIONS = f"WITH {TEXTS}, {WORDS}, {MENTIONS}"


def status(spark, d):
    return table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("text_id"), F.lit("broken").alias("status"))


def facts(spark, d):
    return text_facts(texts(spark, d), status(spark, d))


FUNCTION_LIST = ("['the','of','and','a','to','in','is','it','that','are','as','with','for','its','not','they','their','but',"
                 "'by','from','this','or','on','at','be','an','which','have','has','was']")
SPECIES = "[" + ",".join("'%s'" % w for w in SPECIES_WORDS) + "]"
FACTS = ("facts AS (SELECT x.text_id, x.model, x.place_id, length(x.text) AS length, coalesce(s.status, '') AS tagged, "
         "CASE WHEN s.status IS NOT NULL THEN s.status WHEN length(trim(x.text, ' ' || chr(9) || chr(10) || chr(13))) < 50 OR len(tok) = 0 THEN 'empty' "
         f"WHEN len(list_filter(tok, lambda w: list_contains({FUNCTION_LIST}, lower(w)))) / len(tok) < 0.15 THEN 'not prose (word check)' ELSE '' END AS flag, "
         f"len(list_intersect(list_distinct(regexp_extract_all(lower(x.text), '[a-z]+')), {SPECIES})) AS n_species, "
         "len(regexp_extract_all(x.text, '\\b\\d(?:\\.\\d)?\\s*(?:/\\s*3|out\\s+of\\s+3)\\b')) AS n_param_echo "
         "FROM (SELECT *, regexp_extract_all(text, '[A-Za-z'']+') AS tok FROM texts) x "
         "LEFT JOIN (SELECT doc_id AS text_id, 'broken' AS status FROM labels WHERE toxic = 1) s ON s.text_id = x.text_id)")


def names(spark, d):
    return text_names(mentions(spark, d), precision(spark), places(spark, d), texts(spark, d))


NAMES = (
    "prec(pattern_id, p) AS (VALUES ('the_plural', 0.85), ('a_word', 0.55), ('after_stop', NULL)), "
    "forms AS (SELECT text_id, norm, surface, count(*) AS n, min(start) AS start, max(occ_cased) AS cased, "
    "count(DISTINCT CASE WHEN pattern_id = 'after_stop' THEN start END) AS titles FROM mentions WHERE yields = 'name' GROUP BY 1, 2, 3), "
    "shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_id, norm ORDER BY n DESC, start, surface) AS rn FROM forms) WHERE rn = 1), "
    "grp AS (SELECT m.text_id, m.norm, count(*) AS n_mentions, array_to_string(list_sort(list_distinct(list(m.pattern_id))), ',') AS patterns, "
    "max(coalesce(p.p, 0.0))::DOUBLE AS score, min(m.start) AS first_pos, max(m.occ) AS occurrences, "
    "count(DISTINCT CASE WHEN m.pattern_id = 'after_stop' THEN m.start END) AS in_title "
    "FROM mentions m LEFT JOIN prec p ON p.pattern_id = m.pattern_id WHERE m.yields = 'name' GROUP BY 1, 2), "
    "names AS (SELECT g.*, s.surface AS display, greatest(0, g.occurrences - g.in_title) AS body_occ, greatest(0, s.cased - s.titles) AS body_cased, "
    "CASE WHEN contains(lower(pl.text), g.norm) THEN 1 ELSE 0 END AS in_place_text "
    "FROM grp g JOIN shown s ON s.text_id = g.text_id AND s.norm = g.norm JOIN texts x ON x.text_id = g.text_id JOIN places pl ON pl.place_id = x.place_id)")
WITH_NAMES = f"{WITH_MENTIONS}, {PLACES}, {NAMES}"


def cov(spark, d):
    m = mentions(spark, d)
    m = m.persist()  # read by several aggregates
    return text_cov(facts(spark, d), m, text_names(m, precision(spark), places(spark, d), texts(spark, d)))


COV = (
    "hits AS (SELECT text_id, count(*) FILTER (yields = 'name') AS n_hits, count(*) FILTER (yields = 'statement') AS n_statements, "
    "count(*) FILTER (pattern_id = 'anti_name') AS n_anti, count(*) FILTER (pattern_id = 'place_is_inhabitant') AS n_place_self, "
    "count(*) FILTER (pattern_id = 'being_is_process') AS n_process FROM mentions GROUP BY 1), "
    "per AS (SELECT text_id, count(*) AS n_names, max(score) AS best, round(sum(score), 3) AS expected, "
    "max(score) FILTER (NOT (in_title > 0 AND body_occ = 0)) AS best_body, max(score) FILTER (in_title > 0 AND body_occ = 0) AS best_title_only, "
    "count(*) FILTER (score >= 0.8 AND NOT (in_title > 0 AND body_occ = 0)) AS n_names_80 FROM names GROUP BY 1), "
    "cov0 AS (SELECT f.*, coalesce(h.n_hits, 0) AS n_hits, coalesce(h.n_statements, 0) AS n_statements, coalesce(h.n_anti, 0) AS n_anti, "
    "coalesce(h.n_place_self, 0) AS n_place_self, coalesce(h.n_process, 0) AS n_process, coalesce(p.n_names, 0) AS n_names, coalesce(p.best, 0.0) AS best, "
    "coalesce(p.expected, 0.0) AS expected, coalesce(p.best_body, 0.0) AS best_body, coalesce(p.best_title_only, 0.0) AS best_title_only, coalesce(p.n_names_80, 0) AS n_names_80 "
    "FROM facts f LEFT JOIN hits h USING (text_id) LEFT JOIN per p USING (text_id)), "
    "cov AS (SELECT *, CASE WHEN flag <> '' THEN 'flagged' WHEN n_names_80 >= 3 THEN 'catalogue' WHEN n_names_80 >= 1 THEN 'named' WHEN n_place_self > 0 THEN 'place itself' "
    "WHEN n_process > 0 THEN 'a process' WHEN n_anti > 0 THEN 'unnamed, said so' WHEN n_species >= 4 THEN 'ordinary biology' ELSE 'undetermined' END AS kind FROM cov0)")
WITH_COV = f"{WITH_NAMES}, {FACTS}, {COV}"


# ---- labels of the second instrument ---------------------------------------------------------
def labels(spark, d):
    x = texts(spark, d)
    quote = x.select("text_id", F.inline(find_spans("text", r"\b[Tt]he[ \t]+(?P<name>[a-z]{3,}s)\b", "name"))).withColumn("source", F.lit("quote"))
    line = x.select("text_id", F.inline(find_spans("text", r"\b[Aa]n?[ \t]+(?P<name>[A-Za-z]{4,})\b", "name"))).withColumn("source", F.lit("line"))
    both = quote.unionByName(line)
    return both.select("text_id", "start", "end", F.col("surface").alias("label"), F.lower("surface").alias("norm"), "source")


LABELS = ("labels2 AS (SELECT text_id, start, start + length(surface) AS e, surface AS label, lower(surface) AS norm, pattern_id AS source FROM ("
          + span_rows("quote", r"\b[Tt]he[ \t]+", "[a-z]{3,}s", r"\b") + " UNION ALL " + span_rows("line", r"\b[Aa]n?[ \t]+", "[A-Za-z]{4,}", r"\b") + "))")
OK_TEXTS = "ok AS (SELECT text_id, model FROM facts WHERE flag = '')"
WITH_LABELS = f"WITH {TEXTS}, {LABELS}, {FACTS}, {OK_TEXTS}"


# ---- pages as Markdown-like text --------------------------------------------------------------
def page_texts(spark, d):
    html = F.regexp_replace("html", r"(?s)^.*?<article>", "")
    html = F.regexp_replace(html, r"(?s)</article>.*$", "")
    md = F.regexp_replace(F.regexp_replace(html, r"<h1>", "\n# "), r"</h1>|</p>|<p>|<br>", "\n")
    return table(spark, d, "pages").select(F.col("page_id").alias("text_id"), F.regexp_replace(
        F.regexp_replace(md, r"</?b>", "**"), r"<[^>]*>", "").alias("text"))


PAGE_TEXTS = ("pt AS (SELECT page_id AS text_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace("
              "regexp_replace(regexp_replace(html, '(?s)^.*?<article>', ''), '(?s)</article>.*$', ''), '<h1>', chr(10) || '# ', 'g'), "
              "'</h1>|</p>|<p>|<br>', chr(10), 'g'), '</?b>', '**', 'g'), '<[^>]*>', '', 'g') AS text FROM pages)")


# ---- intervals ----------------------------------------------------------------------------------
def intervals(spark, d):
    """Half an hour per event in seconds since 2024, with the event's type."""
    sec = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", sec.alias("start"), (sec + 1800).alias("end"))


INTERVALS = ("iv AS (SELECT event_id, user_id, event_type, date_diff('second', TIMESTAMP '2024-01-01', ts) AS start, "
             "date_diff('second', TIMESTAMP '2024-01-01', ts) + 1800 AS e FROM events)")


# ---- beings --------------------------------------------------------------------------------------
STEMS = ("economy", "large", "medium", "promo", "small", "standard")


def beings(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("w"))
    words = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("w")).alias("words"))
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    writer = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.concat_ws("/", "r_name", "n_name").alias("model"))
    o = table(spark, d, "orders").join(writer, "o_custkey").join(words, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text_id = F.col("o_custkey") * 100 + F.year("o_orderdate") - 1990
    none = F.array().cast("array<string>")
    w = F.coalesce("words", none)
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), text_id.alias("text_id"), "model", F.lower("o_orderpriority").alias("called"),
        F.transform(w, lambda x: F.concat(x, F.lit("-keeper"))).alias("names"), w.alias("words"),
        (k % 4).cast("int").alias("n_role"), (k % 3).cast("int").alias("n_relation"),
        F.when(F.col("o_orderstatus") == "F", (k % 3 + 1).cast("int")).otherwise(0).alias("n_cost"),
        F.when(F.col("o_orderpriority") < "3", 1).otherwise(0).alias("n_origin"),
        (F.floor("o_totalprice") % 3).cast("int").alias("n_fate"), (text_id % 50 + 20).cast("int").alias("n_sentences"))


BEINGS = (
    "ow AS (SELECT l_orderkey, list_sort(list(DISTINCT lower(p_type))) AS words FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), "
    "beings AS (SELECT o_orderkey AS id, o_custkey * 100 + year(o_orderdate) - 1990 AS text_id, r_name || '/' || n_name AS model, lower(o_orderpriority) AS called, "
    "coalesce(words, []::VARCHAR[]) AS words, o_orderkey % 4 AS n_role, o_orderkey % 3 AS n_relation, "
    "CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 3 + 1 ELSE 0 END AS n_cost, CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END AS n_origin, "
    "floor(o_totalprice)::BIGINT % 3 AS n_fate, (o_custkey * 100 + year(o_orderdate) - 1990) % 50 + 20 AS n_sentences "
    "FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN ow ON l_orderkey = o_orderkey)")
WITH_BEINGS = f"WITH {BEINGS}"


def care_texts(spark, d):
    b = beings(spark, d)
    return b.groupBy("text_id").agg(F.min("model").alias("model"), F.min("n_sentences").alias("n_sentences"),
                                    F.count(F.lit(1)).cast("int").alias("n_beings"))


CARE = "care AS (SELECT text_id, min(model) AS model, min(n_sentences) AS n_sentences, count(*) AS n_beings FROM beings GROUP BY 1)"


def dates(spark, d):
    """A release date per writer; one writer has none, one has an impossible one."""
    n = F.col("n_nationkey")
    date = F.when(n == 24, None).when(n == 23, F.lit("1970-01-01")).otherwise(
        F.format_string("%d-%02d-15", 2023 + n % 4, 1 + (n * 5) % 12))
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat_ws("/", "r_name", "n_name").alias("model"), date.alias("date"))


DATES = ("dates AS (SELECT r_name || '/' || n_name AS model, CASE WHEN n_nationkey = 24 THEN NULL WHEN n_nationkey = 23 THEN '1970-01-01' ELSE "
         "(2023 + n_nationkey % 4) || '-' || lpad((1 + (n_nationkey * 5) % 12)::VARCHAR, 2, '0') || '-15' END AS date FROM nation JOIN region ON r_regionkey = n_regionkey)")
ERA = ("CASE WHEN date IS NULL OR date < '2020' THEN NULL WHEN date < '2025' THEN '2024 and before' WHEN date < '2025-07' THEN 'first half of 2025' "
       "WHEN date < '2026' THEN 'second half of 2025' ELSE '2026' END")


def sentences_of(spark, d):
    """Listed sentences: question q of being b lists n_q numbers from id modulo 7."""
    b = beings(spark, d)

    def numbers(q, j):
        n = F.col("n_" + q)
        listed = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(
            F.lit(q).alias("question"), (i + F.col("id") % 7 + j).cast("int").alias("no")))
        return F.filter(listed, lambda _: n > 0)

    both = F.flatten(F.array(*[numbers(q, j) for j, q in enumerate(("role", "relation", "cost", "origin", "fate"))]))
    return b.select(F.col("id").alias("being_id"), "text_id", F.inline(both))


SENTS = ("sents AS (" + " UNION ALL ".join(
    f"SELECT id AS being_id, text_id, '{q}' AS question, unnest(range(1, n_{q} + 1)) + id % 7 + {j} AS no FROM beings WHERE n_{q} > 0"
    for j, q in enumerate(("role", "relation", "cost", "origin", "fate"))) + ")")
ARR = ("arr AS (SELECT text_id, min(model) AS model, CASE WHEN count(*) > 1 THEN 'ensemble' WHEN max(len(words)) > 1 THEN 'stacked' ELSE 'solo' END AS arrangement "
       "FROM beings WHERE len(words) > 0 GROUP BY 1)")


def being_rows(spark, d):
    from spanloom.operators.beings import being_facts
    b = beings(spark, d).drop("n_sentences")
    return being_facts(b, sentences_of(spark, d), care_texts(spark, d), dates(spark, d))


FACT_ROWS = (
    f"{CARE}, {SENTS}, {ARR}, {DATES}, lst AS (SELECT being_id, count(DISTINCT no) AS n_listed FROM sents GROUP BY 1), "
    f"fr AS (SELECT b.* EXCLUDE (n_sentences), c.n_sentences, CASE WHEN len(b.words) > 0 THEN a.arrangement END AS arrangement, coalesce(l.n_listed, 0) AS n_listed, "
    f"dt.date AS released, {ERA} AS era, round(coalesce(l.n_listed, 0) / c.n_sentences, 3) AS focus FROM beings b JOIN care c USING (text_id) LEFT JOIN arr a USING (text_id) "
    f"LEFT JOIN lst l ON l.being_id = b.id LEFT JOIN dates dt ON dt.model = b.model)")
WITH_FACTS = f"WITH {BEINGS}, {FACT_ROWS}"


def kept(spark, d):
    """What a being is for and against: kinds of part it holds, by return flag."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(part, "l_partkey")
    got = rows.groupBy(F.col("l_orderkey").alias("being_id")).agg(
        F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("noun")))).alias("for"),
        F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("noun")))).alias("against"))
    return got.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("being_id")), "being_id", "left_semi")


KEPT = ("kl AS (SELECT DISTINCT l_orderkey AS id, split_part(p_name, ' ', 2) AS noun, CASE l_returnflag WHEN 'N' THEN 'for' WHEN 'R' THEN 'against' ELSE '' END AS side "
        "FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders)), "
        "kf AS (SELECT b.*, kl.noun FROM kl JOIN fr b ON b.id = kl.id WHERE side = 'for'), ka AS (SELECT b.*, kl.noun FROM kl JOIN fr b ON b.id = kl.id WHERE side = 'against')")
WITH_KEPT = f"{WITH_FACTS}, {KEPT}"
