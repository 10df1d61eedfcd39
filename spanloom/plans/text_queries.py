"""Queries over scans, predicates, text functions and span functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import filters, spans as S, text as T
from spanloom.operators import grounding
from spanloom.operators.beings import fold_plural, lexicon_labels, term_counts
from spanloom.operators.patterns import doc_freq
from spanloom.operators.answers import person_candidates, split_answers
from spanloom.operators.sampling import latest_answers, latest_status
from spanloom.plans.data import (ACCENTED, FACTS, LABELS, PAGE_TEXTS, TEXTS, WITH_BEINGS, WORDS, beings, facts, labels, page_texts, places,
                                 query, sentence_rows, span_rows, table, texts)
from spanloom.session import scratch
from spanloom.sources import corpus, export

EDGE_SQL = "' ' || chr(9) || chr(13) || chr(10) || '*_\"''`“”‘’:;,.—–-()[]'"
SPACE_SQL = "' ' || chr(9) || chr(10) || chr(13)"


def clean_sql(x):
    s = f"trim(regexp_replace(translate({x}, '’‘', ''''''), '\\s+', ' ', 'g'), {EDGE_SQL})"
    s = f"trim(regexp_replace({s}, '^(?i:the|a|an)\\s+', ''), {EDGE_SQL})"
    return f"regexp_replace({s}, '''s$', '')"


def fold_sql(x):
    return (f"lower(regexp_replace(translate(replace(translate({x}, '‘’“”—–‑', '''''\"\"---'), '…', '...'), '*_`', ''), '\\s+', ' ', 'g'))")


# ---- A: scans ---------------------------------------------------------------------------
@query("a1_load_corpus", f"WITH {TEXTS} SELECT place_id, length(arg_min(text, text_id)) AS place_chars FROM texts GROUP BY place_id")
def a1(spark, d):
    kept = corpus.places_with_text(places(spark, d), texts(spark, d))
    return kept.select("place_id", F.length("text").alias("place_chars"))


@query("a3_json_records", """SELECT event_id, CASE WHEN event_id % 9 <> 0 AND event_id % 11 <> 0 THEN coalesce(json_extract_string(props, '$.k')::INT, 0) END AS k,
    CASE WHEN event_id % 9 <> 0 AND event_id % 11 <> 0 THEN coalesce(json_extract_string(props, '$.pool'), 'covered') END AS pool,
    CASE WHEN event_id % 9 = 0 THEN left(props, length(props) - 1) WHEN event_id % 11 = 0 THEN '{"k": "x"}' END AS corrupt FROM events WHERE event_id % 9 = 0 OR event_id % 11 = 0 OR event_id % 13 <> 0""")
def a3(spark, d):
    """Every ninth line is broken, every eleventh has a value of another type, every thirteenth is blank."""
    n = F.col("event_id")
    line = F.when(n % 9 == 0, F.expr("left(props, length(props) - 1)")).when(n % 11 == 0, '{"k": "x"}').when(n % 13 == 0, " ").otherwise(F.col("props"))
    rec = corpus.parse_records(table(spark, d, "events").select("event_id", line.alias("line")), "line", "k int, pool string", {"k": 0, "pool": "covered"})
    return rec.select("event_id", "k", "pool", F.col("_corrupt_record").alias("corrupt"))


@query("a4_latest_answers", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'assistant') DESC, turn DESC) AS rn FROM conversations) WHERE rn = 1")
def a4(spark, d):
    return latest_answers(table(spark, d, "conversations"), "conv_id", F.col("role") == "assistant", "turn").select("conv_id", "turn", "role", "text")


@query("a6_spans_per_text", f"WITH {TEXTS}, {LABELS} SELECT text_id, string_agg(start || '-' || e, ',' ORDER BY start, e) AS spans FROM labels2 GROUP BY text_id")
def a6(spark, d):
    rows = export.spans_by_text(labels(spark, d))
    return rows.select("text_id", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


@query("a7_serving_buckets", f"WITH {TEXTS}, {LABELS} SELECT substr(sha1(norm), 1, 2) AS b, floor(text_id / 100)::BIGINT::VARCHAR AS t, count(*) AS n FROM labels2 GROUP BY 1, 2")
def a7(spark, d):
    return labels(spark, d).groupBy(export.bucket("norm", "sha1").alias("b"), export.bucket("text_id", "div100").alias("t")).agg(F.count(F.lit(1)).alias("n"))


@query("a7_serving_store", f"WITH {TEXTS}, {LABELS}, b AS (SELECT floor(text_id / 100)::BIGINT::VARCHAR AS b, count(*) AS n FROM labels2 GROUP BY 1) SELECT b, n, CASE WHEN b = '1' THEN n ELSE 0 END AS found FROM b")
def a7_store(spark, d):
    """The labels written as a store, read back: rows of each bucket by the index, and of one bucket from its files."""
    root = scratch(spark, "store")
    rows = labels(spark, d)
    index = export.write_store(rows, root, "text_id", "div100", rows=1000)
    one = export.read_bucket(spark, root, "1", rows.withColumn("b", F.lit("")).schema)
    found = one.groupBy("b").agg(F.count(F.lit(1)).alias("found"))
    return index.groupBy("b").agg(F.sum("n").alias("n")).join(found, "b", "left").select("b", "n", F.coalesce("found", F.lit(0)).alias("found"))


# ---- A: what is written and read back ------------------------------------------------------
@query("a2_refuse_unfinalised", """SELECT 'texts' AS name, true AS refused, count(*) AS n FROM documents UNION ALL SELECT 'places', true, count(DISTINCT coalesce(source, '')) FROM documents WHERE source IS NOT NULL""")
def a2(spark, d):
    """A snapshot of the documents without its marker is refused; with it, it loads."""
    root, x = scratch(spark, "snapshot"), texts(spark, d)
    key = F.xxhash64("place_id")
    x.select("text_id", key.alias("place_id"), "model", "text", F.lit("d").alias("created_at"), F.lit(0).alias("regen_count"), F.lit(1).alias("seq"), F.lit("ok").alias("corpus_state")).write.parquet(root + "/texts.parquet")
    places(spark, d).filter("place_id is not null").select(key.alias("place_id"), F.lit(1).cast("long").alias("seed_id"), F.lit("m").alias("model"), "text", F.lit("d").alias("created_at")).write.parquet(root + "/places.parquet")
    x.select("text_id", F.lit("t").alias("tagger"), F.lit("ok").alias("status"), F.lit("d").alias("tagged_at"), F.lit(1).cast("long").alias("seq")).write.parquet(root + "/status.parquet")
    x.groupBy(F.lit("n").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value")).write.parquet(root + "/release.parquet")
    try:
        corpus.load_corpus(spark, root)
        refused = False
    except ValueError:
        refused = True
    spark.createDataFrame([("done",)], "value string").write.text(root + "/FINALIZED")
    c = corpus.load_corpus(spark, root)
    return c.texts.agg(F.lit("texts").alias("name"), F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n")).unionByName(
        c.places.agg(F.lit("places").alias("name"), F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n")))


@query("a5_csv_export", f"""WITH {TEXTS}, {LABELS} SELECT 'labels' AS "table", md5(coalesce(label, '')) AS h, count(*) AS n, sum(start)::BIGINT AS total, 6 AS commented FROM labels2 GROUP BY label
    UNION ALL SELECT 'models', md5(model), count(*), sum(length(text))::BIGINT, 3 FROM texts GROUP BY model""")
def a5(spark, d):
    """Two tables written as CSV, one of them gzipped, with their data dictionary; all read back."""
    root = scratch(spark, "csv")
    per = texts(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("characters"))
    rows = labels(spark, d).select("text_id", "start", "end", "label", F.col("norm").alias("string"), "source")
    export.export_tables({"labels": rows, "models": per}, root, comments={("models", "characters"): "characters written"})
    read = lambda name: spark.read.option("header", True).csv(f"{root}/{name}")
    commented = {t: read("dictionary").filter((F.col("table") == t) & F.col("comment").isNotNull()) for t in ("labels", "models")}
    n = {t: c.agg(F.count(F.lit(1)).cast("int").alias("commented")) for t, c in commented.items()}
    back = read("labels").groupBy(F.lit("labels").alias("table"), F.md5(F.coalesce("label", F.lit(""))).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("start").cast("long")).alias("total"))
    models = read("models").select(F.lit("models").alias("table"), F.md5("model").alias("h"), F.col("texts").cast("long").alias("n"), F.col("characters").cast("long").alias("total"))
    return back.crossJoin(n["labels"]).unionByName(models.crossJoin(n["models"]))


_PER_WRITER = "SELECT concat_ws('/', lang, source) AS model, {} AS v, count(*) AS n FROM documents {} GROUP BY 1"


@query("a8_versions", f"{_PER_WRITER.format("'v2'", '')} UNION ALL {_PER_WRITER.format("'v1'", 'WHERE n_chars > 1000')}")
def a8(spark, d):
    """A table in two versions: the pointer names the later one, a version that exists is refused, the earlier one stays readable."""
    root = scratch(spark, "versions")
    docs = table(spark, d, "documents")
    count = lambda x: x.groupBy(F.concat_ws("/", "lang", "source").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    first = export.overwrite(count(docs.filter("n_chars > 1000")), root, "v1")
    export.overwrite(count(docs), root, "v2")
    try:
        export.overwrite(count(docs.limit(0)), root, "v2")
        raise AssertionError("a version was written over")
    except Exception as e:
        if "already exists" not in str(e):
            raise
    now = export.current(spark, root)
    name = lambda at: F.lit(at.rsplit("/", 1)[1]).alias("v")
    return spark.read.parquet(now).select("model", name(now), "n").unionByName(spark.read.parquet(first).select("model", name(first), "n"))


@query("a11_write_if_changed", "SELECT step, wrote, (SELECT count(*) FROM documents WHERE step < 3 OR n_chars > 1000) AS n FROM (VALUES (1, true), (2, false), (3, true), (4, false)) t(step, wrote)")
def a11(spark, d):
    """The documents written under their content's digest: again, nothing is written; of other content, a new version is."""
    root, out = scratch(spark, "digest"), None
    x = texts(spark, d).select("text_id", "text", F.length("text").alias("n"))
    long_ = table(spark, d, "documents").filter("n_chars > 1000").select(F.col("doc_id").alias("text_id"), "text", F.length("text").alias("n"))
    for step, df in enumerate((x, x, long_, long_), 1):
        wrote = export.write_if_changed(df, root, corpus.content_digest(df.select("text_id", "text")).first().digest)
        row = spark.read.parquet(export.current(spark, root)).agg(F.lit(step).alias("step"), F.lit(wrote).alias("wrote"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


WORD_SUMS = ", ".join(f"lpad(lower(printf('%x', (sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT) % 4294967296)::BIGINT)), 8, '0')" for i in range(8))


@query("a9_f2_content_digest", f"WITH r AS (SELECT sha256(doc_id || chr(0) || text || chr(0)) AS h FROM documents) SELECT count(*) AS n, concat({WORD_SUMS}) AS digest FROM r")
def f2(spark, d):
    return corpus.content_digest(texts(spark, d))


@query("a10_round_history", "SELECT CASE WHEN year(o_orderdate) = 1998 THEN 'again' ELSE 'first' END AS note, year(o_orderdate) - 1994 AS round, "
       "count(*) * CASE WHEN year(o_orderdate) = 1998 THEN 2 ELSE 1 END AS n FROM orders GROUP BY 1, 2, year(o_orderdate)")
def a10(spark, d):
    per = table(spark, d, "orders").groupBy((F.year("o_orderdate") - 1994).alias("round")).agg(F.count(F.lit(1)).alias("n"))
    history = per.select("round", F.lit("d").alias("date"), F.lit("first").alias("note"), F.create_map(F.lit("n"), "n").alias("stats"))
    stats = per.filter("round = 4").select(F.create_map(F.lit("n"), F.col("n") * 2).alias("stats"))
    return corpus.upsert_round(history, 4, "d", "again", stats).select("round", "note", F.element_at("stats", "n").alias("n"))


# ---- B: predicates -------------------------------------------------------------------------
@query("b1_text_flag", f"WITH {TEXTS}, {FACTS} SELECT text_id, tagged, flag, n_species, n_param_echo FROM facts")
def b1(spark, d):
    return facts(spark, d).select("text_id", "tagged", "flag", "n_species", "n_param_echo")


@query("b2_stoplist", f"WITH {TEXTS}, {LABELS} SELECT norm, count(*) AS n FROM labels2 WHERE norm NOT IN ('thes', 'thens', 'eres', 'ines', 'reas') GROUP BY 1")
def b2(spark, d):
    stop = spark.createDataFrame([("few", w) for w in ("thes", "thens", "eres", "ines", "reas")] + [("none", "ands")], "name string, word string")
    return filters.not_in_stoplist(labels(spark, d), stop, "few").groupBy("norm").agg(F.count(F.lit(1)).alias("n"))


@query("b3_b4_b5_capture_checks", f"""WITH {TEXTS}, c AS (SELECT text_id, unnest(regexp_extract_all(t, '[A-Z][A-Za-z]*(?: [A-Za-z]+)*')) AS s FROM texts)
    SELECT count(*) AS n, count(*) FILTER (NOT regexp_matches(s, '[A-Z]{{2,}}|^[A-Za-z]$')) AS not_rejected, count(*) FILTER (len(string_split(lower(s), ' ')) <= 3) AS short,
    count(*) FILTER (regexp_matches(lower(s), '[a-z]')) AS lettered, text_id FROM c GROUP BY text_id""")
def b345(spark, d):
    from spanloom.operators.registry import REJECT_CAPS
    x = texts(spark, d).select("text_id", F.explode(F.transform(S.find_spans("text", "[A-Z][A-Za-z]*(?: [A-Za-z]+)*"), lambda s: s["surface"])).alias("s"))
    low = F.lower("s")
    return x.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("s").rlike(REJECT_CAPS)).alias("not_rejected"),
                                    F.count_if(F.size(F.split(low, " ")) <= 3).alias("short"), F.count_if(low.rlike("[a-z]")).alias("lettered"))


@query("b9_lexicon_labels", f"WITH {TEXTS}, {LABELS} SELECT text_id, norm, label FROM (SELECT *, row_number() OVER (PARTITION BY text_id, norm ORDER BY start, e, label) AS rn FROM labels2 "
       "WHERE regexp_matches(norm, '(^|[^a-z])(thing|reed|other|oner)s?([^a-z]|$)')) WHERE rn = 1")
def b9(spark, d):
    return lexicon_labels(labels(spark, d), ("thing", "reed", "other", "oner")).select("text_id", "norm", "label")


@query("b10_not_bare", f"WITH {TEXTS}, {LABELS} SELECT DISTINCT norm FROM labels2 WHERE NOT regexp_matches(norm, '^(thing|reed|other|oner)s?$')")
def b10(spark, d):
    return labels(spark, d).select("norm").distinct().filter(~T.is_bare("norm", ("thing", "reed", "other", "oner")))


@query("b11_length_band", f"{WITH_BEINGS} SELECT id, n_sentences FROM beings WHERE n_sentences BETWEEN 30 AND 60")
def b11(spark, d):
    return filters.band(beings(spark, d), "n_sentences", 30, 60).select("id", F.col("n_sentences").cast("long").alias("n_sentences"))


@query("b12_person_candidates", """SELECT conv_id AS being_id, count(*) AS n_sentences, count(*) FILTER (regexp_matches(text, ' le ')) AS n_first, count(*) FILTER (regexp_matches(text, ' the ')) AS n_you
    FROM conversations GROUP BY 1 HAVING n_first > 0 OR n_you >= greatest(2.0, n_sentences / 2)""")
def b12(spark, d):
    counts = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("being_id")).agg(
        F.count(F.lit(1)).alias("n_sentences"), F.count_if(F.col("text").contains(" le ")).alias("n_first"), F.count_if(F.col("text").contains(" the ")).alias("n_you"))
    return person_candidates(counts)


@query("b13_facet", f"{WITH_BEINGS} SELECT id, model FROM beings WHERE split_part(model, '/', 1) = 'ASIA' AND list_contains(words, 'promo') AND list_contains(words, 'large')")
def b13(spark, d):
    b = beings(spark, d).withColumn("nouns", F.col("words"))
    return filters.facet(b, writer="ASIA/*", word="promo", noun="large").select("id", "model")


@query("b14_column_filter", "SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer WHERE c_acctbal BETWEEN 100 AND 5000 AND c_nationkey >= 7 AND NOT contains(lower(c_mktsegment), 'build') AND contains(lower(c_name), '#0')")
def b14(spark, d):
    return filters.column_filter(table(spark, d, "customer"), {"c_acctbal": "100..5000", "c_nationkey": ">=7", "c_mktsegment": "!BUILD", "c_name": "#0"}).select(
        "c_custkey", "c_name", "c_acctbal", "c_nationkey")


TERM, NEGATED = r"\b(thing|things|other|others)\b", r"\b(not|no|for|of)\W{0,3}(\w+\W+){0,3}(thing|other)"


@query("b15_f43_negated_terms", f"""WITH {TEXTS}, s AS (SELECT text_id, unnest(string_split(t, chr(10))) AS line FROM texts),
    h AS (SELECT text_id, max(CASE WHEN regexp_matches(line, '(?i)\\b(thing|things|other|others)\\b') THEN 1 ELSE 0 END) AS a,
    max(CASE WHEN regexp_matches(line, '(?i)\\b(thing|things|other|others)\\b') AND regexp_matches(line, '(?i)\\b(not|no|for|of)\\W{{0,3}}(\\w+\\W+){{0,3}}(thing|other)') THEN 1 ELSE 0 END) AS n FROM s GROUP BY 1)
    SELECT count(*) FILTER (a = 1) AS "any", count(*) FILTER (n = 1) AS negated, count(*) FILTER (a = 1 AND n = 0) AS plain FROM h""")
def b15(spark, d):
    lines = texts(spark, d).select(F.col("text_id").alias("being_id"), F.explode(F.split("text", "\n")).alias("line"))
    return term_counts(lines, filters.term_with_negation("line", TERM, NEGATED))


@query("b16_line_cap", f"WITH {TEXTS}, s AS (SELECT text_id, unnest(string_split(text, chr(10))) AS line FROM texts) SELECT text_id, count(*) AS n FROM s WHERE length(line) <= 700 AND trim(line, {SPACE_SQL}) <> '' GROUP BY 1")
def b16(spark, d):
    lines = texts(spark, d).select("text_id", F.explode(F.split("text", "\n")).alias("line"))
    return filters.line_cap(lines, "line").groupBy("text_id").agg(F.count(F.lit(1)).alias("n"))


# ---- C: text functions ------------------------------------------------------------------------
TOKENS = f"{TEXTS}, tok AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM texts)"


def tokens(spark, d):
    return texts(spark, d).select(F.explode(F.split("text", " ")).alias("w")).distinct()


@query("c1_c2_clean_norm", f"WITH {TOKENS} SELECT w, {clean_sql('w')} AS clean, lower({clean_sql('w')}) AS norm FROM tok")
def c1(spark, d):
    return tokens(spark, d).select("w", T.clean("w").alias("clean"), T.norm("w").alias("norm"))


@query("c3_label_norm", f"""WITH {TOKENS} SELECT w, regexp_replace(lower(trim(regexp_replace(regexp_replace(translate('The ' || w, '’‘', ''''''), '[*_`"“”#]', '', 'g'), '\\s+', ' ', 'g'), {SPACE_SQL})), '^(the|a|an)\\s+', '') AS norm FROM tok""")
def c3(spark, d):
    return tokens(spark, d).select("w", T.label_norm(F.concat(F.lit("The "), "w")).alias("norm"))


@query("c4_occurrences", f"WITH {TEXTS} SELECT text_id, len(list_filter(string_split_regex(lower(t), '[^a-z]+'), lambda x: x = 'the')) AS n, len(list_filter(string_split_regex(t, '[^A-Za-z]+'), lambda x: x = 'The')) AS n_cased FROM texts")
def c4(spark, d):
    return texts(spark, d).select("text_id", T.occurrences(F.lower("text"), F.lit("the")).alias("n"), T.occurrences_cased("text", F.lit("The")).alias("n_cased"))


SENT_SQL = (f"{TEXTS}, cutup AS (SELECT text_id, string_split(regexp_replace(text, '([.!?][\"”’)*_]*)(\\s+[\"“*_(]*[A-Z])', '\\1' || chr(10) || '\\2', 'g'), chr(10)) AS p FROM texts), "
            "piece AS (SELECT text_id, unnest(range(1, len(p) + 1)) AS k, p FROM cutup)")


@query("c5_sentences", f"WITH {SENT_SQL} SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY k) AS no, ltrim(p[k], {SPACE_SQL}) AS sentence FROM piece WHERE trim(p[k], {SPACE_SQL} || '-*_#=|') <> ''")
def c5(spark, d):
    x = texts(spark, d).select("text_id", "text", S.sentences("text").alias("ss"))
    return x.select("text_id", F.inline(F.transform("ss", lambda s: F.struct(s["no"].alias("no"), S.cut("text", s["start"], s["end"]).alias("sentence")))))


@query("c6_sentences_all", f"WITH {SENT_SQL} SELECT text_id, count(*) AS n FROM piece WHERE trim(p[k], {SPACE_SQL}) <> '' GROUP BY 1")
def c6(spark, d):
    return texts(spark, d).select("text_id", F.size(S.sentences("text", keep_markers=True)).cast("long").alias("n")).filter("n > 0")


@query("c7_enclosing_sentence", f"WITH {TEXTS} SELECT text_id, start, surface FROM ({sentence_rows('p', '(?i)' + chr(92) + 'bthing')})")
def c7(spark, d):
    found = texts(spark, d).select("text_id", "text", F.explode(S.find_spans("text", r"\bthing", flags="i")).alias("m"))
    s = S.enclosing_sentence("text", F.col("m.start"), F.col("m.end"))
    return found.select("text_id", s["start"].cast("long").alias("start"), s["surface"].alias("surface")).dropDuplicates(["text_id", "start"])


LINE_MASK = r"^#{1,6}[ \t].*$|^[ \t]*\*\*[^*\n]+\*\*[ \t]*:?[ \t]*$"


@query("c8_mask_lines", f"""WITH {PAGE_TEXTS} SELECT text_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN regexp_matches(l, '^#{{1,6}}[ \\t]') OR
    regexp_matches(l, '^[ \\t]*\\*\\*[^*]+\\*\\*[ \\t]*:?[ \\t]*$') THEN repeat(' ', length(l)) ELSE l END), chr(10))) AS h FROM pt""")
def c8(spark, d):
    return page_texts(spark, d).select("text_id", F.md5(S.mask_lines("text", LINE_MASK)).alias("h"))


HEADS_SQL = (f"{PAGE_TEXTS}, pl AS (SELECT text_id, unnest(range(1, len(p) + 1)) AS k, p FROM (SELECT text_id, string_split(text, chr(10)) AS p FROM pt)), "
             "heads AS (SELECT text_id, (coalesce(list_sum(list_transform(p[1:k-1], lambda x: length(x) + 1)), 0))::BIGINT AS start, trim(regexp_replace(CASE WHEN regexp_matches(p[k], '^[ \\t]*#{1,6}[ \\t]+') "
             "THEN regexp_extract(p[k], '^[ \\t]*#{1,6}[ \\t]+(.+?)[ \\t#]*$', 1) ELSE regexp_extract(p[k], '^[ \\t]*(?:(?:[-*•][ \\t]+|\\d+[.)][ \\t]+)?)(\\*\\*[^*]{2,120}\\*\\*)', 1) END, '[*_#`]+', '', 'g'), ' :.') AS title FROM pl)")


@query("c10_headings", f"WITH {HEADS_SQL} SELECT text_id, start, title FROM heads WHERE title <> ''")
def c10(spark, d):
    return page_texts(spark, d).select("text_id", F.inline(S.headings("text"))).select("text_id", F.col("start").cast("long").alias("start"), "title")


@query("c11_kwic", f"WITH {TEXTS}, {LABELS} SELECT l.text_id, start, replace(substr(text, greatest(0, start - 30) + 1, start - greatest(0, start - 30)), chr(10), ' / ') || '«' || label || '»' || replace(substr(text, e + 1, 30), chr(10), ' / ') AS shown FROM labels2 l JOIN texts USING (text_id)")
def c11(spark, d):
    x = labels(spark, d).join(texts(spark, d).select("text_id", "text"), "text_id")
    return x.select("text_id", F.col("start").cast("long").alias("start"), S.kwic("text", F.col("start"), F.col("end"), 30).alias("shown"))


@query("c12_mark_spans", f"WITH {TEXTS} SELECT text_id, md5(regexp_replace(t, '[A-Z][a-z]+', '[S:\\0]', 'g')) AS h FROM texts")
def c12(spark, d):
    plain = F.translate("text", ACCENTED, "0" * len(ACCENTED))
    x = texts(spark, d).select("text_id", plain.alias("text"))
    words = F.transform(S.find_spans("text", "[A-Z][a-z]+"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(2).alias("rank")))
    inner = F.transform(S.find_spans("text", "(?<=[A-Z])[a-z]"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(1).alias("rank")))
    return x.select("text_id", F.md5(S.mark_spans("text", F.concat(words, inner))).alias("h"))


@query("c13_c14_lexicon_words", f"WITH {TEXTS} SELECT text_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), ['thing','rest','there','one','sting','here'])) AS n, len(regexp_extract_all(text, '\\b\\d(?:\\.\\d)?\\s*(?:/\\s*3|out\\s+of\\s+3)\\b')) AS echo FROM texts")
def c13(spark, d):
    return texts(spark, d).select("text_id", T.n_lexicon_words("text", ["thing", "rest", "there", "one", "sting", "here"]).alias("n"), T.param_echo("text").alias("echo"))


@query("c15_words", f"WITH {TEXTS} SELECT text_id, len(regexp_extract_all(t, '[^\\W_]+(?:''[^\\W_]+)*')) AS n_label, len(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''’-]*'))) AS n_corpus FROM texts")
def c15(spark, d):
    return texts(spark, d).select("text_id", F.size(T.words("text")).alias("n_label"), F.size(T.corpus_words("text")).alias("n_corpus"))


@query("c16_fold", f"WITH {TEXTS} SELECT text_id, md5({fold_sql('text')}) AS h FROM texts")
def c16(spark, d):
    return texts(spark, d).select("text_id", F.md5(T.fold("text")).alias("h"))


@query("c17_small_folds", f"""WITH {TOKENS} SELECT w, regexp_replace(trim(translate(lower('The ' || w), '*_"“”‘’''#:.,', ''), {SPACE_SQL}), '^(the|a|an) ', '') AS verdict,
    regexp_replace(trim(translate(lower('Its ' || w), '’‘', ''''''), {SPACE_SQL}), '^(the|a|an|its|their) ', '') AS hand,
    lower(trim(regexp_replace(translate(w, '’‘“”*', '''''""'), '\\s+', ' ', 'g'), {SPACE_SQL})) AS evidence, translate(lower(w), '’‘“”—–', '''''""--') AS label FROM tok""")
def c17(spark, d):
    c = F.concat(F.lit("The "), "w")
    return tokens(spark, d).select("w", T.fold_compare(c, "verdict").alias("verdict"), T.fold_compare(F.concat(F.lit("Its "), "w"), "hand").alias("hand"),
                                   T.fold_compare("w", "evidence").alias("evidence"), T.fold_compare("w", "label").alias("label"))


@query("c18_find_spans", f"WITH {TEXTS} SELECT text_id, start, start + length(surface) AS \"end\", surface FROM ({span_rows('p', chr(92) + 'b[Tt]he[ ' + chr(92) + 't]+', '[a-z]+', chr(92) + 'b')})")
def c18(spark, d):
    x = texts(spark, d).select("text_id", F.inline(S.find_spans("text", r"\b[Tt]he[ \t]+(?P<name>[a-z]+)\b", "name")))
    return x.select("text_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "surface")


EACH = 700


def returned_quotes(spark, d):
    """Per text, at every 700th character, stretches as a model might return them: as written, in capitals with double
    spaces; and one that is in no text."""
    x = texts(spark, d)
    at = F.sequence(F.lit(0), F.floor(F.length("text") / EACH).cast("int"))
    said = F.transform(at, lambda i: F.array(F.substring(F.col("text"), i * EACH + 21, F.lit(60)), F.replace(F.translate(F.substring(F.col("text"), i * EACH + 41, F.lit(90)), "aeiou", "AEIOU"), F.lit(" "), F.lit("  "))))
    said = F.filter(F.concat(F.flatten(said), F.array(F.lit("zzqx wvvk zzqx wvvk zzqx"))), lambda q: F.length(F.btrim(q)) >= 4)
    return x.select("text_id", "text", F.transform(said, lambda q, i: F.struct(i.alias("quote_no"), q.alias("quote"))).alias("quotes"))


# Folding keeps a text's length, and so its offsets, where it holds none of these.
UNEVEN_FOLD = r"[*_`…]|\s\s"


@query("c16_c19_locate", f"""WITH {TEXTS}, s AS (SELECT text_id, text, list_filter(flatten(list_transform(range(0, length(text) // {EACH} + 1), lambda i: [substr(text, (i * {EACH} + 21)::BIGINT, 60),
        replace(translate(substr(text, (i * {EACH} + 41)::BIGINT, 90), 'aeiou', 'AEIOU'), ' ', '  ')])) || ['zzqx wvvk zzqx wvvk zzqx'], lambda q: length(trim(q)) >= 4) AS qs FROM texts),
    q AS (SELECT text_id, text, unnest(range(0, len(qs))) AS quote_no, unnest(qs) AS quote FROM s),
    f AS (SELECT *, trim(quote, {SPACE_SQL}) AS tq, {fold_sql('text')} AS ft, trim({fold_sql('quote')}, ' ') AS fq FROM q)
    SELECT text_id, quote_no, CASE WHEN contains(text, tq) THEN 'exact' ELSE 'folded' END AS match, md5(fq) AS h,
    CASE WHEN contains(text, tq) THEN instr(text, tq) - 1 WHEN NOT regexp_matches(text, '[*_`…]|\\s\\s') THEN instr(ft, fq) - 1 END AS start,
    CASE WHEN contains(text, tq) THEN instr(text, tq) - 1 + length(tq) WHEN NOT regexp_matches(text, '[*_`…]|\\s\\s') THEN instr(ft, fq) - 1 + length(fq) END AS "end"
    FROM f WHERE contains(text, tq) OR (length(fq) >= 8 AND contains(ft, fq))""")
def c19(spark, d):
    q = returned_quotes(spark, d)
    # the places of a text meet it once; joined one by one, each would carry a copy of it and search that
    at = grounding.locate_all(q, ["text_id"]).groupBy("text_id").agg(F.collect_list(F.struct("quote_no", "match", "start", "end")).alias("found"))
    cuts = S.with_cuts("text", F.col("found"), lambda s, stretch: F.struct(s["quote_no"].alias("quote_no"), s["match"].alias("match"), s["start"].alias("start"), s["end"].alias("end"), stretch.alias("cut")))
    x = at.join(q.select("text_id", "text"), "text_id").select("text_id", F.col("text").rlike(UNEVEN_FOLD).alias("uneven"), cuts.alias("found"))
    x = x.select("text_id", "uneven", F.inline("found"))
    even = (F.col("match") == "exact") | ~F.col("uneven")
    return x.select("text_id", "quote_no", "match", F.md5(F.btrim(T.fold("cut"), F.lit(" "))).alias("h"),
                    F.when(even, F.col("start")).cast("long").alias("start"), F.when(even, F.col("end")).cast("long").alias("end"))


def sentences_at_sql(source):
    """CTEs ending in sat: (text_id, text, sentence, start, e) of all sentences and heading lines of ``source``."""
    return (f"sg AS (SELECT text_id, text, g, unnest(range(1, len(g) + 1)) AS i FROM (SELECT text_id, text, string_split(regexp_replace(text, '([.!?][\"”’)*_]*)(\\s+[\"“*_(]*[A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS g FROM {source})), "
            "sl AS (SELECT text_id, text, coalesce(list_sum(list_transform(g[1:i-1], lambda x: length(x))), 0)::BIGINT AS o, string_split(g[i], chr(10)) AS p FROM sg), "
            "sp AS (SELECT text_id, text, p[k] AS piece, o + coalesce(list_sum(list_transform(p[1:k-1], lambda x: length(x) + 1)), 0)::BIGINT AS o FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM sl)), "
            f"sat AS (SELECT text_id, text, ltrim(piece, {SPACE_SQL}) AS sentence, o + length(piece) - length(ltrim(piece, {SPACE_SQL})) AS start, o + length(piece) AS e FROM sp WHERE trim(piece, {SPACE_SQL}) <> '')")


LONG_SENTENCE = 40


@query("c20_fuzzy_alignment", f"""WITH {TEXTS}, {sentences_at_sql('texts')} SELECT text_id, start, e AS "end", 'fuzzy' AS match FROM sat
    WHERE regexp_matches(sentence, '^[\\p{{L}} ,]+[.]$') AND len(string_split(sentence, ' ')) >= {LONG_SENTENCE} AND (length(text) - length(replace(text, sentence, ''))) / length(sentence) = 1""")
def c20(spark, d):
    """Every sentence of forty words and more that stands once in its text, with its middle word replaced, is found where it
    stood. Sentences with marks inside may be widened by them and are left out here."""
    x = texts(spark, d).select("text_id", "text", F.explode(S.sentences("text", keep_markers=True)).alias("s"))
    raw = S.cut("text", F.col("s.start"), F.col("s.end"))
    x = x.withColumn("raw", raw).withColumn("w", F.split("raw", " ")).filter(F.col("raw").rlike(r"^[\p{L} ,]+[.]$") & (F.size("w") >= LONG_SENTENCE))
    x = x.filter((F.length("text") - F.length(F.replace("text", "raw", F.lit("")))) / F.length("raw") == 1)
    changed = F.array_join(F.transform("w", lambda w, i: F.when(i == F.floor(F.size("w") / 2), "zzqxw").otherwise(w)), " ")
    per = x.groupBy("text_id").agg(F.first("text").alias("text"), F.collect_list(F.struct(F.col("s.no").alias("quote_no"), changed.alias("quote"))).alias("quotes"))
    at = grounding.locate_all(per, ["text_id"])
    return at.select("text_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "match")


@query("c21_extract_json", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def c21(spark, d):
    raw = F.concat(F.lit("Sure, here it is:\n```json\n"), "props", F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.get_json_object(T.extract_json(raw), "$.k").cast("int").alias("k"))


@query("c22_valid_numbers", """SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_filter(list(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity::INT END), lambda x: x BETWEEN 1 AND 30))), ',') AS nos
    FROM lineitem GROUP BY 1""")
def c22(spark, d):
    v = F.when(F.col("l_linenumber") % 3 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string")))
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(v).alias("v"))
    return per.select("l_orderkey", F.array_join(T.valid_numbers("v", F.lit(30)), ",").alias("nos"))


@query("c23_split_answers", f"""WITH p AS (SELECT conv_id, turn, least(turn + 1, 5) AS no, trim(least(turn + 1, 5) || '. ' || text, {SPACE_SQL}) AS body FROM conversations UNION ALL SELECT DISTINCT conv_id, -1, 0, 'Well then.' FROM conversations)
    SELECT conv_id, no, string_agg(body, chr(10) ORDER BY turn) AS body FROM p GROUP BY 1, 2""")
def c23(spark, d):
    """All turns of a conversation as the numbered parts of one answer."""
    part = F.concat(F.least(F.col("turn") + 1, F.lit(5)).cast("string"), F.lit(". "), "text")
    p = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    raw = F.concat(F.lit("Well then.\n"), F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n"))
    return p.select("conv_id", F.inline(split_answers(raw))).select("conv_id", F.col("no").cast("long").alias("no"), "body")


@query("c24_lab_era_half", """WITH o AS (SELECT o_orderkey, strftime(o_orderdate + INTERVAL 28 YEAR, '%Y-%m-%d') AS date FROM orders)
    SELECT o_orderkey, split_part('lab/' || o_orderkey, '/', 1) AS lab, CASE WHEN date < '2025' THEN '2024 and before' WHEN date < '2025-07' THEN 'first half of 2025' WHEN date < '2026' THEN 'second half of 2025' ELSE '2026' END AS era,
    substr(date, 1, 4) || CASE WHEN substr(date, 6, 2) <= '06' THEN ' first half' ELSE ' second half' END AS half FROM o""")
def c24(spark, d):
    date = F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 28 * 12), "yyyy-MM-dd")
    o = table(spark, d, "orders").select("o_orderkey", date.alias("date"))
    return o.select("o_orderkey", T.lab(F.concat(F.lit("lab/"), F.col("o_orderkey").cast("string"))).alias("lab"), T.era("date").alias("era"), T.half_year("date").alias("half"))


@query("c25_band_pct", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount * 10 >= 0.8 THEN 'hi' WHEN l_discount * 10 >= 0.5 THEN 'mid' WHEN l_discount > 0 THEN 'lo' ELSE 'none' END AS band, "
       "CASE WHEN l_quantity - 1 <> 0 THEN round(l_linenumber * 100.0 / (l_quantity - 1), 1) END AS pct FROM lineitem")
def c25(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.band(F.col("l_discount") * 10).alias("band"),
                                              T.pct("l_linenumber", F.col("l_quantity") - 1).alias("pct"))


VOCAB = f"{TEXTS}, voc AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z][a-z''’-]*')) AS noun FROM texts)"


@query("c26_fold_plural", f"""WITH {VOCAB}, c AS (SELECT v.noun, b.rule, b.base FROM voc v, LATERAL (VALUES (1, CASE WHEN v.noun LIKE '%ies' THEN left(v.noun, length(v.noun) - 3) || 'y' END), (2, CASE WHEN v.noun LIKE '%ves' THEN left(v.noun, length(v.noun) - 3) || 'f' END),
    (3, CASE WHEN v.noun LIKE '%ves' THEN left(v.noun, length(v.noun) - 3) || 'fe' END), (4, CASE WHEN regexp_matches(v.noun, '(s|x|z|ch|sh|o)es$') THEN left(v.noun, length(v.noun) - 2) END),
    (5, CASE WHEN v.noun LIKE '%s' AND v.noun NOT LIKE '%ss' THEN left(v.noun, length(v.noun) - 1) END)) b(rule, base) WHERE b.base IN (SELECT noun FROM voc)),
    m AS (SELECT noun, arg_min(base, rule) AS base FROM c GROUP BY 1) SELECT voc.noun, coalesce(m.base, voc.noun) AS base FROM voc LEFT JOIN m ON m.noun = voc.noun""")
def c26(spark, d):
    voc = texts(spark, d).select(F.explode(T.corpus_words("text")).alias("noun"))
    return fold_plural(voc, voc)


@query("c27_kept_phrases", """WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, lower(p_type) AS c FROM part)
    SELECT p_partkey, b AS word, form, x FROM (SELECT p_partkey, b, unnest(['pre', 'of']) AS form, unnest([a, c || ' hall']) AS x FROM p)""")
def c27(spark, d):
    from spanloom.functions.text import kept_phrases
    nouns = ("ring", "widget", "bolt", "gear", "gizmo", "plate", "anvil", "rod")
    label = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("s of the "), F.lower("p_type"), F.lit(" hall of glass"))
    return table(spark, d, "part").select("p_partkey", F.inline(kept_phrases(label, nouns)))


@query("c28_find_label", f"WITH {TEXTS} SELECT text_id, CASE WHEN instr(text, 'That') > 0 THEN instr(text, 'That') - 1 WHEN instr(translate(lower(text), '’‘“”—–', '''''\"\"--'), 'that') > 0 THEN instr(translate(lower(text), '’‘“”—–', '''''\"\"--'), 'that') - 1 END AS place FROM texts")
def c28(spark, d):
    return texts(spark, d).select("text_id", T.find_label(F.lit("That"), "text").cast("long").alias("place"))


@query("c29_passage_view", f"""WITH {TEXTS}, s AS (SELECT text_id, text, unnest(range(0, length(text) // 200 + 1)) AS i FROM texts), c AS (SELECT *, (i * 200)::BIGINT AS s, least(i * 200 + 30, length(text))::BIGINT AS e FROM s),
    k AS (SELECT * FROM c WHERE e > s)
    SELECT text_id, string_agg('[' || round_even(100.0 * s / length(text), 0)::INT || '%] ' || trim(substr(text, s + 1, e - s), {SPACE_SQL}), chr(10) ORDER BY s) AS view, count(*) AS passages,
    round_even(100.0 * sum(e - s) / any_value(length(text)), 0)::INT AS covered_pct FROM k GROUP BY text_id""")
def c29(spark, d):
    """Thirty characters at every 200th of the whole text."""
    n = F.length("text")
    at = F.filter(F.sequence(F.lit(0), F.floor(n / 200).cast("int")), lambda i: i * 200 < n)
    spans = F.transform(at, lambda i: F.struct((i * 200).alias("start"), F.least(i * 200 + 30, n).alias("end")))
    return texts(spark, d).filter(n > 0).select("text_id", grounding.passage_view("text", spans).alias("v")).select("text_id", "v.view", F.col("v.passages").cast("long").alias("passages"), "v.covered_pct")


@query("c30_c31_levels", f"{WITH_BEINGS} SELECT id, CASE WHEN n_fate > 0 THEN 'is' WHEN n_cost > 0 THEN 'alive' WHEN n_role > 0 THEN 'part' ELSE 'in' END AS level, CASE WHEN n_fate > 0 THEN 3 WHEN n_cost > 0 THEN 2 WHEN n_role > 0 THEN 1 ELSE 0 END AS rank FROM beings")
def c30(spark, d):
    def arr(c):
        return F.filter(F.sequence(F.lit(0), F.col(c)), lambda x: x > 0)
    b = beings(spark, d).select("id", T.level(arr("n_role"), arr("n_cost"), arr("n_fate")).alias("level"))
    return b.withColumn("rank", T.level_rank("level"))


# ---- F1, G3: document frequency, latest status ---------------------------------------------------
@query("f1_doc_freq", f"WITH {TEXTS}, {WORDS} SELECT word, n_texts, df FROM freq")
def f1(spark, d):
    return doc_freq(texts(spark, d))


@query("g3_latest_status", "SELECT user_id AS text_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('view', 'click', 'error')) WHERE rn = 1")
def g3(spark, d):
    s = table(spark, d, "events").select(F.col("user_id").alias("text_id"), F.col("event_type").alias("status"), F.col("ts").alias("tagged_at"), F.col("event_id").alias("seq"))
    return latest_status(s, ("view", "click", "error"))
