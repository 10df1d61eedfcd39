"""Queries over intervals, samples, requests and answers."""
from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.operators import answers as A, evaluate as E, intervals as I, sampling as G
from spanloom.operators.tables import names_in_quotes
from spanloom.plans.data import ACCENTED, INTERVALS, LABELS, TEXTS, WITH_BEINGS, beings, intervals, labels, page_texts, query, table, texts
from spanloom.plans.text_queries import HEADS_SQL, SENT_SQL, SPACE_SQL, sentences_at_sql
from spanloom.session import scratch
from spanloom.streaming.ingest import answers_now, counts_now, follow, latest, taken

# ---- intervals ---------------------------------------------------------------------------
WITH_IV = f"WITH {INTERVALS}"
WIDE = 86400 * 2


def kind(spark, d, name):
    return intervals(spark, d).filter(F.col("event_type") == name)


@query("e2_overlap_join", f"{WITH_IV} SELECT a.event_id, EXISTS (SELECT 1 FROM iv b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND a.start < b.e AND a.e > b.start) AS alive FROM iv a WHERE a.event_type = 'click'")
def e2(spark, d):
    matched, gone = I.overlap_join(kind(spark, d, "click"), kind(spark, d, "purchase"), ["user_id"], WIDE)
    return matched.select("event_id", F.lit(True).alias("alive")).unionByName(gone.select("event_id", F.lit(False).alias("alive")))


@query("e2_overlap_pairs", f"{WITH_IV} SELECT a.event_id, b.event_id AS other FROM iv a JOIN iv b ON b.user_id = a.user_id AND a.start < b.e AND a.e > b.start WHERE a.event_type = 'click' AND b.event_type = 'view'")
def e2b(spark, d):
    return I.overlap_pairs(kind(spark, d, "click"), kind(spark, d, "view"), ["user_id"], 3600).select("event_id", F.col("r_event_id").alias("other"))


DAYS = "dy AS (SELECT DISTINCT user_id, (start // 43200) * 43200 AS start, (start // 43200) * 43200 + 30000 AS e FROM iv WHERE event_type = 'view')"


def days(spark, d):
    s = F.floor(F.col("start") / 43200) * 43200
    return kind(spark, d, "view").select("user_id", s.alias("start"), (s + 30000).alias("end")).distinct()


@query("e4_not_covered", f"{WITH_IV}, {DAYS} SELECT a.event_id FROM iv a WHERE a.event_type = 'error' AND NOT EXISTS (SELECT 1 FROM dy q WHERE q.user_id = a.user_id AND q.start <= a.start AND a.e <= q.e)")
def e4(spark, d):
    return I.not_covered(kind(spark, d, "error"), days(spark, d), ["user_id"], 20000).select("event_id")


@query("e7_caught", f"{WITH_IV}, {DAYS} SELECT a.event_id FROM iv a WHERE a.event_type = 'error' AND EXISTS (SELECT 1 FROM dy q WHERE q.user_id = a.user_id AND q.start <= a.start AND a.e <= q.e)")
def e7(spark, d):
    return I.caught(kind(spark, d, "error"), days(spark, d), ["user_id"], 20000).select("event_id")


LINES = ("lines AS (SELECT text_id, k, p, (coalesce(list_sum(list_transform(p[1:k-1], lambda x: length(x) + 1)), 0))::BIGINT AS s FROM "
         "(SELECT text_id, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT text_id, string_split(text, chr(10)) AS p FROM texts)))")


@query("e5_locate_in", f"WITH {TEXTS}, {LABELS}, {LINES} SELECT l.text_id, l.start AS pos, s AS line_start FROM (SELECT DISTINCT text_id, start FROM labels2) l JOIN lines ON lines.text_id = l.text_id AND s <= l.start AND l.start < s + length(p[k])")
def e5(spark, d):
    lines = texts(spark, d).select("text_id", F.inline(S.find_spans("text", r"[^\n]+")))
    points = labels(spark, d).select("text_id", F.col("start").cast("long").alias("pos")).distinct()
    return I.locate_in(points, lines.select("text_id", "start", "end"), ["text_id"], width=512).select("text_id", "pos", F.col("r_start").cast("long").alias("line_start"))


@query("e6_asof_join", f"{WITH_IV} SELECT a.event_id, coalesce((SELECT arg_max(b.event_id, (b.start, b.event_id)) FROM iv b WHERE b.event_type = 'view' AND b.user_id = a.user_id AND b.start <= a.start)::VARCHAR, '') AS last_view FROM iv a WHERE a.event_type = 'purchase'")
def e6(spark, d):
    views = kind(spark, d, "view").groupBy("user_id", "start").agg(F.max("event_id").cast("string").alias("last_view"))
    return I.asof_last(kind(spark, d, "purchase"), views, ["user_id"], "last_view", default="", width=WIDE).select("event_id", "last_view")


@query("e6_heading_above", f"WITH {HEADS_SQL}, pl2 AS (SELECT text_id, k, p, (coalesce(list_sum(list_transform(p[1:k-1], lambda x: length(x) + 1)), 0))::BIGINT AS s FROM (SELECT text_id, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT text_id, string_split(text, chr(10)) AS p FROM pt))) "
       "SELECT l.text_id, l.s AS start, coalesce((SELECT arg_max(title, h.start) FROM heads h WHERE h.text_id = l.text_id AND h.title <> '' AND h.start <= l.s), '') AS title FROM pl2 l WHERE length(p[k]) >= 200")
def e6b(spark, d):
    t = page_texts(spark, d)
    quotes = t.select("text_id", F.inline(S.find_spans("text", r"[^\n]{200,}"))).select("text_id", "start", "end")
    heads = t.select("text_id", F.inline(S.headings("text")))
    return I.asof_last(quotes, heads, ["text_id"], "title", default="", width=1000).select("text_id", F.col("start").cast("long").alias("start"), "title")


MERGED = ("o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM iv), g AS (SELECT *, sum(CASE WHEN r IS NULL OR start > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS k FROM o), "
          "mg AS (SELECT user_id, min(start) AS start, max(e) AS e FROM g GROUP BY user_id, k)")


@query("g4_merge_spans", f"{WITH_IV}, {MERGED} SELECT user_id, start, e AS \"end\" FROM mg")
def g4(spark, d):
    return I.merge_spans(intervals(spark, d), ["user_id"], width=WIDE)


@query("f53_coverage", f"WITH {TEXTS}, {LABELS} SELECT text_id, length(text) AS length, coalesce(covered, 0) AS covered, coalesce(n, 0) AS n_spans FROM texts LEFT JOIN (SELECT text_id, sum(e - start)::BIGINT AS covered, count(*) AS n FROM labels2 GROUP BY 1) USING (text_id)")
def f53(spark, d):
    return I.coverage(labels(spark, d), texts(spark, d).select("text_id", F.length("text").alias("length")), ["text_id"])


ANCHORS = ("an AS (SELECT text_id, i * 100 AS start, i * 100 + 20 AS e, i % 2 = 0 AS core FROM (SELECT text_id, text, unnest(range(0, length(text) // 100)) AS i FROM texts)), "
           "qt AS (SELECT text_id, i * 150 AS start, i * 150 + 80 + (text_id % 3) * 40 AS e FROM (SELECT text_id, unnest(range(0, length(text) // 150 + 1)) AS i FROM texts WHERE text_id % 5 <> 0))")


def anchors(spark, d):
    """A mark of 20 characters at every hundredth character of the whole text."""
    x = texts(spark, d).withColumn("n", F.floor(F.length("text") / 100).cast("int")).filter("n > 0")
    return x.select("text_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("text_id", (F.col("i") * 100).alias("start"), (F.col("i") * 100 + 20).alias("end"), (F.col("i") % 2 == 0).alias("core"))


def quotes(spark, d):
    """A stretch of 80 to 160 characters at every 150th character of the whole text, but for a fifth of the texts."""
    x = texts(spark, d).filter("text_id % 5 <> 0").select("text_id", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 150).cast("int"))).alias("i"))
    return x.select("text_id", (F.col("i") * 150).alias("start"), (F.col("i") * 150 + 80 + (F.col("text_id") % 3) * 40).cast("int").alias("end"))


IN_Q = "EXISTS (SELECT 1 FROM qt q WHERE q.text_id = a.text_id AND q.start <= a.start AND a.e <= q.e)"


@query("f49_extractor_recall", f"""WITH {TEXTS}, {ANCHORS}, s AS (SELECT a.*, {IN_Q} AS got FROM an a WHERE text_id IN (SELECT text_id FROM qt)), cv AS (SELECT text_id, count(DISTINCT c) AS n FROM (SELECT text_id, unnest(range(start, e)) AS c FROM qt WHERE text_id IN (SELECT text_id FROM an)) GROUP BY 1)
    SELECT count(*) AS anchors, count(*) FILTER (got) AS got, count(*) FILTER (core) AS core, count(*) FILTER (core AND got) AS got_core, (SELECT round(100.0 * sum(n) / (SELECT sum(length(text)) FROM texts WHERE text_id IN (SELECT text_id FROM s)), 1) FROM cv) AS kept_pct FROM s""")
def f49(spark, d):
    return E.extractor_recall(anchors(spark, d), quotes(spark, d), texts(spark, d))


@query("f49_missed_core", f"WITH {TEXTS}, {ANCHORS} SELECT text_id, start FROM an a WHERE core AND NOT {IN_Q}")
def f49b(spark, d):
    return E.missed_core(anchors(spark, d), quotes(spark, d)).select("text_id", "start")


def page_quotes(spark, d):
    t = page_texts(spark, d)
    q = t.select("text_id", F.inline(S.find_spans("text", r"[^\n]{200,}")))
    return I.asof_last(q, t.select("text_id", F.inline(S.headings("text"))).withColumnRenamed("title", "heading"), ["text_id"], "heading", default="", width=1000).withColumnRenamed("surface", "quote")


NQ = ("nq AS (SELECT DISTINCT text_id, lower(w) AS norm FROM (SELECT text_id, unnest(regexp_extract_all(text, '[.] ([A-Z][a-z]{3,})', 1)) AS w FROM pt)), qb AS (SELECT l.text_id, lower(p[k]) AS q, lower(coalesce((SELECT arg_max(title, h.start) FROM heads h WHERE h.text_id = l.text_id AND h.title <> '' "
      "AND h.start <= (coalesce(list_sum(list_transform(p[1:k-1], lambda x: length(x) + 1)), 0))::BIGINT), '')) AS h FROM pl l WHERE length(p[k]) >= 200), "
      "nf AS (SELECT n.text_id, n.norm, coalesce(max(CASE WHEN regexp_matches(q, '(^|[^a-z])' || norm || '([^a-z]|$)') THEN 1 ELSE 0 END), 0) AS iq, coalesce(max(CASE WHEN regexp_matches(q || ' | ' || h, '(^|[^a-z])' || norm || '([^a-z]|$)') THEN 1 ELSE 0 END), 0) AS iqh FROM nq n LEFT JOIN qb USING (text_id) GROUP BY 1, 2)")


def page_names(spark, d):
    return page_texts(spark, d).select("text_id", F.explode(F.regexp_extract_all("text", F.lit("[.] ([A-Z][a-z]{3,})"), F.lit(1))).alias("w")).select("text_id", F.lower("w").alias("norm")).distinct()


@query("e16_names_in_quotes", f"WITH {HEADS_SQL}, {NQ} SELECT text_id, norm, iq = 1 AS in_quote, iqh = 1 AS in_quote_or_heading FROM nf")
def e16(spark, d):
    return names_in_quotes(page_names(spark, d), page_quotes(spark, d))


@query("f50_quote_context", f"WITH {HEADS_SQL}, {NQ} SELECT (SELECT count(*) FROM qb) AS quotes, (SELECT count(*) FROM qb WHERE h <> '') AS under_heading, (SELECT count(DISTINCT text_id) FROM heads WHERE title <> '') AS texts_with_heading, count(*) AS names, sum(iq)::BIGINT AS in_quote, sum(iqh)::BIGINT AS in_quote_or_heading FROM nf")
def f50(spark, d):
    q = page_quotes(spark, d)
    with_heading = page_texts(spark, d).filter(F.size(S.headings("text")) > 0)
    return E.quote_context_stats(q, with_heading, names_in_quotes(page_names(spark, d), q))


# ---- samples and chunks --------------------------------------------------------------------------
@query("g2_first_wins", f"WITH {TEXTS}, {LABELS} SELECT text_id, norm, arg_min(source, (CASE source WHEN 'quote' THEN 0 ELSE 1 END, start)) AS source FROM labels2 GROUP BY 1, 2")
def g2(spark, d):
    l = labels(spark, d).withColumn("p", F.when(F.col("source") == "quote", 0).otherwise(1))
    return G.first_wins(l.select("text_id", "norm", "source", "p", "start"), ["text_id", "norm"], ["p", "start"]).select("text_id", "norm", "source")


@query("g5_sample_hits", "SELECT source, doc_id, total FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('s1:' || doc_id)) AS rn, count(*) OVER (PARTITION BY source) AS total FROM documents) WHERE rn <= 5")
def g5(spark, d):
    return G.sample_hits(table(spark, d, "documents").select("doc_id", "source"), 5, "s1", ["doc_id"], "source").select("source", "doc_id", "total")


@query("g6_balanced_sample", """WITH t AS (SELECT doc_id, source, md5('s2:' || doc_id) AS dr FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dr) AS turn FROM t), k AS (SELECT * FROM r ORDER BY turn, dr LIMIT 90),
    p AS (SELECT *, row_number() OVER (ORDER BY md5('s2/part:' || doc_id)) - 1 AS i FROM k) SELECT source, doc_id, turn, CASE WHEN i < 45 THEN 'A' ELSE 'B' END AS part FROM p""")
def g6(spark, d):
    return G.balanced_sample(table(spark, d, "documents").select("doc_id", "source"), "source", 90, "s2", "doc_id").select("source", "doc_id", "turn", "part")


@query("g7_stratified_sample", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('s3:' || c_custkey)) AS rn FROM customer) WHERE rn <= 10")
def g7(spark, d):
    return G.stratified_sample(table(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", 10, "s3", "c_custkey")


@query("g8_record_verdicts", "SELECT 'p' AS pattern, doc_id AS text, substr('bpbxtg', (no)::INT, 1) AS verdict FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('s4:' || doc_id)) AS no FROM documents) WHERE no <= 6 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def g8(spark, d):
    from pyspark.sql import Window as W
    drawn = G.sample_hits(table(spark, d, "documents").select("doc_id"), 6, "s4", ["doc_id"])
    rows = drawn.withColumn("no", F.row_number().over(W.orderBy(G.draw_key("s4", "doc_id"))))
    sample = rows.select(F.lit("p").alias("pattern"), F.col("doc_id").alias("text"), F.lit(0).alias("start"), F.lit(3).alias("end"), "no")
    done = table(spark, d, "labels").filter("quality = 1").select(F.lit("p").alias("pattern"), F.col("doc_id").alias("text"), F.lit(0).alias("start"), F.lit(3).alias("end"))
    return E.record_verdicts(sample, "bp bx tg", done).select("pattern", "text", "verdict")


@query("g9_top_k", "SELECT c_nationkey, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 14")
def g9(spark, d):
    return G.top_k(table(spark, d, "customer"), "c_nationkey", 14, [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_nationkey", "c_custkey", "rank")


@query("g10_chunks", "SELECT count(*) AS n, 0 AS oversized, 0 AS gaps FROM conversations")
def g10(spark, d):
    """Every line in one chunk of at most 25, numbered from 1 without gaps."""
    c = G.chunk(table(spark, d, "conversations"), 25, ["conv_id", "turn"])
    per = c.groupBy("share", "chunk").agg(F.count(F.lit(1)).alias("n"), F.max("no").alias("top"), F.countDistinct("no").alias("k"))
    return per.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 25).alias("oversized"), F.count_if((F.col("top") != F.col("n")) | (F.col("k") != F.col("n"))).alias("gaps"))


@query("g10_numbered_lines", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations")
def g10b(spark, d):
    return G.numbered(table(spark, d, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "no")


@query("g11_e20_anonymise", "SELECT doc_id, item, (item - 1000) // 5 AS prompt FROM (SELECT doc_id, 999 + row_number() OVER (ORDER BY md5('s5:' || doc_id), doc_id) AS item FROM documents)")
def g11(spark, d):
    items, keep = G.anonymise(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 5, "s5")
    return G.restore(items.select("item", "prompt"), keep).select("doc_id", "item", "prompt")


@query("g12_page", "SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS p FROM orders) ORDER BY p DESC NULLS LAST, o_totalprice ASC NULLS LAST LIMIT 200")
def g12(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    return G.page(o, [("p", -1), ("o_totalprice", 1)], 200).select("o_orderkey", "o_totalprice")


@query("g13_shuffle", "SELECT doc_id FROM documents ORDER BY md5('s6:' || doc_id)")
def g13(spark, d):
    return G.shuffled(table(spark, d, "documents").select("doc_id"), "s6", "doc_id")


@query("e14_todo", "SELECT o_orderkey AS text_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O')")
def e14(spark, d):
    l = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "text_id")
    batches = l.filter("l_returnflag = 'R'").select("text_id", F.when(F.col("l_linestatus") == "O", "completed").otherwise("failed").alias("status"))
    return G.todo(table(spark, d, "orders").select(F.col("o_orderkey").alias("text_id")), l.filter("l_returnflag = 'A'"), batches)


# ---- requests -------------------------------------------------------------------------------------
@query("i1_requests_text", "SELECT 't' || doc_id AS custom_id, md5('Quote it.' || chr(10) || chr(10) || 'THE TEXT' || chr(10) || chr(10) || text) AS h FROM documents")
def i1(spark, d):
    return A.requests_text(texts(spark, d), "Quote it.").select("custom_id", F.md5("content").alias("h"))


@query("i2_requests_lines", "SELECT conv_id, md5('Labels.' || chr(10) || chr(10) || string_agg((turn + 1) || '. ' || text, chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY 1")
def i2(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("no"), F.col("text").alias("line"))
    return A.requests_lines(lines, "Labels.", "conv_id").select("conv_id", F.md5("content").alias("h"))


@query("i2_requests_labels", """WITH w AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS l FROM conversations GROUP BY 1)
    SELECT c.conv_id, md5('Among ' || any_value(array_to_string(l, '; ')) || ':' || chr(10) || chr(10) || string_agg('[' || (turn + 1) || '] ' || text, chr(10) ORDER BY turn)) AS h FROM conversations c JOIN w USING (conv_id) GROUP BY 1""")
def i2b(spark, d):
    """The instruction holds the labels of the text."""
    c = table(spark, d, "conversations")
    found = c.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("found"))
    lines = c.join(found, "conv_id").select("conv_id", (F.col("turn") + 1).alias("no"), F.col("text").alias("line"), A.prompt_with_labels("Among {labels}:", F.col("found")).alias("prompt"))
    return A.requests_lines(lines, F.col("prompt"), "conv_id", form="[%d] %s").select("conv_id", F.md5("content").alias("h"))


# Texts are numbered in one order here, as sums of ranges, so that the SQL can number them as well; shares are tested in g10.
@query("i3_requests_chunks", """WITH n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS p FROM conversations)
    SELECT p // 9 AS chunk, md5('Lines.' || chr(10) || chr(10) || string_agg((p % 9 + 1) || '. ' || regexp_replace(text, '\\s*\\n\\s*', ' ', 'g'), chr(10) ORDER BY p)) AS h FROM n GROUP BY 1""")
def i3(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("line"))
    return A.requests_chunks(G.chunk_in_order(lines, 9, "conv_id", "turn"), "Lines.").select("chunk", F.md5("content").alias("h"))


@query("i4_requests_groups", """WITH g AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body, row_number() OVER (ORDER BY conv_id) - 1 AS p FROM conversations GROUP BY 1)
    SELECT p // 8 AS chunk, md5('Groups.' || chr(10) || chr(10) || string_agg((p % 8 + 1) || '.' || chr(10) || body, chr(10) || chr(10) ORDER BY p)) AS h FROM g GROUP BY 1""")
def i4(spark, d):
    c = table(spark, d, "conversations")
    groups = G.chunk_in_order(c.select("conv_id").distinct(), 8, "conv_id")
    lines = groups.join(c.select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("line")), "conv_id")
    return A.requests_groups(lines, "Groups.").select("chunk", F.md5("content").alias("h"))


@query("i5_requests_template", "SELECT c_custkey, 'You are ' || c_name || ' of ' || c_mktsegment || '.' AS content FROM customer")
def i5(spark, d):
    return A.requests_template(table(spark, d, "customer"), "You are {c_name} of {c_mktsegment}.", ["c_name", "c_mktsegment"]).select("c_custkey", "content")


def measure(contents):
    """Stands for a model: answers with the number of characters; cannot read a request whose length is divisible by 97,
    and answers one short where a batch holds one of a length divisible by 89."""
    if any(len(c) % 97 == 0 for c in contents):
        raise RuntimeError("cannot read")
    return ['{"n": %d}' % len(c) for c in contents][len(contents) > 1 and any(len(c) % 89 == 0 for c in contents):]


_ASKED = "length(text) + length('P' || chr(10) || chr(10) || 'THE TEXT' || chr(10) || chr(10))"


@query("i6_infer", f"SELECT 't' || doc_id AS custom_id, CASE WHEN ({_ASKED}) % 97 <> 0 THEN {_ASKED} END AS n, ({_ASKED}) % 97 = 0 AS failed FROM documents")
def i6(spark, d):
    got = A.infer(A.requests_text(texts(spark, d), "P"), measure, pause=0)
    return got.select("custom_id", F.get_json_object("raw", "$.n").cast("long").alias("n"), F.col("error").isNotNull().alias("failed"))


def forgotten(contents):
    """Stands for a model that must not be asked again."""
    return ['{"n": -1}' for _ in contents]


@query("i6_infer_logged", f"SELECT 't' || doc_id AS custom_id, CASE WHEN ({_ASKED}) % 97 <> 0 THEN {_ASKED} ELSE -1 END AS n, false AS failed FROM documents")
def i6_logged(spark, d):
    """Every request, asked twice with one log: the second model is asked only what the first could not answer."""
    requests, log = A.requests_text(texts(spark, d), "P"), scratch(spark, "answers")
    A.infer_logged(requests, measure, log, pause=0).write.format("noop").mode("overwrite").save()
    got = A.infer_logged(requests, forgotten, log, pause=0)
    return got.select("custom_id", F.get_json_object("raw", "$.n").cast("long").alias("n"), F.col("error").isNotNull().alias("failed"))


# ---- answers ----------------------------------------------------------------------------------------
STEP, LONG = 400, 60


def quote_answers(spark, d):
    """An answer per text: a stretch at every 400th character of the whole text as written, one quote in no text, one of
    a wrong kind, a number, a list; for a seventh of the texts something unreadable, for another an empty list."""
    x = texts(spark, d)
    at = F.sequence(F.lit(0), F.floor(F.length("text") / STEP).cast("int"))
    own = F.filter(F.transform(at, lambda i: F.btrim(F.substring(F.col("text"), i * STEP + 1, F.lit(LONG)), F.lit(" \t\r\n"))), lambda q: F.length(q) >= 4)
    good = F.transform(own, lambda q: F.to_json(F.struct(F.lit("is").alias("kind"), q.alias("quote"))))
    extra = F.array(*map(F.lit, ('{"kind": "who", "quote": "zzqx wvvk zzqx wvvk"}', '{"kind": "bad", "quote": "x"}', "5", '["a"]', '{"kind": "is", "quote": 7}', '"{zzqx wvvk} zzqx"')))
    listed = F.concat(F.lit("Here:\n{\"quotes\": ["), F.array_join(F.concat(good, extra), ", "), F.lit("]}\n"))
    raw = F.when(F.col("text_id") % 7 == 3, "I cannot say {").when(F.col("text_id") % 7 == 5, '{"quotes": []}').otherwise(listed)
    return x.select("text_id", raw.alias("raw"))


QA = f"""{TEXTS}, qa AS (SELECT text_id, text, unnest(range(0, length(text) // {STEP} + 1)) AS i FROM texts WHERE text_id % 7 NOT IN (3, 5)),
    q AS (SELECT text_id, text, trim(substr(text, (i * {STEP} + 1)::BIGINT, {LONG}), {SPACE_SQL}) AS q FROM qa)"""


@query("i7_ingest_quotes_kept", f"WITH {QA} SELECT text_id, 'is' AS kind, instr(text, q) - 1 AS start, instr(text, q) - 1 + length(q) AS \"end\", q AS quote, 'exact' AS match FROM q WHERE length(q) >= 4")
def i7(spark, d):
    k, _ = A.ingest_quotes(A.parse_quotes(quote_answers(spark, d)), texts(spark, d), hold=True)
    return k.select("text_id", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "quote", "match")


_BAD = [("who", "zzqx wvvk zzqx wvvk", "not in the text"), ("bad", "x", "malformed"), ("", "5", "malformed"), ("", '["a"]', "malformed"), ("is", '{"kind":"is","quote":7}', "malformed"), ("", "{zzqx wvvk} zzqx", "not in the text")]


@query("i7_ingest_quotes_dropped", "SELECT doc_id AS text_id, kind, given, why FROM documents, (VALUES " + ", ".join(f"('{k}', '{g}', '{w}')" for k, g, w in _BAD) + ") v(kind, given, why) WHERE doc_id % 7 NOT IN (3, 5) "
       "UNION ALL SELECT doc_id, '', 'I cannot say {', 'unreadable' FROM documents WHERE doc_id % 7 = 3")
def i7b(spark, d):
    return A.ingest_quotes(A.parse_quotes(quote_answers(spark, d)), texts(spark, d), hold=True)[1].select("text_id", "kind", "given", "why")


@query("i7_quote_records", f"""WITH {QA}, k AS (SELECT text_id, count(*) AS n, string_agg(instr(text, q) - 1, ',' ORDER BY instr(text, q)) AS starts FROM q WHERE length(q) >= 4 GROUP BY 1)
    SELECT doc_id AS text_id, n AS quotes, starts, CASE doc_id % 7 WHEN 3 THEN 1 ELSE 6 END AS dropped FROM documents LEFT JOIN k ON k.text_id = doc_id WHERE doc_id % 7 <> 5""")
def i7c(spark, d):
    r = A.quote_records(*A.ingest_quotes(A.parse_quotes(quote_answers(spark, d)), texts(spark, d), hold=True))
    return r.select("text_id", F.size("quotes").cast("long").alias("quotes"), F.array_join(F.transform("quotes", lambda q: q["start"].cast("string")), ",").alias("starts"), F.size("dropped").alias("dropped"))


def turn_lines(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("text_id"), (F.col("turn") + 1).cast("int").alias("no"), F.col("text").alias("line"), (F.col("turn") * 1000).alias("start"))


@query("i8_ingest_labels", """WITH w AS (SELECT conv_id, turn, text, regexp_extract(text, '[A-Za-zÀ-ÿ]{5,}', 0) AS lab FROM conversations) SELECT conv_id AS text_id, turn * 1000 + instr(text, lab) - 1 AS start, turn * 1000 + instr(text, lab) - 1 + length(lab) AS "end", lab AS label FROM w WHERE lab <> ''""")
def i8(spark, d):
    lines = turn_lines(spark, d)
    lab = F.regexp_extract("line", "[A-Za-zÀ-ÿ]{5,}", 0)
    m = lines.withColumn("lab", lab).filter("lab <> ''").groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("no").cast("string"), F.array("lab", F.lit("zz none zz"))))).alias("m"))
    answers = m.select("text_id", F.to_json("m").alias("raw"))
    kept_, _ = A.ingest_labels(answers, lines)
    return kept_.select("text_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label")


def label_answers(spark, d):
    """Per conversation an object of line numbers to labels; of a fifth of them something unreadable."""
    lab = F.regexp_extract("line", "[A-Za-zÀ-ÿ]{5,}", 0)
    m = turn_lines(spark, d).withColumn("lab", lab).groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("no").cast("string"), F.array("lab", F.lit("zz none zz"))))).alias("m"))
    return m.select("text_id", F.when(F.col("text_id") % 5 == 2, "no labels").otherwise(F.to_json("m")).alias("raw"))


@query("i8_labels_accounted", """SELECT conv_id AS text_id, count(*) FILTER (conv_id % 5 <> 2) AS kept, count(*) FILTER (conv_id % 5 <> 2) + max((conv_id % 5 = 2)::INT) AS dropped
    FROM conversations GROUP BY 1""")
def i8b(spark, d):
    """Kept, dropped and unreadable labels are all there are: one of each two stands in its line."""
    kept_, dropped = A.ingest_labels(label_answers(spark, d).withColumn("raw", F.regexp_replace("raw", '\\[""', '["e"')), turn_lines(spark, d).withColumn("line", F.concat(F.lit("e "), "line")))
    n = lambda df, name: df.groupBy("text_id").agg(F.count(F.lit(1)).alias(name))
    ids = table(spark, d, "conversations").select(F.col("conv_id").alias("text_id")).distinct()
    return ids.join(n(kept_, "kept"), "text_id", "left").join(n(dropped, "dropped"), "text_id", "left").na.fill(0)


@query("g2_h1_role_labels", f"WITH {TEXTS}, {LABELS} SELECT text_id, start, e AS \"end\", norm, CASE WHEN bool_or(source = 'quote') THEN 'quote' ELSE 'line' END AS source FROM (SELECT * FROM labels2 UNION ALL SELECT text_id, start, e, label, norm, 'line' FROM labels2 WHERE source = 'quote') GROUP BY 1, 2, 3, 4")
def h1(spark, d):
    l = labels(spark, d).select("text_id", "start", "end", "label", "source")
    quote, line = l.filter("source = 'quote'").drop("source"), l.drop("source")
    r = A.role_labels({"quote": quote, "line": line})
    return r.select("text_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "norm", "source")


def inhabitants(spark, d):
    x = texts(spark, d).withColumn("n", F.col("text_id") % 4)
    one = F.struct(F.lit("the keeper").alias("called"), F.array(F.lit("old tenders"), F.lit("Wardens of ash")).alias("names"), F.array(F.lit("1"), F.lit("2"), F.lit("99999")).alias("role"), F.array(F.lit("x"), F.lit("1")).alias("cost"))
    two = F.struct(F.lit("someone").alias("called"), F.array(F.lit("someone")).alias("names"), F.array().cast("array<string>").alias("role"), F.array(F.lit("2")).alias("cost"))
    inh = F.when(F.col("n") == 1, F.array(one)).when(F.col("n") == 2, F.array(one, two)).otherwise(F.slice(F.array(one), 1, 0))
    raw = F.when(F.col("n") == 0, "cannot say").otherwise(F.to_json(F.struct(inh.alias("inhabitants"))))
    return x.select("text_id", raw.alias("raw"))


NS = f"ns AS (SELECT text_id, count(*) AS k FROM piece WHERE trim(p[k], {SPACE_SQL} || '-*_#=|') <> '' GROUP BY 1)"


@query("i9_ingest_beings", f"""WITH {SENT_SQL}, {NS}, b AS (SELECT text_id, place, sum(1) OVER (ORDER BY text_id, place) AS id FROM (SELECT text_id, unnest(range(0, CASE text_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END)) AS place FROM texts))
    SELECT id::BIGINT AS id, text_id, CASE place WHEN 0 THEN 'keeper tender warden' ELSE '' END AS words, CASE place WHEN 0 THEN least(2, coalesce(k, 0)) ELSE 0 END AS n_role, CASE WHEN place = 0 THEN least(1, coalesce(k, 0)) WHEN coalesce(k, 0) >= 2 THEN 1 ELSE 0 END AS n_cost FROM b LEFT JOIN ns USING (text_id)""")
def i9(spark, d):
    b, _, _ = A.ingest_beings(inhabitants(spark, d), texts(spark, d))
    return b.select("id", "text_id", F.array_join("words", " ").alias("words"), "n_role", "n_cost")


@query("i9_f56_care_texts", "SELECT CASE doc_id % 4 WHEN 0 THEN NULL WHEN 3 THEN 0 ELSE doc_id % 4 END AS n_beings, count(*) AS texts FROM documents GROUP BY 1")
def i9b(spark, d):
    from spanloom.operators.beings import beings_per_text
    return beings_per_text(A.ingest_beings(inhabitants(spark, d), texts(spark, d))[2])


@query("i10_ingest_nouns", "SELECT p_partkey, split_part(p_name, ' ', 2) AS nouns FROM part")
def i10(spark, d):
    names_ = table(spark, d, "part").select("p_partkey", F.floor(F.col("p_partkey") / 50).alias("chunk"), (F.col("p_partkey") % 50 + 1).cast("int").alias("no"), F.concat(F.lit("keepers of the "), "p_name").alias("name"))
    noun = F.element_at(F.split("name", " "), -1)
    answers = names_.groupBy("chunk").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("no").cast("string"), F.array(F.upper(noun), F.lit("keeper"), F.lit("zz")))))).alias("raw"))
    got = A.ingest_nouns(answers, names_.select("chunk", "no", F.concat("name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("name")))
    return got.select(F.split_part("name", F.lit("#"), F.lit(2)).cast("long").alias("p_partkey"), F.array_join("nouns", ",").alias("nouns"))


@query("i10_ingest_sides", "SELECT p_partkey AS being_id, split_part(p_name, ' ', 2) AS \"for\", lower(p_type) AS against FROM part")
def i10b(spark, d):
    """Nouns in capitals, one that stands nowhere, a blank and a number."""
    g = table(spark, d, "part").select(F.col("p_partkey").alias("being_id"), F.floor(F.col("p_partkey") / 50).alias("chunk"), (F.col("p_partkey") % 50 + 1).cast("int").alias("no"),
                                       F.concat(F.lit("It keeps the "), "p_name", F.lit(". It fights the "), "p_type", F.lit(".")).alias("hay"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("n"), "p_type")
    said = F.struct(F.array(F.upper("n"), F.lit("zz none"), F.lit(" ")).alias("for"), F.array(F.col("p_type"), F.lit("7777")).alias("against"))
    answers = g.groupBy("chunk").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("no").cast("string"), said)))).alias("raw"))
    got = A.ingest_sides(answers, g.select("chunk", "no", "being_id", "hay"))
    return got.select("being_id", F.array_join("for", ",").alias("for"), F.array_join("against", ",").alias("against"))


@query("i11_ingest_levels", f"{WITH_BEINGS} SELECT id AS text_id, CASE WHEN n_fate > 0 THEN 'is' WHEN n_cost > 0 THEN 'alive' WHEN n_role > 0 THEN 'part' ELSE 'in' END AS level FROM beings")
def i11(spark, d):
    def arr(c):
        return F.filter(F.sequence(F.lit(0), F.col(c)), lambda x: x > 0)
    raw = F.concat(F.lit("So: "), F.to_json(F.struct(arr("n_role").alias("part"), arr("n_cost").alias("alive"), arr("n_fate").alias("is"))))
    return A.ingest_levels(beings(spark, d).select(F.col("id").alias("text_id"), raw.alias("raw"), F.lit(5).alias("n"))).select("text_id", "level")


@query("i12_ingest_voice", "SELECT c_custkey AS being_id, CASE WHEN c_custkey % 2 = 0 THEN 'keeper' ELSE 'narrator' END AS i, 'none' AS you FROM customer")
def i12(spark, d):
    g = table(spark, d, "customer").select(F.col("c_custkey").alias("being_id"), F.floor(F.col("c_custkey") / 6).alias("chunk"), (F.col("c_custkey") % 6 + 1).cast("int").alias("no"))
    one = F.struct(F.when(F.col("being_id") % 2 == 0, "keeper").otherwise("narrator").alias("i"), F.lit("none").alias("you"))
    answers = g.groupBy("chunk").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("no").cast("string"), one)))).alias("raw"))
    return A.ingest_voice(answers, g)


@query("i13_batch_register", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'open' END AS status FROM orders")
def i13(spark, d):
    o = table(spark, d, "orders")
    reg = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"))
    return A.batch_register(reg, o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("failed").alias("status")))


@query("f54_answer_accounting", "SELECT o_orderpriority AS batch, count(*) AS answers, count(*) FILTER (o_orderstatus = 'P') AS unreadable, sum(o_orderkey % 3)::BIGINT AS dropped, sum(o_custkey)::BIGINT AS tokens_in, sum(o_orderkey)::BIGINT AS tokens_out, round(sum(o_orderkey % 100 / 8), 3) AS cost FROM orders GROUP BY ROLLUP (o_orderpriority)")
def f54(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("batch"), F.when(F.col("o_orderstatus") == "P", "bad").alias("error"), (F.col("o_orderkey") % 3).alias("n_dropped"),
                                         F.col("o_custkey").alias("tokens_in"), F.col("o_orderkey").alias("tokens_out"), (F.col("o_orderkey") % 100 / 8).alias("cost"))
    return A.answer_accounting(o)


@query("i14_missing_quotes", f"WITH {TEXTS} SELECT text_id AS being_id, 'role' AS question, 'zzqx wvvk' AS part FROM (SELECT text_id, unnest(string_split(text, chr(10))) FROM texts WHERE text_id % 10 = 0)")
def i14(spark, d):
    """Every line of every text is a claim; in a tenth of the texts each claim also has words that stand nowhere."""
    x = texts(spark, d)
    plain = F.translate("text", "/", "")
    claims = x.select(F.col("text_id").alias("being_id"), F.lit("role").alias("question"), F.explode(F.split(plain, "\n")).alias("line"))
    claims = claims.select("being_id", "question", F.concat("line", F.when(F.col("being_id") % 10 == 0, " / zzqx wvvk").otherwise("")).alias("quote"))
    sents = x.select(F.col("text_id").alias("being_id"), F.lit("role").alias("question"), F.lit(1).alias("no"), plain.alias("sentence"))
    return A.missing_quotes(claims, sents).select("being_id", "question", "part")


@query("i14_missing_figures", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 1")
def i14b(spark, d):
    """A claim per customer, checked against the accounts of its nation's question, five in all for a nation."""
    c = table(spark, d, "customer").withColumn("question", (F.col("c_nationkey") % 5).cast("string"))
    number = (F.col("c_custkey") + 1000000).cast("string")
    claims = c.select(F.col("c_custkey").alias("id"), "question", F.col("c_mktsegment").alias("key"), F.array(number, F.lit("100")).alias("numbers"))
    lines = c.select("question", F.concat_ws(" ", F.lit("of"), F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, number), F.lit("in 100")).alias("line"))
    return A.missing_figures(claims, lines).select("id")


@query("i15_resolve_refs", "SELECT o_orderkey AS note_id, 'A' AS part, o_custkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def i15(spark, d):
    notes = table(spark, d, "orders").select(F.col("o_orderkey").alias("note_id"), F.concat(F.lit("see A "), F.col("o_custkey").cast("string"), F.lit(" and B 7.")).alias("note"))
    samples = table(spark, d, "customer").filter("c_nationkey < 10").select(F.lit("A").alias("part"), F.col("c_custkey").alias("id"))
    return A.resolve_refs(notes, samples).select("note_id", "part", "id")


@query("e22_side_by_side", "SELECT c.conv_id AS being_id, c.turn AS no, coalesce(string_agg(s.text, chr(10) ORDER BY s.turn), '') AS said FROM conversations c LEFT JOIN conversations s ON s.conv_id = c.conv_id AND s.role = CASE WHEN c.turn % 2 = 1 THEN 'user' ELSE 'assistant' END GROUP BY 1, 2")
def e22(spark, d):
    """Every turn as an answer part: odd ones beside what the user said, even ones beside the assistant."""
    c = table(spark, d, "conversations")
    parts = c.select(F.col("conv_id").alias("being_id"), F.col("turn").alias("no"), F.col("text").alias("body"))
    said = c.select(F.col("conv_id").alias("being_id"), F.col("role").alias("question"), F.col("turn").alias("no"), F.col("text").alias("sentence"))
    turns = range(1 + (c.agg(F.max("turn")).first()[0] or 0))
    both = A.side_by_side(parts.withColumn("no", F.col("no").cast("int")), said, {n: ["user" if n % 2 else "assistant"] for n in turns})
    return both.select("being_id", F.col("no").cast("long").alias("no"), "said")


_HIT = chr(92) + "b[Tt]he[ ]+[a-z]+s" + chr(92) + "b"


@query("i2_uncovered_lines", f"""WITH {HEADS_SQL}, {sentences_at_sql('pt')}, lines AS (SELECT text_id, p[k] AS line, coalesce(list_sum(list_transform(p[1:k-1], lambda x: length(x) + 1)), 0)::BIGINT AS start FROM pl),
    qt AS (SELECT text_id, start, start + length(line) AS e FROM lines WHERE length(line) >= 200 AND text_id % 2 = 0),
    hd AS (SELECT h.text_id, h.start, h.start + length(line) AS e FROM heads h JOIN lines USING (text_id, start) WHERE title <> ''),
    ac AS (SELECT text_id, translate(text, '{ACCENTED}', '{'0' * len(ACCENTED)}') AS t FROM pt),
    ht AS (SELECT text_id, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS start, length(m[i]) AS n
        FROM (SELECT text_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT text_id, string_split_regex(t, '{_HIT}') AS g, regexp_extract_all(t, '{_HIT}') AS m FROM ac))),
    fr AS (SELECT * FROM ht h WHERE NOT EXISTS (SELECT 1 FROM qt q WHERE q.text_id = h.text_id AND q.start <= h.start AND h.start + h.n <= q.e)),
    al AS (SELECT DISTINCT s.text_id, s.start, s.e, 'sentence' AS why FROM fr JOIN sat s ON s.text_id = fr.text_id AND s.start <= fr.start AND fr.start < s.e UNION ALL SELECT DISTINCT *, 'heading' FROM hd),
    ok AS (SELECT text_id, start, e, min(why) AS why FROM al a WHERE NOT EXISTS (SELECT 1 FROM qt q WHERE q.text_id = a.text_id AND q.start <= a.start AND a.e <= q.e) GROUP BY 1, 2, 3)
    SELECT text_id, start, e AS "end", substr(text, start + 1, e - start) AS line, why FROM ok JOIN pt USING (text_id) WHERE e - start <= 700 AND trim(substr(text, start + 1, e - start), {SPACE_SQL}) <> ''""")
def lines2(spark, d):
    """Headings and sentences with a hit that no quote covers, of the pages."""
    t = page_texts(spark, d)
    heads = t.select("text_id", "text", F.inline(S.headings("text"))).withColumn("end", F.col("start") + F.length(F.split_part(F.substring("text", F.col("start") + 1, F.length("text")), F.lit("\n"), F.lit(1))))
    hits = t.select("text_id", F.inline(S.find_spans("text", r"\b[Tt]he[ ]+[a-z]+s\b")))
    sents = t.select("text_id", F.inline(S.sentences("text", keep_markers=True)))
    q = page_quotes(spark, d).select("text_id", "start", "end").filter("text_id % 2 = 0")
    return A.uncovered_lines(t, heads.select("text_id", "start", "end"), hits, sents, q).select("text_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "line", "why")


@query("j1_answers_table", """WITH a AS (SELECT conv_id AS text_id, turn AS seq, 'b' || (turn // 2) AS batch, CASE WHEN role = 'assistant' THEN text END AS raw FROM conversations WHERE turn // 2 <> 1)
    SELECT text_id, seq, batch, raw FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY (raw IS NOT NULL) DESC, seq DESC, batch DESC) AS rn FROM a) WHERE rn = 1""")
def j1(spark, d):
    """The log of the stream's own step, in two micro-batches that overlap in texts and batches; batch b1 was done before."""
    from functools import reduce
    done = spark.createDataFrame([("b1",)], "batch string")
    logs = [taken(turn_answers(spark, d).filter(F.col("seq") % 2 == part), done)[0] for part in (0, 1)]
    return latest(reduce(lambda x, y: x.unionByName(y), logs)).select("text_id", "seq", "batch", "raw")


@query("j1_batch_counts", """SELECT 'b' || (turn // 2) AS batch, count(*) AS answers, count(*) FILTER (role <> 'assistant') AS unreadable FROM conversations WHERE turn // 2 <> 1 GROUP BY 1""")
def j1b(spark, d):
    return taken(turn_answers(spark, d), spark.createDataFrame([("b1",)], "batch string"))[1]


def turn_answers(spark, d):
    return as_answers(table(spark, d, "conversations"))


def as_answers(turns):
    return turns.select(F.col("conv_id").alias("text_id"), F.concat(F.lit("b"), F.floor(F.col("turn") / 2).cast("string")).alias("batch"), F.col("turn").alias("seq"),
                                                   F.when(F.col("role") == "assistant", F.col("text")).alias("raw"), F.lit(None).cast("string").alias("error"))


def streamed_answers(spark, d):
    """The turns as a stream, in the shape of answer files. The pattern fits a folder of files as well as one file."""
    stream = spark.readStream.schema(table(spark, d, "conversations").schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{d}/conversation[s].parquet")
    return as_answers(stream)


@query("j1_stream_answers", """WITH a AS (SELECT conv_id AS text_id, turn AS seq, 'b' || (turn // 2) AS batch, CASE WHEN role = 'assistant' THEN text END AS raw FROM conversations WHERE turn // 2 <> 1)
    SELECT text_id, seq, batch, raw FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY (raw IS NOT NULL) DESC, seq DESC, batch DESC) AS rn FROM a) WHERE rn = 1""")
def j1_stream(spark, d):
    """A stream over all turns writes the log, which is read; a second call with the same checkpoint adds nothing."""
    at, done = scratch(spark, "stream"), spark.createDataFrame([("b1",)], "batch string")
    for _ in range(2):
        follow(streamed_answers(spark, d), at + "/log", at + "/checkpoint", done)
    return answers_now(spark, at + "/log").select("text_id", "seq", "batch", "raw")


_EARLY = "(SELECT conv_id AS text_id, turn, 'b' || (turn // 2) AS batch, CASE WHEN role = 'assistant' THEN text END AS raw FROM conversations)"


@query("j1_stream_skips_answered", f"""WITH a AS {_EARLY}, done AS (SELECT DISTINCT text_id FROM a WHERE turn < 3 AND raw IS NOT NULL),
    log AS (SELECT * FROM a WHERE turn < 3 UNION ALL SELECT a.* FROM a ANTI JOIN done USING (text_id)),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY (raw IS NOT NULL) DESC, turn DESC, batch DESC) AS rn FROM log) WHERE rn = 1)
    SELECT text_id, turn AS seq, batch, raw, (SELECT count(*) FROM a WHERE turn < 3)::BIGINT + (SELECT count(*) FROM a ANTI JOIN done USING (text_id)) AS answers FROM one""")
def j1_skips(spark, d):
    """A first stream reads the turns before the third; a second, with a checkpoint of its own, reads all and skips every
    text that the first has answered. ``answers`` counts the rows that both took."""
    at = scratch(spark, "stream")
    follow(streamed_answers(spark, d).filter("seq < 3"), at + "/log", at + "/first", skip_answered=True)
    follow(streamed_answers(spark, d), at + "/log", at + "/second", skip_answered=True)
    taken_rows = counts_now(spark, at + "/log").agg(F.sum("answers").alias("answers"))
    return answers_now(spark, at + "/log").select("text_id", "seq", "batch", "raw").crossJoin(taken_rows)
