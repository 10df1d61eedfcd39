"""Answers, samples, tables: small cases with known results."""
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import answers as A, beings as B, evaluate as E, sampling as G
from spanloom.operators.registry import REGISTRY, registry_table, stoplist_table


def test_latest_answer_does_not_depend_on_order(spark):
    rows = [(1, 1, "good"), (1, 2, None), (2, 1, None), (2, 2, "late"), (3, 1, None), (4, 1, "a"), (4, 2, "b")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "text_id int, seq int, raw string")
        got = {r.text_id: r.raw for r in G.latest_answers(df, "text_id", F.col("raw").isNotNull(), "seq").collect()}
        assert got == {1: "good", 2: "late", 3: None, 4: "b"}


def test_contrast_is_zero_for_a_constant(spark):
    df = spark.createDataFrame([(g, s, 1.0) for g in range(5) for s in (True, False) for _ in range(9)], "g int, s boolean, v double")
    assert B.within_contrast(df, "g", F.col("s"), "v").first().points == 0.0
    few = df.filter("g > 0").unionByName(df.filter("g = 0 and s").limit(7))
    assert B.within_contrast(few, "g", F.col("s"), "v").first().groups == 4


def test_pairs_across_equals_all_pairs(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(12), sorted(r.sample("abcde", r.randrange(0, 4)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text_id long, words array<string>")
    want = {}
    for x, y in itertools.combinations(rows, 2):
        if x[1] == y[1]:
            for p in {tuple(sorted((a, b))) for a in x[2] for b in y[2] if a != b}:
                want[(x[1], *p)] = want.get((x[1], *p), 0) + 1
    assert {(z.text_id, z.a, z.b): z.n for z in B.pairs_across(df).collect()} == want


def test_equal_groups_equal_a_sorted_list(spark):
    r = random.Random(7)
    rows = [(r.randrange(20), r.random() < 0.4) for _ in range(333)]
    got = G.equal_groups(spark.createDataFrame(rows, "n int, y boolean"), "n", 8, ("y",)).orderBy("grp").collect()
    rows.sort()
    k = len(rows) // 8
    for i, g in enumerate(got):
        part = rows[i * k:(i + 1) * k]
        assert (g.n, g.low, g.high) == (k, part[0][0], part[-1][0])
        assert abs(g.y_pct - 100 * sum(y for _, y in part) / k) <= 0.0501


def test_plurals(spark):
    words = ["memories", "memory", "leaves", "leaf", "knives", "knife", "boxes", "box", "moss", "channels", "channel", "glass", "waves", "wave", "orphans"]
    df = spark.createDataFrame([(w,) for w in words], "noun string")
    got = {r.noun: r.base for r in B.fold_plural(df, df).collect()}
    assert got == {**{w: w for w in words}, "memories": "memory", "leaves": "leaf", "knives": "knife", "boxes": "box", "channels": "channel", "waves": "wave"}


def test_precision_needs_twenty(spark):
    rows = [("p", t, 0, 5, "b" if t % 4 else "x") for t in range(20)] + [("q", t, 0, 5, "b") for t in range(19)] + [("p", 99, 50, 60, "x")]
    v = spark.createDataFrame(rows, "pattern string, text long, start int, end int, verdict string")
    m = spark.createDataFrame([(p, t, 2, 9) for p in "pq" for t in range(20)], "pattern_id string, text_id long, start int, end int")
    heirs = spark.createDataFrame([("q", "r")], "source string, target string")
    live = spark.createDataFrame([("p",), ("q",)], "id string")
    got = {r.pattern_id: r for r in E.pattern_eval(v, m, heirs, live).collect()}
    assert (got["p"].n_read, got["p"].precision, got["p"].n_gone, got["p"].n_gone_not) == (20, 0.75, 1, 1)
    assert (got["q"].n_read, got["q"].precision) == (19, None)


def test_quotes_ingest(spark):
    text = "The keepers walk at night. They carry lamps to the old wells by the gate."
    raws = [json.dumps({"quotes": [{"kind": "is", "quote": "They carry lamps"}, "The keepers  walk", {"kind": "zz", "quote": "x"}, {"kind": "is", "quote": "no such thing"}, {"kind": "is"}]}),
            "no json", 'So: ["They carry lamps", "unknown words are here now"]']
    answers = spark.createDataFrame(list(enumerate(raws)), "text_id long, raw string")
    texts = spark.createDataFrame([(i, text) for i in range(3)], "text_id long, text string")
    kept, dropped = A.ingest_quotes(A.parse_quotes(answers), texts)
    assert sorted((r.text_id, r.match, r.quote) for r in kept.collect()) == [
        (0, "exact", "They carry lamps"), (0, "folded", "The keepers walk"), (2, "exact", "They carry lamps")]
    assert sorted((r.text_id, r.why) for r in dropped.collect()) == [(0, "malformed"), (0, "malformed"), (0, "not in the text"), (1, "unreadable"), (2, "not in the text")]


def test_quotes_ingest_leaves_out_no_place(spark):
    """Quotes that stand beyond the first places of their three rarest long words, or hold no long word, are not dropped."""
    far = "The old keepers of the marshes carried seven lanterns home at dusk."
    many = "Keepers slept. Marshes froze hard. Lanterns went out in rain. Seven carried nothing. " * 6
    rare = "Harbour folk sang under crooked rafters. Copper bells rang. Granite steps sank. " + "Rain fell. " * 15 + "Velvet moss spread over every single floor they had left behind in the ruins. " * 2
    short = "We sat by the low red inn on the far bank of the sea."
    told = [(many + far, "the old keepers of the marshes carried seven lanterns back at dusk", far),
            (rare, "velvet moss harbour spread over every copper single floor they had left granite behind in the ruins",
             "Velvet moss spread over every single floor they had left behind in the ruins."),
            (short, "we sat by the low red pub on the far bank of the sea", short),
            (many, "the old keepers of the marshes carried seven lanterns back at dusk", None)]
    answers = spark.createDataFrame([(i, json.dumps([q])) for i, (_, q, _) in enumerate(told)], "text_id long, raw string")
    texts = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(told)], "text_id long, text string")
    kept, dropped = A.ingest_quotes(A.parse_quotes(answers), texts)
    assert sorted((r.text_id, r.match, r.quote, r.given) for r in kept.collect()) == [(i, "fuzzy", want, q) for i, (_, q, want) in enumerate(told) if want]
    assert [(r.text_id, r.given, r.why) for r in dropped.collect()] == [(3, told[3][1], "not in the text")]


def test_labels_ingest(spark):
    lines = spark.createDataFrame([(1, 1, "the “Moss” wardens", 10), (1, 2, "a bell", 40)], "text_id long, no int, line string, start int")
    answers = spark.createDataFrame([(1, 'x {"1": ["MOSS", "\\"moss\\"", "gone"], "2": "bell", "9": ["a"], "k": []}')], "text_id long, raw string")
    kept, dropped = A.ingest_labels(answers, lines)
    assert sorted((r.start, r.end, r.label) for r in kept.collect()) == [(14, 20, "“Moss”"), (15, 19, "Moss")]
    assert dropped.count() == 4


def test_beings_ingest(spark):
    text = "One here. Two here. Three here."
    raw = json.dumps({"inhabitants": [{"called": "the keeper", "names": ["old tenders"], "role": [1, "2", 7, "x", 1], "fate": [3]}, {"called": None, "names": None}]})
    answers = spark.createDataFrame([(1, raw), (2, "??"), (3, '{"inhabitants": []}')], "text_id long, raw string")
    texts = spark.createDataFrame([(i, "lab/m", text) for i in (1, 2, 3)], "text_id long, model string, text string")
    b, s, c = A.ingest_beings(answers, texts)
    assert [(r.id, list(r.words), r.n_role, r.n_fate) for r in b.orderBy("id").collect()] == [(1, ["keeper", "tender"], 2, 1), (2, [], 0, 0)]
    assert sorted((r.question, r.no, text[r.start:r.end]) for r in s.collect()) == [("fate", 3, "Three here."), ("role", 1, "One here."), ("role", 2, "Two here.")]
    assert {r.text_id: r.n_beings for r in c.collect()} == {1: 2, 2: None, 3: 0}


def test_split_answers(spark):
    raw = "Intro.\n1. First\nmore\n**2)** Second\n**What has it cost** third\n5: last"
    row = spark.createDataFrame([(raw,)], "r string").select(A.split_answers("r").alias("p")).first()
    assert [(x.no, x.body) for x in row.p] == [(0, "Intro."), (1, "1. First\nmore"), (2, "**2)** Second"), (3, "**What has it cost** third"), (5, "5: last")]


def test_infer_keeps_errors(spark):
    def model(contents):
        if any("bad" in c for c in contents):
            raise RuntimeError("no")
        return ["ok"] * len(contents)
    reqs = spark.createDataFrame([("a", "good"), ("b", "bad")], "custom_id string, content string").repartition(2, "custom_id")
    got = {r.custom_id: (r.raw, r.error) for r in A.infer(reqs, model, tries=2).collect()}
    assert got["b"][0] is None and "RuntimeError" in got["b"][1]


def test_gates(spark):
    claims = spark.createDataFrame([(1, "cost", "They carry lamps / at night")], "being_id long, question string, quote string")
    good = spark.createDataFrame([(1, "cost", 1, "They *carry* lamps,"), (1, "cost", 2, "at night.")], "being_id long, question string, no int, sentence string")
    A.assert_quotes(claims, good)
    with pytest.raises(ValueError):
        A.assert_quotes(claims, good.filter("no = 1"))
    lines = spark.createDataFrame([("cost", "Body marked: 64 of 300, 65")], "question string, line string")
    fig = lambda nums: spark.createDataFrame([("cost", "body marked", nums)], "question string, key string, numbers array<string>")
    A.assert_figures(fig(["64", "65"]), lines)
    with pytest.raises(ValueError):
        A.assert_figures(fig(["6"]), lines)


def test_top_k_equals_full_sort(spark):
    r = random.Random(3)
    rows = [("hot" if i % 3 else "g%d" % (i % 7), r.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = sorted((x.g, x["rank"], x.i) for x in G.top_k(df, "g", 5, [F.desc("v"), F.asc("i")]).collect())
    want = [(g, k + 1, x[2]) for g in {x[0] for x in rows} for k, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))[:5])]
    assert got == sorted(want)


def test_anonymous_numbers(spark):
    items, keep = G.anonymise(spark.range(103).withColumnRenamed("id", "text_id"), "text_id", 5, "s")
    numbers = sorted(r.item for r in keep.collect())
    assert numbers == list(range(1000, 1103)) and "text_id" not in items.columns
    assert G.restore(items, keep).select("text_id").distinct().count() == 103


def test_record_verdicts_checks(spark):
    sample = spark.createDataFrame([("p", 1, 0, 3, 1), ("p", 2, 0, 3, 2)], "pattern string, text long, start int, end int, no int")
    done = sample.limit(0)
    with pytest.raises(ValueError):
        E.record_verdicts(sample, "b", done)
    with pytest.raises(ValueError):
        E.record_verdicts(sample, "bq", done)
    assert [r.verdict for r in E.record_verdicts(sample, "b x", done).orderBy("no").collect()] == ["b", "x"]


def test_registry_table(spark):
    t = registry_table(spark)
    assert t.count() == len(REGISTRY) == 56
    assert t.filter("yields = 'statement'").count() == 4
    assert stoplist_table(spark).select("name").distinct().count() == 3


def test_chunks_in_order_use_no_single_window(spark):
    from spanloom.operators import sampling
    from spanloom.plans.catalog import QUERIES
    rows = [(None if i % 11 == 0 else i * 37 % 50, i) for i in range(3000)] + [(1_000_000, i) for i in range(2500)]
    df = spark.createDataFrame(rows, "k long, t long").repartition(7)
    want = {r: (i // 9, i % 9 + 1) for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    got = sampling.chunk_in_order(df, 9, "k", "t").collect()
    assert len(got) == len(rows) and {(r.k, r.t): (r.chunk, r.no) for r in got} == want
    for name in ("i3_requests_chunks", "i4_requests_groups"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "xxhash64" not in plan, name


def scattered(spark, n=20_000):
    """Keys over all 64 bits, one null, and small values."""
    return spark.range(n).select(F.when(F.col("id") > 0, F.xxhash64("id")).alias("k"), (F.col("id") % 7).alias("v"))


def test_sums_before_keys_of_64_bits(spark):
    df = scattered(spark).repartition(9)
    rows = G.before(df, "k", "v", "ahead").collect()
    total, want = 0, {}
    for k, v in sorted(((r.k, r.v) for r in df.collect()), key=lambda x: (x[0] is not None, x[0])):
        want[k] = total
        total += v
    assert {r.k: r.ahead for r in rows} == want
    # no range holds much more than its share, and there is no other window over the rows
    sizes = [r["count"] for r in G.in_ranges(df, ["k"]).groupBy("_b").count().collect()]
    assert len(sizes) > G.RANGES * 0.9 and max(sizes) < 20 * 20_000 / G.RANGES


def test_chunks_in_order_of_scattered_keys(spark):
    df = scattered(spark, 3000).withColumn("t", F.col("v") * 10**15)
    df = df.unionByName(df.filter("v = 3"))
    rows = G.chunk_in_order(df, 7, "k", "t").collect()
    key = lambda r: (r.k is not None, r.k, r.t)
    ordered = sorted(rows, key=lambda r: (r.chunk, r.no))
    assert [key(r) for r in ordered] == sorted(map(key, rows))
    assert [(r.chunk, r.no) for r in ordered] == [(i // 7, i % 7 + 1) for i in range(len(rows))]
    assert G.chunk_in_order(df.limit(0), 7, "k").count() == 0


def test_equal_groups_of_many_distinct_keys(spark):
    df = scattered(spark, 5003).withColumn("m", F.col("v") == 2)
    rows = sorted((r.k if r.k is not None else -(1 << 70), r.m) for r in df.collect())
    got = {r.grp: (r.n, round(r.m_pct, 1)) for r in G.equal_groups(df, "k", 8, ("m",)).collect()}
    size = 5003 // 8
    assert got == {g: (size, round(100 * sum(m for _, m in rows[g * size:(g + 1) * size]) / size, 1)) for g in range(8)}


def test_distinct_texts_of_a_hot_name(spark):
    """A name in very many texts, over many ranges, with many nouns: exact, and no rows of nouns times texts."""
    texts = spark.range(40_000).select(F.lit("hot").alias("norm"), F.xxhash64("id").alias("text_id")).unionByName(
        spark.range(300).select(F.concat(F.lit("n"), (F.col("id") % 50).cast("string")).alias("norm"), F.xxhash64(F.col("id") * 131).alias("text_id"))).unionByName(
        spark.createDataFrame([("hot", None), ("n1", None)], "norm string, text_id long")).distinct()
    members = spark.range(100).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("noun"), F.lit("hot").alias("norm")).unionByName(
        spark.range(200).select(F.concat(F.lit("x"), (F.col("id") % 120).cast("string")).alias("noun"), F.concat(F.lit("n"), (F.col("id") % 50).cast("string")).alias("norm"))).distinct()
    want = {r.noun: r.n for r in members.join(texts, "norm").groupBy("noun").agg(F.countDistinct("text_id").alias("n")).collect()}
    got = B.distinct_texts(members, texts, "noun", "norm")
    assert {r.noun: r.texts for r in got.collect()} == want
    kept = members.groupBy("norm").agg(F.collect_list("noun").alias("nouns")).withColumn("words", F.array(F.lit("w")))
    rows = {r.noun: (r.texts, r.n_words, r.as_in) for r in B.kept_by_name(texts, kept).collect()}
    assert {k: v[0] for k, v in rows.items()} == {k: n for k, n in want.items() if n > 1} and rows["x3"][2].startswith("hot") and rows["x3"][1] == 1


def test_label_match_equals_all_pairs(spark):
    rng = random.Random(21)
    words = ["ash", "ash's", "the ash", "keepers", "lower stair", "42", "é", "x", "stair keepers", "ashen", "a-b", "", "keepers of ash", "lower"]
    pick = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    labels = spark.createDataFrame([(t, pick(), rng.choice(["quote", "line"])) for t in range(6) for _ in range(40)], "text_id int, label string, source string")
    verdicts = spark.createDataFrame([(t, pick(), "b") for t in range(8) for _ in range(15)], "text_id int, surface string, verdict string")
    fold = lambda c, kind: E.fold_compare(c, kind)
    l = labels.select(F.col("text_id").alias("t"), fold("label", "verdict").alias("l"), "source")
    v = verdicts.select("text_id", "surface", fold("surface", "verdict").alias("s"))
    every = v.join(l, (v.text_id == l.t) & ((F.col("s") == F.col("l")) | E.holds_word("l", "s") | ((F.col("l") != "") & E.holds_word("s", "l"))), "left")
    want = {(r.text_id, r.surface): (bool(r.a), bool(r.b)) for r in every.groupBy("text_id", "surface").agg(F.max(F.col("source") == "quote").alias("a"), F.max(F.col("l").isNotNull()).alias("b")).collect()}
    got = {(r.text_id, r.surface): (r.first, r.either) for r in E.match_label(verdicts, labels).collect()}
    assert got == want and any(a for a, _ in want.values()) and not all(b for _, b in want.values())
    asked = v.select("text_id", F.col("s").alias("_s")).distinct()
    near = E.candidate_pairs(asked, l.select(F.col("t").alias("text_id"), F.col("l").alias("_l")).distinct(), E.word_keys).select("text_id", "_s", "_l").distinct().count()
    assert near < asked.join(l.select(F.col("t").alias("text_id"), "l").distinct(), "text_id").count()

    hand = verdicts.select("text_id", F.col("surface").alias("label"))
    h, k = hand.select("text_id", "label", fold("label", "hand").alias("s")), labels.select(F.col("text_id").alias("t"), fold("label", "hand").alias("l"))
    loose = h.join(k, (h.text_id == k.t) & (F.col("l").contains(F.col("s")) | F.col("s").contains(F.col("l"))), "left")
    want = {(r.text_id, r.label): bool(r.f) for r in loose.groupBy("text_id", "label").agg(F.max(F.col("l").isNotNull()).alias("f")).collect()}
    assert {(r.text_id, r.label): r.found for r in E.match_loose(hand, labels).collect()} == want
