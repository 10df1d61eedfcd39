"""Span functions: offsets in code points, sentences, headings, marks."""
import itertools
import random
import re
import time

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from spanloom.functions import spans as S, text as T
from spanloom.operators import anchors as A, grounding as G

TEXTS = ["😀é the cats. The dogs’ “bones”—and\r\nthe rats", "", "x" * 49, "x" * 50, "no match here",
         "the as the bs the cs " * 200, "a﷐b the cats ﷑"]


def frame(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def test_find_spans_equals_finditer(spark):
    rx = r"\b([Tt]he)[ \t]+(?P<name>[a-z]+s)\b"
    for row in frame(spark, TEXTS).select("t", S.find_spans("t", rx, "name").alias("s"), S.find_spans("t", rx).alias("w")).collect():
        assert [(x.start, x.end) for x in row.s] == [m.span("name") for m in re.finditer(rx, row.t)]
        assert [(x.start, x.end) for x in row.w] == [m.span() for m in re.finditer(rx, row.t)]
        assert all(row.t[x.start:x.end] == x.surface for x in row.s)


def test_offsets_on_generated_texts(spark):
    @settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(alphabet="ab .\n😀é", max_size=400), min_size=20, max_size=40))
    def check(values):
        rows = frame(spark, values).select("t", S.find_spans("t", "a+(?P<name>b)?", 0).alias("s")).collect()
        for row in rows:
            assert [(x.start, x.end, x.surface) for x in row.s] == [(*m.span(), m[0]) for m in re.finditer("a+b?", row.t)]
    check()


def test_sentences(spark):
    text = ("Dr. Moss waits. “Here?” She left!\n# A Heading\n- \n***\nIt rained. then not. Last one")
    row = frame(spark, [text]).select(S.sentences("t").alias("a"), S.sentences("t", True).alias("b")).first()
    shown = [text[x.start:x.end] for x in row.a]
    assert shown == ["Dr.", "Moss waits.", "“Here?”", "She left!", "# A Heading", "It rained. then not.", "Last one"]
    assert [x.no for x in row.a] == list(range(1, 8))
    assert len(row.b) == len(row.a) + 2


def test_headings(spark):
    text = "# One #\n**Two**\n  **Three** They go.\n*Four*\n*Five* is said in a line\n1. __Six__:\nplain\n## \n"
    row = frame(spark, [text]).select(S.headings("t").alias("h")).first()
    assert [x.title for x in row.h] == ["One", "Two", "Three", "Four", "Six"]
    assert [text[x.start:x.start + 3] for x in row.h] == ["# O", "**T", "  *", "*Fo", "1. "]


def test_mask_keeps_length(spark):
    text = "# Head\nBody The Cap\n**Bold line**\nrest"
    row = frame(spark, [text]).select(S.mask_lines("t", r"^#.*$|^\*\*[^*\n]+\*\*$").alias("m")).first()
    assert row.m == "      \nBody The Cap\n" + " " * 13 + "\nrest"


def test_mark_spans(spark):
    spans = "array(named_struct('start',0,'end',5,'rank',1), named_struct('start',3,'end',8,'rank',2), named_struct('start',8,'end',9,'rank',2))"
    row = frame(spark, ["abcdefghijk"]).select(S.mark_spans("t", F.expr(spans)).alias("m"), S.kwic("t", F.lit(3), F.lit(5), 2).alias("k")).first()
    assert row.m == "{w:abc}[S:defghi]jk"
    assert row.k == "bc«de»fg"


def test_clean_and_flags(spark):
    cases = {"**The Moss-Wardens'**": "Moss-Wardens", " “the reed’s” ": "reed", "A": "A", "an  old\nname,": "old name"}
    rows = frame(spark, list(cases)).select("t", T.clean("t").alias("c")).collect()
    assert {r.t: r.c for r in rows} == cases
    flags = frame(spark, ["x" * 49, "of " * 30, "stone " * 20, "the of and a " * 9]).select(T.text_flag("t", F.lit(None).cast("string")).alias("f")).collect()
    assert [r.f for r in flags] == ["empty", "", "not prose (word check)", ""]
    assert frame(spark, ["a"]).select(T.text_flag("t", F.lit("broken")).alias("f")).first().f == "broken"


def test_locate(spark):
    text = ("It’s a *slow* place — full of hum. The keepers of the lower stair walk at night and carry lamps to the wells. "
            "Nobody saw them leave… or come back again.")
    quotes = ["The keepers of the lower stair", "it's a slow  place - full", "keepers of the lower stairs walk at night and carry a lamp to the wells",
              "leave... or come", "hum", "nothing like this stands in the text at all", "  ", "keepers near wells seldom shout loudly anywhere"]
    df = spark.createDataFrame([(i, text, q) for i, q in enumerate(quotes)], "i int, text string, quote string")
    got = {r.i: (r.match, text[r.start:r.end]) for r in G.locate(df, ["i"]).collect()}
    assert got[0] == ("exact", "The keepers of the lower stair")
    assert got[1] == ("folded", "It’s a *slow* place — full")
    assert got[2] == ("fuzzy", "The keepers of the lower stair walk at night and carry lamps to the wells.")
    assert got[3] == ("folded", "leave… or come")
    assert got[4] == ("exact", "hum")
    assert set(got) == {0, 1, 2, 3, 4}


def test_fuzzy_share_limit(spark):
    words = ["stone%d" % i for i in range(30)]
    text = " ".join(words) + "."
    ok, low = words[5:13] + ["zz", "yy"], words[5:12] + ["zz", "yy", "xx"]          # 0.8 and 0.7
    df = spark.createDataFrame([(0, text, " ".join(ok)), (1, text, " ".join(low)), (2, text, "stone1 zz stone2")], "i int, text string, quote string")
    rows = G.locate(df, ["i"]).collect()
    assert [(r.i, r.match) for r in rows] == [(0, "fuzzy")]


def test_unfold_every_position(spark):
    text = "A “b”  *c*…\n\n_d_ — İE f"
    plain = frame(spark, [text]).select(T.fold("t").alias("f")).first().f
    fold = A.Fold(text)
    assert fold.text == plain
    back = [fold.back(i) for i in range(len(plain))]
    for at, ch in zip(back, plain):
        assert T_fold(text[at]).find(ch) >= 0
    assert back == sorted(back)


def test_fold_and_places_match_plain_search(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab*_ …’İ\u00a0\n\t.Q") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    folds = [r.f for r in frame(spark, texts).select("t", T.fold("t").alias("f")).collect()]
    by_text = dict(zip([r.t for r in frame(spark, texts).collect()], folds))
    for text in texts:
        assert A.folded(text) == by_text[text]
        wanted = {text[i: i + rng.randint(1, 12)] for i in range(0, len(text), 5)} | {"", "aba", "Q" * 9, text, text + "x"}
        assert A.places(text, wanted) == {w: text.find(w) for w in wanted if w and w in text}


def test_thousand_quotes_of_one_long_text(spark):
    """The cost follows text plus quotes: many quotes, of which some stand nowhere, and anchors that stand everywhere."""
    rng = random.Random(6)
    words = ["w%d" % i for i in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(200_000)) + "."
    at = [rng.randrange(len(text) - 200) for _ in range(1000)]
    quotes = [text[i: i + 90].strip() for i in at[:500]] + [text[i: i + 90].strip().upper().replace(" ", "  ") for i in at[500:]]
    df = spark.createDataFrame([(1, text, [(i, q) for i, q in enumerate(quotes)])], "k int, text string, quotes array<struct<quote_no:int,quote:string>>")
    got = {r.quote_no: r for r in G.locate_all(df, ["k"]).collect()}
    assert len(got) == 1000 and all(text[r.start:r.end].lower().split() == quotes[i].lower().split() for i, r in got.items())
    assert {r.match for i, r in got.items() if i < 500} == {"exact"} and {r.match for i, r in got.items() if i >= 500} == {"folded"}

    def seconds(n):
        start = time.time()
        A.places(text, quotes[:n])
        return time.time() - start

    seconds(10)
    assert seconds(500) < 5 * max(seconds(5), 0.05)
    start = time.time()
    run = "ab" * 500_000
    assert A.places(run, ["ab" * 40 + "c" + str(i) for i in range(200)]) == {}
    assert time.time() - start < 60


def test_windows_that_cannot_reach_the_share_are_cut(spark):
    words = ["stone%d" % i for i in range(60)]
    text = " ".join(words) + "."
    near, far = words[5:15], [words[5], words[40]] + ["other%d" % i for i in range(8)]
    df = spark.createDataFrame([(0, text, [(0, " ".join(near[:4] + ["zz"] + near[5:])), (1, " ".join(far))])], "k int, text string, quotes array<struct<quote_no:int,quote:string>>")
    rows = G.search_quotes(df, ["k"]).collect()
    assert [r.quote_no for r in rows] == [0] and len(rows[0].windows) == 3 and {w.common for w in rows[0].windows} == {9}


def test_loose_match_reaches_the_best_of_all_windows(spark):
    """Next to a plain search of the windows around every place of every word of the quote."""
    rng, cases = random.Random(11), []
    for i in range(300):
        vocab = [rng.choice(["w", "stone"]) + chr(97 + j) * 3 for j in range(rng.choice([6, 12, 25]))]
        body = [rng.choice(vocab) for _ in range(rng.choice([30, 120]))]
        at, n = rng.randrange(len(body)), rng.randint(4, 20)
        quote = [rng.choice([w, w, w, w, w, w, rng.choice(vocab), "qqqq"]) for w in body[at: at + n]]
        if len(quote) >= 4:
            cases.append((i, " ".join(body) + ".", " ".join(quote)))

    def best(words, windows):
        shares = [G.aligned(words, w) for w in windows]
        return max((got for got, a, z in shares if got >= G.MIN_SHARE * len(words) and z - a + 1 <= G.STRETCH * len(words) + G.SLACK), default=None)

    df = spark.createDataFrame([(i, text, [(0, q)]) for i, text, q in cases], "k int, text string, quotes array<struct<quote_no:int,quote:string>>")
    found = {r.k: r for r in G.search_quotes(df, ["k"]).collect()}
    loose = fuzzy = 0
    for i, text, q in cases:
        if i in found and found[i].match:
            continue
        words, body = A.quote_words(q), A.Words(text)
        reach = len(words) + G.MARGIN
        want = best(words, [body.low[max(0, p - reach): p + reach] for p, w in enumerate(body.low) if w in words])
        assert (best(words, [w.words for w in found[i].windows]) if i in found else None) == want
        loose, fuzzy = loose + 1, fuzzy + (want is not None)
    assert loose > 100 and 50 < fuzzy < loose
    assert {r.k for r in G.locate_all(df, ["k"]).collect()} == {i for i, r in found.items() if r.match or best(r.words, [w.words for w in r.windows])}


def T_fold(ch):
    table = {"“": '"', "”": '"', "—": "-", "…": "...", "\n": " ", " ": " "}
    return table.get(ch, ch).lower()


def marked(text, spans, opens=("", "{w:", "[S:"), closes=("", "}", "]")):
    rank = [0] * len(text)
    for a, b, r in spans:
        for i in range(a, min(b, len(text))):
            rank[i] = max(rank[i], r)
    out, now = "", 0
    for ch, r in zip(text, rank):
        out += (closes[now] + opens[r] if r != now else "") + ch
        now = r
    return out + closes[now]


def test_marks_match_a_plain_sweep(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab é😀.") for _ in range(rng.choice([0, 5, 40, 3000])))
        spans = [(a := rng.randint(0, len(text)), a + rng.choice([0, 1, 3, 900]), rng.randint(1, 2)) for _ in range(rng.choice([0, 1, 6, 80]))]
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<start:int,end:int,rank:int>>")
    got = {r.i: r.m for r in df.select("i", S.mark_spans("t", F.col("s")).alias("m")).collect()}
    assert got == {i: marked(t, s) for i, t, s in rows}


def test_many_marks_in_one_text(spark):
    """A hundred thousand spans of one text: ten times the spans take about ten times as long, not a hundred."""
    def seconds(n):
        text = "one word and " * n
        df = spark.range(1).select(F.lit(text).alias("t"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 13 + 4).alias("start"), (i * 13 + 8).alias("end"), F.lit(1).alias("rank"))).alias("s"))
        start = time.time()
        got = df.select(S.mark_spans("t", F.col("s")).alias("m")).first().m
        assert got == "one {w:word} and " * n
        return time.time() - start

    seconds(1000)
    small = seconds(10_000)
    assert seconds(100_000) < 40 * max(small, 0.5)


def test_marks_and_spans_of_one_long_text(spark):
    """The text is not walked for every mark: 100,000 marked words in one text of 700,000 characters, next to Python."""
    text = "Äb Cd, e " * 50_000 + "Fé Gh\n" * 50_000
    df = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    found = S.find_spans("text", "[A-Z][a-z]")
    ranked = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(2).alias("rank")))
    began = time.time()
    rows = df.select(S.mark_spans("text", ranked), F.transform(found, lambda s: s["end"])).collect()
    assert rows[0][0] == re.sub("([A-Z][a-z])", r"[S:\1]", text)
    assert rows[0][1] == [m.end() for m in re.finditer("[A-Z][a-z]", text)]
    assert rows[1][0] == "" and rows[1][1] == [] and rows[2][0] is None and rows[2][1] is None
    assert time.time() - began < 40


def test_running_over_blocks(spark):
    values = [(i * 7) % 11 - 3 for i in range(1000)]
    df = spark.createDataFrame([(values[:n],) for n in (0, 1, 255, 256, 257, 513, 1000)] + [(None,)], "v array<int>")
    for v, sums in df.select("v", S.running(F.col("v"))).collect():
        assert sums == (None if v is None else list(itertools.accumulate(v)))


def test_running_sums_at_all_sizes_of_a_block(spark):
    values = [[], [3], [1] * 16, list(range(17)), [i % 7 - 2 for i in range(1000)]]
    for v, one, own in spark.createDataFrame([(v,) for v in values], "v array<int>").select("v", S.running(F.col("v")), S.running(F.col("v"), 64)).collect():
        assert one == own == [sum(v[:i + 1]) for i in range(len(v))]


def test_spans_of_lines(spark):
    text = "ab ab\n\nx\nab😀ab ab\r\nb\n"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(
        S.find_spans("t", "(?P<name>a)b", "name", lines=S.lines_of("t"), holds=lambda x: x["line"].contains("ab")).alias("s"),
        S.find_spans("t", "ab", lines=S.lines_of("t")).alias("w"), S.find_spans("t", "ab").alias("all"), S.find_spans("t", r"b\s", lines=S.lines_of("t")).alias("over")).collect()
    assert [(s.start, s.end) for s in got[0].s] == [(m.start(), m.start() + 1) for m in re.finditer("ab", text)]
    assert got[0].w == got[0].all and [(s.start, s.end) for s in got[0].over] == [m.span() for m in re.finditer(r"b\s", text)]
    assert got[1].s is None and got[1].w is None and got[2].w == []
