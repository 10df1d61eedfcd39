"""The registry: golden hits of every pattern, and its regexes as Java and as Python run them."""
import re

import pytest
from pyspark.sql import functions as F

from golden_hits import COUNT, HITS
from spanloom.functions.regex import first_characters, line_bound, to_java
from spanloom.functions.spans import find_spans, lines_of
from spanloom.functions.text import words
from spanloom.operators.patterns import doc_freq, line_test, plain_lower, run_patterns
from spanloom.operators.registry import LIKE_ASCII, NEEDS, NEEDS_LOWER, REGISTRY, STOPLISTS, WORDS, needed_words, needs, tuned

# Invented texts, so that every pattern catches something.
TEXTS = {
    1: "# 1. The Glass Wardens: the Slow Ones\n\nThe Glass Wardens keep watch. 😀 é They are the keepers. It is the hum.\n"
       "**The Moss: the Green Choir**\n**Ash Mothers (The Grey Sisters):** they wait.\n**Sedge Folk**: pale, and quiet.\n"
       "**Brine Kin** are seldom seen. In the hall the **Lantern Eaters** sleep, and the **salt-mouths** too; a **dim thing** stirs.\n",
    2: "They are the *Suturers*, and the *curtain-leeches* beside the *slow light*. A heron (“Attic Barons”) lands.\n"
       "- Slate-eaters: sheets that dissolve stone\n• Rust Singers – they hum\n1. Tide-Callers\n2) Fern Wives (old): quiet\n"
       "A Quillhost strolls. We saw the Quillhost twice, or simply the Hollow Choir. They speak with Tarse often, and to Oren.\n"
       "A fern (Mycora lucens) and *Sturna vulgaris* grow.\n",
    3: "Some call them the Lamplit. It is known to itself as “Old Nine”. They call it “the soft dark” and name *listening dreams*.\n"
       "A word that means roughly *bearers of salt*. There are the stitchers, who mend. There are hinge-ferns that open. There are glass worms, too.\n"
       "The door-makers and lamp-keepers pass. The chimney-sweepers — sooty — nap. The rust-farms are wide. The root-mat is old. the gas-bladders live.\n"
       "The crawlers — the chitons — graze. Those who never left the lower stair watch. It has no name for itself. Nobody says the name aloud!\n",
    4: "The \"Thistle Cousins,\" are shy. He said \"Marrow\" twice. Beside them live the rooters, and there come the pale ones who sing.\n"
       "The grazers eat. The grazers sleep. The grazers wake, the grazers. The fire beings walk on. The other beings wait.\n"
       "vine-walkers climb; vine-walkers fall. The glass-fish, as they are known, drift. The oxbarges creak; the oxbarges leak.\n"
       "The long ones wait and the long ones wake. They are stewards. They are builders of walls. The door-maker came; the door-maker left.\n",
    5: "# The Listeners\n\nThe listeners came. They heard the listeners.\n\n## Cindermaids\nCindermaids are loud. Young Cindermaids sing.\n### The Bridge That Hums\nNo more of it.\n"
       "**The Pale Shape**\n\n**The Drifters**\nthe drifters pass.\n**Grazers**\nGrazers eat.\n"
       "1. Copper-snails\nCopper-snails nap.\n2. Pebble-Sorters: they count\n- Mire Singers\nthe mire singers hum.\n",
    6: "Call them tenders, for lack of better. It is called the resident, since it stays. They call it the warden. The bell-ringers and peat-carriers work.\n"
       "- **Twilight Skimmers**: sleek. The otters (Weir-Lodgers) swim. They call themselves kin; called the Hollow by the townsfolk.\n"
       "What lives there is mostly the place itself. The canyon is a being. It is not a creature but a process. The hill\n",
    7: "", 8: "A " + "Bo " * 3000 + "end.", 9: "the " + "ab-" * 400 + "folk went.",
}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(TEXTS.items()), "text_id long, text string")


def hits(df):
    return {tuple(r) for r in df.select("text_id", "pattern_id", "start", "end", "surface", "norm").collect()}


def test_every_pattern_gives_its_hits(spark, frame):
    rare = spark.createDataFrame([("none", 1, 0.5)], "word string, n_texts long, df double")
    got = hits(run_patterns(frame.filter("text_id < 7"), df=rare))
    assert {(t, p, s, e, surface, n) for p, t, s, e, surface, n in HITS} <= got and len(got) == COUNT
    assert {p for _, p, *_ in got} == {p.id for p in REGISTRY}
    stops = {p.id: set(STOPLISTS.get(p.stop, ())) for p in REGISTRY}
    assert not any(n in stops[p] for _, p, *_, n in got)


def spaced():
    """The texts, and the same with every blank doubled or a tab."""
    for blank in (" ", "  ", "\t"):
        for text in TEXTS.values():
            yield text[:4000].replace(" ", blank)


def test_engines_agree(spark):
    """Each regex as Java runs it gives the matches of Python's engine."""
    texts = list(dict.fromkeys(spaced()))
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    names = [p for p in {p.regex: p for p in REGISTRY}.values()]
    got = df.select("i", *[find_spans("text", tuned(p.regex), ("name", "name2") if "(?P<name" in p.regex else 0, p.flags).alias(p.id) for p in names]).collect()
    for row in got:
        for p in names:
            flags = (re.M if "m" in p.flags else 0) | (re.I if "i" in p.flags else 0)
            group = lambda m: 0 if "(?P<name" not in p.regex else "name" if m["name"] is not None else "name2"  # noqa: E731, B023
            want = [m.span(group(m)) for m in re.finditer(p.regex, texts[row.i], flags)]
            assert [(s.start, s.end) for s in row[p.id]] == want, (p.id, texts[row.i])


def test_blanks_of_any_kind_are_found(spark):
    texts = [(1, "It is\tnot a creature but a process."), (2, "It has no  word for itself."), (3, "They are\tthe  makers."), (4, "Those\twho never left the stair watch.")]
    got = hits(run_patterns(spark.createDataFrame(texts, "text_id long, text string")))
    assert {(1, "being_is_process"), (2, "anti_name"), (3, "pronoun_is_the"), (4, "those_who_lower")} <= {(t, p) for t, p, *_ in got}


def test_long_chains_do_not_overflow(spark):
    """In a session without a stack of its own size, a group loop may repeat without end."""
    n = 1_000_000
    chains = ["the " + "ab-" * n + "folk went.", "The " + "Ab-" * n + "Folk of " + "Bo " * n, "**" + "ab-" * n + "ab** x'" + "a'" * n, "There are " + "ab-" * n + "ab, " + "the " + "ab-" * n + "makers."]
    df = spark.createDataFrame(list(enumerate(chains)), "text_id long, text string")
    rare = spark.createDataFrame([("none", 1, 0.5)], "word string, n_texts long, df double")
    quick = [p for p in REGISTRY if "-" in p.regex or "«" in p.regex]
    assert "-Xss" not in spark.sparkContext.getConf().get("spark.driver.extraJavaOptions", "")
    found = df.select(*[F.size(find_spans("text", tuned(p.regex), ("name", "name2") if "(?P<name" in p.regex else 0, p.flags)).alias(p.id) for p in quick]).collect()
    assert sum(r["the_hyphen_agent"] for r in found) == 2 and sum(r["the_cap"] for r in found) == 1
    assert df.select(F.size(words("text")).alias("n")).agg(F.sum("n")).first()[0] > n
    assert df.select(F.size(find_spans("text", "[A-Z][A-Za-z]*(?: [A-Za-z]+)*")).alias("n")).agg(F.sum("n")).first()[0] >= 2
    assert run_patterns(df.filter("text_id = 0"), [p for p in REGISTRY if p.id == "the_hyphen_agent"], df=rare).count() == 1


def test_loops_become_possessive_only_where_nothing_changes():
    for pattern, want in [("a(?:-b)*", "a(?:-b)*+"), ("a(?:-b)+c", "a(?:-b)++c"), ("a(?:-b)*b", "a(?:-b)*b"), ("a(?:-b)*-c", "a(?:-b)*-c"), ("(?:a)*?b", "(?:a)*?b"), ("(?P<name>x(?:-y)+)[.]", "((?:x)(?:-y)++)[.]"), ("(?:-[a-z]+)*A", "(?:-[a-z]+)*A")]:
        assert to_java(pattern, wanted=()).text.endswith(want.replace("((?:x)", "(?:x") if "name" in pattern else want), pattern


def test_rarity_on_real_texts(spark, small):
    docs = spark.read.parquet(small + "/documents.parquet").select("doc_id", "text")
    freq = {r.word: r.df for r in doc_freq(docs).collect()}
    limits = {p.id: p.max_df for p in REGISTRY}
    got = hits(run_patterns(docs, key="doc_id").withColumnRenamed("doc_id", "text_id"))
    assert got and all(" " in n or freq.get(n, 0) <= limits[p] for _, p, _, _, _, n in got if limits[p])


def test_rare_word_is_dropped(spark, frame):
    common = spark.createDataFrame([("grazers", 9, 0.2), ("oxbarges", 9, 0.001)], "word string, n_texts long, df double")
    rare = spark.createDataFrame([("none", 1, 0.5)], "word string, n_texts long, df double")
    got, every = hits(run_patterns(frame, df=common)), hits(run_patterns(frame, df=rare))
    limits = {p.id: p.max_df or 1 for p in REGISTRY}
    assert got == {h for h in every if {"grazers": 0.2, "oxbarges": 0.001}.get(h[5], 0) <= limits[h[1]]}
    assert any(h[1] == "the_agent_recurring" and h[5] == "grazers" for h in every - got)


def test_surface_is_the_texts_own_stretch(frame, spark):
    for tid, _, s, e, surface, _n in hits(run_patterns(frame)):
        assert TEXTS[tid][s:e].strip() == surface.strip()


def test_needs_are_necessary():
    for p in REGISTRY:
        wanted, lower = needs(p)
        flags = (re.M if "m" in p.flags else 0) | (re.I if "i" in p.flags else 0)
        for text in spaced():
            for m in re.finditer(p.regex, text, flags):
                found = text.lower() if lower else text
                assert not wanted or any(w in found for w in wanted), p.id
                words = set(re.findall("[a-z]+", text.translate(str.maketrans(*LIKE_ASCII)).lower()))
                assert all(words & set(group) for group in needed_words(p)), p.id
    assert set(NEEDS) | set(NEEDS_LOWER) | set(WORDS) <= {p.id for p in REGISTRY}


def test_tuned_patterns_are_equal():
    for p in REGISTRY:
        flags = (re.M if "m" in p.flags else 0) | (re.I if "i" in p.flags else 0)
        for text in spaced():
            a = [m.span() for m in re.finditer(p.regex, text, flags)]
            assert a == [m.span() for m in re.finditer(tuned(p.regex), text, flags)], p.id


def test_translation_of_groups():
    j = to_java(r"(?:a|b)(?P<name>[[x]+)c|(d)(?P<name2>e)")
    assert j.text == r"(?dU)((?:a|b))([\[x]+)c|((?:d))(e)"
    assert j.before == (1, 3) and j.wanted == (2, 4)


def test_lines_that_hold_what_a_pattern_needs_give_all_its_matches(spark):
    texts = [t for t in dict.fromkeys(spaced()) if t] + ["\n\r\n the  Ash\rWood\n\n", "😀 the Ash ﷐\n\nthe Ash, the Bo\n", "THE PLACE İS ıts ſea\nThe ſea iſ it.\nThe LAKE iS it\nNo NAMİNG"]
    lines = F.transform(lines_of("text"), lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"), plain_lower(x["line"]).alias("low")))
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("lines", lines)
    every = [p for p in {p.regex: p for p in REGISTRY}.values()]
    args = lambda p: (tuned(p.regex), ("name", "name2") if "(?P<name" in p.regex else 0, p.flags)
    whole = df.select("i", *[find_spans("text", *args(p)).alias(p.id) for p in every]).collect()
    cut = df.select("i", *[find_spans("text", *args(p), "lines", line_test(p)).alias(p.id) for p in every]).collect()
    assert sorted(whole) == sorted(cut) and sum(len(x) for r in cut for x in r[1:]) > 100
    assert [p.id for p in every if not line_bound(p.regex, p.flags)] == ["the_mod_being", "call_them_bare"]


def test_what_stays_in_a_line_and_what_a_match_begins_with():
    held = {("a.b", ""): True, ("a.b", "s"): False, ("^a", ""): False, ("^a", "m"): True, (r"a\s", ""): False, ("[^a]b", ""): False, (r"[^\n]\S", ""): True, (r"a(?!\n)", ""): False, (r"a\Z", ""): False}
    assert {k: line_bound(*k) for k in held} == held
    first = {"(?:a|)b": {"a", "b"}, "(?:a[0-9]|b){0,2}c": {"a", "b", "c"}, "(?:(?:x|[yz])a)?w(?:1|2)": set("xyzw"), "(?:ab|[^c])": None, "(?!y)x": None, "a?": None, "": None}
    assert {k: first_characters(k) for k in first} == first
    assert tuned(r"\b(?:live|dwell)s") == r"(?=[dl])\b(?:live|dwell)s"
