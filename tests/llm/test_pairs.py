"""Near duplicates, components and benchmark leaks next to brute force."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import brute
from spanloom.llm import neardup
from spanloom.llm.components import components
from spanloom.llm.decontaminate import contained_items, decontaminated
from spanloom.llm.neardup import chunk_keys, near_duplicates, search_distance, spanning_links
from spanloom.llm.shared import BLANKS, PUNCTUATION, distinct_sets, shingle_hashes, word_hashes

SCHEMA = "doc_id long, text string"


def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def family(rng, n, words=120, edits=9):
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits)):
            copy[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_groups_match_brute_force(spark, small, k, percent):
    rng = np.random.default_rng(3)
    docs = texts(spark, small)
    extra = family(rng, 60) + family(rng, 20, 30, 4) + ["one two", "one  TWO", "one two three", "", " \t\n", "ümlaut Ä Ä x"]
    docs |= {10_000 + i: t for i, t in enumerate(extra)} | {20_000: None}
    got = near_duplicates(spark.createDataFrame(list(docs.items()), SCHEMA), k, percent).collect()
    want = brute.components(docs, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got) and len(got) == len(docs)


def test_blocks_give_the_same_groups(spark, monkeypatch):
    docs = dict(enumerate(family(np.random.default_rng(5), 80, 60, 8)))
    monkeypatch.setattr(neardup, "GROUP", 900)
    got = near_duplicates(spark.createDataFrame(list(docs.items()), SCHEMA), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(docs, 3, 85)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t"), (None, None), (2, None), (3, "a b c d e f g"), (2, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "label": F.lit("x"), "id": F.lit(2)})
    got = [tuple(r) for r in near_duplicates(df, 3, 80).collect()]
    assert len(got) == len(rows)
    assert sorted(g for g in got if g[0] is not None) == [(1, 4, 1, True), (1, 4, 1, True), (2, 0, 2, True), (2, 0, 2, True), (3, 5, 1, False)]
    assert sorted((g[1], g[2] or -1, g[3]) for g in got if g[0] is None) == [(0, -1, False), (2, -1, False), (4, 1, False)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keys_hold_every_pair_within_the_distance():
    rng = np.random.default_rng(1)
    distance = search_distance(85)
    keys = chunk_keys(neardup.SYMBOLS, distance)
    for _ in range(300):
        differ = np.zeros(neardup.SYMBOLS, bool)
        differ[rng.choice(neardup.SYMBOLS, distance, replace=False)] = True
        assert any(not differ[list(places)].any() for places in keys)


def test_distance_in_sql(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 16, (2, neardup.SYMBOLS), dtype=np.uint16)
    b[:50] = a[:50]
    b[60] = a[60] ^ 128
    rows = neardup.packed(spark.createDataFrame([(1, 1, a.tobytes()), (2, 1, b.tobytes())], "id long, n long, signature binary"))
    got = rows.alias("x").join(rows.alias("y"), F.expr("x.id < y.id")).select(F.expr(neardup.differing("x", "y"))).first()[0]
    assert got == (a.astype(np.uint8) != b.astype(np.uint8)).sum()


def test_spanning_links_keep_components():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, 30)) for _ in range(60)]
    links = spanning_links(np.array([len(s) for s in sets]), np.concatenate(sets), 55)

    def group(pairs):
        top = list(range(60))
        for _ in range(60):
            for a, b in pairs:
                top[a] = top[b] = min(top[a], top[b])
        return top

    full = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 55 * len(np.union1d(sets[i], sets[j]))]
    assert group(links) == group(full) and len(links) == 60 - len(set(group(full)))


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 75), (75, 75)]
    got = {r.id: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, 75: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("table,words", [(BLANKS, brute.blank_words), (PUNCTUATION, brute.plain_words)])
def test_hashes_tell_shingles_apart(table, words):
    rng = np.random.default_rng(9)
    rows = ["", None, "a", "a b", "b a", "x\ty\nz", "Ä ä", "a, b; c", *(" ".join(rng.choice(["ab", "a", "b", "Ab", "é,", "\t"], 12)) for _ in range(50)), "w" * 3_000_000 + " a b"]
    for k in (1, 3, 5):
        hashes, offsets = distinct_sets(*shingle_hashes(*word_hashes(pa.array(rows), table), k))
        sets = [frozenset(hashes[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])]
        want = [brute.shingles(words(t), k) for t in rows]
        assert [len(s) for s in sets] == [len(s) for s in want]
        assert all((sets[i] == sets[j]) == (want[i] == want[j]) and len(sets[i] & sets[j]) == len(want[i] & want[j]) for i in range(len(rows)) for j in range(i))


def test_leaks_match_brute_force(spark, small):
    docs = texts(spark, small)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    some = brute.plain_words(items[1])
    docs |= {9001: "Before " * 50 + items[0].upper() + " after" * 3000, 9002: "x " + " ".join(some[: len(some) * 9 // 10]), 9003: " ".join(some[: len(some) // 2]), 9004: None, 9005: "", 9006: "only three words"}
    items |= {900: "only three words", 901: None, 902: "", 903: items[0], 904: "?!"}
    frame = lambda d, name: spark.createDataFrame(list(d.items()), f"{name} long, text string").withColumns({"hash": F.lit(1), "hits": F.lit("x")})
    got = contained_items(frame(docs, "doc_id"), frame(items, "item_id"))
    assert {(r.doc_id, r.item_id, r.hits) for r in got.collect()} == brute.contained(docs, items, 5, 80)
    assert {r.item_id: r.n_items for r in got.filter("item_id = 0").collect()} == {0: 2}
    left = {r.doc_id for r in decontaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert left == set(docs) - {d for d, _, _ in brute.contained(docs, items, 5, 80)}


def test_a_leak_takes_only_its_own_rows(spark):
    item = " ".join(f"w{i}" for i in range(40))
    clean = [f"clean text number {i} of a table" for i in range(6)]
    rows = [(None, "x " + item), (None, ("x " + item).upper()), (None, clean[0]), (None, clean[1]), (None, None), (5, item + " y"), (5, clean[2]), (5, clean[2]), (6, clean[3])]
    left = decontaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted([(0, clean[0]), (0, clean[1]), (0, ""), (5, clean[2]), (5, clean[2]), (6, clean[3])])


def test_leaks_of_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    items = one.withColumnRenamed("doc_id", "item_id")
    assert contained_items(none, items).count() == 0
    assert contained_items(one, none.withColumnRenamed("doc_id", "item_id")).count() == 0
    twice = contained_items(one.unionAll(one), items).collect()
    assert [(r.doc_id, r.item_id, r.containment) for r in twice] == [(1, 1, 1.0)]


def test_row_filter_lets_all_chosen_rows_pass(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"), F.xxhash64("id").alias("text_hash"))
    chosen = rows.filter("text_hash % 10 = 0")
    table = neardup.row_filter(chosen, chosen.count())
    keys = rows.select(neardup.row_key(), (F.col("text_hash") % 10 == 0).alias("in")).toPandas()
    let = neardup.passing(table, keys["row_key"].to_numpy())
    assert let[keys["in"]].all() and let[~keys["in"]].mean() < 0.05
    assert not neardup.passing(neardup.row_filter(rows.limit(0), 0), keys["row_key"].to_numpy()).any()


def test_groups_without_a_filter(spark, monkeypatch):
    docs = dict(enumerate(family(np.random.default_rng(7), 40, 60, 8)))
    monkeypatch.setattr(neardup, "FILTER_ROWS", 0)
    got = near_duplicates(spark.createDataFrame(list(docs.items()), SCHEMA), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(docs, 3, 85)


def test_rows_that_may_be_named(spark):
    docs = spark.createDataFrame([(i if i % 5 else None, f"text {i}" if i % 7 else None) for i in range(500)], SCHEMA)
    rows = docs.filter("doc_id % 3 = 0 or doc_id is null and text like '%5'").select("doc_id", neardup.text_hash())
    maybe, others = neardup.may_be_named(docs, rows)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(maybe.unionByName(others)) == key(docs) and others.count() > 200
    assert neardup.named(others, rows.distinct(), "left_semi").count() == 0
    assert key(neardup.named(maybe, rows.distinct(), "left_semi")) == key(neardup.named(docs, rows.distinct(), "left_semi"))
