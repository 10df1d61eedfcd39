"""Shards, packing, search, and the pipeline."""
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import brute
from spanloom.llm import packing
from spanloom.llm.packing import best_fit, local_search, pack_documents, token_ids
from spanloom.llm.shared import shared_folder
from spanloom.llm.sharding import sharded, splitters, write_shards
from spanloom.llm.topk import CoverTree, bound, top_k

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("word_bpe_49k.json"))


def test_a_cluster_must_name_its_shared_folder():
    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key.split(".")[1], default), set=lambda key, value: None))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master=master))
        assert shared_folder(session(master=master, checkpoint="hdfs://x/y/")) == "hdfs://x/y"
    assert shared_folder(session(master="local[8]")).startswith("file://")


def check_shards(rows, shards, slack):
    sizes, slots = np.zeros(shards), [[] for _ in range(shards)]
    for r in rows:
        text = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert sizes.max() - sizes.min() <= slack, sizes


def test_shards(spark):
    rows = sharded(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 8).collect()
    longest = max(r.size for r in rows)
    check_shards(rows, 8, 2 * longest)
    assert len(rows) == 1000


def test_hot_text_and_odd_rows(spark, tmp_path):
    rows = [(i, "same text " * 20, "s") for i in range(3000)] + [(i, f"other {i} " * (i % 7), "t") for i in range(3000, 6000)] + [(None, None, None), (None, None, None), (7, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").withColumns({"h": F.lit(1), "cell": F.lit("c")}).drop("h", "cell")
    got = sharded(df, 8, cell_rows=100).collect()
    assert len(got) == len(rows)
    check_shards(got, 8, 600)
    again = sharded(df.repartition(5), 8, cell_rows=100).collect()
    assert sorted((r.doc_id or -1, r.shard, r.slot) for r in again if r.doc_id is not None) == sorted((r.doc_id or -1, r.shard, r.slot) for r in got if r.doc_id is not None)
    assert sharded(df.limit(0)).count() == 0 and {r.shard for r in sharded(df.limit(1)).collect()} <= set(range(8))
    write_shards(df, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == len(rows) and back.select("shard", "slot").distinct().count() == len(rows)


def test_splitters_are_exact(spark):
    rng = np.random.default_rng(0)
    h, i, size = rng.integers(0, 50, 2000), rng.integers(-(1 << 63), (1 << 63) - 1, 2000), rng.integers(1, 100, 2000)
    keys = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(h, i, size)], "h long, i long, size long")
    order = np.lexsort((i, h))
    for n, edge in enumerate(splitters(keys, 5, 0.0), 1):
        below = sum(int(size[x]) for x in order if (int(h[x]), int(i[x])) < edge)
        assert abs(below - size.sum() * n / 5) <= size.max() / 2


def test_repeated_rows_are_divided_and_stay_in_order(spark):
    hot = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one row " * 25).alias("text"))
    rest = spark.range(100, 8900).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 3000).cast("string")).alias("text"))
    docs = hot.unionAll(rest).withColumns({"h": F.lit("mine"), "r": F.lit(1), "bounds": F.lit(2), "row": F.lit(3), "part": F.lit(4)})
    out = sharded(docs, 8, cell_rows=100).withColumn("key", F.xxhash64("text").bitwiseAND((1 << 63) - 1))
    assert out.columns[:7] == docs.columns and out.first()["h"] == "mine"
    rows = out.collect()
    assert len(rows) == 12_800
    check_shards(rows, 8, 2 * max(r.size for r in rows) + 0.004 * sum(r.size for r in rows) / 8)
    placed = [(r.key, r.doc_id) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert placed == sorted(placed)
    assert "text" not in sharded(docs, 8, keep_text=False).columns


def test_splitters_divide_equal_keys(spark):
    keys = spark.range(1000).select(F.lit(5).cast("long").alias("h"), F.lit(2).cast("long").alias("i"), F.col("id").alias("r"), F.lit(3).cast("long").alias("size"))
    assert splitters(keys, 4, 0.0) == [(5, 2, 250), (5, 2, 500), (5, 2, 750)]


def test_pieces_and_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (5001, ""), (5001, ""), (5002, "word " * 5000), (5003, "<|endoftext|> a|b | c\x1cd e\u0085f   I'LL É ΑΣ.")], docs.schema)
    docs = docs.unionAll(odd)
    rows = pack_documents(docs.withColumns({"cell": F.lit(1), "bin": F.lit(2)}), PATH).collect()
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k, at, len(ids[at: at + 2048]), zlib.crc32(ids[at: at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    first = lambda rows: sorted(tuple(-1 if x is None else x for x in r[:5]) for r in rows)
    assert first(rows) == first(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        ends = np.cumsum([0] + [n for _, n in sorted(p)])
        assert [o for o, _ in sorted(p)] == ends[:-1].tolist() and ends[-1] <= 2048
    lengths = np.array([r.length for r in rows])
    assert len(places) <= len(best_fit(lengths, 2048)) and len(places) >= -(-lengths.sum() // 2048)
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_words_are_remembered(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    a = token_ids(["one two|three four", "| |"], PATH)
    assert a == token_ids(["one two|three four", "| |"], PATH)


def test_search_saves_bins():
    most, better = 100, 0
    for seed in range(40):
        rng = np.random.default_rng(seed)
        lengths = rng.integers(8, 60, 300)
        bins = best_fit(lengths, most)
        after = local_search(lengths, bins, most)
        assert sorted(x for b in after for x in b) == list(range(300)) and all(lengths[b].sum() <= most for b in after)
        assert len(after) <= len(bins)
    # a start that wastes room: one item a bin
    lengths = np.array([50, 50, 60, 40, 30, 30, 40, 70, 30])
    better = local_search(lengths, [[i] for i in range(9)], most, patience=9)
    assert len(better) == 4


def plain_top(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, []).append(tuple(int(np.floor(256 * float(np.float32(x)))) for x in v))
    out = set()
    for q, vs in good.items():
        if q % every == 0:
            for v in vs[:1]:
                found = sorted({(-sum(a * b for a, b in zip(v, w)), j) for j, ws in good.items() if j != q for w in ws if len(w) == len(v)})[:k]
                out |= {(q, n, j, -s) for n, (s, j) in enumerate(found, 1)}
    return out


def test_top_k(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    hot = rows[3][1]
    rows += [(10_000 + i, hot) for i in range(300)] + [(None, hot), (20_050, None), (20_100, [None] * 64), (20_150, [float("nan")] * 64), (20_200, [float("inf")] * 64), (20_250, [1.0, 2.0]), (20_300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "point": F.lit("p"), "block": F.lit(2)})
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df).collect()}
    assert got == plain_top(rows, 50, 5)
    assert top_k(df.limit(0)).count() == 0 and top_k(df.filter("vec_id = 0")).count() == 0


def test_top_k_in_blocks(spark, monkeypatch):
    from spanloom.llm import topk
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 15)
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).round(1)]) for i in range(600)]
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=10).collect()}
    assert got == plain_top(rows, 10, 5)


def test_bounds_hold():
    rng = np.random.default_rng(6)
    a, b = CoverTree(rng.normal(size=(200, 5)) + 2), CoverTree(rng.normal(size=(300, 5)))
    for x in range(0, len(a.centre), 3):
        for y in range(0, len(b.centre), 3):
            assert (a.points[a.members[x]] @ b.points[b.members[y]].T).max() <= bound(a, x, b, y) + 1e-9


def test_pipeline(spark, small):
    import corpus_pipeline as C
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = docs.filter("lang = 'en'").first().text
    odd = [(80_001, "12 34 %% 56", None, "s", 11), (80_002, clean + " one more", "en", "s", None), (80_003, clean + " " + items[0], "en", "s", 1), (80_004, "the of and token = 0123456789abcdef0123 " + "that with " * 20, "en", None, 3), (None, None, None, None, None)]
    docs = docs.unionAll(spark.createDataFrame(odd, docs.schema)).withColumn("label", F.lit(1))
    kept = C.written(C.language(spark, docs, small))
    assert kept.columns == list(C.COLUMNS) and kept.count() == docs.count() - 2 and kept.filter("doc_id = 80001").isEmpty()
    single = C.written(C.near_dedup(spark, kept, small))
    groups = brute.components({r.doc_id: r.text for r in kept.collect()}, 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, top) in groups.items() if i == top} and single.columns == kept.columns
    safe = C.written(C.decontamination(spark, single, small))
    leaks = {d for d, _, _ in brute.contained({r.doc_id: r.text for r in single.collect()}, dict(enumerate(items)), 5, 80)}
    assert {r.doc_id for r in safe.collect()} == {r.doc_id for r in single.collect()} - leaks and leaks
    quiet = C.written(C.secrets(spark, safe, small))
    assert quiet.count() == safe.count() and quiet.columns == safe.columns
    assert quiet.filter("doc_id = 80004").first().text.startswith("the of and [assign] that")
    before = {r.doc_id: r.text for r in safe.collect()}
    assert all(r.text == before[r.doc_id] for r in quiet.collect() if not brute.base_spans(before[r.doc_id]))
    packed = C.packing(spark, quiet, small)
    assert packed.select("doc_id").distinct().count() == quiet.count()


def test_each_class_of_texts_keeps_one_row(spark, small):
    import corpus_pipeline as C
    rng = np.random.default_rng(8)
    a, b, c, d = (" ".join(f"w{i}" for i in rng.integers(0, 9000, 60)) for _ in range(4))
    rows = [(7, a, "s"), (7, b, "s"), (7, b + " more", "s"), (7, a, "r"), (9, b.upper(), "s"), (None, a, "s"), (None, c, "s"), (None, c, "t"), (None, c.upper(), "s"),
            (None, d, "s"), (None, d + " more", "s"), (12, d + " yet", "s"), (None, "", "s"), (13, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.text.lower().replace(" more", ""), r.source) for r in C.near_dedup(spark, docs, small).collect())
    assert got == sorted([(7, a, "r"), (7, b, "s"), (0, c, "s"), (12, d + " yet", "s"), (0, "", "s"), (13, "", "s")])


def test_short_passwords_are_redacted(spark, small):
    import corpus_pipeline as C
    rows = [(1, "password = Tr0ub4d9x now", "a/x"), (2, "password = aaaaaaaaaa now", "a/x"), (3, "token: example99 now", "b/x"), (4, "secret: k3yk3yk3", "c/x"), (5, "secret=short12", "c/x")]
    rows += [(10 + i, "password = c0rrecth0rs now", f"o{i}/x") for i in range(3)]
    got = {r.doc_id: r.text for r in C.secrets(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), small).collect()}
    assert got == {i: t for i, t, _ in rows} | {1: "[assign] now"}


def test_pipeline_of_nothing(spark, small):
    import corpus_pipeline as C
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = C.written(stage(spark, docs, small))
    assert docs.count() == 0


def test_language_stage_that_can_learn_little_rejects_nothing(spark, small):
    import corpus_pipeline as C
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("text rlike '[a-z]'")
    held = docs.filter("crc32(cast(doc_id as string)) % 5 = 0")
    assert held.count() > 20
    for some in (held, docs.orderBy("doc_id").limit(20), docs.limit(3), docs.withColumn("lang", F.lit(None).cast("string"))):
        assert C.language(spark, some, small).count() == some.count()
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34 !!", "en", "s", 8)], "doc_id long, text string, lang string, source string, n_chars long")
    assert C.language(spark, held.unionByName(extra), small).count() == held.count()


def test_packing_of_equal_rows_keeps_cells_small(spark):
    parts = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(300).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    number = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(10))
    sizes = [r["count"] for r in parts.groupBy(number.alias("cell")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 8000
    got = packing.pack(parts, 2048)
    assert got.count() == 60_000
    per = got.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("offset").alias("d"), F.max("offset").alias("top"))
    assert per.filter("n > 6 or n <> d or top <> 300 * (n - 1)").count() == 0
    assert per.count() <= 60_000 / 6 + 20
