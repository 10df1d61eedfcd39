"""Sources, sinks and the stream."""
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from spanloom.operators import answers as A
from spanloom.operators.answers import parse_quotes
from spanloom.sources import corpus as C, export as X
from spanloom.streaming import ingest as J
from spanloom.session import cut_lineage


def test_snapshot(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, 7, "lab/a", "text", "d", 0, 1, "ok")], C.schemas.TEXTS).write.parquet(d + "/texts.parquet")
    spark.createDataFrame([(7, 1, "m", "place", "d"), (8, 1, "m", "other", "d")], C.schemas.PLACES).write.parquet(d + "/places.parquet")
    spark.createDataFrame([(1, "t", "ok", "d", 1)], C.schemas.STATUS).write.parquet(d + "/status.parquet")
    spark.createDataFrame([("k", "v")], C.schemas.RELEASE).write.parquet(d + "/release.parquet")
    with pytest.raises(ValueError):
        C.load_corpus(spark, d)
    open(d + "/FINALIZED", "w").close()
    c = C.load_corpus(spark, d)
    assert [r.place_id for r in c.places.collect()] == [7]
    record = {r.key: r.value for r in C.run_record(c.texts, [1], spark.range(1).select(F.lit(3).alias("texts_n")), c.release).collect()}
    assert record["release_k"] == "v" and json.loads(record["stats"]) == {"texts_n": 3} and len(record["content_sha256"]) == 64


def test_digest_changes_with_content_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "text_id long, text string")
    one = C.content_digest(a).first().digest
    assert C.content_digest(a.orderBy(F.desc("text_id")).repartition(5)).first().digest == one
    assert C.content_digest(a.withColumn("text", F.upper("text"))).first().digest != one


def test_records(spark, tmp_path):
    p = str(tmp_path / "r.jsonl")
    with open(p, "w") as f:
        f.write('{"check": 1, "text": 5}\n\n{"check": 2, "text": 6, "pool": "all"}\n')
    rows = C.read_records(spark, p, "check int, text long, pool string", {"pool": "covered"}).orderBy("check").collect()
    assert [(r.check, r.pool) for r in rows] == [(1, "covered"), (2, "all")]
    with open(p, "a") as f:
        f.write('{"check": 3,\n{}\n \n[1]\n{"check": "x"}\n')
    rows = C.read_records(spark, p, "check int, text long, pool string", {"pool": "covered"}).collect()
    assert sorted(((r.check, r.pool, r._corrupt_record) for r in rows), key=str) == sorted(
        [(1, "covered", None), (2, "all", None), (None, None, '{"check": 3,'), (None, "covered", None), (None, None, "[1]"), (None, None, '{"check": "x"}')], key=str)


def test_versions_and_skipping(spark, tmp_path):
    root = str(tmp_path / "t")
    assert X.current(spark, root) is None
    assert X.write_if_changed(spark.range(3), root, "abc") and not X.write_if_changed(spark.range(9), root, "abc")
    assert spark.read.parquet(X.current(spark, root)).count() == 3
    with pytest.raises(Exception, match="abc"):
        X.overwrite(spark.range(5), root, "abc")
    assert spark.read.parquet(X.current(spark, root)).count() == 3 and not [f for f in os.listdir(root) if f.startswith(".CURRENT-")]
    assert X.write_if_changed(spark.range(9), root, "def") and spark.read.parquet(X.current(spark, root)).count() == 9


def test_exports(spark, tmp_path):
    d = str(tmp_path)
    t = spark.createDataFrame([(1, 0, 3, "abc"), (1, 5, 6, "z"), (250, 1, 2, "b")], "text_id long, start int, end int, label string")
    X.export_tables({"labels": t}, d + "/csv")
    assert any(f.endswith(".csv.gz") for f in os.listdir(d + "/csv/labels"))
    assert spark.read.option("header", True).csv(d + "/csv/labels").count() == 3
    X.export_spans(t, d + "/spans", parts=2)
    files = [f for f in os.listdir(d + "/spans") if f.endswith(".gz")]
    lines = [json.loads(l) for f in files for l in gzip.open(d + "/spans/" + f, "rt")]
    assert {l["text_id"]: [s["start"] for s in l["spans"]] for l in lines} == {1: [0, 5], 250: [1]}
    X.write_buckets(t, d + "/b", "text_id", "div100")
    assert sorted(f for f in os.listdir(d + "/b") if f.startswith("b=")) == ["b=0", "b=2"]
    X.write_buckets(t.crossJoin(spark.range(50)), d + "/b2", "text_id", "div100", rows=20)
    assert len([f for f in os.listdir(d + "/b2/b=0") if f.endswith(".json")]) > 1 and spark.read.json(d + "/b2").count() == 150
    with pytest.raises(ValueError, match="labels.odd"):
        X.export_tables({"labels": t.withColumn("odd", F.lit(1))}, d + "/csv2")


def test_stream_gives_the_batch_table(spark, tmp_path):
    src, table, ck = (str(tmp_path / x) for x in ("in", "log", "ck"))
    os.makedirs(src)
    batches = [[(1, "b1", 1, "one", None), (2, "b1", 1, None, "bad")], [(2, "b2", 2, "two", None), (1, "b2", 2, None, "bad")], [(3, "b3", 3, None, "bad")]]
    names = [f.split()[0] for f in J.ANSWER_DDL.split(", ")]
    for n, batch in enumerate(batches):
        with open(f"{src}/{n}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(names, r))) + "\n" for r in batch)
        J.ingest_stream(spark, src, table, ck, max_files=1)
    every = spark.createDataFrame([r for b in batches for r in b], J.ANSWER_DDL)
    key = lambda df: sorted(map(tuple, df.select(*names).collect()))
    want = key(J.latest(every))
    assert key(J.answers_now(spark, table)) == want
    J.ingest_stream(spark, src, table, ck)                                  # nothing new: nothing changes
    assert key(J.answers_now(spark, table)) == want
    assert {r[0]: r[3] for r in want} == {1: "one", 2: "two", 3: None}
    assert sorted(map(tuple, J.counts_now(spark, table).collect())) == [("b1", 2, 1), ("b2", 2, 1), ("b3", 1, 1)]
    # a second stream, with a checkpoint of its own, adds to the log and skips what was done
    with open(f"{src}/9.json", "w") as f:
        f.write(json.dumps(dict(zip(names, (4, "b4", 9, '{"quotes": ["four"]}', None)))) + "\n")
    done = spark.createDataFrame([("b1",), ("b2",), ("b3",)], "batch string")
    J.ingest_stream(spark, src, table, ck + "2", done=done, parse={"quotes": parse_quotes})
    assert key(J.answers_now(spark, table)) == sorted(want + [(4, "b4", 9, '{"quotes": ["four"]}', None)])
    assert [r.given for r in spark.read.parquet(table + "_quotes").collect()] == ["four"]
    assert sorted(map(tuple, J.counts_now(spark, table).collect()))[-1] == ("b4", 1, 0)


def test_store_opens_only_the_files_of_a_bucket(spark, tmp_path):
    rows = spark.range(10_000).select(F.col("id").alias("text_id"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("v"))
    hot = rows.unionByName(spark.range(4000).select(F.lit(777).cast("long").alias("text_id"), F.col("id").cast("string").alias("v"))).unionByName(rows.limit(1).withColumn("text_id", F.lit(None).cast("long")))
    root = str(tmp_path / "store")
    index = X.write_store(hot, root, "text_id", "div100", rows=1000)
    schema = hot.withColumn("b", F.lit("")).schema
    assert len(os.listdir(root)) == 2 and len([f for f in os.listdir(root + "/data") if f.endswith(".json")]) <= 16
    assert {r.b: r.n for r in index.groupBy("b").agg(F.sum("n").alias("n")).collect()} == {str(i): 4100 if i == 7 else 100 for i in range(100)} | {None: 1}
    for b, n, most in (("42", 100, 2), ("7", 4100, 7), (None, 1, 1), ("none", 0, 0)):
        got = X.read_bucket(spark, root, b, schema)
        assert got.count() == n and len(got.inputFiles()) <= most
    with pytest.raises(Exception, match="already exists"):
        X.write_store(rows, root, "text_id", "div100")


def put(src, name, *rows):
    names = [f.split()[0] for f in J.ANSWER_DDL.split(", ")]
    with open(f"{src}/{name}.json", "w") as f:
        f.writelines(json.dumps(dict(zip(names, r))) + "\n" for r in rows)


def test_answered_texts_are_skipped_and_a_replay_changes_nothing(spark, tmp_path):
    src, table, ck = (str(tmp_path / x) for x in ("in", "log", "ck"))
    os.makedirs(src)
    put(src, 1, (1, "b1", 1, "one", None), (2, "b1", 1, None, "bad"))
    J.ingest_stream(spark, src, table, ck, skip_answered=True)
    put(src, 2, (1, "b2", 9, "again", None), (2, "b2", 2, "two", None), (3, "b2", 2, None, "bad"))
    J.ingest_stream(spark, src, table, ck, skip_answered=True)
    now = lambda: {r.text_id: r.raw for r in J.answers_now(spark, table).collect()}
    assert now() == {1: "one", 2: "two", 3: None}
    # the last epoch is run again, as after a crash before its commit: its own rows are no reason to skip them
    for f in os.listdir(ck + "/commits"):
        if f.strip(".").startswith("1"):
            os.remove(f"{ck}/commits/{f}")
    before = sorted(map(tuple, J.counts_now(spark, table).collect()))
    J.ingest_stream(spark, src, table, ck, skip_answered=True)
    assert now() == {1: "one", 2: "two", 3: None} and sorted(map(tuple, J.counts_now(spark, table).collect())) == before
    # another checkpoint reads all files again and finds only the text without an answer open
    put(src, 3, (3, "b3", 3, "three", None), (2, "b3", 5, "late", None))
    J.ingest_stream(spark, src, table, ck + "2", skip_answered=True)
    assert now() == {1: "one", 2: "two", 3: "three"}


def test_logged_answers_survive_a_failed_task(spark, tmp_path):
    """A task fails in mid-run; the job is run again. Every request was asked once."""
    calls, log, mark = str(tmp_path / "calls"), f"file://{tmp_path}/log", str(tmp_path / "failed")
    os.makedirs(calls)

    def model(contents):
        import os as o
        import uuid as u
        if "r57" in contents and not o.path.exists(mark):
            open(mark, "w").close()
            o._exit(1)                                                      # the worker dies, and with it the task
        with open(f"{calls}/{u.uuid4().hex}", "w") as f:
            f.write("\n".join(contents))
        return [c.upper() for c in contents]

    requests = spark.createDataFrame([(f"t{i}", f"r{i}") for i in range(200)], "custom_id string, content string").repartition(3)
    try:
        A.infer_logged(requests, model, log, per=5, at_once=1, shares=4).collect()
    except Exception:                                                       # a local master does not retry tasks
        pass
    assert os.path.exists(mark)
    got = {r.custom_id: (r.raw, r.error) for r in A.infer_logged(requests, model, log, per=5, at_once=1, shares=4).collect()}
    assert got == {f"t{i}": (f"R{i}", None) for i in range(200)}
    asked = [line for f in os.listdir(calls) for line in open(f"{calls}/{f}").read().split("\n")]
    assert sorted(asked) == sorted(f"r{i}" for i in range(200))


def test_logged_answers_of_odd_requests(spark, tmp_path):
    def model(contents):
        if any(c == "bad" for c in contents):
            raise ValueError("no")
        return [c + "!" for c in contents]

    rows = [("a", "x"), ("a", "x"), (None, "n"), ("b", "bad"), ("c", "")]
    requests = spark.createDataFrame(rows, "custom_id string, content string")
    for _ in range(2):
        got = sorted(((r.custom_id or "", r.raw, (r.error or "")[:10]) for r in A.infer_logged(requests, model, f"file://{tmp_path}/log", pause=0).collect()), key=str)
        assert got == [("", "n!", ""), ("a", "x!", ""), ("a", "x!", ""), ("b", None, "ValueError"), ("c", "!", "")]
    assert A.infer_logged(requests.limit(0), model, f"file://{tmp_path}/log2").count() == 0


def test_cut_lineage(spark, tmp_path):
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        with pytest.raises(ValueError):
            cut_lineage(spark.range(5))
        spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    df = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 20
