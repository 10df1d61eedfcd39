"""Personal data: fixed forms next to their plain regexes, discovery next to a plain version of the graph."""
import hashlib
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.llm import pii
from spanloom.llm.pii import BASE, base_spans, candidates, contexts, digest_columns, scan

SCHEMA = "doc_id long, text string"
FORMS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, form in enumerate(FORMS):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else 0, 13 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_fixed_forms_match_their_regexes():
    rng = random.Random(1)
    for alphabet in ("a.@-", "12.0", "1 -4", "+1 (2)", "a1.@+- ()%é", "25.@"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert base_spans(text) == plain(text), text


def test_given_texts(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in digest_columns(scan(spark.read.parquet(f"{small}/documents.parquet"))).collect()}
    assert len(got) == len(rows)
    for r in rows:
        spans = plain(r.text or "")
        text = ",".join(f"{BASE[k]}:{a}:{b}" for k, a, b in spans)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in BASE] == [sum(s[0] == i for s in spans) for i in range(4)]
        assert got[r.doc_id].spans.startswith(text)


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "@", "a@", "+1", "+1 ", "a@b.", "(", "1-", "1.1.1.1@", "a:", " 1("])
def test_long_texts_take_linear_time(unit):
    start = time.time()
    pii._marks(unit * (1_000_000 // len(unit)))
    assert time.time() - start < 20


def test_candidates_and_contexts():
    text = "Reach Ann Lee at box 4417-22x or 0171 555 0199, or ann@b.org now."
    found = [text[a:b] for a, b in candidates(text, base_spans(text))]
    assert found == ["4417-22x", "0171 555 0199"]
    a = text.index("0171")
    assert contexts(text, a, a + 13) == ["x or <>", "box x or <>", "or <> or"]
    assert contexts("42", 0, 2) == []


def bootstrapped(docs, rounds=pii.ROUNDS):
    """Trusted patterns by plain loops."""
    held = defaultdict(dict)
    for text in docs.values():
        for m in pii._marks(text):
            for p in m["patterns"]:
                old = held[p].get(m["value"], -1)
                held[p][m["value"]] = m["kind"] if old < 0 else min(old, m["kind"]) if m["kind"] >= 0 else old
    score, trusted = {}, {}
    for turn in range(rounds):
        trusted = {}
        for p, values in held.items():
            sums, counts, open_ = [0] * 4, [0] * 4, 0
            for v, k in values.items():
                k, s = (k, 1000) if k >= 0 else score.get(v, (-1, 0))
                if k < 0:
                    open_ += 1
                else:
                    sums[k], counts[k] = sums[k] + s, counts[k] + 1
            best = max((1000 * sums[k] // (sum(sums) + 500 * open_ + 1000), -k, counts[k]) for k in range(4))
            if best[0] >= pii.TRUST and best[2] >= pii.SUPPORT and len(values) >= pii.SUPPORT:
                trusted[p] = (-best[1], best[0])
        score = {}
        for p, (k, s) in trusted.items():
            for v, own in held[p].items():
                if own < 0:
                    score[v] = max(score.get(v, (9, 0)), (k, s), key=lambda x: (x[1], -x[0]))
    return trusted


def corpus(rng):
    words = "alpha beta gamma delta river stone cloud".split()
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = {}
    for i in range(60):
        number = f"+1 (555) 010-{1000 + i}"
        docs[i] = f"{some(6)} you may call her at {number} before noon {some(5)}"
        docs[100 + i] = f"{some(6)} please write mail to user{i}@mail.example.com for help {some(4)}"
        docs[200 + i] = f"{some(6)} the sum of {rng.randint(10000, 99999)} crates {some(4)}"
    # unseen forms in known contexts, then a second context that only they share
    for i in range(8):
        docs[300 + i] = f"{some(5)} you may call her at 0171 555 01{i:02d} before noon. {some(3)}"
        docs[310 + i] = f"{some(5)} ring the back office on 0171 555 01{i:02d} today {some(3)}"
    docs[320] = f"{some(5)} ring the back office on 0999 222 333 today {some(3)}"
    docs[330] = f"{some(5)} please write mail to root@localhost for help {some(3)}"
    return docs


def test_contexts_discover_unseen_identifiers(spark):
    docs = corpus(random.Random(3))
    df = spark.createDataFrame(list(docs.items()), SCHEMA).repartition(5)
    found = {r.doc_id: [(s.kind, docs[r.doc_id][s.start:s.end]) for s in r.spans] for r in scan(df).collect()}
    assert found[300] == [("found_phone", "0171 555 0100")] and found[310] == [("found_phone", "0171 555 0100")]
    assert found[320] == [("found_phone", "0999 222 333")]  # a pattern learned from discovered values only
    assert found[330] == [("found_email", "root@localhost")]
    assert not any(k.startswith("found") for i in range(200, 260) for k, _ in found[i])
    assert all(len(found[i]) == 1 for i in [*range(60), *range(100, 160)])
    base = pii.marked(df, "text", ["doc_id"])
    assert {r.pattern: (r.kind, r.score) for r in pii.learned(base).collect()} == bootstrapped(docs)


def test_given_patterns_match_plain_loops(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    docs = dict(enumerate(r.text for r in df.select("text").collect()))
    assert {r.pattern: (r.kind, r.score) for r in pii.learned(pii.marked(df, "text", ["doc_id"])).collect()} == bootstrapped(docs)


def test_odd_rows(spark):
    rows = [(None, None), (None, "a@b.cd"), (1, ""), (2, "a@b.cd"), (2, "a@b.cd"), (3, "x" * 300_000 + " 1.2.3.4 " + "9" * 5000), (4, "1.2.3.256 1.2.3.4.5.6.7.8 é 010.0.0.1")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"spans": F.lit(1), "kind": F.lit("x"), "pattern": F.lit("y"), "_row": F.lit(3), "MARKS": F.lit(2), "rank": F.lit(None)})
    got = scan(df)
    assert got.columns == ["doc_id", "text", "kind", "pattern", "rank", "spans"]
    out = sorted(((r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.spans]) for r in got.collect()), key=str)
    assert out == sorted([(0, []), (0, [("email", 0, 6)]), (1, []), (2, [("email", 0, 6)]), (2, [("email", 0, 6)]), (3, [("ip", 300_001, 300_008)]),
                          (4, [("ip", 10, 17), ("ip", 18, 25), ("ip", 28, 37)])], key=str)
    assert digest_columns(scan(spark.createDataFrame([], SCHEMA))).count() == 0
