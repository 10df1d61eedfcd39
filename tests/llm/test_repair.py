"""Conversation repair next to an exhaustive search over all edits."""
import gc
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import repair
from spanloom.llm.repair import Search, audited, damaged, digests, repaired

SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(rows):
    """(cost, edits) of the cheapest legal edits of [(initial, fault)], every insert of up to two rows at every place tried."""
    inserts = ["".join(x) for n in range(3) for x in itertools.product("ua", repeat=n)]
    best = None
    for tail in inserts:
        per_row = []
        for initial, fault in rows:
            more = 3 if fault == "truncated" else 0
            own = [("D", 4, "")]
            if fault not in ("blank", "duplicate"):
                own += [("K", more, initial)] + [("R", 3 + more, x) for x in "ua"]
            per_row.append([(i, *o) for i in inserts for o in own])
        for choice in itertools.product(*per_row):
            initials = "".join(i + x for i, _, _, x in choice) + tail
            if re.fullmatch("(s?(ua)+)?", initials):
                found = (sum(3 * len(i) + c for i, _, c, _ in choice) + 3 * len(tail), "".join("I" * len(i) + e for i, e, _, _ in choice) + "I" * len(tail))
                best = min(best or found, found)
    return best


def searched(rows):
    search, letters = Search(), []
    for initial, fault in rows:
        letters += search.push(initial if initial in "sua" else "", fault)
    rest, last, cost = search.end()
    return cost, "".join([*letters, *rest, last])


def test_search_matches_every_edit():
    rng = random.Random(11)
    kinds = [(i, f) for i in "suax" for f in ("", "", "truncated", "blank", "duplicate")]
    for n, times in ((1, 40), (2, 120), (3, 25)):
        for _ in range(times):
            rows = [rng.choice(kinds) for _ in range(n)]
            assert searched(rows) == exhaustive(rows), rows


def unpruned(rows):
    """Cheapest (cost, edits) by keeping whole strings for every state, without dropping any survivor."""
    held = {repair.START: (0, "")}
    for initial, fault in rows:
        new = {}
        for state, (cost, letters) in held.items():
            for more, at in repair._INSERTS[state]:
                for letter, price, to in repair._moves(initial, fault):
                    if at in to:
                        key = (cost + 3 * len(more) + price, letters + more + letter)
                        new[to[at]] = min(new.get(to[at], key), key)
        held = new
    return min((cost + 3 * len(x), letters + x) for q, (cost, letters) in held.items() for x, at in repair._INSERTS[q] if at in (repair.START, repair.PAIR))


def test_long_conversations_and_bounded_histories():
    rng = random.Random(12)
    for weights in ([1, 5, 5, 1], [0, 1, 0, 0], [1, 1, 1, 1], [3, 1, 0, 1]):
        rows = [(rng.choices("suax", weights)[0].replace("x", ""), rng.choices(["", "truncated", "blank", "duplicate"], [8, 1, 1, 1])[0]) for _ in range(400)]
        assert searched(rows) == unpruned(rows)
    search, most = Search(), 0
    for i in range(20000):
        search.push("ua"[i % 2] if rng.random() > 0.1 else "s", "blank" if rng.random() < 0.1 else "")
        if i % 500 == 0:
            gc.collect()
            most = max(most, sum(isinstance(x, repair._Node) for x in gc.get_objects()))
    assert most < 200


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_edits_and_texts(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "And?"), (1, 4, "assistant", "cut of"), (1, 5, "user", " \t")]
    got = repaired(table(spark, rows)).orderBy("seq").collect()
    assert "".join(r.edit for r in got[:-1]) == "KKDIKKD"  # an answer is put in, which costs less than dropping a row
    assert tuple(got[3])[1:] == (3, "I", None, "assistant", "", None, None, None)
    stay = [r for r in got[:-1] if r.edit != "I"]
    assert [(r.turn, r.role, r.text, r.was, r.fault) for r in stay] == [(t, role, x, role, f) for (_, t, role, x), f in zip(rows, ["", "", "duplicate", "", "truncated", "blank"])]
    kept = [r for r in got[:-1] if r.edit != "D"]
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept)) and got[-1].edit is None
    codes = [("s", ""), ("u", ""), ("u", "duplicate"), ("u", ""), ("a", "truncated"), ("u", "blank")]
    assert (got[-1].total, "".join(r.edit for r in got[:-1])) == unpruned(codes)
    row = digests(repaired(table(spark, rows))).collect()[0]
    assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest()
    assert (row.gaps, row.blank, row.duplicate, row.truncated, row.illegal) == (0, 1, 1, 1, 2)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    import zlib
    want = []
    for c, t, role, text in rows:
        act = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
        want += [(c, t, "user" if act == 4 else role, text)] * (0 if act == 0 else 2 if act == 3 else 1)
    got = [tuple(r) for r in damaged(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_odd_rows(spark):
    rows = [(None, None, "user", "A?"), (None, None, "user", "A?"), (None, 3, None, None), (None, 9, "assistant", "B."), (2, None, None, "x"), (3, 5, "user", "?" * 500_000 + " " * 500_000),
            (3, 5, "assistant", "Z."), (4, 0, "", "."), (5, 7, "user", "Tie."), (5, 7, "assistant", "Tie."), (5, 7, "user", "Tie.")]
    df = table(spark, rows).withColumns({"c": F.lit(1), "seq": F.lit("x"), "k": F.lit(None), "total": F.lit(2)})
    got = {r.conv_id: r for r in digests(repaired(df)).collect()}
    assert set(got) == {None, 2, 3, 4, 5}
    assert (got[None].duplicate, got[None].blank, got[None].gaps, got[None].audit) == (1, 1, 5, "KDDK")
    assert (got[2].gaps, got[2].truncated, got[2].audit, got[2].cost) == (0, 1, "D", 4)
    assert got[3].truncated == 0 and got[4].audit == "D"
    # equal turns are read by role: the assistant row comes first
    assert (got[5].duplicate, got[5].illegal, got[5].gaps) == (1, 1, 0)
    assert digests(repaired(table(spark, []))).count() == 0 and audited(table(spark, [])).count() == 0


def test_every_conversation_returns(spark):
    import zlib
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = audited(table(spark, [(c, 0, "user", "x.") for c in gone])).collect()
    assert {r.conv_id for r in got} == set(gone)
    assert {(r.audit, r.cost, r.gaps, r.repaired_sha256) for r in got} == {("", 0, 0, hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("hot", [20_000])
def test_one_long_conversation_over_many_batches(spark, hot):
    """A conversation far beyond an Arrow batch gives the same digests as a search over whole strings."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"text {t}" + rng.choice([".", "", "!"])) for t in range(hot)] + [(8, 0, "user", "Hello.")]
    got = {r.conv_id: r for r in digests(repaired(table(spark, rows))).collect()}
    codes = [(r[2][0], "" if r[3][-1] in ".!" else "truncated") for r in rows[:-1]]
    assert (got[7].cost, got[7].audit) == searched(codes) and got[8].audit == "KI"
