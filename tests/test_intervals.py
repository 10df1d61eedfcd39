"""Interval operators against loops over small data, for several bucket widths."""
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import intervals as I


def rows(n, seed, keys=3, span=60):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        s = r.randrange(400)
        out.add((r.choice([0, 0, 0, *range(keys)]), s, s + r.randrange(0, span)))    # key 0 is hot
    return sorted(out)


@pytest.fixture(scope="module")
def sides(spark):
    ddl = "k int, start int, end int"
    a, b = rows(120, 1), rows(90, 2)
    return a, b, spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl)


@pytest.mark.parametrize("width", [7, 64, 4096])
def test_joins(sides, width):
    a, b, da, db = sides
    over = lambda x, y: x[0] == y[0] and x[1] < y[2] and x[2] > y[1]
    inside = lambda x, y: x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2]
    got, gone = I.overlap_join(da, db, ["k"], width)
    want = [x for x in a if any(over(x, y) for y in b)]
    assert sorted(map(tuple, got.select("k", "start", "end").collect())) == want
    assert sorted(map(tuple, gone.select("k", "start", "end").collect())) == [x for x in a if x not in want]
    pairs = sorted((r.k, r.start, r.end, r.r_start, r.r_end) for r in I.overlap_pairs(da, db, ["k"], width).collect())
    assert pairs == sorted((*x, y[1], y[2]) for x in a for y in b if over(x, y))
    held = sorted(map(tuple, I.caught(da, db, ["k"], width).select("k", "start", "end").collect()))
    assert held == [x for x in a if any(inside(x, y) for y in b)]
    free = sorted(map(tuple, I.not_covered(da, db, ["k"], width).select("k", "start", "end").collect()))
    assert free == [x for x in a if x not in held]


@pytest.mark.parametrize("width", [7, 64, 4096])
def test_merge_covers_the_same_positions(sides, width):
    a, _, da, _ = sides
    merged = sorted(map(tuple, I.merge_spans(da, ["k"], gap=1, width=width).collect()))
    for k in {x[0] for x in a}:
        mine = sorted(x for x in a if x[0] == k)
        want = []
        for _, s, e in mine:
            if want and s <= want[-1][1] + 1:
                want[-1][1] = max(want[-1][1], e)
            else:
                want.append([s, e])
        assert [[s, e] for kk, s, e in merged if kk == k] == want


@pytest.mark.parametrize("width", [7, 64, 4096])
def test_asof_and_locate(spark, sides, width):
    a, b, da, db = sides
    marks = sorted({(k, s, "t%d" % s) for k, s, _ in b})
    got = {(r.k, r.start, r.end): r.title for r in I.asof_last(
        da, spark.createDataFrame(marks, "k int, start int, title string"), ["k"], "title", default="", width=width).collect()}
    for k, s, e in a:
        before = [m for m in marks if m[0] == k and m[1] <= s]
        assert got[(k, s, e)] == (max(before, key=lambda m: m[1])[2] if before else "")
    points = da.select("k", F.col("start").alias("pos")).distinct()
    first = {(r.k, r.pos): (r.r_start, r.r_end) for r in I.locate_in(points, db, ["k"], width=width).collect()}
    for k, p in {(x[0], x[1]) for x in a}:
        hold = sorted((s, e) for kk, s, e in b if kk == k and s <= p < e)
        assert first.get((k, p)) == (hold[0] if hold else None)


def test_no_nested_loop(sides):
    _, _, da, db = sides
    for df in (I.overlap_pairs(da, db, ["k"]), I.caught(da, db, ["k"]), I.merge_spans(da, ["k"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
