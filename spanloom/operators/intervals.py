"""Interval, containment and as-of joins, and interval merging.

All of them carry an equality on the text. A text (or user, or source) may hold a third of
all rows, so positions are cut into buckets that join and sort on their own; results do
not depend on the bucket width.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

WIDTH = 4096


def _bucket(pos, width):
    return F.floor(pos / F.lit(width)).cast("long")


def over_buckets(df: DataFrame, width: int = WIDTH, start="start", end="end", name="_bucket") -> DataFrame:
    """One row per bucket that [start, end) touches."""
    last = F.greatest(F.col(end) - 1, F.col(start))
    return df.withColumn(name, F.explode(F.sequence(_bucket(F.col(start), width), _bucket(last, width))))


def _renamed(df, keys, prefix="r_"):
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def overlap_pairs(left, right, keys, width: int = WIDTH) -> DataFrame:
    """Pairs of intervals that overlap; right columns get the prefix r_. Each pair meets once,
    in the bucket where the later of the two begins."""
    l = over_buckets(left, width)
    r = over_buckets(_renamed(right, keys), width, "r_start", "r_end")
    joined = l.join(r, [*keys, "_bucket"])
    return joined.filter((F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))
                         & (F.col("_bucket") == _bucket(F.greatest("start", "r_start"), width))).drop("_bucket")


def _touching(left, right, keys, width):
    ids = [*keys, "start", "end"]
    l = over_buckets(left.select(*ids), width).alias("l")
    r = over_buckets(right.select(*ids), width).alias("r")
    same = reduce(lambda a, b: a & b, [F.col("l." + k) == F.col("r." + k) for k in [*keys, "_bucket"]])
    hit = same & (F.col("l.start") < F.col("r.end")) & (F.col("l.end") > F.col("r.start"))
    return l.join(r, hit, "left_semi").select(*ids).distinct()


def overlap_join(left, right, keys, width: int = WIDTH):
    """(matched, unmatched) rows of ``left``: does any right interval of the key overlap."""
    ids = [*keys, "start", "end"]
    met = _touching(left, right, keys, width)
    return left.join(met, ids, "left_semi"), left.join(met, ids, "left_anti")


def overlap_flag(left, right, keys, name="alive", width: int = WIDTH) -> DataFrame:
    """``left`` with a boolean: some right interval of the key overlaps."""
    met = _touching(left, right, keys, width).withColumn(name, F.lit(True))
    return left.join(met, [*keys, "start", "end"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _inside(left, right, keys, how, width):
    l = left.withColumn("_bucket", _bucket(F.col("start"), width)).alias("l")
    r = over_buckets(right.select(*keys, "start", "end"), width).alias("r")
    same = reduce(lambda a, b: a & b, [F.col("l." + k) == F.col("r." + k) for k in [*keys, "_bucket"]])
    cond = same & (F.col("r.start") <= F.col("l.start")) & (F.col("l.end") <= F.col("r.end"))
    return l.join(r, cond, how).drop("_bucket")


def caught(left, right, keys, width: int = WIDTH) -> DataFrame:
    """Left intervals that lie wholly inside one right interval."""
    return _inside(left, right, keys, "left_semi", width)


def not_covered(left, right, keys, width: int = WIDTH) -> DataFrame:
    """Left intervals that lie inside no right interval."""
    return _inside(left, right, keys, "left_anti", width)


def locate_in(points, intervals, keys, pos="pos", width: int = WIDTH) -> DataFrame:
    """The first interval that holds each point; points in none are left out."""
    p = points.withColumn("_bucket", _bucket(F.col(pos), width))
    i = over_buckets(_renamed(intervals, keys), width, "r_start", "r_end")
    held = p.join(i, [*keys, "_bucket"]).filter((F.col("r_start") <= F.col(pos)) & (F.col(pos) < F.col("r_end")))
    rest = [c for c in i.columns if c not in (*keys, "_bucket", "r_start", "r_end")]
    first = held.groupBy(*points.columns).agg(F.min(F.struct("r_start", "r_end", *rest)).alias("_first"))
    return first.select(*points.columns, *[F.col("_first." + c).alias(c) for c in ("r_start", "r_end", *rest)])


def running(df, keys, order, value, how, name, bucket="_bucket", inclusive=False) -> DataFrame:
    """Running 'max' of, or 'last' non-null, ``value`` over the earlier rows of a key.

    Two steps: inside each bucket, and over one summary row per bucket. No task sorts a
    whole key.
    """
    step = {"max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    if how == "max":
        top = F.max(value)
    else:
        top = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    tops = df.groupBy(*keys, bucket).agg(top.alias("_top"))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select(*keys, bucket, step("_top").over(before).alias("_carry"))
    local = df.withColumn("_local", step(value).over(inside)).join(carried, [*keys, bucket])
    both = F.greatest("_local", "_carry") if how == "max" else F.coalesce("_local", "_carry")
    return local.withColumn(name, both).drop("_local", "_carry")


def merge_spans(df, keys, gap: int = 1, width: int = WIDTH) -> DataFrame:
    """Merge intervals of a key that overlap, touch, or lie ``gap`` or less apart."""
    longest = df.groupBy(*keys, "start").agg(F.max("end").alias("end"))      # map-side, bounds a key
    spans = longest.withColumn("_bucket", _bucket(F.col("start"), width))
    reached = running(spans, keys, ["start"], "end", "max", "_reach")
    opens = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap), F.col("start"))
    marked = running(reached.withColumn("_open", opens), keys, ["start"], "_open", "last", "_island", inclusive=True)
    return (marked.groupBy(*keys, "_island").agg(F.max("end").alias("end"))
            .select(*keys, F.col("_island").alias("start"), "end"))


def asof_last(points, events, keys, value, pos="start", default=None, width: int = WIDTH) -> DataFrame:
    """Value of the nearest event at or before each point."""
    rows = points.withColumn("_kind", F.lit(1)).withColumn(value, F.lit(None).cast(events.schema[value].dataType))
    marks = events.select(*keys, pos, value).withColumn("_kind", F.lit(0))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_bucket", _bucket(F.col(pos), width))
    filled = running(both, keys, [pos, "_kind"], value, "last", "_found", inclusive=True)
    found = F.col("_found") if default is None else F.coalesce("_found", F.lit(default))
    return filled.filter(F.col("_kind") == 1).select(*points.columns, found.alias(value))


def coverage(spans, lengths, keys) -> DataFrame:
    """Characters covered and number of spans per key, with the text's length."""
    per = spans.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"),
                                   F.count(F.lit(1)).alias("n_spans"))
    return lengths.join(per, [*keys], "left").fillna(0, ["covered", "n_spans"])
