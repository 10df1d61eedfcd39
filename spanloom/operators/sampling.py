"""Windows over groups, top-k, samples, chunks.

A sample is the head of an order by md5(seed:key): the same data and seed give the same
rows on any cluster. Groups may be very large, so heads are taken in two steps, inside
hash shares of a group and then over the heads of the shares.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spanloom.functions.spans import let

SHARES = 32


def latest_answers(df: DataFrame, key, readable, order) -> DataFrame:
    """One row per key: the last readable one, or the last one if none is readable.

    An aggregate with map-side combine and no window, so a hot key is no problem.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(F.coalesce(readable, F.lit(False)), *order)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*keys, "_row.*")


def first_wins(df: DataFrame, keys, priority) -> DataFrame:
    """One row per key, the one with the lowest priority."""
    rest = [c for c in df.columns if c not in keys]
    order = [priority] if isinstance(priority, str) else list(priority)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def latest_status(status: DataFrame, statuses) -> DataFrame:
    """Latest status per text by (tagged_at, seq), among the known ones."""
    return (status.filter(F.col("status").isin(*statuses)).groupBy("text_id")
            .agg(F.max_by("status", F.struct("tagged_at", "seq")).alias("status")))


def top_k(df: DataFrame, group, k: int, order, rank="rank") -> DataFrame:
    """First k rows per group. The shares of a group are cut to k rows each first."""
    group = [group] if isinstance(group, str) else list(group)
    order = order if isinstance(order, (list, tuple)) else [order]
    share = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(SHARES))
    part = W.partitionBy(*group, "_share").orderBy(*order)
    heads = (df.withColumn("_share", share).withColumn("_r", F.row_number().over(part))
             .filter(F.col("_r") <= k).drop("_r", "_share"))
    if not group:
        return heads.orderBy(*order).limit(k)
    whole = W.partitionBy(*group).orderBy(*order)
    return heads.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)


def draw_key(seed, *cols):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample_hits(df: DataFrame, n: int, seed, ids, group=()) -> DataFrame:
    """Seeded sample of n rows per group, with the group's total."""
    group = [group] if isinstance(group, str) else list(group)
    keyed = df.withColumn("_draw", draw_key(seed, *ids))
    if not group:
        total = df.select(F.count(F.lit(1))).scalar()
        return keyed.orderBy("_draw").limit(n).withColumn("total", total).drop("_draw")
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    return top_k(keyed, group, n, "_draw", "_r").join(totals, group).drop("_draw", "_r")


def balanced_sample(df: DataFrame, group: str, n: int, seed, id_col: str, parts=("A", "B")) -> DataFrame:
    """Round-robin over groups up to n rows, then split in equal parts by a second draw."""
    keyed = df.withColumn("_draw", draw_key(seed, id_col))
    turns = top_k(keyed, group, n, "_draw", "turn")
    taken = turns.orderBy("turn", "_draw").limit(n)
    size = n // len(parts)
    order = W.orderBy(draw_key("%s/part" % seed, id_col))                   # n rows at most
    labels = F.array(*map(F.lit, parts))
    place = F.row_number().over(order) - 1
    return taken.withColumn("part", F.get(labels, F.least((place / size).cast("int"), F.lit(len(parts) - 1)))).drop("_draw")


def stratified_sample(df: DataFrame, cell: str, n: int, seed, id_col: str) -> DataFrame:
    """n rows of each cell by draw order."""
    return top_k(df.withColumn("_draw", draw_key(seed, id_col)), cell, n, "_draw", "_r").drop("_draw", "_r")


#: Ranges into which a table's order is cut where rows are numbered, and how many sampled keys stand for one bound.
RANGES, PER_BOUND = 1024, 2


def place_in(bounds, value) -> Column:
    """How many of the sorted ``bounds`` (``RANGES`` at most) are no greater than ``value``, by halving."""
    def halve(arr, low, step):
        if not step:
            return low
        fits = (low + step <= F.size(arr)) & (F.get(arr, low + step - 1) <= value)
        return let(F.when(fits, low + step).otherwise(low), lambda at: halve(arr, at, step // 2))

    return let(bounds, lambda arr: halve(arr, F.lit(0), RANGES // 2))


def in_ranges(df: DataFrame, order, distinct: DataFrame | None = None, name="_b") -> DataFrame:
    """``df`` with the number of the range of ``order`` (columns) that a row lies in: up to ``RANGES`` of about equal size,
    whatever the values are. ``distinct`` has the order's columns once each, where the caller has that already.

    The bounds are the values with the least hashes, a sample that depends on neither the partitions nor on when it is
    drawn, so every use of the same rows cuts them alike. They are a scalar of at most ``RANGES`` values.
    """
    key = F.struct(*order)
    values = (df.select(*order).distinct() if distinct is None else distinct).select(key.alias("_o"))
    least = values.orderBy(F.hash("_o"), "_o").limit(RANGES * PER_BOUND)
    bounds = least.agg(F.array_sort(F.collect_list("_o")).alias("a")).select(F.slice(F.filter("a", lambda _, i: i % PER_BOUND == 1), 1, RANGES - 1))
    return df.withColumn("_bounds", bounds.scalar()).withColumn(name, place_in(F.col("_bounds"), key)).drop("_bounds")


def before(sums: DataFrame, key, value: str, name: str) -> DataFrame:
    """``sums`` (one row per ``key``, a column or several) with the sum of ``value`` over smaller keys, null first.

    Rows are cut into ``in_ranges``: the sums of the ranges before, which a window over ``RANGES`` rows gives, and the running
    sum inside the range. Keys may lie anywhere, such as hashes of 64 bits.
    """
    key = [key] if isinstance(key, str) else list(key)
    placed = in_ranges(sums, key, sums)
    tops = placed.groupBy("_b").agg(F.sum(value).alias("_s"))
    tops = tops.select("_b", (F.sum("_s").over(W.orderBy("_b")) - F.col("_s")).alias("_bb"))
    own = F.sum(value).over(W.partitionBy("_b").orderBy(*key)) - F.col(value)
    return placed.withColumn("_o", own).join(tops, "_b").withColumn(name, F.col("_bb") + F.col("_o")).drop("_b", "_o", "_bb")


#: Rows of a share or range that one window numbers.
WINDOW_ROWS = 100_000


def chunk(df: DataFrame, size: int, order, shares: int | None = None, key=None) -> DataFrame:
    """Number rows and cut them into chunks of ``size``: chunk id, place in the chunk from 1.

    Numbers run inside hash shares of the key; no window spans the whole table. Where
    ``shares`` is not given, the rows are counted and a share has ``WINDOW_ROWS`` of them.
    """
    if shares is None:
        shares = max(SHARES, -(-df.count() // WINDOW_ROWS))
    order = order if isinstance(order, (list, tuple)) else [order]
    keyed = df.withColumn("share", F.pmod(F.xxhash64(*(key or order)), F.lit(shares)))
    place = F.row_number().over(W.partitionBy("share").orderBy(*order)) - 1
    return (keyed.withColumn("_p", place).withColumn("chunk", (F.col("_p") / size).cast("int"))
            .withColumn("no", (F.col("_p") % size + 1).cast("int")).drop("_p"))


def chunk_in_order(df: DataFrame, size: int, key: str, then: str | None = None) -> DataFrame:
    """Like ``chunk`` with all rows in one share, in the order of ``key`` and ``then`` (null first), but a row's number is a
    sum: the rows of smaller ranges of that order, whatever its values are, and its place in its range.
    """
    order = [key, then] if then else [key]
    placed = in_ranges(df, order)
    starts = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_b").orderBy(*order)) - 1
    placed = placed.withColumn("_i", inside).join(starts, "_b").withColumn("_p", F.col("_start") + F.col("_i"))
    return (placed.withColumn("share", F.lit(0).cast("long")).withColumn("chunk", F.floor(F.col("_p") / size).cast("int"))
            .withColumn("no", (F.col("_p") % size + 1).cast("int")).drop("_b", "_i", "_start", "_p"))


def numbered(df: DataFrame, group, order, name="no") -> DataFrame:
    """Number the lines of each request. A request is bounded by what a model can read."""
    group = [group] if isinstance(group, str) else list(group)
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)))


def anonymise(df: DataFrame, id_col: str, per: int, seed, low: int = 1000):
    """(items, map): items without the id, grouped ``per`` to a prompt in drawn order; the map
    from item number to id is kept apart. Numbers are dense from ``low`` in drawn order.

    The draw is cut into ranges of the md5, as many as the rows ask for, numbered inside the
    range, and shifted by the size of the ranges before it.
    """
    digits, n = 3, df.count()
    while digits < 12 and n > WINDOW_ROWS * 16 ** digits:
        digits += 1
    drawn = df.withColumn("_draw", draw_key(seed, id_col))
    drawn = drawn.withColumn("_range", F.conv(F.substring("_draw", 1, digits), 16, 10).cast("long"))
    sizes = before(drawn.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")), "_range", "_n", "_before").select("_range", "_before")
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_draw", id_col))
    ranked = drawn.join(sizes, "_range").withColumn("_rank", F.col("_before") + inside - 1)
    items = ranked.withColumn("item", F.col("_rank") + low).withColumn("prompt", F.floor(F.col("_rank") / per))
    clean = items.drop("_draw", "_range", "_before", "_rank")
    return clean.drop(id_col), clean.select("item", id_col, "prompt")


def restore(answers: DataFrame, item_map: DataFrame) -> DataFrame:
    """Put the id back on anonymised answers."""
    return answers.join(item_map.drop("prompt"), "item")


def page(df: DataFrame, sort, n: int) -> DataFrame:
    """First n rows; ``sort`` is [(column, 1 or -1)], NULL last in either direction."""
    keys = [F.col(c).asc_nulls_last() if d > 0 else F.col(c).desc_nulls_last() for c, d in sort]
    return df.orderBy(*keys).limit(n)


def shuffled(df: DataFrame, seed, id_col: str) -> DataFrame:
    """A reproducible reading order."""
    return df.orderBy(draw_key(seed, id_col), id_col)


def todo(ids: DataFrame, answered: DataFrame, batches: DataFrame, key="text_id", limit=None) -> DataFrame:
    """Ids neither answered nor in a batch that is open or done. Ids of failed, expired and
    cancelled batches are sent again."""
    sent = batches.filter(~F.coalesce("status", F.lit("open")).isin("failed", "expired", "cancelled"))
    left = ids.join(answered.select(key).distinct(), key, "left_anti").join(sent.select(key).distinct(), key, "left_anti")
    return left.orderBy(key).limit(limit) if limit else left


def equal_groups(df: DataFrame, order, n: int = 8, measures=()) -> DataFrame:
    """Shares of boolean ``measures`` over n equal groups by ``order``; the remainder is left out.

    Rows with equal keys are counted first, and the counts are laid along the line of
    ranks range by range, so neither the table nor its keys are sorted as a whole. The
    measures break ties, so equal rows are interchangeable.
    """
    keys = [order, *measures]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    laid = before(counted, keys, "_n", "_from").withColumn("_to", F.col("_from") + F.col("_n"))
    size = F.floor(counted.select(F.sum("_n")).scalar() / n)
    cut = laid.withColumn("_size", size).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    part = F.least("_to", (F.col("grp") + 1) * F.col("_size")) - F.greatest("_from", F.col("grp") * F.col("_size"))
    held = cut.withColumn("_k", part).filter(F.col("_k") > 0)
    return held.groupBy("grp").agg(
        F.sum("_k").alias("n"), F.min(order).alias("low"), F.max(order).alias("high"),
        *[F.round(100.0 * F.sum(F.when(F.col(m), F.col("_k")).otherwise(0)) / F.sum("_k"), 1).alias(m + "_pct")
          for m in measures])


def upper_median(df: DataFrame, group, value: str, name="median") -> DataFrame:
    """The element at index n div 2 of the sorted values, exactly, from a histogram."""
    group = [group] if isinstance(group, str) else list(group)
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    along = W.partitionBy(*group).orderBy(value)
    reach = counts.withColumn("_c", F.sum("_n").over(along)).withColumn("_t", F.sum("_n").over(W.partitionBy(*group)))
    return reach.filter(F.col("_c") > F.floor(F.col("_t") / 2)).groupBy(*group).agg(F.min(value).alias(name))
