"""Exact order statistics for groups of any size.

``percentile`` keeps all distinct values of a group in one aggregation buffer.
Here a group is sorted in one task only if it is known to be small. The span of
a group larger than ``GROUP_ROWS`` is cut into cells of equal width, one pass
counts the rows of each cell and notes its smallest and largest value, and only
the cells that hold a wanted rank between two different values go on. Counts
combine in each task, so what is merged per group is bounded by the cells. Where
equal widths do not part the values after some rounds, a mergeable quantile
sketch names two neighbouring cut points around each wanted rank instead, and one
counting pass proves how many rows lie below, on and between them. The final sort
always sees a bounded number of rows and the answer is exact.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.counts import long_numbers, named
from plumbline.session import cut_lineage, lookup_join

# Largest group that one ranking task takes.
GROUP_ROWS = 1_000_000
# Cells of a group at most, rows of a group per cell at least, and rounds of cells before the sketch.
SPAN_CELLS, CELL_ROWS, ROUNDS = 4096, 64, 3
# Cut points asked of the sketch, and its accuracy (rank error 1/20000).
CELLS = 1000
ACCURACY = 20_000


def _limits(group_rows: int | None) -> int:
    return group_rows or int(os.environ.get("PLUMBLINE_GROUP_ROWS", GROUP_ROWS))


def _sorted_groups(long: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, vs)``: the sorted values of groups proven to hold at most ``GROUP_ROWS`` rows."""
    return long.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("vs"))


def _rank_inside(long: DataFrame, want: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks within small groups, wanted ranks given as a frame."""
    wanted = want.groupBy(*keys).agg(F.collect_list(F.struct("slot", "r")).alias("slots"))
    found = lookup_join(_sorted_groups(long, keys), wanted, keys, "inner")
    picked = F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), F.get("vs", s["r"].cast("int")).alias("v")))
    return found.select(*keys, F.inline(picked))


def _spans(long: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n, lo, hi)``: the rows of each group and the ends of its finite values."""
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    return cut_lineage(long.groupBy(*keys).agg(F.count("*").alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi")))


def _cell() -> Column:
    """The cell of ``v`` in its group's span: never smaller for a larger value, infinities in cells of their own."""
    v, lo, hi, cells = F.col("v"), F.col("lo"), F.col("hi"), F.col("cells")
    share = F.coalesce(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2), F.lit(0.0))  # halves: no overflow
    inside = F.least(F.floor(share * cells), cells - 1)
    infinite = F.when(v == float("inf"), cells).when(v == float("-inf"), F.lit(-1).cast("long"))
    return F.coalesce(infinite, inside)


def _count_cells(long: DataFrame, want: DataFrame, keys: list[str], spans: DataFrame, limit: int,
                 part: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round of cells: resolved slots, the rows still in question, their new ranks and the spans of their cells."""
    parted = F.least(F.lit(SPAN_CELLS), F.ceil(F.col("n") / CELL_ROWS))
    spans = spans.withColumn("cells", F.when(F.col("n") > limit, parted).otherwise(1).cast("long"))
    tagged = lookup_join(long, spans, keys, "inner").select(*keys, "v", _cell().alias("cell"))
    tallies = cut_lineage(tagged.groupBy(*keys, "cell").agg(F.count("*").alias("tally"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    start = F.sum("tally").over(Window.partitionBy(*keys).orderBy("cell")) - F.col("tally")
    inside = F.col("r") - F.col("start")
    placed = tallies.withColumn("start", start).join(want, keys).filter((inside >= 0) & (inside < F.col("tally")))
    placed = cut_lineage(placed.select(*keys, "slot", "cell", inside.alias("r"), "tally", "lo", "hi"))
    found = (F.col("lo") == F.col("hi")) | (F.col("r") == 0) | (F.col("r") == F.col("tally") - 1)
    settled = placed.filter(found).select(*keys, "slot", F.when(F.col("r") == 0, F.col("lo")).otherwise(F.col("hi")).alias("v"))
    left = placed.filter(~found).withColumnRenamed("cell", part)
    asked = spans.join(left.groupBy(*keys).agg(F.collect_set(part).alias("open")), keys)
    tagged = lookup_join(long, asked, keys, "inner").select(*keys, "v", "open", _cell().alias(part))
    rest = tagged.filter(F.array_contains("open", F.col(part))).select(*keys, "v", part)
    deeper = left.select(*keys, part, F.col("tally").alias("n"), "lo", "hi").distinct()
    return settled, rest, left.select(*keys, part, "slot", "r"), deeper


def _narrow(long: DataFrame, want: DataFrame, keys: list[str], part: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of cut points: resolved slots, the rows still in question and their new ranks."""
    grid = [i / CELLS for i in range(CELLS + 1)]
    sketch = cut_lineage(
        long.groupBy(*keys).agg(
            F.count("*").alias("n"), F.percentile_approx("v", grid, ACCURACY).alias("cuts")
        )
    )
    at = F.floor(F.try_divide(F.col("r").cast("double"), F.col("n") - 1) * CELLS).cast("int")
    low, high = F.col("cell") - 1, F.col("cell") + 2
    cells = (
        want.join(sketch, keys)
        .withColumn("cell", F.coalesce(at, F.lit(0)))
        .withColumn("lo", F.when(low >= 0, F.get("cuts", low)).otherwise(F.lit(float("-inf"))))
        .withColumn("hi", F.when(high <= CELLS, F.get("cuts", high)).otherwise(F.lit(float("inf"))))
    )
    per_key = cells.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("slot", "r", "lo", "hi"))).alias("cells")
    )
    per_key = cut_lineage(per_key)
    slots = per_key.select(F.max(F.size("cells"))).first()[0] or 0
    tagged = lookup_join(long, per_key, keys, "inner")
    tallies = []
    for i in range(slots):
        lo, hi = F.get("cells", F.lit(i))["lo"], F.get("cells", F.lit(i))["hi"]
        tallies.append(
            F.struct(
                F.count_if(F.col("v") < lo).alias("below"),
                F.count_if(F.col("v") == lo).alias("on_lo"),
                F.count_if((F.col("v") > lo) & (F.col("v") < hi)).alias("between"),
            )
        )
    # Only counts are aggregated: with the cells as a further aggregate, every row would be sorted with its copy of them.
    counted = lookup_join(tagged.groupBy(*keys).agg(F.array(*tallies).alias("tally")), per_key, keys, "inner")
    placed = cut_lineage(
        counted.select(*keys, F.inline(F.arrays_zip("cells", "tally"))).select(*keys, "cells.*", "tally.*")
    )
    start = F.col("below") + F.col("on_lo")
    after = start + F.col("between")
    settled = placed.filter((F.col("r") < start) | (F.col("r") >= after))
    settled = settled.select(*keys, "slot", F.when(F.col("r") < start, F.col("lo")).otherwise(F.col("hi")).alias("v"))
    open_cells = placed.filter((F.col("r") >= start) & (F.col("r") < after))
    ranges = open_cells.groupBy(*keys).agg(F.collect_list(F.struct("slot", "lo", "hi")).alias("cells"))
    inside = lookup_join(long, ranges, keys, "inner")
    hit = F.filter("cells", lambda c: (F.col("v") > c["lo"]) & (F.col("v") < c["hi"]))
    rest = inside.select(*keys, "v", F.inline(F.transform(hit, lambda c: F.struct(c["slot"].alias(part)))))
    wanted = open_cells.select(*keys, F.col("slot").alias(part), F.col("slot"), (F.col("r") - start).alias("r"))
    return settled, rest, wanted


def _largest(spans: DataFrame) -> int:
    return spans.agg(F.max("n")).first()[0] or 0


def at_ranks(long: DataFrame, want: DataFrame, keys: list[str], group_rows: int | None = None,
             largest: int | None = None, spans: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``(keys, slot, v)``: the value at zero-based rank ``r`` of each group.

    ``long`` holds ``keys`` and a non-missing double ``v``; ``want`` holds
    ``keys, slot, r``. ``largest`` and ``spans`` are given where they are known.
    """
    limit, part = _limits(group_rows), f"part{len(keys)}"
    if largest is None:
        spans = _spans(long, keys) if spans is None else spans
        largest = _largest(spans)
    if largest <= limit:
        return _rank_inside(long, want, keys)
    if rounds:
        settled, rest, wanted, deeper = _count_cells(long, want, keys, _spans(long, keys) if spans is None else spans, limit, part)
        if wanted.isEmpty():
            return settled
        below = at_ranks(rest, wanted, [*keys, part], group_rows, spans=deeper, rounds=rounds - 1)
    else:
        settled, rest, wanted = _narrow(long, want, keys, part)
        below = at_ranks(rest, wanted, [*keys, part], group_rows)
    return settled.unionByName(below.select(*keys, "slot", "v"))


def grouped_quantiles(df: DataFrame, keys: list[str], value: Column, probabilities: list[float],
                      nearest: bool = False, group_rows: int | None = None,
                      rows: int | None = None) -> DataFrame:
    """``(keys, p, value)`` per group; ``rows`` is the row count if already known.

    Linear interpolation between neighbours, or the nearest rank
    ``round((n - 1) * p)`` with halves to even.
    """
    long = df.select(*keys, value.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    limit = _limits(group_rows)
    # A table within the limit cannot hold a larger group; only a larger one is counted by group.
    if (df.count() if rows is None else rows) <= limit or (largest := _largest(spans := _spans(long, keys))) <= limit:
        return _small_quantiles(long, keys, probabilities, nearest)
    sizes = spans.select(*keys, "n")
    spots = []
    for i, p in enumerate(probabilities):
        for j, end in enumerate(_ends(F.col("n"), p, nearest)):
            spots.append(F.struct(F.lit(2 * i + j).alias("slot"), end.alias("r")))
    want = sizes.select(*keys, F.inline(F.array(*spots)))
    found = at_ranks(long, want, keys, group_rows, largest, spans)
    pairs = found.groupBy(*keys, F.floor(F.col("slot") / 2).cast("int").alias("i")).agg(
        F.min("v").alias("a"), F.max("v").alias("b")
    )
    p = F.get(F.array(*[F.lit(float(x)) for x in probabilities]), F.col("i"))
    if nearest:
        return pairs.select(*keys, p.alias("p"), F.col("a").alias("value"))
    mix = _mix(F.col("a"), F.col("b"), F.col("n"), p)
    return lookup_join(pairs, sizes, keys, "inner").select(*keys, p.alias("p"), mix.alias("value"))


def _ends(n: Column, p, nearest: bool) -> list[Column]:
    """Zero-based ranks on both sides of a probability, or the one nearest rank."""
    place = (n - 1) * F.lit(float(p))
    ends = [F.bround(place)] if nearest else [F.floor(place), F.ceil(place)]
    return [e.cast("long") for e in ends]


def _mix(a: Column, b: Column, n: Column, p: Column) -> Column:
    place = (n - 1) * p
    return a + (b - a) * (place - F.floor(place))


def _small_quantiles(long: DataFrame, keys: list[str], probabilities: list[float], nearest: bool) -> DataFrame:
    """All groups are within the limit: one shuffle, then positions in the sorted values."""
    groups = _sorted_groups(long, keys).withColumn("n", F.size("vs"))
    cells = []
    for p in probabilities:
        ends = [F.get("vs", r.cast("int")) for r in _ends(F.col("n"), p, nearest)]
        value = ends[0] if nearest else _mix(ends[0], ends[-1], F.col("n"), F.lit(float(p)))
        cells.append(F.struct(F.lit(float(p)).alias("p"), value.alias("value")))
    return groups.select(*keys, F.inline(F.array(*cells)))


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
                     group_rows: int | None = None, approximate: bool = False) -> DataFrame:
    """``(column, p, value)`` for numeric columns; ``approximate`` answers from a sketch."""
    long = long_numbers(df, columns)
    if approximate:
        sketch = long.groupBy("c").agg(F.percentile_approx("num", probabilities, ACCURACY).alias("q"))
        listed = F.array(*[F.lit(float(p)) for p in probabilities])
        found = sketch.select("c", F.inline(F.arrays_zip(listed.alias("p"), F.col("q").alias("value"))))
    else:
        found = grouped_quantiles(long, ["c"], F.col("num"), probabilities, group_rows=group_rows, rows=df.count())
    return named(found, columns)


def quantile_map(df: DataFrame, columns: list[str], probabilities: list[float],
                 group_rows: int | None = None) -> dict[str, dict[float, float]]:
    """Quantiles per column on the driver: one number per column and probability."""
    out: dict[str, dict[float, float]] = {c: {} for c in columns}
    if columns:
        for row in column_quantiles(df, columns, probabilities, group_rows).collect():
            out[row["column"]][row["p"]] = row["value"]
    return out
