"""As-of, range and interval-overlap joins as plans of equi-joins, sorts and windows.

None of the plans compares all rows of two tables: there is no join on an inequality alone. Time and number columns
serve alike; timestamps and dates are compared in microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType, DecimalType, IntegralType, NumericType, TimestampNTZType, TimestampType

from plumbline.session import col, cut_lineage

# Rows of one key that are sorted together; a key with more is cut into buckets of time.
BUCKET_ROWS = 1_000_000


def axis(df: DataFrame, name: str) -> Column:
    """The column on a number line: microseconds for dates and timestamps."""
    kind = df.schema[name].dataType
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.unix_micros(col(name).cast("timestamp"))
    if not isinstance(kind, NumericType):
        raise TypeError(f"{name!r} is neither a time nor a number")
    return col(name)


def _keys(left: DataFrame, right: DataFrame, by) -> list[tuple[str, str]]:
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in by]
    for a, b in pairs:
        left.schema[a], right.schema[b]
    return pairs


def _beside(left: DataFrame, right: DataFrame, skip: list[str], suffix: str) -> list[tuple[str, str]]:
    """Columns that the right side adds, and their names in the result."""
    taken, out = set(left.columns), []
    for c in right.columns:
        if c not in skip:
            name = c if c not in taken else c + suffix
            if name in taken:
                raise ValueError(f"two columns would be called {name!r}")
            taken.add(name)
            out.append((c, name))
    return out


def _bucket_width(rows: DataFrame, keys: list[str], bucket_rows: int) -> float | None:
    """Width that cuts the key with the most rows into pieces of about ``bucket_rows``; ``None`` if none is that large."""
    spans = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max("_at") - F.min("_at")).cast("double").alias("span"))
    widths = spans.where(F.col("n") > bucket_rows).agg(F.min(F.col("span") * bucket_rows / F.col("n"))).first()[0]
    return widths or None


def asof_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, by=(), direction: str = "backward", exact: bool = True,
              tolerance=None, tie: str | None = None, suffix: str = "_right", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each left row with the last right row of its key at or before it (``backward``), or the first at or after it (``forward``).

    Both sides are put under each other and sorted once inside a key, where the last right row is carried down to the
    left rows. A key with more than ``bucket_rows`` rows is cut into buckets of time that are sorted apart; the last right
    row of each bucket is carried over the borders by a second pass over one row per bucket.

    ``by`` holds names, or pairs of a left and a right name. ``exact=False`` leaves out equal times; ``tolerance`` is the largest
    distance, in the unit of a number, in seconds for times. Of right rows at the same time the one with the largest ``tie``
    counts (the largest whole row if none is given). Left rows without a match, or with a null key or time, stay with nulls.
    Right columns other than the keys come after the left ones, with ``suffix`` where a name is taken.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    pairs = _keys(left, right, by)
    keys = [f"_k{n}" for n in range(len(pairs))]
    added = _beside(left, right, [b for _, b in pairs], suffix)
    sign = 1 if direction == "backward" else -1
    at_left, at_right = axis(left, left_at) * sign, axis(right, right_at) * sign
    whole_left = F.struct(*[col(c) for c in left.columns])
    whole_right = F.struct(at_right.alias("_at"), (col(tie) if tie else F.lit(0)).alias("_tie"), *[col(c).alias(n) for c, n in added])
    sides = [
        left.select(*[col(a).alias(k) for k, (a, _) in zip(keys, pairs)], at_left.alias("_at"), whole_left.alias("_left")),
        right.select(*[col(b).alias(k) for k, (_, b) in zip(keys, pairs)], at_right.alias("_at"), whole_right.alias("_right")),
    ]
    known = F.lit(True)
    for k in [*keys, "_at"]:
        known = known & F.col(k).isNotNull()
    lonely = sides[0].where(~known).select("_left")
    rows = sides[0].where(known).unionByName(sides[1].where(known), allowMissingColumns=True)
    width = _bucket_width(rows.select(*keys, "_at"), keys, bucket_rows)
    rows = rows.withColumn("_bucket", F.floor(F.col("_at") / F.lit(width)).cast("long") if width else F.lit(0).cast("long"))
    group, is_left = [*keys, "_bucket"], F.col("_left").isNotNull()
    # Right rows come first among equal times where equal times match, and last where they do not.
    order = [F.col("_at"), is_left if exact else ~is_left, F.col("_right")]
    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_match", F.last("_right", ignorenulls=True).over(within)).where(is_left)
    if width:
        ends = rows.groupBy(*group).agg(F.max("_right").alias("_end"))
        before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).where("_before IS NOT NULL").drop("_end")
        found = found.join(carried, group, "left").withColumn("_match", F.coalesce("_match", "_before"))
    if tolerance is not None:
        unit = 1 if isinstance(left.schema[left_at].dataType, NumericType) else 1_000_000
        found = found.withColumn("_match", F.when(F.col("_at") - F.col("_match._at") <= F.lit(tolerance * unit), F.col("_match")))
    found = found.select("_left", "_match").unionByName(lonely, allowMissingColumns=True)
    return found.select(*[F.col("_left").getField(c).alias(c) for c in left.columns], *[F.col("_match").getField(n).alias(n) for _, n in added])


# ---------------------------------------------------------------- intervals
#
# Bins come in sizes: a bin of level v is ``base * 2^v`` wide. An interval belongs to the smallest level whose bins are as
# wide as itself, so that it touches at most two of them, however long it is. Levels that occur are counted first.


def _base(lengths: DataFrame) -> float:
    """The median length, as the width of the smallest bins."""
    middle, mean = lengths.where("_len > 0").agg(F.percentile_approx("_len", 0.5, 1000), F.avg("_len")).first()
    return float(middle or mean or 1)


def _level(length: Column, base: float) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length.cast("double"), F.lit(base)) / F.lit(base)))).cast("int")


def _bin(value: Column, level: Column, base: float) -> Column:
    return F.floor(value.cast("double") / (F.lit(base) * F.pow(F.lit(2.0), level))).cast("long")


def _span(df: DataFrame, low: str, high: str, keys: list[tuple[str, str]]) -> DataFrame:
    """Rows as ``_row`` with their keys and bounds; rows with a null key or bound, or with bounds in the wrong order, meet nothing."""
    rows = df.select(*[col(c).alias(k) for k, c in keys], axis(df, low).alias("_low"), axis(df, high).alias("_high"),
                     F.struct(*[col(c) for c in df.columns]).alias("_row"))
    known = F.col("_low") <= F.col("_high")
    for k, _ in keys:
        known = known & F.col(k).isNotNull()
    return rows.where(known).withColumn("_len", F.col("_high") - F.col("_low"))


def _levels(rows: DataFrame) -> list[int]:
    """Levels that occur: at most one per doubling of the length."""
    return sorted(r[0] for r in rows.select("_level").distinct().collect())


def _dealt(rows: DataFrame, levels: Column, base: float) -> DataFrame:
    """A copy of each row for every level given and for every bin that it touches there: one or two."""
    rows = rows.withColumn("_at_level", F.explode(levels))
    first, last = _bin(F.col("_low"), F.col("_at_level"), base), _bin(F.col("_high"), F.col("_at_level"), base)
    return rows.withColumn("_bin", F.explode(F.sequence(first, last)))


def _named(found: DataFrame, left: DataFrame, right: DataFrame, added: list[tuple[str, str]]) -> DataFrame:
    return found.select(*[F.col("_l._row").getField(c).alias(c) for c in left.columns], *[F.col("_r._row").getField(c).alias(n) for c, n in added])


def range_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, by=(), half_open: bool = False,
               suffix: str = "_right", totals: dict[str, str | None] | None = None) -> DataFrame:
    """Pairs of a point and an interval that holds it, ``low <= at <= high`` (``at < high`` if ``half_open``).

    A point looks into one bin of each level that occurs; an interval lies in the one or two bins of its own level
    that it touches. So every pair meets in one bin only. The result is as long as there are such pairs.

    ``totals`` asks for figures over the pairs of each point instead: by name, the sum of a column of the intervals, or with
    ``None`` their number. The result is then one row per point that lies in an interval, and no pair is made.
    """
    pairs = _keys(points, intervals, by)
    if totals is not None:
        return _range_totals(points, intervals, at, low, high, pairs, half_open, totals)
    names = [f"_k{n}" for n in range(len(pairs))]
    spans = _span(intervals, low, high, [(k, b) for k, (_, b) in zip(names, pairs)])
    base = _base(spans)
    spans = spans.withColumn("_level", _level(F.col("_len"), base))
    levels = _levels(spans)
    spots = points.withColumn("_copy", axis(points, at)).select(
        *[col(a).alias(k) for k, (a, _) in zip(names, pairs)], F.col("_copy").alias("_low"), F.col("_copy").alias("_high"),
        F.struct(*[col(c) for c in points.columns]).alias("_row")).where("_low IS NOT NULL")
    l = _dealt(spots, F.array(*[F.lit(v) for v in levels]).cast("array<int>"), base).alias("_l")
    r = _dealt(spans, F.array("_level"), base).alias("_r")
    same = [F.col(f"_l.{k}") == F.col(f"_r.{k}") for k in [*names, "_at_level", "_bin"]]
    inside = (F.col("_l._low") >= F.col("_r._low")) & (F.col("_l._low") < F.col("_r._high") if half_open else F.col("_l._low") <= F.col("_r._high"))
    found = l.join(r, [*same, inside], "inner")
    return _named(found, points, intervals, _beside(points, intervals, [], suffix))


def _range_totals(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, pairs: list[tuple[str, str]], half_open: bool,
                  totals: dict[str, str | None]) -> DataFrame:
    """Running sums over points and ends of intervals in one order: an interval is added at its beginning and taken off behind its end.

    Rows are range-partitioned and written once; each partition is summed on its own and begins with what the partitions before
    it left open under its first key. Sums are taken off again, so they must be of whole numbers or decimals.
    """
    for name, c in totals.items():
        if name in points.columns:
            raise ValueError(f"two columns would be called {name!r}")
        if c is not None and not isinstance(intervals.schema[c].dataType, (IntegralType, DecimalType)):
            raise TypeError(f"{c!r} is neither a whole number nor a decimal")
    names = [f"_k{n}" for n in range(len(pairs))]
    spans = _span(intervals, low, high, [(k, b) for k, (_, b) in zip(names, pairs)])
    # Per total the sum and how many values are in it, after the number of intervals.
    steps = {"_n": F.lit(1).cast("long")}
    for n, c in enumerate(c for c in totals.values() if c is not None):
        value = F.col("_row").getField(c)
        value = value if isinstance(intervals.schema[c].dataType, DecimalType) else value.cast("long")
        steps |= {f"_v{n}": F.coalesce(value, F.lit(0)), f"_c{n}": value.isNotNull().cast("long")}
    mixed = F.xxhash64("_low", "_high", *steps.values())
    whole = [c for c, kind in points.dtypes if "map<" not in kind and "variant" not in kind]
    marks = [
        points.select(*[col(a).alias(k) for k, (a, _) in zip(names, pairs)], axis(points, at).alias("_at"), F.lit(1).alias("_kind"),
                      F.xxhash64(*[col(c) for c in whole]).alias("_mixed"), F.struct(*[col(c) for c in points.columns]).alias("_row")),
        spans.select(*names, F.col("_low").alias("_at"), F.lit(0).alias("_kind"), mixed.alias("_mixed"), *[v.alias(s) for s, v in steps.items()]),
        spans.select(*names, F.col("_high").alias("_at"), F.lit(0 if half_open else 2).alias("_kind"), mixed.alias("_mixed"),
                     *[(-v).alias(s) for s, v in steps.items()]),
    ]
    rows = marks[1].unionByName(marks[2]).unionByName(marks[0], allowMissingColumns=True)
    known = F.col("_at").isNotNull()
    for k in names:
        known = known & F.col(k).isNotNull()
    # Rows of one time and kind may lie in several partitions: between points nothing is added or taken off.
    order = [F.col("_at"), F.col("_kind"), F.col("_mixed")]
    rows = cut_lineage(rows.where(known).repartitionByRange(*[F.col(k) for k in names], *order).withColumn("_part", F.spark_partition_id()))
    group = ["_part", *names]
    ends = rows.groupBy(*group).agg(*[F.sum(s).alias(s) for s in steps])
    # Only a key that goes on from the partition before has a row: at most one per partition.
    if names:
        places = Window.partitionBy(*names).orderBy("_part")
        before = [F.sum(s).over(places.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_before{s}") for s in steps]
        carried = ends.select(*group, *before, F.row_number().over(places).alias("_place")).where("_place > 1").drop("_place")
    else:
        shifts, seen = [], [0] * len(steps)
        for r in ends.orderBy("_part").collect():
            shifts.append((r["_part"], *seen))
            seen = [a + (r[s] or 0) for a, s in zip(seen, steps)]
        kinds = ["_part int", *[f"_before{s} {kind}" for s, kind in ends.dtypes[1:]]]
        carried = points.sparkSession.createDataFrame(shifts, ", ".join(kinds))
    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({f"_sum{s}": F.sum(s).over(within) for s in steps}).where("_kind = 1")
    found = summed.join(F.broadcast(carried), group, "left")
    upto = {s: F.coalesce(f"_sum{s}", F.lit(0)) + F.coalesce(f"_before{s}", F.lit(0)) for s in steps}
    out, n = [], 0
    for name, c in totals.items():
        if c is None:
            out.append(upto["_n"].alias(name))
        else:
            out.append(F.when(upto[f"_c{n}"] > 0, upto[f"_v{n}"]).alias(name))
            n += 1
    return found.where(upto["_n"] > 0).select(*[F.col("_row").getField(c).alias(c) for c in points.columns], *out)


def overlap_join(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], by=(), half_open: bool = False,
                 suffix: str = "_right") -> DataFrame:
    """Pairs of intervals with a common point (with a common stretch if ``half_open``).

    A pair meets at the level of its longer interval: that one is dealt to the bins of its own level, the other one to those of
    every higher level that occurs on the other side. Where both touch two bins, the pair counts in the one that holds
    the beginning of what they share.
    """
    pairs = _keys(left, right, by)
    names = [f"_k{n}" for n in range(len(pairs))]
    a = _span(left, *left_bounds, [(k, x) for k, (x, _) in zip(names, pairs)])
    b = _span(right, *right_bounds, [(k, y) for k, (_, y) in zip(names, pairs)])
    base = _base(a.select("_len").unionByName(b.select("_len")))
    a, b = (x.withColumn("_level", _level(F.col("_len"), base)) for x in (a, b))
    level = lambda found: F.array(*[F.lit(v) for v in found]).cast("array<int>")
    of_a, of_b = level(_levels(a)), level(_levels(b))
    begin = F.greatest("_l._low", "_r._low")
    if half_open:
        shared = (F.col("_l._low") < F.col("_r._high")) & (F.col("_r._low") < F.col("_l._high"))
    else:
        shared = (F.col("_l._low") <= F.col("_r._high")) & (F.col("_r._low") <= F.col("_l._high"))
    same = [F.col(f"_l.{k}") == F.col(f"_r.{k}") for k in [*names, "_at_level", "_bin"]]
    added, found = _beside(left, right, [], suffix), None
    for l_levels, r_levels in ((F.array("_level"), F.filter(of_a, lambda v: v >= F.col("_level"))),
                               (F.filter(of_b, lambda v: v > F.col("_level")), F.array("_level"))):
        l, r = _dealt(a, l_levels, base).alias("_l"), _dealt(b, r_levels, base).alias("_r")
        once = _bin(begin, F.col("_l._at_level"), base) == F.col("_l._bin")
        part = _named(l.join(r, [*same, shared, once], "inner"), left, right, added)
        found = part if found is None else found.unionByName(part)
    return found
