"""Exact order-based measures without one task that sees a huge group.

There is one plan for every size. Rows are range-partitioned on group and order and
written once, with the number of their range, so that later steps agree on it also
after a retry. Each range is worked on alone. What it needs from the ranges before it
(a running total, or the last few rows) is a table of a few rows per range.

Quantiles need no order of all rows: a first pass brackets every wanted position
between two values, a second counts what lies below the bracket and gathers only the
values inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.workspace import release_shuffles, shuffle_partitions, stage

RANGE = "_range"
# Number that rises with the order of the rows over all ranges.
PLACE = "_place"

# Accuracy of the approximate percentiles that bracket an exact one, and the shares of
# the rows by which brackets may reach out; the narrowest that is safe is taken.
ACCURACY = 10_000
REACHES = (0.001, 0.01, 0.1)


def in_ranges(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``df`` written once, range-partitioned, with the range's number as ``RANGE``."""
    n = shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *[F.col(g) for g in group], *order)
    return stage(ranged.withColumn(RANGE, F.spark_partition_id()), "ranges")


def in_order(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``in_ranges`` with sorted ranges and the place of each row as ``PLACE``.

    Within a group and range the places follow each other without gaps.
    """
    n = shuffle_partitions(df.sparkSession)
    keys = [*[F.col(g) for g in group], *order]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    places = {RANGE: F.spark_partition_id(), PLACE: F.monotonically_increasing_id()}
    ordered = stage(ranged.withColumns(places), "ordered")
    release_shuffles(df.sparkSession)
    return ordered


def total_before(
    df: DataFrame, group: list[str], order: str, weights: dict[str, str]
) -> DataFrame:
    """For each row, the total of a weight over the rows before it in its group.

    ``weights`` maps weight column to result column. ``order`` has to be unique
    within a group, as it is for a value histogram.
    """
    zero = F.lit(0)
    ranged = in_ranges(df, group, [F.col(order)])
    inside = (
        Window.partitionBy(*group, RANGE)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per group and range: its window is bounded by the number of ranges.
    earlier = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = ranged.groupBy(*group, RANGE).agg(
        *[F.sum(w).alias(f"_t_{w}") for w in weights]
    )
    offsets = offsets.select(
        *group, RANGE, *[F.sum(f"_t_{w}").over(earlier).alias(f"_o_{w}") for w in weights]
    )
    local = ranged.select("*", *[F.sum(w).over(inside).alias(f"_l_{w}") for w in weights])
    joined = local.join(offsets, [*group, RANGE])
    totals = [
        (F.coalesce(f"_l_{w}", zero) + F.coalesce(f"_o_{w}", zero)).alias(out)
        for w, out in weights.items()
    ]
    return joined.select(*df.columns, *totals)


def number(column: str) -> Column:
    """A column as double, not-a-number as NULL."""
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def value_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of the present values of several numeric columns.

    Equal values are combined before the shuffle, so a hot value costs one row
    per task.
    """
    if len(columns) == 1:
        values = df.select(number(columns[0]).alias("value"))
        values = values.withColumn("column", F.lit(columns[0]))
    else:
        cells = [F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in columns]
        values = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    present = values.where(F.col("value").isNotNull())
    return present.groupBy("column", "value").agg(F.count("*").alias("n"))


def numbers_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles named v0, v1, ..., written once."""
    return stage(df.select([number(c).alias(f"v{i}") for i, c in enumerate(columns)]), "numbers")


def quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles as (column, prob, quantile).

    A column without values has no row.
    """
    return quantiles_of(numbers_of(df, columns), columns, probs)


def brackets(
    numbers: DataFrame, columns: list[str], probs: list[float], also: list[Column] | None = None
) -> DataFrame:
    """One written row: per column n, per wanted quantile the bracket around it, and ``also``.

    An approximate percentile lies within n / ACCURACY ranks of its position. A reach
    of s * n ranks is safe where it covers this error on both sides and the rounding
    of positions; beyond the widest the bracket is the whole column.
    """
    shares = sorted({min(1.0, max(0.0, p + s * r)) for p in probs for r in REACHES for s in (-1, 1)})
    aggregates = []
    for i in range(len(columns)):
        v = F.col(f"v{i}")
        aggregates += [
            F.count(v).alias(f"n{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
            F.percentile_approx(v, [float(s) for s in shares], ACCURACY).alias(f"near{i}"),
        ]
    known = [f"n{i}" for i in range(len(columns))]
    wide = numbers.agg(*aggregates, *(also or []))
    known += wide.columns[len(aggregates) :]
    out = []
    for i in range(len(columns)):
        n = F.col(f"n{i}")
        for j, p in enumerate(probs):
            low = high = None
            for reach in REACHES:
                safe = (n * (reach - 2 / ACCURACY) >= 4) & F.lit(reach <= min(p, 1 - p))
                at = [shares.index(min(1.0, max(0.0, p + s * reach))) for s in (-1, 1)]
                a, b = (F.col(f"near{i}")[k] for k in at)
                low = F.when(safe, a) if low is None else low.when(safe, a)
                high = F.when(safe, b) if high is None else high.when(safe, b)
            out.append(low.otherwise(F.col(f"min{i}")).alias(f"low{i}_{j}"))
            out.append(high.otherwise(F.col(f"max{i}")).alias(f"high{i}_{j}"))
    return stage(wide.select(*known, *out), "brackets")


def quantiles_of(
    numbers: DataFrame, columns: list[str], probs: list[float], bracketed: DataFrame | None = None
) -> DataFrame:
    """Quantiles of written columns v0, v1, ... that carry the given names.

    ``bracketed`` is their row of ``brackets``. After it, one pass counts what lies below
    the brackets and one gathers the values inside. A bracket that misses its position is
    an error, not a missing row.
    """
    spots = [(i, j) for i in range(len(columns)) for j in range(len(probs))]
    row = brackets(numbers, columns, probs) if bracketed is None else bracketed
    marked = numbers.withColumn("_b", row.select(F.struct("*")).scalar())
    bound = {s: (F.col(f"_b.low{s[0]}_{s[1]}"), F.col(f"_b.high{s[0]}_{s[1]}")) for s in spots}
    counts = marked.agg(
        *[F.count(F.when(F.col(f"v{i}") < bound[i, j][0], 1)).alias(f"{i}_{j}") for i, j in spots]
    )
    below = counts.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"{i}_{j}").alias("below"))
                  for i, j in spots]
            )
        ).alias("r")
    ).select("r.*")
    cells = [
        F.when(
            F.col(f"v{i}").between(*bound[i, j]),
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{i}").alias("value")),
        )
        for i, j in spots
    ]
    inside = marked.select(F.explode(F.array_compact(F.array(*cells))).alias("r")).select("r.*")
    inside = inside.groupBy("i", "j", "value").agg(F.count("*").alias("n"))
    placed = total_before(inside, ["i", "j"], "value", {"n": "before"})
    named = [(i, j, columns[i], float(probs[j])) for i, j in spots]
    wanted = numbers.sparkSession.createDataFrame(named, "i int, j int, column string, prob double")
    sizes = row.select(
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"n{i}").alias("total")) for i in range(len(columns))])
        ).alias("r")
    ).select("r.*")
    position = (F.col("total") - 1) * F.col("prob")
    # One row per column and probability in all three tables.
    wanted = wanted.join(F.broadcast(below), ["i", "j"]).join(F.broadcast(sizes), "i")
    wanted = wanted.where("total > 0").select(
        "i", "j", "column", "prob", "below",
        (position - F.floor(position)).alias("part"),
        F.floor(position).alias("first"),
        F.ceil(position).alias("second"),
    )
    start = F.col("below") + F.col("before")
    holds_first = (start <= F.col("first")) & (F.col("first") < start + F.col("n"))
    holds_second = (start <= F.col("second")) & (F.col("second") < start + F.col("n"))
    hits = placed.join(F.broadcast(wanted), ["i", "j"]).where(holds_first | holds_second)
    ends = hits.groupBy("i", "j").agg(
        F.max(F.when(holds_first, F.col("value"))).alias("a"),
        F.max(F.when(holds_second, F.col("value"))).alias("b"),
    )
    found = wanted.join(ends, ["i", "j"], "left")
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    missed = F.raise_error(F.concat(F.lit("a bracket misses a quantile of "), F.col("column")))
    value = F.coalesce(value, missed.cast("double"))
    return found.select("column", "prob", value.alias("quantile"))


def quantile(df: DataFrame, column: str, prob: float) -> DataFrame:
    """One quantile of one column as a one-row frame (use ``.scalar()`` on it)."""
    return quantiles(df, [column], [prob]).agg(F.max("quantile").alias("quantile"))


def average_ranks(df: DataFrame, ranks: dict[str, tuple[str, bool]]) -> DataFrame:
    """Add tie-averaged ranks over all rows.

    ``ranks`` maps a new column to (measure, ascending). The rank of a value is
    the number of rows before it plus (ties + 1) / 2, read from the histogram of
    the values and joined back on the value. A hot value is one row of that
    histogram; adaptive execution picks the join and splits a hot partition.
    """
    base = stage(df, "ranked")
    measures = sorted({m for m, _ in ranks.values()})
    placed = total_before(value_histogram(base, measures), ["column"], "value", {"n": "before"})
    placed = stage(placed, "ranks")
    sizes = placed.groupBy("column").agg(F.sum("n").alias("total"))
    placed = placed.join(F.broadcast(sizes), "column")  # one row per measure
    up = F.col("before") + (F.col("n") + 1) / 2.0
    out = base
    for measure in measures:
        sides = [
            (up if ascending else F.col("total") + 1 - up).alias(name)
            for name, (own, ascending) in ranks.items()
            if own == measure
        ]
        side = placed.where(F.col("column") == measure).select(F.col("value").alias("_value"), *sides)
        out = out.join(side, F.col(measure).cast("double") == F.col("_value"), "left").drop("_value")
    return out.select(*df.columns, *ranks)


def ordinal_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """(value, code): 0-based position of each distinct value in ascending order."""
    values = df.groupBy(column).agg(F.lit(1).alias("_one"))
    values = values.withColumn("_all", F.lit(0))
    placed = total_before(values, ["_all"], column, {"_one": "_before"})
    return placed.select(column, F.col("_before").cast("bigint").alias(code))


def rolling_mean(
    df: DataFrame, group: str, order: list[str], value: str, out: str, rows: int = 7
) -> DataFrame:
    """Mean over the last ``rows`` rows of the group, in the given full order.

    Missing values are skipped and missing order values come last; rows without
    a group get no mean.
    """
    ranged = in_order(df, [group], [F.col(c).asc_nulls_last() for c in order])
    return rolling_mean_of(ranged, group, value, out, rows).drop(RANGE, PLACE)


def rolling_mean_of(
    ranged: DataFrame, group: str, value: str, out: str, rows: int = 7
) -> DataFrame:
    """``rolling_mean`` of rows that ``in_order`` wrote.

    Each range is averaged alone, in one window by place. Only its first ``rows - 1``
    rows lack values of earlier ranges; these come from a table with the last values
    before each group and range.
    """
    margin = rows - 1
    keys = [group, RANGE]
    spans = ranged.groupBy(*keys).agg(F.min(PLACE).alias("_first"), F.max(PLACE).alias("_last"))
    spans = stage(spans, "spans")
    tails = ranged.select(*keys, PLACE, F.struct(value).alias("_value")).join(spans, keys)
    tails = tails.where(F.col(PLACE) > F.col("_last") - margin)
    # At most ``rows - 1`` rows for each group and range.
    before = Window.partitionBy(group).orderBy(PLACE).rowsBetween(-margin, -1)
    own = Window.partitionBy(*keys).orderBy(PLACE)
    halo = tails.select(
        *keys,
        "_first",
        F.collect_list("_value").over(before).alias("_halo"),
        F.row_number().over(own).alias("_number"),
    )
    halo = halo.where("_number = 1").drop("_number")
    frame = Window.partitionBy(*keys).orderBy(PLACE).rowsBetween(-margin, 0)
    local = ranged.withColumns({"_sum": F.sum(value).over(frame), "_count": F.count(value).over(frame)})
    local = local.join(halo, keys, "left")
    lacking = F.lit(margin) - (F.col(PLACE) - F.col("_first")).cast("int")
    start = F.greatest(F.size("_halo") - lacking + 1, F.lit(1))
    earlier = F.when(lacking > 0, F.transform(F.slice("_halo", start, lacking), lambda v: v[value]))
    present = F.filter(F.coalesce(earlier, F.array().cast("array<double>")), lambda v: v.isNotNull())
    total = F.aggregate(present, F.coalesce("_sum", F.lit(0)).cast("double"), lambda a, v: a + v)
    count = F.col("_count") + F.size(present)
    mean = F.when(F.col(group).isNotNull(), F.try_divide(total, count))
    return local.withColumn(out, mean).drop("_sum", "_count", "_halo", "_first")
