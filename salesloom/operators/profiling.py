"""Table profiles in long layout: one row per column, value or bin."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.functions.ordered import brackets, numbers_of, quantiles, quantiles_of
from salesloom.operators.cleaning import numeric_columns, quoted

QUARTILES = [0.25, 0.5, 0.75]


def _missing(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    null = quoted(column).isNull()
    return null | F.isnan(quoted(column)) if isinstance(kind, (T.DoubleType, T.FloatType)) else null


def _present(column: str) -> Column:
    """A numeric column as double; not-a-number is missing, as in all profiles."""
    value = quoted(column).cast("double")
    return F.when(~F.isnan(value), value)


def _long(df: DataFrame, rows: list[Column]) -> DataFrame:
    """Turn one wide aggregate row into one row per struct."""
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def shape(df: DataFrame) -> DataFrame:
    """Rows, columns and missing cells in one pass."""
    gaps = sum((F.sum(_missing(df, c).cast("int")) for c in df.columns), F.lit(0))
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.coalesce(gaps, F.lit(0)).cast("bigint").alias("missing_cells"),
    )


def missing_by_column(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    counts = df.agg(*[F.count(F.when(_missing(df, c), 1)).alias(c) for c in columns])
    return counts.unpivot([], [quoted(c) for c in columns], "column", "missing").orderBy(
        F.col("missing").desc(), "column"
    )


def column_info(df: DataFrame) -> DataFrame:
    """Type and number of present values of each column."""
    counts = df.agg(*[F.count(F.when(~_missing(df, c), 1)).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            quoted(f.name).alias("non_null"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return _long(counts, rows)


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum per column.

    The columns are written once. One pass has the moments and the brackets of the
    quartiles, two more the quartiles.
    """
    columns = columns or numeric_columns(df)
    numbers = numbers_of(df, columns)
    wide = brackets(
        numbers, columns, QUARTILES, [
            F.struct(
                F.lit(c).alias("column"),
                F.count(f"v{i}").alias("count"),
                F.avg(f"v{i}").alias("mean"),
                F.stddev_samp(f"v{i}").alias("std"),
                F.min(f"v{i}").alias("min"),
                F.max(f"v{i}").alias("max"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ],
    )
    # One row per described column here and in the joins below.
    sums = _long(wide, [F.col(f"s{i}") for i in range(len(columns))])
    middle = (
        quantiles_of(numbers, columns, QUARTILES, wide)
        .groupBy("column")
        .pivot("prob", QUARTILES)
        .agg(F.max("quantile"))
        .toDF("column", "q25", "q50", "q75")
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    out = names.join(F.broadcast(sums), "column", "left")
    return out.join(F.broadcast(middle), "column", "left").select(
        "column", F.coalesce("count", F.lit(0)).alias("count"),
        "mean", "std", "min", "q25", "q50", "q75", "max",
    )


def _epoch_seconds(date: Column) -> Column:
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    days = F.extract(F.lit("DAY"), date - start)
    return days * 86400 + F.hour(date) * 3600 + F.minute(date) * 60 + F.second(date)


def value_frequency(df: DataFrame, columns: list[str]) -> DataFrame:
    """Present values, distinct values, most frequent value and its count per column.

    All columns are counted in one shuffle. Equal values meet per task first,
    and of equally frequent values the smallest is reported.
    """
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    counts = (
        df.select(F.explode(cells).alias("cell"))
        .select("cell.*")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count("*").alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"),
    )


def describe_all(df: DataFrame) -> DataFrame:
    """One row per column: text and flags by frequency, numbers and times by moments.

    Times are described as seconds since 1970.
    """
    fields = df.schema.fields
    times = [f.name for f in fields if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))]
    numbers = numeric_columns(df)
    texts = [f.name for f in fields if f.name not in times + numbers]
    plain = df.select(
        *[quoted(c) for c in numbers],
        *[_epoch_seconds(quoted(c).cast("timestamp_ntz")).cast("double").alias(c) for c in times],
    )
    moments = describe_numeric(plain)
    frequent = value_frequency(df, texts)
    return moments.unionByName(frequent, allowMissingColumns=True).select(
        "column", "count", "unique", "top", "freq",
        "mean", "std", "min", "q25", "q50", "q75", "max",
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row; copies meet per task before the shuffle."""
    copies = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of all pairs of numeric columns as (a, b, r), one aggregate."""
    columns = columns or numeric_columns(df)
    value = {c: _present(c) for c in columns}
    pairs = list(combinations(range(len(columns)), 2))

    def r(i: int, j: int) -> Column:
        both = value[columns[i]].isNotNull() & value[columns[j]].isNotNull()
        return F.corr(F.when(both, value[columns[i]]), F.when(both, value[columns[j]]))

    wide = df.agg(
        *[r(i, j).alias(f"{i}_{j}") for i, j in pairs],
        *[F.stddev_pop(value[c]).alias(f"s_{i}") for i, c in enumerate(columns)],
    )
    rows = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            if i == j:
                rho = F.when(F.col(f"s_{i}") > 0, F.lit(1.0))
            else:
                rho = F.nanvl(F.col(f"{min(i, j)}_{max(i, j)}"), F.lit(None).cast("double"))
            rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rho.alias("r")))
    return _long(wide, rows)


def _bounds(df: DataFrame, columns: list[str]) -> Column:
    """Struct with the least and greatest value of each column, read once."""
    wide = df.agg(
        *[F.min(_present(c)).alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(_present(c)).alias(f"hi_{i}") for i, c in enumerate(columns)],
    )
    return wide.select(F.struct(*wide.columns)).scalar()


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the greatest value belongs to the last bin."""
    place = F.floor((value - low) * bins / (high - low))
    return F.when(high == low, 0).otherwise(F.least(place, F.lit(bins - 1))).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Rows per equal-width bin (bins without rows are left out) and the lower edge."""
    value = _present(column)
    marked = df.select(value.alias("v"), _bounds(df, [column]).alias("m")).where("v IS NOT NULL")
    low, high = F.col("m.lo_0"), F.col("m.hi_0")
    return (
        marked.groupBy(_bin(F.col("v"), low, high, bins).alias("bin"), low.alias("lo"), high.alias("hi"))
        .agg(F.count("*").alias("count"))
        .select(
            "bin",
            (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("lower_edge"),
            "count",
        )
    )


def joint_histogram(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Rows per cell of an equal-width grid over two columns."""
    marked = df.select(
        _present(x).alias("x"),
        _present(y).alias("y"),
        _bounds(df, [x, y]).alias("m"),
    ).where("x IS NOT NULL AND y IS NOT NULL")
    return marked.groupBy(
        _bin(F.col("x"), F.col("m.lo_0"), F.col("m.hi_0"), bins).alias("x_bin"),
        _bin(F.col("y"), F.col("m.lo_1"), F.col("m.hi_1"), bins).alias("y_bin"),
    ).agg(F.count("*").alias("count"))


def pair_histograms(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """The joint histogram of every pair of the given columns, in one job."""
    row = _bounds(df, columns)
    place = [
        F.when(
            _present(c).isNotNull(),
            _bin(_present(c), F.col(f"_m.lo_{i}"), F.col(f"_m.hi_{i}"), bins),
        )
        for i, c in enumerate(columns)
    ]
    cells = F.array(
        *[
            F.struct(
                F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"),
                place[i].alias("x_bin"), place[j].alias("y_bin"),
            )
            for i, j in combinations(range(len(columns)), 2)
        ]
    )
    return (
        df.withColumn("_m", row)
        .select(F.explode(cells).alias("c"))
        .select("c.*")
        .where("x_bin IS NOT NULL AND y_bin IS NOT NULL")
        .groupBy("x", "y", "x_bin", "y_bin")
        .agg(F.count("*").alias("count"))
    )


def density(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) on an even grid from min to max.

    A column without spread has no density and gives no rows.

    Equal values are combined first. One aggregate then sums the kernels at every
    grid point, a column for each, so a task sends one row.
    """
    value = _present(column)
    counts = (
        df.select(value.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    )
    whole = df.agg(
        F.count(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.stddev_samp(value).alias("sd"),
    )
    row = whole.select(
        F.struct("total", "lo", "hi", (F.col("sd") * F.pow("total", F.lit(-0.2))).alias("bw"))
    ).scalar()
    marked = counts.select("v", "n", row.alias("m")).where(F.col("m.bw") > 0)
    scale = F.col("m.total") * F.col("m.bw") * F.sqrt(F.lit(2.0) * F.pi())

    def x(point: int) -> Column:
        return F.col("m.lo") + (F.col("m.hi") - F.col("m.lo")) * point / (points - 1)

    def kernel(point: int) -> Column:
        z = (x(point) - F.col("v")) / F.col("m.bw")
        return F.sum(F.col("n") * F.exp(z * z * -0.5) / scale)

    wide = marked.agg(F.max("m").alias("m"), *[kernel(p).alias(f"p{p}") for p in range(points)])
    rows = [
        F.struct(F.lit(p).alias("point"), x(p).alias("x"), F.col(f"p{p}").alias("density"))
        for p in range(points)
    ]
    return _long(wide.where("m IS NOT NULL"), rows)


def box_plot(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, whisker ends (last values within 1.5 interquartile ranges), outliers."""
    q = quantiles(df, [column], QUARTILES).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
          for p, n in zip(QUARTILES, ("q1", "median", "q3"))]
    )
    row = q.select(F.struct("q1", "median", "q3")).scalar()
    marked = df.select(_present(column).alias("v"), row.alias("q")).where("v IS NOT NULL")
    reach = (F.col("q.q3") - F.col("q.q1")) * 1.5
    inside = F.col("v").between(F.col("q.q1") - reach, F.col("q.q3") + reach)
    return marked.agg(
        F.max("q.q1").alias("q1"),
        F.max("q.median").alias("median"),
        F.max("q.q3").alias("q3"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"),
    )


def outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """The rows beyond the whiskers."""
    q = quantiles(df, [column], [0.25, 0.75]).agg(
        F.min("quantile").alias("q1"), F.max("quantile").alias("q3")
    )
    row = q.select(F.struct("q1", "q3")).scalar()
    reach = (F.col("_q.q3") - F.col("_q.q1")) * 1.5
    value = _present(column)
    beyond = (value < F.col("_q.q1") - reach) | (value > F.col("_q.q3") + reach)
    return df.withColumn("_q", row).where(beyond).drop("_q")


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Names both tables have: the candidates for a join."""
    return [c for c in a.columns if c in b.columns]


def shared_column_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each shared column, its distinct values on both sides and in common."""
    names = shared_columns(a, b)

    def values(df: DataFrame, side: str) -> DataFrame:
        cells = F.array(
            *[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in names]
        )
        return (
            df.select(F.explode(cells).alias("cell"))
            .select("cell.*", F.lit(side).alias("side"))
            .where(F.col("value").isNotNull())
            .distinct()
        )

    sides = values(a, "a").unionByName(values(b, "b"))
    seen = sides.groupBy("column", "value").agg(
        F.max((F.col("side") == "a").cast("int")).alias("in_a"),
        F.max((F.col("side") == "b").cast("int")).alias("in_b"),
    )
    return seen.groupBy("column").agg(
        F.sum("in_a").alias("values_a"),
        F.sum("in_b").alias("values_b"),
        F.sum(F.col("in_a") * F.col("in_b")).alias("values_shared"),
    )
