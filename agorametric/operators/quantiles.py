"""Exact median of a measure per group, without gathering a group's values in one task."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from agorametric.session import scratch_path

# Different values that one task may order for one group, and the parts a range of more of them is cut into.
DIRECT = 4096
PARTS = 1024
# Digits of a value; twice a value and its half fit in a decimal then.
DIGITS = 17


def exact_median(rows: DataFrame, bins: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Median by interpolation: the mean of the two middle values.

    `bins` cuts each group's values into ranges that do not overlap: for each range its number `n` of values and the
    `low` and `high` one. Running counts over the ranges tell which one or two hold the middle ranks; only rows in
    those are then counted value by value. `key` must have a small fixed domain: what is broadcast has at most two
    rows for each of its values.
    """
    ordered = Window.partitionBy(key).orderBy("low")
    ranked = bins.select(
        F.col(key).alias("group"),
        "low",
        "high",
        (F.sum("n").over(ordered) - F.col("n")).alias("before"),
        F.sum("n").over(ordered).alias("upto"),
        F.sum("n").over(Window.partitionBy(key)).alias("size"),
    )
    lower, upper = F.expr("(size - 1) div 2"), F.expr("size div 2")
    middle = ranked.select("*", lower.alias("lower"), upper.alias("upper")).where(
        ((F.col("before") <= F.col("lower")) & (F.col("lower") < F.col("upto")))
        | ((F.col("before") <= F.col("upper")) & (F.col("upper") < F.col("upto")))
    )
    within_range = (F.col(key) == F.col("group")) & F.col(value).between(F.col("low"), F.col("high"))
    candidates = (
        rows.select(key, value)
        .join(F.broadcast(middle.select("group", "low", "high", "before", "lower", "upper")), within_range)
        .groupBy(key, "low", "before", "lower", "upper", value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(key, "low").orderBy(value))
    placed = candidates.select(key, value, "lower", "upper", (upto - F.col("n")).alias("start"), upto.alias("stop"))
    at_lower = (F.col("start") <= F.col("lower")) & (F.col("lower") < F.col("stop"))
    at_upper = (F.col("start") <= F.col("upper")) & (F.col("upper") < F.col("stop"))
    total = F.max(F.when(at_lower, F.col(value))) + F.max(F.when(at_upper, F.col(value)))
    return placed.groupBy(key).agg((total * F.lit("0.5").cast("decimal(1,1)")).alias(name))


def median_by(rows: DataFrame, keys: list[str], value: str, name: str, direct: int = DIRECT, parts: int = PARTS) -> DataFrame:
    """Median by interpolation for keys of any domain: the keys, `n` (the number of values) and the median.

    Rows are reduced to one per key and different value, dealt by both. A key with few different values is settled by
    one window. Where there are more, counts over the parts of the range tell which one or two parts hold the middle
    ranks, and only the values in those go on, level by level, until few are left. Nothing is broadcast unless Spark
    finds it small, and no task orders more than `direct` values or `parts` parts of a group.

    `value` is a whole number or a decimal of up to 17 digits. Missing values don't count, a key without values has no
    row, and a missing key is a key of its own.
    """
    kind = rows.schema[value].dataType
    if not isinstance(kind, (DecimalType, IntegralType)) or isinstance(kind, DecimalType) and kind.precision > DIGITS:
        raise TypeError(f"{value} must be a whole number or a decimal of up to {DIGITS} digits, not {kind.simpleString()}")
    scale = kind.scale if isinstance(kind, DecimalType) else 0
    names = [f"key{at}" for at in range(len(keys))]
    number = (F.col(value).cast(f"decimal({DIGITS},{scale})") * F.lit(Decimal(10**scale))).cast("long")
    named = rows.select(*[F.col(key).alias(to) for key, to in zip(keys, names)], number.alias("value")).where("value IS NOT NULL")
    counted = _stored(named.groupBy(*names, "value").agg(F.count("*").alias("n")))
    low, high = counted.agg(F.min("value"), F.max("value")).first()
    width = 1
    while low is not None and low + width <= high:
        width *= parts
    inside = counted.withColumn("range", F.lit(0).cast("long"))
    sizes = _stored(counted.groupBy(*names).agg(F.sum("n").alias("size"), F.count("*").alias("values")))
    ranges = sizes.select(
        *names, F.lit(0).cast("long").alias("range"), "values", F.expr("(size - 1) div 2").alias("lower"), F.expr("size div 2").alias("upper")
    )
    found = []
    while True:
        found.append(_middle(inside, ranges.where(F.col("values") <= direct), names))
        wide = ranges.where(F.col("values") > direct)
        if wide.isEmpty():
            break
        width //= parts
        part = F.expr(f"(value - {low}L) div {width}L")
        inside = _stored(_meeting(inside, wide, names).withColumn("part", part))
        sums = inside.groupBy(*names, "range", "part", "lower", "upper").agg(F.sum("n").alias("n"), F.count("*").alias("values"))
        upto = F.sum("n").over(Window.partitionBy(*names, "range").orderBy("part"))
        placed = sums.withColumns({"upto": upto, "before": upto - F.col("n")})
        ranks = [F.when(_holds(rank), F.col(rank) - F.col("before")).alias(rank) for rank in ("lower", "upper")]
        ranges = _stored(placed.select(*names, F.col("part").alias("range"), "values", *ranks).where("lower IS NOT NULL OR upper IS NOT NULL"))
        inside = inside.select(*names, "value", "n", F.col("part").alias("range"))
    middle = reduce(DataFrame.union, found).groupBy(*names).agg(*[F.max(rank).cast(f"decimal({DIGITS},0)").alias(rank) for rank in ("lower", "upper")])
    half = F.lit(Decimal(5).scaleb(-scale - 1))
    joined = sizes.alias("all").join(middle.alias("middle"), _same(names, "all", "middle"))
    return joined.select(
        *[F.col(f"all.{at}").alias(key) for key, at in zip(keys, names)], F.col("size").alias("n"), ((F.col("lower") + F.col("upper")) * half).alias(name)
    )


def _stored(rows: DataFrame) -> DataFrame:
    """Written to the shared folder: read several times, and of a size that the planner knows."""
    at = scratch_path(rows.sparkSession, "median")
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def _same(names: list[str], left: str, right: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}")) for name in names], F.lit(True))


def _holds(rank: str) -> Column:
    return (F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("upto"))


def _meeting(inside: DataFrame, ranges: DataFrame, names: list[str]) -> DataFrame:
    """The values in the given ranges, with the ranks that are looked for there."""
    same = _same(names, "one", "other") & (F.col("one.range") == F.col("other.range"))
    return inside.alias("one").join(ranges.alias("other"), same).select("one.*", "lower", "upper")


def _middle(inside: DataFrame, ranges: DataFrame, names: list[str]) -> DataFrame:
    """Per key and range the values at both ranks."""
    upto = F.sum("n").over(Window.partitionBy(*names, "range").orderBy("value"))
    placed = _meeting(inside, ranges, names).withColumns({"upto": upto, "before": upto - F.col("n")})
    at = [F.max(F.when(_holds(rank), F.col("value"))).alias(rank) for rank in ("lower", "upper")]
    return placed.groupBy(*names, "range").agg(*at).drop("range")
