"""Operator 7: mixing sources to target weights by hierarchical budgets, by built-in functions only.

The documents' leaves (domain, language, source) form a tree. A budget of tokens is handed down from the root: the
children of a node share its budget by their weights; a child that cannot use its share, because its whole subtree has
fewer tokens, takes what it has, and the others share the rest. So a shortage is made up by siblings first, and only a
subtree that is short as a whole leaves tokens to the siblings of its ancestors.

A leaf passes over its documents in epochs, each in an order that the seed and the epoch's number decide. Whole epochs
are taken, then the longest prefix of the next one that fits into the rest. The prefix is found by ranges of the order's
keys, from coarse to fine, so no task holds a leaf.

Results for odd input: a missing value of a level counts as empty; a missing text or count of tokens counts zero
tokens; rows that repeat another (same id, same text) are taken or left together; a leaf without weight gets nothing;
rows without tokens are taken once at least where their leaf is used up, but in no epoch beyond the last; an empty table gives an empty table. All columns pass with their values, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agorametric.llm.common import stored

# Hexadecimal digits of a key in each step of the search for a prefix: 256 ranges, 256 in one of these, and so on.
_STEPS = (2, 4, 6, 32)
_SALTS = 64


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    """Weights are whole numbers, so that their sums are exact; what is not listed has weight one."""
    listed = weights.get(level, {})
    found = F.lit(1)
    for value, weight in listed.items():
        found = F.when(F.col(level) == value, int(weight)).otherwise(found)
    return found


def allot(leaves: DataFrame, levels: list[str], budget: Column, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Per leaf its tokens of the budget, as a double; `leaves` has the levels and `supply`.

    `budget` is a function of the sum of all supplies, in the column total.
    """
    usable = F.col("supply")
    for level in levels:
        usable = F.when(_weight(level, weights) == 0, 0).otherwise(usable)
    leaves = leaves.select(*levels, usable.cast("long").alias("supply"))
    share = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("total")).select(F.least(F.floor(budget), F.col("total")).cast("double").alias("share"))
    for depth, level in enumerate(levels):
        above, own = levels[:depth], levels[: depth + 1]
        nodes = leaves.groupBy(*own).agg(F.sum("supply").alias("supply")).withColumn("weight", _weight(level, weights).cast("long"))
        # The root is one row, told apart by no column.
        nodes = nodes.join(share, above) if above else nodes.join(F.broadcast(share.withColumn("root", F.lit(1))), F.lit(1) == F.col("root")).drop("root")
        share = _fill(nodes, above, level).select(*own, "share")
    return share


def _fill(nodes: DataFrame, above: list[str], level: str) -> DataFrame:
    """Divides each parent's share among its children: by weight, but no more than a child has."""
    siblings = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    # Children that are short for their weight come first.
    order = siblings.orderBy(F.coalesce(F.try_divide("supply", "weight"), F.lit(0.0)), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.col("share") - F.coalesce(F.sum("supply").over(before), F.lit(0)).cast("double")
    heavy = F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    each = nodes.withColumn("each", F.try_divide(rest, heavy.cast("double")))
    short = F.coalesce(F.col("supply") <= F.col("weight") * F.col("each"), F.lit(True))
    line = each.withColumn("line", F.first(F.when(~short, F.col("each")), ignorenulls=True).over(everyone))
    fits = F.col("line").isNull() | (F.col("supply") <= F.col("weight") * F.col("line"))
    return line.withColumn("share", F.when(fits, F.col("supply").cast("double")).otherwise(F.col("weight") * F.col("line")))


def _named(documents: DataFrame, levels: Mapping[str, Column], tokens: Column, id: str, text: str) -> DataFrame:
    """Columns that the operator works with, and the documents' own columns by number, so that no names clash."""
    found = {f"__{name}": F.coalesce(value.cast("string"), F.lit("")) for name, value in levels.items()}
    row = F.concat_ws("|", F.coalesce(F.col(id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    added = {**found, "__tokens": F.coalesce(tokens.cast("long"), F.lit(0)), "__row": row}
    own = [F.col(f"`{name}`").alias(f"column {at}") for at, name in enumerate(documents.columns)]
    return documents.select(*own, *[value.alias(name) for name, value in added.items()])


def _key(seed: int, epoch: Column) -> Column:
    """A row's place in an epoch."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.col("__row")))


def plan(
    named: DataFrame, levels: list[str], budget: Column, weights: Mapping[str, Mapping[str, int]], epochs: int, seed: int
) -> DataFrame:
    """Per leaf that gets tokens: `__whole` epochs, and the last key `__cut` of the next epoch that is taken, or null."""
    slim = stored(named.groupBy(*levels, "__row").agg(F.sum("__tokens").alias("__tokens")), "rows")
    leaves = stored(slim.groupBy(*levels).agg(F.sum("__tokens").alias("held")), "leaves")
    allotted = allot(leaves.withColumn("supply", F.col("held") * epochs), levels, budget, weights)
    whole = F.coalesce(F.try_divide(F.floor("share"), "held"), F.lit(0.0))
    rest = allotted.join(leaves, levels).withColumn("__whole", F.floor(whole).cast("long"))
    rest = rest.withColumn("left", F.floor("share").cast("long") - F.col("__whole") * F.col("held"))
    rest = stored(rest.select(*levels, "__whole", "left"), "rest")
    # A leaf's rows are spread over salts, so that a large leaf is not met by one task.
    salted = rest.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    keyed = slim.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(_SALTS)).cast("int")).join(salted, [*levels, "__salt"])
    keyed = keyed.select(*levels, _key(seed, F.col("__whole")).alias("key"), "__tokens")
    # Each step looks into the one range per leaf where the sum of tokens passes what is left.
    search = rest.select(*levels, "left", F.lit("").alias("range"), F.lit(None).cast("string").alias("cut"))
    for known, digits in zip((0, *_STEPS), _STEPS):
        inside = keyed
        if known:
            inside = keyed.withColumn("range", F.substring("key", 1, known)).join(search.select(*levels, "range"), [*levels, "range"])
        sums = inside.groupBy(*levels, F.substring("key", 1, digits).alias("next")).agg(F.sum("__tokens").alias("tokens"))
        running = Window.partitionBy(*levels).orderBy("next")
        reached = sums.join(search.select(*levels, "left"), levels).withColumn("reached", F.sum("tokens").over(running))
        step = reached.withColumn("fits", F.col("reached") <= F.col("left"))
        found = step.groupBy(*levels).agg(
            F.max(F.when(F.col("fits"), F.col("reached"))).alias("taken"),
            F.max(F.when(F.col("fits"), F.col("next"))).alias("last"),
            F.min(F.when(~F.col("fits"), F.col("next"))).alias("next"),
        )
        # A range that fits is taken up to its end; no key is in the range "g".
        search = search.join(found, levels, "left").select(
            *levels,
            (F.col("left") - F.coalesce("taken", F.lit(0))).alias("left"),
            F.coalesce("next", F.lit("g")).alias("range"),
            F.coalesce(F.rpad("last", 32, "f"), F.col("cut")).alias("cut"),
        )
        search = stored(search, "search")
    return rest.join(search.select(*levels, F.col("cut").alias("__cut")), levels, "left").select(*levels, "__whole", "__cut")


def mix(
    documents: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    budget: Column,
    tokens: Column,
    epochs: int = 1,
    seed: int = 0,
    epoch: str | None = None,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The documents that are taken, once for each epoch that takes them.

    `levels` names the tree's levels from the top; `weights` gives whole weights of values by level; `budget` is a
    function of the column total, the tokens of all documents in all `epochs`; `epoch` names a column to add, or to replace.
    """
    named = _named(documents, levels, tokens, id, text)
    names = [f"__{name}" for name in levels]
    chosen = stored(plan(named, names, budget, {f"__{name}": listed for name, listed in weights.items()}, epochs, seed), "plan")
    joined = named.join(chosen, names)
    # Rows without tokens would fit into an epoch beyond the last.
    more = F.when((F.col("__whole") < epochs) & (_key(seed, F.col("__whole")) <= F.col("__cut")), 1).otherwise(0)
    times = joined.withColumn("__times", (F.col("__whole") + more).cast("int")).where("__times > 0")
    taken = times.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
    columns = [F.col(f"column {at}").alias(name) for at, name in enumerate(documents.columns) if name != epoch]
    return taken.select(*columns, *([F.col("__epoch").cast("long").alias(epoch)] if epoch else []))
