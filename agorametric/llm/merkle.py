"""Operator 5: Merkle fixity audit of WARC files, by built-in functions only.

A replica is a table of records: file, byte offset, length and content hash. Each replica's tree is built from its own
records and stored: records are hashed into leaves, one for each range of `LEAF_BYTES` bytes of a file that has records,
in order of their offsets; inner nodes hash their children in order, up to a root per file. Then the roots are compared,
and only branches whose hashes differ are descended, level by level. Records are read again only where leaves differ,
and not at all where no root does: `changed` at the same offset, `missing` or `extra` in the second replica.

Results for odd input: missing urls and contents count as empty; a record that repeats another counts once; of
different records at one offset each is compared by its content, as one place with a list of hashes; a file that only
one replica has differs at its root; records without a file or offset belong to no file and are left out; empty tables
give an empty table, and an empty second replica lacks every record. Other columns don't pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agorametric.llm.common import stored

# Bytes of a file under one leaf, and children of an inner node.
LEAF_BYTES = 1 << 16
FANOUT = 16

# Inner levels hashed after one shuffle; a task then holds whole groups of `FANOUT ** LEVELS_AT_ONCE` nodes.
LEVELS_AT_ONCE = 3

# Pages of one file.
FILE_PAGES = 512

# Copies of one record that are placed together.
COPIES_AT_ONCE = 1 << 12


def warc_record(url: Column, page: Column, content: Column) -> Column:
    """A response record as text; its bytes are its UTF-8 form."""
    content = F.coalesce(content, F.lit(""))
    lines = [
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: response"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string")),
        F.lit(""),
        content,
        F.lit(""),
        F.lit(""),
    ]
    return F.concat_ws("\r\n", *lines)


def records_of(pages: DataFrame, **others: Column) -> DataFrame:
    """Pages as records: page_id, file, offset, length, sha256. Further named columns of the page may be kept.

    A file holds the pages of a range of ids, in the order of id and hash; pages without an id are spread over files
    by their url. Only hashes and lengths are shuffled. Equal pages are counted first and placed in blocks of copies;
    a file's offsets are sums over its shares (of one id and one start of the hash) and then within a share, so that no
    task holds a file of any size. Sums within shares and the join with the shares' begins take the same shuffle.
    """
    text = warc_record(F.col("url"), F.col("page_id"), F.col("html"))
    spread = F.concat(F.lit("none-"), F.substring(F.md5(F.coalesce(F.col("url"), F.lit(""))), 1, 3))
    file = F.coalesce(F.concat(F.lit("pages-"), F.floor(F.col("page_id") / FILE_PAGES).cast("string")), spread)
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        file.alias("file"),
        F.octet_length(text).cast("long").alias("length"),
        F.sha2(text, 256).alias("sha256"),
        *[column.alias(name) for name, column in others.items()],
    )
    # Pages of one file either all have an id or none has, so 0 for a missing id mixes nothing.
    share = ["file", "of_page", "share"]
    different = slim.groupBy(*slim.columns).agg(F.count("*").alias("copies"))
    keyed = different.withColumns({"of_page": F.coalesce("page_id", F.lit(0)), "share": F.substring("sha256", 1, 2)})
    different = stored(keyed, "pages")
    size = F.sum(F.col("length") * F.col("copies"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    in_file = before.partitionBy("file").orderBy("of_page", "share")
    shares = different.groupBy(*share).agg(size.alias("size"))
    begins = shares.select(*share, F.coalesce(F.sum("size").over(in_file), F.lit(0)).alias("share_begin"))
    in_share = before.partitionBy(*share).orderBy("sha256", *others)
    within = different.withColumn("within", F.coalesce(size.over(in_share), F.lit(0)))
    placed = within.join(begins, share).withColumn("begin", F.col("share_begin") + F.col("within"))
    # Many copies of one page are blocks first, so that they are spread over tasks.
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPIES_AT_ONCE))))
    last = F.least(F.col("block") + COPIES_AT_ONCE, F.col("copies")) - 1
    if (different.agg(F.max("copies")).first()[0] or 0) > COPIES_AT_ONCE:
        blocks = blocks.repartition("file", "begin", "block")
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.col("block"), last)))
    return copies.select(*slim.columns, (F.col("begin") + F.col("copy") * F.col("length")).alias("offset"))


def _hashed(*parts: str) -> Column:
    """Hash of a node's different rows in order."""
    rows = F.sort_array(F.collect_set(F.struct(*parts)))
    lines = F.transform(rows, lambda row: F.concat_ws(":", *[F.coalesce(row[part].cast("string"), F.lit("-")) for part in parts]))
    return F.sha2(F.array_join(lines, "\n"), 256)


def tree(records: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """One replica's levels of nodes from the leaves up to a root per file: file, node, hash."""
    return _levels(records, ["file"], leaf_bytes, fanout)


def trees(left: DataFrame, right: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> tuple[list[DataFrame], ...]:
    """Both replicas' levels, each from its own records and of one height, by the same jobs."""
    both = left.withColumn("is_left", F.lit(True)).unionByName(right.withColumn("is_left", F.lit(False)))
    levels = _levels(both, ["is_left", "file"], leaf_bytes, fanout)
    return tuple([level.where(side).drop("is_left") for level in levels] for side in ("is_left", "NOT is_left"))


def _levels(records: DataFrame, of: list[str], leaf_bytes: int, fanout: int) -> list[DataFrame]:
    leaf = records.withColumn("node", F.floor(F.col("offset") / leaf_bytes))
    levels = [stored(leaf.groupBy(*of, "node").agg(_hashed("offset", "length", "sha256").alias("hash")), "level")]
    top, height = levels[0].agg(F.max("node")).first()[0] or 0, 0
    while top > 0:
        top, height = top // fanout, height + 1
    while height > 0:
        levels += _above(levels[-1], of, fanout, min(height, LEVELS_AT_ONCE))
        height -= LEVELS_AT_ONCE
    return levels


def _splits(*levels: DataFrame) -> int:
    """Parts in which stored nodes are read: enough tasks for what comes of them, as these are not more rows."""
    return max(level.rdd.getNumPartitions() for level in levels) or 1


def _above(level: DataFrame, of: list[str], fanout: int, height: int = 1) -> list[DataFrame]:
    """So many levels above the given one. Nodes that meet within them are shuffled together, once for all the levels."""

    def parent(node: Column) -> Column:
        return F.floor(node / fanout)

    meet = reduce(lambda node, _: parent(node), range(height), F.col("node"))
    nothing = F.array().cast("array<struct<height: int, node: bigint, hash: string>>")
    rows = level.select(*of, meet.alias("meet"), "node", "hash", nothing.alias("inner")).repartition(*of, "meet")
    for at in range(1, height + 1):
        children = rows.select(*of, "meet", F.col("node").alias("child"), F.col("hash").alias("below"), "inner")
        above = children.withColumn("node", parent(F.col("child"))).groupBy(*of, "meet", "node")
        found = above.agg(_hashed("child", "below").alias("hash"), F.flatten(F.collect_list("inner")).alias("inner"))
        node = F.struct(F.lit(at).alias("height"), "node", "hash")
        rows = found.withColumn("inner", F.concat("inner", F.array(node)))
    inner = rows.select(*of, F.explode("inner").alias("inner")).select(*of, "inner.*")
    inner = stored(inner.coalesce(_splits(level)), "level")
    return [inner.where(F.col("height") == at).drop("height") for at in range(1, height + 1)]


def differing_leaves(left: list[DataFrame], right: list[DataFrame], fanout: int = FANOUT) -> DataFrame | None:
    """Rows (file, node) of leaves that differ, found by descending from the roots; None where all roots are equal."""
    left, right = list(left), list(right)
    for levels, other in ((left, right), (right, left)):
        while len(levels) < len(other):
            levels += _above(levels[-1], ["file"], fanout)
    found = None
    for level, other in zip(reversed(left), reversed(right)):
        splits = _splits(level, other)
        if found is not None:
            branches = found.withColumnRenamed("node", "parent")
            level, other = (
                side.withColumn("parent", F.floor(F.col("node") / fanout)).join(branches, ["file", "parent"], "left_semi")
                for side in (level, other)
            )
        nodes = level.select("file", "node", "hash").join(other.select("file", "node", F.col("hash").alias("other")), ["file", "node"], "full")
        nodes = nodes.where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node")
        found = stored(nodes.coalesce(splits), "differing")
        if found.isEmpty():
            return None
    return found


def audit(left: DataFrame, right: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Where the second replica differs: file, offset, length (of the first, if it has one), kind and both hashes."""

    def placed(replica: DataFrame) -> DataFrame:
        numbers = [F.col(name).cast("long").alias(name) for name in ("offset", "length")]
        named = replica.select(F.col("file").cast("string").alias("file"), *numbers, "sha256")
        return stored(named.where("file IS NOT NULL AND offset IS NOT NULL"), "replica")

    left, right = placed(left), placed(right)
    leaves = differing_leaves(*trees(left, right, leaf_bytes, fanout), fanout)
    if leaves is None:
        return left.sparkSession.createDataFrame([], "file string, offset long, length long, kind string, left_sha256 string, right_sha256 string")
    return differing_places(left, right, leaves, leaf_bytes)


def differing_places(left: DataFrame, right: DataFrame, leaves: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """Both replicas' records under the given leaves, compared place by place."""

    def under(replica: DataFrame, is_left: bool) -> DataFrame:
        node = F.floor(F.col("offset") / leaf_bytes)
        inside = replica.withColumn("node", node).join(leaves, ["file", "node"], "left_semi")
        return inside.select("file", "offset", "length", "sha256", F.lit(is_left).alias("is_left"))

    # Sets of different records: repeated rows are gone before they are shuffled.
    def records(side: Column) -> Column:
        return F.sort_array(F.collect_set(F.when(side, F.struct("length", "sha256"))))

    def hashes(side: str) -> Column:
        named = F.filter(F.col(side)["sha256"], lambda sha256: sha256.isNotNull())
        return F.array_join(F.sort_array(F.array_distinct(named)), ",")

    sides = under(left, True).union(under(right, False))
    places = sides.groupBy("file", "offset").agg(
        records(F.col("is_left")).alias("left"), records(~F.col("is_left")).alias("right")
    )
    places = places.where("left <> right").select(
        "file",
        "offset",
        F.coalesce(F.array_max(F.col("left")["length"]), F.array_max(F.col("right")["length"])).alias("length"),
        hashes("left").alias("left_sha256"),
        hashes("right").alias("right_sha256"),
        (F.size("left") > 0).alias("has_left"),
        (F.size("right") > 0).alias("has_right"),
    )
    kind = F.when(~F.col("has_right"), "missing").when(~F.col("has_left"), "extra").otherwise("changed")
    return places.select("file", "offset", "length", kind.alias("kind"), "left_sha256", "right_sha256")
