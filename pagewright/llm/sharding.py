"""Sharding by a k-d tree over metadata, in DataFrame functions only.

The tree starts with all points in one node that stands for all shards. A node of more than one shard is cut along its
widest metadata dimension, at the weighted median (for an odd number of shards, at the quantile of their share), until
each leaf stands for one shard, and so for the target size. Medians are found where the rows are: a point's key on a
dimension is one whole number of 48 bits, and each of four passes sums the weights by the next 12 bits of the points
that agree with what is known of their node's median so far. A pass returns at most 4096 sums a node and dimension,
whatever the number of rows.

A point is all rows of one text, so equal texts stay in one shard. Where such a group weighs more than a fiftieth of
a shard, sizes near equal come first: its rows are points of their own. There are at most fifty such groups a shard,
and only their digests are broadcast.

Dimensions: numbers are scaled from their smallest to their largest value, other columns placed by MD5. On a dimension,
points of one place are ordered by the MD5 of their text (rows of a heavy group: of their doc_id), so that a common
value, or a missing dimension, can be cut too.

Defined results: null texts are empty (size 1); null metadata lie at the beginning of their dimension; a group lies
where its smallest doc_id lies; repeated rows each get a slot (rows of one doc_id are numbered in one task); an empty table gives an empty result; other columns are
neither read nor returned by ``sharded``, and kept whatever their names by ``write_shards``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import Scratch, fresh


@dataclass(frozen=True)
class ShardParams:
    shards: int = 8
    #: In place of ``shards``: as many as the target size of a shard asks for.
    target_bytes: int | None = None
    dimensions: tuple[str, ...] = ("source", "lang", "n_chars")
    #: A group of equal texts stays together if it weighs at most a shard's size divided by this.
    whole: int = 50


#: A key: 12 bits of place on the dimension, 24 of the point's MD5, 12 that tell repeated rows of a heavy group apart.
DIGIT, DIGITS = 12, 4
PLACES = 1 << DIGIT


def _hex(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def _placed(docs: DataFrame, name: str) -> Column:
    """The place of a row on a dimension, 0 to 4095; only named dimensions are looked at."""
    if not isinstance(docs.schema[name].dataType, NumericType):
        return F.coalesce(_hex(F.md5(F.col(name).cast("string")), 3), F.lit(0).cast("long"))
    exact = F.col(name).cast("decimal(20,0)")
    ends = docs.agg(F.min(exact).alias("low"), F.max(exact).alias("high")).first()
    if ends["low"] is None or ends["low"] == ends["high"]:
        return F.lit(0).cast("long")
    span = f"{ends['high'] - ends['low']}"
    return F.coalesce(F.expr(f"(cast(`{name}` as decimal(20,0)) - {ends['low']}) * {PLACES - 1} div {span}"), F.lit(0)).cast("long")


def _measures(docs: DataFrame, params: ShardParams) -> dict[str, Column]:
    """What a row is dealt by: size, digest of its text, places by dimension, and a number of its own."""
    known = [d for d in params.dimensions if d in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    return {
        "doc_id": F.col("doc_id"), "size": (F.octet_length(text) + 1).cast("long"), "digest": F.md5(text),
        "places": F.array(*(_placed(docs, d) for d in known)) if known else F.array(F.lit(0).cast("long")), "row": F.monotonically_increasing_id(),
    }


def _keys(mark: Column, repeat: Column) -> Column:
    low = F.shiftleft(mark, DIGIT).bitwiseOR(repeat)
    return F.transform("places", lambda place: F.shiftleft(place, DIGIT * (DIGITS - 1)).bitwiseOR(low))


def _row_keys() -> Column:
    return _keys(_hex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 6), F.xxhash64("row").bitwiseAND(PLACES - 1))


def _by_node(values: dict[int, int]) -> Column:
    """A value by node, -1 for a node without one."""
    listed = F.array(*(F.lit(values.get(k, -1)).cast("long") for k in range(max(values) + 1)))
    return F.coalesce(F.get(listed, F.col("node").cast("int")), F.lit(-1).cast("long"))


def _digit(key: Column, k: int) -> Column:
    return F.shiftright(key, DIGIT * (DIGITS - 1 - k)).bitwiseAND(PLACES - 1)


def _cuts(points: DataFrame, sums: DataFrame, shards: dict[int, int], totals: dict[int, int], dims: dict[int, int]) -> dict[int, int]:
    """By node the last key that goes to the left: the keys whose weight lies, by its middle, within the left shards' share.

    ``sums`` has node, dim, digit and w of the first digit; ``points`` node, keys, size. Weights are compared times the
    node's number of shards, so that all is whole numbers.
    """
    share = {n: (shards[n] // 2) * totals[n] for n in shards}
    prefix, before = dict.fromkeys(shards, 0), dict.fromkeys(shards, 0)
    key = F.get("keys", _by_node(dims).cast("int"))
    for k in range(DIGITS):
        if k:
            agree = points.filter(F.shiftright(key, DIGIT * (DIGITS - k)) == _by_node(prefix))
            sums = agree.groupBy("node", _digit(key, k).alias("digit")).agg(F.sum("size").alias("w"))
        else:
            sums = sums.filter(F.col("dim") == _by_node(dims))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)) + _by_node(before)
        reached = sums.withColumn("upto", upto).filter(F.col("upto") * _by_node(shards) >= _by_node(share))
        for r in reached.groupBy("node").agg(F.min(F.struct("digit", "upto", "w")).alias("x")).select("node", "x.*").collect():  # a row a node
            n = r["node"]
            prefix[n], before[n] = prefix[n] << DIGIT | r["digit"], r["upto"] - r["w"]
            if k == DIGITS - 1 and (2 * before[n] + r["w"]) * shards[n] > 2 * share[n]:
                prefix[n] -= 1
    return prefix


def _below(levels: list[tuple[dict[int, int], dict[int, int]]], rows: DataFrame) -> DataFrame:
    """The rows (with keys) with their leaf, as ``node``."""
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    for dims, cuts in levels:
        right = (F.get("keys", _by_node(dims).cast("int")) > _by_node(cuts)).cast("long")
        rows = rows.withColumn("node", F.when(_by_node(dims) >= 0, F.col("node") * 2 + right).otherwise(F.col("node")))
    return rows


@dataclass(frozen=True)
class ShardPlan:
    """The tree, and the shard of every text that isn't in a heavy group."""

    levels: list[tuple[dict[int, int], dict[int, int]]]
    shards: dict[int, int]
    heavy: DataFrame
    light: DataFrame

    def deal(self, rows: DataFrame) -> DataFrame:
        """``rows`` (doc_id, digest, places, row and more) with their ``shard``."""
        heavy = F.broadcast(self.heavy)  # at most ShardParams.whole digests a shard
        own = _below(self.levels, rows.join(heavy, "digest", "left_semi").withColumn("keys", _row_keys())).withColumn("shard", _by_node(self.shards).cast("int")).drop("keys", "node")
        return own.unionByName(rows.join(heavy, "digest", "left_anti").join(self.light, "digest"))


def plan(scratch: Scratch, rows: DataFrame, params: ShardParams) -> ShardPlan:
    """The tree over rows of (doc_id, size, digest, places, row)."""
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.min(F.struct("doc_id", "places")).alias("at")).select("digest", "size", F.col("at.places").alias("places"))
    groups = scratch.write(groups, "groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // params.target_bytes)) if params.target_bytes else params.shards
    if shards < 1 or params.whole < 1:
        raise ValueError("shards and whole must be 1 or more")
    heaviest = total // (shards * params.whole)
    heavy = scratch.write(groups.filter(F.col("size") > heaviest).select("digest"), "heavy")
    light = groups.filter(F.col("size") <= heaviest).withColumn("keys", _keys(_hex(F.col("digest"), 6), F.lit(0).cast("long")))
    single = rows.join(F.broadcast(heavy), "digest", "left_semi").withColumn("keys", _row_keys())
    points = scratch.write(light.select("keys", "size").unionByName(single.select("keys", "size")), "points")
    nodes, first, levels = {1: shards}, {1: 0}, []
    while True:
        at = _below(levels, points)
        many = [n for n, k in nodes.items() if k > 1 and 2 * n not in nodes]
        by = at.filter(F.col("node").isin(many)).select("node", "size", F.posexplode("keys").alias("dim", "key")) if many and total else None
        if by is None:
            break
        # Widths, weights and the first digits of all dimensions in one pass.
        sums = scratch.write(by.groupBy("node", "dim", _digit(F.col("key"), 0).alias("digit")).agg(F.sum("size").alias("w")), f"sums-{len(levels)}")
        widths = sums.groupBy("node", "dim").agg((F.max("digit") - F.min("digit")).alias("width"), F.sum("w").alias("w")).orderBy("node", F.desc("width"), "dim").collect()  # a row a node and dimension
        dims, totals = {}, {}
        for r in widths:
            dims.setdefault(r["node"], r["dim"])
            totals[r["node"]] = r["w"]
        if not dims:
            break
        cuts = _cuts(at.filter(F.col("node").isin(list(dims))), sums, {n: nodes[n] for n in dims}, totals, dims)
        scratch.drop(f"sums-{len(levels)}")
        levels.append((dims, cuts))
        for n in dims:
            left = nodes[n] // 2
            nodes[2 * n], nodes[2 * n + 1] = left, nodes[n] - left
            first[2 * n], first[2 * n + 1] = first[n], first[n] + left
    scratch.drop("points")
    dealt = _below(levels, light).select("digest", _by_node(first).cast("int").alias("shard"))
    return ShardPlan(levels, first, heavy, dealt)


def sharded(docs: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.write(docs.select(F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), *(c.alias(n) for n, c in _measures(docs, params).items())), "rows")
    found = plan(scratch, rows, params)
    dealt = found.deal(rows).select("doc_id", "size", "text_crc32", "shard", "row")
    # Slots without a task that sees a whole shard: numbered within parts, about as many as a part has rows.
    parts = max(1, isqrt(rows.count() // max(1, max(found.shards.values()) + 1)))
    dealt = scratch.write(dealt.withColumn("part", F.pmod(_hex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 8), F.lit(parts))), "dealt")
    scratch.drop("rows", "groups", "heavy")
    ends = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("k"))
    start = F.sum("k").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row")) - 1
    placed = dealt.withColumn("number", number).join(ends.select("shard", "part", start.alias("start")), ["shard", "part"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, params: ShardParams = ShardParams()) -> None:
    """Writes ``docs``, with every column, as one folder of Parquet a shard."""
    scratch, name = Scratch(docs.sparkSession, "sharding"), fresh(docs, "shard")
    measures = {n: c.alias(n) for n, c in _measures(docs, params).items()}
    found = plan(scratch, scratch.write(docs.select(*measures.values()), "rows"), params)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *(measures[n] for n in ("doc_id", "digest", "places", "row")))
    found.deal(rows).select("doc.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    scratch.drop("rows", "groups", "heavy")
