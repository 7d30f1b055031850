"""Operator 6: shards by a hierarchical weighted hash tree.

The tree has regions, racks and shards. Each node draws an exponential variate from a hash of
the document's id and the node's own name, of a rate equal to its weight, which is the sum of
its leaves' weights. A document descends at each level to the child of the least draw, and only
the children of the node it has come to draw. When a leaf's weight grows or shrinks, only draws
on the way to it change: rows move into or out of those subtrees, and all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.llm.common import materialize, release

RACKS, LEAVES = 3, 4


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def topology(n_shards: int, weights: dict[int, float] | None = None) -> list[Leaf]:
    """Shards in racks of LEAVES, racks in regions of RACKS."""
    return [Leaf(i, i // (RACKS * LEAVES), i // LEAVES % RACKS, (weights or {}).get(i, 1.0)) for i in range(n_shards)]


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """leaves and one more, in a region of its own: no other node's weight changes, so rows move only into the new shard."""
    return [*leaves, Leaf(max(x.shard for x in leaves) + 1, max(x.region for x in leaves) + 1, 0, weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)  # 53 bits
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(weight)


def _least(key: Column, nodes: dict[int, tuple[str, float]]) -> Column:
    """The number of the node of the least draw, the lower of equals, among nodes of a positive weight."""
    some = {k: v for k, v in nodes.items() if v[1] > 0}
    if len(some) == 1:
        return F.lit(next(iter(some)))
    return F.array_min(F.array(*(F.struct(_draw(key, *v).alias("draw"), F.lit(k).alias("k")) for k, v in some.items())))["k"]


def _shard(rows: DataFrame, key: str, leaves: list[Leaf], name: str) -> DataFrame:
    """rows with the shard, level by level; of racks and shards only those of the node come to are drawn."""

    def case(picks: list[tuple[Column, Column]]) -> Column:
        return reduce(lambda rest, pick: F.when(pick[0], pick[1]).otherwise(rest), reversed(picks[:-1]), picks[-1][1])

    c = F.col(key)
    weight = lambda some: sum(x.weight for x in some)
    leaves = [x for x in leaves if x.weight > 0]
    regions = {r: [x for x in leaves if x.region == r] for r in sorted({x.region for x in leaves})}
    racks = {(r, k): [x for x in own if x.rack == k] for r, own in regions.items() for k in sorted({x.rack for x in own})}
    rows = rows.withColumn("_region", _least(c, {r: (f"region-{r}", weight(own)) for r, own in regions.items()}))
    rack = [(F.col("_region") == r, _least(c, {k: (f"rack-{r}-{k}", weight(own)) for (q, k), own in racks.items() if q == r})) for r in regions]
    rows = rows.withColumn("_rack", case(rack))
    shard = [((F.col("_region") == r) & (F.col("_rack") == k), _least(c, {x.shard: (f"shard-{x.shard}", x.weight) for x in own})) for (r, k), own in racks.items()]
    return rows.withColumn(name, case(shard).cast("int")).drop("_region", "_rack")


def place(rows: DataFrame, key: str, leaves: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """rows with shard int and grown_shard int, null without a second tree. A null key is a key like any other."""
    rows = _shard(rows, key, leaves, "shard")
    return _shard(rows, key, grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))


def slots(placed: DataFrame, bucket_rows: int = 20_000) -> DataFrame:
    """placed with slot: 0, 1, ... in each shard in the order of doc_id.

    doc_id ranges of about bucket_rows rows are numbered apart and the counts of those ahead
    (more where there would be over 10,000 ranges) are added, so that no task holds a shard. Rows of one doc_id are spread by text_crc32 and a row number.
    """
    first = placed = materialize(placed.withColumn("_row", F.monotonically_increasing_id()), "placed")
    total = placed.count()
    n = min(10_000, max(1, -(-total // bucket_rows)))
    placed = placed.repartitionByRange(n, "doc_id", "text_crc32", "_row").withColumn("_bucket", F.spark_partition_id())
    # the buckets must not change when a partition is computed again
    placed = materialize(placed, "bucketed")
    release(first)
    inside = Window.partitionBy("_bucket", "shard").orderBy("doc_id", "text_crc32", "_row")
    ahead = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    ranked = placed.withColumn("_at", F.row_number().over(inside) - 1)
    return ranked.join(counts, ["shard", "_bucket"]).withColumn("slot", F.col("_ahead") + F.col("_at")).drop("_row", "_bucket", "_at", "_ahead")


def shard_documents(docs: DataFrame, n_shards: int = 24, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs.

    size: UTF-8 bytes of the text plus 8; a null text has none and the checksum 0. The law is
    ``key``: doc_id and the number of shards decide, and one more shard takes rows only into
    itself. Rows that share a doc_id share a shard and have slots of their own; a null doc_id
    has one shard too. Texts count whole, however long. Other columns are ignored; an empty table
    gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    leaves = topology(n_shards, weights)
    placed = place(rows, "doc_id", leaves, grow(leaves))
    return slots(placed).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
