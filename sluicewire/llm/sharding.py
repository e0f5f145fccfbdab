"""Sharding by a hierarchical weighted hash tree.

A row descends region -> rack -> shard. At each node every child draws
``-ln(u(key, child)) / weight`` and the smallest draw wins, so a child gets rows in proportion to
its weight, and raising one child's weight only moves rows *into* that child: movement stays in
the subtree whose weight changed. ``grow`` hangs a new shard under a region of its own, so no
other node's weight changes and rows move only into the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, durable, named

#: Bits of a row's bucket inside its shard, for numbering the shard's rows, and the fewest that are used.
BUCKET_BITS, LEAST_BITS = 20, 8
#: Offsets of at most so many buckets (a few MB) are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Node:
    """A leaf holds ``shard``; an inner node's weight is the sum of its children's."""

    name: str
    leaf_weight: float = 1.0
    shard: int | None = None
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


def uniform_tree(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> Node:
    """``shards`` equal leaves in racks of ``per_rack`` and regions of ``racks_per_region`` racks."""
    leaves = [Node(f"shard{i}", 1.0, i) for i in range(shards)]
    racks = [Node(f"rack{i}", children=tuple(leaves[i * per_rack : (i + 1) * per_rack])) for i in range(-(-shards // per_rack))]
    regions = [Node(f"region{i}", children=tuple(racks[i * racks_per_region : (i + 1) * racks_per_region])) for i in range(-(-len(racks) // racks_per_region))]
    return Node("root", children=tuple(regions))


def grow(tree: Node, weight: float = 1.0) -> Node:
    """``tree`` with one more shard, in a new rack of a new region."""
    n = len(tree.leaves())
    leaf = Node(f"shard{n}", weight, n)
    return Node(tree.name, children=(*tree.children, Node(f"region+{n}", children=(Node(f"rack+{n}", children=(leaf,)),))))


def _draw(key: Column, child: Node) -> Column:
    """An exponential race time; 53 bits of a seeded hash make the uniform number."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(child.weight)


def assign(key: Column, node: Node) -> Column:
    """The shard of ``key`` as one JVM expression: one draw for each child on the way down.

    Children of weight zero get nothing; ties go to the child listed first.
    """
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError(f"{node.name} has no child with a positive weight")
    if len(live) == 1:
        return assign(key, live[0])
    best = F.array_min(F.array(*[F.struct(_draw(key, c).alias("t"), F.lit(i).alias("i")) for i, c in enumerate(live)]))["i"]
    out = assign(key, live[-1])
    for i in range(len(live) - 2, -1, -1):
        out = F.when(best == i, assign(key, live[i])).otherwise(out)
    return out


def shard_table(df: DataFrame, tree: Node, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the key's string form and the tree decide, so equal keys (null keys too,
    which count as the empty string) share a shard whatever their texts. A null text has size 1
    and the checksum of no bytes; a text of any length is measured whole. Repeated rows keep one slot
    each. Slots are gapless per shard, in the order of a hash bucket and then the key; numbering needs
    only per-bucket counts, never a shard in one task: a shard has about as many buckets as the square
    root of the number of rows. Rows that tie in all of key, checksum and size are alike, so their
    slots may be swapped. Other columns of ``df`` are not read, whatever their names. An empty table
    gives no rows.
    """
    k = F.coalesce(named(key).cast("string"), F.lit(""))
    body = F.coalesce(named(text), F.lit(""))
    rows = durable(
        df.select(named(key).alias("key"), F.octet_length(body).cast("long").alias("bytes"), F.crc32(body.cast("binary")).alias("crc"), k.alias("k")).select(
            "key",
            (F.col("bytes") + 1).alias("size"),
            F.col("crc").alias("text_crc32"),
            assign(F.col("k"), tree).cast("int").alias("shard"),
            assign(F.col("k"), grow(tree)).cast("int").alias("grown_shard"),
            # the checksum spreads a key that many different rows share
            F.shiftrightunsigned(F.xxhash64("k", "crc", F.lit("slot")), 64 - BUCKET_BITS).cast("int").alias("bits"),
        )
    )
    bits = min(BUCKET_BITS, max(LEAST_BITS, rows.count().bit_length() // 2))
    rows = rows.withColumn("bucket", F.shiftright("bits", BUCKET_BITS - bits)).drop("bits")
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x 2 ** bits rows of three numbers
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if len(grow(tree).leaves()) << bits <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    here = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(here) - 1)
        .join(offsets, ["shard", "bucket"])
        .select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("before")).cast("long").alias("slot"), "grown_shard")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in eight equal shards; see :func:`shard_table` for nulls, ties, repeats and the rest."""
    return shard_table(documents(spark, sf_dir), uniform_tree(8))
