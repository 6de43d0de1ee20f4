"""Shards from a weighted tree of regions, racks and shards.

A document descends the tree. At each level every child draws -ln(u) / weight with u a
hash of the child and the document, and the least draw wins, so a child gets its weight's
share. When a weight changes, a document moves only if the changed child starts or stops
winning, so movement stays within the subtrees on the path whose weights changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import group_count, store

RACK_SHARDS = 4
REGION_RACKS = 3
SHARDS = 24
#: Rows that are numbered together within a shard.
SLOT_ROWS = 8192
_STEPS = 1 << 52

Tree = dict[int, dict[int, dict[int, float]]]


def even_tree(shards: int) -> Tree:
    """Shards of weight 1 in racks of 4 and regions of 3 racks; a last region takes what is left."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // RACK_SHARDS
        tree.setdefault(rack // REGION_RACKS, {}).setdefault(rack % REGION_RACKS, {})[s] = 1.0
    return tree


def _child(key: Column, parent: Column, weights: Column) -> Column:
    """The child with the least draw; ``weights`` is an array of (child, weight)."""

    def draw(x: Column) -> Column:
        digest = F.md5(F.concat_ws("/", parent, x["child"].cast("string"), key))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(_STEPS))
        return F.struct((-F.ln(u) / x["weight"]).alias("draw"), x["child"].alias("child"))

    return F.array_min(F.transform(weights, draw))["child"]


def _array(children: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight")) for c, w in sorted(children.items())])


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a document; ``key`` is text. Every weight must be positive."""
    rack_weight = {r: {k: sum(s.values()) for k, s in racks.items()} for r, racks in tree.items()}
    region = _child(key, F.lit("top"), _array({r: sum(w.values()) for r, w in rack_weight.items()}))
    racks = F.create_map(*[x for r, w in rack_weight.items() for x in (F.lit(r), _array(w))])
    shards = F.create_map(*[x for r, own in tree.items() for k, s in own.items() for x in (F.lit(f"{r}/{k}"), _array(s))])
    rack = _child(key, F.concat_ws("/", F.lit("region"), region.cast("string")), F.element_at(racks, region))
    place = F.concat_ws("/", region.cast("string"), rack.cast("string"))
    return _child(key, F.concat_ws("/", F.lit("rack"), place), F.element_at(shards, place))


def with_slots(rows: DataFrame, *order: str, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps, in the order of ``point`` and then ``order``.

    ``point`` is a hash of 0 to 2^52 - 1. Its range is cut into even buckets, each numbered
    by itself from where the buckets before it end, so no shard is gathered in one task.
    """
    buckets = group_count(rows.count(), SHARDS * slot_rows)
    rows = rows.withColumn("bucket", F.floor(F.col("point") / F.lit(-(-_STEPS // buckets))))
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "bucket").orderBy("point", *order)
    return (
        rows.join(starts, ["shard", "bucket"])
        .withColumn("slot", (F.col("first") + F.row_number().over(own) - 1).cast("long"))
        .drop("bucket", "first")
    )


def place_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the number of shards decide alone. ``grown_shard`` is the
    place with one shard more; while the regions before it are full, the new shard makes a
    region of its own and takes rows only into itself. A null doc_id is a key like any
    other; a null text has no bytes. Repeated rows share a shard and take a slot each.
    """
    # the separator keeps a null id apart from every number
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, even_tree(shards)).alias("shard"),
        shard_of(key, even_tree(shards + 1)).alias("grown_shard"),
        key.alias("key"),
    )
    point = F.md5(F.concat_ws("/", F.lit("slot"), "key", "size", "text_crc32"))
    placed = placed.withColumn("point", F.conv(F.substring(point, 1, 13), 16, 10).cast("long")).drop("key")
    slots = with_slots(store(placed, "placed"), "doc_id", "size", "text_crc32")
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
