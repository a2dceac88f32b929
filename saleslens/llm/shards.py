"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

Every node has a name and, as weight, the sum of its shards'. At each level a key draws
``-ln(u) / weight`` for each child, ``u`` from a hash of key and child name, and goes to the least
draw. A draw depends on the child's own name and weight only. So if weights change, the draws of all
other nodes stay: a row moves only into or out of a node on a path whose weight changed, and rows
elsewhere keep their order of preference.

The tree is a map literal; its size is the number of shards, a parameter of the caller.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from saleslens.llm.common import col, fresh, staged

#: Shards of the founding tree, and its shape.
FOUNDING, REGION, RACK = 40, 10, 5
#: Parts of a shard that are numbered on their own.
PARTS = 256


class Shard(NamedTuple):
    region: str
    rack: str
    number: int
    weight: float = 1.0


def tree(n: int, founding: int = FOUNDING, region: int = REGION, rack: int = RACK) -> list[Shard]:
    """The tree of ``n`` shards of equal weight; the count alone decides it.

    The founding shards fill regions of ``region`` and racks of ``rack`` shards. Each later shard
    joins in a region and rack of its own, so no weight of an older node changes and one more shard
    takes rows only into itself.
    """
    old = [Shard(f"region{s // region}", f"rack{s // rack}", s) for s in range(min(n, founding))]
    return old + [Shard(f"joined{s}", f"joined{s}", s) for s in range(founding, n)]


def _children(shards: list[Shard]) -> dict[str, list[tuple[str, float]]]:
    weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for s in shards:
        if not s.weight >= 0:
            raise ValueError("weights are zero or more")
        names = ("", s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.number}")
        for parent, child in zip(names, names[1:], strict=False):
            weights[parent][child] += s.weight
    if len({s.number for s in shards}) != len(shards) or not any(s.weight for s in shards):
        raise ValueError("shards need numbers of their own, and one a weight")
    return {p: [(c, w) for c, w in kids.items() if w > 0] for p, kids in weights.items()}


def shard_of(key: Column, shards: list[Shard]) -> Column:
    """The shard number of a string key; a null key counts as one key of its own."""
    kids = {p: k for p, k in _children(shards).items() if k}
    entry = lambda c, w: F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight"))
    tree_map = F.create_map(*(x for p, k in kids.items() for x in (F.lit(p), F.array(*(entry(c, w) for c, w in k)))))
    key = F.coalesce(F.concat(F.lit("="), key), F.lit("null"))
    node = F.lit("")
    for _ in range(3):
        def draw(child: Column) -> Column:
            bits = F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11)
            return F.struct((-F.log((bits + 0.5) / float(1 << 53)) / child["weight"]).alias("draw"), child["name"].alias("name"))

        node = F.array_min(F.transform(F.element_at(tree_map, node), draw))["name"]
    return F.element_at(F.split(node, "/"), -1).cast("int")


def numbered(rows: DataFrame, group: str, part: Column, order: list[Column], name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 within ``group``.

    Parts are numbered each on its own, then moved by the count of the parts before; no group has to
    fit one task. ``rows`` is used twice, so hand in a written table.
    """
    piece, before, number = fresh(rows.columns, "piece", "before", "number")
    rows = rows.withColumn(piece, part)
    counts = rows.groupBy(group, piece).agg(F.count(F.lit(1)).alias(before))
    running = Window.partitionBy(group).orderBy(piece)
    counts = counts.select(group, piece, (F.sum(before).over(running) - F.col(before)).alias(before))
    own = rows.withColumn(number, F.row_number().over(Window.partitionBy(group, piece).orderBy(*order)))
    joined = own.join(counts, [group, piece])
    return joined.withColumn(name, F.col(number) + F.col(before) - 1).drop(piece, before, number)


def place(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None,
          doc_id: str = "doc_id", text: str = "text", parts: int = PARTS) -> DataFrame:
    """One row per document: id, size, crc, law, shard, slot and, with a grown tree, its shard there.

    The law is ``key``: id and tree decide the shard. Size is the text's UTF-8 bytes (null: none)
    plus 16. Slots run from 0 without gaps in each shard. Null ids are one key; null text counts
    as empty; repeated rows get slots of their own; no documents give no rows.
    """
    key = col(doc_id).cast("string")
    light = docs.select(
        col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(col(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, shards).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast(T.IntegerType())).alias("grown_shard"),
    )
    part = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    slots = numbered(staged(light, "shards"), "shard", part, order, "slot")
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
