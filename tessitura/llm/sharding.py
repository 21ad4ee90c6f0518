"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard levels. At each level every child of the node draws ``-ln(u) / weight`` from a hash
of (key, child) and the smallest draw wins, so a child gets rows in proportion to its weight. A draw depends on nothing
but the key, the child's name and its weight: when weights change, rows move only into or out of subtrees whose weights
changed. Everything is built from SQL expressions; rows never leave the JVM and the text itself is never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree: where it stands and how much it takes."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Topology:
    """The leaves of a hash tree. Weights of racks and regions are the sums of what is below them."""

    shards: tuple[Shard, ...]

    @staticmethod
    def regular(regions: int, racks: int, shards: int) -> Topology:
        """``regions * racks * shards`` equal leaves."""
        return Topology(tuple(Shard(f"g{g}", f"k{k}", (g * racks + k) * shards + s) for g in range(regions) for k in range(racks) for s in range(shards)))

    def grown(self, weight: float = 1.0) -> Topology:
        """One more shard, in a region of its own: no other subtree's weight changes, so rows move only into it."""
        n = 1 + max(s.shard for s in self.shards)
        return Topology((*self.shards, Shard(f"g+{n}", "k0", n, weight)))

    def reweighted(self, shard: int, weight: float) -> Topology:
        """Another weight for one leaf; only it, its rack and its region change their draws."""
        return Topology(tuple(replace(s, weight=weight) if s.shard == shard else s for s in self.shards))


#: 24 shards: three regions of two racks of four.
PRODUCTION = Topology.regular(3, 2, 4)


def _draw(key: Column, node: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of MD5 of key and node."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("@"), node)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def _levels(topology: Topology) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level of the tree: path of a node -> paths and weights of its children."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for s in topology.shards:
        path = ["", s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}"]
        for level, parent, child in zip(levels, path[:-1], path[1:], strict=True):
            level.setdefault(parent, {}).setdefault(child, 0.0)
            level[parent][child] += s.weight
    return [{p: sorted(c.items()) for p, c in level.items()} for level in levels]


def place(key: Column, topology: Topology) -> Column:
    """The shard of a key. A null key is placed as the text 'null'; equal draws go to the child first in order."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    at = F.lit("")
    for level in _levels(topology):
        children = F.create_map(*[x for p, c in level.items() for x in (F.lit(p), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in c]))])
        drawn = F.transform(children[at], lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name")))
        at = F.array_min(drawn)["name"]
    return F.element_at(F.split(at, "/"), -1).cast("int")


def shard_documents(docs: DataFrame, topology: Topology = PRODUCTION, *, key: str = "doc_id", text: str = "text", lanes: int = 1024) -> DataFrame:
    """Every row's shard under the law ``key``: the key and the number of shards decide.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot (gapless from 0 within a shard) and
    grown_shard (the shard once the topology has grown by one). Other columns of the input are left out.

    Slots are numbered without putting a shard into one task: rows fall into ``lanes`` lanes by a hash, lane sizes
    (at most shards * lanes rows, whatever the input) are summed up per shard, and rows are numbered within a lane.

    Cases: null text has size 8 and the CRC of no bytes (0); a null key is placed as one key; empty tables give no rows;
    repeated rows with one key share a shard and take a slot each; rows alike in key, size and CRC are interchangeable.
    """
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    body = F.coalesce(F.col("text"), F.lit(""))
    placed = rows.select(
        "doc_id",
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col("doc_id"), topology).alias("shard"),
        F.pmod(F.xxhash64("doc_id", F.crc32(body)), F.lit(lanes)).cast("int").alias("lane"),
        place(F.col("doc_id"), topology.grown()).alias("grown_shard"),
    )
    lane = W.partitionBy("shard").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "lane").agg(F.count(F.lit(1)).alias("n")).select("shard", "lane", F.coalesce(F.sum("n").over(lane), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "lane").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("rank", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "lane"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
