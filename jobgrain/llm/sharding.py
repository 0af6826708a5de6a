"""Hierarchical weighted hash tree: region, rack and shard by weighted hash draws.

At each level a document draws -ln(u) / weight for each child, u a hash of (doc_id, node), and goes to the child
with the smallest draw: each child gets its share by weight. A draw depends on the node's own weight
alone, so when a weight changes, documents move only into or out of that node, and everything below the other
nodes stays. Law ``key``: doc_id and the tree decide.

A grown tree hangs the new shard in a new region of its own: no other node changes its weight, so documents move
into the new shard alone. (A shard put into an existing rack changes the weights on its path; then movement
stays within the subtrees on that path, but may shuffle inside them.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from jobgrain.llm.common import materialize, require

#: Rows of one shard that share a numbering bucket, about.
BUCKET_ROWS = 100_000


@dataclass(frozen=True)
class Node:
    """A node of the tree; its weight is its own (a shard) or that of its children together."""

    name: str
    children: tuple[Node, ...] = ()
    own_weight: float = 1.0
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def regular_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 4, extra: int = 0) -> Node:
    """Shards 0.. in equal racks and regions; each of ``extra`` more shards stands in a new region of its own."""
    leaves = [Node(f"shard{i}", shard=i) for i in range(shards)]
    racks = [Node(f"rack{i}", tuple(leaves[j : j + shards_per_rack])) for i, j in enumerate(range(0, shards, shards_per_rack))]
    regions = [Node(f"region{i}", tuple(racks[j : j + racks_per_region])) for i, j in enumerate(range(0, len(racks), racks_per_region))]
    for k in range(shards, shards + extra):
        leaf = Node(f"shard{k}", shard=k)
        regions.append(Node(f"region-of-{k}", (Node(f"rack-of-{k}", (leaf,)),)))
    return Node("root", tuple(regions))


def _draw(key: Column, node: Node) -> Column:
    h = F.xxhash64(key, F.lit(node.name)).bitwiseAND(F.lit((1 << 52) - 1))
    return -F.log((h + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(node.weight))


def _choose(key: Column, node: Node) -> Column:
    """Position of the child of ``node`` that wins the draw."""
    draws = [F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(node.children) if c.weight > 0]
    return F.array_min(F.array(*draws))["child"] if len(draws) > 1 else draws[0]["child"]


def descend(df: DataFrame, key: str, tree: Node, shard: str) -> DataFrame:
    """Add column ``shard``: one draw per level, each among the children of the node reached so far."""
    level = [((), tree)]
    df = df.withColumn("_path", F.array().cast("array<int>"))
    while any(n.children for _, n in level):
        step = F.lit(-1)
        for path, n in level:
            if n.children and n.weight > 0:
                here = F.col("_path") == F.array(*map(F.lit, path)).cast("array<int>")
                step = F.when(here, _choose(F.col(key), n)).otherwise(step)
        df = df.withColumn("_path", F.concat("_path", F.array(step)))
        level = [((*path, i), c) for path, n in level for i, c in enumerate(n.children)]
        if any(n.children for _, n in level) != all(n.children for _, n in level):
            raise ValueError("all shards must stand at one depth")
    names = F.create_map(*[x for path, n in level for x in (F.lit(",".join(map(str, path))), F.lit(n.shard))])
    return df.withColumn(shard, F.element_at(names, F.concat_ws(",", F.col("_path").cast("array<string>")))).drop("_path")


def number_rows(df: DataFrame, group: str, key: str) -> DataFrame:
    """Add ``slot``: 0, 1, ... without gaps within each group, however large the groups are and however often a key repeats.

    The (narrow) rows are written once with a number of their own. They are dealt to buckets of a group by a hash of key and
    number; bucket counts (small, summed map-side) give each bucket its first slot, and only the rows of one bucket are
    numbered together.
    """
    df = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    buckets = max(1, -(-df.count() // BUCKET_ROWS)) * 8
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(key, "_row", F.lit("slot")), F.lit(buckets)).cast("int"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    first = df.groupBy(group, "_bucket").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = W.partitionBy(group, "_bucket").orderBy(key, "_row")
    numbered = df.withColumn("_slot", F.row_number().over(own) - 1).join(first.drop("_n"), [group, "_bucket"])
    return numbered.withColumn("slot", (F.col("_first") + F.col("_slot")).cast("long")).drop("_bucket", "_first", "_slot", "_row")


def shard_documents(docs: DataFrame, tree: Node | None = None, grown: Node | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (shard under the ``grown`` tree).

    Size is the text's UTF-8 bytes plus 1 (null text: 1, checksum 0). Null doc_ids share one draw; repeated doc_ids go to
    the same shard and get slots of their own; an empty table gives an empty result; further columns are ignored.
    The texts are measured before the shuffle and not carried through it.
    """
    tree, grown = tree or regular_tree(16), grown or regular_tree(16, extra=1)
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = require(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law")
    )
    placed = descend(descend(sized, "doc_id", tree, "shard"), "doc_id", grown, "grown_shard")
    return number_rows(placed, "shard", "doc_id").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
