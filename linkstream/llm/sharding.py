"""Sharding by a hierarchical weighted hash tree (native).

Shards are the leaves of a tree region > rack > shard.  A row goes down the
tree one level at a time; at each node every child draws
``-ln(u) / weight`` with ``u`` hashed from (row key, child), and the smallest
draw wins, so a child gets rows in proportion to the weight below it.

Weight is held as *generations*: what a tree was built with is generation 0,
and every later addition is a generation of its own with its own draw at each
level.  Old draws never change, so an addition can only win rows for itself:
they move into the new leaf and nowhere else, and rows of other subtrees keep
their place.  Lowering a weight makes only that subtree's draws worse, so only
its rows move.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstream.llm.common import dense_slots, free_name, unit_hash

SHARDS_PER_RACK = 5
RACKS_PER_REGION = 2
#: Bytes that a row takes besides its text.
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0
    generation: int = 0


def build_tree(shards: int) -> tuple[Leaf, ...]:
    """``shards`` leaves of weight 1, five to a rack and two racks to a region."""
    out = []
    for s in range(shards):
        rack = s // SHARDS_PER_RACK
        out.append(Leaf(rack // RACKS_PER_REGION, rack, s))
    return tuple(out)


def add_shard(tree: Sequence[Leaf], weight: float = 1.0) -> tuple[Leaf, ...]:
    """The tree with one more shard, numbered next."""
    s = max((x.shard for x in tree), default=-1) + 1
    rack = s // SHARDS_PER_RACK
    generation = max((x.generation for x in tree), default=-1) + 1
    return (*tree, Leaf(rack // RACKS_PER_REGION, rack, s, float(weight), generation))


def set_weight(tree: Sequence[Leaf], shard: int, weight: float) -> tuple[Leaf, ...]:
    """The tree with another weight for the leaves of ``shard``."""
    return tuple(replace(x, weight=float(weight)) if x.shard == shard else x for x in tree)


def _levels(tree: Sequence[Leaf]) -> list[list[list[tuple[str, float, int]]]]:
    """Per level and parent: (label, weight, place of its children or shard)."""
    live = [x for x in tree if x.weight > 0]
    if not live:
        raise ValueError("a tree needs a shard with a positive weight")

    def grouped(leaves, key):
        out: dict = {}
        for x in leaves:
            out.setdefault(key(x), []).append(x)
        return out

    top, racks, shards = [], [], []
    for (g, r), in_region in grouped(live, lambda x: (x.generation, x.region)).items():
        top.append((f"g{g}/r{r}", sum(x.weight for x in in_region), len(racks)))
        entry = []
        for k, in_rack in grouped(in_region, lambda x: x.rack).items():
            entry.append((f"g{g}/r{r}/k{k}", sum(x.weight for x in in_rack), len(shards)))
            shards.append([(f"g{g}/r{r}/k{k}/s{x.shard}", x.weight, x.shard) for x in in_rack])
        racks.append(entry)
    return [[top], racks, shards]


def _descend(key: Column, tree: Sequence[Leaf], seed: int) -> Column:
    at = F.lit(0)
    for parents in _levels(tree):
        table = F.expr("array(" + ", ".join(
            "array(" + ", ".join(f"named_struct('label', '{a}', 'w', {w!r}D, 'next', {n})" for a, w, n in children) + ")"
            for children in parents) + ")")
        draws = F.transform(F.get(table, at), lambda c: F.struct(
            (-F.ln(unit_hash(F.lit(str(seed)), key, c["label"])) / c["w"]).alias("d"), c["next"].alias("n")))
        at = F.array_min(draws)["n"]
    return at


def shard_of(key: Column, tree: Sequence[Leaf], seed: int = 0) -> Column:
    """The shard of a row key; a null key is a key of its own."""
    return _descend(F.coalesce(key.cast("string"), F.lit("null")), tree, seed).cast("int")


def shard_rows(df: DataFrame, id_col: str, text_col: str, tree: Sequence[Leaf],
               grown: Sequence[Leaf] | None = None, seed: int = 0) -> DataFrame:
    """-> (id, size, text_crc32, law, shard, slot, grown_shard), a row per row.

    ``law`` is ``key``: the id and the tree decide, whatever the text.
    ``slot`` counts from 0 without gaps inside a shard.  A null text has
    size 16 and the crc32 of no bytes (0); a null id is one key; equal rows
    get slots of their own; an empty table gives an empty result.  Other
    columns are not read.
    """
    size, crc, shard, more, slot = free_name(df.select(id_col), "size", "text_crc32", "shard", "grown_shard", "slot")
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    narrow = df.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_OVERHEAD).cast("bigint").alias(size),
        F.crc32(data).cast("bigint").alias(crc),
        shard_of(F.col(id_col), tree, seed).alias(shard),
        (shard_of(F.col(id_col), grown, seed) if grown else F.lit(None).cast("int")).alias(more))
    placed = dense_slots(narrow, [shard], [id_col, crc, size, more], slot)
    return placed.select(id_col, size, crc, F.lit("key").alias("law"), shard, slot, more)
