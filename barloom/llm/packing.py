"""Filling containers of fixed capacity with items, each whole in one container unless it is longer than the capacity.

Vector best-fit: an open container has residual capacities for tokens, documents and attention cost (the sum of squared
lengths). Items are placed in falling order of size; of the containers that hold an item under every constraint, the one with the
smallest weighted norm of what would be left takes it; every open container is weighed. Items are split at random into shards of
bounded size, packed side by side; containers that stay open are emptied and their items packed again in new shards of the same
size, for as long as that frees containers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Kinds of containers that are part of the plan; more of them are joined.
MOST_KINDS = 1000


@dataclass(frozen=True)
class PackingRules:
    """shard: items of a shard, about. weights: of tokens, documents and attention cost in the norm. max_documents and
    max_attention: capacities of a container; None for the most that its tokens allow, which never binds. open_share: room, as a
    share of the capacity, from which a container is emptied and packed again. gain: share of the emptied containers that a round
    must free for another one to follow."""

    shard: int = 10_000
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    max_documents: int | None = None
    max_attention: float | None = None
    open_share: float = 0.01
    gain: float = 0.001


def best_fit(sizes: np.ndarray, capacity: int, rules: PackingRules = PackingRules()) -> np.ndarray:
    """The container of each item; sizes are at most the capacity. All open containers are weighed for each item, as vectors; of
    equal norms the earliest container takes it."""
    most_docs = float(rules.max_documents or capacity)
    most_cost = float(rules.max_attention or float(capacity) ** 2)
    wt, wd, wa = rules.weights[0] / capacity**2, rules.weights[1] / most_docs**2, rules.weights[2] / most_cost**2
    out = np.full(len(sizes), -1, np.int64)
    order = np.argsort(-sizes, kind="stable")
    least = int(sizes.min()) if len(sizes) else 0
    # Residuals of the open containers, whose numbers are `name`; closed ones are swept out now and then.
    room, docs, cost, name = (np.zeros(64), np.zeros(64), np.zeros(64), np.zeros(64, np.int64))
    n = made = closed = 0
    for i in order:
        s = float(sizes[i])
        c = s * s
        r, d, q = room[:n], docs[:n], cost[:n]
        fits = np.flatnonzero((r >= s) & (d >= 1) & (q >= c)) if n else ()
        if len(fits):
            x, y, z = r[fits] - s, d[fits] - 1, q[fits] - c
            at = int(fits[np.argmin(wt * x * x + wd * y * y + wa * z * z)])
        else:
            if closed * 2 > n:
                keep = np.flatnonzero((r >= least) & (d >= 1))
                n, closed = len(keep), 0
                for a in (room, docs, cost, name):
                    a[:n] = a[keep]
            if n == len(room):
                room, docs, cost, name = (np.concatenate((a, np.zeros_like(a))) for a in (room, docs, cost, name))
            at, n, made = n, n + 1, made + 1
            room[at], docs[at], cost[at], name[at] = capacity, most_docs, most_cost, made - 1
        room[at] -= s
        docs[at] -= 1
        cost[at] -= c
        closed += bool(room[at] < least or docs[at] < 1)
        out[i] = name[at]
    return out


_PACKED = pa.schema([("container_kind", pa.string()), ("container_id", pa.string()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("n_tokens", pa.int32()), ("capacity_tokens", pa.int32()), ("room", pa.int32()), ("first", pa.int32())])


def _pack_shard(rules: PackingRules, level: int):
    def pack(items: pa.Table) -> pa.Table:
        capacity, kind, shard = items["capacity_tokens"][0].as_py(), items["container_kind"][0].as_py(), items["_shard"][0].as_py()
        order = np.lexsort((items["piece_no"].to_numpy(), items["doc_id"].to_numpy()))
        items = items.take(pa.array(order))
        sizes = items["n_tokens"].to_numpy()
        bins = best_fit(sizes, capacity, rules)
        room = capacity - np.bincount(bins, weights=sizes).astype(np.int64)
        n = len(sizes)
        first = np.zeros(n, np.int32)
        first[np.unique(bins, return_index=True)[1]] = 1  # one item of each container, to count them
        return pa.table([pa.array([kind] * n, pa.string()), pa.array([f"{level}-{shard}-{b}" for b in bins], pa.string()), items["doc_id"].combine_chunks(), items["piece_no"].combine_chunks(), items["n_tokens"].combine_chunks(), pa.array([capacity] * n, pa.int32()), pa.array(room[bins].astype(np.int32)), pa.array(first)], schema=_PACKED)

    return pack


def pieces(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, doc_id, piece_no, n_tokens): each item once for each kind of container.

    sizes: doc_id, n_tokens. An item longer than the capacity is cut into full pieces and a rest. Items without tokens (null or
    0) and kinds without a positive capacity have no rows. Up to MOST_KINDS kinds are part of the plan; of more, each item has a row
    for each kind all the same, by an equi-join on a spread key that every kind has.
    """
    found = containers.where((F.col("capacity_tokens") > 0) & F.col("container_kind").isNotNull()).groupBy("container_kind").agg(F.max("capacity_tokens").cast("int").alias("c"))
    some = found.limit(MOST_KINDS + 1).collect()
    kinds = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("int").alias("capacity_tokens")) for k, c in sorted(map(tuple, some))]) if some else F.array().cast("array<struct<container_kind:string,capacity_tokens:int>>")
    items = sizes.where(F.col("n_tokens") > 0)
    if len(some) <= MOST_KINDS:
        each = items.select("doc_id", "n_tokens", F.inline(kinds))
    else:
        spread = 64  # keys over which the items are spread
        all_kinds = found.select("container_kind", F.col("c").alias("capacity_tokens"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_s"))
        each = items.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int")).join(all_kinds, "_s").select("doc_id", "n_tokens", "container_kind", "capacity_tokens")
    last = F.expr("(n_tokens - 1) div capacity_tokens").cast("int")
    each = each.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    return each.select("container_kind", "capacity_tokens", F.col("doc_id").cast("bigint").alias("doc_id"), "piece_no", F.least(F.col("capacity_tokens"), F.col("n_tokens") - F.col("piece_no") * F.col("capacity_tokens")).cast("int").alias("n_tokens"))


def pack(items: DataFrame, n_items: int, rules: PackingRules = PackingRules(), cut=lambda df: df) -> DataFrame:
    """(container_kind, container_id, doc_id, piece_no, n_tokens, capacity_tokens): the container of each piece.

    items: as from pieces(); n_items: their number, which sets the number of shards. cut: materialises a round's result, since it
    is read twice. Full pieces are containers of their own. Every piece comes out once; an empty table gives no rows. No task packs
    more than about a shard, whatever is left open: items of which no two go together simply stay as they are.
    """
    columns = ["container_kind", "container_id", "doc_id", "piece_no", "n_tokens", "capacity_tokens"]
    whole = items.where(F.col("n_tokens") == F.col("capacity_tokens")).select("container_kind", F.concat_ws("-", F.lit("f"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")).alias("container_id"), "doc_id", "piece_no", "n_tokens", "capacity_tokens")
    done, rest, level = [whole], items.where(F.col("n_tokens") < F.col("capacity_tokens")), 0
    shards = max(1, math.ceil(n_items / rules.shard))
    ddl = "container_kind string, container_id string, doc_id bigint, piece_no int, n_tokens int, capacity_tokens int, room int, first int"
    before = None  # containers that held this round's items so far
    while True:
        sharded = rest.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(level)), F.lit(shards)))
        packed = sharded.groupBy("container_kind", "_shard").applyInArrow(_pack_shard(rules, level), ddl)
        if shards == 1:
            return _union([*done, packed.select(columns)])
        packed = cut(packed)
        still_open = F.col("room") > F.greatest(F.lit(1), F.col("capacity_tokens") * rules.open_share)
        counts = packed.groupBy("container_kind").agg(F.sum("first").alias("used"), F.sum(F.when(still_open, F.col("first"))).alias("open"), F.count_if(still_open).alias("left"))
        used, is_open, left = counts.agg(F.sum("used"), F.sum("open"), F.max("left")).first()
        if not left or (before is not None and used > before * (1 - rules.gain)):
            return _union([*done, packed.select(columns)])
        done.append(packed.where(~still_open).select(columns))
        rest, before = packed.where(still_open).select("container_kind", "capacity_tokens", "doc_id", "piece_no", "n_tokens"), is_open
        shards, level = max(1, math.ceil(left / rules.shard)), level + 1


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
