"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find groups.

Texts become sets of k-word shingles (64-bit hashes). Equal sets are one node. A signature has
``bands * rows`` slots; every element visits the slots in an order of its own (a permutation) and its
rank at level j lies in [j, j+1), so a slot filled at a level can't be improved by a later one: the
levels stop as soon as all slots are filled. Nodes that agree in a whole band share a bucket. Links
count only when the full sets confirm them.

Buckets of any size are resolved without forming all their pairs: some rounds compare every member with
one pivot of its bucket; what then still lies in several groups of one bucket is compared block by
block, on the full sets. A pair of blocks returns a spanning forest of its links at most.

Defined results: a text without words, empty or null has an empty set and no links. A document's group
is named by the smallest doc_id in it; rows with a null doc_id take part and never name a group (a group
of such rows only has a null name and keeps its rows). Repeated rows of one doc_id are kept or dropped
together. Other columns are ignored, whatever their names. Hash collisions: two different shingles are
taken as one with a chance of 2^-64 for each pair; sets are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wakeline.llm.common import chunks, mix, shingles, word_hashes
from wakeline.session import saved


@dataclass(frozen=True)
class NearDedup:
    """k words a shingle; linked from ``percent`` similarity on; at 80 % two sets share no band with a chance of 0.59^24 = 3e-6."""

    k: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    pivot_rounds: int = 3
    block: int = 128


_EMPTY = np.uint64(2**64 - 1)
_GOLD = 0x9E3779B97F4A7C15


def _salt(i: int) -> np.uint64:
    return np.uint64(i * _GOLD % 2**64)


def signatures(s: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash of each text (rows) over its element hashes; texts without elements keep empty slots."""
    out = np.full(len(counts) * slots, _EMPTY)
    owner = np.repeat(np.arange(len(counts)), counts)
    active, order = np.arange(len(s)), None
    for level in range(slots):
        e, d = s[active], owner[active]
        rank = (mix(e + _salt(2 * level + 1)) >> np.uint64(8)) | np.uint64(level << 56)
        pick = level + (mix(e + _salt(2 * level + 2)) >> np.uint64(32)).astype(np.int64) % (slots - level)
        if order is None:
            slot = pick
        else:  # the element's permutation: swap the picked place to the front
            each = np.arange(len(active))
            slot = order[each, pick].astype(np.int64)
            order[each, pick] = order[:, level]
            order[:, level] = slot
        at = d * slots + slot
        free = out[at] == _EMPTY
        np.minimum.at(out, at[free], rank[free])
        open_texts = (out.reshape(-1, slots) == _EMPTY).any(axis=1)
        stay = open_texts[d]
        if not stay.any():
            break
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8), (int(stay.sum()), 1))
            each, picked = np.arange(len(order)), pick[stay]
            order[each, picked] = 0
            order[:, 0] = picked
        else:
            order = order[stay]
        active = active[stay]
    return out.reshape(-1, slots)


def _nodes(s: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """128 bits that name a set of hashes, whatever their order."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    has = counts > 0
    name = np.zeros((len(counts), 2), np.uint64)
    for i in (0, 1):
        if has.any():
            name[has, i] = mix(np.add.reduceat(mix(s + _salt(i + 1)), first[has]) + counts[has].astype(np.uint64))
    raw = name.astype(">u8").tobytes()
    return [raw[16 * i: 16 * i + 16] if has[i] else None for i in range(len(counts))]


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, data, offsets in chunks(batch.column(1)):
        yield first, *shingles(*word_hashes(data, offsets), k)


def _profiles(p: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = p.bands * p.rows
        weights = mix(np.arange(1, slots + 1, dtype=np.uint64) * _salt(1)) | np.uint64(1)
        for batch in batches:
            for first, s, counts in _sets(batch, p.k):
                n = len(counts)
                sig = signatures(s, counts, slots)
                keys = mix((mix(sig) * weights).reshape(n, p.bands, p.rows).sum(axis=2, dtype=np.uint64) + np.arange(p.bands, dtype=np.uint64))
                some = counts > 0
                yield pa.record_batch({
                    "doc_id": batch.column(0).slice(first, n),
                    "n_shingles": pa.array(counts, pa.int64()),
                    "node": pa.array(_nodes(s, counts), pa.binary()),
                    "keys": pa.array([list(k) if ok else None for k, ok in zip(keys.view(np.int64), some)], pa.list_(pa.int64())),
                })

    return run


def _members(k: int):
    """node and its full set, for the documents of the candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, s, counts in _sets(batch, k):
                ends = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s.view(np.int64)))
                yield pa.record_batch({"node": pa.array(_nodes(s, counts), pa.binary()), "members": lists})

    return run


def unite(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Union-find over tables: merge the groups of ``labels(node, label)`` along ``links(a, b)``.

    Every round hooks each root to its smallest neighbouring root, shortens the paths by one jump and
    rewrites the links by the new roots; it ends when no link joins two groups.
    """
    by = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_root"))
    links = saved(links.join(by("a"), "a").join(by("b"), "b").filter("a_root <> b_root")
                  .select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "links")
    while links.head(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("up")).withColumn("up", F.least("root", "up"))
        hooks = saved(hooks, "hooks")
        jump = hooks.select(F.col("root").alias("up"), F.col("up").alias("higher"))
        hooks = saved(hooks.join(jump, "up", "left").select("root", F.coalesce("higher", "up").alias("up")).filter("root <> up"), "hooks")
        labels = saved(labels.join(hooks, labels.label == hooks.root, "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        for end in ("a", "b"):
            links = links.join(hooks.select(F.col("root").alias(end), F.col("up").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = saved(links.filter("a <> b").distinct(), "links")
    return labels


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("members").alias(f"of_{end}")), end)
    na, nb = F.size("of_a"), F.size("of_b")
    near = pairs.filter(100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return near.filter(100 * common >= percent * (na + nb - common)).select("a", "b")


def _block_links(percent: int, columns: int = 20_000):
    """Links between different groups inside one pair of blocks, enough to connect what is connected.

    All intersection sizes come from products of 0/1 matrices over the shingles that two members or more
    share, some columns at a time.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n, sets = len(rows), rows["members"].tolist()
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(n), size)
        value, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]
        common = np.zeros((n, n), np.float32)
        for start in range(0, int((times > 1).sum()), columns):
            part = (column >= start) & (column < start + columns)
            matrix = np.zeros((n, columns), np.float32)
            matrix[owner[part], column[part] - start] = 1
            common += matrix @ matrix.T
        name = {label: i for i, label in enumerate(dict.fromkeys(rows["label"]))}
        group = np.array([name[label] for label in rows["label"]])
        linked = (100 * common >= percent * (size[:, None] + size[None, :] - common)) & (group[:, None] < group[None, :])
        a, b = [], []
        for i, j in np.argwhere(linked):
            if group[i] != group[j]:
                a.append(rows["node"].iat[i])
                b.append(rows["node"].iat[j])
                group[group == group[j]] = group[i]
        return pd.DataFrame({"a": a, "b": b})

    return run


def near_groups(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs(doc_id, text)``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = saved(slim.mapInArrow(_profiles(p), "doc_id long, n_shingles long, node binary, keys array<long>"), "profile")
    filled = profile.filter("n_shingles > 0")
    # one row a node; equal sets have equal keys and signatures
    nodes = saved(filled.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "nodes")
    banded = nodes.select("node", "n", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = saved(banded.join(buckets, "key"), "shared")
    candidates = shared.select("node").distinct()
    labels = saved(candidates.withColumn("label", F.col("node")), "labels")
    ids = candidates.join(nodes.select("node", "first"), "node")
    mine = slim.join(ids.filter("first is not null").select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    sets = mine.unionByName(slim.filter("doc_id is null")).mapInArrow(_members(p.k), "node binary, members array<long>")
    sets = saved(sets.filter("node is not null").dropDuplicates(["node"]), "sets")
    for turn in range(p.pivot_rounds):
        open_ = shared if not turn else _unresolved(shared.filter("size > 2"), labels)
        open_ = open_ if turn else open_.withColumn("label", F.col("node"))
        order = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "label")
        pivots = open_.groupBy("key").agg(F.min(order).alias("pivot")).select("key", "pivot.node", "pivot.n", "pivot.label").toDF("key", "b", "nb", "b_label")
        pairs = open_.join(pivots, "key").filter("label <> b_label").filter(100 * F.least("n", "nb") >= p.percent * F.greatest("n", "nb"))
        labels = unite(labels, saved(_confirmed(pairs.select(F.col("node").alias("a"), "b").distinct(), sets, p.percent), "links"))
    rest = _unresolved(shared.filter("size > 2"), labels)
    # buckets of the same members are compared once
    same = rest.groupBy("key").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all"), F.count("*").alias("size"))
    rest = rest.drop("size").join(same.groupBy("all", "size").agg(F.min("key").alias("key")), "key")
    rest = rest.withColumn("blocks", F.ceil(F.col("size") / p.block).cast("int"))
    rest = rest.withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")).join(sets, "node")
    rest = rest.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", "node", "label", "members", F.least("own", "met").alias("lo"), F.greatest("own", "met").alias("hi"))
    links = rest.groupBy("key", "lo", "hi").applyInPandas(_block_links(p.percent), "a binary, b binary")
    labels = unite(labels, saved(links, "links"))
    named = labels.join(nodes.select("node", "first"), "node")
    names = named.join(named.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("node", "component_id")
    names = nodes.select("node", "first").join(names, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    out = filled.select("doc_id", "n_shingles", "node").join(names, "node").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(profile.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _unresolved(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their group, of the buckets that hold more than one group."""
    rows = shared.join(labels, "node")
    split = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    return rows.join(split, "key")


def drop_near_copies(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """The documents without all but the first of each group; rows without doc_id stay."""
    gone = near_groups(docs, p).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
