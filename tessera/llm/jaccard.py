"""Exact self-join of texts by the Jaccard similarity of their word shingles, for thresholds of four fifths.

Texts are cut as in `simhash`; a text of fewer words than a shingle makes one shingle, and one without words has the
empty set, which joins nothing here. Equal sets are one node (a 64-bit hash of the set).

1. the shingles of all rows are counted by bucket of their hash; shingles are ordered by their bucket's count, then by
   hash. Any fixed order keeps the join exact, this one keeps common lines out of the prefixes;
2. of two sets with similarity 0.8 or more the first n // 5 + 1 shingles (n the set's size) share one; pairs that meet
   there are filtered by size and position, then by their parity sketches: one bit per hash bucket says whether the
   set holds an odd number of shingles there. Bits that differ bound the symmetric difference from below, so a pair
   that fails this cannot be similar, and almost only similar pairs are left to verify on the whole sets;
3. buckets of more than `hot` nodes lose the entries that no set of the bucket can follow far enough, and the others are
   compared with one central pivot each. Members similar to it are linked through it, the others go on to the next
   round. What then isn't connected is paired off, where sizes, positions and the distances to the pivot (which differ
   by 0.2 at most, the triangle inequality) allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ready_for_python
from .common import LOWER, PIECE, discard, lean, materialise
from .components import components

YIELD_ROWS = 128
#: Buckets in which shingles are counted, sent in blocks; rare shingles that share one only change places in the order.
COUNTED, BLOCK = 1 << 20, 1 << 12
#: Rows of a broadcast that narrows the second pass over the texts: a proven bound, whatever the corpus.
SLOTS = 1 << 18
_SPREAD = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, as signed longs. Words of a long text are hashed in pieces."""
    from xxhash import xxh64_intdigest

    raw, at, parts = (text or "").encode().translate(LOWER), 0, []
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and raw[end] not in b" \t\n\x0b\f\r":
            end += 1
        words = raw[at:end].split()
        parts.append(np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words)))
        at = end
    hashed = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    if not len(hashed):
        return np.zeros(0, dtype=np.int64)
    width = min(shingle, len(hashed))
    n = len(hashed) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        total += hashed[k : k + n] * _SPREAD[k]
    return np.unique(total.view(np.int64))


def node_of(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(s.tobytes(), 7)).astype(np.int64))


def sketch_of(s: np.ndarray) -> np.ndarray:
    """Parities of a power of two of buckets, at least one per shingle and 64 in all, as longs."""
    buckets = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount(s & (buckets - 1), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def bucket_of(s: np.ndarray) -> np.ndarray:
    """By the upper bits: sketches take the lower ones."""
    return (s.view(np.uint64) >> np.uint64(64 - (COUNTED - 1).bit_length())).astype(np.int64)


def prefix_of(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set's first n // 5 + 1 shingles in the common order."""
    return s[np.argsort(counts[bucket_of(s)], kind="stable")[: len(s) // 5 + 1]]


def frequency(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many rows' shingles fall into each bucket, over all rows. texts: (key, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(COUNTED, dtype=np.int64)
        for b in batches:
            for at in range(0, len(b), YIELD_ROWS):
                for t in b.text[at : at + YIELD_ROWS]:
                    np.add.at(held, bucket_of(shingle_set(t, shingle)), 1)
        yield from blocks(dict(enumerate(held.reshape(-1, BLOCK))))
        lean()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for i, raw in zip(b.block, b.counts):
                held[i] = held.get(i, 0) + np.frombuffer(raw, dtype=np.int64)
        yield from blocks(held)

    def blocks(held: dict) -> Iterator[pd.DataFrame]:
        some = [(i, x.tobytes()) for i, x in held.items() if x.any()]
        yield pd.DataFrame({"block": [i for i, _ in some], "counts": [x for _, x in some]})

    ready_for_python(texts.sparkSession)
    kind, parts = "block int, counts binary", 8
    got = texts.select("text").mapInPandas(run, kind).repartition(parts, "block").mapInPandas(add, kind).collect()
    out = np.zeros((COUNTED // BLOCK, BLOCK), dtype=np.int64)
    for r in got:
        out[r["block"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return out.ravel()


def node_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(key, node, n, prefix): each row's node, its set's size and its first n // 5 + 1 shingles."""
    shared = texts.sparkSession.sparkContext.broadcast(frequency(texts, shingle))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        for b in batches:
            for at in range(0, len(b), YIELD_ROWS):
                part = b.iloc[at : at + YIELD_ROWS]
                sets = [shingle_set(t, shingle) for t in part.text]
                yield pd.DataFrame({"key": part.key.to_numpy(), **set_columns(sets, counts)})
        lean()

    ready_for_python(texts.sparkSession)
    return texts.mapInPandas(run, f"key string, {SET_COLUMNS}").drop("sketch")


SET_COLUMNS = "node long, n int, prefix array<bigint>, sketch array<bigint>"


def set_columns(sets: list[np.ndarray], counts: np.ndarray) -> dict:
    return {"node": [node_of(s) for s in sets], "n": [len(s) for s in sets], "prefix": [prefix_of(s, counts) for s in sets], "sketch": [sketch_of(s) for s in sets]}


def _whole_sets(texts: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """(node, whole) of the rows with these keys; only rows whose slot is asked for are shuffled."""
    slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), YIELD_ROWS):
                sets = [shingle_set(t, shingle) for t in b.text[at : at + YIELD_ROWS]]
                yield pd.DataFrame({"node": [node_of(s) for s in sets], "whole": sets})
        lean()

    asked = F.broadcast(keys.select(slot.alias("slot")).distinct())
    some = texts.withColumn("slot", slot).join(asked, "slot", "left_semi").select("key", "text")
    return some.join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).mapInPandas(run, "node long, whole array<bigint>").dropDuplicates(["node"])


def _compared(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b, common, total): sizes of the intersection and of the union."""
    both = pairs.join(whole.select(F.col("node").alias("a"), F.col("whole").alias("wa")), "a").join(whole.select(F.col("node").alias("b"), F.col("whole").alias("wb")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("wa", "wb")).alias("common"), (F.size("wa") + F.size("wb")).alias("sum"))
    return common.select("a", "b", "common", (F.col("sum") - F.col("common")).alias("total"))


def _folded(wide: Column, narrow: Column) -> Column:
    """The sketch at half its width where it is wider than the other: similar sets are at most one step apart."""
    half = F.greatest(F.lit(1), F.shiftright(F.size(wide), 1))
    return F.when(F.size(wide) > F.size(narrow), F.zip_with(F.slice(wide, F.lit(1), half), F.slice(wide, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(wide)


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose parities leave a similarity of 0.8 possible: at most a ninth of both sizes may differ."""
    if "sketch" not in nodes.columns:
        return pairs
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    x, y = F.col("s_a"), F.col("s_b")
    off = F.aggregate(F.zip_with(_folded(x, y), _folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, k: t + k)
    return both.where(9 * off <= F.col("n_a") + F.col("n_b")).select("a", "b")


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Joined entries x, y of one bucket that size and position allow: no more can follow a pair's first match."""
    x = left.select("s", *[F.col(c).alias(f"x_{c}") for c in left.columns if c != "s"])
    y = right.select("s", *[F.col(c).alias(f"y_{c}") for c in right.columns if c != "s"])
    rest = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    fits = (F.lit(5) * F.least("x_n", "y_n") >= F.lit(4) * F.greatest("x_n", "y_n")) & (F.lit(9) * rest >= F.lit(4) * (F.col("x_n") + F.col("y_n")))
    return x.join(y, "s").where(fits)


def _useful(entries: DataFrame) -> DataFrame:
    """Entries that some set of their bucket could still follow: none is smaller than the bucket's smallest."""
    least = entries.groupBy("s").agg(F.min("n").alias("_m"))
    rest, other = F.col("n") - F.col("pos"), F.greatest(F.col("_m"), F.ceil(F.col("n") * 4 / 5))
    return entries.join(least, "s").where(F.lit(9) * rest >= F.lit(4) * (F.col("n") + other)).drop("_m")


def _apart(left: DataFrame, right: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of one bucket whose members aren't connected yet, by size, position and, where known, distance to a pivot."""
    named = lambda e: e.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    same = left is right
    met = _met(named(left), named(right)).where("x_root <> y_root")
    if "d" in left.columns:
        met = met.where(F.abs(F.col("x_d") - F.col("y_d")) <= 0.2 + 1e-9)
    return _ordered(met.where("x_node < y_node") if same else met)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))


def links(texts: DataFrame, sets: DataFrame, shingle: int, hot: int = 128) -> DataFrame:
    """Edges (a, b) of nodes with similarity 0.8 or more, with the same components as all such pairs.

    texts: (key, text); sets: their keys and SET_COLUMNS, written. Without sketches every pair is verified in full.
    """
    own = [c for c in ("n", "prefix", "sketch") if c in sets.columns]
    nodes = materialise(sets.where("n > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in own]), "jac-nodes")
    several = materialise(nodes.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "jac-several")
    shared = materialise(nodes.select("node", "n", F.posexplode("prefix").alias("pos", "s")).join(several, "s"), "jac-shared")
    discard(several)
    cold = shared.where(F.col("k") <= hot).select("s", "node", "n", "pos")
    met = materialise(_ordered(_met(cold, cold).where("x_node < y_node")).distinct(), "jac-cold")
    pairs = materialise(_plausible(met, nodes), "jac-plausible")
    # only sets that will be compared are made whole again
    asked = shared.where(F.col("k") > hot).select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    keys = materialise(sets.join(asked, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")).select("key"), "jac-keys")
    whole = materialise(_whole_sets(texts, keys, shingle), "jac-whole")
    edges, rounds = None, []
    alive = materialise(_useful(shared.where(F.col("k") > hot).select("s", "node", "n", "pos")), "jac-hot")
    held = alive.count()
    while held:
        # the member with the fewest rarer shingles in front is the most central one
        pivots = materialise(alive.groupBy("s").agg(F.min_by("node", F.struct("pos", "node")).alias("pivot"), F.count(F.lit(1)).alias("k")), "jac-pivots")
        few = alive.join(pivots.where(F.col("k") <= hot).select("s"), "s", "left_semi")
        rounds.append((few, few))
        many = alive.join(pivots.where(F.col("k") > hot).select("s", "pivot"), "s").where("node <> pivot")
        judged = materialise(_compared(many.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), whole), "jac-pivoted")
        found = judged.where("5 * common >= 4 * total").select("a", "b")
        edges = found if edges is None else edges.unionByName(found)
        far = judged.select(F.col("a").alias("node"), F.col("b").alias("pivot"), (1 - F.col("common") / F.col("total")).alias("d"), (F.col("common") * 5 >= F.col("total") * 4).alias("near"))
        placed = materialise(many.join(far, ["node", "pivot"]), "jac-placed")
        near, off = placed.where("near").drop("near", "pivot"), placed.where("not near").drop("near", "pivot")
        rounds.append((near, off))
        alive, before = materialise(_useful(off.select("s", "node", "n", "pos")), "jac-off"), held
        held = alive.count()
        if 2 * held > before:
            rounds.append((alive, alive))
            held = 0
    if edges is not None:
        # what is connected by now needs no more links: only members of different components still meet
        roots = materialise(components(edges), "jac-roots")
        later = None
        for left, right in rounds:
            some = _apart(left, right, roots)
            later = some if later is None else later.unionByName(some)
        pairs = pairs.unionByName(_plausible(later.distinct(), nodes))
    verified = _compared(materialise(pairs.distinct(), "jac-pairs"), whole).where("5 * common >= 4 * total").select("a", "b")
    return verified if edges is None else verified.unionByName(edges)
