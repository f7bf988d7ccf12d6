"""K-d tree sharding with DataFrame operations only.

Every level finds, for all of its nodes at once, the widest metadata dimension (spread relative to the whole table)
and the exact weighted median along it: histograms of a 63-bit key are refined until the cut lies between two keys.
Dimensions are the text's size and CRC and the metadata columns in `dims`: numbers as they are, strings by their CRC.
The key is the dimension's value, then part of the text's CRC, then part of a hash of doc_id: copies of a text stay
together as far as a cut allows, if their metadata agree, and even one group of copies that holds most rows can be
cut. Only histograms (nodes x BINS rows) reach the driver. Each split halves the bytes to within one key, and nodes
are split until all are at the target bytes or below.

Defined results: a null text has size 1 and CRC 0; null dimensions sort lowest, and columns of `dims` that the table
lacks are left out; ties of the key stay on one side; repeated rows are all placed; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise, text_or_empty

BINS = 4096
VALUE_BITS, CRC_BITS, ID_BITS = 31, 16, 16
ROWS_PER_CHUNK = 4096


def _key(dim: str) -> Column:
    low = F.shiftrightunsigned(F.col("text_crc32"), 32 - CRC_BITS)
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 64 - ID_BITS)
    return F.shiftleft(F.col(dim), CRC_BITS + ID_BITS).bitwiseOR(F.shiftleft(low, ID_BITS)).bitwiseOR(tie)


def _node(cuts: dict[int, tuple[str, int]], level: int, n: int = 1) -> Column:
    """The node of a row at this level: the root is 1, the children of n are 2n and 2n+1."""
    if n.bit_length() > level:
        return F.lit(n)
    dim, cut = cuts[n]
    return F.when(F.col(f"k_{dim}") >= cut, _node(cuts, level, 2 * n + 1)).otherwise(_node(cuts, level, 2 * n))


def _medians(placed: DataFrame, nodes: dict[int, str]) -> dict[int, int]:
    """For each node the least key at or above which half of its bytes lie, by refining histograms."""
    first = min(nodes)
    chosen = F.coalesce(*[F.when(F.col("node").isin([n for n, d in nodes.items() if d == dim]), F.col(f"k_{dim}")) for dim in sorted(set(nodes.values()))])
    keyed = placed.select("size", (F.col("node") - first).alias("node"), chosen.alias("key"))
    low, below, total = [0] * len(nodes), [0] * len(nodes), {}
    width = 1 << (VALUE_BITS + CRC_BITS + ID_BITS)
    while width > 1:
        width = max(1, width // BINS)
        start = F.get(F.array(*[F.lit(x).cast("long") for x in low]), F.col("node"))
        inside = keyed.where(F.col("key") >= start).select("node", "size", F.call_function("div", F.col("key") - start, F.lit(width)).alias("bin"))
        hist = inside.where(F.col("bin") < BINS).groupBy("node", "bin").agg(F.sum("size").alias("w")).collect()
        for i in range(len(nodes)):
            bins = sorted((r["bin"], r["w"]) for r in hist if r["node"] == i)
            total.setdefault(i, sum(w for _, w in bins))
            at = bins[-1][0] if bins else 0
            for b, w in bins:
                if 2 * (below[i] + w) > total[i]:
                    at = b
                    break
                below[i] += w
            low[i] += at * width
    return {first + i: x for i, x in enumerate(low)}


def _dimension(docs: DataFrame, name: str) -> Column:
    """A metadata column as a number of VALUE_BITS."""
    c, top = F.col(f"`{name}`"), (1 << VALUE_BITS) - 1
    if dict(docs.dtypes)[name] == "string":
        return F.coalesce(F.shiftrightunsigned(F.crc32(c), 32 - VALUE_BITS), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(top), F.coalesce(c.cast("long"), F.lit(0))))


def kd_shards(docs: DataFrame, target_bytes: int | None = None, shards: int = 16, dims: tuple[str, ...] = ("lang", "n_chars"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Leaves of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    With target_bytes nodes are split until they hold no more; otherwise the target is a `shards`-th (a power of two)
    of all bytes.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    own = {f"d{i}": _dimension(docs, d) for i, d in enumerate(d for d in dims if d in docs.columns)}
    read = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text_or_empty(text_col)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty(text_col)).alias("text_crc32"),
        *[c.alias(k) for k, c in own.items()],
    ).withColumn("d_crc", F.shiftrightunsigned("text_crc32", 32 - VALUE_BITS))
    candidates = ["size", "d_crc", *own]
    rows = materialise(read.select("*", F.monotonically_increasing_id().alias("at"), *[_key(c).alias(f"k_{c}") for c in candidates]), "shard-rows")
    whole = rows.agg(F.sum("size")).first()[0] or 0
    depth = (shards - 1).bit_length() if target_bytes is None else max(0, -(-whole // max(1, target_bytes)) - 1).bit_length()
    cuts: dict[int, tuple[str, int]] = {}
    spread_all: dict[str, int] = {}
    for level in range(depth):
        placed = rows.withColumn("node", _node(cuts, level))
        spans = placed.groupBy("node").agg(*[(F.max(c) - F.min(c)).alias(c) for c in candidates]).collect()
        if level == 0 and spans:
            spread_all = {c: max(1, spans[0][c]) for c in candidates}
        widest = {1 << level | i: candidates[0] for i in range(1 << level)}
        widest |= {r["node"]: max(candidates, key=lambda c: (r[c] / spread_all[c], c)) for r in spans}
        medians = _medians(placed, widest)
        cuts |= {n: (widest[n], medians[n]) for n in widest}
    placed = rows.withColumn("shard", (_node(cuts, depth) - (1 << depth)).cast("int"))
    return _slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _slots(placed: DataFrame) -> DataFrame:
    """Gapless slots per shard: row numbers inside chunks of rows that were written side by side, plus the chunks' offsets."""
    chunked = placed.withColumn("chunk", F.call_function("div", F.col("at"), F.lit(ROWS_PER_CHUNK).cast("long")))
    numbered = chunked.withColumn("r", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("at")))
    sizes = chunked.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "chunk", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("skip"))
    return numbered.join(offsets, ["shard", "chunk"]).withColumn("slot", (F.col("skip") + F.col("r") - 1).cast("long"))
