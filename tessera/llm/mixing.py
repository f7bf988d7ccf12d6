"""Temperature mixing of sources.

A source's weight is its token share to the power alpha, normalised. Bisection finds alpha: the largest that reaches
a target entropy, or the smallest (flattest) under which no source repeats more than a limit. The budget defaults to
the least at which every source is read at least once, so no document is lost.

The weights become budgeted block permutations: in each epoch a source's documents are permuted by a seeded hash and
cut into blocks of about `block_tokens`; the last epoch of a source ends inside a block, at the document that would
pass its budget. Only per-source figures reach the driver; deciding documents is a narrow pass without a shuffle.

Defined results: a null source is a source of its own; a null or empty text has no tokens, and a source without
tokens is read once; repeated rows and ties share their fate; an empty table gives no rows; other columns, whatever
their names, pass through `mixed` unchanged. Its own are named _epoch, _block and _order, each with as many further
underscores in front as it takes to differ from the caller's (`added_names`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise, numbered, text_or_empty

MOST_SOURCES = 100_000
KEY_BITS = 30


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(tokens: list[int], alpha: float) -> list[float]:
    """Normalised weights: token shares to the power alpha."""
    total = sum(tokens)
    raw = [(t / total) ** alpha if t else 0.0 for t in tokens]
    return [x / sum(raw) for x in raw]


def solve(tokens: list[int], target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """alpha in [0, 1] by bisection. Entropy falls and repetition falls as alpha rises."""
    if not any(tokens):
        return 1.0
    if target_entropy is not None:
        holds = lambda a: entropy(tempered(tokens, a)) >= target_entropy
        good, bad = 0.0, 1.0
    else:
        def holds(a):
            reps = [w / t for w, t in zip(tempered(tokens, a), tokens) if t]
            return max(reps) / min(reps) <= max_repeats

        good, bad = 1.0, 0.0
    if holds(bad):
        return bad
    for _ in range(60):
        mid = (good + bad) / 2
        good, bad = (mid, bad) if holds(mid) else (good, mid)
    return good


def _key(epoch: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("long"), F.col("_h")), 64 - KEY_BITS)


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs under numbered names, which clash with none of the columns here, with _source and _h."""
    docs, (id_col, text_col, source_col) = numbered(docs, id_col, text_col, source_col)
    return docs.withColumn("_source", F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("\x00"))).withColumn("_h", F.xxhash64(F.col(f"`{id_col}`"), F.crc32(text_or_empty(text_col))))


def plan(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per source: weight, tokens, target_tokens, full epochs, blocks, and where its last epoch is cut."""
    spark = docs.sparkSession
    words = F.regexp_count(text_or_empty(numbered(docs, text_col)[1][0]), F.lit(r"\S+")).cast("long")
    rows = materialise(_keyed(docs, id_col, text_col, source_col).select("_source", "_h", words.alias("_n")), "mix-rows")
    stats = rows.groupBy("_source").agg(F.sum("_n").alias("t")).orderBy("_source").limit(MOST_SOURCES + 1).collect()
    if len(stats) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    tokens = [r["t"] for r in stats]
    weights = tempered(tokens, solve(tokens, target_entropy, max_repeats)) if any(tokens) else [0.0] * len(tokens)
    whole = budget if budget is not None else max([t / w for t, w in zip(tokens, weights) if t], default=0)
    made = []
    for r, w in zip(stats, weights):
        goal = round(w * whole)
        epochs = goal // r["t"] if r["t"] else 1
        made.append((r["_source"], w, r["t"], goal, int(epochs), int(goal - epochs * r["t"]), max(1, -(-r["t"] // block_tokens))))
    base = spark.createDataFrame(made, "_source string, weight double, tokens long, target_tokens long, epochs long, rest long, blocks long")
    last = rows.join(F.broadcast(base.where("rest > 0")), "_source").withColumn("k", _key(F.col("epochs"), seed)).withColumn("b", _block(F.col("k"), F.col("blocks")))
    sums = last.groupBy("_source", "b").agg(F.sum("_n").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("_source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    cut = sums.withColumn("upto", F.sum("n").over(upto)).where("upto > rest").groupBy("_source").agg(F.min(F.struct("b", (F.col("upto") - F.col("n")).alias("before"))).alias("c")).select("_source", "c.b", "c.before")
    inside = last.join(F.broadcast(cut), ["_source", "b"]).withColumn("run", F.col("before") + F.sum("_n").over(Window.partitionBy("_source", "b").orderBy("k", "_h").rowsBetween(Window.unboundedPreceding, 0)))
    ends = inside.groupBy("_source").agg(F.first("b").alias("cut_block"), F.max(F.when(F.col("run") <= F.col("rest"), F.struct("k", "_h"))).alias("e"))
    return materialise(base.join(ends, "_source", "left").select(*base.columns, "cut_block", F.col("e.k").alias("cut_key"), F.col("e._h").alias("cut_hash")), "mix-plan")


def added_names(docs: DataFrame) -> list[str]:
    """What `mixed` calls its own three columns beside those of docs."""
    held, out = {c.lower() for c in docs.columns}, []
    for name in ("_epoch", "_block", "_order"):
        while name in held:
            name = "_" + name
        out.append(name)
    return out


def _block(key: Column, blocks: Column) -> Column:
    return F.shiftrightunsigned(key * blocks, KEY_BITS)


def mixed(docs: DataFrame, plan_rows: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs once per epoch in which they are read, with _epoch, _block and _order (blocks in the order of _order)."""
    small = plan_rows.select("_source", F.col("epochs").alias("_full"), F.col("rest").alias("_rest"), F.col("blocks").alias("_blocks"), F.col("cut_block").alias("_cb"), F.col("cut_key").alias("_ck"), F.col("cut_hash").alias("_ch"))
    joined = _keyed(docs, id_col, text_col, source_col).join(F.broadcast(small), "_source")
    k = _key(F.col("_full"), seed)
    block = _block(k, F.col("_blocks"))
    before = F.struct(k, F.col("_h")) <= F.struct(F.col("_ck"), F.col("_ch"))
    extra = (F.col("_rest") > 0) & ((block < F.col("_cb")) | ((block == F.col("_cb")) & F.coalesce(F.col("_ck").isNotNull() & before, F.lit(False))))
    times = F.col("_full") + F.when(extra, 1).otherwise(0)
    each = joined.withColumn("_times", times).where("_times > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    each = each.withColumn("_block", _block(_key(F.col("_epoch"), seed), F.col("_blocks")))
    each = each.withColumn("_order", F.xxhash64(F.lit(seed + 1), "_source", "_epoch", "_block"))
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return each.select(*own, *[F.col(a).alias(b) for a, b in zip(("_epoch", "_block", "_order"), added_names(docs))])
