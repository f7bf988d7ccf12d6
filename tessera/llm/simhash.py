"""SimHash near-dedup by the generalised pigeonhole principle.

Texts are lower-cased (A-Z), cut into words at ASCII white space and into shingles; each shingle's XXH64 (seed 42)
votes on 64 bits. Distinct fingerprints then link at a Hamming distance of at most `distance`:

1. bits that correlate go to the same part (greedy, on the bit covariance over all distinct fingerprints);
2. per fingerprint, dynamic programming deals thresholds t_i >= -1 with sum(t_i) = distance - parts + 1 to the parts
   so that the estimated number of candidates is least. Estimates come from histograms of half parts over all
   fingerprints. Any two fingerprints within the distance agree within t_i in some part;
3. each fingerprint probes the parts' buckets within its thresholds, and the full distance is verified;
4. buckets of more than `hot` members are linked without pairs: two fingerprints differ in at most two bits exactly
   if they share a value one bit or less away from both, so each member joins the least member of its 65 such values;
5. links become components by star contraction. Copies meet in one fingerprint before any of this.

Without a distance, texts also link by the similarity of their shingles (see `near_duplicates` and `jaccard`).

Defined results: a null, empty or blank text has fingerprint zero and links like any other; fewer words than a
shingle make one shingle; repeated rows share a component; a null doc_id is never a component id unless its whole
component is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ready_for_python
from . import jaccard
from .common import LOWER, PIECE, drop_paths, lean, materialise, text_or_empty, watched
from .components import components

BITS = 64


def _votes(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned fingerprint; a long text is taken in pieces that overlap by shingle - 1 words."""
    from xxhash import xxh64_intdigest

    raw = (text or "").encode().translate(LOWER)
    votes, n, carry, at = np.zeros(BITS, dtype=np.int64), 0, [], 0
    whole: list[bytes] = []
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and raw[end] not in b" \t\n\x0b\f\r":
            end += 1
        words = carry + raw[at:end].split()
        at = end
        if len(words) >= shingle:
            hashes = [xxh64_intdigest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(shingle)))]
            votes += _votes(hashes)
            n += len(hashes)
        carry = words[max(0, len(words) - shingle + 1) :]
        whole = words if n == 0 else []
    if n == 0 and whole:
        votes, n = _votes([xxh64_intdigest(b" ".join(whole), 42)]), 1
    return int(sum(1 << i for i in np.flatnonzero(2 * votes > n).tolist())) if n else 0


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64-bit)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.text], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch.doc_id, "fp": fps})
        lean()

    ready_for_python(docs.sparkSession)
    kind = docs.select(F.col(f"`{id_col}`").alias("doc_id")).schema[0].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInPandas(run, f"doc_id {kind}, fp long")


def _bits(fps: pd.Series) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps.to_numpy(np.int64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(df: DataFrame, run, keys: str) -> pd.DataFrame:
    """Count rows per key: counted in each task, then summed; the keys are a bounded set."""
    names = [k.split()[0] for k in keys.split(", ")]
    return df.mapInPandas(run, f"{keys}, n long").groupBy(*names).agg(F.sum("n").alias("n")).toPandas()


def group_bits(distinct: DataFrame, parts: int) -> list[list[int]]:
    """Deal the 64 bits to parts of near equal width so that strongly correlated bits share a part."""

    def run(batches):
        both, n = np.zeros((BITS, BITS), dtype=np.int64), 0
        for batch in batches:
            b = _bits(batch.fp).astype(np.float64)
            both += (b.T @ b).astype(np.int64)
            n += len(b)
        yield pd.DataFrame({"pos": np.arange(BITS * BITS + 1), "n": np.append(both.ravel(), n)})

    got = _summed(distinct, run, "pos int").sort_values("pos").n.to_numpy(dtype=np.float64)
    if not len(got) or got[-1] == 0:
        return [list(range(BITS))[i::parts] for i in range(parts)]
    p = got[:-1].reshape(BITS, BITS) / got[-1]
    one = np.diag(p)
    sd = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    corr = np.abs((p - np.outer(one, one)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        part = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < width:
            best = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def _values(bits: np.ndarray, where: list[int]) -> np.ndarray:
    return bits[:, where].astype(np.int64) @ (1 << np.arange(len(where), dtype=np.int64))


def _ball_counts(distinct: DataFrame, parts: list[list[int]]) -> tuple[list, int]:
    """Per part and half: how many fingerprints lie at distance 0, 1, 2 of each value of that half."""
    halves = [(p[: len(p) // 2], p[len(p) // 2 :]) for p in parts]

    def run(batches):
        hist = [[np.zeros(1 << len(h), dtype=np.int64) for h in two] for two in halves]
        for batch in batches:
            bits = _bits(batch.fp)
            for i, two in enumerate(halves):
                for j, h in enumerate(two):
                    hist[i][j] += np.bincount(_values(bits, h), minlength=1 << len(h))
        for i, two in enumerate(hist):
            for j, x in enumerate(two):
                v = np.flatnonzero(x)
                yield pd.DataFrame({"part": i, "half": j, "value": v, "n": x[v]})

    got = _summed(distinct, run, "part int, half int, value int")
    total = int(got[(got.part == 0) & (got.half == 0)].n.sum()) if len(got) else 0
    out = []
    for i, two in enumerate(halves):
        row = []
        for j, h in enumerate(two):
            mine = got[(got.part == i) & (got.half == j)]
            flat = np.zeros(1 << len(h))
            flat[mine.value.to_numpy(dtype=np.int64)] = mine.n.to_numpy(dtype=np.float64)
            at = np.arange(1 << len(h))
            one = sum((flat[at ^ (1 << b)] for b in range(len(h))), np.zeros_like(flat))
            two_off = sum((flat[at ^ (1 << b) ^ (1 << c)] for b in range(len(h)) for c in range(b)), np.zeros_like(flat))
            row.append(np.stack([flat, one, two_off]) / max(1, total))
        out.append(row)
    return out, total


def allocate(bits: np.ndarray, parts: list[list[int]], balls: list, total: int, distance: int) -> np.ndarray:
    """Thresholds per fingerprint and part: the cheapest deal, by dynamic programming over the parts."""
    budget, rows = distance - len(parts) + 1, len(bits)
    best = {0: (np.zeros(rows), np.zeros((rows, 0), dtype=np.int64))}
    for i, p in enumerate(parts):
        a, b = balls[i]
        x, y = a[:, _values(bits, p[: len(p) // 2])], b[:, _values(bits, p[len(p) // 2 :])]
        shells = [x[0] * y[0], x[1] * y[0] + x[0] * y[1], x[2] * y[0] + x[1] * y[1] + x[0] * y[2]]
        price = {-1: np.zeros(rows)}
        for t in range(min(2, distance) + 1):
            probes = sum([1, len(p), len(p) * (len(p) - 1) // 2][: t + 1])
            price[t] = total * sum(shells[: t + 1]) + probes
        after: dict = {}
        for spent, (cost, dealt) in best.items():
            for t, extra in price.items():
                c, d = cost + extra, np.hstack([dealt, np.full((rows, 1), t)])
                if spent + t in after:
                    c0, d0 = after[spent + t]
                    better = c < c0
                    after[spent + t] = (np.where(better, c, c0), np.where(better[:, None], d, d0))
                else:
                    after[spent + t] = (c, d)
        best = after
    return best[budget][1]


def _probes(distinct: DataFrame, parts: list[list[int]], balls: list, total: int, distance: int) -> DataFrame:
    """(part, sig, fp, own): the fingerprint's own bucket in every part (own), and the buckets that it probes."""
    masks = [np.array([0] + [1 << b for b in range(len(p))] + [1 << b | 1 << c for b in range(len(p)) for c in range(b)], dtype=np.int64) for p in parts]

    def run(batches):
        for batch in batches:
            bits = _bits(batch.fp)
            dealt = allocate(bits, parts, balls, total, distance)
            fps = batch.fp.to_numpy(np.int64)
            for i, p in enumerate(parts):
                own = _values(bits, p)
                yield pd.DataFrame({"part": i, "sig": own, "fp": fps, "own": True})
                for t in range(distance + 1):
                    mine = np.flatnonzero(dealt[:, i] == t)
                    near = masks[i][: sum([1, len(p), len(p) * (len(p) - 1) // 2][: t + 1])]
                    if len(mine):
                        yield pd.DataFrame({"part": i, "sig": (own[mine][:, None] ^ near).ravel(), "fp": np.repeat(fps[mine], len(near)), "own": False})

    return distinct.mapInPandas(run, "part int, sig long, fp long, own boolean")


def links(distinct: DataFrame, distance: int = 2, parts: int = 3, hot: int = 128) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints within the distance, without all pairs of hot buckets."""
    if not 0 <= distance <= 2 or not 2 <= parts <= distance + 2:
        raise ValueError("distance must be 0 to 2, and parts 2 to distance + 2")
    grouped = group_bits(distinct, parts)
    balls, total = _ball_counts(distinct, grouped)
    probes = materialise(_probes(distinct, grouped, balls, total, distance), "sim-probes")
    crowded = materialise(probes.where("own").groupBy("part", "sig").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot).select("part", "sig"), "sim-hot")
    cold = probes.join(crowded, ["part", "sig"], "left_anti")
    found = cold.where("not own").select("part", "sig", F.col("fp").alias("a")).join(cold.where("own").select("part", "sig", F.col("fp").alias("b")), ["part", "sig"])
    near = found.where(F.col("a") < F.col("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    if distance == 0:
        return near
    return near.unionByName(_neighbour_links(probes.join(crowded, ["part", "sig"], "left_semi"), distance))


def _neighbour_links(crowd: DataFrame, distance: int) -> DataFrame:
    """Links of the members of hot buckets through shared values one bit or less away (distance 2), or one bit away (1)."""
    members = crowd.select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)])
    values = members.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), (F.col("flip") == 0).alias("self"))
    if distance == 1:
        return values.where("not self").join(members.select(F.col("fp").alias("value")), "value", "left_semi").select(F.col("fp").alias("a"), F.col("value").alias("b"))
    least = values.groupBy("value").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("value", "b")
    return values.join(least, "value").where("fp <> b").select(F.col("fp").alias("a"), "b")


def _classes(fps: DataFrame, distance: int, parts: int, hot: int) -> DataFrame:
    """(fp, component_id) by fingerprints alone."""
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "sim-distinct")
    found = components(links(distinct.select("fp"), distance, parts, hot))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id")


def _marked(docs: DataFrame, words: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document from one pass over the texts: doc_id, the text's MD5, fingerprint, and `jaccard.SET_COLUMNS`."""
    ready_for_python(docs.sparkSession)
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("key", F.md5("text"))
    common = docs.sparkSession.sparkContext.broadcast(jaccard.frequency(read.select("key", "text"), shingle))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = common.value
        for batch in batches:
            for at in range(0, len(batch), jaccard.YIELD_ROWS):
                part = batch.iloc[at : at + jaccard.YIELD_ROWS]
                fps = np.array([fingerprint(t, words) for t in part.text], dtype=np.uint64).view(np.int64)
                sets = [jaccard.shingle_set(t, shingle) for t in part.text]
                yield pd.DataFrame({"doc_id": part.doc_id.to_numpy(), "key": part.key.to_numpy(), "fp": fps, **jaccard.set_columns(sets, counts)})
        lean()

    kind = read.schema[0].dataType.simpleString()
    return read.mapInPandas(run, f"doc_id {kind}, key string, fp long, {jaccard.SET_COLUMNS}")


def near_duplicates(docs: DataFrame, shingle: int | None = None, distance: int | None = None, parts: int = 3, hot: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    With a distance, documents link where their fingerprints (of three words a shingle by default) differ in so many
    bits at most. Without one they link where their fingerprints of three words differ in two bits at most, or where
    the Jaccard similarity of their shingles (five words by default) is 0.8 or more, by the exact join of `jaccard`.
    """
    spark = docs.sparkSession
    out = ("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    if distance is not None:
        rows = materialise(fingerprints(docs, shingle or 3, id_col, text_col), "sim-fps")
        with watched() as used:
            classes = materialise(_classes(rows, distance, parts, hot), "sim-classes")
        drop_paths(spark, used[:-1])
        return rows.join(classes, "fp").select(*out)
    marked = materialise(_marked(docs, 3, shingle or 5, id_col, text_col), "sim-marked")
    texts = docs.select(text_or_empty(text_col).alias("text")).withColumn("key", F.md5("text"))
    with watched() as used:
        # a document ties its fingerprint (tagged, so that the two kinds of node stay apart) to its set of shingles
        tag = lambda c: F.xxhash64(F.lit("fingerprint"), F.col(c)).alias(c)
        same_print = links(marked.select("fp").distinct(), 2, parts, hot).select(tag("a"), tag("b"))
        same_set = jaccard.links(texts, marked.select("key", "node", "n", "prefix", "sketch"), shingle or 5, hot)
        ties = marked.select(F.xxhash64(F.lit("fingerprint"), F.col("fp")).alias("a"), F.col("node").alias("b")).distinct()
        roots = components(ties.unionByName(same_print).unionByName(same_set))
        least = marked.groupBy("node").agg(F.min("doc_id").alias("least"))
        named = least.join(roots, "node").groupBy("root").agg(F.min("least").alias("component_id"))
        classes = materialise(roots.join(named, "root").select("node", "component_id"), "sim-classes")
    drop_paths(spark, used[:-1])
    return marked.select("doc_id", "fp", "node").join(classes, "node").select(*out)
