"""Benchmark decontamination with a distributed positional inverted index.

Indexing: documents are packed into shards of bounded text. A shard's row holds its term dictionary and, per term,
the delta-coded positions of all its occurrences. Shards are split by document, so the postings of a very common
word are spread over all shards and nothing is shuffled. The index is written to the shared folder.

Searching: test items become windows of `window` consecutive words (a shorter item is one window). For each shard the
windows whose words all occur in it start from the postings of their rarest word; each further word, from rare to
common, keeps the starts that its offset-adjusted postings contain. With slop > 0 a word may lie up to that many
places off its offset: a proximity match. Words compare by their bytes, in the shard's dictionary and in the block's.

Test items come in blocks of bounded size (about BLOCK_BYTES of text, by a hash of id and text), each collected,
broadcast and run over the index; an item may be spread over blocks.

Defined results: a null or empty text has no words; an item without words or with a null item_id is ignored; rows
that repeat an item_id add to that item; repeated documents each get their row; an empty table on either side gives
no matches; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ready_for_python
from .common import bounded_batches, lean, materialise, text_or_empty

SHARD_CHARS, PIECE, BLOCK_BYTES = 1 << 21, 1 << 22, 8 << 20
LOWER = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), dtype=np.uint8)
IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_FACTOR = 0x9E3779B97F4A7C15 | 1
_SPREAD = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: list = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd factor and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_FACTOR, -1, 1 << 64)
        steps = [np.full(n + 1, f, dtype=np.uint64) for f in (_FACTOR, inverse)]
        for s in steps:
            s[0] = 1
        _POWERS[:] = [np.cumprod(s, dtype=np.uint64) for s in steps]
    return _POWERS[0], _POWERS[1]


def _terms_of(low: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of lower-cased bytes: where each word starts, its term number, the distinct terms.

    Words are grouped by a hash and each is then compared with its group's first by its bytes; where two differ, the
    words are numbered by a dictionary of their bytes instead.
    """
    word = IS_WORD[low]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(len(low) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_SPREAD[low] * power[: len(low)], dtype=np.uint64)])
    key = (total[ends] - total[starts]) * inverse[starts]
    del total
    _, first, term = np.unique(key, return_index=True, return_inverse=True)
    term, flat = term.ravel(), low.tobytes()
    size = ends - starts
    origin = starts[first][term]
    same = bool((size == size[first][term]).all())
    if same and len(starts):
        shift = np.repeat(origin - starts, size)
        same = bool((low[word] == low[np.flatnonzero(word) + shift]).all())
    if same:
        return starts, term, [flat[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    known: dict[bytes, int] = {}
    term = np.array([known.setdefault(flat[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.int64)
    return starts, term, list(known)


def word_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of texts in a row: words per text, term number per word, occurrences per term, the terms.

    A long text is cut between words into pieces of about PIECE bytes, which bounds the memory that it takes.
    """
    raw = [t.encode() for t in texts]
    low = LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    ends_of_texts = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, dtype=np.int64)
    at, found, known = 0, [], {}
    while at < len(low):
        end = min(len(low), at + PIECE)
        while end < len(low) and IS_WORD[low[end]]:
            end += 1
        starts, term, terms = _terms_of(low[at:end])
        if at or end < len(low):
            own = np.array([known.setdefault(t, len(known)) for t in terms], dtype=np.int64)
            terms, term = known, own[term] if len(term) else term
        found.append((starts + at, term))
        at = end
    starts, term = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    upto = np.searchsorted(starts, ends_of_texts)
    per_text = np.diff(np.concatenate([[0], upto]))
    return per_text, term, np.bincount(term, minlength=len(terms)), list(terms)


def encode_gaps(values: np.ndarray) -> bytes:
    """Variable-length bytes, seven bits each, low bits first."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), dtype=np.int64)
    for k in range(1, 6):
        size += v >= np.uint64(1 << 7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(6):
        rows = size > k
        out[at[rows] + k] = ((v[rows] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(size[rows] > k + 1, 128, 0).astype(np.uint64)
    return out.tobytes()


def decode_gaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    last = raw < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = 0) -> DataFrame:
    """The written index: one row per shard. With key_bytes the ids are ASCII strings of that length, never null."""
    ready_for_python(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, keys = batch.text.tolist(), batch.doc_id if key_bytes else batch.doc_id.astype("Int64")
            for a, b in bounded_batches(texts, SHARD_CHARS):
                per_text, term, counts, terms = word_table(texts[a:b])
                order = np.argsort(term, kind="stable")
                gaps = np.diff(order, prepend=0)
                first = np.cumsum(counts) - counts
                gaps[first] = order[first]
                own = keys.iloc[a:b]
                held = "".join(own).encode() if key_bytes else own.fillna(0).to_numpy(np.int64).tobytes()
                yield pd.DataFrame({"shard": [part << 32 | seq], "doc_ids": [held], "nulls": [own.isna().to_numpy().tobytes()], "n_words": [per_text.astype("<u4").tobytes()], "terms": [b" ".join(terms)], "counts": [encode_gaps(counts)], "postings": [encode_gaps(gaps)]})
                seq += 1
        lean()

    read = docs.select(F.col(f"`{id_col}`").cast("string" if key_bytes else "long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return materialise(read.mapInPandas(run, "shard long, doc_ids binary, nulls binary, n_words binary, terms binary, counts binary, postings binary"), "index")


def windows_of(items: list[tuple[int, str]], window: int) -> dict:
    """The distinct windows of a block of items, as arrays."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple, set] = {}
    for item, text in items:
        per_text, term, _, terms = word_table([text or ""])
        own = [vocabulary.setdefault(t, len(vocabulary)) for t in terms]
        words = [own[t] for t in term.tolist()]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners.setdefault(tuple(words[i : i + window]), set()).add(item)
    width = max(map(len, owners), default=1)
    return {
        "vocabulary": vocabulary,
        "terms": np.array([list(w) + [-1] * (width - len(w)) for w in owners], dtype=np.int64).reshape(len(owners), width),
        "length": np.array([len(w) for w in owners], dtype=np.int64),
        "owner_ends": np.cumsum([len(o) for o in owners.values()]) if owners else np.zeros(0, dtype=np.int64),
        "owners": np.array([x for o in owners.values() for x in sorted(o)], dtype=np.int64),
    }


def occurrences(block: dict, terms: list[bytes], counts: np.ndarray, postings: np.ndarray, n_words: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all matches in a shard."""
    look = block["vocabulary"].get
    number = np.array([look(t, -1) for t in terms], dtype=np.int64)
    ends = np.cumsum(counts)
    held = np.flatnonzero(number >= 0)
    held = held[np.argsort(number[held])]
    size = np.zeros(len(block["vocabulary"]) + 1, dtype=np.int64)
    size[number[held]] = counts[held]
    lists = [postings[ends[t] - counts[t] : ends[t]] for t in held.tolist()]
    flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
    from_ = np.zeros(len(size), dtype=np.int64)
    from_[number[held]] = np.cumsum(counts[held]) - counts[held]
    span = int(n_words.sum()) + 64
    keys = np.repeat(number[held], counts[held]) * span + flat
    filled = np.where(block["terms"] >= 0, size[block["terms"]], np.iinfo(np.int64).max)
    alive = np.flatnonzero(filled.min(axis=1) > 0) if len(filled) else np.zeros(0, dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    if not len(alive):
        return none, none
    order = np.argsort(filled[alive], axis=1, kind="stable")
    rare = block["terms"][alive, order[:, 0]]
    many = size[rare]
    win = np.repeat(np.arange(len(alive)), many)
    start = flat[np.repeat(from_[rare], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)] - order[win, 0]
    if slop:
        win = np.repeat(win, 2 * slop + 1)
        start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
    length = block["length"][alive]
    doc_ends = np.cumsum(n_words)
    doc = np.searchsorted(doc_ends, start, "right")
    fits = (start >= 0) & (doc < len(doc_ends))
    fits[fits] = start[fits] + length[win[fits]] <= doc_ends[doc[fits]]
    win, start = win[fits], start[fits]
    for k in range(0 if slop else 1, order.shape[1]):
        place = order[win, k]
        word = block["terms"][alive[win], place]
        real = word >= 0
        low = np.searchsorted(keys, word * span + start + place - slop)
        top = np.searchsorted(keys, word * span + start + place + slop, "right")
        keep = ~real | (top > low)
        win, start = win[keep], start[keep]
    if slop and len(win):
        both = np.unique(np.stack([win, start]), axis=1)
        win, start = both[0], both[1]
    return alive[win], start


def search(index: DataFrame, items: DataFrame, window: int = 8, slop: int = 0, item_id: str = "item_id", item_text: str = "text", key_bytes: int = 0) -> DataFrame:
    """One row per document: doc_id, n_words, spans (word ranges inside matches, [start, end)), items (ascending, distinct)."""
    spark = index.sparkSession
    ready_for_python(spark)
    plain = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), text_or_empty(item_text).alias("text")).where("item_id is not null").distinct()
    blocks = max(1, -(-(plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    out, kind = None, "string" if key_bytes else "long"
    for b in range(blocks):
        some = [(r[0], r[1]) for r in plain.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(windows_of(some, window))
        found = index.mapInPandas(lambda batches, s=shared: _search_shards(batches, s.value, slop, key_bytes), f"shard long, row int, doc_id {kind}, n_words long, spans array<struct<s:int,e:int>>, items array<bigint>")
        out = found if out is None else out.unionByName(found)
    if blocks > 1:
        out = out.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return out.select("doc_id", "n_words", F.array_sort("spans").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def _search_shards(batches: Iterator[pd.DataFrame], block: dict, slop: int, key_bytes: int = 0) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for s in batch.itertuples():
            n_words = np.frombuffer(s.n_words, "<u4").astype(np.int64)
            counts = decode_gaps(s.counts)
            gaps = decode_gaps(s.postings)
            first = np.cumsum(counts) - counts
            total = np.cumsum(gaps)
            postings = total - np.repeat(total[first] - gaps[first], counts) if len(counts) else total
            win, start = occurrences(block, s.terms.split(b" ") if s.terms else [], counts, postings, n_words, slop)
            docs = len(n_words)
            spans: list = [[] for _ in range(docs)]
            items: list = [[] for _ in range(docs)]
            if len(win):
                ends = np.cumsum(n_words)
                mark = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
                np.add.at(mark, start, 1)
                np.add.at(mark, start + block["length"][win], -1)
                hit = np.cumsum(mark[:-1]) > 0
                cut = np.zeros(len(hit) + 1, dtype=bool)
                cut[ends[:-1]] = True
                cut[0] = True
                begins = np.flatnonzero(hit & (cut[:-1] | ~np.concatenate([[False], hit[:-1]])))
                finishes = np.flatnonzero(hit & np.append(cut[1:-1] | ~hit[1:], True)) + 1
                owner = np.searchsorted(ends, begins, "right")
                for d, a, b in zip(owner.tolist(), begins.tolist(), finishes.tolist()):
                    off = int(ends[d] - n_words[d])
                    spans[d].append({"s": a - off, "e": b - off})
                doc = np.searchsorted(ends, start, "right")
                many = np.diff(np.concatenate([[0], block["owner_ends"]]))[win]
                at = np.repeat(block["owner_ends"][win] - many, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                for d, item in np.unique(np.stack([np.repeat(doc, many), block["owners"][at]]), axis=1).T.tolist():
                    items[d].append(item)
            if key_bytes:
                ids = np.frombuffer(s.doc_ids, f"S{key_bytes}").astype(str)
            else:
                ids = pd.array(np.frombuffer(s.doc_ids, np.int64), dtype="Int64")
                ids[np.frombuffer(s.nulls, bool)] = pd.NA
            yield pd.DataFrame({"shard": s.shard, "row": np.arange(docs), "doc_id": ids, "n_words": n_words, "spans": spans, "items": items})
    lean()


def n_hit(spans: Column) -> Column:
    """Words covered by sorted spans that may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], x["e"]).alias("upto"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 8, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return judged(search(build_index(docs, id_col, text_col), items, window), least_items)


def judged(found: DataFrame, least_items: int = 2) -> DataFrame:
    """The figures of searched documents."""
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select("doc_id", "n_words", n_hit(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.size("items") >= least_items).alias("contaminated"))
