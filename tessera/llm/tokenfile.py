"""Token ids in Simple-8b files.

A file image holds whole documents in ascending doc_id order:

    magic "TSB8", then little-endian u32 documents, u64 ids, u64 words, u32 blocks
    i64 doc_id and u8 null flag per document, u32 ids per document
    u64 word offset per block of BLOCK ids, then the 64-bit words

The top four bits of a word select how many ids of which width its lower 60 bits hold; an id too wide for any other
selector escapes into a word of its own. Each block starts a new word, so any block decodes by itself.

Images are rows (part, seq, image) of a Parquet table in the shared folder: Spark's writer commits them whichever
executors are lost. `export` copies them out as plain files.

Defined results: a null text is empty and gets the end id only; a null doc_id sorts first; equal doc_ids sort by the
text's hash; repeated rows are all written; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..shipping import ready_for_python
from .common import LOWER, lean, materialise

MAGIC, BLOCK, IDS_PER_IMAGE = b"TSB8", 8192, 1 << 20
#: Fixed values of the format: (ids, bits) of a word by selector; the last is the escape.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([c for c, _ in SELECTORS])
#: The longest word that is remembered, and about what an entry takes beside its bytes.
LONGEST, ENTRY = 64, 170
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The byte-level alphabet by its rule: printable bytes stand for themselves, the others follow from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}
#: Pieces that are merged together and have a slot in a table: at most so many bytes; and about what a slot takes.
SHORT, SLOT = 16, 37
#: The bytes of texts that are cut into pieces at once; they take about 100 times as much while it lasts.
TOGETHER = 1 << 18
HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Kinds of bytes; those from 128 on are looked at in pairs.
BLANK, LETTER, DIGIT, MARK, ODD = range(5)
BLANKS = [bytes([b]) for b in b" \t\n\x0b\f\r"]
KINDS = bytes(BLANK if bytes([b]) in BLANKS else LETTER if bytes([b]).isalpha() else DIGIT if bytes([b]).isdigit() else MARK if b in PUNCTUATION else ODD for b in range(256))
#: The lower case of letters from U+0080 to U+024F that has as many bytes; 0 for all other characters.
NARROW = np.array([ord(low) if i > 127 and (c := chr(i)).isalpha() and len(low := c.lower()) == 1 and "\x7f" < low <= "\u024f" else 0 for i in range(0x280)], dtype=np.uint16)
NARROW[0x250:] = 0
_ENCODERS: dict = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder, with the words that it has seen in earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _ends_token(stem: bytes) -> bool:
    """Whether the pre-tokenizer always cuts between this stem and punctuation behind it."""
    if stem[-1] < 128:
        return stem[-1:].isalnum()
    last = stem[-2:].decode(errors="ignore")[-1:]
    return last.isalpha() and last <= "\u024f" and len(last.lower()) == 1


def _widths(ids: np.ndarray) -> np.ndarray:
    if len(ids) and int(ids.max()) >> 60:
        raise ValueError("an id needs more than 60 bits")
    small = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
    small[0] = 1
    wide = ids >= 1 << 16
    out = small[np.where(wide, 0, ids)]
    if wide.any():
        out[wide] = [int(x).bit_length() for x in ids[wide]]
    return out


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of one block of ids."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    level = np.concatenate([_widths(ids), np.zeros(64, dtype=np.uint8)])
    most = {1: level}
    for k in (2, 4, 8, 16, 32):
        half = most[k // 2]
        most[k] = np.maximum(half[: -k // 2], half[k // 2 :])
    choice = np.full(n, len(SELECTORS) - 1, dtype=np.uint8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[s]
        k = 1 << (count.bit_length() - 1)
        top = np.maximum(most[k][:n], most[k][count - k : count - k + n])
        choice[top <= bits] = s
    step, starts, i = COUNTS[choice].tolist(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    at = np.array(starts)
    chosen = choice[at]
    padded = np.concatenate([ids, np.zeros(64, dtype=np.uint64)])
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        count, bits = SELECTORS[s]
        rows = np.flatnonzero(chosen == s)
        part = padded[at[rows][:, None] + np.arange(count)]
        words[rows] |= np.bitwise_or.reduce(part << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of the words of one block."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for s in np.unique(chosen):
        count, bits = SELECTORS[s]
        rows = np.flatnonzero(chosen == s)
        part = (words[rows][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
        out[(ends[rows] - counts[rows])[:, None] + np.arange(count)] = part
    return out[:n]


def build_image(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    blocks = [pack(ids[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]
    sizes = np.array([len(b) for b in blocks], dtype=np.uint64)
    words = np.concatenate(blocks) if blocks else np.zeros(0, dtype=np.uint64)
    head = np.array([len(doc_ids)], dtype="<u4").tobytes() + np.array([len(ids), len(words)], dtype="<u8").tobytes() + np.array([len(blocks)], dtype="<u4").tobytes()
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes() + np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
    return MAGIC + head + keys + np.array(lengths, dtype="<u4").tobytes() + (np.cumsum(sizes) - sizes).astype("<u8").tobytes() + words.astype("<u8").tobytes()


def read_image(image: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, ids per document, all ids."""
    if image[:4] != MAGIC:
        raise ValueError("not a token file")
    docs = int(np.frombuffer(image, "<u4", 1, 4)[0])
    n, n_words = (int(x) for x in np.frombuffer(image, "<u8", 2, 8))
    n_blocks = int(np.frombuffer(image, "<u4", 1, 24)[0])
    at = 28
    keys = np.frombuffer(image, "<i8", docs, at)
    nulls = np.frombuffer(image, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(image, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    offsets = np.append(np.frombuffer(image, "<u8", n_blocks, at), n_words).astype(np.int64)
    words = np.frombuffer(image, "<u8", n_words, at + 8 * n_blocks)
    parts = [unpack(words[offsets[b] : offsets[b + 1]], min(BLOCK, n - b * BLOCK)) for b in range(n_blocks)]
    return [None if z else int(k) for k, z in zip(keys, nulls)], lengths.astype(np.int64), np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


#: The tokenizer stages under which a text's ids are those of its words, one after the other.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}


def encodes_by_words(path: str) -> bool:
    """Whether the file describes a BPE tokenizer with those stages, of merges over all bytes and nothing else, and special tokens in <| and |>."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model = said["model"]
    marked = all(t["content"].startswith("<|") and not t["normalized"] for t in said["added_tokens"])
    if not (marked and model["type"] == "BPE" and all(said.get(k) == v for k, v in BY_WORDS.items())):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return False
    return all(BYTE_LEVEL.get(b, chr(b)) + end in model["vocab"] for b in range(256) for end in ("", model.get("end_of_word_suffix") or ""))


class Merges:
    """A BPE model's merges, applied to many short words at once.

    The merge of a pair lies at shift[left] + right of one table; shifts are dealt so that no two pairs meet, and an
    entry names its left symbol, so a look-up is exact. Every step merges each word's leftmost pair of lowest rank, as
    the library does.
    """

    NONE = np.iinfo(np.int32).max

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        shown = [BYTE_LEVEL.get(i, chr(i)) for i in range(256)]
        self.inner = np.array([vocab[c] for c in shown], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in shown], dtype=np.int32)
        self.none = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[x + y] for x, y in pairs], dtype=np.int32)
        rows: dict[int, dict[int, int]] = {}
        for rank, (x, y) in enumerate(pairs):
            rows.setdefault(vocab[x], {})[vocab[y]] = rank
        spread, rng = 4 * self.none, np.random.default_rng(0)
        self.shift = np.zeros(self.none + 1, dtype=np.int64)
        self.table = np.full(spread + self.none + 1, -1, dtype=np.int64)
        for left, row in sorted(rows.items(), key=lambda r: -len(r[1])):
            rights = np.array(list(row))
            free = np.zeros(0, dtype=np.int64)
            while not len(free):
                tried = rng.integers(0, spread, 16)
                free = tried[(self.table[tried[:, None] + rights] < 0).all(axis=1)]
            self.shift[left] = free[0]
            self.table[free[0] + rights] = (left << 32) + np.array(list(row.values()))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        entry = self.table[self.shift[left] + right]
        return np.where(entry >> 32 == left, entry & 0xFFFFFFFF, self.NONE).astype(np.int32)

    def encode(self, chars: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words behind each other, and ids per word; a row of chars is a word's bytes, zeros behind them."""
        ids, count = np.zeros(chars.shape, dtype="<u4"), np.zeros(len(chars), dtype=np.int64)
        for low, high in ((0, 6), (6, 8), (8, 10), (10, 12), (12, chars.shape[1])):
            which = np.flatnonzero((length > low) & (length <= high))
            if not len(which):
                continue
            n = length[which]
            # a symbol that merges with nothing stands on both sides
            symbols = np.full((len(which), high + 2), self.none, dtype=np.int32)
            symbols[:, 1:-1] = np.where(np.arange(high) < n[:, None], self.inner[chars[which, :high]], self.none)
            symbols[np.arange(len(n)), n] = self.last[chars[which, n - 1]]
            ranks = self.ranks(symbols[:, :-1], symbols[:, 1:])
            while True:
                at = ranks.argmin(axis=1)
                lowest = ranks[np.arange(len(at)), at]
                done = lowest == self.NONE
                if done.any():
                    ids[which[done], : symbols.shape[1] - 2] = symbols[done, 1:-1]
                    count[which[done]] = n[done]
                    on = ~done
                    which, n, at, lowest, symbols, ranks = which[on], n[on], at[on], lowest[on], symbols[on], ranks[on]
                if not len(which):
                    break
                row, made, n = np.arange(len(which)), self.made[lowest], n - 1
                symbols[row, at] = made
                kept = np.ones(symbols.shape, dtype=bool)
                kept[row, at + 1] = False
                symbols = symbols[kept].reshape(len(row), -1)
                kept = np.ones(ranks.shape, dtype=bool)
                kept[row, at] = False
                ranks = ranks[kept].reshape(len(row), -1)
                ranks[row, at - 1] = self.ranks(symbols[row, at - 1], made)
                ranks[row, at] = self.ranks(made, symbols[row, at + 1])
        return ids[np.arange(ids.shape[1]) < count[:, None]], count


class Encoder(dict):
    """Whole texts to ids with the tokenizers library's results; maps words to packed ids.

    A tokenizer that `encodes_by_words` drops white space, so a text's ids are those of its words in order. Words of
    letters up to U+024F, ASCII digits and ASCII punctuation are cut as the pre-tokenizer cuts them, for many texts at
    once, and pieces of SHORT bytes at most are merged by `Merges`; they are remembered in a table where a piece has one
    slot, by its bytes. Longer pieces and all other words go to the library one by one and are remembered in the dict,
    none longer than LONGEST bytes. Texts with special-token strings or combining marks go through the library whole,
    and so do all texts of any other tokenizer. About `most_bytes` are remembered, half of them in the table.
    """

    def __init__(self, path: str, held: int = 300_000, most_bytes: int = 40 << 20):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.held, self.most_bytes, self.bytes = Tokenizer.from_file(path), held, most_bytes // 2, 0
        self.by_words = encodes_by_words(path)
        self.pieces = self.tokenizer.model.tokenize
        every = np.arange(self.tokenizer.get_vocab_size(), dtype="<u4").tobytes()
        self.packed = [every[a : a + 4] for a in range(0, len(every), 4)]
        if self.by_words:
            with open(path, encoding="utf-8") as f:
                self.merges = Merges(json.load(f)["model"])
            self.bits = max(1, (most_bytes // 2 // SLOT).bit_length() - 1)
            self.low, self.high = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.uint64)
            self.start, self.count = np.zeros(1 << self.bits, dtype=np.int32), np.zeros(1 << self.bits, dtype=np.uint8)
            self.pool, self.used = np.zeros(4 << self.bits, dtype="<u4"), 0

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        """Ids of a word not seen yet, remembered unless it is long."""
        ids = self._ids(word)
        if len(word) <= LONGEST:
            self[word] = ids
            self.bytes += len(word) + len(ids) + ENTRY
        return ids

    def _ids(self, word: bytes) -> bytes:
        """One word of Latin letters only is one pre-token and goes straight to the BPE model."""
        if word.isalpha():
            token = word.decode()
        else:
            stem = word.rstrip(PUNCTUATION)
            if stem and len(stem) < len(word) and _ends_token(stem):
                return self[stem] + self[word[len(stem) :]]
            text = word.decode()
            low = text.lower()
            if not text.isalpha() or max(text) > "\u024f" or len(low) != len(text):
                return self._direct(text)
            token = low.encode().decode("latin-1").translate(BYTE_LEVEL)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.pieces(token)])

    def _put(self, at: int, ids: np.ndarray) -> None:
        """Write ids into the pool, which grows where they don't fit."""
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(len(ids), dtype="<u4")])
        self.pool[at : at + len(ids)] = ids

    def _short(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pool holds the ids of pieces of SHORT bytes at most, and how many; data ends in 24 spare bytes."""
        words, q, by = data.view("<u8"), start >> 3, ((start & 7) << 3).astype(np.uint64)
        middle, back = words[q + 1], np.uint64(64) - by
        low = (words[q] >> by | middle << back) & HEADS[np.minimum(length, 8)]
        high = (middle >> by | words[q + 2] << back) & HEADS[np.maximum(length, 8) - 8]
        mixed = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        slot = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        at, count = self.start[slot].astype(np.int64), self.count[slot].astype(np.int64)
        new = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high))
        if len(new):
            low, high = low[new], high[new]
            _, first, same = np.unique(mixed[new], return_index=True, return_inverse=True)
            if (low[first[same]] != low).any() or (high[first[same]] != high).any():
                first = same = np.arange(len(new))
            low, high, slot = low[first], high[first], slot[new[first]]
            ids, n = self.merges.encode(np.stack([low, high], axis=1).astype("<u8").view(np.uint8), length[new[first]])
            starts = self.used + np.cumsum(n) - n
            self._put(self.used, ids)
            self.used += len(ids)
            at[new], count[new] = starts[same], n[same]
            # of two pieces of one slot, the last is kept in every array
            last = len(slot) - 1 - np.unique(slot[::-1], return_index=True)[1]
            slot = slot[last]
            self.low[slot], self.high[slot], self.start[slot], self.count[slot] = low[last], high[last], starts[last], n[last]
        return at, count

    def _many(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts, or of parts of texts cut at white space."""
        joined = b" ".join(texts).translate(LOWER)
        joined += b" " * (-len(joined) % 8 + 24)
        data, start, stop, plain = cut(joined)
        short = plain & (stop - start <= SHORT)
        at, count = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        at[short], count[short] = self._short(data, start[short], (stop - start)[short])
        others = np.flatnonzero(~short)
        if len(others):
            codes = [self[joined[a:b]] for a, b in zip(start[others].tolist(), stop[others].tolist())]
            count[others] = n = np.array([len(c) // 4 for c in codes])
            at[others] = self.used + np.cumsum(n) - n
            self._put(self.used, np.frombuffer(b"".join(codes), dtype="<u4"))
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = self.pool[np.repeat(at - ends[:-1], count) + np.arange(ends[-1])].tobytes()
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        edge = (4 * ends[np.searchsorted(start, begins)]).tolist()
        most = 4 << self.bits
        if self.used > most:
            self.used, self.low[:], self.high[:] = 0, 0, 0
        if len(self.pool) > most:
            self.pool = self.pool[:most].copy()
        if len(self) > self.held or self.bytes > self.most_bytes:
            self.clear()
            self.bytes = 0
        return [flat[a:b] for a, b in zip(edge, edge[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian u32 ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts, owners, held = [], [], 0
        for i, text in enumerate(texts):
            raw = text.encode()
            if not self.by_words or b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw:
                out[i].append(self._direct(text))
                continue
            for part in pieces_of(raw):
                parts.append(part)
                owners.append(i)
                held += len(part)
                if held >= TOGETHER:
                    for owner, code in zip(owners, self._many(parts)):
                        out[owner].append(code)
                    parts, owners, held = [], [], 0
        for owner, code in zip(owners, self._many(parts) if parts else []):
            out[owner].append(code)
        return [b"".join(codes) for codes in out]


def pieces_of(raw: bytes) -> Iterator[bytes]:
    """A text in parts of about TOGETHER bytes, cut at white space."""
    a = 0
    while len(raw) - a > TOGETHER:
        b = max(raw.rfind(c, a, a + TOGETHER) for c in BLANKS)
        if b <= a:
            b = m.start() if (m := re.compile(b"[" + b"".join(BLANKS) + b"]").search(raw, a + TOGETHER)) else len(raw)
        yield raw[a:b]
        a = b
    yield raw[a:]


def cut(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces as the pre-tokenizer of BY_WORDS cuts them: the bytes in lower case, starts, ends, whether plain.

    A word that holds anything but letters up to U+024F, ASCII digits and ASCII punctuation is one piece, not plain.
    The text, in lower case as to A-Z, ends in white space of some bytes.
    """
    data, kind = np.frombuffer(bytearray(joined), dtype=np.uint8), np.frombuffer(bytearray(joined.translate(KINDS)), dtype=np.uint8)
    if not joined.isascii():
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
        low = NARROW[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
        lead, low = lead[low > 0], low[low > 0]
        data[lead], data[lead + 1] = 0xC0 | low >> 6, 0x80 | low & 63
        kind[lead] = kind[lead + 1] = LETTER
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        edges = np.flatnonzero(np.diff((kind != BLANK).astype(np.int8), prepend=0))
        held = np.unique(np.searchsorted(edges[::2], odd, side="right") - 1)
        step = np.zeros(len(kind), dtype=np.int8)
        step[edges[::2][held]], step[edges[1::2][held]] = 1, -1
        kind[np.cumsum(step, dtype=np.int8) > 0] = ODD
    begins = np.empty(len(kind), dtype=bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == DIGIT
    begins &= kind != BLANK
    quote = np.flatnonzero((data == 0x27) & begins)
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        one, two = data[quote + 1], data[quote + 2]
        size = np.where(np.isin(one, list(b"stmd")), 2, np.where(((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C), 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        begins[quote + 1] = False
        begins[(quote + size)[kind[quote + size] == LETTER]] = True
    start = np.flatnonzero(begins)
    begins |= kind == BLANK
    stop = np.flatnonzero(begins[1:] & (kind[:-1] != BLANK)) + 1
    return data, start, stop, kind[start] != ODD


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append end_id, write images in doc_id order; returns the written table (part, seq, n_ids, image)."""
    spark = docs.sparkSession
    ready_for_python(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    tail = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder, part, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, lengths, keys, held = [], [], [], 0

        def image():
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([build_image(keys, lengths, flat)], pa.binary())], names=["part", "seq", "n_ids", "image"])

        for batch in batches:
            for key, code in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                code += tail
                ids.append(code)
                lengths.append(len(code) // 4)
                keys.append(key)
                held += lengths[-1]
                if held >= IDS_PER_IMAGE:
                    yield image()
                    seq, held = seq + 1, 0
                    ids, lengths, keys = [], [], []
        if keys:
            yield image()
        lean()

    return materialise(ordered.mapInArrow(encode, "part int, seq int, n_ids long, image binary"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, seq, image in zip(batch.part, batch.seq, batch.image):
                keys, lengths, ids = read_image(image)
                ends = np.cumsum(lengths)
                flat = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(flat[4 * (e - k) : 4 * e]) for k, e in zip(lengths.tolist(), ends.tolist())]
                yield pd.DataFrame({"part": part, "seq": seq, "doc_id": pd.array(keys, dtype="Int64"), "inside": ends - lengths, "n_tokens": lengths, "ids_crc32": crcs})
        lean()

    ready_for_python(files.sparkSession)
    docs = files.select("part", "seq", "image").mapInPandas(decode, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier.orderBy("part")), F.lit(0)).alias("skip"))
    images = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(earlier.partitionBy("part").orderBy("seq")), F.lit(0)).alias("before"))
    starts = images.join(parts, "part").select("part", "seq", (F.col("skip") + F.col("before")).alias("base"))
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def export(files: DataFrame, folder: str) -> None:
    """Copy the images of one part after the other to a local folder, as plain files."""
    import os

    os.makedirs(folder, exist_ok=True)
    for row in files.orderBy("part", "seq").toLocalIterator():
        with open(f"{folder}/{row['part']:05d}-{row['seq']:05d}.tsb8", "wb") as f:
            f.write(row["image"])
