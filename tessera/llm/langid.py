"""Language identification with a byte convolutional network, trained in numpy on labelled text.

A text (lower-cased, UTF-8) is cut into windows of WINDOW bytes; every window of the whole text counts. Bytes are
embedded, filters of several widths slide over them, each filter's maximum over the window feeds a softmax over the
learned languages. A document's prediction combines its windows' log probabilities, weighted by their bytes.

`train` reads at most `per_language` documents of each language (a hash decides which), CROPS windows of each from
anywhere in its whole text (the hash decides where). `learn_all` goes on from there with every distinct window of every
labelled text, once: windows are dealt by hash to groups of about GROUP, each group trains a copy of the network, and
the copies' weights are averaged by windows. Groups, their order and the sums don't depend on how the rows are stored.
A batch weighs the languages it holds alike and says nothing about others. Prediction reads the text alone.

Defined results: a null text and a text without any letter is `und` with score 0, and so is every text when nothing
was learned; rows with a null label, text or id teach nothing; repeated rows are predicted alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..shipping import ready_for_python
from .common import lean

WINDOW, CROPS, CHUNK, GROUP = 256, 3, 256, 1 << 14
WIDTHS, FILTERS, DIMS = (2, 3, 4), 10, 5
NAMES = ("embed", "filters", "shift", "dense", "bias")
#: Weights are averaged as whole numbers of this part, so that no order of adding them changes the result.
FINEST = 2.0**-24


class ByteCNN:
    """Embedding, one matrix for the filters of all widths (shorter ones end in zeros), max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages, span = languages, max(WIDTHS)
        self.embed = r.normal(0, 0.5, (256, DIMS)).astype(np.float32)
        self.embed[0] = 0
        self.filters = r.normal(0, 0.3, (span * DIMS, len(WIDTHS) * FILTERS)).astype(np.float32)
        self.open = np.ones_like(self.filters)
        for i, w in enumerate(WIDTHS):
            self.open[w * DIMS :, i * FILTERS : (i + 1) * FILTERS] = 0
        self.filters *= self.open
        self.shift = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.dense = r.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), dtype=np.float32)

    def _unrolled(self, windows: np.ndarray) -> np.ndarray:
        span = max(WIDTHS)
        padded = np.zeros((len(windows), WINDOW + span - 1), dtype=np.uint8)
        padded[:, :WINDOW] = windows
        x = self.embed[padded]
        view = np.lib.stride_tricks.sliding_window_view(x.reshape(len(windows), -1), span * DIMS, axis=1)[:, ::DIMS]
        return view.reshape(len(windows) * WINDOW, span * DIMS)

    def _pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self._unrolled(windows)
        scores = (x @ self.filters).reshape(len(windows), WINDOW, -1)
        return x, scores, scores.max(axis=1)

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        _, _, top = self._pooled(windows)
        z = np.maximum(top + self.shift, 0) @ self.dense + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def _gradients(self, w: np.ndarray, y: np.ndarray, balanced: bool) -> dict:
        """Of the cross entropy; balanced: among the languages of this batch only, each of the same weight."""
        n = len(w)
        x, scores, top = self._pooled(w)
        spot = scores.argmax(axis=1)
        hidden = np.maximum(top + self.shift, 0)
        z = hidden @ self.dense + self.bias
        if balanced:
            held = np.bincount(y, minlength=z.shape[1])
            z[:, held == 0] = -np.inf
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        if balanced:
            p /= (np.count_nonzero(held) * held[y])[:, None].astype(np.float32)
        else:
            p /= n
        back = (p @ self.dense.T) * (hidden > 0)
        picked = x[(np.arange(n)[:, None] * WINDOW + spot).ravel()].reshape(n, spot.shape[1], -1)
        grad = {"dense": hidden.T @ p, "bias": p.sum(axis=0), "shift": back.sum(axis=0), "filters": np.einsum("nf,nfk->kf", back, picked) * self.open}
        to_x = (back[:, :, None] * self.filters.T[None]).reshape(n, spot.shape[1], max(WIDTHS), DIMS)
        padded = np.zeros((n, WINDOW + max(WIDTHS)), dtype=np.uint8)
        padded[:, :WINDOW] = w
        read = padded[np.arange(n)[:, None, None], spot[:, :, None] + np.arange(max(WIDTHS))]
        grad["embed"] = np.zeros_like(self.embed)
        np.add.at(grad["embed"], read.ravel(), to_x.reshape(-1, DIMS))
        grad["embed"][0] = 0
        return grad

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 7, balanced: bool = False) -> None:
        r = np.random.default_rng(seed)
        first, second, step = {n: 0.0 for n in NAMES}, {n: 0.0 for n in NAMES}, 0
        steps = epochs * max(1, len(windows) // batch)
        for epoch in range(epochs):
            for at in np.array_split(r.permutation(len(windows)), max(1, len(windows) // batch)):
                grad = self._gradients(windows[at], labels[at], balanced)
                now = rate * (1 - (step / steps if balanced else epoch / epochs))
                step += 1
                for k in NAMES:
                    first[k] = 0.9 * first[k] + 0.1 * grad[k]
                    second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
                    move = now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
                    setattr(self, k, (getattr(self, k) - move).astype(np.float32))

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in NAMES])

    def with_weights(self, flat: np.ndarray) -> "ByteCNN":
        """A network of the same languages with these weights."""
        out, at = ByteCNN(self.languages), 0
        for k in NAMES:
            held = getattr(out, k)
            setattr(out, k, flat[at : at + held.size].reshape(held.shape).astype(np.float32))
            at += held.size
        return out


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, zero-padded, and the bytes that each holds."""
    raw = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    k = -(-len(raw) // WINDOW)
    out = np.zeros(k * WINDOW, dtype=np.uint8)
    out[: len(raw)] = raw
    return out.reshape(k, WINDOW), np.minimum(WINDOW, len(raw) - WINDOW * np.arange(k)).astype(np.float32)


def train(docs: DataFrame, per_language: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None) -> ByteCNN | None:
    """Fit on a bounded sample of the labelled rows where `usable` holds; None if there are none."""
    rows = docs if usable is None else docs.where(usable)
    rows = rows.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(1 << 40)).alias("h")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    bound = None
    for lang, n in counts.items():
        limit = F.lit(int(min(1.0, 2 * per_language / n) * (1 << 40)))
        bound = F.when(F.col("lang") == lang, limit) if bound is None else bound.when(F.col("lang") == lang, limit)
    place = lambda k: F.pmod(F.xxhash64("h", F.md5("text"), F.lit(k)), F.greatest(F.lit(1), F.length("text") - WINDOW + 1)).cast("int") + 1
    cropped = rows.where(F.col("h") <= bound).select("lang", "h", F.array(*[F.substring("text", place(k), F.lit(WINDOW)) for k in range(CROPS)]).alias("crops"))
    first = Window.partitionBy("lang").orderBy("h", "crops")
    some = cropped.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).toPandas().sort_values(["lang", "r"])
    languages, r = sorted(counts), np.random.default_rng(11)
    crops, labels = [], []
    for lang, texts in zip(some.lang, some.crops):
        for text in texts:
            raw = text.lower().encode()
            size = int(r.integers(12, WINDOW)) if r.random() < 0.4 else WINDOW
            a = int(r.integers(0, max(1, len(raw) - size + 1)))
            crop = np.zeros(WINDOW, dtype=np.uint8)
            piece = np.frombuffer(raw[a : a + size], dtype=np.uint8)
            crop[: len(piece)] = piece
            crops.append(crop)
            labels.append(languages.index(lang))
    model = ByteCNN(languages)
    if crops:
        model.fit(np.array(crops), np.array(labels))
    return model


def labelled_windows(rows: DataFrame) -> DataFrame:
    """(lang, w): every distinct window of every text with its label. rows: (lang, text)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, text in zip(b.lang, b.text):
                windows, _ = windows_of(text)
                for a in range(0, len(windows), CHUNK * CHUNK):
                    yield pd.DataFrame({"lang": lang, "w": [w.tobytes() for w in windows[a : a + CHUNK * CHUNK]]})
        lean()

    ready_for_python(rows.sparkSession)
    return rows.select("lang", "text").mapInPandas(cut, "lang string, w binary").distinct()


def halved(windows: np.ndarray, labels: np.ndarray, seed: int, share: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """The windows, some of them cut in two at any byte, so that short texts are learned as well; no byte is lost."""
    r = np.random.default_rng(seed)
    size = WINDOW - (windows[:, ::-1] != 0).argmax(axis=1)
    cut = (r.random(len(windows)) < share) & (size >= 24)
    at = (12 + r.random(len(windows)) * (size - 23)).astype(np.int64)
    spot = np.arange(WINDOW)
    head = np.where(cut[:, None] & (spot >= at[:, None]), 0, windows).astype(np.uint8)
    moved = np.take_along_axis(windows[cut], np.minimum(spot + at[cut, None], WINDOW - 1), axis=1)
    tail = np.where(spot < (size - at)[cut, None], moved, 0).astype(np.uint8)
    return np.concatenate([head, tail]), np.concatenate([labels, labels[cut]])


def learn_all(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None, rate: float = 0.005, group: int = GROUP) -> ByteCNN | None:
    """The network after one pass over all labelled rows where `usable` holds, from `train`'s, which knows their languages."""
    if model is None:
        return None
    rows = docs if usable is None else docs.where(usable)
    rows = rows.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    size = rows.agg(F.sum(F.ceil(F.octet_length("text") / WINDOW))).first()[0] or 0
    place = F.pmod(F.xxhash64("lang", "w"), F.lit(max(1, -(-size // group))))

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["lang", "w"])
        windows = np.frombuffer(b"".join(b.w), dtype=np.uint8).reshape(len(b), WINDOW)
        labels = b.lang.map({name: i for i, name in enumerate(model.languages)}).to_numpy(np.int64)
        own = model.with_weights(model.weights())
        seed = int(b.g.iloc[0])
        own.fit(*halved(windows, labels, seed), epochs=1, rate=rate, seed=seed, balanced=True)
        sums = np.round(own.weights().astype(np.float64) / FINEST).astype(np.int64) * len(b)
        lean()
        return pd.DataFrame({"at": np.arange(-1, len(sums)), "total": np.concatenate([[len(b)], sums])})

    parts = labelled_windows(rows).withColumn("g", place).groupBy("g").applyInPandas(fit, "at int, total long")
    found = parts.groupBy("at").agg(F.sum("total").alias("total")).toPandas().sort_values("at").total.to_numpy(np.int64)
    if not len(found):
        return model
    return model.with_weights(found[1:] / found[0] * FINEST)


def predict_texts(model: ByteCNN | None, texts: list) -> tuple[list[str], np.ndarray]:
    import regex

    letter = regex.compile(r"\p{L}")
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if model is not None and t and letter.search(t)]
    total = np.zeros((len(texts), len(model.languages) if model else 0))
    weight = np.zeros(len(texts))
    held: list = []

    def flush():
        if held:
            rows = model.log_probs(np.concatenate([w for _, w, _ in held]))
            who = np.concatenate([np.full(len(w), i) for i, w, _ in held])
            size = np.concatenate([s for _, _, s in held])
            np.add.at(total, who, rows * size[:, None])
            np.add.at(weight, who, size)
            held.clear()

    count = 0
    for i in known:
        w, size = windows_of(texts[i])
        for a in range(0, len(w), CHUNK):
            held.append((i, w[a : a + CHUNK], size[a : a + CHUNK]))
            count += len(held[-1][1])
            if count >= CHUNK:
                flush()
                count = 0
    flush()
    for i in known:
        mean = total[i] / weight[i]
        p = np.exp(mean - mean.max())
        p /= p.sum()
        names[i], scores[i] = model.languages[int(p.argmax())], float(p.max())
    return names, scores


def predictor(spark, model: ByteCNN | None):
    """A Column function: text to struct<lang_pred, score>."""
    ready_for_python(spark)

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        names, scores = predict_texts(model, texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return label


def learnable(id_col: str = "doc_id") -> Column:
    """Documents outside the held-out quarter."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 != 2


def identify(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    label = predictor(docs.sparkSession, model)
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), label(F.col(f"`{text_col}`")).alias("p"))
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "p.lang_pred", "p.score")
