"""Secret scanning: candidates from patterns, false positives removed by a random forest trained here in numpy.

Candidates are values assigned to telling names, passwords in connection URLs, private key blocks, strings of known
key formats, and long mixed runs of key-like characters; none has an upper bound on its length, and finding them
takes time in proportion to the text. The forest sees a candidate's length, character classes and transitions,
entropy, the share that dictionary words cover, the document's path (its source) and the neighbouring words. The
dictionary is the whole words of a public tokenizer's vocabulary, whose file is a parameter. The forest is trained on
labelled findings, `training_findings` of them, that a seeded generator makes: keys, tokens and passwords of many
formats in code and prose against digests, identifiers, addresses, place holders and plain words.

Offsets are code points of the whole text, [start, end). Overlapping candidates keep the first and longest.

Defined results: a null or empty text has no findings; repeated rows repeat their findings; an empty table gives no
rows; a null path is empty; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ready_for_python
from .common import lean

SEPARATOR = re.compile(r"=>?|:=?")
VALUE = re.compile(r"""\s*+["'`]?([^\s"'`<>,;]{8,})""")
IN_URL = re.compile(r"://[^\s/:@]*+:([^\s/@]++)@")
PEM = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*?)PRIVATE KEY( BLOCK)?-----")
PEM_LINES = re.compile(r"(?:\s++[A-Za-z0-9+/=]{16,}+)*+")
FORMATS = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|\bAIza[A-Za-z0-9_-]{35}|\beyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}")
RUNS = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORD = re.compile(r"[^\W_]+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NEAR, PATH_ROWS, NEAR_ROWS = 40, 4, 24
NAMES = re.compile(r"(?i)key|token|secret|passw|pwd|credential|auth")
TELLING = re.compile(r"(?i)key|token|secret|passw|pwd|credential|auth|bearer|login")
HARMLESS = re.compile(r"(?i)sha\d*|md5|commit|hash|digest|checksum|uuid|guid|etag|example|sample|dummy|placeholder|test|rev|revision|integrity|id\b")
PLACEHOLDERS = ("test", "exampl", "sampl", "dumm", "change", "your", "passw", "placehold")


class Dictionary:
    """Words for coverage, and the log probabilities of their letter pairs."""

    def __init__(self, words: frozenset[str]):
        self.words = words
        grid = np.full((27, 27), 0.5)
        for w in words:
            codes = [ord(c) - 97 for c in w]
            np.add.at(grid, (codes[:-1], codes[1:]), 1)
        self.pairs = np.log(grid / grid.sum(axis=1, keepdims=True))


_DICTIONARIES: dict[str, Dictionary] = {}


def dictionary(path: str | None = None) -> Dictionary:
    """The words of three ASCII letters and more that a vocabulary file of word-end BPE holds whole."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _DICTIONARIES:
        with open(path, encoding="utf-8") as f:
            whole = (t.removesuffix("</w>") for t in json.load(f)["model"]["vocab"] if t.endswith("</w>"))
            _DICTIONARIES[path] = Dictionary(frozenset(w for w in whole if len(w) > 2 and w.isascii() and w.isalpha() and w.islower()))
    return _DICTIONARIES[path]


def _name_before(text: str, at: int) -> str:
    """The identifier in front of a separator, over white space, quotes and a closing bracket."""
    while at and (text[at - 1].isspace() or text[at - 1] in "\"'`]"):
        at -= 1
    end = at
    while at and (text[at - 1].isalnum() or text[at - 1] in "_-"):
        at -= 1
    return text[at:end]


def _assigned(text: str) -> list[tuple[int, int, str]]:
    """Values behind names that tell of secrets."""
    out, m = [], SEPARATOR.search(text)
    while m:
        at = m.end()
        if NAMES.search(_name_before(text, m.start())):
            v = VALUE.match(text, at)
            if v:
                out.append((v.start(1), v.end(1), "assigned"))
                at = v.end(1)
        m = SEPARATOR.search(text, at)
    return out


def _keys(text: str) -> list[tuple[int, int, str]]:
    """Private key blocks from BEGIN to END, whatever is between; without an END, the lines of code that follow."""
    if "PRIVATE KEY" not in text:
        return []
    marks, out = list(PEM.finditer(text)), []
    for m, after in zip(marks, [*marks[1:], None]):
        if m[1] == "BEGIN":
            closed = after is not None and after[1] == "END" and after[2] == m[2]
            out.append((m.start(), after.end() if closed else PEM_LINES.match(text, m.end()).end(), "key"))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order, without overlaps."""
    found = _assigned(text) + _keys(text) + [(m.start(1), m.end(1), "url") for m in IN_URL.finditer(text)] + [(m.start(), m.end(), "format") for m in FORMATS.finditer(text)]
    found += [(m.start(), m.end(), "run") for m in RUNS.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
    out: list = []
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
        elif b > out[-1][1] and kind == "key":
            out[-1] = (out[-1][0], b, kind)
    return out


def _kind_of(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _commonness(text: str, known: Dictionary) -> float:
    """Mean log probability of character pairs under those of dictionary words."""
    codes = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in text.lower()]
    return float(known.pairs[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0


def _coverage(value: str, known: Dictionary) -> float:
    """Share of the value in letters that are dictionary words, by case and non-letters apart."""
    parts = [p.lower() for p in PARTS.findall(value)]
    return sum(len(p) for p in parts if p in known.words or p.startswith(PLACEHOLDERS)) / len(value)


def features(text: str, start: int, end: int, kind: str, path: str, known: Dictionary) -> list[float]:
    value = text[start:end]
    n = len(value)
    classes = [sum(_kind_of(c) == k for c in value) / n for k in range(4)]
    counts = np.unique(list(value), return_counts=True)[1] / n
    turns = sum(_kind_of(a) != _kind_of(b) for a, b in zip(value, value[1:])) / max(1, n - 1)
    left, right = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    near = [0.0] * NEAR_ROWS
    for w in WORD.findall(left)[-4:] + WORD.findall(right)[:2]:
        near[zlib.crc32(w.lower().encode()) % NEAR_ROWS] += 1
    places = [0.0] * PATH_ROWS
    for w in WORD.findall(path.lower()):
        places[zlib.crc32(w.encode()) % PATH_ROWS] += 1
    hexes = all(c in "0123456789abcdefABCDEF" for c in value)
    dashes = value.count("-")
    return [
        math.log(n), *classes, float(-(counts * np.log2(counts)).sum()), turns, _commonness(value, known), _coverage(value, known), float(hexes), float(n in (32, 40, 64) and hexes), float(dashes == 4 and n == 36), value.count("/") / n, float(len(set(value)) <= 4),
        *[float(kind == k) for k in ("assigned", "format", "url", "key")], float(bool(TELLING.search(left))), float(bool(HARMLESS.search(left))), float(left.rstrip().endswith(("=", ":", '"', "'"))), float("://" in left[-12:] or "www." in left), float("@" in value), float("(" in value or "{" in value or "$" in value[:2]), float("." in value), float("test" in path.lower() or "example" in path.lower()), *near, *places,
    ]


class Forest:
    """Bagged trees with random features at each split, by Gini impurity."""

    def __init__(self, trees: int = 25, depth: int = 9, least: int = 3, seed: int = 13):
        self.size, self.depth, self.least, self.seed, self.trees = trees, depth, least, seed, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        r = np.random.default_rng(self.seed)
        for _ in range(self.size):
            rows = r.integers(0, len(x), len(x))
            nodes: list = []
            self._grow(x[rows], y[rows], 0, r, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes)))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, r: np.random.Generator, nodes: list) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, 0, 0, float(y.mean())))
        if depth == self.depth or len(y) < 2 * self.least or y.min() == y.max():
            return me
        best = (1e9, 0, 0.0)
        for f in r.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]) * 1.5)), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            k = k[(k >= self.least) & (k <= len(y) - self.least)]
            if not len(k):
                continue
            a, b = t[k - 1] / k, (t[-1] - t[k - 1]) / (len(y) - k)
            gini = k * a * (1 - a) + (len(y) - k) * b * (1 - b)
            j = int(gini.argmin())
            if gini[j] < best[0]:
                best = (float(gini[j]), int(f), float((v[k[j] - 1] + v[k[j]]) / 2))
        if best[0] == 1e9:
            return me
        left = x[:, best[1]] <= best[2]
        a, b = self._grow(x[left], y[left], depth + 1, r, nodes), self._grow(x[~left], y[~left], depth + 1, r, nodes)
        nodes[me] = (best[1], best[2], a, b, float(y.mean()))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth + 1):
                f = feature[at]
                go = f >= 0
                side = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(go, np.where(side, left[at], right[at]), at)
            total += value[at]
        return total / max(1, len(self.trees))


def labelled_findings(n: int, seed: int = 13, vocabulary: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of generated findings."""
    r, known = np.random.default_rng(seed), dictionary(vocabulary)
    pick = lambda options: options[int(r.integers(len(options)))]
    run = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    low, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexes, alnum = digit + "abcdef", low + low.upper() + digit
    base, words = alnum + "+/", sorted(w for w in known.words if len(w) < 9)
    number = lambda a, b: int(r.integers(a, b))
    made_up = lambda: "".join(pick("bcdfglmnprstv") + pick("aeiou") + pick(["", "", "n", "r", "s", "\u00e9"]) for _ in range(number(1, 4)))
    prose = lambda k: " ".join(pick(words) if r.random() < 0.5 else made_up() for _ in range(k))
    leet = lambda w: w.replace(pick("aeios"), pick("013$@"))
    names = ["token", "api_key", "apiKey", "secret", "client_secret", "password", "auth_token", "access_key", "SECRET_KEY", "passwd", "credential", "private_key", "DB_PASSWORD", "pwd", "x-api-key"]
    secrets = [
        lambda: run(hexes, pick([32, 40, 40, 48, 64])), lambda: run(alnum, number(16, 64)), lambda: run(base, 40) + pick(["", "=", "=="]), lambda: "ghp_" + run(alnum, 36), lambda: "AKIA" + run(low.upper() + digit, 16), lambda: "sk_live_" + run(alnum, 24), lambda: "xoxb-" + run(digit, 11) + "-" + run(alnum, 24),
        lambda: "AIza" + run(alnum + "_-", 35), lambda: "eyJ" + run(alnum, 20) + "." + run(alnum, 40) + "." + run(alnum, 30), lambda: pick(words).capitalize() + run("!@#$%" + digit, 3) + run(alnum, 8),
        lambda: pick(words) + run(digit, number(1, 5)) + pick(["", "!", "x", "#", run(low, 2)]), lambda: leet(pick(words)) + pick(["-", "_", "", "."]) + leet(pick(words)) + run(digit + "!", number(1, 4)), lambda: run(alnum + "!#%&*-_.", number(9, 24)),
    ]
    x, y = [], []
    while len(y) < n:
        secret = bool(r.random() < 0.5)
        name = pick(names)
        glue = pick([" = ", "=", ": ", ":", " => ", '": ', " := "])
        quote = pick(['"', '"', "'", ""])
        shape = pick(["assigned"] * 7 + ["url", "key"]) if secret else pick(["digest", "uuid", "placeholder", "path", "compound", "number", "reference", "url", "variable", "prose", "blob", "address"])
        if shape == "assigned":
            value = pick(secrets)()
            bare = value.startswith(("ghp_", "AKIA", "sk_live_", "xoxb-", "AIza", "eyJ")) and r.random() < 0.4
            middle = value if bare else name + glue + quote + value + quote
        elif shape == "url" and secret:
            value = pick(secrets[9:])().replace("@", "").replace("/", "")
            middle = pick(["postgres", "mysql", "redis", "amqp", "https", "mongodb+srv"]) + "://" + pick([*words[:50], ""]) + ":" + value + "@" + pick(words) + pick([".example", ":5432", ".internal"]) + "/" + pick(words)
        elif shape == "key":
            label = pick(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "])
            extra = pick(["", "", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + run(hexes, 16) + "\n\n"])
            lines = [run(base, 64) for _ in range(number(0, 20))]
            ends = not lines or r.random() < 0.9
            value = f"-----BEGIN {label}PRIVATE KEY-----\n{extra}" + "\n".join(lines) + (f"\n-----END {label}PRIVATE KEY-----" if ends else "")
            middle = value = value.strip()
        else:
            label = pick(["commit ", "sha256: ", "md5 ", "checksum=", "rev ", "digest: ", "integrity ", "", "hash = ", "id: ", "see "])
            if shape == "digest":
                value = run(hexes, pick([32, 40, 64])) if r.random() < 0.7 else pick(["sha256-", "sha512-"]) + run(base, pick([43, 86])) + "="
                middle = label + value
            elif shape == "uuid":
                value = "-".join(run(hexes, k) for k in (8, 4, 4, 4, 12))
                middle = pick(["uuid ", "id=", "", "request "]) + value
            elif shape == "placeholder":
                value = pick(["your-" + name + "-here", "changeme123", "example_token_value", "xxxxxxxxxxxx", "<" + name + ">", "PLACEHOLDER_VALUE", "test_password_1", "${" + name.upper() + "}", "********", "dummy-secret-value", "null_or_undefined", "REDACTED", "TODO-fill-this-in", "{{ " + name + " }}"]).strip("<>{} ")
                middle = name + glue + quote + value + quote
            elif shape == "path":
                value = "/".join(pick(words) for _ in range(number(2, 6))) + run(digit, 1)
                middle = "/" + value
            elif shape == "compound":
                value = "".join(made_up() for _ in range(8)) + run(digit, 2)
                middle = value
            elif shape == "number":
                value = run(digit, 16) + pick(low)
                middle = value + pick(["", " items"])
            elif shape == "reference":
                value = pick(["os.environ", "config.get", "settings", "process.env"]) + pick([".", "["]) + name.upper()
                middle = name + glue + value
            elif shape == "variable":
                value = pick(["_", "."]).join(pick(words) for _ in range(number(2, 4))) + pick(["", "()", "[0]"])
                middle = name + glue + value
            elif shape == "prose":
                value = pick(words) + pick(["", ".", "-"]) + pick(words)
                middle = pick(["the password: ", "token: ", "author: ", "keywords: ", "a secret: ", "monkey = ", "key="]) + value
            elif shape == "blob":
                value = "".join(pick(words).capitalize() for _ in range(number(3, 6))) + run(digit, 2)
                middle = pick(["class ", "function ", "", "see "]) + value
            elif shape == "address":
                value = pick(words) + "@" + pick(words) + ".example"
                middle = pick(["auth: ", "author: ", "credential: "]) + value
            else:
                value = pick(words) + "-" + pick(words) + "-" + run(digit, 8) + "-" + pick(words)
                middle = "https://www." + pick(words) + ".example/" + value
        text = prose(number(2, 8)) + pick([" ", "\n"]) + middle + pick([" ", "\n", ", "]) + prose(number(2, 8))
        at = text.find(value)
        kinds = [(a, b, k) for a, b, k in candidates(text) if a < at + len(value) and b > at]
        if not kinds:
            continue
        a, b, kind = kinds[0]
        x.append(features(text, a, b, kind, pick(["src/main", "docs/readme", "tests/data", "config/prod", "src0", "src7", "web", ""]), known))
        y.append(float(secret))
    return np.array(x), np.array(y)


_TRAINED: dict = {}


def trained(training_findings: int = 2400, seed: int = 13, vocabulary: str | None = None) -> Forest:
    key = (training_findings, seed, vocabulary)
    if key not in _TRAINED:
        _TRAINED[key] = Forest(seed=seed).fit(*labelled_findings(training_findings, seed, vocabulary))
    return _TRAINED[key]


def judged(texts: list, paths: list, judge: Forest, known: Dictionary) -> list[tuple[int, str, int, int, float]]:
    """(row, kind, start, end, score) of every candidate."""
    rows, seen = [], []
    for i, (text, path) in enumerate(zip(texts, paths)):
        for a, b, what in candidates(text) if text else ():
            rows.append((i, what, a, b))
            seen.append(features(text, a, b, what, path or "", known))
    return [(*row, float(p)) for row, p in zip(rows, judge.predict(np.array(seen)))] if rows else []


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", vocabulary: str | None = None) -> DataFrame:
    """One row per candidate: doc_id, kind, start, end, score, is_secret."""
    ready_for_python(docs.sparkSession)
    # both are of fixed size: trees of bounded depth, and a vocabulary
    shared = docs.sparkSession.sparkContext.broadcast((forest or trained(vocabulary=vocabulary), dictionary(vocabulary)))
    kind = docs.select(F.col(f"`{id_col}`").alias("doc_id")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge, known = shared.value
        for batch in batches:
            found = judged(batch.text.tolist(), batch.path.tolist(), judge, known)
            if found:
                at, kinds, start, end, score = zip(*found)
                yield pd.DataFrame({"doc_id": batch.doc_id.iloc[list(at)].to_numpy(), "kind": kinds, "start": start, "end": end, "score": score, "is_secret": [p >= threshold for p in score]})
        lean()

    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{path_col}`").cast("string").alias("path"))
    return read.mapInPandas(run, f"doc_id {kind}, kind string, start long, end long, score double, is_secret boolean")


def redact(text: str, findings: list[tuple[int, int]], mask: str = "[secret]") -> str:
    """The text with its findings masked."""
    out, at = [], 0
    for a, b in sorted(findings):
        out += [text[at:a], mask]
        at = b
    return "".join(out) + text[at:]
