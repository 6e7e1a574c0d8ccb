"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from whole texts, computed for blocks of documents in numpy. Trees are fitted on the driver from the
statistics of a bounded sample of labelled rows, with monotonic constraints on chosen features, and flattened into node
arrays; scoring walks all documents of a block through all trees one level at a time. The scan is one pass without a
shuffle, and its memory follows a block of about 1 MB or the longest document.

Defined results: a null or empty text has zero for every count, is ``base_failed`` and not kept. Repeated rows get one
result row each. Without labelled rows of both classes every score is 1, so only the base rules reject. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import labelled_sample, table
from ._text import SPACE, Block, Hasher, U, blocks, mix, runs, window_hash

#: Symbols that count as ``n_symbols``.
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "mark_share", "distinct_share", "words_per_line", "top_word_share", "symbol_word_share", "long_word_share", "shout_share",
)
#: Direction of the probability of label 1 with a feature: -1 must not rise.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "symbol_word_share": -1}
MIN_WORDS, MAX_REPEAT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"!?.,;:-_=~/\\\"'()[]{}@^`+")] = True


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By owner: distinct keys and the most frequent key's count; by item: whether its key occurs again in its owner."""
    both = mix(keys ^ (owner.astype(U) * U(0x9E3779B97F4A7C15)))
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(ranked)))
    of = owner[order[first]] if len(first) else np.zeros(0, np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, count)
    again = np.empty(len(ranked), bool)
    again[order] = np.repeat(count > 1, count)
    return np.bincount(of, minlength=n), most, again


def statistics(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Of each document of a block: the base counts (n x 5, long) and the features (n x 14, double)."""
    data, n = b.data, b.n
    start, end, at = b.words()
    words = np.diff(at)
    owner = np.repeat(np.arange(n), words)
    lead = (data & 0xC0) != 0x80
    chars = b.per_doc(lead & ~SPACE[data])
    symbols = b.per_doc(_SYMBOL[data])
    hashes = Hasher(data)
    word = hashes(start, end)

    at3, owner3 = runs(at, 3)
    _, _, again3 = _distinct(window_hash(word, at3, 3), owner3, n)
    cover = np.zeros(len(word), bool)
    for k in range(3):
        cover[at3[again3] + k] = True
    repeats = np.bincount(owner[cover], minlength=n)

    newline = np.flatnonzero(data == 10)
    filled = np.flatnonzero(np.diff(b.at) > 0)
    line_start = np.unique(np.concatenate([b.at[:-1][filled], newline + 1]))
    line_start = line_start[line_start < len(data)]
    line_owner = np.searchsorted(b.at, line_start, side="right") - 1
    stop = np.append(line_start[1:], len(data))
    ends_in_newline = (stop > line_start) & (data[stop - 1] == 10) if len(stop) else np.zeros(0, bool)
    line_end = stop - ends_in_newline
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    lines = np.bincount(line_owner[has_word], minlength=n)
    kinds, _, _ = _distinct(hashes(line_start[has_word], line_end[has_word]), line_owner[has_word], n)

    counts = np.column_stack([words, chars, symbols, lines - kinds, repeats])
    distinct, most, _ = _distinct(word, owner, n)
    some = np.maximum(words, 1)
    letters = np.maximum(chars, 1)
    cum = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shout = (upper[end] - upper[start] >= 2) if len(start) else np.zeros(0, bool)
    shares = [
        np.log1p(words), chars / some, symbols / some, (lines - kinds) / np.maximum(lines, 1), repeats / some, b.per_doc(_UPPER[data]) / letters,
        b.per_doc(_DIGIT[data]) / letters, b.per_doc(_MARK[data]) / some, distinct / np.sqrt(some), words / np.maximum(lines, 1), most / some,
        np.bincount(owner[cum[end] > cum[start]], minlength=n) / some, np.bincount(owner[end - start > 24], minlength=n) / some, np.bincount(owner[shout], minlength=n) / some,
    ]
    return counts.astype(np.int64), np.column_stack(shares).astype(np.float64)


@dataclass
class Trees:
    """Boosted trees as node arrays, one row a tree: a leaf points at itself, so a walk of ``depth`` steps ends in one."""

    bias: float
    depth: int = 0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    left: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, width = self.feature.shape
        if not trees:
            return np.full(len(x), self.bias)
        out = np.full(len(x), self.bias)
        base = np.arange(trees) * width
        feature, threshold, left, right, value = (a.ravel() for a in (self.feature, self.threshold, self.left, self.right, self.value))
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(self.depth):
                k = base + node
                node = np.where(part[row, feature[k]] <= threshold[k], left[k], right[k])
            out[i : i + 4096] += value[base + node].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 2.0, l2: float = 1.0) -> Trees:
    """Boosting with the logistic loss on binned features.

    A constrained feature admits only splits whose leaf values go its way, and the middle of the two values bounds all
    leaves below either side, so every tree is monotone in it. ``least`` is the least hessian in a leaf.
    """
    y = y.astype(float)
    if not len(y) or y.min() == y.max():
        return Trees(bias=50.0 if not len(y) or y[0] == 1 else -50.0)
    monotone, n, width = monotone or {}, x.shape[1], 2 ** (depth + 1)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(n)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(n)])
    p = y.mean()
    model = Trees(bias=float(np.log(p / (1 - p))), depth=depth)
    margin = np.full(len(y), model.bias)
    grown = []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = q - y, np.maximum(q * (1 - q), 1e-9)
        feature, threshold = np.zeros(width, np.int64), np.zeros(width)
        left, right, value = np.arange(width), np.arange(width), np.zeros(width)
        todo, free = [(0, np.arange(len(y)), -np.inf, np.inf, 0)], 1
        step = np.zeros(len(y))
        while todo:
            node, rows, low, high, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            leaf = float(np.clip(-g / (h + l2), low, high))
            best = (1e-6, None)
            for j in range(n if level < depth else 0):
                m = len(edges[j]) + 1
                gl = np.cumsum(np.bincount(binned[rows, j], grad[rows], m))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], hess[rows], m))[:-1]
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-(g - gl) / (h - hl + l2), low, high)
                gain = -(gl * vl + (hl + l2) * vl**2 / 2) - ((g - gl) * vr + (h - hl + l2) * vr**2 / 2) + g * leaf + (h + l2) * leaf**2 / 2
                gain[(hl < least) | (h - hl < least)] = 0
                if way := monotone.get(j):
                    gain[way * (vr - vl) < 0] = 0
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (j, k, vl[k], vr[k]))
            if best[1] is None:
                value[node] = rate * leaf
                step[rows] = rate * leaf
                continue
            j, k, a, b = best[1]
            feature[node], threshold[node] = j, edges[j][k]
            left[node], right[node], free = free, free + 1, free + 2
            goes = binned[rows, j] <= k
            mid, way = (a + b) / 2, monotone.get(j, 0)
            bounds = [(low, high), (low, high)]
            if way > 0:
                bounds = [(low, mid), (mid, high)]
            elif way < 0:
                bounds = [(mid, high), (low, mid)]
            todo += [(left[node], rows[goes], *bounds[0], level + 1), (right[node], rows[~goes], *bounds[1], level + 1)]
        margin += step
        grown.append((feature, threshold, left, right, value))
    model.feature, model.threshold, model.left, model.right, model.value = (np.array(a) for a in zip(*grown, strict=True))
    return model


def train(documents: DataFrame, labels: DataFrame, per_class: int = 4000) -> Trees:
    """Fits on the statistics of at most ``2 * per_class`` labelled documents (``labels.quality``), taken in hash order."""
    sample = labelled_sample(documents, labels, "quality", per_class, balance=False)

    def rows(batches):
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for b in blocks(batch.column("text")):
                _, x = statistics(b)
                yield pa.RecordBatch.from_pydict({"doc_id": ids[b.first : b.first + b.n], "label": label[b.first : b.first + b.n].astype("int32"), "x": pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))})

    got = sample.mapInArrow(rows, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["label"].to_numpy(), {FEATURES.index(k): v for k, v in MONOTONE.items()})


def assess(documents: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """(doc_id, the base counts, score, base_failed, kept) of every document; needs columns doc_id and text.

    ``base_failed``: fewer than 50 words, or over half of them in repeated windows of three. ``kept``: the base rules
    passed and the model's score is ``threshold`` or more.
    """

    def rows(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for b in blocks(batch.column("text")):
                counts, x = statistics(b)
                score = model.score(x)
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT * counts[:, 0])
                yield pa.RecordBatch.from_arrays([ids.slice(b.first, b.n), *(pa.array(c) for c in counts.T), pa.array(score), pa.array(failed), pa.array(~failed & (score >= threshold))], names=["doc_id", *BASE, "score", "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", score double, base_failed boolean, kept boolean"
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, schema)


def keep(documents: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with all their columns; one pass, no join."""
    schema = documents.schema

    def rows(batches):
        for batch in batches:
            good = []
            for b in blocks(batch.column("text")):
                counts, x = statistics(b)
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT * counts[:, 0])
                good.append(~failed & (model.score(x) >= threshold))
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return documents.mapInArrow(rows, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document's counts and verdict."""
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return assess(documents, model)
