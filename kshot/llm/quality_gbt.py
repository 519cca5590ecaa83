"""Operator 2, quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns whole texts into ``FEATURES`` by numpy on the Arrow bytes.  ``fit`` bins every feature
by quantiles, grows depth-limited trees on gradient and hessian histograms and stores them flat: a complete
tree of depth ``d`` is ``2**d - 1`` (feature, threshold) nodes and ``2**d`` leaf values, so scoring is ``d``
rounds of array indexing over all rows and trees at once.

Scale: the fit uses about ``max_rows`` labelled rows (a keyed hash sample, bound is the parameter); only their
statistics reach the driver.  Scoring is one pass without a shuffle; the model is a few thousand numbers.

Edge cases: null and empty texts have all-zero statistics and are scored; labels that are null are not used,
repeated labels of an id count as the largest; without labels of both classes the score is the share of 1
(0.5 without any); repeated rows and null ids are scored each by itself; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kshot.llm.common import Words, held_out, labelled_rows, map_batches, mix, text_runs

MAX_ROWS, SEED = 20_000, 7
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 11, 12, 13),
            "line": (10,), "symbol": b"#*$%&|<>", "mark": b".,;:", "shout": b"!?", "other": b"\"'()-/[]{}@=+_~^`\\",
            "high": range(128, 256)}
FEATURES = (*(f"share_{k}" for k in _CLASSES), "log_words", "word_len", "word_len_std", "distinct_words",
            "top_word", "repeat_next", "distinct_trigrams", "words_per_line", "distinct_lines", "long_words",
            "symbol_per_word", "shout_per_word", "mark_per_word")
_LUT = np.full(256, -1, np.int8)
for _i, _k in enumerate(_CLASSES.values()):
    _LUT[list(_k)] = _i


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct hashes and the largest count of one."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.argsort(mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    d, x = doc[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (d[1:] != d[:-1]))))
    size = np.diff(np.concatenate((new, [len(x)])))
    top = np.zeros(n)
    np.maximum.at(top, d[new], size)
    return np.bincount(d[new], minlength=n).astype(float), top


def _sum(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return (run[offs[1:]] - run[offs[:-1]]).astype(float)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    n = len(offs) - 1
    w = Words(data, offs)
    size = np.maximum(np.diff(offs), 1).astype(float)
    cls = _LUT[data]
    counts = {k: _sum(cls == i, offs) for i, k in enumerate(_CLASSES)}
    words = np.maximum(w.count, 1).astype(float)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.doc, length, minlength=n) / words
    var = np.bincount(w.doc, length ** 2, minlength=n) / words - mean ** 2
    distinct, top = _distinct(w.doc, w.hash, n)
    nxt = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    g, ok = w.grams(3)
    tri, _ = _distinct(w.doc[:len(g)][ok], g[ok], n)
    n_tri = np.maximum(w.count - 2, 1)
    # lines: hash of the words of each line
    line = np.concatenate(([0], np.cumsum(data == 10)))[w.start] if len(w.start) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])))) if len(line) else line
    lh = np.add.reduceat(mix(w.hash * np.uint64(3)), first) if len(first) else w.hash
    ld, _ = _distinct(w.doc[first], lh, n)
    lines = np.bincount(w.doc[first], minlength=n) if len(first) else np.zeros(n)
    cols = [counts[k] / size for k in _CLASSES]
    cols += [np.log1p(w.count), mean, np.sqrt(np.maximum(var, 0)), distinct / words, top / words,
             np.bincount(w.doc[1:][nxt], minlength=n) / words, np.where(w.count > 2, tri / n_tri, 1.0),
             w.count / np.maximum(lines, 1), np.where(lines > 0, ld / np.maximum(lines, 1), 1.0),
             np.bincount(w.doc, length > 15, minlength=n) / words, counts["symbol"] / words, counts["shout"] / words,
             counts["mark"] / words]
    out = np.stack(cols, axis=1)
    out[w.count == 0] = 0
    return out


@dataclass
class Trees:
    """Flat trees: ``feature``/``threshold`` (trees, 2**d - 1), ``leaf`` (trees, 2**d), ``base`` log-odds."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        n_trees, nodes = self.feature.shape
        out = np.full(len(x), self.base)
        if not n_trees:
            return out
        tree = np.arange(n_trees)[None, :]
        for a in range(0, len(x), 4096):
            part = x[a:a + 4096]
            at = np.zeros((len(part), n_trees), np.int64)
            rows = np.arange(len(part))[:, None]
            for _ in range(int(np.log2(nodes + 1))):
                at = 2 * at + 1 + (part[rows, self.feature[tree, at]] > self.threshold[tree, at])
            out[a:a + 4096] += self.leaf[tree, at - nodes].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64,
        min_child: float = 5.0, l2: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss, grown level by level on histograms."""
    share = float(y.mean()) if len(y) else 0.5
    nodes = 2 ** depth - 1
    if not len(y) or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Trees(np.log(share / (1 - share)), np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)   # b > k iff x > e[k]
    wide = bins + 1
    flat = b + np.arange(m) * wide
    base = float(np.log(share / (1 - share)))
    raw = np.full(n, base)
    fs, ts, ls = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        for level in range(depth):
            lo, k = 2 ** level - 1, 2 ** level
            node = at - lo
            idx = (node[:, None] * (m * wide) + flat).ravel()
            shape = (k, m, wide)
            hg = np.bincount(idx, np.repeat(g, m), minlength=k * m * wide).reshape(shape).cumsum(axis=2)
            hh = np.bincount(idx, np.repeat(h, m), minlength=k * m * wide).reshape(shape).cumsum(axis=2)
            tg, th = hg[:, :, -1:], hh[:, :, -1:]
            hn = np.bincount(idx, minlength=k * m * wide).reshape(shape).cumsum(axis=2)
            gain = hg ** 2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg ** 2 / (th + l2)
            gain[(hn < min_child) | (hn[:, :, -1:] - hn < min_child)] = -1
            best = gain.reshape(k, -1).argmax(axis=1)
            good = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
            f, cut = best // wide, best % wide
            for i in np.flatnonzero(good):
                if cut[i] < len(edges[f[i]]):
                    feature[lo + i], threshold[lo + i] = f[i], edges[f[i]][cut[i]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf_at = at - nodes
        sg = np.bincount(leaf_at, g, minlength=nodes + 1)
        sh = np.bincount(leaf_at, h, minlength=nodes + 1)
        leaf = -rate * sg / (sh + l2)
        raw += leaf[leaf_at]
        fs.append(feature), ts.append(threshold), ls.append(leaf)
    return Trees(base, np.stack(fs), np.stack(ts), np.stack(ls))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, text: str = "text", **params) -> Trees:
    """Fit on about ``max_rows`` labelled rows outside the held-out part."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .select("doc_id", F.col("quality").cast("int").alias("quality")))
    part = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = labelled_rows(documents.select("doc_id", F.col(text).alias("text")), part, max_rows, SEED)

    def fn(batch):
        for a, b, data, offs in text_runs(batch.column("text")):
            yield {"quality": batch.column("quality").slice(a, b - a),
                   "x": pa.array(list(statistics(data, offs)), pa.list_(pa.float64()))}
    got = map_batches(rows.select("quality", "text"), fn, "quality int, x array<double>").toArrow()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = np.array(got.column("quality")).astype(float)
    order = np.lexsort(x.T)      # rows arrive in any order; sums should not depend on it
    return fit(x[order], y[order], **params)


def score(documents: DataFrame, model: Trees, text: str = "text", out: str = "score") -> DataFrame:
    """``documents`` with the column ``out`` in 0..1 added (an own column of that name is replaced)."""
    cols = [c for c in documents.columns if c != out]
    src = documents.select(F.struct(*cols).alias("row"))     # the text crosses to Python once, inside its row

    def fn(batch):
        row = batch.column("row")
        for a, b, data, offs in text_runs(row.field(text)):
            yield {"row": row.slice(a, b - a), "score": model.score(statistics(data, offs))}
    scored = map_batches(src, fn, f"row {src.schema['row'].dataType.simpleString()}, score double")
    return scored.select(*[F.col("row")[c].alias(c) for c in cols], F.col("score").alias(out))
