"""Operator 8, toxicity by classifier chains.

Categories are predicted one after another: a logistic model per category over the presence of words and word beginnings, and
from the second on also over the log-odds of all earlier categories.  In training those come from
out-of-fold predictions (``folds`` folds by a hash of the row), so a later model sees earlier ones as wrong as
they are on new texts; in prediction they come from the models fitted on all rows.

They are hashed to ``SLOTS``; a category keeps every slot whose share of its texts differs from that of the others by at
least ``MIN_Z`` standard errors, however many those are.  The models are fitted on the sparse slots by Newton steps whose
equations are solved by conjugate gradients.  Any list of 0/1 label columns can be a chain.

Scale: fitted on about ``max_rows`` labelled rows (keyed hash sample, bound is the parameter); prediction is
one pass without a shuffle over whole texts.

Edge cases: null and empty texts have no words and get the model's base probability; null labels count as 0,
repeated labels of an id as the largest; without rows every probability is 0; repeated rows and null ids are
scored each by itself; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kshot.llm.common import Words, held_out, labelled_rows, map_batches, mix, text_runs

PREFIXES = (4, 6, 8)
SLOTS, MIN_Z, MAX_ROWS, FOLDS, SEED = 1 << 19, 4.0, 12_000, 4, 13


def word_slots(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every word and of the first ``PREFIXES`` bytes of longer ones."""
    w = Words(data, offs)
    parts = [(w.doc, w.hash), *((d, h + np.uint64(n)) for n in PREFIXES for d, h in [w.prefix(n)])]
    slot = (mix(np.concatenate([h for _, h in parts]) + np.uint64(77)) & np.uint64(SLOTS - 1)).astype(np.int64)
    return np.concatenate([d for d, _ in parts]), slot


class _Sums:
    """Sums of runs: values gathered by ``take``, added up by ``key`` (below ``size``)."""

    def __init__(self, key: np.ndarray, take: np.ndarray, size: int):
        order = np.argsort(key, kind="stable")
        self.take, self.size = take[order], size
        self.keys, self.start = np.unique(key[order], return_index=True)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        if len(self.keys):
            out[self.keys] = np.add.reduceat(values[self.take], self.start)
        return out


class Slots:
    """Texts as sparse 0/1 rows: ``text`` has ``feature``; ``dense`` columns beside them, a bias last."""

    def __init__(self, text: np.ndarray, feature: np.ndarray, size: int, dense: np.ndarray):
        self.text, self.feature, self.size, self.dense, self.n = text, feature, size, dense, len(dense)
        self.by_text, self.by_feature = _Sums(text, feature, self.n), _Sums(feature, text, size)

    def rows(self, which: np.ndarray) -> Slots:
        """The texts of a mask."""
        number, inside = np.cumsum(which) - 1, which[self.text]
        return Slots(number[self.text[inside]], self.feature[inside], self.size, self.dense[which])

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.by_text(w[:self.size]) + self.dense @ w[self.size:-1] + w[-1]

    def back(self, r: np.ndarray, power: int = 1) -> np.ndarray:
        """Sums of ``r`` over the texts of every column (times the column's value to ``power``)."""
        return np.concatenate((self.by_feature(r), (self.dense ** power).T @ r, [r.sum()]))


def fit_logistic(x: Slots, y: np.ndarray, l2: float = 1.0, steps: int = 30, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and bias (last) by Newton steps; the bias is hardly penalised.  The fit ends where the gradient, in units
    of the curvature, has fallen to a hundred-thousandth."""
    pen = np.full(x.size + x.dense.shape[1] + 1, l2)
    pen[-1] = 1e-6
    w = np.zeros(len(pen)) if start is None else start.copy()

    def loss(z: np.ndarray, v: np.ndarray) -> float:
        return float((np.logaddexp(0, z) - y * z).sum() + (pen * v * v).sum() / 2)
    z = x.times(w)
    now, first = loss(z, w), None
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6)
        grad = x.back(p - y) + pen * w
        scale = 1 / (x.back(h, 2) + pen)
        size = grad @ (scale * grad)
        first = size if first is None else first
        if size <= 1e-10 * max(first, 1.0):
            break
        step, left = np.zeros(len(w)), grad.copy()
        move, energy = scale * left, size
        for _ in range(60):                       # far from the optimum rough steps do
            if energy <= max(1e-4, min(0.1, size / max(first, 1.0))) * size:
                break
            curved = x.back(h * x.times(move)) + pen * move
            far = energy / (move @ curved)
            step += far * move
            left -= far * curved
            old, energy = energy, left @ (scale * left)
            move = scale * left + energy / old * move
        while True:
            ahead = x.times(w - step)
            new = loss(ahead, w - step)
            if new <= now + 1e-9 * abs(now) or np.abs(step).max() < 1e-9:
                break
            step /= 2
        w, z, now = w - step, ahead, new
    return w


@dataclass
class Chain:
    categories: list[str]
    slot_at: np.ndarray                 # slot -> feature or -1
    weights: list[np.ndarray]           # per category: features, earlier log-odds, bias

    def predict(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability per text and category."""
        n = len(offs) - 1
        out = np.zeros((n, len(self.categories)))
        if not self.weights:
            return out
        doc, slot = word_slots(data, offs)
        f = self.slot_at[slot]
        has = f >= 0
        size = int(self.slot_at.max()) + 1 if len(self.slot_at) else 0
        pairs = np.unique(doc[has] * max(size, 1) + f[has])
        d, f = pairs // max(size, 1), pairs % max(size, 1)
        odds: list[np.ndarray] = []
        for c, w in enumerate(self.weights):
            z = np.bincount(d, w[f], minlength=n) + w[-1]
            for j, earlier in enumerate(odds):
                z = z + w[size + j] * earlier
            odds.append(np.clip(z, -8, 8))
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit_chain(bags: list[np.ndarray], y: np.ndarray, fold: np.ndarray, categories: list[str], folds: int = FOLDS) -> Chain:
    """``bags``: distinct word slots of each text; ``y``: 0/1 per text and category."""
    n = len(bags)
    if not n:
        return Chain(categories, np.full(SLOTS, -1), [])
    flat = np.concatenate(bags)
    owner = np.repeat(np.arange(n), [len(b) for b in bags])
    df = np.bincount(flat, minlength=SLOTS)
    keep = np.zeros(SLOTS, bool)
    for c in range(y.shape[1]):
        pos = y[:, c].sum()
        if not 0 < pos < n:
            continue
        a = np.bincount(flat, y[owner, c], minlength=SLOTS)
        pooled = df / n
        se = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / pos + 1 / (n - pos)))
        keep |= (df >= 3) & (np.abs(a / pos - (df - a) / (n - pos)) >= MIN_Z * se)
    slot_at, chosen = np.full(SLOTS, -1), np.flatnonzero(keep)
    slot_at[chosen] = np.arange(len(chosen))
    sel = keep[flat]
    x = Slots(owner[sel], slot_at[flat[sel]], len(chosen), np.zeros((n, 0)))
    weights = []
    for c in range(y.shape[1]):
        weights.append(fit_logistic(x, y[:, c]))
        oof = np.zeros(n)
        for k in range(folds):
            out = fold == k
            if out.any():
                w = fit_logistic(x.rows(~out), y[~out, c], start=weights[-1]) if (~out).any() else np.zeros(len(weights[-1]))
                oof[out] = x.rows(out).times(w)
        x = Slots(x.text, x.feature, x.size, np.concatenate((x.dense, np.clip(oof, -8, 8)[:, None]), axis=1))
    return Chain(categories, slot_at, weights)


def train(documents: DataFrame, labels: DataFrame, categories: dict[str, Column], max_rows: int = MAX_ROWS,
          text: str = "text") -> Chain:
    """Fit on about ``max_rows`` labelled rows outside the held-out part; ``categories``: name -> 0/1 column
    of ``labels``, in chain order."""
    names = list(categories)
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out()).select(
        "doc_id", *[F.coalesce(c.cast("int"), F.lit(0)).alias(f"y{i}") for i, c in enumerate(categories.values())])
    part = known.groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))])
    rows = (labelled_rows(documents.select("doc_id", F.col(text).alias("text")), part, max_rows, SEED)
            .select("text", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"),
                    F.array(*[F.col(f"y{i}") for i in range(len(names))]).alias("y")))

    def fn(batch):
        for a, b, data, offs in text_runs(batch.column("text")):
            doc, slot = word_slots(data, offs)
            pairs = np.unique(doc * SLOTS + slot)
            cut = np.searchsorted(pairs, np.arange(b - a + 1) * SLOTS)
            bag = (pairs % SLOTS).astype(np.int32)
            yield {"y": batch.column("y").slice(a, b - a), "fold": batch.column("fold").slice(a, b - a),
                   "bag": [bag[x:z].tobytes() for x, z in zip(cut, cut[1:])]}
    got = map_batches(rows, fn, "y array<int>, fold int, bag binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["bag"], r["y"], r["fold"]))
    return fit_chain([np.frombuffer(r["bag"], np.int32).astype(np.int64) for r in got],
                     np.array([r["y"] for r in got], float).reshape(len(got), len(names)),
                     np.array([r["fold"] for r in got]), names)


def score(documents: DataFrame, model: Chain, text: str = "text") -> DataFrame:
    """``documents`` without the text, plus ``p_<category>`` for each category of the chain."""
    cols = [f"p_{c}" for c in model.categories]
    extra = [c for c in documents.columns if c != text and c not in cols]
    src = documents.select(F.struct(*extra).alias("row"), F.col(text).alias("text"))

    def fn(batch):
        for a, b, data, offs in text_runs(batch.column("text")):
            p = model.predict(data, offs)
            yield {"row": batch.column("row").slice(a, b - a), **{c: p[:, i] for i, c in enumerate(cols)}}
    out = map_batches(src, fn, f"row {src.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in cols))
    return out.select(*[F.col("row")[c].alias(c) for c in extra], *cols)
