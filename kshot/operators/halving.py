"""Many candidates of the dense head fitted in the same scans, the worse half dropped at every rung.

The head is ``sigmoid(w . f(a, b) + w0)`` on fixed vectors, trained by gradient descent with momentum.  One scan of the
training pairs carries the gradients of all live candidates: a map task multiplies each Arrow batch with the matrix of
all weights and returns one row of sums per candidate, and a partial aggregation adds them up, so a scan costs little
more for sixteen candidates than for one and only ``candidates x dimensions`` numbers reach the driver.  At the end of a
rung one scan of the one-shot tasks scores every live candidate; the better half goes on with its weights and momentum.

Five of the search space's dimensions apply to this head: ``learning_rate``, ``momentum`` (final), ``momentum_slope``,
``Dense1_multiplier`` (of the learning rate) and ``l2_penalization_Dense1``; the others belong to convolutions.  A scan
stands for ``steps`` iterations of the schedule of I1 (learning rate x 0.99 every 500 iterations, momentum from 0.5 up).

Pairs with a null or unequal vector, or a null label, teach nothing; a task pair without a score counts as the least.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kshot.functions.blocks import matrices
from kshot.operators.classify import one_shot_hit
from kshot.operators.scoring import EPS
from kshot.session import staged

DIMENSIONS = ("learning_rate", "momentum", "momentum_slope", "Dense1_multiplier", "l2_penalization_Dense1")
RESULT = ("rung int, candidate long, learning_rate double, momentum double, momentum_slope double, Dense1_multiplier double, "
          "l2_penalization_Dense1 double, iterations long, loss double, objective double, weight_norm double, kept int, is_best int")


@dataclass
class Heads:
    """Live candidates: their settings, weights (the bias first) and velocities, a row each."""

    settings: list[dict]
    weights: np.ndarray
    velocity: np.ndarray
    scans: int = 0

    @classmethod
    def start(cls, settings: list[dict], dim: int) -> Heads:
        return cls(settings, np.zeros((len(settings), dim + 1)), np.zeros((len(settings), dim + 1)))

    def keep(self, rows: list[int]) -> Heads:
        return Heads([self.settings[i] for i in rows], self.weights[rows], self.velocity[rows], self.scans)

    def step(self, gradient: np.ndarray, steps: int) -> None:
        """One update from the mean gradient of a scan."""
        at = self.scans * steps
        for k, s in enumerate(self.settings):
            rate = s["learning_rate"] * s["Dense1_multiplier"] * steps * 0.99 ** (at // 500)
            grown = max(0, math.ceil(round((s["momentum"] - 0.5) / s["momentum_slope"], 9)))
            momentum = 0.5 + s["momentum_slope"] * min(at, grown)
            decay = 2 * s["l2_penalization_Dense1"] * self.weights[k]
            decay[0] = 0.0
            self.velocity[k] = momentum * self.velocity[k] - rate * (gradient[k] + decay)
        self.weights = self.weights + self.velocity
        self.scans += 1


def _pairs(a: pa.Array, b: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and features (a column of ones first) of the pairs of complete vectors of equal length."""
    right = {m.shape[1]: (rows, m) for rows, m in matrices(b)}
    for rows, m in matrices(a):
        if m.shape[1] in right:
            both, i, j = np.intersect1d(rows, right[m.shape[1]][0], assume_unique=True, return_indices=True)
            x, y = m[i], right[m.shape[1]][1][j]
            f = np.abs(x - y) if kind == "absdiff" else np.hstack((x, y))
            yield both, np.hstack((np.ones((len(both), 1)), f))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def gradients(pairs: DataFrame, weights: np.ndarray, kind: str = "absdiff") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean gradients and losses of all heads over ``pairs(va, vb, label)``, and the number of pairs: one scan."""
    width = weights.shape[1]

    def run(batches):
        grad, loss, n = np.zeros(weights.shape), np.zeros(len(weights)), 0
        for batch in batches:
            label = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            for rows, x in _pairs(batch.column(0), batch.column(1), kind):
                known = ~np.isnan(label[rows])
                x, y = x[known], label[rows][known][:, None]
                if x.shape[1] != width or not len(x):
                    continue
                p = _sigmoid(x @ weights.T)
                q = np.clip(p, EPS, 1 - EPS)
                loss -= (y * np.log(q) + (1 - y) * np.log(1 - q)).sum(axis=0)
                grad += (p - y).T @ x
                n += len(x)
        yield pa.RecordBatch.from_pydict({"head": pa.array(np.arange(len(weights)), pa.int32()),
                                          "sums": pa.array([[*g, s, n] for g, s in zip(grad.tolist(), loss.tolist(), strict=True)])})
    summed = (pairs.select("va", "vb", F.col("label").cast("double").alias("label"))
              .mapInArrow(run, "head int, sums array<double>").select("head", F.posexplode("sums").alias("at", "x"))
              .groupBy("head", "at").agg(F.sum("x").alias("x")).toArrow())          # heads x (dimensions + 3) rows
    out = np.zeros((len(weights), width + 2))
    out[summed["head"].to_numpy(), summed["at"].to_numpy()] = summed["x"].to_numpy()
    n = int(out[0, -1])
    return out[:, :width] / max(n, 1), out[:, width] / max(n, 1), n


def scores(pairs: DataFrame, weights: np.ndarray, keys: list[str], kind: str = "absdiff") -> DataFrame:
    """``keys``, ``head``, ``p`` of every pair under every head: one scan."""
    heads = len(weights)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            p = np.full((n, heads), -1.0)
            for rows, x in _pairs(batch.column(0), batch.column(1), kind):
                if x.shape[1] == weights.shape[1]:
                    p[rows] = _sigmoid(x @ weights.T)
            again = pa.array(np.repeat(np.arange(n), heads))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(2 + i).take(again) for i in range(len(keys))),
                 pa.array(np.tile(np.arange(heads), n), pa.int32()), pa.array(p.ravel())], names=[*keys, "head", "p"])
    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select("va", "vb", *keys).mapInArrow(run, f"{kinds}, head int, p double")


def objectives(tasks: DataFrame, heads: Heads, kind: str = "absdiff") -> np.ndarray:
    """1 - one-shot accuracy of every head over ``tasks(task, pair_no, va, vb)``."""
    hits = one_shot_hit(scores(tasks, heads.weights, ["task", "pair_no"], kind), ["head", "task"])
    out = np.ones(len(heads.settings))
    for head, accuracy in hits.groupBy("head").agg(F.avg("hit")).collect():       # one row a head
        out[head] = 1.0 - accuracy
    return out


def successive_halving(candidates: DataFrame, pairs: DataFrame, tasks: DataFrame, rungs: list[int], steps: int = 50,
                       kind: str = "absdiff") -> tuple[DataFrame, Heads]:
    """A row per candidate and rung (``RESULT``), and the best head.

    ``rungs`` are the scans of each rung.  ``loss`` is what the rung's last scan saw (before its update); candidates are
    ranked by ``objective``, then ``loss`` to nine digits, then number; a loss that is no number ranks last.
    """
    spark = pairs.sparkSession
    pairs = staged(pairs.select("va", "vb", "label"), "search_pairs")
    tasks = staged(tasks.select("task", "pair_no", "va", "vb"), "search_tasks")
    dim = pairs.agg(F.max(F.size("va"))).first()[0] or 0
    settings = [r.asDict() for r in candidates.select("candidate", *DIMENSIONS).orderBy("candidate").collect()]
    live, rows = Heads.start(settings, dim if kind == "absdiff" else 2 * dim), []
    for rung, scans in enumerate(rungs):
        loss = np.zeros(len(live.settings))
        for _ in range(scans):
            gradient, loss, _ = gradients(pairs, live.weights, kind)
            live.step(gradient, steps)
        objective = objectives(tasks, live, kind)
        finite = np.where(np.isfinite(loss), loss, np.inf)
        order = sorted(range(len(loss)), key=lambda i: (objective[i], round(finite[i], 9), live.settings[i]["candidate"]))
        last = rung == len(rungs) - 1
        kept = order[:1] if last else order[:-(-len(order) // 2)]
        for i, s in enumerate(live.settings):
            rows.append((rung, s["candidate"], *(float(s[d]) for d in DIMENSIONS), live.scans * steps, float(loss[i]),
                         float(objective[i]), float(np.sqrt((live.weights[i] ** 2).sum())), int(i in kept),
                         int(last and i == order[0])))
        live = live.keep(sorted(kept))
    return spark.createDataFrame(rows, RESULT), live
