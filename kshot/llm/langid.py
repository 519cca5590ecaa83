"""Operator 7, hierarchical language identification.

A text is the share of its hashed n-grams (1 to 4 bytes of the lowered text, and whole words) among
``DIM`` slots.  One-versus-rest linear support vector machines choose the family, one-versus-one machines
choose the language inside it (most votes, then the larger margin, then the name).  ``FAMILIES`` maps language
codes to families; a code that is not listed is a family of its own.

Scale: fitted on about ``per_lang`` rows of each learned language (keyed hash sample, bound is the parameter);
prediction is one pass without a shuffle, the model is ``machines x DIM`` numbers.

Edge cases: a text that is null or has no letter is ``und`` with score 0; a row without ``lang`` teaches
nothing; with one learned language everything with a letter is that language, with none ``und``; repeated
rows and null ids are predicted each by itself; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kshot.llm.common import Words, free, held_out, map_batches, mix, text_runs

DIM, PER_LANG, GRAMS, SCALE, SEED = 4096, 1500, (1, 2, 3, 4), 40.0, 11
#: language families (fixed values)
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
            "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ca": "romance", "ro": "romance",
            "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic",
            "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic", "az": "turkic", "kk": "turkic",
            "hi": "indic", "ur": "indic", "bn": "indic", "ar": "semitic", "he": "semitic"}


def slots(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, slot) of every n-gram and word, one pair of arrays per kind."""
    out = []
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    run = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        run = run[:m] * np.uint64(0x100000001B3) + data[n - 1:].astype(np.uint64)
        if n in GRAMS:
            ok = doc[:m] == doc[n - 1:]
            s = (mix(run + np.uint64(n)) & np.uint64(DIM - 1)).astype(np.int32)
            out.append((doc[:m][ok], s[ok]))
    w = Words(data, offs)
    out.append((w.doc.astype(np.int32), (mix(w.hash) & np.uint64(DIM - 1)).astype(np.int32)))
    return out


def vectors(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Dense rows: for each kind of gram its share of the slots, scaled."""
    n = len(offs) - 1
    x = np.zeros(n * DIM)
    for doc, s in slots(data, offs):
        size = np.maximum(np.bincount(doc, minlength=n), 1)
        x += np.bincount(doc.astype(np.int64) * DIM + s, minlength=n * DIM) / np.repeat(size, DIM)
    return (x.reshape(n, DIM) * SCALE).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, classes weighted alike) by accelerated gradient descent; ``y`` is -1 or 1."""
    n, d = x.shape
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    rate = 1 / (2 * (weight * ((x.astype(np.float64) ** 2).sum(axis=1) + 1)).sum() + l2)
    w, b = np.zeros(d), 0.0
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ pw.astype(np.float32) + pb))
        r = -2 * weight * y * gap
        gw, gb = x.T @ r.astype(np.float32) + l2 * pw, r.sum()
        nw, nb = pw - rate * gw, pb - rate * gb
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


@dataclass
class Model:
    families: dict[str, list[str]]
    names: list[tuple[str, str]] = field(default_factory=list)     # (family, "") or a pair of languages
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margins(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        out = np.zeros((n, len(self.names)))
        for doc, s in slots(data, offs):
            size = np.maximum(np.bincount(doc, minlength=n), 1) / SCALE
            for j in range(len(self.names)):
                out[:, j] += np.bincount(doc, self.weights[j][s], minlength=n) / size
        return out + self.bias

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offs) - 1
        if not self.families:
            return ["und"] * n, np.zeros(n)
        m = self.margins(data, offs)
        col = {name: j for j, name in enumerate(self.names)}
        fams = sorted(self.families)
        sure = lambda z: 1 / (1 + np.exp(-2 * np.clip(z, -15, 15)))
        if len(fams) > 1:
            fm = np.stack([m[:, col[f, ""]] for f in fams], axis=1)
            which = fm.argmax(axis=1)
            fam_score = sure(fm.max(axis=1))
        else:
            which, fam_score = np.zeros(n, np.int64), np.ones(n)
        lang, score = np.empty(n, object), fam_score
        for i, f in enumerate(fams):
            rows = which == i
            langs = self.families[f]
            votes, total = np.zeros((rows.sum(), len(langs))), np.zeros((rows.sum(), len(langs)))
            for a in range(len(langs)):
                for b in range(a + 1, len(langs)):
                    z = m[rows, col[langs[a], langs[b]]]
                    votes[:, a] += z >= 0
                    votes[:, b] += z < 0
                    total[:, a] += z
                    total[:, b] -= z
            best = (votes + sure(total) / 2).argmax(axis=1)
            lang[rows] = np.array(langs, object)[best]
            if len(langs) > 1:
                score[rows] *= sure(total[np.arange(len(best)), best] / (len(langs) - 1))
        return lang.tolist(), np.clip(score, 0, 1)


def train(documents: DataFrame, per_lang: int = PER_LANG, families: dict[str, str] | None = None,
          text: str = "text", lang: str = "lang") -> Model:
    """Fit on about ``per_lang`` rows of each language outside the held-out part."""
    families = FAMILIES if families is None else families
    known = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}      # one row per language
    if not counts:
        return Model({})
    take = F.create_map(*[F.lit(v) for k, c in counts.items() for v in (k, min(1.0, per_lang / c))])
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = known.where(draw < take[F.col(lang)]).select(F.col(lang).alias("lang"), F.lower(text).alias("text"))

    def fn(batch):
        for a, b, data, offs in text_runs(batch.column("text"), 1 << 18):
            yield {"lang": batch.column("lang").slice(a, b - a), "x": [v.tobytes() for v in vectors(data, offs)]}
    got = map_batches(rows, fn, "lang string, x binary").toArrow()
    raw = got.column("x").to_pylist()
    order = sorted(range(len(raw)), key=raw.__getitem__)
    x = np.frombuffer(b"".join(raw[i] for i in order), np.float32).reshape(-1, DIM)
    y = np.array(got.column("lang").to_pylist(), object)[order]
    groups: dict[str, list[str]] = {}
    for c in sorted(set(y)):
        groups.setdefault(families.get(c, c), []).append(c)
    model = Model(groups)
    fam = np.array([families.get(c, c) for c in y], object)
    machines = []
    if len(groups) > 1:
        for f in sorted(groups):
            model.names.append((f, ""))
            machines.append(fit_svm(x, np.where(fam == f, 1.0, -1.0)))
    for langs in groups.values():
        for a in range(len(langs)):
            for b in range(a + 1, len(langs)):
                rows_ = (y == langs[a]) | (y == langs[b])
                model.names.append((langs[a], langs[b]))
                machines.append(fit_svm(x[rows_], np.where(y[rows_] == langs[a], 1.0, -1.0)))
    if machines:
        model.weights, model.bias = np.stack([w for w, _ in machines]), np.array([b for _, b in machines])
    return model


def identify(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` without the text, plus ``lang_pred`` and ``score``."""
    extra = [c for c in documents.columns if c not in (text, "lang_pred", "score")]
    letter = free("_letter", extra)
    src = documents.select(F.struct(*extra, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letter)).alias("row"),
                           F.lower(text).alias("text"))

    def fn(batch):
        for a, b, data, offs in text_runs(batch.column("text")):
            lang, score = model.predict(data, offs)
            yield {"row": batch.column("row").slice(a, b - a), "lang_pred": lang, "score": score}
    out = map_batches(src, fn, f"row {src.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(*[F.col("row")[c].alias(c) for c in extra],
                      F.when(F.col("row")[letter], F.col("lang_pred")).otherwise("und").alias("lang_pred"),
                      F.when(F.col("row")[letter], F.col("score")).otherwise(0.0).alias("score"))
