"""Shared helpers: Arrow batch mapping, byte-level word splitting and hashing, training samples.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered, which on UTF-8 bytes is:
a run of 0-9, A-Z, a-z or bytes of 0x80 and above.  The whole batch is split and hashed by numpy on the
Arrow buffer; hashes are 64-bit and position independent, so equal words hash alike everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 16), np.uint64(base), dtype=np.uint64)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if n <= 1 << 22:   # the table of one very long text is not kept
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (every input bit reaches every output bit)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a run of texts: byte ``start``/``end``, owning ``doc``, ``hash``, ``count`` per text.
    ``kind`` says which bytes words are made of."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray = _WORD):
        n_docs = len(offs) - 1
        word = kind[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offs] = True
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[:1] = False
        start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty_like(word)
        after[:-1] = word[1:]
        after[-1:] = False
        end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.data, self.start, self.end = data, start, end
        self.doc = np.searchsorted(offs[1:], start, side="right")
        self.count = np.bincount(self.doc, minlength=n_docs)
        self.first = np.concatenate(([0], np.cumsum(self.count)))   # word range of each text
        run = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(_P, len(data)), out=run[1:])
        self._run, self._back = run, _powers(_P_INV, len(data) + 1)[start]
        self.hash = self._hash(start, end, slice(None))

    def _hash(self, start: np.ndarray, end: np.ndarray, which) -> np.ndarray:
        h = (self._run[end] - self._run[start]) * self._back[which]
        return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(56)))

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Owning text and hash of the first ``n`` bytes of every longer word."""
        which = np.flatnonzero(self.end - self.start > n)
        return self.doc[which], self._hash(self.start[which], self.start[which] + n, which)

    def text(self, i: int) -> str:
        return bytes(_LOWER[self.data[self.start[i]:self.end[i]]]).decode("utf-8")

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and validity (inside one text) of the ``k`` words from each word on."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        g = self.hash[:n].copy()
        for j in range(1, k):
            g *= np.uint64(0xD6E8FEB86659FD93)
            g += self.hash[j:j + n]
        return mix(g), self.doc[:n] == self.doc[k - 1:]


def text_runs(col: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts of about ``max_bytes`` (one text may exceed it):
    ``(first row, last row + 1, bytes, offsets)``.  Null is the empty text."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    _, off_buf, data_buf = col.buffers()
    offs = np.frombuffer(off_buf, dtype=np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + max_bytes, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def lowered(data: bytes | np.ndarray):
    """UTF-8 bytes with A-Z lowered."""
    return bytes(_LOWER[np.frombuffer(data, np.uint8)]) if isinstance(data, bytes) else _LOWER[data]


def sections(data: np.ndarray, max_bytes: int, word: np.ndarray = _WORD) -> Iterator[np.ndarray]:
    """Pieces of one text of about ``max_bytes``, cut at bytes that are not ``word`` (a longer word stays whole)."""
    a = 0
    while a < len(data):
        b = a + max_bytes
        while b < len(data) and word[data[b]]:
            gap = np.flatnonzero(~word[data[b:b + max_bytes]])
            b += int(gap[0]) if len(gap) else max_bytes
        yield data[a:b]
        a = b


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` where ``fn`` yields dicts of columns (name -> values) for a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for cols in fn(b):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for f, c in
                     ((f, cols[f.name]) for f in out)], schema=out)
        pa.default_memory_pool().release_unused()     # workers are reused by later stages
    return df.mapInArrow(run, schema)


def free(name: str, columns: list[str]) -> str:
    """``name`` with underscores before it until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept out of every fit: crc32 of the id as text, mod 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_rows(documents: DataFrame, labels: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows of ``documents`` joined with ``labels`` (both by ``doc_id``; ids of labels are distinct).

    First ids are drawn by a keyed hash, ``rows`` of the distinct ones; where ids repeat in ``documents``, rows are then
    drawn from what was joined, so that the bound holds for rows as well.  The same rows on every evaluation."""
    ids = labels.count()
    if ids > rows:
        labels = labels.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * rows / ids))
    labels = F.broadcast(labels)                       # about ``rows`` ids
    met = documents.select("doc_id").join(labels, "doc_id", "left_semi").count()
    if met > 1.25 * rows:
        row = free("_row", documents.columns)
        draw = F.pmod(F.xxhash64(F.lit(seed), row), F.lit(1 << 30)) < int((1 << 30) * rows / met)
        documents = documents.withColumn(row, F.monotonically_increasing_id()).where(draw).drop(row)
    return documents.join(labels, "doc_id")


def listed(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Arrow list column from row offsets and flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
