"""Operator 3, token counts with overlap resynchronisation.

Texts up to ``chunk`` characters are encoded whole.  A longer text is encoded in overlapping chunks with
offsets; two neighbours are spliced at a boundary that both encodings have inside the overlap and that is
*stable*: the split pattern of a byte-level BPE always starts a new match there, whatever stands before
(white space after anything else, or one of a few marks after a letter A-Z).  Tokens left of it are final in
the left chunk, tokens right of it are final in the right one, so the splice equals the whole encoding.
Without such a boundary the overlap is doubled, at last to the whole left chunk, which is then lengthened.

A chunk is encoded through a memo of its segments (the runs between white-space boundaries of the split
pattern, each of which is encoded on its own by the tokenizer anyway) or, if the text holds a special token's
string (white space beside one belongs to another match), by the tokenizer with its offsets.

Map only: no shuffle, memory bounded by a batch, one text and ``memo`` segments per Python worker.

Edge cases: null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids give a row each;
extra columns are kept, except ones named like the three results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kshot.llm.bpe_memo import WS, Memo, load
from kshot.llm.common import free, map_batches

CHUNK, OVERLAP, MEMO = 16_384, 256, 600_000
SEGMENT = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
STABLE = re.compile(f"(?<=[^{WS}])[{WS}]|(?<=[A-Za-z])[,.;:!?]")


class ByTokenizer:
    """Token starts of a text, from the tokenizer's offsets: positions where all earlier tokens have ended,
    the number of tokens before each, and the number of tokens."""

    def __init__(self, tok):
        self.tok = tok

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        offsets = np.array(self.tok.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
        ended = np.concatenate(([0], np.maximum.accumulate(offsets[:, 1])))[:-1]
        clean = np.flatnonzero(offsets[:, 0] >= ended)
        at, first = np.unique(offsets[clean, 0], return_index=True)
        return at, clean[first], len(offsets)


class ByMemo:
    """The same at the starts of the segments, whose tokens come from the memo."""

    def __init__(self, memo: Memo):
        self.memo = memo

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        segments = SEGMENT.findall(text)
        self.memo.learn(set(segments))
        n = np.fromiter(map(self.memo.known.__getitem__, segments), np.int64, len(segments))
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        return np.cumsum(size) - size, np.cumsum(n) - n, int(n.sum())


def count_long(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` by overlapping chunks, spliced; equals the tokens of the whole text."""
    n, total = len(text), 0
    start, end = 0, min(len(text), chunk)
    at, before, count = encode(text[start:end])
    spliced, begin = 0, 0           # where this chunk's share begins, and its tokens left of there
    while end < n:
        width = overlap
        while True:
            lo = max(spliced, end - width)
            hi = min(n, max(lo + chunk, end + 1))
            r_at, r_before, r_count = encode(text[lo:hi])
            stable = np.fromiter((m.start() for m in STABLE.finditer(text, max(lo, 1), end)), np.int64)
            spots = np.intersect1d(np.intersect1d(at + start, r_at + lo), stable)
            spots = spots[spots > lo]
            if len(spots):
                cut = spots[len(spots) // 2]
                total += int(before[np.searchsorted(at + start, cut)]) - begin
                begin, spliced = int(r_before[np.searchsorted(r_at + lo, cut)]), int(cut)
                start, end, at, before, count = lo, hi, r_at, r_before, r_count
                break
            if lo > spliced:
                width *= 2          # widen the overlap
            else:                   # no stable boundary in the whole left chunk: lengthen it
                end = min(n, end + (end - start))
                at, before, count = encode(text[start:end])
                if end == n:
                    break
    return total + count - begin


def _counter(path: str, chunk: int, overlap: int, memo: int, group: int = 512):
    known, specials = None, ()

    def fn(batch):
        nonlocal known, specials
        if known is None:
            known = Memo(path, False, memo, count=True)
            specials = [t.content for t in known.tok.get_added_tokens_decoder().values()]
        kept, col = batch.column("kept"), batch.column("text")
        for lo in range(0, len(col), group):
            texts = col.slice(lo, group).to_pylist()
            counts, cut = [0] * len(texts), []
            for i, t in enumerate(texts):
                if not t:
                    continue
                if len(t) > chunk:
                    special = any(s in t for s in specials)
                    counts[i] = count_long(ByTokenizer(known.tok) if special else ByMemo(known), t, chunk, overlap)
                elif any(s in t for s in specials):
                    counts[i] = len(known.tok.encode(t, add_special_tokens=False))
                else:
                    cut.append((i, SEGMENT.findall(t)))
            known.learn(set().union(*[c for _, c in cut]))
            get = known.known.__getitem__
            for i, segments in cut:
                counts[i] = sum(map(get, segments))
            yield {"kept": kept.slice(lo, group), "n_tokens": pa.array(counts, pa.int64())}
    return fn


def count_tokens(documents: DataFrame, tokenizer: str, text: str = "text", limit: int = 512, chunk: int = CHUNK,
                 overlap: int = OVERLAP, memo: int = MEMO) -> DataFrame:
    """``documents`` without the text, plus ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``).

    ``tokenizer``: path of a byte-level BPE ``tokenizers`` file, present on every executor.
    """
    extra = [c for c in documents.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    size = free("_bytes", extra)
    src = documents.select(F.struct(*extra, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias(size))
                           .alias("kept"), F.col(text).alias("text"))
    out = map_batches(src, _counter(tokenizer, chunk, overlap, memo),
                      f"kept {src.schema['kept'].dataType.simpleString()}, n_tokens long")
    return out.select(*[F.col("kept")[c].alias(c) for c in extra], F.col("kept")[size].alias("n_bytes"), "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))
