"""Operator 9, bounded-space online packing.

Each partition holds ``windows`` open windows of ``capacity`` tokens.  A document (its ids and an end id)
first gives whole windows of its own; the rest goes into the open window that it fills best.  When none has
room and all are open, the fullest is emitted.  What is still open at the end of the partitions is merged,
``merge`` partitions at a time, largest window first into the merged window with the least room that fits;
merged windows are emitted with ``padded`` = the least power of two that holds them, emitted full-length ones
with ``padded`` = ``capacity``.

One pass over the texts and one small shuffle (at most ``windows`` x ``merge`` windows a task, whatever the
input).  Sequence ids name partition and window, the pass is written once, so a retried task changes nothing.

Ids come from a ``tokenizers`` file; words between white space are encoded once per worker and joined
(the pattern drops white space and every step before it works character by character, so words are
independent).  Edge cases: null and empty texts are the end id alone; repeated rows are packed each;
an empty table gives no rows; extra columns are not returned.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kshot.llm.bpe_memo import NOT_SPACE, WS, Memo
from kshot.session import staged

CAPACITY, WINDOWS, MERGE, END = 4096, 32, 8, 2
WORD = re.compile(f"[^{WS}]+")
PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded")


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, through a memo of words."""

    def __init__(self, path: str, memo: int = 300_000):
        self.memo = Memo(path, True, memo)
        # matched before the normaliser, in their own case only
        self.added = [t.content for t in self.memo.tok.get_added_tokens_decoder().values() if not t.normalized]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self._words(t) if t else [] for t in texts]
        self.memo.learn(set().union(*cut))
        get = self.memo.known.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            low = text.lower()                           # the normaliser lowers character by character
            if not any(t in low for t in self.added):
                text = low
        if any(c in text for c in NOT_SPACE):
            return WORD.findall(text)
        return text.split()


class Packer:
    """Open windows of one partition; ``emit`` gets finished windows as (pieces, size, closed)."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.free: list[tuple[int, int]] = []            # (room, window), ascending
        self.held: dict[int, list[tuple]] = {}
        self.next = 0

    def add(self, piece: tuple, length: int) -> list[tuple[int, list[tuple]]]:
        out = []
        if length == self.capacity:
            self.next += 1
            return [(self.next - 1, [(*piece, 0)])]
        at = bisect_left(self.free, (length, -1))        # the least room that suffices
        if at == len(self.free):
            if len(self.free) >= self.windows:
                _, full = self.free.pop(0)               # the fullest goes
                out.append((full, self.held.pop(full)))
            room, w = self.capacity, self.next
            self.next += 1
            self.held[w] = []
        else:
            room, w = self.free.pop(at)
        self.held[w].append((*piece, self.capacity - room))
        if room == length:
            out.append((w, self.held.pop(w)))
        else:
            insort(self.free, (room - length, w))
        return out


def _pass(path: str, capacity: int, windows: int, end: int):
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc, packer, tail = Encoder(path), Packer(capacity, windows), end.to_bytes(4, "little")

        def table(rows, closed):
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset"]
            cols = list(zip(*[r for _, ps in rows for r in ps])) or [[]] * len(names)
            seq = [(part << 33) + w for w, ps in rows for _ in ps]
            arrays = {n: pa.array(c, pa.int64()) for n, c in zip(names, cols)}
            arrays |= {"sequence_id": pa.array(seq, pa.int64()), "closed": pa.array([closed] * len(seq), pa.bool_())}
            return pa.RecordBatch.from_arrays([arrays[k] for k in OUT], OUT)

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for lo in range(0, len(ids), 256):
                done = []
                for doc, data in zip(ids[lo:lo + 256], enc.encode(texts.slice(lo, 256).to_pylist())):
                    data += tail
                    n = len(data) // 4
                    for a in range(0, n, capacity):
                        piece = data[4 * a:4 * (a + capacity)]
                        done += packer.add((doc, a, len(piece) // 4, zlib.crc32(piece), n), len(piece) // 4)
                if done:
                    yield table(done, True)
        if packer.held:
            yield table(list(packer.held.items()), False)
    return run


OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "closed"]


def _merge(capacity: int):
    """Best-fit of the open windows of some partitions, largest first; a merged window keeps the id of its
    first part, parts move as a whole."""
    def fn(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        size: dict[int, int] = {}
        for r in rows:
            size[r["sequence_id"]] = size.get(r["sequence_id"], 0) + r["length"]
        free: list[tuple[int, int]] = []
        place: dict[int, tuple[int, int]] = {}
        for w in sorted(size, key=lambda x: (-size[x], x)):
            at = bisect_left(free, (size[w], -1))
            room, target = free.pop(at) if at < len(free) else (capacity, w)
            place[w] = (target, capacity - room)
            insort(free, (room - size[w], target))
        filled = {target: capacity - room for room, target in free}
        out = {k: [] for k in PIECE}
        for r in rows:
            target, base = place[r["sequence_id"]]
            r |= {"sequence_id": target, "offset": base + r["offset"],
                  "padded": min(capacity, 1 << (filled[target] - 1).bit_length())}
            for k in PIECE:
                out[k].append(r[k])
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})
    return fn


def pack(documents: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY,
         windows: int = WINDOWS, merge: int = MERGE, end: int = END) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded``."""
    src = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long, closed boolean")
    pieces = staged(src.mapInArrow(_pass(tokenizer, capacity, windows, end), schema), "pieces")
    closed = pieces.where("closed").select(*PIECE[:-1], F.lit(capacity).cast("long").alias("padded"))
    left = pieces.where("not closed").withColumn("grp", F.expr(f"shiftright(sequence_id, 33) div {merge}"))
    merged = left.groupBy("grp").applyInArrow(_merge(capacity), ", ".join(f"{c} long" for c in PIECE))
    return closed.unionByName(merged)
