"""Operator 4, benchmark decontamination by winnowing.

Both sides are cut into words; every ``k`` consecutive words get a hash, and of each ``window - k + 1``
consecutive hashes the least (the rightmost of equals) is kept as a fingerprint.  A span of ``window``
words shared by a document and an item holds the same full set of hashes on both sides, so both keep the
same one: every shared span of at least ``window`` words is found.  Fingerprints are joined, and each
meeting is extended over its neighbouring words, compared word by word, to all windows around it.

Items shorter than ``window`` words are one window of their length ``m``; for them every ``m`` words are a
fingerprint (a window of one hash), on documents only for lengths that occur.

Scale: documents emit only fingerprints that pass a Bloom filter of the items' (``bloom_bits`` bits,
whatever the corpus), written once to the shared folder; the rest is joined by hash with a constant salt,
so a passage that a third of the corpus holds is spread.  Items with equal words are one row in the join.

Edge cases: null or empty text has no words, no hits; an item without words matches nothing; repeated rows
are judged one by one; a null ``doc_id`` row is kept and judged by its text.  Other columns are kept whatever they are
called, but for the result's names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kshot.llm.common import Words, free, listed, map_batches, text_runs
from kshot.session import staged

K, WINDOW = 6, 10
SALTS = 32


def select_min(g: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """Positions kept by winnowing: of each ``w`` consecutive valid hashes the least, rightmost of equals.

    ``ok`` is false where a gram runs over the end of its text; a window needs ``w`` valid grams.
    """
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at, full = g[:n].copy(), np.arange(n), ok[:n].copy()
    for j in range(1, w):
        x = g[j:j + n]
        take = x <= low
        low[take] = x[take]
        at[take] = np.flatnonzero(take) + j
        full &= ok[j:j + n]
    return np.unique(at[full])


def fingerprints(words: Words, k: int, window: int, short: list[int]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """``(word positions, hashes, window length)`` of the full-length and each short window."""
    out = []
    g, ok = words.grams(k)
    at = select_min(g, ok, window - k + 1)
    out.append((at, g[at], window))
    for m in short:
        g, ok = words.grams(m)
        at = np.flatnonzero(ok)
        out.append((at, g[at], m))
    return out


def _row_schema(text_col: str) -> str:
    return ("rid long, n_words long, hash array<long>, pos array<long>, len array<int>, "
            "lead array<int>, ctx array<array<string>>")


def _mapper(k: int, window: int, short: list[int], bloom: bytes | None, only_own: bool):
    """Per text: its word count and fingerprints with the words around them (``lead`` of them before)."""
    bits = None if bloom is None else np.frombuffer(bloom, dtype=np.uint8)
    schema_ctx = pa.list_(pa.string())

    def fn(batch):
        rid = batch.column("rid")
        for a, b, data, offs in text_runs(batch.column("text")):
            words = Words(data, offs)
            at, hs, ln = [], [], []
            for p, h, m in fingerprints(words, k, window, short):
                if only_own:    # an item: its own windows only
                    n = words.count[words.doc[p]]
                    keep = n >= window if m == window else n == m
                    p, h = p[keep], h[keep]
                if bits is not None and len(p):
                    slot = h & np.uint64(len(bits) * 8 - 1)
                    keep = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    p, h = p[keep], h[keep]
                at.append(p), hs.append(h), ln.append(np.full(len(p), m, np.int32))
            at, hs, ln = np.concatenate(at), np.concatenate(hs), np.concatenate(ln)
            doc = words.doc[at]
            order = np.argsort(doc, kind="stable")
            at, hs, ln, doc = at[order], hs[order], ln[order], doc[order]
            side = np.where(ln == window, window - k, 0)
            size = np.where(ln == window, k, ln)
            lo = np.maximum(at - side, words.first[doc])
            hi = np.minimum(at + size + side, words.first[doc + 1])
            off = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=b - a))))
            ctx = [[words.text(i) for i in range(x, y)] for x, y in zip(lo, hi)]
            yield {"rid": rid.slice(a, b - a), "n_words": words.count, "hash": listed(off, pa.array(hs.view(np.int64))),
                   "pos": listed(off, pa.array(at - words.first[doc])), "len": listed(off, pa.array(ln, pa.int32())),
                   "lead": listed(off, pa.array((at - lo).astype(np.int32))),
                   "ctx": listed(off, pa.array(ctx, schema_ctx))}
    return fn


def _matches(d_ctx, d_lead, i_ctx, i_lead, window: int):
    """Starts (against the fingerprint) of all common windows of ``window`` words around a meeting, as an
    expression: offsets ``-back .. fwd`` where the words of both sides agree from there on."""
    def same(o):
        d = F.slice(d_ctx, d_lead - o + 1, window)
        i = F.slice(i_ctx, i_lead - o + 1, window)
        return (F.size(d) == window) & (d == i)
    # o words before the fingerprint; o from 0 to both leads
    return F.filter(F.sequence(F.lit(0), F.least(d_lead, i_lead)), same)


def decontaminate(documents: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", k: int = K, window: int = WINDOW,
                  bloom_bits: int = 1 << 24) -> DataFrame:
    """Every row of ``documents`` with ``n_words``, ``n_hit`` (words inside an occurrence of an item's
    window), ``item_ids`` (ids, as strings, of items with occurring windows, sorted), ``contaminated``.

    Columns of ``documents`` other than these are kept as they are.
    """
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and window")
    extra = [c for c in documents.columns if c not in ("n_words", "n_hit", "item_ids", "contaminated", text)]
    # items: equal word sequences are one class
    it = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    norm = F.array_join(F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                                     "abcdefghijklmnopqrstuvwxyz"),
                                         r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != ""), " ")
    it = staged(it.select("item", norm.alias("text")).where("text <> ''")
                .select("item", "text", F.xxhash64("text", F.lit(1)).alias("rid")).distinct(), "items")
    classes = it.select("rid", "text").distinct()
    named_by = staged(it.select(F.col("rid").alias("class"), "item"), "item_classes")
    short = sorted(r[0] for r in classes.select(F.size(F.split("text", " ")).alias("m"))
                   .where(F.col("m") < window).distinct().collect())   # fewer than window values
    cols = ["hash", "pos", "len", "lead", "ctx"]
    prints = (map_batches(classes, _mapper(k, window, short, None, True), _row_schema("text"))
              .select("rid", F.inline(F.arrays_zip(*cols))))
    prints = staged(prints.select(F.col("rid").alias("class"), "hash", "len", F.col("lead").alias("i_lead"),
                                  F.col("ctx").alias("i_ctx")), "item_prints")
    bloom = _bloom(prints, bloom_bits)

    # the other columns travel with the narrow result in one struct, so the text is read once and no name clashes
    keep = F.struct(*[F.col(c) for c in extra]) if extra else F.struct(F.lit(1).alias("_"))
    rows = documents.select(keep.alias("kept"), F.monotonically_increasing_id().alias("rid"), F.col(text).alias("text"))
    found = _scan_documents(rows, k, window, short, bloom)
    cand = (found.select("rid", F.inline(F.arrays_zip(*cols)))
            .withColumn("salt", F.pmod(F.xxhash64("rid", "pos"), F.lit(SALTS)).cast("int")))
    other = prints.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = cand.join(other, ["hash", "len", "salt"])
    full = F.col("len") == window
    wide = _matches(F.col("ctx"), F.col("lead"), F.col("i_ctx"), F.col("i_lead"), window)
    back = F.when(full, wide).when(F.col("ctx") == F.col("i_ctx"), F.array(F.lit(0))).otherwise(F.expr("array()"))
    hits = (met.select("rid", "class", "pos", "len", F.explode(back.cast("array<int>")).alias("o"))
            .select("rid", "class", (F.col("pos") - F.col("o")).alias("at"), "len"))
    hits = staged(hits.distinct(), "hits")
    spans = hits.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("at", "len"))).alias("s"))
    end = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
                      lambda acc, x: F.struct(
                          F.greatest(acc["end"], x["at"] + x["len"]).alias("end"),
                          (acc["n"] + F.greatest(F.lit(0).cast("long"), x["at"] + x["len"]
                                                 - F.greatest(acc["end"], x["at"]))).alias("n")))
    n_hit = spans.select("rid", end["n"].alias("n_hit"))
    named = (hits.select("rid", "class").distinct()
             .join(named_by, "class")
             .groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("item_ids")))
    per = n_hit.join(named, "rid", "left")
    base = found.select("rid", "kept", "n_words")
    out = base.join(per, "rid", "left")
    return out.select(*[F.col("kept")[c].alias(c) for c in extra], "n_words",
                      F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"),
                      (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def keep_clean(documents: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **params) -> DataFrame:
    """``documents`` without the contaminated ones; columns stay as they are.  Only ids and text hashes of
    contaminated rows are joined back."""
    key = free("_key", documents.columns)
    keyed = documents.withColumn(key, F.struct(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("i"),
                                                  F.xxhash64(text).alias("h")))
    judged = decontaminate(keyed.select(key, text), items, text, **params)
    gone = staged(judged.where("contaminated").select(key).distinct(), "contaminated")
    return keyed.join(gone, key, "left_anti").select(*documents.columns)


def _bloom(prints: DataFrame, bits: int) -> bytes:
    """One bitmap of ``bits`` bits (a power of two) over the items' fingerprints: Spark ORs them by
    64-bit word, the driver receives at most ``bits / 64`` rows whatever the tables hold."""
    slot = F.col("hash").bitwiseAND(F.lit(bits - 1))
    rows = (prints.select(F.shiftright(slot, 6).alias("b"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("v"))
            .groupBy("b").agg(F.bit_or("v").alias("v")).toPandas())
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows["b"].to_numpy(dtype=np.int64)] = rows["v"].to_numpy(dtype=np.int64)
    return out.tobytes()


def _scan_documents(rows: DataFrame, k: int, window: int, short: list[int], bloom: bytes) -> DataFrame:
    """One pass over the texts; the result (narrow) is written once, so the row ids hold for all uses."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(bloom)     # bits / 8 bytes by construction
    kept_type = rows.schema["kept"].dataType.simpleString()
    plain = None

    def fn(batch):
        nonlocal plain
        plain = plain or _mapper(k, window, short, shared.value, False)
        kept, at = batch.column("kept"), 0
        sub = pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("text")], ["rid", "text"])
        for cols in plain(sub):
            n = len(cols["rid"])
            yield {**cols, "kept": kept.slice(at, n)}
            at += n
    return staged(map_batches(rows, fn, f"kept {kept_type}, " + _row_schema("text")), "doc_prints")
