"""Operator 11, ranked lexical search over hashed max-sketches.

Index: every document has a sketch of ``ROWS`` rows; each row hashes the document's distinct terms into ``PER_TERM``
coordinates a term and keeps the maximum of what falls together.  What is kept is the term frequency (exact to 128,
rounded up beyond): the impact of a term grows with its frequency at a given document length, so the coordinatewise
maximum of frequencies is the maximum of impacts, and the index needs no corpus statistics.

Search, for a block of queries together: a term's impact in a document is at most that of the least of its ``ROWS``
coordinates, so weighted sums over a query's terms bound its score from above.  The ``SEEDS * k`` documents of the
highest bounds are rescored exactly and their ``k``-th score is a threshold; every document whose bound reaches it is then
rescored, in descending order of bound in each task, until bounds fall under the threshold or the ``k``-th best score
met so far.  Nothing that could rank is skipped: the answers are exact, ties included.

Scale: one pass over the texts writes the index and counts the queried terms' document frequencies; bounds read the
index alone; texts are read again for the rescored documents only, which are picked during the scan by a broadcast of
their keys (by a shuffle join once their list outgrows ``MAX_BYTES``).  Queries travel in blocks of about
``BLOCK_BYTES`` of text; a map task returns at most ``SEEDS * k`` bounds a query.  A document's key is a hash of its id and
text, so rows are told apart without any numbering.  Long texts are cut into sections between words.

Edge cases: null or empty text has no terms and is never found; a query without terms gets no rows; repeated queries
are ranked one by one, repeated document rows are documents of their own; a null id ranks after all others of equal
score; an empty table gives no rows.  Extra columns do not matter and are not returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from kshot.llm.common import Words, lowered, mix, sections, text_runs
from kshot.session import shared_dir, staged

ROWS, PER_TERM = 4, 3
SEEDS = 5
RUN = 1 << 20
BLOCK_BYTES = 1 << 20
MAX_BYTES = 32 << 20
#: Term frequencies by code: exact to 128, then steps of a quarter, so that a code never stands for less.
LEVELS = np.array([*range(129), *(math.ceil(128 * 1.25 ** i) for i in range(1, 128))], dtype=np.int64)
_SEEDS = np.array([0x9E3779B97F4A7C15 * (2 * r + 1) & (1 << 64) - 1 for r in range(ROWS)], dtype=np.uint64)


def _places(hashes: np.ndarray, row: int) -> np.ndarray:
    """32 bits of each term for a row; times the width, shifted by 32, they are its coordinate."""
    return mix(hashes ^ _SEEDS[row]) >> np.uint64(32)


class Queries:
    """A block of queries: the distinct terms, and one entry for each (query, distinct term)."""

    def __init__(self, texts: list[str | None]):
        data = [lowered((t or "").encode()) for t in texts]
        offs = np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64)
        w = Words(np.frombuffer(b"".join(data), np.uint8), offs)
        terms = [bytes(w.data[s:e]) for s, e in zip(w.start, w.end, strict=True)]
        ordered = sorted(dict(zip(terms, w.hash.tolist(), strict=True)).items(), key=lambda x: x[1])
        self.n, self.size = len(texts), len(ordered)
        self.hash = np.array([h for _, h in ordered], dtype=np.uint64)
        if len(np.unique(self.hash)) < self.size:
            raise ValueError("two query terms share a 64-bit hash")
        self.data = np.frombuffer(b"".join(t for t, _ in ordered), np.uint8)
        self.length = np.array([len(t) for t, _ in ordered], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:self.size]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.hash >> np.uint64(48)] = True
        at = {t: i for i, (t, _) in enumerate(ordered)}
        pairs, self.repeats = np.unique(w.doc * max(self.size, 1) + np.array([at[t] for t in terms], dtype=np.int64),
                                        return_counts=True)
        self.query, self.term = pairs // max(self.size, 1), pairs % max(self.size, 1)
        self.asked, self.first = np.unique(self.query, return_index=True)     # queries with terms, their first entry
        self.places = [_places(self.hash, r) for r in range(ROWS)]

    def weigh(self, n_docs: int, n_terms: int, df: dict[int, int]) -> None:
        """Corpus statistics: documents and terms in all, documents by term number."""
        self.n_docs, self.n_terms = n_docs, n_terms
        w = np.zeros(self.size, np.int64)
        for t, d in df.items():
            w[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1)))
        self.weight = self.repeats * w[self.term]

    def length_norm(self, n: int) -> int:
        return 100 - 25 + 25 * n * self.n_docs // self.n_terms

    def total(self, impacts: np.ndarray) -> np.ndarray:
        """Score of every query of ``asked`` from the impacts by term."""
        return np.add.reduceat(impacts[self.term] * self.weight, self.first)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and frequency of the query terms in some texts; words are compared byte by byte."""
        at = np.flatnonzero(self.seen[w.hash >> np.uint64(48)])
        slot = np.minimum(np.searchsorted(self.hash, w.hash[at]), self.size - 1)
        same = (self.hash[slot] == w.hash[at]) & (self.length[slot] == w.end[at] - w.start[at])
        at, slot = at[same], slot[same]
        if len(at):
            size, ends = self.length[slot], np.cumsum(self.length[slot])
            step = np.arange(ends[-1]) - np.repeat(ends - size, size)
            equal = lowered(w.data[np.repeat(w.start[at], size) + step]) == self.data[np.repeat(self.start[slot], size) + step]
            good = np.logical_and.reduceat(equal, ends - size)
            at, slot = at[good], slot[good]
        key, tf = np.unique(w.doc[at] * np.int64(self.size) + slot, return_counts=True)
        return key // self.size, key % self.size, tf


def impact(tf: np.ndarray, norm: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * norm)


def _runs(col: pa.Array) -> Iterator[tuple[int, int, list[Words]]]:
    """Runs of texts as words; one text over ``RUN`` bytes comes as several pieces, cut between words."""
    for a, b, data, offs in text_runs(col, RUN):
        yield a, b, ([Words(part, np.array([0, len(part)])) for part in sections(data, RUN)] if len(data) > RUN
                     else [Words(data, offs)])


def _distinct(parts: list[Words]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and frequency of the distinct terms of each text, texts in order."""
    doc, h = np.concatenate([w.doc for w in parts]), np.concatenate([w.hash for w in parts])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def sketches(parts: list[Words], n_texts: int) -> pa.Array:
    """One sketch per text: ``ROWS`` rows of ``PER_TERM`` coordinates for each distinct term."""
    doc, h, tf = _distinct(parts)
    width = PER_TERM * np.bincount(doc, minlength=n_texts)
    base = np.concatenate(([0], np.cumsum(ROWS * width)))
    code = np.searchsorted(LEVELS, tf).astype(np.uint8)
    order = np.argsort(code, kind="stable")          # of what falls together the last, largest one is written
    doc, h, code = doc[order], h[order], code[order]
    flat = np.zeros(base[-1], np.uint8)
    wide = width[doc].astype(np.uint64)
    for r in range(ROWS):
        at = (_places(h, r) * wide) >> np.uint64(32)
        flat[base[doc] + r * width[doc] + at.astype(np.int64)] = code
    return pa.Array.from_buffers(pa.large_binary(), n_texts, [None, pa.py_buffer(base.astype("<i8").tobytes()),
                                                              pa.py_buffer(flat)]).cast(pa.binary())


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(docs[id_col], docs[text_col])


def scan(docs: DataFrame, block: Queries, id_col: str, text_col: str, with_index: bool = True) -> DataFrame:
    """One written row per document (``key``, ``id``, ``n`` terms, ``sketch``) and, with ``n`` null, the document
    counts of the block's terms by task (``df``).  Without ``with_index`` the counts alone."""
    id_type = docs.schema[id_col].dataType
    schema = StructType([StructField("key", LongType()), StructField("id", id_type), *StructType.fromDDL(
        "n long, sketch binary, df array<struct<term: int, docs: long>>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        df = np.zeros(block.size, np.int64)
        for batch in batches:
            for a, b, parts in _runs(batch.column(2)):
                terms = [block.hits(w)[1] for w in parts]
                df += np.bincount(terms[0] if len(parts) == 1 else np.unique(np.concatenate(terms)), minlength=block.size)
                if with_index:
                    n = sum(w.count for w in parts)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()),
                         sketches(parts, b - a), pa.nulls(b - a, arrow.field("df").type)], schema=arrow)
        at = np.flatnonzero(df)
        counts = pa.array([[{"term": int(t), "docs": int(df[t])} for t in at]], arrow.field("df").type)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, arrow.field(i).type) for i in range(4)), counts], schema=arrow)
        pa.default_memory_pool().release_unused()

    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "search_index")
    rows = docs.select(_key(docs, id_col, text_col).alias("key"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _bounds(batches, block: Queries) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Key, id and bounds (row per document, column per query of ``block.asked``) of some documents at a time."""
    step = max(16, (1 << 21) // len(block.asked))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            out = np.zeros((part.num_rows, len(block.asked)), np.int64)
            for i, (n, raw) in enumerate(zip(part.column(2).to_pylist(), part.column(3), strict=True)):
                flat = np.frombuffer(raw.as_buffer(), np.uint8)
                width = len(flat) // ROWS
                if not width:
                    continue
                wide, found, code = np.uint64(width), np.arange(block.size), None
                for r in range(ROWS):
                    own = flat[r * width:(r + 1) * width][(block.places[r][found] * wide) >> np.uint64(32)]
                    code = own if code is None else np.minimum(code, own)
                    keep = code > 0
                    found, code = found[keep], code[keep]
                impacts = np.zeros(block.size, np.int64)
                impacts[found] = impact(LEVELS, block.length_norm(n))[code]
                out[i] = block.total(impacts)
            yield part.column(0), part.column(1), out


def highest_bounds(index: DataFrame, block: Queries, k: int) -> DataFrame:
    """``key``, ``id``, ``query``, ``bound``: of every map task the ``k`` highest bounds of each query."""
    id_type = index.schema["id"].dataType
    schema = StructType([StructField("key", LongType()), StructField("id", id_type),
                         *StructType.fromDDL("query int, bound long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        keys, ids, best = None, None, None     # of each query the best so far: row numbers into keys and ids
        for key, ident, new in _bounds(batches, block):
            if best is None:
                keys, ids, at, best = key, ident, np.tile(np.arange(len(new))[:, None], (1, new.shape[1])), new
            else:
                at = np.concatenate((at, np.tile(len(keys) + np.arange(len(new))[:, None], (1, new.shape[1]))))
                keys, ids, best = pa.concat_arrays([keys, key]), pa.concat_arrays([ids, ident]), np.concatenate((best, new))
            if len(best) > k:
                top = np.argpartition(-best, k - 1, axis=0)[:k]
                at, best = np.take_along_axis(at, top, 0), np.take_along_axis(best, top, 0)
            used, at = np.unique(at, return_inverse=True)
            keys, ids, at = keys.take(pa.array(used)), ids.take(pa.array(used)), at.reshape(best.shape)
        if best is not None:
            row, col = np.nonzero(best)
            rows = pa.array(at[row, col])
            yield pa.RecordBatch.from_arrays([keys.take(rows), ids.take(rows), pa.array(block.asked[col], pa.int32()),
                                              pa.array(best[row, col])], schema=arrow)
    return index.mapInArrow(run, schema)


def reaching(index: DataFrame, block: Queries, least: np.ndarray) -> DataFrame:
    """``key``, ``id``, ``asked`` (queries), ``bounds`` of every document that reaches a query's threshold."""
    id_type = index.schema["id"].dataType
    schema = StructType([StructField("key", LongType()), StructField("id", id_type),
                         *StructType.fromDDL("asked array<int>, bounds array<long>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for key, ident, bounds in _bounds(batches, block):
            row, col = np.nonzero((bounds > 0) & (bounds >= least))
            rows, count = np.unique(row, return_counts=True)
            offs = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(rows)), ident.take(pa.array(rows)),
                 pa.ListArray.from_arrays(offs, pa.array(block.asked[col], pa.int32())).cast(arrow.field("asked").type),
                 pa.ListArray.from_arrays(offs, pa.array(bounds[row, col])).cast(arrow.field("bounds").type)], schema=arrow)
    return index.mapInArrow(run, schema)


def rescore(docs: DataFrame, picked: DataFrame, block: Queries, k: int, id_col: str, text_col: str) -> DataFrame:
    """Exact scores (``id``, ``query``, ``score``) of the documents in ``picked(key, id, asked, bounds)``, a task's
    highest bounds first; a bound under the ``k``-th best score that the task has met is not looked at."""
    id_type = docs.schema[id_col].dataType
    schema = StructType([StructField("id", id_type), *StructType.fromDDL("query int, score long").fields])
    arrow = to_arrow_schema(schema)
    column = np.full(block.n, -1)
    column[block.asked] = np.arange(len(block.asked))

    def run(batches):
        best: dict[int, list[int]] = {}
        for batch in batches:
            asked, bounds = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i in range(batch.num_rows):
                open_ = [q for q, b in zip(asked[i], bounds[i], strict=True) if len(best.get(q, ())) < k or b >= best[q][-1]]
                if not open_:
                    continue
                n, tf = 0, np.zeros(block.size, np.int64)
                for _, _, parts in _runs(batch.column(1).slice(i, 1)):
                    for w in parts:
                        n += len(w.hash)
                        _, term, times = block.hits(w)
                        tf[term] += times
                scores = block.total(impact(tf, block.length_norm(n)))[column[open_]]
                for q, s in zip(open_, scores.tolist(), strict=True):
                    best[q] = sorted([*best.get(q, []), s], reverse=True)[:k]
                at = np.flatnonzero(scores > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(at), np.int64))),
                     pa.array(np.array(open_)[at], pa.int32()), pa.array(scores[at])], schema=arrow)
        pa.default_memory_pool().release_unused()

    size = picked.agg(F.coalesce(F.sum(F.size("asked") * 12 + 64), F.lit(0))).first()[0]
    side = F.broadcast(picked) if size <= MAX_BYTES else picked
    rows = docs.select(_key(docs, id_col, text_col).alias("_k"), docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    met = rows.join(side, (F.col("_k") == F.col("key")) & F.col("_id").eqNullSafe(F.col("id")))
    return met.select("_id", "_text", "asked", "bounds", F.array_max("bounds").alias("top")).sortWithinPartitions(
        F.desc("top")).mapInArrow(run, schema)


def _search_block(docs: DataFrame, index: DataFrame, block: Queries, k: int, id_col: str, text_col: str) -> DataFrame:
    """``query``, ``rank``, ``id``, ``score`` of one block."""
    best_first = Window.partitionBy("query").orderBy(F.desc("bound"), "key")
    first = SEEDS * k
    seeds = staged(highest_bounds(index, block, first).withColumn("r", F.row_number().over(best_first)).where(F.col("r") <= first)
                   .groupBy("key", "id").agg(F.collect_set("query").alias("asked"), F.max("bound").alias("bound"))
                   .select("key", "id", "asked", F.transform("asked", lambda _: F.col("bound")).alias("bounds")),
                   "search_seeds")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = rescore(docs, seeds, block, k, id_col, text_col).withColumn("rank", F.row_number().over(by_score))
    least = np.zeros(block.n, np.int64)
    for q, s in ranked.where(F.col("rank") == k).select("query", "score").collect():     # one row a query
        least[q] = s
    picked = staged(reaching(index, block, least[block.asked]), "search_picked").dropDuplicates(["key", "id"])
    scored = rescore(docs, picked, block, k, id_col, text_col)
    return scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_col``, ``rank``, ``id_col``, ``score`` of the ``k`` best documents of every row of ``items``."""
    spark = docs.sparkSession
    queries = staged(items.select(items[item_col].alias("item"), items[item_text].alias("body"),
                                  F.monotonically_increasing_id().alias("row")), "search_items")
    total = queries.agg(F.sum(F.octet_length("body") + 16)).first()[0] or 0
    n_blocks = -(-total // block_bytes)
    out, index, n_docs, n_terms = [], None, 0, 0
    for b in range(n_blocks):
        mine = queries.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b).orderBy("row").collect()  # about block_bytes
        block = Queries([r["body"] for r in mine])
        if not block.size:
            continue
        seen = scan(docs, block, id_col, text_col, with_index=index is None)
        if index is None:
            index = seen.where(F.col("n").isNotNull()).drop("df")
            n_docs, n_terms = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_terms:
            break
        df = seen.where(F.col("n").isNull()).select(F.explode("df").alias("d")).groupBy("d.term").agg(F.sum("d.docs"))
        block.weigh(n_docs, n_terms, {t: d for t, d in df.collect()})               # one row a query term
        named = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(mine)], StructType(
            [StructField("query", LongType()), StructField("item", queries.schema["item"].dataType)]))
        found = _search_block(docs, index, block, k, id_col, text_col).join(F.broadcast(named), "query")
        out.append(found.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"),
                                F.col("id").alias(id_col), "score"))
    if not out:
        kinds = f"{queries.schema['item'].dataType.simpleString()}, rank int, {id_col} " \
                f"{docs.schema[id_col].dataType.simpleString()}, score long"
        return spark.createDataFrame([], f"{item_col} {kinds}")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
