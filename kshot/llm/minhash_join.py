"""Operator 10, n-gram Jaccard join by MinHash banding with exact verification.

A document is the set of its ``n``-word shingles (a text of 1 to ``n - 1`` words has one shingle: all its
words).  Documents with equal sets are one *node*.  ``bands`` x ``rows`` MinHash values are chosen for the
target recall at the threshold; nodes meet where a band agrees, and every such pair is verified on the full
sets: Jaccard >= ``threshold``.  Pairs are never rows: a bucket is cut into blocks of bounded size, a task
gets two blocks, verifies all their pairs with numpy and returns one row per member (its number of links
and the least node it is connected to).  A pair that agrees in several bands is counted in the first only;
a bucket whose members all agree in one earlier band is skipped as a whole.

Result: one row per document with ``class_id`` (the least doc_id of its connected group), ``n_links``
(documents at Jaccard >= threshold, copies included) and ``class_root`` (the least node of the group).  Ids
that are null or repeat can give several groups one ``class_id``; ``class_root`` always tells them apart.  No
cap on buckets, partners or candidates.

Edge cases: a text without words links to nothing and is its own class, without a root; null ids take part like others but
never name a class that has an id; repeated rows are copies of each other; extra columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kshot.llm.common import Words, free, map_batches, mix, text_runs
from kshot.session import staged

N, THRESHOLD, RECALL = 5, 0.8, 0.9995
BLOCK = 256
NODE = "decimal(38,0)"


def choose_bands(threshold: float, recall: float, max_hashes: int = 80) -> tuple[int, int]:
    """``(bands, rows)`` with the most rows per band (fewest false candidates) whose probability
    ``1 - (1 - threshold ** rows) ** bands`` reaches ``recall`` within ``max_hashes`` values."""
    best = None
    for rows in range(1, max_hashes + 1):
        miss = 1 - threshold ** rows
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log(miss)))) if miss > 0 else 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band layout reaches the recall within max_hashes")
    return best


def _shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, concatenated, with text offsets."""
    g, ok = words.grams(n)
    n_docs = len(words.count)
    per = []
    small = {m: words.grams(m)[0] for m in range(1, n) if (words.count == m).any()}
    for d in range(n_docs):
        c, a = words.count[d], words.first[d]
        if c >= n:
            per.append(np.unique(g[a:a + c - n + 1]))
        elif c:
            per.append(mix(small[c][a:a + 1] + np.uint64(c)))
        else:
            per.append(g[:0])
    off = np.concatenate(([0], np.cumsum([len(x) for x in per]))).astype(np.int64)
    return (np.concatenate(per) if per else g[:0]), off


def _nodes(sh: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """128-bit name of each non-empty set, as a decimal column (null for an empty set)."""
    full = np.flatnonzero(np.diff(off))
    lo, hi = np.zeros(len(off) - 1, np.uint64), np.zeros(len(off) - 1, np.uint64)
    if len(full):
        starts = off[:-1][full]
        lo[full] = mix(np.add.reduceat(mix(sh + np.uint64(0xA5A5)), starts))
        hi[full] = mix(np.add.reduceat(mix(sh ^ np.uint64(0x5C5C5C5C)), starts)) >> np.uint64(2)
    raw = np.stack([lo, hi], axis=1).tobytes()
    some = np.zeros(len(off) - 1, bool)
    some[full] = True
    valid = pa.array(some).buffers()[1]
    return full, pa.Array.from_buffers(pa.decimal128(38, 0), len(off) - 1, [valid, pa.py_buffer(raw)])


def _signer(n: int, bands: int, rows: int):
    rng = np.random.default_rng(20_231)
    mul = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def fn(batch):
        for a, b, data, offs in text_runs(batch.column("text")):
            sh, off = _shingles(Words(data, offs), n)
            full, node = _nodes(sh, off)
            cols = {"kept": batch.column("kept").slice(a, b - a), "node": node}
            for i in range(bands):
                key = np.zeros(b - a, np.uint64)
                if len(full):
                    k = np.full(len(full), i + 1, np.uint64)
                    for j in range(i * rows, (i + 1) * rows):
                        low = np.minimum.reduceat(sh * mul[j] + add[j], off[:-1][full])
                        k = mix(k * np.uint64(0x9E3779B97F4A7C15) + low)
                    key[full] = k
                cols[f"b{i}"] = key.view(np.int64)
            yield cols
    return fn


def _set_rows(n: int):
    def fn(batch):
        for a, b, data, offs in text_runs(batch.column("text")):
            sh, off = _shingles(Words(data, offs), n)
            full, node = _nodes(sh, off)
            names = node.take(pa.array(full))
            once = {x: i for i, x in zip(full[::-1], names.to_pylist()[::-1])}   # copies of a batch once
            yield {"node": pa.array(list(once), pa.decimal128(38, 0)),
                   "shingles": [sh[off[i]:off[i + 1]].tobytes() for i in once.values()]}
    return fn


def _linked(sets: list[np.ndarray], cand: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the candidate pairs whose Jaccard similarity reaches the threshold."""
    size = np.array([len(s) for s in sets])
    cand = cand & (np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size) - 1e-9)
    use = np.flatnonzero(cand.any(axis=0) | cand.any(axis=1))
    out = np.zeros_like(cand)
    if not len(use):
        return out
    cand_u, size_u = cand[np.ix_(use, use)], size[use]
    flat = np.concatenate([sets[i] for i in use])
    _, inv, cnt = np.unique(flat, return_inverse=True, return_counts=True)
    multi = cnt >= 2                                   # a shingle of one member is in no intersection
    col = np.cumsum(multi) - 1
    who = np.repeat(np.arange(len(use)), size_u)
    sel = multi[inv]
    who, col = who[sel], col[inv[sel]]
    m = int(multi.sum())
    a, b = np.nonzero(cand_u)
    if len(a) * 15e-6 < len(use) ** 2 * m * 1e-10 + 1e-4:
        shared = np.array([len(np.intersect1d(sets[use[x]], sets[use[y]], assume_unique=True)) for x, y in zip(a, b)])
    else:
        order = np.argsort(col, kind="stable")
        who, col = who[order], col[order]
        inter = np.zeros((len(use), len(use)), np.float32)
        for lo in range(0, m, 4096):
            x, y = np.searchsorted(col, (lo, lo + 4096))
            block = np.zeros((len(use), min(4096, m - lo)), np.float32)
            block[who[x:y], col[x:y] - lo] = 1
            inter += block @ block.T
        shared = inter[a, b].astype(np.int64)
    union = size_u[a] + size_u[b] - shared
    hit = shared >= threshold * union - 1e-9
    out[use[a[hit]], use[b[hit]]] = True
    return out


def _verify(bands: int, threshold: float):
    """One unit (two blocks of a bucket): links of each member inside the unit, counted where this band is
    the pair's first common one, and the least member that it is connected to."""
    def fn(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        band, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        names = t.column("node").to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        names = [names[x] for x in order]
        t = t.take(order)
        sig = np.stack([t.column(f"b{x}").to_numpy() for x in range(bands)], axis=1)
        blk, n_docs = t.column("blk").to_numpy(), t.column("n_docs").to_numpy()
        cand = np.triu(np.ones((len(names), len(names)), bool), 1)
        if i != j:
            cand &= blk[:, None] != blk[None, :]
        for x in range(band):
            cand &= sig[:, x][:, None] != sig[:, x][None, :]
        out_n, out_d, out_r = [], [], []
        if cand.any():
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles").combine_chunks()]
            link = _linked(sets, cand, threshold)
            link |= link.T
            deg = link @ n_docs
            root = np.arange(len(names))
            while True:                                # least member of each local component
                near = np.where(link, root[None, :], len(names)).min(axis=1, initial=len(names))
                new = np.minimum(root, near)
                new = new[new]
                if (new == root).all():
                    break
                root = new
            for x in np.flatnonzero(deg):
                out_n.append(names[x]), out_d.append(int(deg[x])), out_r.append(names[root[x]])
        dec = pa.decimal128(38, 0)
        return pa.table({"node": pa.array(out_n, dec), "links": pa.array(out_d, pa.int64()), "root": pa.array(out_r, dec)})
    return fn


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the least node of the connected component of every node of ``edges(a, b)``.

    Minimum labels with pointer jumping; every round is written to the shared folder, the driver sees one
    count per round.
    """
    both = staged(edges.where("a <> b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    lab = staged(both.groupBy("a").agg(F.min("b").alias("m"))
                 .select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = (both.join(lab.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near")))
        step = (lab.join(near.withColumnRenamed("a", "node"), "node")
                .select("node", F.col("root").alias("was"), F.least("root", "near").alias("to")))
        jump = lab.select(F.col("node").alias("to"), F.col("root").alias("far"))
        new = staged(step.join(jump, "to", "left")
                     .select("node", "was", F.least("to", "far").alias("root")), "labels")
        if not new.where("root <> was").limit(1).count():
            return new.select("node", "root")
        lab = new.select("node", "root")


def near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N,
                    threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Every row of ``documents`` without its text, plus ``class_id``, ``n_links`` and ``class_root``."""
    bands, rows = choose_bands(threshold, recall)
    names = [f"b{i}" for i in range(bands)]
    extra = [c for c in documents.columns if c not in (text, "class_id", "n_links", "class_root")]
    src = documents.select(F.struct(*extra).alias("kept"), F.col(text).alias("text"))
    th = free("_th", extra)
    src = src.withColumn("kept", F.struct(*[F.col("kept")[c].alias(c) for c in extra], F.xxhash64("text").alias(th)))
    kept_type = src.schema["kept"].dataType.simpleString()
    docs = staged(map_batches(src, _signer(n, bands, rows),
                              f"kept {kept_type}, node {NODE}, " + ", ".join(f"{x} long" for x in names)), "signatures")
    ident = F.col("kept")[doc_id]
    nodes = staged(docs.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min(ident).alias("least"), F.min(F.col("kept")[th]).alias("th"),
        *[F.max(x).alias(x) for x in names]), "nodes")

    where = nodes.select("node", F.posexplode(F.array(*names)).alias("band", "key"))
    # small tables are written before they meet the wide side, so that AQE can split a hot key of it
    multi = staged(where.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = where.join(multi, ["band", "key"])
    members = staged(members.join(nodes.select("node", "n_docs", "th", *names), "node"), "members")
    # skip a bucket whose members all agree in one earlier band: that bucket holds all its pairs
    agree = staged(members.groupBy("band", "key").agg(
        F.greatest(*[((F.min(x) == F.max(x)) & (F.first("band") > i)).cast("int") for i, x in enumerate(names)],
                   F.lit(0)).alias("seen")).where("seen = 0").select("band", "key"), "unseen")
    todo = members.join(agree, ["band", "key"])
    n_blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    todo = (todo.withColumn("blk", F.pmod(F.xxhash64("node", F.lit(3)), n_blocks).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
            .select("node", "n_docs", "band", "key", "blk", F.least("blk", "other").alias("i"),
                    F.greatest("blk", "other").alias("j"), *names))

    # full sets of the members only: texts whose hash is that of a member's representative
    want = staged(members.select("th").distinct(), "wanted")
    texts = documents.select(F.xxhash64(text).alias("th"), F.col(text).alias("text")).join(want, "th", "left_semi")
    sets = (map_batches(texts.select("text"), _set_rows(n), f"node {NODE}, shingles binary")
            .groupBy("node").agg(F.first("shingles").alias("shingles")))
    units = todo.join(sets, "node")
    found = staged(units.groupBy("band", "key", "i", "j").applyInArrow(
        _verify(bands, threshold), f"node {NODE}, links long, root {NODE}"), "links")

    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per = nodes.select("node", "n_docs", "least").join(links, "node", "left").join(comp, "node", "left")
    per = per.withColumn("root", F.coalesce("root", "node"))
    # only groups of several nodes need the least id over their nodes
    group = staged(per.where("links is not null").groupBy("root").agg(F.min("least").alias("first")), "groups")
    per = per.join(group, "root", "left").select(
        "node", F.coalesce("first", "least").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"), F.col("root").alias("class_root"))
    # written, so that AQE can split a node that many documents share
    out = docs.select("kept", "node").join(staged(per, "classes"), "node", "left")
    return out.select(*[F.col("kept")[c].alias(c) for c in extra],
                      F.coalesce("class_id", ident).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "class_root")


def keep_one(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **params) -> DataFrame:
    """``documents`` with one row of every near-duplicate class: that with the least id (the least text
    hash and one of equal rows if ids repeat).  Columns stay as they are; the text never travels through
    the join's shuffles, rows are found again by id and text hash."""
    cols = documents.columns
    key = free("_key", [*cols, "class_id", "n_links", "class_root"])
    keyed = documents.withColumn(key, F.struct(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("i"),
                                                  F.xxhash64(text).alias("h")))
    judged = near_duplicates(keyed.select(doc_id, key, text), text, doc_id, **params)
    alone = F.col("n_links") == 0
    # rows without links stand for themselves; a class of several is cut to its least (id, hash); the root
    # names the class, as ids may be null or repeat
    grouped = (judged.where(~alone).groupBy("class_root")
               .agg(F.min(F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("d"),
                                   F.col(key).alias("k"))).alias("m")).select(F.col("m.k").alias(key)))
    drop = (judged.where(~alone).select(key).distinct()
            .join(grouped.withColumn("stay", F.lit(1)), key, "left").where("stay is null").select(key))
    out = keyed.join(drop, key, "left_anti")
    again = staged(judged.where(~alone).groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
                   .select(key), "repeated")
    if again.limit(1).count():      # equal id and text in several rows: one of them
        rest = out.join(again, key, "left_anti")
        once = out.join(again, key, "left_semi").dropDuplicates([key])
        out = rest.unionByName(once)
    return out.select(*cols)
