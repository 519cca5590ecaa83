"""Exact nearest support for any number of classes (F1, D11, F5, K1): block kernels, pivots, chunks bounded in bytes.

Support vectors under ``MAX_BYTES`` go to every task once as a matrix; queries stream past it in Arrow batches, so there
are no query x support rows and no shuffle.  For the L1 distance the matrix is ordered by pivots: every support belongs
to the cell of its nearest pivot and cells are sorted by that distance.  With the best distance ``u`` found so far, the
triangle inequality leaves of a cell only the supports whose distance to its pivot is within ``u`` of the query's, and of
these only those within ``u`` of the query at ``TABLE`` more pivots; just those are compared.

More supports are dealt into chunks under ``MAX_BYTES``, by pivot cell, a large cell by hash into several.  A bounded
sample of the supports gives each query an upper bound; the query travels only to chunks whose ring of pivot distances
comes within that bound, meets each with its own pivots there, and a partial maximum per query finishes.  Neighbouring
chunks share a shelf of ``MAX_BYTES``, to which a query travels once.  Queries of a shelf are dealt over as many tasks as
their bytes and pairs ask for, so neither a hot cell nor a hot chunk gathers in one task.

Equal distances go to the lowest class index.  A query without any defined pair gets the lowest class index and the score
``-inf``.  Vectors that are not finite (or beyond 1e100) are compared
with all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from kshot.functions.blocks import cosine_block, l1_block, l1_least, l1_rows, matrices
from kshot.functions.vectors import cosine_similarity, manhattan_similarity
from kshot.session import staged

MAX_BYTES = 32 << 20
PIVOTS = 256             # cells at most
TABLE = 16               # pivots, the first, whose distances to all supports are kept
PROBE = 32               # supports compared for a first bound
SAMPLE = 4096
FEW = 256                # up to so many supports are compared without pivots
TRIAL = 16               # queries that show how many supports the pivots leave
WEAK = 0.25              # above this share the others are compared with all, in blocks
PAIRS = 1 << 27          # (query, support) pairs of a task
LEAST = 1 << 22          # so many pairs are worth every core
SCAN = 1 << 20           # numbers of a matrix of queries against supports or chunks
_SLACK = 1e-9            # share of the distances by which rounding may break the triangle inequality
FOUND = "rank double, class_idx int, compared long"


@dataclass(frozen=True)
class Kernel:
    """``rank`` of every query against every support (higher is nearer), the score from it, whether L1 bounds hold."""

    rank: Callable[[np.ndarray, np.ndarray], np.ndarray]
    score: Callable[[Column], Column]
    is_l1: bool = False


def _nearness(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    return -l1_block(q, s)


def _cosine(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    return cosine_block(q, s).filled(-np.inf)


def _itself(rank: Column) -> Column:
    return rank


#: Scorers that run in blocks (named functions: kernels are sent to the workers).
KERNELS: dict[Callable, Kernel] = {manhattan_similarity: Kernel(_nearness, F.exp, True),
                                   cosine_similarity: Kernel(_cosine, _itself)}


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each the farthest from those before it."""
    picked, far = [0], l1_rows(vectors, vectors[:1])
    while len(picked) < n and far.max() > 0:
        picked.append(int(np.argmax(far)))
        far = np.minimum(far, l1_rows(vectors, vectors[picked[-1]:picked[-1] + 1]))
    return vectors[picked]


def _tame(m: np.ndarray) -> np.ndarray:
    """Rows whose distances are finite numbers."""
    return (np.abs(m) < 1e100).all(axis=1)


class Cells:
    """Supports of one length ordered by nearest pivot and distance to it, with their distances to ``TABLE`` pivots."""

    def __init__(self, vectors: np.ndarray, classes: np.ndarray):
        some = vectors[:: max(1, -(-len(vectors) // SAMPLE))]
        self.pivots = choose_pivots(some, min(PIVOTS, int(np.sqrt(len(vectors)))))
        cell, ring = np.empty(len(vectors), np.int64), np.empty(len(vectors))
        table = np.empty((len(vectors), min(TABLE, len(self.pivots))))
        for a in range(0, len(vectors), SAMPLE):
            near = l1_block(vectors[a:a + SAMPLE], self.pivots)
            cell[a:a + SAMPLE], ring[a:a + SAMPLE] = np.argmin(near, axis=1), near.min(axis=1)
            table[a:a + SAMPLE] = near[:, :table.shape[1]]
        order = np.lexsort((ring, cell))
        self.vectors, self.classes, self.table, self.ring = vectors[order], classes[order], table[order], ring[order]
        self.start = np.searchsorted(cell[order], np.arange(len(self.pivots) + 1))

    def _compare(self, rows: np.ndarray, vec: np.ndarray, best: float, best_class: int) -> tuple[float, int]:
        d = l1_rows(self.vectors[rows], vec)
        least = d.min()
        if least > best:
            return best, best_class
        klass = self.classes[rows[d == least]].min()
        return least, klass if least < best or best_class < 0 else min(klass, best_class)

    def nearest(self, q: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least distance at most ``upper``, lowest class at it (-1: none), and the number of supports compared.

        A few queries show what the pivots save; where that is little, the rest meet all supports in blocks of rounded
        numbers, at a fraction of the time a distance (``l1_least``)."""
        first = self._pruned(q[:TRIAL], upper[:TRIAL])
        rest = q[TRIAL:]
        if not len(rest):
            return first
        weak = first[2].sum() > WEAK * len(self.vectors) * TRIAL
        more = (self._scanned if weak else self._pruned)(rest, upper[TRIAL:])
        return tuple(np.concatenate(x) for x in zip(first, more, strict=True))

    def _scanned(self, q: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dist, classes = upper.copy(), np.full(len(q), -1)
        least, near = l1_least(q, self.vectors, self.classes)
        found = least <= upper
        dist[found], classes[found] = least[found], near[found]
        return dist, classes, np.full(len(q), len(self.vectors), np.int64)

    def _pruned(self, q: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dist, classes, compared = upper.copy(), np.full(len(q), -1), np.zeros(len(q), np.int64)
        to_pivots = l1_block(q, self.pivots)
        for i, (vec, near) in enumerate(zip(q, to_pivots, strict=True)):
            best, best_class = upper[i], -1
            slack = _SLACK * (1 + near.max() + (best if np.isfinite(best) else 0))
            known = near[:self.table.shape[1]]
            for c in np.argsort(near, kind="stable"):
                a, b = self.start[c], self.start[c + 1]
                ring, reach = self.ring[a:b], best + slack
                a, b = a + np.searchsorted(ring, near[c] - reach), a + np.searchsorted(ring, near[c] + reach, side="right")
                if a >= b:
                    continue
                gap = np.abs(self.table[a:b] - known).max(axis=1)
                if best_class < 0 and b - a > PROBE:
                    probe = np.argpartition(gap, PROBE)[:PROBE]
                    best, best_class = self._compare(a + probe, vec, best, best_class)
                    compared[i] += PROBE
                    gap[probe] = np.nan
                rows = a + np.flatnonzero(gap <= best + slack)
                if len(rows):
                    best, best_class = self._compare(rows, vec, best, best_class)
                    compared[i] += len(rows)
            dist[i], classes[i] = best, best_class
        return dist, classes, compared


def keep_better(rank: np.ndarray, classes: np.ndarray, at: np.ndarray, r: np.ndarray, found: np.ndarray) -> None:
    """Put the answers ``r``, ``found`` in place where they are nearer, or as near with a lower class."""
    # NaN counts as the greatest rank, as in Spark
    old, new = np.nan_to_num(rank[at], nan=np.inf), np.nan_to_num(r, nan=np.inf)
    better = (found >= 0) & ((classes[at] < 0) | (new > old) | ((new == old) & (found < classes[at])))
    rank[at[better]], classes[at[better]] = r[better], found[better]


class Supports:
    """Support vectors of any lengths in memory: pivot cells where they pay, plain matrices else."""

    def __init__(self, vectors: pa.Array, classes: np.ndarray, kernel: Kernel):
        self.kernel, self.cells, self.plain = kernel, {}, {}
        for rows, m in matrices(vectors):
            own = classes[rows]
            finite = _tame(m)
            ordered = bool(kernel.is_l1 and finite.sum() > FEW)
            if ordered:
                self.cells[m.shape[1]] = Cells(m[finite], own[finite])
            rest = ~finite if ordered else np.ones(len(own), bool)
            order = np.flatnonzero(rest)[np.argsort(own[rest], kind="stable")]       # the first maximum is the lowest class
            self.plain[m.shape[1]] = (m[order], own[order])

    def nearest(self, vectors: pa.Array, upper: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``rank``, ``class_idx`` (-1: none) and ``compared`` of each query; supports under ``-upper`` need not be found."""
        n = len(vectors)
        rank, classes, compared = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, np.int64)
        for rows, q in matrices(vectors):
            m, own = self.plain.get(q.shape[1], (None, ()))
            if len(own):
                step = max(1, (1 << 20) // len(own))
                for a in range(0, len(rows), step):
                    r, at = self.kernel.rank(q[a:a + step], m), rows[a:a + step]
                    first = np.argmax(r, axis=1)
                    rank[at], classes[at] = r[np.arange(len(at)), first], own[first]
                compared[rows] += len(own)
            cells = self.cells.get(q.shape[1])
            if cells is None:
                continue
            finite = _tame(q)
            for at, part in ((rows[finite], q[finite]), (rows[~finite], q[~finite])):
                if not len(at):
                    continue
                if _tame(part).all():
                    limit = np.full(len(at), np.inf) if upper is None else upper[at]
                    # a tie with what is known so far must be seen, so the limit is not below it
                    limit = np.where(classes[at] >= 0, np.minimum(limit, -rank[at]), limit)
                    limit = np.where(np.isnan(limit), np.inf, limit)
                    d, found, seen = cells.nearest(part, limit)
                    r = -d
                else:
                    order = np.argsort(cells.classes, kind="stable")
                    all_ranks = self.kernel.rank(part, cells.vectors[order])
                    first = np.argmax(all_ranks, axis=1)
                    r, found = all_ranks[np.arange(len(at)), first], cells.classes[order][first]
                    seen = np.full(len(at), len(order))
                compared[at] += seen
                keep_better(rank, classes, at, r, found)
        return rank, classes, compared


def _free(name: str, columns: list[str]) -> str:
    while name in columns:
        name = "_" + name
    return name


def vector_bytes(df: DataFrame, vec: str) -> int:
    """Bytes of a vector column as doubles, with the array headers."""
    return df.agg(F.coalesce(F.sum(F.coalesce(F.size(vec), F.lit(0)).cast("long") * 8 + 24), F.lit(0))).first()[0]


def row_bytes(df: DataFrame, vec: str) -> int:
    """Bytes of the largest vector as doubles."""
    return (df.agg(F.max(F.size(vec))).first()[0] or 0) * 8 + 24


def write_support(support: DataFrame, vec: str = "vec") -> DataFrame:
    return staged(support.select(F.col("class_idx").cast("int").alias("class_idx"), F.col(vec).alias("vec")), "support")


def _gather(rows: DataFrame, kernel: Kernel) -> Supports:
    table = rows.toArrow()
    return Supports(table["vec"].combine_chunks(), table["class_idx"].to_numpy(), kernel)


def _beside(df: DataFrame, fn, vec: str, names: list[str], kinds: str) -> DataFrame:
    """``df`` with columns ``fn(vectors)`` of type ``kinds`` beside it, batch by batch."""
    extra = StructType.fromDDL(kinds)
    schema = StructType(df.schema.fields + [type(f)(n, f.dataType) for n, f in zip(names, extra, strict=True)])
    arrow, at = to_arrow_schema(schema), df.columns.index(vec)

    def run(batches):
        for b in batches:
            cols = fn(b.column(at))
            made = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                    for c, f in zip(cols, list(arrow)[len(b.columns):], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=arrow.names)
    return df.mapInArrow(run, schema)


def rank_broadcast(queries: DataFrame, supports: DataFrame, kernel: Kernel, query_vec: str, names: list[str]) -> DataFrame:
    """``queries`` (batch or stream) with ``rank``, ``class_idx``, ``compared`` under ``names``; supports to every task."""
    held = queries.sparkSession.sparkContext.broadcast(_gather(supports, kernel))
    return _beside(queries, lambda v: held.value.nearest(v), query_vec, names, FOUND)


def _deal(supports: DataFrame, kernel: Kernel, max_bytes: int) -> tuple[DataFrame, Supports, np.ndarray, list]:
    """Supports with their ``chunk``; a bounded sample of them; the pivots; (pivot, least, greatest ring distance) by
    chunk, pivot -1 for chunks that every query visits."""
    size = F.coalesce(F.size("vec"), F.lit(0))
    widest = supports.agg(F.max(size)).first()[0] or 1
    few = max(1, min(SAMPLE, max_bytes // (8 * max(1, widest))))
    some = supports.orderBy(F.xxhash64("vec", "class_idx")).limit(few)
    sample = _gather(some, kernel)
    table = some.toArrow()["vec"]
    whole = max(((m[_tame(m)]) for _, m in matrices(table)), key=len, default=np.zeros((0, 0)))
    pivots = choose_pivots(whole, PIVOTS) if kernel.is_l1 and len(whole) and whole.shape[1] else np.zeros((0, 0))
    sc = supports.sparkSession.sparkContext
    held = sc.broadcast(pivots)

    def cell_of(vectors):
        cell, ring, p = np.full(len(vectors), -1), np.zeros(len(vectors)), held.value
        for rows, m in matrices(vectors):
            if len(p) and m.shape[1] == p.shape[1]:
                near, ok = l1_block(m, p), _tame(m)
                cell[rows[ok]] = np.argmin(near[ok], axis=1)
                ring[rows[ok]] = near[ok].min(axis=1)
        return cell, ring
    celled = staged(_beside(supports, cell_of, "vec", ["cell", "ring"], "cell int, ring double"), "support_cells")
    cells = celled.groupBy("cell").agg(F.sum(size.cast("long") * 8 + 24).alias("bytes")).collect()     # one row a pivot
    first, table = 0, []
    for c in sorted(cells, key=lambda r: r["cell"]):
        table.append((c["cell"], first, n := -(-c["bytes"] // max_bytes)))
        first += n
    # a cell is cut by ring distance, so that its chunks are narrow; equal distances are dealt by hash
    most = max((n for c, _, n in table if c >= 0), default=1)
    cuts = {}
    if most > 1:
        grid = [i / most for i in range(1, most)]
        rings = celled.where(F.col("cell") >= 0).groupBy("cell").agg(F.percentile_approx("ring", grid, max(10_000, 10 * most)).alias("q"))
        rings = {r["cell"]: r["q"] for r in rings.collect()}                                # a row a pivot
        for c, _, n in table:
            if n > 1 and c >= 0:
                x = np.array([rings[c][round(i * most / n) - 1] for i in range(1, n)])
                cuts[c] = x if len(np.unique(x)) == len(x) else None
    where = sc.broadcast({c: (at, n, cuts.get(c)) for c, at, n in table})
    celled_names = [*celled.columns, "chunk"]
    at_cell, at_ring = celled.columns.index("cell"), celled.columns.index("ring")

    def place(batches):
        for b in batches:
            cell, ring = b.column(at_cell).to_numpy(), b.column(at_ring).to_numpy()
            hashed, chunk = b.column(len(b.columns) - 1).to_numpy(), np.empty(len(b), np.int32)
            for c in np.unique(cell).tolist():
                rows, (first, n, x) = np.flatnonzero(cell == c), where.value[c]
                chunk[rows] = first + (np.searchsorted(x, ring[rows]) if x is not None else hashed[rows] % n)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(chunk)], names=celled_names)
    hashed = celled.withColumn("hash", F.pmod(F.xxhash64("vec", "class_idx"), F.lit(1 << 31)))
    dealt = staged(hashed.mapInArrow(place, StructType([*celled.schema.fields, StructField("chunk", IntegerType())])), "support_chunks")
    spans = dealt.groupBy("chunk", "cell").agg(F.min("ring").alias("lo"), F.max("ring").alias("hi")).collect()  # a row a chunk
    return dealt.select("chunk", "class_idx", "vec"), sample, pivots, [(r["chunk"], r["cell"], r["lo"], r["hi"]) for r in spans]


class _Rings:
    """Which queries come within reach of which chunks."""

    def __init__(self, pivots: np.ndarray, spans: list, is_l1: bool):
        spans = sorted(spans)
        self.pivots, self.is_l1 = pivots, is_l1
        self.chunk = np.array([s[0] for s in spans], np.int64)
        self.cell = np.array([s[1] for s in spans], np.int64)
        self.lo, self.hi = np.array([s[2] for s in spans], float), np.array([s[3] for s in spans], float)

    def reached(self, m: np.ndarray, near: np.ndarray | None, upper: np.ndarray, some: slice | np.ndarray) -> np.ndarray:
        """Of queries ``m`` of one length with pivot distances ``near``: whether each must meet each chunk of ``some``."""
        if near is None:
            return np.ones((len(m), len(self.chunk[some])), bool)
        cell = self.cell[some]
        d = near[:, np.maximum(cell, 0)]
        gap = np.maximum(d - self.hi[some], self.lo[some] - d)
        reach = (upper * (1 + _SLACK))[:, None] + _SLACK * (1 + d)
        return (cell < 0) | ~(gap > reach) | ~_tame(m)[:, None]

    def near(self, m: np.ndarray) -> np.ndarray | None:
        return l1_block(m, self.pivots) if self.is_l1 and len(self.pivots) and m.shape[1] == self.pivots.shape[1] else None


def _visits(sample: Supports, rings: _Rings, shelf: np.ndarray, kernel: Kernel):
    """Of a batch of queries: the shelves that hold a chunk that each must visit, and its upper bound.  ``shelf`` is that
    of each chunk, ascending."""
    starts = np.flatnonzero(np.diff(shelf, prepend=-1))

    def fn(vectors):
        rank, classes, _ = sample.nearest(vectors)
        upper = np.where((classes >= 0) & np.isfinite(rank), -rank, np.inf)
        visit = np.ones((len(vectors), len(starts)), bool)
        step = max(1, SCAN // max(1, len(shelf)))
        for rows, m in matrices(vectors):
            for a in range(0, len(rows), step):
                part = m[a:a + step]
                all_chunks = rings.reached(part, rings.near(part), upper[rows[a:a + step]], slice(None))
                visit[rows[a:a + step]] = np.logical_or.reduceat(all_chunks, starts, axis=1)
        offs = np.concatenate(([0], np.cumsum(visit.sum(axis=1))))
        to = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(shelf[starts][np.nonzero(visit)[1]], pa.int32()))
        return to, upper if kernel.is_l1 else np.full(len(upper), np.inf)
    return fn


def rank_chunks(queries: DataFrame, supports: DataFrame, kernel: Kernel, query_vec: str, names: list[str],
                max_bytes: int, queries_per_task: int | None = None) -> DataFrame:
    """As ``rank_broadcast`` for supports of any size.

    Neighbouring chunks stand on shelves of ``MAX_BYTES`` (a larger chunk has its own): a query travels once to a shelf,
    whatever the number of its chunks that it must meet there."""
    row = _free("_row", queries.columns)
    kept = staged(queries.withColumn(row, F.monotonically_increasing_id()), "queries")
    narrow = kept.select(F.col(row).alias("row"), F.col(query_vec).alias("vec"))
    dealt, sample, pivots, spans = _deal(supports, kernel, max_bytes)
    sc = queries.sparkSession.sparkContext
    rings = _Rings(pivots, spans, kernel.is_l1)
    per_shelf = max(1, MAX_BYTES // max_bytes)
    shelf_of = np.arange(len(rings.chunk)) // per_shelf
    n = kept.count()
    pairs = n * -(-supports.count() // max(1, int(shelf_of.max(initial=0)) + 1))
    salts = max(1, -(-vector_bytes(narrow, "vec") // MAX_BYTES), -(-pairs // (4 * PAIRS)))
    if pairs >= LEAST:
        salts = max(salts, -(-sc.defaultParallelism // (int(shelf_of.max(initial=0)) + 1)))
    if queries_per_task:
        salts = max(salts, -(-n // queries_per_task))
    tasks = -(-n * len(spans) // PAIRS)
    spread = narrow.repartition(tasks) if tasks > 1 else narrow
    sent = _beside(spread, _visits(sample, rings, shelf_of, kernel), "vec", ["shelves", "upper"], "shelves array<int>, upper double")
    sent = sent.select("row", "vec", "upper", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"),
                       F.explode("shelves").alias("shelf"))
    shelves = sc.broadcast((rings, dict(zip(rings.chunk.tolist(), shelf_of.tolist(), strict=True))))
    at_chunk, stood_names = dealt.columns.index("chunk"), [*dealt.columns, "shelf"]

    def stand(batches):
        for b in batches:
            at = pa.array([shelves.value[1][c] for c in b.column(at_chunk).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, at], names=stood_names)
    stood = dealt.mapInArrow(stand, StructType([*dealt.schema.fields, StructField("shelf", IntegerType())]))
    stood = stood.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def meet(q: pa.Table, s: pa.Table) -> pa.Table:
        if not q.num_rows or not s.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "rank": pa.array([], pa.float64()),
                             "class_idx": pa.array([], pa.int32()), "compared": pa.array([], pa.int64())})
        rings, vectors, upper = shelves.value[0], q["vec"].combine_chunks(), q["upper"].to_numpy().copy()
        rank, classes, compared = np.full(len(vectors), -np.inf), np.full(len(vectors), -1), np.zeros(len(vectors), np.int64)
        lengths = [(rows, m, rings.near(m)) for rows, m in matrices(vectors)]
        s = s.sort_by("chunk")
        numbers = s["chunk"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        held_vec, held_class = s["vec"].combine_chunks(), s["class_idx"].to_numpy()
        places = np.searchsorted(rings.chunk, numbers[cuts[:-1]])
        whole = np.concatenate([rows for rows, _, _ in lengths] or [np.empty(0, np.int64)])
        i, most = 0, 1
        while i < len(places) and len(whole):
            # chunks that every query must visit are compared as one, ever more at a time while that holds
            look = min(most, len(places) - i, max(1, SCAN // len(vectors)))
            go = np.zeros((len(vectors), look), bool)
            for rows, m, near in lengths:
                go[rows] = rings.reached(m, near, upper[rows], places[i:i + look])
            all_go = go[whole].all(axis=0)
            n = look if all_go.all() else max(1, int(np.argmin(all_go)))
            rows = np.flatnonzero(go[:, 0])
            x, y = cuts[i], cuts[i + n]
            i, most = i + n, 2 * most if all_go[0] else 1
            if not len(rows):
                continue
            held = Supports(held_vec.slice(x, y - x), held_class[x:y], kernel)
            r, found, seen = held.nearest(vectors.take(pa.array(rows)) if len(rows) < len(vectors) else vectors, upper[rows])
            compared[rows] += seen
            keep_better(rank, classes, rows, r, found)
            if kernel.is_l1:
                known = (classes >= 0) & np.isfinite(rank)
                upper = np.where(known, np.minimum(upper, -rank), upper)
        return pa.table({"row": q["row"], "rank": pa.array(rank), "class_idx": pa.array(classes, pa.int32(), mask=classes < 0),
                         "compared": pa.array(compared)})
    local = sent.groupBy("shelf", "salt").cogroup(stood.groupBy("shelf", "salt")).applyInArrow(meet, f"row long, {FOUND}")
    best = local.groupBy("row").agg(
        F.max(F.when(F.col("class_idx").isNotNull(), F.struct("rank", (-F.col("class_idx")).alias("minus")))).alias("best"),
        F.sum("compared").alias("compared"))
    found = best.select(F.col("row").alias(row), F.col("best.rank").alias(names[0]), (-F.col("best.minus")).alias(names[1]),
                        F.col("compared").alias(names[2]))
    return kept.join(found, row, "left").drop(row)


def _tasks(queries: DataFrame, supports: DataFrame) -> int:
    """Tasks by the pairs to compare: one for few, every core for more, and ``PAIRS`` a task at most."""
    pairs = queries.count() * supports.count()
    return 1 if pairs < LEAST else max(queries.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS))


def nearest_in_blocks(queries: DataFrame, supports: DataFrame, kernel: Kernel, query_vec: str = "vec",
                      max_bytes: int = MAX_BYTES, counted: bool = False, queries_per_task: int | None = None) -> DataFrame:
    """``queries`` with ``pred`` and ``score`` (and ``compared``, the supports it was compared with) against written
    ``supports(class_idx, vec)``; the size of the supports picks the way."""
    names = [_free(n, queries.columns) for n in ("_rank", "_class", "_compared")]
    if vector_bytes(supports, "vec") <= max_bytes:
        n = 1 if queries.isStreaming else _tasks(queries, supports)
        spread = queries.repartition(n) if n > 1 else queries
        found = rank_broadcast(spread, supports, kernel, query_vec, names)
    else:
        found = rank_chunks(queries, supports, kernel, query_vec, names, max_bytes, queries_per_task)
    lowest = supports.agg(F.min("class_idx")).first()[0]
    rank, klass = F.col(names[0]), F.col(names[1])
    none = klass.isNull() | (klass < 0)
    more = [F.coalesce(F.col(names[2]), F.lit(0)).alias("compared")] if counted else []
    return found.select(*queries.columns, F.when(none, F.lit(lowest)).otherwise(klass).cast("int").alias("pred"),
                        F.when(none, F.lit(float("-inf"))).otherwise(kernel.score(rank)).alias("score"), *more)
