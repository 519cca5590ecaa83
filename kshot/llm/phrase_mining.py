"""Operator 12, phrase collocations by vertical partitioning of a depth-truncated suffix tree.

A phrase of up to ``MAX_WORDS`` words occurs as often as it is a prefix of a suffix, so all counts are leaf totals of a
suffix tree of the pieces, cut off at that depth.  The tree never exists as a whole:

1. Words are counted per language.  A phrase has no fewer than ``min_count`` occurrences only if its words do, so a
   bitmap of the frequent words (a filter: it may let others pass) cuts suffixes before the first rare word.
2. Vertical partitioning: the two-word prefixes of what is left are counted.  A prefix with more suffixes than the memory
   budget is extended by a word and counted again, until it fits or has full depth; suffixes are cut before the first
   pair of words that is too rare.  Prefixes, ordered by hash, are packed into groups of about a budget.
3. Every map task combines equal suffixes and sends each group its part as one block.  A group sorts its suffixes, which
   is its subtree in depth-first order: nodes begin where the leading words change and count the leaves below.
   A prefix that was extended has its count summed over the groups of its extensions.
4. Scores, the check against longer candidates and the ranking are joins over the (few) frequent phrases.

Words stand as 64-bit hashes of language and word until the ranked phrases are spelled out.

Scale: three scans of the texts (one more for every level of extension); what is shuffled is pre-aggregated counts and
the combined suffixes of frequent pairs.  Group borders and over-budget prefixes (at most ``MAX_GROUPS`` each) and the
bitmaps (at most ``MAX_BITS``) are the only things that go to all tasks; beyond ``MAX_GROUPS`` budgets of suffixes the
budget itself grows.  Candidates look up their parts by ``split_join``, so a frequent first word is no hot key.
Long texts are cut into sections between pieces.

Edge cases: null text counts as empty, a null language is ``und``; empty tables give no rows; equal scores and counts
rank by the phrase in byte order; repeated rows count each time.  Extra columns do not matter and are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kshot.llm.common import Words, lowered, map_batches, mix, sections, text_runs
from kshot.operators.joins import split_join
from kshot.session import staged

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
BUDGET = 1_000_000
MAX_GROUPS, MAX_BITS = 1 << 20, 1 << 26
RUN = 1 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_PART = ~_BREAK                       # bytes inside a piece
_PHRASE_WORD = _PART.copy()
_PHRASE_WORD[[0x20, 0x09]] = False


class Run(NamedTuple):
    """Words of some texts: their hashes with the language mixed in, and whether the next word is of the same piece."""

    words: Words
    lang: np.ndarray        # number of the language in the batch, per word
    h: np.ndarray
    joined: np.ndarray


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def runs(batch: pa.RecordBatch) -> Iterator[tuple[list[str], Run]]:
    """Runs of a batch of (text, lang)."""
    langs = batch.column(1).cast(pa.string()).fill_null("und").dictionary_encode()
    names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
    seeds = np.array([_lang_hash(x) for x in names], dtype=np.uint64)
    for a, b, data, offs in text_runs(batch.column(0), RUN):
        parts = [(data, offs)] if len(data) <= RUN else [(x, np.array([0, len(x)])) for x in sections(data, RUN, _PART)]
        for part, at in parts:
            w = Words(part, at, _PHRASE_WORD)
            lang = code[a:b][w.doc]
            piece = np.cumsum(_BREAK[part])[w.start]
            joined = (w.doc[1:] == w.doc[:-1]) & (piece[1:] == piece[:-1])
            yield names, Run(w, lang, mix(w.hash ^ seeds[lang]), joined)


def extend(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hash of a prefix and one more word."""
    return mix(g * np.uint64(0xD6E8FEB86659FD93) + h)


def _summed(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a batch with their counts."""
    parts = [np.unique(k, return_counts=True) for k in keys]
    if len(parts) == 1:
        return parts[0]
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``h``, ``n`` by map task of ``docs(text, lang)``."""
    def fn(batch):
        seen, names = [], []
        for names, run in runs(batch):
            h, first, n = np.unique(run.h, return_index=True, return_counts=True)
            w = run.words
            size = (w.end - w.start)[first]
            offs = np.concatenate(([0], np.cumsum(size)))
            flat = lowered(w.data[np.repeat(w.start[first] - offs[:-1], size) + np.arange(offs[-1])])
            text = pa.Array.from_buffers(pa.string(), len(h), [None, pa.py_buffer(offs.astype("<i4").tobytes()), pa.py_buffer(flat)])
            seen.append((h, n, run.lang[first], text))
        if seen:
            h, first, at = np.unique(np.concatenate([x[0] for x in seen]), return_index=True, return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([x[1] for x in seen]), minlength=len(h)).astype(np.int64)
            lang = np.concatenate([x[2] for x in seen])[first]
            text = pa.concat_arrays([x[3] for x in seen]).take(pa.array(first))
            yield {"lang": pa.array(names, pa.string()).take(pa.array(lang)), "word": text, "h": h.view(np.int64), "n": n}
    return map_batches(docs, fn, "lang string, word string, h long, n long")


def bitmap(keys: DataFrame, col: str, n: int) -> np.ndarray:
    """A filter of ``n`` hashes: 16 to 32 bits each, ``MAX_BITS`` at most, gathered as 64-bit words."""
    bits = min(MAX_BITS, max(1 << 12, 1 << (16 * n).bit_length()))
    at = F.col(col).bitwiseAND(F.lit(bits - 1))
    words = keys.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(
        f"shiftleft(1L, cast({col} & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def levels(run: Run, frequent: np.ndarray, good: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For 2, 3, ... ``MAX_WORDS`` words: the length, which entries of the level before go on, the words where such
    prefixes begin and their hashes.  Filters: both words ``frequent``, every pair of neighbours ``good``."""
    n = len(run.h)
    ok = frequent[(run.h & np.uint64(len(frequent) - 1)).astype(np.int64)]
    pair = np.zeros(n + MAX_WORDS, bool)
    pair[:max(n - 1, 0)] = ok[1:] & ok[:-1] & run.joined
    at = np.flatnonzero(pair)
    g = extend(run.h[at], run.h[at + 1])
    if good is not None:
        keep = good[(g & np.uint64(len(good) - 1)).astype(np.int64)]
        pair[at[~keep]] = False
        at, g = at[keep], g[keep]
    yield 2, np.arange(len(at)), at, g
    for k in range(3, MAX_WORDS + 1):
        on = np.flatnonzero(pair[at + k - 2])
        at = at[on]
        g = extend(g[on], run.h[at + k - 1])
        yield k, on, at, g


def _among(g: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, g), len(keys) - 1)] == g if len(keys) else np.zeros(len(g), bool)


def count_prefixes(docs: DataFrame, k: int, frequent: np.ndarray, good: np.ndarray | None, over: np.ndarray) -> DataFrame:
    """``g``, ``n`` by map task: prefixes of ``k`` words; beyond two words those only that extend one of ``over``."""
    def fn(batch):
        keys = []
        for _, run in runs(batch):
            before = None
            for level, on, _at, g in levels(run, frequent, good):
                if level == k:
                    keys.append(g if before is None else g[_among(before[on], over)])
                    break
                before = g
        if keys:
            g, n = _summed(keys)
            yield {"g": g.view(np.int64), "n": n}
    return map_batches(docs, fn, "g long, n long")


def partition(docs: DataFrame, frequent: np.ndarray, min_count: int, budget: int) \
        -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray], int]:
    """The filter of frequent pairs, the group borders, the over-budget prefixes by length, and the budget used."""
    good, over, sums = None, {}, np.zeros(1 << 16, np.int64)
    for k in range(2, MAX_WORDS):
        found = staged(count_prefixes(docs, k, frequent, good, over.get(k - 1, np.zeros(0, np.uint64)))
                       .groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "phrase_prefixes")
        if k == 2:
            n, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
            good, budget = bitmap(found, "g", n), max(budget, total // MAX_GROUPS)
        top = F.shiftrightunsigned("g", 48).alias("top")
        load = found.where(F.col("n") <= budget).groupBy(top).agg(F.sum("n").alias("n")).toArrow()   # at most 65,536 rows
        sums[load["top"].to_numpy()] += load["n"].to_numpy()
        large = found.where(F.col("n") > budget).select("g").toArrow()["g"].to_numpy()               # at most MAX_GROUPS
        over[k] = np.sort(large.view(np.uint64))
        if not len(large):
            break
    borders, held = [], 0
    for i, n in enumerate(sums.tolist()):
        if held and held + n > budget:
            borders.append(i << 48)
            held = 0
        held += n
    return good, np.array(borders, dtype=np.uint64), over, budget


def suffix_blocks(docs: DataFrame, frequent: np.ndarray, good: np.ndarray, borders: np.ndarray,
                  over: dict[int, np.ndarray]) -> DataFrame:
    """``part`` (group), ``words`` (columns of 64-bit hashes, 0 after the end), ``times``: by map task, the distinct
    suffixes of each group."""
    def fn(batch):
        rows, routes = [], []
        for _, run in runs(batch):
            h = np.append(run.h, np.zeros(MAX_WORDS, np.uint64))
            for k, on, at, g in levels(run, frequent, good):
                if k == 2:
                    start, length, route, climbing = at, np.full(len(at), 2), g.copy(), np.arange(len(at))
                else:
                    longer = _among(before[on], over.get(k - 1, np.zeros(0, np.uint64)))
                    climbing = climbing[on]
                    length[climbing] = k
                    route[climbing[longer]] = g[longer]
                before = g
            rows.append(np.stack([np.where(length > j, h[start + j], np.uint64(0)) for j in range(MAX_WORDS)]))
            routes.append(route)
        if any(map(len, routes)):
            words, route = np.concatenate(rows, axis=1), np.concatenate(routes)
            whole = words[0].copy()
            for j in range(1, MAX_WORDS):
                whole = extend(whole, words[j])
            _, first, times = np.unique(whole, return_index=True, return_counts=True)
            part = np.searchsorted(borders, route[first], side="right")
            order = np.argsort(part, kind="stable")
            first, times, part = first[order], times[order], part[order]
            parts, begin = np.unique(part, return_index=True)
            ends = np.append(begin[1:], len(part))
            yield {"part": parts.astype(np.int32), "words": [words[:, first[a:b]].tobytes() for a, b in zip(begin, ends, strict=True)],
                   "times": [times[a:b].astype("<i8").tobytes() for a, b in zip(begin, ends, strict=True)]}
    return map_batches(docs, fn, "part int, words binary, times binary")


def subtree(words: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 2 to ``MAX_WORDS`` words: the nodes of a group's subtree (columns of words) and their leaf totals.

    Sorted suffixes are the leaves in depth-first order; a node is a run of leaves with equal leading words."""
    order = np.lexsort(words[::-1])
    words, times = words[:, order], times[order]
    new = np.zeros(len(times), bool)
    new[:1] = True
    for d in range(1, MAX_WORDS + 1):
        new[1:] |= words[d - 1, 1:] != words[d - 1, :-1]
        if d > 1:
            begin = np.flatnonzero(new)
            total = np.add.reduceat(times, begin)
            real = words[d - 1, begin] != 0
            yield d, words[:d, begin[real]], total[real]


def count_phrases(blocks: DataFrame, over: dict[int, np.ndarray], min_count: int) -> DataFrame:
    """``p`` (hashes of the words), ``f`` of every phrase of two words and more with at least ``min_count`` occurrences."""
    def build(table: pa.Table) -> pa.Table:
        words = np.concatenate([np.frombuffer(x, "<u8").reshape(MAX_WORDS, -1) for x in table["words"].to_pylist()], axis=1)
        times = np.concatenate([np.frombuffer(x, "<i8") for x in table["times"].to_pylist()])
        lists, totals = [], []
        for d, node, n in subtree(words, times):
            g = node[0]
            for j in range(1, d):
                g = extend(g, node[j])
            keep = (n >= min_count) | _among(g, over.get(d, np.zeros(0, np.uint64)))     # those are summed over groups
            flat = np.ascontiguousarray(node[:, keep].T).view(np.int64).ravel()
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, d), pa.int32()), pa.array(flat)))
            totals.append(pa.array(n[keep]))
        return pa.table({"p": pa.chunked_array(lists), "f": pa.chunked_array(totals)})

    return (blocks.groupBy("part").applyInArrow(build, "p array<long>, f long").groupBy("p").agg(F.sum("f").alias("f"))
            .where(F.col("f") >= min_count))


def _score(a: str, n: str, left: str, right: str):
    wide = {x: f"cast({x} as decimal(19, 0))" for x in (a, n, left, right)}     # 1000 * a * n has at most 38 digits
    return F.expr(f"(1000 * {wide[a]} * {wide[n]}) div ({wide[left]} * {wide[right]})")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
         budget: int = BUDGET) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's best phrases."""
    body = docs.select(docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    counted = staged(count_words(body), "phrase_words")
    per_lang = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = staged(counted.groupBy("h", "lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
                   .join(per_lang, "lang"), "phrase_vocabulary")
    frequent = bitmap(words, "h", words.count())
    good, borders, over, _ = partition(body, frequent, min_count, budget)
    phrases = staged(count_phrases(suffix_blocks(body, frequent, good, borders, over), over, min_count), "phrase_counts")

    # the counts of both parts of every cut, and from the first word the language and its total
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    parts = cuts.select("p", F.col("f").alias("a"), "k", F.explode(F.array(
        F.struct(F.lit(True).alias("is_left"), F.slice("p", F.lit(1), F.col("k")).alias("key")),
        F.struct(F.lit(False).alias("is_left"), F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")).alias("key")))).alias("x"))
    known = phrases.select(F.col("p").alias("key"), "f", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("n")) \
        .unionByName(words.select(F.array("h").alias("key"), "f", "lang", "n"))
    met = split_join(parts.select("p", "a", "k", "x.is_left", "x.key"), known, "key", ["p", "k"])
    left, first = F.col("is_left"), F.col("is_left") & (F.col("k") == 1)
    cut = met.groupBy("p", "a", "k").agg(
        F.max(F.when(left, F.col("f"))).alias("l"), F.max(F.when(~left, F.col("f"))).alias("r"),
        F.max(F.when(first, F.col("lang"))).alias("lang"), F.max(F.when(first, F.col("n"))).alias("n"))
    whole = cut.groupBy("p", "a").agg(F.max("lang").alias("lang"), F.max("n").alias("n"),
                                      F.collect_list(F.struct("k", "l", "r")).alias("cuts"))       # four cuts at most
    scored = whole.withColumn("c", F.explode("cuts")).select("p", "a", "lang", "n", "c.k", "c.l", "c.r") \
        .withColumn("score", _score("a", "n", "l", "r")) \
        .groupBy("p", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))

    # longer by one word is enough: of all phrases between a candidate and a longer one, counts only fall
    size = F.size("p")
    longer = phrases.where(size > 2).select(F.explode(F.array(F.slice("p", F.lit(1), size - 1), F.slice("p", F.lit(2), size - 1)))
                                            .alias("p"), "f").groupBy("p").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, "p", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = [F.desc("c.score"), F.desc("a")]
    best = kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)
    best = staged(best.select("p", "a", "lang", "n", "c"), "phrase_best")
    spelled = best.select("p", F.posexplode("p").alias("at", "h")).join(words.select("h", "word"), "h").groupBy("p").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = best.join(spelled, "p").withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score")
