"""Helpers that spell the oracle twins of the operators as plain (DuckDB-compatible) SQL text."""

from __future__ import annotations


def lit(p) -> str:
    if isinstance(p, str) and p.startswith("@"):
        return f"CAST({p[1:]} AS VARCHAR)"         # '@expr' marks a column expression
    return "'" + str(p).replace("'", "''") + "'"


def key(seed, *parts) -> str:
    return "concat_ws('|', " + ", ".join([lit(seed)] + [lit(p) for p in parts]) + ")"


def h(seed, *parts) -> str:
    """P1 keyed hash as SQL."""
    return f"('0x' || substr(md5({key(seed, *parts)}), 1, 15))::BIGINT"


def idx(n: str, seed, *parts) -> str:
    """P1 index in [0, n); null when n <= 0 (as ``keyed_index``)."""
    return f"(CASE WHEN ({n}) > 0 THEN {h(seed, *parts)} % ({n}) END)"


def unif(seed, *parts) -> str:
    return f"({h(seed, *parts)} / 1152921504606846976.0)"


def md5key(seed, *parts) -> str:
    return f"md5({key(seed, *parts)})"


def r(x: str, d: int = 6) -> str:
    return f"(round({x}, {d}) + 0.0)"


def l1(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i]::DOUBLE - {b}[i]::DOUBLE)))"


def manhattan(a: str, b: str) -> str:
    return f"exp(-{l1(a, b)})"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def norm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE)))"


def cosine(a: str, b: str) -> str:
    return f"(CASE WHEN {norm(a)} * {norm(b)} > 0 THEN {dot(a, b)} / ({norm(a)} * {norm(b)}) END)"


def shift3(r0: str, r1: str, r2: str) -> tuple[str, str, str]:
    """P4 for k = 3 given raw draws r0 in n, r1 in n-1, r2 in n-2."""
    x1 = f"({r1} + CASE WHEN {r1} >= {r0} THEN 1 ELSE 0 END)"
    lo, hi = f"least({r0}, {x1})", f"greatest({r0}, {x1})"
    a = f"({r2} + CASE WHEN {r2} >= {lo} THEN 1 ELSE 0 END)"
    x2 = f"({a} + CASE WHEN {a} >= {hi} THEN 1 ELSE 0 END)"
    return r0, x1, x2


ITEMS_VEC = "items AS (SELECT vec_id AS item_id, label AS class, embedding AS vec FROM embeddings)"
ITEMS_TEXT = ("items AS (SELECT doc_id AS item_id, lang AS superclass, concat_ws('/', lang, source) AS class, "
              "text FROM documents)")


def member_cte(seed, src: str = "items", name: str = "mi") -> str:
    """member_idx (0-based) and n per class."""
    return (f"{name} AS (SELECT s.*, row_number() OVER (PARTITION BY class ORDER BY {md5key(seed, 'm', '@item_id')}, "
            f"item_id) - 1 AS member_idx, count(*) OVER (PARTITION BY class) AS n FROM {src} s)")


def label_cte(src: str = "items", name: str = "lab") -> str:
    return (f"{name} AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS class_idx "
            f"FROM (SELECT DISTINCT class FROM {src}))")


def metrics_ctes(pred_src: str, labels_src: str, beta: float = 1.0) -> str:
    """CTEs conf, per, mm (one row: accuracy, recall, precision, f_beta; macro over labels)."""
    b2 = float(beta) ** 2
    return f"""conf AS (SELECT actual, pred, count(*) AS n FROM {pred_src} GROUP BY actual, pred),
per0 AS (SELECT l.label,
    coalesce((SELECT sum(n) FROM conf c WHERE c.pred = l.label AND c.actual = l.label), 0) AS tp,
    coalesce((SELECT sum(n) FROM conf c WHERE c.pred = l.label), 0) AS pp,
    coalesce((SELECT sum(n) FROM conf c WHERE c.actual = l.label), 0) AS ap FROM {labels_src} l),
per1 AS (SELECT label, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS p,
    CASE WHEN ap > 0 THEN tp / ap ELSE 0.0 END AS r FROM per0),
per AS (SELECT label, p, r, CASE WHEN {b2} * p + r <> 0 THEN (1 + {b2}) * p * r / ({b2} * p + r) ELSE 0.0 END AS f
    FROM per1),
mm AS (SELECT
    (SELECT CASE WHEN coalesce(sum(n), 0) > 0 THEN coalesce(sum(CASE WHEN pred = actual THEN n END), 0) / sum(n)
            ELSE 0.0 END FROM conf) AS accuracy,
    coalesce(avg(r), 0.0) AS recall, coalesce(avg(p), 0.0) AS precision, coalesce(avg(f), 0.0) AS f_beta
    FROM per)"""


def binary_ctes(src: str, beta: float = 1.0, positive: int = 1) -> str:
    """CTE bm: one row (accuracy, recall, precision, f_beta) for a binary problem."""
    b2 = float(beta) ** 2
    return f"""bparts AS (SELECT count(*) AS total,
    coalesce(sum(CASE WHEN pred = actual THEN 1 ELSE 0 END), 0) AS correct,
    coalesce(sum(CASE WHEN pred = {positive} AND actual = {positive} THEN 1 ELSE 0 END), 0) AS tp,
    coalesce(sum(CASE WHEN pred = {positive} THEN 1 ELSE 0 END), 0) AS pp,
    coalesce(sum(CASE WHEN actual = {positive} THEN 1 ELSE 0 END), 0) AS ap FROM {src}),
bpr AS (SELECT CASE WHEN total > 0 THEN correct / total ELSE 0.0 END AS accuracy,
    CASE WHEN ap > 0 THEN tp / ap ELSE 0.0 END AS recall,
    CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS precision FROM bparts),
bm AS (SELECT accuracy, recall, precision,
    CASE WHEN {b2} * precision + recall <> 0 THEN (1 + {b2}) * precision * recall / ({b2} * precision + recall)
         ELSE 0.0 END AS f_beta FROM bpr)"""


def distinct_chain(src: str, n: str, k: int, seed, parts: tuple, prefix: str = "dx", out: str = "x") -> tuple[str, str]:
    """P4 as chained CTEs over ``src``; returns (cte text, name of the last CTE with x0..x{k-1})."""
    ctes, prev = [], src
    for j in range(k):
        name = f"{prefix}{j}"
        raw = idx(f"{n} - {j}", seed, *parts, f"d{j}")
        if j == 0:
            expr = raw
        else:
            earlier = ", ".join(f"{out}{i}" for i in range(j))
            expr = (f"list_reduce(list_prepend({raw}, list_sort([{earlier}])), "
                    f"lambda acc, p: acc + CASE WHEN acc >= p THEN 1 ELSE 0 END)")
        ctes.append(f"{name} AS (SELECT *, {expr} AS {out}{j} FROM {prev})")
        prev = name
    return ",\n".join(ctes), prev


def offsets_cte(src_counts: str, name: str = "off") -> str:
    return (f"{name} AS (SELECT class, n, coalesce(sum(n) OVER (ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING "
            f"AND 1 PRECEDING), 0) AS off FROM {src_counts})")


def ws_chars() -> str:
    from kshot.operators.text import WHITESPACE
    return " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def tokens(col: str = "text") -> str:
    """B1 as SQL."""
    return f"string_split(trim({col}, {ws_chars()}), ' ')"


DTOK = f"dtok AS (SELECT doc_id AS item_id, {tokens()} AS tokens FROM documents)"


def vocab_freq_cte(low_freq: int = 2, src: str = "dtok", name: str = "vocab") -> str:
    return f"""{name}_cnt AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM {src}) GROUP BY token),
{name} AS (SELECT token, (row_number() OVER (ORDER BY cnt DESC, token) + 1)::BIGINT AS id FROM {name}_cnt
           WHERE cnt > {low_freq} UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNK>', 1)"""


def encode_cte(src: str, vocab: str, default: int, name: str = "enc") -> str:
    return f"""{name}_ex AS (SELECT item_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM {src}),
{name} AS (SELECT e.item_id, list(coalesce(v.id, {default})::INTEGER ORDER BY e.pos) AS ids
           FROM {name}_ex e LEFT JOIN {vocab} v USING (token) GROUP BY e.item_id)"""


def zeros(n: int) -> str:
    return f"list_transform(range({n}), lambda x: 0)"
