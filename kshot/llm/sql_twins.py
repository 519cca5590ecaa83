"""DuckDB SQL of the operators that SQL can express: 1, 4, 5 and 11 to 13 (whole tables, whole texts).

Operator 6 has none: its added kinds need look-behind, which DuckDB's patterns lack.
"""

from __future__ import annotations

from kshot.llm.line_rules import BOILERPLATE, MAX_LOSS, MAX_SYMBOLS, MIN_WORDS, PHRASE_WORDS

# 40 hex digits are four groups of 40 bits, each eight letters of five bits
WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, ((i // 8) * 10 + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1)), '')
    AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to, 'ok' AS status FROM m"""


def _lowered(col: str) -> str:
    return f"translate(coalesce({col}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op4_words(col: str) -> str:
    return rf"regexp_extract_all({_lowered(col)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


# an item's window is as long as the item allows, 10 words at most; texts meet windows of every such length
DECONTAMINATE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_op4_words('text')} AS w FROM documents),
b AS (SELECT item_id, {_op4_words('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k,
       array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i + 1 : i + k], ' ') AS g
       FROM (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, k WHERE len(w) >= k)),
hit AS MATERIALIZED (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
n AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM hit) GROUP BY r),
s AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit,
  coalesce(len(s.items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(s.items, ','), '')) AS items_sha256,
  coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)"""


_NOT_SPACE = r"[^\x20\x09-\x0D]+"
_SENTENCE_END = r"[.!?…:;。！？][\"'')\]»”’]*$"

LINE_RULES = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
       regexp_extract_all(coalesce(text, ''), '{_NOT_SPACE}') AS w FROM documents),
g AS (SELECT r, i, w[i : i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
nr AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
l1 AS (SELECT r, l, regexp_extract_all(l, '{_NOT_SPACE}') AS w FROM l0),
l2 AS (SELECT r, l, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS c,
       length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) AS s,
       len(list_filter(w, lambda x: x IN ('|', '»', '›', '·', '•', '>'))) AS v,
       regexp_matches(w[len(w)], '{_SENTENCE_END}') AS e,
       regexp_matches(lower(l), '{"|".join(BOILERPLATE)}') AS b FROM l1 WHERE len(w) > 0),
l3 AS (SELECT *, (n < {MIN_WORDS} AND NOT e) OR s > {MAX_SYMBOLS} * c OR v * 4 >= n OR (b AND n <= {PHRASE_WORDS}) AS bad
       FROM l2),
ln AS (SELECT r, count(*) AS lines, count(DISTINCT l) AS kinds, sum(c) AS chars, sum(CASE WHEN bad THEN c ELSE 0 END) AS gone
       FROM l3 GROUP BY r),
o AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(ln.chars, 0)::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      coalesce(ln.lines - ln.kinds, 0)::BIGINT AS n_dup_lines, coalesce(nr.n, 0)::BIGINT AS n_repeat_words,
      coalesce(ln.gone / ln.chars, 0.0) AS lost
      FROM d LEFT JOIN ln USING (r) LEFT JOIN nr USING (r))
SELECT * EXCLUDE (lost), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= {MAX_LOSS} AS kept FROM o"""


SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_op4_words('text')} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS nd, sum(len(w)) AS nt FROM d),
i AS (SELECT row_number() OVER () AS q, item_id, {_op4_words('text')} AS w FROM benchmark),
e AS (SELECT q, t, count(*) AS c FROM (SELECT q, unnest(w) AS t FROM i) GROUP BY q, t),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM e) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), s),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * nd) // nt AS m FROM d, s),
x AS (SELECT q, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM e JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY q, r),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank
      FROM x JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= 20"""

PHRASES = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_lowered('text')} AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, unnest(range(0, len(w))) AS i FROM w WHERE len(w) > 0),
f AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM (SELECT lang, w[i + 1 : i + k] AS p FROM s, range(1, 6) r(k) WHERE i + k <= len(w))
      GROUP BY lang, p HAVING count(*) >= 100),
c AS (SELECT lang, p, f AS a, len(p) AS size FROM f WHERE len(p) > 1),
x AS (SELECT c.lang, c.p, a, k, l.f AS l, r.f AS r, n::BIGINT AS n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
      FROM c JOIN range(1, 5) q(k) ON k < size JOIN f l ON l.lang = c.lang AND l.p = c.p[1 : k]
      JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1 : size] JOIN n ON n.lang = c.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS j FROM x),
g AS (SELECT lang, p[1 : size - 1] AS p, a FROM c WHERE size > 2 UNION ALL SELECT lang, p[2 : size] AS p, a FROM c WHERE size > 2),
m AS (SELECT lang, p, max(a) AS longer FROM g GROUP BY lang, p),
k AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
      FROM b LEFT JOIN m ON m.lang = b.lang AND m.p = b.p WHERE j = 1 AND coalesce(longer < a, true)),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
      FROM k)
SELECT * FROM o WHERE rank <= 2000"""

EXACT_DEDUP = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS c,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY c DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""
