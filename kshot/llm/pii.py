"""Operator 6, personal data: patterns propose, checksums confirm, context adjusts (SQL functions only).

Base kinds, leftmost and non-overlapping within a kind, failing matches dropped without a retry: ``email``;
``ip`` (parts at most 255); ``card`` (12 to 19 digits, Luhn); ``phone`` (``+``, 9 to 15 digits).  They always
stay.  Added kinds: ``iban`` and ``local`` (a phone number without ``+``).  Every span has a score:
what its kind starts with, plus ``CONTEXT_BONUS`` if one of the kind's context words stands within ``reach``
characters; added spans need ``min_score`` and must not overlap a base span.

An IBAN is proposed by its first four characters alone.  Of the lengths at which a group may end after them, that
of its country is tried first, then the longest (each, longest first, for a country without a fixed length); the
first that mod-97 confirms is the span, so what follows in the text cannot hide it.  Spans do not overlap.

The patterns are written with possessive repeats and look-behinds so that no text makes them backtrack; they
match what the plain ones match.  Positions come from the text between the matches.

Map only: no shuffle.  Edge cases: a null or empty text has no spans; repeated rows and null ids are judged
each by itself; other columns are kept, except ones named like the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE, CONTEXT_BONUS, REACH = 0.6, 0.3, 40
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]*[\x20().0-9-][0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]{4}){2})"
IBAN_LENGTHS = range(34, 14, -1)
#: characters of an IBAN by country
COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO EG GT HN HU LB NI PL SV",
    29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
NUMBER = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"

#: kind, pattern, a substring that a text must hold, score, context words; base kinds first, in their order
KINDS = (
    ("email", EMAIL, "@", 0.9, "mail|contact|write to|reach"),
    ("ip", IP, ".", 0.6, r"\bip\b|address|server|host"),
    ("card", CARD, None, 0.7, "card|visa|credit|debit|payment"),
    ("phone", PHONE, "+", 0.7, r"phone|\btel|call|mobile|fax"),
    ("iban", IBAN, None, 0.7, "iban|account|bank|konto|compte|cuenta"),
    ("local", NUMBER, None, 0.4, r"phone|\btel|call|mobile|fax"),
)
BASE = 4


def _luhn(d: str) -> str:
    at = f"cast(substring({d}, length({d}) - i + 1, 1) as int)"
    return (f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = 0, {at} * 2 - if({at} > 4, 9, 0), {at}))"
            " % 10 = 0")


def _mod97(m: str) -> str:
    s = f"replace({m}, ' ', '')"
    turned = f"concat(substring({s}, 5), substring({s}, 1, 4))"
    return (f"aggregate(split({turned}, ''), 0, (a, c) -> case when c = '' then a when c between '0' and '9' "
            "then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1")


def _confirmed(kind: str) -> str:
    """The checksum or range test of a match ``s.m``, as SQL."""
    if kind == "ip":
        part = "trim(leading '0' from p)"
        return f"forall(split(s.m, '[.]'), p -> length({part}) <= 3 and coalesce(try_cast({part} as int), 0) <= 255)"
    if kind == "card":
        d = "translate(s.m, ' -', '')"
        return f"length({d}) between 12 and 19 and {_luhn(d)}"
    if kind == "phone":
        return "length(translate(s.m, '+ ().-', '')) between 9 and 15"
    return "true"


def _ibans() -> str:
    """The IBANs among the matches ``found`` (beginnings only), as SQL; the leftmost of overlapping ones."""
    def ending(n: int) -> str:
        fours, rest = divmod(n - 4, 4)
        tail = rf"(?:\x20?[A-Z0-9]{{{rest}}})" if rest else ""
        return rf"^[A-Z0-9]{{4}}(?:\x20?[A-Z0-9]{{4}}){{{fours}}}{tail}(?![A-Za-z0-9])"
    window = max(IBAN_LENGTHS) + max(IBAN_LENGTHS) // 4 + 1         # with spaces and the character after it
    ends = ", ".join(f"regexp_extract(s.w, {_sql(ending(n))}, 0)" for n in IBAN_LENGTHS)
    fixed = "map(" + ", ".join(f"'{c}', {n}" for n, cs in COUNTRIES.items() for c in cs.split()) + ")"
    return f"""aggregate(
        transform(
            transform(
                transform(found, s -> named_struct('at', s.at, 'w', substring(body, s.at + 1, {window}))),
                s -> named_struct('at', s.at, 'fixed', try_element_at({fixed}, substring(s.w, 1, 2)),
                                  'ends', filter(array({ends}), e -> e <> ''))),
            s -> named_struct('at', s.at, 'm', get(filter(
                concat(filter(s.ends, e -> length(replace(e, ' ', '')) = s.fixed),
                       if(s.fixed is null, s.ends, slice(s.ends, 1, 1))), e -> {_mod97('e')}), 0))),
        cast(array() as array<struct<m: string, at: int>>),
        (a, s) -> if(s.m is null or s.at < coalesce(get(a, size(a) - 1).at + length(get(a, size(a) - 1).m), 0),
                     a, concat(a, array(named_struct('m', s.m, 'at', s.at)))))"""


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPAN = "array<struct<start: int, ord: int, kind: string, end: int, score: double>>"


def _propose(t: DataFrame, order: int, reach: int) -> DataFrame:
    """Add the confirmed spans of one kind as ``k<order>``, from the columns ``body`` and ``digit``."""
    kind, pattern, needs, score, words = KINDS[order]
    gate = F.col("digit") if kind != "email" else F.lit(True)
    if needs:
        gate = gate & F.col("body").contains(needs)
    t = t.withColumn("m", F.when(gate, F.regexp_extract_all("body", F.lit(pattern), F.lit(0)))
                     .otherwise(F.expr("cast(array() as array<string>)")))
    # the texts between the matches give the positions
    t = t.withColumn("g", F.when(F.size("m") > 0, F.split("body", pattern, -1)))
    near = (f"lower(substring(body, greatest(1, s.at + 1 - {reach}), least(s.at, {reach}) + length(s.m) + {reach}))"
            f" rlike {_sql(words)}")
    t = t.withColumn("found", F.expr("""
        aggregate(m, named_struct('i', 0, 'at', 0, 'found', cast(array() as array<struct<m: string, at: int>>)),
            (a, x) -> named_struct('i', a.i + 1, 'at', a.at + length(g[a.i]) + length(x),
                'found', concat(a.found, array(named_struct('m', x, 'at', a.at + length(g[a.i]))))),
            a -> a.found)"""))
    if kind == "iban":
        t = t.withColumn("found", F.expr(_ibans()))
    return t.withColumn(f"k{order}", F.expr(f"""transform(
        filter(found, s -> {_confirmed(kind)}),
        s -> named_struct('start', s.at, 'ord', {order}, 'kind', '{kind}', 'end', s.at + length(s.m),
                          'score', cast({score} + if({near}, {CONTEXT_BONUS}, 0) as double)))""").cast(SPAN)).drop("m", "g", "found")


def find(documents: DataFrame, text: str = "text", min_score: float = MIN_SCORE, reach: int = REACH) -> DataFrame:
    """``documents`` plus ``base_spans`` and ``spans``: arrays of ``(start, ord, kind, end, score)`` sorted by
    start and kind; code points, end exclusive."""
    cols = [c for c in documents.columns if c not in ("base_spans", "spans")]
    t = documents.select(F.struct(*cols).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    t = t.withColumn("digit", F.col("body").rlike("[0-9]"))
    for i in range(len(KINDS)):
        t = _propose(t, i, reach)
    t = t.withColumn("base_spans", F.sort_array(F.concat(*[F.col(f"k{i}") for i in range(BASE)])))
    more = F.filter(F.concat(*[F.col(f"k{i}") for i in range(BASE, len(KINDS))]), lambda s: (
        (s["score"] >= min_score)
        & ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    return t.select(*[F.col("row")[c].alias(c) for c in cols], "base_spans",
                    F.sort_array(F.concat("base_spans", more)).alias("spans"))


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(documents: DataFrame, text: str = "text", **params) -> DataFrame:
    """``documents`` with every span replaced by its kind in brackets; overlapping spans become one, named
    after the first.  A null text stays null; columns stay as they are."""
    cols = documents.columns
    found = find(documents.select(F.struct(*cols).alias("row"), F.col(text).alias("orig")), "orig", **params)
    # keep a span that starts at or after all earlier ends; an overlapping one lengthens the last kept
    merged = F.expr("""aggregate(spans, cast(array() as array<struct<start: int, end: int, kind: string>>), (a, s) ->
        case when size(a) > 0 and s.start < a[size(a) - 1].end
        then concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start,
             'end', greatest(a[size(a) - 1].end, s.end), 'kind', a[size(a) - 1].kind)))
        else concat(a, array(named_struct('start', s.start, 'end', s.end, 'kind', s.kind))) end)""")
    found = found.withColumn("cuts", merged)
    parts = F.expr("""concat(flatten(transform(cuts, (s, i) -> array(
        substring(orig, coalesce(get(cuts, i - 1).end, 0) + 1, s.start - coalesce(get(cuts, i - 1).end, 0)),
        concat('[', upper(s.kind), ']')))), array(substring(orig, element_at(cuts, -1).end + 1)))""")
    new = F.when(F.size("cuts") > 0, F.array_join(parts, "")).otherwise(F.col("orig"))
    return found.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in cols])
