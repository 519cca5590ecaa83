"""Operator 5, line-first cleaning (SQL functions only).

Every line is judged on its own; failing lines go; a document that loses too large a share of its word
characters is rejected.  A line (a ``\\n``-part of the text that holds a word) fails

* ``punctuation``: it has fewer than ``min_words`` words and does not end like a sentence, or symbols
  ``#*$%&|<>`` are over ``max_symbols`` of its word characters;
* ``navigation``: ``|``, ``»``, ``›``, ``·``, ``•`` or ``>`` as words of their own are at least a quarter of
  its words;
* ``boilerplate``: it holds one of the ``BOILERPLATE`` phrases and at most ``phrase_words`` words.

Base figures per document: see ``clean``.  Words are ``[^\\x20\\x09-\\x0D]+``.  Repeated 3-word windows are found
by sorting one long per window (its hash above its position, as many position bits as the text needs) and
comparing the words of neighbours, so cost is n log n and exact but for hash ties inside one text.

Map only: no shuffle, one row in, one row out.  Edge cases: a null or empty text has no words and fails the
base rules; a text without line breaks is one line; repeated rows and null ids are judged each by itself;
columns of the input other than the text and the result names are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MAX_SYMBOLS, PHRASE_WORDS, MAX_LOSS = 4, 0.2, 30, 0.5
ODD_SPACES = "\t\x0b\f\r"                        # white space besides space and line break
ODD_SPACE = r"[\\x09\\x0B-\\x0D]"
SYMBOLS = "#*$%&|<>"
SENTENCE_END = r"[.!?…:;。！？][\"\')\\]»”’]*$"
#: phrases of page furniture (fixed values)
BOILERPLATE = ("all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service",
               "terms of use", "enable javascript", "javascript is disabled", "subscribe to our newsletter",
               "sign up for", "log in to", "click here", "read more", "share this", "follow us on", "skip to content",
               "powered by", "lorem ipsum", "add to cart", "back to top")
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines",
          "n_bad_lines", "lost", "kept", "clean_text")


def clean(documents: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_symbols: float = MAX_SYMBOLS,
          phrase_words: int = PHRASE_WORDS, max_loss: float = MAX_LOSS, base_words: int = 50,
          repeat_pct: int = 50) -> DataFrame:
    """``documents`` plus ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines``
    (lines with a word that equal an earlier line), ``n_repeat_words`` (words in 3-word windows found twice or
    more), ``base_failed`` (under ``base_words`` words, or over ``repeat_pct`` % repeated), ``n_lines``,
    ``n_bad_lines``, ``lost`` (share of word characters in failing lines), ``kept``, ``clean_text``."""
    extra = [c for c in documents.columns if c != text and c not in RESULT]
    # every column of the input but the text travels inside one struct, so helper names cannot clash with them
    carried = F.struct(*[documents[c] for c in extra]) if extra else F.lit(None).cast("int")
    t = documents.select(carried.alias("x"), F.coalesce(documents[text], F.lit("")).alias("t"))
    # single characters are split without a pattern; empty words between neighbouring spaces are removed
    t = t.select("*", F.expr(f"if(t rlike '{ODD_SPACE}', translate(t, '{ODD_SPACES}', '    '), t)").alias("u"))
    t = t.select("x", "t", F.expr(r"""filter(zip_with(split(t, '\n', -1), split(u, '\n', -1), (l, v) -> named_struct(
        'l', l, 'w', array_remove(split(v, ' ', -1), ''))), y -> size(y.w) > 0)""").alias("lines"))
    t = t.select("x", "t", F.expr(f"""transform(lines, y -> named_struct(
        'l', y.l, 'n', size(y.w), 'c', length(array_join(y.w, '')),
        's', if(y.l rlike '[{SYMBOLS}]', length(y.l) - length(translate(y.l, '{SYMBOLS}', '')), 0),
        'v', if(y.l rlike '[|»›·•>]', size(filter(y.w, z -> z in ('|', '»', '›', '·', '•', '>'))), 0),
        'unended', if(size(y.w) < {min_words}, not element_at(y.w, -1) rlike '{SENTENCE_END}', false),
        'phrase', if(size(y.w) <= {phrase_words}, lower(y.l) rlike '{"|".join(BOILERPLATE)}', false)))""").alias("lines"),
        F.expr("flatten(transform(lines, y -> y.w))").alias("w"))
    t = t.select("x", "t", "w", F.expr(f"""transform(lines, y -> named_struct('l', y.l, 'c', y.c, 's', y.s, 'bad',
        y.unended or y.s > {max_symbols} * y.c or y.v * 4 >= y.n or y.phrase))""").alias("lines"),
        F.expr("transform(w, z -> xxhash64(z))").alias("h"), F.expr("cast(ceil(log2(size(w) + 2)) as int)").alias("b"))
    # one long per 3-word window, its hash above its position; texts that repeat no window end here
    t = t.select("x", "t", "w", "lines", "b", F.expr("""if(size(w) < 3, cast(array() as array<bigint>), transform(
        slice(h, 1, size(h) - 2), (z, i) -> shiftleft(shiftrightunsigned(xxhash64(z, h[i + 1], h[i + 2]), b), b)))""").alias("p"))
    t = t.select("x", "t", "w", "lines", "b", F.expr("""if(size(array_distinct(p)) = size(p), cast(array() as array<bigint>),
        sort_array(transform(p, (z, i) -> z | cast(i as bigint))))""").alias("p"))
    t = t.select("*", F.expr("shiftleft(1L, b) - 1").alias("m"))
    same = ("shiftright(z, b) = shiftright({y}, b) and w[cast(z & m as int)] = w[cast({y} & m as int)] and "
            "w[cast(z & m as int) + 1] = w[cast({y} & m as int) + 1] and w[cast(z & m as int) + 2] = w[cast({y} & m as int) + 2]")
    t = t.select("x", "t", "w", "lines", F.expr(f"""sort_array(transform(filter(p, (z, j) -> coalesce({same.format(y='get(p, j - 1)')},
        false) or coalesce({same.format(y='get(p, j + 1)')}, false)), z -> z & m))""").alias("r"))
    out = t.select(
        "x", "t", F.expr("cast(size(w) as bigint)").alias("n_words"),
        F.expr("aggregate(lines, 0L, (a, y) -> a + y.c)").alias("word_chars"),
        F.expr("aggregate(lines, 0L, (a, y) -> a + y.s)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(transform(lines, y -> y.l))) as bigint)").alias("n_dup_lines"),
        F.expr("aggregate(transform(r, (z, j) -> least(3L, coalesce(get(r, j + 1), z + 3) - z)), 0L, (a, v) -> a + v)")
        .alias("n_repeat_words"),
        F.expr("cast(size(lines) as bigint)").alias("n_lines"),
        F.expr("cast(size(filter(lines, y -> y.bad)) as bigint)").alias("n_bad_lines"),
        F.expr("aggregate(lines, 0L, (a, y) -> a + if(y.bad, y.c, 0))").alias("gone"),
        F.expr(r"concat_ws('\n', transform(filter(lines, y -> not y.bad), y -> y.l))").alias("clean_text"))
    failed = (F.col("n_words") < base_words) | (100 * F.col("n_repeat_words") > repeat_pct * F.col("n_words"))
    lost = F.when(F.col("word_chars") > 0, F.col("gone") / F.col("word_chars")).otherwise(0.0)
    return out.select(*[F.col("x")[c].alias(c) for c in extra], F.col("t").alias(text), *RESULT[:5],
                      failed.alias("base_failed"), "n_lines", "n_bad_lines", lost.alias("lost"),
                      (~failed & (lost <= max_loss)).alias("kept"), "clean_text")
