"""Operators against brute force, edge rows and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import brute_hits, brute_links
from pyspark.sql import functions as F

from kshot.llm import decontaminate as D
from kshot.llm import langid as L
from kshot.llm import line_rules as R
from kshot.llm import minhash_join as M
from kshot.llm import packing as K
from kshot.llm import pii as P
from kshot.llm import quality_gbt as Q
from kshot.llm import token_counts as T
from kshot.llm import toxicity as X
from kshot.llm.bpe_memo import Memo, load

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
CLASH = "score string, n_words int, spans int, label int, text string, doc_id long"


def frame(spark, rows):
    return spark.createDataFrame([("s", 1, 2, 3, t, i) for i, t in rows], CLASH).repartition(3)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "delta.", "eps", "é2", "zeta", "eta", "9"]) + str(rng.randint(0, 30))
                    for _ in range(n))


EDGE = [(1, None), (2, ""), (3, "word"), (4, "a b c d"), (4, "a b c d"), (None, "x y z"), (5, "é" * 300_000), (6, "\n\n \t")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 12, 30]))) for i in range(30)] + [(90, "!!"), (91, None), (92, "one two three")]
    items.append((93, items[4][1].upper()))
    docs = []
    for i in range(120):
        t = prose(rng, rng.randint(0, 80))
        if i % 3 == 0:
            t += " " + rng.choice(items[:30])[1] + "; " + prose(rng, 5)
        docs.append((i, t))
    for i in range(120, 180):          # near copies of one text
        w = docs[0][1].split() + prose(random.Random(1), 60).split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"new{i}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, docs[7][1] * 1) for i in range(20)]
    return docs, items


def test_winnowing_finds_every_shared_window(spark, corpus):
    docs, items = corpus
    it = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(frame(spark, docs), it).collect()
    want = brute_hits(docs, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in got} == want
    kept = D.keep_clean(frame(spark, docs), it)
    assert kept.columns == ["score", "n_words", "spans", "label", "text", "doc_id"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, w in want.items() if not w[1])


def test_decontaminate_edges(spark):
    it = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_hit, r.contaminated) for r in D.decontaminate(frame(spark, EDGE), it).collect())
    assert got == [(0, 0, False), (1, 0, False), (2, 0, False), (3, 0, False), (4, 4, True), (4, 4, True), (5, 0, False), (6, 0, False)]
    assert D.decontaminate(frame(spark, EDGE), it.limit(0)).where("contaminated").count() == 0
    assert D.decontaminate(frame(spark, EDGE[:1]).limit(0), it).count() == 0


@pytest.mark.parametrize("block", [7, 256])
def test_near_duplicates_equal_brute_force(spark, corpus, block):
    docs, _ = corpus
    got = M.near_duplicates(frame(spark, docs), recall=0.999999, block=block).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute_links(docs)


def test_near_duplicate_edges_and_keep_one(spark):
    rows = EDGE + [(7, "a b c d")]
    got = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in M.near_duplicates(frame(spark, rows)).collect())
    assert got == [(0, None, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 2), (4, 4, 2), (5, 5, 0), (6, 6, 0), (7, 4, 2)]
    kept = M.keep_one(frame(spark, rows))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert M.near_duplicates(frame(spark, EDGE[:1]).limit(0)).count() == 0


def test_classes_without_ids_or_with_a_shared_id_stay_apart(spark):
    base = [prose(random.Random(70 + i), 40) for i in range(4)]
    near = [t + " tail" for t in base]              # 36 of 37 shingles in common
    rows = [(None, base[0]), (None, near[0]), (None, base[1]), (None, near[1]), (None, base[1]),
            (7, base[2]), (8, near[2]), (7, base[3]), (9, near[3]), (None, None), (None, "")]
    got = M.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r.class_id, r.class_root is None, r.n_links) for r in got) == {
        (None, False, 1): 2, (None, False, 2): 3, (7, False, 1): 4, (None, True, 0): 2}
    assert sorted(Counter(r.class_root for r in got if r.n_links).values()) == [2, 2, 2, 3]
    kept = Counter(r.text for r in M.keep_one(frame(spark, rows)).collect())
    assert sum(kept.values()) == 6 and kept[None] == kept[""] == 1
    assert all(kept[a] + kept[b] == 1 for a, b in zip(base, near))
    assert kept[base[2]] == kept[base[3]] == 1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(50, 60)], "a long, b long")
    got = {r.node: r.root for r in M.components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 21 for i in range(21, 41)}, 50: 50, 60: 50}


def test_token_counts_equal_the_library(spark):
    rng = random.Random(1)
    alphabet = ["a", "foo", "ñand", " ", "  ", "\n", "\t", ".", ",", "'s", "日", "。", "<|endoftext|>", "　", "\x1c", "ﬁ", "Σ", "İ",
                "́", "_", "👍", "***", "12"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(300)] + ["x" * 5000, "é " * 3000]
    tok = load(BYTE)
    want = [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    by = T.ByTokenizer(tok)
    assert [T.count_long(by, t, 40, 8) for t in texts] == want
    rows = list(enumerate(texts)) + [(9000, None)]
    got = {r.doc_id: r for r in T.count_tokens(frame(spark, rows), BYTE, chunk=64, overlap=16, memo=50).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want and got[9000].n_tokens == got[9000].n_bytes == 0
    assert all(got[i].n_bytes == len(t.encode()) for i, t in enumerate(texts))


def test_memo_equals_the_tokenizer():
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshrdlucmféüß") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for path, lead in ((WORD, ""), (BYTE, " ")):
        memo = Memo(path, not lead, 10)
        use = {lead + w + t for w in words for t in ("", ",", "!)", "'s")}
        memo.learn(use)
        assert all(np.frombuffer(memo.known[w], "<u4").tolist() == memo.tok.encode(w, add_special_tokens=False).ids for w in use)


def test_packing_is_whole_and_gapless(spark, corpus):
    import zlib
    docs = corpus[0] + [(900, None), (901, "long one " * 9000), (902, "")]
    got = K.pack(frame(spark, docs), WORD).collect()
    tok = load(WORD)
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs}
    per, seq = {}, {}
    for r in got:
        per.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert set(per) == set(ids)
    for d, ps in per.items():
        assert sum(p.length for p in ps) == len(ids[d])
    for ps in seq.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == np.cumsum([0] + [p.length for p in ps])[:-1].tolist()
        assert sum(p.length for p in ps) <= ps[0].padded <= 4096
    assert K.pack(frame(spark, docs[:1]).limit(0), WORD).count() == 0


def test_packing_special_strings_in_any_case():
    tok, enc = load(WORD), K.Encoder(WORD)
    texts = ["One <|ENDOFTEXT|> Two", "a<|EndOfText|>b", "<|endoftext|> X<|startoftext|>Y <|StartOfText|>", "plain Words, here",
             "é <|EndOfText|>", "<|ENDOFTEXT|><|endoftext|>"]
    for _ in range(2):                                  # the second time from the memo
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [
            tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_line_rules_base_figures(spark, corpus):
    docs = corpus[0] + EDGE + [(800, "Home | News | Sport\n" + "A good line of prose stands here.\n" * 20), (801, "x y z x y z"),
                               (802, "Accept cookies to read on\n" * 30 + "One real sentence that stays.")]
    sep = re.compile(r"[^\x20\x09-\x0D]+")
    for r in R.clean(frame(spark, docs)).collect():
        t = r.text
        w = sep.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if sep.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        cov = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(cov) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov), failed)
        if r.doc_id == 800:
            assert r.n_bad_lines == 1 and "Home" not in r.clean_text
        if r.doc_id == 802:
            assert r.lost > 0.8 and not r.kept


def test_pii_base_and_added_spans(spark):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
             ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(d):
        two = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))]
        return sum(two) % 10 == 0

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")),
                "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
    rng = random.Random(3)
    parts = ["1", "40", "255", " ", "-", ".", "@", "+", "(", "a", "b.c", "é", "😀", "_", "x@y.z", "+1 (743) 555-3824", "4316522678525456"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))) for i in range(800)] + EDGE[:4] + [
        (5000, "1" * 30_000), (5001, "a." * 20_000 + "@"), (5002, "IBAN GB82 WEST 1234 5698 7654 32, call 555-123-4567"),
        (5003, "id GB82 WEST 1234 5698 7654 33 and 555-123-4567")]
    for r in P.find(frame(spark, rows)).select("doc_id", "text", P.listed("base_spans").alias("b"), P.listed("spans").alias("s")).collect():
        want = sorted((m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p) in enumerate(kinds)
                      for m in re.finditer(p, r.text or "") if ok(n, m.group()))
        assert r.b == ",".join(x[2] for x in want)
        if r.doc_id == 5002:
            assert r.s == "iban:5:32,local:39:51"
        if r.doc_id == 5003:
            assert r.s == ""
    red = {r.doc_id: r for r in P.redact(frame(spark, [(1, "to a@b.co, +1 (743) 555-3824 !"), (2, None)])).collect()}
    assert red[1].text == "to [EMAIL], [PHONE] !" and red[2].text is None and red[1].spans == 2


def test_iban_before_other_words(spark):
    def iban(country, body):                            # check digits by ISO 13616
        n = int("".join(str(int(c, 36)) for c in body + country + "00"))
        return f"{country}{98 - n % 97:02d}{body}"
    plain = [iban("BE", "539007547034"), iban("AT", "1904300234573201"), iban("CZ", "08000000192000145399"),
             iban("GB", "WEST12345698765432"), iban("MT", "MALT011000012345MTLCAST001S")]
    assert [len(x) for x in plain] == [16, 20, 24, 22, 31] and plain[0] == "BE68539007547034"
    spaced = [" ".join(x[i:i + 4] for i in range(0, len(x), 4)) for x in plain]
    after = [" Please pay", " EUR", " 2024", " 2024 EUR 100", " A", " 7", ", then", " " + plain[0], ""]
    texts = [("account ", x, a) for x in plain + spaced for a in after]
    rows = [(i, "".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in P.find(frame(spark, rows)).select("doc_id", "base_spans", "spans").collect()}
    cards = 0
    for i, (lead, x, a) in enumerate(texts):
        want = [(len(lead), len(lead) + len(x))]
        if a.endswith(plain[0]):
            want.append((want[0][1] + 1, want[0][1] + len(a)))
        base = got[i].base_spans                       # digits that pass Luhn by chance are a card, which stays
        cards += len(base)
        want = [w for w in want if not any(b.start < w[1] and w[0] < b.end for b in base)]
        assert [(s.start, s.end) for s in got[i].spans if s.kind == "iban"] == want, rows[i]
    assert cards < len(texts) / 4
    red = P.redact(frame(spark, [(1, f"pay {spaced[0]} Please, {plain[1]} EUR")])).first()
    assert red.text == "pay [IBAN] Please, [IBAN] EUR"
    wrong = [(1, "account BE68 5390 0754 7035 Please pay"), (2, "code ZZ12 3456 7890"), (3, "xBE68539007547034 BE68539007547034x")]
    assert P.find(frame(spark, wrong)).where("exists(spans, s -> s.kind = 'iban')").count() == 0


def test_classifiers_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    from kshot.llm.common import held_out
    model = Q.train(docs, labels)
    z = (Q.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(held_out())
         .select("score", "quality").toPandas())
    assert ((z.score >= 0.7) == (z.quality == 1)).mean() > 0.95
    lang = L.identify(docs, L.train(docs)).where(held_out()).toPandas()
    assert (lang.lang == lang.lang_pred).mean() > 0.97
    chain = X.train(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    t = X.score(docs, chain).join(labels, "doc_id").where(held_out()).toPandas()
    assert (t.p_toxic[t.toxic == 1].mean() > t.p_toxic[t.toxic == 0].mean() + 0.3) and (t.p_toxic[t.toxic == 0] >= 0.5).mean() < 0.05


def test_classifier_edges(spark):
    docs = frame(spark, EDGE).withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(1, 1, None), (3, None, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    s = Q.score(docs, Q.train(docs, labels))
    assert s.count() == len(EDGE) and s.where("score is null or score < 0 or score > 1").count() == 0
    assert Q.score(docs, Q.train(docs, labels.limit(0))).where("score <> 0.5").count() == 0
    assert {r.lang_pred for r in L.identify(docs, L.train(docs)).collect()} == {"und"}
    one = docs.withColumn("lang", F.when(F.col("doc_id") == 3, "en"))
    p = {r.doc_id: r.lang_pred for r in L.identify(one, L.train(one)).collect()}
    assert p[1] == p[2] == p[6] == "und" and p[4] in ("en", "und")
    x = X.score(docs, X.train(docs, labels, {"toxic": F.col("toxic")}))
    assert x.count() == len(EDGE) and x.where("p_toxic is null").count() == 0
    assert X.score(docs, X.train(docs, labels.limit(0), {"toxic": F.col("toxic")})).where("p_toxic <> 0").count() == 0
    assert R.clean(docs).count() == len(EDGE) and T.count_tokens(docs, BYTE).count() == len(EDGE)


def test_trees_flat_traversal_matches_walking():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    m = Q.fit(x, y, trees=30, depth=3)
    want = np.full(len(x), m.base)
    for f, t, leaf in zip(m.feature, m.threshold, m.leaf):
        for i, row in enumerate(x):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > t[at])
            want[i] += leaf[at - len(f)]
    assert np.allclose(m.raw(x), want) and ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_pipeline_stages_keep_clean_documents(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.staged(out, f"t_{name}")
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert max(v[1] for v in brute_links(texts).values()) == 0
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(v[1] for v in brute_hits(texts, items).values())
