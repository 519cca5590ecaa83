"""Registered queries of the ``llm`` operators and their SQL twins (read by ``__spark_entry__``)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from kshot.llm import decontaminate as op4
from kshot.llm import exact_dedup as op13
from kshot.llm import langid as op7
from kshot.llm import line_rules as op5
from kshot.llm import max_sketch_search as op11
from kshot.llm import minhash_join as op10
from kshot.llm import packing as op9
from kshot.llm import phrase_mining as op12
from kshot.llm import pii as op6
from kshot.llm import quality_gbt as op2
from kshot.llm import sql_twins
from kshot.llm import token_counts as op3
from kshot.llm import toxicity as op8
from kshot.llm import warc as op1
from kshot.llm.common import held_out
from kshot.session import shared_dir

QUERIES = {}
ORACLE = {"op1_warc": sql_twins.WARC, "op4_decontaminate": sql_twins.DECONTAMINATE,
          "op5_line_rules": sql_twins.LINE_RULES, "op11_max_sketch_search": sql_twins.SEARCH,
          "op12_phrase_mining": sql_twins.PHRASES, "op13_exact_dedup": sql_twins.EXACT_DEDUP}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc(spark, sf_dir):
    path = shared_dir(spark, "warc")
    op1.write_archive(_table(spark, sf_dir, "pages"), path, min_bytes=0)
    return op1.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                "refers_to", "status")


@query
def op2_quality_gbt(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = op2.train(docs, _table(spark, sf_dir, "labels"))
    return op2.score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op3_token_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return op3.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_decontaminate(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = op4.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit",
                      F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query
def op5_line_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return op5.clean(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                  "base_failed", "kept")


@query
def op6_pii(spark, sf_dir):
    found = op6.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[op6.count("base_spans", k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
                        F.sha2(op6.listed("base_spans").cast("binary"), 256).alias("base_sha256"),
                        op6.listed("spans").alias("spans"))


@query
def op7_langid(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = op7.train(docs)
    return op7.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"),
                                                                     "lang_pred", "score")


@query
def op8_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    out = op8.score(docs, op8.train(docs, _table(spark, sf_dir, "labels"), chain))
    return out.select("doc_id", held_out().alias("held_out"), "p_low_quality", F.col("p_toxic").alias("score"),
                      (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"))


@query
def op9_packing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return op9.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_near_duplicates(spark, sf_dir):
    return op10.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_max_sketch_search(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return op11.search(docs, _table(spark, sf_dir, "benchmark"))


@query
def op12_phrase_mining(spark, sf_dir):
    return op12.mine(_table(spark, sf_dir, "documents").select("text", "lang"))


@query
def op13_exact_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return op13.dedup(docs, history=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
