from __spark_entry__ import entry, oracle_sql, queries


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["accuracy", "recall", "precision", "f_beta"]
    assert df.count() == 1


def test_oracle_keys_are_queries():
    assert set(oracle_sql()) <= set(queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_is_builtin_and_not_single_partition_over_items(spark):
    from tests.conftest import SF01
    plan = _plan(queries()["classify_and_score"](spark, SF01))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "BroadcastNestedLoopJoin" in plan or "BroadcastExchange" in plan


def test_scans_prune_columns(spark):
    from tests.conftest import SF01
    plan = queries()["nearest_support"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in plan


def test_headline_plans_stay_in_the_jvm(spark):
    from tests.conftest import SF001
    names = ["sample_balanced_pairs", "episode_pairs", "one_shot_hit", "pad_post_trunc_tail", "augment_pairs",
             "episode_query_pairs", "early_stop"]
    for n in names:
        plan = _plan(queries()[n](spark, SF001))
        for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
            assert node not in plan, (n, node)


def test_entry_survives_a_failing_import_of_the_training_data_queries(monkeypatch):
    import sys
    import warnings

    import __spark_entry__ as entry
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)          # importing it raises ImportError
    for name in [m for m in sys.modules if m.startswith("kshot.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert "classify_and_score" in entry.queries() and not any(q.startswith("op") for q in entry.queries())
        assert "pipeline" not in entry.oracle_sql()
