"""Plan shape: native expressions, pushdown, top-k operators, one regex pass."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from vocspark.plans.registry import QUERIES
from vocspark.operators import enrich as en
from vocspark.operators import filters as fl
from vocspark.operators import rank as rk
from vocspark.sources import fixture as fx
from tests.conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_plans_except_model_hook(spark):
    for name, fn in QUERIES.items():
        if name in ("score_with_model", "train_baseline") or name.startswith("stream_"):
            continue
        plan = _plan(fn(spark, SF_SMALL))
        assert not any(n in plan for n in PYTHON_NODES), name


def test_model_hook_is_one_arrow_hop(spark):
    plan = _plan(E.queries()["score_with_model"](spark, SF_SMALL))
    assert plan.count("MapInPandas") == 1


def test_filters_reach_the_scan(spark):
    d = fl.history_filter(fx.feedback(spark, SF_SMALL), ["Positive"], ["email"], "2024-01-05", "2024-01-20")
    plan = _plan(d)
    pushed = plan[plan.find("PushedFilters"):]
    assert "GreaterThanOrEqual(ts,2024-01-05" in pushed and "LessThan(ts," in pushed
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_column_pruning(spark):
    plan = _plan(fx.documents(spark, SF_SMALL).select("doc_id"))
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_global_top_k_is_take_ordered(spark):
    plan = _plan(rk.urgent_queue(en.enrich_feedback(fx.feedback(spark, SF_SMALL))))
    assert "TakeOrderedAndProject" in plan


def test_per_group_top_k_limits_before_shuffle(spark):
    d = rk.voice_of_customer(fx.feedback(spark, SF_SMALL))
    d._jdf.queryExecution().executedPlan()
    plan = d._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan


def test_tokens_computed_once_in_enrichment(spark):
    plan = _plan(en.enrich_feedback(fx.feedback(spark, SF_SMALL)))
    assert plan.count("regexp_extract_all(lower(text") == 1


def test_word_counts_aggregate_map_side(spark):
    from vocspark.operators import aggregate as ag
    plan = _plan(ag.top_words(fx.feedback(spark, SF_SMALL)))
    assert "partial_count" in plan


def test_stop_words_are_a_hash_set(spark):
    from vocspark.functions import text as tx
    d = fx.feedback(spark, SF_SMALL).select(F.size(tx.content_words("text")))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan.upper()


def test_top_k_adds_fan_in_step_for_many_partitions(spark):
    d = fx.feedback(spark, SF_SMALL).repartition(50)
    small = rk.top_per_group(d, "sentiment", [F.col("id")], 5)
    big = rk.top_per_group(d, "sentiment", [F.col("id")], 5, task_rows=100)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, big.collect()))
    assert "_bucket" in big._jdf.queryExecution().optimizedPlan().toString()


def _subqueries(df) -> int:
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue().count("Subquery:")


def test_report_scalars_run_once(spark):
    """A scalar read by many lines is one subquery, not one per reference."""
    q = E.queries()
    assert _subqueries(q["insights"](spark, SF_SMALL)) == 1          # words map
    assert _subqueries(q["recommendations"](spark, SF_SMALL)) == 1   # words map
    assert _subqueries(q["executive_summary"](spark, SF_SMALL)) == 2  # themes, history
    assert _subqueries(q["batch_vs_history"](spark, SF_SMALL)) == 1
    assert _subqueries(q["share_like_this"](spark, SF_SMALL)) == 1


def _scans(df) -> int:
    """Reads of tables in a plan and its subqueries."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return sum(line.startswith("(") and "Scan parquet" in line for line in buf.getvalue().splitlines())


def test_reports_read_the_batch_twice_at_most(spark):
    q = E.queries()
    for name, most in (("key_metrics", 1), ("group_gap", 1), ("insights", 2), ("recommendations", 2),
                       ("executive_summary", 3)):  # the last one reads the history too
        assert 1 <= _scans(q[name](spark, SF_SMALL)) <= most, name


def test_report_of_an_empty_batch(spark):
    from vocspark.operators import report as rp
    from vocspark.operators.enrich import enrich_feedback
    e = enrich_feedback(fx.feedback(spark, SF_SMALL).limit(0))
    rows = {(r.section_no, r.line_no): r.line for r in rp.report_sections(e).collect()}
    assert (0, 1) not in rows and (3, 1) in rows
    assert rp.kpi_row(e).first().total == 0


def test_length_histogram_scans_texts_once(spark):
    """The min/max subquery reads the per-length aggregate, whose exchange
    the main plan reuses, so the texts are tokenized once."""
    df = E.queries()["length_histogram"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "hashpartitioning(_w" in plan


def test_item_report_tokenizes_and_cleans_once(spark):
    """One token pass for enrichment and aspects, and each sentence cleaned
    once (not once per rule word inside the lambda)."""
    plan = _plan(E.queries()["item_report"](spark, SF_SMALL))
    assert plan.count("regexp_extract_all(lower(text") == 1
    assert plan.count("https?://") == 1


def test_lexicon_join_builds_on_the_lexicon(spark):
    """The word list is broadcast after the size check; the token side streams."""
    df = E.queries()["lexicon_match_join"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [word" in plan and "BuildRight" in plan


def test_broadcast_only_within_the_bound(spark):
    from vocspark.operators.joins import broadcast_if_small
    small = spark.range(3).withColumnRenamed("id", "word")
    assert broadcast_if_small(small, 1) is small             # past the bound: no hint
    hinted = broadcast_if_small(small, 10)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in hinted.lower()
