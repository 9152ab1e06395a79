"""Operators that are to be native run no Python on executors."""

import re

import pytest

from tessera.llm import queries


@pytest.mark.parametrize("name", ["op2_mixing", "op4_line_dedup", "op10_chat_formatting"])
def test_plan_holds_no_python(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_plan_has_no_cartesian_product(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoop|LocalCheckpoint", plan)


@pytest.mark.parametrize("name", ["op3_token_counts", "op5_quality_classifier", "op6_toxicity", "op7_quality_rules", "op8_byte_bpe"])
def test_scan_reads_id_and_text_only(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
