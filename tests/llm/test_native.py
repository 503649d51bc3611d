"""The operators marked native keep to DataFrame functions, and op1 to a plan without a shuffle."""

import re

from tessera.llm import op1_url, op8_spotsigs

SF = "/root/testdata/sf0.001"
PYTHON = r"InPandas|InArrow|ArrowEval|BatchEval|PythonUDF|CartesianProduct|NestedLoop"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_op1(spark):
    text = plan(op1_url.judge(spark.read.parquet(f"{SF}/pages.parquet"), [0.0] * 9))
    assert not re.search(PYTHON + "|Exchange", text) and "ReadSchema: struct<page_id:bigint,url:string>" in text


def test_op8(spark):
    text = plan(op8_spotsigs.query(spark, SF))
    assert not re.search(PYTHON, text) and "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_op8_join(spark):
    text = plan(op8_spotsigs.similar_query(spark, SF))
    assert not re.search(PYTHON, text)
