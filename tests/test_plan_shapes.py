"""What the plans must look like, so that they hold at any size."""

import re

import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = sorted(n for n, f in catalog.QUERIES.items() if n in catalog.ORACLES and n != "semantic_info" and f.__module__ == catalog.__name__)


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python_and_no_cross_join(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert not re.search(r"InPandas|InArrow|ArrowEval|BatchEval|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_scans_read_only_what_is_used(spark):
    schemas = lambda n: re.findall(r"ReadSchema: struct<([^>]*)", plan(catalog.QUERIES[n](spark, SF)))
    assert schemas("url_normalize") == ["page_id:bigint,url:string"]
    assert schemas("sha_content_hash") == ["doc_id:bigint,text:string"]
    assert all("l_comment" not in s and "l_extendedprice" not in s for s in schemas("doc_stats_per_key"))


def test_filters_reach_the_scan(spark):
    text = plan(catalog.QUERIES["scope_filter_chunks"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(label,3\)", text)


def test_rank_limit_comes_before_the_shuffle(spark):
    text = plan(catalog.QUERIES["sim_threshold_after_limit"](spark, SF))
    assert "WindowGroupLimit" in text and text.index("Filter (isnotnull(score") < text.index("Window ")
