"""Plan properties of registered queries (explain "formatted")."""

import io
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

CHECKED = [
    "c2_ned", "c6_reduce_generation", "c7_ned_from_counts", "f7_kruskal_lineitem_stat", "f8_partial_lineitem_stat",
    "g7_topk_share", "p3_quota_sample", "e4_mann_whitney", "e17_mutual_information_events", "b10_sample_per_group",
]


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cartesian_or_row_udf(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # only Arrow-batched Python, and only for tails


def test_scans_read_only_needed_columns(spark):
    plan = _plan(E.queries()["f8_partial_lineitem_stat"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", plan)
    assert schemas == ["struct<l_quantity:double,l_extendedprice:double,l_discount:double>"]


def test_draws_rank_within_hash_bins(spark):
    plan = _plan(E.queries()["b10_sample_per_group"](spark, SF_SMALL))
    ranks = re.findall(r"Arguments: \[row_number\(\)[^\n]*", plan)
    assert ranks and all("_bin" in r for r in ranks)  # a group is never ranked as a whole


@pytest.mark.parametrize("name", ["f1_ttest_stat", "f2_anova_stat", "e1_intrinsic_fraction", "e3_cohens_d", "e9_temp_response", "e10_spread_comparison"])
def test_no_ordering_where_no_rank_is_read(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "Window" not in plan and "row_number" not in plan


def test_metric_is_one_projection(spark):
    plan = _plan(E.queries()["c2_ned"](spark, SF_SMALL))
    assert "Exchange" not in plan  # the metric per position needs no shuffle
