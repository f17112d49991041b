"""Plan shape of headline queries: pruning, no cartesian product, no single-task window."""

import re

import pytest

from gsx.plans import catalog

SF = "/root/testdata/sf0.001"
CATALOG = catalog()


def plan(spark, name):
    df = CATALOG[name].run(spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["a7_signed_auc_lines", "t5_functionals", "t8_perturbation", "l1_content_dedup", "l1_copy_report",
     "e6_transfer_matrix", "e9_roc_points", "e12_confidence_cascade", "u6_undersample", "u5_seeded_shuffle"],
)
def test_no_cartesian_and_no_single_partition_window(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Exchange SinglePartition" not in text or name == "u5_seeded_shuffle"


def test_scan_reads_only_needed_columns(spark):
    text = plan(spark, "s7_column_subset_scan")
    assert re.search(r"PushedFilters: \[.*EqualTo\(o_orderstatus,F\)", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "o_comment" not in schema and "o_custkey" not in schema


def test_content_dedup_shuffles_no_text(spark):
    text = plan(spark, "l1_content_dedup")
    keys = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and all("text" not in k for k in keys)


@pytest.mark.parametrize("name", ["e4_within_domain", "e5_cross_domain", "e6_transfer_matrix_lines"])
def test_line_matrix_repeats_no_row_per_cell(spark, name):
    text = plan(spark, name)
    assert "explode" not in text and "rangepartitioning" not in text and "MapInArrow" in text
