"""Plans are the ones intended: no products of tables, columns and filters reach the scan, limits run before shuffles."""

import pytest
from pyspark.sql import functions as F

from helixframe import adapters, registry
from helixframe.operators import relational

NAMES = [
    "sc_matrix_mean", "sc_cell_qc", "wave_em_step3", "wave_top2", "wave_refine_l1_l2", "bucket_neighborhood", "wave_ksmooth", "wave_propagate_members", "point_in_interval", "interval_overlap", "annotation_params",
    "psv_assign", "psv_merge", "igh_best_copy", "barcode_correct", "concordance", "truth_eval", "validator", "seed_join", "minimizers", "window_features", "region_merge_islands", "cigar_bases", "record_flatten", "variant_lookup",
    "knn_cosine_top5", "similarity_graph", "representatives", "extract_alignments",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_products(spark, small, name):
    plan = plan_of(registry.queries()[name](spark, small))
    assert "CartesianProduct" not in plan
    if name != "psv_assign":  # reads meet the four paralog names
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_scans_read_what_is_used(spark, small):
    plan = plan_of(registry.queries()["wave_coverage_prior"](spark, small))
    schema = plan[plan.index("ReadSchema") :]
    assert "l_quantity" in schema and "l_shipdate" not in schema and "l_tax" not in schema
    plan = plan_of(registry.queries()["prob_filter"](spark, small))
    assert "PushedFilters" in plan and "l_returnflag" in plan[plan.index("PushedFilters") :]


def test_top_k_is_cut_before_the_shuffle(spark, small):
    plan = plan_of(relational.top_k(adapters.weights(spark, small), ["read_id"], [F.desc("w"), F.col("bucket_id")], 3))
    assert "WindowGroupLimit" in plan
