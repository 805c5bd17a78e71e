"""Plans of the queries over unblinded ratings where files are small beside the broadcast threshold and tables are not.

The threshold lies above the estimates of single files and below those of their joins, as at a gigabyte with the default.
"""

import re

import pytest

from lexloom.operators import ranks
from lexloom.plans import registry
from lexloom.plans import relations as REL

NAMES = ["system_rank", "three_lens_join", "cohen_kappa", "exact_agreement", "cluster_bootstrap", "gap_bootstrap", "any_rater", "mean_of_item_means", "decode_agreement", "self_consistency", "friedman", "leave_one_out_rho", "score_agreement", "passage_collapse", "rater_matrix", "icc_bootstrap", "one_system_rho", "paired_gap", "rank_rho", "design_effect", "icc", "level_split_rho", "order_swap", "partial_spearman"]


@pytest.mark.parametrize("name", NAMES)
def test_no_growing_table_is_broadcast(name, spark, data):
    query = REL.three_lens if name == "partial_spearman" else registry.QUERIES[name]  # its own result is one local row
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        plan = query(spark, data)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"BroadcastHashJoin \[[^\]]*item_id", plan) and "SortMergeJoin" in plan


def test_many_ranked_values_are_merged(spark):
    df = spark.range(50).selectExpr("id % 3 as g", "id % 7 as v")
    plan = ranks.average_rank(df, ["g"], "v", "r", plain_rows=0)._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"\w+Join", plan).group() == "SortMergeJoin"
