"""Plans of the catalogue: no nested loops over tables, no window over all rows in one task."""

import re

import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Windows and nested loops over rows of a fixed small number: centres, literal tables, sums of ranges, one row of totals.
SMALL = {"canonical_palette_sort", "digit_layout", "exact_dedup_offsets", "global_palette", "kmeans_full", "kmeans_step", "lut_quantize", "monotone_refit", "nearest_center", "pair_search", "reserved_nearest", "tile_size_sweep", "variant_cross", "weighted_quantile_sample"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SMALL))
def test_plan(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert not re.search(r"Window(?!GroupLimit)[^\n]*\n(?:[^\n]*(?:Sort|Project|Shuffle)[^\n]*\n)*[^\n]*SinglePartition", plan)
