"""Registered queries against their SQL twins at the smallest scale.

All of them run with FULL=1; by default a cross-section keeps the suite short.
"""
import os

import pytest

from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SHORT = ("a06_reconciled_plots", "a13_replay_safe_read", "b06_structured_degradation", "b17_radial_filter", "c01_zonal_join", "c06_voronoi_crowns", "c13_instance_vote",
         "c17_point_in_polygon", "c23_interpolating_join", "d04_treetops", "d10_plot_footprint_metrics", "d14_voxel_metrics", "d24_angular_coverage", "d42_isotonic_radius",
         "d52_rumple", "e09_leave_one_out_order_statistic", "i04_leave_one_stand_out", "i16_permutation_test", "j13_best_subset", "k04_incremental_distillation")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def names():
    from canopyframe.plans import ORACLES
    return list(ORACLES) if os.environ.get("FULL") else [n for n in SHORT if n in ORACLES]


@pytest.mark.parametrize("name", names())
def test_equal(spark, con, name):
    from canopyframe.plans import ORACLES, QUERIES
    msg, _, ok = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES[name])
    assert ok, msg


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
