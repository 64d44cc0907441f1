"""Joins whose sides come from multiplied rows must not be broadcast: Spark takes these for as small as the rows they come from."""

import re

import pytest

from tilewright.plans import catalog

MULTIPLIED = [
    "a18_vertex_normals", "a18_vertex_normals_area", "a23_triangle_stats", "f09_must_refine", "m01_initial_mesh", "m04_refresh_elevation", "m05_to_children",
    "m08_weld_vertices", "m09_plane_height", "u06_split_to_sets", "j12_triangle_deviation", "a17_horizon_occlusion", "snk03_write_mesh", "src08_read_mesh_header",
    "src08_read_mesh_normals", "r15_border_activation", "r03_crop", "r04_reproject_nearest", "r04_reproject_back", "r05_resize_to_depth", "j03_sample_nearest",
    "j04_sample_bilinear", "j07_sample_tile_bilinear", "r06_warp_near", "r06_warp_bilinear", "r10_heightmap", "j06_tile_raster", "r06_warp_average", "r06_warp_max",
    "r06_warp_min", "r06_warp_med", "r06_warp_mode", "r06_warp_q1",
]


@pytest.mark.parametrize("name", MULTIPLIED)
def test_multiplied_rows_are_shuffled(spark, inputs, name):
    plan = catalog.ENTRIES[name].build(inputs)._jdf.queryExecution().executedPlan().toString()
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)]
    # pairs of boxes meet in lattice cells, and reduced cells meet the list of tiles: which side is small is left to Spark there
    left = {"_lv, _cx, _cy"} if name.startswith(("r06", "r10", "j06")) else set()
    assert [k for k in keys if k not in left and not (name.startswith("r06_warp") and k == "x, y")] == []
    assert "BroadcastNestedLoopJoin" not in plan
