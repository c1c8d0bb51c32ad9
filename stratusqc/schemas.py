"""Table schemas, as DDL strings."""

from __future__ import annotations

SPEC = "struct<min:double,max:double,step_max:double,persistence_max:int,unit:string>"
FOREST_NODES = (
    "variable string, tree int, node int, feature int, split double, "
    "left_child int, right_child int, leaf_path double"
)
