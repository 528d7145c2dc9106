"""windlass: Spark-first analytics for oriented point clouds, winding graphs and meshes."""
