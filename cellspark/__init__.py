"""cellspark: a Spark-first analytics engine for planar cell polygons."""
