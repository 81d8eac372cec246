"""flowgraph: graph, iterative and sparse-matrix analytics as PySpark DataFrame programs."""
