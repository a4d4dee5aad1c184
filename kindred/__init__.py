"""kindred: Spark-first entity resolution, record linkage and set decoding.

Sub-packages: ``sources`` (readers and writers), ``functions`` (column expressions
and string metrics), ``operators`` (relational building blocks), ``plans`` (whole
pipelines and the query catalogue), ``streaming`` (resumable micro-batches).
"""
