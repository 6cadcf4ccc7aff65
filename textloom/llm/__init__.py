"""Operations of a large-scale training-data pipeline, written for Spark.

Nothing outside this subpackage imports it.
"""
