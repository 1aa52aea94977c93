"""Operators of a large-scale training-data pipeline.

One module per operator; ``queries.py`` registers them. Nothing outside this
subpackage imports it (``__spark_entry__.py`` adds its queries only if it can
be imported). Every operator takes and returns DataFrames, keeps its input's
rows whole, and writes intermediate tables only under the shared folder of
``spark.checkpoint.dir`` (:func:`distkpi.llm.common.materialize`).
"""
