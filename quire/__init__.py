"""quire: DataFrame operators for research-pipeline data work on Spark.

Subpackages
-----------
sources    readers and writers (parquet tables, JSON, JSONL, TSV, text records)
functions  Column -> Column helpers (text, JSON extraction, LaTeX, numerics)
operators  DataFrame -> DataFrame operators grouped by domain
plans      shared derived inputs, distributed ordering helpers, query registry
streaming  Structured Streaming twins of the stateful batch operators
"""

__version__ = "0.1.0"
