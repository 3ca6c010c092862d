"""vigil: train, score and watch text classifiers on Spark.

Subpackages
-----------
sources    table readers/writers (parquet, CSV edge, JSON batches, manifests)
functions  column expressions (text cleaning, vectors, labels, time, formatting)
operators  DataFrame operators (cumulative sums, KS, ROC, sampling, evaluation, drift, terms)
plans      composed jobs (training/evaluation, monitoring, lineage tables, summaries)
streaming  Structured Streaming jobs (ingest, refresh, scoring, windowed metrics)
"""

__all__ = ["session"]
