"""Micro-batch scoring: the reference's chunked prediction over a growing
set of vector files, as a Structured Streaming query.

The fitted class-average model is a small literal, so each micro-batch is a
narrow projection (no state, no shuffle); progress and exactly-once output
are tracked in a checkpoint under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import centroid as C
from quarry.session import scratch_path

VECTOR_SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()),
                              T.StructField("embedding", T.ArrayType(T.FloatType())),
                              T.StructField("label", T.IntegerType())])


def score_stream(spark: SparkSession, source: str, centroids: DataFrame, sink: str, sim: str = "cosine",
                 checkpoint: str | None = None, available_now: bool = True, max_files_per_trigger: int = 64):
    """Start a streaming query that scores every new parquet file of
    ``source`` and appends (vec_id, label, pred) to ``sink``."""
    labels, vectors = C.fetch_centroids(centroids)
    stream = (spark.readStream.schema(VECTOR_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source)
              .select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")))
    scored = C.predict_nearest_centroid_literal(stream, labels, vectors, sim).select("vec_id", "label", "pred")
    w = (scored.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint or scratch_path(spark, "score-stream-ckpt")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(sink)
