import tempfile


from quarry.operators import centroid as C
from quarry.plans.common import emb
from quarry.streaming.scoring import score_stream
from tests.conftest import SF_SMALL


def test_stream_scoring_equals_batch(spark):
    e = emb(spark, SF_SMALL)
    cents = C.class_average(e.filter("split = 'train'"))
    src = tempfile.mkdtemp(prefix="quarry-src-")
    sink = tempfile.mkdtemp(prefix="quarry-sink-")
    raw = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    raw.repartition(3).write.mode("overwrite").parquet(src)
    q = score_stream(spark, src, cents, sink, checkpoint=tempfile.mkdtemp(prefix="quarry-ck-"))
    q.awaitTermination(120)
    got = {r["vec_id"]: r["pred"] for r in spark.read.parquet(sink).collect()}
    exp = {r["vec_id"]: r["pred"] for r in C.predict_nearest_centroid(e, cents, "cosine").select("vec_id", "pred").collect()}
    assert got == exp
