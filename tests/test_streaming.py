import os

from pyspark.sql import functions as F

from conftest import SF001
from tixspark.plans.ingest import ingest_messages, publish_projection, q_pipeline_metrics
from tixspark.sources import contracts as C
from tixspark.streaming.redact_stream import run_available


def test_stream_equals_batch_and_counts(spark):
    msgs = ingest_messages(spark, SF001)
    out, metrics = run_available(spark, msgs)
    streamed = spark.read.parquet(os.path.join(out, "topics")).select("topic", "key").collect()
    valid = C.validate_ingest(msgs).where(F.col("reject_reason").isNull())
    batch = publish_projection(valid).select("topic", "key").collect()
    assert sorted(streamed) == sorted(batch)
    total = msgs.count()
    assert metrics["received"] == total
    assert metrics["processed"] + metrics["rejected"] == total
    assert metrics["rejected"] > 0
    assert metrics["redacted_entities"] == q_pipeline_metrics(spark, SF001).first().redacted_entities > 0
