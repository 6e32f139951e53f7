from tixspark.plans import ingest

from conftest import SF001


def test_messages_are_decoded_once(spark):
    """The filters on what validation found must not be put back below it with all that they are computed from."""
    plan = ingest.q_publish_events(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_entries(") == 1
