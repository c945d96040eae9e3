from datetime import datetime, timedelta

from pyspark.sql import functions as F

from starling.schemas import Relation
from starling.streaming.edges import drained

START = datetime(2024, 1, 1)
POST = "id long, created_at timestamp, text string, user struct<id: long, screen_name: string>, hashtagEntities string, in_reply_to_user_id long, userMentionEntities string, retweeted_status struct<id: long, user: struct<id: long, screen_name: string>, created_at: timestamp, text: string>"


def post(i, hours):
    return (i, START + timedelta(hours=hours), "t", (i % 3, "s"), "a", -1, None, (0, (9, "s"), START, "r"))


def test_late_rows_and_a_second_run(spark, tmp_path):
    """Days are appended once the watermark has passed them; a row later than the delay is left out; a second run goes on from the checkpoint."""
    source, out = str(tmp_path / "posts"), str(tmp_path / "days")
    run = lambda: {(r.src, r.bucket.date().isoformat()): r.weight for r in drained(spark.readStream.schema(POST).parquet(source), out, "day", [Relation.RETWEET], delay="6 hours").collect()}
    spark.createDataFrame([post(0, 1), post(3, 2), post(1, 26), post(2, 80)], POST).write.parquet(source)
    assert run() == {("u:0", "2024-01-01"): 2, ("u:1", "2024-01-02"): 1}
    spark.createDataFrame([post(6, 3), post(2, 79), post(1, 200)], POST).write.mode("append").parquet(source)
    assert run() == {("u:0", "2024-01-01"): 2, ("u:1", "2024-01-02"): 1, ("u:2", "2024-01-04"): 2}
    assert spark.read.parquet(source).select(F.count("*")).first()[0] == 7
