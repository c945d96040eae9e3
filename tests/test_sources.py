import json

import pytest
from pyspark.sql import functions as F

from starling.plans.config import Config
from starling.sources import readers, sinks
from starling.streaming.edges import tenure_stream


def test_edge_files_drop_bad_rows(spark, tmp_path):
    (tmp_path / "e.csv").write_text("0,a,b,3\n0,a,b\n2,a,t,x\n4,a,c,2.0\n0,a,b,1,9\n\n")
    got = sorted(map(tuple, readers.edge_file(spark, str(tmp_path / "e.csv")).collect()))
    assert got == [(0, "a", "b", 3), (4, "a", "c", 2)]
    got = readers.edge_file(spark, str(tmp_path / "e.csv"), bucketed=True).collect()
    assert [tuple(r) for r in got] == [(0, "a", "b", 1.0, 9)]


def test_extended_json(spark, tmp_path):
    post = {"id": 1, "created_at": {"$date": "2022-02-24T10:00:00Z"}, "text": "x", "user": {"id": 2, "created_at": {"$date": "2020-01-01T00:00:00Z"}}}
    (tmp_path / "p.json").write_text(json.dumps(post))
    r = readers.ejson_posts(spark, str(tmp_path / "p.json")).select(F.col("created_at").cast("string"), "user.id", "retweeted_status").first()
    assert tuple(r) == ("2022-02-24 10:00:00", 2, None)


def test_partition_round_trip(spark, tmp_path):
    m = spark.createDataFrame([(0.1, "a", "u", 4), (0.2, "a", "u", 5), (0.1, "b", "h", 6)], "resolution double, name string, type string, community long")
    sinks.partition_table(m, [0.1, 0.2], str(tmp_path / "p"))
    got = readers.partition_file(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, m.collect()))


def test_labels_like_floats_match(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,name,type,0.1\n0,a,u,881.0\n1,b,u,\n")
    assert [r.community for r in readers.partition_file(spark, str(tmp_path / "p.csv")).collect()] == [881]


def test_snapshot_and_relations(spark, tmp_path):
    e = spark.createDataFrame([(0, "a", "b", 1), (2, "a", "t", 1)], "rel int, src string, dst string, weight long")
    sinks.by_relation(e, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).where("rel = 2").count() == 1
    sinks.snapshot(e.select("src"), e, str(tmp_path / "g"))
    v, e2 = readers.snapshot(spark, str(tmp_path / "g"))
    assert (v.count(), e2.count()) == (2, 2)


def test_chunks(spark):
    from datetime import datetime

    days = list(readers.date_chunks(datetime(2022, 1, 1), datetime(2022, 1, 4)))
    assert [(a.day, b.day) for a, b in days] == [(1, 3), (3, 4)]
    assert sorted(map(tuple, readers.id_chunks(spark.range(5, 26), "id", 10).collect())) == [(5, 15), (15, 25), (25, 26)]
    assert readers.id_chunks(spark.range(0), "id", 10).collect() == []
    far = spark.createDataFrame([(0,), (10**18,)], "id long")
    assert readers.id_chunks(far, "id", 1000).limit(3).count() == 3  # a billion million ranges, made only as far as they are read


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(100)
    one, two = (sorted(r.id for r in readers.sample(df, 10).collect()) for _ in range(2))
    assert len(one) == 10 and one == two


def test_config_defaults_and_unknown_names():
    c = Config.of({"graph": {"method": "week"}, "community": {"hierarchical": {"top_k": 5}}})
    assert (c.graph.method, c.community.hierarchical.top_k, c.community.hierarchical.min_size) == ("week", 5, 30)
    with pytest.raises(ValueError, match="unknown"):
        Config.of({"graph": {"colour": 1}})


def test_streamed_tenure_equals_batch(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 4, 0), ("b", 1, 3), ("b", 2, 4)], "name string, slice long, community long").write.parquet(path)
    stream = spark.readStream.schema("name string, slice long, community long").parquet(path)
    q = tenure_stream(stream).writeStream.outputMode("append").format("memory").queryName("tenures").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("tenures").collect()))
    assert got == [("a", 1, 0, 1), ("a", 2, 0, 2), ("a", 4, 0, 1), ("b", 1, 3, 1), ("b", 2, 4, 1)]
