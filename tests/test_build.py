from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from starling.functions import scalar
from starling.operators import edges as E
from starling.operators import graph as G
from starling.operators import temporal as T
from starling.schemas import Relation

SCHEMA = "id long, created_at timestamp, text string, user struct<id: long, screen_name: string>, hashtagEntities string, userMentionEntities string, in_reply_to_user_id long, retweeted_status struct<id: long, user: struct<id: long, screen_name: string>, created_at: timestamp, text: string, hashtagEntities: string>"


def post(i, tags=None, reply=-1, rt=None, at="2022-02-24T10:00:00", mention=None, user=1):
    inner = None if rt is None else (rt * 100, (rt, f"N{rt}"), datetime(2022, 1, 1), "inner", "x|y")
    return (i, datetime.fromisoformat(at), f"text {i}", (user, f"N{user}"), tags, mention, reply, inner)


@pytest.fixture(scope="module")
def posts(spark):
    rows = [post(1, "B|a|c|a"), post(2, ""), post(3, reply=None), post(4, reply=7), post(5, None, rt=9), post(6, "t", mention="Bob|ann")]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_user_tags_count_repeats_and_keep_the_empty_tag(posts):
    got = {(d, w) for _, _, d, w in rows(E.edges(posts, [Relation.USER_HASHTAG]))}
    assert got == {("h:a", 2), ("h:b", 1), ("h:c", 1), ("h:", 1), ("h:t", 1)}
    dropped = {d for _, _, d, _ in rows(E.edges(posts, [Relation.USER_HASHTAG], drop_empty=True))}
    assert "h:" not in dropped


def test_tag_pairs_have_both_directions_and_a_double_loop(posts):
    got = {(s, d): w for _, s, d, w in rows(E.edges(posts, [Relation.HASHTAG_PAIR]))}
    assert got[("h:a", "h:a")] == 2
    assert got[("h:a", "h:b")] == got[("h:b", "h:a")] == 2
    assert got[("h:b", "h:c")] == 1
    once = {(s, d) for _, s, d, _ in rows(E.edges(posts, [Relation.HASHTAG_PAIR], distinct_tags=True))}
    assert ("h:a", "h:a") not in once


def test_replies_leave_out_missing_and_sentinel(posts):
    assert rows(E.edges(posts, [Relation.RESPONSE])) == [(4, "u:1", "u:7", 1)]


def test_retweets_use_outer_tags_only(posts):
    assert rows(E.edges(posts, [Relation.RETWEET])) == [(0, "u:1", "u:9", 1)]
    assert not [r for r in rows(E.edges(posts, [Relation.USER_HASHTAG])) if r[2] in ("h:x", "h:y")]


def test_mentions_resolve_to_known_users(spark, posts):
    m = E.edges(posts, [Relation.MENTION])
    assert [d for _, _, d, _ in rows(m)] == ["m:ann", "m:bob"]
    names = spark.createDataFrame([("bob", 5)], "screen_name string, user_id long")
    assert [d for _, _, d, _ in rows(E.resolve_mentions(m, names))] == ["m:ann", "u:5"]


def test_tweet_edges_keep_the_latest(spark):
    p = spark.createDataFrame([post(1, rt=2), post(1, rt=2, at="2022-03-01T00:00:00")], SCHEMA)
    (r,) = E.tweet_edges(p).collect()
    assert (r.src, r.dst, r.t_src) == ("t:1", "t:200", 1646092800.0)


def test_node_map_is_distinct(posts):
    got = rows(E.node_map(posts))
    assert len(got) == len(set(got))
    assert ("9", "u:9", 1) in got and ("5", "t:5", 2) in got and ("900", "t:900", 2) in got and ("a", "h:a", 3) in got


def test_week_bucket_in_a_zone_and_its_labels(spark):
    df = spark.createDataFrame([(datetime(2022, 2, 24, 10),)], "t timestamp")
    r = df.select(scalar.bucket("t", "week", "Europe/Rome").alias("b")).select(F.col("b").cast("string").alias("b"), scalar.week_label("b", "Europe/Rome").alias("right"), scalar.week_label("b").alias("compat")).first()
    assert r == Row(b="2022-02-20 23:00:00", right="2022-W08", compat="2022-W07")
    with pytest.raises(ValueError):
        scalar.bucket("t", "month")


def test_bucketed_weights(spark):
    p = spark.createDataFrame([post(i, reply=7, at=t) for i, t in ((1, "2022-02-21T00:00:00"), (2, "2022-02-27T23:00:00"), (3, "2022-02-28T00:00:00"))], SCHEMA)
    assert sorted(r.weight for r in E.edges(p, [Relation.RESPONSE], method="week").collect()) == [1, 2]


def test_degree_filter_counts_rows_of_users_only(spark):
    e = [(0, "u:a", f"u:x{i}", 1) for i in range(10)] + [(0, "u:b", f"u:y{i}", 1) for i in range(11)] + [(2, "u:b", "h:t", 1)]
    kept = {(s, d) for _, s, d, _ in rows(G.degree_filter(spark.createDataFrame(e, "rel int, src string, dst string, weight long"), 11))}
    assert kept == {("u:b", "h:t")}
    many = [(0, "u:b", "u:c", 1)] * 11
    assert G.degree_filter(spark.createDataFrame(many, "rel int, src string, dst string, weight long"), 11).count() == 11


def test_whole_numbers_and_resolutions(spark):
    r = spark.createDataFrame([("881.0", "881", "x")], "a string, b string, c string").select(*(scalar.whole(F.col(c)).alias(c) for c in "abc")).first()
    assert tuple(r) == (881, 881, None)
    assert scalar.resolutions()[0] == 0.1 and scalar.resolutions()[-1] == 1.0
    with pytest.raises(ValueError):
        scalar.resolutions(0.1, 1.0, 20)


def test_inherited_labels(spark):
    s = "name string, community long"
    prev, cur = spark.createDataFrame([("n1", 0), ("n2", 0), ("n3", 1)], s), spark.createDataFrame([("n1", 5), ("n2", 5), ("n3", 6), ("n4", 7)], s)
    assert rows(T.inherit_labels(prev, cur)) == [(5, 0), (6, 1), (7, 2)]


def test_bonus_is_capped(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("d", "e", 1.0)], "src string, dst string, weight double")
    p = spark.createDataFrame([("a", 0, 3), ("b", 0, 5), ("c", 1, 9), ("d", 2, 20), ("e", 2, 20)], "name string, community long, tenure long")
    got = {(r.src, r.dst): round(r.bonus, 6) for r in T.with_bonus(e, p, 0.1, 1.0).collect()}
    assert got == {("a", "b"): 0.4, ("a", "c"): 0.0, ("d", "e"): 1.0}


def test_tenure_breaks_on_gaps(spark):
    m = spark.createDataFrame([("a", "w1", 0), ("a", "w2", 0), ("a", "w4", 0), ("b", "w3", 1)], "name string, slice string, community long")
    assert [r[3] for r in rows(T.tenure(m))] == [1, 2, 1, 1]


def test_surrogates_are_distinct_and_unsigned_on_demand(spark):
    r = spark.range(200).select(scalar.surrogate(F.col("id").cast("string")).alias("s"), scalar.surrogate(F.col("id").cast("string"), True).alias("u")).collect()
    assert len({x.s for x in r}) == 200 and all(int(x.u) == x.s % 2**64 for x in r)


def test_pairs_are_counted_in_parts_that_follow_the_table(spark, monkeypatch):
    from starling.queries import QUERIES, build

    sf = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, QUERIES["tag_cooccurrence"](spark, sf).collect()))
    monkeypatch.setattr(build, "ROWS_A_PART", 1000)
    parts = QUERIES["tag_cooccurrence"](spark, sf)
    assert parts.rdd.getNumPartitions() == 24 and sorted(map(tuple, parts.collect())) == whole
