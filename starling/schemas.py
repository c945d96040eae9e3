"""Kinds of relations, nodes and maps, and the schemas of the engine's tables."""

from __future__ import annotations

from enum import IntEnum


class Relation(IntEnum):
    """Codes of edge files."""

    RETWEET = 0
    TWEET_RETWEET = 1
    USER_HASHTAG = 2
    HASHTAG_PAIR = 3
    RESPONSE = 4
    MENTION = 5


class MapKind(IntEnum):
    """Codes of node map files."""

    USER_ID = 0
    RETWEETED_USER_ID = 1
    TWEET_ID = 2
    HASHTAG = 3


#: Schemas are DDL texts, so that importing them needs no session.
_USER_FIELDS = "id: bigint, screen_name: string, name: string, description: string, location: string, url: string, created_at: timestamp, verified: boolean, geo_enabled: boolean, lang: string, time_zone: string, utc_offset: int, friends_count: int, followers_count: int, favourites_count: int, statuses_count: int, listed_count: int"
_POST_FIELDS = (
    ("id", "bigint"), ("created_at", "timestamp"), ("text", "string"), ("truncated", "boolean"), ("possibly_sensitive", "boolean"), ("source", "string"),
    ("retweet_count", "int"), ("favourited_count", "int"), ("favorited", "boolean"), ("in_reply_to_status_id", "bigint"), ("in_reply_to_user_id", "bigint"),
    ("in_reply_to_screen_name", "string"), ("hashtagEntities", "string"), ("hashtagEntitiesArray", "array<string>"), ("userMentionEntities", "string"),
    ("userMentionEntitiesArray", "array<string>"), ("urlEntities", "string"), ("urlEntitiesArray", "array<string>"), ("user", f"struct<{_USER_FIELDS}>"),
)
_NESTED = ", ".join(f"{name}: {kind}" for name, kind in _POST_FIELDS)

POST = ", ".join(f"{name} {kind}" for name, kind in _POST_FIELDS) + f", retweeted_status struct<{_NESTED}>"
EDGE = "rel int, src string, dst string, weight bigint"
EDGE_T = "rel int, src string, dst string, bucket double, weight bigint"
TWEET_EDGE = "rel int, src string, dst string, t_src double, t_dst double"
NODE_MAP = "original string, node string, map_type int"
MEMBERSHIP = "graph string, resolution double, name string, type string, community bigint"
MEMBERSHIP_T = "name string, slice string, community bigint"
