"""Column expressions of the pipeline: tags, times, labels, ids. All run on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tag_list(c: Column | str, drop_empty: bool = False) -> Column:
    """Lower-cased parts of a pipe-delimited list; null is an empty array, an empty string one empty tag (unless dropped)."""
    parts = F.coalesce(F.split(F.lower(col(c)), r"[|]"), F.array().cast("array<string>"))
    return F.filter(parts, lambda t: t != "") if drop_empty else parts


def pairs(tags: Column | str, distinct: bool = False) -> Column:
    """All unordered pairs (a, b) of the sorted tags; a repeated tag pairs with itself unless distinct."""
    own = F.array_sort(F.array_distinct(col(tags)) if distinct else col(tags))
    tails = F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return F.flatten(tails)


def epoch(c: Column | str) -> Column:
    """Seconds since 1970, with their fraction."""
    return F.unix_micros(col(c).cast("timestamp")) / F.lit(1e6)


def bucket(c: Column | str, method: str, zone: str = "UTC") -> Column:
    """Begin of the day or (Monday) week, in a time zone, as an instant."""
    if method not in ("day", "week"):
        raise ValueError(f"unsupported bucket {method!r}: day or week")
    ts = col(c).cast("timestamp")
    if zone == "UTC":
        return F.date_trunc(method, ts)
    return F.to_utc_timestamp(F.date_trunc(method, F.from_utc_timestamp(ts, zone)), zone)


def week_label(c: Column | str, zone: str = "UTC") -> Column:
    """ISO year and week, YYYY-Www, of an instant seen in a zone (zone UTC on a bucket of another zone is one week early around midnight)."""
    ts = col(c).cast("timestamp")
    local = ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), local).cast("int"), F.weekofyear(local))


def whole(c: Column | str) -> Column:
    """'881.0' and '881' as 881; null if it is no number."""
    return F.expr("try_cast(try_cast(_x AS DOUBLE) AS BIGINT)".replace("_x", c)) if isinstance(c, str) else c.try_cast("double").try_cast("bigint")


def resolution_label(c: Column | str) -> Column:
    return F.format_string("%.1f", col(c).cast("double"))


def resolutions(low: float = 0.1, high: float = 1.0, n: int = 10) -> list[float]:
    """An even grid rounded to one decimal; grids finer than that would collide and are refused."""
    step = (high - low) / (n - 1) if n > 1 else 0.0
    out = [round(low + i * step, 1) for i in range(n)]
    if len(set(out)) < n:
        raise ValueError("resolutions collide after rounding to one decimal")
    return out


def reply_target(c: Column | str) -> Column:
    """The user replied to; null where it is missing or the sentinel -1."""
    return F.nullif(col(c), F.lit(-1))


def any_present(*cs: str) -> Column:
    """At least one of the fields is there."""
    out = F.lit(False)
    for c in cs:
        out = out | F.col(c).isNotNull()
    return out


def conditional_text(compat: bool = False) -> tuple[Column, Column]:
    """(text, type): a retweet shows the text of what it repeats. compat swaps the two type names."""
    is_rt = F.col("retweeted_status").isNotNull()
    kinds = ("normal", "retweet") if compat else ("retweet", "normal")
    return F.when(is_rt, F.col("retweeted_status.text")).otherwise(F.col("text")), F.when(is_rt, kinds[0]).otherwise(kinds[1])


def keyword_match(c: Column | str, keywords: list[str]) -> Column:
    """Any of the keywords (regular expressions), in any case."""
    return col(c).rlike("(?i)" + "|".join(keywords))


def ejson_date(c: Column | str) -> Column:
    """The instant in an extended-JSON {"$date": ...} struct."""
    return F.to_timestamp(col(c).getField("$date"))


def parse_day(c: Column | str) -> Column:
    return F.to_timestamp(col(c), "dd/MM/yyyy")


def parse_instant(c: Column | str) -> Column:
    return F.to_timestamp(col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def report_name(c: Column | str) -> tuple[Column, Column]:
    """(resolution, community) out of candidate_res{r}_comm{c}.csv."""
    pattern = r"candidate_res(.+?)_comm(.+?)\.csv"
    return F.regexp_extract(col(c), pattern, 1), F.regexp_extract(col(c), pattern, 2)


def surrogate(c: Column | str, unsigned: bool = False) -> Column:
    """A 64-bit number for a node key, for joins on narrow columns; as decimal(20,0) if unsigned."""
    h = F.xxhash64(col(c))
    return F.when(h < 0, h.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(h.cast("decimal(20,0)")).cast("decimal(20,0)") if unsigned else h
