"""URL filters: rules on host and path, and a verdict by link-graph propagation for the rest.

A rule names a host (and so all its subdomains) and how the path begins; the
longest that fits decides. Hosts whose pages mostly fall under allow rules are
trusted seeds, hosts whose pages mostly fall under block rules are blocked
seeds. Trust runs from the trusted seeds along links (personalised PageRank);
distrust runs from the blocked seeds against the links, to those that point at
them. Both are iterated in one join and one sum over the edges of the host
graph, until no host's rank changes by more than ``TOLERANCE`` of an even share
(each round shrinks what is missing by the damping, so this ends), and a host is
blocked if its distrust is at least ``share`` of its trust and distrust together and at least ``floor``
times what an even spread would give it.

Only DataFrame functions are used. Defined results: a null url, or one without
``://``, has an empty host and path, takes no part in the graph and is allowed
unless a rule fits; null html has no links; a link to its own host is left out;
repeated rows count each time; an empty table gives no rows; extra columns are
ignored. Rules are written into the plan, so their
number should stay in the hundreds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

Rule = tuple[str, str]  # (verdict, "host/path")
#: Ranks have settled if they change by less than this share of 1 / number of hosts, and rounds between two looks.
TOLERANCE, STEPS = 1e-4, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query.
RULES: tuple[Rule, ...] = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, its verdict): the longest rule that fits, null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links of pages to other hosts."""
    found = F.regexp_extract_all(F.col("html"), F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\\s>]+)"), F.lit(1))
    links = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(F.transform(found, lambda h: F.translate(h, UPPER, LOWER))).alias("dst"))
    return links.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float) -> DataFrame:
    """hosts (host, trust0, distrust0: seed shares) with trust and distrust once they have settled."""
    edges = materialize(edges)
    start = hosts.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust0").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("distrust0").alias("seed")))).alias("x")).select("host", "x.kind", "x.seed")
    if edges.isEmpty():
        return hosts.select("host", F.col("trust0").alias("trust"), F.col("distrust0").alias("distrust"))
    # Trust follows the links, distrust goes against them; each end shares what it has among its links by their number.
    out = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    sums = out.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = materialize(out.join(sums, ["kind", "src"]).select(F.col("kind").alias("_kind"), "src", "dst", (F.col("n") / F.col("all")).alias("share")))
    ends = shares.select(F.col("_kind").alias("kind"), F.col("dst").alias("host")).unionByName(shares.select(F.col("_kind").alias("kind"), F.col("src").alias("host")))
    seeds = materialize(start.unionByName(ends.distinct().withColumn("seed", F.lit(0.0))).groupBy("host", "kind").agg(F.max("seed").alias("seed")))
    has_links = shares.select(F.col("_kind").alias("kind"), F.col("src").alias("host")).distinct().withColumn("linked", F.lit(True))
    rank = materialize(seeds.join(has_links, ["kind", "host"], "left").select("host", "kind", "seed", F.coalesce("linked", F.lit(False)).alias("linked"), F.col("seed").alias("rank")))
    number = rank.select("host").distinct().count()
    while True:
        before = rank
        for _ in range(STEPS):
            rank = stepped(rank, shares, damping)
        rank = materialize(rank)
        moved = rank.join(before.select("host", "kind", F.col("rank").alias("was")), ["host", "kind"]).agg(F.max(F.abs(F.col("rank") - F.col("was"))).alias("m")).first().m
        if moved is None or moved * number <= TOLERANCE:
            break
    value = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k)
    return rank.groupBy("host").agg(value("trust"), value("distrust"))


def stepped(rank: DataFrame, shares: DataFrame, damping: float) -> DataFrame:
    """One round of both ranks."""
    sent = rank.where("linked").join(shares, (F.col("host") == F.col("src")) & (F.col("kind") == F.col("_kind"))).groupBy("_kind", "dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
    # What hosts without links hold goes back to the seeds.
    loose = rank.where(~F.col("linked")).groupBy(F.col("kind").alias("_k")).agg(F.sum("rank").alias("loose"))
    rank = rank.join(sent, (F.col("host") == F.col("dst")) & (F.col("kind") == F.col("_kind")), "left").join(F.broadcast(loose), F.col("kind") == F.col("_k"), "left")  # two rows at most
    return rank.select("host", "kind", "seed", "linked", ((1 - damping) * F.col("seed") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("seed") * F.coalesce("loose", F.lit(0.0)))).alias("rank"))


def host_verdicts(judged: DataFrame, edges: DataFrame, damping: float = 0.85, share: float = 0.5, floor: float = 0.5) -> DataFrame:
    """(host, trust, distrust, blocked) for every host of judged (host, by_rule) or of an edge."""
    count = lambda k: F.count_if(F.col("by_rule") == k)
    hosts = judged.where(F.col("host") != "").groupBy("host").agg(F.count("*").alias("n"), count("allow").alias("a"), count("block").alias("b"))
    hosts = hosts.select("host", (2 * F.col("a") > F.col("n")).cast("double").alias("t"), (2 * F.col("b") > F.col("n")).cast("double").alias("d"))
    all_hosts = hosts.agg(F.sum("t").alias("ts"), F.sum("d").alias("ds"))
    seeded = hosts.withColumn("one", F.lit(1)).join(F.broadcast(all_hosts.withColumn("one", F.lit(1))), "one")
    seeded = seeded.select("host", F.when(F.col("ts") > 0, F.col("t") / F.col("ts")).otherwise(0.0).alias("trust0"), F.when(F.col("ds") > 0, F.col("d") / F.col("ds")).otherwise(0.0).alias("distrust0"))
    ranks = materialize(propagate(seeded, edges, damping))
    number = ranks.count()
    both = F.col("trust") + F.col("distrust")
    blocked = (F.col("distrust") > 0) & (F.col("distrust") >= share * both) & (F.col("distrust") * number >= floor)
    return ranks.select("host", "trust", "distrust", blocked.alias("blocked"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each page."""
    host, path = host_and_path(F.col("url").cast("string"))
    split = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, by_rule = fitting(F.col("host"), F.col("path"), rules)
    judged = split.select("page_id", "host", "path", rule.alias("rule"), by_rule.alias("by_rule"))
    verdicts = host_verdicts(judged.select("host", "by_rule"), host_edges(split), **options)
    out = judged.join(verdicts, "host", "left")
    verdict = F.coalesce("by_rule", F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))



def judge_sql(rules: tuple[Rule, ...] = RULES, damping: float = 0.85, rounds: int = 40, share: float = 0.5, floor: float = 0.5) -> str:
    """The verdicts in SQL (DuckDB) over the view pages; as SQL cannot stop by itself, `rounds` rounds are written out one after another."""
    cases = {"rule": "", "by_rule": ""}
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, tail = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{tail}')"
        cases["rule"] += f" WHEN {fits} THEN '{text}'"
        cases["by_rule"] += f" WHEN {fits} THEN '{kind}'"
    steps = ["r0 AS (SELECT kind, host, seed, seed AS rank FROM seeds)"]
    for k in range(rounds):
        steps.append(
            f"r{k + 1} AS MATERIALIZED (SELECT r.kind, r.host, r.seed, (1 - {damping}::DOUBLE) * r.seed + {damping}::DOUBLE * (coalesce(got, 0) + r.seed * coalesce(loose, 0)) AS rank FROM r{k} r"
            f" LEFT JOIN (SELECT s.kind, s.dst AS host, sum(rank * s.share) AS got FROM r{k} x JOIN shares s ON x.kind = s.kind AND x.host = s.src GROUP BY ALL) g ON g.kind = r.kind AND g.host = r.host"
            f" LEFT JOIN (SELECT x.kind, sum(rank) AS loose FROM r{k} x WHERE NOT EXISTS (SELECT 1 FROM shares s WHERE s.kind = x.kind AND s.src = x.host) GROUP BY ALL) l ON l.kind = r.kind)"
        )
    href = r"""(?i)<a\s[^>]*?href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)"""
    return f"""
WITH a AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
judged AS (SELECT page_id, html, host, path, CASE{cases["rule"]} END AS rule, CASE{cases["by_rule"]} END AS by_rule FROM b),
edges AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{href}', 1)), '{UPPER}', '{LOWER}') AS dst FROM judged WHERE host <> '') WHERE src <> dst GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
shares AS (SELECT kind, src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways),
h AS (SELECT host, CASE WHEN 2 * count(*) FILTER (by_rule = 'allow') > count(*) THEN 1.0::DOUBLE ELSE 0 END AS t, CASE WHEN 2 * count(*) FILTER (by_rule = 'block') > count(*) THEN 1.0::DOUBLE ELSE 0 END AS d FROM judged WHERE host <> '' GROUP BY host),
z AS (SELECT sum(t) AS ts, sum(d) AS ds FROM h),
own AS (SELECT 'trust' AS kind, host, CASE WHEN ts > 0 THEN t / ts ELSE 0 END AS seed FROM h, z UNION ALL SELECT 'distrust', host, CASE WHEN ds > 0 THEN d / ds ELSE 0 END FROM h, z
  UNION ALL SELECT kind, src, 0 FROM shares UNION ALL SELECT kind, dst, 0 FROM shares),
seeds AS (SELECT kind, host, max(seed) AS seed FROM own GROUP BY ALL), {", ".join(steps)},
v AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS d, count(*) OVER () AS n FROM r{rounds} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN d > 0 AND d >= {share} * (t + d) AND d * n >= {floor} THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN v ON v.host = j.host"""
