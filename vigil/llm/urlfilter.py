"""URL filters as a temporal list join.

A list is a log of dated entries: from its day on, a rule is in a state (``block``, ``allow``,
or ``lift``: no longer listed). Per rule the log becomes validity intervals [since, until).
A capture is judged by the rules on its address (domain, host, host and first path part)
that are active on the day it was fetched: an as-of join on the rule key, in which the
intervals of a key are disjoint, so a capture meets one interval a key at most. The most
specific active rule decides. IP addresses have no domain, and names below a shared suffix (co.uk) have one
label more, so that strangers share no rule; a final dot does not hide a host from its rules.

Keys may be hot (one host with a third of all captures): captures are salted by their id and
the intervals, far fewer, repeated per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 8
GRAINS = {"domain": 1, "host": 2, "path": 3}
NEVER = "9999-12-31"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]*)"
_PART = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)"
_ROOT_DOT = r"\.$"
_ADDRESS = r"^\[|(^|\.)[0-9]+$"  # [v6], or a last label that is a number
# Labels under which country registries sell names: one more label belongs to the domain.
SECOND_LEVELS = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "nom", "or", "org")
_SHARED = rf"(?:{'|'.join(SECOND_LEVELS)})\.[a-z]{{2}}"
_UNDER_SHARED = rf"(^|\.){_SHARED}$"
_LONG_DOMAIN = rf"([^.]+\.{_SHARED})$"
_DOMAIN = r"([^.]+\.[^.]+)$"


def host_of(url: Column) -> Column:
    """The host in lower case, without the root's final dot; IPv6 addresses keep their brackets; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), _ROOT_DOT, "")


def is_address(host: Column) -> Column:
    """Whether a host is an IP address and not a name."""
    return host.rlike(_ADDRESS)


def domain_of(host: Column) -> Column:
    """The registered domain of a host name: its last two labels, three below a shared suffix such as co.uk.
    Empty for addresses, single labels and shared suffixes themselves."""
    long_form = F.regexp_extract(host, _LONG_DOMAIN, 1)
    return F.when(is_address(host), "").when(host.rlike(_UNDER_SHARED), long_form).otherwise(F.regexp_extract(host, _DOMAIN, 1))


def rule_keys(url: Column) -> dict[str, Column]:
    """The key of each grain; null where the address has none."""
    host = host_of(url)
    some = lambda key, if_: F.when(if_ != "", key)
    domain = domain_of(host)
    part = F.regexp_extract(url, _PART, 1)
    return {"domain": some(domain, domain), "host": some(host, host), "path": F.when(host != "", some(F.concat(host, part), part))}


def intervals(entries: DataFrame) -> DataFrame:
    """entries (grain, rule, day, state) -> grain, rule, state, since, until; lifted spans are left
    out. Of several entries of a rule on one day the largest state by name counts (lift,
    then block, then allow); entries without rule, day or state are left out."""
    clean = entries.filter("grain IS NOT NULL AND rule IS NOT NULL AND day IS NOT NULL AND state IS NOT NULL")
    daily = clean.groupBy("grain", "rule", "day").agg(F.max("state").alias("state"))
    following = F.lead("day").over(Window.partitionBy("grain", "rule").orderBy("day"))
    spans = daily.select(
        "grain", "rule", "state", F.col("day").alias("since"),
        F.coalesce(following, F.to_date(F.lit(NEVER))).alias("until"),
    )
    return spans.filter("state <> 'lift'")


def judge(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """captures (id, url, fetched) -> id, host, fetched, grain, rule, state, since, blocked; one row
    per distinct (id, url, fetched). A null or hostless address, or a null day, meets no rule
    and is not blocked; no list blocks nothing; other columns are ignored."""
    seen = captures.select("id", "url", "fetched").distinct()
    key = F.xxhash64("id", "url", "fetched")
    keys = rule_keys(F.col("url"))
    candidates = seen.select(
        "id", "url", "fetched", F.pmod(key, F.lit(salts)).cast("int").alias("salt"),
        F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), k.alias("rule")) for g, k in keys.items()])).alias("r"),
    ).select("id", "url", "fetched", "salt", "r.grain", "r.rule")
    spans = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    active = candidates.filter("rule IS NOT NULL AND fetched IS NOT NULL").join(spans, ["grain", "rule", "salt"]).filter(
        "since <= fetched AND fetched < until"
    )
    depth = F.coalesce(*[F.when(F.col("grain") == g, d) for g, d in GRAINS.items()])
    hits = active.select("id", "url", "fetched", F.struct(depth.alias("depth"), "grain", "rule", "state", "since").alias("hit"))
    none = seen.select("id", "url", "fetched", F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"))
    best = hits.unionByName(none).groupBy("id", "url", "fetched").agg(F.max("hit").alias("hit"))
    return best.select(
        "id", host_of(F.col("url")).alias("host"), "fetched", "hit.grain", "hit.rule", "hit.state", "hit.since",
        F.coalesce(F.col("hit.state") == "block", F.lit(False)).alias("blocked"),
    )


def _number(key: Column, at: int) -> Column:
    """A number below 65536 from the MD5 of a key."""
    return F.conv(F.substring(F.md5(key), at, 4), 16, 10).cast("int")


START = "2024-01-01"


def derived_lists(pages: DataFrame) -> DataFrame:
    """List entries for the addresses of ``pages``: each domain, host and first path part is
    listed, lifted and listed again on days that follow from its MD5; one in four is allowed."""
    keys = rule_keys(F.col("url"))
    rules = pages.select(
        F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), k.alias("rule")) for g, k in keys.items()])).alias("r")
    ).select("r.grain", "r.rule").filter("rule IS NOT NULL").distinct()
    first = _number(F.col("rule"), 1) % 365
    lifted = first + 1 + _number(F.col("rule"), 5) % 120
    again = lifted + 1 + _number(F.col("rule"), 9) % 120
    listed = F.when(_number(F.col("rule"), 13) % 4 == 0, "allow").otherwise("block")
    entry = lambda day, state: F.struct(F.date_add(F.to_date(F.lit(START)), day).alias("day"), state.alias("state"))
    log = F.array(entry(first, listed), entry(lifted, F.lit("lift")), entry(again, listed))
    return rules.select("grain", "rule", F.explode(log).alias("e")).select("grain", "rule", "e.day", "e.state")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Pages carry no fetch day and come with no list: both follow from the table (the day from
    page_id, the list from the addresses), so they grow with it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.date_add(F.to_date(F.lit(START)), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int"))
    captures = pages.select(F.col("page_id").alias("id"), "url", fetched.alias("fetched"))
    return judge(captures, derived_lists(pages)).withColumnRenamed("id", "page_id")


def _rule_sql(alias: str) -> str:
    return f"""SELECT page_id, url, host, fetched, 'domain' AS grain, 1 AS depth,
        nullif(CASE WHEN regexp_matches(host, '{_ADDRESS}') THEN '' WHEN regexp_matches(host, '{_UNDER_SHARED}')
                 THEN regexp_extract(host, '{_LONG_DOMAIN}', 1) ELSE regexp_extract(host, '{_DOMAIN}', 1) END, '') AS rule FROM {alias}
      UNION ALL SELECT page_id, url, host, fetched, 'host', 2, nullif(host, '') FROM {alias}
      UNION ALL SELECT page_id, url, host, fetched, 'path', 3, CASE WHEN host <> '' AND regexp_extract(url, '{_PART}', 1) <> ''
                THEN host || regexp_extract(url, '{_PART}', 1) END FROM {alias}"""


def _number_sql(at: int) -> str:
    return f"CAST('0x' || substr(md5(rule), {at}, 4) AS INTEGER)"


ORACLE_SQL = f"""
WITH c AS (SELECT DISTINCT page_id, url, regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '{_ROOT_DOT}', '') AS host,
             CAST(DATE '{START}' + CAST((page_id * 37) % 365 AS INTEGER) AS DATE) AS fetched FROM pages),
    k AS ({_rule_sql("c")}),
    r AS (SELECT DISTINCT grain, rule FROM k WHERE rule IS NOT NULL),
    n AS (SELECT grain, rule, {_number_sql(1)} % 365 AS d1, {_number_sql(5)} % 120 + 1 AS s2, {_number_sql(9)} % 120 + 1 AS s3,
             CASE WHEN {_number_sql(13)} % 4 = 0 THEN 'allow' ELSE 'block' END AS listed FROM r),
    i AS (SELECT grain, rule, listed AS state, CAST(DATE '{START}' + d1 AS DATE) AS since, CAST(DATE '{START}' + (d1 + s2) AS DATE) AS until FROM n
      UNION ALL SELECT grain, rule, listed, CAST(DATE '{START}' + (d1 + s2 + s3) AS DATE), DATE '{NEVER}' FROM n),
    h AS (SELECT k.page_id, k.url, k.fetched, k.grain, k.rule, i.state, i.since,
             row_number() OVER (PARTITION BY k.page_id, k.url, k.fetched ORDER BY k.depth DESC) AS place
          FROM k JOIN i ON k.grain = i.grain AND k.rule = i.rule AND i.since <= k.fetched AND k.fetched < i.until)
SELECT c.page_id, c.host, c.fetched, h.grain, h.rule, h.state, h.since, coalesce(h.state = 'block', false) AS blocked
FROM c LEFT JOIN h ON h.place = 1 AND c.page_id = h.page_id AND c.url = h.url AND c.fetched = h.fetched
"""
