"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact join.

URLs are brought to a canonical form (scheme, ``www.``/``m.``, default ports, fragments,
tracking parameters and trailing slashes go; parameters are sorted).  The
listed ones set eight bits in one 512-bit block each; a URL whose bits are not
all set is not listed.  The rest are joined to the list itself on the canonical
URL, which removes the false positives.

Scale: the filter is a table of blocks with 16 bits per listed URL, joined on
the block number -- broadcast by the planner while its files are small,
shuffled beyond that -- so it grows with the list and never has to fit a
task.  Only possible hits are shuffled for the exact join.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, stored, table

#: The contract's rules, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words in a host that put a page's URL on the list the query derives.
LISTED_WORDS = ("casino", "pills", "bets", "poker", "lottery", "loans", "replica", "viagra")
BITS_PER_URL, WORDS = 16, 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    return (ascii_lower(F.regexp_extract(u, r"://([^/?#]*)", 1)), F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1))


def canonical(url: Column) -> Column:
    """The form in which URLs are listed; empty without a host."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)")))
    params = F.array_join(kept, "&")
    path = F.regexp_replace(path, r"/+$", "")
    return F.when(host == "", F.lit("")).otherwise(F.concat(host, path, F.when(params == "", F.lit("")).otherwise(F.concat(F.lit("?"), params))))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (like ``net/``) and its verdict, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks))


def _bit(key: Column, i: int) -> Column:
    """The key's bit in word ``i`` of its block."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64)).cast("int"))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """``block, w0 .. w7`` of the distinct keys in ``listed.key``."""
    key = F.col("key")
    return listed.groupBy(_block(key, blocks).alias("block")).agg(*[F.bit_or(_bit(key, i)).alias(f"w{i}") for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """Judges every page's URL.

    Input: ``page_id, url`` and ``listed.url`` (others are ignored).  Output, one
    row per input row: ``page_id, host, path, rule, verdict, canonical``.  A
    fitting rule decides; otherwise a URL is blocked if its canonical form is
    listed.

    URLs that are null or have no ``://`` have an empty host and path and are
    allowed; such entries of the list match nothing.  Repeated rows are judged alike.
    Empty tables give an empty result, or an empty list.
    """
    names = listed.select(canonical(F.col("url")).alias("canonical")).where("canonical <> ''").distinct()
    names = stored(names.withColumn("key", F.xxhash64("canonical")), "urls-listed")
    blocks = names.count() * BITS_PER_URL // (64 * WORDS) + 1
    filled = stored(bloom(names, blocks), "urls-bloom")
    host, path = host_and_path(F.col("url"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("key", F.xxhash64("canonical"))
    tested = p.withColumn("block", _block(F.col("key"), blocks)).join(filled, "block", "left")
    every = F.lit(True)
    for i in range(WORDS):
        bit = _bit(F.col("key"), i)
        every = every & (F.coalesce(F.col(f"w{i}").bitwiseAND(bit), F.lit(0)) != 0)
    tested = stored(tested.withColumn("possible", every)
                    .select("page_id", "host", "path", "rule", "ruled", "canonical", "possible"), "urls-tested")
    out = lambda df, blocked: df.select("page_id", "host", "path", "rule", F.coalesce("ruled", blocked).alias("verdict"), "canonical")
    hits = tested.where("possible").join(names.select("canonical", F.lit(True).alias("listed")), "canonical", "left")
    return out(tested.where("not possible"), F.lit("allow")).unionByName(
        out(hits, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))))


def op7_bloom_urls(spark, sf_dir):
    """Verdicts on all pages, with the URLs on hosts named with a listed word as the list."""
    pages = table(spark, sf_dir, "pages")
    host, _ = host_and_path(F.col("url"))
    return filter_urls(pages, pages.where(host.rlike("|".join(LISTED_WORDS))))


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '://[^?#]*\?([^#]*)', 1), '&'),
                               lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS kept
  FROM pages),
c AS (
  SELECT *, CASE WHEN host = '' THEN '' ELSE
      regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
      || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END END AS canonical,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, 'casino|pills|bets|poker|lottery|loans|replica|viagra') AND canonical <> '')
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END AS verdict, canonical
FROM c
"""
