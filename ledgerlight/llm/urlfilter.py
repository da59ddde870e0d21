"""URL filter (native): blocked Bloom filter, then an exact hash join.

A URL's canonical keys are ``suffix/`` for its host and every parent domain and
``host + path`` without a trailing slash. Each listed key sets ``BITS`` bits in
one 64-bit block, so a probe touches one word. The filter has ``BITS_EACH`` bits for
each key counted. Up to ``LITERAL_BLOCKS`` words are one literal array that a page's row
meets in place; larger filters are a table of words, at most ``MOST_BLOCKS``, that each key
of an undecided URL meets by a broadcast hash join. Keys with a possible hit go to an exact
join with the list, which removes the filter's false positives.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no
rule and is allowed. Repeated rows each get a row. Extra columns are ignored.
An empty list flags nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import ascii_lower, stored

#: (verdict, host, path); a rule fits the host and its subdomains.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Trackers, spam, adult sites, gambling and pill shops, each under every ending it may have.
SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
ENDINGS = ("example.com", "example.net", "example.org")
#: Their canonical URLs; ``filter_urls`` takes any list as a table.
LISTED = tuple(f"{site}.{end}/" for site in SITES for end in ENDINGS)
BITS = 4
BITS_EACH = 24
#: 64-bit words: most in a literal, most in all (some 100 MB as a broadcast).
LITERAL_BLOCKS = 1 << 15
MOST_BLOCKS = 1 << 21


def blocks_for(keys: int) -> int:
    """64-bit words of a filter of ``keys`` keys."""
    return min(MOST_BLOCKS, max(64, -(-BITS_EACH * keys // 64)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def canonical_keys(host: Column, path: Column) -> Column:
    """Distinct lookup keys of a URL: host suffixes as sites, and the page itself."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    sites = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(labels, i, n), "."), F.lit("/")))
    page = F.concat(host, F.regexp_replace(path, "/+$", ""))
    return F.when(host != "", F.array_distinct(F.concat(sites, F.array(page)))).otherwise(F.array().cast("array<string>"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(1))
    m = None
    for i in range(BITS):
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(h, i * 8), F.lit(64)).cast("int"))
        m = bit if m is None else m.bitwiseOR(bit)
    return m


def bloom_table(listed: DataFrame, blocks: int) -> DataFrame:
    """b, m: the filter's words that aren't 0, at most ``blocks``."""
    return listed.select(_block(F.col("key"), blocks).alias("b"), _mask(F.col("key")).alias("m")).groupBy("b").agg(F.bit_or("m").alias("m"))


def bloom_blocks(listed: DataFrame, blocks: int) -> list[int]:
    """All words in order, for a literal: at most ``blocks`` rows reach the driver."""
    words = [0] * blocks
    for r in bloom_table(listed, blocks).collect():
        words[r.b] = r.m
    return words


def possible_hits(probes: DataFrame, table: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``probes`` (url, key) that a filter of ``table``'s words lets pass."""
    key = F.col("key")
    met = probes.withColumn("b", _block(key, blocks)).join(F.broadcast(table), "b")  # at most MOST_BLOCKS words
    return met.where(F.col("m").bitwiseAND(_mask(key)) == _mask(key)).select("url", "key")


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    name, verdict = None, None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    null = F.lit(None).cast("string")
    return (null, null) if name is None else (name, verdict)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, blocks: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``; ``listed`` has ``key``."""
    known = listed.where("key IS NOT NULL").select("key").distinct()
    blocks = blocks or blocks_for(known.count())
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    keys = canonical_keys(F.col("host"), F.col("path"))
    base = base.withColumns({"rule": rule, "ruled": ruled})
    if blocks > LITERAL_BLOCKS:
        open_keys = base.where("ruled IS NULL").select("url", F.explode(keys).alias("key"))
        passed = possible_hits(open_keys, stored(bloom_table(known, blocks), "filter"), blocks).distinct()
        hits = stored(passed.join(known, "key").select("url").distinct(), "hits").withColumn("hit", F.lit(True))
        verdict = F.coalesce("ruled", F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict")
        return base.join(hits, "url", "left").select("page_id", "host", "path", "rule", verdict)
    words = bloom_blocks(known, blocks)
    filt = F.expr("array(" + ",".join(f"{w}L" if w > -(2**63) else "-9223372036854775808" for w in words) + ")")
    possible = F.exists(keys, lambda k: F.element_at(filt, _block(k, blocks) + 1).bitwiseAND(_mask(k)) == _mask(k)) if any(words) else F.lit(False)
    # Rules win over the list, so only URLs without one are looked up.
    flagged = base.withColumn("maybe", F.col("ruled").isNull() & possible)
    if any(words):
        flagged = stored(flagged.withColumn("url", F.when(F.col("maybe"), F.col("url"))), "flagged")
    probes = flagged.where("maybe").select("url", F.explode(keys).alias("key")).distinct()
    hits = probes.join(known, "key").select("url").distinct().withColumn("hit", F.lit(True))
    verdict = F.coalesce("ruled", F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict")
    exact = flagged.where("maybe").join(hits, "url", "left").select("page_id", "host", "path", "rule", verdict)
    clear = flagged.where(~F.col("maybe")).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    return clear.unionByName(exact)


def listed_frame(spark: SparkSession, keys: Sequence[str] = LISTED) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")


def sql(rules: Sequence[tuple[str, str, str]] = RULES, listed: Sequence[str] = LISTED) -> str:
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True))
    hit = " OR ".join(
        f"host = '{k[:-1]}' OR ends_with(host, '.{k[:-1]}')" if k.endswith("/") else f"host || regexp_replace(path, '/+$', '') = '{k}'" for k in listed
    ) or "false"
    return f"""
    WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    p AS (SELECT page_id,
        coalesce(translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') AS path FROM r)
    SELECT page_id, host, path, CASE {rule} END AS rule,
        CASE {verdict} WHEN {hit} THEN 'block' ELSE 'allow' END AS verdict
    FROM p"""
