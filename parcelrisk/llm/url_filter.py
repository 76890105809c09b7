"""URL filters: rules by host and path, and a list of canonical URLs, behind one blocked Bloom filter.

Every URL asks for few keys: its canonical form, and its host suffixes with prefixes of its path in the shapes that rules have. A
blocked Bloom filter of all listed keys passes what may be listed; an exact hash join then removes false positives. Most keys end at
the filter, inside the scan's stage: only possible hits are shuffled.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelrisk.llm.common import Scratch, spread_join

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
BLOCK_WORDS, PAGE_BLOCKS = 8, 1024  # a block is one cache line of 512 bits; a row of the filter holds 64 KiB
KEYS_A_BLOCK = 32  # 16 bits a key
MOST_BLOCKS = 1 << 20  # the filter never exceeds 64 MiB; a longer list only means more false positives for the exact join


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """host/path?query without scheme, leading ``www.``, default port, final slashes, fragment and tracking parameters; parameters are sorted. Null without a host."""
    bare = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)?$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    asked = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))), "&")
    return F.when(bare != "", F.concat(bare, F.regexp_replace(path(url), "/+$", ""), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")))


def junk_sites(pages: DataFrame, words: list[str], url: str = "url") -> DataFrame:
    """The URLs (column ``url``) whose host has one of ``words`` between its dots and hyphens: a list to filter by, where no other is given."""
    labels = F.split(host(F.col(url)), "[.-]")
    return pages.filter(F.arrays_overlap(labels, F.array(*map(F.lit, words)))).select(F.col(url).alias("url"))


def _hashed(df: DataFrame, blocks: int) -> DataFrame:
    """Row of the filter, first word of the block in it, and the hash that gives each word's bit."""
    block = F.pmod(F.xxhash64("kind", "key"), F.lit(blocks))
    return df.withColumns({"at": F.floor(block / PAGE_BLOCKS).cast("int"), "word": (F.pmod(block, F.lit(PAGE_BLOCKS)) * BLOCK_WORDS).cast("int"), "bits": F.xxhash64("key", "kind")})


def _bit(j: str) -> str:
    return f"shiftleft(1L, cast(shiftrightunsigned(bits, 6 * {j}) & 63 AS int))"


def bloom_filter(entries: DataFrame, blocks: int) -> DataFrame:
    """(at, words): the blocked Bloom filter of the keys (kind, key), 64 KiB of words a row."""
    words = _hashed(entries, blocks).select("at", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1))).alias("j"))
    words = words.groupBy("at", (F.col("word") + F.col("j")).alias("w")).agg(F.bit_or(F.expr(_bit("j"))).alias("v"))
    size = PAGE_BLOCKS * BLOCK_WORDS
    every = entries.sparkSession.range(-(-blocks // PAGE_BLOCKS) * size).select(F.floor(F.col("id") / size).cast("int").alias("at"), (F.col("id") % size).cast("int").alias("w"))
    filled = every.join(words, ["at", "w"], "left").groupBy("at").agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0)).alias("v")))).alias("all"))
    return filled.select(F.col("at").alias("at_f"), F.col("all.v").alias("words"))


def may_be_listed(keys: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``keys`` (kind, key, ...) that the filter passes: all listed ones, and few others."""
    tests = " AND ".join(f"(get(words, word + {j}) & {_bit(str(j))}) <> 0" for j in range(BLOCK_WORDS))
    return _hashed(keys, blocks).join(F.broadcast(bloom), (F.col("at") == F.col("at_f")) & F.expr(tests)).select(*keys.columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url", most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block); columns of these names are replaced.

    ``rules`` (host, path, verdict): a rule fits its host and all subdomains of URLs whose path starts with the rule's; of those that
    fit, the longest (host and path together, then host) wins, and block wins over allow for one host and path. Where none fits,
    ``rule`` is null and a URL whose canonical form is that of a ``listed`` (url) one is blocked, any other allowed. Null URLs and those
    without ``://`` have empty host and path, fit no rule and are allowed. Repeated pages stay; empty rules, lists and pages are fine.
    URLs of any length count whole. The shapes of the rules (numbers of labels, lengths of paths) reach the driver, the rules do not.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    rules = rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict").filter("h <> ''")
    ruled = rules.groupBy("h", "p").agg(F.max("verdict").alias("verdict")).select(F.lit(0).alias("kind"), F.concat("h", "p").alias("key"), F.length("h").alias("h_chars"), "verdict")
    urls = listed.select(canonical(F.col("url")).alias("key")).filter("key IS NOT NULL").distinct().select(F.lit(1).alias("kind"), "key", F.lit(0).alias("h_chars"), F.lit("block").alias("verdict"))
    entries = scratch.write(ruled.union(urls), "entries")
    shapes = sorted(map(tuple, rules.select(F.size(F.split("h", r"\.")), F.length("p")).distinct().collect()))
    blocks = max(1, min(most_blocks, -(-entries.count() // KEYS_A_BLOCK)))
    bloom = scratch.write(bloom_filter(entries, blocks), "bloom")
    row, link = F.struct(*(F.col(f"`{c}`") for c in pages.columns)), F.coalesce(F.col(f"`{url}`"), F.lit(""))
    asked = pages.select(link.alias("u")).select("u", host(F.col("u")).alias("h"), path(F.col("u")).alias("p")).filter("h <> ''")
    by_rule = [F.concat(F.substring_index("h", ".", -n), F.substring("p", 1, k)) for n, k in shapes]
    own = F.struct(F.lit(1).alias("kind"), canonical(F.col("u")).alias("key"))
    keys = F.array_distinct(F.array(own, *[F.struct(F.lit(0).alias("kind"), k.alias("key")) for k in by_rule]))
    asked = asked.select("u", F.explode(keys).alias("k")).select("u", "k.kind", "k.key").filter("key IS NOT NULL")
    hits = scratch.write(may_be_listed(asked, bloom, blocks).distinct(), "hits")
    found = spread_join(hits, entries, ["kind", "key"])
    best = F.max(F.when(F.col("kind") == 0, F.struct(F.length("key").alias("n"), "h_chars", "key", "verdict")))
    decided = scratch.write(found.groupBy("u").agg(best.alias("best"), F.max("kind").alias("listed")), "decided")
    rows = scratch.write(pages.select(row.alias("row"), link.alias("u")), "rows")
    out = spread_join(rows, decided, ["u"], "left")
    verdict = F.when(F.col("best").isNotNull(), F.col("best.verdict")).when(F.col("listed") == 1, "block").otherwise("allow")
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*kept, host(F.col("u")).alias("host"), path(F.col("u")).alias("path"), F.col("best.key").alias("rule"), verdict.alias("verdict"))
