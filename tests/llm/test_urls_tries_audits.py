"""URL filters, the conversation trie and the divergence audit against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

from parcelrisk.llm import divergence, list_ranking, prefix_trie, queries, url_filter
from parcelrisk.llm.common import Scratch, scan, spread_join
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
RULE = "host string, path string, verdict string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def canonical(url):
    host, path = parts(url)
    host = re.sub(r":(80|443)?$", "", host.removeprefix("www."))
    query = url.split("#", 1)[0].split("?", 1)[1] if url and "://" in url and "?" in url.split("#", 1)[0] else ""
    asked = "&".join(sorted(p for p in query.split("&") if p and not re.match(r"(utm_[^=]*|ref|fbclid|gclid)(=|$)", p)))
    return host + path.rstrip("/") + ("?" + asked if asked else "") if host else None


def judged(url, rules, listed):
    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    return host, path, None, "block" if canonical(url) is not None and canonical(url) in listed else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://NET/", "https://a.net/x", "https://a.net?x", "https://planet/x", "https://www.Example.net/en/1?b=2&a=1&utm_source=f#t", "http://example.net/en/1?a=1&b=2", "http://x.example.com/de/", "http://x.example.com/de",
    "http://example.com/de/?ref=1", "http://a.org/fr/1", "http://a.org/fr", "http://a.org/en/1/", "http://a.org/en/1", "https://www.a.org:443/en/1#x", "http://a.org:8080/en/1", "HTTP://É.org/Ü/1", "http://É.org/Ü/1/", "http://a.b.c.d.e.f.net/", "http://..net/", "http://x/a://b.net/c",
    "http://a.org/en/1?ref", "http://a.org/en/1?refer=1", "http://long.org/" + "y" * 200_000, "http://a\nb.org/x\ny",
]


def test_urls_are_judged_as_by_brute_force(spark):
    rules = [(h, p, v) for h, p, v in queries.RULES] + [("É.org", "/", "block"), ("long.org", "/" + "y" * 1000, "allow"), ("c.d.e.f.net", "", "allow")]
    listed = ["http://a.org/en/1/?utm_x=1", "http://example.net/en/1?a=1&b=2", "http://gone.org/", None, "junk", "http://a\nb.org/x\ny", "http://a.org/en/1"]
    rows = [(k % 3 or None, u, "mine") for k, u in enumerate(URLS + URLS[5:12])]
    pages = spark.createDataFrame(rows, "page_id int, url string, verdict string")
    args = spark.createDataFrame(rules, RULE), spark.createDataFrame([(u,) for u in listed], "url string")
    known = {canonical(u) for u in listed if u} - {None}
    want = Counter((k, u, *judged(u, rules, known)) for k, u, _ in rows)
    assert Counter(map(tuple, url_filter.judge(pages, *args).select("page_id", "url", "host", "path", "rule", "verdict").collect())) == want
    assert url_filter.judge(pages, *args).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    none = [pages.limit(0), args[0].limit(0), args[1].limit(0)]
    assert url_filter.judge(none[0], *args).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, none[1], none[2]).collect()} == {"allow"}


def test_a_crowded_filter_only_passes_more(spark):
    """One block for thousands of keys passes nearly everything; the exact join still tells what is listed."""
    listed = spark.range(5000).select(F.format_string("http://s%d.org/p", "id").alias("url"))
    pages = spark.range(4000, 6000).select(F.col("id").alias("page_id"), F.format_string("https://www.s%d.org/p/?ref=x", "id").alias("url"))
    out = url_filter.judge(pages, spark.createDataFrame([], RULE), listed, most_blocks=1)
    assert {(r.page_id, r.verdict) for r in out.collect()} == {(k, "block" if k < 5000 else "allow") for k in range(4000, 6000)}
    keys = pages.select(F.lit(1).alias("kind"), url_filter.canonical(F.col("url")).alias("key"))
    entries = keys.limit(0).union(listed.select(F.lit(1), url_filter.canonical(F.col("url"))))
    passed = [url_filter.may_be_listed(keys, url_filter.bloom_filter(entries, b), b).count() for b in (1, 200)]
    assert passed[0] > 1900 and 1000 <= passed[1] < 1050


def test_host_shapes_of_one_hot_url(spark):
    """A third of all rows share one URL: each keeps its row."""
    pages = spark.range(30_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://hot.net/").otherwise(F.format_string("http://c%d.org/", "id")).alias("url"))
    out = url_filter.judge(pages, spark.createDataFrame(queries.RULES, RULE), pages.limit(0).select("url"))
    assert out.groupBy("verdict").count().orderBy("verdict").collect() == [("allow", 20_000), ("block", 10_000)]
    assert out.select("page_id").distinct().count() == 30_000


def trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [v[3:] for v in sorted(vs)] for c, vs in convs.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members, below = defaultdict(list), defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            below[k[:-1]].append(k)

    def subtree(k):
        found = [subtree(j) for j in below[k]] or [(1, 0)]
        return sum(a for a, _ in found), sum(b for _, b in found) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)

    ends = {k: ",".join(map(str, sorted(c for c in m if len(full[c]) == len(k)))) for k, m in members.items()}
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(below[k]), *subtree(k), hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()), key=lambda r: r[:2])


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_equals_brute_force(spark):
    odd = [
        (0, 0, "a", "x"), (0, None, None, "y"), (0, 1, "b", None), (1, 0, "a", "x"), (1, 1, "b", "z"), (1, 1, "b", "w"), (1, 1, "b", "w"), (2, 0, "u", "q"), (205, 3, "k", "k"), (None, 1, "a", "b"), (-7, 0, "a", "x"), (-100, 0, "n", "t"), (-100, 1, "n", "é" * 50_000), (100, 5, "", ""),
    ]
    rows = odd + [(c, i, "u", f"t{i}") for c in range(300, 400) for i in range(c % 9)] + [(c, 0, "s", "same") for c in range(10_000, 25_000, 250)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit(1)), base=7)
    assert [tuple(r) for r in got.orderBy("conv_id", "depth").collect()] == trie(rows)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_trie_with_one_hot_node_and_one_hot_conversation(spark):
    """All begin with one turn, a third are copies, and one conversation has a third of all turns."""
    rows = [(c, t, "u", "start" if t == 0 else f"{c if c % 3 else 0}") for c in range(0, 60_000, 100) for t in range(2)] + [(60_000, t, "u", str(t)) for t in range(600)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS), base=100)
    assert [tuple(r) for r in got.orderBy("conv_id", "depth").collect()] == trie_flat(rows)


def trie_flat(rows):
    """As ``trie``, without deep recursion: subtree sums from the deepest node up."""
    import sys

    held = sys.getrecursionlimit()
    sys.setrecursionlimit(10_000)
    try:
        return trie(rows)
    finally:
        sys.setrecursionlimit(held)


def test_list_ranking_by_contraction(spark):
    n = 300
    elements = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < n - 1, (F.col("id") + 1).cast("string")).alias("next"))
    for base in (1, 5_000):
        got = list_ranking.rank(elements, Scratch(spark, "ranks"), base)
        assert got.filter("CAST(id AS long) <> position").count() == 0 and got.count() == n


def test_scan_and_spread_join_over_hot_keys(spark):
    d = spark.range(20_000).select((F.col("id") % 7 != 0).cast("int").alias("k"), F.col("id").alias("o"))
    got = scan(d, ["k"], ["o"], {"r": (F.sum, lambda a, b: a + b, F.lit(1)), "x": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), "o")}, Scratch(spark, "t"), "d")
    held = {0: [0, 0], 1: [0, 0]}
    for k, o, r, x in got.orderBy("o").collect():
        held[k] = [held[k][0] + 1, held[k][1] ^ o]
        assert [r, x] == held[k]
    groups = spark.createDataFrame([(0, "a"), (2, "c")], "k int, v string")
    assert spread_join(d, groups, ["k"]).count() == d.filter("k = 0").count()
    assert spread_join(d, groups, ["k"], "left").groupBy("v").count().orderBy("v").collect() == [(None, d.filter("k = 1").count()), ("a", d.filter("k = 0").count())]


def diverge(rows, most=200):
    rows = [tuple(v or "" for v in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)})) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(s, w) for (_, g, s), w in zip(rows, words, strict=True) if g == lang]
        docs = Counter(t for _, w in mine for t in set(w))
        kept = [t for t, n in docs.items() if n >= 3]
        counts = {s: Counter() for s, _ in mine}
        for s, w in mine:
            counts[s].update(w)
        share = lambda c, kept=kept: (lambda n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1) if part == "pair" or r <= most]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    words = ["the", "The", "über", "ÜBER", "日本", "naïve", "x9y", "a-b", "e\u0301", "\x7f"] + [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)]
    rows = [(" ".join(words[(k * j + j * j) % len(words)] for j in range(k % 40)), ["en", "de", None][k % 3], f"s{k % 5}") for k in range(150)]
    rows += [(None, "en", "silent"), ("", "en", None), ("once", "fr", "a"), (None, "fr", "b"), ("rare word", "it", "only"), *[("copy copy copy", "en", "s1")] * 5, ("long " * 300_000, "en", "s2"), *[("the", "en", "s2")] * 3]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "id": F.lit(2)})
    assert sorted(map(tuple, divergence.audit(docs).collect())) == diverge(rows)
    assert sorted(map(tuple, divergence.audit(docs, most_terms=3).collect())) == diverge(rows, 3)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_audit_counts_in_pieces(spark, monkeypatch):
    """What a task holds and how texts, bitmaps and blocks are cut does not change the result."""
    for name in ("MOST_HELD", "SLICE", "CELLS"):
        monkeypatch.setattr(divergence, name, 5)
    rows = [(f"alpha beta {'gamma ' * k} delta", "en", f"s{k % 3}") for k in range(9)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    held = [r for b in divergence._count(iter(docs.toArrow().to_batches())) for r in b.to_pylist()]
    n = Counter()
    for r in held:
        n[r["source"], r["term"]] += r["n"]
    assert n["s2", "gamma"] == 2 + 5 + 8 and n["s0", "alpha"] == 3
    assert sorted(map(tuple, divergence.audit(docs).collect())) == diverge(rows)


def test_queries_return_the_contract(spark):
    rows = {name: queries.QUERIES[name](spark, DATA) for name in ("op11_url_filter", "op12_prefix_trie", "op13_divergence")}
    assert dict(rows["op11_url_filter"].dtypes) == {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}
    assert [t for _, t in rows["op12_prefix_trie"].dtypes] == ["bigint"] * 7 + ["string"]
    assert rows["op13_divergence"].dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert [tuple(r) for r in rows["op12_prefix_trie"].orderBy("conv_id", "depth").collect()] == trie([tuple(r) for r in turns])
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    listed = {canonical(p.url) for p in pages if {*re.split("[.-]", parts(p.url)[0])} & {*queries.JUNK}}
    assert {tuple(r) for r in rows["op11_url_filter"].collect()} == {(p.page_id, *judged(p.url, queries.RULES, listed)) for p in pages}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text", "lang", "source").collect()
    assert sorted(map(tuple, rows["op13_divergence"].collect())) == diverge([tuple(r) for r in docs])
