"""The operators over the given tables, with production parameters: one query each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelrisk.llm import bpe, divergence, embedding_dedup, fingerprints, line_dedup, lm_scoring, packing, prefix_trie, simhash, token_counts, toxicity, url_filter, warc
from parcelrisk.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH l AS (SELECT doc_id, regexp_extract_all(text, 'THE_LINE') AS lines FROM documents WHERE length(text) > 0),
u AS (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM l),
f AS (SELECT doc_id, x, i, n, length(rtrim(x, ' ' || chr(10))) AS bare, ('0x' || substr(md5(rtrim(x, ' ' || chr(10))), 1, 8))::BIGINT AS h,
  sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) - length(x) AS before FROM u),
e AS (SELECT *, i = n OR (i > 1 AND (31 * lag(h) OVER w + h) % 2 = 0) AS last FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, i = 1 OR lag(last) OVER w AS begin, min(CASE WHEN last THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT a.doc_id, a.i AS a, b.i AS b, a.begin, b.last, a.next FROM g a JOIN g b ON a.doc_id = b.doc_id AND b.i > a.i AND b.before + b.bare - a.before >= 80 AND (a.begin OR b.last)),
s AS (SELECT doc_id, a, min(b) AS b FROM p WHERE begin GROUP BY doc_id, a UNION SELECT doc_id, max(a), b FROM p WHERE last GROUP BY doc_id, b UNION SELECT doc_id, a, b FROM p WHERE begin AND b = next),
t AS (SELECT s.doc_id, a, b, rtrim(string_agg(x, '' ORDER BY i), ' ' || chr(10)) AS chunk FROM s JOIN f ON f.doc_id = s.doc_id AND i BETWEEN a AND b GROUP BY s.doc_id, a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, a) > 1 AS gone FROM t WHERE length(chunk) >= 80),
c AS (SELECT f.*, EXISTS (SELECT 1 FROM r WHERE r.doc_id = f.doc_id AND gone AND i BETWEEN a AND b) AS cut FROM f),
d AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER w, false) AS opens FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
o AS (SELECT doc_id, coalesce(string_agg(CASE WHEN NOT cut THEN x END, '' ORDER BY i), '') AS text, count(*) FILTER (opens) AS chunks_removed, coalesce(sum(length(x)) FILTER (cut), 0)::BIGINT AS chars_removed FROM d GROUP BY doc_id)
SELECT documents.doc_id, coalesce(o.text, documents.text) AS text, coalesce(o.chunks_removed, 0) AS chunks_removed, coalesce(o.chars_removed, 0) AS chars_removed
FROM documents LEFT JOIN o ON documents.doc_id = o.doc_id
""".replace("THE_LINE", line_dedup.LINE)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", token_counts.over_limit(F.col("n_tokens")).alias("over_limit"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), file, pattern), file, pattern)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_fingerprints(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), lm_scoring.held_out("doc_id"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
JUNK = ["adult", "ads", "bets", "casino", "pills", "spam"]  # words of the names of the sites whose URLs are listed


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules first; where none fits, what is on the list of URLs at junk sites is blocked."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), url_filter.junk_sites(pages, JUNK)).drop("url")


OP11_SQL = r"""
WITH a AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '') AS query FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)?$', '') AS bare,
  array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS asked FROM a),
c AS (SELECT *, CASE WHEN bare <> '' THEN bare || regexp_replace(path, '/+$', '') || CASE WHEN asked <> '' THEN '?' || asked ELSE '' END END AS canonical FROM b),
listed AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND len(list_intersect(regexp_split_to_array(host, '[.-]'), ['adult', 'ads', 'bets', 'casino', 'pills', 'spam'])) > 0),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (SELECT url, max_by(struct_pack(rule := h || p, v := v), length(h) + length(p)) AS best FROM (SELECT DISTINCT url, host, path FROM c), rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fits ON c.url = fits.url LEFT JOIN listed ON c.canonical = listed.canonical
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 6 AS h FROM t GROUP BY conv_id),
c AS (SELECT s.conv_id, s.conv_id - s.conv_id % 100 AS first, s.h, least(s.h, coalesce(f.n, 0)) AS k FROM s LEFT JOIN s f ON f.conv_id = s.conv_id - s.conv_id % 100),
r AS (SELECT conv_id, pos AS depth, role, text FROM (SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.first AND t.pos <= c.k) UNION ALL SELECT conv_id, c.k + pos - c.h, role, text FROM t JOIN c USING (conv_id) WHERE pos > c.h),
l AS (SELECT conv_id, coalesce(max(r.depth), 0) AS depth FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
m AS (SELECT conv_id, depth, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS key, length(text) AS chars FROM r UNION ALL SELECT conv_id, 0, [], 0 FROM c),
n AS (SELECT key, min(conv_id) AS conv_id, depth, count(*) AS n_convs, min(chars) AS chars FROM m GROUP BY key, depth),
e AS (SELECT m.key, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) AS ends FROM m JOIN l USING (conv_id, depth) GROUP BY m.key),
k AS (SELECT key[:len(key) - 1] AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
g AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (key)),
u AS (SELECT a.key, sum((b.n_children = 0)::INT) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved FROM g b JOIN m a ON a.conv_id = b.conv_id AND a.depth <= b.depth GROUP BY a.key)
SELECT g.conv_id, g.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM g JOIN u USING (key) LEFT JOIN e USING (key) LEFT JOIN n p ON g.depth > 0 AND p.key = g.key[:len(g.key) - 1]
"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
z AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS whole FROM z GROUP BY ALL),
p AS (SELECT z.*, 1 + (1000000000 * (z.n + 1)) // (s.whole + v.v) AS p, 1 + (1000000000 * (z.total::HUGEINT + 1)) // (v.n + v.v) AS q FROM z JOIN s USING (lang, source) JOIN v USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
y AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM o WHERE part = 'pair' OR rank <= 200
"""


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_packing, op4_byte_bpe, op5_embedding_dedup, op6_simhash, op7_fingerprints, op8_warc, op9_toxicity, op10_lm_scoring, op11_url_filter, op12_prefix_trie, op13_divergence)}
ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op5_embedding_dedup": OP5_SQL, "op8_warc": OP8_SQL, "op11_url_filter": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_divergence": OP13_SQL}
