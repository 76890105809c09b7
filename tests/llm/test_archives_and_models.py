"""WARC round trips, toxicity, language-model scores and the pipeline."""

import collections
import hashlib
import collections
import math
import random
import zlib

import numpy as np
import pytest

from parcelrisk.llm import lm_scoring, toxicity, warc

PAGES = "page_id long, url string, html string"


def test_pages_come_back_whole(spark):
    g = random.Random(1)
    long = "".join(g.choice("abc é\r\n日\x00") for _ in range(60_000))
    rows = [(1, "http://a/\r\nX: y", "short"), (2, "u", "short"), (3, None, None), (4, "u", ""), (5, "u", long), (6, "u", "x" * 100), (9, "u", "x" * 100), (7, "u", "x" * 99), (8, "u", "x" * 99), (10, "u", long), (11, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3)]
    out = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()}
    first = {}
    for k, _, h in sorted(rows):
        body = (h or "").encode()
        origin = first.setdefault(body, k) if len(body) >= 100 else k
        assert out[k] == (len(body), hashlib.sha256(body).hexdigest(), "response" if origin == k else "revisit", None if origin == k else origin)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_repeated_and_null_pages_are_records_of_their_own(spark):
    import duckdb

    from parcelrisk.llm.queries import OP8_SQL

    long = "long é " * 6_000
    rows = [(1, "u", "x" * 200), (1, "u", "x" * 200), (2, "u", "x" * 200), (2, "u", "x" * 200), (2, "v", "other" * 50), (3, "u", long), (3, "u", long), (3, "v", long), (4, "u", long)]
    rows += [(5, "u", "own " * 50), (5, "u", "x" * 200), (6, "u", "short"), (6, "u", "short"), (None, "u", long), (None, "u", long), (None, "v", "x" * 200), (None, None, None), (7, "u", "none " * 50), (None, "u", "none " * 50), (None, "u", "lone " * 50)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES))
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.sql(OP8_SQL)
    assert collections.Counter(map(tuple, got.select(*want.columns).collect())) == collections.Counter(want.fetchall())


def test_lost_segments_and_broken_chunks_fail(spark, tmp_path):
    pages = warc.classify(spark.createDataFrame([(1, "u", "y" * 50_000)], PAGES))
    warc.write_archives(pages, str(tmp_path / "a"))
    parsed = warc.read_archives(spark, str(tmp_path / "a")).persist()
    assert parsed.filter("segment IS NOT NULL").count() == 4
    assert warc.payload(warc.reassemble(parsed).first()["block"]) == b"y" * 50_000
    for lost in ("coalesce(segment, 0) <> 2", "coalesce(segment, 0) <> 4"):
        with pytest.raises(Exception, match="segments do not fit"):
            warc.reassemble(parsed.filter(lost)).collect()
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.dechunk(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_a_very_long_page_of_any_bytes(spark):
    long = "".join(map(chr, [*range(0x0, 0xD800), *range(0xE000, 0x11000)])) * 24
    out = warc.round_trip(spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "x" * 4096), (4, "u", "y" * 8192)], PAGES)).orderBy("page_id").collect()
    body = long.encode()
    assert [(r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out[:2]] == [(len(body), "response", None), (len(body), "revisit", 1)]
    assert all(r["payload_digest"] == hashlib.sha256(body).hexdigest() for r in out[:2]) and [r["payload_bytes"] for r in out[2:]] == [4096, 8192]


def corpus(g, n=400):
    clean = ["".join(g.choice(["ba", "do", "ki", "lu", "me"]) for _ in range(g.randrange(1, 5))) for _ in range(300)]
    rows = []
    for k in range(n):
        words = [g.choice(clean) for _ in range(g.randrange(5, 80))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(g.randrange(1, 6)):
                words.insert(g.randrange(len(words)), g.choice(["Wretch", "scoundrelish", "scoundrelly", "scoundrels"]))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = corpus(random.Random(2))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (1000, ""), (1001, "scoundrelesque " * 3)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, t, 1) for k, _, t in rows if k % 2 == 0] + [(None, 1, 0), (5000, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    assert model.cuts == sorted(model.cuts) and all(w >= 0 for w in model.weights.values())
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(k, t) for k, _, t in rows if k % 2]
    assert all(out[k]["rejected"] == bool(t) for k, t in held)
    assert not out[1000]["rejected"] and not out[None]["rejected"] and out[1001]["rejected"]
    assert all(0 <= r["expected_severity"] <= 2 for r in out.values())
    nothing = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert not toxicity.score(docs, nothing).filter("rejected").count()
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_repeated_ids_and_labels_do_not_weigh_more(spark):
    rows = corpus(random.Random(6))
    labels = [(k, t) for k, _, t in rows]
    once = toxicity.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    many = toxicity.fit(spark.createDataFrame([r[:2] for r in rows] + [rows[k][:2] for k in (0, 1, 6)] * 50, "doc_id long, text string"), spark.createDataFrame(labels + labels[:20] * 3, "doc_id long, toxic int"))
    assert once.weights and many.weights.keys() == once.weights.keys()
    assert all(math.isclose(many.weights[f], w, rel_tol=1e-6, abs_tol=1e-9) for f, w in once.weights.items()) and np.allclose(many.cuts, once.cuts)


def test_cumulative_link_recovers_the_order():
    g = np.random.default_rng(3)
    x = (g.random((3000, 3)) < 0.4).astype(float)
    z = x @ np.array([2.0, 1.0, 0.0]) + g.logistic(size=3000)
    y = (z > 1).astype(int) + (z > 3)
    w, cuts = toxicity.fit_cumulative_link(x, y, np.ones(3000), 2)
    assert np.allclose(w, [2, 1, 0], atol=0.25) and np.allclose(cuts, [1, 3], atol=0.3)


def test_cumulative_link_is_the_penalised_maximum():
    """On a small table no step in any parameter raises the likelihood written out from the model's definition."""
    x = np.array([[1, 0], [1, 1], [0, 1], [0, 0], [1, 1], [0, 1], [1, 0], [0, 0], [0, 0], [1, 1]], float)
    y, weight, l2 = np.array([1, 2, 1, 0, 1, 0, 0, 1, 0, 2]), np.arange(1.0, 11.0), 0.5
    w, cuts = toxicity.fit_cumulative_link(x, y, weight, 2, l2=l2, steps=4000, rate=0.01)

    def value(w, cuts):
        total = -l2 / 2 * sum(v * v for v in w)
        for row, grade, n in zip(x, y, weight, strict=True):
            z = sum(a * b for a, b in zip(row, w, strict=True))
            reach = [1.0, *(1 / (1 + math.exp(c - z)) for c in cuts), 0.0]
            total += n * math.log(reach[grade] - reach[grade + 1])
        return total

    best = value(w, cuts)
    for k in range(2):
        for step in (-0.02, 0.02):
            moved_w, moved_c = w.copy(), cuts.copy()
            moved_w[k] = max(moved_w[k] + step, 0)
            moved_c[k] += step
            assert value(moved_w, cuts) <= best + 1e-9 and value(w, moved_c) <= best + 1e-9


def test_grades_rank_held_out_rows_as_well_as_a_plain_fit(spark):
    rows = corpus(random.Random(12), 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, t) for k, _, t in rows if k // 6 % 3], "doc_id long, toxic int")
    ordinal, plain = toxicity.fit(docs, labels), toxicity.fit(docs, labels, grades=1)

    def auc(model):
        out = {r["doc_id"]: r["expected_severity"] for r in toxicity.score(docs, model).collect()}
        bad, good = ([out[k] for k, _, t in rows if k // 6 % 3 == 0 and t == kind] for kind in (1, 0))
        return sum((a > b) + (a == b) / 2 for a in bad for b in good) / (len(bad) * len(good))

    assert auc(ordinal) >= auc(plain) - 1e-9 and auc(ordinal) > 0.99
    # grades follow how many telling words a text holds
    few, many = toxicity.score(spark.createDataFrame([(1, "ba do wretch"), (2, "wretch scoundrels scoundrelly scoundrelish")], "doc_id long, text string"), ordinal).orderBy("doc_id").collect()
    assert few["expected_severity"] < many["expected_severity"]


def test_toxicity_of_long_texts_and_clashing_columns(spark):
    rows = corpus(random.Random(13))
    docs = spark.createDataFrame([(*r[:2], "x") for r in rows] + [(2000, "ba do ki " * 200_000, "x"), (2001, "ba do ki " * 200_000 + "wretch scoundrels scoundrelly", None), (2001, "ba", None), (2001, "ba", None)], "doc_id long, text string, rejected string")
    model = toxicity.fit(docs, spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, toxic int"))
    out = toxicity.score(docs, model)
    assert dict(out.dtypes)["rejected"] == "boolean" and out.columns.count("rejected") == 1
    assert sorted((r["doc_id"], r["rejected"]) for r in out.filter("doc_id >= 2000").collect()) == [(2000, False), (2001, False), (2001, False), (2001, True)]
    assert toxicity.fit(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).weights == {}


@pytest.fixture(scope="module")
def lattice():
    import public_tokenizers

    return lm_scoring.BatchLattice(lm_scoring.existing_scores(public_tokenizers.path("piece_bpe_32k.model")))


def test_marginal_sums_all_segmentations(lattice):
    def every(text):
        if not text:
            return 1.0
        total = 0.0
        for j in range(1, len(text) + 1):
            p = lattice.one.log_p.get(text[:j])
            if p is not None:
                total += math.exp(p) * every(text[j:])
        if text[0] not in lattice.one.log_p:
            total += math.exp(sum(lattice.one.byte[b] for b in text[0].encode())) * every(text[1:])
        return total

    words = ["the", "anblewh", "stille", "日x", "", "😀a"]
    assert np.allclose(lattice.log_marginals(words), [math.log(every("▁" + w)) for w in words])
    long = ["x" * 70, "ab" * 100]
    assert np.allclose(lattice.log_marginals(long), [lattice.one.log_marginal(w) for w in long])


def test_expected_counts_agree(lattice):
    words, uses, rest, plain = ["the", "anblewh", "日x", "x" * 70], np.zeros(len(lattice.pieces)), {}, {}
    lattice.expected(words, np.arange(1.0, 5.0), uses, rest)
    for k, w in enumerate(words):
        lattice.one.expected(w, k + 1.0, plain)
    for k in np.flatnonzero(uses):
        rest[lattice.pieces[k]] = rest.get(lattice.pieces[k], 0) + uses[k]
    assert {k: round(v, 6) for k, v in rest.items() if v > 1e-6} == {k: round(v, 6) for k, v in plain.items() if v > 1e-6}


def test_scores_against_plain_counts(spark, path):
    rows = [(k, t) for k, t, _ in corpus(random.Random(4), 80)] + [(500, None), (501, ""), (502, "Never SEEN words\x0bhere"), (None, "ba do")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in lm_scoring.score(df, path("piece_bpe_32k.model"), lm_scoring.held_out("doc_id")).collect()}
    tokens = {k: [*(t or "").encode().lower().split(), b"\n"] for k, t in rows}
    held = {k: True if k is None else zlib.crc32(str(k).encode()) % 10 == 0 for k in tokens}
    c = collections.Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in tokens.items():
        r = out[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    assert lm_scoring.score(df.limit(0), path("piece_bpe_32k.model"), lm_scoring.held_out("doc_id")).count() == 0


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(random.Random(5), 120)
    docs = spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t, _ in rows] + [(900, rows[1][1], "en", "src1", 5), (901, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, t) for k, _, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "packing"]
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    # 900 repeats an earlier text and is cut to nothing; like 901 it has no words, and of such documents one stays
    assert ids == {k for k, _, t in rows if not t} | {900}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids


def test_near_duplicate_stage_loses_no_text(spark):
    """Unlike texts under one id are documents of their own: only rows whose group has a smaller id or text goes; null ids stay."""
    import corpus_pipeline
    from parcelrisk.llm import simhash

    g = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    a, b, c, d = (" ".join(g.choice(words) for _ in range(60)) for _ in range(4))
    rows = [(7, a), (7, b), (9, b), (8, c), (9, d), (9, d), (None, a), (None, None), (None, None), (5, None), (6, ""), (10, a + " tail"), (11, c)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], schema)
    prints = {t: simhash.simhash(simhash.shingle_hashes(t, 3, 42)) for _, t in rows}
    near = lambda s, t: (prints[s] ^ prints[t]) & (2**64 - 1)
    groups = {t: t for t in prints}
    for _ in prints:  # texts that differ in few bits have one group
        for s in prints:
            for t in prints:
                if near(s, t).bit_count() <= 3:
                    groups[s] = groups[t] = min(groups[s], groups[t], key=str)
    want = collections.Counter((k, groups[t]) for k, t in rows if k is None)
    for group in set(groups.values()):
        ids = [k for k, t in rows if groups[t] == group and k is not None]
        want.update([(min(ids), group)] if ids else [])
    kept = corpus_pipeline.one_of_each(spark, docs, "").collect()
    assert collections.Counter((r["doc_id"], groups[r["text"]]) for r in kept) == want
    assert {(7, a), (7, b), (8, c), (9, d)} <= {(r["doc_id"], r["text"]) for r in kept}
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), "").count() == 0


def test_pipeline_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
