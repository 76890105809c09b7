"""Line dedup, near-duplicates of texts and vectors, and fingerprints against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parcelrisk.llm import components, embedding_dedup, fingerprints, line_dedup, simhash
from parcelrisk.llm.common import Scratch

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(g, n=9):
    return " ".join(g.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_repeated_passage_goes_and_the_rest_stays(docs):
    g = random.Random(1)
    passage = " ".join(sentence(g) for _ in range(8))
    own = [" ".join(sentence(g) for _ in range(4)) for _ in range(6)]
    rows = [(k, f"{own[k]}\n{passage}\nShort end.") for k in range(5)] + [(5, own[5]), (6, None), (7, "")]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert out[0]["text"] == rows[0][1] and out[5]["text"] == rows[5][1]
    for k in range(1, 5):
        assert out[k]["text"].startswith(own[k] + "\n") and not out[k]["text"].endswith("Short end.")  # a line like others: it repeats with the passage
        assert len(out[k]["text"]) < len(own[k]) + 120 and out[k]["chars_removed"] == len(rows[k][1]) - len(out[k]["text"])
    assert out[6]["text"] is None and out[7]["text"] == ""


def test_lines_inside_one_text_and_equal_rows(docs, spark):
    g = random.Random(2)
    passage = " ".join(sentence(g) for _ in range(6))
    df = spark.createDataFrame([(1, f"{passage}\n{passage}\n", "x"), (1, f"{passage}\n{passage}\n", "x"), (None, passage + "\n", "y")], "doc_id long, text string, cuts string")
    out = line_dedup.dedup_lines(df.withColumnRenamed("cuts", "source")).collect()
    texts = {(r["doc_id"], r["source"]): r["text"] for r in out}
    assert len(out) == 3 and texts[None, "y"] == passage + "\n" and len(texts[1, "x"]) < len(passage)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def brute_passages(rows, least=80):
    """Every run of lines is compared: a line goes if it lies in a run that stands in an earlier place."""
    seen, out = set(), {}
    for k, t in sorted(rows):
        lines = re.findall(line_dedup.LINE, t)
        gone = set()
        for i in range(len(lines)):
            mine = []
            for j in range(i + 2, len(lines) + 1):
                run = "".join(lines[i:j]).rstrip(" \n")
                if len(run) >= least:
                    if run in seen:
                        gone.update(range(i, j))
                    mine.append(run)
            seen.update(mine)
        out[k] = "".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_equal_digests_of_unlike_chunks_are_told_apart(docs, monkeypatch):
    g = random.Random(9)
    passage = " ".join(sentence(g) for _ in range(6))
    rows = [(k, f"{sentence(g)} {sentence(g)}\n{passage}\n") for k in range(4)]
    want = sorted(map(tuple, line_dedup.dedup_lines(docs(rows)).collect()))
    assert any(r[2] for r in want)
    real = line_dedup.chunks
    monkeypatch.setattr(line_dedup, "chunks", lambda *a: real(*a).withColumn("digest", F.lit(0).cast("long")))
    assert sorted(map(tuple, line_dedup.dedup_lines(docs(rows)).collect())) == want


def test_repeated_runs_go_wherever_they_start_and_end(docs):
    g = random.Random(8)
    wrapped = "".join(" ".join(g.choice(WORDS) for _ in range(10))[:58] + "\n" for _ in range(12))
    short = "".join(f"{g.choice(WORDS)} {k};\n" for k in range(14))
    prose = " ".join(sentence(g) for _ in range(5))
    own = lambda: " ".join(sentence(g) for _ in range(3))
    rows = [(1, f"{own()}\n{wrapped}{own()}"), (2, f"a\n{wrapped}{own()}"), (3, f"x\n{short}y\n"), (4, f"other\n{short}{own()}")]
    rows += [(5, f"{own()} {prose} {own()}"), (6, f"{own()} {prose}\n{own()}"), (7, prose), (8, f"{own()} " + " ".join(prose.split(". ")[1:4]) + own())]
    every = [sentence(g, g.randrange(1, 9)) for _ in range(12)]
    rows += [(10 + k, "".join(g.choice(every) + g.choice([" ", "\n", "", "\n\n"]) for _ in range(30))) for k in range(12)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_passages(docs(rows)).collect()}
    want = brute_passages(rows)
    for k, t in rows:
        assert out[k]["text"] == want[k] and out[k]["chars_removed"] == len(t) - len(want[k])
    assert wrapped[:40] not in out[2]["text"] and short[:40] not in out[4]["text"] and prose[-30:] not in out[6]["text"] and out[7]["text"] == ""
    odd = {r["doc_id"]: r["text"] for r in line_dedup.dedup_passages(docs([(1, None), (2, ""), (None, prose), (3, prose), (3, prose), (4, "one")])).collect()}
    assert odd == {1: None, 2: "", None: prose, 3: "", 4: "one"} and line_dedup.dedup_passages(docs([])).count() == 0


def gone(text, out):
    return len(text) - len(out)


def test_a_block_of_lines_goes_from_all_but_the_first_wherever_it_stands(docs):
    g = random.Random(11)
    block = "".join(f"Clause {k} says {sentence(g, 6)}\n" for k in range(30))
    own = [[sentence(g, g.randrange(3, 9)) + "\n" for _ in range(k)] for k in range(12)]
    rows = [(k, "".join(own[k]) + block + "".join(reversed(own[k]))) for k in range(12)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert out[0] == rows[0][1]
    for k in range(1, 12):
        assert gone(rows[k][1], out[k]) >= 0.9 * len(block), k
        assert all(x in out[k] for x in own[k])


def test_most_of_what_brute_force_cuts_is_cut(docs):
    g = random.Random(12)
    passages = [" ".join(sentence(g, g.randrange(3, 12)) for _ in range(g.randrange(7, 25))) for _ in range(30)]
    wide = ["".join(g.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往") for _ in range(g.randrange(6, 30))) + "。" for _ in range(12)]
    passages += ["".join(wide), "\n".join(x[:-1] for x in wide)]
    own = lambda: " ".join(sentence(g, g.randrange(3, 12)) for _ in range(g.randrange(9)))
    rows = [(k, own() + g.choice([" ", "\n"]) + g.choice(passages) + g.choice([" ", "\n"]) + own()) for k in range(150)]
    want = brute_passages(rows)
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert all(gone(t, out[k]) <= gone(t, want[k]) for k, t in rows)
    assert sum(gone(t, out[k]) for k, t in rows) >= 0.9 * sum(gone(t, want[k]) for k, t in rows)


def test_white_space_at_the_end_goes_without_looking_at_every_character(spark):
    odd = ["", " ", "\n", "a", "a ", "a\n", "a. \n", "a\n \n  ", " \n \n", "a b\n\n", " a", "a\t ", "a\r\n", "ä。 ", "a\n "]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    rows = df.select("x", F.expr(line_dedup._bare("x")).alias("line"), F.expr(f"transform(array(x), y -> {line_dedup._bare('y')})[0]").alias("inside")).collect()
    assert all(r["line"] == r["inside"] == r["x"].rstrip(" \n") for r in rows) and len(rows) == len(odd)
    assert "trim(TRAILING" in line_dedup._bare("x") and line_dedup._bare("x").index("endswith(rtrim(x)") < line_dedup._bare("x").index("trim(TRAILING")


def test_equal_rows_do_not_multiply_and_names_do_not_clash(spark, docs):
    g = random.Random(13)
    passage = " ".join(sentence(g) for _ in range(6))
    df = spark.createDataFrame([(1, passage, "a", 1)] * 40 + [(2, passage, "b", 2)] * 2 + [(None, None, None, 3)], "doc_id long, text string, k1 string, row int")
    df = df.withColumn("cuts", F.lit(5)).withColumn("chunks_removed", F.lit("old"))
    scratch = Scratch(spark, "rows")
    keyed = df.select(*line_dedup._keys(F.col("doc_id"), F.col("text")), "text")
    assert line_dedup.repeated_spans(keyed, scratch, 2, 80).count() < 100
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "k1", "row", "cuts", "chunks_removed", "chars_removed"]
    kept = collections.Counter((r["doc_id"], r["text"], r["k1"], r["cuts"]) for r in out.collect())
    assert kept == {(1, passage, "a", 5): 40, (2, "", "b", 5): 2, (None, None, None, 5): 1}
    long = [(1, "word " * 60_000), (2, "x. y. " * 30_000)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(long)).collect()}
    assert all(out[k]["text"] and out[k]["text"] in t and gone(t, out[k]["text"]) == out[k]["chars_removed"] > 0 for k, t in long)


def test_stretches_without_any_cut_are_cut_and_engines_agree_on_lines(docs, spark):
    import duckdb

    g = random.Random(14)
    odd = ["word " * 900, "ab" * 700 + "\r", "x" * 200 + "\r", "x" * 200 + "\r\n", "x" * 201 + "\u2028", "end here" + "\r\r", "天" * 900, "了" * 450 + "。" + "了" * 450]
    odd += ["".join(g.choice("abckmz天 .!。\n\r") for _ in range(600)) for _ in range(40)] + ["".join(g.choice("abcdef ") for _ in range(900)) + g.choice(["", ".", "\n"]) for _ in range(20)]
    found = {r["doc_id"]: r["lines"] for r in docs(list(enumerate(odd))).select("doc_id", line_dedup._lines().alias("lines")).collect()}
    for k, t in enumerate(odd):
        assert found[k] == re.findall(line_dedup.LINE, t) and "".join(found[k]) == t
        assert max(map(len, found[k])) <= 420
        assert duckdb.execute("SELECT regexp_extract_all(?, ?)", [t, line_dedup.LINE]).fetchall()[0][0] == found[k]


def brute_simhash(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << i for i in range(64) if h and 2 * sum(x >> i & 1 for x in h) > len(h))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(docs):
    g = random.Random(3)
    base = [" ".join(sentence(g) for _ in range(20)) for _ in range(6)]
    texts = [None, "", " \t", "One", "one TWO", *base]
    texts += [b.replace(".", "", g.randrange(3)) for b in base for _ in range(6)] + [base[0]] * 20
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    fp = {k: brute_simhash(t) for k, t in rows}
    want = groups(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    out = simhash.near_duplicates(docs(rows)).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id").collect()
    assert {r["doc_id"]: (r["f"], r["component_id"]) for r in out} == {k: (format(fp[k], "016x"), want[k]) for k in fp}
    assert simhash.near_duplicates(docs([])).count() == 0
    odd = simhash.near_duplicates(docs([(None, "x y z"), (4, "x y z"), (4, "x y z"), (None, "q r s t")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in odd) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_grid_join_finds_all_pairs(spark):
    g = random.Random(4)
    values = sorted({x ^ sum(1 << k for k in g.sample(range(64), g.randrange(5))) for x in (g.getrandbits(64) for _ in range(60)) for _ in range(8)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = [tuple(sorted(r)) for r in simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_stars_and_loops(spark):
    e = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 130)] + [(7, 7), (1, 0), (None, 3), (200, 199)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(e, "a long, b long"), Scratch(spark, "test")).collect()))
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 130)} | {199: 199, 200: 199}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_vectors_equal_brute_force(spark):
    g = np.random.default_rng(5)
    base = g.normal(size=(25, 16))
    x = np.concatenate([base + g.normal(size=base.shape) * s for s in (0.0, 0.05, 0.2, 0.3, 0.35)]).astype(np.float32)
    rows = [(int(k), v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [1.0, 2.0]), (906, [2.0, 4.0])]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    want = groups(range(len(u)), [(a, b) for a, b in np.argwhere(near) if a < b])
    out = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block_rows=40).collect()}
    for k in range(len(u)):
        assert out[k] == (near[k].sum(), want[k], want[k] == k)
    assert all(out[k] == (0, k, True) for k in range(900, 905))
    assert out[905] == (1, 905, True) and out[906] == (1, 905, False)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quantised_bound_never_misses():
    g = np.random.default_rng(6)
    u = g.normal(size=(200, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    codes, scale, error = embedding_dedup.quantise(u)
    approx = (codes * scale[:, None]) @ (codes * scale[:, None]).T
    assert (np.abs(approx - u @ u.T) <= error[:, None] + error[None, :] + error[:, None] * error[None, :] + 1e-12).all()


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_blocks_meet_without_a_copy_for_each_other_block(spark):
    """40 blocks, vectors of small and of large errors: shuffles hold the vectors a few times at most, and no link is missed."""
    g = np.random.default_rng(8)
    u = g.normal(size=(500, 64)) ** np.repeat([1, 9], 250)[:, None]
    u = np.concatenate([u, u + 0.04 * g.normal(size=u.shape) * np.linalg.norm(u, axis=1)[:, None]]).astype(np.float32)
    x = u / np.linalg.norm(u.astype(np.float64), axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert 100 < near.sum() and 0 < (~near.any(1)).sum()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(u)], "vec_id long, embedding array<float>")
    before = shuffled_bytes(spark)
    out = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, block_rows=25).collect()}
    assert shuffled_bytes(spark) - before < 5 * u.nbytes
    assert out == dict(enumerate(near.sum(1)))


def test_products_of_codes_are_exact_and_lengths_do_not_overflow(spark):
    g = np.random.default_rng(7)
    for d in (3, 1040, 2500):
        x, y = (g.choice(np.array([-127, 127, 126], np.int8), (5, d)) for _ in range(2))
        assert (embedding_dedup.code_products(x, y) == x.astype(np.int64) @ y.astype(np.int64).T).all()
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [3.0, 6.0]), (4, [5e-324, 0.0]), (5, [2.0, 0.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in out) == [(-1, 4, 1, False), (1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (4, 1, 4, True), (5, 1, 4, False)]


def jaccard(x, y):
    x, y = (collections.Counter(t.lower().split()) for t in (x, y))
    total = sum(max(x[w], y[w]) for w in x | y)
    return sum(min(x[w], y[w]) for w in x | y) / total if total else 1.0


def test_fingerprints_estimate_jaccard(docs):
    g = random.Random(7)
    rows = [(k * 2, " ".join(g.choice(WORDS) + str(g.randrange(k % 5 + 1)) for _ in range(g.randrange(1, 200)))) for k in range(60)]
    rows += [(300, None), (301, ""), (302, "é" * 9), (303, rows[0][1]), (304, rows[0][1])]
    out = {r["doc_id"]: r for r in fingerprints.edit_fingerprints(docs(rows)).collect()}
    text, ids = {k: t or "" for k, t in rows}, sorted(k for k, _ in rows)
    errors = []
    for i, k in enumerate(ids):
        nxt, n = ids[(i + 1) % len(ids)], len(text[k])
        edited = text[k][: n - n // 4] + text[nxt][: n // 4]
        r = out[k]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        errors += [r["near_edited"] - jaccard(text[k], edited), r["near_next"] - jaccard(text[k], text[nxt])]
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1
    assert out[303]["fingerprint"] == out[304]["fingerprint"] == out[0]["fingerprint"] and out[303]["near_next"] == 1
    assert out[300]["near_next"] == 1 and out[301]["near_next"] == 0
    assert fingerprints.edit_fingerprints(docs([])).count() == 0
    alone = fingerprints.edit_fingerprints(docs([(5, "one two three four")])).first()
    assert alone["near_next"] == 1 and alone["n_chars"] == 18
    twice = fingerprints.edit_fingerprints(docs([(5, "a b c d"), (5, "a b c d"), (None, "a b c d")])).collect()
    assert len(twice) == 3 and len({r["fingerprint"] for r in twice}) == 1


@pytest.mark.parametrize("w,v", [(1, 4), (3, 5)])
def test_equal_draws_give_the_weight_ratio(spark, w, v):
    """For one term with two weights the share of equal samples is their ratio."""
    df = spark.createDataFrame([(0, 77, w, v)], "k0 int, term long, a int, b int")
    r = fingerprints.signatures(df, ["k0"], ["a", "b"], 2048, 8).first()
    assert math.isclose(np.mean(np.array(r["a"]) == np.array(r["b"])), w / v, abs_tol=0.05)


def test_stretches_without_sentence_ends_are_cut_by_content(docs):
    """A passage without sentence ends goes behind whatever opening it stands: but for its first and last pieces, in spaced and unspaced scripts."""
    g = random.Random(9)
    spaced = " ".join("".join(g.choice("abcdefghiklmnoprstuwz") for _ in range(g.randint(2, 9))) for _ in range(550))
    wide = "".join(chr(g.randrange(0x4E00, 0x9FA0)) for _ in range(2_000))
    for passage in (spaced, wide):
        rows = [(k, "".join(g.choice("abcdefgh ") for _ in range(17 * k)) + passage + ("." if k % 2 else "")) for k in range(6)]
        left = {r["doc_id"]: len(r["text"]) for r in line_dedup.dedup_lines(docs(rows)).collect()}
        assert left[0] == len(rows[0][1]) and all(left[k] - 17 * k < 0.25 * len(passage) for k in range(1, 6)), left
