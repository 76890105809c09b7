"""Token counts, byte-level BPE and packing against the libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from parcelrisk.llm import bpe, packing, token_counts

ODD = [None, "", " ", "  ", "a", "a  b", "a \n b  ", "don't 's ' s", "<|endoftext|> a<|endoftext|>b <|startoftext|>", "İΣς ΑΣ ß é é 가", "a\x1cb \x85c　d\xa0e\x1f", " lead", " trail ", "\n\n x\ty", "日本語テキスト" * 50, "😀😀 !!??..", "\x00a", "1234 5 " * 10, "x" * 5000, "ab" * 3000, "word, word. (word) word's"]


def texts():
    g = random.Random(1)
    return ODD + ["".join(g.choice("ab \n\x1c.!é1's ") for _ in range(g.randrange(60))) for _ in range(400)] + ["".join(g.choice("thein") for _ in range(g.randrange(300))) for _ in range(60)]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_counts_equal_the_library(docs, path):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs(rows), path("word_bpe_49k.json")).collect()}
    want = [len(e.ids) for e in library(path("word_bpe_49k.json")).encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert [got[k] for k, _ in rows] == want


def test_counts_keep_other_columns_and_replace_their_own(spark, path):
    df = spark.createDataFrame([(1, "a b", "x", 9)], "doc_id long, text string, slice string, n_tokens int")
    out = token_counts.token_counts(df, path("word_bpe_49k.json")).first()
    assert (out["slice"], out["n_tokens"]) == ("x", 2)
    assert token_counts.token_counts(df.limit(0), path("word_bpe_49k.json")).count() == 0


def tiktoken_encoding(path):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(docs, path):
    file, rows = path("byte_bpe_multi_50k.tiktoken"), list(enumerate(texts()))
    encoded = bpe.encode(docs(rows), file, public_tokenizers.PATTERN)
    got = {r["doc_id"]: (bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.decode(encoded, file, public_tokenizers.PATTERN).collect()}
    enc = tiktoken_encoding(file)
    for k, t in rows:
        assert got[k] == (np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()), repr(t)[:80]


@pytest.mark.parametrize("leaf", [1, 3, 7])
def test_joining_anywhere_gives_the_same_tokens(path, leaf):
    code = bpe.Codec(path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, leaf=leaf)
    g = random.Random(leaf)
    for _ in range(300):
        piece = bytes(g.choice(b"thein rs\xc3\xa9") for _ in range(g.randrange(1, 60)))
        cut = g.randrange(len(piece) + 1)
        assert code.join(code.merge(piece[:cut]), code.merge(piece[cut:])) == code.merge(piece) == code.tree(piece)


def check_packed(rows, pieces, path, window=1024):
    lib, seen, total = library(path("byte_bpe_50k.json")), {}, {}
    for p in pieces:
        seen.setdefault(p["doc_id"], []).append(p)
        total.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for k, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(seen.pop(k), key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert not seen
    for parts in total.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    full = sum(sum(n for _, n in parts) for parts in total.values())
    padded = sum(window - n if (n := sum(x for _, x in parts)) & (n - 1) else 0 for parts in total.values())
    return padded / full


def test_packing_places_every_id_once(docs, path):
    g = random.Random(5)
    rows = list(enumerate([t for t in texts() if t is None or len(t) < 3000] + [" ".join(["word"] * g.randrange(1, 2500)) for _ in range(300)]))
    assert check_packed(rows, packing.pack(docs(rows), path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect(), path) < 0.03
    assert packing.pack(docs([]), path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


def test_packing_takes_repeated_rows_and_null_ids(docs, path):
    out = packing.pack(docs([(7, "same text")] * 5 + [(None, "other")]), path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in out) == [(False, 3)] * 5 + [(True, 2)]
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 6


def test_plan_uses_each_piece_once():
    g = np.random.default_rng(1)
    for h in (g.integers(0, 40, 1025), np.bincount(g.integers(1, 1025, 50), minlength=1025), np.zeros(1025, int)):
        h[0] = 0
        used = np.zeros(1025, int)
        for row, n in packing.plan(h):
            assert sum(row) <= 1024 and n > 0
            for length in row:
                used[length] += n
        assert (used == h).all()


def residual(lengths, h, x):
    return h - np.bincount(lengths.ravel(), (np.where(lengths > 0, 1.0, 0) * x[:, None]).ravel(), len(h))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counts_are_nearly_the_least_squares(seed):
    """Against coordinate descent, which is exact in the end."""
    g, window = np.random.default_rng(seed), 24
    h = [g.integers(0, 500, window + 1), np.bincount(g.integers(1, 9, 5000), minlength=window + 1), np.bincount(np.r_[g.integers(14, 25, 3000), g.integers(1, 25, 400)], minlength=window + 1)][seed - 1]
    h[0] = 0
    lengths = packing.combinations(window)
    x = packing.repeat_counts(lengths, h)
    exact, rest = np.zeros(len(lengths)), h.astype(float)
    rows = [[int(v) for v in row if v] for row in lengths]
    for _ in range(4000):
        for j, row in enumerate(rows):
            move = max(sum(rest[v] for v in row) / sum(row.count(v) for v in row), -exact[j])
            exact[j] += move
            for v in row:
                rest[v] -= move
    assert (x >= 0).all() and np.linalg.norm(residual(lengths, h, x)) <= 1.01 * np.linalg.norm(rest) + 1e-3 * np.linalg.norm(h)
