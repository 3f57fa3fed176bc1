"""Tokenising operators against the tokenizers library: BPE round trip, packing, token files."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tributary.llm import bpe, packing, token_files
from tributary.llm.queries import tokenizer

BYTE, WORD = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n  x", "don't WE'LL it's 'tis I'M", "a" * 5000, "<|endoftext|> and <|startoftext|>", "日本語 текст émile İI ſK", "1234 5.6%%%", "tab\tand\r\nline ", "😀 é   x\u0085y", "the same passage of many words again " * 300]


def rows():
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma,", "d", "été", "12", "x's", "--", "(z)", "ß"]
    out = list(enumerate(ODD))
    for i in range(60):
        out.append((100 + i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", ""]) for _ in range(rng.randint(1, 400)))))
    return [*out, out[9], (None, "no id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in rows()], "doc_id long, text string, ids string, length string").repartition(3)


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(spark, docs):
    t = library(BYTE)
    out = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], hashlib.sha256(bytes(r["ids"])).hexdigest(), r["decoded"]) for r in out)
    want = []
    for d, text in rows():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((str(d), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.encode(docs.limit(0), BYTE).collect() == []


def test_packing(spark, docs):
    t = library(WORD)
    capacity = 256
    pieces = packing.cut_pieces(docs, WORD, capacity=capacity)
    out = packing.pack(pieces, capacity, shard_pieces=40).collect()
    want, total = [], 0
    for d, text in rows():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        want += [(str(d), a // capacity, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for a in range(0, len(ids), capacity)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(by) <= -(-total // capacity) + 4
    assert packing.pack(packing.cut_pieces(docs.limit(0), WORD)).collect() == []


def test_evolution():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 300).tolist()
    best = packing.evolve(sizes, 100, 3, [])
    assert sorted(k for b in best for k in b) == list(range(300)) and all(sum(sizes[k] for k in b) <= 100 for b in best)
    again = packing.evolve(sizes, 100, 4, [best])
    assert len(again) <= len(best)
    assert packing.evolve([], 100, 1, []) == []


def test_token_files(spark, docs, tmp_path):
    t = library(BYTE)
    for planes in ("byte", "bit"):
        path = str(tmp_path / planes)
        token_files.write_tokens(docs, BYTE, path, planes=planes)
        out = token_files.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
        start, got = 0, []
        for r in out:
            assert r["start"] == start
            start += r["n_tokens"]
            got.append((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"], bytes(r["ids"])))
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in out]
        assert ids == sorted(ids)
        want = []
        for d, text in rows():
            x = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
            want.append((str(d), len(x) // 4, zlib.crc32(x), x))
        assert sorted(got) == sorted(want)
    token_files.write_tokens(docs.limit(0), BYTE, str(tmp_path / "none"))
    assert token_files.read_tokens(spark, str(tmp_path / "none")).collect() == []


def test_planes():
    rng = np.random.default_rng(0)
    for top in (1, 2, 255, 70_000, 2**32):
        ids = rng.integers(0, top, 40_000, dtype=np.uint64).astype(np.uint32)
        for planes in ("byte", "bit"):
            assert (token_files.unpack_chunk(*token_files.pack_chunk(ids, planes), planes) == ids).all()


def test_texts_that_polynomials_confuse():
    from test_ngram_join import thue_morse

    texts = []
    for n in (1024, 2048, 4096):
        texts += [thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))]
    texts += ["a\0b a\0", "\0", "\0\0", "x" * 16, "x" * 17, "é" * 8, "é" * 9]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw])
    from tributary.llm import tokens

    for path in (BYTE, WORD):
        coder, t = tokens.Encoder(path), library(path)
        for _ in range(2):  # found, and found again
            ids, ends = coder.encode(data, at)
            assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_joins_are_repaired(monkeypatch):
    monkeypatch.setattr(bpe, "CUT_BITS", 4)
    rng = random.Random(3)
    words = ["alpha", "Beta", "don't", "été", "12,5", "--", "<|endoftext|>", "(z)", "日本"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", ""]) for _ in range(600)) for _ in range(8)]
    raw = [t.encode() for t in texts]
    reuse, t = bpe.Reuse(BYTE, {}), library(BYTE)
    ids, ends = reuse.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert reuse.joins > 100 and 0 < reuse.repaired <= reuse.joins and reuse.widened == 0


def test_packing_of_hard_sizes():
    """Thirds that fit only in the right threes: crossover gets below best-fit decreasing."""
    rng = np.random.default_rng(1)
    sizes = []
    for _ in range(300):
        a = int(rng.integers(500, 900))
        b = int(rng.integers(400, 2048 - a - 300))
        sizes += [a, b, 2048 - a - b]
    greedy: list = []
    packing.best_fit(sizes, sorted(range(900), key=lambda k: -sizes[k]), greedy, [], 2048)
    best = packing.evolve(sizes, 2048, 1, [])
    assert sorted(k for b in best for k in b) == list(range(900)) and all(sum(sizes[k] for k in b) <= 2048 for b in best)
    assert len(best) < len(greedy)


def test_shards_share_their_last_bins(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in np.clip(rng.lognormal(3, 1, 4000), 1, 255)]
    df = spark.createDataFrame([(i, n, 5) for i, n in enumerate(sizes)], "doc_id long, length long, offset long")
    out = packing.pack(df, 256, shard_pieces=250).collect()
    assert len(out) == 4000 and len({r["sequence_id"] for r in out}) <= -(-sum(sizes) // 256) * 1.005 + 1
