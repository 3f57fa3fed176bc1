"""The registered queries over the whole smallest tables, against plain computations."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers

import test_conversations
import test_importance
import test_suffix_dedup
from tributary.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in t}


def rows(spark, name):
    return queries.queries()[name](spark, SF).collect()


def by_id(found):
    out = {r["doc_id"]: r for r in found}
    assert len(out) == len(found)
    return out


def test_op1(spark, docs):
    sets, parent = {}, {i: i for i in docs}
    for i, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(words[k : k + 4]) for k in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} - {()}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = by_id(rows(spark, "op1_ngram_jaccard_join"))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == {i: (len(sets[i]), root(i)) for i in docs}


def test_op4_and_op7(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.no_truncation()
    t.no_padding()
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in docs.items()}
    packed = lambda x: np.array(x, "<u4").tobytes()
    got = by_id(rows(spark, "op4_bpe_round_trip"))
    for i, x in ids.items():
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(x), hashlib.sha256(packed(x)).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()
    got, start = by_id(rows(spark, "op7_token_files")), 0
    for i in sorted(ids):
        assert tuple(got[i][c] for c in ("start", "n_tokens", "ids_crc32")) == (start, len(ids[i]) + 1, zlib.crc32(packed([*ids[i], 0])))
        start += len(ids[i]) + 1


def test_op5(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    t.no_truncation()
    t.no_padding()
    want = {}
    for i, x in docs.items():
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[i, p] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    found = rows(spark, "op5_best_fit_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == want and len(found) == len(want)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(x[1] for x in want.values()) // 2048) + 1


def test_op8(spark, docs):
    data = [(i, x.encode()) for i, x in sorted(docs.items())]
    got = by_id(rows(spark, "op8_suffix_array_dedup"))
    for (i, x), gone in zip(data, test_suffix_dedup.brute(data), strict=True):
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == (len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize(("name", "label", "parts", "fold", "threshold"), [("op6_quality_classifier", "quality", 5, 0, 0.3), ("op10_toxicity", "toxic", 3, 1, 0.7)])
def test_op6_and_op10(spark, docs, name, label, parts, fold, threshold):
    got = by_id(rows(spark, name))
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % parts == fold) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    labels = {r["doc_id"]: r[label] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    seen = [got[i]["predicted"] == y for i, y in labels.items() if i in got and y is not None]
    assert np.mean(seen) >= 0.85


def test_op11(spark):
    found = rows(spark, "op11_conversation_repair")
    want = test_conversations.expected([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()])
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == want and len(found) == len(want)


def test_op12(spark, docs):
    target = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    found = sorted((tuple(r) for r in rows(spark, "op12_importance_resampling")), key=str)
    want = test_importance.expected(list(docs.items()), target)
    assert found == sorted(((i, n, w, s, k) for i, _, n, w, s, k in want), key=str)
