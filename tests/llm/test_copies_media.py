"""Exact dedup and media columns."""

import hashlib
import zlib

import numpy as np

from tributary.llm import exact_dedup, media

ROWS = [(1, "a", "x"), (2, "a", "y"), (3, "b", None), (4, None, "z"), (5, "", "z"), (None, "b", "z"), (2, "a", "y"), (6, "c" * 100_000, "z"), (None, "d", "z"), (None, "d", "w")]


def test_exact(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string").repartition(3)
    for keep, pick in (("largest", max), ("smallest", min)):
        want = []
        for d, t, _ in ROWS:
            ids = [i for i, u, _ in ROWS if (u or "") == (t or "") and i is not None]
            size = sum((u or "") == (t or "") for _, u, _ in ROWS)
            stays = pick(ids) if ids else None
            want.append((str(d), str(stays), size, d == stays if d is not None else stays is None, hashlib.sha256((t or "").encode()).hexdigest()))
        got = [(str(r["doc_id"]), str(r["keep_id"]), r["group_size"], bool(r["kept"]), r["text_sha256"]) for r in exact_dedup.exact_groups(df, keep).collect()]
        assert sorted(got) == sorted(want)
    left = exact_dedup.deduplicate(df).collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(["1", "3", "4", "6", "None", "None"]) and all("keep_id" in r.asDict() for r in left)
    assert exact_dedup.exact_groups(df.limit(0)).collect() == []


def test_media_forms():
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (24, 24), (7, 13), (50, 3)):
        grey = rng.integers(0, 256, shape, dtype=np.uint8)
        for form in (media.pgm, media.bmp):
            assert (media.decode(form(grey)) == grey).all()
        h, w = shape
        assert (media.resize_area(grey, h, w) == grey).all()
        big = media.resize_area(np.kron(grey, np.ones((3, 2), np.uint8)), h, w)
        assert (big == grey).all()
    assert (media.decode(b"P2 # c\n2 2\n15\n0 15 5 10\n") == np.array([[0, 255], [85, 170]])).all()
    assert (media.decode(b"P1\n3 1\n1 0 1\n") == np.array([[0, 255, 0]])).all()
    assert media.decode(b"P6\n1 1\n255\nabc").shape == (1, 1, 3)
    for broken in (b"", b"P5\n9 9\n255\nx", b"BM", b"GIF89a", b"P5\n0 0\n255\n"):
        assert media.decode(broken) is None or media.decode(broken).size == 0


def test_media(spark):
    df = spark.createDataFrame([(d, t, "x") for d, t, _ in ROWS], "doc_id long, text string, media string").repartition(3)
    out = media.media_features(media.stored(media.text_media(df))).collect()
    want = []
    for d, t, _ in ROWS:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.append((str(d), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["samples_bytes"], r["samples_sha256"], r["samples_tail_crc32"]) for r in out) == sorted(want)
    for r in out:
        assert bytes(r["tile"])[:6] == b"\x93NUMPY" and len(r["dhash"]) == 16
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"nope"))], "doc_id long, media binary")
    assert all(r["width"] is None and r["tile"] is None for r in media.media_features(odd).collect())


def plain_resize(picture, height, width):
    """The mean of each target sample's area, sample by sample."""
    h, w = picture.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            total = 0.0
            for y in range(h):
                dy = min((i + 1) * h / height, y + 1) - max(i * h / height, y)
                for x in range(w) if dy > 0 else ():
                    dx = min((j + 1) * w / width, x + 1) - max(j * w / width, x)
                    total += picture[y, x] * dy * dx if dx > 0 else 0
            out[i, j] = total * height * width / (h * w)
    return out


def test_resize_and_hash():
    rng = np.random.default_rng(3)
    for shape in ((24, 24), (31, 24), (5, 17), (8, 9), (1, 1)):
        grey = rng.integers(0, 256, shape, dtype=np.uint8)
        for target in ((24, 24), (8, 9), (3, 7)):
            assert np.abs(media.resize_area(grey, *target) - plain_resize(grey, *target)).max() <= 0.5 + 1e-6
        small = media.resize_area(grey, 8, 9).astype(int)
        bits = "".join(str(int(small[i, j] < small[i, j + 1])) for i in range(8) for j in range(8))
        assert media.difference_hash(grey) == int(bits, 2)


def test_query(spark):
    from tributary.llm.queries import op9_media_columns

    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op9_media_columns(spark, sf_dir).collect():
        raw = texts[r["doc_id"]].encode()
        rows = np.frombuffer(raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw)), np.uint8).reshape(-1, 24)
        stored = b"P5\n24 %d\n255\n" % len(rows) + rows.tobytes()
        assert (r["n_bytes"], r["media_bytes"], r["media_sha256"]) == (len(raw), len(stored), hashlib.sha256(stored).hexdigest())
        tile = media.npy(media.resize_area(rows, 24, 24))
        assert r["feature"] == f"{media.difference_hash(rows):016x}:{hashlib.sha256(tile).hexdigest()}"
