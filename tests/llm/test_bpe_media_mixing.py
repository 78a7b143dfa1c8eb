import hashlib
import json
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pileline.llm import bpe, media, mixing
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "hello world's  \n\n end", "<|endoftext|>x<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaa", "é" * 50, "\U0001f600‍梦 12345 ½ ₂", "!!!???...", "x" * 3000, "Ab1 " * 2000, "\x00\x01\x85  "]


def test_ids_are_the_library_s():
    library, own = Tokenizer.from_file(PATH), bpe.ByteBpe(bpe.read_spec(PATH))
    r = random.Random(4)
    texts = [t or "" for t in TEXTS] + ["".join(chr(r.choice([32, 32, 65, 97, 101, 116, 233, 0x4E00, 0x301, 39, 10, 49, 0x1F600])) for _ in range(60)) for _ in range(300)]
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert list(ids) == want, t
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert own.decode([222, 50256, 5]) == library.decode([222, 50256, 5], skip_special_tokens=False)


def test_round_trip_rows(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, "a")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted(map(tuple, bpe.round_trip_digests(df, PATH).collect()))
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in [*enumerate(TEXTS), (3, "a")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    apart = bpe.decode(bpe.encode(df, PATH), PATH)
    assert sorted(map(str, apart.collect())) == sorted(map(str, bpe.round_trip(df, PATH).collect()))
    assert bpe.round_trip_digests(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("planes", [1, 3])
def test_images_round_trip(planes):
    image = np.random.default_rng(1).integers(0, 256, (7, 5, planes), dtype=np.uint8)
    assert (media.decode(media.encode_netpbm(image)) == image).all()
    if planes == 3:
        assert (media.decode(media.encode_bmp(image)) == image).all()
    plain = f"P{2 if planes == 1 else 3} # a comment\n5 7\n255\n" + " ".join(map(str, image.reshape(-1)))
    assert (media.decode(plain.encode()) == image).all()


def test_bitmaps_and_damage():
    bits = np.array([[1, 0, 1], [0, 1, 1]], np.uint8)
    assert (media.decode(b"P1\n3 2\n101\n011\n")[:, :, 0] == bits).all()
    assert (media.decode(b"P4\n3 2\n" + np.packbits(bits, axis=1).tobytes())[:, :, 0] == bits).all()
    assert media.decode(b"P5\n2 1\n1000\n" + (999).to_bytes(2, "big") + (3).to_bytes(2, "big")).tolist() == [[[999], [3]]]
    for bad in (None, b"", b"P6", b"P6\n2 2\n255\nabc", b"BM123", b"GIF89a", b"P5\n0 4\n255\n", b"P6\nx y\n"):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def test_resize_is_the_mean_over_areas():
    image = np.arange(6 * 4, dtype=np.uint8).reshape(6, 4, 1)
    assert np.allclose(media.resize(image, 3, 2)[:, :, 0], image[:, :, 0].reshape(3, 2, 2, 2).mean((1, 3)))
    assert np.allclose(media.resize(image, 1, 1), image.mean()) and np.allclose(media.resize(image, 12, 8)[::2, ::2], image)


def test_text_media_rows(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, media int")
    for x in media.media_digests(media.text_media(df)).collect():
        raw = (TEXTS[x.doc_id] or "").encode()
        payload = raw + b" " * (max(1, math.ceil(len(raw) / 192)) * 192 - len(raw))
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert x.media_bytes > len(payload)
    tiled = media.tiles(spark.createDataFrame([(1, bytearray(b"P5\n2 2\n255\n\x00\x10\x20\x30")), (2, None), (3, bytearray(b"zz"))], "id int, m binary"), "id", "m", 4).orderBy("id").collect()
    assert np.load(__import__("io").BytesIO(tiled[0].tile)).shape == (4, 4, 1) and tiled[0].error is None
    assert tiled[1].error == "empty" and tiled[2].error == "unknown kind"


def water_fill(sizes, weights, most=3):
    """The targets by resharing the excess round by round."""
    target, open_, left = {}, dict(weights), float(sum(sizes.values()))
    while open_:
        whole = sum(open_.values())
        over = [s for s in open_ if left * open_[s] / whole > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * w / whole for s, w in open_.items()}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        for s in over:
            del open_[s]
    return target


def test_mixing_meets_targets(spark):
    r = random.Random(9)
    docs = []
    for s, n in (("b", 400), ("a", 40), (None, 60), ("c", 3), ("é", 200), ("z", 1)):
        docs += [(len(docs) + k, " ".join(["w"] * r.randrange(0, 40)), s) for k in range(n)]
    docs += [(9000, None, "a"), (9001, "", "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    rows = mixing.mixed(df).collect()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water_fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    source, taken = {d: s for d, _, s in docs}, {}
    assert len(rows) == len(docs)
    for x in rows:
        assert x.source_size == sizes[source[x.doc_id]] and abs(x.target - want[source[x.doc_id]]) < 1e-6
        assert 0 <= x.taken <= 3 * x.size and (not x.size or x.taken % x.size == 0)
        taken[source[x.doc_id]] = taken.get(source[x.doc_id], 0) + x.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 20
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixed(df.repartition(3)).collect()))
    copies = mixing.mixed_documents(df).groupBy("doc_id").count().collect()
    assert {x.doc_id: x["count"] for x in copies if next(y.size for y in rows if y.doc_id == x.doc_id)} == {x.doc_id: x.taken // x.size for x in rows if x.taken}
    assert mixing.mixed(df.limit(0)).count() == 0


def test_tiles_by_plain_loops(spark, tmp_path):
    image = np.random.default_rng(2).integers(0, 256, (7, 5, 3), dtype=np.uint8)
    n = 4
    cell = lambda i, k, size: max(0.0, min((i + 1) * size / n, k + 1) - max(i * size / n, k))
    want = np.zeros((n, n, 3))
    for y in range(n):
        for x in range(n):
            for row in range(7):
                for column in range(5):
                    want[y, x] += cell(y, row, 7) * cell(x, column, 5) * image[row, column] * n * n / 35
    stored = [(1, bytearray(media.encode_netpbm(image))), (2, bytearray(media.encode_bmp(image)))]
    media.write_tiles(media.tiles(spark.createDataFrame(stored, "id int, m binary"), "id", "m", n), str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t")).collect()
    assert len(read) == 2 and len({x.dhash for x in read}) == 1
    for x in read:
        assert (np.load(__import__("io").BytesIO(x.tile)) == np.rint(want)).all() and (x.height, x.width, x.planes) == (7, 5, 3)
    grey = media.grey(media.resize(image, 8, 9))
    bits = "".join(str(int(grey[y, x + 1] > grey[y, x])) for y in range(8) for x in range(8))
    assert read[0].dhash == f"{int(bits, 2):016x}"
    tall = np.random.default_rng(3).integers(0, 256, (10_001, 3, 1), dtype=np.uint8)  # more rows than a strip has
    assert np.allclose(media.resize(tall, 1, 1), tall.mean()) and np.allclose(media.resize(tall, 10_001, 3), tall)


def test_the_tile_of_a_text_is_returned(spark):
    rows = media.media_digests(media.text_media(spark.createDataFrame([(1, "abc" * 500), (2, None), (1, "abc" * 500)], "doc_id long, text string"))).collect()
    assert all(np.load(__import__("io").BytesIO(x.tile)).shape == (16, 16, 3) for x in rows)
    assert all(x.feature.endswith(hashlib.sha256(x.tile).hexdigest()[:32]) for x in rows)


def test_mixing_keeps_clashing_columns_and_cells_are_even(spark):
    names = "__key __s __epochs __last __n __copy __id __size __source __cell".split()
    df = spark.range(300).selectExpr("id as doc_id", "repeat('w ', 5) as text", "if(id % 3 = 0, 'a', null) as source", *[f"'x{k}' as {c}" for k, c in enumerate(names)])
    out = mixing.mixed_documents(df).collect()
    assert out and all([x[c] for c in names] == [f"x{k}" for k in range(len(names))] for x in out)
    # a source of the least weight: no cell gets a hundredth of its rows
    low = mixing.sized(spark.range(100_000).selectExpr("id as doc_id", "'a' as text", "'s' as source"), "doc_id", "text", "source", F.lit(0.1))
    assert low.groupBy("__cell").count().agg(F.max("count")).first()[0] < 1000


def test_mix_takes_a_part_of_equal_rows(spark):
    rows = [(1, "w " * 10, "a", 1)] * 40 + [(2, "w " * 10, "b", 1)] * 30 + [(k, "w " * 7, "c", 1) for k in range(20)] + [(None, None, None, 2)] * 3 + [(5, "x y", None, 3)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, own long").repartition(5)
    plan = {}
    for r in mixing.mixed(df).collect():
        plan[r["source_size"], r["target"]] = plan.get((r["source_size"], r["target"]), 0) + r["taken"]
    words = {}
    for r in mixing.mixed_documents(df).collect():
        words[r["source"]] = words.get(r["source"], 0) + len((r["text"] or "").split())
    assert sorted(v for v in plan.values() if v) == sorted(v for v in words.values() if v)
    assert any(abs(v - t) <= 10 for (_, t), v in plan.items())


def test_a_tokenizer_file_that_is_not_read_in_full_is_refused():
    told = json.loads(bpe.read_spec(PATH))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": told["model"] | {"ignore_merges": True}}, {"added_tokens": [told["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError, match="not done here"):
            bpe.ByteBpe(json.dumps(told | change))


def test_tiles_as_npy_files_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text"), (1, "some text"), (None, None), (3, "é" * 700)], "doc_id long, text string")
    tiled = media.media_digests(media.text_media(docs))
    files = media.write_npy_files(tiled, f"file://{tmp_path}/tiles").collect()
    assert len({f["file"] for f in files}) == 4 and sorted((f["doc_id"] or 0) for f in files) == [0, 1, 1, 3]
    want = sorted(bytes(r["tile"]) for r in tiled.collect())
    assert sorted((tmp_path / "tiles" / f["file"]).read_bytes() for f in files) == want
    assert np.load(tmp_path / "tiles" / files[0]["file"]).ndim >= 2
    assert media.media_digests(media.text_media(docs.limit(0))).collect() == []
