import gzip
import hashlib
import math

import numpy as np
import pytest

from edgetables.llm import embed_dedup, topk, warc
from tests.reference_labels import labels

SCHEMA = "vec_id long, embedding array<float>, label int, n int"


def odd_rows():
    return [
        (1000, None, 1, 1),
        (1001, [], 1, 1),
        (1002, [0.0] * 8, 1, 1),
        (1003, [float("nan")] + [1.0] * 7, 1, 1),
        (1004, [1.0, None] + [1.0] * 6, 1, 1),
        (1005, [float("inf")] * 8, 1, 1),
        (None, [1.0] * 8, None, 1),
        (1006, [1.0] * 5, 1, 1),
    ]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for k in range(12):
        base = rng.normal(size=8)
        out += [base + rng.normal(size=8) * 0.25 * (j % 4) for j in range(15)]
    out += [out[0]] * 20 + list(rng.normal(size=(40, 8)))
    order = rng.permutation(len(out))
    return [(int(i), [float(x) for x in np.float32(out[i] / 5)], 0, 1) for i in order] + odd_rows()


def sound(rows):
    return {
        r[0]: np.array(r[1], float) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all()
    }


@pytest.mark.parametrize("block_rows, slices", [(16_384, 7), (64, 1), (64, 3)])
def test_top_k_equals_brute_force(spark, rows, monkeypatch, block_rows, slices):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(topk, "TOP_SLICES", slices)
    monkeypatch.setattr(topk, "LEAST_QUERIES", 10)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in topk.top_k(frame, frame.filter("vec_id % 5 = 0"), k=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vectors = {k: np.floor(v * 256).astype(int) for k, v in sound(rows).items()}
    for query in [k for k in vectors if k % 5 == 0]:
        scored = sorted((-int(v @ vectors[query]), k) for k, v in vectors.items() if k != query and len(v) == len(vectors[query]))
        want = [(rank, k, -s) for rank, (s, k) in enumerate(scored[:4], 1)]
        assert sorted(got.pop(query, [])) == want
    assert not got


def test_top_k_of_few_or_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0], 0, 0), (1, [1.0, -2.0], 0, 0), (1, [1.0, -2.0], 0, 0)], SCHEMA)
    rows = sorted(tuple(r) for r in topk.top_k(frame, frame, k=5).collect())
    score = 256 * 256 - 512 * 512
    assert rows == [(0, 1, 1, score), (0, 2, 1, score), (1, 1, 0, score)]
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_large_components(spark, monkeypatch, block_rows):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(1)
    sizes = [1.0, 1e7, 1e12, 1e17, 1e300, -1e300]
    rows = [(k, [float(x) for x in rng.normal(size=3) * rng.choice(sizes, 3)]) for k in range(24)] + [(30, [1e7, -1e7, 0.5]), (31, [-1e300] * 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    held = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    codes = {k: [held(math.floor(256 * x)) for x in v] for k, v in rows}
    want = []
    for query, q in codes.items():
        scored = sorted((-held(sum(a * b for a, b in zip(q, c))), k) for k, c in codes.items() if k != query)
        want += [(query, rank, k, -s) for rank, (s, k) in enumerate(scored[:3], 1)]
    assert sorted(tuple(r) for r in topk.top_k(frame, frame, k=3).collect()) == sorted(want)


def test_signed_digits_and_slices():
    for n in range(-300, 300):
        assert sum(d << s for s, d in topk.signed_digits(n)) == n
    codes = np.array([[-5, 3], [7, -8], [0, 1]])
    bits, maps = topk.slices_of(codes)
    assert bits == 4
    block = topk.Block(np.array([1, 2, 3]), bits, maps)
    assert block.codes(np.array([0, 1, 2])).T.tolist() == codes.tolist()


@pytest.mark.parametrize("tile", [4096, 40])
@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_links_equal_brute_force(spark, rows, monkeypatch, tile, threshold):
    monkeypatch.setattr(embed_dedup, "TILE_ROWS", tile)
    monkeypatch.setattr(embed_dedup, "STRIPE_ROWS", 16)
    found = embed_dedup.near_links(spark.createDataFrame(rows, SCHEMA), threshold=threshold).collect()
    assert len(found) == len(rows)
    vectors = {k: v for k, v in sound(rows).items() if v.any()}
    links = [
        (a, b)
        for a, x in vectors.items()
        for b, y in vectors.items()
        if a < b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    ]
    component = labels(links)
    for r in found:
        n = sum(r["vec_id"] in link for link in links)
        smallest = component.get(r["vec_id"], r["vec_id"])
        assert (r["n_links"], r["component_id"], r["kept"]) == (n, smallest, smallest == r["vec_id"])


def test_ids_that_repeat_with_other_vectors(spark):
    rows = [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (3, [1.0, 0.01]), (5, [0.01, 1.0]), (7, [1.0, 0.0]), (9, [-1.0, 0.0])]
    found = embed_dedup.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found)
    assert got == [(3, 2, 3, True), (5, 1, 5, True), (7, 1, 5, False), (7, 2, 3, False), (7, 2, 3, False), (9, 0, 9, True)]


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    units, codes, scales, errors = embed_dedup.quantise(rng.normal(size=(200, 16)) * 10.0 ** rng.integers(-150, 150, (200, 1)))
    exact = units @ units.T
    near = (codes.astype(int) @ codes.astype(int).T) * np.outer(scales, scales)
    bound = errors[:, None] + errors + np.outer(errors, errors)
    assert (np.abs(exact - near) <= bound + 1e-12).all() and np.allclose((units**2).sum(1), 1)


def test_no_vectors(spark):
    assert embed_dedup.near_links(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r["kept"] for r in embed_dedup.near_links(spark.createDataFrame(odd_rows()[:3], SCHEMA)).collect()] == [True] * 3


PAGES = "page_id long, url string, html string, file string"


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_archives_give_back_every_page(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    monkeypatch.setattr(warc, "MAX_BROADCAST_DIGESTS", broadcast)
    long, short = "é<p>\r\n\r\nx" * 300, "tiny"
    pages = [(k, f"http://h/{k}\r\n", long, "") for k in range(8)] + [(k, None, short, "") for k in (20, 21)]
    pages += [(30, "u", None, None), (31, "u", "", None), (None, "u", "n" * 1500, ""), (None, "u", long, ""), (40, "u", "z" * 5000, "")]
    frame = spark.createDataFrame(pages, PAGES).repartition(3)
    folder = warc.write_warc(frame)
    rows = warc.resolve_revisits(warc.read_records(spark, folder.uri), with_payload=True).collect()
    assert len(rows) == len(pages)
    got = sorted((-1 if r["page_id"] is None else r["page_id"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in rows)
    want = [(k, "response" if k == 7 else "revisit", None if k == 7 else 7, long.encode()) for k in range(8)]
    want += [(20, "response", None, b"tiny"), (21, "response", None, b"tiny"), (30, "response", None, b""), (31, "response", None, b"")]
    want += [(-1, "response", None, b"n" * 1500), (-1, "revisit", 7, long.encode()), (40, "response", None, b"z" * 5000)]
    assert got == sorted(want)
    for r in rows:
        payload = bytes(r["payload"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())


def test_archive_of_nothing(spark):
    folder = warc.write_warc(spark.createDataFrame([], PAGES))
    assert warc.resolve_revisits(warc.read_records(spark, folder.uri)).count() == 0


def test_records_are_separate_gzip_members():
    records = [warc.warc_record(k, "u", b"x" * k, hashlib.sha1(b"x" * k).hexdigest(), None, False, warc.DATE) for k in range(3)]
    packed = b"".join(gzip.compress(r) for r in records)
    assert list(warc.members(memoryview(packed))) == records and gzip.decompress(packed) == b"".join(records)
    assert [warc.parse_record(r)[5] for r in records] == [0, 1, 2]
    with pytest.raises(ValueError):
        list(warc.members(memoryview(packed[:-5])))
