"""Operators 11 to 13 against plain Python, on small tables with the odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from edgetables.llm import filter_audit, order_minhash, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LONG = "Längeres Wort " * 3 + "x" * 70 + " " + "é" * 200


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def some_texts(seed=7, n=60):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "été", "x9", "日本語", "the", "of", "z" * 65, "naïve"]
    return [" ".join(rng.choices(words, k=rng.randrange(0, 60))) + rng.choice(["", ".", "\n", "\t!"]) for _ in range(n)]


# --- resampling ---------------------------------------------------------------------------------------------------


def test_checksums_are_those_of_the_library():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    starts = rng.integers(0, 3800, 500)
    sizes = rng.integers(1, 150, 500)
    want = [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(starts, sizes)]
    assert resample.crc32_of(data, starts, sizes).tolist() == want


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_features_are_all_runs_of_words(longest):
    texts = ["", "!!", LONG, "A b A b", *some_texts()]
    text_of, bucket, words = resample.features(texts, longest, 997)
    for k, text in enumerate(texts):
        found = WORD.findall(lowered(text))
        runs = [" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]
        assert sorted(bucket[text_of == k].tolist()) == sorted(zlib.crc32(run.encode()) % 997 for run in runs)
        assert words[k] == len(found)


def test_bit_slices_add_up_exactly():
    rng = np.random.default_rng(5)
    gains = rng.integers(-9000, 9000, 1000)
    text_of, bucket = np.sort(rng.integers(0, 8, 5000)), rng.integers(0, 1000, 5000) % rng.integers(1, 1000, 5000)
    planes = resample.planes_of(gains, 15)
    got = resample.sliced_sums(resample.count_planes(text_of, bucket, 9, 1000), planes)
    assert got.tolist() == [int(gains[bucket[text_of == k]].sum()) for k in range(9)]


def test_very_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", 40)
    texts = ["short one", LONG * 5, "word " * 100, "w" * 500, ""]
    counts = [np.zeros(resample.BUCKETS, int) for _ in texts]
    for start, some in resample.pieces(texts, 1):
        text_of, bucket, _ = resample.features(some)
        for k, b in zip(text_of, bucket):
            counts[start + k][b] += 1
    for text, count in zip(texts, counts):
        want = Counter(zlib.crc32(w.encode()) % resample.BUCKETS for w in WORD.findall(lowered(text)))
        assert {int(b): int(count[b]) for b in np.flatnonzero(count)} == want


def plain_resample(docs, target, percent=10, least=20):
    split = lambda text: [zlib.crc32(w.encode()) % 10000 for w in WORD.findall(lowered(text))]
    s, t = Counter(b for _, x in docs for b in split(x)), Counter(b for x in target for b in split(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
    rows = []
    for doc_id, text in docs:
        found = split(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None])
    may = sorted((row for row in rows if row[1] >= least and row[3] is not None), key=lambda row: (-row[3], row[0]))
    for rank, row in enumerate(may[: percent * len(may) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, rows), key=str)


def test_resampling_equals_plain_python(spark):
    docs = list(enumerate(some_texts(n=200))) + [(500, None), (501, ""), (502, "...")]
    docs += [(None, "the of the"), (503, LONG * 40), (3, some_texts(n=200)[3]), (3, some_texts(n=200)[3])]
    target = ["Beta été of of of", None, "", "naïve x9"]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, rank string, weight int")
    wanted = spark.createDataFrame([(1, x) for x in target], "doc_id int, text string")
    for percent in (10, 50, 100, 0):
        got = resample.resample(frame, wanted, percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_resample(docs, target, percent)


def test_resampling_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    assert [tuple(r) for r in resample.resample(some, none).collect()] == plain_resample([(1, "a b")], [])


# --- fingerprints -------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    """Elements one by one; the hashes of runs are taken from the operator."""
    size = min(order_minhash.GRAM, len(text))
    seen, elements = Counter(), []
    for k, base in enumerate(order_minhash.gram_hashes(text).tolist()):
        run = text[k : k + size]
        x = np.array([(base + seen[run] * int(order_minhash._STEP)) % 2**64], np.uint64)
        elements.append(int(order_minhash.mixed(x)[0]))
        seen[run] += 1
    if not elements:
        return [0] * order_minhash.PLACES
    out = []
    for j in range(order_minhash.PLACES):
        turn, times = int(order_minhash._TURN[j, 0]), int(order_minhash._TIMES[j, 0])
        by_hash = sorted(range(len(elements)), key=lambda k: (((elements[k] >> 32) ^ turn) * times % 2**32, k))
        total = int(order_minhash._PLACE[j])
        for k in sorted(by_hash[: order_minhash.PICKED]):
            x = (total * int(order_minhash._BASE) + elements[k]) % 2**64
            total = int(order_minhash.mixed(np.array([x], np.uint64))[0])
        out.append(total >> 48)
    return out


@pytest.mark.parametrize("block", [8192, 5])
def test_fingerprints_equal_plain_python(monkeypatch, block):
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    for text in ["", "a", "ab", "12345678", "123456789", "aaaaaaaaaaaaaaaaaaaa", "日本語 " * 9, *some_texts(n=8)]:
        assert order_minhash.fingerprint(text).tolist() == plain_fingerprint(text)


def test_fingerprints_follow_the_edit_distance():
    rng = random.Random(2)
    parts = ["".join(rng.choices("abcdefghij ", k=200)) for _ in range(8)]
    text, mark = "".join(parts), lambda t: order_minhash.fingerprint(t)
    near = order_minhash.likeness(mark(text), mark(text.replace(text[800:804], "____")))
    moved = order_minhash.likeness(mark(text), mark("".join(reversed(parts))))
    other = order_minhash.likeness(mark(text), mark("".join(rng.choices("abcdefghij ", k=1600))))
    assert near > 0.9 and near > moved + 0.2 and moved > other and other < 0.1


def plain_next(docs):
    ordered = sorted(docs, key=lambda d: -d[0])
    out = []
    for k, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        marks = [order_minhash.fingerprint(t) for t in (text, edited, after)]
        agree = [float(np.mean(marks[0] == m)) for m in marks[1:]]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *[m.astype("<u2").tobytes().hex() for m in marks[:2]], *agree))
    return sorted(out)


@pytest.mark.parametrize("ranges", [1, 3, 9])
def test_each_document_meets_the_next(spark, ranges):
    docs = [(3 * k, text) for k, text in enumerate(some_texts(n=25))]
    docs += [(-4, None), (100, ""), (101, "y"), (200, LONG * 300), (201, "ab😀cd")]
    frame = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, fingerprint double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = order_minhash.with_next(frame)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        assert got.columns == names
        assert sorted(map(tuple, got.collect())) == plain_next(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_next_of_few_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert order_minhash.with_next(spark.createDataFrame([], schema)).count() == 0
    (alone,) = order_minhash.with_next(spark.createDataFrame([(1, "one text on its own")], schema)).collect()
    assert alone["near_next"] == 1.0 and alone["n_chars"] == 19
    same = [(5, "repeated row")] * 4 + [(None, "no id"), (None, None)]
    rows = order_minhash.with_next(spark.createDataFrame(same, schema)).collect()
    assert len(rows) == 6 and sum(r["near_next"] == 1.0 for r in rows) == 3
    marks = {r["fingerprint"] for r in order_minhash.fingerprints(spark.createDataFrame(same, schema)).collect()}
    assert len(marks) == 3


# --- filter audit -------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    first = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    good, bad = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    parts = {}
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > first[text],
        }
        parts.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, doc_id in good, doc_id in bad))
    out = []
    for part, rows in parts.items():
        removed = Counter()
        found = []
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order):
                before = set(order[:step])
                here = [r for r in rows if letter in r[0] and not r[0] & before]
                removed[letter] += len(here)
                found.append((
                    letter, part, order, step + 1, sum(not r[0] & (before | {letter}) for r in rows), len(here),
                    sum(letter in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {letter} for r in rows),
                    sum(r[1] for r in here), sum(r[2] for r in here),
                ))
        out += [(*row[1:], removed[row[0]]) for row in found]
    return sorted(out)


def test_audit_equals_plain_python(spark):
    rng = random.Random(11)
    many = [f"w{k}" for k in range(90)]
    texts = [" ".join(rng.choices(many, k=rng.randrange(60, 240))) for _ in range(30)]
    texts += [t.upper() for t in texts[:8]] + [t + " 5%" for t in texts[5:12]] + ["", " ", "A", "e\x0bf\x0cg h", "word " * 20000]
    docs = [(k, t, rng.choice(["en", "fr", None, ""])) for k, t in enumerate(texts * 2)]
    docs += [(None, texts[0], "en"), (None, None, "zz"), (7, texts[7], "en"), (7, texts[7], "fr"), (300, None, None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, quality string")
    judged = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit(frame, judged)
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "x", None)], docs.schema), labels).collect()
    assert len(one) == 600 and sum(r["removed"] for r in one) == 120


def test_fewer_filters(spark):
    counted = spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 0, 2, 2, 0)], "part string, mask int, docs long, good long, toxic long")
    rows = {(r["filter_order"], r["step"]): r for r in filter_audit.interactions(counted, "XY").collect()}
    assert rows["XY", 1]["removed"] == 5 and rows["XY", 2]["redundant"] == 5 and rows["YX", 2]["kept"] == 2
    assert rows["XY", 1]["shapley"] == 5 and len(rows) == 4
