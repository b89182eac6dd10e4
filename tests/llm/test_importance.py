"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from onefold.llm.importance import crc32s, gain_planes, importance_resample, sliced_sums

TEXTS = [
    (1, "Alpha beta-beta, GAMMA! 42 été " * 8), (2, "alpha " * 25), (2, "alpha " * 25), (3, None), (4, ""), (5, " ,;! "), (6, "x" * 70_000), (7, "one two"),
    (None, "beta " * 30), (8, "Ünï " * 20), (9, "w " * 19), (10, "w " * 20), (11, " ".join(f"t{i % 50}" for i in range(30_000))),
] + [(100 + i, f"common words {i % 7} here " * (3 + i % 5)) for i in range(60)]
TARGET = ["alpha beta gamma", "common t1 t2 t3", None, ""]
SCHEMA = "doc_id long, text string, weight string, rank int, score string, n_words string, bucket string, __down string"


def features(text, longest):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets, longest, percent=10):
    found = [features(t, longest) for _, t in docs]
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for counts, texts in ((s, [f for _, f in found]), (t, [features(x, longest)[1] for x in target])):
        for fs in texts:
            for f in fs:
                counts[zlib.crc32(f.encode()) % buckets] += 1
    total = [(float(s.sum()) + buckets), (float(t.sum()) + buckets)]
    gain = [math.floor(1000 * math.log((b + 1) * total[0] / ((a + 1) * total[1]))) for a, b in zip(s, t, strict=True)]
    rows = []
    for (d, _), (n_words, fs) in zip(docs, found, strict=True):
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n_words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = percent * len(able) // 100
    return [(*r, i + 1 if i < drawn else None) for i, r in enumerate(able)] + [(*r, None) for r in rows if r[1] < 20]


@pytest.mark.parametrize(("buckets", "longest", "percent"), [(10_000, 1, 10), (64, 2, 50), (1, 3, 100)])
def test_matches_brute_force(spark, buckets, longest, percent):
    docs = spark.createDataFrame([(*r, "a", 1, "b", "c", "d", "e") for r in TEXTS], SCHEMA).repartition(4)
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, n int")
    got = [tuple(r) for r in importance_resample(docs, target, buckets, longest, percent=percent).collect()]
    want = brute(TEXTS, TARGET, buckets, longest, percent)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert importance_resample(none, none).count() == 0
    docs = spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id long, text string")
    got = [tuple(r)[:1] + tuple(r)[5:] for r in importance_resample(docs, none, percent=100).collect()]
    assert sorted(got) == [(1, 1), (2, None)]


def test_crc_of_runs():
    words = ["a" * 300, "x", "é", "b" * 64, "c" * 65, "", *("z" * k for k in range(90))]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    start = end - [len(w.encode()) for w in words]
    assert crc32s(data, start, end).tolist() == [zlib.crc32(w.encode()) for w in words]
    assert len(crc32s(data, start[:0], end[:0])) == 0


def test_bit_planes_are_exact():
    draw = np.random.default_rng(1)
    for low, high in ((-30_000, 30_000), (-1, 1), (0, 5), (-8, 0), (-(1 << 40), 1 << 40)):
        gain = draw.integers(low, high, 1000)
        row = draw.integers(0, 700, 50_000)
        bucket = (draw.pareto(1, 50_000) * 10).astype(int) % 1000
        want = np.zeros(700, int)
        np.add.at(want, row, gain[bucket])
        assert (sliced_sums(row, bucket, 700, gain_planes(gain), 1000) == want).all()
