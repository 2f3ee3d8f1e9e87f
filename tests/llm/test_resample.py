"""Importance resampling: CRCs from prefixes, and the drawing, against plain code."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from contactlake.llm import resample
from tests.llm.conftest import edge_pairs, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_crcs_of_all_runs_from_prefixes(monkeypatch, piece):
    monkeypatch.setattr(resample, "PIECE", piece)
    draw = random.Random(piece)
    for _ in range(200):
        text = "".join(draw.choice("abZé9 .,\n😀-_\x7f\x80") for _ in range(draw.choice([0, 1, 5, 50, 300])))
        words, wanted = runs(text)
        got = list(resample.features(text.encode()))
        assert sum(n for n, _ in got) == len(words)
        assert sorted(int(c) for _, crcs in got for c in crcs) == sorted(zlib.crc32(w.encode()) for w in wanted)


def test_longer_runs(monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 20)
    words = prose(5, 60).split()
    wanted = [" ".join(words[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(words) - n + 1)]
    got = [int(c) for _, crcs in resample.features(" ".join(words).encode(), 4) for c in crcs]
    assert sorted(got) == sorted(zlib.crc32(w.encode()) for w in wanted)


def test_shift_cancels_a_prefix():
    a, b = b"some words before ", b"and a long run of them" * 50
    got = resample.run_crcs(
        np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(a + b)], np.uint32), np.array([len(b)])
    )
    assert int(got[0]) == zlib.crc32(b)


def brute(docs, target):
    size = resample.BUCKETS

    def counts(texts):
        return Counter(zlib.crc32(r.encode()) % size for t in texts for r in runs(t)[1])

    s, t = counts(x for _, x in docs), counts(target)
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(bucket):
        ratio = float(t[bucket] + 1) * (all_s + size) / (float(s[bucket] + 1) * (all_t + size))
        return math.floor(1000 * math.log(ratio))

    rows = []
    for key, text in docs:
        words, features = runs(text)
        weight = sum(gain(zlib.crc32(r.encode()) % size) for r in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((key, len(words), len(features), weight, score))
    fit = sorted((-r[4], r[0] is not None, r[0] or 0) for r in rows if r[1] >= 20)
    return rows, fit[: 25 * len(fit) // 100]


def test_drawing_equals_plain_code(spark, corpus):
    pairs = edge_pairs() + [(100 + i, prose(i % 30, 15 + i % 20)) for i in range(120)]
    target = [prose(i, 40) for i in range(5)] + [None, "", "É é"]
    got = resample.resample(
        corpus(pairs), spark.createDataFrame([(t, "x") for t in target], "text string, bucket string")
    ).collect()
    rows, drawn = brute(pairs, target)
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got))) == sorted(map(str, rows))
    ranked = sorted((r.rank, -r.score, r.doc_id is not None, r.doc_id or 0) for r in got if r.rank is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r[1:] for r in ranked] == drawn


def test_empty_tables(spark, corpus, empty):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resample.resample(empty, target).isEmpty()
    rows = resample.resample(corpus([(1, prose(1, 30))]), target.limit(0)).collect()
    assert [(r.n_words, r.rank) for r in rows] == [(30, None)]  # a quarter of one row is none


def test_a_target_draws_its_like(spark, corpus):
    """Rare texts in the target's words are drawn far more often than the others."""
    own = " ".join(f"zeta{i} omega{i % 5}" for i in range(20))
    pairs = [(i, prose(i, 40) if i % 20 else own) for i in range(200)]
    target = spark.createDataFrame([(own,)] * 200, "text string")
    drawn = [r.doc_id for r in resample.resample(corpus(pairs), target).collect() if r.rank is not None]
    assert len(drawn) == 50 and sum(d % 20 == 0 for d in drawn) >= 8
