"""Periodic runs against brute force over all starts and periods."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieout.llm import periodic_runs, queries


def brute(words, least=6, periods=4):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            found.setdefault((i, j + q), q)  # periods rise, so the first is the smallest
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, periods * q) and e - s >= 2 * q)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(words):
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    most = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (most[0], most[1], most[2], 1000 * most[1] // most[2]) if most else (None,) * 4
    return (len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("least, periods", [(6, 4), (6, 2), (2, 2), (9, 3), (1, 5)])
def test_runs_of(least, periods):
    rng = random.Random(least * 10 + periods)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            unit = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 7))]
            text = [rng.randrange(3) for _ in range(rng.randint(0, 12))] + unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))] + [rng.randrange(2) for _ in range(rng.randint(0, 25))]
            if rng.random() < 0.2:
                text = text * 2
            texts.append(text)
        codes, part = np.array(sum(texts, []), np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        at = np.cumsum([0, *map(len, texts)])
        want = sorted((int(at[k]) + s, int(at[k]) + s + length, q) for k, t in enumerate(texts) for s, length, q in brute(t, least, periods))
        assert sorted(periodic_runs.runs_of(codes, part, least, periods)) == want


def test_long_texts():
    began = time.time()
    n = 200_000
    zeros, part = np.zeros(n, np.int64), np.zeros(n, np.int64)
    assert periodic_runs.runs_of(zeros, part) == [(0, n, 1)]
    unit = np.random.default_rng(1).integers(0, 50_000, n // 5)
    assert periodic_runs.runs_of(np.concatenate([[-1 + 60_000], np.tile(unit, 5), [60_000]]), np.zeros(n + 2, np.int64)) == [(1, n + 1, n // 5)]
    assert time.time() - began < 60


def test_query(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "a", "x x x x x", "x x x x x x", "ab " * 7, "é\x1c é\x1c é\x1c é\x1c é\x1c é\x1c", "Z  " * 30, "a b c a b c a b c a b c", "w " * 20_000]
    texts += [" ".join(rng.choice(["a", "bb", "é", "d.", "E"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [*enumerate(texts), (4, "y y y y y y y z z z z z z z"), (None, "n n n n n n n"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "runs": F.lit(None), "n": F.lit(1)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    split = lambda t: [w.decode() for w in (t or "").encode().split()]
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert got.columns == names
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(i, *expected(planted(i, split(t)))) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) > 20
    assert periodic_runs.periodic_runs(df.limit(0)).collect() == []
