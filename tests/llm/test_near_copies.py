"""The near-duplicate stage against brute-force shingle similarity."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tieout.llm import near_copies
from tieout.llm.simhash import fingerprint


def brute(texts, width=5, similarity=0.8):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [grams(t) for t in texts]
    fps = [fingerprint(t or "", width) for t in texts]
    linked = lambda i, j: len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) or (fps[i] ^ fps[j]).bit_count() <= 4
    near = [[j for j in range(len(texts)) if linked(i, j)] for i in range(len(texts))]
    part = list(range(len(texts)))
    for _ in texts:
        now = [min(part[j] for j in near[i]) for i in range(len(texts))]
        if now == part:
            break
        part = now
    return near, part


def varied():
    rng = random.Random(11)
    texts = [None, "", " \n", "one two", "One  two", "a b c d e"]
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(100, 500))]
        texts.append(" ".join(words))
        for _ in range(4):
            new = list(words)
            for _ in range(rng.randint(0, len(words) // 30)):
                new[rng.randrange(len(new))] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(new))
    return texts


@pytest.mark.parametrize("block", [512, 2])
def test_near_copies_have_the_groups_of_brute_force(spark, block):
    texts = varied()
    near, part = brute(texts)
    assert sum(len(n) - 1 for n in near) > 60
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    got = {r.key: r.component for r in near_copies.near_copies(rows, 5, "0.8", block).collect()}
    assert [got[i] for i in range(len(texts))] == part


def test_pipeline_stage_keeps_one_of_each_group_of_brute_force(spark):
    texts = varied()
    _, part = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"key": F.lit(1), "node": F.lit("x")})
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(part)) and got[0].asDict().keys() == {"doc_id", "text", "key", "node"}


def test_bands_recall_at_the_least_similarity():
    rng = random.Random(2)
    met = total = 0
    for _ in range(300):
        common = [rng.getrandbits(64) for _ in range(400)]
        a, b = (near_copies.np.array(sorted(common + [rng.getrandbits(64) for _ in range(50)]), near_copies.np.uint64) for _ in range(2))  # 400 of 500
        met, total = met + bool(set(near_copies.bands(a)) & set(near_copies.bands(b))), total + 1
    assert met >= 0.99 * total
