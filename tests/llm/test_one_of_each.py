"""One row of each group stays, whatever the ids are."""

import random

import pytest

import corpus_pipeline
from tieout.llm import simhash


@pytest.mark.parametrize("stage", [lambda s, d: corpus_pipeline.near_duplicates(s, d, ""), lambda s, d: simhash.one_of_each_group(d, 5, 6)])
def test_null_and_repeated_ids(spark, stage):
    rng = random.Random(4)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(5))
    rows = [(None, a), (1, b), (1, b), (1, c), (2, c), (None, d), (5, d), (3, e), (4, e), (None, e)]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, a), (1, b), (1, c), (5, d), (3, e)])
