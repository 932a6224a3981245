"""Operators that learn, on small tables, and the pipeline."""

import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tieout.llm import mixing, toxicity

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "to", "vi", "zu")]


def labelled(spark, n=400, seed=1):
    """Texts of neutral words; toxic ones have one of two bad words. Identity terms come with many toxic texts and few others."""
    random.seed(seed)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        w = random.choices(WORDS, k=15) + ([random.choice(["vile", "scumbag"])] if toxic and random.random() < 0.8 else [])
        if random.random() < (0.7 if toxic else 0.05):
            w.append(random.choice(["women", "men"]))
        random.shuffle(w)
        rows.append((i, " ".join(w), 1, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")


def test_toxicity_finds_held_out_texts(spark):
    docs, labels = labelled(spark)
    rows = toxicity.toxicity(docs.withColumns({"_id": F.lit(1), "_text": F.lit("x")}), labels).join(labels, "doc_id").collect()
    assert len(rows) == 400
    bad = {r.doc_id for r in docs.where("text like '%vile%' or text like '%scumbag%'").collect()}
    for held in (True, False):
        mine = [r for r in rows if r.held_out == held]
        assert mine and np.mean([r.predicted for r in mine if r.doc_id in bad]) > 0.95
        assert np.mean([r.predicted for r in mine if not r.toxic]) < 0.05
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_swap_penalty_frees_neutral_mentions(spark):
    """With terms that only one side of a swap has a weight for, the penalty takes the weight away."""
    features = {"women": 0, "vile": 1}
    rows = [[0, 1]] * 30 + [[0]] * 30 + [[1]] * 30 + [[]] * 90
    labels = [1] * 30 + [1] * 20 + [0] * 10 + [1] * 28 + [0] * 2 + [0] * 90
    swaps = [([0], []), ([0, 1], [1])] * 30
    plain, fair = toxicity.fit(features, rows, labels, swaps, 0.0), toxicity.fit(features, rows, labels, swaps, 50.0)
    assert plain.score({"women"}) > 0.5 > fair.score({"women"})
    assert abs(fair.weights[0]) < 0.2 * abs(plain.weights[0]) and fair.score({"vile"}) > 0.5


def test_swapped_texts():
    out = toxicity.swapped("the Women sing")
    assert len(out) == 2 and "men" in out[0] and "girls" in out[1] and all("women" not in f and "sing" in f for f in out)
    assert toxicity.swapped("nobody here") == []
    hindus = toxicity.swapped("all hindus sing")  # English and German have the word
    assert [f & {"buddhists", "atheists", "christen", "muslime", "christians", "muslims"} for f in hindus] == [{"buddhists"}, {"atheists"}, {"christen"}, {"muslime"}]


def test_features_of_long_and_unspaced_words():
    assert toxicity.word_features("Word!") == ("word", "word*")
    assert "~本語" in toxicity.word_features("日本語") and "日本語" not in toxicity.word_features("日本語")
    long = toxicity.word_features("ab" * 50_000)
    assert set(long) == {"abab*", "ababa*", "ababab*", "~ab", "~ba", "~aba", "~bab"}


def test_fit_against_a_dense_reference():
    """Plain gradient descent on the dense loss comes to the same scores."""
    rng = np.random.default_rng(3)
    x = (rng.random((80, 5)) < 0.4).astype(float)
    y = (x @ np.array([2.0, -1, 0.5, 0, 1]) + rng.normal(size=80) > 1).astype(float)
    swaps = [(sorted(map(int, rng.choice(5, 2, replace=False))), [int(rng.integers(5))]) for _ in range(20)]
    d = np.zeros((20, 5))
    for i, (p, q) in enumerate(swaps):
        d[i, p] += 1
        d[i, q] -= 1
    w, b, penalty = np.zeros(5), 0.0, 0.05
    for _ in range(40_000):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) / 80
        w, b = w - 0.3 * (x.T @ e + toxicity.RIDGE * w + 2 * penalty / 20 * d.T @ (d @ w)), b - 0.3 * e.sum()
    model = toxicity.fit({str(i): i for i in range(5)}, [np.nonzero(r)[0].tolist() for r in x], y.tolist(), swaps, penalty)
    assert np.abs(1 / (1 + np.exp(-(x @ w + b))) - 1 / (1 + np.exp(-(x @ model.weights + model.bias)))).max() < 0.01


def test_toxicity_of_odd_tables(spark):
    docs, labels = labelled(spark, 60)
    odd = spark.createDataFrame([(None, "x"), (900, None), (901, ""), (902, "vile " * 5000), (902, "vile " * 5000)], "doc_id long, text string")
    assert toxicity.toxicity(odd.unionByName(docs), labels).count() == 65
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_mixing_meets_its_targets(spark):
    random.seed(2)
    rows = [(i, " ".join(random.choices(WORDS[:10] if i % 5 else WORDS[10:], k=random.randint(5, 60))), int(i % 5 > 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumns({"n_words": F.lit(1), "_rate": F.lit("x")})
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[::2]], "doc_id long, quality int")
    domain = F.concat(F.lit("q"), F.col("quality").cast("string"))
    got = mixing.mixed(docs, labels, domain, {"q0": 0.4, "q1": 0.6}).collect()
    assert len(got) == 600 and all(r.rate >= 0 for r in got)
    p = np.array([[float(x.split(":")[1]) for x in r.posteriors.split(",")] for r in got])
    n, rate, copies = (np.array([getattr(r, k) for r in got], float) for k in ("n_words", "rate", "copies"))
    for take, close in ((rate, 0.005), (copies, 0.04)):
        total = ((n * take)[:, None] * p).sum(0)
        assert total[0] / total.sum() == pytest.approx(0.4, abs=close)
    assert np.abs(copies - rate).max() < 1
    assert np.mean([r.domain == f"q{int(r.doc_id % 5 > 0)}" for r in got]) > 0.99
    out = mixing.remixed(docs, labels, domain, {"q0": 0.4, "q1": 0.6})
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == 600 and out.count() > 600


def test_rates_against_dense_least_squares(spark):
    """The same objective as a dense projected gradient, where targets can't all be met too."""
    rng = np.random.default_rng(4)
    n = rng.integers(1, 50, 40)
    p = rng.dirichlet([0.4, 0.4, 0.4], 40).round(6)
    df = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(40)], "id long, n_words long, p0 double, p1 double, p2 double")
    for weights in ([0.2, 0.5, 0.3], [0.0, 1.0, 0.0]):
        have = (n[:, None] * p).sum(0)
        budget = max(h / w for h, w in zip(have, weights) if w)
        target = budget * np.array(weights)
        scale = np.where(target > 0, target, have.sum())
        m = (n[:, None] * p / scale).T
        r = np.full(40, budget / have.sum())
        for _ in range(60_000):
            r = np.maximum(0, r - (m.T @ (m @ r - target / scale)) / np.linalg.eigvalsh(m @ m.T)[-1])
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            got = {x.id: x._rate for x in mixing.fitted_rates(df, 3, weights).collect()}
        mine = np.array([got[i] for i in range(40)])
        assert mine.min() >= 0
        loss = lambda r: float(((m @ r - target / scale) ** 2).sum())
        assert loss(mine) <= max(3 * mixing.CLOSE**2, loss(r) * 1.01 + 1e-6)


def test_targets_that_the_corpus_lacks_are_refused(spark):
    docs = spark.createDataFrame([(1, "ka lo"), (2, "mi nu")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, d string")
    with pytest.raises(ValueError):
        mixing.mixed(docs, labels, F.col("d"), {"a": 0.5, "c": 0.5})


def test_mixing_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "ka lo"), (4, "ka " * 9000), (4, "ka " * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1), (2, 0), (9, None)], "doc_id long, quality int")
    domain = F.concat(F.lit("q"), F.col("quality").cast("string"))
    assert mixing.mixed(docs, labels, domain).count() == 5 and mixing.mixed(docs.limit(0), labels, domain).count() == 0
    assert {r.rate for r in mixing.mixed(docs, labels.limit(0), domain).collect()} == {1.0}


def test_pipeline_stages(spark, tmp_path):
    random.seed(7)
    texts = [" ".join(random.choices(WORDS, k=60)) for _ in range(120)]
    texts = [t + " vile vile" if i % 6 == 0 else t for i, t in enumerate(texts)]
    texts += [texts[1], texts[2] + " ka", "note password=hunter2222 end " + " ".join(random.choices(WORDS, k=60))]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), int("vile" in t)) for i, t in enumerate(texts[:120])], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pieces":
            assert now.columns == docs.columns
    ids = {n: {r.doc_id for r in df.collect()} for n, df in seen.items()}
    clean = {i for i, t in enumerate(texts) if "vile" not in t}
    assert ids["toxicity"] == clean
    assert 120 not in ids["near_duplicates"] and clean - {120, 121} <= ids["near_duplicates"]
    assert ids["near_duplicates"] == ids["secrets"] == ids["mixing"] == ids["pieces"]
    assert "hunter" not in {r.doc_id: r.text for r in seen["secrets"].collect()}[122]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["pieces"].count()
