"""A toxicity classifier that identity terms alone don't sway, and its scores for whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, packed

#: Labelled rows that the classifier is fitted on at most (those with the smallest hashes of their ids).
TRAIN_ROWS = 20_000
#: Features that are kept at most; least rows with a feature, and its least z score against the labels.
FEATURES, LEAST_ROWS, LEAST_Z = 4096, 6, 4.0
#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6)
#: Longest word that is a feature as a whole; of a longer one, and of one in a script without spaces, all neighbouring letters are.
LONGEST = 40
#: Weight of the mean squared change of the log-odds under swaps, and of the squared feature weights.
SWAP_PENALTY, RIDGE = 4.0, 2e-5
STEPS = 600

#: Identity terms, in groups whose members may stand for each other.
IDENTITIES = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes"),
)
#: The groups of each term: words of several languages are in several.
GROUPS_OF = {w: tuple(g for g in IDENTITIES if w in g) for group in IDENTITIES for w in group}
EDGE = re.compile(r"^\W+|\W+$")
#: Letters of scripts that are written without spaces: Thai to Khmer, kana, Han.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def word_features(token: str) -> tuple[str, ...]:
    """The word that a token holds, and its beginnings; neighbouring letters where there are no words or none that is short."""
    w = EDGE.sub("", token.lower())
    if not w:
        return ()
    stems = tuple(w[:n] + "*" for n in STEMS if len(w) >= n)
    if len(w) <= LONGEST and not UNSPACED.search(w):
        return (w, *stems)
    return (*stems, *dict.fromkeys("~" + w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)))


def text_features(text: str) -> set[str]:
    found: set[str] = set()
    for token in set(text.split()):
        found.update(word_features(token))
    return found


def swapped(text: str) -> list[set[str]]:
    """Features of the text with each of its identity terms replaced: by the next term of a group of it, and by the one after.

    Terms of several groups are swapped within one group at a time, the others then within their only one.
    """
    tokens = set(text.split())
    terms = {t: w for t in tokens if (w := EDGE.sub("", t.lower())) in GROUPS_OF}
    if not terms:
        return []
    rest: set[str] = set()
    for t in tokens - terms.keys():
        rest.update(word_features(t))
    out = []
    for which in range(max(len(GROUPS_OF[w]) for w in terms.values())):
        for step in (1, 2):
            f = set(rest)
            for w in terms.values():
                g = GROUPS_OF[w][min(which, len(GROUPS_OF[w]) - 1)]
                f.update(word_features(g[(g.index(w) + step) % len(g)]))
            out.append(f)
    return out


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, found: set[str]) -> float:
        z = self.bias + sum(self.weights[self.features[f]] for f in found if f in self.features)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _design(rows: list[list[int]], n: int):
    """(row, column) of the ones of a sparse 0/1 matrix."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return at, np.array([j for r in rows for j in r], np.int64), n


def fit(features: dict[str, int], rows: list[list[int]], labels: list[int], swaps: list[tuple[list[int], list[int]]], swap_penalty: float = SWAP_PENALTY) -> Model:
    """Logistic regression on 0/1 features by gradient steps with momentum.

    The loss is the mean log loss, plus the ridge, plus swap_penalty times the mean squared difference of
    the log-odds of a sentence and of itself with other identity terms.
    """
    k, n = len(features), len(rows)
    y = np.array(labels, float)
    share = (y.sum() + 1) / (n + 2)
    w, b = np.zeros(k), float(np.log(share / (1 - share)))
    at, col, _ = _design(rows, k)
    pairs = max(len(swaps), 1)
    p_at, p_col, _ = _design([p for p, _ in swaps], k)
    q_at, q_col, _ = _design([q for _, q in swaps], k)
    vw, vb, rate = np.zeros(k), 0.0, 2.0
    support = np.bincount(col, minlength=k) / max(n, 1) + 1e-3 if k else np.zeros(0)
    if k and swaps:  # steps stay stable for features that swaps touch
        support = support + swap_penalty * (np.bincount(p_col, minlength=k) + np.bincount(q_col, minlength=k)) / pairs
    for _ in range(STEPS if n and k else 0):
        z = b + np.bincount(at, w[col], minlength=n)
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        g = np.bincount(col, e[at], minlength=k) + RIDGE * w
        if swaps:
            d = np.bincount(p_at, w[p_col], minlength=len(swaps)) - np.bincount(q_at, w[q_col], minlength=len(swaps))
            d *= 2 * swap_penalty / pairs
            g += np.bincount(p_col, d[p_at], minlength=k) - np.bincount(q_col, d[q_at], minlength=k)
        vw, vb = 0.9 * vw - 0.1 * rate * g / np.sqrt(support), 0.9 * vb - 0.1 * rate * e.sum()
        w, b = w + vw, b + vb
    return Model(features, w, b)


def train(docs: DataFrame, labels: DataFrame, label: Column, may_learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, swap_penalty: float = SWAP_PENALTY) -> Model:
    """The model for label, a 0/1 column of labels(id).

    It learns from at most train_rows rows of labels, of those with may_learn where it is given. Their ids
    and labels (16 bytes a row) are broadcast; which features tell the labels apart is counted by Spark;
    at most FEATURES features, and the sample's rows as lists of them, come to the driver. An id that
    labels has twice counts with its largest label.
    """
    asked = labels.where(may_learn) if may_learn is not None else labels
    asked = asked.select(F.col(id_col).alias("_id"), label.cast("int").alias("_y")).where("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    sample = F.broadcast(asked.orderBy(F.xxhash64("_id"), F.col("_id")).limit(train_rows))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(sample, "_id")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist()):
                found = sorted(text_features(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], names=["f", "y"])

    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not n:
        return Model({}, np.zeros(0), 0.0)
    share = (n1 + 0.5) / (n + 1)
    counted = rows.select("_text", "_y").mapInArrow(spread, "f string, y int").groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
    z = F.abs(F.col("n1") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = counted.where(F.col("n") >= LEAST_ROWS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(FEATURES)
    features = {r["f"]: i for i, r in enumerate(best.select("f").collect())}

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, kinds, ys = [], [], []
            for text, y in zip(b.column(0), b.column(1).to_pylist()):
                t = text.as_py()
                index = lambda fs: sorted(features[f] for f in fs if f in features)
                one = index(text_features(t))
                own.append(one)
                kinds.append([index(s) for s in swapped(t)])
                ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.list_(pa.int32()))), pa.array(ys, pa.int32())], names=["own", "swaps", "y"])

    got = sorted((tuple(r["own"]), tuple(map(tuple, r["swaps"])), r["y"]) for r in rows.select("_text", "_y").mapInArrow(listed, "own array<int>, swaps array<array<int>>, y int").collect())
    pairs = [(list(o), list(s)) for o, ss, _ in got for s in ss]
    return fit(features, [list(o) for o, _, _ in got], [y for _, _, y in got], pairs, swap_penalty)


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _row, _score) of each row of docs: the row as a struct, and the score (0 to 1) of its text.

    The text alone is scored, whole, whatever its length; null and empty texts get the score of a text
    without features.
    """
    weight = {f: float(model.weights[i]) for f, i in model.features.items()}
    bias = float(model.bias)

    class Hits(dict):
        """Token -> its features that have a weight."""

        def __missing__(self, token: str) -> tuple[str, ...]:
            hits = tuple(f for f in word_features(token) if f in weight)
            if len(self) > 500_000:
                self.clear()
            if len(token) <= 48:
                self[token] = hits
            return hits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits()
        for b in batches:
            scores = []
            for text in b.column(b.num_columns - 1):
                found = {f for h in map(hits.__getitem__, set((text.as_py() or "").split())) if h for f in h}
                z = bias + sum(weight[f] for f in sorted(found))
                scores.append(1 / (1 + np.exp(-min(40.0, max(-40.0, z)))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "_score"])

    rows = packed(docs, id_col).select("_id", "_row", F.col(f"_row.`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _row {rows.schema['_row'].dataType.simpleString()}, _score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of docs.

    The model learns labels.toxic from rows whose crc32(doc_id as text) mod 5 is not 0 (held_out: it is).
    predicted is 1 from a score of 0.5 on. Null and empty texts score like texts without features, null
    ids are not held out, repeated rows each keep their row, other columns are ignored, texts of any
    length are scored whole, an empty table gives an empty result; without labels every score is 0.5.
    """
    out = F.coalesce(held_out(F.col(id_col), 5, 0), F.lit(False))
    model = train(docs, labels, F.col("toxic"), ~out, id_col, text_col, train_rows)
    scored = toxicity_scores(docs.select(id_col, text_col), model, id_col, text_col).withColumnRenamed("_id", id_col)
    return scored.select(id_col, out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, with docs' columns."""
    out = F.coalesce(held_out(F.col(id_col), 5, 0), F.lit(False))
    model = train(docs, labels, F.col("toxic"), ~out, id_col, text_col)
    return toxicity_scores(docs, model, id_col, text_col).where("_score < 0.5").select("_row.*")
