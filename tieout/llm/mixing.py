"""Document rates that bring the expected token shares of soft domains to target weights."""

from __future__ import annotations

import math
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, packed

#: Labelled rows that the classifier is fitted on at most (those with the smallest hashes of their ids).
TRAIN_ROWS = 20_000
#: Hash buckets of words in the classifier, and domains at most.
BUCKETS, DOMAINS = 1 << 13, 16
#: Words of the whole corpus that are added to each domain's own.
LEANING = 1000.0
#: Words' worth of evidence that a text gives at most: its mean log-likelihood counts that often.
EVIDENCE = 40.0
#: Relative error of every domain's total at which steps end, and steps in which the objective must fall by that share to go on.
CLOSE, STILL = 1e-3, 40
#: Steps that a fit may take before it is an error.
STEPS = 1000
#: Steps between checkpoints of the rates.
LINEAGE = 10


class Buckets(dict):
    """Token -> bucket of its lower-cased word."""

    def __missing__(self, token: bytes) -> int:
        b = zlib.crc32(token.lower()) % BUCKETS
        if len(self) > 500_000:
            self.clear()
        if len(token) <= 48:
            self[token] = b
        return b


def train_domains(docs: DataFrame, labels: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, log priors, log probabilities of the buckets in each domain) of a multinomial classifier.

    domain is a text column of labels(id); null domains teach nothing. At most train_rows labelled rows
    are learnt from (their ids and domains are broadcast); the counts, one row for each domain and bucket,
    come to the driver. More than DOMAINS domains are an error.
    """
    asked = labels.select(F.col(id_col).alias("_id"), domain.cast("string").alias("_d")).where("_id is not null and _d is not null").groupBy("_id").agg(F.min("_d").alias("_d"))
    sample = F.broadcast(asked.orderBy(F.xxhash64("_id"), "_id").limit(train_rows))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(sample, "_id").select("_text", "_d")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, sums = Buckets(), {}
        for b in batches:
            for text, d in zip(b.column(0), b.column(1).to_pylist()):
                if d not in sums:
                    if len(sums) >= 4 * DOMAINS:
                        raise ValueError(f"more than {DOMAINS} domains")
                    sums[d] = np.zeros(BUCKETS + 1, np.int64)
                at = [bucket[w] for w in text.as_py().encode().split()]
                sums[d][:BUCKETS] += np.bincount(at, minlength=BUCKETS) if at else 0
                sums[d][BUCKETS] += 1  # the documents
        for d, s in sums.items():
            at = np.nonzero(s)[0]
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], names=["d", "b", "n"])

    counts = rows.mapInArrow(count, "d string, b int, n long").groupBy("d", "b").agg(F.sum("n").alias("n"))
    got = counts.collect()
    names: dict[str, np.ndarray] = {}
    for r in got:
        if r["d"] not in names and len(names) >= DOMAINS:
            raise ValueError(f"more than {DOMAINS} domains")
        names.setdefault(r["d"], np.zeros(BUCKETS + 1))[r["b"]] = r["n"]
    order = sorted(names)
    if not order:
        return ["all"], np.zeros(1), np.full((1, BUCKETS), -math.log(BUCKETS))
    table = np.array([names[d] for d in order])
    priors = np.log(table[:, BUCKETS] / table[:, BUCKETS].sum())
    counts = table[:, :BUCKETS]
    shared = (counts.sum(0) + 1) / (counts.sum() + BUCKETS)  # a rare domain leans on what all domains have
    words = np.log((counts + LEANING * shared) / (counts.sum(1, keepdims=True) + LEANING))
    return order, priors, words


def domain_posteriors(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, p0, p1, ...) of each row: its words and the posteriors of its domains, to 6 digits."""
    names, priors, words = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Buckets()
        for b in batches:
            n, p = [], []
            for text in b.column(1):
                at = np.fromiter(map(bucket.__getitem__, (text.as_py() or "").encode().split()), np.int64)
                z = priors + (words[:, at].sum(1) * (EVIDENCE / max(EVIDENCE, len(at))) if len(at) else 0)
                e = np.exp(z - z.max())
                n.append(len(at))
                p.append(np.round(e / e.sum(), 6))
            table = np.array(p).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(table[:, k]) for k in range(len(names)))], names=["id", "n_words", *(f"p{k}" for k in range(len(names)))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, " + ", ".join(f"p{k} double" for k in range(len(names))))


def fitted_rates(posteriors: DataFrame, k: int, weights: list[float], steps: int = STEPS) -> DataFrame:
    """posteriors with _rate: nonnegative rates whose expected totals of words in the k domains are as weights.

    Projected gradient, one pass over the documents a step: the squared relative errors of the totals are
    made small, each document's rate going against the gradient (in the metric of its words) and back to 0
    where it would be less. Rates start equal, at the least total of words that lowers no domain below what
    the corpus has of it. A pass returns the k totals alone, whatever the number of documents. Steps end
    where the targets are met, or where no rates come nearer to them (which is said in a warning, as
    is a target for a domain that the corpus has no words of). A fit that does not end is an error.
    """
    ps = [F.col(f"p{i}") for i in range(k)]
    n = F.col("n_words").cast("double")
    gram = [F.coalesce(F.sum(n * ps[i] * ps[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    first = posteriors.agg(*[F.coalesce(F.sum(n * p), F.lit(0.0)).alias(f"t{i}") for i, p in enumerate(ps)], *gram).first()
    have = np.array([first[f"t{i}"] for i in range(k)])
    w = np.array(weights, float)
    if not have.sum() or not w.sum():
        return posteriors.withColumn("_rate", F.lit(1.0))
    if ((w > 0) & (have <= 0)).any():
        warnings.warn(f"targets left out, as no document has words of domains {np.nonzero((w > 0) & (have <= 0))[0].tolist()}", stacklevel=2)
        w = np.where(have > 0, w, 0.0)
        if not w.sum():
            return posteriors.withColumn("_rate", F.lit(1.0))
    w = w / w.sum()
    asked = w > 0
    budget = (have[asked] / w[asked]).max()
    target = budget * w
    scale = np.where(target > 0, target, have.sum())  # of a domain that shall have nothing: the corpus
    gram = np.array([[first[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    # the step: one over the largest eigenvalue of the scaled Gram matrix (the gradient's Lipschitz constant)
    step = 1 / np.linalg.eigvalsh(gram / np.sqrt(np.outer(scale, scale)))[-1]
    rows = posteriors.withColumn("_rate", F.lit(float(budget / have.sum()))).withColumn("_before", F.col("_rate"))
    speed, losses = 1.0, []
    for s in range(1, steps + 1):
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        ahead = F.col("_rate") + (speed - 1) / faster * (F.col("_rate") - F.col("_before"))
        at = rows.withColumn("_ahead", ahead)
        got = at.agg(*[F.sum(n * F.col("_ahead") * p).alias(f"a{i}") for i, p in enumerate(ps)], *[F.sum(n * F.col("_rate") * p).alias(f"r{i}") for i, p in enumerate(ps)]).first()
        error = [abs(got[f"r{i}"] - target[i]) / scale[i] for i in range(k)]
        if max(error) < CLOSE:
            break
        losses.append(sum(e * e for e in error))
        if s > STILL and min(losses[-STILL:]) > (1 - CLOSE) * min(losses[:-STILL]):
            warnings.warn(f"no rates meet the targets: totals are off by {[round(e, 4) for e in error]} of them", stacklevel=2)
            break
        start, totals = "_ahead", "a"
        if s > 1 and losses[-1] > losses[-2]:  # the momentum went too far: begin anew from here
            start, totals, faster = "_rate", "r", 1.0
        g = [float(f"{step * (got[f'{totals}{i}'] - target[i]) / scale[i]:.9g}") for i in range(k)]
        down = sum((p * x for p, x in zip(ps, g)), F.lit(0.0))
        rows = at.select(*posteriors.columns, F.greatest(F.lit(0.0), F.col(start) - down).alias("_new"), F.col("_rate").alias("_before")).withColumnRenamed("_new", "_rate")
        speed = faster
        if s % LINEAGE == 0:
            rows = checkpointed(rows)
    else:
        raise RuntimeError(f"no rates after {steps} steps")
    return rows.drop("_before")


def mixed(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, keep_all: bool = False) -> DataFrame:
    """(doc_id, n_words, domain, posteriors, rate, copies): one row for each row of docs.

    domain, a text column of labels(id), names the domains; weights give their target shares of tokens, which
    are words between white space here (by default as the square roots of the shares that the corpus has, which favours the rare). posteriors lists
    name:probability; domain is the likeliest; rate is how often the document shall be taken; copies rounds
    it up or down by a hash of the id, so that the copies of many documents come to their rates. keep_all
    takes each document once at least. A null or empty text has no words and rate and posteriors like the
    priors; texts of any length are read whole; repeated rows each keep their row; a null id is rounded
    like any other value; other columns are ignored; an empty table gives an empty result; without labels
    there is one domain, and all rates are 1. A target for a domain that no label names is an error.
    """
    model = train_domains(docs, labels, domain, id_col, text_col, train_rows)
    names = model[0]
    k = len(names)
    posteriors = checkpointed(domain_posteriors(docs, model, id_col, text_col))
    if weights is None:
        total = posteriors.agg(*[F.coalesce(F.sum(F.col("n_words") * F.col(f"p{i}")), F.lit(0.0)).alias(f"t{i}") for i in range(k)]).first()
        weights = {d: math.sqrt(total[f"t{i}"]) for i, d in enumerate(names)}
    if len(names) > 1 and (unknown := [d for d, w in weights.items() if w > 0 and d not in names]):
        raise ValueError(f"no label teaches the domains {unknown}")
    rates = fitted_rates(posteriors, k, [weights.get(d, 0.0) for d in names])
    chance = F.pmod(F.xxhash64(F.col("id"), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.round("_rate", 6)
    copies = (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    listed = F.array(*[F.struct(F.col(f"p{i}").alias("p"), F.lit(d).alias("d")) for i, d in enumerate(names)])
    best = F.array_max(F.transform(listed, lambda x, i: F.struct(x["p"].alias("p"), (-i).alias("i"), x["d"].alias("d"))))["d"]
    text = F.array_join(F.transform(listed, lambda x: F.concat(x["d"], F.lit(":"), F.format_number(x["p"], 6))), ",")
    return rates.select(F.col("id").alias(id_col), "n_words", best.alias("domain"), text.alias("posteriors"), rate.alias("rate"), (F.greatest(copies, F.lit(1)) if keep_all else copies).alias("copies"))


def quality_domain() -> Column:
    """The domains of the labelled table: its quality and toxic marks."""
    return F.concat(F.lit("quality"), F.col("quality").cast("string"), F.lit("_toxic"), F.col("toxic").cast("string"))


def remixed(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row as often as its rate asks, once at least; docs' columns."""
    copies = mixed(docs, labels, domain, weights, id_col, text_col, keep_all=True).groupBy(F.col(id_col).alias("_id")).agg(F.max("copies").alias("_copies"))
    rows = packed(docs, id_col).join(copies.withColumnRenamed("_id", "_other"), F.col("_id").eqNullSafe(F.col("_other")), "left")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.coalesce("_copies", F.lit(1)))).alias("_copy")).select("_row.*")
