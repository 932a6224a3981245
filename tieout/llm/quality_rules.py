"""Quality verdicts for whole texts from base rules and a hashed n-gram likelihood ratio. Built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Hash buckets of words and word pairs; the two multinomials have this many outcomes at any input size.
BUCKETS = 1 << 14
#: Trusted documents that the target multinomial is fitted on at most (those with the smallest hashes of their ids).
TARGET_DOCS = 20_000
#: Least mean log-likelihood ratio of a kept document, in millionths of a nat for each n-gram.
THRESHOLD = -80_000
MICRO = 1_000_000
GRAM = 8


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def _features(hashes: Column) -> Column:
    """Buckets of the words and of the pairs of neighbours."""
    pairs = F.when(
        F.size(hashes) > 1,
        F.transform(F.sequence(F.lit(1), F.size(hashes) - 1), lambda i: F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i)).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")),
    ).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(hashes, lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), pairs)


def ratio_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_docs: int = TARGET_DOCS) -> list[int]:
    """The log of target over raw probability of each bucket, in millionths, add-one smoothed.

    Raw counts are over all of docs, target counts over at most target_docs of those in trusted(id).
    The ids of these are broadcast (8 bytes each); the counts come to the driver, one row a bucket.
    """
    ids = trusted.select(F.col(id_col).alias("_trusted")).where("_trusted is not null").distinct().orderBy(F.xxhash64("_trusted"), "_trusted").limit(target_docs)
    rows = docs.select(F.col(id_col).alias("_id"), F.transform(_words(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.xxhash64(w)).alias("_hashes"))
    rows = rows.join(F.broadcast(ids), F.col("_id") == F.col("_trusted"), "left").select(F.col("_trusted").isNotNull().cast("long").alias("target"), _features(F.col("_hashes")).alias("_f"))
    # explode() would have Spark infer a filter on the array's size and work the array out again for it, once for each element
    counts = rows.select("target", F.explode_outer("_f").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target"))
    found = counts.where("bucket is not null").collect()
    n_raw, n_target = sum(r["raw"] for r in found), sum(r["target"] for r in found)
    weights = [0] * BUCKETS
    if not n_target:
        return weights  # nothing to compare with: every document scores 0
    shift = math.log((n_raw + BUCKETS) / (n_target + BUCKETS))
    weights = [round(MICRO * shift)] * BUCKETS
    for r in found:
        weights[r["bucket"]] = round(MICRO * (math.log((r["target"] + 1) / (r["raw"] + 1)) + shift))
    return weights


def _n_repeat(grams: Column) -> Column:
    """Words in the windows that occur twice or more, from the hashes of all windows in order."""
    by_hash = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda j: ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == F.get(s, j)["h"])) | ((j < n - 1) & (F.get(s, F.least(j + 1, n - 1))["h"] == F.get(s, j)["h"])),
        )
        at = F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))
        zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach"))
        return F.aggregate(at, zero, lambda a, p: F.struct((a["total"] + p + GRAM - F.greatest(p, a["reach"])).alias("total"), (p + GRAM).alias("reach")), lambda a: a["total"])

    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.transform(F.array(by_hash), covered)[0]).otherwise(0)


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, target_docs: int = TARGET_DOCS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr_micro).

    One row for each row of docs; trusted(doc_id) names the target documents. llr_micro is the mean, over
    the words and word pairs of the text, of the log of the target's over the raw corpus's probability, in
    millionths of a nat; kept means that no base rule failed and llr_micro is at least threshold. Sums are
    of whole numbers, so verdicts don't depend on how the work was split. A null or empty text has no
    words and fails; texts of any length are judged whole; repeated rows and null ids each keep their row;
    other columns are ignored; an empty table gives an empty result, and without trusted documents every
    ratio is 0.
    """
    weights = ratio_weights(docs, trusted, id_col, text_col, target_docs)
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    df = docs.select(
        F.col(id_col).alias("id"), _words(text).alias("words"), lines.alias("lines"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols")
    )
    df = df.select(
        "id", "n_symbols", F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")
    )
    grams = F.when(F.size("hashes") >= GRAM, F.transform(F.sequence(F.lit(0), F.size("hashes") - GRAM), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(GRAM)]))).otherwise(F.array().cast("array<bigint>"))
    df = df.select("id", F.size("hashes").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", grams.alias("grams"), _features(F.col("hashes")).alias("features"))
    total = F.aggregate("features", F.lit(0).cast("long"), lambda a, f: a + F.get(table, f))
    df = df.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", _n_repeat(F.col("grams")).cast("long").alias("n_repeat_words"), F.when(F.size("features") > 0, F.floor(total / F.size("features"))).otherwise(0).cast("long").alias("llr_micro"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return df.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("llr_micro") >= threshold)).alias("kept"), "llr_micro")
