"""Readings of captured parser responses: an occurrence and an observation for each block, with what is wrong, held against a second reading.

A response is JSON text as it came. Types are checked as JSON has them: a number where a text must be is no text.
Nothing financial is taken out of prose here; a value's metric, entity and period come from a later mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import digest
from ..operators import pack

#: Most blocks of a response, most characters of a block and of a response.
MOST_BLOCKS, MOST_CHARS, MOST_RESPONSE = 10_000, 200_000, 20 << 20
NUMBERS = ("left", "top", "width", "height")


def _kind(v: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("VOID"))


def _text(v: Column, path: str) -> Column:
    """The text at path of a variant, or null if it is something else."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(_kind(found) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str, kind: str = "double") -> Column:
    found = F.try_variant_get(v, path, "variant")
    whole = ("BIGINT",) if kind == "int" else ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    return F.when(_kind(found).isin(*whole), F.try_variant_get(v, path, kind))


def responses(captured: DataFrame, version: str = "document_version_id", source: str = "source_sha256", body: str = "response", declared: str | None = None) -> DataFrame:
    """(document_version_id, source_sha256, response_sha256, response_id, code, blocks): each response, or why it is of no use.

    declared names a column with the SHA-256 that a response must have.
    """
    text = F.col(body).cast("string")
    df = captured.select(F.col(version).alias("document_version_id"), F.col(source).alias("source_sha256"), F.sha2(text, 256).alias("response_sha256"), (F.col(declared) if declared else F.sha2(text, 256)).alias("_said"), F.length(text).alias("_size"), F.try_parse_json(text).alias("_v"))
    df = df.withColumns({"response_id": _text(F.col("_v"), "$.job_id"), "_type": _text(F.col("_v"), "$.result.type"), "_chunks": F.try_variant_get("_v", "$.result.chunks", "array<variant>")})
    lists = F.transform("_chunks", lambda c: F.try_variant_get(c, "$.blocks", "array<variant>"))
    whole = F.col("_chunks").isNotNull() & F.forall(lists, lambda b: b.isNotNull())
    df = df.withColumn("blocks", F.when(whole, F.flatten(lists)))
    n = F.coalesce(F.size("blocks"), F.lit(0))
    known = F.coalesce(F.trim("response_id") != "", F.lit(False))
    code = (
        F.when(~F.coalesce(F.col("source_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "source_hash_missing").when(~F.coalesce(F.col("response_sha256") == F.col("_said"), F.lit(False)), "response_mismatch")
        .when(F.col("_size") > MOST_RESPONSE, "response_too_long").when(~known, "malformed_response").when(~F.col("_type").eqNullSafe(F.lit("full")), "result_elsewhere").when((n <= 0) | (n > MOST_BLOCKS), "malformed_response")
    )
    df = df.withColumn("code", code)
    return df.select("document_version_id", "source_sha256", "response_sha256", "response_id", "code", F.when(F.col("code").isNull(), F.col("blocks")).alias("blocks"))


def observations(of: DataFrame) -> DataFrame:
    """(document_version_id, response_sha256, response_id, block, occurrence_id, observation_id, raw_value, block_type, page, original_page, bbox, confidence, confidence_status, code) of responses.

    A block whose text or place is malformed has a code and no ids; the others keep theirs. An occurrence is a
    place in a document, the same for every parser that reads it; an observation is what one response says of it.
    """
    each = of.where("code is null").select("document_version_id", "source_sha256", "response_sha256", "response_id", F.posexplode("blocks").alias("block", "v"))
    v = F.col("v")
    each = each.withColumns({"raw_value": _text(v, "$.content"), "block_type": _text(v, "$.type"), "page": _number(v, "$.bbox.page", "int"), "original_page": _number(v, "$.bbox.original_page", "int"), **{f"_{n}": _number(v, f"$.bbox.{n}") for n in NUMBERS}})
    left, top, width, height = (F.col(f"_{n}") for n in NUMBERS)
    inside = (left >= 0) & (top >= 0) & (width > 0) & (height > 0) & (left + width <= 1) & (top + height <= 1) & (F.col("page") >= 1) & (F.col("original_page") >= 1)
    fine = F.coalesce(inside & (F.length("raw_value") <= MOST_CHARS), F.lit(False))
    score = F.coalesce(_number(v, "$.granular_confidence.parse_confidence"), _text(v, "$.granular_confidence.parse_confidence").try_cast("double"))
    sure = score.between(0, 1)
    each = each.withColumns({"code": F.when(~fine, "malformed_block"), "bbox": F.when(fine, F.array(left, top, left + width, top + height)), "confidence": F.when(sure, score), "confidence_status": F.when(F.coalesce(sure, F.lit(False)), "AVAILABLE").otherwise("UNAVAILABLE")})
    place = digest(F.col("document_version_id"), F.col("source_sha256"), F.col("original_page"), F.col("page"), F.transform("bbox", lambda x: F.round(x, 9).cast("string")), F.col("block"))
    each = each.withColumn("occurrence_id", F.when(fine, place))
    each = each.withColumn("observation_id", F.when(fine, digest(F.col("occurrence_id"), F.col("response_sha256"), F.col("block"))))
    return each.select("document_version_id", "response_sha256", "response_id", "block", "occurrence_id", "observation_id", "raw_value", "block_type", *[F.when(fine, F.col(c)).alias(c) for c in ("page", "original_page")], "bbox", "confidence", "confidence_status", "code")


def availability(of: DataFrame, seen: DataFrame) -> DataFrame:
    """(document_version_id, response_sha256, status, code, n_blocks, n_malformed): a response is AVAILABLE if it and all of its blocks are whole; what it has is kept in any case."""
    counts = seen.groupBy("document_version_id", "response_sha256").agg(F.count(F.lit(1)).alias("n_blocks"), F.count("code").alias("n_malformed"))
    met = of.select("document_version_id", "response_sha256", "code").join(counts, ["document_version_id", "response_sha256"], "left")
    met = met.withColumns({"n_blocks": F.coalesce("n_blocks", F.lit(0)), "n_malformed": F.coalesce("n_malformed", F.lit(0))})
    status = F.when(F.col("code").isNull() & (F.col("n_malformed") == 0), "AVAILABLE").otherwise("UNAVAILABLE")
    return met.select("document_version_id", "response_sha256", status.alias("status"), "code", "n_blocks", "n_malformed")


def second_pass(first: DataFrame, second: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((document_version_id, status), (document_version_id, occurrence_id, a, b, agreement)) of two readings.

    first and second(document_version_id, occurrence_id, reading) have a reading for each occurrence as
    pack.agreement compares them; asked(document_version_id, requested, answered) says whether a second reading
    was wanted and came. A reading that wasn't wanted is NOT_RUN, one that didn't come or is empty UNAVAILABLE:
    neither is ever agreement. Of several second readings of one occurrence none counts.
    """
    n = second.groupBy("document_version_id").agg(F.count(F.lit(1)).alias("_n"))
    came = F.coalesce("answered", F.lit(False)) & (F.coalesce("_n", F.lit(0)) > 0)
    status = F.when(~F.coalesce("requested", F.lit(False)), "NOT_RUN").when(~came, "UNAVAILABLE").otherwise("COMPLETED")
    runs = asked.join(n, "document_version_id", "left").select("document_version_id", status.alias("status"))
    done = runs.where("status = 'COMPLETED'").select("document_version_id")
    mine = first.join(done, "document_version_id", "left_semi")
    pairs = pack.paired_observations(mine, second.join(done, "document_version_id", "left_semi")).withColumn("availability", F.lit(None).cast("string"))
    of = mine.select("occurrence_id", "document_version_id").distinct()
    return runs, pack.agreement(pairs).join(of, "occurrence_id").select("document_version_id", "occurrence_id", "a", "b", "agreement")
