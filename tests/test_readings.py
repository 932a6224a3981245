"""Captured responses of every malformed kind, and second readings."""

import hashlib
import json

from tieout.sources import readings

SHA = hashlib.sha256(b"source").hexdigest()
PLACE = {"left": 0.1, "top": 0.2, "width": 0.3, "height": 0.4, "page": 1, "original_page": 3}


def block(content="text", box=None, **more):
    return {"type": "Text", "content": content, "bbox": PLACE if box is None else box, **more}


def response(*blocks, job="job1", kind="full"):
    return json.dumps({"job_id": job, "result": {"type": kind, "chunks": [{"blocks": [b]} for b in blocks]}})


def read(spark, bodies, sha=SHA):
    df = spark.createDataFrame([(f"v{i}", sha, b) for i, b in enumerate(bodies)], "document_version_id string, source_sha256 string, response string")
    of = readings.responses(df)
    seen = readings.observations(of)
    return {r.document_version_id: r for r in readings.availability(of, seen).collect()}, sorted(seen.collect(), key=lambda r: (r.document_version_id, r.block))


def test_malformed_responses(spark):
    bodies = [None, "", "[]", "{}", "not json", response(), response(block(), job=" "), response(block(), job=5), response(block(), kind="url"), json.dumps({"job_id": "j", "result": {"type": "full", "chunks": [{"blocks": 3}]}}), json.dumps({"job_id": "j", "result": {"type": "full", "chunks": None}})]
    got, seen = read(spark, bodies)
    assert {r.status for r in got.values()} == {"UNAVAILABLE"} and not seen
    assert {k: r.code for k, r in got.items()} == {f"v{i}": "result_elsewhere" if i == 8 else "response_mismatch" if i == 0 else "malformed_response" for i in range(len(bodies))}
    assert read(spark, [response(block())], sha="short")[0]["v0"].code == "source_hash_missing"
    assert read(spark, [])[0] == {}


def test_malformed_blocks_leave_the_others(spark):
    wrong = [block(content=5), block(content=None), block(box={}), block(box=PLACE | {"page": 0}), block(box=PLACE | {"left": "0.1"}), block(box=PLACE | {"width": 0.95}), block(box=PLACE | {"page": True}), block(box=5), "no block", block(content="x" * (readings.MOST_CHARS + 1))]
    got, seen = read(spark, [response(block("a"), *wrong, block("b", granular_confidence={"parse_confidence": 0.5})), response(block("a", granular_confidence={"parse_confidence": 1.5}))])
    assert (got["v0"].status, got["v0"].n_blocks, got["v0"].n_malformed) == ("UNAVAILABLE", 12, 10) and got["v1"].status == "AVAILABLE"
    assert [(r.raw_value, r.block) for r in seen if r.code is None] == [("a", 0), ("b", 11), ("a", 0)]
    assert all((r.occurrence_id is None) == (r.code is not None) for r in seen) and len({r.observation_id for r in seen if r.code is None}) == 3
    assert [r.confidence for r in seen if r.code is None] == [None, 0.5, None] and seen[0].original_page == 3


def test_occurrences_are_the_same_for_every_response(spark):
    one = read(spark, [response(block("a"))])[1][0]
    other = read(spark, [response(block("b"), job="job2")])[1][0]
    assert one.occurrence_id == other.occurrence_id and one.observation_id != other.observation_id
    assert read(spark, [response(block("a", box=PLACE | {"top": 0.21}))])[1][0].occurrence_id != one.occurrence_id


def test_absence_is_never_agreement(spark):
    reading = "struct<scope: string, metric: string, entity_id: string, period: string, currency: string, raw_scale: string, value_decimal: string>"
    schema = f"document_version_id string, occurrence_id string, reading {reading}"
    r = lambda v, period="2024": ("s", "fee", "E", period, "EUR", "units", v)
    first = spark.createDataFrame([("v1", "a", r("1.0")), ("v1", "b", r("2")), ("v1", "c", r("3")), ("v1", "d", r("4", None)), ("v2", "e", r("5")), ("v3", "f", r("6"))], schema)
    second = spark.createDataFrame([("v1", "a", r("1")), ("v1", "b", r("2.5")), ("v1", "c", r("3")), ("v1", "c", r("3")), ("v1", "d", r("4")), ("v3", "f", r("6"))], schema)
    asked = spark.createDataFrame([("v1", True, True), ("v2", True, True), ("v3", False, True), ("v4", True, False), ("v5", None, None)], "document_version_id string, requested boolean, answered boolean")
    runs, pairs = readings.second_pass(first, second, asked)
    assert {x.document_version_id: x.status for x in runs.collect()} == {"v1": "COMPLETED", "v2": "UNAVAILABLE", "v3": "NOT_RUN", "v4": "UNAVAILABLE", "v5": "NOT_RUN"}
    assert {x.occurrence_id: x.agreement for x in pairs.collect()} == {"a": "AGREE", "b": "DISAGREE", "c": "UNKNOWN", "d": "UNKNOWN"}
