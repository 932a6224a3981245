"""Fill-in-the-middle texts, made by DuckDB inside Arrow batches: no Python touches a single row."""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The units that a text is cut between, and the marks of its parts.
UNIT = "[A-Za-z]+|[^A-Za-z]"
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text that one statement takes (a longer text goes alone), and what DuckDB may hold for it.
STEP_BYTES, MEMORY = 4 << 20, "1GB"


def _sql(plain_from: int, spm_below: int, keep: bool) -> str:
    """The statement over batch(id, key, text): all of a text's numbers come from the SHA-256 of its id."""
    p, s, m = MARKS
    group = lambda i: f"CAST('0x' || substr(sha256('1:' || key), {8 * i + 1}, 8) AS UBIGINT)"
    kept = ", output" if keep else ""
    return f"""
WITH units AS (SELECT id, text, {group(0)} AS h1, {group(1)} AS h2, {group(2)} AS h3, {group(3)} AS h4,
  regexp_extract_all(text, '{UNIT}') AS u FROM (SELECT id, coalesce(key, '') AS key, coalesce(text, '') AS text FROM batch)),
cuts AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS b,
  CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR h3 % 100 >= {plain_from} THEN 'plain'
       WHEN h4 % 100 < {spm_below} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT id, text, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, a), '') END AS prefix,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, a + 1, b), '') END AS middle,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, b + 1, n), '') END AS suffix FROM cuts),
made AS (SELECT id, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END AS output FROM parts),
apart AS (SELECT *, CASE WHEN form <> 'plain' THEN string_split_regex(output, '{p}|{s}|{m}') END AS x FROM made),
back AS (SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN x[2] || x[4] || x[3] ELSE x[3] || x[4] || x[2] END AS restored FROM apart)
SELECT id, n, form, CAST(prefix_chars AS BIGINT) AS prefix_chars, CAST(middle_chars AS BIGINT) AS middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256{kept} FROM back"""


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of batch with about STEP_BYTES of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim: int = 90, spm: int = 20, keep: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 [, output]): one row for each row of docs, no shuffle.

    A text of n units (runs of A-Z and a-z, or one other code point) is cut at two places that the
    SHA-256 of its id names; about fim of 100 texts become prefix, suffix and middle with marks between,
    spm of 100 of them with the suffix first, the others stay plain. So do empty texts and those that
    have a mark in them, so that restored, the text rebuilt from output and form, is always the text.
    keep adds the output itself. A null text counts as empty and a null id as an empty name; a text of
    any length is handled whole, in a statement of its own where it is longer than STEP_BYTES; repeated
    rows each keep their row and, as they share an id, get the same cuts; other columns are ignored; an
    empty table gives an empty result.
    """
    statement = _sql(fim, spm, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as con:
            for whole in batches:
                for batch in _steps(whole):
                    con.register("batch", pa.Table.from_batches([batch]))
                    yield from con.sql(statement).to_arrow_table().to_batches()
                    con.unregister("batch")

    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * keep)
    return made.withColumnRenamed("id", id_col)
