"""What goes with results: manifests of sources, records of findings, reconciliation items, a brief for readers."""

from __future__ import annotations

import html
import json
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import formula_safe
from ..model import ROW, Table
from ..operators.lineage import lineage
from ..operators.snapshots import multiset_digest
from .exports import _written_csv


def canonical_json(value) -> bytes:
    """JSON that is the same for equal values: sorted keys, no spaces, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def digest(value) -> str:
    return sha256(canonical_json(value)).hexdigest()


def source_manifest(table: Table, keys: list[str] | None = None) -> DataFrame:
    """(row_id, column_key, sources, sha256): for each cell the source cells that it was made of, and a checksum of them."""
    refs = lineage(table, keys)
    ref = F.struct("source_table", "source_row", "source_column")
    cells = refs.groupBy("row_id", "column_key").agg(F.array_sort(F.collect_set(ref)).alias("sources"))
    return cells.withColumn("sha256", F.sha2(F.to_json("sources"), 256))


def fingerprint(df: DataFrame) -> str:
    """A checksum of a table's columns and rows, whatever the rows' order; repeated rows count."""
    rows = df.agg(multiset_digest(F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])))).first()[0]
    return digest({"columns": df.columns, "rows": rows})


def finding_records(findings: DataFrame, records: DataFrame, tables: list[Table], corrections: DataFrame | None = None) -> DataFrame:
    """A row for each affected source row of each finding: what was found, the cell's original and effective value, and who corrected it and why.

    corrections(row_id, column_key, value, seq, actor_id, reason), as they were applied to the tables.
    """
    cells = None
    for t in tables:
        own = records.where(F.col("dataset_id") == t.table_id).join(t.df.withColumnRenamed(ROW, "row_id"), "row_id")
        value = F.coalesce(*[F.when(F.col("column_key") == k, F.col(f"`{k}`")) for k in t.keys])
        part = own.select("match_key", "dataset_id", "row_id", "column_key", value.alias("effective"))
        cells = part if cells is None else cells.unionByName(part)
    if corrections is not None:
        last = corrections.groupBy("row_id", "column_key").agg(F.max_by(F.struct("value", "actor_id", "reason"), "seq").alias("c"), F.min_by("original", "seq").alias("original"))
        cells = cells.join(last, ["row_id", "column_key"], "left")
        # a later edit of another kind may have replaced the cell: only a correction that still holds is shown
        held = F.col("c").isNotNull() & F.col("c.value").eqNullSafe(F.col("effective"))
        cells = cells.select("match_key", "dataset_id", "row_id", "column_key", "effective", F.when(F.col("c").isNotNull(), F.col("original")).otherwise(F.col("effective")).alias("original"), F.when(held, F.col("c.actor_id")).alias("corrected_by"), F.when(held, F.col("c.reason")).alias("reason"))
    else:
        none = F.lit(None).cast("string")
        cells = cells.select("*", F.col("effective").alias("original"), none.alias("corrected_by"), none.alias("reason"))
    return findings.select("match_key", "check_id", "status", "code").join(cells, "match_key")


def plain_or_safe(c: Column) -> Column:
    """formula_safe, but for plain negative numbers."""
    return F.when(c.rlike(r"^-[0-9]+(?:\.[0-9]+)?$"), c).otherwise(formula_safe(c))


def export_rows(df: DataFrame, path: str) -> int:
    """The rows of a report as one CSV file on the driver, with structs and lists as JSON."""
    text = [F.to_json(F.col(c)) if df.schema[c].dataType.simpleString().startswith(("array", "struct", "map")) else F.col(c).cast("string") for c in df.columns]
    return _written_csv(path, df.columns, df.select(*[plain_or_safe(F.coalesce(t, F.lit(""))).alias(c) for t, c in zip(text, df.columns)]).orderBy(*df.columns))


def brief(title: str, sources: list[dict], checks: list[dict], findings: list[dict]) -> str:
    """An HTML page for readers. What it lists is bounded: evidence, not all records, stands beside findings."""
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"

    def block(name: str, rows: list[dict]) -> str:
        if not rows:
            return f"<h2>{html.escape(name)}</h2><p>none</p>"
        heads = "".join(f"<th>{html.escape(k)}</th>" for k in rows[0])
        body = "".join(f"<tr>{''.join(cell(r.get(k)) for k in rows[0])}</tr>" for r in rows)
        return f"<h2>{html.escape(name)}</h2><table><tr>{heads}</tr>{body}</table>"

    parts = "".join(block(n, r) for n, r in (("Sources", sources), ("Checks", checks), ("Findings", findings)))
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{parts}</body></html>'


def pack_manifest(snapshot: dict, artifact: bytes, approval: dict) -> dict:
    """What an approved file was made of. ValueError unless the approval names this snapshot and these bytes, and each fact has a source."""
    if approval.get("snapshot_digest") != digest(snapshot) or approval.get("artifact_sha256") != sha256(artifact).hexdigest():
        raise ValueError("the approval is for something else")
    sources = {s["source_id"]: s for s in snapshot["sources"] if s.get("content_hash") and s.get("locator")}
    used = {i for f in snapshot["facts"] for i in (f.get("source_id"), f.get("correction_source_id")) if i}
    if used - sources.keys() or any(not f.get("source_id") for f in snapshot["facts"]):
        raise ValueError("a fact has no source")
    return {"sources": [sources[i] for i in sorted(used)], "facts": snapshot["facts"], "checks": snapshot["checks"], "rules": snapshot.get("rules", {}), "snapshot_digest": digest(snapshot), "artifact_sha256": approval["artifact_sha256"], "approval": approval}


def verified(manifest: dict, artifact: bytes) -> bool:
    """Whether a manifest is whole and belongs to these bytes."""
    return manifest.get("artifact_sha256") == sha256(artifact).hexdigest() and all(manifest.get(k) for k in ("sources", "checks", "approval"))
