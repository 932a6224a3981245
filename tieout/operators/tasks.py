"""Tasks of a review as a state machine over their events, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What each action needs the status to be, and what it makes of it (None: leaves it).
ACTIONS = {
    "release": (("pending_manager_release",), "open"),
    "acknowledge": (("open",), "acknowledged"),
    "evidence_received": (("open", "acknowledged", "evidence_received", "verification_pending"), "evidence_received"),
    "request_verification": (("evidence_received",), "verification_pending"),
    "reply": (("open", "acknowledged", "evidence_received", "verification_pending"), None),
}
#: Actions of tasks that people raise alone.
MANUAL = {"resolve": (("open", "acknowledged", "evidence_received", "verification_pending"), "resolved"), "reopen": (("resolved",), "open")}
OUTCOMES = ("PASS", "MISSING_EVIDENCE", "NEEDS_REVIEW", "FAIL", "ERROR")
STATE = "task_id string, kind string, party string, status string, cycle int, n_events long, n_refused long, fingerprint string"
#: status, cycle, events, refused events, fingerprint of the last evaluation.
START = (None, 1, 0, 0, None)


def stepped(state: tuple, kind: str, party: str, action: str, fingerprint: str | None) -> tuple:
    """The state after an event: an action of people, or evaluated:OUTCOME, or withdrawn."""
    status, cycle, events, refused, last = state
    opened = "pending_manager_release" if party == "investor" else "open"
    if action == "created":
        return (opened if status is None else status, cycle, events + 1, refused, last)
    if action.startswith("evaluated:"):
        outcome = action.partition(":")[2]
        if outcome == "PASS":  # a requirement that passes at once has no task
            return ("resolved" if status else None, cycle, events + 1, refused, fingerprint)
        if status is None:
            return (opened, cycle, events + 1, refused, fingerprint)
        again = status in ("resolved", "withdrawn") or (party == "investor" and status != "pending_manager_release" and last is not None and last != fingerprint)
        return (opened if again else status, cycle + again, events + 1, refused, fingerprint)
    if action == "withdrawn":
        return ("withdrawn", cycle, events + 1, refused, last)
    needs, to = (MANUAL if kind == "manual" and action in MANUAL else ACTIONS).get(action, ((), None))
    if status not in needs:
        return (status, cycle, events, refused + 1, last)
    return (opened if action == "reopen" else to or status, cycle + (action == "reopen"), events + 1, refused, last)


def _folded(rows: Iterable[tuple], state: tuple = START) -> tuple:
    for kind, party, action, fingerprint in rows:
        state = stepped(state, kind, party, action, fingerprint)
    return state


def task_states(events: DataFrame) -> DataFrame:
    """STATE of each task after events(task_id, kind, party, seq, action, fingerprint), in the order of seq. A task's events go through one task, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for b in batches:
            out = []
            for task, kind, party, action, fingerprint in zip(*(b.column(i).to_pylist() for i in range(5))):
                if now is None or now[0] != task:
                    if now is not None:
                        out.append(now)
                    now = [task, kind, party, START]
                now[3] = stepped(now[3], now[1], now[2], action, fingerprint)
            yield _batch(out)
        if now is not None:
            yield _batch([now])

    return events.repartition("task_id").sortWithinPartitions("task_id", "seq").select("task_id", "kind", "party", "action", "fingerprint").mapInArrow(run, STATE)


def _batch(rows: list) -> pa.RecordBatch:
    flat = [(t, k, p, *s) for t, k, p, s in rows]
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(types)], names=[x.split()[0] for x in STATE.split(", ")])


def task_stream(events: DataFrame) -> DataFrame:
    """The same for a stream of events: the state of each task that a micro-batch touches, kept from one to the next."""
    import pandas as pd

    def update(key, batches, state):
        now, kind, party = START, None, None
        if state.exists:
            *now, kind, party = state.get
            now = tuple(now)
        for b in batches:
            for e in b.sort_values("seq").itertuples():
                kind, party = kind or e.kind, party or e.party
                now = stepped(now, kind, party, e.action, e.fingerprint)
        state.update((*now, kind, party))
        yield pd.DataFrame([(key[0], kind, party, *now)], columns=[x.split()[0] for x in STATE.split(", ")])

    held = "status string, cycle int, n_events long, n_refused long, fingerprint string, kind string, party string"
    return events.groupBy("task_id").applyInPandasWithState(update, STATE, held, "update", "NoTimeout")


def notices(events: DataFrame, members: DataFrame) -> DataFrame:
    """(task_id, cycle, event, recipient): who hears of events(task_id, cycle, event, owner, party, released, actor), each once.

    Investors hear of nothing before a manager released the request; until then managers do. Nobody hears of their own action.
    """
    managers = members.where("party = 'account_manager'").select(F.col("actor_id").alias("recipient"), F.lit(True).alias("_hidden"))
    hidden = (F.col("party") == "investor") & ~F.coalesce("released", F.lit(False))
    rows = events.withColumn("_hidden", hidden)
    own = rows.where("not _hidden and owner is not null").withColumn("recipient", F.col("owner"))
    theirs = rows.where("_hidden").join(F.broadcast(managers), "_hidden")
    both = own.select("task_id", "cycle", "event", "recipient", "actor").unionByName(theirs.select("task_id", "cycle", "event", "recipient", "actor"))
    return both.where(~F.col("recipient").eqNullSafe(F.col("actor"))).select("task_id", "cycle", "event", "recipient").distinct()


def work_metrics(events: DataFrame) -> DataFrame:
    """(event_type, n, first, last, seconds) of events(event_type, ts)."""
    g = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return g.withColumn("seconds", F.unix_timestamp("last") - F.unix_timestamp("first"))


def collection_summary(sources: DataFrame, datasets: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of counts: sources, datasets, their rows, accepted ones, and open issues."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    a = sources.agg(F.count(F.lit(1)).alias("n_sources"))
    b = datasets.agg(F.count(F.lit(1)).alias("n_datasets"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.count_if("accepted").alias("n_accepted"))
    c = issues.agg(F.count_if(~F.coalesce("resolved", F.lit(False))).alias("n_open"))
    return one(a).join(one(b), "_one").join(one(c), "_one").drop("_one")
