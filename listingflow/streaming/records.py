"""Streaming reconcile with keyed state: records, history, new-record events and run verdicts.

Two keyed operators on RocksDB state follow the daily aggregates of a stream:

* ``SourceRuns``, one key per source, holds the last accepted count and whether the baseline was used; it
  judges each closed run (zero rows, volume drop) and sends the verdict to every bucket of the source.
* ``Records``, one key per source and bucket of its records, holds the records.  One pass over a run gives all
  outputs of the same state: changed records, history rows and new-record events.

Nothing refolds earlier runs.  A run enters when the watermark has passed its day, so a run may come in any number
of batches; rows behind the watermark are late and left out.  A source's records lie in ``buckets`` keys, so
no task holds a hot source whole; a verdict is one row per run and bucket.  A task reads the records of one key at a time
and writes back those that changed, so the number of buckets is chosen for one of them to fit into a task.  A record keeps the number of accepted
listings at its last sighting, so its missing count is a difference and absent records are not rewritten.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed_values as V
from ..functions.keys import CONTENT_FIELDS
from ..operators.lifecycle import FIELDS, FLAGS, HISTORY_FIELDS

BUCKETS = 16
_TEXTS = ", ".join(f"{f} string" for f in FIELDS)
_FLAGS = ", ".join(f"{f} boolean" for f in FLAGS)
#: What is kept of a record; dates are ISO text, which sorts as the dates do.
RECORD = f"{_TEXTS}, {_FLAGS}, first_seen string, last_seen string, changed_at string, detail_verified_at string, status string, seen_accepted bigint, eligible boolean, queued boolean"
INPUT = f"source_id bigint, bucket int, run_date string, job_key bigint, {_TEXTS}, {_FLAGS}, accepted boolean, baseline boolean, n_accepted bigint"
CHANGES = "array<struct<field:string,before:string,after:string>>"
OUTPUT = f"part string, source_id bigint, job_key bigint, at string, kind string, title string, changes {CHANGES}, record struct<{RECORD.replace(' ', ':').replace(',:', ',')}>, accepted boolean, n_accepted bigint"
_names = lambda schema: [c.split()[0] for c in schema.split(", ")]
RECORD_NAMES, INPUT_NAMES = _names(RECORD), _names(INPUT)


VERDICT = ("source_id bigint, run_date string, n_jobs bigint, err_ratio double, capability string, accepted boolean, "
           "guarded boolean, baseline boolean, n_accepted bigint")


class SourceRuns(StatefulProcessor):
    """Verdict of every run of a source, in order: the volume rule as a fold over its runs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "last_count bigint, started boolean, n_accepted bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, started, n = self.held.get() if self.held.exists() else (0, False, 0)
        for run in sorted(rows, key=lambda r: r.run_date):
            unproved = run.n_jobs == 0 and not run.explicit_empty
            dropped = last >= V.DROP_MIN_COUNT and not run.explicit_empty and run.n_jobs < last * V.DROP_KEEP_RATIO
            accepted = bool(run.listing_complete and not unproved and not dropped)
            last, n = (run.n_jobs, n + 1) if accepted else (last, n)
            guarded = dropped or (unproved and run.capability not in V.SILENT_CAPABILITIES)
            yield Row(source_id=key[0], run_date=run.run_date, n_jobs=run.n_jobs, err_ratio=run.err_ratio, capability=run.capability,
                      accepted=accepted, guarded=bool(guarded), baseline=not started, n_accepted=n)
            started = started or run.n_jobs > 0 or bool(run.listing_complete and run.explicit_empty)
        self.held.update((last, started, n))

    def close(self) -> None:
        pass


def judged(runs: DataFrame) -> DataFrame:
    """Closed runs of a stream with their verdict.

    ``runs`` has one row per source and closed day: run_date, n_jobs, err_ratio, listing_complete, explicit_empty, capability.
    """
    rows = runs.select("source_id", F.col("run_date").cast("string").alias("run_date"), "n_jobs", "err_ratio",
                       "listing_complete", "explicit_empty", "capability")
    return rows.groupBy("source_id").transformWithState(SourceRuns(), outputStructType=VERDICT, outputMode="Append", timeMode="None")


def merged(old: dict | None, new: dict, day: str) -> dict:
    """A sighting over the stored record: what an incomplete read does not prove is kept."""
    sure = bool(new["detail_complete"]) or old is None
    strong = sure or (new["deadline_type"] is not None and new["deadline_type"] not in V.WEAK_DEADLINES)
    rule = {"department": new["department"], "posted_date": new["posted_date"], "listing_fingerprint": new["listing_fingerprint"]}
    out = {}
    for f in FIELDS:
        keep = strong if f.startswith("deadline") else sure or rule.get(f) not in (None, "")
        out[f] = new[f] if keep else old[f]
    out["detail_complete"] = bool(new["detail_complete"])
    for f in ("source_closed", "detail_refresh_failed"):
        out[f] = bool(new[f]) if new["detail_complete"] or new[f] else bool(old and old[f])
    out["detail_verified_at"] = day if new["detail_complete"] else old and old["detail_verified_at"]
    return out


def _due(record: dict, day: str) -> bool:
    return record["deadline_type"] == "closing" and record["deadline"] is not None and record["deadline"] < day


class Records(StatefulProcessor):
    """The records of one bucket of a source, run by run."""

    def __init__(self, matches: Callable[[dict], bool]):
        self.matches = matches

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", "job_key bigint", RECORD)
        # sightings whose verdict has not come yet; normally both come in one batch
        self.waiting = handle.getListState("waiting", INPUT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        verdicts, seen = {}, {}
        for r in [dict(zip(INPUT_NAMES, w)) for w in self.waiting.get()] + [r.asDict() for r in rows]:
            if r["job_key"] is None:
                verdicts[r["run_date"]] = r
            else:
                seen.setdefault(r["run_date"], []).append(r)
        held = {job: dict(zip(RECORD_NAMES, r)) for (job,), r in self.jobs.iterator()} if verdicts else {}
        dirty = {}
        for day in sorted(verdicts):
            yield from self._run(key, day, verdicts[day], seen.pop(day, []), held, dirty)
        for job, day in dirty.items():
            values = tuple(held[job][c] for c in RECORD_NAMES)
            self.jobs.updateValue((job,), values)
            yield self._out("state", key[0], day, job_key=job, record=values)
        rest = [tuple(r[c] for c in INPUT_NAMES) for later in seen.values() for r in later]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()

    def _run(self, key, day: str, verdict: dict, rows: list[dict], held: dict, dirty: dict) -> Iterator[Row]:
        source, bucket = key
        if bucket == 0:
            yield self._out("run", source, day, accepted=verdict["accepted"], n_accepted=verdict["n_accepted"])
        present = set()
        for new in sorted(rows, key=lambda r: r["job_key"]):
            job = new["job_key"]
            present.add(job)
            old = held.get(job)
            record = merged(old, new, day)
            record |= {"status": "closed" if record["source_closed"] or _due(record, day) else "open", "last_seen": day,
                       "first_seen": old["first_seen"] if old else day, "seen_accepted": verdict["n_accepted"],
                       "eligible": old["eligible"] if old else not verdict["baseline"], "queued": bool(old and old["queued"])}
            touched = old is None or old["status"] != record["status"] or any(old[f] != record[f] for f in CONTENT_FIELDS)
            record["changed_at"] = day if touched else old["changed_at"]
            if touched:
                kind = "updated" if old else "baseline" if verdict["baseline"] else "new"
                yield self._out("history", source, day, job_key=job, kind=kind, title=record["title"], changes=[
                    (f, old[f], record[f]) for f in HISTORY_FIELDS if old and old[f] != record[f]])
            if (not record["queued"] and record["eligible"] and record["detail_complete"] and record["status"] == "open"
                    and self.matches(record)):
                record["queued"] = True
                yield self._out("outbox", source, day, job_key=job, kind="new")
            held[job], dirty[job] = record, day
        if verdict["accepted"]:
            yield from self._sweep(source, day, verdict["n_accepted"], present, held, dirty)

    def _sweep(self, source: int, day: str, n_accepted: int, present: set, held: dict, dirty: dict) -> Iterator[Row]:
        """Records that a proven listing did not hold: closed once their date passed, else missing after three."""
        for job, record in held.items():
            if job in present or record["status"] == "closed":
                continue
            missed = n_accepted - record["seen_accepted"]
            status = "closed" if _due(record, day) else "missing" if missed >= V.MISSING_AFTER else record["status"]
            if status != record["status"]:
                yield self._out("history", source, day, job_key=job, kind="status", title=record["title"],
                                changes=[("status", record["status"], status)])
                held[job], dirty[job] = record | {"status": status, "changed_at": day}, day

    @staticmethod
    def _out(part: str, source: int, day: str, **rest) -> Row:
        row = dict.fromkeys(("part", "source_id", "job_key", "at", "kind", "title", "changes", "record", "accepted", "n_accepted"))
        return Row(**row | {"part": part, "source_id": source, "at": day} | rest)

    def close(self) -> None:
        pass


def reconcile_stream(observed: DataFrame, runs: DataFrame, matches: Callable[[dict], bool],
                     buckets: int = BUCKETS) -> DataFrame:
    """All outputs of closed runs as one tagged stream (column ``part``).

    ``observed`` has one row per source, record and closed day, ``runs`` is as in ``judged``; both come from the same
    watermarked stream.
    """
    here = {"bucket": F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))} | {c: F.col(c) for c in (
        "source_id", "run_date", "accepted", "baseline", "n_accepted")}
    kinds = dict(observed.dtypes)
    missing = {c: F.lit(None).cast("bigint" if c == "job_key" else kinds[c] if kinds[c] == "boolean" else "string") for c in INPUT_NAMES if c not in here}
    verdicts = judged(runs).select(*[(here | missing)[c].alias(c) for c in INPUT_NAMES])
    text = {"run_date", *FIELDS}
    given = {"bucket": F.pmod(F.xxhash64("job_key"), F.lit(buckets)).cast("int"), "accepted": F.lit(None).cast("boolean"),
             "baseline": F.lit(None).cast("boolean"), "n_accepted": F.lit(None).cast("bigint")}
    rows = observed.select(*[given[c].alias(c) if c in given else F.col(c).cast("string").alias(c) if c in text
                             else F.col(c).cast("bigint").alias(c) if c.endswith(("_id", "_key")) else F.col(c) for c in INPUT_NAMES])
    return rows.unionByName(verdicts).groupBy("source_id", "bucket").transformWithState(
        Records(matches), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def state_of(outputs: DataFrame) -> DataFrame:
    """Newest record of each key; the missing count is the source's accepted listings since it was last seen."""
    newest = outputs.where("part = 'state'").groupBy("source_id", "job_key").agg(F.max_by("record", "at").alias("r"))
    counts = outputs.where("part = 'run'").groupBy("source_id").agg(F.max("n_accepted").alias("n_accepted"))
    return newest.join(counts, "source_id").select(
        "source_id", "job_key", "r.*", (F.col("n_accepted") - F.col("r.seen_accepted")).alias("missing_count"))
