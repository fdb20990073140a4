"""Incremental ingestion: gates, change detection, upserts and confirmed removals in micro-batches; event-time windows."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlight.functions import scalar as S
from ledgerlight.sources.buckets import BucketTable


def signature() -> Column:
    """Of a slice's count and total, to the hundredth."""
    return F.sha1(F.concat_ws("|", F.col("n").cast("string"), F.round("total", 2).cast("string")).cast("binary"))


def changed_slices(probe: DataFrame, last: DataFrame, key: str = "slice") -> DataFrame:
    """Slices whose count or total differs from the signature of the last read, or was never read."""
    now = probe.withColumn("signature", signature())
    return now.join(last.select(key, F.col("signature").alias("_last")), key, "left").where("_last is null or _last <> signature").drop("_last")


def signatures(probe: DataFrame, key: str = "slice") -> DataFrame:
    return probe.select(key, signature().alias("signature"))


def changed_below(probes: list[DataFrame], last: list[DataFrame], key: str = "slice", parent: str = "parent") -> DataFrame:
    """Changed slices of the lowest of several levels. A level is compared only below what changed in the level above, so where nothing moved nothing
    further is asked; the first level has no parent."""
    moved = changed_slices(probes[0], last[0], key)
    for probe, before in zip(probes[1:], last[1:], strict=True):
        below = probe.join(moved.select(F.col(key).alias(parent)).distinct(), parent, "left_semi")
        moved = changed_slices(below, before, key)
    return moved


def touched(works: DataFrame, changed: DataFrame, *groups: tuple[str, ...]) -> DataFrame:
    """Works whose findings may change when some works do: those, and all that share one of the peer groups with them."""
    hit = works.join(changed.select("work_id").distinct(), "work_id", "left_semi").withColumn("_own", F.lit(True))
    ids = hit.select("work_id")
    for g in groups:
        on = [works[c].eqNullSafe(F.col(f"_{c}")) for c in g]
        ids = ids.union(works.join(hit.select(*[F.col(c).alias(f"_{c}") for c in g]).distinct(), on, "left_semi").select("work_id"))
    return works.join(ids.distinct(), "work_id", "left_semi")


def recomputed(findings: DataFrame, again: DataFrame, scope: DataFrame) -> DataFrame:
    """Findings after a change: those of the works in scope come from ``again``, all others stay."""
    return findings.join(scope.select(F.col("work_id").alias("entity_id")).distinct(), "entity_id", "left_anti").unionByName(again)


def due(changed_at: str | None, analysed_at: str | None, now: str, minutes: int = 180) -> bool:
    """Whether to recompute: something changed since the last analysis, which was long enough ago."""
    at = lambda t: dt.datetime.fromisoformat(t)
    return changed_at is not None and (analysed_at is None or (at(changed_at) > at(analysed_at) and at(now) - at(analysed_at) >= dt.timedelta(minutes=minutes)))


def payloads(rows: DataFrame, key: str = "slice", without: tuple[str, ...] = ("Sno",)) -> DataFrame:
    """SHA-256 of each slice's rows in any order, serial numbers left out."""
    cols = [c for c in rows.columns if c not in (key, *without)]
    return rows.groupBy(key).agg(S.payload_hash(F.struct(*cols)).alias("payload"), F.count(F.lit(1)).alias("n"))


def unchanged(rows: DataFrame, seen: DataFrame, key: str = "slice") -> DataFrame:
    """Slices whose payload is the one seen last: nothing to do."""
    return payloads(rows, key).join(seen.select(key, "payload"), [key, "payload"], "left_semi")


def gated(slices: DataFrame, before: DataFrame, required: DataFrame | None = None, tolerance: int = 1, key: str = "slice") -> DataFrame:
    """Verdict of each slice (rows, stated, missing_fields): ok or the first gate that it fails."""
    rows = slices.join(before.select(key, F.col("rows").alias("rows_before")), key, "left")
    verdict = (
        F.when(F.col("missing_fields") > 0, "contract").when((F.col("rows") == 0) & (F.coalesce("rows_before", F.lit(0)) > 0), "emptied").when(F.col("rows") * 10 < F.coalesce("rows_before", F.lit(0)), "collapsed")
        .when(F.abs(F.col("rows") - F.col("stated")) > tolerance, "count").otherwise("ok")
    )
    return rows.withColumn("verdict", verdict)


def lifecycle(state: DataFrame, verdicts: DataFrame, escalate: int = 3, key: str = "slice") -> DataFrame:
    """Failure counters and states after a read: live, retry, quarantined."""
    rows = state.join(verdicts.select(key, "verdict"), key, "full")
    failures = F.when(F.col("verdict") == "ok", 0).when(F.col("verdict").isNotNull(), F.coalesce("failures", F.lit(0)) + 1).otherwise(F.coalesce("failures", F.lit(0)))
    return rows.select(key, failures.alias("failures"), F.when(failures == 0, "live").when(failures >= escalate, "quarantined").otherwise("retry").alias("lifecycle"))


def removals(listed: DataFrame, known: DataFrame, waiting: DataFrame, now: str, consistent: bool = True, after_minutes: int = 10, key: str = "work_id") -> DataFrame:
    """(key, state, first_missing_at): absent works wait, and retire when a consistent read at least ten minutes later lacks them too; those that come back are restored."""
    at = F.lit(now).cast("timestamp")
    absent = known.select(key).distinct().join(listed.select(key).distinct(), key, "left_anti").join(waiting.select(key, "first_missing_at"), key, "left")
    confirmed = F.lit(consistent) & (F.col("first_missing_at") <= at - F.expr(f"interval {after_minutes} minutes"))
    gone = absent.select(key, F.when(confirmed, "retired").otherwise("missing").alias("state"), F.coalesce("first_missing_at", at).alias("first_missing_at"))
    back = waiting.select(key, "first_missing_at").join(listed.select(key).distinct(), key, "left_semi").select(key, F.lit("restored").alias("state"), "first_missing_at")
    return gone.unionByName(back)


def watched(listings: DataFrame, after_minutes: int = 10) -> DataFrame:
    """The same on a stream, with state for each work: listings (work_id, read_at, listed, consistent) to (work_id, state, at), a row each time a work's state changes.

    A work that a read doesn't list waits; a consistent read at least ``after_minutes`` later that lacks it too retires it; one that lists it restores it."""

    def step(key, frames, state: GroupState):
        now, since = state.get if state.exists else ("listed", 0.0)
        out = []
        rows = pd.concat(list(frames)).sort_values("read_at")
        for at, listed, consistent in zip(rows["read_at"], rows["listed"], rows["consistent"]):
            new = now
            if listed:
                new = "listed"
            elif now == "listed":
                new, since = "missing", at.timestamp()
            elif now == "missing" and consistent and at.timestamp() - since >= 60 * after_minutes:
                new = "retired"
            if new != now:
                out.append((key[0], "restored" if new == "listed" else new, at))
            now = new
        state.update((now, since))
        yield pd.DataFrame(out, columns=["work_id", "state", "at"]).astype({"at": "datetime64[us]"})

    kind = listings.schema["work_id"].dataType.simpleString()
    return listings.groupBy("work_id").applyInPandasWithState(step, f"work_id {kind}, state string, at timestamp", "now string, since double", "append", GroupStateTimeout.NoTimeout)


def queued(state: DataFrame, now: str, first_minutes: int = 5, escalate: int = 3, key: str = "slice") -> DataFrame:
    """(slice, due_at, escalated): slices to read again, each failure doubling the wait; those that failed ``escalate`` times go to a person and stay in the queue."""
    wait = F.lit(first_minutes * 60) * F.pow(F.lit(2), F.least("failures", F.lit(10)) - 1).cast("bigint")
    return state.where("failures > 0").select(key, F.timestamp_seconds(F.lit(now).cast("timestamp").cast("bigint") + wait).alias("due_at"), (F.col("failures") >= escalate).alias("escalated"))


def parity(stored: DataFrame, portal: DataFrame, key: str, tolerance: float = 1.0) -> DataFrame:
    """Stored figures against the portal's: exact within a rupee and to the row."""
    ours = stored.groupBy(key).agg(F.count(F.lit(1)).alias("our_n"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("our_total"))
    rows = portal.join(ours, key, "full").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "our_n")], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total", "our_total")])
    return rows.withColumn("exact", (F.col("n") == F.col("our_n")) & (F.abs(F.col("total") - F.col("our_total")) <= tolerance))


def oldest_first(state: DataFrame, limit: int | None = None) -> DataFrame:
    rows = state.orderBy(F.asc_nulls_first("last_read"), "slice")
    return rows.limit(limit) if limit else rows


def start_upserts(spark: SparkSession, stream: DataFrame, table: str, checkpoint: str, key: str = "work_id", trigger: str | None = None, buckets: int = 64, keep: int = 2) -> StreamingQuery:
    """Upserts each micro-batch into a table in buckets, of which only those that the batch touches are rewritten, and logs its edits.

    A version names the epochs it holds, so a batch that comes again changes nothing. A later epoch of a stream whose table is gone, or
    that has not had the one before, is an error: the table would start over without what came before. A stream with a checkpoint of
    its own goes on with the table as it is."""
    name = checkpoint.rstrip("/")

    def write(batch: DataFrame, epoch: int) -> None:
        at, t = str(spark.sql("select current_timestamp()").first()[0]), BucketTable(spark, table)
        if not t.exists():
            if epoch:
                raise FileNotFoundError(f"epoch {epoch} of {name}: the table {table} is gone")
            t.create(batch.limit(0), key, buckets)
        last = t.version().epochs.get(name)
        if epoch and (last is None or epoch > last + 1):
            raise ValueError(f"epoch {epoch} of {name}: {table} has {'none' if last is None else f'only {last}'} of the epochs before")
        t.upsert(batch, at, epoch=(name, epoch))
        t.vacuum(keep)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def windowed(events: DataFrame, length: str, slide: str | None = None, lateness: str = "10 minutes", *keys: str) -> DataFrame:
    """Tumbling or sliding counts and sums by event time; works on streams and tables."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", lateness: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")
