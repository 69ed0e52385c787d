"""A queue of leased runs as state transitions of a table.

Concurrency is the writer's: one micro-batch at a time applies these to the current state. Each
function takes the table as it is and returns the rows as they become.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def claimable(now: int, max_attempts: int | None = None) -> Column:
    """Queued, or running on a lease that has run out; neither cancelled nor past its deadline."""
    free = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease") < now))
    ready = free & ~F.col("cancel_requested") & (F.col("deadline") > now)
    return ready if max_attempts is None else ready & (F.col("attempts") < max_attempts)


def claim_next(runs: DataFrame, now: int, by: list[str], lease_seconds: int = 30, max_attempts: int | None = None) -> DataFrame:
    """The oldest claimable run of each queue, as it is after the claim."""
    oldest = F.min_by(F.struct("run_id", "created", "attempts"), F.struct("created", "run_id"))
    picked = runs.filter(claimable(now, max_attempts)).groupBy(*by).agg(oldest.alias("r"))
    return picked.select(*by, "r.run_id", "r.created", F.lit("running").alias("status"), F.lit(now + lease_seconds).cast("long").alias("lease"), (F.col("r.attempts") + 1).alias("attempts"))


def renew(runs: DataFrame, beats: DataFrame, now: int, lease_seconds: int = 30) -> DataFrame:
    """Leases renewed for beats (run_id, owner_id) of the holder, while the lease lives and no cancel was asked."""
    alive = (F.col("status") == "running") & (F.col("lease") > now) & ~F.col("cancel_requested") & (F.col("deadline") > now)
    return runs.filter(alive).join(beats, ["run_id", "owner_id"], "left_semi").withColumn("lease", F.lit(now + lease_seconds).cast("long"))


def expire(runs: DataFrame, revisions: DataFrame, now: int) -> DataFrame:
    """Runs past their deadline: failed, or superseded where the task has moved on (task_id, current)."""
    late = runs.filter(F.col("status").isin("queued", "running") & (F.col("deadline") <= now))
    return late.join(revisions, "task_id").withColumn("status", F.when(F.col("current") == F.col("task_revision"), "failed").otherwise("superseded"))


def finish(runs: DataFrame, results: DataFrame, revisions: DataFrame, now: int) -> DataFrame:
    """run_id, outcome of results (run_id, outcome): rejected when late, superseded when the task has moved on."""
    live = (F.col("status") == "running") & ~F.col("cancel_requested") & (F.col("lease") > now) & (F.col("deadline") > now)
    joined = results.join(runs, "run_id").join(revisions, "task_id")
    outcome = F.when(~F.coalesce(live, F.lit(False)), "rejected").when(F.col("current") != F.col("task_revision"), "superseded").otherwise(F.col("outcome"))
    return joined.select("run_id", outcome.alias("outcome"))


def ingest(log: DataFrame, key: str, payload: str, order: str) -> DataFrame:
    """Each request with its verdict: new, replay (same key and payload as the first) or conflict."""
    first = log.groupBy(key).agg(F.min(order).alias("first"), F.min_by(payload, order).alias("first_payload"))
    verdict = F.when(F.col(order) == F.col("first"), "new").when(F.col(payload).eqNullSafe(F.col("first_payload")), "replay").otherwise("conflict")
    return log.join(first, key).withColumn("verdict", verdict).drop("first", "first_payload")


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """current with changes laid over it, the latest change of a key winning."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    rest = [c for c in current.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("__new", order)).alias("r")).select(*key, "r.*")


def backoff(failures: Column, first: float = 0.5, most: float = 30.0) -> Column:
    return F.least(F.lit(most), first * F.pow(F.lit(2.0), failures - 1))


def insert_returning(rows: DataFrame, natural_key: list[str], now: int) -> DataFrame:
    """Rows as they are inserted: with a made id, from their natural key, and the moment of their creation.

    A made id needs no counter that all writers share, and inserting again gives the same one.
    """
    made = F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in natural_key]), 256), 1, 32)
    return rows.select(made.alias("id"), F.lit(now).cast("long").alias("created"), *rows.columns)


def apply_changes(stored: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored rows after the changes, and the outcome (id, outcome) of each change.

    stored: id, version, value. changes: id, op (create, update or delete), expected, value; one for an
    id at most. An update or delete applies only to the version that it expects.
    """
    asked = changes.select("id", "op", "expected", F.col("value").alias("new"))
    both = stored.join(asked, "id", "full_outer")
    there, fits = F.col("version").isNotNull(), F.col("version") == F.col("expected")
    outcome = F.when(F.col("op") == "create", F.when(there, "exists").otherwise("applied")).otherwise(F.when(~there, "missing").when(fits, "applied").otherwise("conflict"))
    done = both.withColumn("outcome", F.when(F.col("op").isNotNull(), outcome))
    applied = F.coalesce(F.col("outcome") == "applied", F.lit(False))
    kept = done.filter((there & ~(applied & (F.col("op") == "delete"))) | (applied & (F.col("op") == "create")))
    after = kept.select("id", F.when(applied, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).alias("version"), F.when(applied, F.col("new")).otherwise(F.col("value")).alias("value"))
    return after, done.filter("outcome is not null").select("id", "outcome")
