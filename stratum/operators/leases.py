"""Who may write: arbitration between the numbered lease records of a lock.

Leases are (lock, epoch, holder, priority, duration_s, last_modified). A lock has one record a writer that is alive, a
handful; all joins are on the lock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRY_S = 15


def _timed(leases: DataFrame) -> DataFrame:
    at = F.unix_micros("last_modified")
    return leases.select("lock", "epoch", "holder", "priority", at.alias("at"), (at + F.col("duration_s") * 1_000_000).alias("until"))


def owner(leases: DataFrame) -> DataFrame:
    """The lowest epoch of a lock owns it."""
    return leases.groupBy("lock").agg(F.min("epoch").alias("epoch"), F.min_by("holder", "epoch").alias("holder"), F.min_by("priority", "epoch").alias("priority"))


def listing(leases: DataFrame) -> DataFrame:
    """Records by lock and epoch."""
    return leases.orderBy("lock", "epoch")


def scavenge(leases: DataFrame) -> DataFrame:
    """For each claim and each lower lease of its lock: removed (expired by the claim's time, or its own), survives, or
    regression (survives though it is younger)."""
    t = _timed(leases)
    low = t.select("lock", *[F.col(c).alias(f"low_{c}") for c in t.columns if c != "lock"])
    pairs = t.join(low, "lock").where(F.col("low_epoch") < F.col("epoch"))
    state = F.when((F.col("low_until") <= F.col("at")) | (F.col("low_holder") == F.col("holder")), "removed").when(F.col("low_at") > F.col("at"), "regression").otherwise("survives")
    return pairs.select("lock", "epoch", "low_epoch", "low_priority", state.alias("state"))


def outcomes(leases: DataFrame) -> DataFrame:
    """What each claim comes to, judged by itself: Owner, Queued, QueuedBackwardClock, Yielded or Failed."""
    t = _timed(leases)
    below = scavenge(leases).where("state <> 'removed'").groupBy("lock", "epoch").agg(F.max((F.col("state") == "regression").cast("int")).alias("regression"), F.min_by("low_priority", "low_epoch").alias("owner_priority"))
    high = t.select("lock", F.col("epoch").alias("high_epoch"), F.col("priority").alias("high_priority"), F.col("until").alias("high_until"))
    beaten = (F.col("high_epoch") > F.col("epoch")) & (F.col("high_priority") > F.col("priority")) & (F.col("at") < F.col("high_until"))
    above = t.join(high, "lock").where(beaten).select("lock", "epoch").distinct().withColumn("yields", F.lit(True))
    joined = t.join(below, ["lock", "epoch"], "left").join(above, ["lock", "epoch"], "left")
    outcome = (
        F.when(F.col("regression") == 1, "QueuedBackwardClock")
        .when(F.col("owner_priority").isNotNull() & (F.col("priority") > F.col("owner_priority")), "Queued")
        .when(F.col("owner_priority").isNotNull(), "Failed")
        .when(F.col("yields"), "Yielded")
        .otherwise("Owner")
    )
    return joined.select("lock", "epoch", outcome.alias("outcome"))


def refusals(leases: DataFrame, claims: DataFrame) -> DataFrame:
    """(lock, holder, refused) for claims (lock, holder, priority, at, a timestamp): refused at once, without a record, where
    another holder of no lesser priority owns the lock and its lease began before and has not run out."""
    t = _timed(leases)
    own = t.groupBy("lock").agg(F.min_by(F.struct("holder", "priority", "at", "until"), "epoch").alias("o"))
    at = F.unix_micros("at")
    refused = (F.col("o.holder") != F.col("holder")) & (F.col("o.priority") >= F.col("priority")) & (F.col("o.at") <= at) & (at < F.col("o.until"))
    return claims.join(own, "lock", "left").select("lock", "holder", F.coalesce(refused, F.lit(False)).alias("refused"))


def released(leases: DataFrame, holder: str) -> DataFrame:
    """The records that stay once a holder gives up its own."""
    return leases.where(~F.col("holder").eqNullSafe(F.lit(holder)))


def broken(leases: DataFrame, now: DataFrame) -> DataFrame:
    """(lock, epoch, kept) when locks are broken by hand: of each lock the lowest lease that has not run out stays; records
    without a holder or a positive duration are malformed and go like all others. now: (lock, now)."""
    t = _timed(leases).join(now.select("lock", F.unix_micros("now").alias("now")), "lock")
    sound = F.col("holder").isNotNull() & (F.col("until") > F.col("at")) & (F.col("until") > F.col("now"))
    first = t.where(sound).groupBy("lock").agg(F.min("epoch").alias("first"))
    return t.join(first, "lock", "left").select("lock", "epoch", F.coalesce(F.col("epoch") == F.col("first"), F.lit(False)).alias("kept"))


def renewal(duration_s: Column, since_renewal_s: Column, failed: Column) -> Column:
    """What a holder does: renew after a third of the lease (after 15 s more if the last try failed), give up after two thirds."""
    third = duration_s / 3
    return F.when(since_renewal_s >= 2 * third, "lost").when(since_renewal_s >= third + F.when(failed, RETRY_S).otherwise(0), "renew").otherwise("wait")


def status(leases: DataFrame, now: DataFrame) -> DataFrame:
    """Active or Stale for each lease at the time (lock, now) of its lock."""
    t = _timed(leases).join(now.select("lock", F.unix_micros("now").alias("now")), "lock")
    return t.select("lock", "epoch", "holder", F.when(F.col("until") > F.col("now"), "Active").otherwise("Stale").alias("status"))


def lock_status(locks: DataFrame, leases: DataFrame, now: DataFrame) -> DataFrame:
    """Of each lock: Active if a lease is, Stale if all have run out, Unlocked if there is none."""
    found = status(leases, now).groupBy("lock").agg(F.bool_or(F.col("status") == "Active").alias("active"))
    return locks.join(found, "lock", "left").select("lock", F.when(F.col("active"), "Active").when(F.col("active").isNotNull(), "Stale").otherwise("Unlocked").alias("status"))


def next_epoch(leases: DataFrame) -> DataFrame:
    """The epoch that the next claim on each lock takes."""
    return leases.groupBy("lock").agg((F.max("epoch") + 1).alias("next_epoch"))
