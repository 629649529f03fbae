"""Checkpoints, their schedules and time to live, and browsing what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions import expr

LEAST_INTERVAL_S = 600


def new_checkpoints(folders: DataFrame, name: str, now: Column, ttl_s: int) -> DataFrame:
    return folders.select("folder", F.lit(name).alias("name"), now.alias("create_time"), (now + F.make_dt_interval(secs=F.lit(ttl_s))).alias("expire_time"))


def refresh(checkpoints: DataFrame, name: str, now: Column, ttl_s: int) -> DataFrame:
    """Checkpoints of one name live on from now; others stay as they are."""
    expire = F.when(F.col("name") == name, now + F.make_dt_interval(secs=F.lit(ttl_s))).otherwise(F.col("expire_time"))
    return checkpoints.withColumn("expire_time", expire)


def live(checkpoints: DataFrame, now: Column) -> DataFrame:
    return checkpoints.where(F.col("expire_time") > now)


def ages(checkpoints: DataFrame, now: DataFrame, schedules: DataFrame) -> DataFrame:
    """Seconds since the last checkpoint of each schedule in any folder; names that aren't schedules and ages below 0 go."""
    last = checkpoints.groupBy("name").agg(F.max("create_time").alias("last"))
    aged = last.join(schedules, "name").crossJoin(F.broadcast(now))  # one row: the clock
    age = F.floor(F.unix_micros("now") / 1e6 - F.unix_micros("last") / 1e6).cast("long")
    return aged.select("name", "interval_s", age.alias("age_s")).where("age_s >= 0")


def due(schedules: DataFrame, aged: DataFrame) -> DataFrame:
    """Seconds until each valid schedule fires: at once without a checkpoint or once the interval has passed."""
    wait = F.greatest(F.col("interval_s") - F.coalesce("age_s", F.col("interval_s")), F.lit(0)).cast("long")
    return valid(schedules).join(aged.select("name", "age_s"), "name", "left").select("name", wait.alias("delay_s"))


def valid(schedules: DataFrame) -> DataFrame:
    """Schedules of ten minutes and more; shorter ones are passed over."""
    return schedules.where(F.col("interval_s") >= LEAST_INTERVAL_S)


def by_minute(checkpoints: DataFrame) -> DataFrame:
    """What a path to a minute names: of several checkpoints of a folder in it the newest."""
    return checkpoints.groupBy("folder", expr.snapshot_dir(F.col("create_time")).alias("minute")).agg(F.max("create_time").alias("create_time"))


def parse_paths(paths: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Level of each path (root, folder, snapshot, subpath, or null where nothing is): folder, minute, and the rest."""
    trimmed = F.trim(F.col("path"), F.lit("/"))
    parts = F.split(trimmed, "/", 3)
    split = paths.select("path", F.get(parts, F.lit(0)).alias("folder"), F.get(parts, F.lit(1)).alias("minute"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("rest"))
    known = checkpoints.select("folder").distinct().withColumn("known", F.lit(True))
    minutes = by_minute(checkpoints).select("folder", "minute", F.lit(True).alias("there"))
    level = (
        F.when(F.col("folder") == "", "root")
        .when(F.col("minute").isNull() & F.col("known"), "folder")
        .when(F.col("there") & (F.col("rest") == ""), "snapshot")
        .when(F.col("there"), "subpath")
    )
    return split.join(known, "folder", "left").join(minutes, ["folder", "minute"], "left").select("path", level.alias("level"))


def read_dir(files: DataFrame, directory: str) -> DataFrame:
    """Immediate children of a directory: live files, and each directory below it once. The prefix reaches the scan."""
    below = files.where(F.startswith("name", F.lit(directory + "/"))) if directory else files
    inside = below.where(~F.col("deleted")).withColumn("rest", expr.relative_under(directory, F.col("name"))).where(F.col("rest").isNotNull())
    nested = F.contains("rest", F.lit("/"))
    entry = F.substring_index("rest", "/", 1)
    return inside.groupBy("folder", entry.alias("entry")).agg(F.max(nested).alias("is_dir"), F.max(F.when(~nested, F.col("size"))).alias("size"))


def file_metadata(files: DataFrame, paths: DataFrame) -> DataFrame:
    """What each (folder, path) is: a live file with its size, a directory if live names lie below it, or not found.

    Directories are the distinct proper prefixes of live names, so the lookup is an equi join.
    """
    alive = files.where(~F.col("deleted"))
    parts = F.split("name", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = alive.where(F.contains("name", F.lit("/"))).select("folder", F.explode(above).alias("path")).distinct().withColumn("dir", F.lit(True))
    own = alive.select("folder", F.col("name").alias("path"), "size")
    joined = paths.join(own, ["folder", "path"], "left").join(dirs, ["folder", "path"], "left")
    return joined.select("folder", "path", F.when(F.col("size").isNotNull(), "file").when(F.col("dir"), "directory").otherwise("not found").alias("kind"), "size")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names added, removed or changed between two snapshots (an extension)."""
    b, a = (df.where(~F.col("deleted")).select("folder", "name", F.col("sequence").alias(s)) for df, s in ((before, "s0"), (after, "s1")))
    change = F.when(F.col("s0").isNull(), "added").when(F.col("s1").isNull(), "removed").when(F.col("s0") != F.col("s1"), "changed")
    return b.join(a, ["folder", "name"], "full_outer").select("folder", "name", change.alias("change")).where(F.col("change").isNotNull())


def entries(files: DataFrame) -> DataFrame:
    """What a file system shows of live rows: folder, path, kind, size (0 for directories and links), modified (microseconds)."""
    kind = F.lower("type")
    size = F.when(kind == "file", F.col("size")).otherwise(F.lit(0)).cast("long")
    return files.where(~F.col("deleted")).select("folder", F.col("name").alias("path"), kind.alias("kind"), size.alias("size"), expr.modified_time(F.col("modified_s"), F.col("modified_ns")).alias("modified"))


def schedules_after(schedules: DataFrame, upserts: DataFrame, removed: DataFrame) -> DataFrame:
    """Schedules (interval_s, ttl_s) after some are set and others removed, by interval."""
    kept = schedules.join(upserts, "interval_s", "left_anti").unionByName(upserts.select(*schedules.columns))
    return kept.join(removed, "interval_s", "left_anti")
