"""Snapshots: differences, retention, deletion plans, checkpoints, rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import period


def diff_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed, content_changed, metadata_changed; equal entries are left out."""
    a, b = (df.select("path", F.struct("mode", "size", "object_id").alias(n)) for df, n in ((old, "a"), (new, "b")))
    change = (
        F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a.object_id") != F.col("b.object_id"), "content_changed")
        .when((F.col("a.mode") != F.col("b.mode")) | (F.col("a.size") != F.col("b.size")), "metadata_changed")
    )
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def diff_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed, modified, where modified is another kind or other content, not other rights."""
    a, b = (df.select("path", F.struct((F.col("mode").bitwiseAND(61440)).alias("kind"), "object_id").alias(n)) for df, n in ((old, "a"), (new, "b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def unchanged_root(old_root: Column, new_root: Column) -> Column:
    """Roots that are known and equal: the difference is empty and need not be formed."""
    return F.coalesce(old_root == new_root, F.lit(False))


def retention(snaps: DataFrame, daily: int = 0, weekly: int = 0, monthly: int = 0, yearly: int = 0) -> DataFrame:
    """snaps (archive, id, timestamp, protected) with kept: by a rule, or protected; without rules all are kept.

    Of each rule's latest periods the newest snapshot is kept, of equal times that with the smallest id. All rules share
    one order, newest first: a snapshot opens a period where the one before it lies in another, and the number of periods
    opened so far is a running sum.
    """
    rules = [(k, n) for k, n in zip(("day", "week", "month", "year"), (daily, weekly, monthly, yearly), strict=True) if n]
    if not rules:
        return snaps.withColumn("kept", F.lit(True))
    order = Window.partitionBy("archive").orderBy(F.col("timestamp").desc(), F.col("id").asc())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    out, keep = snaps.withColumns({f"p_{k}": period(F.col("timestamp"), k) for k, _ in rules}), F.col("protected")
    opens = {f"o_{k}": F.col(f"p_{k}").isNotNull() & ~F.col(f"p_{k}").eqNullSafe(F.lag(f"p_{k}").over(order)) for k, _ in rules}
    out = out.withColumns(opens).withColumns({f"n_{k}": F.sum(F.col(f"o_{k}").cast("int")).over(so_far) for k, _ in rules})
    for kind, n in rules:
        keep = keep | (F.col(f"o_{kind}") & (F.col(f"n_{kind}") <= n))
    return out.withColumn("kept", keep).select(*snaps.columns, "kept")


def keep_newest(snaps: DataFrame, keep: int) -> DataFrame:
    """snaps with kept: the newest of each archive, of equal times those with the largest ids."""
    w = Window.partitionBy("archive").orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return snaps.withColumn("kept", F.row_number().over(w) <= keep)


def check_plans(plans: DataFrame, snaps: DataFrame, revisions: DataFrame) -> DataFrame:
    """(plan, outcome) of deletion plans (plan, archive, revision, allow_empty, ids): the first rule that is broken.

    revisions (archive, revision) are current; a plan for an archive without one names a wrong archive.
    """
    ids = plans.select("plan", "archive", F.explode("ids").alias("id")).join(snaps.select("archive", "id", "protected"), ["archive", "id"], "left")
    # ids are looked at in ascending order, and the first that is protected or unknown names the outcome
    bad = F.when(F.col("protected").isNull(), "UNKNOWN_SNAPSHOT").when(F.col("protected"), "SNAPSHOT_PROTECTED")
    seen = ids.groupBy("plan").agg(F.min_by(bad, F.when(bad.isNotNull(), F.col("id"))).alias("bad"), F.countDistinct("id").alias("n"))
    counts = snaps.groupBy("archive").agg(F.count("*").alias("all"))
    out = plans.join(revisions.withColumnRenamed("revision", "now"), "archive", "left").join(counts, "archive", "left").join(seen, "plan", "left")
    size = F.size("ids")
    outcome = (
        F.when(size == 0, "NOOP").when(F.size(F.array_distinct("ids")) < size, "DUPLICATE_ID").when(F.col("now").isNull(), "WRONG_ARCHIVE").when(F.col("now") != F.col("revision"), "STALE_HISTORY")
        .when((F.col("n") >= F.coalesce("all", F.lit(0))) & ~F.col("allow_empty"), "EMPTY_HISTORY_FORBIDDEN").when(F.col("bad").isNotNull(), F.col("bad")).otherwise("APPLIED")
    )
    return out.select("plan", outcome.alias("outcome"))


def check_freshness(snaps: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(archive, id, status) against (archive, seq, root): no checkpoint, rolled back, tampered, ok. A newer snapshot
    passes without its root being compared."""
    c = checkpoints.select("archive", "seq", F.col("root").alias("known"))
    status = F.when(F.col("seq").isNull(), "no_checkpoint").when(F.col("id") < F.col("seq"), "rolled_back").when((F.col("id") == F.col("seq")) & ~F.col("root").eqNullSafe(F.col("known")), "tampered").otherwise("ok")
    return snaps.join(c, "archive", "left").select("archive", "id", status.alias("status"))


def advance_checkpoint(current: DataFrame, offers: DataFrame) -> DataFrame:
    """Checkpoints (archive, seq, root) after offers: strictly newer ones with a root replace what is there."""
    best = offers.where("root IS NOT NULL").groupBy("archive").agg(F.max(F.struct("seq", "root")).alias("offer"))
    newer = F.col("seq").isNull() | (F.col("offer.seq") > F.col("seq"))
    out = current.join(best, "archive", "full_outer").withColumn("take", F.col("offer").isNotNull() & newer)
    return out.select("archive", F.when(F.col("take"), F.col("offer.seq")).otherwise(F.col("seq")).alias("seq"), F.when(F.col("take"), F.col("offer.root")).otherwise(F.col("root")).alias("root"))


def rollback(versions: dict[str, DataFrame], live: dict[str, DataFrame], control: tuple[str, ...] = ("snapshots", "snapshot_controls", "config", "snapshot_operations")) -> dict[str, DataFrame]:
    """Tables after a rollback: file state of the version, control tables as they are now."""
    return versions | {k: live[k] for k in control if k in live}
