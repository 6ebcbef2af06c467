"""Plans over version rows: (id, rev, op, properties...) and commits: (rev, commit_no)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STORE, DELETE = "store", "delete"
_OWN = (1 << 63) - 1


def dedupe_staged(versions: DataFrame, order: str) -> DataFrame:
    """The last of several writes of an id in one revision."""
    rest = [c for c in versions.columns if c not in ("id", "rev")]
    return versions.groupBy("id", "rev").agg(F.max_by(F.struct(*rest), order).alias("m")).select("id", "rev", "m.*")


def visible_versions(versions: DataFrame, commits: DataFrame, snapshot: int, own: int | None = None) -> DataFrame:
    """Versions committed by ``snapshot`` or of the session's own revision, with their rank ``at``."""
    joined = versions.join(commits.select("rev", "commit_no"), "rev", "left")
    mine = F.col("rev") == F.lit(own) if own is not None else F.lit(False)
    seen = joined.filter((F.col("commit_no") <= snapshot) | mine)
    return seen.withColumn("at", F.when(mine, F.lit(_OWN)).otherwise(F.col("commit_no"))).drop("commit_no")


def snapshot_view(versions: DataFrame, commits: DataFrame, snapshot: int, own: int | None = None) -> DataFrame:
    """For each id the newest visible version, by commit and not by revision; deleted ids are gone."""
    newest = newest_of(visible_versions(versions, commits, snapshot, own), "at")
    return newest.filter(F.col("op") == STORE).select(*[c for c in versions.columns if c not in ("op", "rev")])


def newest_of(versions: DataFrame, order: str) -> DataFrame:
    """The rows whose ``order`` is the largest of their id.  Only ids and ranks are aggregated, by hash
    and with partial maxima; the payload meets them in one join."""
    top = versions.groupBy("id").agg(F.max(order).alias(order))
    return versions.join(top, ["id", order], "left_semi")


def conflicts(reads: DataFrame, journal: DataFrame, commits: DataFrame, start: int) -> DataFrame:
    """Ids of ``reads`` that a revision committed after ``start`` has updated or deleted."""
    later = journal.filter(F.col("kind").isin("update", "delete")).join(commits.filter(F.col("commit_no") > start), "rev", "left_semi")
    return reads.select("id").distinct().join(later, "id", "left_semi")


def last_commit(commits: DataFrame) -> DataFrame:
    """rev and commit_no of the newest commit; nulls if there is none."""
    return commits.agg(F.max_by("rev", "commit_no").alias("rev"), F.max("commit_no").alias("commit_no"))


def committed(revisions: DataFrame, commits: DataFrame) -> DataFrame:
    """Each revision and whether it has a commit."""
    marked = commits.select("rev", F.lit(True).alias("committed")).distinct()
    return revisions.join(marked, "rev", "left").withColumn("committed", F.coalesce("committed", F.lit(False)))


def available_revisions(revisions: DataFrame, deletions: DataFrame) -> DataFrame:
    return revisions.join(deletions.select("rev"), "rev", "left_anti").orderBy(F.desc("rev"))


def survivors(versions: DataFrame, commits: DataFrame, oldest: int) -> DataFrame:
    """What a clean-up keeps: versions after the ``oldest`` active snapshot or not committed, and before
    it the newest version of each id unless that is a deletion."""
    joined = versions.join(commits.select("rev", "commit_no"), "rev", "left")
    later = joined.filter(F.col("commit_no").isNull() | (F.col("commit_no") > oldest)).drop("commit_no")
    old = newest_of(joined.filter(F.col("commit_no") <= oldest), "commit_no")
    return later.unionByName(old.filter(F.col("op") == STORE).drop("commit_no")).select(versions.columns)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change feed between two snapshots: id and insert, update or delete."""
    names = sorted(set(before.columns) & set(after.columns) - {"id"})
    a = before.select("id", F.struct(*names).alias("old"), F.lit(True).alias("was"))
    b = after.select("id", F.struct(*names).alias("new"), F.lit(True).alias("is"))
    both = a.join(b, "id", "full")
    kind = F.when(F.col("was").isNull(), "insert").when(F.col("is").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return both.select("id", kind.alias("change")).filter("change is not null")
