"""A versioned item store: sessions with snapshot isolation, optimistic commits and clean-up.

Items are Parquet, one folder a revision, written by Spark.  Control data are small files; the commit
marker is created exclusively, and of several sessions that try for a number one gets it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from satchel.operators import hierarchy
from satchel.operators.items import fetch_many
from satchel.operators.predicates import ID, KIND
from satchel.operators.query import PreparedQuery, Query
from satchel.plans.versions import DELETE, STORE, conflicts, dedupe_staged, snapshot_view, survivors
from satchel.sources.raw import RawStore

READONLY, READWRITE = "READONLY", "READWRITE"
MAX_SESSION_S, LEASE_S = 31, 30 * 60


class ConflictingCommitError(RuntimeError):
    """Something the session read has changed; run its work again in a new session."""


class ClosedSessionError(RuntimeError):
    pass


class Lock:
    """An exclusive lock with a lease: one that is older than ``break_s`` is broken."""

    def __init__(self, raw: RawStore, path: str, break_s: float = MAX_SESSION_S + 1):
        self.raw, self.path, self.break_s, self.token = raw, path, break_s, uuid.uuid4().hex

    def acquire(self, wait_s: float = 0) -> bool:
        mine = lambda: json.dumps({"token": self.token, "at": time.time()}).encode()
        if self.raw.create(self.path, mine(), wait_s):
            return True
        held = self.raw.fetch(self.path)
        if held and time.time() - (old := json.loads(held))["at"] > self.break_s:
            # of several that find it expired, one may break this very lock, and no later one
            if self.raw.create(f"{self.path}-broken/{old['token']}", mine()):
                self.raw.delete(self.path)
                return self.raw.create(self.path, mine())
        return False

    def release(self) -> None:
        held = self.raw.fetch(self.path)
        if held and json.loads(held)["token"] == self.token:
            self.raw.delete(self.path)


class ItemStore:
    """Opens or creates a store under ``root``; revision 0 is committed as 0 and empty."""

    def __init__(self, spark: SparkSession, root: str, clean: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self.raw = RawStore(spark, f"{self.root}/control", clean)
        if clean:
            RawStore(spark, f"{self.root}/data", True)
        self.raw.create("revisions/0", b'{"start": 0}')
        self.raw.create("commits/0", b'{"rev": 0}')
        self._active: list[Session] = []

    # ---- control tables
    def commits(self) -> DataFrame:
        """(rev, commit_no) of every commit; the executors read the markers."""
        number = F.element_at(F.split("path", "/"), -1).cast("long")
        rev = F.get_json_object(F.col("content").cast("string"), "$.rev").cast("long")
        return self.raw.frame("commits").select(rev.alias("rev"), number.alias("commit_no"))

    def last_commit(self) -> int:
        return max(int(p.split("/")[-1]) for p in self.raw.list_children("commits"))

    def _revision_of(self, commit: int) -> int:
        return json.loads(self.raw.fetch(f"commits/{commit}"))["rev"]

    def _merges(self) -> list[dict]:
        """Clean-ups that took effect, oldest first: folder, keep (its revision) and gone (those merged)."""
        found = sorted(self.raw.list_children("merges"), key=lambda p: int(p.split("/")[-1]))
        return [json.loads(self.raw.fetch(p)) for p in found]

    def available_revisions(self) -> list[int]:
        """Newest first, committed or not, without those cleaned up."""
        gone = {r for m in self._merges() for r in m["gone"]}
        numbers = (int(p.split("/")[-1]) for p in self.raw.list_children("revisions"))
        return sorted((n for n in numbers if n not in gone), reverse=True)

    def is_committed(self, revision: int) -> bool:
        return not self.commits().filter(F.col("rev") == revision).isEmpty()

    def active_sessions(self) -> list[Session]:
        return list(self._active)

    def snapshots_in_use(self) -> list[int]:
        """Snapshots of sessions, here or elsewhere, whose lease holds."""
        found = []
        for p in self.raw.list_children("sessions"):
            if (raw := self.raw.fetch(p)) and time.time() - (x := json.loads(raw))["at"] < LEASE_S:
                found.append(x["snapshot"])
        return found

    # ---- data
    def _folders(self, what: str) -> list[str]:
        fs, path = self.raw._fs, self.raw._path(f"{self.root}/data/{what}")
        if not fs.exists(path):
            return []
        return [f"{self.root}/data/{what}/{s.getPath().getName()}" for s in fs.listStatus(path) if s.getPath().getName().startswith("rev=")]

    def _read(self, base: str, folders: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").option("basePath", base).parquet(*folders).withColumn("rev", F.col("rev").cast("long"))

    def versions(self) -> DataFrame:
        """Versions of every revision; those that a clean-up merged come from its folder."""
        merges = self._merges()
        replaced = {f"rev={r}" for m in merges for r in (*m["gone"], m["keep"])}
        folders = [f for f in self._folders("versions") if f.split("/")[-1] not in replaced]
        out = self._read(f"{self.root}/data/versions", folders) if folders else self.spark.createDataFrame([], f"id string, rev long, op string, {KIND} string")
        if merges:
            base = f"{self.root}/data/merged/{merges[-1]['folder']}"
            out = out.unionByName(self._read(base, [f"{base}/rev={merges[-1]['keep']}"]), allowMissingColumns=True)
        return out

    def journal(self) -> DataFrame:
        folders = self._folders("journal")
        return self._read(f"{self.root}/data/journal", folders) if folders else self.spark.createDataFrame([], "id string, rev long, kind string")

    # ---- sessions
    def begin(self, mode: str = READWRITE, revision: int | None = None) -> Session:
        """READONLY on the last commit, or on that of ``revision``; READWRITE on a new revision."""
        snapshot = self.last_commit()
        if revision is not None:
            found = self.commits().filter(F.col("rev") == revision).first()
            if mode != READONLY or found is None or revision not in self.available_revisions():
                raise ValueError(f"revision {revision} can't be opened {mode}")
            snapshot = found.commit_no
        own = None
        if mode == READWRITE:
            own = self.available_revisions()[0] + 1
            while not self.raw.create(f"revisions/{own}", json.dumps({"start": snapshot}).encode()):
                own += 1
        session = Session(self, snapshot, own, self._revision_of(snapshot))
        self._active.append(session)
        return session

    def clean_up(self) -> int:
        """Merges all versions up to the oldest snapshot in use into one revision; returns how many
        revisions went.  Readers of newer snapshots see what they saw.

        The merged rows go to a folder of their own that one exclusive marker puts in force, so a crash
        at any step loses nothing.  Files that an earlier clean-up replaced are deleted by the next one,
        when their readers are done.
        """
        fs, path = self.raw._fs, self.raw._path
        merges = self._merges()
        for m in merges:
            for r in (*m["gone"], m["keep"]):
                fs.delete(path(f"{self.root}/data/versions/rev={r}"), True)
        for m in merges[:-1]:
            fs.delete(path(f"{self.root}/data/merged/{m['folder']}"), True)
        oldest = min([*self.snapshots_in_use(), self.last_commit()])
        keep = self._revision_of(oldest)
        left = set(self.available_revisions())
        # as many as there are revisions since the last clean-up
        gone = [r.rev for r in self.commits().filter(F.col("commit_no") < oldest).select("rev").collect() if r.rev in left and r.rev != keep]
        if not gone:
            return 0
        settled = self.versions().filter(F.col("rev").isin([*gone, keep]))
        folder = uuid.uuid4().hex
        survivors(settled, self.commits(), oldest).drop("rev").write.parquet(f"{self.root}/data/merged/{folder}/rev={keep}")
        content = json.dumps({"folder": folder, "keep": keep, "gone": gone}).encode()
        return len(gone) if self.raw.create(f"merges/{len(merges)}", content) else 0


class Session:
    def __init__(self, store: ItemStore, snapshot: int, own: int | None, revision: int):
        self.store_, self.snapshot, self.own = store, snapshot, own
        self.revision = own if own is not None else revision
        self.is_active = True
        self._staged: DataFrame | None = None
        self._turn = 0
        self._reads: list[DataFrame] = []
        self._marker = f"sessions/{uuid.uuid4().hex}"
        self.hooks: dict[str, list[Callable]] = {"load": [], "store": [], "delete": [], "commit": []}
        self.renew()

    def renew(self) -> None:
        """Begins the lease of the session's snapshot anew; a session that outlives it calls this."""
        self.store_.raw.store(self._marker, json.dumps({"snapshot": self.snapshot, "at": time.time()}).encode())

    def _check(self, write: bool = False) -> None:
        if not self.is_active:
            raise ClosedSessionError("the session is closed")
        if write and self.own is None:
            raise PermissionError("the session is read-only")

    # ---- reading
    def frame(self) -> DataFrame:
        """The items that the session sees, its own writes among them; all of them count as read."""
        found = self._view()
        self._read_ids(found.select(ID))
        return found

    def _view(self) -> DataFrame:
        self._check()
        versions = self.store_.versions()
        if self._staged is not None:
            versions = versions.unionByName(self._latest(), allowMissingColumns=True)
        return snapshot_view(versions, self.store_.commits(), self.snapshot, self.own).withColumnRenamed("id", ID)

    def prepare(self, query: Query) -> PreparedQuery:
        """The query over what the session sees; the rows that it selects count as read."""
        made = query.prepare(self._view())
        self._read_ids(made.df().select(ID))
        return made

    def _loaded(self, rows: list[Row | None]) -> list[Row | None]:
        for hook in self.hooks["load"]:
            for row in rows:
                if row is not None:
                    hook(row)
        return rows

    def _read_ids(self, ids: DataFrame) -> None:
        if self.own is not None:
            self._reads.append(ids.select(F.col(ids.columns[0]).alias("id")))

    def fetch(self, identifier: str) -> Row | None:
        self._read_ids(self.store_.spark.createDataFrame([(identifier,)], "id string"))
        return self._loaded([self._view().filter(F.col(ID) == identifier).first()])[0]

    def fetch_many(self, identifiers: list[str]) -> list[Row | None]:
        """By position, None for what is not there."""
        self._read_ids(self.store_.spark.createDataFrame([(i,) for i in identifiers], "id string"))
        rows = fetch_many(self._view(), identifiers).orderBy("pos").drop("pos", "wanted").collect()
        return self._loaded([r if r[ID] is not None else None for r in rows])

    def list_children(self, path: str) -> DataFrame:
        found = hierarchy.list_children(self._view(), path)
        self._read_ids(found.select(ID))
        return found

    def fetch_children(self, path: str) -> DataFrame:
        found = hierarchy.fetch_children(self._view(), path)
        self._read_ids(found.select(ID))
        return found

    # ---- writing
    def _stage(self, rows: DataFrame, op: str) -> None:
        self._check(write=True)
        self._turn += 1
        rows = rows.withColumnRenamed(ID, "id").withColumns({"rev": F.lit(self.own).cast("long"), "op": F.lit(op), "_turn": F.lit(self._turn)})
        if self._staged is not None:
            clash = [c for c, t in rows.dtypes if dict(self._staged.dtypes).get(c, t) != t]
            if clash:
                raise TypeError(f"the type of {', '.join(clash)} differs from an earlier write")
            rows = self._staged.unionByName(rows, allowMissingColumns=True)
        self._staged = rows

    def _latest(self) -> DataFrame:
        return dedupe_staged(self._staged, "_turn").drop("_turn")

    def store(self, items: DataFrame) -> None:
        """Inserts or replaces items; of several writes of an id the last holds."""
        self._check(write=True)
        for hook in self.hooks["store"]:
            hook(items)
        known = dict(self.store_.versions().dtypes)
        clash = [c for c, t in items.dtypes if c != ID and known.get(c, t) != t]
        if clash:
            raise TypeError(f"the type of {', '.join(clash)} differs from that in the store")
        self._stage(items, STORE)

    update = store

    def create(self, items: DataFrame) -> None:
        raise NotImplementedError("use store")

    def delete(self, identifiers: DataFrame | Iterable[str]) -> None:
        """Ids that do not exist are passed over."""
        self._check(write=True)
        if not isinstance(identifiers, DataFrame):
            identifiers = self.store_.spark.createDataFrame([(i,) for i in identifiers], f"{ID} string")
        for hook in self.hooks["delete"]:
            hook(identifiers)
        self._stage(identifiers.select(ID), DELETE)

    def delete_children(self, path: str) -> None:
        """Direct children only."""
        self.delete(self.list_children(path))

    def flush(self) -> None:
        """Writes what is staged; it stays this session's own until commit.  The journal is written at
        commit alone, once for a revision, so that who follows it never meets a row twice."""
        self._check(write=True)
        if self._staged is None:
            return
        self._latest().drop("rev").write.mode("overwrite").parquet(f"{self.store_.root}/data/versions/rev={self.own}")

    def _publish_journal(self) -> None:
        kind = F.when(F.col("op") == DELETE, "delete").when(F.col("old").isNull(), "insert").otherwise("update")
        old = snapshot_view(self.store_.versions(), self.store_.commits(), self.snapshot).select("id", F.lit(1).alias("old"))
        data = f"{self.store_.root}/data"
        written = self.store_.spark.read.parquet(f"{data}/versions/rev={self.own}")
        written.join(old, "id", "left").select("id", kind.alias("kind")).write.mode("overwrite").parquet(f"{data}/journal/rev={self.own}")

    def commit(self) -> int:
        """The commit number; raises if something read has changed since the session began."""
        self._check()
        if self.own is None:
            self.close()
            return self.snapshot
        self.flush()
        if self._staged is not None:
            self._publish_journal()
        while True:
            last = self.store_.last_commit()
            if self._reads and last > self.snapshot:
                reads = self._reads[0]
                for more in self._reads[1:]:
                    reads = reads.union(more)
                hit = conflicts(reads, self.store_.journal(), self.store_.commits(), self.snapshot).first()
                if hit is not None:
                    self.close()
                    raise ConflictingCommitError(f"{hit['id']} was changed by another session")
            if self.store_.raw.create(f"commits/{last + 1}", json.dumps({"rev": self.own}).encode()):
                break
        for hook in self.hooks["commit"]:
            hook(last + 1)
        self._staged = None
        self.close()
        return last + 1

    def close(self) -> None:
        """Without a commit, what was written is never seen."""
        if self.is_active:
            self.is_active = False
            self.store_.raw.delete(self._marker)
            self.store_._active.remove(self)

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *exc) -> None:
        self.close()
