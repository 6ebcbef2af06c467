import threading

import pytest

import satchel as s
from satchel import Query
from satchel.operators.items import item_frame
from satchel.operators.ordered import OrderedSet
from satchel.plans.store import READONLY, READWRITE, ClosedSessionError, ConflictingCommitError, ItemStore, Lock
from satchel.plans.versions import changes
from satchel.sources.raw import MemoryStore, RawStore

SCHEMA = "__ID__ string, __KIND__ string, name string"


def person(spark, *ids, name="x"):
    return item_frame(spark, [{"__ID__": i, "__KIND__": "Person", "name": name} for i in ids], SCHEMA)


def ids(df):
    return sorted(r["__ID__"] for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return ItemStore(spark, str(tmp_path / "store"))


def test_isolation(spark, store):
    t = store.begin(READWRITE)
    t.store(person(spark, "person-0.1"))
    assert t.revision == 1 and t.commit() == 1
    t1, t2 = store.begin(READWRITE), store.begin(READONLY)
    assert t1.revision == 2 and t2.revision == 1
    t1.store(person(spark, "person-1.1"))
    assert ids(t1.frame()) == ["person-0.1", "person-1.1"] and ids(t2.frame()) == ["person-0.1"]
    t4 = store.begin(READWRITE)
    assert t4.revision == 3
    t1.commit()
    assert ids(t2.frame()) == ["person-0.1"] == ids(t4.frame())
    assert ids(store.begin(READONLY).frame()) == ["person-0.1", "person-1.1"]
    assert ids(store.begin(READONLY, revision=1).frame()) == ["person-0.1"]
    assert t4.prepare(Query().where(s.kind("Person"))).count() == 1


def test_rollback_and_guards(spark, store):
    with store.begin(READWRITE) as t:
        t.store(person(spark, "a"))
        t.flush()
    assert ids(store.begin(READONLY).frame()) == [] and not t.is_active
    with pytest.raises(ClosedSessionError):
        t.store(person(spark, "b"))
    r = store.begin(READONLY)
    with pytest.raises(PermissionError):
        r.store(person(spark, "b"))
    with pytest.raises(NotImplementedError):
        r.create(person(spark, "b"))
    with pytest.raises(ValueError):
        store.begin(READONLY, revision=99)


def test_delete_and_fetch(spark, store):
    t = store.begin(READWRITE)
    t.store(person(spark, "1", "2", "1/a", "1/b", "1/a/x"))
    t.commit()
    t = store.begin(READWRITE)
    t.delete(["1", "missing"])
    assert t.fetch("1") is None and t.fetch("2")["name"] == "x"
    assert [r and r["__ID__"] for r in t.fetch_many(["2", "1", "2"])] == ["2", None, "2"]
    t.store(person(spark, "1", name="new"))
    assert t.fetch("1")["name"] == "new"
    assert ids(t.list_children("1")) == ["1/a", "1/b"]
    t.delete_children("1")
    t.commit()
    assert ids(store.begin(READONLY).frame()) == ["1", "1/a/x", "2"]


def test_conflict(spark, store):
    t = store.begin(READWRITE)
    t.store(person(spark, "a", "b"))
    t.commit()
    t1, t2, t3 = (store.begin(READWRITE) for _ in range(3))
    for t, i in ((t1, "a"), (t2, "a"), (t3, "b")):
        t.fetch(i)
    t1.store(person(spark, "a", name="1"))
    t2.store(person(spark, "a", name="2"))
    t3.store(person(spark, "b", name="3"))
    t3.commit()  # a lower revision may commit later
    t1.commit()
    with pytest.raises(ConflictingCommitError):
        t2.commit()
    assert {r["name"] for r in store.begin(READONLY).frame().collect()} == {"1", "3"}


def test_clean_up(spark, store):
    for k in range(5):
        t = store.begin(READWRITE)
        t.store(person(spark, f"person-{k}", "same", name=str(k)))
        if k == 3:
            t.delete(["person-0"])
        t.commit()
    before = sorted(map(tuple, store.begin(READONLY).frame().select("__ID__", "name").collect()))
    for t in store.active_sessions():
        t.close()
    assert store.clean_up() == 5 and store.available_revisions() == [5]
    assert sorted(map(tuple, store.begin(READONLY).frame().select("__ID__", "name").collect())) == before
    assert store.is_committed(5) and store.clean_up() == 0


def test_type_conflict(spark, store):
    t = store.begin(READWRITE)
    t.store(person(spark, "a"))
    with pytest.raises(TypeError):
        t.store(item_frame(spark, [{"__ID__": "b", "name": 1.0}], "__ID__ string, name double"))


def test_changes(spark):
    a = spark.createDataFrame([("1", 1), ("2", 2), ("3", None)], "id string, v int")
    b = spark.createDataFrame([("1", 1), ("2", 3), ("4", 4)], "id string, v int")
    assert sorted(map(tuple, changes(a, b).collect())) == [("2", "update"), ("3", "delete"), ("4", "insert")]


@pytest.fixture(params=["files", "memory"])
def raw(request, spark, tmp_path):
    return RawStore(spark, str(tmp_path / "raw")) if request.param == "files" else MemoryStore(spark)


def test_raw(raw):
    raw.store("ducks", b"daddy")
    raw.store("ducks/huey", b"h")
    assert raw.fetch("ducks") == b"daddy" and raw.list_children("ducks") == ["ducks/huey"] and raw.fetch("no") is None
    assert not raw.create("ducks", b"x") and raw.create("ducks/louie", b"l")
    assert sorted((r.path, bytes(r.content)) for r in raw.frame().collect()) == [("ducks", b"daddy"), ("ducks/huey", b"h"), ("ducks/louie", b"l")]
    raw.delete("ducks")
    assert raw.list_children() == [] and raw.fetch("ducks/huey") is None


def test_create_is_exclusive(raw):
    for turn in range(8):
        won = []
        threads = [threading.Thread(target=lambda k=k, turn=turn: won.append(raw.create(f"lock-{turn}", str(k).encode()) and k)) for k in range(32)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        (winner,) = [k for k in won if k is not False]
        assert raw.fetch(f"lock-{turn}") == str(winner).encode()


def test_an_expired_lock_is_broken_once(raw):
    assert Lock(raw, "lock").acquire()
    late = [Lock(raw, "lock", break_s=-1) for _ in range(8)]
    held, won = raw.fetch("lock"), []
    fetch = raw.fetch
    raw.fetch = lambda path: held if path == "lock" else fetch(path)  # all of them saw the same lock expire
    threads = [threading.Thread(target=lambda lock=lock: won.append(lock.acquire())) for lock in late]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(won) == 1


def test_two_sessions_race_for_a_number(spark, store):
    sessions, got = [store.begin(READWRITE) for _ in range(3)], []
    for k, t in enumerate(sessions):
        t.store(person(spark, f"race-{k}"))
    threads = [threading.Thread(target=lambda t=t: got.append(t.commit())) for t in sessions]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [1, 2, 3] and ids(store.begin(READONLY).frame()) == ["race-0", "race-1", "race-2"]


def test_a_query_counts_as_read(spark, store):
    with store.begin(READWRITE) as t:
        t.store(person(spark, "a", "b"))
        t.commit()
    t1, t2 = store.begin(READWRITE), store.begin(READWRITE)
    assert t1.prepare(Query().where(s.eq("name", "x"))).count() == 2
    t1.store(person(spark, "c"))
    t2.store(person(spark, "b", name="y"))
    t2.commit()
    with pytest.raises(ConflictingCommitError):
        t1.commit()


def test_a_killed_clean_up_loses_nothing(spark, store, monkeypatch):
    for k in range(3):
        with store.begin(READWRITE) as t:
            t.store(person(spark, f"p{k}", "same", name=str(k)))
            t.commit()
    see = lambda: sorted(map(tuple, ItemStore(spark, store.root).begin(READONLY).frame().select("__ID__", "name").collect()))
    before = see()
    [t.close() for t in store.active_sessions()]
    create = store.raw.create
    monkeypatch.setattr(store.raw, "create", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.clean_up()
    assert see() == before
    monkeypatch.setattr(store.raw, "create", create)
    for p in store.raw.list_children("sessions"):
        store.raw.delete(p)
    assert store.clean_up() == 3 and see() == before
    store.clean_up()  # deletes the files that the first one replaced
    assert see() == before


def test_load_hook_and_renewal(spark, store):
    with store.begin(READWRITE) as t:
        t.store(person(spark, "a"))
        t.commit()
    t, seen = store.begin(READONLY), []
    t.hooks["load"].append(lambda row: seen.append(row["__ID__"]))
    t.fetch("a"), t.fetch("no"), t.fetch_many(["no", "a"])
    assert seen == ["a", "a"]
    t.renew()
    assert store.snapshots_in_use() == [1]


def test_lock(raw):
    a, b = Lock(raw, "lock"), Lock(raw, "lock", break_s=0)
    assert a.acquire() and not Lock(raw, "lock").acquire()
    assert b.acquire()  # the lease was over
    a.release()
    assert raw.exists("lock")
    b.release()
    assert not raw.exists("lock")


def test_ordered_set(spark):
    t = OrderedSet(spark.createDataFrame([(k, k) for k in range(0, 20, 2)], "key int, value int"))
    t = t.put(3, 3).put(4, 40).remove(6)
    assert t.find(4).value == 40 and t.find(6) is None and t.seek(5).key == 8 and t.seek(5, reverse=True).key == 4 and t.seek(99) is None
    assert [r.key for r in t.ordered(reverse=True).collect()] == [18, 16, 14, 12, 10, 8, 4, 3, 2, 0]
    with pytest.raises(ValueError):
        t.put(None, 1)
    assert [tuple(r) for r in t.in_range(3, 8).orderBy("key").collect()] == [(3, 3), (4, 40), (8, 8)]
    many = OrderedSet(spark.createDataFrame([(1, ["a", "b"]), (2, []), (9, ["c"])], "key int, value array<string>"))
    assert sorted(tuple(r) for r in many.in_range(1, 5).collect()) == [(1, "a"), (1, "b")]
    assert many.clear().is_empty()


def test_journal_stream(spark, store, tmp_path):
    from satchel.streaming.feed import journal_stream

    for name in ("a", "b"):
        t = store.begin(READWRITE)
        t.store(person(spark, "same", name))
        t.commit()
    feed = journal_stream(spark, store.root)
    run = feed.writeStream.format("memory").queryName("journal").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = sorted((r.rev, r.id, r.kind) for r in spark.table("journal").collect())
    assert got == [(1, "a", "insert"), (1, "same", "insert"), (2, "b", "insert"), (2, "same", "update")]


def test_snapshots_are_planned_without_sort_aggregates(spark):
    from satchel.plans.versions import snapshot_view, survivors

    versions = spark.createDataFrame([("a", 1, "store", "x"), ("a", 2, "delete", None), ("b", 1, "store", "y")], "id string, rev long, op string, name string")
    commits = spark.createDataFrame([(1, 1), (2, 2)], "rev long, commit_no long")
    for df, want in ((snapshot_view(versions, commits, 1), ["a", "b"]), (snapshot_view(versions, commits, 2), ["b"]), (survivors(versions, commits, 2), ["b"])):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.id for r in df.collect()) == want
