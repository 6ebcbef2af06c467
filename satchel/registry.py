"""Registered queries over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, TimestampNTZType

from satchel.functions import convert, numbers, paths, strings
from satchel.operators import hierarchy, items
from satchel.operators import predicates as P
from satchel.operators.predicates import ID, KIND
from satchel.operators.ordered import OrderedSet
from satchel.operators.query import Direction, Query
from satchel.operators.ranking import with_places
from satchel.plans import versions as V
from satchel.plans.shared import new_folder
from satchel.plans.store import READONLY, ItemStore
from satchel.sources.tables import read_table as table

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str) -> Callable[[Builder], Builder]:
    def keep(f: Builder) -> Builder:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


def _filter(name: str, of: str, key: str, predicate: P.Predicate, where: str, derive: dict[str, tuple[Callable[[], Column], str]] | None = None) -> None:
    """A query that returns the keys of the rows that match."""
    derived = derive or {}
    source = f"(SELECT *, {', '.join(f'{s} AS {c}' for c, (_, s) in derived.items())} FROM {of})" if derived else of

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, of).withColumns({c: e() for c, (e, _) in derived.items()})
        return Query().where(predicate).prepare(df).df().select(key)

    _add(name, f"SELECT {key} FROM {source} WHERE {where}")(run)


# ---------------------------------------------------------------- filters, scalar properties
_filter("filter_eq", "customer", "c_custkey", P.eq("c_mktsegment", "BUILDING"), "c_mktsegment = 'BUILDING'")
_filter("filter_ne", "orders", "o_orderkey", P.ne("o_orderstatus", "F"), "o_orderstatus <> 'F'")
_filter("filter_gt", "orders", "o_orderkey", P.gt("o_totalprice", 150000.0), "o_totalprice > 150000")
_filter("filter_ge", "lineitem", "l_orderkey", P.ge("l_quantity", 25.0), "l_quantity >= 25")
_filter("filter_lt", "orders", "o_orderkey", P.lt("o_totalprice", 50000.0), "o_totalprice < 50000")
_filter("filter_le", "lineitem", "l_orderkey", P.le("l_quantity", 25.0), "l_quantity <= 25")
_filter("filter_range_and", "customer", "c_custkey", P.and_(P.gt("c_acctbal", 1000.0), P.lt("c_acctbal", 5000.0)), "c_acctbal > 1000 AND c_acctbal < 5000")
_filter(
    "filter_or_nested",
    "orders",
    "o_orderkey",
    P.or_(P.and_(P.eq("o_orderstatus", "F"), P.eq("o_orderpriority", "1-URGENT")), P.and_(P.eq("o_orderstatus", "O"), P.or_(P.gt("o_totalprice", 200000.0), P.lt("o_totalprice", 10000.0)))),
    "(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR (o_orderstatus = 'O' AND (o_totalprice > 200000 OR o_totalprice < 10000))",
)
_filter("filter_any_scalar", "customer", "c_custkey", P.any_("c_mktsegment", "BUILDING", "MACHINERY"), "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_filter("filter_all_scalar", "customer", "c_custkey", P.all_("c_mktsegment", "BUILDING", "BUILDING"), "c_mktsegment = 'BUILDING' AND c_mktsegment = 'BUILDING'")
_filter("filter_xor", "orders", "o_orderkey", P.xor("o_orderstatus", "F", "F"), "o_orderstatus <> 'F'")
_filter("filter_ne_all", "orders", "o_orderkey", P.ne("o_orderstatus", P.all_of("F", "O")), "o_orderstatus NOT IN ('F', 'O')")
_filter("filter_none", "orders", "o_orderkey", P.none("o_orderstatus", "F", "O"), "o_orderstatus NOT IN ('F', 'O')")
_MAYBE = {"maybe": (lambda: F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")), "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END")}
_filter("filter_is_null", "orders", "o_orderkey", P.is_null("maybe"), "maybe IS NULL", _MAYBE)
_filter("filter_not_null", "orders", "o_orderkey", P.not_null("maybe"), "maybe IS NOT NULL", _MAYBE)
_filter("filter_ne_skips_absent", "orders", "o_orderkey", P.ne("maybe", 0.0), "maybe <> 0", _MAYBE)
_filter("filter_empty_values", "customer", "c_custkey", P.or_(P.any_("c_mktsegment"), P.all_("c_mktsegment"), P.eq("c_mktsegment", "BUILDING")), "c_mktsegment = 'BUILDING'")


@_add("add_filter_conjunction", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_nationkey <= 10")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query().where(P.eq("c_mktsegment", "BUILDING")).add_filter("c_acctbal", P.Op.GREATER, 0.0).add_filter(P.le("c_nationkey", 10))
    return q.prepare(table(spark, sf_dir, "customer")).df().select("c_custkey")


@_add("where_replaces", "SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query().where(P.eq("c_mktsegment", "BUILDING")).where(P.lt("c_acctbal", 0.0)).prepare(table(spark, sf_dir, "customer")).df().select("c_custkey")


# ---------------------------------------------------------------- filters, multi-valued properties
_MEMBERS = "(SELECT l_orderkey AS id, list(DISTINCT l_suppkey) AS members, list(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("members"), F.collect_set("l_linenumber").alias("lines"))


def _multi(name: str, predicate: P.Predicate, where: str) -> None:
    _add(name, f"SELECT id FROM {_MEMBERS} WHERE {where}")(lambda spark, sf_dir: Query().where(predicate).prepare(_members(spark, sf_dir)).df().select("id"))


_multi("multi_eq", P.eq("members", 3), "list_contains(members, 3)")
_multi("multi_any", P.any_("members", 1, 2, 5), "list_has_any(members, [1, 2, 5])")
_multi("multi_all", P.all_("lines", 1, 2, 4), "list_has_all(lines, [1, 2, 4])")
_multi("multi_ne", P.ne("lines", 1), "len(list_filter(lines, lambda x: x <> 1)) > 0")
_multi("multi_ne_all", P.ne("lines", P.all_of(1, 2)), "len(list_filter(lines, lambda x: x <> 1)) > 0 AND len(list_filter(lines, lambda x: x <> 2)) > 0")
_multi("multi_none", P.none("members", 1, 2, 5), "NOT list_has_any(members, [1, 2, 5])")
_multi("multi_range", P.and_(P.gt("lines", 3), P.lt("lines", 2)), "len(list_filter(lines, lambda x: x > 3)) > 0 AND len(list_filter(lines, lambda x: x < 2)) > 0")
_multi("multi_ge_le", P.or_(P.ge("lines", 7), P.le("members", 1)), "len(list_filter(lines, lambda x: x >= 7)) > 0 OR len(list_filter(members, lambda x: x <= 1)) > 0")

# ---------------------------------------------------------------- items of several kinds
_KINDS = """(SELECT 'customer/' || c_custkey AS "__ID__", 'customer' AS "__KIND__", c_name AS name, c_acctbal AS balance, CAST(NULL AS INTEGER) AS size FROM customer
UNION ALL SELECT 'supplier/' || s_suppkey, 'supplier', s_name, s_acctbal, NULL FROM supplier
UNION ALL SELECT 'part/' || p_partkey, 'part', p_name, NULL, p_size FROM part)"""


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda kind, c: paths.child(F.lit(kind), F.col(c).cast("string"))
    made = []
    for kind, k, rename in (
        ("customer", "c_custkey", {"c_name": "name", "c_acctbal": "balance"}),
        ("supplier", "s_suppkey", {"s_name": "name", "s_acctbal": "balance"}),
        ("part", "p_partkey", {"p_name": "name", "p_size": "size"}),
    ):
        df = table(spark, sf_dir, kind).select(k, *[F.col(a).alias(b) for a, b in rename.items()])
        made.append(items.items_of(df, kind, key(kind, k)).drop(k))
    return items.union_items(*made)


@_add("items_union_kinds", f'SELECT "__ID__", "__KIND__", name, balance, size FROM {_KINDS}')
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).select(ID, KIND, "name", "balance", "size")


@_add("items_has_property", f"""SELECT "__ID__" FROM {_KINDS} WHERE "__KIND__" = 'part'""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).filter(items.has_property("size")).select(ID)


@_add("filter_kind", f"""SELECT "__ID__", name FROM {_KINDS} WHERE "__KIND__" = 'supplier' AND balance > 0""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query().where(P.kind("supplier") & P.gt("balance", 0.0)).prepare(_kinds(spark, sf_dir)).df().select(ID, "name")


@_add("filter_id", f"""SELECT "__ID__", "__KIND__", name FROM {_KINDS} WHERE "__ID__" = 'part/7'""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query().where(P.id_("part/7")).prepare(_kinds(spark, sf_dir)).df().select(ID, KIND, "name")


@_add("identifiers", f"""SELECT "__ID__" FROM {_KINDS} WHERE balance < 0""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query().where(P.lt("balance", 0.0)).prepare(_kinds(spark, sf_dir)).identifiers()


@_add("fetch_ids_positional", f"""SELECT pos, i."__KIND__", i.name FROM (VALUES (0, 'part/3'), (1, 'nothing'), (2, 'supplier/1'), (3, 'part/3')) w(pos, wanted) LEFT JOIN {_KINDS} i ON i."__ID__" = w.wanted""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.fetch_many(_kinds(spark, sf_dir), ["part/3", "nothing", "supplier/1", "part/3"]).select("pos", KIND, "name")


@_add("reference_join", "SELECT 'order/' || o_orderkey AS \"__ID__\" FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), F.col("o_orderkey")).alias(ID), F.concat(F.lit("customer/"), F.col("o_custkey")).alias("customer"))
    poor = Query().where(P.kind("customer") & P.lt("balance", 0.0)).prepare(_kinds(spark, sf_dir)).df()
    return items.reference_join(orders, "customer", poor).select(ID)


# ---------------------------------------------------------------- order, count, first
def _ranked(df: DataFrame, q: Query, key: str) -> DataFrame:
    """The place of each row in the query's order, ties by key."""
    return with_places(df, *(x.column() for x in q.sorts), F.col(key)).select(key, "place")


def _order(name: str, q: Query, by: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "customer").withColumn("maybe", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")))
        return _ranked(df, q, "c_custkey")

    _add(name, f"SELECT c_custkey, row_number() OVER (ORDER BY {by}, c_custkey) AS place FROM (SELECT *, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS maybe FROM customer)")(run)


_order("order_asc_nulls", Query().order_by("maybe"), "maybe ASC NULLS FIRST")
_order("order_desc_nulls", Query().order_by("maybe", Direction.DESCENDING), "maybe DESC NULLS LAST")
_order("order_multi_key", Query().order_by("c_mktsegment").add_sort("maybe", Direction.DESCENDING), "c_mktsegment ASC NULLS FIRST, maybe DESC NULLS LAST")

_TREE = """(SELECT r_name AS "__ID__" FROM region
UNION ALL SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", paths.child("r_name", "n_name").alias(ID))
    customers = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(paths.child(ID, "c_name").alias(ID))
    return region.select(F.col("r_name").alias(ID)).union(nations.select(ID)).union(customers)


@_add("order_identifier", f"""SELECT "__ID__", row_number() OVER (ORDER BY string_split("__ID__", '/')[1:len(string_split("__ID__", '/')) - 1], string_split("__ID__", '/')[-1]) AS place FROM {_TREE}""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_places(_tree(spark, sf_dir), *paths.order_key(F.col(ID))).select(ID, "place")


@_add("count", "SELECT count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query().where(P.ne("c_mktsegment", "BUILDING")).prepare(table(spark, sf_dir, "customer")).df().agg(F.count(F.lit(1)).alias("n"))


@_add("item_first", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query().where(P.eq("c_mktsegment", "BUILDING")).order_by("c_acctbal", Direction.DESCENDING).order_by("c_custkey")
    return q.prepare(table(spark, sf_dir, "customer")).df().limit(1).select("c_custkey", "c_name")


# ---------------------------------------------------------------- hierarchy
_SPLIT = "string_split(\"__ID__\", '/')"


@_add("path_name_parent_depth", f"""SELECT "__ID__", {_SPLIT}[-1] AS name, CASE WHEN len({_SPLIT}) > 1 THEN array_to_string({_SPLIT}[1:len({_SPLIT}) - 1], '/') END AS parent, len({_SPLIT}) AS depth FROM {_TREE}""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select(ID, paths.name(ID).alias("name"), paths.parent(ID).alias("parent"), paths.depth(ID).cast("long").alias("depth"))


@_add("path_revision_number", "SELECT c_custkey, c_custkey AS rev FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/a-1/store-"), F.col("c_custkey"), F.lit("/"))
    return table(spark, sf_dir, "customer").select("c_custkey", paths.revision_number(paths.normalise(path)).alias("rev"))


@_add("list_children", f"""SELECT "__ID__" FROM {_TREE} WHERE "__ID__" LIKE 'ASIA/%' AND len({_SPLIT}) = 2""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.list_children(_tree(spark, sf_dir), "/ASIA/")


@_add("children_many", f"""SELECT array_to_string({_SPLIT}[1:len({_SPLIT}) - 1], '/') AS path, count(*) AS n, min("__ID__") AS first FROM {_TREE} WHERE len({_SPLIT}) > 1 GROUP BY 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    found = hierarchy.fetch_children_of(tree, tree.select(F.col(ID).alias("path")))
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(ID).alias("first"))


@_add("descendants", f"""SELECT "__ID__" FROM {_TREE} WHERE "__ID__" LIKE 'EUROPE/%'""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.fetch_descendants(_tree(spark, sf_dir), "EUROPE")


@_add("ancestors", f"""SELECT t."__ID__" AS "__ID__", c.c AS below FROM {_TREE} t JOIN (SELECT "__ID__" AS c FROM {_TREE}) c ON c.c LIKE t."__ID__" || '/%'""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    pairs = tree.select(F.col(ID).alias("below"), F.explode(paths.ancestors(ID)).alias(ID))
    return pairs.join(tree, ID).select(ID, "below")


@_add("delete_children", f"""SELECT "__ID__" FROM {_TREE} WHERE NOT ("__ID__" LIKE 'AFRICA/%' AND len({_SPLIT}) = 2)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.delete_children(_tree(spark, sf_dir), "AFRICA")


# ---------------------------------------------------------------- versions
# an id is a user, a revision an event; revisions commit out of order; errors delete
_VERSIONS = "(SELECT CAST(user_id AS VARCHAR) AS id, event_id AS rev, CASE WHEN event_type = 'error' OR event_id % 11 = 0 THEN 'delete' ELSE 'store' END AS op, value FROM events)"
_COMMITS = "(SELECT event_id AS rev, CASE WHEN event_id % 2 = 0 THEN event_id + 1 ELSE event_id - 1 END AS commit_no FROM events WHERE event_id % 13 <> 0)"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    op = F.when((F.col("event_type") == "error") | (F.col("event_id") % 11 == 0), V.DELETE).otherwise(V.STORE)
    commit = F.when(F.col("event_id") % 2 == 0, F.col("event_id") + 1).otherwise(F.col("event_id") - 1)
    return e.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("rev"), op.alias("op"), "value"), e.filter("event_id % 13 <> 0").select(F.col("event_id").alias("rev"), commit.alias("commit_no"))


def _snapshot_sql(where: str, own: str = "NULL") -> str:
    return f"""SELECT id, value FROM (SELECT v.*, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN v.rev = {own} THEN 9223372036854775807 ELSE c.commit_no END DESC) AS k
    FROM {_VERSIONS} v LEFT JOIN {_COMMITS} c ON v.rev = c.rev WHERE {where}) WHERE k = 1 AND op = 'store'"""


def _snapshot(name: str, sql: str, **args) -> None:
    _add(name, sql)(lambda spark, sf_dir: V.snapshot_view(*_versions(spark, sf_dir), **args).select("id", "value"))


_snapshot("mvcc_snapshot", _snapshot_sql("c.commit_no <= 1000000000"), snapshot=1000000000)
_snapshot("mvcc_time_travel", _snapshot_sql("c.commit_no <= 500"), snapshot=500)
_snapshot("mvcc_own_writes", _snapshot_sql("c.commit_no <= 500 OR v.rev = 650", "650"), snapshot=500, own=650)


@_add("mvcc_tombstone", f"SELECT id FROM {_VERSIONS} WHERE rev IN (SELECT rev FROM {_COMMITS}) GROUP BY id EXCEPT SELECT id FROM ({_snapshot_sql('c.commit_no <= 1000000000')})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions, commits = _versions(spark, sf_dir)
    known = versions.join(commits, "rev", "left_semi").select("id").distinct()
    return known.join(V.snapshot_view(versions, commits, 1000000000), "id", "left_anti")


@_add(
    "mvcc_conflicts",
    f"SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events WHERE event_type = 'view' AND CAST(user_id AS VARCHAR) IN (SELECT id FROM {_VERSIONS} v JOIN {_COMMITS} c ON v.rev = c.rev WHERE c.commit_no > 900)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions, commits = _versions(spark, sf_dir)
    journal = versions.select("id", "rev", F.when(F.col("op") == V.DELETE, "delete").otherwise("update").alias("kind"))
    reads = table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").cast("string").alias("id"))
    return V.conflicts(reads, journal, commits, 900)


@_add("revisions_available", f"SELECT event_id AS rev FROM events WHERE event_id NOT IN (SELECT rev FROM {_VERSIONS} WHERE op = 'delete')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions, _commits = _versions(spark, sf_dir)
    return V.available_revisions(versions.select("rev"), versions.filter(F.col("op") == V.DELETE))


@_add(
    "vacuum_survivors",
    f"""WITH j AS (SELECT v.*, c.commit_no FROM {_VERSIONS} v LEFT JOIN {_COMMITS} c ON v.rev = c.rev)
    SELECT id, rev, op FROM j WHERE commit_no IS NULL OR commit_no > 700 UNION ALL
    SELECT id, rev, op FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY commit_no DESC) AS k FROM j WHERE commit_no <= 700) WHERE k = 1 AND op = 'store'""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.survivors(*_versions(spark, sf_dir), 700).select("id", "rev", "op")


@_add(
    "change_feed",
    f"""WITH a AS ({_snapshot_sql("c.commit_no <= 300")}), b AS ({_snapshot_sql("c.commit_no <= 800")})
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'delete' ELSE 'update' END AS change
    FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.value IS DISTINCT FROM b.value""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions, commits = _versions(spark, sf_dir)
    return V.changes(V.snapshot_view(versions, commits, 300), V.snapshot_view(versions, commits, 800))


@_add("latest_turn", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("order", F.col("turn"))
    rows = c.select(F.col("conv_id").alias("id"), F.lit(0).alias("rev"), "turn", "role", "order")
    return V.dedupe_staged(rows, "order").select(F.col("id").alias("conv_id"), "turn", "role")


# ---------------------------------------------------------------- functions
_TEXT = StringType()


def _columns(name: str, of: str, columns: Callable[[], dict[str, Column]], sql: str) -> None:
    _add(name, sql)(lambda spark, sf_dir: table(spark, sf_dir, of).select(*[c.alias(a) for a, c in columns().items()]))


def _wordy() -> Column:
    return F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.format_number(F.col("o_totalprice").cast("long"), 0))


_columns(
    "convert_int",
    "orders",
    lambda: {"o_orderkey": F.col("o_orderkey"), "n": convert.to_integer(_wordy(), _TEXT), "safe": convert.to_safe_int(_wordy(), _TEXT, 7), "big": convert.to_long(_wordy(), _TEXT), "small": convert.to_short(_wordy(), _TEXT)},
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(trunc(o_totalprice) AS INTEGER) END AS n, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(trunc(o_totalprice) AS INTEGER) ELSE 7 END AS safe, "
    "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(trunc(o_totalprice) AS BIGINT) END AS big, CASE WHEN o_orderkey % 5 <> 0 AND trunc(o_totalprice) < 1000 THEN CAST(trunc(o_totalprice) AS SMALLINT) END AS small FROM orders",
)
_columns(
    "convert_flags",
    "orders",
    lambda: {"o_orderkey": F.col("o_orderkey"), "flag": convert.to_integer(F.col("o_orderstatus") == "F", BooleanType()), "real": convert.to_double(F.col("o_orderstatus") == "F", BooleanType())},
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 0 END AS flag, CASE WHEN o_orderstatus = 'F' THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS real FROM orders",
)
_columns(
    "convert_double",
    "lineitem",
    lambda: {"l_orderkey": F.col("l_orderkey"), "l_linenumber": F.col("l_linenumber"), "x": convert.to_double(F.concat(F.lit(" 1,"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0"), F.lit(".5")), _TEXT), "none": convert.to_safe_double(F.lit("one"), _TEXT, 2.5)},
    "SELECT l_orderkey, l_linenumber, 1000.5 + l_quantity AS x, CAST(2.5 AS DOUBLE) AS none FROM lineitem",
)
_columns(
    "convert_bool",
    "orders",
    lambda: {"o_orderkey": F.col("o_orderkey"), "b": convert.to_boolean("o_orderpriority", _TEXT), "word": convert.to_safe_boolean(F.when(F.col("o_orderkey") % 3 == 0, "TRUE").when(F.col("o_orderkey") % 3 == 1, "yes"), _TEXT, True), "n": convert.to_boolean(F.col("o_totalprice") - 1000, DoubleType())},
    "SELECT o_orderkey, FALSE AS b, o_orderkey % 3 <> 1 AS word, trunc(o_totalprice - 1000) <> 0 AS n FROM orders",
)
_columns(
    "convert_date",
    "orders",
    lambda: {"o_orderkey": F.col("o_orderkey"), "day": F.date_format(convert.to_date(F.date_format("o_orderdate", "MM/dd/yyyy"), _TEXT), "yyyy-MM-dd"), "iso": F.date_format(convert.to_date(F.date_format("o_orderdate", "yyyy-MM-dd"), _TEXT), "yyyy-MM-dd"), "short": F.date_format(convert.to_date(F.date_format("o_orderdate", "MM/dd/yy"), _TEXT), "yyyy-MM-dd"), "bad": convert.to_date(F.lit("soon"), _TEXT).isNull()},
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS short, TRUE AS bad FROM orders",
)
_columns(
    "convert_decimal",
    "customer",
    lambda: {"c_custkey": F.col("c_custkey"), "d": convert.to_decimal(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), _TEXT).cast("string"), "whole": convert.to_big_integer(F.concat(F.col("c_custkey"), F.lit(",000")), _TEXT).cast("string"), "frac": convert.to_big_integer(F.lit("1.5"), _TEXT).isNull()},
    "SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS d, CAST(c_custkey * 1000 AS VARCHAR) AS whole, TRUE AS frac FROM customer",
)
_filter("filter_like_wildmat", "customer", "c_custkey", P.gt("hit", 0), "hit > 0", {"hit": (lambda: strings.wildmat("c_name", "Customer#*[0-4]?").cast("int"), "CAST(regexp_full_match(c_name, 'Customer#.*[0-4].') AS INTEGER)")})


@_add("wildmat", "SELECT c_custkey FROM customer WHERE regexp_full_match(c_name, 'Customer#.*[1-3]')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(strings.wildmat("c_name", "customer#*[1-3]", ignore_case=True)).select("c_custkey")


@_add("wildmat_prefix", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^..[a-m]')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(strings.starts_with_wild("p_name", "??[a-m]")).select("p_partkey")


_columns(
    "str_pad_head_tail",
    "part",
    lambda: {"p_partkey": F.col("p_partkey"), "l": strings.prepad(F.col("p_size").cast("string"), 4, "0"), "r": strings.pad("p_brand", 3, "*"), "h": strings.head("p_name", 5), "t": strings.tail("p_name", 5)},
    "SELECT p_partkey, CASE WHEN length(CAST(p_size AS VARCHAR)) >= 4 THEN CAST(p_size AS VARCHAR) ELSE lpad(CAST(p_size AS VARCHAR), 4, '0') END AS l, CASE WHEN length(p_brand) >= 3 THEN p_brand ELSE rpad(p_brand, 3, '*') END AS r, left(p_name, 5) AS h, right(p_name, 5) AS t FROM part",
)
_columns(
    "str_blank",
    "documents",
    lambda: {"doc_id": F.col("doc_id"), "blank": strings.is_blank("text"), "cut": strings.is_blank(F.regexp_replace("text", "[^\\x00-\\x20]+", " ")), "none": strings.is_blank(F.nullif(F.col("text"), F.col("text")))},
    "SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x20]') AS blank, TRUE AS cut, TRUE AS none FROM documents",
)
_columns(
    "str_replace",
    "documents",
    lambda: {"doc_id": F.col("doc_id"), "h": F.md5(strings.replace_all("text", "the", "[THE]").cast("binary"))},
    "SELECT doc_id, md5(replace(text, 'the', '[THE]')) AS h FROM documents",
)
_columns(
    "str_breakup",
    "documents",
    lambda: {"doc_id": F.col("doc_id"), "h": F.md5(strings.break_large_words("text", " \n", "-", 6).cast("binary"))},
    "SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '[^ \\n]+|[ \\n]+'), lambda w: CASE WHEN regexp_matches(w, '[ \\n]') THEN w ELSE array_to_string(regexp_extract_all(w, '(?s).{1,6}'), '-') END), '')) AS h FROM documents",
)
_columns(
    "str_wordbreak",
    "documents",
    lambda: {"doc_id": F.col("doc_id"), "at": strings.last_word_break("text", " \n", 40).cast("long")},
    "SELECT doc_id, CASE WHEN regexp_matches(left(text, 40), '[ \\n]') THEN CAST(length(regexp_extract(left(text, 40), '(?s)^(.*[ \\n])', 1)) AS BIGINT) ELSE -1 END AS at FROM documents",
)
def _money() -> Column:
    return F.col("c_acctbal").cast("decimal(12,2)").cast("string")


@_add("num_encode_order", "SELECT c_custkey, row_number() OVER (ORDER BY CAST(c_acctbal AS DECIMAL(12,2)), c_custkey) AS place FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_places(table(spark, sf_dir, "customer"), numbers.encode(_money()), F.col("c_custkey")).select("c_custkey", "place")


_columns("num_decode", "customer", lambda: {"c_custkey": F.col("c_custkey"), "v": numbers.decode(numbers.encode(_money()))}, "SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS v FROM customer")
def _made_url() -> Column:
    return F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit("?a=x+"), F.col("page_id"), F.lit("&id="), F.col("page_id"), F.lit("#f"))


_columns(
    "url_query_params",
    "pages",
    lambda: {"page_id": F.col("page_id"), "q": F.element_at(strings.query_components(_made_url()), "a"), "id": F.element_at(strings.query_components(_made_url()), "id"), "none": strings.query_components("url").isNull()},
    "SELECT page_id, 'x ' || page_id AS q, CAST(page_id AS VARCHAR) AS id, NOT contains(url, '?') AS none FROM pages",
)
_columns(
    "num_encode",
    "customer",
    lambda: {"c_custkey": F.col("c_custkey"), "code": numbers.encode(F.col("c_custkey").cast("string"))},
    "SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) = 1 THEN '?' || c_custkey || '*' ELSE '??' || length(CAST(c_custkey AS VARCHAR)) || c_custkey || '*' END AS code FROM customer",
)


# ---------------------------------------------------------------- properties, sets, limits
@_add("properties_set_remove", f"""SELECT "__ID__", upper(name) AS name, "__KIND__" <> 'part' AS has_balance, FALSE AS indexed FROM {_KINDS}""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = items.set_property(items.remove_property(_kinds(spark, sf_dir), "size"), "name", F.upper("name"), indexed=False)
    return made.select(ID, "name", items.has_property("balance").alias("has_balance"), items.is_indexed("name").alias("indexed"))


@_add("items_copy", f"""SELECT 'copy/' || "__ID__" AS "__ID__", name FROM {_KINDS} WHERE "__KIND__" = 'supplier'""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = Query().where(P.kind("supplier")).prepare(_kinds(spark, sf_dir)).df()
    return items.copy_items(suppliers, paths.child(F.lit("copy"), ID)).select(ID, "name")


@_add("reference_join_multi", "SELECT DISTINCT l_orderkey AS \"__ID__\" FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 3000")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = table(spark, sf_dir, "supplier").filter("s_acctbal < 3000").select(F.col("s_suppkey").alias(ID))
    return items.reference_join(_members(spark, sf_dir).withColumnRenamed("id", ID), "members", poor).select(ID)


def _sets(name: str, sql: str, make: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders")
        one = Query().where(P.eq("o_orderstatus", "F")).prepare(orders).df().select("o_custkey")
        two = Query().where(P.gt("o_totalprice", 200000.0)).prepare(orders).df().select("o_custkey")
        return make(one, two)

    _add(name, f"SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' {sql} SELECT o_custkey FROM orders WHERE o_totalprice > 200000")(run)


_sets("set_intersection", "INTERSECT", lambda a, b: a.intersect(b))
_sets("set_union", "UNION", lambda a, b: a.union(b).distinct())
_sets("set_except", "EXCEPT", lambda a, b: a.subtract(b))


@_add("limit_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query().order_by("o_totalprice", Direction.DESCENDING).order_by("o_orderkey")
    return q.prepare(table(spark, sf_dir, "orders")).df().limit(25).select("o_orderkey", "o_totalprice")


@_add("tree_size", f"""SELECT len({_SPLIT}) AS depth, count(*) AS n FROM {_TREE} GROUP BY 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).groupBy(paths.depth(ID).cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- ordered sets
@_add("ordered_upsert", "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS value FROM customer WHERE c_custkey <> 5")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    entries = OrderedSet(c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")))
    return entries.put_all(c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.lit("new").alias("value"))).remove(5).frame


@_add("ordered_seek", "(SELECT o_orderkey AS key, 'next' AS way FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 1) UNION ALL (SELECT o_orderkey, 'back' FROM orders WHERE o_orderkey <= 100 ORDER BY o_orderkey DESC LIMIT 1)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = OrderedSet(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")))
    way = lambda reverse, label: entries.nearest(100, reverse).select("key", F.lit(label).alias("way"))
    return way(False, "next").union(way(True, "back"))


# ---------------------------------------------------------------- more of versions
@_add("max_committed_revision", f"SELECT arg_max(rev, commit_no) AS rev, max(commit_no) AS commit_no FROM {_COMMITS}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.last_commit(_versions(spark, sf_dir)[1])


@_add("revisions_committed", f"SELECT event_id AS rev, event_id IN (SELECT rev FROM {_COMMITS}) AS committed FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions, commits = _versions(spark, sf_dir)
    return V.committed(versions.select("rev"), commits)


@_add(
    "mvcc_children",
    f"SELECT id FROM ({_snapshot_sql('c.commit_no <= 800')}) WHERE id LIKE '1%'",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions, commits = _versions(spark, sf_dir)
    placed = versions.withColumn("id", paths.child(F.substring("id", 1, 1), "id"))
    seen = V.snapshot_view(placed, commits, 800).withColumnRenamed("id", ID)
    return hierarchy.list_children(seen, "1").select(paths.name(ID).alias("id"))


# ---------------------------------------------------------------- more functions
_columns(
    "convert_times",
    "orders",
    lambda: {"o_orderkey": F.col("o_orderkey"), "ms": convert.to_long("o_orderdate", TimestampNTZType()), "back": F.date_format(convert.to_timestamp("o_orderdate", TimestampNTZType()), "yyyy-MM-dd HH:mm:ss")},
    "SELECT o_orderkey, epoch_ms(o_orderdate) AS ms, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS back FROM orders",
)
_columns(
    "convert_narrow",
    "orders",
    lambda: {"o_orderkey": F.col("o_orderkey"), "b": convert.to_byte("o_orderkey", LongType()).cast("int"), "safe": convert.to_safe_byte(F.lit("300"), _TEXT, 9).cast("int"), "c": convert.to_character(F.lit(65) + F.col("o_orderkey") % 26, LongType()), "s": convert.to_safe_string(F.nullif(F.col("o_orderstatus"), F.lit("F")))},
    "SELECT o_orderkey, CAST((o_orderkey + 128) % 256 - 128 AS INTEGER) AS b, 9 AS safe, chr(CAST(65 + o_orderkey % 26 AS INTEGER)) AS c, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS s FROM orders",
)
_columns(
    "convert_types",
    "customer",
    lambda: {"c_custkey": F.col("c_custkey"), "code": convert.type_code("c_acctbal"), "text_code": convert.type_code("c_name"), "decimal_code": convert.type_code(F.col("c_acctbal").cast("decimal(12,2)")), "n": F.size(convert.to_list("c_name", _TEXT)).cast("long"), "path": paths.normalise(F.concat(F.lit("/a/"), F.col("c_name"), F.lit("//")))},
    "SELECT c_custkey, 7 AS code, 1 AS text_code, 0 AS decimal_code, CAST(1 AS BIGINT) AS n, 'a/' || c_name AS path FROM customer",
)
def _wild(pattern: str) -> dict[str, Column]:
    got = strings.wild_start("p_name", pattern)
    return {"p_partkey": F.col("p_partkey"), **{c: got[c] for c in ("found", "last_matched", "exactly_matched", "last_consecutive")}}


_columns(
    "wild_start_lengths",
    "part",
    lambda: _wild("??*[aeiou]*n"),
    "SELECT p_partkey, hit AS found, CASE WHEN hit THEN CAST(length(p_name) AS INTEGER) ELSE -1 END AS last_matched, CASE WHEN hit THEN 4 ELSE -1 END AS exactly_matched, CASE WHEN hit THEN 2 ELSE 0 END AS last_consecutive FROM (SELECT p_partkey, p_name, regexp_full_match(p_name, '(?s)...*[aeiou].*n') AS hit FROM part)",
)
_columns(
    "wild_start_prefix",
    "part",
    lambda: _wild("?[a-m]"),
    "SELECT p_partkey, hit AS found, CASE WHEN hit THEN 2 ELSE -1 END AS last_matched, CASE WHEN hit THEN 2 ELSE -1 END AS exactly_matched, CASE WHEN hit THEN 2 ELSE 0 END AS last_consecutive FROM (SELECT p_partkey, regexp_matches(p_name, '^.[a-m]') AS hit FROM part)",
)
_columns(
    "convert_formats",
    "customer",
    lambda: {"c_custkey": F.col("c_custkey"), "money": convert.format_money("c_acctbal"), "plain": convert.format_plain("c_acctbal"), "f": convert.to_float(F.col("c_acctbal").cast("string"), _TEXT).cast("double")},
    "SELECT c_custkey, CASE WHEN abs(c_acctbal) < 1 THEN replace(format('{:,.2f}', CAST(c_acctbal AS DOUBLE)), '0.', '.') ELSE format('{:,.2f}', CAST(c_acctbal AS DOUBLE)) END AS money, CASE WHEN abs(c_acctbal) < 1 THEN replace(format('{:.3f}', CAST(c_acctbal AS DOUBLE)), '0.', '.') ELSE format('{:.3f}', CAST(c_acctbal AS DOUBLE)) END AS plain, CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) AS f FROM customer",
)


# ---------------------------------------------------------------- sessions of a store
def _stored(spark: SparkSession, sf_dir: str) -> ItemStore:
    """Customers in a store, then every fifth gone and every third renamed, in three commits."""
    store = ItemStore(spark, new_folder(spark, "store"))
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey")).alias(ID), F.lit("customer").alias(KIND), F.col("c_name").alias("name"), "c_custkey")
    for change in (lambda t: t.store(people), lambda t: t.delete(people.filter("c_custkey % 5 = 0")), lambda t: t.store(people.filter("c_custkey % 3 = 0").withColumn("name", F.lit("new")))):
        with store.begin() as session:
            change(session)
            session.commit()
    return store


_STORED = "SELECT 'customer/' || c_custkey AS \"__ID__\", CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0"


@_add("store_commit_roundtrip", _STORED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).begin(READONLY).frame().select(ID, "name")


@_add("store_clean_up", _STORED)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    store.clean_up()
    return store.begin(READONLY).frame().select(ID, "name")


@_add(
    "flagship",
    "SELECT 'customer/' || c_custkey AS \"__ID__\", c_name AS name, c_acctbal AS balance FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a kind by two properties, the richest first."""
    df = items.items_of(table(spark, sf_dir, "customer"), "customer", F.concat(F.lit("customer/"), F.col("c_custkey")))
    q = Query().where(P.kind("customer") & P.eq("c_mktsegment", "BUILDING") & P.gt("c_acctbal", 0.0)).order_by("c_acctbal", Direction.DESCENDING)
    return q.prepare(df).df().select(ID, F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
