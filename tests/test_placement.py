import pytest
from pyspark.sql import functions as F

from tessera.catalog import LEAST, MOST, Catalog, CatalogError, Chunk, Keyspace, Node, Pin, Range, Relation, even_chunks, even_ranges, halved
from tessera.errors import Refusal
from tessera.operators import advisor, joins, reshard
from tessera.plans.engine import Engine, read_only, statement_kind
from tessera.queries import SHARED, engine, sample_catalog

SF = "/root/testdata/sf0.001"


def test_ranges_and_chunks_cover_all_slots():
    for n in (1, 3, 24, 1000):
        r = even_ranges(n, [1, 2, 3])
        assert r[0].lo == LEAST and r[-1].hi == MOST and all(a.hi + 1 == b.lo for a, b in zip(r, r[1:]))
    c = even_chunks(64)
    assert c[0].lo == LEAST and c[-1].hi == MOST
    lower, upper = halved(Chunk(5, 0, 9), 64)
    assert (lower, upper) == (Chunk(5, 0, 4), Chunk(64, 5, 9))
    with pytest.raises(CatalogError):
        even_chunks(48)


def test_validation():
    ok = sample_catalog()
    ks = ok.keyspaces["order"]
    for bad in (Keyspace("x", "bigint", 1, ks.ranges[:-1]), Keyspace("x", "bigint", 1, (Range(LEAST, MOST, 9),)), Keyspace("x", "bigint", 1, ks.ranges, pins=(Pin("007", 1),)), Keyspace("x", "float", 1, ks.ranges), Keyspace("x", "bigint", 1, ks.ranges, strategy="list"), Keyspace("x", "bytea", 1, ks.ranges, pins=(Pin("a", 1),))):
        with pytest.raises(ValueError):
            ok.changed(keyspaces=ok.keyspaces | {"x": bad})
    with pytest.raises(CatalogError):
        ok.changed(relations=ok.relations | {"t": Relation("t", "sharded", "nowhere", "k")})


def test_catalog_file_round_trip_and_race(spark, tmp_path):
    c = sample_catalog()
    c.save(spark, str(tmp_path / "cat"))
    assert Catalog.load(spark, str(tmp_path / "cat")) == c
    n = reshard.pin_key(c, "order", "0012", 2)
    n.save(spark, str(tmp_path / "cat"))
    assert Catalog.load(spark, str(tmp_path / "cat")).keyspaces["order"].owner(12) == 2
    with pytest.raises(CatalogError):
        reshard.pin_key(c, "order", 13, 1).save(spark, str(tmp_path / "cat"))


ROUTES = {
    "pin_eq": "node", "pin_null": "node", "pin_contradiction": "node", "pin_join": "node", "join_colocated_pinned": "node", "pin_between": "scatter", "pin_or": "scatter", "agg_count": "scatter", "agg_minmax": "scatter",
    "agg_distinct": "scatter", "having_count": "scatter", "topk": "scatter", "join_colocated_agg": "scatter", "join_left_colocated": "scatter", "join_reference": "scatter", "group_by_reference": "scatter", "semi_exists": "scatter",
    "join_global": "join", "join_nonkey": "join", "join_other_keyspace": "join", "win_rank": "join", "union_distinct": "join", "rollup": "join", "scalar_avg_filter": "join", "win_partition_key": "scatter", "join_theta_self": "home", "join_cross": "home", "nested_group_by_key": "scatter",
}


@pytest.mark.parametrize("name", sorted(ROUTES))
def test_routes(spark, name):
    assert engine(spark, SF).route(SHARED[name]).kind == ROUTES[name]


def test_pins_name_owner_and_chunk(spark):
    e = engine(spark, SF)
    ks = e.catalog.keyspaces["order"]
    r = e.route("select * from orders where o_orderkey = 100")
    assert r.nodes == (ks.owner(100),) and r.chunks == (ks.chunk_of_slot(ks.slot(100)),)
    r = e.route("select * from orders join lineitem on o_orderkey = l_orderkey where l_orderkey in (1, 2, 3)")
    assert set(r.nodes) == {ks.owner(v) for v in (1, 2, 3)}
    assert "Route: node" in e.explain("select * from orders where o_orderkey = 100")


def test_strict_mode_refuses_what_cannot_be_put_together(spark):
    e = Engine(spark, sample_catalog(), strict=True)
    e.register(SF, ["orders"])
    with pytest.raises(Refusal):
        e.sql("select o_orderstatus, stddev(o_totalprice) from orders group by o_orderstatus")
    assert e.sql("select o_orderkey, stddev(o_totalprice) as s from orders group by o_orderkey").count() > 0
    for statement in ("merge into orders using x on true", "begin", "call f()"):
        with pytest.raises(Refusal):
            e.sql(statement)


def test_statement_kinds():
    assert [statement_kind(s) for s in ("select 1", "WITH x as (select 1) select 1", "insert into t values (1)", "copy t from stdin", "create table t(a int)", "set x = 1", "commit")] == ["select", "select", "insert", "copy", "ddl", "session", "transaction"]
    assert read_only("select 1") and not read_only("delete from t")


def test_placed_tables_answer_alike_and_are_pruned(spark, tmp_path):
    e = engine(spark, SF)
    before = {k: sorted(map(str, e.sql(SHARED[k]).collect())) for k in ("pin_eq", "pin_in", "agg_count", "join_colocated_agg", "win_row_number", "topk")}
    for t in ("orders", "lineitem"):
        e.place(t, spark.read.parquet(f"{SF}/{t}.parquet"), str(tmp_path / t))
    assert before == {k: sorted(map(str, e.sql(SHARED[k]).collect())) for k in before}
    found = e.lookup("orders", 100)
    assert "PartitionFilters: [isnotnull(chunk_no" in found._jdf.queryExecution().toString() and found.count() == spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderkey = 100").count()
    with pytest.raises(Exception, match="is null"):
        e.place("orders", spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_orderkey", F.lit(None).cast("long")), str(tmp_path / "bad"))


def test_bucketed_tables_need_no_shuffle(spark):
    e = engine(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        o = e.bucketed("orders", spark.read.parquet(f"{SF}/orders.parquet"), 4)
        l = e.bucketed("lineitem", spark.read.parquet(f"{SF}/lineitem.parquet"), 4)
        joined = o.join(l, o.o_orderkey == l.l_orderkey).groupBy("o_orderkey").agg(F.count("*").alias("n"))
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.agg(F.sum("n")).first()[0] == l.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists orders_placed")
        spark.sql("drop table if exists lineitem_placed")


def test_join_strategies_agree(spark):
    a = spark.range(200).selectExpr("id % 17 as k", "id as x")
    b = spark.range(60).selectExpr("id % 13 as k", "id as y")
    want = sorted(map(str, a.join(b, ["k"]).collect()))
    for s in ("broadcast right", "broadcast left", "repartition", "colocated"):
        assert sorted(map(str, joins.join(a, b, ["k"], strategy=s).collect())) == want
    assert sorted(map(str, joins.salted_join(a, b, ["k"], 4).select("k", "x", "y").collect())) == want
    none = joins.Caps(broadcast_rows=0, repartition_bytes=0, gather_rows=0)
    with pytest.raises(Refusal):
        joins.join(a, b, ["k"], caps=none)


def test_resharding_keeps_every_slot_owned():
    c = sample_catalog()
    ks = c.keyspaces["order"]
    s = reshard.split_range(c, "order", ks.ranges[3].lo + 5, upper_to=2)
    m = reshard.move_range(s, "order", ks.ranges[0].lo, 3)
    assert m.keyspaces["order"].owner_of_slot(ks.ranges[0].lo) == 3 and m.keyspaces["order"].owner_of_slot(ks.ranges[3].lo + 6) == 2
    one = reshard.move_range(c, "order", ks.ranges[1].lo, ks.ranges[0].node)
    assert len(reshard.merge_ranges(one, "order", ks.ranges[0].lo).keyspaces["order"].ranges) == 23
    with pytest.raises(CatalogError):
        reshard.merge_ranges(c, "order", ks.ranges[0].lo)
    grown = reshard.scale(c, add=["node4"])
    counts = {n.id: sum(r.node == n.id for r in grown.keyspaces["order"].ranges) for n in grown.nodes}
    assert counts == {1: 6, 2: 6, 3: 6, 4: 6} and abs(reshard.moved_share(ks, grown.keyspaces["order"]) - 0.25) < 0.01
    drained = reshard.drain_node(grown, 2)
    gone = reshard.remove_node(drained, 2)
    assert all(r.node != 2 for k in gone.keyspaces.values() for r in k.ranges)
    with pytest.raises(CatalogError):
        reshard.remove_node(grown, 3)
    assert reshard.split_chunk(c, "order", 5).keyspaces["order"].chunks[-1].no == 64
    assert reshard.dissolve(c).relations == {}
    with pytest.raises(CatalogError):
        reshard.drop_keyspace(c, "order")


def test_verify_cleanup_and_writes(spark):
    e = engine(spark, SF)
    placed = e.owners("orders").withColumn("at", F.when(F.col("o_orderkey") % 10 == 0, F.lit(1)).otherwise(F.col("owner"))).drop("slot", "owner", "chunk_no")
    placed.createOrReplaceTempView("orders")
    rows = reshard.verify(e, "orders", "at").collect()
    kept = reshard.cleanup(e, "orders", "at")
    assert sum(r.n_foreign for r in rows) > 0 and kept.count() == sum(r.n_owned for r in rows)
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    assert sorted(map(tuple, reshard.upsert(base, spark.createDataFrame([(2, "x"), (9, "y")], "k int, v string"), ["k"]).collect()), key=str) == [(1, "a"), (2, "x"), (3, None), (9, "y")]
    assert {r.k: r.v for r in reshard.update(base, F.col("v") == "a", {"v": F.lit("z")}).collect()} == {1: "z", 2: "b", 3: None}
    assert [r.k for r in reshard.delete(base, F.col("v") == "a").orderBy("k").collect()] == [2, 3]
    with pytest.raises(CatalogError):
        reshard.update(base, F.lit(True), {"k": F.lit(1)}, key="k")


def test_rewrite_chunks_touches_only_them(spark, tmp_path):
    e = engine(spark, SF)
    path = str(tmp_path / "orders")
    e.place("orders", spark.read.parquet(f"{SF}/orders.parquet"), path)
    all_rows, in_five = spark.table("orders").count(), spark.table("orders").filter("chunk_no = 5").count()
    reshard.rewrite_chunks(e, "orders", path, lambda df: df.filter("o_orderkey % 2 = 0"), [5])
    left = spark.table("orders").filter("chunk_no = 5").count()
    assert left < in_five and spark.table("orders").count() == all_rows - in_five + left


def test_jobs_run_each_step_once(spark, tmp_path):
    ran = []
    steps = [reshard.Step(n, lambda n=n: ran.append(n)) for n in ("copy", "swap", "clean")]
    log = reshard.JobLog(spark, str(tmp_path / "jobs"))
    assert log.run("j1", steps[:2]) == ["copy", "swap"] and log.run("j1", steps) == ["clean"] and ran == ["copy", "swap", "clean"]


def test_advice():
    A = advisor.decide
    assert A("t", {1: 100, 2: 100}, [(0, 1, 100), (1, 2, 100)], {}) == []
    assert A("t", {1: 500, 2: 20}, [(0, 1, 500), (1, 2, 20)], {0: ("k", 10)})[0].what == "split"
    assert A("t", {1: 500, 2: 20}, [(0, 1, 500), (1, 2, 20)], {0: ("k", 400)})[0].what == "pin"
    assert A("t", {1: 500, 2: 20}, [(i, 1, 50) for i in range(10)] + [(10, 2, 20)], {})[0].what == "move"
    move = A("t", {1: 500, 2: 20}, [(i, 1, 50) for i in range(10)] + [(10, 2, 20)], {})
    assert advisor.next_step("on", move, []) == move[0] and advisor.next_step("off", move, []) is None
    assert advisor.next_step("on", move, [advisor.Job("x", "running")]) is None and advisor.next_step("on", move, [advisor.Job("x", "done", True, "t")]) is None


def test_stripes():
    assert reshard.stripe_sql("s", 5, 10_000) == "ALTER SEQUENCE s INCREMENT BY 1024 RESTART WITH 10245"
    assert reshard.stripe_sql("s", 5, 10_245).endswith("RESTART WITH 11269")
    assert (10245 - 5) % 1024 == 0


def test_nodes_are_found():
    assert Node(1, "a").state == "active"
