"""Registered queries of the engine's own operators and their SQL for another engine.

SHARED holds statements that both engines read alike; PAIRS those that need an operator or other syntax here. Computed columns
are cast on both sides. Queries run over whole tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import Catalog, Keyspace, Node, Pin, Relation, even_chunks, even_ranges
from tessera.functions import compat
from tessera.operators import advisor, exact, joins, reshard
from tessera.plans.engine import Engine
from tessera.streaming import streams

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "embeddings", "pages", "benchmark"]
NODES = (1, 2, 3)


def sample_catalog() -> Catalog:
    """The catalog of the test tables: four key spaces over three nodes."""
    space = lambda name, seed, **more: Keyspace(name, "bigint", seed, even_ranges(24, list(NODES)), chunks=even_chunks(64), **more)
    spaces = [space("order", 1), space("cust", 2, pins=(Pin("42", 3), Pin("7", 1))), space("user", 3, second_type="bigint"), space("doc", 4), space("conv", 5)]
    of = {"orders": ("order", "o_orderkey", None), "lineitem": ("order", "l_orderkey", None), "customer": ("cust", "c_custkey", None), "events": ("user", "user_id", "event_id"), "documents": ("doc", "doc_id", None), "labels": ("doc", "doc_id", None), "conversations": ("conv", "conv_id", None)}
    relations = {t: Relation(t, "sharded", *k) for t, k in of.items()} | {t: Relation(t, "reference") for t in ("region", "nation")}
    catalog = Catalog(1, tuple(Node(i, f"node{i}", home=i == 1) for i in NODES), {k.name: k for k in spaces}, relations)
    catalog.validate()
    return catalog


def engine(spark: SparkSession, sf_dir: str, tables: list[str] = TABLES) -> Engine:
    out = Engine(spark, sample_catalog())
    out.register(sf_dir, tables)
    return out


def _sql(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    named = [t for t in TABLES if re.search(rf"\b{t}\b", statement)]
    return lambda spark, sf_dir: engine(spark, sf_dir, named).sql(statement)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


D = "decimal(38,2)"
MONEY = "cast(o_totalprice as decimal(18,2))"
SHARED = {
    # key lookups
    "pin_eq": "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 100",
    "pin_in": "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey in (1, 7, 100, 2001, -5)",
    "pin_null": "select o_orderkey, o_custkey from orders where o_orderkey is null",
    "pin_between": "select o_orderkey, o_custkey from orders where o_orderkey between 100 and 250",
    "pin_or": "select o_orderkey, o_custkey from orders where o_orderkey = 5 or o_custkey = 10",
    "pin_contradiction": "select o_orderkey from orders where o_orderkey = 5 and o_orderkey = 6",
    "pin_join": "select o_orderkey, l_linenumber, l_partkey, l_suppkey from orders join lineitem on o_orderkey = l_orderkey where o_orderkey = 100",
    "filter_like": "select c_custkey, c_name from customer where c_name like '%7%' and c_mktsegment in ('BUILDING', 'MACHINERY')",
    "filter_case": "select o_orderkey, case when o_orderstatus = 'F' then 'done' when o_orderstatus = 'O' then 'open' else 'other' end as state from orders where not (o_totalprice < 100000)",
    # aggregates
    "agg_count": "select count(*) as n, count(o_custkey) as n_cust, count(nullif(o_orderstatus, 'F')) as n_not_f from orders",
    "agg_minmax": "select min(o_orderkey) as lo, max(o_orderkey) as hi, min(o_orderpriority) as p_lo, max(o_orderpriority) as p_hi, min(cast(o_orderdate as date)) as d_lo, max(cast(o_orderdate as date)) as d_hi from orders",
    "agg_bool": "select o_orderstatus, bool_and(o_totalprice > 1000) as all_big, bool_or(o_totalprice > 400000) as any_big from orders group by o_orderstatus",
    "agg_empty": f"select count(*) as n, cast(sum({MONEY}) as {D}) as total, max(o_orderkey) as hi from orders where o_orderkey < -1",
    "agg_filter": f"select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as n_f, cast(sum({MONEY}) filter (where o_orderstatus = 'O') as {D}) as open_total from orders group by o_orderpriority",
    "group_by_status": f"select o_orderstatus, count(*) as n, cast(sum({MONEY}) as {D}) as total from orders group by o_orderstatus",
    "group_by_hidden": "select count(*) as n from orders group by o_orderpriority, o_orderstatus",
    "group_by_expr": "select cast(extract(year from o_orderdate) as bigint) as y, count(*) as n from orders group by extract(year from o_orderdate)",
    "group_by_position": "select o_orderpriority, count(*) as n from orders group by 1",
    "group_by_reference": "select r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name",
    "having_count": "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12",
    "having_avg": f"select o_custkey, count(*) as n from orders group by o_custkey having sum({MONEY}) > 200000 * count(*)",
    "order_by_agg": "select o_custkey, count(*) as n from orders group by o_custkey order by count(*) desc, o_custkey limit 25",
    "agg_distinct": "select count(distinct l_partkey) as parts, count(distinct l_suppkey) as supps, count(*) as n from lineitem",
    "agg_distinct_grouped": "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_shipdate) as days from lineitem group by l_returnflag",
    "sum_avg_distinct": "select l_linestatus, cast(sum(distinct cast(l_quantity as decimal(18,2))) as decimal(38,2)) as s, cast(count(distinct l_quantity) as bigint) as n from lineitem group by l_linestatus",
    "agg_stddev": "select l_returnflag, round(stddev_samp(l_quantity), 6) as sd, round(var_pop(l_quantity), 6) as v from lineitem group by l_returnflag",
    "agg_corr": "select l_linestatus, round(corr(l_quantity, l_extendedprice), 6) as c, round(regr_slope(l_extendedprice, l_quantity), 4) as slope from lineitem group by l_linestatus",
    "agg_bits": "select o_orderstatus, bit_and(o_custkey) as a, bit_or(o_custkey) as o, bit_xor(o_custkey) as x from orders group by o_orderstatus",
    "agg_percentile": "select l_returnflag, round(percentile_cont(0.5) within group (order by l_extendedprice), 4) as med, percentile_disc(0.9) within group (order by l_quantity) as p90 from lineitem group by l_returnflag",
    "rollup": "select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) as bigint) as g1, cast(grouping(l_linestatus) as bigint) as g2 from lineitem group by rollup(l_returnflag, l_linestatus)",
    "cube": "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube(l_returnflag, l_linestatus)",
    "grouping_sets": "select l_returnflag, l_linenumber, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linenumber), ())",
    "nested_group_by_key": "select n, count(*) as orders_with_n from (select l_orderkey, count(*) as n from lineitem group by l_orderkey) t group by n",
    "nested_distinct": "select count(*) as n from (select distinct o_custkey, o_orderstatus from orders) t",
    "nested_limit": "select count(*) as n, min(o_orderkey) as lo from (select o_orderkey from orders order by o_totalprice desc nulls last, o_orderkey limit 100) t",
    # order, limit, distinct
    "topk": "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 20",
    "topk_offset": "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 20 offset 30",
    "order_nulls": "select o_orderkey, nullif(o_orderstatus, 'F') as s from orders order by nullif(o_orderstatus, 'F') asc nulls first, o_orderkey limit 50",
    "distinct_rows": "select distinct o_orderstatus, o_orderpriority from orders",
    "distinct_pairs": "select count(*) as n from (select distinct l_partkey, l_suppkey from lineitem) t",
    "distinct_order_limit": "select distinct l_shipdate from lineitem order by l_shipdate limit 30",
    # joins
    "join_colocated_pinned": "select l_linenumber, l_partkey, l_suppkey, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey where l_orderkey = 257",
    "join_colocated_agg": "select o_orderpriority, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as decimal(38,2)) as q from orders join lineitem on o_orderkey = l_orderkey group by o_orderpriority",
    "join_left_colocated": "select count(*) as n, count(l.quality) as labelled from documents d left join labels l on d.doc_id = l.doc_id",
    "join_right_colocated": "select count(*) as n, count(l.doc_id) as labelled from labels l right join documents d on d.doc_id = l.doc_id",
    "join_full_colocated": "select count(*) as n, count(o.o_orderkey) as a, count(t.k) as b from orders o full join (select l_orderkey * 2 as k, count(*) as c from lineitem group by l_orderkey) t on o.o_orderkey = t.k",
    "join_reference": "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9000",
    "join_global": "select p_brand, count(*) as n from lineitem join part on l_partkey = p_partkey group by p_brand",
    "join_nonkey": "select s_name, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey group by s_name",
    "join_other_keyspace": f"select c_mktsegment, count(*) as n, cast(sum({MONEY}) as {D}) as total from orders join customer on o_custkey = c_custkey group by c_mktsegment",
    "join_theta_self": "select count(*) as n from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey",
    "join_cross": "select count(*) as n, min(r_name) as lo, max(n_name) as hi from region cross join nation",
    "join_comma": "select r_name, count(*) as n from nation, region where n_regionkey = r_regionkey group by r_name",
    "join_using": "select count(*) as n, cast(sum(l.toxic) as bigint) as toxic from documents join labels l using (doc_id)",
    "join_natural": "select count(*) as n from documents natural join (select doc_id, quality from labels) t",
    "join_three": "select n_name, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name",
    "semi_exists": "select count(*) as n from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_quantity > 45)",
    "semi_in": "select count(*) as n from documents where doc_id in (select doc_id from labels where quality = 1)",
    "anti_not_exists": "select count(*) as n, min(o_orderkey) as lo from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)",
    "anti_not_in": "select count(*) as n from documents where doc_id not in (select doc_id from labels)",
    "anti_not_in_null": "select count(*) as n from nation where n_nationkey not in (select nullif(r_regionkey, 3) from region)",
    "scalar_correlated": "select count(*) as n from lineitem l where l.l_quantity > (select avg(x.l_quantity) from lineitem x where x.l_partkey = l.l_partkey)",
    "scalar_avg_filter": "select count(*) as n from orders where o_totalprice > (select avg(o_totalprice) from orders)",
    "cte_single": "with big as (select o_orderkey, o_custkey from orders where o_totalprice > 300000) select o_custkey, count(*) as n from big group by o_custkey",
    "cte_recursive": "with recursive t(n) as (select 1 union all select n + 1 from t where n < 50) select cast(sum(n) as bigint) as s, count(*) as c from t",
    "values_join": "select v.s, count(*) as n from (values ('F'), ('O'), ('X')) as v(s) left join orders on o_orderstatus = v.s group by v.s",
    # windows
    "win_rank": "select o_orderkey, cast(rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as r from orders",
    "win_dense_rank": "select o_orderkey, cast(dense_rank() over (partition by o_orderstatus order by o_orderpriority) as bigint) as r from orders",
    "win_row_number": "select o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as rn from orders",
    "win_sum": f"select o_orderkey, cast(sum({MONEY}) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row) as {D}) as running from orders",
    "win_lag": "select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as prev, lead(o_orderkey, 2) over (partition by o_custkey order by o_orderkey) as next2 from orders",
    "win_ntile": "select c_custkey, cast(ntile(4) over (partition by c_nationkey order by c_acctbal, c_custkey) as bigint) as q from customer",
    "win_first_last": "select o_orderkey, first_value(o_orderkey) over w as f, last_value(o_orderkey) over w as l, nth_value(o_orderkey, 2) over w as second from orders window w as (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following)",
    "win_distribution": "select c_custkey, round(percent_rank() over (partition by c_mktsegment order by c_custkey), 9) as pr, round(cume_dist() over (partition by c_mktsegment order by c_custkey), 9) as cd from customer",
    "win_partition_key": "select l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) over (partition by l_orderkey) as lines from lineitem",
    "win_range_interval": "select event_id, count(*) over (partition by user_id order by ts range between interval '1' day preceding and current row) as last_day from events",
    "win_in_subquery": "select count(*) as n from (select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) t where rn = 1",
    # set operations
    "union_distinct": "select o_custkey as k from orders union select c_custkey from customer",
    "union_all": "select count(*) as n from (select o_orderkey as k from orders union all select l_orderkey from lineitem) t",
    "intersect": "select o_custkey as k from orders intersect select c_custkey from customer where c_acctbal > 5000",
    "intersect_all": "select l_linenumber as k from lineitem where l_orderkey < 500 intersect all select cast(o_custkey % 7 as int) from orders where o_orderkey < 300",
    "except": "select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'F'",
    "except_all": "select l_linenumber as k from lineitem where l_orderkey < 500 except all select cast(o_custkey % 7 as int) from orders where o_orderkey < 100",
    # scalars
    "json_props": "select event_id, event_type from events where value > 90",
    "scalar_text": "select c_custkey, upper(c_name) as u, lower(c_name) as l, cast(length(c_name) as bigint) as n, substring(c_name, 3, 5) as s, replace(c_name, '0', 'o') as r, trim(concat('  ', c_name, ' ')) as t, lpad(c_name, 25, '*') as p, reverse(c_name) as rev, repeat('ab', 2) as rep, md5(c_name) as h, split_part(c_name, '#', 2) as sp, translate(c_name, '012', 'abc') as tr, ascii(c_name) as a from customer",
    "scalar_numbers": "select o_orderkey, abs(-o_custkey) as a, round(o_totalprice / 7, 2) as r, cast(floor(o_totalprice) as bigint) as f, cast(ceil(o_totalprice) as bigint) as c, mod(o_custkey, 7) as m, round(sqrt(o_totalprice), 6) as sq, round(ln(o_totalprice), 6) as l, cast(sign(o_totalprice - 100000) as double) as sg, round(power(o_custkey, 2), 0) as pw, greatest(o_orderkey, o_custkey) as g, least(o_orderkey, o_custkey) as le from orders",
    "scalar_dates": "select o_orderkey, cast(extract(year from o_orderdate) as bigint) as y, cast(extract(month from o_orderdate) as bigint) as m, cast(extract(day from o_orderdate) as bigint) as d, cast(date_trunc('month', o_orderdate) as date) as mon, make_date(2001, 2, 3) as md from orders",
    "scalar_null": "select o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') as c, nullif(o_custkey, 10) as n, o_custkey is distinct from 10 as d from orders",
}


def _duck_slot(source: str, key: str, seed: int) -> str:
    """The slot of a bigint key in plain SQL: a nested select for each round of the hash."""
    from tessera.functions import slots as s

    x = [(s.START + 4) & s.MASK] * 3
    if seed:
        x = s._mix(s._Ints, [s._Ints.add(x[0], seed >> 32), s._Ints.add(x[1], seed & s.MASK), x[2]])
    m = str(s.MASK)
    inner = f"select *, ({x[0]} + xor({key} & {m}, case when {key} >= 0 then ({key} >> 32) & {m} else xor(({key} >> 32) & {m}, {m}) end)) & {m} as wa, {x[1]}::bigint as wb, {x[2]}::bigint as wc from {source}"
    for i, k in enumerate(s.FINAL):
        own, before = "abc"[(i + 2) % 3], "abc"[(i + 1) % 3]
        rot = f"(((w{before} << {k}) & {m}) | (w{before} >> {32 - k}))"
        inner = f"select * replace ((xor(w{own}, w{before}) - {rot}) & {m} as w{own}) from ({inner})"
    return f"select * exclude (wa, wb, wc), (case when wb >= 2147483648 then wb - 4294967296 else wb end) * 4294967296 + wc as slot from ({inner})"


def _duck_ranges(ks: Keyspace) -> str:
    return "(values " + ", ".join(f"({r.lo}::hugeint, {r.hi}::hugeint, {r.node})" for r in ks.ranges) + ") as r(lo, hi, node)"


def _duck_owner(source: str, key: str, ks: Keyspace) -> str:
    pins = "".join(f" when {key} = {p.value} then {p.node}" for p in ks.pins)
    return f"select s.*, case{pins or ' when false then 0'} else node end as owner, cast((slot::hugeint + 9223372036854775808) // 288230376151711744 as int) as chunk_no from ({_duck_slot(source, key, ks.seed)}) s join {_duck_ranges(ks)} on slot between lo and hi"


_CATALOG = sample_catalog()
_ORDER, _CUST = _CATALOG.keyspaces["order"], _CATALOG.keyspaces["cust"]
_OWNED = _duck_owner("orders", "o_orderkey", _ORDER)
_LINES = _duck_owner("lineitem", "l_orderkey", _ORDER)


def slot_of_key(spark, sf_dir):
    return engine(spark, sf_dir, ["orders"]).owners("orders").select("o_orderkey", "slot")


def owner_of_key(spark, sf_dir):
    return engine(spark, sf_dir, ["orders"]).owners("orders").select("o_orderkey", "owner", "chunk_no")


def rows_per_owner(spark, sf_dir):
    return engine(spark, sf_dir, ["lineitem"]).owners("lineitem").groupBy("owner").agg(F.count("*").alias("n"))


def rows_per_chunk(spark, sf_dir):
    return engine(spark, sf_dir, ["lineitem"]).owners("lineitem").groupBy("chunk_no").agg(F.count("*").alias("n"))


def pinned_owner(spark, sf_dir):
    return engine(spark, sf_dir, ["customer"]).owners("customer").select("c_custkey", "owner")


def owns_rows(spark, sf_dir):
    e = engine(spark, sf_dir, ["customer"])
    owned = [e.spark.table("customer").filter(_CUST.owns_column(n, F.col("c_custkey"))).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("s")).select(F.lit(n).alias("node"), "n", "s") for n in NODES]
    return owned[0].union(owned[1]).union(owned[2])


def second_key_spread(spark, sf_dir):
    """Nodes that hold rows of each user when the second key spreads them."""
    return engine(spark, sf_dir, ["events"]).owners("events").groupBy("user_id").agg(F.countDistinct("owner").alias("nodes"), F.count("*").alias("n"))


def hot_keys(spark, sf_dir):
    return advisor.hot_keys(table(spark, sf_dir, "events"), "user_id", 10)


def skew_by_range(spark, sf_dir):
    return advisor.rows_by_range(engine(spark, sf_dir, ["lineitem"]), "lineitem").select("range_no", "owner", "n")


def split_bound(spark, sf_dir):
    return advisor.split_bounds(engine(spark, sf_dir, ["lineitem"]), "lineitem").select("range_no", "bound")


def verify_rows(spark, sf_dir):
    return reshard.verify(engine(spark, sf_dir, ["orders"]), "orders").select("owner", "n_owned", "n_foreign")


def agg_sum_float_as_decimal(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(exact.float_total(F.col("l_extendedprice")).cast("decimal(38,2)").alias("total"))


def avg_decimal(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(exact.dec_sum(F.col("l_quantity")).alias("s"), F.count("*").alias("n"), exact.dec_avg(F.col("l_quantity"), digits=10).cast("double").alias("a"))


def topk_with_ties(spark, sf_dir):
    return exact.with_ties(table(spark, sf_dir, "part").select("p_partkey", "p_size"), 25, ("p_size", True))


def distinct_on(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return exact.distinct_on(orders, ["o_custkey"], ("o_orderkey", True))


def string_agg(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(exact.ordered_string_agg("n_name", ", ").alias("names"))


def array_agg_sorted(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_nationkey")), ",").alias("ks"))


def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def array_member(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(exact.is_member(F.col("o_orderstatus"), F.array(F.lit("F"), F.lit("P")))).agg(F.count("*").alias("n"))


def enum_order(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    rank = exact.ranked(parts, "o_orderpriority", ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"])
    return parts.select("o_orderkey", rank.cast("bigint").alias("r"))


def join_broadcast(spark, sf_dir):
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    joined = joins.join(lines.withColumnRenamed("l_partkey", "p_partkey").select("p_partkey"), part.select("p_partkey", "p_type"), ["p_partkey"])
    return joined.groupBy("p_type").agg(F.count("*").alias("n"))


def join_repartition(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return joins.join(lines, orders, ["k"], strategy="repartition").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


def join_salted(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    users = events.groupBy("user_id").agg(F.max("event_id").alias("last"))
    hot = advisor.hot_keys(events, "user_id", 5).select("user_id")
    return joins.salted_join(events, users, ["user_id"], 8, hot).agg(F.count("*").alias("n"), F.sum("last").alias("s"))


def not_in_operator(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "region").select("r_regionkey")
    return joins.not_in(nation, region, "n_nationkey", "r_regionkey")


def range_series(spark, sf_dir):
    return spark.sql("select explode(sequence(1, 20, 3)) as g")


def lateral_join(spark, sf_dir):
    return engine(spark, sf_dir, ["region", "nation"]).sql("select r_name, x.n from region, lateral (select count(*) as n from nation where n_regionkey = r_regionkey) x")


def upsert_rows(spark, sf_dir):
    """The table after an upsert of changed and new rows."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    changes = base.filter("c_custkey <= 100").select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"))
    return reshard.upsert(base, changes, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("s"))


def update_rows(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    changed = reshard.update(base, F.col("c_nationkey") < 5, {"c_mktsegment": F.lit("MOVED")}, key="c_custkey")
    return changed.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def delete_rows(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("s"))
    return reshard.delete(base, F.col("s") == "F").agg(F.count("*").alias("n"), F.count("s").alias("filled"))


def replayed_changes(spark, sf_dir):
    """A table after a log of changes with repeated and deleted keys."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    log = base.filter("c_custkey <= 300").select("c_custkey", F.lit("LATER").alias("c_mktsegment"), (F.col("c_custkey") % 3).alias("seq"), F.expr("case when c_custkey % 3 = 2 then 'delete' else 'upsert' end").alias("op"))
    log = log.union(log.select("c_custkey", F.lit("FIRST"), F.lit(-1).cast("bigint"), F.lit("upsert")))
    return streams.replayed(base, log, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("s"))


def event_windows(spark, sf_dir):
    return streams.window_counts(table(spark, sf_dir, "events"), "1 day").select(F.to_date("start").alias("day"), "event_type", "n")


def date_bins(spark, sf_dir):
    start = compat.date_bin(6 * 3600, F.col("ts"), F.lit("2000-01-01").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy(start.cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"))


def compat_text(spark, sf_dir):
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", compat.strpos(c, F.lit("#")).cast("bigint").alias("at"), compat.starts_with(c, F.lit("Cust")).alias("starts"), compat.left(c, -3).alias("l"), compat.right(c, 4).alias("r"),
        compat.regexp_replace_first(c, "0", "_").alias("one"), compat.to_hex(F.col("c_custkey")).alias("hex"), compat.concat_skip_nulls(c, F.lit(None).cast("string"), F.lit("!")).alias("con"), compat.dow(F.lit("2024-03-03").cast("date")).cast("bigint").alias("dow"))


def user_aggregate(spark, sf_dir):
    """An aggregate of one's own, by Arrow batches of a group."""

    @F.pandas_udf("bigint")
    def spread(x: pd.Series) -> int:
        return int(x.max() - x.min())

    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(spread(F.col("o_custkey")).alias("spread"))


def table_sample(spark, sf_dir):
    """TABLESAMPLE with a seed."""
    return table(spark, sf_dir, "lineitem").sample(fraction=0.1, seed=7).agg(F.count("*").alias("n"))


PAIRS: dict[str, tuple[Callable, str]] = {
    "slot_of_key": (slot_of_key, f"select o_orderkey, cast(slot as bigint) as slot from ({_duck_slot('orders', 'o_orderkey', 1)})"),
    "owner_of_key": (owner_of_key, f"select o_orderkey, owner, chunk_no from ({_OWNED})"),
    "rows_per_owner": (rows_per_owner, f"select owner, count(*) as n from ({_LINES}) group by owner"),
    "rows_per_chunk": (rows_per_chunk, f"select chunk_no, count(*) as n from ({_LINES}) group by chunk_no"),
    "pinned_owner": (pinned_owner, f"select c_custkey, owner from ({_duck_owner('customer', 'c_custkey', _CUST)})"),
    "owns_rows": (owns_rows, f"select owner as node, count(*) as n, cast(sum(c_custkey) as bigint) as s from ({_duck_owner('customer', 'c_custkey', _CUST)}) group by owner"),
    "hot_keys": (hot_keys, "select user_id, n, round(n / total, 9) as share from (select user_id, count(*) as n, (select count(*) from events) as total from events where user_id is not null group by user_id) order by n desc, user_id limit 10"),
    "skew_by_range": (skew_by_range, f"select cast(least((slot::hugeint + 9223372036854775808) // {((1 << 64) - 1) // 24}, 23) as int) as range_no, owner, count(*) as n from ({_LINES}) group by all"),
    "split_bound": (split_bound, f"with s as (select cast(least((slot::hugeint + 9223372036854775808) // {((1 << 64) - 1) // 24}, 23) as int) as range_no, slot from ({_LINES})), o as (select range_no, slot, row_number() over (partition by range_no order by slot) as rn, count(*) over (partition by range_no) as c from s) select range_no, cast(min(slot) as bigint) as bound from o where rn >= ceil(c / 2.0) group by range_no"),
    "verify_rows": (verify_rows, f"select owner, count(*) as n_owned, cast(0 as bigint) as n_foreign from ({_OWNED}) group by owner"),
    "agg_sum_float_as_decimal": (agg_sum_float_as_decimal, "select l_returnflag, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(38,2)) as total from lineitem group by l_returnflag"),
    "avg_decimal": (avg_decimal, "select l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as decimal(38,2)) as s, count(*) as n, round(cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(*), 10) as a from lineitem group by l_linestatus"),
    "topk_with_ties": (topk_with_ties, "select p_partkey, p_size from (select p_partkey, p_size, rank() over (order by p_size desc nulls first) as r from part) where r <= 25"),
    "distinct_on": (distinct_on, "select distinct on (o_custkey) o_custkey, o_orderkey, o_orderstatus from orders order by o_custkey, o_orderkey desc"),
    "string_agg": (string_agg, "select n_regionkey, string_agg(n_name, ', ' order by n_name) as names from nation group by n_regionkey"),
    "array_agg_sorted": (array_agg_sorted, "select n_regionkey, array_to_string(list_sort(array_agg(n_nationkey)), ',') as ks from nation group by n_regionkey"),
    "json_extract": (json_extract, "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events"),
    "array_member": (array_member, "select count(*) as n from orders where o_orderstatus = any(['F', 'P'])"),
    "enum_order": (enum_order, "select o_orderkey, cast(case o_orderpriority when '5-LOW' then 0 when '4-NOT SPECIFIED' then 1 when '3-MEDIUM' then 2 when '2-HIGH' then 3 when '1-URGENT' then 4 end as bigint) as r from orders"),
    "join_broadcast": (join_broadcast, "select p_type, count(*) as n from lineitem join part on l_partkey = p_partkey group by p_type"),
    "join_repartition": (join_repartition, "select count(*) as n, cast(sum(o_orderkey) as bigint) as s from lineitem join orders on l_partkey = o_custkey"),
    "join_salted": (join_salted, "select count(*) as n, cast(sum(last) as bigint) as s from events join (select user_id, max(event_id) as last from events group by user_id) u using (user_id)"),
    "not_in_operator": (not_in_operator, "select n_nationkey from nation where n_nationkey not in (select r_regionkey from region)"),
    "range_series": (range_series, "select cast(g as int) as g from generate_series(1, 20, 3) t(g)"),
    "lateral_join": (lateral_join, "select r_name, (select count(*) from nation where n_regionkey = r_regionkey) as n from region"),
    "update_rows": (update_rows, "select case when c_nationkey < 5 then 'MOVED' else c_mktsegment end as c_mktsegment, count(*) as n from customer group by 1"),
    "delete_rows": (delete_rows, "select count(*) as n, count(nullif(o_orderstatus, 'P')) as filled from orders where nullif(o_orderstatus, 'P') is distinct from 'F'"),
    "replayed_changes": (replayed_changes, "select case when c_custkey <= 300 then 'LATER' else c_mktsegment end as c_mktsegment, count(*) as n, cast(sum(c_custkey) as bigint) as s from customer where not (c_custkey <= 300 and c_custkey % 3 = 2) group by 1"),
    "event_windows": (event_windows, "select cast(ts as date) as day, event_type, count(*) as n from events group by all"),
    "date_bins": (date_bins, "select time_bucket(interval '6 hours', ts, timestamp '2000-01-01') as start, count(*) as n from events group by all"),
    "compat_text": (compat_text, "select c_custkey, strpos(c_name, '#') as at, starts_with(c_name, 'Cust') as starts, left(c_name, -3) as l, right(c_name, 4) as r, regexp_replace(c_name, '0', '_') as one, lower(to_hex(c_custkey)) as hex, concat(c_name, null, '!') as con, date_part('dow', date '2024-03-03') as dow from customer"),
    "user_aggregate": (user_aggregate, "select o_orderpriority, max(o_custkey) - min(o_custkey) as spread from orders group by o_orderpriority"),
    "upsert_rows": (upsert_rows, "with ch as (select c_custkey * 2 as k from customer where c_custkey <= 100), m as (select c_custkey, case when c_custkey in (select k from ch) then 'NEW' else c_mktsegment end as c_mktsegment from customer union all select k, 'NEW' from ch where k not in (select c_custkey from customer)) select c_mktsegment, count(*) as n, cast(sum(c_custkey) as bigint) as s from m group by c_mktsegment"),
}
#: Queries that plain SQL of another engine can't express: tests hold the first against the one-value hash; samples differ by engine.
ALONE = {"second_key_spread": second_key_spread, "table_sample": table_sample}

QUERIES = {k: _sql(v) for k, v in SHARED.items()} | {k: f for k, (f, _) in PAIRS.items()} | ALONE
ORACLE = dict(SHARED) | {k: s for k, (_, s) in PAIRS.items()}
