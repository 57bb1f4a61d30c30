"""The registered graph queries over the star schema, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.search import full_text, nearest
from ..operators.match import both, into, match, node, optional, out, p
from ..operators.record_graph import RecordGraph, has_label, of_versions, prop
from ..operators.relational import collect, group, order, union, unwind
from ..operators.versions import last_write
from ..sources import records
from ..sources.graph import Graph
from ..sources.tables import star_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a function of the graph under its name."""

    def add(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(star_graph(spark, sf_dir))
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def count_all() -> Column:
    return F.count(F.lit(1))


def one_row(g: Graph) -> DataFrame:
    return g.nodes["Region"].df.sparkSession.range(1).select()


# -- scans and predicates


@query("select n_nationkey k, n_name as name from nation")
def q01_label_scan(g: Graph) -> DataFrame:
    return match(g, node("n", "Nation")).select(p("n.n_nationkey").alias("k"), p("n.n_name").alias("name"))


@query("select (select count(*) from region) + (select count(*) from nation) c")
def q02_all_nodes(g: Graph) -> DataFrame:
    return g.scan("Region", "Nation").agg(count_all().alias("c"))


@query("select c_custkey k from customer where c_mktsegment is not distinct from 'BUILDING'")
def q03_prop_map(g: Graph) -> DataFrame:
    return match(g, node("c", "Customer", c_mktsegment="BUILDING")).select(p("c.c_custkey").alias("k"))


@query("select r_name as name from region")
def q04_prop_map_null(g: Graph) -> DataFrame:
    return match(g, node("n", "Region", missing=None)).select(p("n.r_name").alias("name"))


def _labelled(g: Graph, where: Column) -> DataFrame:
    """Documents with their label, if any, as far as a condition holds."""
    return optional(g, match(g, node("d", "Document")), node("d", "Document"), out("LABELLED"), node("x", "DocLabel")).filter(where)


@query("select d.doc_id k from documents d left join labels l using (doc_id) where l.quality is distinct from 1")
def q05_two_valued_not(g: Graph) -> DataFrame:
    return _labelled(g, S.not_(p("x.quality") == 1)).select(p("d.doc_id").alias("k"))


@query("select o_orderkey k from orders where o_orderstatus in ('F', 'P') and o_totalprice > 400000")
def q06_in_list(g: Graph) -> DataFrame:
    wanted = S.is_in(p("o.o_orderstatus"), F.array(F.lit("F"), F.lit("P"), F.lit(None)))
    return match(g, node("o", "Purchase"), where=wanted & (p("o.o_totalprice") > 400000)).select(p("o.o_orderkey").alias("k"))


@query("select count(*) c, count(l.doc_id) labelled from documents d left join labels l using (doc_id) where l.quality is null and d.lang is not null")
def q07_is_null(g: Graph) -> DataFrame:
    return _labelled(g, p("x.quality").isNull() & p("d.lang").isNotNull()).agg(count_all().alias("c"), F.count(p("x.id")).alias("labelled"))


# -- expansions


@query("select c_custkey c, n_name n from customer join nation on c_nationkey = n_nationkey")
def q08_expand_out(g: Graph) -> DataFrame:
    return match(g, node("c", "Customer"), out("IN_NATION"), node("n", "Nation")).select(p("c.c_custkey").alias("c"), p("n.n_name").alias("n"))


@query("select r_name r, count(n_nationkey) c from region join nation on n_regionkey = r_regionkey group by 1")
def q09_expand_in(g: Graph) -> DataFrame:
    return match(g, node("r", "Region"), into("IN_REGION"), node("n", "Nation")).groupBy(p("r.r_name").alias("r")).agg(F.count(p("n.id")).alias("c"))


@query("select count(*) c from nation")
def q10_undirected_once(g: Graph) -> DataFrame:
    return match(g, node(), both("IN_REGION", var="r"), node()).agg(count_all().alias("c"))


@query("select n_name a, r_name b from nation join region on n_regionkey = r_regionkey")
def q11_undirected_labelled(g: Graph) -> DataFrame:
    return match(g, node("a", "Nation"), both("IN_REGION"), node("b", "Region")).select(p("a.n_name").alias("a"), p("b.r_name").alias("b"))


@query("select 2 * count(*) c from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1")
def q12_undirected_both(g: Graph) -> DataFrame:
    return match(g, node("a", "Turn"), both("NEXT"), node("b", "Turn")).agg(count_all().alias("c"))


@query("select r_name region, count(*) c, min(o_totalprice) mn, max(o_totalprice) mx from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")
def q13_three_hop_agg(g: Graph) -> DataFrame:
    rows = match(g, node("o", "Purchase"), into("PLACED"), node("c", "Customer"), out("IN_NATION"), node("n", "Nation"), out("IN_REGION"), node("r", "Region"))
    price = p("o.o_totalprice")
    return rows.groupBy(p("r.r_name").alias("region")).agg(count_all().alias("c"), F.min(price).alias("mn"), F.max(price).alias("mx"))


@query("select 'IN_NATION' t, (select count(*) from customer) + (select count(*) from supplier) c union all select 'IN_REGION', (select count(*) from nation)")
def q14_multi_type(g: Graph) -> DataFrame:
    return match(g, node(), out("IN_NATION", "IN_REGION", var="r"), node()).groupBy(p("r.type").alias("t")).agg(count_all().alias("c"))


@query("select l_orderkey o, l_partkey p, l_quantity q from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' and p_size < 3")
def q15_rel_map(g: Graph) -> DataFrame:
    rows = match(g, node("o", "Purchase"), out("CONTAINS", var="l", l_returnflag="R"), node("p", "Part"), where=p("p.p_size") < 3)
    return rows.select(p("o.o_orderkey").alias("o"), p("p.p_partkey").alias("p"), p("l.l_quantity").alias("q"))


@query("select count(*) c from nation a join nation b on a.n_regionkey = b.n_regionkey")
def q16_homomorphic(g: Graph) -> DataFrame:
    return match(g, node("a", "Nation"), out("IN_REGION"), node("r"), into("IN_REGION"), node("b", "Nation")).agg(count_all().alias("c"))


@query("select a.n_name a, b.n_name b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def q17_theta(g: Graph) -> DataFrame:
    rows = match(g, node("a", "Nation"), out("IN_REGION"), node("r"), into("IN_REGION"), node("b", "Nation"), where=(p("a.id") != p("b.id")) & (p("a.n_nationkey") < p("b.n_nationkey")))
    return rows.select(p("a.n_name").alias("a"), p("b.n_name").alias("b"))


@query("select a.r_name a, b.r_name b from region a cross join region b")
def q18_cross(g: Graph) -> DataFrame:
    return match(g, node("b", "Region"), rows=match(g, node("a", "Region"))).select(p("a.r_name").alias("a"), p("b.r_name").alias("b"))


@query("select c_custkey c, o_orderkey o from customer left join orders on o_custkey = c_custkey and o_totalprice > 490000")
def q19_optional(g: Graph) -> DataFrame:
    rows = optional(g, match(g, node("c", "Customer")), node("c", "Customer"), out("PLACED"), node("o", "Purchase"), where=p("o.o_totalprice") > 490000)
    return rows.select(p("c.c_custkey").alias("c"), p("o.o_orderkey").alias("o"))


@query("select c_custkey c from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)")
def q20_optional_anti(g: Graph) -> DataFrame:
    rows = optional(g, match(g, node("c", "Customer")), node("c", "Customer"), out("PLACED"), node("o", "Purchase"), where=p("o.o_totalprice") > 450000)
    return group(rows, ["c"], F.count(p("o.id")).alias("n")).filter("n = 0").select(p("c.c_custkey").alias("c"))


# -- grouping


@query("select r_name region, count(distinct n_name) n from nation join region on n_regionkey = r_regionkey group by 1")
def q21_collect_distinct(g: Graph) -> DataFrame:
    rows = group(match(g, node("n", "Nation"), out("IN_REGION"), node("r", "Region")), ["r"], collect(p("n.n_name"), distinct=True).alias("names"))
    return rows.select(p("r.r_name").alias("region"), S.size(F.col("names"), "array").alias("n"))


@query("select r_name region, list_sort(list(n_name)) as names from nation join region on n_regionkey = r_regionkey group by 1")
def q22_collect(g: Graph) -> DataFrame:
    rows = match(g, node("n", "Nation"), out("IN_REGION"), node("r", "Region"))
    return rows.groupBy(p("r.r_name").alias("region")).agg(collect(p("n.n_name")).alias("names"))


@query("select o_custkey c, count(*) n from orders group by 1 having count(*) > 15")
def q23_having(g: Graph) -> DataFrame:
    rows = match(g, node("c", "Customer"), out("PLACED"), node("o", "Purchase"))
    return group(rows, ["c"], count_all().alias("n")).filter("n > 15").select(p("c.c_custkey").alias("c"), "n")


@query("select o_orderkey o, c_name c from (select * from orders order by o_totalprice desc, o_orderkey limit 10) join customer on o_custkey = c_custkey")
def q24_with_limit_expand(g: Graph) -> DataFrame:
    top = order(match(g, node("o", "Purchase")), ("o.o_totalprice", "desc"), "o.o_orderkey", limit=10)
    return match(g, node("c", "Customer"), out("PLACED"), node("o", "Purchase"), rows=top).select(p("o.o_orderkey").alias("o"), p("c.c_name").alias("c"))


@query("select distinct o_orderpriority p from orders")
def q25_distinct(g: Graph) -> DataFrame:
    return match(g, node("o", "Purchase")).select(p("o.o_orderpriority").alias("p")).distinct()


@query("select count(*) a, 0::bigint b, count(distinct o_custkey) c from orders")
def q26_counts(g: Graph) -> DataFrame:
    return match(g, node("o", "Purchase")).agg(count_all().alias("a"), F.count(F.lit(None)).alias("b"), F.countDistinct(p("o.o_custkey")).alias("c"))


@query("select count(*) c, max(o_totalprice) m from orders where o_orderkey < 0")
def q27_global_empty(g: Graph) -> DataFrame:
    return match(g, node("o", "Purchase"), where=p("o.o_orderkey") < 0).agg(count_all().alias("c"), F.max(p("o.o_totalprice")).alias("m"))


@query("select c_custkey k, c_acctbal b from customer order by c_acctbal desc nulls last, c_custkey limit 20 offset 5")
def q28_order_skip_limit(g: Graph) -> DataFrame:
    rows = match(g, node("c", "Customer")).select(p("c.c_custkey").alias("k"), p("c.c_acctbal").alias("b"))
    return order(rows, ("b", "desc"), "k", skip=5, limit=20)


@query("select c_nationkey k from customer union select s_nationkey from supplier")
def q29_union(g: Graph) -> DataFrame:
    return union(match(g, node("c", "Customer")).select(p("c.c_nationkey").alias("k")), match(g, node("s", "Supplier")).select(p("s.s_nationkey").alias("k")))


@query("select c_nationkey k from customer union all select s_nationkey from supplier")
def q30_union_all(g: Graph) -> DataFrame:
    return union(match(g, node("c", "Customer")).select(p("c.c_nationkey").alias("k")), match(g, node("s", "Supplier")).select(p("s.s_nationkey").alias("k")), all=True)


# -- lists and expressions


@query("select r_regionkey::bigint x, r_name as name from region where r_regionkey in (1, 2, 3)")
def q31_unwind(g: Graph) -> DataFrame:
    xs = unwind(one_row(g), F.array(*(F.lit(x).cast("long") for x in (1, 2, 3))), "x")
    return match(g, node("r", "Region")).join(xs, p("r.r_regionkey").eqNullSafe(F.col("x"))).select("x", p("r.r_name").alias("name"))


@query("select 'a' l, 'b' r, null::varchar missing union all select 'c', 'd', null")
def q32_unwind_pairs(g: Graph) -> DataFrame:
    pairs = unwind(one_row(g), F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit("d"))), "p")
    return pairs.select(S.at(F.col("p"), 0).alias("l"), S.at(F.col("p"), 1).alias("r"), S.at(F.col("p"), 9).alias("missing"))


@query("select case when p_size > 25 then 'big' else 'small' end s, count(*) c from part group by 1")
def q33_case(g: Graph) -> DataFrame:
    return match(g, node("p", "Part")).groupBy(F.when(p("p.p_size") > 25, "big").otherwise("small").alias("s")).agg(count_all().alias("c"))


@query("select r_name as name, (4 - r_regionkey)::bigint n from region")
def q34_list_comp(g: Graph) -> DataFrame:
    xs = S.comprehension(F.array(*(F.lit(x) for x in (1, 2, 3, 4))), lambda x: x > p("r.r_regionkey"), lambda x: x * 2)
    return match(g, node("r", "Region")).select(p("r.r_name").alias("name"), S.size(xs, "array").alias("n"))


@query("select n_nationkey k, n_name as name from nation")
def q35_map_literal(g: Graph) -> DataFrame:
    rows = match(g, node("n", "Nation")).select(F.struct(p("n.n_nationkey").alias("k"), p("n.n_name").alias("name")).alias("m"))
    return rows.select("m.k", "m.name")


@query("select p_partkey k, p_size / 2.0::double h, (p_size * 3 - 1)::bigint t from part")
def q36_arith(g: Graph) -> DataFrame:
    size = p("p.p_size").cast("long")
    return match(g, node("p", "Part")).select(p("p.p_partkey").alias("k"), S.divide(size, F.lit(2)).alias("h"), (size * 3 - 1).alias("t"))


@query("select n_name || '/' || n_regionkey::varchar s from nation")
def q37_plus_string(g: Graph) -> DataFrame:
    return match(g, node("n", "Nation")).select(S.plus(S.plus(p("n.n_name"), F.lit("/"), "string", "string"), S.to_string(p("n.n_regionkey")), "string", "string").alias("s"))


@query("select p_partkey k, upper(p_name) u, lower(p_type) l, replace(p_brand, 'Brand#', 'B') b, substring(p_name, 2, 3) s, length(p_name)::bigint n from part")
def q38_string_funcs(g: Graph) -> DataFrame:
    name = p("p.p_name")
    return match(g, node("p", "Part")).select(p("p.p_partkey").alias("k"), S.to_upper(name).alias("u"), S.to_lower(p("p.p_type")).alias("l"), S.replace(p("p.p_brand"), "Brand#", "B").alias("b"), S.substring(name, 1, 3).alias("s"), S.size(name, "string").alias("n"))


@query("select p_partkey k, string_split(p_name, ' ')[1] w, p_name t, p_name || ' ' lt, '  ' || p_name rt from part")
def q39_split_trim(g: Graph) -> DataFrame:
    name = p("p.p_name")
    padded = F.concat(F.lit("  "), name, F.lit(" "))
    return match(g, node("p", "Part")).select(p("p.p_partkey").alias("k"), S.at(S.split(name, " "), 0).alias("w"), S.trim(padded).alias("t"), S.ltrim(padded).alias("lt"), S.rtrim(padded).alias("rt"))


@query("select s, trunc(try_cast(s as double))::bigint i, try_cast(s as double) f from (values ('1'), ('1.9'), ('abc')) t(s)")
def q40_casts(g: Graph) -> DataFrame:
    rows = unwind(one_row(g), F.array(F.lit("1"), F.lit("1.9"), F.lit("abc")), "s")
    return rows.select("s", S.to_integer(F.col("s")).alias("i"), S.to_float(F.col("s")).alias("f"))


@query("select d.doc_id k, coalesce(l.quality, l.toxic, -1)::bigint v from documents d left join labels l using (doc_id)")
def q41_coalesce(g: Graph) -> DataFrame:
    value = F.coalesce(p("x.quality"), p("x.toxic"), F.lit(-1)).cast("long")
    return _labelled(g, F.lit(True)).select(p("d.doc_id").alias("k"), value.alias("v"))


@query("select 'Nation' l, count(*) c from nation")
def q42_labels_ids(g: Graph) -> DataFrame:
    return g.scan("Nation").groupBy(S.at(F.col("labels"), 0).alias("l")).agg(F.countDistinct("id").alias("c"))


# -- search


@query(
    "with s as (select q.vec_id as query, n.vec_id as id, round(list_cosine_similarity(n.embedding::double[], q.embedding::double[]), 9) as score from embeddings q, embeddings n where q.vec_id % 50 = 0), "
    "t as (select query, id, row_number() over (partition by query order by score desc, id) as place from s where score > 0.2) select query, id, place from t where place <= 10"
)
def q43_cosine_topk(g: Graph) -> DataFrame:
    vectors = lambda rows: rows.select(p("n.vec_id").alias("id"), p("n.embedding").alias("vector"))
    asked = match(g, node("n", "Item"), where=p("n.vec_id") % 50 == 0)
    return nearest(vectors(match(g, node("n", "Item"))), vectors(asked), k=10, above=0.2).select("query", "id", "place")


@query(
    "select p_partkey k, (contains(lower(p_name), 'red')::int + contains(lower(p_name), 'widget')::int) / 2.0::double score "
    "from part where contains(lower(p_name), 'red') or contains(lower(p_name), 'widget')"
)
def q44_fulltext(g: Graph) -> DataFrame:
    return full_text(match(g, node("n", "Part")), "red widget", ["n.p_name"]).select(p("n.p_partkey").alias("k"), "score")


# -- versioned records: events are versions of their user, with clock (ts, event_id)


def _last_events(g: Graph) -> DataFrame:
    return last_write(g.nodes["Event"].df.select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"])


@query("select user_id, arg_max(event_type, {ts: ts, id: event_id}) as event_type from events group by 1")
def q45_lww(g: Graph) -> DataFrame:
    return _last_events(g).select("user_id", "event_type")


@query("select user_id, arg_max(event_type, {ts: ts, id: event_id}) as event_type from events group by 1 having arg_max(event_type, {ts: ts, id: event_id}) <> 'error'")
def q46_lww_tombstone(g: Graph) -> DataFrame:
    return _last_events(g).filter("event_type <> 'error'").select("user_id", "event_type")


@query("select l_orderkey o, l_partkey p, count(*) c from lineitem where l_partkey not in (select p_partkey from part where p_size <= 45) group by 1, 2")
def q47_dangling(g: Graph) -> DataFrame:
    small = Graph(dict(g.nodes), g.edges, clean=False).add_nodes("Part", g.nodes["Part"].df.filter("p_size <= 45"), "p_partkey")
    return small.dangling("CONTAINS").groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).agg(count_all().alias("c"))


@query("select distinct l_partkey p from lineitem where l_suppkey = 1")
def q48_neighbors(g: Graph) -> DataFrame:
    return g.neighbors("Supplier", 1, "SUPPLIED").select(F.col("id").cast("long").alias("p"))


@query("select 'Region' l, count(*) c from region union all select 'Nation', count(*) from nation union all select 'Customer', count(*) from customer")
def q49_label_stats(g: Graph) -> DataFrame:
    kept = Graph({x: g.nodes[x] for x in ("Region", "Nation", "Customer")})
    return kept.label_counts().select(F.col("label").alias("l"), F.col("n").alias("c"))


@query("select c_custkey k, (select max(o_totalprice) from orders where o_custkey = c_custkey) as last, n_name nation from customer left join nation on c_nationkey = n_nationkey")
def q50_two_optional(g: Graph) -> DataFrame:
    rows = optional(g, match(g, node("c", "Customer")), node("c", "Customer"), out("PLACED"), node("o", "Purchase"))
    last = group(rows, ["c"], F.max(p("o.o_totalprice")).alias("last"))
    return optional(g, last, node("c", "Customer"), out("IN_NATION"), node("n", "Nation")).select(p("c.c_custkey").alias("k"), "last", p("n.n_name").alias("nation"))


@query("select l_suppkey s, count(*) edges, count(distinct l_partkey) parts from lineitem group by 1")
def q51_rel_identity(g: Graph) -> DataFrame:
    rows = match(g, node("s", "Supplier"), out("SUPPLIED", var="r"), node("p", "Part"))
    return rows.groupBy(p("s.s_suppkey").alias("s")).agg(F.count(p("r.id")).alias("edges"), F.countDistinct(p("p.id")).alias("parts"))


@query("select d.doc_id id, l.quality q from documents d left join labels l using (doc_id) order by q desc nulls last, id")
def q52_order_null_last(g: Graph) -> DataFrame:
    rows = optional(g, match(g, node("d", "Document")), node("d", "Document"), out("LABELLED"), node("x", "DocLabel"))
    return order(rows.select(p("d.doc_id").alias("id"), p("x.quality").alias("q")), ("q", "desc"), "id")


# -- records


def _records(g: Graph) -> RecordGraph:
    """Customers and nations as JSON records: customers in debt have a later version with one more label, those of one segment are deleted later."""

    def lines(df: DataFrame, folder: str, at: int, **fields: Column) -> DataFrame:
        stamp = {"v": F.lit(1), "updated_at": F.lit(f"2026-01-01T00:00:0{at}Z"), "writer": F.lit("w"), "counter": F.lit(0)}
        return df.select(F.lit(f"/{folder}/w").alias("path"), F.to_json(F.struct(*(c.alias(k) for k, c in {**stamp, **fields}.items()))).alias("line"))

    customers, nations = g.nodes["Customer"].df, g.nodes["Nation"].df
    c_id, n_id = F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), F.col("c_nationkey"))
    props = F.struct(F.col("c_custkey").alias("key"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_mktsegment").alias("segment"))
    parts = [
        lines(customers, "nodes", 1, id=c_id, labels=F.array(F.lit("Customer"), F.col("c_mktsegment")), props=props),
        lines(customers.filter("c_acctbal < 0"), "nodes", 2, id=c_id, labels=F.array(F.lit("Customer"), F.col("c_mktsegment"), F.lit("Debtor")), props=props),
        lines(customers.filter("c_mktsegment = 'MACHINERY'"), "meta/deleted", 3, id=c_id, kind=F.lit("node")),
        lines(nations, "nodes", 1, id=F.concat(F.lit("n"), "n_nationkey"), labels=F.array(F.lit("Nation")), props=F.struct(F.col("n_name").alias("name"))),
        lines(customers, "edges", 1, id=F.concat(F.lit("e"), "c_custkey"), type=F.lit("IN_NATION"), **{"from": c_id, "to": n_id}, props=F.struct(F.col("c_mktsegment").alias("via"))),
    ]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionAll(x)
    return of_versions(records.versions(whole)[0])


@query("select n_name nation, count(*) c, max(c_custkey) last from customer join nation on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING' and c_acctbal < 0 group by 1")
def q53_record_labels(g: Graph) -> DataFrame:
    rows = match(_records(g), node("c", "Customer", "Debtor", segment="BUILDING"), out("IN_NATION"), node("n", "Nation"))
    return rows.groupBy(prop("n.name").alias("nation")).agg(count_all().alias("c"), F.max(prop("c.key", "bigint")).alias("last"))


@query("select n_name nation, c_custkey k, c_acctbal < 0 as debtor, c_mktsegment via from nation left join customer on c_nationkey = n_nationkey and c_mktsegment <> 'MACHINERY'")
def q54_record_optional(g: Graph) -> DataFrame:
    graph = _records(g)
    rows = optional(graph, match(graph, node("n", "Nation")), node("n"), both("IN_NATION", var="r"), node("c"))
    debtor = F.when(p("c.id").isNotNull(), has_label("c", "Debtor"))
    return rows.select(prop("n.name").alias("nation"), prop("c.key", "bigint").alias("k"), debtor.alias("debtor"), prop("r.via").alias("via"))


@query("select 'Nation' l, count(*) c from nation union all select 'none', 0")
def q55_record_unknown(g: Graph) -> DataFrame:
    graph = _records(g)
    found = match(graph, node("n", "Nation")).select(F.lit("Nation").alias("l"))
    none = match(graph, node("a", "Nation", "Debtor"), out("NO_SUCH_TYPE"), node("b", "NoSuchLabel"))
    return union(found.groupBy("l").agg(count_all().alias("c")), none.agg(count_all().alias("c")).select(F.lit("none").alias("l"), "c"), all=True)
