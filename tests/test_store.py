"""Record folders: last write wins, liveness, bad input, updates, export, compaction, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scalars as S
from weftgraph.functions.search import cosine, full_text, nearest, query_tokens
from weftgraph.operators import versions as V
from weftgraph.operators.match import both, into, match, node, optional, out, p, pattern
from weftgraph.operators.record_graph import has_label, open_folder, prop
from weftgraph.operators.relational import union
from weftgraph.operators.writes import Store
from weftgraph.sources import records
from weftgraph.sources.graph import Graph
from weftgraph.streaming.versions import bundles, keep_winners, winners_table


def node_line(i, at, labels=("P",), writer="w", counter=0, **props):
    return {"id": i, "v": 1, "updated_at": at, "writer": writer, "counter": counter, "labels": list(labels), "props": props}


def edge_line(i, at, a, b, kind="KNOWS", **props):
    return {"id": i, "v": 1, "updated_at": at, "writer": "w", "counter": 0, "type": kind, "from": a, "to": b, "props": props}


def put(folder, name, rows, tail=""):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" if not isinstance(r, str) else r + "\n" for r in rows) + tail)


T1, T2, T3 = "2026-01-01T00:00:01.000001Z", "2026-01-01T00:00:02Z", "2026-01-01T00:00:03Z"


@pytest.fixture
def folder(tmp_path):
    put(tmp_path, "nodes/w.1.jsonl", [node_line("a", T1, name="old"), node_line("a", T2, name="new"), node_line("b", T1), node_line("c", T1)], tail='{"id": "torn"')
    put(tmp_path, "nodes/x.1.jsonl", ["not json", json.dumps({"no": "id"}), json.dumps(node_line("a", T2, writer="x", name="tie"))])
    put(tmp_path, "edges/w.1.jsonl", [edge_line("e1", T1, "a", "b"), edge_line("e2", T1, "a", "zz"), edge_line("e3", T1, "a", "c")])
    put(tmp_path, "vectors/embedding/w.1.jsonl", [{"id": "b", "v": 1, "updated_at": T1, "writer": "w", "counter": 0, "dim": 2, "dtype": "f32le", "vec": "AACAPwAAAMA="}, {"id": "c", "v": 1, "updated_at": T1, "writer": "w", "counter": 0, "dim": 1, "dtype": "f32le", "vec": "AACAPw=="}])
    put(tmp_path, "meta/deleted.w.jsonl", [{"id": "c", "v": 1, "kind": "node", "updated_at": T1, "writer": "w", "counter": 0}])
    return tmp_path


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_reading_and_liveness(spark, folder):
    good, skipped, torn = records.read(spark, str(folder))
    won = V.winners(good)
    assert ids(V.live_nodes(won)) == ["a", "b"] and ids(V.live_edges(won)) == ["e1"]
    assert ids(V.dangling_edges(won)) == ["e2", "e3"] and ids(V.live_vectors(won)) == ["b"]
    assert skipped.count() == 2 and torn.count() == 1
    name = V.live_nodes(won).filter("id = 'a'").select(F.expr("try_variant_get(props['name'], '$', 'string')")).first()[0]
    assert name == "tie"  # equal time and counter: the larger writer
    assert V.live_vectors(won).select(records.decode_vector(F.col("vec"))).first()[0] == [1.0, -2.0]
    assert {(r.what, r["name"]): r.n for r in V.label_catalogue(won).collect()} == {("label", "P"): 2, ("type", "KNOWS"): 1, ("vector", "embedding"): 1}
    assert {r.check: r.n for r in V.report(good, skipped, torn).collect()} == {"nodes": 2, "edges": 1, "vectors": 1, "dangling": 2, "tombstones": 1, "skipped": 2, "torn": 1}
    assert [r.id for r in V.out_neighbors(won, "a").collect()] == ["b"]
    assert "c" in ids(V.compacted(good, "w").filter("tombstone")) and "e2" not in ids(V.compacted(good, "w"))


def test_export_and_import(spark, folder, tmp_path):
    won = V.winners(records.read(spark, str(folder))[0])
    live = V.live_nodes(won).unionByName(V.live_edges(won).select(won.columns)).unionByName(V.live_vectors(won).select(won.columns))
    path = str(tmp_path / "export")
    records.export(live, "g").coalesce(1).write.text(path)
    again = V.winners(records.load_export(spark, path))
    assert ids(V.live_nodes(again)) == ["a", "b"] and ids(V.live_edges(again)) == ["e1"] and ids(V.live_vectors(again)) == ["b"]


def test_last_write_is_order_independent(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randint(0, 3), rng.randint(0, 2), rng.choice("xy"), rng.random() < 0.3, rng.randint(1, 2), str(k)) for k in range(200)]
    want = {}
    for r in rows:
        if r[0] not in want or r[1:] > want[r[0]][1:]:
            want[r[0]] = r
    for _ in range(2):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "id string, updated_at int, counter int, writer string, tombstone boolean, v int, record string")
        assert sorted(tuple(r) for r in V.last_write(df, ["id"], list(V.CLOCK)).select(*df.columns).collect()) == sorted(want.values())


def props(**kw):
    return F.from_json(F.lit(json.dumps(kw)), "map<string,variant>")


def test_updates_are_atomic_and_read_themselves(spark, tmp_path):
    folder = str(tmp_path / "g")
    store = Store(spark, folder, "me")
    people = spark.createDataFrame([("a", ["P"]), ("b", ["P"])], "id string, labels array<string>")
    store.create_nodes(people.withColumn("props", props(x=1)))
    store.create_edges(spark.createDataFrame([("e", "KNOWS", "a", "b")], "id string, type string, src string, dst string").withColumn("props", props(w=2)))
    with pytest.raises(ValueError):
        store.create_edges(spark.createDataFrame([("f", "KNOWS", "a", "nobody")], "id string, type string, src string, dst string").withColumn("props", props()))
    assert ids(store.nodes()) == ["a", "b"] and ids(Store(spark, folder, "other").nodes()) == []
    store.set_props("node", spark.createDataFrame([("a",)], "id string").withColumn("props", props(y=None, z="t")))
    store.add_labels(spark.createDataFrame([("a", ["Q"])], "id string, labels array<string>"))
    store.set_vectors(spark.createDataFrame([("a", "embedding", "AACAPw==", 1), ("a", "Bad name", "AACAPw==", 1)], "id string, property string, vec string, dim int"))
    store.commit()
    other = Store(spark, folder, "other")
    a = other.nodes().filter("id = 'a'").select("labels", F.to_json("props").alias("props")).first()
    assert a.labels == ["P", "Q"] and json.loads(a.props) == {"x": 1, "y": None, "z": "t"}
    assert other.vectors().count() == 1 and ids(other.edges()) == ["e"]
    rows = spark.createDataFrame([("b", ["R"], 0), ("n", ["P"], 0), ("n", ["S"], 1)], "id string, labels array<string>, ordinal int").withColumn("props", F.when(F.col("ordinal") == 1, props(k=2)).otherwise(props(k=1)))
    other.merge_nodes(rows)
    other.merge_edges(spark.createDataFrame([("KNOWS", "a", "b"), ("KNOWS", "b", "n"), ("KNOWS", "b", "n")], "type string, src string, dst string").withColumn("props", props()))
    merged = {r.id: (r.labels, json.loads(r.props)) for r in other.nodes().select("id", "labels", F.to_json("props").alias("props")).collect()}
    assert merged["b"] == (["P", "R"], {"x": 1, "k": 1}) and merged["n"] == (["P", "S"], {"k": 2})
    assert other.edges().count() == 2
    other.delete_nodes(spark.createDataFrame([("a",)], "id string"))
    assert ids(other.nodes()) == ["b", "n"] and other.vectors().count() == 0 and other.edges().count() == 1
    other.rollback()
    assert ids(other.nodes()) == ["a", "b"]
    other.delete_edges(spark.createDataFrame([("e",)], "id string"))
    other.commit()
    assert Store(spark, folder, "third").edges().count() == 0


def test_merge_by_map_and_several_rows_for_one_id(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"), "me")
    store.create_nodes(spark.createDataFrame([("a",), ("b",)], "id string").withColumn("labels", F.array(F.lit("P"))).withColumn("props", props(x=1)))
    edge = lambda **kw: spark.createDataFrame([("KNOWS", "a", "b")], "type string, src string, dst string").withColumn("props", props(**kw))
    store.merge_edges(edge(g="1").unionAll(edge(g="1")).withColumn("id", F.lit("own")))
    # another value, text and number, and what the first edge has or lacks
    store.merge_edges(edge(g="2").unionAll(edge(g=1)).unionAll(edge(h=None)).unionAll(edge()).unionAll(edge(g="1")))
    store.merge_edges(edge(g="9").withColumn("id", F.lit("own")))
    assert store.edges().count() == 3
    rows = spark.createDataFrame([("a", 0, "9"), ("a", 1, "1"), ("b", 0, "3")], "id string, ordinal int, v string").withColumn("props", F.from_json(F.concat(F.lit('{"x": '), "v", F.lit("}")), "map<string,variant>"))
    store.set_props("node", rows)
    assert {r.id: json.loads(r.props) for r in store.nodes().select("id", F.to_json("props").alias("props")).collect()} == {"a": {"x": 1}, "b": {"x": 3}}
    with pytest.raises(ValueError, match="one id"):
        store.create_nodes(spark.createDataFrame([("c",), ("c",)], "id string").withColumn("labels", F.array(F.lit("P"))).withColumn("props", props()))


def test_unknown_labels_and_types_give_no_rows(spark):
    g = Graph().add_nodes("A", spark.createDataFrame([(1, "x"), (2, "y")], "k long, name string"), "k")
    g.add_edges("T", spark.createDataFrame([(1, 2)], "s long, t long"), "A", "A", "s", "t")
    assert match(g, node("n", "Nobody")).count() == 0 and match(g, node("n", "A", "B")).select(p("n.name")).count() == 0
    assert match(g, node("a", "A"), out("U", var="r"), node("b", "A")).select(p("a.name"), p("r.id"), p("b.k")).count() == 0
    rows = optional(g, match(g, node("a", "A")), node("a", "A"), out("U"), node("b", "A"))
    assert sorted((r[0], r[1]) for r in rows.select(p("a.k"), p("b.k")).collect()) == [(1, None), (2, None)]
    rows = optional(g, match(g, node("a", "A")), node("a", "A"), out("T"), node("b", "Nobody"))
    assert rows.select(p("a.k"), p("b.id")).count() == 2


def test_stream_keeps_winners(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    schema = "id string, at long, value string"
    for k, rows in enumerate(([("a", 2, "two"), ("b", 1, "one")], [("a", 1, "late"), ("b", 3, "three")])):
        put(source, f"{k}.json", [{"id": i, "at": t, "value": v} for i, t, v in rows])
        keep_winners(bundles(spark, str(source), schema), table, ["id"], ["at"], str(tmp_path / "state")).awaitTermination()
    assert {r.id: r.value for r in winners_table(spark, table).collect()} == {"a": "two", "b": "three"}


# -- patterns against a naive matcher


def naive(nodes, edges, path, labelled):
    """Rows of node ids for a path of (labels, direction) hops over small graphs; undirected as the rules say."""
    rows = [[n] for n in nodes if path[0] in (None, nodes[n])]
    for k in range(1, len(path), 2):
        direction, label, new = path[k], path[k + 1], []
        for row in rows:
            for a, b in edges:
                steps = [(a, b)] if direction == "out" else [(b, a)] if direction == "in" else [(a, b), (b, a)]
                if direction == "both" and len(path) == 3:
                    steps = [(a, b)] if not labelled else [(a, b)] + ([(b, a)] if a != b else [])
                new += [[*row, y] for x, y in steps if x == row[-1] and label in (None, nodes[y])]
        rows = new
    return sorted(map(tuple, rows))


@pytest.mark.parametrize("seed", range(4))
def test_patterns_equal_a_naive_matcher(spark, seed):
    rng = random.Random(seed)
    nodes = {k: rng.choice("AB") for k in range(12)}
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(25)]
    g = Graph(clean=rng.random() < 0.5)
    for label in "AB":
        g.add_nodes(label, spark.createDataFrame([(k,) for k, x in nodes.items() if x == label], "k long"), "k")
    for x in "AB":
        for y in "AB":
            own = [(a, b) for a, b in edges if nodes[a] == x and nodes[b] == y]
            g.add_edges("T", spark.createDataFrame(own, "s long, t long"), x, y, "s", "t")
    hop = {"out": out, "in": into, "both": both}
    for path in (["A", "out", "B"], ["A", "in", None], [None, "both", None], ["A", "both", None], [None, "out", None, "in", "A"], ["B", "both", "A", "out", None]):
        built = [node(f"n{k}", *([x] if x else [])) if k % 2 == 0 else hop[x]("T") for k, x in enumerate(path)]
        got = pattern(g, built)
        found = sorted(tuple(int(str(v).rpartition(":")[2]) for v in r) for r in got.select(*(p(f"n{k}.id") for k in range(0, len(path), 2))).collect())
        assert found == naive(nodes, edges, path, any(path[::2])), path


def test_bound_variables_and_optional(spark):
    g = Graph().add_nodes("A", spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, name string"), "k")
    g.add_edges("T", spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "s long, t long"), "A", "A", "s", "t")
    loop = match(g, node("a", "A"), out("T"), node("a", "A"))
    assert [r[0] for r in loop.select(p("a.k")).collect()] == [2]
    rows = optional(g, match(g, node("a", "A")), node("a", "A"), out("T"), node("b", "A"), where=p("b.name") == "y")
    assert sorted((r[0], r[1] or 0) for r in rows.select(p("a.k"), p("b.k")).collect()) == [(1, 2), (2, 2), (3, 0)]
    again = match(g, node("b", "A"), out("T"), node("c", "A"), rows=rows)
    assert again.count() == 2  # a variable left null by optional matches nothing
    dangling = Graph(dict(g.nodes), clean=False).add_edges("T", spark.createDataFrame([(1, 2), (1, 9), (8, 1), (8, 9)], "s long, t long"), "A", "A", "s", "t")
    assert dangling.dangling("T").count() == 3 and match(dangling, node(), out("T"), node()).count() == 1


def test_scalar_rules(spark):
    row = spark.range(1).select(F.array(F.lit(1), F.lit(None).cast("int")).alias("xs"), F.lit(None).cast("int").alias("n"), F.lit(" \t x\n").alias("s"))
    one = lambda c: row.select(c).first()[0]
    assert one(S.is_in(F.lit(None).cast("int"), F.col("xs"))) is True and one(S.is_in(F.lit(3), F.col("xs"))) is False
    assert one(S.not_(F.col("n") == 1)) is True and one(S.trim(F.col("s"))) == "x" and one(S.ltrim(F.col("s"))) == "x\n"
    assert one(S.at(F.col("xs"), -2)) == 1 and one(S.at(F.col("xs"), 5)) is None
    assert one(S.to_integer(F.lit("-1.9"))) == -1 and one(S.to_integer(F.lit("zz"))) is None
    assert one(S.to_string(F.lit(True), "boolean")) == "True" and one(S.equal(F.lit("1"), F.lit(1), "string", "number")) is False
    assert one(S.concat_lists(F.lit(None).cast("array<int>"), F.col("xs"))) == [1, None] and one(S.split(F.lit("a.b."), ".")) == ["a", "b", ""]
    assert one(cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(2**-0.5)
    assert one(cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    with pytest.raises(Exception, match="different lengths"):
        one(cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))))
    with pytest.raises(ValueError):
        union(spark.range(1), spark.range(1).withColumnRenamed("id", "x"))


def test_full_text_and_user_functions(spark):
    assert query_tokens("Red AND blue_2, not!") == ["red", "blue_2"]
    df = spark.createDataFrame([("a red fox",), ("Reddish blue",), ("none",)], "t string")
    assert [(r.t, r.score) for r in full_text(df, "red blue", ["t"], limit=5, tie="t").collect()] == [("Reddish blue", 1.0), ("a red fox", 0.5)]
    functions = S.Registry()
    functions.column("Twice")(lambda x: F.concat(x, x))

    @functions.scalar("shout", returns="string")
    def shout(x):
        return x.str.upper()

    assert [r[0] for r in df.limit(1).select(functions("SHOUT", functions("twice", F.col("t")))).collect()] == ["A RED FOXA RED FOX"]
    with pytest.raises(KeyError, match="known: shout, twice"):
        functions("missing")


def test_graph_of_a_folder(spark, tmp_path):
    nodes = [node_line("a", T1, ("P", "Q"), name="x", age=5, uuid="u1"), node_line("b", T1, ("P",), age="5"), node_line("c", T1, (), age=5.0, tags=[1, 2]), node_line("gone", T1)]
    put(tmp_path, "nodes/w.1.jsonl", nodes)
    edges = [edge_line("e1", T1, "a", "b", since=1), edge_line("e2", T1, "b", "c", "LIKES"), edge_line("e3", T1, "c", "c"), edge_line("e4", T1, "a", "gone")]
    put(tmp_path, "edges/w.1.jsonl", edges)
    put(tmp_path, "meta/deleted.w.jsonl", [{"id": "gone", "v": 1, "kind": "node", "updated_at": T1, "writer": "w", "counter": 0}])
    g = open_folder(spark, str(tmp_path))

    def found(*path, **more):
        return sorted(tuple(r) for r in match(g, *path, **more).select(*(p(f"{x}.id") for x in dict.fromkeys(n.var for n in path if n.var))).collect())

    assert found(node("n")) == [("a",), ("b",), ("c",)]
    assert found(node("n", "P")) == [("a",), ("b",)] and found(node("n", "P", "Q")) == [("a",)] and found(node("n", "Z")) == []
    assert found(node("n", age=5)) == [("a",), ("c",)] and found(node("n", age="5")) == [("b",)] and found(node("n", tags=[1, 2])) == [("c",)]
    assert found(node("n", name=None)) == [("b",), ("c",)]
    assert found(node("n", uuid="u1")) == [("a",)] and found(node("n", uuid="b")) == [("b",)]
    assert found(node("n"), out("KNOWS", since=1), node("m")) == [("a", "b")]
    assert found(node("n"), into(), node("m", "P")) == [("b", "a"), ("c", "b")] and found(node("n"), out("NONE"), node("m")) == []
    assert found(node(), both(var="r"), node()) == [("e1",), ("e2",), ("e3",)]  # as stored, where no end is labelled
    assert found(node("n", "P"), both(), node("m")) == [("a", "b"), ("b", "a"), ("b", "c")]
    assert found(node("n"), out(), node("n")) == [("c",)] and found(node("n"), out(), node("m"), out(), node("k")) == [("a", "b", "c"), ("b", "c", "c"), ("c", "c", "c")]
    bound = match(g, node("n", uuid="c"))
    assert sorted(r[0] for r in match(g, node("n"), both(var="r"), node(), rows=bound).select(p("r.id")).collect()) == ["e2", "e3", "e3"]
    left = optional(g, match(g, node("n")), node("n"), out("LIKES"), node("m"))
    assert sorted((r[0], r[1]) for r in left.select(p("n.id"), has_label("m", "P")).collect()) == [("a", False), ("b", False), ("c", False)]
    assert [tuple(r) for r in left.filter("`m.id` is not null").select(prop("m.age", "double"), prop("m.age"), prop("n.uuid")).collect()] == [(5.0, None, "b")]


def test_incoming_relationships_between_free_ends(spark):
    g = Graph().add_nodes("A", spark.range(3), "id").add_edges("T", spark.createDataFrame([(0, 1)], "s long, t long"), "A", "A", "s", "t")
    rows = match(g, node(), into("T", var="r"), node()).select(p("r.s"), p("r.t")).collect()
    assert [tuple(r) for r in rows] == [(0, 1)]


def test_tables_with_columns_named_like_identity(spark):
    nodes = spark.createDataFrame([(1, "x", "one"), (2, "y", "two")], "id long, label string, name string")
    edges = spark.createDataFrame([(1, 2, 7, "t")], "s long, t long, id long, type string")
    g = Graph().add_nodes("A", nodes, "id").add_edges("TO", edges, "A", "A", "s", "t")
    rows = match(g, node("a", "A", label="x"), out("TO", var="r", id=7), node("b", "A")).collect()
    assert [(r["a.id"], r["a.label"], r["a.label_"], r["r.type"], r["r.type_"], r["r.id_"], r["b.id_"]) for r in rows] == [(1, "A", "x", "TO", "t", 7, 2)]
    assert match(g, node("a", "A", id=2)).count() == 1 and match(g, node("a", "A", label="A")).count() == 0
    assert sorted((r.id, r.labels, r.id_) for r in g.scan().collect()) == [("A:1", ["A"], 1), ("A:2", ["A"], 2)]
    assert match(g, node("a", "A"), out("NONE"), node("b", "A")).columns[:2] == ["a.id", "a.label"]


def test_bound_ends_are_joined_once_and_tables_are_opened_when_asked(spark):
    opened = []

    def table(name, df):
        return lambda: (opened.append(name), df)[1]

    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, name string")
    b = spark.createDataFrame([(10, 1), (11, 1)], "o long, a long")
    g = Graph().add_nodes("A", table("a", a), "k").add_nodes("B", table("b", b), "o").add_edges("HAS", table("b", b), "A", "B", "a", "o")
    people = match(g, node("a", "A"))
    assert set(opened) == {"a"}
    rows = optional(g, people, node("a", "A"), out("HAS"), node("b", "B"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # A once, B once
    assert sorted((r["a.name"], r["b.o"] or 0) for r in rows.collect()) == [("x", 10), ("x", 11), ("y", 0)]
    narrow = people.select(p("a.id"))  # the name is fetched again where rows lack it
    assert sorted(r["a.name"] for r in match(g, node("a", "A"), rows=narrow).collect()) == ["x", "y"]
    assert {r["a.name"] for r in match(g, node("a", "A"), out("HAS"), node("b", "B"), rows=narrow).collect()} == {"x"}


def test_dangling_edges_once_each(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    edges = spark.createDataFrame([(1, 2), (1, 9), (9, 1), (9, 9), (None, 1), (1, 9)], "s long, t long")
    g = Graph(clean=False).add_nodes("A", a, "k").add_edges("TO", edges, "A", "A", "s", "t")
    assert sorted(map(str, (tuple(r) for r in g.dangling("TO").collect()))) == sorted(map(str, [(1, 9), (1, 9), (9, 1), (9, 9), (None, 1)]))


def test_nearest_equals_brute_force_in_small_blocks(spark):
    rng = random.Random(5)
    vectors = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(90)] + [(90, None), (None, [1.0] * 4), (91, [0.0] * 4), (7, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(vectors, "id long, vector array<float>").repartition(3)
    length = lambda x: sum(v * v for v in x) ** 0.5
    score = lambda x, y: round(sum(a * b for a, b in zip(x, y)) / (length(x) * length(y)), 9) if length(x) * length(y) else 0.0
    real = [(i, v) for i, v in vectors if i is not None and v is not None]
    want = []
    for q, x in real:
        if q % 10 == 0:
            best = sorted((-score(x, y), i) for i, y in real if score(x, y) > 0.1)[:5]
            want += [(q, i, place) for place, (_, i) in enumerate(best, 1)]
    got = nearest(df, df.filter("id % 10 = 0"), k=5, above=0.1, floats=64)
    assert sorted((r.query, r.id, r.place) for r in got.collect()) == sorted(want)
    assert nearest(df.limit(0), df, k=5).count() == 0 and nearest(df, df.limit(0), k=5).count() == 0
