"""Operator 2 against SQL and on odd rows; the pipeline stage by stage."""

import re

import duckdb

import corpus_pipeline
from weftgraph.llm import chat

SF = "/root/testdata/sf0.001"


def test_chat_equals_sql(spark):
    got = chat.rotate(spark.read.parquet(f"{SF}/conversations.parquet"))
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.sql(f"select {', '.join(columns)} from ({chat.ORACLE_SQL})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want)


def test_crowded_parts_equal_sql(spark):
    """Over 5,000 rows in a part, among them one row 3,000 times, and as many null turns."""
    rows = [(k % 3, None if k % 2 else k % 40, ("system", "ann", "bob")[k % 7 % 3], f"t{k % 97}") for k in range(36_000)] + [(1, 5, "bob", "again")] * 3_000
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotate(df)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"turn": "Int64"}))
    want = con.sql(f"select {', '.join(columns)} from ({chat.ORACLE_SQL})").fetchall()
    found = sorted(tuple(r[c] for c in columns) for r in got.collect())
    assert found == sorted(want) and max(r[columns.index("sub")] for r in found) == 2 and max(r[columns.index("n_turns")] for r in found) == chat.CROWD


def test_chat_masks_and_odd_rows(spark):
    rows = [(1, 0, "ann", "hi <|im_end|>"), (1, 1, "bob", None), (1, 2, "ann", "bye"), (1, None, None, "?"), (None, 0, "system", "s"), (2, 0, "ann", "x"), (2, 0, "ann", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotate(df).collect()
    assert {(r.conv_id, r.participant) for r in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann")}
    for r in got:
        trained = [r.text[int(a) : int(b)] for a, b in (x.split("-") for x in r.mask.split(",") if x)]
        assert len(trained) == r.n_trained and all(t.endswith("<|im_end|>\n") for t in trained)
        assert r.text.count("<|im_start|>assistant\n") == r.n_trained and r.text.count("<|im_start|>") == r.n_turns
    assert sum(r.n_turns for r in chat.rotate(df, crowd=1).filter("conv_id = 2").collect()) == 2
    assert chat.rotate(df.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, odd, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "line dedup", "n-gram Jaccard join", "packing"]
    for k, (start, name) in enumerate(((docs, "docs"), (odd, "odd"))):
        df = start
        for j, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, df, SF).write.parquet(f"{tmp_path}/{name}{j}")
            after = spark.read.parquet(f"{tmp_path}/{name}{j}")
            if j < 4:
                assert after.columns == start.columns and after.count() <= df.count()
                df = after
        assert after.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()


def brute_near(texts, n=5, percent=80):
    """The doc_ids that stay of (doc_id, text): the smallest of each component."""
    sets, root = {}, {}
    for i, t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split("[ \\t-\\r]+", w) if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        root[i] = i
    by_shingle = {}
    for i in sorted(sets):
        for x in sets[i]:
            by_shingle.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in {(a, b) for ids in by_shingle.values() for a in ids for b in ids if a < b}:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i for i in sets if find(i) == i}


def test_run_equals_its_stages(spark):
    """run's rows are the stages' one after another; near copies go as brute force has it, and every kept document is packed whole."""
    df, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF).persist()
        seen.append(df)
    before = sorted((r.doc_id, r.text) for r in seen[2].collect())
    after = sorted((r.doc_id, r.text) for r in seen[3].collect())
    keep = brute_near(before)
    assert after == [x for x in before if x[0] in keep]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept_good = {r.doc_id for r in seen[1].select("doc_id").collect()}
    n_words = {r.doc_id: len((r.text or "").split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0 and n_words[i] >= 50]  # shorter ones fail the base rule
    assert sum(i in kept_good for i in good) >= 0.95 * len(good)
    pieces = lambda rows: sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in rows.collect())

    def whole(rows):
        at = {}
        for doc_id, start, length, tokens in rows:
            assert at.get(doc_id, 0) == start
            at[doc_id] = start + length
        return at == {doc_id: tokens for doc_id, _, _, tokens in rows}

    got = corpus_pipeline.run(spark, SF).persist()
    mine, theirs = pieces(got), pieces(df)
    assert whole(mine) and whole(theirs) and {x[0] for x in mine} == {i for i, _ in after}
    tokens = lambda rows: {(x[0], x[3]) for x in rows}
    assert tokens(mine) == tokens(theirs)
    placed = {}
    for r in got.collect():
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
