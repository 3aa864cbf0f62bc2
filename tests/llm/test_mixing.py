import random

import duckdb

from tidelane.llm import mixing as M


def shared_out(sizes, most=3):
    """The targets by repeated resharing."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        goal = {s: most * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in full and goal[s] > most * sizes[s]}
        if not over:
            return goal
        full |= over


def rows(seed, n=3000):
    r = random.Random(seed)
    out = []
    for i in range(n):
        source = r.choice(["hot"] * 6 + ["a", "B", "é", "\U0001f600", None, "z1", "z2", "tiny"] + ["none"])
        if source == "tiny" and r.random() < 0.9:
            source = "hot"
        k = 0 if source == "none" else int(r.lognormvariate(3, 1))
        out.append((i, source, r.choice([" ", "\n", "\t"]).join(["w"] * k) or r.choice(["", None]), 1, "x"))
    return out


KIND = "doc_id long, source string, text string, size int, copies string"


def test_targets_limits_and_sql(spark, tmp_path):
    data = rows(4) + [(None, "a", "x y", 1, "x"), (5, "a", "x y", 1, "x"), (5, "a", "x y", 1, "x")]
    df = spark.createDataFrame(data, KIND)
    out = M.mix(df).collect()
    assert len(out) == len(data)
    sizes, taken = {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        assert 0 <= r.copies <= 3 and r.size == len((r.text or "").split())
    goal = shared_out(sizes)
    for r in out:
        assert abs(r.target - goal[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source]
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 200
    df.select("doc_id", "source", "text").write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    key = lambda r: (r[0] is None, r[0] or 0, *map(float, r[1:]))
    sql = sorted(con.sql(M.ORACLE_SQL).fetchall(), key=key)
    assert sql == sorted(((r.doc_id, r.size, r.source_size, r.target, r.size * r.copies) for r in out), key=key)


def test_emits_copies_and_reruns_agree(spark):
    df = spark.createDataFrame(rows(5, 400), KIND)
    a, b = M.mix(df).collect(), M.mix(df.repartition(3)).collect()
    assert sorted((r.doc_id, r.copies) for r in a) == sorted((r.doc_id, r.copies) for r in b)
    assert M.emitted(M.mix(df)).count() == sum(r.copies for r in a)


def test_empty(spark):
    assert M.mix(spark.createDataFrame([], KIND)).count() == 0
    out = M.mix(spark.createDataFrame([(1, None, None, 1, "x")], KIND)).collect()
    assert [(r.size, r.target, r.copies) for r in out] == [(0, 0.0, 0)]


def test_no_name_of_the_documents_clashes(spark):
    names = ["_ahead", "_size", "_copy", "doc", "key", "class", "cell", "hash", "rank", "n", "each", "offset", "before", "row", "copy", "a.b"]
    data = [(i, "ab"[i % 2], "w " * (i % 9), *["v"] * len(names)) for i in range(60)] + [(99, "a", "word " * 60000, *["v"] * len(names))]
    kind = "doc_id long, source string, text string, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame(data, kind)
    mixed = M.mix(df)
    assert mixed.columns == [*df.columns, "size", "source_size", "target", "copies"]
    found = mixed.collect()
    assert len(found) == len(data) and all(r[n] == "v" for r in found for n in names)
    assert {r.doc_id: r["size"] for r in found}[99] == 60000
    taken = M.emitted(mixed)
    assert taken.columns == mixed.columns
    assert taken.count() == sum(r.copies for r in found)


def test_rows_without_id_spread_over_cells(spark):
    df = spark.createDataFrame([(None, "a", f"w w{i}") for i in range(400)], "doc_id long, source string, text string")
    found = M.mix(df.unionAll(spark.createDataFrame([(1, "b", "x " * 2000)], df.schema))).where("source = 'a'").collect()
    assert len(found) == 400
    assert abs(sum(r.copies * r["size"] for r in found) - found[0].target) < 4
