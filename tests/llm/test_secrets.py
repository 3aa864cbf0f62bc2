import hashlib
import re

from tidelane.llm import secrets as S


def plain(text):
    """The contract, literally: maximal matches first, then the length tests."""
    found = []
    letters = {c: f"[{c}{c.upper()}]" for c in "abcdefghijklmnopqrstuvwxyz"}
    words = "|".join("".join(letters.get(c, c) for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for kind, pattern, least in (
        ("assign", f"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
        ("access", "AKIA[A-Z0-9]+", 20),
        ("hex", "[0-9a-f]+", 24),
    ):
        for m in re.finditer(pattern, text):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                found.append((m.start(), S.KINDS.index(kind), kind, m.end()))
    return sorted(found)


TEXTS = [
    None,
    "",
    "password: hunter22 x",
    "secret: token: abcdef1",
    'ToKeN" = "abc" token=abc=def',
    "api_key=abcdef apikey='ghijkl' API-KEY=zzzzzz",
    "toKen=abcdef ſecret=abcdef",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " xAKIAKIA" + "9" * 20,
    "f" * 23 + " " + "0123456789abcdef" * 2 + "g" + "a" * 24 + "é" + "b" * 30,
    "é" * 50 + " passwd = 'päss' passwd='passpass'",
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----",
    "x" * 200000 + " token=abcdefgh",
]


def test_spans_follow_the_contract(spark, tmp_path):
    rows = [(i, t, "n", 1) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "m", 2), (None, TEXTS[3], "n", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, blob int")
    found = S.scan_versions(df, str(tmp_path / "ledger")).collect()
    assert len(found) == len(rows)
    for r in found:
        text = TEXTS[3 if r.doc_id is None else r.doc_id] or ""
        base = plain(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, _, k, _ in base) for x in S.BASE), r
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("key_block")] == [s for s in joined.split(",") if s]
    assert [r.spans for r in found if r.doc_id == 10] == ["key_block:0:65"]


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([("a", 1, "token=abcdef"), ("b", 1, "token=abcdef"), ("c", 1, "x")], "path string, version int, text string")
    assert S.ledger(spark, path) is None
    assert {(r.path, r.n_assign) for r in S.scan_versions(one, path).collect()} == {("a", 1), ("b", 1), ("c", 0)}
    assert S.ledger(spark, path).count() == 2
    two = one.union(spark.createDataFrame([("a", 2, "y"), ("c", 2, "token=abcdef")], one.schema))
    found = S.scan_versions(two, path)
    assert {(r.path, r.version, r.n_assign) for r in found.collect()} == {("a", 1, 1), ("b", 1, 1), ("c", 1, 0), ("a", 2, 0), ("c", 2, 1)}
    assert S.ledger(spark, path).count() == 3
    S.scan_versions(two, path, rules="next")
    assert S.ledger(spark, path).count() == 6
    empty = spark.createDataFrame([], one.schema)
    assert S.scan_versions(empty, path).count() == 0
    assert S.scan_versions(empty, str(tmp_path / "none")).count() == 0


def test_a_pair_that_two_runs_committed_counts_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([("a", "token=abcdef"), ("b", "x")], "path string, text string")
    S.scan_versions(rows, path)
    S.ledger(spark, path).write.mode("append").parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("append").parquet(path)
    assert S.ledger(spark, path).count() == 4
    assert {(r.path, r.n_assign) for r in S.scan_versions(rows, path).collect()} == {("a", 1), ("b", 0)}
    assert S.scan_versions(rows, path).count() == 2


def test_the_query_goes_on_with_a_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    docs = spark.createDataFrame([(1, "token=abcdef"), (2, "x"), (3, "x"), (None, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    first = {tuple(r) for r in S.op9_secrets(spark, str(tmp_path), path).collect()}
    assert S.ledger(spark, path).count() == 3
    # Nothing new: no row is added. Other rules: every content is scanned anew.
    assert {tuple(r) for r in S.op9_secrets(spark, str(tmp_path), path).collect()} == first
    assert S.ledger(spark, path).count() == 3
    assert {tuple(r) for r in S.op9_secrets(spark, str(tmp_path), path, rules="next").collect()} == first
    assert S.ledger(spark, path).count() == 6
