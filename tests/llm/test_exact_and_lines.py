import hashlib
from collections import Counter

from pyspark.sql import functions as F

from fixtures import edge, edge_rows, empty
from millrace.llm import exact_dedup, line_dedup


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_edges(spark):
    got = exact_dedup.exact_dedup(edge(spark)).collect()
    want = Counter(low(r[1]) for r in edge_rows())
    assert len(got) == len(edge_rows())
    by = {r["doc_id"]: r for r in got}
    assert by[1]["keep_id"] == 5 and not by[1]["kept"] and by[5]["kept"] and by[5]["group_size"] == 2
    assert by[3]["keep_id"] == 3 and by[2]["keep_id"] == 3 and not by[2]["kept"]
    assert [r["kept"] for r in got if r["doc_id"] == 6] == [True, True]
    assert [(r["kept"], r["keep_id"]) for r in got if r["doc_id"] is None] == [(True, None)] * 2
    assert by[7]["text_sha256"] == hashlib.sha256(low(edge_rows()[7][1]).encode()).hexdigest()
    assert sorted(r["group_size"] for r in got) == sorted(want[low(r[1])] for r in edge_rows())
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_compares_content_where_digests_clash(spark):
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 1)
    a, b = (sorted(map(tuple, exact_dedup.exact_dedup(edge(spark), **k).collect()), key=str) for k in ({}, {"digest": weak}))
    assert a == b


def test_exact_survivors_keep_columns(spark):
    out = exact_dedup.survivors(edge(spark))
    assert out.schema == edge(spark).schema
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, -1, 3, 4, 5, 6, 6, 7, 8, 9]


def test_lines(spark):
    texts = [(i, f"own {i}\n  Shared LINE \x0b\r\n\nend") for i in range(12)] + [(20, None), (21, ""), (22, "shared line"), (23, "Shared\tline"), (23, "Shared\tline")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, n_lines string")
    got = sorted(map(tuple, line_dedup.line_dedup(df).select("doc_id", "text", "n_lines", "n_dropped").collect()))
    want = sorted([(i, f"own {i}\n", 4, 2) for i in range(12)] + [(20, "", 1, 0), (21, "", 1, 0), (22, "", 1, 1), (23, "Shared\tline", 1, 0), (23, "Shared\tline", 1, 0)])
    assert got == want


def test_line_edges(spark):
    out = line_dedup.line_dedup(edge(spark), threshold=2)
    assert out.count() == len(edge_rows()) and set(out.columns) == {*edge(spark).columns, "n_dropped"}
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[6]["text"] == "" and by[6]["n_dropped"] == 1 and by[1]["text"] == "" and by[7]["text"] == edge_rows()[7][1]
    assert line_dedup.line_dedup(empty(spark)).count() == 0
