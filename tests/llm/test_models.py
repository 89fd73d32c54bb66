import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fixtures import SF, docs, edge, edge_rows, empty, rows
from millrace.llm import ann, langid, toxicity

SF2 = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_accuracy_on_held_out(spark):
    truth = dict(rows("SELECT doc_id, lang FROM documents"))
    got = langid.identify(docs(spark)).collect()
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in out) >= 0.95 * len(out)


def test_language_equals_plain_backoff(spark):
    """Counts, backoff and softmax from the texts alone, words and n-grams as Counters."""
    data = rows("SELECT doc_id, text, lang FROM documents")
    langs = sorted({lang for _, _, lang in data if lang})
    split = lambda t: ["".join(g) for k, g in itertools.groupby(t.lower(), str.isalpha) if k]
    count = [{lang: Counter() for lang in langs} for _ in range(6)]
    for text, lang in {(t, lang) for i, t, lang in data if not held(i) and t and lang}:
        for w in split(text):
            count[0][lang][w] += 1
            for n in range(1, 6):
                for k in range(len(w) + 2 - n + 1):
                    count[n][lang][f"^{w}$"[k : k + n]] += 1
    kinds = [len(set().union(*c.values())) for c in count]
    whole = [[sum(c[lang].values()) + 0.5 * kinds[n] for lang in langs] for n, c in enumerate(count)]

    def logs(n, key):
        v = [math.log((count[n][lang][key] + 0.5) / whole[n][i]) for i, lang in enumerate(langs)]
        return [x - sum(v) / len(v) for x in v]

    def score(w):
        if any(c[w] for c in count[0].values()):
            return logs(0, w)
        for n in range(5, 0, -1):
            known = [g for k in range(len(w) + 2 - n + 1) if any(c[g := f"^{w}$"[k : k + n]] for c in count[n].values())]
            if known:
                return [sum(x) / len(known) for x in zip(*(logs(n, g) for g in known), strict=True)]
        return [0.0] * len(langs)

    more = [(10_000, "unseenwordly qzxv \u65e5\u672c"), (10_001, "\xbd 2\xb2 \u2460 \u2167"), (10_002, "x\xb2y")]
    df = docs(spark).select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, None) for i, t in more], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    for i, text in [*((i, t) for i, t, _ in data[::5]), *more]:
        parts = split(text or "")
        total = [sum(x) for x in zip(*map(score, parts), strict=True)] if parts else []
        if not total:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        assert abs(got[i]["score"] - 1 / sum(math.exp(max(-700, v - total[best])) for v in total)) < 1e-3
        assert got[i]["lang_pred"] == langs[best]
    assert got[10_001]["lang_pred"] == "und" and got[10_002]["lang_pred"] != "und"


def test_rare_language_is_learnt(spark):
    data = [(i, f"the common words of number {i}", "en") for i in range(400)] + [(1000 + i, f"zeldzame woorden nummer {i}", "nl") for i in range(8)]
    df = spark.createDataFrame([*data, (5000, "zeldzame woorden", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, per_language=40).collect()}
    assert got[5000] == "nl" and got[7] == "en"


def test_language_edges(spark):
    got = langid.identify(edge(spark)).collect()
    assert len(got) == len(edge_rows())
    by = {r["doc_id"]: r for r in got}
    assert by[2]["lang_pred"] == by[3]["lang_pred"] == by[4]["lang_pred"] == "und" and by[1]["lang_pred"] == "en"
    assert by[None]["held_out"]
    assert langid.identify(empty(spark)).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(30, rng.integers(0, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    index = toxicity.BlockMaxIndex(vectors, 30, block=16)
    dense = np.zeros((500, 30))
    for n, (t, w) in enumerate(vectors):
        dense[n, t] = w
    for t, w in vectors[:60]:
        plain = np.round(dense[:, t] @ w, 12)
        want = np.lexsort((np.arange(500), -plain))[:15]
        want = want[plain[want] > 0]
        numbers, scores = index.search(t, w, 15)
        assert np.allclose(scores, np.minimum(1.0, plain[want]), atol=1e-9) and numbers.tolist() == want.tolist()
    assert len(toxicity.BlockMaxIndex([], 30).search(*vectors[0], 15)[0]) == 0


def test_toxicity_equals_brute_force(spark):
    """Term weights, neighbours, votes and scores from the texts alone, without index and vocabulary memo."""
    labels = spark.read.parquet(f"{SF2}/labels.parquet").select("doc_id", "toxic")
    sample, total = toxicity.sampled(docs(spark, SF2), labels, "doc_id", "text", "toxic", 8000)
    sample = [r.asDict() for r in sample.collect()]
    texts = dict(rows("SELECT doc_id, text FROM documents", SF2))
    model = toxicity.fit(docs(spark, SF2), labels, "doc_id", "text", "toxic")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs(spark, SF2), labels).collect()}
    bags = {i: Counter(re.findall(r"[^\W\d_]+", t.lower())) for i, t in texts.items()}
    n = Counter(r["y"] for r in sample)
    cut = {y: min(0.25, 1000 / n[y]) for y in n}
    learnt = [r for r in sample if r["u"] >= cut[r["y"]]]
    index = sorted(r["id"] for r in learnt if r["u"] < cut[r["y"]] + min(1.0, 1000 / n[r["y"]]))
    assert index == sorted(model.ids) and not any(held(i) for i in index)
    toxic = {r["id"]: r["y"] for r in sample}
    side = Counter(r["y"] for r in learnt)
    weight = {}
    for t in {t for i in index for t in bags[i]}:
        k = [sum(t in bags[r["id"]] for r in learnt if r["y"] == y) for y in (0, 1)]
        e, whole = 1 / side[0] + 1 / side[1], side[0] + side[1]
        p = sum(k) / whole
        z = (k[1] / side[1] - k[0] / side[0]) / math.sqrt(p * (1 - p) * e + 0.5 * e / whole)
        weight[t] = (math.log((len(bags) + 1) / (sum(t in b for b in bags.values()) + 1)) + 1e-6) * max(z, 1.0) ** 1.5

    def vector(bag):
        v = {t: (1 + math.log(c)) * weight[t] for t, c in bag.items() if t in weight}
        length = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / length for t, w in v.items()}

    examples = {i: vector(bags[i]) for i in index}
    with_neighbours = 0
    for id_ in sorted(bags)[::7]:
        q = vector(bags[id_]) if any(t in weight for t in bags[id_]) else {}
        near = sorted(((round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12), i) for i, v in examples.items()), reverse=True)[:30]
        near = [(min(1.0, s), i) for s, i in near if s > 0]
        with_neighbours += bool(near)
        score = model.empty
        if near:
            votes = [sum(s / (0.05 + (1 - s)) for s, i in near if toxic[i] == y) for y in (0, 1)]
            prior = (total[1] + 0.5) / (total[0] + total[1] + 1)
            share = (total[0] / sum(toxic[i] == 0 for i in index)) / (total[1] / sum(toxic[i] == 1 for i in index))
            z = model.line[0] + model.line[1] * math.log((votes[1] + 0.3 * prior) / (share * votes[0] + 0.3 * (1 - prior)))
            score = 1 / (1 + math.exp(-z))
        assert abs(got[id_]["score"] - score) < 1e-6, id_
        assert [round(e["similarity"], 6) for e in got[id_]["evidence"]] == [round(s, 6) for s, _ in near[:3]]
    assert with_neighbours >= 0.95 * sum(bool(bags[i]) for i in sorted(bags)[::7])


def test_toxicity_on_held_out(spark):
    """Rows of the fold that no label is learnt from."""
    sf = "/root/testdata/sf0.1"
    truth = {i: y for i, y in rows("SELECT doc_id, max(toxic) FROM labels WHERE toxic IN (0, 1) GROUP BY 1", sf) if held(i)}
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs(spark, sf), labels).collect()}
    clean = [got[i]["predicted"] for i, y in truth.items() if y == 0]
    toxic = [got[i]["predicted"] for i, y in truth.items() if y == 1]
    print(sum(clean), len(clean), sum(toxic), len(toxic), len({round(r["score"], 9) for r in got.values()}))
    assert sum(clean) <= 0.01 * len(clean) and sum(toxic) >= 0.85 * len(toxic)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"]) for r in got.values())
    assert all(not held(e["doc_id"]) for r in got.values() for e in r["evidence"])


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, None), (7, 3), (None, 1), (6, 0), (6, 0)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        got = toxicity.score_toxicity(edge(spark), some).collect()
        assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0
    out = toxicity.without_toxic(edge(spark), labels)
    assert out.schema == edge(spark).schema and out.count() <= len(edge_rows())


@pytest.mark.parametrize("shard_bytes", [ann.SHARD_BYTES, 700_000])
def test_neighbours_recall(spark, shard_bytes):
    """All of the table in one shard of production size, and in several."""
    data = rows("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id", "/root/testdata/sf0.1")
    ids, vectors = np.array([d[0] for d in data]), np.array([d[1] for d in data], dtype=float)
    got = ann.neighbours(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), shard_bytes=shard_bytes).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    assert set(found) == {i for i in ids if i % 20 == 0}
    hit = 0
    for q, near in found.items():
        near.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in near] == list(range(1, 21))
        scores = (vectors * vectors[list(ids).index(q)]).sum(axis=1)
        assert np.allclose([r["score"] for r in near], [scores[list(ids).index(r["vec_id"])] for r in near], rtol=0, atol=1e-12)
        want = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        hit += len({r["vec_id"] for r in near} & set(want))
    assert hit >= 0.95 * 20 * len(found)


def test_recall_of_a_full_shard():
    """As many random vectors as a shard of production size holds: the hardest case, as they have no structure to follow."""
    n = ann.SHARD_BYTES // (12 * 64 + 5 * ann.MOST_LINKS + 60)
    vectors = np.random.default_rng(4).standard_normal((n, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    order, layers = ann.build(vectors)
    points = vectors[order]
    graph, queries = ann.Graph(points.astype(np.float32), layers), points[:256]
    found = graph.search(queries.astype(np.float32), ann.BEAM)
    scores = queries @ points.T
    want = np.argsort(-scores, axis=1)[:, :20]
    best = np.take_along_axis(found, np.argsort(-np.take_along_axis(scores, found, axis=1), axis=1)[:, :20], axis=1)
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(best.tolist(), want.tolist(), strict=True)]) >= 0.95
    assert graph.visited <= 0.3 * n * len(queries)


def test_layers_are_linked_within():
    vectors = np.random.default_rng(4).standard_normal((3000, 8))
    order, layers = ann.build(vectors)
    assert sorted(order.tolist()) == list(range(3000)) and [len(x) for x in layers] == [3000, 187]
    for links in layers:
        assert links.max() < len(links) and (links != np.arange(len(links))[:, None]).all()
        for row in links:
            row = row[row >= 0]
            assert len(row) and len(set(row.tolist())) == len(row)


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(i, [1.0, 0.0], "x") for i in range(0, 50)] + [(100, [0.0, 2.0], "x"), (100, [0.0, 2.0], "x"), (120, None, "x"), (140, [0.0, 0.0], "x"), (160, [nan, 1.0], "x"), (180, [inf, 1.0], "x"),
            (200, [None, 1.0], "x"), (220, [1.0, 1.0, 1.0], "x"), (None, [5.0, 5.0], "x"), (240, [], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, id string")
    got = {}
    for r in ann.neighbours(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 100}
    assert sorted(got[20]) == [(k + 1, k, 1.0) for k in range(20)] and [x[1] for x in sorted(got[0])] == list(range(1, 21))
    assert [x[1] for x in sorted(got[100])] == list(range(20))
    assert ann.neighbours(df.limit(0)).count() == 0


def test_labels_of_sf_are_used_only_outside_the_fold(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs(spark), labels, "doc_id", "text", "toxic")
    assert model.ids and not any(held(i) for i in model.ids)
