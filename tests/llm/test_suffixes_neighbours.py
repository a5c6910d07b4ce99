import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import neighbours, suffixes

SPAN = suffixes.SPAN


def brute(texts):
    """(n_bytes, n_removed, n_spans, hash of what stays) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(x[i:i + SPAN] for x in data for i in range(len(x) - SPAN + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - SPAN + 1):
            if count[x[i:i + SPAN]] > 1:
                gone[i:i + SPAN] = b"\1" * SPAN
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return out


def got(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    return {k: sorted(v) for k, v in out.items()}


def want(ids, texts):
    out = defaultdict(list)
    for i, x in zip(ids, brute(texts), strict=True):
        out[i].append(x)
    return {k: sorted(v) for k, v in out.items()}


def test_repeats_of_documents(documents, texts):
    ids = sorted(texts)
    assert got(suffixes.op2(documents)) == want(ids, [texts[i] for i in ids])


def words(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.mark.parametrize("local, crowded", [(16, 256), (2, 256), (16, 3)])
def test_planted_repeats(make_docs, monkeypatch, local, crowded):
    """Passages of just below, at and above the length, shared by few and by many, inside and across texts;
    near copies; periodic texts.  Small bounds send the same cases through the count of crowded anchors."""
    monkeypatch.setattr(suffixes, "LOCAL", local)
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    r = random.Random(8)
    passages = [words(r, 200).encode()[:n].decode(errors="ignore") for n in (199, 200, 201, 260, 700)]
    texts = []
    for i in range(60):
        own = [words(r, r.randint(1, 60)) for _ in range(3)]
        own.insert(1, passages[i % 5] if i % 2 else words(r, 5))
        if i % 7 == 0:
            own.append(passages[4][100:350])
        texts.append("\n".join(own))
    texts += [texts[3], texts[3][:150] + "#" + texts[3][151:], words(r, 30) + texts[5], "ab" * 400, "x" * 500, "abc" * 150, "", None, passages[4]]
    texts += [passages[3] + str(i) for i in range(30)]
    docs = make_docs(texts).repartition(5)
    assert got(suffixes.op2(docs)) == want(range(len(texts)), texts)


def test_repeat_edges(edge_docs, no_docs):
    assert suffixes.op2(no_docs).count() == 0
    src = edge_docs.collect()
    assert got(suffixes.op2(edge_docs)) == want([r["doc_id"] for r in src], [r["text"] for r in src])


def test_transform_and_merge_against_sorting():
    r = random.Random(1)
    shards = [[bytes(r.choice(b"ab\0\xff") for _ in range(r.randint(1, 300))) for _ in range(r.randint(1, 5))] for _ in range(4)]
    shards[1].append(shards[0][0] + b"z" * 250)
    shards[2].append(b"q" * 230)
    shards[3].append(b"q" * 215)
    for strings in shards:
        last, starts, sizes = suffixes.transform(strings)
        order = sorted((s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        assert [0 if i == 0 else strings[k][i - 1] for _, k, i in order] == last.tolist()
        assert [next(n for n, (_, k, i) in enumerate(order) if (k, i) == (j, 0)) for j in range(len(strings))] == starts.tolist()
        assert sizes.tolist() == [len(s) for s in strings]
    marks = suffixes.repeated_intervals([suffixes.transform(s) for s in shards])
    count = Counter(s[i:i + SPAN] for strings in shards for s in strings for i in range(len(s) - SPAN + 1))
    for strings, own in zip(shards, marks):
        for s, m in zip(strings, own):
            assert m.tolist() == [count[s[i:i + SPAN]] > 1 for i in range(len(s) - SPAN + 1)]


def exact_neighbours(ids, vectors, k=5):
    v = np.array(vectors, float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i, q in enumerate(ids):
        if q % 50 == 0:
            s = unit @ unit[i]
            order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(s[j], 12), ids[j]))[:k]
            out[q] = [(ids[j], s[j]) for j in order]
    return out


def answers(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.orderBy("vec_id").collect()
    want_, found = exact_neighbours([r["vec_id"] for r in rows], [r["embedding"] for r in rows]), answers(neighbours.op9(vectors))
    assert set(found) == set(want_) and all(len(v) == 5 for v in found.values())
    hit = [len({a for a, _ in found[q]} & {a for a, _ in want_[q]}) / 5 for q in want_]
    assert np.mean(hit) >= 0.9
    score = {(q, a): s for q in want_ for a, s in want_[q]}
    assert all(abs(s - score[q, a]) < 1e-12 for q in found for a, s in found[q] if (q, a) in score)


def test_clustered_vectors_take_few_comparisons(spark, monkeypatch):
    """Clusters with one that holds a third of all rows: narrow windows, far fewer comparisons than an exact scan."""
    g = np.random.default_rng(11)
    centres = g.normal(0, 1, (200, 32))
    which = np.where(np.arange(6000) % 3 == 0, 0, g.integers(1, 200, 6000))
    v = centres[which] + g.normal(0, 0.08, (6000, 32))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    chosen, window = [], neighbours.window
    monkeypatch.setattr(neighbours, "window", lambda *a: chosen.append((*window(*a), a[3])) or chosen[-1][:2])
    found = answers(neighbours.op9(df))
    curves, width, n = chosen[0]
    assert n == 6000 and neighbours.comparisons(curves, width, n) < n
    want_ = exact_neighbours(list(range(6000)), v.astype(np.float32).tolist())
    assert np.mean([len({a for a, _ in found[q]} & {a for a, _ in want_[q]}) / 5 for q in want_]) >= 0.9
    monkeypatch.setattr(neighbours, "CHUNK", 7)  # a block's queries in many chunks give the same answers
    assert answers(neighbours.op9(df)) == found


def test_copies_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(300)] + [(300, [3.0, 2.0, 1.0], 0), (301, [0.0, 0.0, 0.0], 0), (350, None, 0), (400, [nan, 1.0, 1.0], 0),
                                                            (450, [1.0, None, 1.0], 0), (500, [inf, 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 0), (50, [1.0, 2.0, 3.0], 0), (550, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    found = answers(neighbours.op9(df))
    assert set(found) == {0, 50, 100, 150, 200, 250, 300}
    assert [a for a, _ in found[0]] == [1, 2, 3, 4, 5] and [a for a, _ in found[100]] == [0, 1, 2, 3, 4]
    assert [a for a, _ in found[300]] == [0, 1, 2, 3, 4]
    assert neighbours.op9(df.limit(0)).count() == 0 and neighbours.op9(df.filter("vec_id = 50")).count() == 0
    assert len(answers(neighbours.op9(df.filter("vec_id in (0, 300, 7)")))[0]) == 2


def test_hilbert_curve_visits_neighbouring_cells():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = neighbours.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()
