import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import decontamination, runs, whitening
from tests.conftest import SF0001

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- operator 11: runs -----------------------------------------------------------------------------------------------

def brute_runs(w, least=24, times=3):
    """Every distance's maximal stretches; the smallest distance of a stretch is its period."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((i, n, q) for (i, n), q in out.items())


def number(docs):
    sizes = [len(d) for d in docs]
    return np.array([x for d in docs for x in d], np.int64), np.repeat(np.cumsum(sizes), sizes).astype(np.int64)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=90), st.lists(st.tuples(st.integers(0, 89), st.integers(1, 20), st.integers(1, 80)), max_size=3)), min_size=1, max_size=3),
       st.sampled_from([(24, 3), (24, 3), (9, 3), (6, 4), (24, 5)]))
def test_runs_are_those_of_brute_force(drawn, law):
    docs = []
    for w, repeats in drawn:
        for at, period, more in repeats:
            for i in range(at + period, min(len(w), at + period + more)):
                w[i] = w[i - period]
        docs.append(w)
    words, ends = number(docs)
    want, before = [], 0
    for d in docs:
        want += [(i + before, n, q) for i, n, q in brute_runs(d, *law)]
        before += len(d)
    assert runs.runs(words, ends, *law) == sorted(want)


def test_runs_of_long_texts():
    a, b = [0], [0, 1]
    while len(b) < 30000:
        a, b = b, b + a
    fib = np.array(b[:30000])
    assert runs.runs(np.zeros(30000, np.int64), np.full(30000, 30000)) == [(0, 30000, 1)]
    found = runs.runs(fib, np.full(len(fib), len(fib)))
    head = runs.runs(fib[:1500], np.full(1500, 1500))
    assert head == brute_runs(fib[:1500].tolist()) and [r for r in found if r[0] + r[1] < 1400] == [r for r in head if r[0] + r[1] < 1400]
    with pytest.raises(ValueError):
        runs.runs(fib, np.full(len(fib), len(fib)), 24, 2)


def digest(doc_id, text):
    """The contract, word by word."""
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode()) & 0xFFFFFFFF
        g = h // 10
        if h % 10 == 0 and n:
            a, original = g % n, list(w)
            p = 1 + (n - a) // (3 + g % 8)
            w = [original[i] if i < a else original[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)), n)


def test_op11_follows_the_contract(documents, texts):
    got = runs.op11(documents).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"}
    short = {d: t for d, t in texts.items() if len(t) < 20000}
    assert sum(r["n_runs"] > 0 for r in got) > 10 and len(got) == len(texts)
    assert sorted(tuple(r) for r in got if r["doc_id"] in short) == sorted(digest(d, t) for d, t in short.items())


def test_runs_edges(edge_docs, no_docs, make_docs):
    assert runs.op11(no_docs).count() == 0
    got = Counter(tuple(r) for r in runs.op11(edge_docs).collect() if r["n_words"] < 1000)
    rows = edge_docs.select("doc_id", "text").collect()
    assert got == Counter(digest(*r) for r in rows if len(r["text"] or "") < 20000)
    line = "a b c d e f g   h "
    texts = [line * 9, line * 9 + "x " + line * 9, "w " * 23, "w " * 24, "  " * 30]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10][:5]
    assert sorted(tuple(r) for r in runs.op11(make_docs(texts, ids)).collect()) == sorted(digest(i, t) for i, t in zip(ids, texts, strict=True))
    kept = runs.periodic_runs(make_docs(["p q " * 20 + "end"]), "doc_id", "text").first()
    assert kept["collapsed"] == "p q end" and kept["runs"][0].asDict() == {"start": 0, "length": 40, "period": 2}


# ---- operator 12: whitening ------------------------------------------------------------------------------------------

def check_whitening(vectors, got, tolerance=1e-7):
    """``vectors`` (id, entries) that take part, against exact sums and an eigensystem of its own."""
    ints = [(i, tuple(int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v)) for i, v in vectors]
    fit = sorted({x for _, x in ints})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    centred = [[n * x[d] - sums[d] for d in range(dims)] for x in fit]
    cov = np.array([[float(Fraction(sum(z[a] * z[b] for z in centred), n ** 3)) for b in range(dims)] for a in range(dims)])
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(16, int((value > value[0] * 1e-13).sum()))
    rows = {}
    for r in got:
        rows.setdefault((r["vec_id"], r["deviation_exact"]), {}).setdefault(r["component"], []).append(r)
    assert len(got) == k * len(ints) and all(r["n"] == n and r["identity_error"] <= 1e-4 for r in got)
    exact = Counter((i, sum((n * x[d] - sums[d]) ** 2 for d in range(dims))) for i, x in ints)
    assert Counter({key: len(c[1]) for key, c in rows.items()}) == exact
    assert all(r["deviation"] == (int(r["deviation_exact"]) if r["deviation_exact"] < 1 << 63 else None) for r in got)
    for r in got:
        assert abs(r["explained"] - value[r["component"] - 1] / np.trace(cov)) <= 1e-4 * r["explained"]
    gap = [min(abs(value[c] - value[c - 1]) if c else np.inf, abs(value[c] - value[c + 1]) if c + 1 < len(value) else np.inf) / value[0] for c in range(k)]
    for c in range(k):
        if gap[c] < 1e-6:  # the vector of a near-double eigenvalue is not determined
            continue
        mine = {(i, sum((n * x[d] - sums[d]) ** 2 for d in range(dims))): sum(float(Fraction(n * x[d] - sums[d], n)) * vector[d, c] for d in range(dims)) / np.sqrt(value[c]) for i, x in ints}
        pairs = [(rows[key][c + 1][0]["whitened"], y) for key, y in mine.items() if exact[key] == 1]
        sign = np.sign(sum(a * b for a, b in pairs)) or 1
        assert all(abs(a - sign * b) <= tolerance / gap[c] ** 0.5 + tolerance for a, b in pairs)


def test_op12_follows_the_contract(spark):
    vectors = spark.read.parquet(f"{SF0001}/embeddings.parquet")
    check_whitening([(r["vec_id"], r["embedding"]) for r in vectors.limit(10**6).collect()], whitening.op12(vectors).collect())


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, x string, whitened double, n int")


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7) / 8, -float(i * i % 11), 0.25 * (i % 3), 5.0]) for i in range(40)] + [(None, [1.0, 2.0, 3.0, 5.0]), (3, [0.5, 0.5, 0.5, 5.0]), (3, [0.5, 0.5, 0.5, 5.0])]
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0]), (92, [nan, 1.0, 1.0, 1.0]), (93, [1.0, inf, 1.0, 1.0]), (94, []), (95, [1.0, 2.0]), (96, [3e38, 1.0, 1.0, 1.0])]
    check_whitening(good, whitening.op12(vectors_of(spark, good + bad)).collect())  # the constant dimension has no component
    for few in ([], bad[:4], good[:1], [good[5]] * 3):
        assert whitening.op12(vectors_of(spark, few)).collect() == []


def test_whitening_of_large_entries_stays_exact(spark):
    rows = [(i, [float(2 ** 40 * (i % 5)), float(i - 8) * 2 ** 30, float(i * i)]) for i in range(17)]
    got = whitening.op12(vectors_of(spark, rows)).collect()
    check_whitening(rows, got, 1e-5)
    assert any(r["deviation"] is None for r in got) and max(r["deviation_exact"] for r in got) > 1 << 63


def test_polarised_sums_give_the_covariance():
    y = np.random.default_rng(4).integers(-300, 300, (500, 9))
    q = whitening.polarised(y)
    assert all(q[a, b] == (((y[:, a] + y[:, b]) ** 2).sum() if a != b else (y[:, a] ** 2).sum()) for a in range(9) for b in range(a, 9))
    x = y + 1_000_000
    fit = whitening.Fit(500, x.sum(0).tolist())
    own = whitening.polarised(x - fit.centre)
    fit.solve({(a, b): own[a, b] for a in range(9) for b in range(a, 9)})
    assert np.allclose(fit.cov, np.cov(y.T, bias=True), rtol=1e-12, atol=1e-9)


# ---- operator 13: windows of benchmark items -------------------------------------------------------------------------

def lower_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_windows(docs, items, window=10):
    where = {}
    for item, text in items:
        w = lower_words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            where.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = lower_words(text), set(), set()
        for n in {len(k) for k in where}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in where:
                    hit |= set(range(i, i + n))
                    found |= where[tuple(w[i:i + n])]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((doc_id, len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def test_op13_follows_the_contract(spark, documents):
    items = spark.read.parquet(f"{SF0001}/benchmark.parquet")
    got = decontamination.op13(documents, items)
    want = brute_windows([tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    rows = [tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(rows) == sorted(want) and sum(r[-1] for r in rows) > 1


@pytest.fixture(scope="module")
def make_items(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "w", 1, "z") for i, t in rows], "item_id long, text string, window string, row int, words string")
    return make


def test_windows_edges(edge_docs, no_docs, make_docs, make_items):
    base = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, base), (10, base.upper()), (2, "née ZOË"), (3, "x"), (4, None), (5, ""), (6, "?! ..."), (None, "alpha beta gamma"), (7, "a a a a a a a a a a a"),
             (7, "a a a a a a a a a a a"), (8, "one two three four"), (9, "plain words that says a thing and another line with more words")]
    docs = [base, "zero " + base + " " + base, "one-two,three four five six seven eight nine ten", "One two THREE four five six seven eight nine", "a " * 30, "a " * 9,
            "alpha beta alpha Beta, gamma", "née zoë née", "one two three one two three four", base.replace("six", "six six"), None, "?", base, base]
    bench = make_items(items)
    for d in (make_docs(docs), edge_docs):
        rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
        got = Counter(tuple(r) for r in decontamination.op13(d, bench).collect())
        assert got == Counter(brute_windows(rows, items))
    assert decontamination.op13(no_docs, bench).count() == 0
    clean = decontamination.op13(make_docs(docs), make_items([])).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] for r in clean)


def test_a_window_hangs_on_its_rarest_shingle(make_docs, make_items):
    common = "the usual words of every page here"
    docs = [common + f" w{i}" for i in range(50)] + ["start " + common + " rare ending of text"]
    read, hits = decontamination.contamination(make_docs(docs), make_items([(1, common + " rare ending of")]), "doc_id", "text", "item_id", "text")
    assert [(r["start"], r["length"], r["item_id"]) for r in hits.collect()] == [(1, 10, 1)] and read.count() == 51


def test_a_full_bitmap_only_lets_more_through(make_docs, make_items, monkeypatch):
    monkeypatch.setattr(decontamination, "BITS", (16, 16))
    monkeypatch.setattr(decontamination, "EACH", 1)
    docs = [" ".join(f"v{(i * 7 + j * j) % 97}" for j in range(40)) for i in range(60)]
    items = [(i, docs[i * 3][5:60]) for i in range(15)]
    got = sorted(tuple(r) for r in decontamination.op13(make_docs(docs), make_items(items)).collect())
    assert got == sorted(brute_windows(list(enumerate(docs)), items))
