import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import packing, simhash


def brute_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    names = sorted({p for _, p in prints})
    root = {p: p for p in names}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for d, p in prints:
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
    return {(d, p): least.get(find(p)) for d, p in prints}


def test_groups(documents, texts):
    rows = simhash.op8(documents).collect()
    want = brute_groups([(d, brute_print(t)) for d, t in texts.items()])
    assert {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in rows} == want and len(rows) == len(texts)


def test_group_edges(edge_docs, no_docs):
    assert simhash.op8(no_docs).count() == 0 and simhash.stage(no_docs).count() == 0
    src = edge_docs.collect()
    want = brute_groups([(r["doc_id"], brute_print(r["text"])) for r in src])
    rows = simhash.op8(edge_docs).collect()
    assert len(rows) == len(src)
    assert {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in rows} == want
    stay = simhash.stage(edge_docs)
    assert stay.columns == edge_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in stay.collect()) == [(False, 1), (False, 4), (False, 5), (False, 9), (True, None)]


@pytest.mark.parametrize("block", [4, 1024])
def test_links_of_crowded_cells(spark, monkeypatch, block):
    """Chains of fingerprints one to three bits apart, in cells above and below the block size."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    g = random.Random(2)
    prints = set()
    for _ in range(12):
        p = g.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            for b in g.sample(range(64), g.randint(1, 4)):
                p ^= 1 << b
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    got = simhash.grouped(spark.createDataFrame(signed, "id long, fp long"), "id").collect()
    want = brute_groups([(i, p & (1 << 64) - 1) for i, p in signed])
    assert {r["fp"] & (1 << 64) - 1: r["component_id"] for r in got} == {p: c for (_, p), c in want.items()}


def test_manhattan_is_a_lower_bound():
    g = np.random.default_rng(4)
    a, b = g.integers(0, 1 << 63, (2, 2000), np.uint64)
    b[:1000] = a[:1000] ^ (np.uint64(1) << g.integers(0, 64, 1000).astype(np.uint64))
    assert (simhash._manhattan(a, b) <= np.bitwise_count(a ^ b)).all()


def tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(rows, ids_of):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["row"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for (doc, _), own in by_doc.items():
        ids, own = ids_of(doc), sorted(own, key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 2048 for r in own[1:])
        for r in own:
            part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) <= 2048
    return len(by_sequence)


def test_packing(documents, texts):
    rows = packing.op6(documents).collect()
    ids = {d: tokens(t) for d, t in texts.items()}
    n = check_packing(rows, ids.__getitem__)
    assert {r["doc_id"] for r in rows} == set(texts)
    assert n <= 1.02 * sum(map(len, ids.values())) / 2048 + 1


def test_packing_over_a_tree(documents, texts):
    ids = {d: tokens(t) for d, t in texts.items()}
    rows = packing.pack(packing.tokenized(documents, "doc_id", "text"), leaf_rows=6).collect()
    assert check_packing(rows, ids.__getitem__) <= 1.1 * sum(map(len, ids.values())) / 2048 + 1


def test_packing_edges(edge_docs, no_docs):
    assert packing.op6(no_docs).count() == 0
    texts = [r["text"] for r in edge_docs.collect()]
    own = edge_docs.drop("doc_id").withColumn("doc_id", F.monotonically_increasing_id())
    number = {r["doc_id"]: r["text"] for r in own.collect()}
    check_packing(packing.op6(own).collect(), lambda d: tokens(number[d]))
    assert sorted(map(str, number.values())) == sorted(map(str, texts))
    rows = packing.op6(edge_docs).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, None, 4, 5, 6, 9}
    assert len({r["row"] for r in rows}) == edge_docs.count()


@pytest.mark.parametrize("odd", ["a  b", " lead", "tail ", "a\n\nb", "", " ", "\n", "I'm don't we'll", "x\ty\r\nz", "　wide b",
                                 "\u0085a b", "\x1c a b\x1d c", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y <|endoftext", "1 22 333 a1b2", "é ü ñ\n\nß", "a b", "a᠎b"])
def test_encoder_agrees_with_the_tokenizer(odd):
    import public_tokenizers
    import pyarrow as pa

    from ledgerloom.llm.common import utf8
    own = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))
    batch = ["The first text.", odd, "another text\nwith lines", odd, odd + "x", "x" + odd]
    ids, edge = own.encode(*utf8(pa.array(batch)))
    for i, text in enumerate(batch):
        assert ids[edge[i]:edge[i + 1]].tolist() == tokens(text)[:-1]


def test_closed_bins_change_no_result(monkeypatch):
    """The tree packs into as many sequences as one that hands up every bin."""
    g = random.Random(8)

    def tree(lengths, keep_all):
        groups = [lengths[i::32] for i in range(32)]
        groups = [[(n, [i]) for i, n in enumerate(x)] for x in groups]
        closed = 0
        with monkeypatch.context() as m:
            if keep_all:
                m.setattr(packing, "FAN_IN", 10 ** 9)
            for level, left in ((0, 2), (1, 1), (2, 0)):
                packed = [packing._pack(k, [f for f, _ in x], [h for _, h in x], level, left) for k, x in enumerate(groups)]
                closed += sum(r[2] is not None for x in packed for r in x)
                still = [[(r[1], r[3]) for r in x if r[2] is None] for x in packed]
                groups = [sum(still[i:i + 8], []) for i in range(0, len(still), 8)]
        return closed

    for law in (lambda: g.randint(1, 2048), lambda: g.choice([1500, 1500, 1500, 300]), lambda: min(2048, int(g.expovariate(1 / 400)) + 1), lambda: g.choice([1025, 1023])):
        lengths = [law() for _ in range(4000)]
        assert tree(lengths, False) == tree(lengths, True)


def test_best_fit_fills_bins():
    bins = packing.best_fit([1000, 1048, 2000, 48, 500, 500, 1048], 2048)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(7))
