"""The pipeline's stages against brute force, and the subpackage's place in the entry point."""

from collections import Counter, defaultdict

import corpus_pipeline
from ledgerloom.llm import pii, quality
from ledgerloom.llm.queries import QUERIES
from tests.conftest import SF0001
from tests.llm.test_quality_secrets import brute
from tests.llm.test_sharding_mixing import expected_targets
from tests.llm.test_simhash_packing import brute_groups, brute_print, check_packing, tokens


def test_stages(spark, documents, labels, tmp_path):
    before = documents
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF0001).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == documents.columns
        a, b = before.collect(), after.collect()
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality.op4(before, labels).filter("kept").collect()}
            assert sorted(r["doc_id"] for r in b) == sorted(kept)
            assert not any(brute(r["text"])[-1] for r in b)
        elif name == "simhash_near_dedup":
            groups = brute_groups([(r["doc_id"], brute_print(r["text"])) for r in a])
            assert sorted(r["doc_id"] for r in b) == sorted(set(groups.values()))
        elif name == "pii_surrogates":
            want = {r["doc_id"]: r["text"] for r in pii.op10(before).collect()}
            assert {r["doc_id"]: r["text"] for r in b} == want
        elif name == "mix_sources":
            size, taken = Counter(), Counter()
            n = {r["doc_id"]: len(r["text"].encode().split()) for r in a}
            source = {r["doc_id"]: r["source"] for r in a}
            for d in n:
                size[source[d]] += n[d]
            for r in b:
                taken[r["source"]] += n[r["doc_id"]]
            target = expected_targets(size)
            assert max(Counter(r["doc_id"] for r in b).values()) <= 3
            assert all(abs(taken[s] - target[s]) <= 0.06 * target[s] + 8 for s in target)
        else:
            ids = {r["doc_id"]: tokens(r["text"]) for r in a}
            check_packing(b, ids.__getitem__)
            copies = defaultdict(set)
            for r in b:
                copies[r["doc_id"]].add(r["row"])
            assert {d: len(x) for d, x in copies.items()} == Counter(r["doc_id"] for r in a)
        before = after


def test_registered():
    import __spark_entry__
    keys = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES} and set(QUERIES) | {"pipeline"} <= set(keys)
    assert set(QUERIES) & set(__spark_entry__.oracle_sql()) == {"op13_benchmark_windows"}
