import random

import pytest

import corpus_pipeline
from logloom.llm.decontam import edit_budget, normalise
from logloom.llm.mixing import mix_digest

from .helpers import classes, crc, infix_distance
from .test_simhash import fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(home / name))
        docs = out[name] = spark.read.parquet(str(home / name))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for name in ("toxicity", "near_dedup", "decontamination", "mixing"):
        assert stages[name].dtypes == stages["documents"].dtypes


def test_near_copies(stages):
    rows = stages["toxicity"].orderBy("doc_id").collect()
    prints = [fingerprint(r["text"]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = {rows[c]["doc_id"] for c in classes(len(rows), pairs)}
    assert {r["doc_id"] for r in stages["near_dedup"].collect()} == want


def test_benchmark_passages(spark, stages):
    bench = [normalise(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in stages["decontamination"].collect()}
    rng = random.Random(0)
    for r in stages["near_dedup"].collect():
        text = normalise(r["text"])
        exact = any(b in text for b in bench)
        assert not (exact and r["doc_id"] in kept)
        if r["doc_id"] not in kept and not exact:
            assert any(infix_distance(b, text) <= edit_budget(len(b))[0] for b in bench)
    sample = rng.sample(sorted(kept), 3)
    for r in stages["decontamination"].where(f"doc_id IN ({', '.join(map(str, sample))})").collect():
        text = normalise(r["text"])[:3000]
        assert all(infix_distance(b, text) > edit_budget(len(b))[0] for b in bench[:5])


def test_mixing_and_sharding(stages):
    want = {r["doc_id"]: r["copies"] for r in mix_digest(stages["decontamination"]).collect() if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in stages["mixing"].groupBy("doc_id").count().collect()}
    assert got == want
    rows = stages["sharding"].collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in stages["mixing"].collect())
    where = {}
    for r in rows:
        assert where.setdefault(r["text"], r["shard"]) == r["shard"]
    for k in range(40):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, stages["sharding"].collect()), key=str)
