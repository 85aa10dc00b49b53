"""The stages one after the other, each checked on its own input."""

import hashlib
import random

import corpus_pipeline
from pitwarden.llm import factor_machine
from pitwarden.llm.common import stage
from test_operators import brute_components, prose

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = stage(step(spark, docs, SMALL), name)
        seen[name] = (before, docs)
    assert [c for _, after in list(seen.values())[:-1] for c in [after.columns]] == [columns] * 4
    before, after = seen["quality_classifier"]
    machine = factor_machine.train(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert after.count() == factor_machine.score_quality(before, machine).filter("score >= 0.3").count()
    before, after = seen["minhash_near_dedup"]
    assert after.count() == after.select("doc_id").distinct().count() < before.count()
    before, after = seen["suffix_array_dedup"]
    assert after.count() == before.count() and after.filter("n_chars <> length(text)").isEmpty()
    before, after = seen["temperature_mixing"]
    assert after.join(before, columns, "left_anti").isEmpty()
    before, after = seen["byte_level_bpe"]
    texts = {r.doc_id: r.text or "" for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


def test_near_duplicates_link_from_eighty_percent(spark):
    rng = random.Random(12)
    rows = []
    for family in range(12):
        base = prose(rng, 150).split(" ")
        for edits in (0, 2, 3, 4):  # likeness to the first: 1, 0.87, 0.81, 0.76
            own = base[:]
            for k in range(edits):
                own[10 + 30 * k + edits] = f"w{family}x{edits}"
            rows.append((len(rows), " ".join(own)))
    sets, label = brute_components(rows, 80)
    assert label[2] == 0 and label[3] == 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))
