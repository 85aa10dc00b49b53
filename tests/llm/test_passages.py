"""The pipeline's passages: over 50 words, though shorter than the 400 bytes of op9's contract."""

import random

import corpus_pipeline
from pitwarden.llm import repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_passages_of_over_fifty_words_leave_all_documents(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(55))
    line = " ".join(word() for _ in range(30))
    own = [" ".join(word() for _ in range(80)) for _ in range(4)]
    assert 250 <= len(passage) < 400 and len(line) < 250
    texts = [f"{own[0]} {passage} {own[1]}", f"{own[2]} {passage}", f"{own[3]} {line}", f"{line} {own[1][:200]}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert all(passage not in t for t, _ in got.values())
    assert got[0][0].startswith(own[0]) and got[0][0].endswith(own[1]) and got[1][0].startswith(own[2])
    assert got[2][0] == texts[2] and got[3][0] == texts[3]
    assert all(n == len(t) for t, n in got.values())


def test_the_contract_length_of_the_operator_stays():
    assert repeats.RepeatRule().length == 400
