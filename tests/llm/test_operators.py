"""Each text operator on small tables: edge cases, and brute force, an exact round trip or held-out accuracy."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pitwarden.llm import chosen_path, factor_machine, license_search, line_crf, lz_fingerprint, rank_queue_bpe, repeats, temperature_mixing, url_filter, warc_transactions
from pitwarden.llm.induced_sort import permuted_lcp, suffix_array
from pitwarden.llm.queries import QUERIES, URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join(rng.choice(["the", "ores", "tion", "hean", "ing", "ould"]) + rng.choice("abcdefgh") + rng.choice("klmnop") for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    long = prose(rng, 9000)
    shared = prose(rng, 90)
    rows = [
        (1, prose(rng, 120)), (2, None), (3, ""), (4, long), (5, long), (5, long), (6, shared + " " + prose(rng, 60)), (7, prose(rng, 50) + " " + shared),
        (8, "Ünïcode " * 3 + "é\U0001f642"), (9, " \t\n\x0b "), (None, "no id here"), (10, long[:-200]),
    ]
    return spark.createDataFrame([(i, t, "en", None if i == 1 else f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_line_field_counts_and_clash(spark, docs):
    field = line_crf.LineField(np.zeros((2, line_crf.N_FEATURES)), np.zeros((2, 2)), np.array([1.0, 0.0]))
    got = line_crf.line_quality(docs.withColumnRenamed("lang", "kept"), field).collect()
    assert len(got) == 12 and all(isinstance(r.kept, bool) for r in got)
    for r in got:
        w = words(r.text)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        repeated = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)} if len(w) < 500 else None
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert repeated is None or r.n_repeat_words == len(repeated)
        assert r.kept == (not r.base_failed)
    assert line_crf.repeated_words([b"a"] * 9) == 9 and line_crf.repeated_words([b"a"] * 8) == 0
    assert line_crf.line_quality(docs.limit(0), field).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        e, step, first = rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
        score = lambda y: first[y[0]] + sum(e[t, y[t]] for t in range(5)) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        best = max(([k >> t & 1 for t in range(5)] for k in range(32)), key=score)
        assert line_crf.viterbi(e, step, first) == best


def test_line_field_learns(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    field = line_crf.train(docs, labels, line_crf.LabelRule(max_documents=120))
    rows = line_crf.line_quality(docs.select("doc_id", "text"), field).join(labels, "doc_id").filter("NOT base_failed AND quality = 1").collect()
    assert np.mean([r.kept for r in rows]) > 0.97


def test_symbols_are_those_of_the_class():
    flat = line_crf.LineField(np.zeros((2, line_crf.N_FEATURES)), np.zeros((2, 2)), np.zeros(2))
    for text in ("see [[wiki]] a[0] [1] #2", "# [x] * $ % & | < > ]", "[]", ""):
        assert line_crf.judge(text, flat, line_crf.LabelRule())[2] == len(re.findall(r"[#*$%&|<>]", text))


def test_line_field_is_trained_on_whole_texts(spark, monkeypatch):
    rows = [(1, "\n" * 100 + "late line"), (2, "\n".join(f"line {i} of many" for i in range(150))), (3, "one line\n\nanother"), (4, "# | # |")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    seen, fit = [], line_crf.fit_field
    monkeypatch.setattr(line_crf, "fit_field", lambda texts, *a, **k: seen.append(sorted(len(y) for _, y in texts)) or fit(texts, *a, **k))
    field = line_crf.train(docs, labels, line_crf.LabelRule(rounds=2, epochs=3))
    assert seen == [[1, 1, 2, 150]] * 2 and all(np.isfinite(p).all() for p in (field.emit, field.step, field.first))


def test_fingerprints(spark, docs):
    got = lz_fingerprint.edited_pairs(docs, 3).collect()
    order = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (-(r.doc_id if r.doc_id is not None else -1), r.text or ""))
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(order)
    for here, after in zip(order, order[1:] + order[:1], strict=True):
        if here.doc_id != 5:
            text, nxt, r = here.text or "", after.text or "", by_id[here.doc_id]
            edited = text[: len(text) - len(text) // 3] + nxt[: len(text) // 3]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            one, other, third = map(lz_fingerprint.fingerprint, (text, edited, nxt))
            assert r.fingerprint == one.astype(">u4").tobytes().hex() and r.edited_fingerprint == other.astype(">u4").tobytes().hex()
            assert r.near_next == lz_fingerprint.likeness(one, third) and 0 <= r.near_edited <= 1
    assert by_id[4].fingerprint == by_id[5].fingerprint
    assert lz_fingerprint.edited_pairs(docs.limit(0), 3).count() == 0
    assert lz_fingerprint.edited_pairs(docs.filter("doc_id = 1"), 3).head().near_next == 1.0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u\r\nv", "x\r\n\r\nWARC/1.1\r\ny"), (6, "q", "same"), (6, "q", "same"), (None, "n", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.record_type): r for r in warc_transactions.page_transactions(pages, str(tmp_path / "a")).collect()}
    assert got[2, "response"].refers_to is None and got[1, "revisit"].refers_to == 2
    assert got[4, "response"].payload_bytes == 0 and got[3, "revisit"].refers_to == 4
    for i, _, html in rows:
        raw = (html or "").encode()
        r = next(v for k, v in got.items() if k[0] == i)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    nested = warc_transactions.captures(warc_transactions.read_records(spark, str(tmp_path / "a"))).collect()
    assert len(nested) == 7 and {r.copies for r in nested} == {1, 2}
    assert all(r.request.http.startswith("GET ") and r.metadata.fields["payload-length"] for r in nested)
    assert next(r for r in nested if r.metadata.fields.get("page-id") == "5").response.payload == b"x\r\n\r\nWARC/1.1\r\ny"
    assert warc_transactions.page_transactions(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_url_rules_and_model(spark):
    weights = url_filter.fit(spark.createDataFrame(list(url_filter.LABELLED), "url string, label int"))
    urls = [
        ("https://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://b.org/x", "b.org", "/x", "org/", "allow"), ("http://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"), ("http://b.com/de/a", "b.com", "/de/a", "com/de/", "block"),
        ("http://borg/es/", "borg", "/es/", None, None), (None, "", "", None, None), ("no scheme", "", "", None, None), ("http://h", "h", "", None, None),
        ("https://m.casino-win.example.net/en/9", "m.casino-win.example.net", "/en/9", None, "block"), ("https://blog.ththen.example.net/en/9", "blog.ththen.example.net", "/en/9", None, "allow"),
        ("http://x/" + "a" * 50_000, "x", "/" + "a" * 50_000, None, None),
    ]
    df = spark.createDataFrame([(i, u[0], 1.5) for i, u in enumerate(urls)], "page_id long, url string, score double")
    for r in url_filter.filter_urls(df, URL_RULES, weights).collect():
        _, host, path, rule, verdict = urls[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and 0 <= r.score <= 1
        assert verdict in (None, r.verdict)
    assert url_filter.filter_urls(df.limit(0), URL_RULES, weights).count() == 0


def test_url_table_does_not_copy_the_test_hosts(spark):
    table = [u for u, _ in url_filter.LABELLED]
    assert len(table) == 168 and not [u for u in table for part in ("ththe", "tionand", "erthin", "oningre", "/en/", "/de/", "/fr/", "/es/", "example") if part in u]
    weights = url_filter.fit(spark.createDataFrame(list(url_filter.LABELLED), "url string, label int"))
    urls = spark.createDataFrame([(1, "http://museum.org/"), (2, "http://free-poker.com/")], "page_id long, url string")
    assert {r.page_id: r.score >= 0.5 for r in url_filter.filter_urls(urls, (), weights).collect()} == {1: False, 2: True}


def brute_components(texts, percent=85):
    sets = {}
    for i, t in texts:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return sets, label


@pytest.mark.parametrize("limit", [64, 3])
def test_chosen_path(spark, limit):
    rng = random.Random(8)
    base = prose(rng, 150).split(" ")
    rows = [(0, None), (1, ""), (2, "A b c"), (3, "a B c"), (4, " ".join(base)), (5, " ".join(base).upper())]
    for i in range(6, 40):  # a family of edits whose members are partly linked
        own = base[:]
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(len(own))] = f"w{i}"
        rows.append((i, " ".join(own)))
    rows += [(i, prose(rng, 80)) for i in range(40, 50)]
    rule = chosen_path.JoinRule(node_limit=limit, max_depth=2, chunk=8)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    sets, label = brute_components(rows)
    got = {r.doc_id: r for r in chosen_path.near_duplicates(docs, rule).collect()}
    assert {i: r.component_id for i, r in got.items()} == label
    assert all(r.n_shingles == len(sets[i]) and r.kept == (label[i] == i) for i, r in got.items())
    kept = chosen_path.keep_first(docs.unionByName(docs.filter("doc_id IN (4, 41)")), rule)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))


def test_near_duplicates_of_nothing(spark, docs):
    assert chosen_path.near_duplicates(docs.limit(0)).count() == 0
    assert chosen_path.keep_first(docs.filter("doc_id IS NULL")).count() == 1


def test_bpe_equals_the_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    raw = rank_queue_bpe.read_ranks(spark, path)
    rng = random.Random(2)
    odd = spark.createDataFrame([(100 + i, t, "en", "s", 0) for i, t in enumerate(["a" * 4000, "ab" * 3000, " \x85\xa0\x1c x\r\n\n  y", "".join(rng.choice("abcédеж é中🙂") for _ in range(3000)), "<|endoftext|>"])], DOCS)
    given = docs.unionByName(odd).withColumnRenamed("lang", "n_tokens")
    both = rank_queue_bpe.decode_column(rank_queue_bpe.encode_column(given, raw, public_tokenizers.PATTERN), raw, public_tokenizers.PATTERN).collect()
    for r in both:
        assert r.ids == library.encode_ordinary(r.text or "") and r.decoded.decode() == (r.text or "") and r.n_tokens == len(r.ids)
    digest = {r.text: r for r in rank_queue_bpe.round_trip(given, raw, public_tokenizers.PATTERN).collect()}
    for r in both:
        assert digest[r.text].ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert digest[r.text].decoded_sha256 == hashlib.sha256(r.decoded).hexdigest()


def test_rank_queue_order():
    queue, rng, held = rank_queue_bpe.RankQueue(), random.Random(6), []
    for _ in range(3000):
        if held and rng.random() < 0.45:
            assert queue.take() == min(held)
            held.remove(min(held))
        else:
            held.append((rng.randrange(1 << 18) if rng.random() < 0.5 else rng.randrange(40), rng.randrange(10**6)))
            queue.push(*held[-1])


def test_factor_machine(spark, docs):
    sf = SMALL.replace("0.001", "0.01")
    table, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    machine = factor_machine.train(table, labels)
    rows = factor_machine.score_quality(table, machine).join(labels, "doc_id").filter(factor_machine.held_out(F.col("doc_id"))).collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.98 and min(good) >= 0.3
    got = factor_machine.score_quality(docs.withColumnRenamed("lang", "score"), machine).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert factor_machine.reject_poor(docs, machine).columns == docs.columns
    assert factor_machine.score_quality(docs.limit(0), machine).count() == 0
    flat = factor_machine.train(docs, labels.limit(0))
    assert {r.score for r in factor_machine.score_quality(docs, flat).collect()} == {0.5}


def test_pair_identity():
    rng = np.random.default_rng(0)
    m = factor_machine.Machine(0.3, rng.normal(size=9).astype(np.float32), rng.normal(size=(9, 3)).astype(np.float32))
    slots, x = np.arange(9), rng.normal(size=9).astype(np.float32)
    pairs = sum(float(m.factors[i] @ m.factors[j]) * x[i] * x[j] for i in range(9) for j in range(i))
    assert factor_machine.margins(m, slots, x, np.array([0]))[0][0] == pytest.approx(0.3 + float(m.linear @ x) + pairs, rel=1e-4)


def test_license_notices(spark, docs):
    rows = [
        (1, "x Under the MIT License, and under-the-mit license y", 2, "mit", "mit"), (2, "Apache License, Version 2.0 (cc by-nc)", 2, "apache-2,cc-by-nc", "apache-2,cc-by-nc"),
        (3, "Releasd undr the MIT License.", 0, "", "mit"), (4, "licensed under the Apache License, Version 3", 0, "", ""), (5, "Licensed under the GNU General Public Licence", 0, "", "gpl"), (6, None, 0, "", ""),
        (7, "under the mit licenses", 0, "", ""),
    ]
    got = {r.doc_id: r for r in license_search.license_notices(spark.createDataFrame([(i, t, "z") for i, t, *_ in rows], "doc_id long, text string, labels string")).collect()}
    for i, t, n, base, labels in rows:
        r = got[i]
        assert (r.n_base, r.base_labels, r.labels) == (n, base, labels) and 0 <= r.score <= 1
        assert r.n_words == len(license_search.WORD.findall((t or "").lower()))
    assert (got[1].first_word, got[1].last_word) == (1, 6) and got[6].first_word is None
    assert got[3].spans[0].errors == 2 and (got[3].spans[0].start, got[3].spans[0].end) == (0, 5)
    assert license_search.license_notices(docs.limit(0)).count() == 0


def test_stacked_notices_are_all_found():
    rule = license_search.NoticeRule()
    twice = "permision is hereby granted free of charge permission is hereby granted free of charge"
    assert [f[1:] for f in license_search.find_notices(twice, rule)] == [(0, 42, 1), (43, 86, 0)]
    assert license_search.scan("mozilla pblic licence version 2 mozilla public license version 3", rule)[5] == "mpl-2"
    many = " ".join(["released under the mit license"] * 50)
    assert [f[1:3] for f in license_search.find_notices(many, rule)] == [(31 * k, 31 * k + 30) for k in range(50)]


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for trial in range(120):
        k = rng.choice([1, 2, 3, 26])
        body = [rng.randint(1, k) for _ in range(rng.randint(1, 200))]
        t = np.array((body[:17] * 9 if trial % 3 == 0 else body) + [0], np.uint16)
        text = t.tolist()
        sa = suffix_array(t, k + 1)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])  # noqa: B023
        p = permuted_lcp(t, sa, 1000)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            n = 0
            while a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert p[b] == n


@pytest.mark.parametrize("key_segments", [1000, 2])
def test_repeats(spark, key_segments):
    rng = random.Random(3)
    passage, other = prose(rng, 30), prose(rng, 22)
    rows = [(i, prose(rng, rng.randint(0, 30)) + passage + prose(rng, rng.randint(0, 30))) for i in range(12)]
    rows += [(20, passage), (21, None), (22, ""), (23, "é" * 90 + other + other), (24, "z" * 700), (25, prose(rng, 80)), (26, rows[0][1]), (26, rows[0][1]), (None, "ü" * 20 + other)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_bytes long")
    rule = repeats.RepeatRule(length=60, gram=12, key_segments=key_segments, shard_bytes=2000, blocks=(8, 1))
    seen = {}
    for _, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 59):
            seen[raw[k : k + 60]] = seen.get(raw[k : k + 60], 0) + 1
    want = {}
    for i, t in rows:
        raw = (t or "").encode()
        mask = [any(seen[raw[k : k + 60]] > 1 for k in range(max(0, j - 59), min(j, len(raw) - 60) + 1)) for j in range(len(raw))]
        kept = bytes(b for b, m in zip(raw, mask, strict=True) if not m)
        want[i] = (len(raw), sum(mask), sum(m and not (j and mask[j - 1]) for j, m in enumerate(mask)), hashlib.sha256(kept).hexdigest())
    got = repeats.repeat_report(docs, rule).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    clean = repeats.remove_repeats(docs, rule, count="n_bytes")
    assert clean.columns == docs.columns and all(r.n_bytes == len(r.text or "") or r.text is None for r in clean.collect())
    assert repeats.repeat_report(docs.limit(0), rule).count() == 0


def test_mixing(spark, docs):
    rows = [(i, "a b c d", "big") for i in range(300)] + [(1000 + i, "a b", "small") for i in range(20)] + [(2000, None, "none"), (2001, "x y z", None)]
    table = spark.createDataFrame([(i, t, s, 7) for i, t, s in rows], "doc_id long, text string, source string, epoch long")
    rule = temperature_mixing.MixRule(entropy=0.6, max_epochs=30.0, blocks=4)
    plan = {r.src: r for r in temperature_mixing.source_plan(table, rule).collect()}
    p = np.array([1200, 40, 3]) / 1243
    w = p ** plan["big"].exponent
    assert -(w / w.sum() * np.log(w / w.sum())).sum() == pytest.approx(0.6 * np.log(3), abs=1e-4)
    got = temperature_mixing.mix(table, rule).collect()
    spent = {}
    for r in got:
        spent[r.source] = spent.get(r.source, 0) + r.n_tokens
    for source, unit in (("big", 4), ("small", 2), (None, 3)):
        budget = plan[source or ""].budget
        assert budget - unit < spent.get(source, 0) <= budget
    small = [r for r in got if r.source == "small"]
    assert len({(r.doc_id, r.epoch) for r in small}) == len(small) and sum(r.source == "none" for r in got) == 1
    limited = {r.src: r for r in temperature_mixing.source_plan(table, temperature_mixing.MixRule(entropy=1.0, max_epochs=2.0, blocks=4)).collect()}
    assert max(r.budget / r.tokens for r in limited.values() if r.tokens) <= 2.01
    assert temperature_mixing.mix(table.limit(0), rule).count() == 0
    again = [(r.doc_id, r.epoch, r.block_rank) for r in temperature_mixing.mix(table, rule).collect()]
    assert sorted(again) == sorted((r.doc_id, r.epoch, r.block_rank) for r in got)
    assert temperature_mixing.mix(docs).count() >= 1


def test_all_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
