"""The operators applied to their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pitwarden.llm import (
    chosen_path, factor_machine, importance_radix, license_search, line_crf, lz_fingerprint, periodic_runs, projection_forest, rank_queue_bpe, repeats,
    temperature_mixing, url_filter, warc_transactions,
)
from pitwarden.llm.common import documents, shared_path, width
from pitwarden.plans.registry import Query

RANKS = "byte_bpe_multi_50k.tiktoken"
OP6_CACHE = 700_000  # some 315 MB a worker; the pipeline, whose workers hold more, keeps the smaller default
URL_RULES = (
    url_filter.UrlRule("allow", "org", "/"), url_filter.UrlRule("block", "example.org", "/es/"), url_filter.UrlRule("block", "example.org", "/en/1"),
    url_filter.UrlRule("allow", "com", "/fr/"), url_filter.UrlRule("block", "com", "/de/"),
)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_crf.line_quality(docs, line_crf.train(docs, labels(spark, sf_dir))).drop("text")


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.edited_pairs(documents(spark, sf_dir), width(spark))


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_transactions.page_transactions(pages(spark, sf_dir), shared_path(spark, "archive"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = url_filter.fit(spark.createDataFrame(list(url_filter.LABELLED), "url string, label int"))
    return url_filter.filter_urls(pages(spark, sf_dir).select("page_id", "url"), URL_RULES, weights).drop("url")


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(documents(spark, sf_dir))


def op6_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = rank_queue_bpe.read_ranks(spark, public_tokenizers.path(RANKS))
    return rank_queue_bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN, cache=OP6_CACHE).drop("text")


def op7_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = factor_machine.train(docs, labels(spark, sf_dir))
    return factor_machine.score_quality(docs.select("doc_id", "text"), machine).select("doc_id", factor_machine.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_search.license_notices(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op9_induced_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = temperature_mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("text")
    return mixed.withColumn("weight", F.floor(F.col("weight") * 1e6 + 0.5) / 1e6)


def op11_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(documents(spark, sf_dir))


def op13_importance_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_radix.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = """
WITH p AS (
    SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
    SELECT *, (
        SELECT string_agg(translate(lpad(to_base(CAST('0x' || substr(hex, i, 10) AS BIGINT), 32), 8, '0'), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'), '' ORDER BY i)
        FROM (VALUES (1), (11), (21), (31)) AS v(i)
    ) AS payload_digest FROM p
), t AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM t
"""

def _hash(*parts: str) -> str:
    return "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 15) AS BIGINT)"


def _mixing_sql(rule: temperature_mixing.MixRule) -> str:
    """The whole mixture in SQL: shares, exponent by sections, budgets, permutations cut at the budget."""
    entropy = "(SELECT ln(sum(pow(p, {a}))) - {a} * sum(pow(p, {a}) * ln(p)) / sum(pow(p, {a})) FROM shares)"
    repeats = f"({rule.budget}::DOUBLE * (SELECT max(pow(p, {{a}} - 1)) / sum(pow(p, {{a}})) FROM shares))"
    enough = {"h": f"{entropy} >= (SELECT target FROM goal)", "r": f"{repeats} > {rule.max_epochs}::DOUBLE"}
    steps = [f"""goal AS (SELECT {entropy.format(a='1.0::DOUBLE')} + {rule.lift}::DOUBLE * (ln(count(*)) - {entropy.format(a='1.0::DOUBLE')}) AS target FROM shares)""",
             f"""h0 AS (SELECT CASE WHEN {entropy.format(a='1.0::DOUBLE')} >= (SELECT target FROM goal) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lo, 1.0::DOUBLE AS hi)""",
             f"""r0 AS (SELECT CASE WHEN {repeats.format(a='0.0::DOUBLE')} <= {rule.max_epochs} THEN 0.0::DOUBLE WHEN {repeats.format(a='1.0::DOUBLE')} > {rule.max_epochs} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lo,
               CASE WHEN {repeats.format(a='0.0::DOUBLE')} <= {rule.max_epochs} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hi)"""]
    n = rule.sections
    for k in range(rule.passes):
        for c, test in enough.items():
            steps.append(f"""{c}{k + 1} AS (SELECT lo + (hi - lo) * (k - 1) / {n}.0::DOUBLE AS lo, CASE WHEN k = {n} THEN hi ELSE lo + (hi - lo) * k / {n}.0::DOUBLE END AS hi
              FROM (SELECT lo, hi, coalesce(min(i) FILTER (WHERE NOT ok), {n}) AS k FROM (
                SELECT lo, hi, i, {test.format(a='a')} AS ok FROM (SELECT lo, hi, i, lo + (hi - lo) * i / {n}.0::DOUBLE AS a FROM {c}{k}, range(1, {n}) AS s(i))) GROUP BY lo, hi))""")
    last = rule.passes
    return f"""
WITH d AS (
    SELECT doc_id, source, coalesce(source, '') AS src, {_hash(str(rule.seed), "'block'", "doc_id")} % {rule.blocks} AS block,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS t FROM documents
), sources AS (
    SELECT src, CAST(sum(t) AS BIGINT) AS tokens FROM d GROUP BY src
), shares AS (
    SELECT src, tokens / (SELECT sum(tokens) FROM sources)::DOUBLE AS p FROM sources WHERE tokens > 0
), {', '.join(steps)}, expo AS (
    SELECT CASE WHEN (SELECT count(*) FROM shares) < 2 THEN 1.0::DOUBLE ELSE greatest((SELECT lo FROM h{last}), (SELECT hi FROM r{last})) END AS a
), weights AS (
    SELECT s.src, s.tokens, coalesce(pow(p, a) / (SELECT sum(pow(p, a)) FROM shares), 0.0::DOUBLE) AS weight FROM sources s LEFT JOIN shares USING (src), expo
), exact AS (
    SELECT *, weight * ({rule.budget}::DOUBLE * (SELECT sum(tokens) FROM sources)) AS e FROM weights
), ranked AS (
    SELECT *, CAST(floor(e) AS BIGINT) AS f, row_number() OVER (ORDER BY tokens = 0, e - floor(e) DESC, src) AS r FROM exact
), budgets AS (
    SELECT src, tokens, weight, f + CASE WHEN tokens > 0 AND r <= floor({rule.budget} * (SELECT sum(tokens) FROM sources) + 0.5) - (SELECT sum(f) FROM ranked) THEN 1 ELSE 0 END AS budget FROM ranked
), planned AS (
    SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM budgets
), placed AS (
    SELECT d.*, weight, epoch, epochs, rest, {_hash(str(rule.seed), "'epoch'", "epoch", "d.src", "block")} AS block_rank, {_hash(str(rule.seed), "'document'", "epoch", "doc_id")} AS document_rank
    FROM d JOIN planned USING (src), range(0, 64) AS x(epoch) WHERE epoch <= epochs
), walked AS (
    SELECT *, sum(t) OVER (PARTITION BY src, epoch ORDER BY block_rank, block, document_rank ROWS UNBOUNDED PRECEDING) AS run FROM placed
)
SELECT doc_id, source, t AS n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(block AS INTEGER) AS block, block_rank, document_rank, floor(weight * 1e6 + 0.5) / 1e6 AS weight
FROM walked WHERE epoch < epochs OR (rest > 0 AND run <= rest)
"""


OP11_SQL = """
WITH RECURSIVE able AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM able AS a JOIN able AS b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
    SELECT vec_id AS node, vec_id AS low FROM embeddings
    UNION
    SELECT l.b, r.low FROM reach AS r JOIN links AS l ON l.a = r.node WHERE r.low < l.b
), low AS (
    SELECT node, min(low) AS component_id FROM reach GROUP BY node
), degree AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN low ON node = vec_id LEFT JOIN degree ON a = vec_id
"""

OP13_SQL = """
WITH RECURSIVE step AS (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)
), wordy AS (
    SELECT doc_id, 'd' AS kind, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
    UNION ALL
    SELECT item_id, 't', regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), per_text AS (
    SELECT kind, doc_id, unnest(list_concat(
        w,
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
    FROM wordy
), counted AS (
    SELECT kind, doc_id, f, count(*) AS n FROM per_text GROUP BY ALL
), spelled AS (
    SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), walk AS (
    SELECT f, h, 1 AS pos, CAST(4294967295 AS BIGINT) AS c FROM spelled
    UNION ALL
    SELECT f, h, pos + 2, xor(c >> 8, step.v) FROM walk JOIN step ON step.i = xor(c & 255, CAST('0x' || substr(h, pos, 2) AS BIGINT)) WHERE pos < length(h)
), hashed AS (
    SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM walk WHERE pos > length(h)
), totals AS (
    SELECT b.bucket, coalesce(x.s, 0) AS s, coalesce(x.t, 0) AS t
    FROM range(10000) AS b(bucket) LEFT JOIN (
        SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 't'), 0) AS t
        FROM counted JOIN hashed USING (f) GROUP BY bucket
    ) AS x USING (bucket)
), gain AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000.0::DOUBLE)))) AS BIGINT) AS g FROM totals
), weighed AS (
    SELECT doc_id, sum(n * g) AS weight FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY doc_id
), scored AS (
    SELECT doc_id, coalesce(len(w), 0) AS words, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS score
    FROM wordy LEFT JOIN weighed USING (doc_id) WHERE kind = 'd'
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY words >= 20) AS able FROM scored
)
SELECT doc_id, CAST(words + greatest(words - 1, 0) + greatest(words - 2, 0) AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN words >= 20 AND r <= 5 * able // 100 THEN r END AS rank
FROM ranked
"""

QUERIES = {q.name: q for q in (
    Query("op1_line_crf", op1_line_crf, None, ()),
    Query("op2_lz_fingerprint", op2_lz_fingerprint, None, ()),
    Query("op3_warc_transactions", op3_warc_transactions, OP3_SQL, ()),
    Query("op4_url_filter", op4_url_filter, None, ()),
    Query("op5_chosen_path", op5_chosen_path, None, ()),
    Query("op6_rank_queue_bpe", op6_rank_queue_bpe, None, ()),
    Query("op7_factor_machine", op7_factor_machine, None, ()),
    Query("op8_license_notices", op8_license_notices, None, ()),
    Query("op9_induced_repeats", op9_induced_repeats, None, ()),
    Query("op10_temperature_mixing", op10_temperature_mixing, _mixing_sql(temperature_mixing.MixRule()), ()),
    Query("op11_projection_forest", op11_projection_forest, OP11_SQL, ()),
    Query("op12_periodic_runs", op12_periodic_runs, None, ()),
    Query("op13_importance_radix", op13_importance_radix, OP13_SQL, ()),
)}
