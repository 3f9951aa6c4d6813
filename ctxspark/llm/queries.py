"""Registered queries of the operators: each reads its whole tables; ``ORACLES`` holds DuckDB twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxspark.llm.common import table
from ctxspark.llm.decontaminate import best_leaks
from ctxspark.llm.filter_audit import audit
from ctxspark.llm.hard_negatives import mine
from ctxspark.llm.jaccard import jaccard_components
from ctxspark.llm.mixing import mixture_digest
from ctxspark.llm.packing import packing_digest
from ctxspark.llm.quality import quality
from ctxspark.llm.secret_scan import find_secrets
from ctxspark.llm.suffix_dedup import repeated_passages
from ctxspark.llm.token_files import token_digest
from ctxspark.llm.tokens import default_vocabulary
from ctxspark.llm.topk import top_k
from ctxspark.llm.toxicity import score_toxicity
from ctxspark.llm.warc import warc_round_trip


def op1_suffix_array_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"), least=50)


def op2_benchmark_decontamination(spark, sf_dir):
    return best_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op4_quality_kneser_ney(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secret_scan(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op7_warc(spark, sf_dir):
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op8_token_files(spark, sf_dir):
    return token_digest(table(spark, sf_dir, "documents"), default_vocabulary(), end_id=2)


def op9_harmonic_packing(spark, sf_dir):
    return packing_digest(table(spark, sf_dir, "documents"), default_vocabulary(), end_id=1, capacity=2048)


def op10_block_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op11_source_mix(spark, sf_dir):
    return mixture_digest(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label, every=50, n_positives=5, n_negatives=3, low=50, high=95)


def op13_filter_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_benchmark_decontamination, op3_toxicity, op4_quality_kneser_ney, op5_secret_scan,
    op6_ngram_jaccard_join, op7_warc, op8_token_files, op9_harmonic_packing, op10_block_top_k, op11_source_mix, op12_hard_negatives, op13_filter_audit)}

ORACLES = {
    "op10_block_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, r.vec_id,
                     CAST(list_sum(list_transform(list_zip(q.c, r.c), p -> p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
    "op11_source_mix": r"""
        WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                          substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 16) AS key FROM documents),
        s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS code
               FROM r GROUP BY source),
        s1 AS (SELECT *, [3, 1, 2][code % 3 + 1] AS w, 2 * ss AS most FROM s0),
        s2 AS (SELECT *, CAST(sum(ss) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY most / w, code) AS pos,
                      CAST(coalesce(sum(most) OVER (ORDER BY most / w, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS kept,
                      CAST(sum(w) OVER (ORDER BY most / w, code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM s1),
        lv AS (SELECT coalesce(arg_min((3 * total - 2 * kept) / (2 * rest), pos), 0) AS lam FROM s2
               WHERE (3 * total - 2 * kept) / (2 * rest) * w < most),
        t AS (SELECT source, code, ss, least(CAST(most AS DOUBLE), lam * w) AS target, greatest(1, least(64, ss // 256)) AS block,
                     CAST(ceil(n / 4096) AS BIGINT) AS shards FROM s2, lv),
        d AS (SELECT r.*, t.code, t.target, t.ss, t.block, CAST('0x' || substr(key, 1, 8) AS BIGINT) % t.shards AS shard
              FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
        sh AS (SELECT code, shard, CAST(sum(size) AS BIGINT) AS words,
                      CAST(CASE WHEN sum(size) > 0 THEN greatest(1, round(sum(size) / max(block))) ELSE 0 END AS BIGINT) AS blocks
               FROM d GROUP BY code, shard),
        v AS (SELECT t.code, CAST(sum(blocks) AS BIGINT) AS blocks, CASE WHEN max(ss) > 0 THEN max(target) * sum(blocks) / max(ss) ELSE 0 END AS votes
              FROM sh JOIN t USING (code) GROUP BY t.code),
        h AS (SELECT floor(sum(CAST(round(votes, 6) AS DECIMAL(30, 6))) + 0.5) AS house FROM v),
        q1 AS (SELECT code, blocks, row_number() OVER (ORDER BY votes / (k + 0.5) DESC, code) AS place
               FROM (SELECT *, unnest(range(CAST(2 * votes AS BIGINT) + 3)) AS k FROM v WHERE votes > 0)),
        seats AS (SELECT code, least(count(*), 2 * max(blocks)) AS seats FROM q1, h WHERE place <= house GROUP BY code),
        q2 AS (SELECT code, shard, seats, row_number() OVER (PARTITION BY code ORDER BY blocks / (k + 0.5) DESC, shard) AS place
               FROM (SELECT *, unnest(range(2 * blocks + 2)) AS k FROM sh JOIN seats USING (code) WHERE blocks > 0)),
        quota AS (SELECT code, shard, count(*) AS quota FROM q2 WHERE place <= seats GROUP BY code, shard),
        p AS (SELECT sh.*, least(coalesce(quota, 0), 2 * blocks) AS quota,
                     CASE WHEN blocks > 0 THEN CAST('0x' || substr(md5('11:phase:' || code || ':' || shard), 1, 8) AS BIGINT) % blocks END AS phase
              FROM sh LEFT JOIN quota USING (code, shard)),
        o AS (SELECT d.doc_id, d.size, d.ss, d.target, p.words, p.blocks, p.quota, p.phase,
                     CAST(sum(d.size) OVER (PARTITION BY d.code, d.shard ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b
              FROM d JOIN p USING (code, shard))
        SELECT doc_id, size, ss AS source_size, target,
               CAST(CASE WHEN size > 0 AND quota > 0 THEN list_sum([
                   (least(b, (i + 1) * words // blocks) - greatest(b - size, i * words // blocks))
                   * (((i + 1) * quota + phase) // blocks - (i * quota + phase) // blocks)
                   for i in range(((b - size + 1) * blocks - 1) // words, (b * blocks - 1) // words + 1)]) ELSE 0 END AS BIGINT) AS taken FROM o""",
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS c
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                     AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
                     CAST(list_sum([p[1] * p[2] for p in list_zip(a.c, r.c)]) AS BIGINT) AS score
              FROM v a JOIN v r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
        p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                     CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND p.n <= 5
                           AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
                            100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text),
                            regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE)] AS fails,
                     coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
              FROM d LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
        o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS ord
              FROM range(5) a(i), range(5) b(i), range(5) c(i), range(5) d(i), range(5) e(i)
              WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        x AS (SELECT part, ord, s.i AS step, ord[s.i] AS filter, n, good, toxic, fails[ord[s.i] + 1] AS fail,
                     len([y for y in ord[1:s.i - 1] if fails[y + 1]]) = 0 AS alive, len([y for y in fails if y]) = 1 AS alone
              FROM c, o, range(1, 6) s(i)),
        g AS (SELECT part, ord, step, filter,
                     coalesce(sum(n) FILTER (WHERE alive AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (WHERE alive AND fail), 0) AS removed,
                     coalesce(sum(n) FILTER (WHERE NOT alive AND fail), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fail AND alone), 0) AS unique_fails,
                     coalesce(sum(good) FILTER (WHERE alive AND fail), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE alive AND fail), 0) AS toxic_lost
              FROM x GROUP BY part, ord, step, filter)
        SELECT part, array_to_string([substr('ABCDE', CAST(y + 1 AS INTEGER), 1) for y in ord], '') AS filter_order,
               CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM g""",
}
