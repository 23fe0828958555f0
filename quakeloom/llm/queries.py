"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm import lm_scoring
from quakeloom.llm.chat_format import format_chats
from quakeloom.llm.curriculum import plan_mix
from quakeloom.llm.decontaminate import find_benchmark_passages
from quakeloom.llm.exact_dedup import exact_dedup
from quakeloom.llm.fill_middle import fill_in_middle, restore
from quakeloom.llm.filter_audit import audit_filters
from quakeloom.llm.html_text import extract_main_text
from quakeloom.llm.language_id import held_out, identify, train
from quakeloom.llm.ngram_join import jaccard_components
from quakeloom.llm.packing import pack
from quakeloom.llm.suffix_dedup import repeated_passages
from quakeloom.llm.token_counts import count_section_tokens


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    kept_out = lm_scoring.held_out(F.col("doc_id"))
    training = docs.filter(~kept_out)
    words = lm_scoring.count_words(training)
    out = lm_scoring.score(docs, words, lm_scoring.train(training, words))
    return out.select("doc_id", kept_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_section_tokens(_read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_read(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(_read(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("full_hash")).alias("text_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = identify(docs, train(docs.filter(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_read(spark, sf_dir, "conversations"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_benchmark_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_read(spark, sf_dir, "documents"))
    text = restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan_mix(_read(spark, sf_dir, "documents"))
    first = F.round(F.get("takes", 0)["position"], 9)
    out = out.select("doc_id", "size", "source_size", "target", "taken", F.size("takes").alias("passes"), first.alias("position"))
    return out.orderBy(F.asc_nulls_last("position"), "doc_id")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_token_counts": op2_token_counts,
        "op3_html_extraction": op3_html_extraction,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_language_id": op6_language_id,
        "op7_chat_format": op7_chat_format,
        "op8_packing": op8_packing,
        "op9_decontamination": op9_decontamination,
        "op10_ngram_join": op10_ngram_join,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_curriculum_mix": op12_curriculum_mix,
        "op13_filter_audit": op13_filter_audit,
    }


_OP5 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS k, count(*) OVER (PARTITION BY h) AS g FROM d
)
SELECT doc_id, k AS keep_id, g::BIGINT AS group_size, doc_id = k AS kept, h AS text_sha256 FROM r
"""


_OP9 = r"""
WITH fold AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM fold),
i AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, len(w[p:p + 9]) AS n, array_to_string(w[p:p + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND array_to_string(w[p:p + dw.n - 1], ' ') = k),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


_OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
  FROM documents
), u AS (SELECT doc_id, t, w, len(w) AS n, [('0x' || h[8 * k + 1:8 * k + 8])::BIGINT for k in [0, 1, 2, 3]] AS r FROM d),
c AS (
  SELECT doc_id, t, w, n, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
              WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (SELECT *, array_to_string(w[:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


_OP12 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), z AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [0, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS turn FROM z),
c AS (SELECT *, [5.0, 2.0, 1.0][turn + 1]::DOUBLE AS weight, 2 * source_size AS cap, 2 * source_size / [5.0, 2.0, 1.0][turn + 1]::DOUBLE AS fill FROM w),
s AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(weight) OVER o, 0) AS weights, sum(source_size) OVER () * 150 / 100::DOUBLE AS asked, sum(weight) OVER () AS total
  FROM c WINDOW o AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, (asked - caps) / (total - weights) >= fill AS is_full FROM s),
t AS (
  SELECT source, turn, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE least(
    (asked - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)) / (total - coalesce(sum(weight) FILTER (WHERE is_full) OVER (), 0)) * weight, cap::DOUBLE) END AS target
  FROM f
), r AS (
  SELECT d.doc_id, size, source_size, target, turn, floor(target + 0.5)::BIGINT AS wanted,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, greatest(least(wanted - before, size), 0) AS one, greatest(least(wanted - source_size - before, size), 0) AS two, before::DOUBLE / wanted::DOUBLE AS x FROM r
)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken, ((one > 0)::INT + (two > 0)::INT)::INT AS passes,
  CASE WHEN one > 0 THEN round(CASE turn WHEN 0 THEN 2 * (5 * x) / (6 + sqrt(36 - 4 * (5 * x))) WHEN 1 THEN 2 * (2 * x) / (1 + sqrt(1 + 4 * (2 * x))) ELSE x END, 9) END AS position
FROM p
"""


_OP13 = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
    'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)} AS f
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), g AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails,
    count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM d GROUP BY 1, 2),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS c, string_split(filter_order[1:step - 1], '') AS earlier FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (
  SELECT part, filter_order, step, c,
    coalesce(sum(n) FILTER (WHERE NOT list_contains(fails, c) AND NOT list_has_any(fails, earlier)), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE list_contains(fails, c) AND NOT list_has_any(fails, earlier)), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE list_contains(fails, c) AND list_has_any(fails, earlier)), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = [c]), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE list_contains(fails, c) AND NOT list_has_any(fails, earlier)), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE list_contains(fails, c) AND NOT list_has_any(fails, earlier)), 0)::BIGINT AS toxic_lost
  FROM g, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": _OP5, "op9_decontamination": _OP9, "op11_fill_in_middle": _OP11, "op12_curriculum_mix": _OP12, "op13_filter_audit": _OP13}
