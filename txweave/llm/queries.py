"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txweave.llm import media, mixing, packing, pii, quality_gam, quality_rules, simhash, substring, suffixes, url_filter
from txweave.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.systematic(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _joined(spans: Column) -> Column:
    """kind:start:end of spans, by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in pii.KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(F.array_sort(spans), one))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return out.select("doc_id", *(count(k) for k in range(4)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), F.size(F.concat("base", "added")).cast("long").alias("n_spans"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.describe(media.store(table(spark, sf_dir, "documents")))
    ranges = F.transform("keyframes", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))
    feature = F.concat_ws(
        "|", F.col("codec"), F.concat("duration_ms", F.lit("ms")), F.concat(F.lit("samples="), "n_samples"),
        F.concat(F.lit("keyframes="), F.size("keyframes")), F.concat(F.lit("ranges="), F.sha2(F.concat_ws(",", ranges), 256)),
    )
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_source_mixing, op4_quality_classifier, op5_simhash_near_dedup, op6_pii, op7_suffix_array_dedup, op8_url_filters, op9_best_fit_packing, op10_media_columns)}


#: Words of all texts in rows; windows of 35 as joined strings, counted over all documents.
OP1_SQL = r"""
WITH lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM lists WHERE len(w) > 0),
win AS (SELECT doc_id, n, i, word, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS s FROM w),
marked AS (SELECT doc_id, n, i, word, i + 34 <= n AND count(*) FILTER (WHERE i + 34 <= n) OVER (PARTITION BY s) > 1 AS twice FROM win),
gone AS (SELECT doc_id, i, word, coalesce(max(CAST(twice AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) = 1 AS out FROM marked),
docs AS (SELECT doc_id, count(*) FILTER (WHERE out) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT out) AS kept FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM lists LEFT JOIN docs USING (doc_id)
"""


def _op2_sql() -> str:
    """The counts, metrics, exact binomial tails and corrected cutoffs of the quality rules."""
    rules = quality_rules.RULES
    grid = ", ".join(f"('{r}', CAST({c} AS DOUBLE))" for r, c in quality_rules.tests_grid())
    alpha, delta, bands = quality_rules.ALPHA, quality_rules.DELTA, quality_rules.BANDS
    tried = len(rules) * (len(bands) + 1)
    metric = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in rules) + " END"
    stratum = " + ".join(f"CASE WHEN n_words > {b} THEN 1 ELSE 0 END" for b in bands)
    return rf"""
WITH lists AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM documents),
w AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM lists WHERE len(w) > 4),
win AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM w),
twice AS (SELECT doc_id, i, i + 4 <= n AND count(*) FILTER (WHERE i + 4 <= n) OVER (PARTITION BY doc_id, s) > 1 AS again FROM win),
cover AS (SELECT doc_id, max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice),
rep AS (SELECT doc_id, sum(c) AS n FROM cover GROUP BY doc_id),
base AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(x) - len(list_distinct(x)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(x) AS n_lines,
  length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS upper_chars, length(regexp_replace(t, '[^!]+', '', 'g')) AS shouts FROM lists LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, coalesce(n_symbols / nullif(CAST(word_chars AS DOUBLE), 0), 0) AS symbol_share, coalesce(n_dup_lines / nullif(CAST(n_lines AS DOUBLE), 0), 0) AS dup_line_share,
  coalesce(n_repeat_words / nullif(CAST(n_words AS DOUBLE), 0), 0) AS repeat_share, coalesce(upper_chars / nullif(CAST(word_chars AS DOUBLE), 0), 0) AS upper_share,
  coalesce(shouts / nullif(CAST(word_chars AS DOUBLE), 0), 0) AS shout_share, coalesce(word_chars / nullif(CAST(n_words AS DOUBLE), 0), 0) AS mean_word,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {stratum} AS stratum FROM base),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT m.* FROM m JOIN good USING (doc_id) WHERE NOT base_failed),
grid(rule, cutoff) AS (VALUES {grid}),
tests AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE {metric} > cutoff) AS k FROM held, grid GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1),
  lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha})))) END AS tail FROM tests),
cuts AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tails WHERE tail <= {delta} / {tried} GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM m JOIN cuts USING (stratum) WHERE {metric} > cutoff)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""


def _op8_sql() -> str:
    """Rules, Witten-Bell models by levels, scores of all URLs and the calibrated cutoff."""
    f = url_filter
    upper, lower = f.UPPER, f.LOWER
    rules = sorted(f.RULES, key=lambda r: -len(r.host + r.path))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules]
    pick = lambda value: "CASE " + " ".join(f"WHEN {c} THEN {value(r)}" for c, r in zip(fits, rules, strict=True)) + " END"
    levels = [
        f"""l0 AS (SELECT key, (allow + 1.0) / (sum(allow) OVER () + {f.ALPHABET}) AS pa, (block + 1.0) / (sum(block) OVER () + {f.ALPHABET}) AS pb
  FROM (SELECT right(gram, 1) AS key, sum(allow) AS allow, sum(block) AS block FROM counts GROUP BY 1))"""
    ]
    for k in range(1, f.ORDER + 1):
        mixed = lambda s: f"CASE WHEN n{s} = 0 THEN p{s} ELSE (c{s} + t{s} * p{s}) / (n{s} + t{s}) END AS p{s}"
        levels.append(
            f"""l{k} AS (SELECT key, {mixed('a')}, {mixed('b')} FROM (SELECT x.key, ca, cb, pa, pb, sum(ca) OVER w AS na, sum(cb) OVER w AS nb,
  sum(CAST(ca > 0 AS INTEGER)) OVER w AS ta, sum(CAST(cb > 0 AS INTEGER)) OVER w AS tb
  FROM (SELECT right(gram, {k + 1}) AS key, CAST(sum(allow) AS DOUBLE) AS ca, CAST(sum(block) AS DOUBLE) AS cb FROM counts GROUP BY 1) x JOIN l{k - 1} y ON right(x.key, {k}) = y.key
  WINDOW w AS (PARTITION BY left(x.key, {k}))))"""
        )
    start = "^" * f.ORDER
    return rf"""
WITH u AS (SELECT page_id, url, instr(coalesce(url, ''), '://') AS pos FROM pages),
r AS (SELECT *, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
h AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, {pick(lambda x: f"'{x.host}{x.path}'")} AS rule, {pick(lambda x: f"'{x.verdict}'")} AS by_rule, {pick(lambda x: len(x.host))} AS hl, {pick(lambda x: len(x.path))} AS pl,
  coalesce(substr(md5(url), 1, 1) IN ('0', '1', '2'), false) AS held FROM h),
c AS (SELECT *, CASE WHEN pos > 0 THEN substr(url, 1, pos + 2 + length(host) - greatest(coalesce(hl, 0), length(regexp_extract(host, '([^.]*)\z', 1))))
  || substr(url, pos + 3 + length(host) + greatest(coalesce(pl, 0), length(regexp_extract(path, '^(/[^/]*/?)', 1)))) ELSE coalesce(url, '') END AS rest_of FROM j),
t AS (SELECT *, '{start}' || regexp_replace(regexp_replace(translate(rest_of, '{upper}', '{lower}'), '[0-9]', '9', 'g'), '[^a-z9:/?#\[\]@!&''()*+,;=._~%-]', '|', 'g') || '$' AS chars FROM c),
g AS (SELECT by_rule, held, chars, substr(chars, i, {f.ORDER + 1}) AS gram FROM (SELECT by_rule, held, chars, unnest(generate_series(1, length(chars) - {f.ORDER})) AS i FROM t)),
counts AS (SELECT gram, count(*) FILTER (WHERE by_rule = 'allow' AND NOT held) AS allow, count(*) FILTER (WHERE by_rule = 'block' AND NOT held) AS block FROM g GROUP BY 1),
{", ".join(levels)},
s AS (SELECT chars, round(avg(ln(pa) - ln(pb)), 9) AS score FROM g JOIN l{f.ORDER} ON key = gram GROUP BY 1),
known AS (SELECT count(*) AS n, list_sort(list(score)) AS scores FROM t JOIN s USING (chars) WHERE held AND by_rule = 'allow'),
taught AS (SELECT count(DISTINCT by_rule) AS sides FROM t WHERE NOT held),
cut AS (SELECT CASE WHEN n >= {f.LEAST} AND sides = 2 THEN scores[CAST(floor({f.RISK} * n) AS BIGINT) + 1] END AS least FROM known, taught)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN least IS NULL OR score >= least THEN 'allow' ELSE 'block' END) AS verdict, score FROM t JOIN s USING (chars), cut
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_quality_rules": _op2_sql(), "op8_url_filters": _op8_sql()}
