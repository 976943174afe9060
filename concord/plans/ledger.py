"""Facts derived from the star schema, in SQL that Spark and DuckDB both read.

Two publishers state each customer's revenue by fiscal year: the orders' totals, and the
line items' net prices. By the customer key the second one writes dollars, another basis, a
bracketed number, a quarter, an approximation, or no period at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators import linking

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "conversations", "labels"]

WRITTEN = """
SELECT 'o-' || CAST(c_custkey AS STRING) || '-' || CAST(fy AS STRING) AS id, 'orders' AS doc_id, c_custkey, fy, 0 AS variant, c_name AS subject_raw, 'revenue from operations' AS metric_raw,
       'Rs. ' || CAST(v AS STRING) AS value_raw, '' AS unit_hint, 'FY' || CAST(fy AS STRING) AS period_text, 'consolidated' AS basis, CAST(v AS DOUBLE) AS x
FROM (SELECT o_custkey, year(o_orderdate + INTERVAL 9 MONTH) AS fy, CAST(sum(round(o_totalprice)) AS BIGINT) AS v FROM orders GROUP BY 1, 2) o JOIN customer ON o_custkey = c_custkey
UNION ALL
SELECT 'l-' || CAST(c_custkey AS STRING) || '-' || CAST(fy AS STRING), 'lineitem', c_custkey, fy, CAST(c_custkey % 8 AS INT), c_name, 'operating revenue',
       CASE c_custkey % 8 WHEN 1 THEN 'US$ ' || CAST(k AS STRING) || ' thousand' WHEN 3 THEN '(' || CAST(k AS STRING) || ') thousand' WHEN 5 THEN 'about ' || CAST(k AS STRING) || ' thousand' ELSE CAST(k AS STRING) || ' thousand' END,
       CASE c_custkey % 8 WHEN 1 THEN '' ELSE 'figures in INR' END,
       CASE c_custkey % 8 WHEN 4 THEN 'Q4 FY' || CAST(fy AS STRING) WHEN 6 THEN '' ELSE 'FY' || CAST(fy AS STRING) END,
       CASE c_custkey % 8 WHEN 2 THEN 'standalone' ELSE 'consolidated' END, CAST(k AS DOUBLE)
FROM (SELECT o_custkey, year(o_orderdate + INTERVAL 9 MONTH) AS fy, CAST(floor(sum(l_extendedprice * (1 - l_discount)) / 1000) AS BIGINT) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) l
JOIN customer ON o_custkey = c_custkey
"""


def sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(query)


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, WRITTEN)


_held: dict[str, DataFrame] = {}


def facts(spark: SparkSession, sf_dir: str, keep: bool = True) -> DataFrame:
    """The ledger as normalised facts, kept for the joins that read them several times; those of another folder are released.

    Without ``keep``, for plans that read them once: only the columns they ask for are worked out.
    """
    key = f"{spark.sparkContext.applicationId} {sf_dir}"
    if key not in _held:
        for old in list(_held):
            gone = _held.pop(old)
            if old.split(" ", 1)[0] == spark.sparkContext.applicationId:
                gone.unpersist()
        raw = written(spark, sf_dir).withColumns({"qualifiers": F.create_map(F.lit("basis"), "basis"), "evidence_text": F.lit(""), "page": F.lit(1), "match_ratio": F.lit(1.0), "grounded": F.lit(True), "confidence": F.lit(0.9)})
        _held[key] = linking.alone(linking.normalize_facts(raw))
    return _held[key].persist() if keep else _held[key]


# The ledger's facts as DuckDB reads them from the written strings.
FACTS = rf"""
WITH written AS ({WRITTEN}), parsed AS (
  SELECT *, CAST(replace(regexp_extract(value_raw, '([-+]?\d[\d,]*(?:\.\d+)?)', 1), ',', '') AS DOUBLE) AS n,
    CASE WHEN regexp_matches(lower(value_raw || ' ' || unit_hint), '(^|[^a-z])thousand($|[^a-z])') THEN 1000.0 ELSE 1.0 END AS scale,
    regexp_matches(value_raw, '\(\d+\)') AS neg, regexp_matches(value_raw, '(^|[^a-z])about([^a-z]|$)') AS approx
  FROM written),
facts AS (
  SELECT id, doc_id, c_custkey, fy, lower(subject_raw) AS subject_text, metric_raw, value_raw, basis, CASE WHEN neg THEN -n * scale ELSE n * scale END AS value_num, approx,
    CASE WHEN contains(value_raw, 'US$') THEN 'USD' ELSE 'INR' END AS unit,
    CASE WHEN period_text = '' THEN NULL WHEN period_text LIKE 'Q4%' THEN make_date(fy, 1, 1) ELSE make_date(fy - 1, 4, 1) END AS p0,
    CASE WHEN period_text = '' THEN NULL ELSE make_date(fy, 3, 31) END AS p1,
    CASE WHEN period_text = '' THEN '' WHEN period_text LIKE 'Q4%' THEN 'Q4 FY' || fy ELSE 'FY' || fy END AS canonical,
    CASE WHEN n = 0 OR n IS NULL THEN 0.01 ELSE least(greatest(0.5 / n, 0.0005), 0.1) END AS tol,
    trim(regexp_replace(regexp_replace(lower(subject_raw), '[^\w\s&]', ' ', 'g'), '\s+', ' ', 'g')) AS subject_key
  FROM parsed)
"""

# Candidate pairs of the ledger: all labels have the same stems, so partners rank by id.
PAIRS = (
    FACTS
    + """, near AS (
  SELECT p.id AS a, f.id AS b, row_number() OVER (PARTITION BY p.id ORDER BY f.id) AS r FROM facts p JOIN facts f ON p.subject_key = f.subject_key AND p.id <> f.id),
pairs AS (SELECT DISTINCT least(a, b) AS fact_a, greatest(a, b) AS fact_b FROM near WHERE r <= 12)
"""
)

# The rule table for pairs that are all numeric and have no evidence text.
VERDICTS = (
    PAIRS
    + """, seen AS (
  SELECT fact_a, fact_b, a.doc_id <> b.doc_id AS cross_doc, a.value_num AS x, b.value_num AS y, a.unit AS ua, b.unit AS ub, a.basis <> b.basis AS differs, a.unit = b.unit AS comparable,
    a.subject_key AS subject_key, a.canonical AS ca, b.canonical AS cb, a.doc_id AS da, b.doc_id AS db,
    greatest(a.tol, b.tol, CASE WHEN a.approx OR b.approx THEN 0.05 ELSE 0 END) AS tol,
    CASE WHEN a.p0 IS NULL OR b.p0 IS NULL THEN 'UNKNOWN' WHEN a.p0 = b.p0 AND a.p1 = b.p1 THEN 'EQUAL' WHEN a.p0 <= b.p0 AND a.p1 >= b.p1 THEN 'CONTAINS'
      WHEN b.p0 <= a.p0 AND b.p1 >= a.p1 THEN 'CONTAINED_BY' WHEN a.p1 < b.p0 OR b.p1 < a.p0 THEN 'DISJOINT' ELSE 'OVERLAPS' END AS rel
  FROM pairs JOIN facts a ON fact_a = a.id JOIN facts b ON fact_b = b.id),
measured AS (
  SELECT *, CASE WHEN NOT comparable THEN NULL WHEN greatest(abs(x), abs(y)) = 0 THEN 0 ELSE abs(x - y) / greatest(abs(x), abs(y)) END AS rel_diff,
    CASE WHEN comparable AND x * y < 0 THEN abs(abs(x) - abs(y)) / greatest(abs(x), abs(y)) END AS gap,
    CASE WHEN comparable AND y <> 0 AND x <> 0 THEN abs(x / y) END AS r
  FROM seen),
scaled AS (
  SELECT *, rel_diff IS NOT NULL AND rel_diff <= tol AS within,
    r IS NOT NULL AND r <> 1 AND (list_bool_or(list_transform([10.0::DOUBLE, 100, 1e3, 1e5, 1e6, 1e7, 1e9], lambda f: abs(r / f - 1) < 0.02 OR abs(r * f - 1) < 0.02))
      OR (round_even(log10(r), 0) <> 0 AND abs(log10(r) - round_even(log10(r), 0)) <= 0.18)) AS scale,
    r IS NOT NULL AND (r BETWEEN 60 AND 100 OR r BETWEEN 0.01 AND 1 / 60.0::DOUBLE) AS fx
  FROM measured),
series AS (
  SELECT doc_id, subject_key, canonical FROM facts WHERE value_num IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT round(value_num, 6)) >= 3),
ruled AS (
  SELECT v.*, CASE
    WHEN gap IS NOT NULL AND gap <= greatest(tol, 0.01) THEN '1' WHEN NOT comparable THEN '6'
    WHEN rel = 'EQUAL' AND within THEN '7a' WHEN rel = 'EQUAL' AND differs THEN '7b'
    WHEN rel = 'EQUAL' AND (scale OR fx) THEN '7c' WHEN rel = 'EQUAL' AND 0.0 = 1.0 THEN '7e' WHEN rel = 'EQUAL' THEN '7d'
    WHEN rel = 'CONTAINS' AND abs(y) > 1.02 * abs(x) THEN '8a' WHEN rel = 'CONTAINED_BY' AND abs(x) > 1.02 * abs(y) THEN '8a'
    WHEN rel IN ('CONTAINS', 'CONTAINED_BY') THEN '8b' WHEN rel = 'DISJOINT' THEN '9' WHEN rel = 'OVERLAPS' THEN '10' WHEN within THEN '11a' ELSE '11b' END AS base,
    da = db AND ca = cb AND s.doc_id IS NOT NULL AS member
  FROM scaled v LEFT JOIN series s ON s.doc_id = v.da AND s.subject_key = v.subject_key AND s.canonical = v.ca),
verdicts AS MATERIALIZED (
  SELECT fact_a, fact_b, cross_doc, rel_diff, CASE WHEN member THEN '*' ELSE base END AS rule,
    CASE WHEN member THEN 'RELATED' WHEN base IN ('7a', '11a') THEN 'CORROBORATES' WHEN base IN ('7d', '9', '11b') THEN 'RELATED' WHEN base = '7f' THEN 'CONTRADICTS' ELSE 'RECONCILED' END AS kind,
    CAST(CASE WHEN member THEN 0.30 ELSE CASE base WHEN '1' THEN 0.70 WHEN '6' THEN 0.50 WHEN '7a' THEN 0.99 WHEN '7b' THEN 0.60 WHEN '7c' THEN CASE WHEN scale THEN 0.60 ELSE 0.55 END WHEN '7d' THEN 0.30 WHEN '7f' THEN 0.65
      WHEN '8a' THEN 0.45 WHEN '8b' THEN 0.70 WHEN '9' THEN 0.45 WHEN '10' THEN 0.50 WHEN '11a' THEN 0.62 ELSE 0.35 END END AS DOUBLE) AS score,
    CASE WHEN member THEN 'enumeration' ELSE CASE base WHEN '1' THEN 'sign convention' WHEN '6' THEN 'currency' WHEN '7b' THEN 'basis' WHEN '7c' THEN 'unit' WHEN '7d' THEN 'attribution' WHEN '8a' THEN 'period' WHEN '8b' THEN 'period' WHEN '9' THEN 'period' WHEN '10' THEN 'period' END END AS dimension,
    NOT member AND (base IN ('6', '7b', '7f', '8a', '10', '11b') OR (base = '7c' AND NOT scale)) AS needs_llm
  FROM ruled)
"""
)
