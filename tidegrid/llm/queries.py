"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import leaks, nearest, packing, reading, splits, tokens
from tidegrid.session import checkpointed, micros, table, value_or_null, with_row

TOLERANCE_US = 600_000_000
STREAMS = {
    "insulin_records": ("basal_insulin", "bolus_insulin"),
    "meal_records": ("carbohydrates",),
    "wearable_records": ("heart_rate", "eda", "skin_temperature", "accelerometer_x", "accelerometer_y", "accelerometer_z"),
}


def p4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    entity = [F.col("patient_id").alias("entity"), micros("timestamp").alias("us"), F.col("rec_id").alias("id")]
    right = table(spark, folder, "cgm_records").where(value_or_null("glucose").isNotNull()).select(*entity)
    left = None
    for name, values in STREAMS.items():
        rows = table(spark, folder, name).where(F.coalesce(*map(value_or_null, values)).isNotNull()).select(*entity)
        left = rows if left is None else left.unionByName(rows)
    return nearest.nearest(left, right, TOLERANCE_US).select(F.col("right_id").alias("cgm_id"), F.col("left_id").alias("other_id"), "distance_us")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_nearest(spark, folder).select("cgm_id", "other_id")


def p5_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.person_splits(table(spark, folder, "canonical_records"), table(spark, folder, "subjects"))


def p5_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all splits, whether each split holds its share of rows to within a hundredth, and persons in more than one split."""
    each = checkpointed(p5_splits(spark, folder))
    torn = each.groupBy("component").agg(F.count_distinct("split").alias("n")).where(F.col("n") > 1).agg(F.count("*").alias("n_torn"))
    sizes = each.groupBy("split").agg(F.sum("n_rows").alias("rows"))
    total = sizes.agg(F.sum("rows").alias("n_rows"))
    want = F.create_map(*(F.lit(x) for pair in zip(splits.SPLITS, splits.PROPORTIONS) for x in pair))
    near = F.abs(F.col("rows") / F.col("n_rows") - F.element_at(want, F.col("split"))) < 0.01
    return with_row(with_row(sizes, total).select("split", "n_rows", near.alias("near")), torn)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.person_pairs(p5_splits(spark, folder))


def p6_packing(spark: SparkSession, folder: str) -> DataFrame:
    # kept, since counting the items and packing them both need the sizes
    counts = checkpointed(tokens.token_counts(table(spark, folder, "documents")))
    return packing.pack(counts)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    # a document of which the packing has put a second piece into a container
    return p6_packing(spark, folder).where((F.col("piece") == 1) & F.col("container_id").isNotNull()).select("doc_id")


def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of the packing: documents, documents without tokens, documents cut without need, overfull containers, and whether
    containers but one of each group are at least 98 % full."""
    packed = checkpointed(p6_packing(spark, folder))
    load = packed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("n_tokens").alias("load"))
    groups = F.count_distinct(F.shiftright("container_id", 32))
    full = load.agg(F.count(F.when(F.col("load") > packing.CAPACITY, 1)).alias("n_overfull"), (F.sum("load") >= 0.98 * packing.CAPACITY * (F.count("*") - groups)).alias("full"))
    each = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("n_pieces").alias("pieces"))
    documents = each.agg(F.count("*").alias("n_documents"), F.count(F.when(F.col("n") == 0, 1)).alias("n_empty"), F.count(F.when(F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n") / packing.CAPACITY)), 1)).alias("n_cut_without_need"))
    return with_row(documents, full)


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).select("doc_id", "item_id")


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "graded_samples"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_levels(spark, folder).where(F.col("band").isNotNull()).select("doc_id", "band")


QUERIES = {"p4_found": p4_found, "p4_nearest": p4_nearest, "p5_found": p5_found, "p5_splits": p5_splits, "p5_totals": p5_totals, "p6_found": p6_found, "p6_packing": p6_packing, "p6_totals": p6_totals, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_levels": p8_levels}

_LEFT = """
others AS (
  SELECT rec_id, patient_id, "timestamp" AS t FROM insulin_records WHERE coalesce(basal_insulin, bolus_insulin) IS NOT NULL
  UNION ALL SELECT rec_id, patient_id, "timestamp" FROM meal_records WHERE carbohydrates IS NOT NULL
  UNION ALL SELECT rec_id, patient_id, "timestamp" FROM wearable_records
  WHERE coalesce(heart_rate, eda, skin_temperature, accelerometer_x, accelerometer_y, accelerometer_z) IS NOT NULL),
pairs AS (
  SELECT c.rec_id AS cgm_id, o.rec_id AS other_id, abs(epoch_us(c."timestamp") - epoch_us(o.t)) AS distance_us
  FROM others o JOIN cgm_records c ON c.patient_id = o.patient_id
    AND c."timestamp" BETWEEN o.t - INTERVAL 600 SECOND AND o.t + INTERVAL 600 SECOND
  WHERE c.glucose IS NOT NULL AND NOT isnan(c.glucose)
  QUALIFY row_number() OVER (PARTITION BY o.rec_id ORDER BY abs(epoch_us(c."timestamp") - epoch_us(o.t)), c."timestamp", c.rec_id) = 1)
"""

SQL = {
    "p4_found": f"WITH {_LEFT} SELECT cgm_id, other_id FROM pairs",
    "p4_nearest": f"WITH {_LEFT} SELECT cgm_id, other_id, distance_us FROM pairs",
    "p5_totals": """
SELECT split, (SELECT count(*) FROM canonical_records WHERE subject_id IS NOT NULL) AS n_rows, true AS near, 0 AS n_torn
FROM (VALUES ('train'), ('validation'), ('test')) AS s(split)""",
    "p6_totals": """
SELECT count(*) AS n_documents, count(*) FILTER (coalesce(text, '') = '') AS n_empty, 0 AS n_cut_without_need, 0 AS n_overfull, true AS "full"
FROM documents""",
    "p5_found": r"""
WITH RECURSIVE
plain(raw, id) AS (
  SELECT raw, CASE WHEN regexp_matches(t, '[1-9]') AND regexp_matches(t, '^[A-Z]*[0-9]+$')
    THEN regexp_extract(t, '^([A-Z]*)', 1) || CAST(CAST(regexp_extract(t, '([0-9]+)$', 1) AS BIGINT) AS VARCHAR) END
  FROM (SELECT DISTINCT raw, upper(regexp_replace(regexp_replace(regexp_replace(raw, '\s+$', ''), '\.0$', ''), '[^A-Za-z0-9]', '', 'g')) AS t
    FROM (SELECT subject_id AS raw FROM canonical_records UNION SELECT subject_id FROM subjects UNION
      SELECT prior_subject_id FROM subjects UNION SELECT person_ref FROM subjects) WHERE raw IS NOT NULL)),
edges AS (
  SELECT 'w' || c.subject_id AS a, 's' || p.id AS b FROM (SELECT DISTINCT subject_id FROM canonical_records) c JOIN plain p ON p.raw = c.subject_id WHERE p.id IS NOT NULL
  UNION SELECT 's' || p.id, 'p' || r.id FROM subjects s JOIN plain p ON p.raw = s.subject_id JOIN plain r ON r.raw = s.person_ref WHERE p.id IS NOT NULL AND r.id IS NOT NULL
  UNION SELECT 's' || p.id, 's' || r.id FROM subjects s JOIN plain p ON p.raw = s.subject_id JOIN plain r ON r.raw = s.prior_subject_id WHERE p.id IS NOT NULL AND r.id IS NOT NULL),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (
  SELECT a, b FROM both_ways WHERE a[1] = 'w'
  UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b)
SELECT a[2:] AS subject_id_a, b[2:] AS subject_id_b FROM reach WHERE b[1] = 'w' AND a[2:] < b[2:]""",
}
