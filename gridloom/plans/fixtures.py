"""Input views of the registered plans, as SQL that Spark and DuckDB both run over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "pixels": """
SELECT CAST(user_id % 5 AS INT) AS scene,
       CAST(event_id % 100 AS INT) AS x, CAST(FLOOR(event_id / 100) AS INT) AS y,
       100.0E0 + (event_id % 100) * 0.01E0 AS lon, 30.0E0 - FLOOR(event_id / 100) * 0.01E0 AS lat,
       CAST((event_id * 37 + user_id * 11) % 3000 AS DOUBLE) AS red,
       CAST((event_id * 53 + user_id * 7) % 3000 AS DOUBLE) AS green,
       CAST((event_id * 59 + user_id * 17) % 3000 AS DOUBLE) AS blue,
       CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST((event_id * 71 + user_id * 29) % 3000 AS DOUBLE) END AS nir,
       CAST((event_id * 83 + user_id * 3) % 3000 AS DOUBLE) AS swir2,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS water_mask,
       CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS INT) AS gt_class,
       CAST(CASE WHEN event_id % 5 = 0 THEN event_id % 3 WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 2 WHEN event_type = 'purchase' THEN 3 WHEN event_type = 'signup' THEN 4 ELSE 0 END AS INT) AS pred_class,
       ts
FROM events""",
    "samples": """
SELECT l_orderkey AS seq, l_linenumber AS sub, CONCAT('batch', CAST(l_linenumber AS STRING)) AS source,
       95.0E0 + (l_partkey % 200) * 0.05E0 AS lon, 30.0E0 + (l_suppkey % 40) * 0.05E0 AS lat,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity * 100 END AS band_2,
       CASE WHEN l_orderkey % 13 = 0 OR l_orderkey % 11 = 0 THEN NULL ELSE l_quantity * 80 + l_linenumber END AS band_3,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE (l_partkey % 3000) * 1.0E0 END AS band_4,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE (l_suppkey % 2500) * 1.0E0 END AS band_8,
       CASE WHEN l_tax = 0 THEN NULL ELSE l_tax * 100 END AS depth,
       CAST(l_partkey % 100 AS INT) AS cloud_pct, l_shipdate AS obs_date
FROM lineitem""",
    "boxes_gt": """
SELECT o_orderkey AS box_id, o_custkey % 200 AS image_id, o_orderpriority AS label,
       (o_orderkey * 7) % 900 AS x1, (o_orderkey * 13) % 900 AS y1,
       (o_orderkey * 7) % 900 + 20 + o_orderkey % 80 AS x2, (o_orderkey * 13) % 900 + 20 + o_orderkey % 60 AS y2
FROM orders""",
    "boxes_pred": """
SELECT o_orderkey AS box_id, o_custkey % 200 AS image_id,
       CASE WHEN o_orderkey % 17 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS label,
       (o_orderkey * 7) % 900 + o_orderkey % 9 AS x1, (o_orderkey * 13) % 900 + o_orderkey % 7 AS y1,
       (o_orderkey * 7) % 900 + 20 + o_orderkey % 80 + o_orderkey % 5 AS x2, (o_orderkey * 13) % 900 + 20 + o_orderkey % 60 + o_orderkey % 6 AS y2,
       ((o_orderkey * 31) % 1000) / 1000.0E0 AS score
FROM orders WHERE o_orderkey % 4 <> 0""",
    "track_truth": """
SELECT o_orderkey AS det, o_custkey % 10 AS seq, o_custkey AS frame, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS track, o_orderpriority AS cls,
       (o_orderkey * 7) % 160 AS x1, (o_orderkey * 13) % 160 AS y1, (o_orderkey * 7) % 160 + 20 + o_orderkey % 40 AS x2, (o_orderkey * 13) % 160 + 20 + o_orderkey % 30 AS y2
FROM orders""",
    "track_found": """
SELECT o_orderkey AS det, o_custkey % 10 AS seq, o_custkey AS frame, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS track,
       CASE WHEN o_orderkey % 17 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS cls,
       (o_orderkey * 7) % 160 + o_orderkey % 9 AS x1, (o_orderkey * 13) % 160 + o_orderkey % 7 AS y1,
       (o_orderkey * 7) % 160 + 20 + o_orderkey % 40 + o_orderkey % 5 AS x2, (o_orderkey * 13) % 160 + 20 + o_orderkey % 30 + o_orderkey % 6 AS y2
FROM orders WHERE o_orderkey % 4 <> 0""",
    "kg_nodes": """
SELECT CONCAT('r', CAST(r_regionkey AS STRING)) AS id, 'region' AS label, r_name AS name FROM region
UNION ALL SELECT CONCAT('n', CAST(n_nationkey AS STRING)), 'nation', n_name FROM nation
UNION ALL SELECT CONCAT('s', CAST(s_suppkey AS STRING)), 'supplier', s_name FROM supplier
UNION ALL SELECT CONCAT('c', CAST(c_custkey AS STRING)), 'customer', c_name FROM customer""",
    "kg_edges": """
SELECT CONCAT('e1-', CAST(n_nationkey AS STRING)) AS id, 'IN_REGION' AS type, CONCAT('n', CAST(n_nationkey AS STRING)) AS src, CONCAT('r', CAST(n_regionkey AS STRING)) AS dst FROM nation
UNION ALL SELECT CONCAT('e2-', CAST(s_suppkey AS STRING)), 'IN_NATION', CONCAT('s', CAST(s_suppkey AS STRING)), CONCAT('n', CAST(s_nationkey AS STRING)) FROM supplier
UNION ALL SELECT CONCAT('e3-', CAST(c_custkey AS STRING)), 'IN_NATION', CONCAT('c', CAST(c_custkey AS STRING)), CONCAT('n', CAST(c_nationkey AS STRING)) FROM customer""",
    "regions": """
SELECT d.doc_id AS region_id, d.doc_id % 100 AS image_id, d.lang AS split_tag,
       (d.doc_id * 7) % 400 AS bx, (d.doc_id * 11) % 400 AS bv, 10 + d.doc_id % 90 AS bw, 10 + d.doc_id % 70 AS bh, 512 AS img_w, 512 AS img_h,
       CASE d.doc_id % 6 WHEN 0 THEN 'building' WHEN 1 THEN 'Road' WHEN 2 THEN 'vegetation' WHEN 3 THEN 'farmland' WHEN 4 THEN 'bare-land' ELSE 'water' END AS clip_class,
       CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 THEN 'highway' ELSE ' Barren Land ' END AS llm_class
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "qa_items": """
SELECT u.conv_id AS sample_id, u.turn AS item_no, u.text AS question, a.text AS answer,
       CASE u.turn % 3 WHEN 0 THEN 'qa' WHEN 1 THEN 'mcq' ELSE 'caption' END AS type
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""",
    "patch_series": "SELECT user_id AS patch_id, ts, value, event_type AS phase FROM events",
    "scenes": """
SELECT p_partkey AS scene_id, p_brand AS sensor, 95.0E0 + (p_partkey % 50) * 0.2E0 AS min_lon, 30.0E0 + (p_partkey % 10) * 0.2E0 AS min_lat,
       95.0E0 + (p_partkey % 50) * 0.2E0 + 0.5E0 AS max_lon, 30.0E0 + (p_partkey % 10) * 0.2E0 + 0.5E0 AS max_lat, p_size * 2 AS cloud_pct
FROM part""",
    "rect_targets": """
SELECT c_custkey AS fid, CAST((c_custkey * 17) % 1000 AS DOUBLE) AS x1, CAST((c_custkey * 23) % 1000 AS DOUBLE) AS y1,
       CAST((c_custkey * 17) % 1000 + 5 + c_custkey % 20 AS DOUBLE) AS x2, CAST((c_custkey * 23) % 1000 + 5 + c_custkey % 30 AS DOUBLE) AS y2, c_mktsegment AS kind FROM customer""",
    "rect_masks": """
SELECT s_suppkey AS fid, CAST((s_suppkey * 37) % 1000 AS DOUBLE) AS x1, CAST((s_suppkey * 41) % 1000 AS DOUBLE) AS y1,
       CAST((s_suppkey * 37) % 1000 + 40 AS DOUBLE) AS x2, CAST((s_suppkey * 41) % 1000 + 30 AS DOUBLE) AS y2, s_name AS kind FROM supplier""",
    "query_vectors": "SELECT vec_id AS prompt_id, label AS class_id, embedding FROM embeddings WHERE vec_id % 20 = 0",
    "prompt_vectors": "SELECT vec_id AS prompt_id, label AS class_id, embedding FROM embeddings WHERE vec_id < 30",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table where there is no view of that name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", VIEWS[name]))


def with_views(sql: str) -> str:
    """Oracle text with the views that it names in front, as common table expressions."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    if not used:
        return sql
    body = sql.strip()
    if re.match(r"WITH RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {ctes}, {body[len('WITH'):]}" if re.match(r"WITH\b", body, re.I) else f"WITH {ctes} {body}"
