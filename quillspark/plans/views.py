"""Deterministic views over the driver's tables, in SQL that Spark and DuckDB both read.

Images hold ten boxes each, so their number grows with the table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

IMAGE = "CAST((p_partkey - p_partkey % 10) / 10 AS BIGINT)"
VIEWS = {
    "v_pairs": """
        SELECT item_id AS ord, CAST(item_id % 5 AS STRING) AS document_id, CAST(item_id % 10 AS STRING) AS line_id, text AS ground_truth,
          CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(replace(text, 'th', 't'), 'er', 're') ELSE translate(text, 'aeio', 'eoia') END AS prediction
        FROM {benchmark}""",
    "v_dialog": """
        SELECT turn AS ord, CAST(conv_id AS STRING) AS document_id, CAST((turn - turn % 2) / 2 AS BIGINT) AS line_id, text AS ground_truth,
          CASE (conv_id + turn) % 4 WHEN 0 THEN replace(text, 'th', 't') WHEN 1 THEN translate(text, 'ae', 'ea') ELSE text END AS prediction
        FROM {conversations}""",
    "v_images": f"""
        SELECT DISTINCT {IMAGE} AS image_id, concat('page_', CAST({IMAGE} AS STRING), '.png') AS file_name, 600 AS width, 800 AS height FROM {{part}}""",
    "v_gt": f"""
        SELECT {IMAGE} AS image_id, p_partkey AS gt, CAST((p_partkey * 37) % 400 AS DOUBLE) AS x, CAST((p_partkey * 11) % 600 AS DOUBLE) AS y,
          CAST(60 + p_size AS DOUBLE) AS w, CAST(12 + p_size % 9 AS DOUBLE) AS h,
          CASE {IMAGE} % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source
        FROM {{part}} WHERE p_partkey % 19 <> 0""",
    "v_pred": f"""
        SELECT {IMAGE} AS image_id, p_partkey AS pred, CAST((p_partkey * 7919) % 997 AS DOUBLE) / CAST(996 AS DOUBLE) AS score,
          CAST((p_partkey * 37) % 400 + p_partkey % 7 AS DOUBLE) AS x, CAST((p_partkey * 11) % 600 + p_partkey % 3 AS DOUBLE) AS y,
          CAST(60 + p_size AS DOUBLE) * CAST(5 + p_partkey % 6 AS DOUBLE) / CAST(10 AS DOUBLE) AS w,
          CASE WHEN p_partkey % 17 = 0 THEN CAST(40 AS DOUBLE) ELSE CAST(12 + p_size % 9 AS DOUBLE) END AS h
        FROM {{part}} WHERE p_partkey % 7 <> 0
        UNION ALL
        SELECT {IMAGE}, p_partkey + 100000000, CAST((p_partkey * 104729) % 997 AS DOUBLE) / CAST(996 AS DOUBLE),
          CAST((p_partkey * 37) % 400 AS DOUBLE) + CAST(60 + p_size AS DOUBLE) / CAST(2 AS DOUBLE), CAST((p_partkey * 11) % 600 AS DOUBLE),
          CAST(60 + p_size AS DOUBLE) / CAST(2 AS DOUBLE), CAST(12 + p_size % 9 AS DOUBLE)
        FROM {{part}} WHERE p_partkey % 5 = 0""",
    "v_steps": "SELECT user_id AS run, ts, event_id, value FROM {events}",
    "v_vec": "SELECT label AS run, vec_id AS step, embedding AS vec FROM {embeddings}",
    "v_scored": """
        SELECT doc_id, CAST((doc_id * 7919) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score, quality AS correct FROM {labels}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = set(re.findall(r"{(\w+)}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def with_views(sql: str, recursive: bool = False) -> str:
    """DuckDB SQL with the views it names in front; `sql` starts with further named queries or with SELECT."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    heads = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in used]
    body = sql.strip()
    if body.startswith("WITH "):
        heads, body = [*heads, body[5:]], ""
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(heads)} {body}" if heads else body
