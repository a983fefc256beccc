"""Inputs of the registered queries, made from the driver's tables.

Each is one SQL text with {table} holes that both Spark and the oracle's engine
read, so the two sides compute on the same rows. All rows of a table are read, and
the pairs (20 parts each) grow in number with it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def made(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def named(text: str) -> str:
    """The same text over the oracle's views, in parentheses; doubled braces stand for single ones."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", text).replace("{{", "{").replace("}}", "}") + ")"


PART_A = """
SELECT p_partkey AS k, p_name AS name, p_brand AS brand, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price,
  (p_partkey * 37 % 1000) / 1e3 AS x, (p_partkey * 91 % 1000) / 1e3 AS y
FROM {part}"""

#: Drops %97, adds for %89, dearer for %13, one brand renumbered, moves %31.
PART_B = """
SELECT p_partkey AS k, p_name AS name, p_brand AS brand, CAST(p_size + CASE WHEN p_brand LIKE '%3' AND p_partkey % 13 <> 0 THEN 7 ELSE 0 END AS DOUBLE) AS size,
  p_retailprice + CASE WHEN p_partkey % 13 = 0 THEN 1.5e0 ELSE 0e0 END AS price,
  (p_partkey * 37 % 1000) / 1e3 + CASE WHEN p_partkey % 31 = 0 THEN 5e-2 ELSE 0e0 END AS x, (p_partkey * 91 % 1000) / 1e3 AS y
FROM {part} WHERE p_partkey % 97 <> 0
UNION ALL
SELECT p_partkey + 1000000, p_name, p_brand, CAST(p_size AS DOUBLE), p_retailprice, 5e-1, 5e-1 FROM {part} WHERE p_partkey % 89 = 0"""

#: Twelve kinds of text, one in eleven malformed, some with white space around; places on a grid of 1/10,000.
ELEMENTS = """
SELECT p_partkey AS k, CAST(FLOOR(p_partkey / 2e1) AS BIGINT) AS pair_id, CAST(1 + p_partkey % 2 AS INT) AS sheet,
  CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE '' END ||
  CASE p_partkey % 14
    WHEN 0 THEN CAST(p_partkey % 9 + 2 AS STRING) || '"-PV-26-' || lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') || '-GC11S-38'
    WHEN 1 THEN 'PIT ' || CAST(1000 + p_partkey % 9000 AS STRING) || ' 26'
    WHEN 2 THEN 'FT -' || CAST(100 + p_partkey % 900 AS STRING) || ' 27 SD HH:' || CAST(p_partkey % 300 AS STRING) || ' LL:' || CAST(p_partkey % 50 AS STRING)
    WHEN 3 THEN '26BL' || CAST(1000 + p_partkey % 9000 AS STRING)
    WHEN 4 THEN 'N' || CAST(100 + p_partkey % 9000 AS STRING)
    WHEN 5 THEN '26-KA-' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0')
    WHEN 6 THEN CAST(p_partkey % 90 + 1 AS STRING) || '. ' || p_name
    WHEN 7 THEN CAST(p_partkey % 90 + 1 AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '-' || CAST(p_partkey % 90 + 3 AS STRING) ELSE '' END || '. DELETED.'
    WHEN 8 THEN CAST(p_partkey % 90 + 1 AS STRING) || '. SEE DCN-KP-' || lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') || '-1 AND DCN-KP-0007-2'
    WHEN 9 THEN CASE p_partkey % 4 WHEN 0 THEN 'REV C' WHEN 1 THEN 'SHEET ' || CAST(p_partkey % 5 + 1 AS STRING) || ' OF 6' WHEN 2 THEN '2024-01-15' ELSE 'AB' || CAST(p_partkey % 40 AS STRING) || '-PID-1-2-3' END
    WHEN 10 THEN CASE WHEN p_partkey % 3 = 0 THEN 'D' ELSE CAST(p_partkey % 14 AS STRING) END
    WHEN 11 THEN 'A 2023-05-0' || CAST(p_partkey % 9 + 1 AS STRING) || ' ISSUED FOR REVIEW'
    WHEN 12 THEN p_brand
    ELSE p_name END ||
  CASE WHEN p_partkey % 11 = 0 THEN ' ?' WHEN p_partkey % 5 = 0 THEN ' ' ELSE '' END AS text,
  CASE WHEN p_partkey % 14 = 10 THEN 1e-2 ELSE (p_partkey * 7919 % 10000) / 1e4 END AS x, (p_partkey * 104729 % 10000) / 1e4 AS y
FROM {part}"""

#: Words of documents on lines of ten, with gaps that vary.
SPANS = """
SELECT doc_id AS pair_id, 'A' AS side, CAST(1 AS INT) AS sheet, CAST(i AS INT) AS ord, w AS text,
  (i % 10) * 60e0 + CASE WHEN i % 7 = 3 THEN 0e0 ELSE 5e0 END AS x0, (i % 10) * 60e0 + CASE WHEN i % 3 = 0 THEN 55e0 ELSE 60e0 END AS x1,
  CAST(FLOOR(i / 10e0) AS INT) * 12e0 AS y0, CAST(FLOOR(i / 10e0) AS INT) * 12e0 + 10e0 AS y1,
  (i % 10) * 60e0 + CASE WHEN i % 7 = 3 THEN 0e0 ELSE 5e0 END AS origin_x, CAST(FLOOR(i / 10e0) AS INT) * 12e0 + 8e0 + CASE WHEN i % 5 = 1 THEN 25e-2 ELSE 0e0 END AS origin_y, 10e0 AS size
FROM words"""

WORDS_SPARK = "SELECT doc_id, pos AS i, w FROM (SELECT doc_id, posexplode(split(text, ' ')) AS (pos, w) FROM {documents}) q WHERE w <> ''"
WORDS_DUCK = "SELECT doc_id, i - 1 AS i, a[i] AS w FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS a FROM documents) p) q WHERE a[i] <> ''"

#: Answers with citations of known and unknown ids, refusals, and answers without any.
ANSWERS = """
SELECT conv_id * 1000 + turn AS answer_id, conv_id,
  CASE WHEN conv_id % 9 = 0 THEN 'REFUSED: nothing found'
    WHEN conv_id % 7 = 0 THEN text
    ELSE text || ' [A:1:B-3:el_' || CAST(conv_id % 50 AS STRING) || '] and [delta:2:-:delta' || CAST(turn AS STRING) || '].' || CASE WHEN conv_id % 5 = 0 THEN ' [B:1:C-4:el_unknown]' ELSE '' END END AS answer
FROM {conversations} WHERE role = 'assistant'"""

#: Regions, text boxes and change boxes on a unit sheet, on a grid.
REGIONS = """
SELECT p_partkey AS region_id, CAST(FLOOR(p_partkey / 2e1) AS BIGINT) AS pair_id, CAST(1 AS INT) AS sheet, (p_partkey * 37 % 90) / 1e2 AS x0, (p_partkey * 53 % 90) / 1e2 AS y0,
  (p_partkey * 37 % 90) / 1e2 + (p_partkey % 5 + 3) / 1e2 AS x1, (p_partkey * 53 % 90) / 1e2 + (p_partkey % 3 + 3) / 1e2 AS y1,
  CAST(150 + p_partkey * 17 % 6000 AS INT) AS area_px, (p_partkey * 7919 % 1009) / 1009e0 AS magnitude
FROM {part}"""

CHANGE_BOXES = """
SELECT CAST(FLOOR(p_partkey / 2e1) AS BIGINT) AS pair_id, CAST(1 AS INT) AS sheet, (p_partkey * 41 % 90) / 1e2 AS x0, (p_partkey * 59 % 90) / 1e2 AS y0,
  (p_partkey * 41 % 90) / 1e2 + 4e-2 AS x1, (p_partkey * 59 % 90) / 1e2 + 4e-2 AS y1
FROM {part}"""

TEXT_BOXES = """
SELECT CAST(FLOOR(p_partkey / 2e1) AS BIGINT) AS pair_id, CAST(1 AS INT) AS sheet, CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'B' END AS side, CASE WHEN p_partkey % 13 = 0 THEN 'geometry' ELSE 'text' END AS type,
  CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_brand END AS content, (p_partkey * 43 % 90) / 1e2 AS x0, (p_partkey * 61 % 90) / 1e2 AS y0,
  (p_partkey * 43 % 90) / 1e2 + 7e-2 AS x1, (p_partkey * 61 % 90) / 1e2 + 6e-2 AS y1
FROM {part}"""

#: Drawn boxes of sheets of 2,000 x 3,000 pixels, 250 a sheet: on side A but for m = 3, on side B but for m = 9 and moved a little for m = 7.
DRAWN = """
SELECT CAST(FLOOR(p_partkey / 25e1) AS BIGINT) AS pair_id, p_partkey % 11 AS m, CAST(p_partkey * 7919 % 2940 AS INT) AS x, CAST(p_partkey * 104729 % 1950 AS INT) AS y,
  CAST(8 + p_partkey % 43 AS INT) AS w, CAST(6 + p_partkey % 37 AS INT) AS h, CAST(p_size * 4 AS INT) AS grey
FROM {part}"""

#: Labelled and predicted changes of documents.
SCORED = """
SELECT d.doc_id, l.quality, (length(d.text) * 7919 % 1000) / 1e3 AS confidence, d.source, ((length(d.text) * 7919 % 1000) >= 300) AS predicted
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""
