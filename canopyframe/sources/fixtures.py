"""Forest-shaped views over the driver's tables, as SQL text both engines run.

Every view is a projection or aggregate of the given tables, so its size follows theirs.  The number
of stands grows with the tables (six per block of rows) while each stand stays 100 m x 100 m, so point
and stem density do not change with scale.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from canopyframe.functions.hashing import uniform_sql

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

_U = uniform_sql("l_partkey * 31 + l_linenumber", "l_orderkey", "l_suppkey", 1)
_V = uniform_sql("l_partkey * 31 + l_linenumber", "l_orderkey", "l_suppkey", 2)
_R = uniform_sql("l_partkey * 31 + l_linenumber", "l_orderkey", "l_suppkey", 3)

VIEWS: dict[str, str] = {
    # airborne returns: one per lineitem row, no unique key
    "fx_points": """
SELECT CAST(l_suppkey % 6 + 1 + 6 * CAST(floor(l_orderkey / 15000) AS BIGINT) AS INT) AS stand,
       ((l_partkey*7919 + l_linenumber*104729 + l_orderkey*31) % 10000) / CAST(100 AS DOUBLE) AS x,
       ((l_suppkey*6151 + l_orderkey*613 + l_linenumber*3571) % 10000) / CAST(100 AS DOUBLE) AS y,
       ((CAST(l_quantity AS BIGINT)*977 + l_partkey*13 + l_linenumber*5) % 3600) / CAST(100 AS DOUBLE) AS z,
       CASE WHEN (l_partkey + l_linenumber) % 17 = 0 THEN 2
            WHEN (l_partkey + l_linenumber) % 23 = 0 THEN 18 ELSE 1 END AS classification,
       CAST(1 + l_suppkey % 5 AS INT) AS number_of_returns,
       CAST(1 + l_orderkey % (1 + l_suppkey % 5) AS INT) AS return_number,
       CAST(l_partkey % 73 - 36 AS INT) AS scan_angle,
       CAST(CAST(floor(l_extendedprice) AS BIGINT) % 4096 AS INT) AS intensity,
       CAST((l_orderkey*17) % 256 AS INT) AS red, CAST((l_orderkey*29 + 80) % 256 AS INT) AS green,
       CAST((l_orderkey*41) % 256 AS INT) AS blue,
       l_orderkey * 8 + l_linenumber AS pid
FROM {lineitem}""",
    # field plots: one per supplier
    "fx_plots": """
SELECT s_suppkey AS plot, CAST(s_suppkey % 6 + 1 + 6 * CAST(floor(s_suppkey / 100) AS BIGINT) AS INT) AS stand,
       CAST(15 + (s_suppkey*37) % 70 AS DOUBLE) AS cx, CAST(15 + (s_suppkey*53) % 70 AS DOUBLE) AS cy,
       4 + ((s_suppkey % 6)*7 % 11) / CAST(2 AS DOUBLE) + (s_suppkey % 7) / CAST(10 AS DOUBLE) AS age
FROM {supplier}""",
    # stem map, unique tree_id
    "fx_trees": """
SELECT c_custkey AS tree_id, CAST(c_custkey % 6 + 1 + 6 * CAST(floor(c_custkey / 1500) AS BIGINT) AS INT) AS stand,
       ((c_custkey*7919 + (c_custkey*c_custkey) % 9973) % 10000) / CAST(100 AS DOUBLE) AS x,
       ((c_custkey*6151 + (c_custkey*c_custkey*3) % 9967) % 10000) / CAST(100 AS DOUBLE) AS y,
       6 + ((c_custkey*131) % 2400) / CAST(100 AS DOUBLE) AS dbh_cm,
       12 + ((c_custkey*131) % 2400) / CAST(150 AS DOUBLE) + ((c_custkey*71) % 300) / CAST(100 AS DOUBLE) AS h_m
FROM {customer}""",
    # jittered detections of the stems in nine views, unique det_id
    "fx_detections": """
SELECT o_orderkey AS det_id, t.stand, t.tree_id, CAST(o_orderkey % 9 AS INT) AS view_id,
       t.x + ((o_orderkey*37) % 241 - 120) / CAST(100 AS DOUBLE) AS x,
       t.y + ((o_orderkey*53) % 241 - 120) / CAST(100 AS DOUBLE) AS y,
       50 + CAST(floor(o_totalprice) AS BIGINT) % 5000 AS n_pts,
       t.h_m - ((o_orderkey*19) % 200) / CAST(100 AS DOUBLE) AS z_max
FROM {orders} JOIN {fx_trees} t ON o_custkey = t.tree_id""",
    # census rows by plot: 15 trees each, some dead (null diameter), spacing as text
    "fx_census": """
SELECT CAST(floor(c_custkey / 15) AS BIGINT) AS plot, t.stand AS tree_stand,
       CAST(floor((c_custkey % 15) / 5) AS BIGINT) + 1 AS linha, c_custkey % 5 + 3 AS arvore, c_custkey AS tree_id,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE t.dbh_cm END AS d_cm, t.h_m,
       CASE WHEN c_custkey % 2 = 0 THEN '2,87 x 1,88' ELSE '1,9 x 3' END AS espac
FROM {customer} JOIN {fx_trees} t ON t.tree_id = c_custkey""",
    # stem sections, unique (tree_id, h_m)
    "fx_sections": """
SELECT l_orderkey AS tree_id, l_linenumber*2 - CAST(1.7 AS DOUBLE) AS h_m,
       30 - 3*l_linenumber + max(l_quantity)/CAST(25 AS DOUBLE) AS d_cm
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    # scaled trees: per-tree volume from a noisy volume law
    "fx_volumes": """
SELECT CAST(tree_id AS INT) AS arv, stand AS talhao, dbh_cm AS d_cm, h_m,
       0.00004 * dbh_cm * dbh_cm * h_m * (0.9 + (tree_id * 37 % 21) / CAST(100 AS DOUBLE)) AS v
FROM {fx_trees}""",
    # plot table with covariates, a target and an imperfect prediction
    "fx_panel0": """
SELECT plot, stand, age, cx, cy,
       10 + 2.2 * age + ((plot * 13) % 17) / CAST(10 AS DOUBLE) AS hdom,
       8 + 2.0 * age + ((plot * 29) % 23) / CAST(10 AS DOUBLE) AS hmean,
       3 + ((plot * 7) % 19) / CAST(10 AS DOUBLE) AS zsd,
       0.5 + ((plot * 11) % 37) / CAST(100 AS DOUBLE) AS cover,
       900 + (plot * 61) % 700 AS n_field, 500 + (plot * 61) % 700 * 0.5 + (plot * 17) % 90 AS n_obs
FROM {fx_plots}""",
    "fx_panel": """
SELECT p.*, round(exp(0.5 + 1.1 * ln(hdom) + 0.4 * ln(age) + ((plot * 41) % 31 - 15) / CAST(100 AS DOUBLE)), 4) AS vol_ha,
       round(exp(0.5 + 1.1 * ln(hdom) + 0.4 * ln(age) + ((plot * 41) % 31 - 15) / CAST(100 AS DOUBLE))
             * (0.88 + ((plot * 19) % 25) / CAST(100 AS DOUBLE)), 4) AS pred
FROM {fx_panel0} p""",
    # terrestrial returns of single stems with a segmenter's instance and semantic labels
    "fx_stem0": f"""
SELECT l_suppkey AS k, l_orderkey * 8 + l_linenumber AS pid, (l_orderkey + l_linenumber) % 10 AS kind,
       14 + (l_suppkey*37 % 120) / CAST(10 AS DOUBLE) AS h0, 0.06 + (l_suppkey*53 % 90) / CAST(1000 AS DOUBLE) AS r0,
       5 + 10 * (l_suppkey % 10) + (l_suppkey*17 % 10) / CAST(10 AS DOUBLE) AS cx,
       5 + 10 * (CAST(floor(l_suppkey / 10) AS BIGINT) % 10) AS cy,
       {_U} AS u, {_V} AS v, {_R} AS w, l_partkey
FROM {{lineitem}}""",
    "fx_stem1": """
SELECT k, pid, kind, h0, r0, cx, cy, u, l_partkey,
       CASE WHEN kind = 0 THEN 0.05 * w WHEN kind <= 6 THEN 0.7 * h0 * v * sqrt(v) ELSE h0 * (0.5 + 0.5 * v) END AS z,
       CASE WHEN kind = 0 THEN 1.5 * sqrt(v)
            WHEN kind <= 6 THEN r0 * sqrt(1 - 0.7 * v * sqrt(v)) + (w - 0.5) * 0.012
            ELSE 0.1 + 2.0 * (1 - v) * sqrt(w) END AS rad
FROM {fx_stem0}""",
    "fx_labelled": """
SELECT 't' || lpad(CAST(CAST(floor(k / 4) AS BIGINT) AS VARCHAR(12)), 4, '0') || '_p' || CAST(k % 4 AS VARCHAR(12)) AS tile,
       CASE WHEN l_partkey % 29 = 0 THEN -1 ELSE k END AS inst, pid,
       round(cx + rad * cos(2 * pi() * u), 4) AS x, round(cy + rad * sin(2 * pi() * u), 4) AS y, round(z, 4) AS z,
       CASE WHEN kind = 0 THEN 0 WHEN kind <= 6 THEN 1 WHEN kind = 9 THEN NULL ELSE 2 END AS semantic,
       ((l_partkey * 7) % 100) / CAST(100 AS DOUBLE) AS score
FROM {fx_stem1}""",
    "fx_tree_pts": """
SELECT inst, pid, x, y, z, coalesce(semantic, 2) AS semantic, score FROM {fx_labelled} WHERE inst >= 0""",
    # stem centres and true radii behind fx_labelled
    "fx_stems": """
SELECT s_suppkey AS stem, 14 + (s_suppkey*37 % 120) / CAST(10 AS DOUBLE) AS h0,
       0.06 + (s_suppkey*53 % 90) / CAST(1000 AS DOUBLE) AS r0,
       5 + 10 * (s_suppkey % 10) + (s_suppkey*17 % 10) / CAST(10 AS DOUBLE) AS cx,
       CAST(5 + 10 * (CAST(floor(s_suppkey / 10) AS BIGINT) % 10) AS DOUBLE) AS cy
FROM {supplier}""",
    # stand outlines: an irregular hexagon per stand
    "fx_edges": """
SELECT s.stand, 0 AS ring, v.seq, v.x1 + s.stand % 3 AS x1, v.y1 AS y1, v.x2 + s.stand % 3 AS x2, v.y2 AS y2
FROM (SELECT DISTINCT stand FROM {fx_plots}) s JOIN
     (SELECT 0 AS seq, CAST(5 AS DOUBLE) AS x1, CAST(10 AS DOUBLE) AS y1, CAST(60 AS DOUBLE) AS x2, CAST(3 AS DOUBLE) AS y2
      UNION ALL SELECT 1, 60, 3, 95, 40 UNION ALL SELECT 2, 95, 40, 70, 60
      UNION ALL SELECT 3, 70, 60, 90, 97 UNION ALL SELECT 4, 90, 97, 20, 88 UNION ALL SELECT 5, 20, 88, 5, 10) v
  ON v.seq >= 0""",
    # tile arrivals for the streaming operators
    "fx_tile_events": """
SELECT event_id, ts, CAST(user_id % 6 + 1 + 6 * CAST(floor(event_id / 10000) AS BIGINT) AS INT) AS stand,
       CAST(floor(event_id % 10000 / 250) AS INT) AS tile_seq,
       ((event_id*7919) % 10007) / CAST(100 AS DOUBLE) AS x, ((event_id*6151) % 10009) / CAST(100 AS DOUBLE) AS y,
       1 + (event_id * 37) % 997 AS size
FROM {events}""",
}

_REF = re.compile(r"\{(\w+)\}")


class Fixtures:
    """Lazily built DataFrames for one data folder: ``fx.lineitem``, ``fx.fx_points`` ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in VIEWS:
                self._made[name] = self.sql(VIEWS[name])
            else:
                raise AttributeError(name)
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(_REF.findall(text))})


def _needed(text: str, found: dict[str, None]) -> None:
    for name in re.findall(r"\bfx_\w+", text):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found[name] = None


def with_views(body: str) -> str:
    """``body`` preceded by the definitions of the views it mentions, as one SQL statement."""
    found: dict[str, None] = {}
    _needed(body, found)
    ctes = ", ".join(f"{n} AS ({_REF.sub(lambda m: m.group(1), VIEWS[n]).strip()})" for n in found)
    return f"WITH {ctes} {body}" if found else body
