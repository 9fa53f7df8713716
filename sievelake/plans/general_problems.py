"""Queries of the general data-processing problems (1, 5 and 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.operators.packed import PackedGrammar, split_packed
from sievelake.operators.salted import salted_aggregate, with_share
from sievelake.operators.spatial import points_in_regions
from sievelake.sources.tables import table


def query_key(column: str):
    """Lower case, ё as е, null as ''."""
    return F.replace(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit("ё"), F.lit("е"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Query keys that hold at least 2.5 % of the search log."""
    log = table(spark, sf, "train", ["search_query"]).select(query_key("search_query").alias("query_key"))
    counts = salted_aggregate(log, ["query_key"], {"n_rows": ("count", None)})
    return with_share(counts, "n_rows", "share").where(F.col("share") >= 0.025).select("query_key")


def p1_query_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Per query key: rows, distinct items, prices and time span."""
    log = table(spark, sf, "train", ["search_query", "item_id", "item_price", "event_ts"])
    log = log.select(query_key("search_query").alias("query_key"), "item_id", "item_price", "event_ts")
    out = salted_aggregate(
        log,
        ["query_key"],
        {"n_rows": ("count", None), "n_items": ("count_distinct", "item_id"), "n_priced": ("count", "item_price"), "avg_price": ("avg", "item_price"), "max_price": ("max", "item_price"), "first_ts": ("min", "event_ts"), "last_ts": ("max", "event_ts")},
    )
    return out.withColumn("avg_price", F.round("avg_price", 2)).withColumn("first_ts", F.col("first_ts").cast("string")).withColumn("last_ts", F.col("last_ts").cast("string"))


def packed_values(spark: SparkSession, sf: str, brackets: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    keys = [r["key_text"] for r in table(spark, sf, "filter_keys", ["key_text"]).collect() if r["key_text"]]  # a fixed list of 30
    grammar = PackedGrammar(keys, brackets)
    log = table(spark, sf, "train", ["log_id", "search_infm_params_text"]).select(
        F.lit("train").alias("source_table"), F.col("log_id").cast("string").alias("rec_id"), F.col("search_infm_params_text").alias("packed")
    )
    items = table(spark, sf, "benchmark_items", ["item_id", "item_infm_params_text"]).select(
        F.lit("benchmark_items").alias("source_table"), F.col("item_id").alias("rec_id"), F.col("item_infm_params_text").alias("packed")
    ).dropDuplicates(["rec_id"])
    carry = ["source_table", "rec_id"]
    return split_packed(log, "packed", carry, grammar).unionByName(split_packed(items, "packed", carry, grammar))


def p5_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values of both packed fields with kind and error flag, brackets shielding separators."""
    return packed_values(spark, sf, (("(", ")"), ("[", "]"), ("{", "}")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values of both packed fields as this data defines them: quoted or bare, brackets are characters."""
    return packed_values(spark, sf).select("source_table", "rec_id", "pos", "param_key", "param_value")


def regions(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "geo_places")
    disc = F.col("place_kind") == "point"
    return places.select(
        F.col("place_id").cast("long").alias("place"),
        *[F.when(disc, F.col(c)).alias(a) for c, a in (("center_latitude", "disc_lat"), ("center_longitude", "disc_lon"), ("radius_km", "disc_km"))],
        *[F.when(~disc, F.col(c)).alias(a) for c, a in (("ring_latitude", "ring_lat"), ("ring_longitude", "ring_lon"))],
    )


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Places that each item's coordinates lie in or near."""
    points = table(spark, sf, "benchmark_items", ["item_id", "item_latitude", "item_longitude"])
    hits = points_in_regions(points, "item_latitude", "item_longitude", regions(spark, sf))
    return hits.select("item_id", F.col("place_id").cast("int").alias("place_id")).distinct()


def p7_location_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per item: how many places hold it, and whether one of them has the claimed location."""
    points = table(spark, sf, "benchmark_items", ["item_id", "item_latitude", "item_longitude", "item_location_id"])
    hits = points_in_regions(points, "item_latitude", "item_longitude", regions(spark, sf))
    places = F.broadcast(table(spark, sf, "geo_places", ["place_id", "location_id"]).withColumn("place_id", F.col("place_id").cast("long")))  # 640 rows, fixed
    same = F.coalesce(F.col("location_id") == F.col("item_location_id"), F.lit(False))
    return hits.join(places, "place_id").groupBy("item_id").agg(F.countDistinct("place_id").alias("n_places"), F.max(same.cast("int")).alias("agrees"))


QUERIES = {"p1_found": p1_found, "p1_query_profile": p1_query_profile, "p5_found": p5_found, "p5_values": p5_values, "p7_found": p7_found, "p7_location_check": p7_location_check}

_KEY = "replace(lower(coalesce(search_query, '')), 'ё', 'е')"
_PIP = """
WITH places AS (
  SELECT place_id, location_id, place_kind, center_latitude cy, center_longitude cx, radius_km km, ring_latitude ry, ring_longitude rx FROM geo_places),
vert AS (SELECT place_id, unnest(range(1, len(ry) + 1)) i, ry, rx FROM places WHERE place_kind = 'area'),
edge AS (SELECT place_id, i, ry[i] y1, rx[i] x1, ry[CASE WHEN i = len(ry) THEN 1 ELSE i + 1 END] y2, rx[CASE WHEN i = len(ry) THEN 1 ELSE i + 1 END] x2, rx[1] x0 FROM vert),
-- every vertex as seen from the first one: all these rings are narrower than 180 degrees
flat AS (SELECT place_id, y1, y2, x0, x1 - 360 * round((x1 - x0) / 360) x1, x2 - 360 * round((x2 - x0) / 360) x2 FROM edge),
pts AS (SELECT DISTINCT item_id, item_latitude y, item_longitude x, item_location_id loc FROM benchmark_items
  WHERE item_latitude BETWEEN -90 AND 90 AND item_longitude BETWEEN -180 AND 180),
box AS (SELECT place_id, min(least(y1, y2)) s, max(greatest(y1, y2)) n FROM flat GROUP BY 1),
area AS (
  SELECT p.item_id, f.place_id FROM pts p JOIN box b ON p.y BETWEEN b.s AND b.n JOIN flat f ON f.place_id = b.place_id
  GROUP BY p.item_id, f.place_id, p.y, p.x
  HAVING sum(CASE WHEN (f.y1 > p.y) <> (f.y2 > p.y) AND p.x - 360 * round((p.x - f.x0) / 360) < (f.x2 - f.x1) * (p.y - f.y1) / (f.y2 - f.y1) + f.x1 THEN 1 ELSE 0 END) % 2 = 1),
near AS (
  SELECT p.item_id, c.place_id FROM pts p JOIN places c ON c.place_kind = 'point' AND p.y BETWEEN c.cy - c.km / 111 - 0.01 AND c.cy + c.km / 111 + 0.01
  WHERE 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(c.cy - p.y) / 2), 2) + cos(radians(p.y)) * cos(radians(c.cy)) * pow(sin(radians(c.cx - p.x) / 2), 2)))) <= c.km),
hits AS (SELECT * FROM area UNION SELECT * FROM near)
"""
SQL = {
    "p1_found": f"SELECT {_KEY} AS query_key FROM train GROUP BY 1 HAVING count(*) >= 0.025 * (SELECT count(*) FROM train)",
    "p1_query_profile": f"""SELECT {_KEY} AS query_key, count(*) AS n_rows, count(DISTINCT item_id) AS n_items, count(item_price) AS n_priced,
  round(sum(item_price) / nullif(count(item_price), 0), 2) AS avg_price, max(item_price) AS max_price,
  CAST(min(event_ts) AS VARCHAR) AS first_ts, CAST(max(event_ts) AS VARCHAR) AS last_ts FROM train GROUP BY 1""",
    "p7_found": _PIP + "SELECT DISTINCT item_id, place_id FROM hits",
    "p7_location_check": _PIP + """SELECT h.item_id, count(DISTINCT h.place_id) AS n_places,
  max(CASE WHEN g.location_id = p.loc THEN 1 ELSE 0 END) AS agrees FROM hits h JOIN pts p USING (item_id) JOIN geo_places g ON g.place_id = h.place_id GROUP BY 1""",
}
