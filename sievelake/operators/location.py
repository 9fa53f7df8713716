"""Where items of a search location are: shares from the log, centroids, distances and the log prior."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.geo import haversine_km
from sievelake.operators.index import small_side
from sievelake.operators.spatial import points_in_regions
from sievelake.staging import stage

#: Fixed values of the prior: weight of the same location, of nearness, its reach, the floor, and the distance of the unknown.
SAME, NEAR, REACH_KM, FLOOR, UNKNOWN_KM = 0.5, 0.05, 30.0, 1e-4, 5000.0
#: Beyond this distance nearness adds less than 2e-12 to the logarithm of the floor.
NEAR_KM = 1_000.0
LOWEST = math.log(FLOOR)


def conditional(clicks: DataFrame, search: str = "search_location_id", item: str = "item_location_id") -> DataFrame:
    """(search, item, n, p): share of a search location's clicks on items of each location."""
    counts = clicks.where(F.col(search).isNotNull() & F.col(item).isNotNull()).groupBy(search, item).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(search).agg(F.sum("n").alias("__all"))
    return counts.join(totals, search).withColumn("p", F.col("n") / F.col("__all")).drop("__all")


def centroids(items: DataFrame, clicks: DataFrame) -> DataFrame:
    """(location, lat, lon, n_points): median coordinates of an item location, or, for locations that only searches have, of the clicked items.

    The two medians are taken on their own, and null coordinates are skipped.
    """
    of = lambda df, key: df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("location")).agg(
        F.median("item_latitude").alias("lat"), F.median("item_longitude").alias("lon"), F.count(F.lit(1)).alias("n_points")
    )
    own = of(items, "item_location_id")
    return own.unionByName(of(clicks, "search_location_id").join(own.select("location"), "location", "left_anti"))


def log_prior(p: Column, same: Column, distance: Column) -> Column:
    """ln(max(P(item location | search location), 0.5 if the same, 0.05 e^(-km / 30)) + 1e-4)."""
    near = F.lit(NEAR) * F.exp(-F.coalesce(distance, F.lit(UNKNOWN_KM)) / REACH_KM)
    return F.log(F.greatest(F.coalesce(p, F.lit(0.0)), F.when(same, SAME).otherwise(0.0), near) + FLOOR)


@dataclass
class Prior:
    """What the prior is made of: shares (search_location_id, item_location_id, p) from the log and centres (location, lat, lon).

    Pairs of locations are never enumerated: ``attach`` computes the prior of given pairs, ``near`` lists those above the floor.
    """

    shares: DataFrame
    centres: DataFrame

    def attach(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (s_loc, item_loc, ...) with loc_p, loc_same, loc_dist and loc_logp. A null location is far from everything and has the floor."""
        at = lambda a: small_side(self.centres.select(F.col("location").alias(a), F.struct("lat", "lon").alias(f"__{a}")))
        p = small_side(self.shares.select(F.col("search_location_id").alias("s_loc"), F.col("item_location_id").alias("item_loc"), F.col("p").alias("loc_p")))
        out = pairs.join(at("s_loc"), "s_loc", "left").join(at("item_loc"), "item_loc", "left").join(p, ["s_loc", "item_loc"], "left")
        km = haversine_km(F.col("__s_loc.lat"), F.col("__s_loc.lon"), F.col("__item_loc.lat"), F.col("__item_loc.lon"))
        same = F.coalesce(F.col("s_loc") == F.col("item_loc"), F.lit(False))
        out = out.withColumns({"loc_p": F.coalesce("loc_p", F.lit(0.0)), "loc_same": same.cast("double"), "loc_dist": F.coalesce(km, F.lit(UNKNOWN_KM))})
        return out.withColumn("loc_logp", log_prior(F.col("loc_p"), same, F.col("loc_dist"))).drop("__s_loc", "__item_loc")

    def near(self, searches: DataFrame, items: DataFrame, search: str = "search_location_id", item: str = "item_location_id") -> DataFrame:
        """(s_loc, item_loc, loc_p, loc_same, loc_dist, loc_logp) of the pairs above the floor: clicked in the log, equal, or within NEAR_KM.

        Points within reach are found by cells of a space-filling curve, as any points near others.
        """
        asked = stage(searches.select(F.col(search).cast("long").alias("s_loc")).where(F.col("s_loc").isNotNull()).distinct(), "search-places")
        places = stage(items.select(F.col(item).cast("long").alias("item_loc")).where(F.col("item_loc").isNotNull()).distinct(), "item-places")
        at = lambda df, a: df.join(small_side(self.centres.select(F.col("location").alias(a), "lat", "lon")), a)
        no_ring = F.lit(None).cast("array<double>")
        discs = at(asked, "s_loc").select(F.col("s_loc").alias("place"), F.col("lat").alias("disc_lat"), F.col("lon").alias("disc_lon"), F.lit(NEAR_KM).alias("disc_km"), no_ring.alias("ring_lat"), no_ring.alias("ring_lon"))
        close = points_in_regions(at(places, "item_loc"), "lat", "lon", discs, place="s_loc").select("s_loc", "item_loc")
        logged = self.shares.select(F.col("search_location_id").alias("s_loc"), F.col("item_location_id").alias("item_loc"))
        logged = logged.join(small_side(asked), "s_loc", "left_semi").join(small_side(places), "item_loc", "left_semi").select("s_loc", "item_loc")
        equal = asked.join(places, F.col("s_loc") == F.col("item_loc")).select("s_loc", "item_loc")
        return self.attach(close.unionByName(logged).unionByName(equal).distinct())
