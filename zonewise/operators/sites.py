"""Candidate-site preparation: clinics from registers, provisional stops from car parks, one merged table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from zonewise.functions.ranking import dense_position
from zonewise.operators import joins, spatial

CORE = ("site_id", "site_name", "site_type", "x", "y", "zone", "zone_x", "zone_y", "suitability", "coord_source")


def clinic_sites(
    register: DataFrame,
    lookup: DataFrame,
    centroids: DataFrame,
    postcodes: DataFrame,
    prefix: str,
    site_type: str,
    points: DataFrame | None = None,
    drop_tokens: Sequence[str] = (),
) -> DataFrame:
    """Register rows (id, name, postcode, area) of the study area with zone, coordinates and their source.

    Coordinates come from the best-named building near the postcode when ``points`` is given,
    else from the postcode; unknown postcodes stay without coordinates.
    """
    rows = spatial.geocode_lookup(joins.small_area_to_zone(register, lookup, "area"), "postcode", postcodes)
    rows = rows.withColumns({"site_id": F.concat(F.lit(prefix), F.col("id").cast("string")), "site_name": F.col("name")})
    if points is None:
        rows = rows.withColumn("coord_source", F.lit("postcode_centroid"))
    else:
        rows = spatial.match_by_name(rows, points, drop_tokens)
    rows = joins.attach_xy(rows, centroids)
    return rows.withColumns({"site_type": F.lit(site_type), "suitability": F.lit("confirmed")}).select(*CORE)


def mobile_sites(parking: DataFrame, centroids: DataFrame) -> DataFrame:
    """Public car parks as provisional stops, each in the zone of the nearest centroid, numbered from 1."""
    parks = dense_position(spatial.public_car_parks(parking), [F.col("site_id")], "_n")
    near = spatial.nearest(parks, centroids.select("zone", "x", "y"), "zone")
    return joins.attach_xy(near, centroids).select(
        F.concat(F.lit("MS_"), (F.col("_n") + 1).cast("string")).alias("site_id"),
        F.coalesce("name", F.lit("Public Car Park")).alias("site_name"),
        F.lit("mobile_stop").alias("site_type"),
        "x",
        "y",
        "zone",
        "zone_x",
        "zone_y",
        F.lit("provisional").alias("suitability"),
        F.lit("parking").alias("coord_source"),
    )


def merge_sites(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def site_manifest(sites: DataFrame) -> DataFrame:
    return sites.groupBy("site_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("n_with_xy"), F.min("site_id").alias("first_id")
    )
