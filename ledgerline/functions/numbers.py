"""Amount bins, ratios and distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius in km, and the inner edges of the fallback amount bins.
EARTH_RADIUS_KM = 6371.0088
FIXED_INNER_EDGES = [10.0, 50.0, 200.0]


def log_amount(amount: Column) -> Column:
    """log(1 + amount); NULL at -1 and below, where it is not a finite number."""
    return F.when(amount > -1.0, F.log1p(amount))


def bin_by_edges(value: Column, edges: list[float]) -> Column:
    """Right-closed bins by ascending edges; the lowest edge belongs to bin 0.

    Equal edges count once. NULL outside the edges or with fewer than two distinct ones.
    """
    distinct = sorted(set(edges))
    if len(distinct) < 2:
        return F.lit(None).cast("int")
    number = F.lit(0)
    for edge in distinct[1:-1]:
        number = number + (value > edge).cast("int")
    return F.when(value.between(distinct[0], distinct[-1]), number).cast("int")


def bin_fixed(value: Column) -> Column:
    """Bin numbers 0 to 3 by the fixed edges, open at both ends."""
    bin_number = F.lit(0)
    for edge in FIXED_INNER_EDGES:
        bin_number = bin_number + (value > edge).cast("int")
    return bin_number.cast("int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; NULL when a coordinate is NULL."""
    north = F.sin(F.radians(lat2 - lat1) / 2)
    east = F.sin(F.radians(lon2 - lon1) / 2)
    chord = north * north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * east * east
    return F.asin(F.sqrt(F.least(chord, F.lit(1.0)))) * (2 * EARTH_RADIUS_KM)
