"""Geographic column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the analysed scripts' for identical results:
# mean Earth radius in km used by the distance rule, and the bounding box of
# plausible customer coordinates (latitude -34..6, longitude -74..-34).
EARTH_RADIUS_KM = 6371.01
GEO_BOX = {"lat_min": -34.0, "lat_max": 6.0, "long_min": -74.0, "long_max": -34.0}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _rad(x: Column) -> Column:
    return x * math.pi / 180.0


def distance_km(lat1, long1, lat2, long2) -> Column:
    """Great-circle distance by the spherical law of cosines.

    Any missing coordinate gives null.  A cosine just outside [-1, 1] (machine
    precision, e.g. identical points) is rounded to 6 decimals; if it is still
    outside, the distance is null.
    """
    a1, o1, a2, o2 = (_rad(_c(v)) for v in (lat1, long1, lat2, long2))
    cos_val = F.sin(a1) * F.sin(a2) + F.cos(a1) * F.cos(a2) * F.cos(o1 - o2)
    fixed = F.when(F.abs(cos_val) > 1, F.round(cos_val, 6)).otherwise(cos_val)
    return F.when(F.abs(fixed) > 1, F.lit(None).cast("double")).otherwise(
        F.lit(EARTH_RADIUS_KM) * F.acos(fixed))


def outside_geo_box(lat, long) -> Column:
    """True when the point lies outside the plausible box (bounds inclusive)."""
    la, lo = _c(lat), _c(long)
    return ((la < GEO_BOX["lat_min"]) | (la > GEO_BOX["lat_max"])
            | (lo < GEO_BOX["long_min"]) | (lo > GEO_BOX["long_max"]))


def mask_outside_box(value, lat, long) -> Column:
    """``value`` with points outside the box replaced by null (row kept)."""
    return F.when(F.coalesce(outside_geo_box(lat, long), F.lit(False)),
                  F.lit(None).cast("double")).otherwise(_c(value))


def _as_text(x) -> Column:
    # a missing value renders as the text 'nan', and two missing values compare equal
    return F.coalesce(_c(x).cast("string"), F.lit("nan"))


def state_pair(customer_state, seller_state) -> Column:
    return F.concat(_as_text(customer_state), F.lit("-"), _as_text(seller_state))


def same_state(customer_state, seller_state) -> Column:
    return (_as_text(customer_state) == _as_text(seller_state)).cast("int")


def state_flag(state, value: str) -> Column:
    return F.coalesce(_c(state) == F.lit(value), F.lit(False)).cast("int")
