"""Numbers for the map: scores, sizes, years, lanes, page columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANES, LANE_HEIGHT, TIMELINE_WIDTH = 12, 34, 880
#: Sizes (least, greatest) of owned and external nodes; one size where scaling is off.
OWNED_SIZE, EXTERNAL_SIZE, PLAIN_SIZE = (1.2, 9.5), (0.8, 6.25), 1.05


def citation_score(global_count: Column, local_count: Column) -> Column:
    return F.when(global_count > 0, global_count).otherwise(F.greatest(F.lit(0), F.coalesce(local_count, F.lit(0))))


def scaled(value: Column, low: Column, high: Column, owned: Column) -> Column:
    """A logarithmic score, stretched between the least and greatest of all nodes, as a size."""
    span = high - low
    share = F.when(span > 0, (value - low) / span).otherwise(F.lit(0.0))
    shaped = F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), F.lit(0.8))
    size = lambda r: F.lit(r[0]) + F.lit(r[1] - r[0]) * shaped
    return F.when(owned, size(OWNED_SIZE)).otherwise(size(EXTERNAL_SIZE))


def effective_year(owned: Column, year: Column, date: Column) -> Column:
    """An owned item's own year; else a date as years with a fraction; else a positive year."""
    number = year.try_cast("double")
    positive = F.when(number > 0, number)
    parts = F.split(date, "-")
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("1")).try_cast("double")
    dated = F.when(date.rlike(r"^\d{4}") & (at(1) > 0), at(1) + ((at(2) - 1) + (at(3) - 1) / 31) / 12)
    return F.coalesce(F.when(owned, positive), dated, positive)


def lane_offset(index: Column) -> Column:
    lane = index % LANES
    step = F.floor(lane / 2) + 1
    return F.when(lane % 2 == 0, -step).otherwise(step) * LANE_HEIGHT


def timeline_x(year: Column, first: Column, last: Column) -> Column:
    span = F.when(last - first != 0, last - first).otherwise(F.lit(1.0))
    return F.lit(-TIMELINE_WIDTH / 2) + (year - first) / span * TIMELINE_WIDTH


def page_column(x0: Column, x1: Column, width: Column) -> Column:
    """0 for a block whose centre is left of the page's middle, else 1."""
    return F.when((x0 + x1) / 2 < width / 2, F.lit(0)).otherwise(F.lit(1))


def collision_radius(value: Column) -> Column:
    return F.greatest(F.lit(4.5), F.sqrt(value) * 3.2) + 3


def link_distance(radius_a: Column, radius_b: Column, degree_a: Column, degree_b: Column) -> Column:
    """A link's wanted length: both radii and room for the busier end. A node that isn't drawn has radius 8, one without links degree 1."""
    hub = F.greatest(F.coalesce(degree_a, F.lit(1)), F.coalesce(degree_b, F.lit(1)))
    return F.greatest(F.lit(42.0), F.coalesce(radius_a, F.lit(8.0)) + F.coalesce(radius_b, F.lit(8.0)) + F.least(F.lit(96.0), F.sqrt(hub) * 12))


def component_radius(squares: Column, members: Column) -> Column:
    return F.greatest(F.lit(28.0), F.sqrt(squares) * 1.12, F.sqrt(members) * 8)


def plain_or_scaled(scaling: Column, size: Column) -> Column:
    """The scaled size, or one size for all where scaling is off."""
    return F.when(scaling, size).otherwise(F.lit(PLAIN_SIZE))


def cluster_colour(cluster: Column, colours: int = 15) -> Column:
    """Index of a cluster's colour; null without a cluster (the colour of external nodes)."""
    return F.pmod(cluster, F.lit(colours))


def to_pixels(low: Column, high: Column, scale: Column) -> Column:
    """Start and extent of a box's side on the screen."""
    return F.struct((low * scale).alias("start"), ((high - low) * scale).alias("extent"))


#: The greatest zoom by the number of placed nodes (up to, zoom), and beyond; the margin's
#: least size and its share of the view's shorter side, for up to FEW_NODES nodes and for more.
MOST_ZOOM, ZOOM_BEYOND = ((1, 5.2), (2, 4.2), (4, 3.35), (12, 2.65)), 2.1
FEW_NODES, FEW_MARGIN, MARGIN = 4, (28.0, 0.08), (52.0, 0.07)


def fit_zoom(n: Column, width: Column, height: Column, view_width: Column, view_height: Column) -> Column:
    """The zoom at which the box of n placed nodes fits a view: the least of three limits."""
    short = F.least(view_width, view_height)
    margin = F.when(n <= FEW_NODES, F.greatest(F.lit(FEW_MARGIN[0]), short * FEW_MARGIN[1])).otherwise(F.greatest(F.lit(MARGIN[0]), short * MARGIN[1]))
    most = F.lit(ZOOM_BEYOND)
    for upto, zoom in reversed(MOST_ZOOM):
        most = F.when(n <= upto, zoom).otherwise(most)
    side = lambda view, box: F.greatest(F.lit(1.0), view - 2 * margin) / F.greatest(F.lit(1.0), box)
    return F.least(most, side(view_width, width), side(view_height, height))
