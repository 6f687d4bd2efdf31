"""Quick and standard suspicion signals, 0 to 100 each, and their weighted means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
QUICK_WEIGHTS = {"follower_ratio": 0.15, "genre_absence": 0.10, "image_quality": 0.05, "external_urls": 0.10, "catalog_size": 0.10, "durations": 0.10, "cadence": 0.15, "placement": 0.10, "popularity_mismatch": 0.10, "name_points": 0.05}
STANDARD_WEIGHTS = {"quick": 0.40, "genius": 0.12, "discogs": 0.12, "live": 0.12, "registry": 0.08, "label": 0.10, "fans": 0.06}


def follower_ratio(listeners: Column, followers: Column, popularity: Column) -> Column:
    r, per = followers / listeners, popularity / followers
    known = F.when(followers == 0, 90).when(r < 0.001, 90).when(r < 0.005, 70).when(r < 0.01, 45).when(r < 0.03, 25).otherwise(5)
    unknown = F.when((followers == 0) & (popularity > 20), 90).when(followers == 0, 60).when(per > 1, F.least(F.lit(90.0), 50 + 10 * per)).when(per > 0.1, 30).otherwise(5)
    return F.when(listeners > 0, known).otherwise(unknown).cast("double")


def genre_absence(n: Column) -> Column:
    return F.when(n == 0, 70).when(n == 1, 20).otherwise(0)


def image_quality(width: Column) -> Column:
    """width: 0 for no image."""
    return F.when(width == 0, 80).when(width < 300, 40).otherwise(0)


def external_urls(n: Column) -> Column:
    return F.when(n == 0, 50).otherwise(0)


def catalog_size(albums: Column, singles: Column) -> Column:
    return F.when((albums == 0) & (singles == 0), 60).when((albums == 0) & (singles > 20), 70).when((albums == 0) & (singles <= 5), 30).when((singles > 50) & (albums < 2), 75).otherwise(5)


def durations(n: Column, mean: Column, sd: Column) -> Column:
    short = F.when(mean < 90, 40).when(mean < 120, 20).otherwise(0)
    alike = F.when((sd < 10) & (n >= 5), 35).when(sd < 20, 15).otherwise(0)
    return F.when(n < 3, 20).otherwise(short + alike)


def cadence(n: Column, days: Column) -> Column:
    rate = n / F.greatest(days / 30.0, F.lit(1.0))
    return F.when(n < 2, 10).when(days == 0, 80).when(rate > 8, 90).when(rate > 4, 65).when(rate > 2, 35).otherwise(5)


def placement(popularity: Column, followers: Column) -> Column:
    return F.when((popularity >= 40) & (followers < 500), 80).when((popularity >= 30) & (followers < 200), 70).when((popularity >= 20) & (followers < 50), 60).otherwise(5)


def popularity_mismatch(n: Column, most: Column, mean: Column, followers: Column) -> Column:
    return F.when(n == 0, 20).when((most > 50) & (followers < 300), 80).when((mean > 30) & (followers < 500), 55).otherwise(5)


def weighted(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Rounded mean by weight of the signals at hand, within 0 and 100."""
    total = sum(weights[k] for k in signals)
    mean = sum((signals[k] * weights[k] for k in list(signals)[1:]), signals[next(iter(signals))] * weights[next(iter(signals))]) / total
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(mean))).cast("long")


def steps(value: Column, table: tuple[tuple[float, float], ...], above: float) -> Column:
    """The points of the first bound that value doesn't exceed."""
    out = F
    for bound, points in table:
        out = out.when(value <= bound, points)
    return out.otherwise(above)
