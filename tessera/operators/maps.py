"""Attribution maps, masks and rasters as long tables: (image, row, col, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact, with_exact


def grid_long(df: DataFrame, keep: Sequence[str], grid: str, width: int) -> DataFrame:
    """A flat array of H x W values as rows (row, col, value)."""
    return df.select(*keep, F.posexplode(grid).alias("_p", "value")).select(*keep, F.floor(F.col("_p") / width).cast("int").alias("row"), F.pmod("_p", F.lit(width)).cast("int").alias("col"), "value")


def patch_contributions(tokens: DataFrame, gamma: Sequence[float], beta: Sequence[float], heads: DataFrame) -> DataFrame:
    """(image, model, patch, contribution) of linear heads on the layer-normed mean of patch tokens.

    ``tokens`` has image, patch, token array<double>; ``heads`` has model, coef, intercept. The pooled mean is normalized by its own mean and
    variance over dimensions; both are sums over patches, so a head's score splits exactly into patches plus a constant part, which is spread
    evenly. Contributions of an image add up to its score.
    """
    d = len(gamma)
    long = tokens.select("image", "patch", F.posexplode("token").alias("k", "v"))
    pooled = long.groupBy("image", "k").agg(F.avg("v").alias("m"))
    facts = pooled.groupBy("image").agg(F.avg("m").alias("mu"), F.sqrt(F.var_pop("m") + 1e-6).alias("sd"))
    patches = tokens.groupBy("image").agg(F.count("*").alias("n"))
    g, b = (F.array(*[F.lit(float(x)) for x in xs]) for xs in (gamma, beta))
    small = F.broadcast(heads.select("model", F.zip_with("coef", g, lambda c, x: c * x).alias("w"), (F.aggregate(F.zip_with("coef", b, lambda c, x: c * x), F.lit(0.0), lambda s, x: s + x) + F.col("intercept")).alias("a")))  # few heads
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    own = F.aggregate(F.zip_with("token", "w", lambda t, w: t * w), F.lit(0.0), lambda s, x: s + x)
    joined = tokens.join(facts, "image").join(patches, "image").crossJoin(small)
    value = own / F.col("n") / F.col("sd") + (F.col("a") - F.col("mu") * total / F.col("sd")) / F.col("n")
    if d < 1:
        raise ValueError("no dimensions")
    return joined.select("image", "model", "patch", value.alias("contribution"))


def reconstruction_error(contributions: DataFrame, scores: DataFrame) -> DataFrame:
    """n and max_error of summed contributions against scores (image, model, score)."""
    sums = contributions.groupBy("image", "model").agg(F.sum("contribution").alias("s"))
    return sums.join(scores, ["image", "model"]).agg(F.count("*").alias("n"), F.max(F.abs(F.col("s") - F.col("score"))).alias("max_error"))


def normalize_mass(maps: DataFrame, image: Sequence[str], value: str = "value", name: str = "share") -> DataFrame:
    """Each map divided by its sum of absolute values; maps without mass are null."""
    mass = F.sum(F.abs(value)).over(Window.partitionBy(*image))
    return maps.withColumn(name, F.col(value) / F.nullif(mass, F.lit(0.0)))


def map_summary(maps: DataFrame, group: Sequence[str], value: str = "value") -> DataFrame:
    """Per group and cell: n, mean, median, sd."""
    return with_exact(maps, [*group, "row", "col"], [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")], {"median": (value, 0.5)})


def robust_z(maps: DataFrame, group: Sequence[str], value: str = "value", cut: float = 3.5) -> DataFrame:
    """Maps with robust_z of each value against its cell's median and MAD in the group, and outlier past ``cut``."""
    cell = [*group, "row", "col"]
    center = exact(maps, cell, {"_m": (value, 0.5)})
    away = maps.join(center, cell).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    spread = exact(away, cell, {"_mad": ("_d", 0.5)})
    z = 0.6744897501960817 * (F.col(value) - F.col("_m")) / F.nullif(F.col("_mad"), F.lit(0.0))
    return away.join(spread, cell).withColumn("robust_z", z).withColumn("outlier", F.coalesce(F.abs("robust_z") > cut, F.lit(False))).drop("_m", "_d", "_mad")


def mirror_left(maps: DataFrame, eye: str, width: int) -> DataFrame:
    """Left eyes in right-eye orientation."""
    return maps.withColumn("col", F.when(F.col(eye) == "L", width - 1 - F.col("col")).otherwise(F.col("col")))


def set_maps(maps: DataFrame, match_set: str, cohort: str, value: str = "value") -> DataFrame:
    """Mean map per match set and cohort, of sets that both cohorts are in."""
    whole = maps.groupBy(match_set).agg(F.count_distinct(cohort).alias("n")).filter("n = 2").select(match_set)
    return maps.join(whole, match_set, "left_semi").groupBy(match_set, cohort, "row", "col").agg(F.avg(value).alias(value))


def effect_concordance(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """n cells, correlation and sign agreement of two effect maps."""
    j = a.select("row", "col", F.col(value).alias("x")).join(b.select("row", "col", F.col(value).alias("y")), ["row", "col"])
    return j.agg(F.count("*").alias("n"), F.corr("x", "y").alias("correlation"), F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("sign_agreement"))


def region_metrics(maps: DataFrame, masks: DataFrame, value: str = "value") -> DataFrame:
    """Per image and region (mask-long: image, region, row, col): area fraction, positive and absolute mass fractions, enrichment, signed mean."""
    v = F.col(value)
    whole = maps.groupBy("image").agg(F.count("*").alias("cells"), F.sum(F.greatest(v, F.lit(0.0))).alias("pos"), F.sum(F.abs(v)).alias("mass"))
    inner = maps.join(masks.select("image", "region", "row", "col").distinct(), ["image", "row", "col"]).groupBy("image", "region").agg(F.count("*").alias("n"), F.sum(F.greatest(v, F.lit(0.0))).alias("p"), F.sum(F.abs(v)).alias("m"), F.avg(v).alias("signed_mean"))
    safe = lambda a, b: F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0))
    out = inner.join(whole, "image").withColumns({"area_fraction": safe("n", "cells"), "positive_mass_fraction": safe("p", "pos"), "absolute_mass_fraction": safe("m", "mass")})
    return out.withColumn("enrichment", F.col("absolute_mass_fraction") / F.col("area_fraction")).select("image", "region", "area_fraction", "positive_mass_fraction", "absolute_mass_fraction", "enrichment", "signed_mean")


def pixel_rank_correlation(maps: DataFrame, pixels: DataFrame, covariate: str, value: str = "value") -> DataFrame:
    """Spearman correlation of attribution and a pixel covariate per image."""
    from .windows import average_ranks

    j = maps.select("image", "row", "col", F.col(value).alias("x")).join(pixels.select("image", "row", "col", F.col(covariate).alias("y")), ["image", "row", "col"]).filter("x is not null and y is not null")
    ranked = average_ranks(j, {"x": "rx", "y": "ry"}, ["image"])
    return ranked.groupBy("image").agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("spearman"))


def circular_masks(centers: DataFrame, height: int, width: int, radius: Column, outer: Column | None = None, regions: tuple[str, str] = ("disc", "annulus")) -> DataFrame:
    """(image, region, row, col) of discs around (cy, cx), and of the rings out to ``outer``."""
    grid = centers.select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"))
    d = F.hypot(F.col("row") - F.col("cy"), F.col("col") - F.col("cx"))
    region = F.when(d <= radius, regions[0])
    if outer is not None:
        region = region.when(d <= outer, regions[1])
    return grid.withColumn("region", region).filter("region is not null").select("image", "region", "row", "col")


def localization(maps: DataFrame, masks: DataFrame, value: str = "value") -> DataFrame:
    """Per image: the peak cell and whether it lies in any region (ties: first row, column)."""
    peak = maps.groupBy("image").agg(F.max_by(F.struct("row", "col"), F.struct(F.col(value), -F.col("row"), -F.col("col"))).alias("p")).select("image", F.col("p.row").alias("row"), F.col("p.col").alias("col"))
    inside = masks.select("image", "row", "col").distinct().withColumn("hit", F.lit(True))
    return peak.join(inside, ["image", "row", "col"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def raster_quality(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Per image of (image, row, col, value 0-255): foreground fraction, brightness, contrast, gradient energy, dark and bright fractions."""
    v = F.col(value)
    facts = pixels.groupBy("image").agg(F.greatest(F.percentile(value, F.lit(0.05)) + 5.0, F.lit(8.0)).alias("cut"))
    rows = pixels.join(facts, "image")
    right = v - F.lag(v).over(Window.partitionBy("image", "row").orderBy("col"))
    down = v - F.lag(v).over(Window.partitionBy("image", "col").orderBy("row"))
    rows = rows.withColumns({"gx": right, "gy": down, "fg": v > F.col("cut")})
    fg = F.when(F.col("fg"), v)
    return rows.groupBy("image").agg(F.avg(F.col("fg").cast("double")).alias("retina_fraction"), F.avg(fg).alias("brightness_mean"), F.stddev_pop(fg).alias("contrast_std"), (F.avg(F.col("gx") ** 2) + F.avg(F.col("gy") ** 2)).alias("gradient_energy"), F.avg((v < 10).cast("double")).alias("dark_fraction"), F.avg((v > 245).cast("double")).alias("bright_fraction"))


def aligned_average(maps: DataFrame, frames: DataFrame, group: str, height: int, width: int, value: str = "value") -> DataFrame:
    """Maps moved by each image's affine (a, b, ty, c, d, tx: row' = a row + b col + ty, col' = c row + d col + tx), clipped at the p99 of
    absolute values per group, and averaged per target cell by coverage."""
    moved = maps.join(frames, "image").withColumns({"r": F.round(F.col("a") * F.col("row") + F.col("b") * F.col("col") + F.col("ty")).cast("int"), "c2": F.round(F.col("c") * F.col("row") + F.col("d") * F.col("col") + F.col("tx")).cast("int")})
    kept = moved.filter(F.col("r").between(0, height - 1) & F.col("c2").between(0, width - 1))
    scale = exact(kept, [group], {"_s": (F.abs(value), 0.99)})
    clipped = F.greatest(F.least(F.col(value), F.col("_s")), -F.col("_s"))
    per_image = kept.join(scale, group).groupBy(group, "image", F.col("r").alias("row"), F.col("c2").alias("col")).agg(F.avg(clipped).alias("v"), F.count("*").alias("w"))
    return per_image.groupBy(group, "row", "col").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("value"), F.count("*").alias("n_images"))
