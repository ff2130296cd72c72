"""Route families, and a few pages of each that stand for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomaudit.functions import urls as U
from loomaudit.operators.ranks import placed

PER_FAMILY, THRESHOLD = 3, 8


def patterned(urls: DataFrame, locales: list[str] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """urls (site, url, path, ...) with pattern and locale: segments that vary behind one prefix are blanked; those of `locales` fold into one. The first section never varies."""
    tags = F.array(*(F.lit(x.lower()) for x in locales or []))
    parts = U.segments(F.col("path"))
    folded = F.transform(parts, lambda s: F.when(F.array_contains(tags, F.lower(s)), "{locale}").otherwise(s)) if locales else parts
    own = F.coalesce(F.get(F.filter(parts, lambda s: F.array_contains(tags, F.lower(s))), F.lit(0)), F.lit("")) if locales else F.lit("")
    shaped = urls.withColumns({"parts": folded, "locale": own})
    steps = shaped.select("site", "url", F.posexplode("parts").alias("depth", "segment"), "parts").select("site", "url", "depth", "segment", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("prefix"))
    children = steps.groupBy("site", "depth", "prefix").agg(F.count_distinct("segment").alias("n"))
    varies = children.where((F.col("n") >= threshold) & (F.col("depth") > 0) & ~((F.col("depth") == 1) & (F.col("prefix") == "{locale}"))).select("site", "depth", "prefix", F.lit(True).alias("varies"))
    named = steps.distinct().join(varies, ["site", "depth", "prefix"], "left").select("site", "url", "depth", F.when(F.col("varies"), F.concat(F.lit("{"), F.col("depth").cast("string"), F.lit("}"))).otherwise(F.col("segment")).alias("name"))
    patterns = named.groupBy("site", "url").agg(F.concat(F.lit("/"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "name"))), lambda x: x["name"]), "/")).alias("pattern"))
    return shaped.join(patterns, ["site", "url"], "left").withColumn("pattern", F.coalesce("pattern", F.lit("/"))).drop("parts")


def selected(patterns: DataFrame, per_family: int = PER_FAMILY, threshold: int = THRESHOLD) -> DataFrame:
    """patterns with size and keep: small groups are kept whole, of others the first, the last and evenly spaced ones of the sorted URLs."""
    ranked = placed(patterns, ["site", "locale", "pattern"], ["url"])
    last = F.col("size") - 1
    spots = F.array(*(F.floor(i * last / (per_family - 1) + 0.5) if per_family > 1 else F.lit(0) for i in range(per_family)))
    return ranked.withColumn("keep", (F.col("size") < threshold) | (F.col("size") <= per_family) | F.array_contains(spots, F.col("place"))).drop("place")


def families(chosen: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(site, pattern, size, sampled) of the groups that were sampled, locales together, the largest first."""
    return chosen.where(F.col("size") >= threshold).groupBy("site", "pattern").agg(F.count("*").alias("size"), F.count_if("keep").alias("sampled")).orderBy(F.desc("size"), "site", "pattern")
