"""The producing side: routes of a site, their clusters, and what pages and sitemaps declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomaudit.functions import text as X
from loomaudit.functions import urls as U
from loomaudit.functions.subtags import is_valid, likely_region


def bcp47(locale: Column) -> Column:
    """A served locale as a tag: language, and region in upper case; null if it names no audience or has a script."""
    parts = F.split(F.replace(F.lower(F.trim(locale)), F.lit("_"), F.lit("-")), "-")
    region = F.get(parts, F.lit(1))
    sound = is_valid(F.array_join(parts, "-")) & (F.size(parts) <= 2) & (region.isNull() | region.rlike(r"^([a-z]{2}|\d{3})$"))
    return F.when(sound, F.concat_ws("-", F.get(parts, F.lit(0)), F.upper(region)))


def open_graph_locale(tag: Column) -> Column:
    """language_REGION; the likely region where the tag has none."""
    language, region = F.split_part(tag, F.lit("-"), F.lit(1)), F.nullif(F.split_part(tag, F.lit("-"), F.lit(2)), F.lit(""))
    return F.concat_ws("_", language, F.coalesce(region, likely_region(language)))


def registry(entries: DataFrame, default_locale: str) -> DataFrame:
    """(family, key, locale, path, listed, last_modified, is_anchor) from entries (family, key, locale, path, listed, last_modified).

    A key's anchor is its page in the default locale, else in the first locale by name."""
    rank = F.struct((F.col("locale") != default_locale).alias("other"), F.col("locale").alias("locale"))
    anchors = entries.groupBy("family", "key").agg(F.min_by("locale", rank).alias("anchor"))
    return entries.join(anchors, ["family", "key"]).withColumn("is_anchor", F.col("locale") == F.col("anchor")).drop("anchor")


def clashes(entries: DataFrame) -> DataFrame:
    """(problem, value, n): one key and locale with several paths, or one path of several routes."""
    keys = entries.groupBy("family", "key", "locale").agg(F.count_distinct("path").alias("n")).where("n > 1").select(F.lit("several-paths").alias("problem"), F.concat_ws("|", "family", "key", "locale").alias("value"), "n")
    paths = entries.groupBy("path").agg(F.count_distinct(F.concat_ws("|", "family", "key", "locale")).alias("n")).where("n > 1").select(F.lit("shared-path").alias("problem"), F.col("path").alias("value"), "n")
    return keys.unionByName(paths)


def clusters(routes: DataFrame, base: str) -> DataFrame:
    """(family, key, tag, url): the pages of each key, and x-default for its anchor."""
    url = F.concat(F.lit(base.rstrip("/")), F.col("path"))
    own = routes.select("family", "key", bcp47(F.col("locale")).alias("tag"), url.alias("url"))
    default = routes.where("is_anchor").select("family", "key", F.lit("x-default").alias("tag"), url.alias("url"))
    return own.unionByName(default)


def sitemap(routes: DataFrame, base: str) -> DataFrame:
    """(loc, lastmod, hreflang, href): a row for each listed page and each member of its cluster."""
    loc = F.concat(F.lit(base.rstrip("/")), F.col("path"))
    listed = routes.where("listed").select("family", "key", loc.alias("loc"), F.col("last_modified").alias("lastmod"))
    return listed.join(clusters(routes, base), ["family", "key"]).select("loc", "lastmod", F.col("tag").alias("hreflang"), F.col("url").alias("href"))


def metadata(routes: DataFrame, base: str, site_name: str) -> DataFrame:
    """What each page declares: (path, canonical, og_locale, og_site_name, x_default)."""
    url = F.concat(F.lit(base.rstrip("/")), F.col("path"))
    default = clusters(routes, base).where("tag = 'x-default'").select("family", "key", F.col("url").alias("x_default"))
    return routes.join(default, ["family", "key"], "left").select("path", url.alias("canonical"), open_graph_locale(bcp47(F.col("locale"))).alias("og_locale"), F.lit(site_name).alias("og_site_name"), "x_default")


def page_metadata(routes: DataFrame, content: DataFrame, base: str, site_name: str) -> DataFrame:
    """All that a page declares, from content (path, title, description, image, image_alt): (path, title, description, canonical, languages: map of tags to URLs, og_type, og_url, og_title, og_description, og_locale, og_alternates, og_image, og_image_alt, twitter_card, twitter_title, twitter_description, twitter_image).

    A page without an image has the small card; a relative image is the base's."""
    cluster = clusters(routes, base).groupBy("family", "key").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("tag", "url")))).alias("languages"))
    own = metadata(routes, base, site_name).select("path", "canonical", "og_locale", "og_site_name")
    keyed = routes.select("family", "key", "path").join(cluster, ["family", "key"]).select("path", "languages")
    image = F.when(X.blank(F.col("image")), None).when(F.col("image").rlike("(?i)^https?://"), F.col("image")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace("image", "^/+", "")))
    others = F.array_except(F.transform(F.filter(F.map_keys("languages"), lambda t: t != "x-default"), open_graph_locale), F.array("og_locale"))
    alone = F.size(F.map_keys("languages")) <= 2
    return own.join(keyed, "path").join(content, "path", "left").select(
        "path", "title", "description", "canonical", F.when(~alone, F.col("languages")).alias("languages"), F.lit("website").alias("og_type"), F.col("canonical").alias("og_url"), "og_site_name", F.col("title").alias("og_title"), F.col("description").alias("og_description"),
        "og_locale", others.alias("og_alternates"), image.alias("og_image"), F.when(image.isNotNull(), F.coalesce("image_alt", "title")).alias("og_image_alt"), F.when(image.isNull(), "summary").otherwise("summary_large_image").alias("twitter_card"), F.col("title").alias("twitter_title"),
        F.col("description").alias("twitter_description"), image.alias("twitter_image"),
    )


def robots_body(base: str, indexable: bool) -> str:
    """The text of robots.txt."""
    return f"User-agent: *\nAllow: /\nSitemap: {base.rstrip('/')}/sitemap.xml\n" if indexable else "User-agent: *\nDisallow: /\n"


def site_definition(spark: SparkSession, base: str, served: list[str], default_locale: str) -> DataFrame:
    """(base, locale, tag, og_locale, is_default) for each locale of a site. Raises ValueError where the base is no origin, no locale is served, one is named twice or no tag, or the default is not among them."""
    parts = U.parse_url(base, None)
    if parts is None or parts[0] not in ("http", "https"):
        raise ValueError(f"the base must be an absolute http or https URL, not {base!r}")
    if parts[4] not in ("", "/") or parts[5] or parts[6]:
        raise ValueError(f"the base must be an origin with no path, not {base!r}")
    if not served:
        raise ValueError("a site serves at least one locale")
    if twice := sorted({x for x in served if served.count(x) > 1}):
        raise ValueError("locales named twice: " + ", ".join(twice))
    if default_locale not in served:
        raise ValueError(f"the default locale {default_locale!r} is not served")
    tags = spark.createDataFrame([(x,) for x in served], "locale string").withColumn("tag", bcp47(F.col("locale")))
    if odd := [r["locale"] for r in tags.where("tag is null").collect()]:  # no more than the locales given
        raise ValueError("locales that name no audience: " + ", ".join(odd))
    return tags.select(F.lit(parts[3]).alias("base"), "locale", "tag", open_graph_locale(F.col("tag")).alias("og_locale"), (F.col("locale") == default_locale).alias("is_default"))


def collection(entries: DataFrame, family: str, path: Column, locale: Column | str, key: Column | None = None, listed: Column | bool = True, last_modified: Column | None = None) -> DataFrame:
    """Rows of a registry (family, key, locale, path, listed, last_modified) from entries of any shape; the key of a row without one is its path."""
    of_locale = F.lit(locale) if isinstance(locale, str) else locale
    shown = F.lit(listed) if isinstance(listed, bool) else listed
    changed = F.lit(None).cast("string") if last_modified is None else last_modified.cast("string")
    return entries.select(F.lit(family).alias("family"), F.coalesce(path if key is None else key, path).alias("key"), of_locale.alias("locale"), path.alias("path"), F.coalesce(shown, F.lit(True)).alias("listed"), changed.alias("last_modified"))


def checked_registry(entries: DataFrame, default_locale: str) -> DataFrame:
    """`registry`, of entries without clashes: raises ValueError with the first one."""
    first = clashes(entries).orderBy("problem", "value").first()
    if first is not None:
        raise ValueError(f"{first['problem']}: {first['value']} ({first['n']} times)")
    return registry(entries, default_locale)


def locate(routes: DataFrame, base: str, asked: DataFrame) -> DataFrame:
    """asked (path, locale) with the url of that route in that locale, and the tags of its cluster: problem says why there is none. A route of one locale needs none; path may be any path of the route."""
    known = routes.select("family", "key", "path").distinct()
    pages = routes.select("family", "key", F.col("locale").alias("served"), F.col("path").alias("own"))
    counts = routes.groupBy("family", "key").agg(F.count("*").alias("n"), F.min("locale").alias("only"))
    tags = clusters(routes, base).groupBy("family", "key").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("languages"))
    found = asked.join(known, "path", "left").join(counts, ["family", "key"], "left").withColumn("served", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("locale")))
    placed = found.join(pages, ["family", "key", "served"], "left").join(tags, ["family", "key"], "left")
    problem = F.when(F.col("n").isNull(), "no such route").when((F.col("n") > 1) & F.col("locale").isNull(), "needs a locale").when(F.col("own").isNull(), "not served in this locale")
    return placed.select("path", "locale", F.concat(F.lit(base.rstrip("/")), F.col("own")).alias("url"), F.when(F.col("own").isNotNull(), F.col("languages")).alias("languages"), problem.alias("problem"))


def root_metadata(spark: SparkSession, base: str, name: str, description: str, indexable: bool = True, title_template: str | None = None) -> DataFrame:
    """What every page of a site inherits, as one row."""
    row = [(base.rstrip("/"), name, title_template or f"%s · {name}", description, indexable)]
    return spark.createDataFrame(row, "metadata_base string, title_default string, title_template string, description string, indexable boolean")
