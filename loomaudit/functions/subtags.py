"""Language tags by the registry that the session's JVM ships (ICU, as Spark's collations use it).

`registry` is that registry as a dimension table; the expressions here hold its
codes as literals, some hundred of each kind. Grammar is that of Unicode
locale identifiers: language, script, region, variants, extensions and private
use, without grandfathered forms and extended languages.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes that name no audience.
NO_LANGUAGE, NO_REGION, NO_SCRIPT = ("mul", "zxx", "und", "mis"), ("zz", "xa", "xb"), ("zzzz",)
#: Two-letter codes that stand for another language's.
OLD_LANGUAGES = {"in": "id", "iw": "he", "ji": "yi", "jw": "jv", "mo": "ro", "no": "no", "sh": "sr", "tl": "fil"}
#: Region codes in use for another's.
OLD_REGIONS = {"uk": "gb"}
TAG = r"^(?:[a-z]{2,3}|[a-z]{5,8})(?:-[a-z]{4})?(?:-(?:[a-z]{2}|[0-9]{3}))?(?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(?:-[a-wyz0-9](?:-[a-z0-9]{2,8})+)*(?:-x(?:-[a-z0-9]{1,8})+)?$"
VARIANT = r"^(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3})$"


class Codes(NamedTuple):
    """Lower-case codes; likely gives a language's (script, region)."""

    languages: tuple[str, ...]
    scripts: tuple[str, ...]
    regions: tuple[str, ...]
    likely: dict[str, tuple[str, str]]


@lru_cache(maxsize=1)
def codes() -> Codes:
    """The codes that have an English name, with the older and longer codes that stand for them."""
    icu = SparkSession.active()._jvm.com.ibm.icu
    locale, region = icu.util.ULocale, icu.util.Region
    names = icu.text.LocaleDisplayNames.getInstance(locale("en"))
    languages = {x for x in locale.getISOLanguages() if names.languageDisplayName(x) != x}
    likely = {x: str(locale.addLikelySubtags(locale(x))).split("_") for x in sorted(languages)}
    longer = {locale(x).getISO3Language() for x in languages if len(x) == 2} - {""}
    kinds = region.RegionType
    regions = {str(r).lower() for k in (kinds.TERRITORY, kinds.WORLD, kinds.CONTINENT, kinds.SUBCONTINENT, kinds.GROUPING, kinds.DEPRECATED) for r in region.getAvailable(k)}
    numbers = {f"{region.getInstance(r.upper()).getNumericCode():03d}" for r in regions if r.isalpha()} - {"-01", "000"}
    script = icu.lang.UScript
    scripts = {script.getShortName(i).lower() for i in range(script.CODE_LIMIT) if names.scriptDisplayName(script.getShortName(i)) != script.getShortName(i)}
    return Codes(
        tuple(sorted((languages | longer | set(OLD_LANGUAGES)) - set(NO_LANGUAGE))), tuple(sorted(scripts - set(NO_SCRIPT))), tuple(sorted((regions | numbers | set(OLD_REGIONS)) - set(NO_REGION))),
        {k: (v[1], v[2]) for k, v in likely.items() if len(v) == 3},
    )


def registry(spark: SparkSession) -> DataFrame:
    """(kind, code, script, region): language, script and region codes; the script and region that a language most likely means."""
    known = codes()
    rows = [("language", x, *known.likely.get(x, (None, None))) for x in known.languages] + [("script", x, None, None) for x in known.scripts] + [("region", x, None, None) for x in known.regions]
    return spark.createDataFrame(rows, "kind string, code string, script string, region string")


def is_known_language(language: Column) -> Column:
    """Whether a code, in lower case, names a language."""
    return F.coalesce(language.isin(*codes().languages), F.lit(False))


def is_valid(tag: Column) -> Column:
    """Whether a tag names an audience: x-default, or a well-formed tag whose language, script and region, as far as it has them, are known, and that names no variant or extension twice."""
    low = F.lower(tag)
    parts = F.split(low, "-")
    second = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    has_script = second.rlike("^[a-z]{4}$")
    at = F.coalesce(F.get(parts, F.when(has_script, 2).otherwise(1)), F.lit(""))
    has_region = at.rlike("^(?:[a-z]{2}|[0-9]{3})$")
    head = F.split(F.regexp_replace(low, "-[a-z0-9]-.*$", ""), "-")
    variants = F.filter(F.slice(head, F.lit(2), F.greatest(F.size(head) - 1, F.lit(0))), lambda p: p.rlike(VARIANT))
    singles = F.filter(F.split(F.regexp_replace(low, "-x-.*$", ""), "-"), lambda p: F.length(p) == 1)
    once = (F.size(F.array_distinct(variants)) == F.size(variants)) & (F.size(F.array_distinct(singles)) == F.size(singles))
    known = codes()
    sound = low.rlike(TAG) & is_known_language(F.get(parts, F.lit(0))) & (~has_script | second.isin(*known.scripts)) & (~has_region | at.isin(*known.regions)) & once
    return F.coalesce((low == "x-default") | sound, F.lit(False))


def likely_region(language: Column) -> Column:
    """The region, in upper case, that a bare language most likely means; null where none is known."""
    pairs = [F.lit(x) for k, (_, region) in sorted(codes().likely.items()) for x in (k, region)]
    return F.try_element_at(F.create_map(*pairs), language)
