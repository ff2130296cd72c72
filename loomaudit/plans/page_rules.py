"""Page rules, declared as data and judged in one projection.

A rule has an id, a kind, a severity (of a scored rule, one for each band), a
rigor, and two expressions over what a page declares: its status (pass, fail,
warn or na) and what was observed, as JSON. Rules of one's own are added to the
list that `evaluate` gets, as expressions or, with `own_rule`, as functions of a
page. A rule that fails has the status crashed, and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomaudit.functions import text as X
from loomaudit.functions import urls as U

PASS, FAIL, WARN, NA, CRASHED = "pass", "fail", "warn", "na", "crashed"
# The accepted ranges.
TITLE_IDEAL, TITLE_ACCEPTABLE = (10, 60), (5, 70)
DESCRIPTION_IDEAL, DESCRIPTION_ACCEPTABLE = (50, 160), (25, 200)
RATIO_IDEAL, RATIO_ACCEPTABLE = (1.7, 2.1), (1, 3)
APPLE_RELS = ("apple-touch-icon",)
FINDINGS = "rule_id string, kind string, status string, band string, severity string, rigor string, observed string"


@dataclass(frozen=True)
class Rule:
    """severity is that of a failure; of a scored rule severities has one for acceptable and one for poor."""

    id: str
    rigor: str
    category: str
    status: Column
    observed: Column
    severity: str | None = None
    severities: dict[str, str] = field(default_factory=dict)
    band: Column | None = None
    sources: tuple[str, ...] = ()
    title: str = ""

    @property
    def kind(self) -> str:
        return "scored" if self.severities else "boolean"


def _c(name: str) -> Column:
    return F.col(name)


def _verdict(failed: Column, applies: Column | None = None) -> Column:
    out = F.when(F.coalesce(failed, F.lit(False)), FAIL).otherwise(PASS)
    return out if applies is None else F.when(F.coalesce(applies, F.lit(False)), out).otherwise(NA)


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _any(items: Column, test) -> Column:
    return F.coalesce(F.exists(items, test), F.lit(False))


def has_open_graph() -> Column:
    return (_text(_c("og_title")) != "") | (F.size("og_images") > 0) | (_text(_c("og_url")) != "")


def hreflang_locales() -> Column:
    """The distinct locales of a page's alternates, as language or language-region."""
    parts = F.transform(F.filter("alternates", lambda a: ~a["is_default"]), lambda a: X.locale_parts(a["hreflang"]))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p.isNotNull()), lambda p: F.concat_ws("-", p["language"], p["region"])))


def _absolute(value: Column) -> Column:
    """Whether a text is an http(s) URL on its own."""
    return F.coalesce(X.trimmed(value).rlike(r"(?i)^https?:[/\\]*[^/\\?#\s]"), F.lit(False))


def _probe(key: Column) -> Column:
    return F.try_element_at(_c("assets"), key)


def page_rules() -> list[Rule]:
    """The built-in rules, in their order."""
    title, description = X.trimmed(_text(_c("title"))), X.trimmed(_text(_c("description")))
    images, icons = _c("og_images"), _c("icons")
    no_images = F.size(images) == 0

    def scored(value: Column, ideal, acceptable, applies: Column) -> tuple[Column, Column]:
        band = F.when(applies, X.band(value, ideal, acceptable))
        return F.when(~applies, NA).when(band == "ideal", PASS).otherwise(WARN), band

    title_status, title_band = scored(X.utf16_length(title), TITLE_IDEAL, TITLE_ACCEPTABLE, title != "")
    desc_status, desc_band = scored(X.utf16_length(description), DESCRIPTION_IDEAL, DESCRIPTION_ACCEPTABLE, description != "")
    measured = F.get(F.filter(images, lambda i: (i["width"] > 0) & (i["height"] > 0)), F.lit(0))
    ratio = F.floor(measured["width"] / measured["height"] * 100 + 0.5) / 100
    ratio_status, ratio_band = scored(ratio, RATIO_IDEAL, RATIO_ACCEPTABLE, measured.isNotNull())

    cluster = hreflang_locales()
    own = X.trimmed(_text(_c("og_locale")))
    others = F.filter(F.transform("og_alternates", X.trimmed), lambda t: t != "")
    missing = F.filter(cluster, lambda t: ~X.same_locale(t, own) & ~F.exists(others, lambda d: X.same_locale(d, t)))
    unbacked = F.filter(others, lambda d: ~F.exists(cluster, lambda t: X.same_locale(t, d)))

    alts = F.filter(images, lambda i: ~X.blank(i["alt"]))
    card_title = X.trimmed(F.coalesce("og_title", "title", F.lit("")))

    manifest = _c("manifest_icons")

    def path_of(ref: Column) -> Column:
        return F.regexp_extract(ref, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)

    def disagrees(icon: Column) -> Column:
        twin = F.get(F.filter(icons, lambda h: path_of(h["href"]) == path_of(icon["src"])), F.lit(0))
        sizes = (_text(icon["sizes"]) != "") & (_text(twin["sizes"]) != "") & (X.sizes_sorted(icon["sizes"]) != X.sizes_sorted(twin["sizes"]))
        kinds = (_text(icon["type"]) != "") & (_text(twin["type"]) != "") & (F.lower(icon["type"]) != F.lower(twin["type"]))
        return twin.isNotNull() & (F.coalesce(sizes, F.lit(False)) | F.coalesce(kinds, F.lit(False)))

    probed_images = F.filter(F.transform(images, lambda i: _probe(X.trimmed(i["url"]))), lambda p: p.isNotNull())
    probed_icons = F.filter(F.transform(icons, lambda i: _probe(i["href"])), lambda p: p.isNotNull())

    def sized(p: Column) -> Column:
        return F.coalesce(p["ok"] & (F.size(p["sizes"]) > 0), F.lit(False))

    comparable_images = F.filter(images, lambda i: sized(_probe(X.trimmed(i["url"]))) & i["width"].isNotNull() & i["height"].isNotNull())
    comparable_icons = F.filter(icons, lambda i: sized(_probe(i["href"])) & (F.size(F.filter(i["parsed"], lambda s: s != "any")) > 0))

    def real(p: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(p["sizes"], lambda s: F.concat(s["width"].cast("string"), F.lit("x"), s["height"].cast("string")))))

    says = [X.comma_tokens(_c(n)) for n in ("robots", "googlebot", "x_robots")]
    speaking = sum((F.size(s) > 0).cast("int") for s in says)

    def conflict(no: str, yes: str) -> Column:
        negative, positive = F.lit(False), F.lit(False)
        for s in says:
            negative = negative | F.array_contains(s, no)
            positive = positive | (F.array_contains(s, yes) & ~F.array_contains(s, no))
        return negative & positive

    def js(value: Column) -> Column:
        return F.to_json(F.struct(value.alias("value")))

    def images_of(*names: str) -> Column:
        return F.to_json(F.transform(images, lambda i: F.struct(*(i[n].alias(n) for n in names))), {"ignoreNullFields": "false"})

    return [
        Rule("title.missing", "spec-required", "document", _verdict(title == ""), js(title), "error", sources=("whatwg-html-title",), title="A page has a title"),
        Rule("title.length", "heuristic", "document", title_status, js(F.when(title == "", 0).otherwise(X.utf16_length(title))), severities={"acceptable": "warning", "poor": "warning"}, band=title_band, sources=("google-title-link", "moz-title-tag"), title="A title fits a result list"),
        Rule("description.missing", "spec-recommended", "meta", _verdict(description == ""), js(description), "warning", sources=("whatwg-html-standard-metadata-names", "google-snippet"), title="A page has a description"),
        Rule("description.length", "heuristic", "meta", desc_status, js(F.when(description == "", 0).otherwise(X.utf16_length(description))), severities={"acceptable": "warning", "poor": "warning"}, band=desc_band, sources=("google-snippet", "moz-meta-description"), title="A description fits a snippet"),
        Rule("canonical.missing", "vendor-spec", "canonical", _verdict(_text(_c("canonical")) == ""), js(_text(_c("canonical"))), "warning", sources=("ietf-rfc6596", "google-canonicalization"), title="A page names its canonical URL"),
        Rule("canonical.absolute", "vendor-spec", "canonical", _verdict(~_text(_c("canonical_raw")).rlike("(?i)^https?://"), _text(_c("canonical_raw")) != ""), js(_text(_c("canonical_raw"))), "error", sources=("ietf-rfc6596", "google-canonicalization", "whatwg-url"), title="A canonical URL is absolute"),
        Rule("viewport.missing", "guideline", "meta", _verdict(X.blank(_c("viewport"))), js(_text(_c("viewport"))), "warning", sources=("mdn-viewport", "whatwg-html-standard-metadata-names"), title="A page sets its viewport"),
        Rule("og.title.missing", "vendor-spec", "opengraph", _verdict(X.blank(_c("og_title"))), js(_text(_c("og_title"))), "warning", sources=("ogp",), title="A shared page has a title"),
        Rule("og.description.missing", "vendor-spec", "opengraph", _verdict(X.blank(_c("og_description")), has_open_graph()), js(_text(_c("og_description"))), "info", sources=("ogp", "meta-og-sharing"), title="A shared page has a description"),
        Rule("og.image.missing", "vendor-spec", "opengraph", _verdict(no_images), images_of("url"), "warning", sources=("ogp", "meta-og-sharing"), title="A shared page has an image"),
        Rule("og.image.absolute", "vendor-spec", "opengraph", _verdict(_any(images, lambda i: ~_absolute(i["url"]) | (i["secure_url"].isNotNull() & ~_absolute(i["secure_url"]))), ~no_images), images_of("url", "secure_url"), "warning", sources=("ogp", "meta-og-sharing"), title="Image URLs are absolute"),
        Rule("og.image.alt", "guideline", "opengraph", _verdict(_any(images, lambda i: X.blank(i["alt"])), ~no_images), images_of("url", "alt"), "warning", sources=("ogp",), title="Images are described"),
        Rule("og.image.alt.caption", "guideline", "opengraph", _verdict(_any(alts, lambda i: X.trimmed(i["alt"]) == card_title), (F.size(alts) > 0) & (card_title != "")), images_of("url", "alt"), "info", sources=("ogp",), title="A description is not the title again"),
        Rule("og.image.dimensions", "vendor-spec", "opengraph", _verdict(_any(images, lambda i: i["width"].isNull() | i["height"].isNull()), ~no_images), images_of("url", "width", "height"), "warning", sources=("ogp", "meta-og-sharing"), title="Images state their size"),
        Rule("og.image.ratio", "vendor-spec", "opengraph", ratio_status, js(F.coalesce(ratio, F.lit(0.0))), severities={"acceptable": "info", "poor": "warning"}, band=ratio_band, sources=("meta-og-sharing", "x-cards"), title="Images have the shape of a card"),
        Rule("og.locale.missing", "vendor-spec", "opengraph", _verdict(own == "", (F.size(cluster) >= 2) & has_open_graph()), js(own), "warning", sources=("ogp",), title="A translated page states its locale"),
        Rule("og.locale.alternates", "vendor-spec", "opengraph", _verdict((F.size(missing) > 0) | (F.size(unbacked) > 0), (F.size(cluster) >= 2) & (own != "")), F.to_json(F.struct(own.alias("locale"), others.alias("alternates"), cluster.alias("hreflang"))), "warning", sources=("ogp", "google-hreflang"), title="Both lists of translations agree"),
        Rule("icons.missing", "guideline", "icons", _verdict((F.size(icons) == 0) & (F.coalesce(F.size(manifest), F.lit(0)) <= 0)), F.to_json(F.struct(F.transform(icons, lambda i: i["href"]).alias("head"), F.transform(manifest, lambda i: i["src"]).alias("manifest"))), "warning", sources=("whatwg-html-link-types", "mdn-link-rel"), title="A page has an icon"),
        Rule("icons.apple-touch.missing", "vendor-spec", "icons", _verdict(~_any(icons, lambda i: i["rel"].isin(*APPLE_RELS)), F.size(icons) > 0), F.to_json(F.transform(icons, lambda i: i["rel"])), "info", sources=("apple-web-apps", "whatwg-html-link-types"), title="A page has a home-screen icon"),
        Rule("icons.manifest-mismatch", "guideline", "icons", _verdict((F.size(icons) == 0) | _any(manifest, disagrees), F.coalesce(_c("manifest_parsed"), F.lit(False)) & (F.size(manifest) > 0)), F.to_json(F.struct(F.transform(icons, lambda i: i["href"]).alias("head"), F.transform(manifest, lambda i: i["src"]).alias("manifest"))), "info", sources=("w3c-appmanifest", "whatwg-html-link-types"), title="Manifest and head agree on icons"),
        Rule("og.image.reachable", "vendor-spec", "opengraph", _verdict(_any(probed_images, lambda p: ~p["ok"]), F.size(probed_images) > 0), F.to_json(probed_images), "error", sources=("ogp", "meta-og-sharing"), title="Shared images answer"),
        Rule("og.image.sizes-mismatch", "guideline", "opengraph", _verdict(_any(comparable_images, lambda i: (i["width"] != _probe(X.trimmed(i["url"]))["sizes"][0]["width"]) | (i["height"] != _probe(X.trimmed(i["url"]))["sizes"][0]["height"])), F.size(comparable_images) > 0), F.to_json(comparable_images), "warning", sources=("ogp", "meta-og-sharing"), title="Stated sizes are real"),
        Rule("icons.unreachable", "vendor-spec", "icons", _verdict(_any(probed_icons, lambda p: ~p["ok"]), F.size(probed_icons) > 0), F.to_json(probed_icons), "warning", sources=("whatwg-html-link-types", "mdn-link-rel"), title="Icons answer"),
        Rule("icons.sizes-mismatch", "guideline", "icons", _verdict(_any(comparable_icons, lambda i: F.array_sort(F.array_distinct(F.filter(i["parsed"], lambda s: s != "any"))) != real(_probe(i["href"]))), F.size(comparable_icons) > 0), F.to_json(comparable_icons), "info", sources=("whatwg-html-link-types", "mdn-link-rel"), title="Icon sizes are real"),
        Rule("robots.conflict", "vendor-spec", "robots", _verdict(conflict("noindex", "index") | conflict("nofollow", "follow"), speaking >= 2), F.to_json(F.struct(*(F.array_sort(s).alias(n) for s, n in zip(says, ("robots", "googlebot", "x_robots"), strict=True)))), "error", sources=("google-robots-meta",), title="Robots directives agree"),
    ]


#: What each profile changes, by rigor and by rule; null switches a rule off.
PROFILES: dict[str, dict[str, dict[str, str | None]]] = {
    "default": {"rigor": {}, "rule": {}},
    "strict": {"rigor": {"spec-required": "error", "spec-recommended": "error", "vendor-spec": "error", "guideline": "warning", "heuristic": "warning"}, "rule": {}},
    "spec-only": {"rigor": {"heuristic": None}, "rule": {}},
    "marketing": {"rigor": {}, "rule": {"description.missing": "error", "description.length": "warning", "og.title.missing": "error", "og.image.missing": "error", "og.description.missing": "warning"}},
}


def profile_named(name: str) -> dict[str, dict[str, str | None]]:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}: one of {', '.join(PROFILES)}")
    return PROFILES[name]


def under_profile(rules: list[Rule], name: str) -> list[Rule]:
    """The rules with a profile's severities; what it says of a rule outweighs what it says of the rule's rigor."""
    profile, out = profile_named(name), []
    for rule in rules:
        change = profile["rule"].get(rule.id, profile["rigor"].get(rule.rigor, ""))
        if change is None:
            continue
        kept = {k: getattr(rule, k) for k in rule.__dataclass_fields__}
        if change and rule.severities:
            kept["severities"] = dict.fromkeys(rule.severities, change)
        elif change:
            kept["severity"] = change
        out.append(Rule(**kept))
    return out


def own_rule(id: str, severity: str, reads: tuple[str, ...], judge: Callable[[dict], tuple[str, object] | str], rigor: str = "heuristic", category: str = "own", title: str = "") -> Rule:
    """A rule that a function judges: it gets the columns named as a dictionary and returns a status, or a status and what it observed. What it raises is kept as the page's crash of this rule."""

    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for values in zip(*(c.to_pylist() for c in columns), strict=True):
            try:
                said = judge(dict(zip(reads, values, strict=True)))
                status, observed = said if isinstance(said, tuple) else (said, None)
                if status not in (PASS, FAIL, WARN, NA):
                    raise ValueError(f"no status: {status!r}")
            except Exception as error:  # noqa: BLE001 - whatever a rule of one's own raises
                status, observed = CRASHED, str(error)
            out.append({"status": status, "observed": None if observed is None else str(observed)})
        return pa.array(out, pa.struct([("status", pa.string()), ("observed", pa.string())]))

    said = F.arrow_udf(run, "struct<status: string, observed: string>")(*reads)
    return Rule(id, rigor, category, said["status"], said["observed"], severity, title=title)


def _sound(pages: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules; one that cannot be read against these pages (a column that is not there) is crashed on all of them. Read together, and one by one only where that fails."""

    def fault(some: list[Rule]) -> str | None:
        try:
            pages.select(*(x for r in some for x in (r.status, r.observed, F.lit(None) if r.band is None else r.band))).schema  # noqa: B018
        except AnalysisException as error:
            return str(error).split("\n")[0]
        return None

    if fault(rules) is None:
        return rules
    return [r if (said := fault([r])) is None else replace(r, status=F.lit(CRASHED), observed=F.lit(said), band=None) for r in rules]


def evaluate(pages: DataFrame, rules: list[Rule] | None = None, facts: bool = True) -> DataFrame:
    """(site, page_url, visit_ord, ord: a rule's place, FINDINGS) for each page and rule. Without facts, what was observed is null: for those who read the verdicts alone."""
    rules = page_rules() if rules is None else _sound(pages, rules)
    none = F.lit(None).cast("string")

    def finding(i: int, rule: Rule) -> Column:
        band = none if rule.band is None else rule.band
        severity = F.when(rule.status == FAIL, rule.severity).when(rule.status == CRASHED, "info")
        for name, value in rule.severities.items():
            severity = severity.when((rule.status == WARN) & (band == name), value)
        return F.struct(F.lit(i).alias("ord"), F.lit(rule.id).alias("rule_id"), F.lit(rule.kind).alias("kind"), rule.status.alias("status"), band.alias("band"), severity.alias("severity"), F.lit(rule.rigor).alias("rigor"), (rule.observed if facts else none).alias("observed"))

    return pages.select("site", "page_url", "visit_ord", F.explode(F.array(*(finding(i, r) for i, r in enumerate(rules)))).alias("f")).select("site", "page_url", "visit_ord", "f.*")


def rule_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The rules as a dimension."""
    rows = [(i, r.id, r.kind, r.severity or r.severities["poor"], r.rigor, r.category, ",".join(r.sources), r.title) for i, r in enumerate(page_rules() if rules is None else rules)]
    return spark.createDataFrame(rows, "ord int, rule_id string, kind string, severity string, rigor string, category string, sources string, title string")


@dataclass(frozen=True)
class Advisory:
    """A question for a reader: where it applies, and the facts to judge by."""

    id: str
    applies: Column
    evidence: tuple[str, ...]


def advisories_of() -> list[Advisory]:
    return [
        Advisory("title.descriptive", ~X.blank(_c("title")), ("title", "description", "og_title", "page_url")),
        Advisory("description.accurate", ~X.blank(_c("description")), ("description", "title", "page_url")),
        Advisory("lang.matches-content", ~X.blank(_c("html_lang")), ("html_lang", "title", "description", "og_locale")),
        Advisory("og.image.representative", F.size("og_images") > 0, ("og_images", "og_title", "title", "page_url")),
    ]


def advisories(pages: DataFrame) -> DataFrame:
    """(id, rule_id, page_url, status, evidence as JSON with nulls) where an advisory applies."""
    url = U.parsed(F.col("page_url"))
    keyed = pages.withColumn("route_key", U.route_key(url, F.col("page_url")))
    rows = [F.when(a.applies, F.struct(F.lit(a.id).alias("rule_id"), F.to_json(F.struct(*a.evidence), {"ignoreNullFields": "false"}).alias("evidence"))) for a in advisories_of()]
    each = keyed.select("page_url", "route_key", F.explode(F.array_compact(F.array(*rows))).alias("a"))
    return each.select(X.identity("advisory", F.col("a.rule_id"), F.col("route_key")).alias("id"), F.col("a.rule_id").alias("rule_id"), "page_url", F.lit("needs-judgment").alias("status"), F.col("a.evidence").alias("evidence"))
