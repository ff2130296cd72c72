import pytest

from loomaudit.plans import options


def test_catalogue(spark):
    rows = {r["name"]: r for r in options.catalogue(spark).collect()}
    assert len(rows) == 31 and len({r["group"] for r in rows.values()}) == 7
    assert sum(r["short"] is not None for r in rows.values()) == 5 and sum(r["kind"] != "switch" for r in rows.values()) == 16
    assert rows["--regressions-only"]["requires"] == rows["--update-baseline"]["requires"] == "--baseline"
    assert rows["--depth"]["default"] == "2" and rows["--start-timeout"]["default"] == "60000"


@pytest.mark.parametrize(
    ("arguments", "says"),
    [
        (["--baseline", "b.json", "https://a.b"], "--baseline needs --regressions-only or --update-baseline"),
        (["--regressions-only"], "--regressions-only needs --baseline"),
        (["--update-baseline"], "--update-baseline needs --baseline"),
        (["--summary", "--baseline", "b", "--regressions-only"], "--summary has no effect beside --baseline"),
        (["preview", "https://a.b", "--json"], "preview has no effect beside --json"),
        (["preview", "https://a.b", "--max-debt", "3"], "preview has no effect beside --max-debt"),
        (["--depth", "-1"], "--depth is below 0"),
        (["--depth", "two"], "--depth is no whole number"),
        (["--max-pages", "0"], "--max-pages is below 1"),
        (["--coverage", "some"], "--coverage is none of structural, all"),
        (["--fail-on", "info"], "--fail-on is none of error, warning, never"),
        (["--locales", "en, qq"], "--locales names no locale: qq"),
        (["--profile", "nobody"], "--profile is none of"),
        (["--depth"], "--depth requires a value"),
        (["--nothing"], "unknown option: --nothing"),
        (["https://a.b", "rules"], "unexpected argument: rules"),
    ],
)
def test_refused(spark, arguments, says):
    with pytest.raises(ValueError, match=says.replace("-", "[-]")):
        options.of_arguments(spark, arguments)


def test_accepted(spark):
    command, address, made = options.of_arguments(spark, ["--report", "r.json", "preview", "https://a.b", "--depth", "0", "--include", "/a/*", "--include", "/b/*", "--locales", "en,pt-BR", "--no-sitemap", "--no-external", "-q"])
    assert (command, address) == ("preview", "https://a.b")
    assert (made.depth, made.include, made.locales, made.use_sitemap, made.check_external, made.fail_on) == (0, ["/a/*", "/b/*"], ["en", "pt-BR"], False, False, "warning")
    assert options.of_arguments(spark, ["--baseline", "b", "--update-baseline"])[0] is None
    assert options.of_arguments(spark, []) == (None, None, options.Options())


def test_many_runs_at_once(spark):
    given = spark.createDataFrame([(1, "--depth", "3"), (2, "--depth", "x"), (2, "--baseline", "b"), (3, "--what", None)], "run int, option string, value string")
    assert sorted((r["run"], r["option"]) for r in options.faults(given).collect()) == [(2, "--baseline"), (2, "--depth"), (3, "--what")]
