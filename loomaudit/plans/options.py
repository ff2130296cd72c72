"""The options of a run: one table of what there is, and another of what does not go together.

Options are named as on a command line. `catalogue` and `constraints` are
dimensions; `faults` holds given options, of one run or of many, against both.
`of_arguments` makes of a list of arguments what `audit.Options` takes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomaudit.functions import text as X
from loomaudit.functions.subtags import is_valid
from loomaudit.plans import page_rules
from loomaudit.plans.audit import Options

NUMBER, LIST, TEXT, SWITCH = "number", "list", "text", "switch"


@dataclass(frozen=True)
class Option:
    """`field` is the part of `audit.Options` that it sets, `least` the smallest number, `choices` all values; what has neither field nor view is not built."""

    name: str
    group: str
    kind: str = SWITCH
    short: str | None = None
    default: str | None = None
    field: str | None = None
    least: int | None = None
    choices: tuple[str, ...] = ()


#: The names, groups, short forms and defaults that users know.
OPTIONS = (
    Option("--json", "output"),
    Option("--summary", "output", short="-s"),
    Option("--report", "output", TEXT),
    Option("--conformance", "output"),
    Option("--advisories", "output"),
    Option("--depth", "crawl", NUMBER, default="2", field="depth", least=0),
    Option("--max-pages", "crawl", NUMBER, default="200", field="max_pages", least=1),
    Option("--coverage", "crawl", TEXT, default="structural when a sitemap is found, all otherwise", field="coverage", choices=("structural", "all")),
    Option("--include", "crawl", LIST, field="include"),
    Option("--exclude", "crawl", LIST, field="exclude"),
    Option("--no-sitemap", "crawl", field="use_sitemap"),
    Option("--locales", "i18n", LIST, field="locales"),
    Option("--ignore-holes", "i18n", LIST, field="ignore_holes"),
    Option("--profile", "gate", TEXT, default="default", field="profile", choices=tuple(page_rules.PROFILES)),
    Option("--fail-on", "gate", TEXT, default="warning", field="fail_on", choices=("error", "warning", "never")),
    Option("--regressions-only", "gate"),
    Option("--baseline", "gate", TEXT),
    Option("--update-baseline", "gate"),
    Option("--max-debt", "gate", NUMBER, field="max_debt", least=0),
    Option("--start", "boot", TEXT),
    Option("--start-cwd", "boot", TEXT, default="the current directory"),
    Option("--start-timeout", "boot", NUMBER, default="60000", least=1),
    Option("--no-external", "fetch", field="check_external"),
    Option("--static", "fetch"),
    Option("--allow-insecure-tls", "fetch"),
    Option("--timeout", "fetch", NUMBER, default="8000 for link probes, 15000 for page fetches", least=1),
    Option("--verbose", "terminal", short="-V"),
    Option("--quiet", "terminal", short="-q"),
    Option("--no-color", "terminal", default="colour when stdout is a TTY and NO_COLOR is unset"),
    Option("--help", "terminal", short="-h"),
    Option("--version", "terminal", short="-v"),
)
COMMANDS = ("rules", "flags", "preview")
#: (option, needs, one of): an option that means nothing without one of others; a command counts as an option.
NEEDS = (("--update-baseline", ("--baseline",)), ("--regressions-only", ("--baseline",)), ("--baseline", ("--regressions-only", "--update-baseline")))
#: (option, and): two that would leave one without effect.
EXCLUDES = (("--summary", "--baseline"), *(("preview", x) for x in ("--json", "--summary", "--baseline", "--update-baseline", "--regressions-only", "--max-debt")))


def catalogue(spark: SparkSession) -> DataFrame:
    """(name, short, group, kind, default, requires, built) of all options."""
    requires = {a: b[0] for a, b in NEEDS if len(b) == 1}
    rows = [(o.name, o.short, o.group, o.kind, o.default, requires.get(o.name), o.field is not None) for o in OPTIONS]
    return spark.createDataFrame(rows, "name string, short string, group string, kind string, default string, requires string, built boolean").orderBy("name")


def constraints(spark: SparkSession) -> DataFrame:
    """(option, others: array, problem): needs (one of others must be there) and excludes (none may)."""
    rows = [(a, list(b), "needs") for a, b in NEEDS] + [(a, [b], "excludes") for a, b in EXCLUDES]
    return spark.createDataFrame(rows, "option string, others array<string>, problem string")


def _value_fault() -> Column:
    """What is wrong with a value: no number, too small, none of the choices, not there, not a locale; null where nothing is."""
    number = F.when(F.col("value").rlike(r"^[+-]?\d{1,15}$"), F.col("value").cast("bigint"))
    odd = F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: (x != "") & ~is_valid(x))
    return (
        F.when(F.col("kind").isNull(), "unknown option")
        .when((F.col("kind") != SWITCH) & X.blank(F.col("value")), "needs a value")
        .when((F.col("kind") == NUMBER) & number.isNull(), "is no whole number")
        .when((F.col("kind") == NUMBER) & (number < F.col("least")), F.concat(F.lit("is below "), F.col("least").cast("string")))
        .when((F.size("choices") > 0) & ~F.array_contains("choices", F.col("value")), F.concat(F.lit("is none of "), F.array_join("choices", ", ")))
        .when((F.col("option") == "--locales") & (F.size(odd) > 0), F.concat(F.lit("names no locale: "), F.array_join(odd, ", ")))
    )


def faults(given: DataFrame) -> DataFrame:
    """(run, option, fault) of given options (run, option, value); a command is given as an option of its name."""
    spark = given.sparkSession
    known = spark.createDataFrame([(o.name, o.kind, o.least, list(o.choices)) for o in OPTIONS] + [(c, SWITCH, None, []) for c in COMMANDS], "option string, kind string, least int, choices array<string>")
    alone = given.join(F.broadcast(known), "option", "left").select("run", "option", _value_fault().alias("fault")).where("fault is not null")
    runs = given.groupBy("run").agg(F.collect_set("option").alias("options"))
    met = runs.select("run", "options", F.explode("options").alias("option")).join(F.broadcast(constraints(spark)), "option")
    shared = F.array_intersect("options", "others")
    broken = met.where(F.when(F.col("problem") == "needs", F.size(shared) == 0).otherwise(F.size(shared) > 0))
    return alone.unionByName(broken.select("run", "option", F.concat(F.when(F.col("problem") == "needs", "needs ").otherwise("has no effect beside "), F.array_join("others", " or ")).alias("fault")))


def read_arguments(arguments: list[str]) -> tuple[str | None, str | None, list[tuple[str, str | None]]]:
    """(command, address, [(option, value)]) of a command line. Raises ValueError for what is no argument."""
    by_name = {n: o for o in OPTIONS for n in (o.name, o.short) if n}
    command, address, given, rest = None, None, [], list(arguments)
    while rest:
        word = rest.pop(0)
        if word in by_name:
            option = by_name[word]
            if option.kind != SWITCH and not rest:
                raise ValueError(f"{word} requires a value")
            given.append((option.name, rest.pop(0) if option.kind != SWITCH else None))
        elif word.startswith("-"):
            raise ValueError(f"unknown option: {word}")
        elif word in COMMANDS and command is None and address is None:
            command = word
        elif address is None:
            address = word
        else:
            raise ValueError(f"unexpected argument: {word}")
    return command, address, given


def of_arguments(spark: SparkSession, arguments: list[str]) -> tuple[str | None, str | None, Options]:
    """(command, address, options) of a command line. Raises ValueError with all that is wrong."""
    command, address, given = read_arguments(arguments)
    rows = [(0, n, v) for n, v in given] + ([(0, command, None)] if command else [])
    if rows:
        wrong = faults(spark.createDataFrame(rows, "run int, option string, value string")).orderBy("option", "fault").collect()  # no more than the arguments
        if wrong:
            raise ValueError("; ".join(f"{r['option']} {r['fault']}" for r in wrong))
    made: dict = {}
    for name, value in given:
        option = next(o for o in OPTIONS if o.name == name)
        if option.field is None:
            continue
        if option.kind == SWITCH:
            made[option.field] = False
        elif option.kind == NUMBER:
            made[option.field] = int(value or "")
        elif option.kind == LIST:
            made.setdefault(option.field, []).extend([x.strip() for x in re.split(",", value or "") if x.strip()] if name == "--locales" else [value])
        else:
            made[option.field] = value
    return command, address, Options(**made)
