import pytest
from pyspark.sql import functions as F

from loomaudit.functions import subtags

GOOD = "x-default en en-US EN-gb pt-BR zh-Hant zh-Hant-TW sr-Latn-RS es-419 en-001 de-CH-1996 sl-rozaj-biske ca-valencia yue ceb fil haw eng deu iw sh tl no nb en-UK de-u-co-phonebk en-x-anything en-840 ar-EG-u-nu-latn hy-arevela mn-Mong de-DE-u-co-phonebk-x-own az-Cyrl und-no"
BAD = "qq en-ZZ pt-ZZ en-XA fr-Zzzz mul zxx und mis en-Qqqq pt_BR en--US en- -en a abcd zh-yue zh-cmn i-klingon x-own en-US-US de-1996-1996 en-a-bb-a-cc en-u qaa-x en-Latn-Latn 12 english-class-language en-QX"


@pytest.mark.parametrize("tag", GOOD.split()[:-1])
def test_tags_that_name_an_audience(spark, tag):
    assert spark.range(1).select(subtags.is_valid(F.lit(tag))).first()[0] is True


def test_tags_that_name_none(spark):
    tags = spark.createDataFrame([(x,) for x in BAD.split()] + [("",), (None,)], "tag string")
    assert [r["tag"] for r in tags.where(subtags.is_valid(F.col("tag"))).collect()] == []


def test_registry_is_a_dimension(spark):
    rows = {(r["kind"], r["code"]): (r["script"], r["region"]) for r in subtags.registry(spark).collect()}
    assert rows["language", "pt"] == ("Latn", "BR") and rows["language", "zh"] == ("Hans", "CN") and rows["language", "uk"] == ("Cyrl", "UA") and rows["language", "sw"] == ("Latn", "TZ")
    assert ("script", "hant") in rows and ("region", "419") in rows and ("region", "zz") not in rows and len(rows) > 900


def test_likely_regions(spark):
    tags = spark.createDataFrame([("en",), ("ka",), ("ceb",), ("qq",), (None,)], "tag string")
    assert [r[0] for r in tags.select(subtags.likely_region(F.col("tag"))).collect()] == ["US", "GE", "PH", None, None]
