import random

import corpus_pipeline
from loomaudit.llm.common import load

GOOD = "This is a fair text of some length about {0} and {1}, with words such as {2} {3} {4} that do not repeat, so {5} rules are content with {6} of it at {7}."


def text(i):
    own = random.Random(i)
    return GOOD.format(*("".join(own.choices("bcdfghjklmnpqrtvwz", k=7)) for _ in range(8)))


def test_stages(spark, tmp_path):
    toxic = " ".join(["idiot moron scum"] * 3)
    rows = [(i, text(i), "en", "s", 1) for i in range(60)]
    rows += [(100 + i, text(i), "en", "s", 1) for i in range(5)]  # copies
    rows += [(200, "short", "en", "s", 1), (201, "a b c d e " * 20, "en", "s", 1), (202, None, "en", "s", 1)]
    rows += [(300 + i, text(300 + i) + f" you {toxic} {i}", "en", "s", 1) for i in range(60)]
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    rows += [(400, text(400) + " " + item, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i >= 300)) for i in [*range(60), *range(300, 360)]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(60))
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in out.values())


def test_stages_keep_columns(spark, data):
    docs = load(spark, data, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.withColumnRenamed("source", "quality_kept"), data).columns == [c.replace("source", "quality_kept") for c in docs.columns]
