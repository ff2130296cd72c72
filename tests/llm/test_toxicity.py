import random
import unicodedata

import pytest

from loomaudit.llm import toxicity

LEXICON = toxicity.Lexicon({"idiot": 3.0, "trash": 2.0, "scum": 1.5, "sc": 0.25}, exceptions=("trash can", "scum line"))
FOUND = toxicity.automaton(LEXICON.key())


@pytest.mark.parametrize("text", ["@idiot", "!idiot", "$idiot", "|idiot|", "you!idiot", "4idiot", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "ídiot", "ídiot", "іdiot", "1D10T", "(Idiot)", "id­iots"])
def test_signs_marks_and_lookalikes_hide_nothing(text):
    assert toxicity.weigh(text, FOUND) == 3.0


@pytest.mark.parametrize("text", ["anidiot", "éidiot", "the trash can", "TRASH\n CAN!", "", "idio t"])
def test_no_hit(text):
    assert toxicity.weigh(text, FOUND) == 0


def test_an_exception_ends_with_its_word():
    assert toxicity.weigh("trash cannot", FOUND) == 2.0
    assert toxicity.weigh("trash can trash", FOUND) == 2.0


def brute(text, lexicon):
    base = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn" and c not in "­​")
    base = " ".join(base.lower().split())
    folded = "".join(toxicity._FOLD.get(ord(c), c) for c in base)
    starts = [i for i in range(len(base)) if i == 0 or not base[i - 1].isalpha()]
    spans = [(i, i + len(p)) for i in starts for p in lexicon.exceptions if folded.startswith(p, i) and not base[i + len(p) : i + len(p) + 1].isalpha()]
    return sum(w for i in starts for e, w in lexicon.weights.items() if folded.startswith(e, i) and not any(a <= i and i + len(e) <= b for a, b in spans))


def test_matcher_equals_brute_force():
    rng = random.Random(5)
    parts = ["idiot", "1d!0t", "trash", "tr@sh", "can", "cannot", "scum", "5cum", "line", " ", " ", " ", "x", "é", "é", "-", "@", "\n", "​", "ѕсum", "7"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert toxicity.weigh(text, FOUND) == pytest.approx(brute(text, LEXICON)), text


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id bigint, quality int, toxic int")


def test_learning_chooses_the_word_and_learns_an_exception(spark):
    """zorgly is toxic but beside a lamp; zorba, of the same beginning, is not."""
    rows = []
    for i in range(600):
        middle = "such zorgly here" if i % 3 == 0 else "a zorgly lamp" if i % 24 == 1 else "the zorba way" if i % 12 in (2, 4, 5) else "nothing more"
        rows.append((i, f"word{i} and {middle} again {i}", int(i % 3 == 0)))
    docs, labels = labelled(spark, rows)
    lexicon = toxicity.learn_lexicon(docs, labels)
    assert [e for e in lexicon.weights if e.startswith("zor")] == ["zorgly"]
    assert "zorgly lamp" in lexicon.exceptions
    found = toxicity.automaton(lexicon.key())
    assert toxicity.weigh("a Zorgly lamp", found) == 0 < toxicity.weigh("z0rgly man", found)
    assert toxicity.learn_lexicon(*labelled(spark, rows[::-1])) == lexicon


def test_ties_fall_to_the_longer_then_the_first():
    totals = (100, 100, 100, 100)
    counts = [(s, 0, 40, 0, 40, 0, 40, 0, 40) for s in ("bad", "badw", "badword", "abcd")]
    assert list(toxicity.choose_stems(counts, totals, 3, 2.0)) == ["badword", "abcd"]


def test_repeated_ids_nulls_long_texts_and_empty_tables(spark):
    rows = [(i, f"text {i} {'idiot' if i % 2 else 'fine'}", i % 2) for i in range(200)]
    docs, labels = labelled(spark, rows)
    lexicon = toxicity.learn_lexicon(docs, labels)
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "idiot"), (3, "idiot " * 200_000), (3, "z" * 1_000_000)], "doc_id bigint, text string")
    scores = [r["s"] for r in odd.select(toxicity.score(lexicon, odd["text"]).alias("s")).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[3] > scores[0] == scores[1]
    assert odd.limit(0).select(toxicity.score(lexicon, odd["text"]).alias("s")).count() == 0
    assert toxicity.learn_lexicon(docs.union(docs), labels.union(labels)) == lexicon
    assert toxicity.learn_lexicon(docs.limit(0), labels) == toxicity.Lexicon()
