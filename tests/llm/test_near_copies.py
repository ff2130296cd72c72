import random

import corpus_pipeline
import pytest

from loomaudit.llm import near_copies


def brute_kept(rows):
    """The smallest key of each component of texts with a five-word Jaccard of 0.8 or more."""
    def runs(text):
        words = [w for w in (text or "").encode().lower().split() if w]
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    sets, owner = {k: runs(t) for k, t in rows}, {k: k for k, _ in rows}

    def find(k):
        while owner[k] != k:
            k = owner[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                owner[max(x, y)] = min(x, y)
    return {find(k) for k in keys}


def made_rows():
    own = random.Random(7)
    words = lambda n: ["".join(own.choices("abcdefghij", k=6)) for _ in range(n)]
    line = words(12)  # a line that many texts hold
    rows = []
    for length in (8, 30, 80, 200):
        for _ in range(4):
            base = words(length)
            rows.append(base)
            for edits in range(1, 6):
                copy = base.copy()
                for _ in range(edits):
                    copy[own.randrange(length)] = words(1)[0]
                rows.append(copy)
    base = words(100)
    for _ in range(60):  # one large group, whose copies are not all similar to each other
        copy = base.copy()
        for _ in range(own.randrange(4)):
            copy[own.randrange(100)] = words(1)[0]
        rows.append(copy)
    rows += [words(3) + line for _ in range(50)] + [words(60) + line for _ in range(50)]
    rows += [["a", "b"], ["A", "b"], ["a", "b", "c"], [], ["a"] * 7, ["a"] * 70]
    return [(i, " ".join(r)) for i, r in enumerate(rows)] + [(9000, None), (9001, " ")]


@pytest.mark.parametrize("rounds", [0, 1, near_copies.ROUNDS])
def test_near_copies_match_brute_force(spark, monkeypatch, rounds):
    rows = made_rows()
    monkeypatch.setattr(near_copies, "links", lambda u, r, t, links=near_copies.links: links(u, r, t, rounds))
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"] for r in got.collect()} == brute_kept(rows)


def test_stage_drops_edited_copies_and_keeps_others(spark, data):
    base = [f"word{i}" for i in range(60)]
    edited, other = base.copy(), base.copy()
    edited[30] = "else"
    other[10], other[25], other[40] = "x", "y", "z"
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(other)), (None, " ".join(base)), (None, "no key at all here")]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), data)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "3", "None"]


def test_shuffled_joins_and_columns_with_dots(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BROADCAST_IDS", 0)
    monkeypatch.setattr(near_copies, "MOST_SAMPLED", 5)
    rows = made_rows()[:80]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id bigint, text string, `a.b` int, `it's ``quoted``` string")
    got = near_copies.one_of_each(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == brute_kept(rows)
