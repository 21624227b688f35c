"""The join by shuffle gives the same rows as the one by broadcast; long texts, clashing columns, repeated rows."""

import pytest

from arbora.llm import decontaminate

FILLER = " ".join(f"f{i}" for i in range(40))
ITEM = "The quick, brown fox jumps over 13 lazy dogs -- and then it sleeps."
ROWS = [
    (1, f"{FILLER} {ITEM} {FILLER}", "x"), (1, f"{FILLER} {ITEM} {FILLER}", "x"), (2, FILLER, "y"), (3, None, None), (4, "", "z"), (5, "two Words", "z"),
    (6, "the quick brown fox jumps over 13 lazy dogs", "z"), (7, " ".join([FILLER] * 5000) + " " + ITEM, "z"), (None, ITEM.upper(), "z"), (8, "TWO words two wordS", "z"),
]
ITEMS = [(1, ITEM), (2, "two words"), (2, "two words"), (None, "zz"), (3, None), (4, "--"), (5, "Ünicode fox")]


@pytest.mark.parametrize("windows,rows", ((200_000, 200_000), (0, 0), (200_000, 0)))
def test_every_join_gives_the_same(spark, monkeypatch, windows, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", windows)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, w string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((r.n_hit, r["items"]) for r in decontaminate.contamination(docs, items).collect())
    assert got == [(2, ["2"]), (4, ["2"]), (13, ["1"]), (13, ["1"]), (13, ["1"])]
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]


def test_the_shuffle_carries_no_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, w string").selectExpr("doc_id as key", "split(text, ' ') as w")
    words = spark.createDataFrame([(3, 1)], "k int, s long")
    plan = decontaminate._places(docs, words, [3], False)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :].splitlines()
    assert join[1].strip(" :+-").startswith("Project [key") and "w#" not in join[1].split("AS s")[-1]
