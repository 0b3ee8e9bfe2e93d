import time

import numpy as np
from brute import tiled
from hypothesis import given, settings
from hypothesis import strategies as st

from tideloom.llm import decontaminate
from tideloom.llm.decontaminate import contamination, tile

ITEM = "one two three four five six seven eight nine ten eleven twelve"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=30), st.integers(1, 4))
def test_tiles_like_trying_all_places(item, doc, least):
    a, b = np.array(item, np.uint64), np.array(doc, np.uint64)
    assert tile(a, b, least) == tiled(item, doc, least)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r["_doc_id"]: (r["_contaminated"], r["_coverage"], r["_items"]) for r in contamination(d, b, **more).collect()}


DOCS = [
    (1, "start " + ITEM.upper() + " end"),
    (2, "seven eight nine ten eleven twelve and then one two three four five six"),
    (3, "one two three four five six seven eight but no more"),
    (4, "nothing in common"),
    (5, None),
    (6, ""),
    (7, "x y " * 50_000 + ITEM),
    (8, "short one item"),
]
ITEMS = [(10, ITEM), (11, "short one"), (12, None), (13, " "), (14, ITEM)]


def test_whole_reordered_partial_and_null(spark, monkeypatch):
    got = found(spark, DOCS, ITEMS)
    assert got[1] == (True, 100, [10, 14]) and got[2] == (True, 100, [10, 14]) and got[7] == (True, 100, [10, 14])
    assert got[3] == (False, 66, []) and got[8] == (True, 100, [11])
    assert got[4] == got[5] == got[6] == (False, 0, [])
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    assert found(spark, DOCS, ITEMS) == got


def test_empty_tables_repeats_and_clashes(spark):
    assert found(spark, [], ITEMS) == {}
    assert all(v == (False, 0, []) for v in found(spark, DOCS, []).values())
    d = spark.createDataFrame([(1, ITEM, "a"), (1, ITEM, "b"), (None, "x", None)], "doc_id long, text string, _items string")
    b = spark.createDataFrame([(1, ITEM, 2)], "item_id long, text string, _coverage int")
    rows = contamination(d, b, keep=("doc_id", "text", "_items")).collect()
    assert sorted((r["_kept"]["_items"] or "", r["_contaminated"]) for r in rows) == [("", False), ("a", True), ("b", True)]


def test_a_long_reordered_item_is_tiled_fast():
    rng = np.random.default_rng(4)
    item = rng.integers(0, 1 << 40, 4000, dtype=np.uint64)
    parts = [item[i : i + 20] for i in range(0, 4000, 20)]
    doc = np.concatenate([parts[i] for i in rng.permutation(200)])
    start = time.perf_counter()
    assert tile(item, doc, 5) == 4000
    assert time.perf_counter() - start < 1


def test_words_that_repeat_all_over():
    item, doc = np.full(300, 7, np.uint64), np.full(5000, 7, np.uint64)
    assert tile(item, doc, 5) == 300
    item[::50] = 9
    assert tile(item, doc, 5) == 294


def test_a_large_benchmark_is_joined(spark, monkeypatch):
    rng = np.random.default_rng(9)
    docs = DOCS + [(None, ITEM), (1, "another text"), (1, ITEM), (20, "one two three four five and so on"), (21, "short")]
    items = ITEMS + [(10, "other words under an id that repeats"), (None, ITEM), (15, "short")]
    for i in range(40):
        item = [f"t{rng.integers(60)}" for _ in range(rng.integers(3, 30))]
        items.append((100 + i, " ".join(item)))
        docs.append((100 + i, " ".join(["lead", *item[len(item) // 2 :], "gap", *item[: len(item) // 2]])))
    keep = ("doc_id", "text")

    def rows():
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        out = contamination(d, b, keep=keep)
        return sorted(((r["_doc_id"], r["_kept"]["text"], r["_contaminated"], r["_coverage"], r["_items"]) for r in out.collect()), key=repr)

    held = rows()
    monkeypatch.setattr(decontaminate, "HELD_BYTES", 0)
    assert rows() == held and any(r[2] for r in held)
    plain = found(spark, docs, items)
    monkeypatch.undo()
    assert found(spark, docs, items) == plain
    assert found(spark, [], ITEMS) == {}
