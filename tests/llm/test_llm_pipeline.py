import random

import corpus_pipeline
import pytest
from brute import near_components, targets, tiled, words
from corpus_pipeline import STAGES
from pyspark.sql import functions as F

from tideloom.llm.registry import table
from tideloom.session import fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _kept string, shard string"
ITEM = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def folder(spark):
    path = fresh_path(spark, "tables")
    items = [(1, ITEM), (2, None), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def stage(spark, folder, name, rows, schema=SCHEMA):
    run = dict(STAGES)[name]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    out = run(spark, docs, folder)
    assert out.columns[: len(docs.columns)] == docs.columns
    return [tuple(r) for r in out.collect()]


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), "k", "s")


def test_language_drops_what_it_cannot_tell(spark, folder):
    rng = random.Random(1)
    own = {lang: [f"{lang}{s}" for s in ("ra", "mo", "ki", "ta", "lu")] for lang in ("xx", "yy", "zz")}
    shared = ["qbo", "qva", "qde"]
    rows = []
    for i in range(240):
        lang = ("xx", "yy", "zz")[i % 3]
        rows.append(row(i, " ".join(rng.choice(own[lang] + shared) for _ in range(30)), lang))
    odd = [row(900, None), row(901, ""), row(902, "42 !"), row(903, "qbo"), row(None, "xxra xxmo xxki"), row(904, "xxra xxmo xxki xxta", None)]
    got = stage(spark, folder, "language", rows + odd + odd[-1:])
    ids = sorted((r[0] for r in got if r[0] is not None))
    assert ids == [*range(240), 904, 904] and sum(r[0] is None for r in got) == 1
    assert set(got) <= set(rows + odd)


def test_language_may_want_some_only(spark, folder, monkeypatch):
    rows = [row(i, f"{'aba' if i % 2 else 'zuz'} " * 20, "xx" if i % 2 else "yy") for i in range(60)]
    monkeypatch.setattr(corpus_pipeline, "WANTED", ("yy",))
    assert {r[0] % 2 for r in stage(spark, folder, "language", rows)} == {0}


def test_near_dedup_keeps_one_of_each_group(spark, folder):
    rng = random.Random(2)
    rows = []
    for n in range(30):
        text = [f"w{rng.randrange(900)}" for _ in range(60)]
        for _ in range(rng.choice([1, 1, 3])):
            copy = list(text)
            if rng.random() < 0.5:
                copy[rng.randrange(60)] = "x"
            rows.append(row(len(rows), " ".join(copy)))
    rows += [row(None, rows[0][1]), row(500, None), row(501, "")]
    least = near_components([r[:2] for r in rows if r[0] is not None], 5, 80)
    want = [r for r in rows if r[0] is None or least[r[0], r[1]] == r[0]]
    assert sorted(stage(spark, folder, "near_dedup", rows), key=repr) == sorted(want, key=repr)


def test_decontamination_drops_whole_items(spark, folder):
    rows = [
        row(1, f"before {ITEM.upper()} after"), row(2, "clean text of no test"), row(2, "clean text of no test"), row(3, None), row(4, ""),
        row(5, " ".join(ITEM.split()[6:] + ["and"] + ITEM.split()[:6])), row(6, "one two three four five six seven"),
        row(None, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), row(7, "long " * 50_000),
    ]
    items = [words(ITEM), words("alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    want = [r for r in rows if len(words(r[1])) > 1000 or not any(100 * tiled(i, words(r[1]), 5) >= 80 * len(i) for i in items)]
    assert sorted(stage(spark, folder, "decontamination", rows), key=repr) == sorted(want, key=repr)


def test_mixing_takes_what_the_targets_ask(spark, folder):
    rng = random.Random(3)
    rows = [row(i, "w " * rng.randrange(1, 60), source="abc"[min(2, i % 7)]) for i in range(700)]
    got = stage(spark, folder, "mixing", rows + [row(800, None), row(801, "x", source=None)])
    sizes = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in "abc"}
    want = dict(zip("abc", targets([*sizes.values(), 1], [5, 2, 1, 5])))
    copies = {}
    for r in got:
        copies[r[:2]] = copies.get(r[:2], 0) + 1
    assert max(copies.values()) <= 3 and set(got) <= set(rows + [row(800, None), row(801, "x", source=None)])
    for s, target in want.items():
        taken = sum(len(words(r[1])) for r in got if r[3] == s)
        assert abs(taken - target) <= 60


def test_sharding_numbers_every_row(spark, folder):
    rows = [row(i, f"text {i // 2}") for i in range(400)] + [row(None, None), row(900, ""), row(901, "x" * 5000)]
    got = stage(spark, folder, "sharding", rows)
    assert sorted((r[:7] for r in got), key=repr) == sorted(rows, key=repr)
    slots = {}
    for r in got:
        slots.setdefault(r[7], []).append(r[8])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("name", [n for n, _ in STAGES])
def test_empty_tables_stay_empty(spark, folder, name):
    assert stage(spark, folder, name, []) == []


def test_run_is_the_stages_in_order(spark):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in STAGES] == ["language", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = table(spark, sf, "documents")
    for _, run in STAGES:
        docs = run(spark, docs, sf)
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", F.xxhash64("text"), "shard", "slot").collect())
    assert key(got) == key(docs) and len(key(got)) > 50
