import os
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideloom.llm.langid import Lattice, fit, identify, vocabulary
from tideloom.llm.registry import QUERIES, table

PIECES = ["▁", "a", "b", "ab", "▁a", "aba", "ba"]


def segmentations(word, number):
    if not word:
        yield ()
        return
    if word[0] not in number:
        for rest in segmentations(word[1:], number):
            yield (0, *rest)
    for n in range(1, len(word) + 1):
        if word[:n] in number:
            for rest in segmentations(word[n:], number):
                yield (number[word[:n]], *rest)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=7), min_size=1, max_size=5), st.integers(0, 9))
def test_forward_and_expectations_sum_all_segmentations(words, seed):
    lattice = Lattice(PIECES)
    probs = np.random.default_rng(seed).dirichlet(np.ones(len(PIECES) + 1), 2).T
    scores = lattice.score(words, np.log(probs))
    wanted = np.zeros(len(probs))
    for word, got in zip(words, scores):
        ways = list(segmentations("▁" + word, lattice.number))
        weight = np.array([[np.prod(probs[list(w), m]) for m in (0, 1)] for w in ways])
        assert got == pytest.approx(np.log(weight.sum(axis=0)))
        for way, p in zip(ways, weight[:, 0] / weight[:, 0].sum()):
            np.add.at(wanted, list(way), 2 * p)
    found = lattice.expected(words, np.full(len(words), 2.0), np.log(probs)[:, 0])
    assert found == pytest.approx(wanted)


def test_vocabulary_is_read_from_the_file():
    pieces = vocabulary()
    assert len(pieces) > 10_000 and "▁the" in pieces and all(p == p.lower() for p in pieces)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op7_language"](spark, sf).collect()}
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").select("doc_id", "lang").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and lang[i]]
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_edge_cases(spark):
    train = spark.createDataFrame(
        [(i, t, l) for i in range(40) for t, l in [("the cat and the dog", "en"), ("der hund und die katze", "de")]]
        + [(50, None, "en"), (51, "", "de"), (52, "x", None), (None, "y", "en")],
        "doc_id long, text string, lang string",
    )
    model = fit(train, rounds=2)
    assert model.languages == ["de", "en"]
    rows = [
        (1, None), (2, ""), (3, "123 !? _"), (4, "The DOG"), (4, "The DOG"), (5, "und die"), (6, "the " * 300_000),
        (7, "ж" * 3000), (None, "der"),
    ]
    schema = "doc_id long, text string, _score string, lang_pred int"
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], schema)
    got = [(r["_kept"]["_score"], r["_doc_id"], r["_lang_pred"], r["_score"]) for r in identify(docs, model, keep=["_score"]).collect()]
    assert len(got) == len(rows) and {g[0] for g in got} == {"k"}
    by = {g[1]: g[2:] for g in got}
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[4][0] == by[6][0] == "en" and by[5][0] == by[None][0] == "de" and by[7][0] in ("de", "en")
    assert identify(docs.limit(0), model).count() == 0
    none = fit(train.where("lang = 'xx'"))
    assert {r["_lang_pred"] for r in identify(docs, none).collect()} == {"und"}


def test_workers_need_not_have_the_package(tmp_path):
    """The driver finds the package by its path; Python workers start in another folder without it."""
    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config(
    "spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
from tideloom.llm.queries import QUERIES
print("ROWS", QUERIES["op7_language"](spark, "/root/testdata/sf0.001").where("lang_pred <> 'und'").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("ROWS")[1]) > 100
