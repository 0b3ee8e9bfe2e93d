import random
from itertools import product

import pytest
from brute import targets as brute_targets
from brute import words
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from tideloom.llm import mixing
from tideloom.llm.mixing import mix_sources, route, targets

SCHEMA = "doc_id long, text string, source string"


@given(st.lists(st.integers(0, 200), min_size=1, max_size=9))
def test_targets_match_repeated_resharing(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights))
from tideloom.llm.registry import QUERIES, table


def best_flow(supply, quota, repeats):
    """Most words, then least cost, over all ways to deal out small supplies."""
    edges = [(p, m) for p in supply for m in p]
    best = None
    for amounts in product(*[range(quota[m] + 1) for _, m in edges]):
        out = {p: 0 for p in supply}
        into = {m: 0 for m in quota}
        for (p, m), a in zip(edges, amounts):
            out[p] += a
            into[m] += a
        if any(into[m] > quota[m] for m in quota) or any(out[p] > repeats * supply[p] for p in supply):
            continue
        cost = sum(max(0, out[p] - k * supply[p]) for p in supply for k in range(1, repeats))
        score = (sum(amounts), -cost)
        best = score if best is None else max(best, score)
    return best


@settings(max_examples=60, deadline=None)
@given(
    st.dictionaries(st.sampled_from([("a",), ("b",), ("a", "b"), ("b", "c")]), st.integers(0, 3), min_size=1),
    st.tuples(*[st.integers(0, 4)] * 3),
)
def test_flow_is_the_cheapest_of_the_largest(supply, quotas):
    quota = {m: q for m, q in zip("abc", quotas) if any(m in p for p in supply)}
    given_ = route(supply, quota, 2)
    out = {p: sum(given_.get(p, {}).values()) for p in supply}
    into = {m: sum(f.get(m, 0) for f in given_.values()) for m in quota}
    assert all(into[m] <= quota[m] for m in quota) and all(out[p] <= 2 * supply[p] for p in supply)
    assert (sum(out.values()), -sum(max(0, out[p] - supply[p]) for p in supply)) == best_flow(supply, quota, 2)


def mixed(spark, rows, schema=SCHEMA, **more):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(mix_sources(df, **more).collect(), key=repr)


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    sources = ["b", "a", None, "hot", "é", "B"]
    return [
        (i, " ".join(["x"] * rng.choice([0, 1, 3, 8, 40])), "hot" if i % 3 else rng.choice(sources)) for i in range(n)
    ]


def check(rows, got):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, brute_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    of = {r[0]: r for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        source, size = of[r["_doc_id"]][2], len(words(of[r["_doc_id"]][1]))
        assert r["_size"] == size and r["_source_size"] == sizes[source]
        assert r["_target"] == pytest.approx(want[source])
        assert 0 <= r["_taken"] <= 3 * size and abs(r["_copies"] * size - r["_taken"]) <= max(0, size)
        taken[source] += r["_taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_every_source_meets_its_target(spark):
    rows = corpus()
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    check(rows, got)
    assert got == mixed(spark, random.Random(3).sample(rows, len(rows)))


def test_repeats_nulls_and_clashes(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, "x " * 100_000, "t"), (None, "q r", "t")]
    schema = SCHEMA + ", size string, _taken int, _pattern string"
    wide = [(*r, "k", 7, "p") for r in rows]
    got = mixed(spark, wide, schema, keep=["doc_id", "_taken", "_pattern", "size"])
    assert len(got) == len(rows) and all(r["_kept"]["_taken"] == 7 and r["_kept"]["doc_id"] == r["_doc_id"] for r in got)
    assert all(r["_taken"] == 0 for r in got if r["_size"] == 0)
    assert mixed(spark, [], SCHEMA) == []
    assert all(r["_taken"] == 0 and r["_target"] == 0 for r in mixed(spark, [(1, None, "s"), (2, "", None)]))


def test_documents_of_several_sources(spark):
    rows = [(i, "w " * (i % 5 + 1), ["a", "b"] if i % 4 else ["a"]) for i in range(200)] + [(999, "w", [])]
    got = mixed(spark, rows, "doc_id long, text string, tags array<string>", sources=F.col("tags"))
    total = sum(len(words(t)) for _, t, _ in rows)
    assert abs(sum(r["_taken"] for r in got) - total) <= 3
    assert {r["_pattern"] for r in got} == {'["a"]', '["a","b"]', "[null]"}


def test_every_part_goes_through_the_flow(spark, monkeypatch):
    calls, plain = [], mixing._flow

    def noted(supply, quota, repeats):
        calls.append((set(supply), plain(supply, quota, repeats)))
        return calls[-1][1]

    monkeypatch.setattr(mixing, "_flow", noted)
    got = QUERIES["op2_mix_sources"](spark, "/root/testdata/sf0.001").collect()
    sources = {r["source"] for r in table(spark, "/root/testdata/sf0.001", "documents").select("source").distinct().collect()}
    assert {p for patterns, _ in calls for p in patterns} == {(s,) for s in sources}
    assert sum(r["taken"] for r in got) == sum(w for _, given in calls for members in given.values() for w in members.values())
