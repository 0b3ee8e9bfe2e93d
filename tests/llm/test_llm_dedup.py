import hashlib
import random
import re

import numpy as np
from brute import near_components, shingle_set
from hypothesis import given, settings
from hypothesis import strategies as st

from tideloom.llm import minhash
from tideloom.llm.components import components
from tideloom.llm.exact_dedup import exact_duplicates
from tideloom.llm.minhash import Signature, link_sets, near_duplicates
from tideloom.llm.textual import shingles, words_of

SCHEMA = "doc_id long, text string"


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(digest(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[digest(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[digest(t)]), i == keep, digest(t)))
    return sorted(out, key=repr)


def exact(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(5)
    return sorted((tuple(r) for r in exact_duplicates(df).collect()), key=repr)


def test_exact_with_a_text_that_fills_a_third(spark):
    rng = random.Random(1)
    rows = [(i, "same  text\n") for i in range(900)] + [(i, f"text {i // 2}") for i in range(900, 1900)]
    rows += [(i, rng.choice([None, "", " ", "same text", "same\ttext "])) for i in range(1900, 2600)]
    rng.shuffle(rows)
    assert exact(spark, rows) == exact_brute(rows)


def test_exact_edge_cases(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, None), (5, "x" * 3_000_000), (4, "x" * 3_000_000)]
    assert exact(spark, rows) == exact_brute(rows)
    assert exact(spark, []) == []
    wide = [(*r, "k", 1) for r in rows]
    assert exact(spark, wide, SCHEMA + ", keep_id string, group_size int") == exact_brute(rows)


def near(spark, rows, words=5, percent=80, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(4)
    return sorted(near_duplicates(df, words, percent).collect(), key=repr)


def near_check(got, rows, words, percent):
    want = near_components([r[:2] for r in rows], words, percent)
    expected = sorted((r[0], len(shingle_set(r[1], words)), want[r[0], r[1]]) for r in rows if r[0] is not None)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == expected
    assert len(got) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def families(seed, sizes, length=60):
    """Families of near copies: members differ from a common text, and from each other, by a few words."""
    rng = random.Random(seed)
    rows, n = [], 0
    for size in sizes:
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(length)] = f"w{rng.randrange(5000)}"
            rows.append((n, " ".join(text)))
            n += 1
    rng.shuffle(rows)
    return rows


def test_near_matches_all_pairs(spark):
    rows = families(2, [1] * 20 + [2] * 20 + [30, 9])
    near_check(near(spark, rows, 3, 85), rows, 3, 85)


def test_large_families_are_settled_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = families(3, [60, 25, 1, 1])
    near_check(near(spark, rows, 3, 85), rows, 3, 85)


def test_near_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\ttwo"), (6, "one"), (7, "a b c d e f"),
        (7, "a b c d e f"), (8, "A B C D E F"), (9, "x " * 200_000), (10, "x " * 199_999),
    ]
    near_check(near(spark, rows), rows, 5, 80)
    wide = [(*r, 1, True, "x") for r in [*rows, (None, "a b c d e f")]]
    got = near(spark, wide, schema=SCHEMA + ", component_id int, kept boolean, keys string")
    near_check([r for r in got if r["doc_id"] is not None], rows, 5, 80)
    (alone,) = [r for r in got if r["doc_id"] is None]
    assert alone["kept"] and alone["component_id"] is None
    assert near(spark, []) == []


def test_repeated_ids_with_other_texts_are_judged_by_text(spark):
    one, two = "a b c d e f g", "p q r s t u v"
    got = near(spark, [(1, one), (5, one), (5, two), (9, two)])
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (5, 1), (5, 5), (9, 5)]


def test_pigeonhole_guarantee():
    """Signatures that differ in fewer values than the bound always share a key."""
    rng = np.random.default_rng(0)
    signature = Signature()
    for _ in range(50):
        a = rng.integers(0, 1 << 16, (1, 40), dtype=np.uint64)
        b = a.copy()
        places = rng.choice(40, signature.chunks * (signature.errors + 1) - 1, replace=False)
        b[0, places] = (b[0, places] + np.uint64(1)) % np.uint64(1 << 16)
        assert np.intersect1d(signature.keys(a), signature.keys(b)).size


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=2, max_size=24), st.integers(50, 95))
def test_link_sets_loses_no_link(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    forest = link_sets(arrays, list(range(len(sets))), percent)
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    same = [[root(i) == root(j) for j in range(len(sets))] for i in range(len(sets))]
    assert same == [[forest.root(i) == forest.root(j) for j in range(len(sets))] for i in range(len(sets))]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab Cé\n\x0b\x1f", max_size=30)), max_size=8), st.integers(1, 4))
def test_shingles_count_like_plain_python(texts, k):
    found = [len(shingles(w, k)) for w in words_of(texts)]
    assert found == [len(shingle_set(t, k)) for t in texts]


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(50))
    assert got[200] == got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
