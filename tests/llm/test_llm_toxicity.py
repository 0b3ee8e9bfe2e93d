import math
import re
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tideloom.llm.registry import QUERIES, table
from tideloom.llm.toxicity import (
    ORDER,
    THRESHOLD,
    Block,
    Grams,
    calibrate,
    evidence,
    fit,
    grams_of,
    toxicity,
    words_in,
)

#: Words that the data's toxic documents hold and others do not.
LEXICON = {"trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "loser", "scum", "moron"}


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert len(got) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= THRESHOLD) for r in got.values())
    held = [i for i, r in got.items() if r["held_out"]]
    hits = {i: sum(w in LEXICON for w in re.findall(r"[a-z]+", texts[i].lower())) for i in held}
    toxic, clean = [i for i in held if hits[i] >= 3], [i for i in held if not hits[i]]
    assert sum(got[i]["predicted"] for i in toxic) >= 0.95 * len(toxic)
    assert sum(got[i]["predicted"] for i in clean) <= 0.01 * len(clean)


def scores(spark, docs, labels, schema="doc_id long, text string"):
    d = spark.createDataFrame(docs, schema)
    return toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()


def test_edge_cases(spark):
    docs = [(i, "vile scum vile" if i % 4 == 0 else "a kind and quiet day") for i in range(200)]
    docs += [(500, None), (501, ""), (502, "42 ?!"), (None, "scum"), (503, "kind " * 200_000), (503, "kind " * 200_000)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(7, 1, None), (0, 1, 1), (9999, 1, 1), (None, 1, 1)]
    schema = "doc_id long, text string, _x string, _toxic int"
    got = scores(spark, [(*d, "k", 3) for d in docs], labels, schema)
    assert len(got) == len(docs) and all(0 <= r["_score"] <= 1 for r in got)
    by = {r["_doc_id"]: r for r in got}
    assert by[500]["_score"] == by[501]["_score"] == by[502]["_score"]
    assert by[4]["_score"] > by[500]["_score"] > by[503]["_score"] and by[503]["_predicted"] == 0
    assert len({r["_score"] for r in scores(spark, docs, [], "doc_id long, text string")}) <= 1
    assert scores(spark, [], labels) == []


def test_a_rare_expression_keeps_its_own_evidence(spark):
    # Frequent clean n-grams whose CRC-32 agrees in its last 20 bits with one of the rare word's n-grams.
    def cell(gram):
        return zlib.crc32(gram.encode()) & ((1 << 20) - 1)

    rare = {cell(gram) for gram in grams_of("zqxjkv")}
    letters = "abcdefghilmnoprstuwyабвгдежзиклмнопрст"
    twins = [g for g in map("".join, product(letters, repeat=4)) if cell(g) in rare]
    assert len({cell(g) for g in twins}) >= 5
    clean = " ".join(twins) + " a kind and quiet day"
    docs = [(i, "zqxjkv day" if i % 20 == 0 else f"{clean} {clean}") for i in range(400)]
    docs += [(1000, "zqxjkv"), (1001, "kind")]
    teach = spark.createDataFrame([(t, int(i % 20 == 0)) for i, t in docs[:400]], "_text string, _toxic int")
    got = evidence(spark.createDataFrame(docs, "doc_id long, text string"), fit(teach), "doc_id", "text").collect()
    x = {r["_doc_id"]: r["_x"] for r in got}
    own = {r["key"]: r["llr"] for r in fit(teach).collect()}
    assert x[1000] == pytest.approx(sum(own[g] for g in grams_of("zqxjkv")) / 107)
    assert x[1000] > 0.1 > 0 > x[1001]


@given(st.lists(st.tuples(st.floats(-1, 1), st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=20))
def test_calibration_rises(rows):
    x, n0, n1 = np.array(rows, float).T
    knots, p = calibrate(x, n0, n1)
    assert (np.diff(knots) >= 0).all() and (np.diff(p) >= 0).all() and (p >= 0).all() and (p <= 1).all()


def plain_kneser_ney(texts):
    """Log-likelihood ratios by the textbook: ``{gram or context: ratio}`` from ``(text, toxic)``."""
    counts = [Counter(), Counter()]
    for text, toxic in texts:
        for word, n in words_in(text).items():
            for gram in grams_of(word):
                counts[toxic][gram] += n

    def discount(values):
        one, two = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return min(max(one / (one + 2 * two) if one else 0.5, 0.1), 0.95)

    level, before = {}, {g for c in counts for g in c}
    for length in range(ORDER - 1, 0, -1):
        kinds = defaultdict(set)
        for g in before:
            kinds[g[1:]].add(g[0])
        level[length] = {g: len(s) for g, s in kinds.items()}
        before = set(level[length])

    def shared(gram):
        table = level[len(gram)]
        if len(gram) == 1:
            return table[gram] / sum(table.values())
        d, mine = discount(table.values()), {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        return (max(mine[gram] - d, 0) + d * len(mine) * shared(gram[1:])) / sum(mine.values())

    def prob(c, gram):
        d, mine = discount([n for n in counts[c].values()]), {g: n for g, n in counts[c].items() if g[:-1] == gram[:-1]}
        if not mine:
            return shared(gram[1:])
        return (max(mine.get(gram, 0) - d, 0) + d * len(mine) * shared(gram[1:])) / sum(mine.values())

    def backoff(c, context):
        mine = [n for g, n in counts[c].items() if g[:-1] == context]
        return discount(list(counts[c].values())) * len(mine) / sum(mine) if mine else 1.0

    grams = {g for c in counts for g in c}
    out = {g: math.log(prob(1, g) / prob(0, g)) for g in grams}
    return out | {c: math.log(backoff(1, c) / backoff(0, c)) for c in {g[:-1] for g in grams}}


def test_scores_are_those_of_plain_kneser_ney(spark):
    texts = [("vile vile scum, vilest day", 1), ("a kind day, days of villages", 0), ("quiet kinds", 0), ("scum of the day", 1), ("the village", 0)]
    model = fit(spark.createDataFrame(texts, "_text string, _toxic int"))
    want = plain_kneser_ney(texts)
    got = {r["key"]: r["llr"] for r in model.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    docs = [(1, "vile villagers"), (2, "unknown xyz"), (3, None), (4, "Scum!")]
    x = {r["_doc_id"]: r["_x"] for r in evidence(spark.createDataFrame(docs, "doc_id long, text string"), model, "doc_id", "text").collect()}
    for i, text in docs:
        grams = [g for w, n in words_in(text).items() for g in grams_of(w) * n]
        total = sum(want.get(g, want.get(g[:-1], 0.0)) for g in grams)
        assert x[i] == pytest.approx(total / (len(grams) + 100), abs=1e-12)


WORDS = st.lists(st.text(alphabet="abcéжß漢𐐷", min_size=1, max_size=9), max_size=30)


@given(WORDS.map(lambda w: sorted(set(w))))
def test_grams_of_many_words(words):
    grams = Grams(words)
    every = [g for w in words for g in grams_of(w)]
    assert [grams.keys[i] for i in grams.index] == every and grams.sizes.tolist() == [len(w) + 1 for w in words]
    n = len(grams.context)
    assert sorted(grams.keys) == sorted(set(every) | {g[:-1] for g in every})
    assert [grams.keys[c] for c in grams.context] == [g[:-1] for g in grams.keys[:n]]


@given(st.lists(WORDS.map(Counter), max_size=6))
def test_blocks_unpack_to_what_was_packed(docs):
    places, kinds, at, times = {}, array("q"), array("q"), array("q")
    for doc in docs:
        kinds.append(len(doc))
        at.extend(places.setdefault(w, len(places)) for w in doc)
        times.extend(doc.values())
    block = Block.unpacked(*Block.of(places, kinds, at, times).packed())
    ends = np.cumsum(block.kinds)
    found = [dict(zip([block.words[i] for i in block.at[e - k : e]], block.times[e - k : e])) for k, e in zip(block.kinds, ends)]
    assert found == [dict(d) for d in docs]
