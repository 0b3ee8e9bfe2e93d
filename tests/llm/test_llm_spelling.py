import random
import re
from collections import Counter, defaultdict
from zlib import crc32

from brute import LOWER
from hypothesis import given, settings
from hypothesis import strategies as st

from tideloom.llm import spelling
from tideloom.llm.spelling import one_edit_links, spelling_variants

SCHEMA = "doc_id long, text string"


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows, shortest=7, least=2, ratio=10, every=31):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'null' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = defaultdict(list)
    for a in words:
        for b in words:
            if one_apart(a, b):
                near[a].append(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def variants(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = spelling_variants(df, every=31, **options)
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect())


def corpus(seed, docs=150):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéßÉ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 13))) for _ in range(40)]
    rows = []
    for i in range(docs):
        text = []
        for _ in range(60):
            w = rng.choice(base[: 1 + min(39, int(rng.expovariate(0.15)))])
            if rng.random() < 0.1:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", rng.choice("abxyz"), w[at] + "e"]) + w[at + 1 :]
            text.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", ", ", "1"]).join(text)))
    return rows


def test_variants_equal_all_pairs(spark):
    rows = corpus(1)
    got = variants(spark, rows)
    assert got == brute(rows)
    assert any(r[1] for r in got)


def test_crowded_chunks_lose_nothing(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(spelling, "COMPARED", 2)
    assert variants(spark, rows) == brute(rows)


def test_chains_of_forms_have_one_root(spark):
    text = " ".join(["elephants"] * 400 + ["elephant"] * 30 + ["elefant"] + ["elephan"] * 2 + ["elepha"])
    rows = [(None, text), (None, text)]
    got = {r[0]: r for r in variants(spark, rows)}
    assert sorted(got.values()) == brute(rows)
    assert got["elephan"][1:3] == ("elephant", "elephants")


def test_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, "12 ЖЖЖЖЖЖЖ"), (4, "Straße Éléphant Éléphant×÷"), (4, "Straßen Straßen straßen"),
        (4, "Straßen Straßen straßen"), (None, "STRASSEN strassen strassens strassens"), (5, "abcdefgh " * 200_000 + "x" * 300_000), (6, "x" * 300_000),
    ]
    want = brute(rows)
    assert variants(spark, rows) == want
    wide = [(*r, 1, "x", True) for r in rows]
    assert variants(spark, wide, SCHEMA + ", n int, word string, form boolean") == want
    assert variants(spark, []) == []


@settings(max_examples=15, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=3, max_size=7), min_size=2, max_size=60), st.sampled_from([2, 256]))
def test_links_of_random_words(spark, words, compared):
    held, spelling.COMPARED = spelling.COMPARED, compared
    try:
        got = one_edit_links(spark.createDataFrame([(w,) for w in words], "word string"), 3).collect()
    finally:
        spelling.COMPARED = held
    pairs = [frozenset(r) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset((a, b)) for a in words for b in words if one_apart(a, b)}
