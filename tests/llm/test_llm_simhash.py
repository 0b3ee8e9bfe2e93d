import random
from itertools import combinations

import xxhash
from brute import words

from tideloom.llm import simhash
from tideloom.llm.simhash import fingerprint, hamming_links, segment_variants, simhash_groups

SCHEMA = "doc_id long, text string"


def plain_fingerprint(text, k):
    w = words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64(" ".join(w[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_of(keys, links):
    """The smallest member each key can reach, for keys ``(id, fingerprint)``."""
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    return {k: min((x[0] for x in keys if x[0] is not None and root(x) == root(k)), default=None) for k in keys}


def brute(rows, k, distance=2):
    keys = {(i, plain_fingerprint(t, k)) for i, t in rows}
    links = [(a, b) for a, b in combinations(keys, 2) if bin(a[1] ^ b[1]).count("1") <= distance]
    least = least_of(keys, links)
    return sorted(((i, f"{f:016x}", least[i, f]) for i, t in rows for f in [plain_fingerprint(t, k)]), key=repr)


def groups(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).repartition(5)
    return sorted((tuple(r) for r in simhash_groups(df, **options).collect()), key=repr)


def test_spark_and_the_library_hash_alike(spark):
    (row,) = spark.sql("SELECT xxhash64('one two three') AS h").collect()
    assert row["h"] % 2**64 == xxhash.xxh64("one two three".encode(), seed=42).intdigest()
    assert fingerprint(b"One two\tthree") % 2**64 == row["h"] % 2**64


def test_copies_and_near_copies_as_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for n in range(60):
        text = [f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 40, 400]))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(text)
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = "x"
            rows.append((len(rows), rng.choice([" ", "\n"]).join(copy)))
    got = groups(spark, rows, words=3)
    assert got == brute(rows, 3)
    assert len({r[2] for r in got}) < len({r[1] for r in got})


def test_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "One two"), (4, "One two"), (5, "one\ttwo"), (None, "one two"), (None, "lonely"),
        (7, "long " * 300_000), (8, "long " * 299_000), (9, "Ä b c d"), (9, "ä b c d"),
    ]
    want = brute(rows, 3)
    assert groups(spark, rows, words=3) == want
    wide = [(*r, "x", 1, 2) for r in rows]
    assert groups(spark, wide, SCHEMA + ", fp string, component_id int, fingerprint int", words=3) == want
    assert groups(spark, []) == []


def linked(spark, fps, distance):
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    return [(r["a"] % 2**64, r["b"] % 2**64) for r in hamming_links(df, distance).collect()]


def check_links(spark, fps, distance):
    keys = {(f, f) for f in fps}
    got = linked(spark, fps, distance)
    assert all(bin(a ^ b).count("1") <= distance for a, b in got)
    want = least_of(keys, [(a, b) for a, b in combinations(keys, 2) if bin(a[1] ^ b[1]).count("1") <= distance])
    assert least_of(keys, [((a, a), (b, b)) for a, b in got]) == want


def clouds(seed):
    """Fingerprints around a few centres, at up to five flipped bits."""
    rng = random.Random(seed)
    out = {0, 2**64 - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            out.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))}))
    return sorted(out)


def test_links_of_clouds_in_small_groups_and_in_crowds(spark, monkeypatch):
    fps = clouds(1)
    check_links(spark, fps, 2)
    check_links(spark, fps, 1)
    monkeypatch.setattr(simhash, "COMPARED", 3)
    check_links(spark, fps, 2)
    check_links(spark, fps, 1)


def test_a_segment_shared_by_all(spark):
    rng = random.Random(2)
    fps = sorted({(7 << 32) | rng.getrandbits(9) << rng.randrange(20) for _ in range(400)})
    check_links(spark, fps, 2)


def test_every_pair_within_the_distance_shares_a_variant():
    masks = segment_variants(2)
    rng = random.Random(3)
    for bits in combinations(range(64), 2):
        a = rng.getrandbits(64)
        b = a ^ (1 << bits[0]) ^ (1 << bits[1])
        assert any(a & kept == b & kept for kept, _ in masks)
