import hashlib
import re
import time

import pytest
from hypothesis import example, given
from hypothesis import strategies as st

from tideloom.llm.pii import KINDS, Mapped, disguised_spans, find_pii, luhn, normalise, plain_spans, redacted
from tideloom.llm.registry import QUERIES, table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (
                kind == "email"
                or (kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")))
                or (kind == "card" and 12 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@given(st.text(alphabet="a1@.+- (2", max_size=40))
@example("a@b.c@d.e")
@example("@a@b.c")
@example("1.2.3.4.5.6.7.8.9")
@example("1.2.3.256.1.1.1")
@example("4111-1111 11111111 +44 20 7946 0123")
def test_plain_spans_are_the_regexes(text):
    assert plain_spans(text) == brute(text)


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("mail john.doe (at) example [dot] com now", "email", "john.doe (at) example [dot] com"),
        ("to john at example dot com, please", "email", "john at example dot com"),
        ("\U0001f642 іvan@exаmple.com", "email", "іvan@exаmple.com"),
        ("a​b@c­d.org", "email", "a​b@c­d.org"),
        ("４１１１ 1111 1111 １１１１", "card", "４１１１ 1111 1111 １１１１"),
        ("call plus four four two zero seven nine four six zero one two three ok", "phone", "plus four four two zero seven nine four six zero one two three"),
        ("call plus one four one five 555 0199 ok", "phone", "plus one four one five 555 0199"),
        ("call +1 415 555 oh one nine nine ok", "phone", "+1 415 555 oh one nine nine"),
        ("at one two seven dot zero dot zero dot one", "ip", "one two seven dot zero dot zero dot one"),
        ("at one zero dot zero dot zero dot one", "ip", "one zero dot zero dot zero dot one"),
        ("at 10 dot zero dot 0 dot 1", "ip", "10 dot zero dot 0 dot 1"),
        ("at 10.zero.0.one", "ip", "10.zero.0.one"),
        ("at one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ],
)
def test_disguises_are_found_in_place(text, kind, part):
    plain = plain_spans(text)
    found = [(k, text[a:b]) for a, b, k in disguised_spans(text, plain)]
    assert (kind, part) in found


@pytest.mark.parametrize(
    "text, base",
    [("jоhn@mail.com", "hn@mail.com"), ("john@mail.cоm", "john@mail.c"), ("jo\u200bhn@mail.com", "hn@mail.com")],
)
def test_a_plain_fragment_does_not_hide_the_whole(text, base):
    line = f"to {text}, a@b.cd"
    plain = plain_spans(line)
    more = disguised_spans(line, plain)
    assert [line[a:b] for a, b, _ in plain] == [base, "a@b.cd"]
    assert [line[a:b] for a, b, _ in more] == [text]
    assert redacted(line, sorted([*plain, *more])) == "to [email], [email]"


@pytest.mark.parametrize(
    "text",
    ["he looked at the dot and one two three", "Look at house dot", "Москва и point (at) night", "one two", "(dot) [at]"],
)
def test_clean_texts_stay_clean(text):
    assert plain_spans(text) == [] and disguised_spans(text, []) == []


@pytest.mark.parametrize("text", ["One. Two. Three. Four!", "in 2019 one of 10, two of 20", "one 2.5 two", "someone 20 199 120"])
def test_counted_words_stay_words(text):
    assert plain_spans(text) == [] and disguised_spans(text, []) == []


def test_leading_zeros_are_read():
    text = "at " + "0" * 5000 + ".0.0.1 on"
    assert plain_spans(text) == [(3, len(text) - 3, "ip")]


def test_rewriting_keeps_offsets():
    mapped = Mapped("ab(at)c")
    mapped.rewrite(re.compile(r"\(at\)"), lambda m: [("@", m.start(), m.end())])
    mapped.rewrite(re.compile("b@"), lambda m: [("x", m.start(), m.end()), ("y", m.start() + 1, m.end())])
    assert mapped.text == "axyc"
    assert mapped.starts.tolist() == [0, 1, 2, 6] and mapped.ends.tolist() == [1, 6, 6, 7]


def test_redaction_joins_overlaps():
    assert redacted("0123456789", [(1, 4, "ip"), (2, 6, "card"), (8, 9, "ip")]) == "0[ip]67[ip]9"


def test_edge_cases(spark):
    long = "x " * 200_000 + "a@b.cd"
    rows = [(1, None), (2, ""), (3, "a@b.cd"), (3, "a@b.cd"), (None, "a@b.cd"), (4, long), (5, "9" * 100_000 + "." * 50_000)]
    schema = "doc_id long, text string, _spans string, kind int"
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], schema)
    got = find_pii(df, keep=("_spans", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [(s["start"], s["end"], s["kind"]) for s in r["_spans"]]
        assert spans == brute(r["_kept"]["text"]) and r["_kept"]["_spans"] == "k"
    assert {r["_doc_id"]: r["_redacted"] for r in got}[3] == "[email]"
    assert find_pii(df.limit(0)).count() == 0


def test_query_matches_the_regexes(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    for r in QUERIES["op6_pii"](spark, sf).collect():
        want = brute(texts[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[2] == k for s in want) for k in KINDS]
        assert set(line.split(",")) - {""} <= set(r["spans"].split(","))


def test_runs_of_white_space_cost_their_length():
    for text in ("dot" + " " * 200_000 + "x", "a at " + " \t" * 100_000, "(" + " " * 200_000 + "at", " " * 200_000 + "(dot) (at) one two"):
        start = time.perf_counter()
        normalise(text)
        assert time.perf_counter() - start < 0.5
    text = "or ann  (at) mail   (dot) com, joe (at)  (at) x"
    assert [text[a:b] for a, b, _ in disguised_spans(text, [])] == ["ann  (at) mail   (dot) com"]
