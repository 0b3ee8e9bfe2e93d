"""Personal data, plain and disguised, with offsets in the original text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.registry import packed, register, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[Span]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = max(done, text.rfind("@", done, at) + 1)
        start += len(text[start:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), "email"
            done = domain.end()
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[Span]:
    """Four dotted numbers of at most 255, looked for in runs of digits and dots."""
    if "." in text:
        for run in _DOTTED.finditer(text):
            if run.group().count(".") >= 3:
                for m in _IP.finditer(run.group()):
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
                        yield run.start() + m.start(), run.start() + m.end(), "ip"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), "card"


def _phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                yield m.start(), m.end(), "phone"


def _ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def plain_spans(text: str) -> list[Span]:
    """Identifiers as they stand, leftmost and non-overlapping per kind; a match that fails its test is dropped."""
    return _ordered(s for find in (_emails, _ips, _cards, _phones) for s in find(text))


class Mapped:
    """A rewritten text that knows for each character which characters of the source it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text))
        self.ends = self.starts + 1

    def rewrite(self, pattern: re.Pattern, write: Callable[[re.Match], list[tuple[str, int, int]]]) -> None:
        """Replace matches: ``write`` gives characters and the part of the present text each stands for."""
        pieces: list[str] = []
        starts, ends, done = [], [], 0
        for m in pattern.finditer(self.text):
            written = write(m)
            for array, held in ((self.starts, starts), (self.ends, ends)):
                held.append(array[done : m.start()])
            pieces += [self.text[done : m.start()], *(c for c, _, _ in written)]
            starts.append(np.array([self.starts[a] for _, a, _ in written], int))
            ends.append(np.array([self.ends[b - 1] for _, _, b in written], int))
            done = m.end()
        if not done:
            return
        pieces.append(self.text[done:])
        self.text = "".join(pieces)
        self.starts = np.concatenate([*starts, self.starts[done:]])
        self.ends = np.concatenate([*ends, self.ends[done:]])


# Letters of other scripts that look like Latin ones, and marks that cannot be seen.
_LOOKS = dict(
    zip(
        "АВЕКМНОРСТУХаеосрхуіјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονι" "∙․‧。．＠﹫＋﹢－‐‑‒–",
        "ABEKMHOPCTYXaeocpxyijsdhABEZHIKMNOPTYXaovi" ".....@@++-----",
    )
)
_LOOKS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_LOOKS |= {chr(0x0660 + i): str(i) for i in range(10)} | {chr(0x06F0 + i): str(i) for i in range(10)}
_LOOKS |= {chr(0x1D7CE + i): str(i % 10) for i in range(50)}
_LOOKS |= {chr(0x1D400 + 52 * n + i): (chr(65 + i) if i < 26 else chr(71 + i)) for n in range(13) for i in range(52)}
_UNSEEN = "­​‌‍⁠﻿"
_AS_LATIN = str.maketrans(_LOOKS)
_HIDDEN = re.compile(f"[{_UNSEEN}]")
#: The stretches of Unicode in which the characters above lie.
_STRANGE = re.compile("[\xad\u0370-\u06ff\u2000-\u206f\u2219\u3002\ufe60-\uff5e\U0001d400-\U0001d7ff]")
_DIGITS = {w: str(n) for n, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
#: Spelled digits in a row that are always read as a number. Runs with fewer are where, with their numerals, they
#: have the digits of the shortest telephone number or the parts of an IP address; others are ordinary words.
SPELLED, DIGITS = 7, 9
#: Tokens of the shortest of these: four digits and three dots.
_LEAST = 7

# Top-level names after which a bare "at ... dot ..." is read as an address.
_TOP = "com|org|net|edu|gov|mil|info|biz|io|ai|app|dev|tv|de|fr|nl|uk|eu|ca|au|jp|cn|br|ch|pl|ru|se|example|test|invalid"
_OPEN, _SHUT = r"[(\[{<]\s*", r"\s*[)\]}>]"
_BARE_AT = rf"(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)*\s+dot\s+(?:{_TOP})\b)"
#: White space ahead of a bracket, all of it: a run is looked at from its start only.
_AHEAD = r"(?:(?<!\s)\s+)?"
_AT = re.compile(rf"{_AHEAD}{_OPEN}(?:at|@){_SHUT}\s*|{_BARE_AT}", re.IGNORECASE)
_DOT = re.compile(rf"{_AHEAD}{_OPEN}(?:dot|point|\.){_SHUT}\s*|(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])", re.IGNORECASE)
_BRACKETED = re.compile(rf"{_OPEN}(?:at|@|dot|point|\.){_SHUT}", re.IGNORECASE)
_WORD = "|".join(_DIGITS)
_TOKEN = rf"(?:(?:{_WORD})(?![A-Za-z])|[0-9.])"
_NUMBER = re.compile(rf"(?<![A-Za-z0-9])(?:plus\s+)?{_TOKEN}(?:[\s,-]*{_TOKEN}){{{_LEAST - 1},}}", re.IGNORECASE)
_NEAR = re.compile(rf"(?:{_WORD})[\s,.-]*(?:(?:{_WORD})(?![a-z])|[0-9])|[0-9][\s,.-]*(?:{_WORD})(?![a-z])")
#: Four parts whose dots have nothing after them: a dot and a space end a sentence.
_QUAD = re.compile(rf"{_TOKEN}(?:\.(?=\S)(?:[\s,-]*(?:(?:{_WORD})(?![A-Za-z])|[0-9]))+){{3}}", re.IGNORECASE)
_PARTS = re.compile(rf"plus|{_WORD}|[0-9.]", re.IGNORECASE)


def _one(sign: str) -> Callable[[re.Match], list[tuple[str, int, int]]]:
    return lambda m: [(sign, m.start(), m.end())]


def _spelled(m: re.Match) -> list[tuple[str, int, int]]:
    parts = [(p.group().lower(), m.start() + p.start(), m.start() + p.end()) for p in _PARTS.finditer(m.group())]
    words, numerals = sum(p in _DIGITS for p, _, _ in parts), sum(p.isdigit() for p, _, _ in parts)
    if not words or words < SPELLED and words + numerals < DIGITS and not _QUAD.search(m.group()):
        return [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m.group())]
    return [(_DIGITS.get(p, "+" if p == "plus" else p), a, b) for p, a, b in parts]


def normalise(text: str) -> Mapped | None:
    """The text with disguises undone, or None if it shows none.

    Look-alikes and unseen marks first, then at and dot, in brackets or between words of an
    address, then runs of spelled digits and numerals long enough for a detector. Texts without any sign of these
    are told apart by a few searches and not rewritten.
    """
    # Look-alikes stand for one character each, so offsets stay as they are.
    strange = not text.isascii() and _STRANGE.search(text)
    latin = text.translate(_AS_LATIN) if strange else text
    hidden = strange and _HIDDEN.search(latin)
    low = latin.lower()
    spelled = _NEAR.search(low)
    if not (latin != text or hidden or spelled or "dot" in low or _BRACKETED.search(latin)):
        return None
    mapped = Mapped(latin)
    mapped.rewrite(_HIDDEN, lambda m: [])
    mapped.rewrite(_AT, _one("@"))
    mapped.rewrite(_DOT, _one("."))
    mapped.rewrite(_NUMBER, _spelled)
    return mapped if mapped.text != text else None


def disguised_spans(text: str, plain: Sequence[Span]) -> list[Span]:
    """Identifiers that only show once disguises are undone, as spans of the source text.

    One that lies within a plain span of its kind is not reported again. One that reaches beyond
    it stands beside it: an undisguised part of an address may look like an address itself.
    """
    mapped = normalise(text)
    if mapped is None:
        return []
    found = []
    for start, end, kind in plain_spans(mapped.text):
        a, b = int(mapped.starts[start]), int(mapped.ends[end - 1])
        own = [s for s in plain if s[2] == kind]
        at = bisect_right(own, a, key=lambda s: s[0])
        if not at or own[at - 1][1] < b:
            found.append((a, b, kind))
    return found


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: Sequence[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())])


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), redact: bool = True
) -> DataFrame:
    """One row per row of ``docs``: ``_kept`` (a struct of the ``keep`` columns), ``_doc_id, _spans, _redacted``.

    ``_spans`` lists the identifiers of the whole text by start, then kind: kind, start and end
    (code points of the source text, end exclusive), and whether it was disguised. Plain ones
    (``plain_spans``) are always there. For disguised ones, transducers undo look-alike
    characters, unseen marks, at and dot spelled or bracketed, and runs of spelled digits, each
    keeping for every character it writes the source characters it stands for; what the same
    detectors find in the result is mapped back. ``_redacted`` is the text with its spans replaced
    (null without ``redact``).

    A null text counts as empty; an empty text has no spans. Every row is judged alone, so
    repeated rows agree, in time linear in the text. An empty table gives an empty result.
    """
    named = docs.select(*packed(keep), F.col(id_col).alias("_doc_id"), F.col(text_col).alias("_text"))
    out = named.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, texts = [], []
            for item in batch["_text"]:
                text = item.as_py() or ""
                plain = plain_spans(text)
                more = set(disguised_spans(text, plain)) if text else set()
                spans = _ordered([*plain, *more])
                lists.append(
                    [{"kind": k, "start": a, "end": b, "disguised": (a, b, k) in more} for a, b, k in spans]
                )
                texts.append(redacted(text, spans) if redact else None)
            columns = {name: batch[name] for name in out}
            columns |= {"_spans": pa.array(lists, pa.list_(_SPAN)), "_redacted": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    kinds = "array<struct<kind:string,start:bigint,end:bigint,disguised:boolean>>"
    schema = named.select(*out, F.lit(None).cast(kinds).alias("_spans"), F.lit(None).cast("string").alias("_redacted"))
    return named.mapInArrow(run, schema.schema)


@register("op6_pii")
def op6_pii(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"), redact=False)
    plain = F.filter("_spans", lambda s: ~s["disguised"])

    def count(kind):
        # A second parameter of the function would be the place in the array, not the kind.
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long")

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        F.col("_doc_id").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text_of(plain), 256).alias("base_sha256"),
        text_of(F.col("_spans")).alias("spans"),
    )
