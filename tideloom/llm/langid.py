"""Language identification by unigram piece models that sum over all segmentations of a text."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.registry import packed, register, table
from tideloom.session import settle

#: The fixed public vocabulary; another sentencepiece model may be named instead.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Words of pooled evidence with which each language starts.
PRIOR_WORDS = 1000.0
UNKNOWN = "und"
#: Tokens whose scores a task remembers at most; forgetting them changes time, not results.
_REMEMBERED = 300_000
_CELLS = 1 << 21
_MARK = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")


def tokens_in(text: str | None) -> list[str]:
    """The lower-cased text between white space; runs of letters never reach over it."""
    return text.lower().split() if text else []


def words_in(token: str) -> list[str]:
    """The runs of letters of a token."""
    return [token] if token.isalpha() else _LETTERS.findall(token)


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The lower-cased pieces of letters of a sentencepiece model, the mark of a word's start included."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == _MARK or _LETTERS.fullmatch(p.removeprefix(_MARK)))


class Lattice:
    """All segmentations of marked words into pieces; a character of no piece is an unknown one, number 0."""

    def __init__(self, pieces: Sequence[str]):
        self.number = {p: i + 1 for i, p in enumerate(pieces)}
        letters = sorted({c for p in pieces for c in p})
        self.kind = np.zeros(sys.maxunicode + 1, np.int64)
        self.kind[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        # A tree of all beginnings of pieces: from a node and the kind of a character to the next node.
        nodes = {"": 0}
        for p in pieces:
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes))
        steps = sorted((nodes[x[:-1]] * (len(letters) + 1) + int(self.kind[ord(x[-1])]), n) for x, n in nodes.items() if x)
        steps.append((np.iinfo(np.int64).max, 0))
        self.steps, self.next = np.array(steps, np.int64).T.copy()
        self.width = len(letters) + 1
        self.piece_at = np.array([self.number.get(x, 0) for x in nodes], np.int64)

    def edges(self, words: Sequence[str]) -> tuple[np.ndarray, ...]:
        """Word, start, end and piece of each edge, ordered by end, then length."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        line = "".join(f"{_MARK}{w}\n" for w in words).encode("utf-32-le", "surrogatepass")
        line = np.frombuffer(line, np.uint32)
        kinds = self.kind[line]
        unknown = line != ord("\n")
        place, node, length = np.flatnonzero(kinds), np.int64(0), 0
        starts, lengths, found = [], [], []
        while len(place):
            step = node * self.width + kinds[place + length]
            at = np.searchsorted(self.steps, step)
            alive = self.steps[at] == step
            place, node, length = place[alive], self.next[at[alive]], length + 1
            piece = self.piece_at[node]
            whole = piece > 0
            starts.append(place[whole])
            lengths.append(np.full(len(starts[-1]), length))
            found.append(piece[whole])
            if length == 1:
                unknown[starts[0]] = False
        alone = np.flatnonzero(unknown)
        start, length = np.concatenate([*starts, alone]), np.concatenate([*lengths, np.ones(len(alone), np.int64)])
        piece = np.concatenate([*found, np.zeros(len(alone), np.int64)])
        word = np.repeat(np.arange(len(words)), sizes)[start]
        start -= (np.cumsum(sizes) - sizes)[word]
        order = np.lexsort((length, start + length))
        return word[order], start[order], (start + length)[order], piece[order]

    def forward(self, words: Sequence[str], logs: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Log probabilities ``[word, end, model]`` of all beginnings, and the edges.

        ``logs`` holds the log probability of each piece under each model.
        """
        w, s, e, piece = edges = self.edges(words)
        size = max(len(x) for x in words) + 2
        alpha = np.full((len(words), size, logs.shape[1]), -np.inf)
        alpha[:, 0] = 0
        for a, b in _runs(e, e - s):
            at = (w[a:b], e[a:b])
            alpha[at] = np.logaddexp(alpha[at], alpha[w[a:b], s[a:b]] + logs[piece[a:b]])
        return alpha, edges

    def score(self, words: Sequence[str], logs: np.ndarray) -> np.ndarray:
        """The log probability of each word under each model, summed over its segmentations."""
        out = np.empty((len(words), logs.shape[1]))
        for part in _batches(words, logs.shape[1]):
            alpha, _ = self.forward([words[i] for i in part], logs)
            out[part] = alpha[np.arange(len(part)), [len(words[i]) + 1 for i in part]]
        return out

    def expected(self, words: Sequence[str], counts: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """How often each piece is expected in ``counts`` occurrences of the words, under one model."""
        out = np.zeros(len(logs))
        for part in _batches(words, 1):
            held = [words[i] for i in part]
            alpha, (w, s, e, piece) = self.forward(held, logs[:, None])
            alpha = alpha[:, :, 0]
            ends = np.array([len(x) + 1 for x in held])
            rows = np.arange(len(held))
            beta = np.full(alpha.shape, -np.inf)
            beta[rows, ends] = 0
            for a, b in reversed(_runs(e, e - s)):
                at = (w[a:b], s[a:b])
                beta[at] = np.logaddexp(beta[at], beta[w[a:b], e[a:b]] + logs[piece[a:b]])
            share = alpha[w, s] + logs[piece] + beta[w, e] - alpha[rows, ends][w]
            np.add.at(out, piece, np.exp(share) * counts[part][w])
        return out


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Where neighbours agree in all keys; within such a run, no place of a word occurs twice."""
    if not len(keys[0]):
        return []
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    cuts = np.append(np.flatnonzero(change), len(change)).tolist()
    return list(zip(cuts[:-1], cuts[1:]))


def _batches(words: Sequence[str], models: int) -> Iterator[np.ndarray]:
    """Indices of words of similar length, few enough for one array."""
    order = np.argsort([len(w) for w in words], kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(4096, _CELLS // ((len(words[order[at]]) + 2) * max(1, models))))
        part = order[at : at + n]
        while len(part) > 1 and (len(words[part[-1]]) + 2) * models * len(part) > 2 * _CELLS:
            part = part[: (len(part) + 1) // 2]
        yield part
        at += len(part)


#: Steps of one expected occurrence in sums.
FINE = float(1 << 20)


class LanguageModel:
    """Log probabilities of the pieces (rows) under the languages (columns)."""

    def __init__(self, languages: Sequence[str], pieces: Sequence[str], logs: np.ndarray):
        self.languages, self.pieces, self.logs = list(languages), list(pieces), logs


def _held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    path: str = VOCABULARY,
    rounds: int = ROUNDS,
) -> LanguageModel:
    """Piece probabilities per language from labelled rows outside the held-out third.

    The words of all these rows are counted per language over the cluster; each round then adds
    up, over the cluster, how often the forward-backward algorithm expects each piece in the
    distinct words, and the driver receives one number per language and piece of the vocabulary.
    A language starts from ``PRIOR_WORDS`` words of the pooled distribution. Without labelled
    rows there are no languages, and every text is ``und``.
    """
    pieces = vocabulary(path)
    labelled = docs.where(F.col(lang_col).isNotNull() & ~F.coalesce(_held_out(F.col(id_col)), F.lit(True)))
    labelled = labelled.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("_lang"):
                tokens: Counter = Counter()
                for text in part["_text"]:
                    tokens.update(tokens_in(text))
                found: Counter = Counter()
                for token, n in tokens.items():
                    for word in words_in(token):
                        found[word] += n
                if found:
                    yield pd.DataFrame({"lang": lang, "word": list(found), "n": list(found.values())})

    words = labelled.mapInPandas(count, "lang string, word string, n long")
    words = settle(words.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(r["_lang"] for r in labelled.select("_lang").distinct().collect())
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)))
    logs = np.full((len(pieces) + 1, len(languages)), -np.log(len(pieces) + 1))
    for _ in range(rounds):
        logs = _improved(words, languages, pieces, logs)
    return LanguageModel(languages, pieces, logs)


def _improved(words: DataFrame, languages: list[str], pieces: list[str], logs: np.ndarray) -> np.ndarray:
    shared = words.sparkSession.sparkContext.broadcast((languages, pieces, logs))

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, pieces, logs = shared.value
        lattice = Lattice(pieces)
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                column = logs[:, languages.index(lang)]
                found = lattice.expected(part["word"].tolist(), part["n"].to_numpy(), column)
                seen = np.flatnonzero(found)
                if len(seen):
                    yield pd.DataFrame({"lang": lang, "piece": seen, "n": np.rint(found[seen] * FINE)})

    rows = words.mapInPandas(expect, "lang string, piece long, n double")
    # Whole numbers add up alike in any order.
    total = (F.sum(F.col("n").cast("decimal(28,0)")).cast("double") / FINE).alias("n")
    rows = rows.groupBy("lang", "piece").agg(total).toArrow().to_pandas()
    found = np.zeros(logs.shape)
    column = rows["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy(np.int64)
    found[rows["piece"].to_numpy(np.int64), column] = rows["n"].to_numpy()
    pooled = found.sum(axis=1, keepdims=True) + 1
    pooled /= pooled.sum()
    return np.log((found + PRIOR_WORDS * pooled) / (found.sum(axis=0) + PRIOR_WORDS))


class _Scorer:
    """Scores texts, remembering the scores of words and of tokens."""

    def __init__(self, pieces: Sequence[str], logs: np.ndarray):
        self.lattice, self.logs = Lattice(pieces), logs
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.tokens: dict[str, int] = {}
        self.of_words = np.empty((0, self.logs.shape[1]))
        self.of_tokens = np.empty((0, self.logs.shape[1]))
        self.letters = np.empty(0, bool)

    def _learn(self, tokens: list[str]) -> None:
        split = [words_in(t) for t in tokens]
        fresh = list(set(chain.from_iterable(split)).difference(self.words))
        if fresh:
            self.words.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh))))
            self.of_words = np.concatenate([self.of_words, self.lattice.score(fresh, self.logs)])
        sums = np.zeros((len(tokens), self.logs.shape[1]))
        owners = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, split), np.int64, len(split)))
        np.add.at(sums, owners, self.of_words[np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64)])
        letters = [t.isalpha() or any(map(str.isalpha, t)) for t in tokens]
        self.tokens.update(zip(tokens, range(len(self.tokens), len(self.tokens) + len(tokens))))
        self.of_tokens = np.concatenate([self.of_tokens, sums])
        self.letters = np.concatenate([self.letters, np.array(letters, bool)])

    def score(self, texts: Sequence[str | None]) -> list[np.ndarray | None]:
        """For each text the log probability under every language; None where it has no letter."""
        counted = [Counter(tokens_in(t)) for t in texts]
        if len(self.tokens) > _REMEMBERED:
            self._forget()
        fresh = list(set().union(*counted).difference(self.tokens))
        if fresh:
            self._learn(fresh)
        out: list[np.ndarray | None] = []
        for c in counted:
            at = np.fromiter(map(self.tokens.__getitem__, c), np.int64, len(c))
            has_letter = self.letters[at].any()
            out.append(np.fromiter(c.values(), np.float64, len(c)) @ self.of_tokens[at] if has_letter else None)
        return out


def identify(
    docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """One row per row of ``docs``: ``_kept`` (a struct of the ``keep`` columns), ``_doc_id, _lang_pred, _score``.

    The lower-cased runs of letters of the whole text are scored under every language, each by the
    sum over all its segmentations into pieces (the forward algorithm), and multiplied. The most
    probable language, the first by name of equal ones, is ``_lang_pred`` and its share of the
    total probability ``_score``. A null text, or one without a letter, is ``und`` with score 0.
    Every row is judged alone, so repeated rows agree. An empty table gives an empty result.
    """
    # Plain values: a class of this package would be sent by name, which workers need not know.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.logs, {}))
    inside = text_col if text_col in keep else None
    read = [] if inside else [F.col(text_col).alias("_text")]
    named = docs.select(*packed(keep), F.col(id_col).alias("_doc_id"), *read)
    out = [c for c in named.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The tasks that one worker runs after another share its copy, and what it has learned so far.
        languages, pieces, logs, kept = shared.value
        scorer = kept["scorer"] = kept.get("scorer") or _Scorer(pieces, logs)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part["_kept"].field(inside) if inside else part["_text"]
                langs, scores = [], []
                for row in scorer.score(texts.to_pylist()):
                    if row is None or not len(row):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(row.argmax())
                    langs.append(languages[best])
                    scores.append(float(1 / np.exp(row - row[best]).sum()))
                columns = {name: part[name] for name in out}
                columns |= {"_lang_pred": pa.array(langs, pa.string()), "_score": pa.array(scores, pa.float64())}
                yield pa.RecordBatch.from_pydict(columns)

    schema = named.select(*out, F.lit("").alias("_lang_pred"), F.lit(0.0).alias("_score")).schema
    return named.mapInArrow(run, schema)


@register("op7_language")
def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select(
        F.col("_doc_id").alias("doc_id"),
        _held_out(F.col("_doc_id")).alias("held_out"),
        F.col("_lang_pred").alias("lang_pred"),
        F.col("_score").alias("score"),
    )
