"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to two bytes, with the counts of the bytes that follow,
gathered over all documents it learns from. A byte's probability under the longest context is its share
of the counts; a context not followed by it escapes to the next shorter one, with the probability of the
number of different bytes seen (method C), and bytes of the longer context are excluded there; below all
contexts, bytes are equally likely. Every byte value that occurs is a symbol of its own, but for letters
A-Z and white space, and one more stands for those that do not occur. The statistics are frozen, so the
code length of a byte after two others is a constant of the language. Those of the triples that any
language has are looked up; the others follow from tables of pairs, as a byte that escapes costs its
count in the shorter context and a constant of the longer one. A text's code length is their sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import text_bytes

#: Bytes coded at a time, places whose code lengths are looked up at a time, and places a task collects
#: before it counts them.
_BLOCK, _ROWS, _PENDING = 1 << 20, 1 << 12, 1 << 22
UNDECIDED = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # letters of either case are one symbol
_FOLD[9:14] = 32  # white space is a blank


class Escapes(NamedTuple):
    """A language's code lengths in bits of what no context of two has: the constant of the two bytes before
    if the last of them has the symbol, if only the empty context has it, and if nothing has; and what its
    count adds, infinite if there is none."""

    to_one: np.ndarray
    to_none: np.ndarray
    to_any: np.ndarray
    pair: np.ndarray
    single: np.ndarray

    def of(self, at: np.ndarray) -> np.ndarray:
        n = len(self.single)
        before, symbol = at // n, at % n
        pair, single = self.pair[before % n, symbol], self.single[symbol]
        alone = np.where(np.isfinite(single), self.to_none.ravel()[before] + single, self.to_any.ravel()[before])
        return np.where(np.isfinite(pair), self.to_one.ravel()[before] + pair, alone)


class Model:
    """Frozen code lengths in bits: ``seen[row, language]`` of the places ``at`` (of two symbols before and
    the symbol) that any language has, and each language's escapes for the others."""

    def __init__(self, languages: list[str], symbol_of: np.ndarray, at: np.ndarray, seen: np.ndarray, escapes: list[tuple[np.ndarray, ...]]):
        self.languages, self.symbol_of, self.at, self.seen = languages, symbol_of, at, seen
        self.escapes = [Escapes(*x) for x in escapes]
        self.symbols = len(self.escapes[0].single)
        self._row = np.full(self.symbols**3, -1, np.int32)
        self._row[at] = np.arange(len(at), dtype=np.int32)

    @property
    def bits(self) -> np.ndarray:
        """All code lengths, ``[language, before2, before1, symbol]``; large with many languages and symbols."""
        n = self.symbols
        every = np.stack([x.of(np.arange(n**3)) for x in self.escapes])
        every[:, self.at] = self.seen.T
        return every.reshape(-1, n, n, n)

    def lengths(self, text: bytes) -> np.ndarray:
        """Bits of the whole text in each language."""
        total = np.zeros(len(self.languages))
        for at in contexts(text, self.symbol_of, self.symbols):
            rows = self._row[at]
            new, rows = at[rows < 0], rows[rows >= 0]
            for start in range(0, len(rows), _ROWS):
                total += self.seen[rows[start : start + _ROWS]].sum(0, dtype=np.float64)
            if len(new):
                places, times = np.unique(new, return_counts=True)
                total += [x.of(places).astype(np.float64) @ times for x in self.escapes]
        return total


def contexts(text: bytes, symbol_of: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each byte the place of (two bytes before, byte) in a table of n x n x n, by blocks. A text
    starts after blanks."""
    blank = symbol_of[32]
    before = np.array([blank, blank], np.int32)
    for start in range(0, len(text), _BLOCK):
        symbols = symbol_of[np.frombuffer(text, np.uint8, min(_BLOCK, len(text) - start), start)]
        symbols = np.concatenate([before, symbols])
        yield (symbols[:-2] * n + symbols[1:-1]) * n + symbols[2:]
        before = symbols[-2:]


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol after each pair of symbols, from their counts; method C with exclusion."""
    n = counts.shape[-1]
    p = np.zeros(counts.shape)
    free = np.ones(counts.shape, bool)  # symbols no longer context has
    escape = np.ones((n, n, 1))
    for tree in (counts, counts.sum(0)[None], counts.sum((0, 1))[None, None]):
        seen = np.where(free, tree, 0)
        total, kinds = seen.sum(-1, keepdims=True), (seen > 0).sum(-1, keepdims=True)
        rest = (free & (seen == 0)).any(-1, keepdims=True)
        # Nothing is left to escape to once all symbols are known.
        size = np.maximum(total + np.where(rest, kinds, 0), 1)
        p = np.where(seen > 0, escape * seen / size, p)
        escape = np.where(total > 0, escape * np.where(rest, kinds, 0) / size, escape)
        free &= seen == 0
    p = np.where(free, escape / np.maximum(free.sum(-1, keepdims=True), 1), p)
    return -np.log2(p)


def sparse_code_lengths(at: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, Escapes]:
    """What :func:`code_lengths` gives, from the places that occur and their counts: the bits of these
    places, and the escapes for all others. A symbol of a context is one of its shorter contexts, too, so
    what is excluded there depends on the context alone."""
    two, symbol = at // n, at % n
    one = two % n
    pairs = np.bincount(one * n + symbol, counts, n * n).reshape(n, n)
    singles = pairs.sum(0)

    def escape(total: np.ndarray, kinds: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of contexts and probabilities to escape, with ``left`` symbols that they lack."""
        kinds = np.where(left > 0, kinds, 0)
        size = np.maximum(total + kinds, 1)
        return size, np.where(total > 0, kinds / size, 1)

    kinds_two = np.bincount(two, minlength=n * n).reshape(n, n)
    kinds_one, kinds_none = (pairs > 0).sum(1), int((singles > 0).sum())
    size_two, out_two = escape(np.bincount(two, counts, n * n).reshape(n, n), kinds_two, n - kinds_two)
    known = np.bincount(two, pairs[one, symbol], n * n).reshape(n, n)
    size_one, out_one = escape(pairs.sum(1) - known, kinds_one - kinds_two, np.broadcast_to(n - kinds_one, (n, n)))
    size_none, out_none = escape(singles.sum() - (pairs > 0) @ singles, kinds_none - kinds_one, np.full(n, n - kinds_none))
    with np.errstate(divide="ignore"):
        to_one = np.log2(size_one) - np.log2(out_two)
        to_none = np.log2(size_none) - np.log2(out_two * out_one)
        to_any = np.log2(max(n - kinds_none, 1)) - np.log2(out_two * out_one * out_none)
        escapes = (to_one, to_none, to_any, -np.log2(pairs), -np.log2(singles))
    escapes = [np.where(np.isnan(x) | (x == -np.inf), np.inf, x).astype(np.float32) for x in escapes]
    return np.log2(size_two.ravel()[two]) - np.log2(counts), Escapes(*escapes)


def learn(texts: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """The model of all rows with a text and a language, None if there are none; of every language there is.

    Two passes over all rows: bytes per language, then contexts. Tasks send sums, a row for
    each triple of symbols that occurs in a language; the model has a code length for each language and
    triple of any.
    """
    rows = texts.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                seen = sums.setdefault(name, np.zeros(256, np.int64))
                for at in range(0, len(content), _BLOCK):
                    seen += np.bincount(np.frombuffer(content, np.uint8, min(_BLOCK, len(content) - at), at), minlength=256)
        for name, seen in sums.items():
            used = np.flatnonzero(seen)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name] * (len(used) + 1)), "byte": pa.array([-1, *used.tolist()], pa.int32()),
                "n": pa.array([0, *seen[used].tolist()], pa.int64()),
            })

    found = rows.mapInArrow(histogram, "lang string, byte int, n long").groupBy("lang", "byte").agg(F.sum("n").alias("n"))
    languages = sorted(r.lang for r in found.where("byte = -1").collect())
    if not languages:
        return None
    folded = np.zeros(256, np.int64)
    for r in found.where("byte >= 0").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        folded[_FOLD[r.byte]] += r.n
    folded[32] += 1  # the blank has a symbol
    used = np.flatnonzero(folded)
    symbol_of = np.full(256, len(used), np.int32)
    symbol_of[used] = np.arange(len(used))
    symbol_of, n = symbol_of[_FOLD], len(used) + 1
    place = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        pending: dict[str, list[np.ndarray]] = {}
        waiting = 0

        def add_up() -> None:
            for name, parts in pending.items():
                at, times = np.unique(np.concatenate(parts), return_counts=True)
                if name in sums:
                    both = np.concatenate([sums[name][0], at])
                    at, group = np.unique(both, return_inverse=True)
                    times = np.bincount(group, np.concatenate([sums[name][1], times])).astype(np.int64)
                sums[name] = at, times
            pending.clear()

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                for at in contexts(content, symbol_of, n):
                    pending.setdefault(name, []).append(at)
                    waiting += len(at)
                    if waiting >= _PENDING:
                        add_up()
                        waiting = 0
        add_up()
        for name, (at, times) in sums.items():
            yield pa.RecordBatch.from_pydict({
                "language": pa.array(np.full(len(at), place[name], np.int32)), "at": pa.array(at.astype(np.int32)), "n": pa.array(times),
            })

    summed = rows.mapInArrow(count, "language int, at int, n long").groupBy("language", "at").agg(F.sum("n").alias("n"))
    got = summed.toArrow()
    language, found_at, times = (got[c].to_numpy() for c in ("language", "at", "n"))
    at = np.unique(found_at)
    seen, escapes = np.empty((len(at), len(languages)), np.float32), []
    for i in range(len(languages)):
        own = found_at[language == i]
        bits, escape = sparse_code_lengths(own, times[language == i], n)
        seen[:, i] = escape.of(at)
        seen[np.searchsorted(at, own), i] = bits
        escapes.append(escape)
    return Model(languages, symbol_of, at, seen, escapes)


def with_language(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of the shortest code and its score from 0 to 1.

    The score is the language's probability if each is as likely and a text of n bytes weighs as much
    as its square root of bytes, for neighbouring bytes tell much the same. Ties go to the first name.
    A text that is null or has no letter, and every text without a model, is ``und`` with score 0.
    Columns named ``lang`` and ``score`` are replaced.
    """

    # Broadcast values travel as plain data, without the code of their class.
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.languages, model.symbol_of, model.at, model.seen, [tuple(x) for x in model.escapes]))

    @F.arrow_udf("lang string, score double")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value and Model(*shared.value)
        for texts in batches:
            yield named(model, texts)

    def named(model: Model | None, texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for content in text_bytes(texts):
            if model is None or not any(map(str.isalpha, content.decode("utf-8", "replace"))):
                names.append(UNDECIDED)
                scores.append(0.0)
                continue
            bits = model.lengths(content)
            best = int(bits.argmin())
            names.append(model.languages[best])
            scores.append(float(1 / np.exp2(np.maximum((bits[best] - bits) / len(content) ** 0.5, -1000)).sum()))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    # What follows may ask for the language in filters, too: the optimizer must not copy the function there, as each
    # copy scores every text again, in Python workers of its own.
    found = identify.asNondeterministic()(F.col(text))
    return docs.withColumn(lang, found).withColumns({score: F.col(f"{lang}.score"), lang: F.col(f"{lang}.lang")})
