"""Toxicity by compression distance with zstandard dictionaries.

One dictionary is trained on toxic text and one on ordinary text. Both compress the same windows (runs of
letters); a window that is shorter under the toxic dictionary by enough speaks for toxicity. Toxic
documents are mostly ordinary prose, so the toxic dictionary is trained on what they say more often: words
whose beginnings stand often in toxic documents and hardly ever in ordinary ones. Places of toxic documents
with the same words around them count once, as copies of a passage repeat what it says; a fixed phrase
stands among other words each time. How much shorter is enough is calibrated on the whole texts of labelled
documents: a logistic regression over the counts of windows at each threshold. Every window of a text is
compressed with both, when calibrating as when scoring.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import blocks, stored, text_bytes

#: Labelled documents of each kind to learn from, and bytes of a document that train dictionaries at most, in passages
#: drawn from its whole text.
SAMPLE, SAMPLE_BYTES, PASSAGE = 3000, 1 << 16, 1 << 11
#: Bytes of the ordinary dictionary, and of the toxic one at least: that one has room for a sample of each of its words.
DICTIONARY_BYTES = 112640
#: About so many words, drawn by hash from all ordinary documents of the sample, train their dictionary.
ORDINARY_WORDS = 1_000_000
#: Lengths of word beginnings that are compared, shorter words being compared whole; how much more often
#: toxic documents have one, and how unlikely (in nats, by the Chernoff bound) their number would be if it
#: were as likely in either kind.
BEGINNINGS, TIMES, SURPRISE = (4, 5, 6), 8, 16.0
#: Words on either side by which copies are told.
AROUND = 4
#: Bytes less under the toxic dictionary, and bytes there at most.
GAINS, MOST = (1, 2, 3, 4, 5), (1, 2, 3, 4, 5)
#: Windows a task remembers.
KNOWN = 500_000
#: Stands before each window in either dictionary's language, so that the shortest windows are compressed at all.
LEAD = b"the quick brown fox jumps over it: "
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_GRAM = 4


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The windows of a text, by blocks: runs of letters, A-Z in lower case."""
    for block in blocks(text):
        yield _WORD.findall(block.lower())


def _beginnings(word: bytes) -> list[bytes]:
    return [word[:k] for k in BEGINNINGS if len(word) >= k] or [word + b" "]


def _params(size: int) -> zstandard.ZstdCompressionParameters:
    """For a dictionary of ``size`` bytes: the search tree holds 2^(chain_log - 1) places, the last ones."""
    log = min(max(18, (size + 1024).bit_length()), 28)
    return zstandard.ZstdCompressionParameters(
        window_log=log, chain_log=log + 1, hash_log=log, search_log=7, min_match=3, target_length=999,
        strategy=zstandard.STRATEGY_BTULTRA2, write_content_size=False, write_checksum=False, write_dict_id=False,
    )


def _train(size: int, words: list[bytes]) -> bytes:
    """A dictionary trained on windows of the words; only the lead if they are too few to train on. The lead
    is part of the samples, as the costs of literals and matches are those of the samples."""
    try:
        return zstandard.train_dictionary(size, [LEAD + w + b" " for w in words]).as_bytes()
    except zstandard.ZstdError:
        return LEAD


def _train_whole(words: list[bytes]) -> bytes:
    """A dictionary that has every one of the words, those that training leaves out behind the others."""
    distinct = sorted(set(words))
    trained = _train(max(DICTIONARY_BYTES, sum(len(LEAD) + len(w) + 1 for w in distinct)), words)
    there = set(trained.split(b" "))
    return trained + b" " + b"".join(w + b" " for w in distinct if w not in there)


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    bias: float
    short: tuple[bytes, ...] = ()


class Distances:
    """Bytes of a window under the ordinary and the toxic dictionary, beyond those of the lead."""

    def __init__(self, toxic: bytes, ordinary: bytes, short: tuple[bytes, ...] = ()):
        self._compress = [self._compressor(x) for x in (ordinary, toxic)]
        self._lead = [len(c(LEAD)) for c in self._compress]
        self._known: dict[bytes, tuple[int, int]] = {}
        self._grams = np.zeros(1 << 20, bool)
        lead, plain = set(_WORD.findall(LEAD)), self._grams_of(_WORD.findall(ordinary.lower()))
        own = self._grams_of([w for w in _WORD.findall(toxic.lower()) if w not in lead]) - plain
        if own:
            joined = np.frombuffer(b"".join(sorted(own)), np.uint8).astype(np.uint32)
            self._grams[self._places(joined)[::_GRAM]] = True
        letter = rb"[a-z\x80-\xff]"
        self._short = short and re.compile(rb"(?<!%b)(?:%b)(?!%b)" % (letter, b"|".join(map(re.escape, short)), letter))

    @staticmethod
    def _grams_of(words: list[bytes]) -> set[bytes]:
        return {w[i : i + _GRAM] for w in words for i in range(len(w) - _GRAM + 1)}

    @staticmethod
    def _compressor(content: bytes):
        trained = zstandard.ZstdCompressionDict(content)
        if not trained.dict_id():
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = _params(len(content))
        trained.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=trained, compression_params=params).compress

    @staticmethod
    def _places(x: np.ndarray) -> np.ndarray:
        joined = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
        return (joined * np.uint32(2654435761)) >> np.uint32(12)

    def candidates(self, block: bytes) -> Iterator[bytes]:
        """Words that share four letters in a row with the toxic dictionary which the ordinary one lacks,
        and the toxic words of fewer letters: those a match of their own makes shorter. Scores are of all windows.
        """
        low = block.lower()
        if self._short:
            yield from self._short.findall(low)
        x = np.frombuffer(low, np.uint8).astype(np.uint32)
        if len(x) < _GRAM:
            return
        end = 0
        for at in np.flatnonzero(self._grams[self._places(x)]).tolist():
            if at < end:
                continue
            start = at
            while start > end and (97 <= low[start - 1] <= 122 or low[start - 1] >= 128):
                start -= 1
            word = _WORD.match(low, start)
            if word:
                end = word.end()
                yield word.group()

    def of(self, word: bytes) -> tuple[int, int]:
        got = self._known.get(word)
        if got is None:
            if len(self._known) > KNOWN:
                self._known.clear()
            ordinary, toxic = (len(c(LEAD + word + b" ")) - base for c, base in zip(self._compress, self._lead, strict=True))
            got = self._known[word] = (ordinary, toxic)
        return got

    def features(self, text: bytes) -> np.ndarray:
        """For each pair of thresholds whether any window passes, how many, and their share of the text."""
        counts = Counter()
        size = 0
        for block in blocks(text):
            size += len(block)
            for word, n in Counter(_WORD.findall(block.lower())).items():
                counts[self.of(word)] += n
        passing = np.array([
            sum(n for (ordinary, toxic), n in counts.items() if ordinary - toxic >= gain and toxic <= most)
            for gain in GAINS for most in MOST
        ], np.float64)
        return np.concatenate([passing > 0, np.log1p(passing), np.sqrt(passing / max(size, 1) * 100)])


def toxic_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The words of the toxic texts whose beginnings set them apart, as often as they stand there."""
    counts = [Counter(), Counter()]
    for found, texts in zip(counts, (toxic, ordinary), strict=True):
        for text in texts:
            for block in words_of(text):
                for word, n in Counter(block).items():
                    for start in _beginnings(word):
                        found[start] += n
    sizes = [found.total() for found in counts]
    share, ratio = sizes[0] / max(sum(sizes), 1), TIMES * sizes[0] / max(sizes[1], 1)

    def apart(here: int, there: int) -> bool:
        q = here / (here + there)
        surprise = here * np.log(q / share) + (there * np.log((1 - q) / (1 - share)) if there else 0)
        return here > ratio * there and q > share and surprise >= SURPRISE

    likely = {start for start, here in counts[0].items() if apart(here, counts[1][start])}
    surroundings: dict[bytes, set[int]] = {start: set() for start in likely}
    for text in toxic:
        words = [word for block in words_of(text) for word in block]
        for i, word in enumerate(words):
            for start in likely.intersection(_beginnings(word)):
                surroundings[start].add(hash((*words[max(i - AROUND, 0) : i], None, *words[i + 1 : i + 1 + AROUND])))
    beginnings = {start for start, places in surroundings.items() if apart(len(places), counts[1][start])}
    return [w for text in toxic for block in words_of(text) for w in block if not beginnings.isdisjoint(_beginnings(w))]


def ordinary_words(ordinary: list[bytes], most: int = ORDINARY_WORDS) -> list[bytes]:
    """The words of the ordinary texts, each as often as it stands there; of more than ``most``, about as
    many, drawn by hash from all of them alike. In the order of their hashes."""
    counts = Counter(word for text in ordinary for block in words_of(text) for word in block)
    bound = (1 << 32) * min(1.0, most / max(counts.total(), 1))
    places = ((zlib.crc32(word + b" %d" % i), word) for word, n in counts.items() for i in range(n))
    return [word for place, word in sorted(x for x in places if x[0] < bound)]


def _regress(x: np.ndarray, y: np.ndarray, steps: int = 3000, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, steps + 1):
        error = 1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60))) - y
        g = np.append(x.T @ error / len(y) + decay * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes, tuple[bytes, ...]]:
    """The toxic and the ordinary dictionary, and the toxic words of few letters; repeated texts count once."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    words = toxic_words(toxic, ordinary)
    apart = set(words)  # their few places in ordinary texts do not make them ordinary words
    plain = [w for w in ordinary_words(ordinary, ORDINARY_WORDS) if w not in apart]
    return _train_whole(words), _train(DICTIONARY_BYTES, plain), tuple(sorted({w for w in words if len(w) < _GRAM}))


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """Dictionaries and thresholds from the texts of each kind; repeated texts count once."""
    bad, good, short = dictionaries(toxic, ordinary)
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    distances = Distances(bad, good, short)
    x = np.stack([distances.features(t) for t in toxic + ordinary])
    weights, bias = _regress(x, np.array([1.0] * len(toxic) + [0.0] * len(ordinary)))
    return Model(bad, good, weights, bias, short)


def passages(text: bytes, most: int) -> bytes:
    """A text of at most ``most`` bytes as it is; of a longer one, passages drawn by hash from the whole of it,
    of about so many bytes. A word of many passages is cut."""
    if len(text) <= most:
        return text
    parts = [part[i : i + 2 * PASSAGE] for part in blocks(text, PASSAGE) for i in range(0, len(part), 2 * PASSAGE)]
    kept, left = [], most
    seed = zlib.crc32(text)
    for i in sorted(range(len(parts)), key=lambda i: zlib.crc32(b"%d" % i, seed)):
        if len(parts[i]) <= left:
            kept.append(i)
            left -= len(parts[i])
        if left < PASSAGE // 2:
            break
    return b" ".join(parts[i] for i in sorted(kept))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE,
          sample_bytes: int = SAMPLE_BYTES, text: str = "text", doc_id: str = "doc_id") -> Model | float:
    """The model of at most ``sample`` labelled documents of each kind, drawn by hash of their ids. Dictionaries are
    trained, of longer ones than ``sample_bytes``, on about so many bytes of passages from the whole text; thresholds
    are calibrated by tasks on every window of the whole texts. With labels of one kind only, or none, a number: the
    share of ones, or 0. Labels other than 0 and 1 and null ids are not used; of documents that repeat an
    id, each has its label; repeated texts count once."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).where("y in (0, 1) and id is not null").distinct()
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    drawn = stored(drawn[0].unionByName(drawn[1]), "drawn")
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(drawn, F.col("doc") == F.col("id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [passages(x, sample_bytes) for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], ["y", "t"])

    texts = texts.select(F.col("y").cast("int").alias("y"), "text")
    got = texts.mapInArrow(cut, "y int, t binary").toArrow()
    toxic, ordinary = (sorted(t for t, kind in zip(got["t"].to_pylist(), got["y"].to_pylist(), strict=True) if kind == y) for y in (1, 0))
    if not toxic or not ordinary:
        return 1.0 if toxic else 0.0
    trained = dictionaries(toxic, ordinary)
    shared = docs.sparkSession.sparkContext.broadcast(trained)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = None
        for batch in batches:
            distances = distances or Distances(*shared.value)
            rows = [(hashlib.sha256(x).digest(), distances.features(x).tolist()) for x in text_bytes(batch.column(1))]
            columns = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["y", "h", "x"])

    # The sample may lie in a few files only, so its texts are dealt anew.
    spread = texts.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    got = spread.mapInArrow(measure, "y int, h binary, x array<double>").toArrow().to_pydict()
    seen = {(1 - y, h): x for y, h, x in zip(got["y"], got["h"], got["x"], strict=True)}
    weights, bias = _regress(np.array([seen[k] for k in sorted(seen)]), np.array([1.0 - k[0] for k in sorted(seen)]))
    return Model(trained[0], trained[1], weights, bias, trained[2])


def with_toxicity(docs: DataFrame, model: Model | float, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text from 0 to 1, higher for toxic. A null counts as an empty
    text, which has no window. A column named ``name`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model if isinstance(model, float) else tuple(model))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        got = shared.value
        distances = None if isinstance(got, float) else Distances(got[0], got[1], got[4])
        for texts in batches:
            if distances is None:
                yield pa.array([got] * len(texts), pa.float64())
                continue
            logits = [float(distances.features(x) @ got[2]) + got[3] for x in text_bytes(texts)]
            yield pa.array([float(1 / (1 + np.exp(-min(max(x, -60), 60)))) for x in logits], pa.float64())

    return docs.withColumn(name, score(F.col(text)))
