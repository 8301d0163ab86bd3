"""Cost-balanced packing of tokenized documents into sequences.

A document in a sequence costs a linear and a quadratic (attention) part. Tasks gather documents into
groups of a bounded number of tokens. A group has as many full sequences as its tokens fill, and for the
rest sequences of decreasing powers of two, which need no padding. Documents in descending order of cost
go to the sequence of lowest cost with room for them; where none has room, they are cut.
"""

from __future__ import annotations

import heapq
import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from repolens.llm.common import blocks, text_bytes

SEQUENCE_TOKENS = 2048
#: Tokens that are packed together.
GROUP_TOKENS = 1 << 20
#: Cost of a token, and of a pair of tokens of a document that attend to each other.
LINEAR, QUADRATIC = 2048.0, 1.0
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Words that are looked up together, and parts of words whose ids a Python worker remembers in each of two generations.
MET_WORDS, KNOWN_PARTS = 1 << 20, 150_000
#: Bytes of text whose new words are learnt in one call, and plain words that are encoded as one text.
LEARN_BYTES, JOINED_WORDS = 1 << 22, 1024
#: Bytes and texts that are encoded in one call: an encoding is many times larger than its text.
ENCODED_BYTES, ENCODED_TEXTS = 1 << 18, 1 << 12

# A word that ends in a letter and then marks: the pre-tokenizer always parts them there. The apostrophe is
# no such mark, as it starts contractions.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
# Two-byte letters are those from U+00C0 to U+00FF. A word of such letters is one pre-token.
_LATIN = np.isin(np.arange(256), [*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)])
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
# Special tokens are matched before anything else, and case changes what combining marks (lead bytes CC and
# CD) compose to: such words stay as they are.
_ODD = rb"<\||\xcc|\xcd"
#: How the vocabulary marks the last token of a word.
_WORD_END = "</w>"


def _runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` with these starts and lengths, one behind the other."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(starts - ends + lengths, lengths)
    return values[at]


def _texts(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Texts from their bytes, one behind the other."""
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class WordTokenizer:
    """Ids of texts by a tokenizer that lower-cases and whose words never span white space. Each different word
    of some megabytes of text is looked at once, in columns; its parts before and after the last letter are
    remembered."""

    def __init__(self, path: str, words: int = MET_WORDS, parts: int = KNOWN_PARTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[at for token, at in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self._parts = _Memory()
        self._words, self._most = words, parts

    @staticmethod
    def _split(words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Parts with the ids of each word: the first ones, whether there is a second, and the second ones."""
        odd = pc.match_substring_regex(words.view(pa.large_binary()), pattern=_ODD)
        low = pc.if_else(odd, words, pc.ascii_lower(words))
        head = pc.ascii_rtrim(low, characters=_MARKS)
        sizes, heads = (pc.binary_length(x).to_numpy() for x in (low, head))
        data = np.frombuffer(low.buffers()[2] or b"", np.uint8)
        starts = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low)]
        two = np.flatnonzero((heads > 0) & (sizes > heads) & ~odd.to_numpy(zero_copy_only=False))
        last = starts[two] + heads[two] - 1
        wide = (heads[two] > 1) & (data[last - 1] == 0xC3) & _LATIN[data[last]]
        two = two[wide | (data[last] >= ord("a")) & (data[last] <= ord("z"))]
        parted = np.zeros(len(low), bool)
        parted[two] = True
        marks = sizes[two] - heads[two]
        return pc.if_else(pa.array(parted), head, low), parted, _texts(_runs(data, starts[two] + heads[two], marks), marks)

    def _learn(self, parts: list[bytes]) -> None:
        known = self._parts
        new = [p for p in parts if p not in known and p not in known.old]
        plain = [p for p in new if p.isalpha() or _LETTERS.fullmatch(p)]
        others = list(set(new).difference(plain))
        joined = [plain[at : at + JOINED_WORDS] for at in range(0, len(plain), JOINED_WORDS)]
        for some, ids in zip(joined, self._encoded([b" ".join(j) for j in joined]), strict=True):
            ends = ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()
            if len(ends) == len(some):
                raw = ids.tobytes()
                known.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
            else:
                others += some
        known.update(zip(others, (ids.tobytes() for ids in self._encoded(others)), strict=True))

    def _encoded(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        some, size = [], 0
        for at, text in enumerate(texts, 1):
            some.append(text.decode("utf-8", "replace"))
            size += len(text)
            if at == len(texts) or size >= ENCODED_BYTES or len(some) >= ENCODED_TEXTS:
                yield from [np.array(e.ids, "<u4") for e in self._tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                some, size = [], 0

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one behind the other, and how many each has."""
        met = words.dictionary_encode()
        first, parted, second = self._split(met.dictionary)
        parts = pa.concat_arrays([first, second]).dictionary_encode()
        names = parts.dictionary.view(pa.large_binary()).to_pylist()
        self._learn(names)
        found = [self._parts[p] for p in names]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at, n = parts.indices.to_numpy(), len(first)
        in_order = np.insert(at[:n], np.flatnonzero(parted) + 1, at[n:])
        values = _runs(np.frombuffer(b"".join(found), "<u4"), (np.cumsum(sizes) - sizes)[in_order], sizes[in_order])
        counts = sizes[at[:n]]
        counts[parted] += sizes[at[n:]]
        each = met.indices.to_numpy()
        return _runs(values, (np.cumsum(counts) - counts)[each], counts[each]), counts[each]

    def ids(self, text: bytes) -> np.ndarray:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text; the words of about ``LEARN_BYTES`` of them that are new are learnt together."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held, size = [], 0
        for at, block in ((at, block) for at, text in enumerate(texts) for block in blocks(text)):
            held.append((at, block))
            size += len(block)
            if size >= LEARN_BYTES:
                self._add(held, out)
                held, size = [], 0
        self._add(held, out)
        return [np.concatenate(ids) if ids else np.zeros(0, "<u4") for ids in out]

    def _add(self, held: list[tuple[int, bytes]], out: list[list[np.ndarray]]) -> None:
        if not held:
            return
        split = pc.ascii_split_whitespace(pa.array([b for _, b in held], pa.large_binary()).view(pa.large_string()))
        words = split.flatten()
        found = []
        for at in range(0, len(words), self._words):
            if len(self._parts) > self._most:
                self._parts.age()
            found.append(self._ids(words.slice(at, self._words)))
        ids, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        ends = np.append(0, np.cumsum(counts))[split.offsets.to_numpy()]
        for (at, _), start, end in zip(held, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[at].append(ids[start:end])


class _Memory(dict):
    """What was used lately. When it grows too large it ages: what is used again comes over from before, the rest
    goes at the next time."""

    def __init__(self):
        super().__init__()
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, key: bytes) -> bytes:
        value = self[key] = self.old[key]
        return value

    def age(self) -> None:
        self.old = dict(self)
        self.clear()


def _tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, which keeps its memory from task to task."""
    kept = sys.modules.setdefault("_repolens_tokenizers", types.ModuleType("_repolens_tokenizers"))
    if path not in vars(kept):
        setattr(kept, path, WordTokenizer(path))
    return vars(kept)[path]


def cost(tokens: int) -> float:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def rooms(tokens: int, length: int = SEQUENCE_TOKENS) -> list[int]:
    """Lengths of the sequences that hold exactly so many tokens: full ones, then powers of two."""
    full, rest = divmod(tokens, length)
    return [length] * full + [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]


def assign(lengths: list[int], length: int = SEQUENCE_TOKENS) -> Iterator[tuple[int, int, int, int, int]]:
    """``document, start, tokens, sequence, offset`` of each piece; every token is in exactly one.

    Documents go by descending length to the sequence of lowest cost with room. One longer than a
    sequence gives whole sequences first. A piece with no room anywhere is cut to the room of the
    sequence of lowest cost.
    """
    room = np.array(rooms(sum(lengths), length), np.int64)
    used = np.zeros(len(room), np.int64)
    costs = np.zeros(len(room))
    pieces = [(-n, doc, 0) for doc, n in enumerate(lengths) if n]
    heapq.heapify(pieces)
    while pieces:
        size, doc, start = heapq.heappop(pieces)
        size = -size
        if size > length:
            heapq.heappush(pieces, (-(size - length), doc, start + length))
            size = length
        left = room - used
        seq = int(np.where(left >= size, costs, np.inf).argmin())
        if left[seq] < size:
            seq = int(np.where(left > 0, costs, np.inf).argmin())
            part = int(left[seq])
            heapq.heappush(pieces, (-(size - part), doc, start + part))
            size = part
        yield doc, start, size, seq, int(used[seq])
        used[seq] += size
        costs[seq] += cost(size)


_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id",
           length: int = SEQUENCE_TOKENS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers. A document is its ids and
    then ``END_ID``; a null or empty text has only that one. Sequences are filled from offset 0 without
    gaps; each is full or a power of two long. Rows that repeat a document are packed each. A group is
    packed when it has ``group_tokens`` tokens or its task ends, so a task holds one group and one
    document. sequence_id is unique, by task and group. Further columns are not read. Empty input: no rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        group: list[tuple[int, np.ndarray]] = []
        tokens, next_id = 0, TaskContext.get().partitionId() << 40
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = [len(ids) for _, ids in group]
            rows = [
                (group[d][0], start, n, group[d][1][start : start + n].tobytes(), sizes[d], next_id + seq, offset)
                for d, start, n, seq, offset in assign(sizes, length)
            ]
            for at in range(0, len(rows), 4096):
                columns = zip(*rows[at : at + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        def tokenized(batch: pa.RecordBatch, tokenizer: WordTokenizer) -> Iterator[tuple[int, np.ndarray]]:
            held, size = [], 0
            for doc, content in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                held.append((doc, content))
                size += len(content)
                if size >= LEARN_BYTES:
                    yield from ended(held, tokenizer)
                    held, size = [], 0
            yield from ended(held, tokenizer)

        def ended(held: list[tuple[int, bytes]], tokenizer: WordTokenizer) -> Iterator[tuple[int, np.ndarray]]:
            for (doc, _), ids in zip(held, tokenizer.ids_of([t for _, t in held]), strict=True):
                yield doc, np.append(ids, np.uint32(END_ID)).astype("<u4")

        for batch in batches:
            for doc, ids in tokenized(batch, tokenizer):
                group.append((doc, ids))
                tokens += len(ids)
                if tokens >= group_tokens:
                    yield from flush()
                    next_id += len(rooms(tokens, length))
                    group, tokens = [], 0
        if group:
            yield from flush()
        # The worker stays for later tasks; what it held goes back to the machine.
        pa.default_memory_pool().release_unused()

    named = docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text")
    return named.mapInArrow(pack, _SCHEMA)
