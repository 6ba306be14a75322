"""Byte-pair encoding of a whole corpus by a lazily determinised transducer.

The merges of a public byte-level vocabulary are compiled into a finite-state
transducer over bytes. A state is the last token that is certain, together
with the bytes read since; reading a byte either stays silent or emits the
tokens that no continuation can change. A boundary is certain once all
tokenisations that can still win pass through it, so the lookahead is bounded
by the length of the longest token. States and transitions are made when a
text first needs them and kept.

Rests on two properties of merges in rank order: a prefix of an encoding that
ends at a token boundary is the encoding of its bytes, and a sequence of tokens
is an encoding if each two neighbours are the encoding of their bytes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY_DIR = os.environ.get("KINETRAIL_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the pattern that splits texts before the merges of byte_bpe_50k.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words kept with their ids in each Python worker; beyond it the memory starts afresh.
WORD_MEMORY = 100_000
#: Characters from which a text is read piece by piece.
LONG_TEXT = 1_000_000
#: Transducer states kept in each Python worker; beyond it the memory starts afresh.
STATE_MEMORY = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a rank file: a base64 token and its rank a line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class MergeTransducer:
    """Bytes to token ids, exactly as merging in rank order gives them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        #: proper prefixes of tokens: what may still grow
        self.growing = {t[:i] for t in ranks for i in range(1, len(t))}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state is (certain token, bytes since); its row maps a byte to (state, ids)
        self._numbers: dict[tuple[bytes, bytes], int] = {(b"", b""): 0}
        self._keys: list[tuple[bytes, bytes]] = [(b"", b"")]
        self._rows: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self._ends: list[tuple[int, ...] | None] = [()]

    def merged(self, data: bytes) -> list[bytes]:
        """The definition: merge the neighbours of lowest rank, leftmost first, until none can."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stand(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay apart when their bytes are encoded together."""
        if not left:
            return self.merged(right) == [right]
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def _lasts(self, before: bytes, since: bytes) -> list[bytes | None]:
        """For each prefix of ``since``, the last token of its encoding after ``before``; None where it has none."""
        lasts: list[bytes | None] = [before]
        for end in range(1, len(since) + 1):
            found = None
            for start in range(max(0, end - self.longest), end):
                if lasts[start] is None:
                    continue
                token = since[start:end]
                if token in self.ranks and self._stand(lasts[start], token):
                    found = token
                    break
            lasts.append(found)
        return lasts

    @staticmethod
    def _cuts(lasts: list[bytes | None], end: int) -> list[int]:
        """Token boundaries on the way to ``end``, the start included."""
        cuts = [end]
        while end > 0:
            end -= len(lasts[end])
            cuts.append(end)
        return cuts[::-1]

    def _number(self, key: tuple[bytes, bytes]) -> int:
        n = self._numbers.get(key)
        if n is None:
            n = self._numbers[key] = len(self._keys)
            self._keys.append(key)
            self._rows.append({})
            self._ends.append(None)
        return n

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the transition: what is certain after one more byte, and what is left open."""
        before, since = self._keys[state]
        since += bytes([byte])
        lasts = self._lasts(before, since)
        size = len(since)
        # places where a token may begin that reaches beyond what was read
        alive = [size] if lasts[size] is not None else []
        alive += [
            i for i in range(max(0, size - self.longest), size) if lasts[i] is not None and since[i:] in self.growing
        ]
        certain = set(self._cuts(lasts, alive[0]))
        for i in alive[1:]:
            certain &= set(self._cuts(lasts, i))
        cut = max(certain)
        if cut == 0:
            made = (self._number((before, since)), ())
        else:
            cuts = self._cuts(lasts, cut)
            tokens = [since[a:b] for a, b in zip(cuts, cuts[1:])]
            made = (self._number((tokens[-1], since[cut:])), tuple(self.ranks[t] for t in tokens))
        self._rows[state][byte] = made
        return made

    def _end(self, state: int) -> tuple[int, ...]:
        before, since = self._keys[state]
        lasts = self._lasts(before, since)
        cuts = self._cuts(lasts, len(since))
        ids = self._ends[state] = tuple(self.ranks[since[a:b]] for a, b in zip(cuts, cuts[1:]))
        return ids

    def encode(self, data: bytes) -> list[int]:
        """Token ids of a byte string, read once from left to right."""
        if len(self._keys) > STATE_MEMORY:
            self._reset()
        out: list[int] = []
        rows, state = self._rows, 0
        for byte in data:
            step = rows[state].get(byte)
            if step is None:
                step = self._step(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        ends = self._ends[state]
        out += self._end(state) if ends is None else ends
        return out


class Utf8Decoder:
    """Incremental decoding of UTF-8: bytes in any pieces, whole characters out.

    Ill-formed input gives one replacement character for each maximal part of
    a character, as the Unicode standard recommends.
    """

    #: First continuation byte allowed after the lead bytes that restrict it (fixed values).
    LIMITS = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}

    def __init__(self) -> None:
        self.missing, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.missing:
                if self.low <= byte <= self.high:
                    self.value, self.low, self.high = self.value << 6 | byte & 0x3F, 0x80, 0xBF
                    self.missing -= 1
                    if not self.missing:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.missing, self.low, self.high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                self.missing = 1 + (byte >= 0xE0) + (byte >= 0xF0)
                self.value = byte & (0x3F >> self.missing)
                self.low, self.high = self.LIMITS.get(byte, (0x80, 0xBF))
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        """What an unfinished character at the end stands for."""
        left, self.missing, self.low, self.high = self.missing, 0, 0x80, 0xBF
        return "�" if left else ""


class Tokenizer:
    """Texts to ids and back with one vocabulary; special tokens are ordinary text."""

    _loaded: dict[str, Tokenizer] = {}

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.transducer = MergeTransducer(self.ranks)
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.pieces = regex.compile(PIECES)
        self.words: dict[str, list[int]] = {}

    @classmethod
    def load(cls, name: str, folder: str) -> Tokenizer:
        """Once a Python worker."""
        path = f"{folder}/{name}.tiktoken"
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for NULL and empty texts. Lone surrogates, which no column holds, count as a question mark."""
        if not text:
            return []
        words, out = self.words, []
        # of a very long text no list of pieces is made
        pieces = self.pieces.findall(text) if len(text) < LONG_TEXT else (m.group() for m in self.pieces.finditer(text))
        for piece in pieces:
            ids = words.get(piece)
            if ids is None:
                ids = self.transducer.encode(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(words) >= WORD_MEMORY:
                        words.clear()
                    words[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, decoded as a stream."""
        decoder = Utf8Decoder()
        return "".join([decoder.feed(self.bytes_of[i]) for i in ids] + [decoder.close()])


def encode_column(
    df: DataFrame, text: str, keep: list[str], name: str = "byte_bpe_50k", folder: str | None = None, out: str = "ids"
) -> DataFrame:
    """Columns ``keep`` and the token ids of ``text`` as ``out``, a list of integers.

    NULL and empty texts give an empty list; blank texts are encoded like any
    other. Only the kept columns and the text are read. Rows stay where they are:
    no shuffle, and a worker holds one Arrow batch.
    """
    folder = folder or VOCABULARY_DIR
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    source = df.select(*keep, df[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokenizer.load(name, folder)
        for batch in batches:
            for part in _slices(batch):
                ids = pa.array(map(coder.encode, part.column(len(keep)).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], ids], [*keep, out])

    return source.mapInArrow(run, schema)


def count_column(
    df: DataFrame, text: str, keep: list[str], name: str = "byte_bpe_50k", folder: str | None = None, out: str = "n_tokens"
) -> DataFrame:
    """Columns ``keep`` and the number of tokens of ``text`` as ``out``; 0 for NULL and empty texts."""
    folder = folder or VOCABULARY_DIR
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType(), False)])
    source = df.select(*keep, df[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokenizer.load(name, folder)
        for batch in batches:
            sizes = pa.array([len(coder.encode(t)) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes], [*keep, out])

    return source.mapInArrow(run, schema)


def decode_column(
    df: DataFrame, ids: str, keep: list[str], name: str = "byte_bpe_50k", folder: str | None = None, out: str = "text"
) -> DataFrame:
    """Columns ``keep`` and the text of a column of ids; NULL stays NULL."""
    folder = folder or VOCABULARY_DIR
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.StringType())])
    source = df.select(*keep, df[ids].alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokenizer.load(name, folder)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, out])

    return source.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that the lists of ids of one part are held at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
