"""Encoding a corpus with a public byte-level BPE vocabulary.

Method: a sentencepiece BPE model is serialised directly from the ranks of the vocabulary: every token is a piece whose
bytes are mapped to printable characters, its score is its negative rank, and nothing is normalised. Texts are cut into
pre-tokens by the vocabulary's pattern; each is byte-mapped and encoded, and ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabularies lie; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens whose ids a worker keeps; the oldest half is dropped when there are more.
KEPT = 200_000
#: Longer pre-tokens are encoded but not kept.
KEPT_LENGTH = 40
#: Characters of text whose pre-tokens a worker holds at a time; a longer text is held alone.
PIECE = 1 << 20


def byte_characters() -> list[str]:
    """A printable character for each byte: printable Latin-1 characters stand for themselves, the others take 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(others) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: text or message, integer, or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def sentencepiece_model(vocabulary: str = VOCABULARY) -> bytes:
    """The serialised model: piece i is the token of rank i; one unknown piece follows, which byte-mapped text never needs."""
    tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, Path(vocabulary).read_bytes().splitlines()))
    if [rank for rank, _ in tokens] != list(range(len(tokens))):
        raise ValueError("the ranks of the vocabulary must be 0, 1, 2, ...")
    letters = byte_characters()
    # Field numbers and enum values of the public sentencepiece model format.
    pieces = [_field(1, _field(1, "".join(letters[b] for b in token).encode()) + _field(2, -float(rank))) for rank, token in tokens]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(2, _field(3, 2) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1))
    normalizer = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return b"".join(pieces) + unknown + trainer + normalizer


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        self.letters = byte_characters()
        self.known: dict[str, list[int]] = {}
        self.by_letter = {c: b for b, c in enumerate(self.letters)}
        self.pieces: list[bytes] | None = None

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; null and empty texts have no ids. Every text is encoded whole; pre-tokens are held for
        PIECE characters of text, or one longer text, at a time."""
        counts, parts = [], []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= PIECE):
                size += len(texts[to] or "")
                to += 1
            for ids in self._encode_piece(texts[at:to]):
                counts.append(len(ids))
                parts.append(ids)
            at = to
        return np.concatenate([[0], np.cumsum(counts)]).astype("int64"), np.concatenate(parts) if parts else np.zeros(0, "int32")

    def _encode_piece(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.known) > KEPT:
            for old in list(self.known)[: KEPT // 2]:
                del self.known[old]
        known = self.known
        new = [p for p in {p for pre in cut for p in pre} if p not in known]
        table = self.letters
        mapped = [p if p.isascii() and p.isalnum() else "".join([table[b] for b in p.encode("utf-8", "surrogatepass")]) for p in new]
        known.update(zip(new, self.processor.encode(mapped, num_threads=1)))
        for pre in cut:
            flat: list[int] = []
            for p in pre:
                flat += known[p]
            yield np.asarray(flat, "int32")
        for p in new:
            if len(p) > KEPT_LENGTH:
                del known[p]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids. Bytes that are no UTF-8, as part of a character may be cut off, become U+FFFD."""
        if self.pieces is None:
            size = self.processor.get_piece_size() - 1  # the last piece is the unknown one
            self.pieces = [bytes(map(self.by_letter.__getitem__, self.processor.id_to_piece(i))) for i in range(size)]
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def _shared_model(df: DataFrame, vocabulary: str):
    """The model as a broadcast variable: it is as large as the vocabulary file, about 1 MB, whatever the corpus."""
    return df.sparkSession.sparkContext.broadcast(sentencepiece_model(vocabulary))


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """key and ids (array of int) of every document. Null and empty texts have the empty list. No shuffle; other columns are not read."""
    model = _shared_model(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            offsets, ids = codec.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(ids))], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, keys: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keys`` and n_tokens (0 for null and empty texts) of every document."""
    model = _shared_model(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            offsets, _ = codec.encode_batch(batch.column(len(keys)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(np.diff(offsets))], [*keys, "n_tokens"])

    kinds = [f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keys]
    return documents.select(*keys, text).mapInArrow(run, ", ".join([*kinds, "n_tokens bigint"]))


def decode(encoded: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """key and text of the ids; an empty or null list gives the empty text."""
    model = _shared_model(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")
