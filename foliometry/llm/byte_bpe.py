"""Byte-level BPE encoding and decoding through a sentencepiece model that is written straight from a vocabulary of ranks.

No tokenizer is trained. The vocabulary gives byte strings with ranks; each byte becomes one letter (U+0100 and on), so every
entry is a piece of letters, its score is its negative rank, and normalisation is the identity. Such a model merges, as rank
BPE does, the neighbours whose joined piece has the lowest rank, the leftmost first. Texts are cut into pre-tokens by the
pattern; a pre-token that is an entry itself is that entry, any other goes to the model. Decoding lays the bytes of the ids
end to end.

Pre-tokens are looked up in a bounded store of a task, so each distinct one is encoded once; there is no shuffle, and a task
needs memory for one slice of texts and the store. A lost executor costs its own partitions.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows and rows with null or shared ids each
have their own row; long texts are encoded whole, a stretch of pre-tokens at a time; characters that the pattern does not
match have no ids; an id outside the vocabulary cannot be decoded and is an error; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import codecs
import struct
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.llm.common import slices, texts_of
from foliometry.llm.gather import WordIds, bounds_of, byte_runs, matches

#: Ids that are decoded at a time.
MOST_IDS = 1 << 18

# Field numbers and values of sentencepiece's model format (fixed values).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
NORMAL, UNKNOWN, UNUSED = 1, 2, 5
MODEL_TYPE, VOCAB_SIZE, BPE = 3, 4, 2
NORMALIZER_NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5

#: The letter of each byte.
LETTERS = "".join(chr(0x100 + b) for b in range(256))


def letters(raw: bytes) -> str:
    return codecs.charmap_decode(raw, "strict", LETTERS)[0]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, raw: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


def _piece(text: str, score: float, kind: int) -> bytes:
    score_field = _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", score)
    return _block(PIECES, _block(PIECE_TEXT, text.encode()) + score_field + _number(PIECE_TYPE, kind))


def read_ranks(path: str) -> dict[bytes, int]:
    """The entries of a rank file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(raw): int(rank) for raw, rank in (line.split() for line in f if line.strip())}


def model_of(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks. Ranks without an entry become unused pieces; one unknown piece comes last."""
    by_rank = {rank: raw for raw, rank in ranks.items()}
    size = max(by_rank) + 1
    pieces = [_piece(letters(by_rank[k]), -float(k), NORMAL) if k in by_rank else _piece(f"\u2400{k}", -float(k), UNUSED) for k in range(size)]
    pieces.append(_piece("\u2401", 0.0, UNKNOWN))
    trainer = _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, size + 1)
    identity = _block(NORMALIZER_NAME, b"identity") + b"".join(_number(f, 0) for f in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES))
    return b"".join(pieces) + _block(TRAINER, trainer) + _block(NORMALIZER, identity)


class Decoder:
    """Bytes of ids under one vocabulary."""

    def __init__(self, path: str) -> None:
        by_rank = {rank: raw for raw, rank in read_ranks(path).items()}
        size = max(by_rank) + 1
        self.bytes = byte_runs([by_rank.get(k, b"") for k in range(size)])
        self.known_ids = np.array([k in by_rank for k in range(size)])

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows of ids, and where each row's bytes begin and end."""
        if not ((ids >= 0) & (ids < len(self.known_ids))).all() or not self.known_ids[ids].all():
            raise ValueError("an id is outside the vocabulary")
        raw, lengths = self.bytes.gather(ids)
        return raw, bounds_of(lengths)[bounds]


class Encoder:
    """Ids of texts under one vocabulary and one pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from sentencepiece import SentencePieceProcessor

        self.ranks = read_ranks(path)
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"not a byte-level vocabulary: bytes {missing} have no rank")
        self.model = SentencePieceProcessor(model_proto=model_of(self.ranks))
        self.encode = WordIds(matches(regex.compile(pattern)), self._encode)  # texts to ids and bounds
        self.by_word = WordIds(matches(regex.compile(pattern)), self._encode)
        size = max(self.ranks.values()) + 1
        by_rank = {rank: raw for raw, rank in self.ranks.items()}
        self.bytes = byte_runs([by_rank.get(k, b"") for k in range(size)])
        self.known_ids = np.array([k in by_rank for k in range(size)])

    def _encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        raws = [w.encode() for w in words]
        whole = [self.ranks.get(raw) for raw in raws]
        rest = iter(self.model.encode([letters(raw) for raw, k in zip(raws, whole, strict=True) if k is None], num_threads=1))
        return [next(rest) if k is None else [k] for k in whole]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text by text, and where each text's ids begin and end."""
        return self.by_word(texts)


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, pattern)


@cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _encoding(path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, bounds = encoder(path, pattern)(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return run


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the lists of this column have about MOST_IDS values together; a longer list is a batch of its own."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(column)), 0))
    part = np.cumsum(sizes, dtype=np.int64) // MOST_IDS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    return (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)


def _decoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole, "ids")):
            column = pc.fill_null(batch.column("ids"), [])
            offsets = np.asarray(column.offsets).astype(np.int64)
            raw, bounds = decoder(path)(np.asarray(column.flatten()), offsets - offsets[0])
            decoded = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded.cast(pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int), a row for each row of docs. ranks: path of a rank file."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encoding(ranks, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, ids) with the bytes of the ids as decoded."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoding(ranks), "doc_id long, ids array<int>, decoded binary")


def query(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Digests of each document's ids and of their decoded bytes."""
    import public_tokenizers

    ranks, pattern = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    decoded = decode(encode(docs, ranks, pattern), ranks)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
