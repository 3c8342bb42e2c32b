"""Packing of tokenised examples into fixed-length sequences: vector bin packing by the dot-product heuristic.

An example has three sizes: tokens, segments and loss-bearing tokens; a sequence has a limit for each. The open sequence
takes, from a window of waiting examples, the one whose size vector has the largest dot product with what is left (each
measured against its limit), so examples that use what is plentiful go first. Where examples may be cut, the chosen one is
cut to what is left, and what remains at the end of a task is cut at powers of two, which need no padding.

Each task packs the rows of its own partition in one pass: no shuffle, memory for one window of examples, and a lost
executor costs its own partitions only. Sequence ids are the partition's number and a counter within it, so they are
unique; they depend on how the input is split.

Defined results: a null text counts as empty; an empty text is the end token alone; an example longer than a sequence is
cut into several (with cut=False it is a failure); repeated rows are packed as often as they occur; an empty table
gives an empty result.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, repeat
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliometry.llm.common import slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Waiting examples among which the heuristic chooses, and words of which a worker remembers the ids (about 600 bytes each; fewer cost time only).
WINDOW, MOST_WORDS = 128, 800_000


@cache
def _tokenizer(path: str) -> Any:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """a, with room for at least n entries."""
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def _stays_letters(word: str) -> bool:
    """Whether a run of letters is one after normalisation, which takes some (U+0130, U+095E) apart into letter and mark."""
    return word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha()


class Encoder:
    """Token ids of texts. The vocabulary's rules never reach over a blank, so ids are looked up word by word.

    That holds for tokenizers that drop white space, whose normalisation never joins characters over a blank and that mark
    word ends with </w>. A word may have several word ends (normalisation can take a letter apart into a letter and a mark).
    Texts that may hold a special token's string go to the tokenizer whole.
    """

    def __init__(self, path: str, end_id: int, most_words: int = MOST_WORDS) -> None:
        self.tokenizer, self.end_id, self.most_words = _tokenizer(path), end_id, most_words
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.used = 0
        self.pool, self.starts, self.lengths = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _store(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, k = len(self.place), len(words)
        self.pool = _grown(self.pool, self.used + len(ids))
        self.starts, self.lengths = _grown(self.starts, n + k), _grown(self.lengths, n + k)
        self.pool[self.used : self.used + len(ids)] = ids
        self.lengths[n : n + k] = lengths
        self.starts[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.place.update(zip(words, range(n, n + k), strict=True))

    def _store_each(self, words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self._store(words, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the known words at these places, one word after the other, and each word's number of ids."""
        n = self.lengths[at]
        ends = np.cumsum(n)
        return self.pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[at] - (ends - n), n)], n

    def _learn(self, words: set[str]) -> bool:
        """Adds words that are not known; False if the store was full and has been emptied instead."""
        if self.place and len(self.place) + len(words) > self.most_words:
            self._clear()
            return False
        known = self.place
        whole = {w for w in words if w.isalpha() and _stays_letters(w)}
        tailed = [w for w in words - whole if w[-1] in ".,!|" and (b := w[:-1]).isalpha() and _stays_letters(b)]
        letters = list(whole.union(b for w in tailed if (b := w[:-1]) not in known))
        for i in range(0, len(letters), 4096):  # runs of letters, each of which ends with one word-end id
            part = letters[i : i + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(part):
                self._store(part, ids, np.diff(ends, prepend=0))
            else:  # a letter of these that normalisation takes apart ends a word early: each word by itself
                self._store_each(part)
        rest = list((words - whole).difference(tailed).union(c for c in ".,!|" if c not in known))
        self._store_each(rest)
        pairs = np.array([[known[w[:-1]], known[w[-1]]] for w in tailed], np.int64).reshape(-1)
        ids, n = self._gather(pairs)
        self._store(tailed, ids, n.reshape(-1, 2).sum(axis=1))
        return True

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        whole = {i for i, t in enumerate(texts) if "<|" in t}
        words = [[] if i in whole else (t.lower() if t.isascii() else t).replace("\n", " ").split(" ") for i, t in enumerate(texts)]
        flat = [w for ws in words for w in ws if w]
        counts = np.array([len(ws) - ws.count("") for ws in words], np.int64)
        at = np.fromiter(map(self.place.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = [flat[i] for i in missing]
            if not self._learn(set(new)):  # the store began anew
                self._learn(set(flat))
                new, missing = flat, range(len(flat))
            at[missing] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        ids, n = self._gather(at)
        bounds = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        end = np.array([self.end_id], np.uint32)
        out = [np.concatenate([ids[i:j], end]) for i, j in zip(bounds, bounds[1:], strict=False)]
        for i in whole:
            out[i] = np.array([*self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.end_id], np.uint32)
        return out


@cache
def _encoder(path: str, end_id: int, most_words: int) -> Encoder:
    """One for each Python worker, so that its words serve all tasks of the worker."""
    return Encoder(path, end_id, most_words)


class Packer:
    """Places examples (key, tokens, loss) into sequences; pieces come out as (key, start, length, sequence, offset)."""

    def __init__(self, most_tokens: int, most_segments: int, most_loss: int, cut: bool = True, first: int = 0) -> None:
        self.limit = np.array([most_tokens, most_segments, most_loss], float)
        self.cut, self.sequence = cut, first
        self.left, self.offset = self.limit.copy(), 0
        self.keys: list[Any] = []
        self.starts: list[int] = []
        self.table = np.zeros((WINDOW + 1, 3))  # sizes of the waiting examples, in the order of keys
        self.pieces: list[tuple[Any, int, int, int, int]] = []

    def add(self, key: Any, tokens: int, loss: int) -> None:
        """A new example; the window is brought down to its size first."""
        if not self.cut and (tokens > self.limit[0] or loss > self.limit[2]):
            raise ValueError(f"an example of {tokens} tokens, {loss} with loss, fits in no sequence")
        self.table[len(self.keys)] = tokens, 1, loss
        self.keys.append(key)
        self.starts.append(0)
        while len(self.keys) > WINDOW:
            self._place()

    @property
    def sizes(self) -> np.ndarray:
        return self.table[: len(self.keys)]

    def _new(self) -> None:
        self.sequence += 1
        self.left, self.offset = self.limit.copy(), 0

    def _place(self, most: int | None = None) -> None:
        sizes = self.sizes
        fits = (sizes <= self.left).all(axis=1)
        gain = sizes @ (self.left / self.limit**2)
        if fits.any():
            i = int(np.argmax(np.where(fits, gain, -1)))
            n = int(sizes[i, 0])
        elif self.cut and (self.left >= 1).all():
            i = int(np.argmax(gain))
            n = int(min(self.left[0], self.left[2], sizes[i, 0]))
        else:
            return self._new()
        self._put(i, n)

    def _put(self, i: int, n: int) -> None:
        tokens, _, loss = self.table[i].tolist()
        bears = n if tokens == loss else min(loss, n)
        self.pieces.append((self.keys[i], self.starts[i], n, self.sequence, self.offset))
        self.left -= [n, 1, bears]
        self.offset += n
        self.starts[i] += n
        if n < tokens:
            self.table[i] = tokens - n, 1, loss - bears
        else:  # the last one takes its place
            last, start = self.keys.pop(), self.starts.pop()
            if i < len(self.keys):
                self.keys[i], self.starts[i], self.table[i] = last, start, self.table[len(self.keys)]
        if self.left[0] <= 0:
            self._new()

    def finish(self) -> None:
        """Places all that wait; with cut, the last sequences end at powers of two."""
        while len(self.keys):
            waiting = int(self.sizes[:, 0].sum())
            if self.cut and self.offset + waiting <= self.limit[0]:
                size = 1 << (self.offset + waiting).bit_length() - 1
                if size <= self.offset:
                    self._new()
                    continue
                while self.offset < size and len(self.keys) and self.left[1] >= 1 and self.left[2] >= 1:
                    self._put(int(np.argmax(self.sizes[:, 0])), int(min(size - self.offset, self.sizes[:, 0].max(), self.left[2])))
                if len(self.keys) and self.offset:
                    self._new()
            else:
                self._place()


def _pack(path: str, end_id: int, limits: tuple[int, int, int], most_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _encoder(path, end_id, most_words)
        packer = Packer(*limits, first=TaskContext.get().partitionId() << 33)

        def flush() -> Iterator[pa.RecordBatch]:
            pieces, packer.pieces = packer.pieces, []
            if pieces:
                docs = [p[0] for p in pieces]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d[0] for d in docs], pa.int64()), pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()),
                        pa.array([zlib.crc32(d[1][p[1] : p[1] + p[2]].astype("<u4").tobytes()) for d, p in zip(docs, pieces, strict=True)], pa.int64()),
                        pa.array([len(d[1]) for d in docs], pa.int64()), pa.array([p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64()),
                    ],
                    names=[f.split()[0] for f in PIECES.split(", ")],
                )

        for batch in slices(batches, "text", 4 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                packer.add((doc_id, ids), len(ids), len(ids))
            yield from flush()
        packer.finish()
        yield from flush()

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, most_tokens: int = 4096, most_segments: int = 1024, most_loss: int | None = None, doc_id: str = "doc_id", text: str = "text",
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """Pieces of tokenised documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizer file. Every token of a document bears loss; most_loss is most_tokens if not given.
    most_words: words of which a worker remembers the ids, fewer where other steps have left little memory; the result is the same.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_pack(tokenizer, end_id, (most_tokens, most_segments, most_loss or most_tokens), most_words), PIECES)


def pack_examples(examples: DataFrame, most_tokens: int, most_segments: int, most_loss: int) -> DataFrame:
    """Instruction data, uncut: (example_id, n_tokens, n_loss) to (example_id, n_tokens, sequence_id, offset).

    The loss-bearing tokens of an example are those of its answers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(most_tokens, most_segments, most_loss, cut=False, first=TaskContext.get().partitionId() << 33)

        def flush() -> Iterator[pa.RecordBatch]:
            pieces, packer.pieces = packer.pieces, []
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pieces], pa.int64()) for k in (0, 2, 3, 4)], names=["example_id", "n_tokens", "sequence_id", "offset"])

        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                packer.add(*[x or 0 for x in row])
            yield from flush()
        packer.finish()
        yield from flush()

    rows = examples.select(*[F.col(c).cast("long") for c in ("example_id", "n_tokens", "n_loss")])
    return rows.mapInArrow(run, "example_id long, n_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(docs: DataFrame) -> DataFrame:
    return pack_documents(docs, default_tokenizer())
