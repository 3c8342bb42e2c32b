"""Runs of values laid end to end, so that many of them are looked up and joined in a few numpy operations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np

#: Words of which a store remembers the ids, their characters, and words that are looked up at a time.
MOST_WORDS, MOST_CHARS, STRETCH = 300_000, 16_000_000, 500_000


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def bounds_of(lengths: Iterable[int] | np.ndarray) -> np.ndarray:
    """Where each run begins, and at the end where the last one ends."""
    lengths = np.fromiter(lengths, np.int64) if not isinstance(lengths, np.ndarray) else lengths
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


class Runs:
    """Runs of values of one type; gather() gives chosen ones end to end, add() appends some."""

    def __init__(self, dtype: type) -> None:
        self.pool, self.starts, self.lengths = np.zeros(1 << 12, dtype), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.used = self.n = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.pool = self._room(self.pool, self.used + len(values))
        self.starts, self.lengths = self._room(self.starts, self.n + len(lengths)), self._room(self.lengths, self.n + len(lengths))
        self.pool[self.used : self.used + len(values)] = values
        self.lengths[self.n : self.n + len(lengths)] = lengths
        self.starts[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.used, self.n = self.used + len(values), self.n + len(lengths)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these runs, one run after the other, and the length of each."""
        lengths = self.lengths[at]
        return self.pool[spread(self.starts[at], lengths)], lengths


def byte_runs(items: list[bytes]) -> Runs:
    runs = Runs(np.uint8)
    runs.add(np.frombuffer(b"".join(items), np.uint8), np.fromiter(map(len, items), np.int64, len(items)))
    return runs


class WordIds:
    """Token ids of texts whose words are encoded each by itself: each distinct word is encoded once, in a store of bounded size.

    split: the words of a text, in lists of about STRETCH at most; encode: the ids of each of these words.
    """

    def __init__(self, split: Callable[[str], Iterator[list[str]]], encode: Callable[[list[str]], list[list[int]]]) -> None:
        self.split, self.encode_words = split, encode
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.chars = Runs(np.int32), 0

    def _learn(self, words: list[str]) -> None:
        found = self.encode_words(words)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.ids.add(np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum())), lengths)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.chars += sum(map(len, words))

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words end to end, and the number of each."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = list(dict.fromkeys(words[i] for i in missing))
            if self.place and len(self.place) + len(new) > MOST_WORDS:  # the store begins anew
                self._clear()
                missing, new = range(len(words)), list(dict.fromkeys(words))
            self._learn(new)
            at[missing] = np.fromiter((self.place[words[i]] for i in missing), np.int64, len(missing))
        ids, n = self.ids.gather(at)
        if self.chars > MOST_CHARS:
            self._clear()
        return ids, n

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text by text, and where each text's ids begin and end."""
        found, lengths = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        words: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            ids, n = self._look_up(words)
            found.append(ids)
            sums = np.concatenate([[0], np.cumsum(n)])
            stops = np.cumsum([k for _, k in owners])
            np.add.at(lengths, [i for i, _ in owners], sums[stops] - sums[stops - [k for _, k in owners]])
            words.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for part in self.split(text):
                if words and len(words) + len(part) > STRETCH:
                    flush()
                words += part
                owners.append((i, len(part)))
        if words:
            flush()
        return np.concatenate(found), bounds_of(lengths)


def matches(pattern: object) -> Callable[[str], Iterator[list[str]]]:
    """The matches of a compiled pattern, in lists of at most STRETCH."""

    def split(text: str) -> Iterator[list[str]]:
        if len(text) <= STRETCH:
            yield pattern.findall(text)  # type: ignore[attr-defined]
        else:
            part = []
            for m in pattern.finditer(text):  # type: ignore[attr-defined]
                part.append(m.group())
                if len(part) == STRETCH:
                    yield part
                    part = []
            yield part

    return split
