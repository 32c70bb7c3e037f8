"""Packing token sequences by the sum-of-squares rule.

Each task packs the documents of its partition as they come. A document is cut
into whole windows and a remainder, and the remainder goes to the fill level that
makes the sum of squared counts of partially filled windows smallest. A level
array holds these counts, so a choice is one pass over the levels. When a task
has MAX_OPEN open windows, and at its end, the emptiest windows are cut up to
fill the fullest ones; so a task's memory is bounded and at most one of its
windows stays short.

Defined results: a null text counts as empty, and an empty one is packed as its
end token alone; rows with a null or repeated id are packed as documents of their
own; texts of any length are cut into as many windows as they need; an empty
table gives an empty result. Other columns are ignored, whatever their names.
A task that is run again packs the same rows in the same way, under the same
sequence ids, if its partition is read from files.
"""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_strings, give_back, slices, text_or_empty, word_hash

WINDOW = 4096
MAX_OPEN = 1024
END_ID = 2
CACHED_WORDS = 200_000
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_FAR = 1 << 40
_words: dict[str, _WordIds] = {}


def byte_characters() -> dict[int, str]:
    """How byte-level models spell a byte: visible Latin-1 as itself, the rest in order from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b if b in visible else 256 + hidden.index(b)) for b in range(256)}


class _WordIds(dict):
    """Little-endian uint32 ids of words, by the tokenizer on a miss.

    The tokenizer drops white space and never joins what stands on both sides of
    it, so the ids of a text are those of its words. A word of letters alone is one
    unit of its pre-tokenizer: it goes straight to the model, in lower case and
    spelled in the model's byte characters. So does what stands before a last
    full stop or comma, which are units of their own, unless letters change in the
    normal form, where a mark that comes off a letter belongs to the stop's unit.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.last: dict[str, bytes] = {}  # the table before this one: words of late aren't asked for again when a table is full
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.spell = byte_characters()

    def __missing__(self, word: str) -> bytes:
        ids = self.last.get(word)
        if ids is None:
            ids = self._ask(word)
        if len(word) <= 40:
            if len(self) >= CACHED_WORDS:
                self.last = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _ask(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():
                return self._spelled(word) if word.islower() else self[word.lower()]
            if word[-1:] in (".", ",") and word[:-1].isalpha():
                return self[word[:-1]] + self[word[-1]]
        elif "\u03a3" not in word and unicodedata.is_normalized("NFC", word):
            lower = word.lower()
            if lower.isalpha():
                return self._spelled(lower.encode().decode("latin-1").translate(self.spell))
            if word[-1] in (".", ",") and lower[:-1].isalpha():
                return self[word[:-1]] + self[word[-1]]
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _spelled(self, letters: str) -> bytes:
        ids = [t.id for t in self.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        for c in "\n\t\r":
            text = text.replace(c, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


def word_ids(path: str) -> _WordIds:
    """One table per Python worker and tokenizer file."""
    if path not in _words:
        _words[path] = _WordIds(path)
    return _words[path]


class Packer:
    """Sum-of-squares packing of id strings into windows of ``size`` ids; done() takes the placed pieces."""

    def __init__(self, size: int = WINDOW, first_id: int = 0, max_open: int = MAX_OPEN) -> None:
        self.size, self.next_id, self.max_open, self.n_open = size, first_id, max_open, 0
        self.levels: list[list[list]] = [[] for _ in range(size + 1)]  # open windows, each a list of pieces
        self.up = np.ones(size + 1, np.int64)  # what one window more at a level adds: 2n + 1, or 0 at the full level
        self.up[size] = 0
        self.down = np.full(size + 1, -_FAR)  # what one less takes away: 2n - 1
        self.out: list[tuple] = []

    def _count(self, level: int) -> None:
        n = len(self.levels[level])
        self.up[level], self.down[level] = 2 * n + 1, 2 * n - 1 if n else -_FAR

    def add(self, doc_id, ids: bytes) -> None:
        total, at, size = len(ids) // 4, 0, self.size
        while total - at >= size:
            self._close([(doc_id, at, ids[4 * at : 4 * (at + size)], total)])
            at += size
        if left := total - at:
            self._place((doc_id, at, ids[4 * at :], total), left)

    def _place(self, piece: tuple, n: int) -> None:
        change = self.up[n + 1 :] - self.down[1 : self.size - n + 1]
        best = len(change) - int(np.argmin(change[::-1])) if len(change) else 0  # of equal ones the fullest
        if best and change[best - 1] <= self.up[n]:
            window = self.levels[best].pop()
            self._count(best)
            self.n_open -= 1
        else:
            window, best = [], 0
        window.append(piece)
        self._keep(window, best + n)
        if self.n_open > self.max_open:
            self.drain()

    def _keep(self, window: list, level: int) -> None:
        if level == self.size:
            self._close(window)
        else:
            self.levels[level].append(window)
            self._count(level)
            self.n_open += 1

    def _close(self, window: list) -> None:
        offset = 0
        for doc_id, start, ids, total in window:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, ids, total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def drain(self) -> None:
        """Fill the fullest open windows with pieces cut from the emptiest, until one is left at most."""
        windows = [(level, w) for level in range(self.size, 0, -1) for w in self.levels[level]]
        for level in {level for level, _ in windows}:
            self.levels[level] = []
            self._count(level)
        self.n_open, last = 0, len(windows) - 1
        for i, (level, window) in enumerate(windows):
            if i > last:
                break
            while level < self.size and last > i:
                donor = windows[last][1]
                doc_id, start, ids, total = donor.pop()
                room = 4 * (self.size - level)
                window.append((doc_id, start, ids[:room], total))
                level += min(room, len(ids)) // 4
                if len(ids) > room:
                    donor.append((doc_id, start + room // 4, ids[room:], total))
                if donor:
                    windows[last] = (sum(len(p[2]) for p in donor) // 4, donor)
                else:
                    last -= 1
            self._keep(window, level)

    def done(self, end: bool = False) -> list[tuple]:
        if end:
            self.drain()
            for level in self.levels:
                for window in level:
                    self._close(window)
        out, self.out = self.out, []
        return out


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    kinds = (("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*pieces), kinds)], names=[n for n, _ in kinds])


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The documents' pieces as PIECES; ids are little-endian uint32.

    Sequence ids are unique: a task counts from its number times 2**40.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        word_hash.clear()  # of stages before this one
        give_back()
        packer, encode = Packer(window, TaskContext.get().partitionId() << 40), word_ids(tokenizer).encode
        for batch in slices(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), arrow_strings(batch["text"])):
                packer.add(doc_id, encode(text) + end)
                if len(packer.out) >= 1000:
                    yield _batch(packer.done())
        if last := packer.done(end=True):
            yield _batch(last)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, PIECES)
