"""Byte-level BPE encoding and decoding as a reduction up a tree.

A text is cut in halves until a piece has at most `LEAF_CHARS` characters. A leaf is matched by the pattern and each
match encoded on its own; two neighbours are then joined, and joining is associative, so any tree gives the same ids.

* Joining texts: a match of the left side that ends `LOOK` or more characters before the cut stands as it is, since the
  pattern looks that far ahead at most and never back. Matching starts again behind those and goes on until a match ends
  where a match of the right side ends; from there on both agree. (A pattern of your own must have this property, and
  must match every character.)
* Joining the ids of one match: the ids next to the cut are encoded again as one window, and the window grows on a side
  until the id outside and the first id inside are stable as a pair, that is, encoding the two alone gives the two.
  A row of ids is the encoding of its bytes if each neighbouring pair is stable: the first merge that crosses a
  border in the whole would be the lowest there in the pair as well. So nothing outside the window can change.
* Decoding concatenates the bytes of blocks of ids up the tree.

Merging takes the lowest rank first and the leftmost among equals; a match that is a token as a whole is that token.

Edge cases: a null text is empty; an empty text has no ids; special tokens are ordinary text; a very long text or a
very long single match is taken whole, and memory grows with that one text; repeated rows are encoded each for itself,
an empty table gives an empty result; a column of the input named like the result is replaced. Ids that the vocabulary
does not have raise an error when decoded; null ids among others are skipped, a null list is empty.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

LEAF_CHARS = 1 << 12
LEAF_BYTES = 24
#: Characters behind a match that decide where it ends: two, for the contractions of three characters.
LOOK = 2
#: Leading matches that a joined piece keeps apart; a cut that needs more is matched again from the cut on.
HEAD = 8
#: Ids in a leaf when decoding.
BLOCK_IDS = 1 << 14
#: Remembered words and pairs in a worker, and the longest word that is remembered.
MEMORY = 1 << 18
MEMORY_CHARS = 64
_SHORT = 128
_NONE = 1 << 62


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.int32)


class _Words(dict):
    """Ids of a match, packed, remembered while there is room."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or self.encode(word)
        if len(word) <= MEMORY_CHARS:
            if len(self) >= MEMORY:  # words that come back soon stay
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


@dataclass
class Piece:
    """Text from `start` to `stop`, encoded: all ids, the first matches and the last `LOOK` with their ids (packed, four bytes each)."""

    start: int
    stop: int
    ids: bytes
    n: int
    first: list[tuple[str, bytes]]
    last: list[tuple[str, bytes]]


class Vocabulary:
    """Ranks of byte strings, which are their ids, and the pattern that cuts a text first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        missing = [k for k in range(256) if bytes([k]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes, {missing[0]} first")
        self.ranks = ranks
        self.names: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for data, k in ranks.items():
            self.names[k] = data
        self.pattern = regex.compile(pattern)
        self.words = _Words(self.word)
        self.pairs: dict[tuple[int, int], bool] = {}

    # ids of bytes, by merges alone

    def merged(self, data: bytes) -> list[int]:
        """Merges one by one: what leaves and windows are encoded with."""
        if len(data) > _SHORT:
            return self._merged_long(data)
        get = self.ranks.get
        parts = [data[k:k + 1] for k in range(len(data))]
        scores = [get(data[k:k + 2], _NONE) for k in range(len(data) - 1)]
        while scores:
            low = min(scores)
            if low == _NONE:
                break
            k = scores.index(low)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = get(parts[k - 1] + parts[k], _NONE)
            if k < len(scores):
                scores[k] = get(parts[k] + parts[k + 1], _NONE)
        return [self.ranks[p] for p in parts]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same by a heap of possible merges over linked parts, for wide windows."""
        get, n = self.ranks.get, len(data)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := get(data[k:k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            right = after[k]
            if end[k] == 0 or right >= n or end[right] != stop or end[k] != right:
                continue  # a part of this merge has been merged otherwise
            end[k], end[right], after[k] = stop, 0, after[right]
            if after[k] < n:
                before[after[k]] = k
                if (r := get(data[k:end[after[k]]])) is not None:
                    heapq.heappush(heap, (r, k, end[after[k]]))
            if before[k] >= 0 and (r := get(data[before[k]:stop])) is not None:
                heapq.heappush(heap, (r, before[k], stop))
        out, k = [], 0
        while k < n:
            out.append(self.ranks[data[k:end[k]]])
            k = after[k]
        return out

    def stable(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.names[a] + self.names[b]) == [a, b]
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the bytes of both, given the ids of each."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merged(b"".join(map(self.names.__getitem__, chain(left[len(left) - i:], right[:j]))))
            left_holds = i == len(left) or self.stable(left[-i - 1], window[0])
            right_holds = j == len(right) or self.stable(window[-1], right[j])
            if left_holds and right_holds:
                return left[:len(left) - i] + window + right[j:]
            i, j = (i if left_holds else 2 * i), (j if right_holds else 2 * j)

    def merged_tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        half = len(data) // 2
        return self.joined(self.merged_tree(data[:half]), self.merged_tree(data[half:]))

    # matches and texts

    def word(self, match: str) -> bytes:
        data = match.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        return _packed([whole] if whole is not None else self.merged_tree(data))

    def word_across(self, left: tuple[str, bytes], right: tuple[str, bytes]) -> bytes:
        """The ids of a match that the cut parted, from those of its parts."""
        data = [part.encode("utf-8", "surrogatepass") for part, _ in (left, right)]
        whole = self.ranks.get(data[0] + data[1])
        if whole is not None:
            return _packed([whole])
        # a single id may stand for the whole part without any merge leading to it
        own = [unpacked(ids).tolist() if len(ids) > 4 else self.merged(part) for part, (_, ids) in zip(data, (left, right), strict=True)]
        return _packed(self.joined(*own))

    def leaf(self, text: str, start: int, stop: int) -> Piece:
        matches = self.pattern.findall(text, start, stop)
        ids = list(map(self.words.__getitem__, matches))
        pairs = [list(zip(matches[cut], ids[cut], strict=True)) for cut in (slice(HEAD), slice(-LOOK, None))]
        return Piece(start, stop, b"".join(ids), len(matches), *pairs)

    def join(self, text: str, left: Piece, right: Piece) -> Piece:
        if not left.n or not right.n:
            return left if not right.n else right
        back, begin = 0, left.stop
        while back < len(left.last) and begin > left.stop - LOOK:
            back += 1
            begin -= len(left.last[-back][0])
        parted = (left.stop - len(left.last[-1][0]), right.start + len(right.first[0][0])) if right.first else None
        new: list[tuple[str, bytes]] = []
        taken, at, agreed = 0, right.start, False
        for found in self.pattern.finditer(text, begin, right.stop):
            while at < found.end() and taken < len(right.first):
                at += len(right.first[taken][0])
                taken += 1
            new.append((found[0], self.word_across(left.last[-1], right.first[0]) if found.span() == parted else self.words[found[0]]))
            agreed = at == found.end()
            if agreed or at < found.end():
                break
        if not agreed:  # not within the leading matches: all of the right side is matched again
            new, taken = [(m, self.words[m]) for m in self.pattern.findall(text, begin, right.stop)], right.n
        kept = len(left.ids) - sum(len(own) for _, own in left.last[len(left.last) - back:])
        used = sum(len(own) for _, own in right.first[:taken]) if agreed else len(right.ids)
        ids = b"".join([left.ids[:kept], *(own for _, own in new), right.ids[used:]])
        rest = right.n - taken
        first = left.first[:left.n - back]
        if left.n - back < HEAD:
            first = (first + new + right.first[taken:])[:HEAD]
        last = (left.last[:len(left.last) - back] + new + right.last[max(len(right.last) - rest, 0):])[-LOOK:]
        return Piece(left.start, right.stop, ids, left.n - back + len(new) + rest, first, last)

    def _tree(self, text: str, start: int, stop: int) -> Piece:
        if stop - start <= LEAF_CHARS:
            return self.leaf(text, start, stop)
        half = (start + stop) // 2
        return self.join(text, self._tree(text, start, half), self._tree(text, half, stop))

    def encode(self, text: str | None) -> np.ndarray:
        return unpacked(self._tree(text or "", 0, len(text or "")).ids)

    def decode(self, ids: Iterable[int]) -> bytes:
        name, ids = self.names.__getitem__, list(ids)
        if ids and min(ids) < 0:
            raise ValueError(f"{min(ids)} is no id")
        level = [b"".join(map(name, ids[at:at + BLOCK_IDS])) for at in range(0, len(ids), BLOCK_IDS)]
        while len(level) > 1:
            level = [b"".join(level[k:k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


@lru_cache(2)
def _vocabulary(raw: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(parse_ranks(raw), pattern)


@dataclass(frozen=True)
class Tokenizer:
    """A rank file's bytes, sent once to each executor (their size is the vocabulary's), and the pattern."""

    raw: object
    pattern: str

    @property
    def vocabulary(self) -> Vocabulary:
        return _vocabulary(self.raw.value, self.pattern)


def tokenizer(spark: SparkSession, path: str, pattern: str) -> Tokenizer:
    """The rank file at `path` on the driver."""
    with open(path, "rb") as file:
        return Tokenizer(spark.sparkContext.broadcast(file.read()), pattern)


def encoded(text: Column, own: Tokenizer) -> Column:
    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = own.vocabulary
        for batch in texts:
            yield pd.Series([vocabulary.encode(t) for t in batch], dtype=object)

    return ids(text.cast("string"))


def decoded(ids: Column, own: Tokenizer) -> Column:
    @F.pandas_udf(BinaryType())
    def data(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = own.vocabulary
        for batch in lists:
            yield pd.Series([vocabulary.decode(() if x is None else x.tolist()) for x in batch], dtype=object)

    return data(F.filter(ids, lambda x: x.isNotNull()))


def encode(docs: DataFrame, own: Tokenizer, text: str = "text", to: str = "tokens") -> DataFrame:
    """`docs` with the ids of each whole text in column `to`."""
    return docs.withColumn(to, encoded(F.col(text), own))


def decode(docs: DataFrame, own: Tokenizer, tokens: str = "tokens", to: str = "decoded") -> DataFrame:
    """`docs` with the bytes of each row of ids in column `to`."""
    return docs.withColumn(to, decoded(F.col(tokens), own))


def digests(docs: DataFrame, own: Tokenizer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its key, the number of ids, the SHA-256 of the ids in decimal joined by commas, and that of the decoded bytes.

    Ids and decoded bytes are made text by text and only their digests leave the task.
    """
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    key_type = rows.schema[0].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = own.vocabulary
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for cell in batch.column(1):
                ids = vocabulary.encode(cell.as_py()).tolist()
                counts.append(len(ids))
                of_ids.append(sha256(",".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(sha256(vocabulary.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(digested, f"`{key}` {key_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
