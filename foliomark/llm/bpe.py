"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by concatenation.

A tokenizer file (JSON with vocabulary, merges and added tokens) is read once on the driver and sent to the
tasks; nothing is trained here.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, named

#: Fixed value: how byte-level BPE cuts a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose tokens a task remembers (twice as many at most), and the longest such piece.
REMEMBERED, LONGEST = 200_000, 64
#: Texts whose ids are in a task's memory together.
AT_ONCE = 500


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it can be printed, else one of
    those from U+0100 on in turn."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printed else chr(next(others)) for b in range(256)]


class _Memory(dict):
    """Tokens of pieces, made when first asked for.  Of a full memory, what is asked for again survives."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class BytePairs:
    """A byte-level BPE tokenizer."""

    def __init__(self, spec: str) -> None:
        model = json.loads(spec)
        vocabulary: dict[str, int] = model["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocabulary[c] for c in letters]
        #: the rank of the merge of two neighbouring tokens, and what the merge of a rank makes
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[a], vocabulary[b]] = rank
            self.made.append(vocabulary[a + b])
        added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.added = added
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.strings: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *added.values()]))
        for token, i in vocabulary.items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        for token, i in added.items():
            self.strings[i] = token.encode()
        self.names = [str(i) for i in range(len(self.strings))]
        self.pieces = regex.compile(PIECES)
        self.memory = _Memory(self.merged)

    def merged(self, piece: str) -> tuple[int, ...]:
        """The tokens of one piece: the earliest merge first, of equal ones the leftmost."""
        first = self.first
        ids = [first[b] for b in piece.encode("utf-8", "surrogatepass")]
        size = len(ids)
        if size == 1:
            return (ids[0],)
        # an entry of the queue is rank * size + place of the left token
        rank_of, made = self.ranks.get, self.made
        queue = [r * size + i for i, r in enumerate(map(rank_of, zip(ids, ids[1:], strict=False))) if r is not None]
        heapify(queue)
        following, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while queue:
            rank, i = divmod(heappop(queue), size)
            j = following[i]
            if j >= size or rank_of((ids[i], ids[j])) != rank:  # stale: one of the two has been merged meanwhile
                continue
            ids[i], ids[j] = made[rank], -1
            following[i] = after = following[j]
            if after < size:
                before[after] = i
                if (found := rank_of((ids[i], ids[after]))) is not None:
                    heappush(queue, found * size + i)
            if (h := before[i]) >= 0 and (found := rank_of((ids[h], ids[i]))) is not None:
                heappush(queue, found * size + h)
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text; an added token's string in the text is that token.  Null is empty."""
        if not text:
            return []
        if self.split is None or not self.split.search(text):
            return list(chain.from_iterable(map(self.memory.__getitem__, self.pieces.findall(text))))
        ids: list[int] = []
        for part in self.split.split(text):
            if part in self.added:
                ids.append(self.added[part])
            else:
                ids.extend(chain.from_iterable(map(self.memory.__getitem__, self.pieces.findall(part))))
        return ids

    def decode(self, ids: Iterable[int] | None) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD.  Null is empty."""
        return b"".join(map(self.strings.__getitem__, ids or ())).decode("utf-8", "replace")

    def listed(self, ids: Iterable[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=4)
def tokenizer(spec: str) -> BytePairs:
    """The tokenizer of a file's content, made once in each Python process."""
    return BytePairs(spec)


def _sent(docs: DataFrame, path: str):
    """The file's content (1.6 MB for 50,000 tokens) for the tasks."""
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def bpe_encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of its texts; a null or empty text has none.

    All other columns and repeated rows stay as they are; an empty table gives no rows.  A column that is
    named like the new one is replaced.
    """
    sent = _sent(docs, path)
    rows = docs.drop(ids) if ids != text else docs

    def make(texts):
        # four bytes an id: lists of a batch's ids would be several times its texts
        return [[np.array(tokenizer(sent.value).encode(t), dtype=np.int32) for t in texts]]

    return append_columns(rows, [text], T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))]), make, AT_ONCE)


def bpe_decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the texts of its token ids; a null or empty list gives the empty text.

    All other columns and repeated rows stay as they are; an empty table gives no rows.  A column that is named like
    the new one is replaced.
    """
    sent = _sent(rows, path)
    make = lambda lists: [list(map(tokenizer(sent.value).decode, lists))]
    return append_columns(rows.drop(text), [ids], T.StructType([T.StructField(text, T.StringType())]), make)


def bpe_round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: `encode` and `decode` in one pass.

    The digests are of the ids, in decimal and joined by commas, and of the decoded text.  A null text counts
    as empty; null ids, repeated rows and empty tables are passed through, other columns ignored.
    """
    sent = _sent(docs, path)

    def make(texts):
        pairs = tokenizer(sent.value)
        counts, lists, decoded = [], [], []
        for t in texts:
            ids = pairs.encode(t)
            counts.append(len(ids))
            lists.append(hashlib.sha256(pairs.listed(ids).encode()).hexdigest())
            decoded.append(hashlib.sha256(pairs.decode(ids).encode()).hexdigest())
        return [counts, lists, decoded]

    added = T.StructType([T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256"))])
    return append_columns(docs.select(named(doc_id).alias("doc_id"), named(text).alias("text")), ["text"], added, make).drop("text")
