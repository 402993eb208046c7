"""Byte-level BPE as a finite-state transducer: the encoder reads bytes once, from left to right.

Nondeterministic form: a state is the last token u and a place in the vocabulary's trie, that is, the bytes read
since u.  Where the place is a token t that can stand behind u, t may be the next token.  A list of tokens is what
the merges make of a text exactly if that holds for each two neighbours, so every prefix of a text has one way
that ends with a token, and the whole text has one.

Deterministic form, made as texts ask for it: a state is the set of ways that are still open, each with its place
and the tokens that it alone has made.  Tokens that all open ways begin with are emitted; a way stays open for no
more bytes than the longest token has, so the transducer looks no further ahead than that.

Decoding concatenates the tokens' bytes and reads them with an incremental UTF-8 automaton, so a character that is
cut by the end of a token is held until the rest of it comes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, fresh, named

#: Transitions, and pairs of neighbours, that a task remembers; others are made each time that they are needed.
MOVES, PAIRS = 250_000, 600_000
#: Pieces of text whose tokens a task remembers (twice as many at most), and the longest such piece.
PIECES, LONGEST = 250_000, 64
#: Ids that are decoded at once.
CHUNK = 512

_NEVER = 1 << 62


class Merges:
    """What the ranks say: how a token is merged from its bytes, and which tokens can be neighbours."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.strings: list[bytes] = [b""] * (1 + max(ranks.values()))
        for string, i in ranks.items():
            self.strings[i] = string
        self._last: dict[int, tuple[int, int] | None] = {}
        self._steady: dict[int, bool] = {}
        self._edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self._beside: dict[int, bool] = {}

    def merge(self, data: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """The tokens of ``data`` by the merges themselves, lowest rank first, leftmost of equals; the last merge."""
        parts, last = [data[i : i + 1] for i in range(len(data))], None
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            last = self.ranks[parts[i]], self.ranks[parts[i + 1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts], last

    def made_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge makes ``token`` of; (token, token) for a single byte, None if the
        merges of its bytes never arrive at it."""
        if token not in self._last:
            made, last = self.merge(self.strings[token])
            self._last[token] = None if made != [token] else last or (token, token)
        return self._last[token]

    def reached(self, token: int) -> bool:
        return self.made_of(token) is not None

    def _is_steady(self, token: int) -> bool:
        """Whether the ranks rise with every merge that leads to ``token``, so that they tell the order in time."""
        if token not in self._steady:
            parts = self.made_of(token)
            self._steady[token] = parts[0] == token or all((len(self.strings[p]) == 1 or p < token) and self._is_steady(p) for p in parts)
        return self._steady[token]

    def _edge(self, token: int, side: int) -> list[int]:
        """What stands at the first (0) or last (1) byte of ``token`` while it is merged, in order of time."""
        known = self._edges[side]
        if token not in known:
            inner = self.made_of(token)[side]
            known[token] = [token] if inner == token else [*self._edge(inner, side), token]
        return known[token]

    def beside(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes together leave just these two; ``left`` is -1 at the beginning."""
        key = left << 32 | right
        known = self._beside.get(key)
        if known is None:
            known = self.reached(right) and (left < 0 or self._compare(left, right))
            if len(self._beside) < PAIRS:
                self._beside[key] = known
        return known

    def _compare(self, left: int, right: int) -> bool:
        if not (self._is_steady(left) and self._is_steady(right)):
            return self.merge(self.strings[left] + self.strings[right])[0] == [left, right]
        a, b, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        while True:
            across = self.ranks.get(self.strings[a[i]] + self.strings[b[j]], _NEVER)
            next_left = a[i + 1] if i + 1 < len(a) else _NEVER
            next_right = b[j + 1] if j + 1 < len(b) else _NEVER
            # of equal ranks the leftmost comes first: left's own, then across, then right's own
            if across < next_left and across <= next_right and across != _NEVER:
                return False
            if next_left == next_right == _NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1


#: Open ways: (last token, place in the trie, tokens not yet emitted); the last one ends with a token.
Ways = tuple[tuple[int, int, tuple[int, ...]], ...]


class _State(dict):
    """For each byte read so far from here: the next state, and the tokens that are certain then."""

    __slots__ = ("ways",)

    def __init__(self, ways: Ways) -> None:
        self.ways = ways


class Transducer:
    """Encodes pieces of text by the merges; states are made when first reached."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.merges = Merges(ranks)
        self.strings = self.merges.strings
        self.children: dict[int, int] = {}  # place * 256 + byte: place
        self.token = [-1]  # by place
        self.inner = [True]  # whether longer tokens go on from a place
        for string, i in ranks.items():
            at = 0
            for byte in string:
                self.inner[at] = True
                at = self.children.setdefault(at << 8 | byte, len(self.token))
                if at == len(self.token):
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[at] = i
        self._start = _State(((-1, 0, ()),))
        self.states: dict[Ways, _State] = {self._start.ways: self._start}
        self.made = 0

    def _advance(self, ways: Ways, byte: int) -> tuple[Ways, tuple[int, ...]]:
        """The open ways after one more byte, and the tokens that are certain then."""
        child, token_at, inner, beside = self.children.get, self.token, self.inner, self.merges.beside
        still, ended, least = [], None, 1
        for last, place, pending in ways:
            at = child(place << 8 | byte)
            if at is None:
                continue
            if ended is None and (token := token_at[at]) >= 0 and beside(last, token):
                ended = token, 0, (*pending, token)
            if inner[at]:
                still.append((last, at, pending))
                if not pending:
                    least = 0
        still.append(ended)
        if not least:
            return tuple(still), ()
        sure, own, shortest = 0, ended[2], min(len(w[2]) for w in still)
        while sure < shortest and all(w[2][sure] == own[sure] for w in still):
            sure += 1
        return tuple((last, place, pending[sure:]) for last, place, pending in still), own[:sure]

    def emit(self, data: bytes) -> list[int]:
        """Tokens of the bytes of one piece, each put out as soon as it is certain."""
        state, ways, tokens = self._start, self._start.ways, []
        for byte in data:
            if state is not None:
                step = state.get(byte)
                if step is not None:
                    state, out = step
                    ways = state.ways
                    tokens += out
                    continue
            ways, out = self._advance(ways, byte)
            tokens += out
            target = self.states.get(ways)
            if self.made < MOVES:
                if target is None:
                    target = self.states[ways] = _State(ways)
                if state is not None:
                    state[byte] = target, out
                    self.made += 1
            state = target  # none if it is new and there is no room for it
        tokens += ways[-1][2]
        return tokens


class Utf8Reader:
    """Reads bytes as UTF-8 as they come; what is no UTF-8 becomes U+FFFD, as in Python's decoder.

    States: 0 between characters; 1 to 3 for so many continuation bytes that are missing; 4 to 7 after the lead
    bytes E0, ED, F0, F4, which narrow the next byte.
    """

    TABLE: list[list[int]] = []

    def __init__(self) -> None:
        self.state, self.held, self.valid = 0, bytearray(), True

    @classmethod
    def table(cls) -> list[list[int]]:
        if not cls.TABLE:
            rows = [[-1] * 256 for _ in range(8)]
            for low, high, to in ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3)):
                rows[0][low : high + 1] = [to] * (high + 1 - low)
            for lead, to in ((0xE0, 4), (0xED, 5), (0xF0, 6), (0xF4, 7)):
                rows[0][lead] = to
            for state, low, high, to in (
                (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2),
                (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
            ):
                rows[state][low : high + 1] = [to] * (high + 1 - low)
            cls.TABLE = rows
        return cls.TABLE

    def read(self, data: bytes) -> str:
        """The characters that are complete after ``data``."""
        table, state, held, out = self.table(), self.state, self.held, []
        for byte in data:
            to = table[state][byte]
            if to < 0:
                self.valid = False
                out.append("�")
                held.clear()
                to = table[0][byte] if state else -1  # the byte may begin the next character
                if to < 0:
                    if state:
                        out.append("�")
                    state = 0
                    continue
            held.append(byte)
            if to == 0:
                out.append(held.decode())
                held.clear()
            state = to
        self.state = state
        return "".join(out)

    def end(self) -> str:
        """What is left when no more bytes come."""
        cut, self.state = self.state != 0, 0
        self.held.clear()
        self.valid &= not cut
        return "�" if cut else ""


class _Memory(dict):
    """Packed ids of pieces of text, made when first asked for; of a full memory, what is asked again survives."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece) or self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class RankTokenizer:
    """A tokenizer from a file of ranks (base64 of a token's bytes, blank, rank) and the pattern that cuts texts."""

    def __init__(self, content: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        self.transducer = Transducer(self.ranks)
        self.strings = self.transducer.strings
        self.whole: list[str | None] = []
        for string in self.strings:
            reader = Utf8Reader()
            text = reader.read(string)
            self.whole.append(text if reader.valid and not reader.state else None)
        self.cut = regex.compile(pattern)
        self.memory = _Memory(self._packed)

    def _packed(self, piece: str) -> bytes:
        data = piece.encode()
        known = self.ranks.get(data)  # a piece that is a token stays whole even if merges don't reach it
        ids = self.transducer.emit(data) if known is None else [known]
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null is empty."""
        return b"".join(map(self.memory.__getitem__, self.cut.findall(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def read(self, ids: Iterable[int], reader: Utf8Reader) -> str:
        """The characters that are complete after ``ids``; ``reader`` holds the rest."""
        if not reader.state:
            try:
                return "".join(map(self.whole.__getitem__, ids))
            except TypeError:  # a token that is no whole characters
                pass
        out = []
        for i in ids:
            text = self.whole[i] if not reader.state else None
            out.append(reader.read(self.strings[i]) if text is None else text)
        return "".join(out)

    def decode(self, ids: list[int] | None) -> tuple[str, bool]:
        """The text of ids, and whether their bytes are UTF-8; null is empty."""
        reader, out = Utf8Reader(), []
        for at in range(0, len(ids or ()), CHUNK):
            out.append(self.read(ids[at : at + CHUNK], reader))
        out.append(reader.end())
        return "".join(out), reader.valid


@lru_cache(maxsize=4)
def rank_tokenizer(content: bytes, pattern: str) -> RankTokenizer:
    """The tokenizer of a file's content, made once in each Python process."""
    return RankTokenizer(content, pattern)


def _sent(df: DataFrame, path: str, pattern: str):
    """The file's content (0.8 MB for 50,000 tokens) and the pattern, for the tasks."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast((file.read(), pattern))


def transducer_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of its texts; a null or empty text has none.

    Each match of ``pattern`` is encoded by itself; there are no special tokens.  All other columns, null ids and
    repeated rows stay as they are; an empty table gives no rows.  A column that is named like the new one is
    replaced.
    """
    sent = _sent(docs, path, pattern)
    rows = docs.drop(ids) if ids != text else docs

    def make(texts):
        # four bytes an id: lists of a batch's ids would be several times its texts
        return [[np.frombuffer(rank_tokenizer(*sent.value).packed(t), "<i4") for t in texts]]

    if ids != text:
        return append_columns(rows, [text], T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))]), make)
    (made,) = fresh(rows, "ids_")
    added = append_columns(rows, [text], T.StructType([T.StructField(made, T.ArrayType(T.IntegerType()))]), make)
    return added.select(*(named(made).alias(c) if c == text else named(c) for c in rows.columns))


def transducer_decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded", valid: str = "decoded_valid") -> DataFrame:
    """``rows`` with the texts of its token ids, and whether their bytes are UTF-8 (else they hold U+FFFD).

    A null list gives the empty text.  All other columns and repeated rows stay as they are; an empty table gives
    no rows; columns that are named like the new ones are replaced.
    """
    sent = _sent(rows, path, pattern)

    def make(lists):
        tokenizer = rank_tokenizer(*sent.value)
        return list(map(list, zip(*map(tokenizer.decode, lists), strict=True))) if lists else [[], []]

    added = T.StructType([T.StructField(text, T.StringType()), T.StructField(valid, T.BooleanType())])
    return append_columns(rows.drop(text, valid), [ids], added, make)


def transducer_round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and decoded_valid of every row, in one pass.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded bytes; the last column
    says whether the automaton read these as UTF-8.  A null text counts as empty; null ids, repeated rows and empty
    tables are passed through, other columns ignored.
    """
    sent = _sent(docs, path, pattern)

    def make(texts):
        tokenizer = rank_tokenizer(*sent.value)
        counts, lists, decoded, valid = [], [], [], []
        for t in texts:
            packed = tokenizer.packed(t)
            ids = np.frombuffer(packed, "<u4").tolist()
            digest, reader = hashlib.sha256(), Utf8Reader()
            for at in range(0, len(ids), CHUNK):
                chunk = ids[at : at + CHUNK]
                tokenizer.read(chunk, reader)
                digest.update(b"".join(map(tokenizer.strings.__getitem__, chunk)))
            reader.end()
            counts.append(len(ids))
            lists.append(hashlib.sha256(packed).hexdigest())
            decoded.append(digest.hexdigest())
            valid.append(reader.valid)
        return [counts, lists, decoded, valid]

    added = T.StructType([
        T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")),
        T.StructField("decoded_valid", T.BooleanType()),
    ])
    return append_columns(docs.select(named(doc_id).alias("doc_id"), named(text).alias("text")), ["text"], added, make).drop("text")
