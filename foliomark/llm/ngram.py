"""LM scoring with a bigram model in an Elias-Fano trie.

The corpus is gathered by word: the occurrences of a word, with the words before it, meet in one shard, where
its counts are summed and the occurrences are scored.  So the model is as large as the corpus makes it, and no
task holds more than a shard.  A shard's trie has two levels: words, and below each word the words that came
before it.  Both are Elias-Fano sequences (children are made monotone by adding their parent's place), tied by
monotone pointers, a third such sequence: a context is searched between its parent's pointer and the next.
Smoothed probabilities are quantised to 16 bits, all in memory-mapped arrays.

Hot words are dealt to shards by word and context, hot pairs of these by batch, with their counts sent along.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, named
from .elias_fano import EliasFano, Levels

#: Weight of the lower order: P(w | u) = (c(u, w) + PRIOR * P(w)) / (c(u) + PRIOR).
PRIOR = 1_000.0
#: Tokens that one shard holds, about, and that a batch of documents is cut after.
SHARD_TOKENS, BATCH_TOKENS = 3_000_000, 2_000_000
#: Bytes of a token with its blank, to set the number of shards from the size of the texts.
TOKEN_BYTES = 6
#: Bytes of text that are cut into words at once.
PIECE_BYTES = 8_000_000
#: Bits of the code of a word before another, below that other word.
CONTEXT_BITS = 40
#: Words (pairs) with so large a share of a shard's tokens are hot: they are dealt by context (batch), too.  Of each
#: there are HOT_MOST at most: hot is only what also has that share of all tokens.
HOT_SHARE, HOT_MOST = 0.25, 100_000
#: An odd number, to mix the codes of a hot word and its context.
MIX = 0x9E3779B97F4A7C15
LEVELS = 1 << 16

#: What no word can be: the end of a text, which is a token, and its beginning, which is only a context.
END, BEGIN = b"\n", b"\n\n"

_ROWS = "batch string, ids array<string>, held array<boolean>, sizes array<long>, data binary"


def code(word: bytes) -> int:
    """64 bits that stand for a word."""
    return xxhash.xxh64_intdigest(word)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each in the smallest type that holds it."""
    small = [a if a.dtype == np.uint64 else a.astype(np.min_scalar_type(int(a.max(initial=0)))) for a in arrays]
    head = np.array([len(small), *(x for a in small for x in (len(a), a.dtype.itemsize))], dtype="<i8")
    # differing bytes of a number are kept apart, which compresses better
    body = b"".join(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in small)
    return zstandard.compress(head.tobytes() + body, 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * n, []
    for size, width in head.reshape(-1, 2).tolist():
        flat = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        out.append(np.ascontiguousarray(flat).view(f"<u{width}").ravel())
        at += size * width
    return out


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces that end with a blank."""
    at = 0
    while len(data) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < len(data) and data[end : end + 1].strip():
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


class _Batch:
    """Documents with their tokens, as numbers of the words that occur in them."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {END: 0}
        self.ids, self.held, self.sizes = [], [], []
        self.tokens: list[np.ndarray] = []
        self.count = 0

    def add(self, doc_id: str | None, held: bool, text: str | None) -> None:
        words, size = self.words, 1
        for piece in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
            cut = piece.split()
            self.tokens.append(np.fromiter((words.setdefault(w, len(words)) for w in cut), dtype=np.int32, count=len(cut)))
            size += len(cut)
        self.tokens.append(np.zeros(1, dtype=np.int32))
        self.ids.append(doc_id)
        self.held.append(held)
        self.sizes.append(size)
        self.count += size

    def codes(self) -> np.ndarray:
        return np.fromiter(map(code, self.words), dtype=np.uint64, count=len(self.words))

    def placed(self) -> tuple[np.ndarray, ...]:
        """The batch's word codes and short context codes, ascending; and of every token the places of its word and
        of its context among them, and its document."""
        codes, tokens, sizes = self.codes(), np.concatenate(self.tokens), np.array(self.sizes)
        ordered = np.sort(codes)
        word = np.searchsorted(ordered, codes)[tokens]
        shorts = np.append(short_context(codes), short_context(np.array([code(BEGIN)], dtype=np.uint64)))
        context, context_rank = np.unique(shorts, return_inverse=True)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.cumsum(sizes) - sizes] = len(codes)
        return ordered, context, word, context_rank[before], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def rows(self, name: str, shards: int, hot: Hot) -> Iterator[tuple]:
        """One row for each shard that has an occurrence here, and one (shard -1 and below) with the documents.

        An occurrence is a word after a context in a document, with the times that it is there.  It belongs to
        the shard of its word or, if the word is hot, of word and context or, if this pair is hot, also of the batch.
        """
        ordered, context, word, before, docs = self.placed()
        # texts come one after the other, so stable sorts leave the documents of a pair in order
        order = np.argsort(word * len(context) + before, kind="stable")
        word, before, docs = word[order], before[order], docs[order]
        shard = (ordered % np.uint64(shards)).astype(np.int32)[word]
        split = np.isin(ordered, hot.words)[word]
        mixed = (ordered[word[split]] ^ (context[before[split]] * np.uint64(MIX))) % np.uint64(shards)
        own = xxhash.xxh32_intdigest(name) % shards
        dealt = np.isin((word[split] << 32) | before[split], hot.places(ordered, context))
        shard[split] = np.where(dealt, (mixed + np.uint64(own)) % np.uint64(shards), mixed).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        word, before, docs, shard = word[order], before[order], docs[order], shard[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(word) != 0) | (np.diff(before) != 0) | (np.diff(docs) != 0)]))
        times = np.diff(first, append=len(word))
        word, before, docs, shard = word[first], before[first], docs[first], shard[first]
        held = np.array(self.held, dtype=np.int64)
        yield -1 - own, name, self.ids, self.held, self.sizes, None
        cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            words, word_at = np.unique(word[a:b], return_inverse=True)
            used, used_at = np.unique(before[a:b], return_inverse=True)
            present, doc_at = np.unique(docs[a:b], return_inverse=True)
            yield int(shard[a]), name, None, None, None, _pack(
                _differences(ordered[words]), np.diff(word_at, prepend=0), _differences(context[used]), used_at, doc_at, times[a:b],
                np.diff((present << 1) | held[present], prepend=0),
            )


class Hot(NamedTuple):
    """Hot words (codes, ascending) and hot pairs (word and short context), each with its training count."""

    words: np.ndarray
    counts: np.ndarray
    pair_words: np.ndarray
    pair_contexts: np.ndarray
    pair_counts: np.ndarray

    def places(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """The hot pairs that ``words`` and ``contexts`` (both ascending) hold, as place << 32 | place."""
        at, ctx = np.searchsorted(words, self.pair_words), np.searchsorted(contexts, self.pair_contexts)
        here = (at < len(words)) & (ctx < len(contexts))
        here[here] = (words[at[here]] == self.pair_words[here]) & (contexts[ctx[here]] == self.pair_contexts[here])
        return (at[here] << 32) | ctx[here]


def _differences(ascending: np.ndarray) -> np.ndarray:
    """Steps between ascending uint64 numbers; `np.cumsum` undoes it."""
    return np.diff(ascending, prepend=np.uint64(0))


def short_context(codes: np.ndarray) -> np.ndarray:
    return codes >> np.uint64(64 - CONTEXT_BITS)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1, F.lit(False))


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[_Batch]:
    batch = _Batch()
    for r in rows:
        for d, h, t in zip(*(r.column(c) for c in ("doc_id", "held", "text")), strict=True):
            batch.add(d.as_py(), h.as_py(), t.as_py())
            if batch.count >= BATCH_TOKENS:
                yield batch
                batch = _Batch()
    if batch.ids:
        yield batch


def _words(docs: DataFrame, heavy: float) -> DataFrame:
    """Words, how often they occur in training texts (n) and in all (n_all), batch by batch; and of pairs (with
    their short context) those that make up a share ``heavy`` of a batch."""

    def run(rows):
        for batch in _batches(rows):
            ordered, context, word, before, docs_ = batch.placed()
            learned = ~np.array(batch.held, dtype=bool)[docs_]
            counts = [np.bincount(word[learned], minlength=len(ordered)), np.bincount(word, minlength=len(ordered))]
            none = pa.nulls(len(ordered), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ordered.view(np.int64)), none, *map(pa.array, counts)], names=_COUNTED)
            # only pairs of words that are heavy themselves are looked at
            at = np.flatnonzero((counts[1] >= heavy * batch.count)[word])
            pair, n_all = np.unique((word[at] << 32) | before[at], return_counts=True)
            pair, n_all = (x[n_all >= heavy * batch.count] for x in (pair, n_all))
            codes = ordered[pair >> 32].view(np.int64), context[pair & 0xFFFFFFFF].view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, codes), pa.array(np.zeros_like(n_all)), pa.array(n_all)], names=_COUNTED)

    return docs.mapInArrow(run, "word long, context long, n long, n_all long")


_COUNTED = ["word", "context", "n", "n_all"]


def _pairs_of(docs: DataFrame, pairs) -> DataFrame:
    """Some pairs, counted as words are, batch by batch."""

    def run(rows):
        words, contexts = pairs.value
        wanted = Hot(words, words, words, contexts, words)
        for batch in _batches(rows):
            ordered, context, word, before, docs_ = batch.placed()
            keys = (word << 32) | before
            at = np.flatnonzero(np.isin(keys, wanted.places(ordered, context)))
            pair, place = np.unique(keys[at], return_inverse=True)
            learned = ~np.array(batch.held, dtype=bool)[docs_[at]]
            arrays = [
                ordered[pair >> 32].view(np.int64), context[pair & 0xFFFFFFFF].view(np.int64),
                np.bincount(place[learned], minlength=len(pair)), np.bincount(place, minlength=len(pair)),
            ]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=_COUNTED)

    return docs.mapInArrow(run, "word long, context long, n long, n_all long")


def _hot(docs: DataFrame, words: DataFrame, candidates: DataFrame, every: int, shard_tokens: int) -> Hot:
    """What is hot: HOT_MOST words and pairs at most, since each has that share of all tokens.

    A pair that is hot has half of its occurrences in batches where it is heavy, so only such pairs of hot words
    (twice HOT_MOST at most) are counted.  A hot pair that were missed would stay in one shard, nothing else.
    """
    least = max(HOT_SHARE * shard_tokens, every / HOT_MOST)
    found = words.where(F.col("n_all") >= least)
    rows = found.select("word", "n").toPandas().astype(np.int64)
    codes = rows["word"].to_numpy().view(np.uint64)
    order = np.argsort(codes)
    codes, counts = codes[order], rows["n"].to_numpy()[order]
    none = np.zeros(0, dtype=np.uint64)
    heavy = candidates.where(F.col("n_all") >= least / 2).select("word", "context")
    asked = heavy.join(F.broadcast(found.select("word")), "word", "left_semi").toPandas().astype(np.int64)
    if not len(asked):
        return Hot(codes, counts, none, none, np.zeros(0, dtype=np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(tuple(asked[c].to_numpy().view(np.uint64) for c in ("word", "context")))
    pairs = _pairs_of(docs, sent).groupBy("word", "context").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))
    rows = pairs.where(F.col("n_all") >= least).select("word", "context", "n").toPandas().astype(np.int64)
    return Hot(codes, counts, *(rows[c].to_numpy().view(np.uint64) for c in ("word", "context")), rows["n"].to_numpy())


def _gathered(docs: DataFrame, shards: int, hot) -> DataFrame:
    """The tokens of all documents by shard of their word."""
    kinds = [pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
    names = ["shard", "batch", "ids", "held", "sizes", "data"]

    def run(rows):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, batch in enumerate(_batches(rows)):
            columns = zip(*batch.rows(f"{part}-{number}", shards, hot.value), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.mapInArrow(run, "shard int, " + _ROWS)


def _together(blobs: pd.Series) -> tuple:
    """The occurrences of a shard: its words, and of each occurrence the word's place, the context, whether it
    is held out, its document (numbered through all batches) and its times; then each batch's present documents.
    Columns are put together one by one, to hold little at once."""
    parts = [_unpack(b) for b in blobs]
    word = np.concatenate([np.cumsum(p[0])[np.cumsum(p[1].astype(np.int32))] for p in parts])
    words, word_at = np.unique(word, return_inverse=True)
    del word
    word_at = word_at.astype(np.int32)
    context = np.concatenate([np.cumsum(p[2].astype(np.uint64))[p[3]] for p in parts])
    marked = [np.cumsum(p[6].astype(np.int64)) for p in parts]
    present = [m >> 1 for m in marked]
    before = np.cumsum([0, *map(len, present[:-1])])
    docs = np.concatenate([p[4].astype(np.int64) + n for p, n in zip(parts, before, strict=True)])
    times = np.concatenate([p[5].astype(np.int32) for p in parts])
    held = np.concatenate([(m & 1)[p[4]] for p, m in zip(parts, marked, strict=True)]) > 0
    return words, word_at, context, held, docs, times, present


class Trie:
    """The words of a shard (those seen in training), and below each the words that came before it."""

    def __init__(self, words: np.ndarray, parents: np.ndarray, contexts: np.ndarray, word_values: np.ndarray, pair_values: np.ndarray) -> None:
        """``parents`` are the places of the pairs' words, ascending; ``contexts`` ascend below a parent."""
        top = int(words[-1]) if len(words) else 0
        pointers = np.searchsorted(parents, np.arange(len(words) + 1)).astype(np.uint64)
        shifted = (parents.astype(np.uint64) << np.uint64(CONTEXT_BITS)) + contexts
        arrays, self.shape = {}, {}
        for name, values, most in (("word", words, top), ("pointer", pointers, len(parents)), ("pair", shifted, len(words) << CONTEXT_BITS)):
            bits, arrays[f"{name}_low"], arrays[f"{name}_high"] = EliasFano.parts(values, most)
            self.shape[name] = (bits, len(values))
        for name, values in (("word", word_values), ("pair", pair_values)):
            arrays[f"{name}_book"], arrays[f"{name}_value"] = quantised(values)
        self.levels = Levels(**arrays)
        self.sequences = {n: EliasFano(*self.shape[n], self.levels[f"{n}_low"], self.levels[f"{n}_high"]) for n in self.shape}

    def words(self, codes: np.ndarray) -> np.ndarray:
        """Places of words, -1 for those not seen."""
        return self.sequences["word"].find(codes)

    def pairs(self, parents: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Places of contexts below their parents, by a search for successors between the parents' pointers."""
        first, last = (self.sequences["pointer"].at(parents + k).astype(np.int64) for k in (0, 1))
        return self.sequences["pair"].find((parents.astype(np.uint64) << np.uint64(CONTEXT_BITS)) + contexts, first, last)

    def values(self, level: str, places: np.ndarray) -> np.ndarray:
        return self.levels[f"{level}_book"][self.levels[f"{level}_value"][places]]


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code book of 65,536 values at most and the places of ``values`` in it.

    With fewer distinct values each has its own entry; else neighbours share their mean.
    """
    book, place = np.unique(values, return_inverse=True)
    if len(book) > LEVELS:
        cell = np.arange(len(book)) * LEVELS // len(book)
        book, place = np.bincount(cell, book) / np.bincount(cell), cell[place]
    return book.astype(np.float64) if len(book) else np.zeros(1), place.astype(np.uint16)


def _scored(total: int, distinct: int, begins: int, prior: float, hot):
    """A shard's share in the scores of the documents, batch by batch; rows with documents pass through."""
    base_total, begin = np.log10(total + 0.5 * (distinct + 1)), short_context(np.array([code(BEGIN)], dtype=np.uint64))[0]
    end, unknown = np.uint64(code(END)), np.log10(0.5) - base_total

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["shard"].iloc[0] < 0:
            return rows.drop(columns="shard")
        words, word_at, context, held, docs, times, present = _together(rows["data"])
        # occurrences of a pair (a word after a context) are put next to each other
        order = np.lexsort((context, word_at))
        word_at, context, held, docs, times = (x[order] for x in (word_at, context, held, docs, times))
        del order
        first = np.flatnonzero(np.concatenate([[True], (np.diff(word_at) != 0) | (context[1:] != context[:-1])]))
        runs = np.diff(first, append=len(word_at))
        learned = np.where(held, 0, times)
        count = np.bincount(word_at, learned, len(words))
        seen = np.add.reduceat(learned, first, dtype=np.int64)
        # a hot word or pair is in several shards, its count is known beforehand
        known_words, known_pairs = _known(words, word_at[first], context[first], hot.value)
        count[known_words[0]] = known_words[1]
        seen[known_pairs[0]] = known_pairs[1]
        base = np.log10(count + 0.5) - base_total
        # the trie has what training saw
        inside, known = first[seen > 0], np.flatnonzero(count > 0)
        parents = (np.cumsum(count > 0) - 1)[word_at[inside]]
        values = np.log10(seen[seen > 0] + prior * 10.0 ** base[word_at[inside]])
        trie = Trie(words[known], parents, context[inside], base[known], values)
        place = trie.words(words)
        word_value = np.full(len(words), unknown)
        word_value[place >= 0] = trie.values("word", place[place >= 0])
        pair = np.full(len(first), -1, dtype=np.int64)
        asked = np.flatnonzero(place[word_at[first]] >= 0)
        pair[asked] = trie.pairs(place[word_at[first[asked]]], context[first[asked]])
        value = np.log10(prior) + word_value[word_at[first]]
        value[pair >= 0] = trie.values("pair", pair[pair >= 0])
        # what a token adds to its text: its own numerator, and the denominator that it is for the next
        value -= np.where(context[first] == begin, np.log10(begins + prior), 0.0)
        value -= np.where(words == end, 0.0, np.log10(count + prior))[word_at[first]]
        shares = (np.repeat(value, runs) * times, base[word_at] * times, (count > 0)[word_at] * times)
        total_docs = sum(map(len, present))
        sums = [np.bincount(docs, x, total_docs) for x in shares]
        data, at = [], 0
        for places in present:
            score, base_sum, n_known = (x[at : at + len(places)] for x in sums)
            data.append(_pack(np.diff(places, prepend=0), n_known.astype(np.int64), base_sum.view(np.uint64), score.view(np.uint64)))
            at += len(places)
        return pd.DataFrame({"batch": rows["batch"], "ids": None, "held": None, "sizes": None, "data": data})

    return run


def _known(words: np.ndarray, word_at: np.ndarray, context: np.ndarray, hot: Hot) -> tuple:
    """Of a shard's words, and of its pairs (ascending by word and context), the hot ones' places and counts."""
    at = np.searchsorted(words, hot.words)
    here = at < len(words)
    here[here] = words[at[here]] == hot.words[here]
    pair_at = np.searchsorted(words, hot.pair_words)
    there = pair_at < len(words)
    there[there] = words[pair_at[there]] == hot.pair_words[there]
    bits = np.uint64(CONTEXT_BITS)
    own = (word_at.astype(np.uint64) << bits) | context
    asked = (pair_at[there].astype(np.uint64) << bits) | hot.pair_contexts[there]
    place = np.searchsorted(own, asked)
    found = place < len(own)
    found[found] = own[place[found]] == asked[found]
    return (at[here], hot.counts[here]), (place[found], hot.pair_counts[there][found])


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """The documents of a batch with the sums of what all shards have for them.

    A shard sends only documents that it has tokens of, so a batch's group is no larger than its tokens.
    """
    meta = rows[rows["ids"].notna()].iloc[0]
    n = len(meta["ids"])
    known, base, score = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n)
    for data in rows.loc[rows["ids"].isna(), "data"]:
        steps, n_known, base_sum, own = _unpack(data)
        places = np.cumsum(steps.astype(np.int64))
        known[places] += n_known.astype(np.int64)
        base[places] += base_sum.view(np.float64)
        score[places] += own.view(np.float64)
    return pd.DataFrame({
        "doc_id": meta["ids"], "held_out": meta["held"], "n_tokens": meta["sizes"], "n_known": known, "base_score": base, "score": score,
    })


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prior: float = PRIOR, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from all rows whose id isn't held out.  Words are lower-cased in A-Z and followed by
    one end token.  base_score is the sum of the words' smoothed log10 frequencies; score that of their
    bigram probabilities, smoothed towards these frequencies.  A null or blank text is an end token alone;
    a null id counts as the empty id and comes out null.  Repeated rows are learned as often as they come,
    and each is scored.  Other columns are ignored; an empty table gives no rows; without any training text
    all counts are zero.

    ``docs`` is read for the size of its texts, for its words, for pairs that may be hot if there are any, and for
    its tokens; it should give its rows in the same order each time, as files do.
    """
    rows = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    ready = rows.select(F.col("doc_id").cast("string"), held_out(F.col("doc_id")).alias("held"), "text")
    sizes = ready.agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + TOKEN_BYTES), F.count_if(~F.col("held"))
    ).first()
    shards = max(1, -(-(sizes[0] or 0) // (TOKEN_BYTES * shard_tokens)))
    # half of what makes a pair hot, if it is dealt evenly
    heavy = max(HOT_SHARE * shard_tokens * TOKEN_BYTES / max(1, sizes[0] or 0), 1 / HOT_MOST) / 2
    counted = checkpointed(_words(ready, heavy).groupBy("word", "context").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all")))
    words, candidates = counted.where("context IS NULL").drop("context"), counted.where("context IS NOT NULL")
    distinct, total, every = words.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_all"), F.lit(0))).first()
    hot = docs.sparkSession.sparkContext.broadcast(_hot(ready, words, candidates, every, shard_tokens))
    kind = rows.schema["doc_id"].dataType
    return (
        _gathered(ready, shards, hot)
        .groupBy("shard")
        .applyInPandas(_scored(total, distinct, sizes[1], prior, hot), _ROWS)
        .groupBy("batch")
        .applyInPandas(_summed, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        .select(
            F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known",
            F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
        )
    )
