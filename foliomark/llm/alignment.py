"""Cross-tokenizer alignment: which tokens of two tokenizers end together, and how often over the whole corpus.

Each text is encoded by both tokenizers (A: byte-level BPE, B: pieces with byte fallback), their tokens are laid
out as byte ranges, and the ends that both share cut them into groups.  A group of one A and one B token with the
same bytes is regular: a map from A ids to B ids with the same bytes, made beforehand, knows it, and it is counted
in a vector as long as the vocabulary.  Only pairs of irregular groups are shuffled.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PIECES, byte_letters
from .common import checkpointed, named, stored

#: How sentencepiece writes a blank; fixed value.
BLANK = "▁"
#: Bits of a B id in the number of a pair.
PAIR_BITS = 32


class Vocabulary(NamedTuple):
    """Bytes of each token, their lengths, and the decimal ids followed by each of two separators."""

    strings: list[bytes]
    sizes: np.ndarray
    inside: np.ndarray
    last: np.ndarray


def _vocabulary(strings: list[bytes], inside: bytes, last: bytes) -> Vocabulary:
    numbers = [str(i).encode() for i in range(len(strings))]
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    return Vocabulary(strings, sizes, *(np.array([n + end for n in numbers], dtype=object) for end in (inside, last)))


def _byte_encoder(spec: str, strings: list[bytes], added: dict):
    """Ids of a text by a byte-level BPE file, special tokens' strings being plain text.

    Where ids are the order of the merges, which is what they usually are, a table of ranks says the same as the
    file, and the faster library is asked; tests compare it with the file's own.
    """
    model = json.loads(spec)
    merges, vocabulary = model["model"]["merges"], model["model"]["vocab"]
    usual = model["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    in_order = all(vocabulary["".join(p.split(" ") if isinstance(p, str) else p)] == 256 + k for k, p in enumerate(merges))
    if usual and in_order and model["normalizer"] is None:
        import tiktoken

        ranks = {s: i for i, s in enumerate(strings) if i not in added}
        return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    tokenizer = _file_tokenizer(spec)
    return lambda text: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


def _file_tokenizer(spec: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_str(spec)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Alignment(NamedTuple):
    """A text's tokens (a, b), where its groups end in each list, the A ids of the regular groups, and the numbers
    of the irregular groups' linked pairs."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    regular: np.ndarray
    irregular: np.ndarray


class Aligner:
    """Both tokenizers and the map between their ids."""

    def __init__(self, a_spec: str, b_model: bytes) -> None:
        import sentencepiece

        file = _file_tokenizer(a_spec)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        a_strings = [b""] * file.get_vocab_size(with_added_tokens=True)
        added = file.get_added_tokens_decoder()
        for token, i in file.get_vocab(with_added_tokens=True).items():
            a_strings[i] = token.encode() if i in added else bytes(byte_of[c] for c in token)
        self.a = _byte_encoder(a_spec, a_strings, added)
        b_strings = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(BLANK, " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        self.a_words, self.b_words = _vocabulary(a_strings, b",", b"|"), _vocabulary(b_strings, b",", b";")
        #: the B id with the same bytes, -1 for none; of several the first that is no byte token
        first: dict[bytes, int] = {}
        for i in sorted(range(len(b_strings)), key=lambda i: (self.b.is_byte(i), i)):
            if not self.b.is_control(i) and not self.b.is_unknown(i):
                first.setdefault(b_strings[i], i)
        self.same = np.array([first.get(s, -1) for s in a_strings], dtype=np.int64)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by A and B; None if there are no tokens or their bytes aren't the text's."""
        if not text:
            return None
        a, b = self.a(" " + text), self.b.encode(text)
        expected = b" " + text.encode()
        if b"".join(map(self.a_words.strings.__getitem__, a)) != expected or b"".join(map(self.b_words.strings.__getitem__, b)) != expected:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def align(self, a: np.ndarray, b: np.ndarray) -> Alignment:
        at_a, at_b = np.cumsum(self.a_words.sizes[a]), np.cumsum(self.b_words.sizes[b])
        near = np.minimum(np.searchsorted(at_b, at_a), len(at_b) - 1)
        a_ends = np.flatnonzero(at_b[near] == at_a)
        b_ends = near[a_ends]
        alone = (np.diff(a_ends, prepend=-1) == 1) & (np.diff(b_ends, prepend=-1) == 1)
        a_last, b_last = a[a_ends], b[b_ends]
        alone &= self.same[a_last] == b_last
        return Alignment(a, b, a_ends, b_ends, a_last[alone], (a_last[~alone] << PAIR_BITS) | b_last[~alone])

    def listed(self, x: Alignment) -> bytes:
        """All groups, in order: `a1,a2|b1;a3|b2,b3`."""
        n_a, n_b = len(x.a), len(x.b)
        a_group, b_group = (np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1)) for ends in (x.a_ends, x.b_ends))
        # before an A token stand the B tokens of the groups before; before a B token the A tokens up to its group
        a_at = np.arange(n_a) + np.concatenate(([0], x.b_ends + 1))[a_group]
        b_at = np.arange(n_b) + x.a_ends[b_group] + 1
        words = np.empty(n_a + n_b, dtype=object)
        words[a_at], words[b_at] = self.a_words.inside[x.a], self.b_words.inside[x.b]
        words[a_at[x.a_ends]], words[b_at[x.b_ends]] = self.a_words.last[x.a[x.a_ends]], self.b_words.last[x.b[x.b_ends]]
        return b"".join(words.tolist())[:-1]


@lru_cache(maxsize=2)
def aligner(a_spec: str, b_model: bytes) -> Aligner:
    """The tokenizers of both files' contents, made once in each Python process."""
    return Aligner(a_spec, b_model)


_ENCODED = {
    "row": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(),
    "regular": pa.list_(pa.int32()), "regular_times": pa.list_(pa.int64()),
    "irregular": pa.list_(pa.int64()), "irregular_times": pa.list_(pa.int64()),
}


def _batch(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_ENCODED)
    arrays = [pa.array(c, kind) for c, kind in zip(columns, _ENCODED.values(), strict=True)]
    return pa.RecordBatch.from_arrays([doc_ids, *arrays], names=["doc_id", *_ENCODED])


def _encoded(docs: DataFrame, sent) -> DataFrame:
    """A row for each document, numbered, with its counted links, and one without number for each task: the
    regular groups of all its documents, counted in a vector (whose zeros aren't sent)."""

    def run(batches):
        from pyspark import TaskContext

        both, number, kind = aligner(*sent.value), TaskContext.get().partitionId() << 33, None
        total = np.zeros(len(both.same), dtype=np.int64)
        for batch in batches:
            rows, kind = [], batch.schema.field("doc_id").type
            for text in batch.column("text").to_pylist():
                tokens = both.encode(text)
                if tokens is None:
                    rows.append((number, 0, 0, 0, "", [], [], [], []))
                else:
                    x = both.align(*tokens)
                    same, same_n = np.unique(x.regular, return_counts=True)
                    odd, odd_n = np.unique(x.irregular, return_counts=True)
                    total[same] += same_n
                    rows.append((number, len(x.a), len(x.b), len(x.a_ends), hashlib.sha256(both.listed(x)).hexdigest(), same, same_n, odd, odd_n))
                number += 1
            yield _batch(batch.column("doc_id"), rows)
        seen = np.flatnonzero(total)
        if len(seen):
            yield _batch(pa.nulls(1, kind), [(None, None, None, None, None, seen, total[seen], None, None)])

    shapes = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<long>"}
    columns = ", ".join(f"{name} {shapes[kind]}" for name, kind in _ENCODED.items())
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}")


def _regular_sums(docs: DataFrame, vectors) -> DataFrame:
    """row, best_regular and sum_regular: the share of the regular groups, looked up in vectors."""

    def run(batches):
        counts, is_best = vectors.value
        for batch in batches:
            ids, times = batch.column("regular"), batch.column("regular_times")
            ends = np.asarray(ids.offsets) - ids.offsets[0].as_py()
            flat, n = np.asarray(ids.flatten()), np.asarray(times.flatten())
            shares = (np.where(is_best[flat], n, 0), counts[flat] * n)
            sums = [np.diff(np.r_[0, np.cumsum(share)][ends]) for share in shares]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, sums)], names=["row", "best_regular", "sum_regular"])

    return docs.select("row", "regular", "regular_times").mapInArrow(run, "row long, best_regular long, sum_regular long")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and pairs (a, b, count, is_best).

    A encodes the text with a blank before it, B the text (and puts the blank there itself); both without special
    tokens, whose strings in a text are plain text.  Each end that A and B share is a group's end and links the two
    tokens that end there, so n_links is n_groups.  A pair's count is the number of links, over all documents, that
    hold it; is_best says whether no other A id has more with the same B id.  n_best counts a document's links whose
    pair is_best, count_sum adds up the counts of its links' pairs, groups_sha256 is of all its groups.

    A null or empty text, or one that either tokenizer changes (its tokens' bytes aren't the text's), has no tokens:
    zeros and an empty groups_sha256.  Null ids and repeated rows stay, each row is counted and comes out; other
    columns are ignored; an empty table gives no rows.

    On the driver and in broadcasts are vectors as long as the vocabularies, nothing that grows with the corpus.
    """
    with open(a_path, encoding="utf-8") as a_file, open(b_path, "rb") as b_file:
        files = a_file.read(), b_file.read()
    spark, both = docs.sparkSession, aligner(*files)
    every = stored(_encoded(docs.select(named(doc_id).alias("doc_id"), named(text).alias("text")), spark.sparkContext.broadcast(files)), "alignment")
    rows = every.where("row IS NOT NULL")

    # regular groups: vectors, summed
    vectors = every.where("row IS NULL").select(F.explode(F.arrays_zip("regular", "regular_times")).alias("v"))
    found = vectors.groupBy(F.col("v.regular").alias("a")).agg(F.sum("v.regular_times").alias("n")).toPandas()
    counts = np.zeros(len(both.same), dtype=np.int64)
    counts[found["a"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)

    # irregular groups: pairs, counted before they are shuffled
    links = rows.select("row", F.explode(F.arrays_zip(F.col("irregular").alias("pair"), F.col("irregular_times").alias("times"))).alias("l")).select("row", "l.*")
    pairs = checkpointed(links.groupBy("pair").agg(F.sum("times").alias("count")))
    b_of = F.col("pair").bitwiseAND(F.lit((1 << PAIR_BITS) - 1)).cast("int")
    found = pairs.groupBy(b_of.alias("b")).agg(F.max("count").alias("n")).toPandas()
    most = np.zeros(len(both.b_words.strings), dtype=np.int64)
    most[found["b"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    mapped = np.flatnonzero(both.same >= 0)
    np.maximum.at(most, both.same[mapped], counts[mapped])
    is_best = (counts > 0) & (counts == most[both.same])

    known = spark.createDataFrame(pa.table({"b": np.arange(len(most), dtype=np.int32), "most": most}))
    judged = pairs.withColumn("b", b_of).join(F.broadcast(known), "b").select("pair", "b", "count", (F.col("count") == F.col("most")).alias("is_best"))
    irregular = links.join(judged, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("best_irregular"), F.sum(F.col("times") * F.col("count")).alias("sum_irregular")
    )
    regular = _regular_sums(rows, spark.sparkContext.broadcast((counts, is_best)))
    zero = F.lit(0).cast("long")
    documents = (
        rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(regular, "row", "left").join(irregular, "row", "left")
        .select(
            "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
            (F.coalesce("best_regular", zero) + F.coalesce("best_irregular", zero)).alias("n_best"),
            (F.coalesce("sum_regular", zero) + F.coalesce("sum_irregular", zero)).alias("count_sum"),
            "groups_sha256",
        )
    )
    seen = np.flatnonzero(counts)
    simple = spark.createDataFrame(pa.table({"a": seen.astype(np.int32), "b": both.same[seen].astype(np.int32), "count": counts[seen], "is_best": is_best[seen]}))
    return documents, judged.select(F.shiftright("pair", PAIR_BITS).cast("int").alias("a"), "b", "count", "is_best").unionByName(simple)
