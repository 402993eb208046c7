"""Filter interaction audit, BPE transducer, cross-tokenizer alignment: against brute force and the libraries."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from foliomark.llm import alignment, filter_audit, queries, transducer

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

TEXTS = [
    None, "", " ", "a", "plain words, twice: plain words.", "  two  blanks\n\n and\tlines \r\n", "▁piece mark", "<|endoftext|> <s> </s> <unk>",
    "日本語のテキスト 😀 é é ﬁ ½", "\0\x01 control", "\x85\xa0 　 blanks", "don't we'll I'M ſ", "a" * 5_000, "0" * 777 + " " * 300 + "x", "word " * 20_000,
]


# --- filter interaction audit -----------------------------------------------------


def audit_rows():
    pick = random.Random(3)
    words = ["alpha", "beta", "Gamma", "DELTA", "#tag", "e"]
    rows = [(None, "x " * 300, "en"), (None, "x " * 300, None), (7, None, None), (8, "", ""), (8, "", "de"), (9, "  ", "en")]
    for i in range(10, 90):
        n = pick.choice([3, 199, 200, 201, 400])
        text = " ".join(pick.choice(words[: pick.randint(1, 6)]) + (str(pick.randrange(300)) if pick.random() < 0.7 else "") for _ in range(n))
        rows.append((i, pick.choice([text, "a copied text", "x " * 300]), pick.choice(["en", "de", None])))
    return rows, [(i, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for i in [*range(5, 70), 20, 21, 22]] + [(None, 1, 1)]


def audit_brute(rows, labels):
    good, toxic = ({d for d, *flags in labels if d is not None and flags[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for d, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": any(d is not None and e is not None and e < d and (t or "") == text for e, t, _ in rows),
        }
        parts[lang or ""].append(({f for f in fails if fails[f]}, d in good, d in toxic))
    out = []
    for part, docs in parts.items():
        own = []
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                here = [x for x in docs if not x[0] & set(order[: step - 1])]
                gone = [x for x in here if f in x[0]]
                late = sum(f in x[0] for x in docs) - len(gone)
                own.append((order, step, len(here) - len(gone), len(gone), late, sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        share = Counter()
        for order, step, _, removed, *_ in own:
            share[order[step - 1]] += removed
        out += [(part, *x, share[x[0][x[1] - 1]]) for x in own]
    return sorted(out)


def test_filter_audit_against_brute_force(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "'x' AS part", "2 AS n")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS label_id", "2 AS n")
    found = [tuple(r) for r in filter_audit.filter_interactions(docs, marks).collect()]
    assert sorted(found) == audit_brute(rows, labels)
    assert sum(r[0] == "en" for r in found) == 600
    none = filter_audit.filter_interactions(docs.limit(0), marks)
    assert none.collect() == [] and none.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    unlabelled = filter_audit.filter_interactions(docs, marks.limit(0)).collect()
    assert sorted(tuple(r) for r in unlabelled) == audit_brute(rows, [])


def test_filter_audit_sql(spark, tmp_path):
    rows, labels = audit_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = queries.op11_filter_audit(spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    names = ", ".join(found.columns)
    assert sorted(con.execute(f"SELECT {names} FROM ({queries.oracle_sql()['op11_filter_audit']})").fetchall()) == sorted(map(tuple, found.collect()))


# --- BPE transducer ---------------------------------------------------------------


@pytest.fixture(scope="module")
def multi():
    with open(RANKS, "rb") as file:
        own = transducer.RankTokenizer(file.read(), PATTERN)
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_transducer_against_the_library(multi):
    own, library = multi
    pick = random.Random(8)
    letters = [chr(c) for c in [*range(128), 0x85, 0xA0, 0x1C, 0x2028, 0x3000, 0x17F, 0x301, 0x660, 0x4E00, 0x1F600, *(pick.randrange(0x80, 0xD800) for _ in range(200))]]
    texts = [t for t in TEXTS if t is not None]
    texts += ["".join(pick.choice(letters[: pick.choice([3, 128, len(letters)])]) for _ in range(pick.randint(0, 60))) for _ in range(4_000)]
    texts += ["".join(pick.choice(["a", "b", "é", "aa", "the", "ing"]) for _ in range(200)) for _ in range(300)]
    for text in texts:
        ids = library.encode_ordinary(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == (text, True)


def test_transducer_without_room_for_states(multi, monkeypatch):
    monkeypatch.setattr(transducer, "MOVES", 50)
    monkeypatch.setattr(transducer, "PAIRS", 50)
    monkeypatch.setattr(transducer, "PIECES", 5)
    own = transducer.Transducer(multi[0].ranks)
    for text in ("internationalization", "Donaudampfschifffahrt", "a" * 500, "internationalization"):
        data = text.encode()
        assert own.emit(data) == own.merges.merge(data)[0]
        assert own.made <= 50


def random_ranks(pick):
    """Ranks of random strings, in an order in which longer ones may come first, so that ranks don't always rise."""
    longer = {bytes(pick.choices(b"abc", k=pick.randint(2, 5))) for _ in range(pick.randint(3, 40))}
    strings = [bytes([b]) for b in b"abc"] + pick.sample(sorted(longer), len(longer))
    return {s: i for i, s in enumerate(strings)}


def test_transducer_of_random_merges():
    pick = random.Random(17)
    for _ in range(150):
        own = transducer.Transducer(random_ranks(pick))
        for _ in range(60):
            data = bytes(pick.choices(b"abc", k=pick.randint(1, 25)))
            assert own.emit(data) == own.merges.merge(data)[0]


def test_tokens_come_out_before_the_end(multi):
    """No way stays open for more bytes than the longest token has."""
    own = multi[0].transducer
    longest, ways = max(map(len, own.strings)), ((-1, 0, ()),)
    for byte in b"the" * 500 + b"q" * 500:
        ways, _ = own._advance(ways, byte)
        assert len(ways) <= longest + 1 and max(len(w[2]) for w in ways) <= longest


def test_utf8_reader_is_pythons():
    pick = random.Random(4)
    for _ in range(5_000):
        data = bytes(pick.choice([pick.randrange(256), pick.randrange(0x80, 0xC0), 0xE0, 0xED, 0xF0, 0xF4, 0xC3, 65]) for _ in range(pick.randint(0, 9)))
        reader = transducer.Utf8Reader()
        assert "".join(reader.read(data[i : i + 1]) for i in range(len(data))) + reader.end() == data.decode("utf-8", "replace")


def test_transducer_columns(spark, multi):
    rows = [(None if i == 3 else i, t, "x", [i]) for i, t in enumerate(TEXTS)] + [(0, "a", "y", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids array<int>")
    found = transducer.transducer_round_trip(docs, RANKS, PATTERN).collect()
    wanted = []
    for d, text, *_ in rows:
        ids = multi[1].encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        wanted.append((d, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), True))
    assert Counter(map(tuple, found)) == Counter(wanted)
    encoded = transducer.transducer_encode(docs, RANKS, PATTERN)
    assert encoded.columns == ["doc_id", "text", "n_tokens", "ids"]
    decoded = transducer.transducer_decode(encoded, RANKS, PATTERN).select("text", "decoded", "decoded_valid").collect()
    assert all((t or "") == d and v for t, d, v in decoded)
    assert transducer.transducer_encode(docs, RANKS, PATTERN, ids="text").columns == docs.columns
    assert transducer.transducer_round_trip(docs.limit(0), RANKS, PATTERN).collect() == []
    broken = spark.createDataFrame([([multi[0].ranks[b"\xe6"]],), (None,)], "ids array<int>")
    assert [tuple(r) for r in transducer.transducer_decode(broken, RANKS, PATTERN).select("decoded", "decoded_valid").collect()] == [("�", False), ("", True)]


# --- cross-tokenizer alignment ----------------------------------------------------


def aligned_brute(rows):
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(alignment.byte_letters())}
    docs, counts = [], Counter()
    for _, text in rows:
        groups, links = [], []
        if text:
            xs = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            ys = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
            whole = (" " + text).encode()
            if b"".join(s for _, s in xs) == whole == b"".join(s for _, s in ys):
                i = j = at_a = at_b = 0
                left, right = [], []
                while i < len(xs) or j < len(ys):
                    if at_a <= at_b and not (at_a == at_b and left):
                        left.append(xs[i][0])
                        at_a, i = at_a + len(xs[i][1]), i + 1
                    else:
                        right.append(ys[j][0])
                        at_b, j = at_b + len(ys[j][1]), j + 1
                    if at_a == at_b:
                        groups.append((left, right))
                        links.append((left[-1], right[-1]))
                        left, right = [], []
        counts.update(links)
        docs.append((groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for (d, _), (groups, links) in zip(rows, docs, strict=True):
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((
            d, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out, {(*p, n, n == most[p[1]]) for p, n in counts.items()}


def test_ranks_say_what_the_file_says():
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        spec, own = a.read(), b.read()
    fast, file = alignment.aligner(spec, own).a, alignment._file_tokenizer(spec)
    pick = random.Random(6)
    letters = [chr(c) for c in [*range(128), 0x85, 0xA0, 0x1C, 0x2028, 0x3000, 0x17F, 0x301, 0x660, 0x4E00, 0x1F600, *(pick.randrange(0x80, 0xD800) for _ in range(200))]]
    texts = [t for t in TEXTS if t] + ["".join(pick.choice(letters[: pick.choice([128, len(letters)])]) for _ in range(40)) for _ in range(4_000)]
    assert all(fast(t) == file.encode(t, add_special_tokens=False).ids for t in texts)


def test_alignment_against_brute_force(spark):
    pick = random.Random(12)
    words = ["the", "house", "Haus", "tokenization", "été", "12345", "x9", "日本", ",", "\n", "  ", "unbelievably"]
    texts = [*TEXTS, *(" ".join(pick.choice(words) for _ in range(pick.randint(1, 60))) for _ in range(60))]
    rows = [(None if i % 9 == 4 else i // 2, t) for i, t in enumerate(texts)] + [(3, "the house")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS row", "1 AS n_a", "2 AS irregular").repartition(3)
    found, pairs = alignment.align_tokenizers(docs, A_PATH, B_PATH)
    wanted, counted = aligned_brute(rows)
    assert Counter(map(tuple, found.collect())) == Counter(wanted)
    assert {tuple(r) for r in pairs.collect()} == counted and pairs.count() == len(counted)
    assert any(w[1] == 0 and t for w, (_, t) in zip(wanted, rows, strict=True))  # a text that a tokenizer changes
    none, no_pairs = alignment.align_tokenizers(docs.limit(0), A_PATH, B_PATH)
    assert none.collect() == [] and no_pairs.collect() == []
