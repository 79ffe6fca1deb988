"""Filter audit, Merkle manifest and token counts against plain versions, on odd rows and by SQL."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import filter_audit, merkle, queries, token_counts
from lexloom.llm.common import table

SF = "/root/testdata/sf0.001"
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, part string, idx bigint, n bigint, mask int, grp bigint, leaf string"
WORDS = " ".join(f"w{i}" for i in range(120))
ODD = [
    (1, WORDS, "en", "s", 1), (1, WORDS, "en", "s", 1), (2, WORDS, None, "s", 2), (2, WORDS, "de", None, 2), (3, None, "en", "s", 3), (4, "", "", "", 4), (None, WORDS, "en", "s", 5), (None, None, None, None, None),
    (5, "word " * 40_000, "de", "t", 6), (6, " \n\t ", "de", "s", 7), (7, "A lot OF CAPITALS\nand $ marks", "fr", "été", 8), (-9, WORDS + "\n", "en", "s", 9), (1 << 62, "line\nend", "en", "s", 10), ((1 << 62) + 1, "line\nend", "en", "s", 10),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "p", 1, 2, 3, 4, "l") for r in ODD], KIND).repartition(3)


def dicts(frame):
    return Counter(str(sorted(r.asDict().items())) for r in frame.collect())


# the filter audit


def plain_mask(text, copy):
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), copy)
    return frozenset(f for f, x in zip("ABCDE", fails) if x)


def plain_audit(rows, labels):
    """Every order applied to every document, one after another."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = [(i, lang or "", plain_mask(text or "", i is not None and first[text or ""] < i)) for i, text, lang, *_ in rows]
    out = []
    for part in {p for _, p, _ in docs}:
        own = [(i, m) for i, p, m in docs if p == part]
        found, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), sum(f in m for _, m in own) - len(gone), sum(m == {f} for _, m in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return Counter(out)


LABELS = [(1, 1, 0), (1, 0, 1), (5, 1, 1), (7, 0, 1), (2, 1, None), (None, 1, 1), (99, 1, 1)]


def test_audit_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id bigint, quality int, toxic int, part string")
    assert Counter(tuple(r) for r in filter_audit.audit(odd, labels).collect()) == plain_audit(ODD, LABELS)
    assert filter_audit.audit(odd.limit(0), labels).count() == 0
    assert Counter(tuple(r) for r in filter_audit.audit(odd, labels.limit(0)).collect()) == plain_audit(ODD, [])


@pytest.mark.parametrize("buffer_chars", [1, 16_000_000])
def test_copies_under_collisions(spark, buffer_chars):
    """Fingerprints that collide, a text that most rows have, ids in any order and repeated."""
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 400)), f"t{int(rng.integers(0, 30)) if rng.random() < 0.5 else 0}", "en") for _ in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    first = {}
    for i, t, _ in rows:
        first[t] = min(i, first.get(t, i))
    want = Counter((i, "en", plain_text_mask(t) | (16 if first[t] < i else 0)) for i, t, _ in rows)
    found = Counter()
    for r in filter_audit.masks(docs, F.xxhash64("text") % 3, buffer_chars).collect():
        found[r["doc_id"], r["part"], r["mask"]] += r["n"]
    assert found == want


def plain_text_mask(text):
    return sum(1 << "ABCDE".index(f) for f in plain_mask(text, False))


# the manifest


def plain_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row
    return plain_hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves, fanout=3):
    """All levels up to a single node."""
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([plain_hash(*found[-1][i : i + fanout]) for i in range(0, len(found[-1]), fanout)])
    return found


def plain_way(tree, i, fanout=3):
    """(siblings before, siblings after) of each level."""
    way = []
    for level in tree[:-1]:
        start = i - i % fanout
        way.append((level[start:i], level[i + 1 : start + fanout]))
        i //= fanout
    return way


def plain_manifest(rows, fanout=3):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    trees = [plain_tree([plain_leaf(r) for r in by[s]], fanout) for s in order]
    over = plain_tree([t[-1][0] for t in trees], fanout)
    out = []
    for p, s in enumerate(order):
        for i, r in enumerate(by[s]):
            way = plain_way(trees[p], i, fanout) + plain_way(over, p, fanout)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            at = plain_leaf((r[0], r[1].replace("\n", ""), *r[2:])) if tampered else plain_leaf(r)
            for a, b in way:
                at = plain_hash(*a, at, *b)
            root = over[-1][0]
            out.append(str(sorted({"doc_id": r[0], "leaf": plain_leaf(r), "subroot": trees[p][-1][0], "root": root, "proof_sha256": plain_hash(*(x for a, b in way for x in a + b)), "folded_root": at, "verified": at == root}.items())))
    return Counter(out)


def test_manifest_on_odd_rows(spark, odd):
    found = dicts(merkle.manifest(odd))
    assert found == plain_manifest(ODD)
    assert merkle.manifest(odd.limit(0)).count() == 0
    one = odd.where("doc_id = 7")
    assert dicts(merkle.manifest(one)) == plain_manifest([r for r in ODD if r[0] == 7])


@pytest.mark.parametrize("fanout, k", [(3, 1), (3, 2), (2, 3), (4, 6)])
def test_manifest_by_superblocks(spark, fanout, k):
    """Parts of 1 to 200 rows, one of them most of the table; rows alike; more parts than a block."""
    sizes = {f"p{i}": 1 + i % 4 for i in range(30)} | {"big": 200, "Z": 27, None: 9}
    rows = [(i if s != "Z" else 5, f"{i}\n" if s != "Z" else "same", "en", s, 1) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(7)
    assert dicts(merkle.manifest(docs, fanout, k)) == plain_manifest(rows, fanout)


def test_manifest_of_lone_leaves(spark):
    """No part has two rows."""
    rows = [(i, f"a\n{i}", "en", f"s{i}", 1) for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert dicts(merkle.manifest(docs)) == plain_manifest(rows)


def test_values_do_not_run_together(spark):
    rows = spark.createDataFrame([("a", "b", None), ("ab", "", None), ("ab", None, ""), ("a", "1:b", "-"), ("a", "b", "-")], "x string, y string, z string")
    assert rows.select(merkle.leaf(F.col("x"), F.col("y"), F.col("z"))).distinct().count() == 5


# token counts


def plain_counts(texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [len(library.encode(t or "", add_special_tokens=False)) for t in texts]


#: Blanks of many kinds, marks that join, special tokens within words, digits, contractions, no blanks at all.
HARD = [
    "don't stop 5's 'S 'll x y z\x1c\x1d a\x85b\x0b\x0cc", "é ́e á 1́ 2", "x<|endoftext|>y <|startoftext|><|endoftext|>1 <| endoftext|> <|ENDOFTEXT|>", "한글 각 が İI ǅ ß ﬁ Σ ΑΣ",
    "1234567890" * 3000, "ab12cd34" * 3000, "x" * 9000, "́" * 9000, "😀👍🏽é" * 2000, "a1́" * 4000, "é1e" * 3000, "word " * 30_000, "", " \n\t ", None, "�﻿", "a" + " " * 10_000 + "b",
]


@pytest.mark.parametrize("piece_bytes, batch_bytes", [(4096, 4 << 20), (3, 50), (16, 700)])
def test_lengths_are_the_librarys(piece_bytes, batch_bytes):
    lengths = token_counts.Lengths(public_tokenizers.path("word_bpe_49k.json"), memory_pieces=100, piece_bytes=piece_bytes)
    assert lengths.cuts
    rows = [(i, (t or "").encode()) for i, t in enumerate(HARD)]
    found = [tuple(r) for done in token_counts.counted(rows, lengths, batch_bytes) for r in done]
    assert found == [(i, len(r), n) for (i, r), n in zip(rows, plain_counts(HARD))]


def test_random_texts_are_cut_safely():
    rng = np.random.default_rng(2)
    letters = list("aA1 9é́'sS<|>\n\t.,- 漢ß") + ["<|endoftext|>", "'ll", "ͅ", "ᄀ", "ᅡ"]
    texts = ["".join(rng.choice(letters, int(rng.integers(1, 120)))) for _ in range(1500)]
    lengths = token_counts.Lengths(public_tokenizers.path("word_bpe_49k.json"), piece_bytes=2)
    found = [r[2] for done in token_counts.counted([(None, t.encode()) for t in texts], lengths, 40) for r in done]
    assert found == plain_counts(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_take_whole_texts(name):
    lengths = token_counts.Lengths(public_tokenizers.path(name))
    assert not lengths.cuts
    texts = ["a  text of words ", "", "1 2  3\n\n4"]
    assert lengths.batch([t.encode() for t in texts]) == [len(lengths_of(name, t)) for t in texts]


def lengths_of(name, text):
    if name.endswith(".json"):
        return Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode(text)


def test_counts_on_odd_rows_and_a_whole_table(spark, odd):
    frame = token_counts.count_tokens(odd)
    want = Counter((r[0], len((r[1] or "").encode()), n, n > 2048) for r, n in zip(ODD, plain_counts([r[1] for r in ODD])))
    assert Counter(tuple(r) for r in frame.collect()) == want
    assert token_counts.count_tokens(odd.limit(0)).count() == 0
    docs = table(spark, SF, "documents").collect()
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in queries.queries()["op13_token_counts"](spark, SF).collect()}
    assert found == {r["doc_id"]: (len((r["text"] or "").encode()), n) for r, n in zip(docs, plain_counts([r["text"] for r in docs]))}
