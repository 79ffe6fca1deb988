"""Distances of op10 and the parse of op7 against plain versions that share no code with them."""

import math
from collections import Counter

import numpy as np

from lexloom.llm import phrase_prints, quality
from lexloom.llm.common import table

SF = "/root/testdata/sf0.001"


# op10: every document's distances to every language


def plain_class(c):
    """The class of a character, None for blanks."""
    if c in " \t\n\x0b\x0c\r":
        return None
    if "a" <= c <= "z":
        return "lower"
    if "A" <= c <= "Z":
        return "upper"
    if "0" <= c <= "9":
        return "digit"
    if c in ".,;:!?'\"-()":
        return "point"
    if c in "#*$%&|<>":
        return "symbol"
    n = ord(c)
    return "other" if n < 0x80 else "two" if n < 0x800 else "three" if n < 0x10000 else "four"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_words(text):
    out = []
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            out.append("")
        elif not out:
            out = [c]
        else:
            out[-1] += c
    return [w for w in out if w]


def plain_distance(p, q):
    """Of two histograms as dicts."""
    a, b = sum(p.values()), sum(q.values())
    if not a or not b:
        return 1.0
    total = 0.0
    for key in p.keys() | q.keys():
        x, y = p.get(key, 0) / a, q.get(key, 0) / b
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
    return math.sqrt(max(0.0, min(1.0, total / 2)))


def with_rest(words, names):
    found = {n: words.get(n, 0) for n in names}
    return found | {"": sum(words.values()) - sum(found.values())}


def test_distances_to_languages(spark):
    docs = table(spark, SF, "documents")
    rows = docs.collect()
    classes, words = {}, {}
    for r in rows:
        text = r["text"] or ""
        classes.setdefault(r["lang"], Counter()).update(k for k in map(plain_class, text) if k)
        words.setdefault(r["lang"], Counter()).update(plain_words(ascii_lower(text)))
    judged_by = [lang for lang in words if words[lang].total() >= 1000]
    top = {lang: sorted(words[lang], key=lambda w: (-words[lang][w], w.encode()))[:64] for lang in judged_by}
    found = {r["doc_id"]: r for r in quality.judge(docs, quality.references(docs)).collect()}
    assert len(found) == len(rows)
    judged = 0
    for r in rows:
        text, got = r["text"] or "", found[r["doc_id"]]
        own = plain_words(text)
        if got["base_failed"] or sum(map(len, own)) < 200 or r["lang"] not in judged_by:
            assert got["kept"] == (not got["base_failed"])
            continue
        judged += 1
        mine, kinds = Counter(plain_words(ascii_lower(text))), Counter(k for k in map(plain_class, text) if k)
        by_chars = min(plain_distance(kinds, classes[lang]) for lang in judged_by)
        by_words = min(plain_distance(with_rest(mine, top[lang]), with_rest(words[lang], top[lang])) for lang in judged_by)
        assert got["kept"] == (by_chars <= 0.33 and by_words <= 0.5), (r["doc_id"], by_chars, by_words)
        row = got.asDict()
        for name, value in (("char_distance", by_chars), ("word_distance", by_words)):
            assert name not in row or math.isclose(row[name], value, abs_tol=1e-9)
    assert judged > 100


# op7: one name after another, in whole numbers

ALL = (1 << 64) - 1
M1, M2, M3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def plain_mix(x):
    x = ((x ^ (x >> 30)) * M2) & ALL
    x = ((x ^ (x >> 27)) * M3) & ALL
    return x ^ (x >> 31)


def plain_coin(own, left):
    bit = 0
    while (own >> bit) & 1 == (left >> bit) & 1:
        bit += 1
    return 2 * bit + ((own >> bit) & 1)


def plain_level(names, level):
    """The names of the phrases of one document."""
    runs = []
    for n in names:
        if runs and runs[-1][0] == n:
            runs[-1][1] += 1
        else:
            runs.append([n, 1])
    names = [n if k == 1 else plain_mix(n ^ plain_mix(k)) for n, k in runs]
    labels = [plain_coin(n, names[i - 1] if i else ~n & ALL) for i, n in enumerate(names)]
    for _ in range(2):
        labels = [plain_coin(x, labels[i - 1] if i else x ^ 1) for i, x in enumerate(labels)]
    begins = [i for i in range(len(names)) if i == 0 or i + 1 < len(names) and labels[i] > labels[i - 1] and labels[i] > labels[i + 1]]
    out = []
    for a, b in zip(begins, [*begins[1:], len(names)]):
        total = sum(plain_mix((n + (k + 1) * M1) & ALL) for k, n in enumerate(names[a:b]))
        out.append(plain_mix((total + (b - a) * M1 + level) & ALL))
    return out


def plain_sketch(text, levels=(2, 3, 4), size=64):
    names = [ord(c) * M1 & ALL for c in text]
    found = set(names) if 0 < len(names) < 16 else set()
    for level in range(1, max(levels) + 1):
        if names:
            names = plain_level(names, level)
            if level in levels:
                found |= set(names)
    return sorted(found)[:size]


def test_phrases_by_the_plain_parse(spark):
    rng = np.random.default_rng(4)
    texts = ["", "a", "aa", "aaabb", "abababab" * 9, "é你😀" * 50, "x" * 5000, "the same words " * 40] + ["".join(rng.choice(list("ab c"), int(rng.integers(1, 300)))) for _ in range(40)]
    texts += [r["text"] or "" for r in table(spark, SF, "documents").orderBy("doc_id").limit(25).collect()]
    for text, sketch in zip(texts, phrase_prints.sketches(texts)):
        assert sketch.tolist() == plain_sketch(text), text[:50]


def test_likeness_by_sets():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, int(rng.integers(0, 50)))).astype(np.uint64)[:16] for _ in range(2))
        both = sorted({*a.tolist()} | {*b.tolist()})[:16]
        want = sum(x in a and x in b for x in both) / len(both) if both else 1.0
        assert phrase_prints.likeness(a, b, 16) == want
