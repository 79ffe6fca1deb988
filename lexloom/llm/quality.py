"""Quality rules by distribution divergence.

Each language's reference is the distribution of its texts over character
classes and over its most common words, counted from all documents.  A
document is compared by Jensen-Shannon distance (square root of the divergence
in bits, 0 to 1) with every reference, so a wrong language label does no harm;
it fails if even the nearest one is too far in characters or in words.  Short
documents are not judged by distance: their histograms say too little.  Nor are
documents of a language without a reference: the base rules alone judge them.

Scale.  Reference counts are summed in each batch before the shuffle.  A
language gets a reference from ``min_words`` words of its own on, whatever the
other languages hold; references grow with the languages, not with the input,
and have ``common`` words each.

Rows.  A null text has no words and fails the base rules.  Null languages form
a reference of their own.  Repeated rows are judged alike and all returned.
With no documents there are no references and no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import arrow_keep, arrow_map, written

#: Fixed values.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    SPACES,
    b".,;:!?'\"-()",
    SYMBOLS,
    bytes(range(0xC2, 0xE0)),
    bytes(range(0xE0, 0xF0)),
    bytes(range(0xF0, 0xF5)),
)
_OTHER, _SKIP = len(_CLASSES), len(_CLASSES) + 1
_TABLE = bytearray([_OTHER] * 256)
for _k, _of in enumerate(_CLASSES):
    for _b in _of:
        _TABLE[_b] = _k
for _b in range(0x80, 0xC0):
    _TABLE[_b] = _SKIP
_TABLE = bytes(_TABLE)
#: Blanks say nothing about a script; letters, signs and digits do.
_USED = [k for k in range(_OTHER + 1) if _CLASSES[k : k + 1] != (SPACES,)]


def class_counts(raw: bytes) -> list[int]:
    """How many characters of each class, blanks left out."""
    coded = raw.translate(_TABLE)
    return [coded.count(k) for k in _USED]


def base_counts(text: str | None) -> dict:
    """The counts of the base rules, of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    if len(found) < len(windows):
        end = 0  # words before this position are counted
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    n, blanks = len(words), sum(map(raw.count, (SPACES[k : k + 1] for k in range(6))))
    return {
        "n_words": n, "word_chars": len(text or "") - blanks, "n_symbols": sum(raw.count(SYMBOLS[k : k + 1]) for k in range(8)), "n_dup_lines": dup,
        "n_repeat_words": repeated, "base_failed": n < MIN_WORDS or 100 * repeated > 50 * n,
    }


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of counts or shares; 1 if either is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.nansum(np.where(p > 0, p * np.log2(p / m), 0)) + np.nansum(np.where(q > 0, q * np.log2(q / m), 0))
    return math.sqrt(min(1.0, max(0.0, d / 2)))


def references(docs: DataFrame, common: int = 64, min_words: int = 1000) -> dict:
    """``{lang: (class counts, {word: count of the common ones}, count of all words)}`` over all documents."""
    kind = "lang string, word binary, n bigint"

    def count(langs, texts):
        by, classes = defaultdict(Counter), defaultdict(lambda: np.zeros(len(_USED), dtype=np.int64))
        for lang, text in zip(langs, texts):
            if text:
                raw = text.encode("utf-8", "surrogatepass")
                by[lang].update(raw.lower().split())
                classes[lang] += class_counts(raw)
        # a word holds no blank, so keys with one are free for the classes and the total
        out = {"lang": [], "word": [], "n": []}
        for lang, found in by.items():
            found |= {b"class %d" % i: int(n) for i, n in enumerate(classes[lang])} | {b"total words": found.total()}
            out["lang"] += [lang] * len(found)
            out["word"] += found
            out["n"] += found.values()
        return out

    counts = written(arrow_map(docs, kind, count, "lang", "text", rows=None).groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    special = counts.where(F.instr("word", " ") > 0)
    totals = special.where(F.col("word") == F.lit(b"total words")).select("lang", F.col("n").alias("total"))
    big = [(r["lang"], r["total"]) for r in totals.where(F.col("total") >= min_words).collect()]
    out = {lang: (np.zeros(len(_USED)), {}, total) for lang, total in big}
    if not out:
        return {}
    named = F.lit(False)
    for lang in out:
        named |= F.col("lang").eqNullSafe(F.lit(lang))
    for r in special.where(named & F.startswith(F.col("word"), F.lit(b"class "))).collect():
        out[r["lang"]][0][int(bytes(r["word"]).split()[1])] = r["n"]
    # two steps, so that no task sorts all words of a language
    salted = counts.where(named & (F.instr("word", " ") == 0)).withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(64)))
    first = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "word")
    some = salted.withColumn("r", F.row_number().over(first)).where(F.col("r") <= common)
    top = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= common)
    for r in top.select("lang", "word", "n").collect():
        out[r["lang"]][1][bytes(r["word"])] = r["n"]
    return out


def _prepared(refs: dict) -> list:
    return [(classes, list(words), np.array([*words.values(), max(0, total - sum(words.values()))], dtype=float)) for classes, words, total in refs.values()]


def judged(text: str | None, prepared: list, by_distance: bool = True, most_chars: float = 0.33, most_words: float = 0.5, min_chars: int = 200) -> dict:
    """The base counts of a text, its distances (None if not judged by any) and whether it is kept."""
    row = base_counts(text) | {"char_distance": None, "word_distance": None}
    row["kept"] = not row["base_failed"]
    if row["kept"] and by_distance and row["word_chars"] >= min_chars and prepared:
        raw = text.encode("utf-8", "surrogatepass")
        classes, words = np.array(class_counts(raw), dtype=float), Counter(raw.lower().split())
        by_words = []
        for _, names, ref in prepared:
            own = [words[w] for w in names]
            by_words.append(js_distance(np.array([*own, row["n_words"] - sum(own)], dtype=float), ref))
        row["char_distance"] = min(js_distance(classes, c) for c, _, _ in prepared)
        row["word_distance"] = min(by_words)
        row["kept"] = row["char_distance"] <= most_chars and row["word_distance"] <= most_words
    return row


def judge(docs: DataFrame, refs: dict, **limits) -> DataFrame:
    """``(doc_id, the base counts, base_failed, kept, char_distance, word_distance)`` of each row.

    ``most_chars`` and ``most_words``: the largest distances that pass.
    ``min_chars``: word characters below which distances don't count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_prepared(refs))
    kind = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double"
    names = [k.split()[0] for k in kind.split(", ")]

    langs = set(refs)

    def run(ids, texts, own):
        rows = [judged(t, shared.value, lang in langs, **limits) | {"doc_id": i} for i, t, lang in zip(ids, texts, own)]
        return {k: [r[k] for r in rows] for k in names}

    return arrow_map(docs, kind, run, "doc_id", "text", "lang")


def reject(docs: DataFrame, refs: dict, **limits) -> DataFrame:
    """``docs`` without the rows that the rules reject, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(_prepared(refs))
    langs = set(refs)

    return arrow_keep(docs, lambda text, lang: judged(text, shared.value, lang in langs, **limits)["kept"], "text", "lang")
