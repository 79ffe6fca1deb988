"""How filters interact: what each of them removes, in every order, and what it costs.

A document's failures are a bit mask.  Four bits come from its own text; the
last, being a copy of a document of a smaller id, needs the others' texts.  For
that, texts are routed by their fingerprint: rows become pairs of the text's
XXH64 and its row, a partition keeps for each fingerprint a chain of the full
texts that share it with the smallest id of each, and rows that aren't of that id
are given the bit.  Fingerprints only route; texts are compared in full.

Masks are counted in vectors by part, one place for each mask, and merged by
``combineByKey``.  Every order of the filters is read off these vectors.

Scale.  Chains are first made within a task over ``buffer_chars`` of text at a
time, so a text of a third of all rows is sent once a task and buffer, and a
reducer's chain has an entry for each different text.  Rows that a task already
knows to be copies travel without text, dealt by id.  Labels are joined to rows
without texts.  A reducer holds the different texts of its partition, so texts are
measured first and there are as many partitions as keep it near
``reducer_bytes``.  Vectors have three counts for each mask; the report has a row
for each part, order and step.

Rows.  A null text is empty, a null or empty ``lang`` is the part of that name.
A null id is neither smaller nor larger: its row is no copy, makes none and has no labels.  Rows of
equal id and text are not copies of each other.  Of several labels of an id
any 1 counts.  Other columns are ignored; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words, and the characters of a filter.
_BLANKS, _MARKS, _CAPITALS = r"[ \t-\r]+", r"[#$%&*|]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"
COPY = 1 << 4


def own_failures(text: F.Column) -> F.Column:
    """The mask of the four failures that a text has by itself: few words, few different ones, many capitals, marks."""
    words = F.filter(F.split(text, _BLANKS), lambda w: w != "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    tests = (n < 100, 100 * different < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike(_MARKS))
    return sum((t.cast("int") * (1 << k) for k, t in enumerate(tests)), F.lit(0))


class Chains:
    """For each fingerprint the texts that have it, each with its smallest id, its mask and how many rows of that id a part has."""

    def __init__(self):
        self.by_print: dict[int, list[list]] = {}
        self.chars = 0

    def add(self, fingerprint: int, text: str, mask: int, key: int, parts: dict[str, int]) -> Iterator[tuple]:
        """Takes rows of an id in; gives ``(id, mask, parts)`` of rows that now are known to be copies."""
        chain = self.by_print.setdefault(fingerprint, [])
        for entry in chain:
            if entry[0] == text:
                break
        else:
            chain.append([text, mask, key, dict(parts)])
            self.chars += len(text) + 100
            return
        if key < entry[2]:
            yield entry[2], mask | COPY, entry[3]
            entry[2:] = key, dict(parts)
        elif key > entry[2]:
            yield key, mask | COPY, parts
        else:
            for part, n in parts.items():
                entry[3][part] = entry[3].get(part, 0) + n

    def drain(self) -> Iterator[tuple]:
        """``(fingerprint, (id, mask, parts, text))`` of what is held, which is then forgotten."""
        for fingerprint, chain in self.by_print.items():
            for text, mask, key, parts in chain:
                yield fingerprint, (key, mask, parts, text)
        self.by_print, self.chars = {}, 0


def routed(rows: Iterable[tuple], buffer_chars: int) -> Iterator[tuple]:
    """``(routing key, (id, mask, parts, text))`` from rows ``(fingerprint, id, mask, part, text)``; without text where the mask is known to be whole."""
    chains = Chains()
    for fingerprint, key, mask, part, text in rows:
        if key is None:
            yield fingerprint, (None, mask, {part: 1}, None)
            continue
        for known, whole, parts in chains.add(fingerprint, text, mask, key, {part: 1}):
            yield hash(known), (known, whole, parts, None)
        if chains.chars > buffer_chars:
            yield from chains.drain()
    yield from chains.drain()


def judged(rows: Iterable[tuple]) -> Iterator[tuple]:
    """``(id, part, mask, n)``: masks with the last bit, from all rows of a fingerprint."""
    chains = Chains()
    for fingerprint, (key, mask, parts, text) in rows:
        found = [(key, mask, parts)] if text is None else chains.add(fingerprint, text, mask, key, parts)
        for known, whole, own in found:
            for part, n in own.items():
                yield known, part, whole, n
    for _, (key, mask, parts, _) in chains.drain():
        for part, n in parts.items():
            yield key, part, mask, n


def reducers(docs: DataFrame, reducer_bytes: int) -> int:
    """How many partitions hold about ``reducer_bytes`` of text each, as many as other shuffles have at least."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // reducer_bytes))


def masks(docs: DataFrame, fingerprint: F.Column | None = None, buffer_chars: int = 16_000_000, reducer_bytes: int = 32 << 20) -> DataFrame:
    """``(doc_id, part, mask, n)``: the failures of ``n`` rows of an id."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    prints = F.xxhash64(text) if fingerprint is None else fingerprint
    rows = docs.select(prints.alias("fingerprint"), "doc_id", own_failures(text).alias("mask"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    pairs = rows.rdd.mapPartitions(lambda rows: routed(rows, buffer_chars))
    found = pairs.partitionBy(reducers(docs, reducer_bytes), lambda key: key).mapPartitions(judged)
    return spark.createDataFrame(found, "doc_id bigint, part string, mask int, n bigint")


def counted(rows: Iterable[tuple], most_parts: int = 10_000) -> Iterator[tuple]:
    """``(part, vector)`` of rows ``(part, mask, n, good, toxic)``: three counts for each mask."""
    size = 1 << len(FILTERS)
    found: dict[str, list[int]] = {}
    for part, mask, n, good, toxic in rows:
        own = found.get(part)
        if own is None:
            if len(found) >= most_parts:
                yield from found.items()
                found = {}
            own = found[part] = [0] * (3 * size)
        own[mask] += n
        own[size + mask] += n * good
        own[2 * size + mask] += n * toxic
    yield from found.items()


def merged(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b)]


def report(part: str, vector: list[int]) -> Iterator[tuple]:
    """A row for each order of the filters and step of it."""
    size, letters = 1 << len(FILTERS), {f: 1 << k for k, f in enumerate(FILTERS)}
    docs, good, toxic = (vector[i * size : (i + 1) * size] for i in range(3))
    of = lambda counts, bit, free: sum(c for m, c in enumerate(counts) if m & bit and not m & free)  # noqa: E731  those that fail this one and none of ``free``
    orders, removed, shapley = list(permutations(FILTERS)), {}, dict.fromkeys(FILTERS, 0)
    for order in orders:
        before = 0
        for f in order:
            if (f, before) not in removed:
                removed[f, before] = tuple(of(c, letters[f], before) for c in (docs, good, toxic))
            shapley[f] += removed[f, before][0]
            before |= letters[f]
    failing = {f: of(docs, b, 0) for f, b in letters.items()}
    only = {f: docs[b] for f, b in letters.items()}
    for order in orders:
        before, kept = 0, sum(docs)
        for step, f in enumerate(order, 1):
            here, lost, bad = removed[f, before]
            kept -= here
            yield part, "".join(order), step, kept, here, failing[f] - here, only[f], lost, bad, shapley[f]
            before |= letters[f]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``."""
    spark = docs.sparkSession
    one = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality"), one("toxic"))
    met = masks(docs).join(told, "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    vectors = met.rdd.mapPartitions(counted).combineByKey(lambda v: v, merged, merged)
    return spark.createDataFrame(
        vectors.flatMap(lambda x: report(*x)),
        "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    )
