"""Best-fit packing of token pieces by sum of squares.

A document's ids and an end id are cut into pieces of at most ``capacity``
(the first may be shorter).  Full pieces fill a sequence each.  The others are
packed, longest first: each goes where the sum over residual gaps of the
squared number of open sequences with that gap becomes smallest, ties to the
tightest fit.

Scale.  Packing needs only (doc_id, piece, length, checksum) rows.  They are
dealt evenly into groups of about ``per_group`` pieces, each packed in one
task; a group wastes at most a few sequences in tens of thousands, and the
work grows in proportion to the input.  No key decides the group, so copies or
hot documents don't gather.

Rows.  A null or empty text is the end id alone.  Repeated rows are packed
once each.  Null ids are kept.  An empty table gives no rows.
"""

from __future__ import annotations

import array
import base64
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import arrow_map

#: Characters on which all Unicode versions in use agree; other units go to the tokenizers library itself.
_PLAIN = re.compile("[^\u0000-\u001b -\u0084\u0086-Ϳ΄-ΆΈ-Ίΐ-ΡΣ-ԯ]")
_END = "<|endoftext|>"


class UnitEncoder:
    """Byte-level BPE ids of texts, exactly the tokenizers library's.

    A pre-token never runs over a blank that follows a non-blank, so a text
    falls into units that are encoded on their own; frequent units are
    remembered, up to ``most`` of them.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str, most: int = 300_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.end_id = self.exact.token_to_id(_END)
        encode = self.unit

        class Memory(dict):
            def __missing__(self, unit):
                ids = encode(" " + unit if unit[:1] != "\n" else unit)
                if len(self) < most:
                    self[unit] = ids
                return ids

        self.memory = Memory()

    def unit(self, text: str) -> bytes:
        if _PLAIN.search(text):
            ids = self.exact.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array.array("I", ids).tobytes()

    def plain(self, text: str) -> bytes:
        """The ids of a text without the end token's string."""
        if text.replace("\n", " ").split(" ") != text.split():
            return self.unit(text)  # runs of blanks, or other blanks than these
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.unit(first) + b"".join(map(self.memory.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _END not in text:
            return self.plain(text) if text else b""
        end = array.array("I", [self.end_id]).tobytes()
        return end.join(self.plain(part) if part else b"" for part in text.split(_END))


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str) -> UnitEncoder:
    import public_tokenizers

    return UnitEncoder(public_tokenizers.path(vocabulary), public_tokenizers.path(ranks), public_tokenizers.PATTERN)


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document."""

    def cut(ids, texts):
        encode, end = encoder(vocabulary, ranks).encode, array.array("I", [end_id]).tobytes()
        out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for doc_id, text in zip(ids, texts):
            own = encode(text or "") + end
            n = len(own) // 4
            edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                out["doc_id"].append(doc_id)
                out["piece"].append(k)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(memoryview(own)[4 * a : 4 * b]))
        return out

    return arrow_map(docs, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", cut, "doc_id", "text")


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, in the order given, by sum of squares."""
    open_ = np.zeros(capacity + 1, dtype=np.int32)  # sequences by gap; the gaps 0 and capacity stay at 0
    heap: list[list[int]] = [[] for _ in range(capacity + 1)]  # the sequences of each gap
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    far, used = np.int32(1 << 30), 0
    for i, s in enumerate(lengths.tolist()):
        # half the change of the sum of squares, plus a half, for a sequence of gap s, s + 1, ...
        now = open_[s:capacity]
        change = np.where(now > 0, 2 * (open_[: capacity - s] - now) + 2, far)
        if len(now) and now[0] > 0:
            change[0] = 1 - 2 * now[0]
        fresh = 2 * int(open_[capacity - s]) + 1 if s < capacity else 0
        at = int(change.argmin()) if len(now) else -1  # the first of equals is the tightest
        if at >= 0 and change[at] <= fresh:
            gap = s + at
            b = heap[gap].pop()
            open_[gap] -= 1
        else:
            gap, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            heap[gap - s].append(b)
            open_[gap - s] += 1
    return bins, offsets


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``pack`` of the longest first; then sequences that aren't full are emptied and packed again while that saves some."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    rest, used, before = np.argsort(-lengths, kind="stable"), 0, None
    while len(rest):
        b, o = pack(lengths[rest], capacity)
        n = int(b.max()) + 1
        if before is not None and n >= before:
            break
        bins[rest], offsets[rest] = used + b, o
        full = np.bincount(b, weights=lengths[rest]) == capacity
        # full sequences keep the first numbers
        number = np.where(full, np.cumsum(full) - 1, full.sum() + np.cumsum(~full) - 1)
        bins[rest] = used + number[b]
        used, before, rest = used + int(full.sum()), n - int(full.sum()), rest[~full[b]]
    return bins, offsets


def expected(docs: DataFrame, capacity: int = 2048) -> int:
    """About how many pieces the documents have: one each, and one more for every ``4 * capacity`` characters."""
    longer = F.floor(F.coalesce(F.length("text"), F.lit(0)) / (4 * capacity))
    return docs.agg((F.count("*") + F.coalesce(F.sum(longer), F.lit(0))).cast("bigint")).first()[0]


def assign(pieces: DataFrame, n_pieces: int, capacity: int = 2048, per_group: int = 50_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``n_pieces``, their number or so, says how many tasks share them."""
    import pyarrow as pa

    groups = max(1, -(-n_pieces // per_group))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        from pyspark import TaskContext

        found = [b for b in batches if b.num_rows]
        if not found:
            return
        rows = pa.Table.from_batches(found).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
        bins, offsets = pack_group(rows.column("length").to_numpy(), capacity)
        bins += TaskContext.get().partitionId() << 40
        yield from rows.append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offsets)).to_batches()

    kind = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return pieces.select(*names).repartition(groups).mapInArrow(run, kind)
