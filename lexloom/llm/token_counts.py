"""Token counts: the lengths that a tokenizer's encoding of whole texts has, and nothing else.

An Arrow function regroups its rows into batches of about equal bytes and hands
a batch's new pieces to the library's batch encoder, of which it keeps the
lengths only.  Where the vocabulary file drops white space before it merges,
texts are cut into pieces at ASCII white space, since no normal form, special
token, word or merge reaches over it; a piece longer than ``piece_bytes`` is cut
again between an ASCII digit and an ASCII letter or digit, since digits are
words of their own there.  A long text so becomes many pieces, and a batch never
holds more than one window of it.  Pieces repeat, so a worker remembers their
lengths.  For other vocabularies a text is one piece.

Scale.  A scan and a map: nothing is shuffled, broadcast or collected.  A worker
holds ``batch_bytes`` of text beside the rows that Spark sends it, and the
lengths of about ``memory_pieces`` pieces; forgetting them costs time only.

Rows.  A null or empty text has no bytes and no tokens.  Special tokens' strings
in a text count as one token each.  Bytes that aren't UTF-8 are encoded as U+FFFD.
Repeated rows and null ids come back once each; other columns are ignored; no
documents give no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from lexloom.llm.common import arrow_schema, slices

_BLANK = re.compile(rb"[\t-\r ]")


def drops_blanks(path: str) -> bool:
    """Whether the file's words are runs of letters, single digits or runs of other marks, and white space is in none of them."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    steps = (model.get("pre_tokenizer") or {}).get("pretokenizers") or [model.get("pre_tokenizer") or {}]
    first = steps[0]
    words = (first.get("pattern") or {}).get("Regex", "") if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") else ""
    return r"|[\p{N}]|" in words and words.endswith(r"|[^\s\p{L}\p{N}]+") and not any(re.search(r"\s|\d", t["content"]) or t["lstrip"] or t["rstrip"] for t in model["added_tokens"])


def windows(raw: bytes, most: int) -> Iterator[bytes]:
    """``raw`` in parts of about ``most`` bytes that end before white space."""
    at = 0
    while len(raw) - at > most and (end := _BLANK.search(raw, at + most)):
        yield raw[at : end.start()]
        at = end.end()
    yield raw[at:]


class Lengths:
    """Numbers of tokens of texts, by one vocabulary file."""

    def __init__(self, path: str, memory_pieces: int = 300_000, piece_bytes: int = 4096):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.cuts, self.memory_pieces, self.piece_bytes = drops_blanks(path), memory_pieces, piece_bytes
        self._long = re.compile(rb"(?s).{%d}.*?[0-9](?=[0-9A-Za-z])|.+" % piece_bytes)
        self.known: dict[bytes, int] = {}

    def windows(self, raw: bytes, most: int) -> Iterable[bytes]:
        return windows(raw, most) if self.cuts else (raw,)

    def pieces(self, window: bytes) -> list[bytes]:
        if not self.cuts:
            return [window] if window else []
        out = window.split()
        if any(len(p) > self.piece_bytes for p in out):
            out = [q for p in out for q in (self._long.findall(p) if len(p) > self.piece_bytes else (p,))]
        return out

    def batch(self, parts: list[bytes]) -> list[int]:
        """The tokens of each part: its pieces' lengths added up."""
        split = [self.pieces(p) for p in parts]
        new = list(set().union(*split).difference(self.known))
        if len(self.known) + len(new) > self.memory_pieces:
            self.known = {}
            new = list(set().union(*split))
        self.known.update(zip(new, self.encode([p.decode("utf-8", "replace") for p in new])))
        return [sum(map(self.known.__getitem__, p)) for p in split]


def counted(rows: Iterable[tuple], lengths: Lengths, batch_bytes: int) -> Iterator[list[list]]:
    """Lists of ``[id, bytes, tokens]`` in the order of ``rows``, pairs of id and bytes of text, each list from one batch."""
    held: list[list] = []
    jobs: list[tuple[list, bytes]] = []
    size = 0

    def flush() -> None:
        for (row, _), n in zip(jobs, lengths.batch([p for _, p in jobs])):
            row[2] += n
        jobs.clear()

    for key, raw in rows:
        row = [key, len(raw), 0]
        for part in lengths.windows(raw, batch_bytes):
            if size and size + len(part) > batch_bytes or len(jobs) >= 100_000:
                flush()
                size = 0
                if held:
                    yield held
                    held = []
            jobs.append((row, part))
            size += len(part)
        held.append(row)  # all but its last parts may be counted already
    if held:
        flush()
        yield held


@lru_cache(maxsize=2)
def worker_lengths(name: str) -> Lengths:
    import public_tokenizers

    return Lengths(public_tokenizers.path(name))


def count_tokens(docs: DataFrame, name: str = "word_bpe_49k.json", limit: int = 2048, batch_bytes: int = 4 << 20) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each row: bytes of UTF-8, tokens, and whether they are more than ``limit``."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T

    kind = T.StructType.fromDDL("doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
    schema = arrow_schema(kind)

    def rows(batches):
        for batch in slices(batches):
            texts = pc.cast(batch.column("text"), pa.binary()).to_pylist()
            yield from zip(batch.column("doc_id").to_pylist(), (t or b"" for t in texts))

    def run(batches):
        for done in counted(rows(batches), worker_lengths(name), batch_bytes):
            ids, sizes, tokens = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, kind)
