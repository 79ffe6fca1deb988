"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus's frequent words are compiled into the minimal acyclic automaton
of their bytes, suffixes shared.  Each arc has a number, and the numbers along
a word's path add up to the word's row in the lexicon, whose output is the
word's token ids.  The automaton lies in one file that workers memory-map, and
a block's new words walk it together.  Words that it lacks are merged exactly,
by the vocabulary's merge ranks.

Texts are normalised and split as the vocabulary file says.  Texts of
characters on which Unicode versions may differ go through the tokenizers
library's own normaliser and splitter, word by word the same afterwards.

Scale.  Word counts are summed in each batch before their shuffle.  The
lexicon has at most ``lexicon_words`` words, whatever the corpus; it is only a
store of merges already done, so its size never changes a result.  A worker
remembers about twice ``memory_words`` further words at most, and those of a
block.

Rows.  A null or empty text has no ids and decodes to ''.  Special tokens'
strings in a text are their ids.  Rows come back once each, null ids too; no
documents give an empty lexicon and no rows.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import arrow_map, frequent, shared_file, written

#: Characters on which all Unicode versions agree and that need no special lower-casing.
_NOT_PLAIN = re.compile("[^\u0000-\u001b -\u0084\u0086-˿Ḁ-ỿ‐-‧‰-⁞€]")
#: Fixed value: the vocabulary's own pattern.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else the next from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Vocabulary:
    """Normalising, splitting, merging and decoding for one vocabulary file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.ids: dict[str, int] = model["model"]["vocab"]
        self.ranks = {tuple(m): k for k, m in enumerate(model["model"]["merges"])}
        self.end = model["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self._specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self._split = regex.compile(_WORD).findall
        self._letters = byte_letters()
        self._bytes = {ord(c): b for b, c in self._letters.items()}

    def chunks(self, text: str) -> list:
        """The text as white-space-free chunks, special ids and, where library rules decide, tuples of words."""
        if "<|" not in text:
            return self._part(text)
        out = []
        for part in self._specials.split(text):
            out += [self.special[part]] if part in self.special else self._part(part)
        return out

    def _part(self, text: str) -> list:
        if text.isascii():
            if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
                return text.lower().split()
        elif not _NOT_PLAIN.search(text) and unicodedata.is_normalized("NFC", text):
            return text.lower().split()
        normal = self.library.normalizer.normalize_str(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [tuple(bytes(self._bytes[ord(c)] for c in w) for w, _ in found)]

    def words(self, chunk) -> tuple[bytes, ...]:
        if isinstance(chunk, tuple):
            return chunk
        if chunk.isalpha():  # letters alone are one word
            return (chunk.encode("utf-8", "surrogatepass"),)
        return tuple(w.encode("utf-8", "surrogatepass") for w in self._split(chunk))

    def merge(self, word: bytes) -> list[int]:
        """The word's ids: again and again the best-ranked pair, the leftmost of equals, becomes one symbol."""
        symbols = [self._letters[b] for b in word]
        symbols[-1] += self.end
        symbols = self._merge_short(symbols) if len(symbols) <= 64 else self._merge_long(symbols)
        return [self.ids[s] for s in symbols if s in self.ids]

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The pairs' ranks lie beside the symbols; a merge renews its two neighbours."""
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(pair, none) for pair in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def _merge_long(self, symbols: list) -> list[str]:
        """The same by a queue of pairs, for words whose scans would be quadratic."""
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (r := ranks.get((symbols[left], symbols[right]))) is not None:
                    heapq.heappush(queue, (r, left, symbols[left], symbols[right]))
        return [s for s in symbols if s is not None]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes where the file names no decoder: token strings joined by blanks."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name))


def compile_words(words: list[bytes], outputs: list[list[int]]) -> bytes:
    """The transducer file: the minimal automaton of distinct ``words``, and their outputs in byte order."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    counts: list[int] = []  # words below each finished state
    arcs: list[tuple] = []  # (byte, target) of each finished state
    finals: list[bool] = []
    path: list[tuple[bool, list]] = [(False, [])]  # the states of the last word, not finished yet

    def finish(state: tuple[bool, list]) -> int:
        key = (state[0], *state[1])
        found = register.get(key)
        if found is None:
            found = register[key] = len(counts)
            counts.append(state[0] + sum(counts[t] for _, t in state[1]))
            arcs.append(tuple(state[1]))
            finals.append(state[0])
        return found

    def close(depth: int, word: bytes) -> None:
        while len(path) - 1 > depth:
            target = finish(path.pop())
            path[-1][1].append((word[len(path) - 1], target))

    last = b""
    for k in order:
        word, common = words[k], 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common, last)
        path.extend((False, []) for _ in word[common:])
        path[-1] = (True, path[-1][1])
        last = word
    close(0, last)
    root = finish(path[0])
    keys, targets, numbers = [], [], []
    for state, out in enumerate(arcs):
        number = int(finals[state])
        for byte, target in out:
            keys.append(state << 8 | byte)
            targets.append(target)
            numbers.append(number)
            number += counts[target]
    lengths = [len(outputs[k]) for k in order]
    parts = {
        "root": np.array([root], dtype=np.int64), "keys": np.array(keys, dtype=np.int64), "targets": np.array(targets, dtype=np.int32), "numbers": np.array(numbers, dtype=np.int32),
        "finals": np.array(finals, dtype=np.uint8), "starts": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), "ids": np.array([i for k in order for i in outputs[k]], dtype="<u4"),
        "longest": np.array([max(map(len, words), default=0)], dtype=np.int64),
    }
    head, at, body = {}, 0, []
    for name, a in parts.items():
        head[name] = (a.dtype.str, len(a), at)
        raw = a.tobytes()
        raw += b"\0" * (-len(raw) % 16)
        body.append(raw)
        at += len(raw)
    told = json.dumps(head).encode()
    told += b" " * (-(len(told) + 8) % 16)
    return len(told).to_bytes(8, "little") + told + b"".join(body)


class Lexicon:
    """A memory-mapped transducer file."""

    def __init__(self, path: str):
        whole = np.memmap(path, dtype=np.uint8, mode="r")
        head = int.from_bytes(bytes(whole[:8]), "little")
        for name, (kind, n, at) in json.loads(bytes(whole[8 : 8 + head])).items():
            kind = np.dtype(kind)
            # a plain view of the mapped pages: slicing a memmap object is slow
            setattr(self, name, np.asarray(whole[8 + head + at : 8 + head + at + n * kind.itemsize]).view(kind))

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The lexicon row of each word, -1 for words it lacks; all words take each step together."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(words) else lengths
        letters = np.frombuffer(b"".join(words), dtype=np.uint8)
        row = np.full(len(words), -1, dtype=np.int64)
        alive = np.flatnonzero(lengths <= self.longest[0])
        state, number = np.full(len(alive), self.root[0], dtype=np.int64), np.zeros(len(alive), dtype=np.int64)
        depth = 0
        while len(alive) and len(self.keys):
            ended = lengths[alive] == depth
            if ended.any():
                good = self.finals[state[ended]] == 1
                row[alive[ended][good]] = number[ended][good]
                alive, state, number = alive[~ended], state[~ended], number[~ended]
            key = state << 8 | letters[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            alive, at = alive[hit], at[hit]
            state, number = self.targets[at].astype(np.int64), number[hit] + self.numbers[at]
            depth += 1
        return row

    def output(self, row: int) -> np.ndarray:
        return self.ids[self.starts[row] : self.starts[row + 1]]


class Encoder:
    """Encodes blocks of texts by a lexicon, merging what it lacks."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon, memory_words: int = 200_000):
        self.vocab, self.lexicon, self.most = vocab, lexicon, memory_words
        self.special = {i: array.array("I", [i]).tobytes() for i in vocab.special.values()}
        self.memory, self.older = dict(self.special), {}

    def _learn(self, chunks: set) -> dict:
        """Ids of chunks not yet remembered."""
        split = {c: self.vocab.words(c) for c in chunks}
        words = list({w for own in split.values() for w in own})
        known = {}
        for w, row in zip(words, self.lexicon.rows(words).tolist()):
            known[w] = self.lexicon.output(row).tobytes() if row >= 0 else array.array("I", self.vocab.merge(w)).tobytes()
        return {c: b"".join(map(known.__getitem__, own)) for c, own in split.items()}

    def block(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.vocab.chunks(t) if t else [] for t in texts]
        needed = set().union(*split)
        if len(self.memory) > self.most:  # what isn't used again by the next time goes
            self.memory, self.older = dict(self.special), self.memory
        new = needed - self.memory.keys()
        again = new & self.older.keys()
        self.memory.update((c, self.older[c]) for c in again)
        self.memory.update(self._learn(new - again))
        return [b"".join(map(self.memory.__getitem__, c)) for c in split]


def blocks(texts: list, most_chars: int = 2_000_000):
    """Slices of a batch of about so many characters, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most_chars:
            yield slice(start, i)
            start, size = i, 0
        size += len(t or "")
    yield slice(start, len(texts))


def word_counts(docs: DataFrame, name: str) -> DataFrame:
    """``(word, n)`` over all documents, by the vocabulary's own splitting."""

    def count(texts):
        vocab, found, own = vocabulary(name), Counter(), Counter()

        def split():
            for c, n in own.items():
                if not isinstance(c, int):
                    for w in vocab.words(c):
                        found[w] += n
            own.clear()

        for t in texts:
            if t:
                own.update(vocab.chunks(t))
                if len(own) > 500_000:
                    split()
        split()
        return {"word": list(found), "n": list(found.values())}

    return arrow_map(docs, "word binary, n bigint", count, "text", rows=None).groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(spark: SparkSession, counts: DataFrame, name: str, lexicon_words: int = 65_536) -> str:
    """Compile the most frequent words; returns the file name that ``SparkFiles.get`` finds."""
    vocab = vocabulary(name)
    words = sorted(bytes(r["word"]) for r in frequent(counts, lexicon_words).select("word").collect())
    data = compile_words(words, [vocab.merge(w) for w in words])
    return shared_file(spark, data, f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin")


@lru_cache(maxsize=1)
def worker_encoder(name: str, file: str) -> Encoder:
    from pyspark import SparkFiles

    return Encoder(vocabulary(name), Lexicon(SparkFiles.get(file)))


def round_trip(docs: DataFrame, name: str = "word_bpe_49k.json", lexicon_words: int = 65_536) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode every text, decode its ids, digest both."""
    counts = written(word_counts(docs, name), "bpe-counts")
    file = build_lexicon(docs.sparkSession, counts, name, lexicon_words)

    def run(ids, texts):
        encoder, out = worker_encoder(name, file), {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for part in blocks(texts):
            for raw in encoder.block(texts[part]):
                out["n_tokens"].append(len(raw) // 4)
                out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                decoded = encoder.vocab.decode(memoryview(raw).cast("I").tolist())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
        return out

    return arrow_map(docs, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", run, "doc_id", "text")
