"""Secret scans by token efficiency.

Besides fixed patterns, a run of ``[A-Za-z0-9+/_=-]`` counts as a secret if a
tiktoken vocabulary needs so many tokens for it that there are at most
``most_ratio`` characters to a token: natural words and names are cheaper.
Known digests (hex of a usual digest length that no pattern claims), UUIDs,
numbers and identifiers made of words are left out first, as are runs without
a digit or without a letter.  What a run holds is judged part by part: as a
whole, and then every part between separators and every remainder beside a base
span, so that words next to a secret don't hide it.

Spans are ``kind:start:end`` in code points, end exclusive, over the whole
match.  Kinds: assign, access, hex, random.  A random span never overlaps a
base one, so base spans stay as they are.

Scale.  One pass over the texts, no shuffle.  Byte tables rule out nearly all
texts before any pattern runs.

Rows.  A null text is empty; rows come back once each with their ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from lexloom.llm.common import arrow_map, slices

#: Fixed values.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
DIGESTS = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: A part of an identifier: words in one case or in camel case, then a short number.
PART = re.compile(r"[a-z]*(?:[A-Z][a-z]+)*[0-9]{0,4}|[A-Z]{0,12}[0-9]{0,4}")
JOINTS = re.compile(r"[_/+=-]+")
#: What may lie between the parts of a run, the strongest first: a part without one is split at the next.
SEPARATORS = ("=", "/", "+", "_", "-")

_HEX_TABLE = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_RUN_TABLE = bytes(49 if RUN.fullmatch(chr(b)) and b < 128 else 48 for b in range(256))


@lru_cache(maxsize=2)
def vocabulary(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches."""
    low, found = raw.lower(), []
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"1" * 24 in raw.translate(_HEX_TABLE):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def known(run: str) -> bool:
    """Digests, UUIDs, numbers and names aren't secrets."""
    digest = len(run) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run)
    return bool(digest or UUID.fullmatch(run) or all(map(PART.fullmatch, JOINTS.split(run)))) or not (re.search("[0-9]", run) and re.search("[A-Za-z]", run))


def _merged(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """Sorted spans as stretches that neither touch nor overlap."""
    out: list[list[int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _free(runs, taken: list[list[int]]):
    """The stretches of the runs, which come in order, that no stretch of ``taken`` covers: one pass over both."""
    k = 0
    for a, b in runs:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        i = k
        while i < len(taken) and taken[i][0] < b:
            if a < taken[i][0]:
                yield a, taken[i][0]
            a = max(a, taken[i][1])
            i += 1
        if a < b:
            yield a, b


def _random(text: str, a: int, b: int, encode, least: int, most_ratio: float) -> list[tuple[int, int]]:
    """The random spans of a stretch: the whole of it, or else those of its parts."""
    part = text[a:b]
    if b - a < least or known(part):
        return []
    if b - a <= most_ratio * len(encode(part)):
        return [(a, b)]
    split = next((c for c in SEPARATORS if c in part), None)
    found = []
    if split:
        for x in re.finditer(f"[^{re.escape(split)}]+", part):
            found += _random(text, a + x.start(), a + x.end(), encode, least, most_ratio)
    return found


def scan(text: str | None, tokens="byte_bpe_50k.tiktoken", least: int = 16, most_ratio: float = 2.0) -> list[tuple[int, int, int]]:
    """All spans of a text, by start, then kind."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    found = base_spans(text, raw)
    if b"1" * least not in raw.translate(_RUN_TABLE):
        return found
    taken, encode = _merged(found), vocabulary(tokens).encode_ordinary
    runs = (m.span() for m in RUN.finditer(text) if m.end() - m.start() >= least)
    for a, b in _free(runs, taken):
        found += [(a, 3, b) for a, b in _random(text, a, b, encode, least, most_ratio)]
    return sorted(found)


def scan_frame(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random)``."""
    kind = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"

    def run(ids, texts):
        out = {k.split()[0]: [] for k in kind.split(", ")}
        for doc_id, text in zip(ids, texts):
            spans = scan(text, **options)
            told = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
            out["doc_id"].append(doc_id)
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(sum(s[1] == k for s in spans))
            base = ",".join(t for t, s in zip(told, spans) if s[1] < 3)
            out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            out["spans"].append(",".join(told))
        return out

    return arrow_map(docs, kind, run, "doc_id", "text")


def redact(text: str | None, mark: str = "[secret]", **options) -> str | None:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in scan(text, **options):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return text if not out else "".join([*out, text[at:]])


def redact_frame(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with redacted texts, all other columns kept; ``n_chars``, if there, is the new length."""
    import pyarrow as pa

    def run(batches):
        for batch in slices(batches):
            old = batch.column("text").to_pylist()
            new = [redact(t, **options) for t in old]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            at = batch.schema.get_field_index("n_chars")
            if at >= 0:
                kept = batch.column(at).to_pylist()
                lengths = [n if a == b else len(b) for a, b, n in zip(old, new, kept)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(lengths, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
