"""Searching the words of a corpus by regular expressions with an index of three-letter pieces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # older names of the same modules
    import sre_constants as C
    import sre_parse as parser

#: The length of an indexed piece.
PIECE = 3


def piece_index(terms: DataFrame) -> DataFrame:
    """``(piece, term)``: the different pieces of each word of ``terms``; shorter words have none."""
    starts = F.sequence(F.lit(1), F.length("term") - (PIECE - 1))
    pieces = F.when(F.length("term") >= PIECE, F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("term"), i, F.lit(PIECE)))))
    return terms.select("term").distinct().select("term", F.explode(pieces).alias("piece")).select("piece", "term")


def _runs(tokens, out: list[str]) -> None:
    """Texts that every match of a parsed pattern holds, added to ``out``; the last one may go on."""
    for op, value in tokens:
        if op is C.LITERAL:
            out[-1] += chr(value)
        elif op is C.SUBPATTERN and not value[1] and not value[2]:
            _runs(value[3], out)
        elif op is C.MAX_REPEAT and value[0] >= 1:
            out.append("")
            _runs(value[2], out)
            out.append("")
        elif op is not C.AT:  # the beginning and the end take no letters
            out.append("")


def required(pattern: str) -> list[str]:
    """Pieces that every word that matches must hold; none if the pattern can't be read or may ignore case."""
    try:
        parsed = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    if parsed.state.flags & (re.IGNORECASE | re.VERBOSE):
        return []
    runs = [""]
    _runs(parsed, runs)
    return sorted({r[i : i + PIECE] for r in runs for i in range(len(r) - PIECE + 1)})


def candidates(index: DataFrame, pieces: list[str]) -> DataFrame:
    """``(term)`` of words that have all ``pieces``, read from their rows of the index alone."""
    return index.where(F.col("piece").isin(pieces)).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") == len(pieces)).select("term")


def matching_terms(terms: DataFrame, index: DataFrame, pattern: str) -> DataFrame:
    """``(term)`` of the words that match ``pattern``: of candidates by the index, of all where the pattern names no piece."""
    pieces = required(pattern)
    found = candidates(index, pieces) if pieces else terms.select("term").distinct()
    return found.where(F.col("term").rlike(pattern))
