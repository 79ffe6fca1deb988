"""Text expressions: normalising, tokenising and n-grams, all inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a normalised text keeps: letters, numbers, underscore and the blank.
NOT_WORD = r"[^\p{L}\p{N}_ ]+"


def normalise(text: Column, sep: str = "") -> Column:
    """Lower-case and replace every run of other characters by ``sep``.

    With the default ``sep`` line ends vanish too, so the words on both
    sides of one fuse; ``sep=" "`` keeps them apart.  Null gives null.
    """
    return F.regexp_replace(F.lower(text), NOT_WORD, sep)


def tokens(text: Column, sep: str = "") -> Column:
    """The blank-separated words of the normalised text; null or blank gives none."""
    return F.coalesce(F.filter(F.split(normalise(text, sep), " +"), lambda w: w != ""), F.array().cast("array<string>"))


def ngrams(words: Column, n: int) -> Column:
    """Every run of ``n`` neighbours, as arrays.

    Shifted slices are zipped: a lambda that indexes ``words`` would have it
    computed again for each element.
    """
    if n == 1:
        return F.transform(words, lambda w: F.array(w))
    starts = F.greatest(F.size(words) - (n - 1), F.lit(0))
    shifted = F.arrays_zip(*(F.slice(words, k + 1, starts) for k in range(n)))
    return F.transform(shifted, lambda z: F.array(*(z[str(k)] for k in range(n))))


def admissible_word(word: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Letters only and not a stop word."""
    return word.rlike(r"^\p{L}+$") & ~(word.isin(*stop_words) if stop_words else F.lit(False))


def admissible(gram: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """All words of a gram are letters only and none is a stop word."""
    return F.forall(gram, lambda w: admissible_word(w, stop_words))
