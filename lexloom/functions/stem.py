"""English stemming: the published Porter2 rules."""

from __future__ import annotations

import re

_V = "aeiouy"
#: Fixed values of the published algorithm.
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def _regions(word: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    after = re.compile(rf"[{_V}][^{_V}]")
    if r1 is None:
        m = after.search(word)
        r1 = m.end() if m else len(word)
    m = after.search(word, r1)
    return r1, m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(rf"[^{_V}][{_V}][^{_V}wxY]$", word) or re.fullmatch(rf"[{_V}][^{_V}]", word))


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def porter2(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = word.removeprefix("'")
    w = re.sub(rf"(^|(?<=[{_V}]))y", "Y", w)
    r1, r2 = _regions(w)
    # step 0 and 1a
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(rf"[{_V}].", w[:-1]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # step 1b
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and re.search(rf"[{_V}]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    # step 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # step 2
    end = _longest(w, [*_STEP2, "ogi", "li"])
    if end and len(w) - len(end) >= r1:
        if end == "ogi":
            w = w[:-1] if w[:-3].endswith("l") else w
        elif end == "li":
            w = w[:-2] if w[-3:-2] and w[-3] in _LI else w
        else:
            w = w[: -len(end)] + _STEP2[end]
    # step 3
    end = _longest(w, [*_STEP3, "ative"])
    if end and len(w) - len(end) >= r1:
        if end == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(end)] + _STEP3[end]
    # step 4
    end = _longest(w, [*_STEP4, "ion"])
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    # step 5
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
