"""Stemmers of ten languages by the published Snowball rules, and ``stem`` for these and English.

One engine serves all: a table of endings is compiled into a tree of their
letters from the last one on, so the longest ending of a word is found in one
walk back, not below a given place.  A language is a few tables and what is
done to the endings found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

from lexloom.functions.stem import porter2


class Endings:
    """A table of endings, each with what it stands for."""

    def __init__(self, table: dict[str, str] | Iterable[str]):
        self.root: dict = {}
        for ending, value in (table.items() if isinstance(table, dict) else ((e, "") for e in table)):
            node = self.root
            for letter in reversed(ending):
                node = node.setdefault(letter, {})
            node[""] = (ending, value)

    def longest(self, word: str, start: int = 0) -> tuple[str, str]:
        """The longest ending of ``word[start:]`` and its value, empty if there is none."""
        node, found = self.root, ("", "")
        for at in range(len(word) - 1, start - 1, -1):
            node = node.get(word[at])
            if node is None:
                break
            found = node.get("", found)
        return found


def table(**groups: str) -> Endings:
    """Endings in groups, each ending with the name of its group."""
    return Endings({e: name for name, endings in groups.items() for e in endings.split()})


def after_vowel_pair(word: str, vowels: str, start: int = 0) -> int:
    """The place after the first vowel and the first other letter behind it."""
    for at in range(start + 1, len(word)):
        if word[at - 1] in vowels and word[at] not in vowels:
            return at + 1
    return len(word)


def regions(word: str, vowels: str, least: int = 0) -> tuple[int, int]:
    """Where the first and second region begin; the second doesn't follow ``least``."""
    first = after_vowel_pair(word, vowels)
    return max(first, min(least, len(word))), after_vowel_pair(word, vowels, first)


def romance_region(word: str, vowels: str) -> int:
    """Where the verb endings' region begins in Spanish, Italian and Portuguese."""
    if len(word) < 2:
        return len(word)
    if word[1] not in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] in vowels), len(word))
    if word[0] in vowels:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in vowels), len(word))
    return min(3, len(word))


def marked(word: str, vowels: str, between: str) -> str:
    """Letters of ``between`` that stand between vowels, in upper case."""
    out = list(word)
    for i in range(1, len(word) - 1):
        if word[i] in between and out[i - 1] in vowels and word[i + 1] in vowels:
            out[i] = word[i].upper()
    return "".join(out)


def cut(word: str, region: int, *endings: str) -> str:
    """``word`` without the first of ``endings`` that it has within the region."""
    for e in endings:
        if word.endswith(e):
            return word[: -len(e)] if len(word) - len(e) >= region else word
    return word


# German

_DE_VOWELS = "aeiouyäöü"
_DE1 = table(a="em ern er", b="e en es", s="s")
_DE2 = table(a="en er est", st="st")
_DE3 = table(end="end ung", ig="ig ik isch", lich="lich heit", keit="keit")


def german(word: str) -> str:
    w = marked(word.replace("ß", "ss"), _DE_VOWELS, "uy")
    r1, r2 = regions(w, _DE_VOWELS, 3)
    end, kind = _DE1.longest(w)
    left = w[: len(w) - len(end)]
    if end and len(left) >= r1:
        if kind == "s":
            w = left if left[-1:] in tuple("bdfghklmnrt") else w
        else:
            w = left[:-1] if kind == "b" and left.endswith("niss") else left
    end, kind = _DE2.longest(w)
    left = w[: len(w) - len(end)]
    if end and len(left) >= r1 and (kind == "a" or len(left) >= 4 and left[-1] in "bdfghklmnt"):
        w = left
    end, kind = _DE3.longest(w)
    left = w[: len(w) - len(end)]
    if end and len(left) >= r2:
        if kind == "end":
            w = left
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
        elif kind == "ig":
            w = w if left.endswith("e") else left
        elif kind == "lich":
            w = cut(left, r1, "er", "en")
        else:
            w = cut(left, r2, "lich", "ig")
    return w.translate(str.maketrans("UYäöü", "uyaou"))


# Spanish

_ES_VOWELS = "aeiouáéíóúü"
_ACUTE = str.maketrans("áéíóú", "aeiou")
_ES_PRONOUNS = Endings("me se sela selo selas selos la le lo las les los nos".split())
_ES_GERUNDS = table(accent="iéndo ándo ár ér ír", plain="ando iendo ar er ir", y="yendo")
_ES1 = table(
    cut="anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos", ic="adora ador ación adoras adores aciones ante antes ancia ancias",
    log="logía logías", u="ución uciones", ente="encia encias", amente="amente", mente="mente", idad="idad idades", iva="iva ivo ivas ivos",
)
_ES2A = Endings("ya ye yan yen yeron yendo yo yó yas yes yais yamos".split())
_ES2B = table(
    gu="en es éis emos",
    cut="arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos",
)
_ES3 = table(cut="os a o á í ó", gu="e é")


def spanish(word: str) -> str:
    w = word
    (r1, r2), rv = regions(w, _ES_VOWELS), romance_region(w, _ES_VOWELS)
    end, _ = _ES_PRONOUNS.longest(w)
    if end:
        left = w[: -len(end)]
        before, kind = _ES_GERUNDS.longest(left, rv)
        if kind == "accent":
            w = left[: -len(before)] + before.translate(_ACUTE)
        elif kind == "plain" or kind == "y" and left.endswith("uyendo"):
            w = left
    before = w
    end, kind = _ES1.longest(w)
    left = w[: len(w) - len(end)]
    if end and len(left) >= (r1 if kind == "amente" else r2):
        w = {"log": left + "log", "u": left + "u", "ente": left + "ente"}.get(kind, left)
        if kind == "ic":
            w = cut(w, r2, "ic")
        elif kind == "amente":
            w = _after_amente(w, r2, "os", "ic", "ad")
        elif kind == "mente":
            w = cut(w, r2, "ante", "able", "ible")
        elif kind == "idad":
            w = cut(w, r2, "abil", "ic", "iv")
        elif kind == "iva":
            w = cut(w, r2, "at")
        changed = True
    else:
        changed = False
    if not changed:
        end, _ = _ES2A.longest(w, rv)
        if end and w[: -len(end)].endswith("u"):
            w = w[: -len(end)]
        else:
            end, kind = _ES2B.longest(w, rv)
            if end:
                w = w[: -len(end)]
                if kind == "gu" and w.endswith("gu"):
                    w = w[:-1]
    end, kind = _ES3.longest(w, rv)
    if end:
        w = w[: -len(end)]
        if kind == "gu" and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ACUTE)


def _after_amente(w: str, r2: int, *others: str) -> str:
    if w.endswith("iv"):
        return cut(w[:-2], r2, "at") if len(w) - 2 >= r2 else w
    return cut(w, r2, *others)


# French

_FR_VOWELS = "aeiouyâàëéêèïîôûù"
_FR1 = table(
    cut="ance iqUe isme able iste eux ances iqUes ismes ables istes", ic="atrice ateur ation atrices ateurs ations", log="logie logies", u="usion ution usions utions", ent="ence ences", ement="ement ements",
    ite="ité ités", iv="if ive ifs ives", eau="eaux", al="aux", eux="euse euses", issement="issement issements", amment="amment", emment="emment", ment="ment ments",
)
_FR2A = Endings("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split())
_FR2B = table(ions="ions", cut="é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez", a="âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions")
_FR4 = table(ion="ion", i="ier ière Ier Ière", e="e", gu="ë")


def _french_marked(word: str) -> str:
    out = list(word)
    for i, c in enumerate(word):
        before, after = out[i - 1] if i else "", word[i + 1] if i + 1 < len(word) else ""
        left, right = before != "" and before in _FR_VOWELS, after != "" and after in _FR_VOWELS
        if c in "ui" and left and right or c == "y" and (left or right) or c == "u" and before == "q":
            out[i] = c.upper()
    return "".join(out)


def _french_region(w: str) -> int:
    if w.startswith(("par", "col", "tap")):
        return 3
    if len(w) > 1 and w[0] in _FR_VOWELS and w[1] in _FR_VOWELS:
        return min(3, len(w))
    return next((i + 1 for i in range(1, len(w)) if w[i] in _FR_VOWELS), len(w))


def _french_suffix(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool, bool]:
    """The word, whether an ending was replaced, and whether verb endings are to be looked for all the same."""
    end, kind = _FR1.longest(w)
    left = w[: len(w) - len(end)]
    n = len(left)
    if kind in ("cut", "ic", "log", "u", "ent", "ite", "iv") and n >= r2:
        w = {"log": left + "log", "u": left + "u", "ent": left + "ent"}.get(kind, left)
        if kind == "ic" and w.endswith("ic"):
            w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif kind == "ite":
            for e, other in (("abil", "abl"), ("ic", "iqU"), ("iv", "iv")):
                if w.endswith(e):
                    w = w[: -len(e)] + ("" if len(w) - len(e) >= r2 else other)
                    break
        elif kind == "iv" and w.endswith("at") and len(w) - 2 >= r2:
            w = w[:-2]
            if w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        return w, True, False
    if kind == "ement" and n >= rv:
        w = left
        if w.endswith("iv") and n - 2 >= r2:
            w = cut(w[:-2], r2, "at")
        elif w.endswith("eus"):
            w = w[:-3] if n - 3 >= r2 else w[:-1] + "x" if n - 3 >= r1 else w
        elif w.endswith(("abl", "iqU")):
            w = w[:-3] if n - 3 >= r2 else w
        elif w.endswith(("ièr", "Ièr")) and n - 3 >= rv:
            w = w[:-3] + "i"
        return w, True, False
    if kind == "eau":
        return left + "eau", True, False
    if kind == "al" and n >= r1:
        return left + "al", True, False
    if kind == "eux" and n >= r1:
        return left if n >= r2 else left + "eux", True, False
    if kind == "issement" and n >= r1 and left and left[-1] not in _FR_VOWELS:
        return left, True, False
    if kind in ("amment", "emment") and n >= rv:
        return left + ("ant" if kind == "amment" else "ent"), True, True
    if kind == "ment" and left and left[-1] in _FR_VOWELS and n - 1 >= rv:
        return left, True, True
    return w, False, True


def french(word: str) -> str:
    w = _french_marked(word)
    (r1, r2), rv = regions(w, _FR_VOWELS), _french_region(w)
    w, changed, more = _french_suffix(w, rv, r1, r2)
    if more:
        verb = False
        end, _ = _FR2A.longest(w, rv)
        left = w[: len(w) - len(end)]
        if end and len(left) > rv and left[-1] not in _FR_VOWELS:
            w, verb = left, True
        else:
            end, kind = _FR2B.longest(w, rv)
            left = w[: len(w) - len(end)]
            if end and (kind != "ions" or len(left) >= r2):
                w, verb = left, True
                if kind == "a" and w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
        changed = verb
    if changed:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        end, kind = _FR4.longest(w, rv)
        left = w[: len(w) - len(end)]
        if kind == "ion":
            w = left if len(left) >= r2 and len(left) > rv and left[-1] in "st" else w
        elif kind == "i":
            w = left + "i"
        elif kind == "e" or kind == "gu" and left.endswith("gu") and len(left) - 2 >= rv:
            w = left
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    at = len(w) - 1
    while at >= 0 and w[at] not in _FR_VOWELS:
        at -= 1
    if 0 <= at < len(w) - 1 and w[at] in "éè":
        w = w[:at] + "e" + w[at + 1 :]
    return w.translate(str.maketrans("IUY", "iuy"))


# Italian

_IT_VOWELS = "aeiouàèìòù"
_IT_PRONOUNS = Endings("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split())
_IT_GERUNDS = table(cut="ando endo", e="ar er ir")
_IT1 = table(
    cut="anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti", ic="azione azioni atore atori", log="logia logie",
    u="uzione uzioni usione usioni", ente="enza enze", amento="amento amenti imento imenti", amente="amente", ita="ità", iv="ivo ivi iva ive",
)
_IT2 = Endings(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete "
    "eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo "
    "ono uta ute uti uto ar ir".split()
)


def italian(word: str) -> str:
    w = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    w = marked(w, _IT_VOWELS, "ui")
    (r1, r2), rv = regions(w, _IT_VOWELS), romance_region(w, _IT_VOWELS)
    end, _ = _IT_PRONOUNS.longest(w)
    if end:
        left = w[: -len(end)]
        _, kind = _IT_GERUNDS.longest(left, rv)
        w = left if kind == "cut" else left + "e" if kind == "e" else w
    end, kind = _IT1.longest(w)
    left = w[: len(w) - len(end)]
    if end and len(left) >= {"amento": rv, "amente": r1}.get(kind, r2):
        w = {"log": left + "log", "u": left + "u", "ente": left + "ente"}.get(kind, left)
        if kind == "ic":
            w = cut(w, r2, "ic")
        elif kind == "amente":
            w = _after_amente(w, r2, "os", "ic", "abil")
        elif kind == "ita":
            w = cut(w, r2, "abil", "ic", "iv")
        elif kind == "iv" and w.endswith("at") and len(w) - 2 >= r2:
            w = cut(w[:-2], r2, "ic")
    else:
        end, _ = _IT2.longest(w, rv)
        w = w[: len(w) - len(end)]
    if len(w) > rv and w[-1] in "aeioàèìò":
        w = w[:-1]
        if len(w) > rv and w[-1] == "i":
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.translate(str.maketrans("IU", "iu"))


# Portuguese

_PT_VOWELS = "aeiouáéíóúâêô"
_PT1 = table(
    cut="eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância", log="logia logias", u="uça~o uço~es",
    ente="ência ências", amente="amente", mente="mente", idade="idade idades", iva="iva ivo ivas ivos", ira="ira iras",
)
_PT2 = Endings(
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o "
    "ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis "
    "ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras".split()
)
_PT4 = Endings("os a i o á í ó".split())
_PT5 = table(e="e é ê", c="ç")


def portuguese(word: str) -> str:
    w = word.replace("ã", "a~").replace("õ", "o~")
    (r1, r2), rv = regions(w, _PT_VOWELS), romance_region(w, _PT_VOWELS)
    end, kind = _PT1.longest(w)
    left = w[: len(w) - len(end)]
    changed = False
    if kind == "ira":
        if len(left) >= rv and left.endswith("e"):
            w, changed = left + "ir", True
    elif end and len(left) >= (r1 if kind == "amente" else r2):
        w, changed = {"log": left + "log", "u": left + "u", "ente": left + "ente"}.get(kind, left), True
        if kind == "amente":
            w = _after_amente(w, r2, "os", "ic", "ad")
        elif kind == "mente":
            w = cut(w, r2, "ante", "avel", "ível")
        elif kind == "idade":
            w = cut(w, r2, "abil", "ic", "iv")
        elif kind == "iva":
            w = cut(w, r2, "at")
    if not changed:
        end, _ = _PT2.longest(w, rv)
        if end:
            w, changed = w[: -len(end)], True
    if changed:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        end, _ = _PT4.longest(w, rv)
        w = w[: len(w) - len(end)]
    end, kind = _PT5.longest(w)
    if kind == "e" and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    elif kind == "c":
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


# Dutch

_NL_VOWELS = "aeiouyè"
_NL1 = table(heid="heden", en="en ene", s="s se")
_NL3 = table(end="end ing", ig="ig", lijk="lijk", baar="baar", bar="bar")


def _undoubled(w: str) -> str:
    return w[:-1] if w.endswith(("kk", "dd", "tt")) else w


def _dutch_en(w: str, n: int, r1: int) -> str:
    """``w`` without its last ``n`` letters, an ending en, where that is allowed."""
    left = w[: len(w) - n]
    return _undoubled(left) if len(left) >= r1 and left and left[-1] not in _NL_VOWELS and not left.endswith("gem") else w


def _dutch_e(w: str, r1: int) -> tuple[str, bool]:
    if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in _NL_VOWELS:
        return _undoubled(w[:-1]), True
    return w, False


def dutch(word: str) -> str:
    w = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    out = list(w)
    for i, c in enumerate(w):
        before = i > 0 and out[i - 1] in _NL_VOWELS
        if c == "y" and (i == 0 or before) or c == "i" and before and i + 1 < len(w) and w[i + 1] in _NL_VOWELS:
            out[i] = c.upper()
    w = "".join(out)
    r1, r2 = regions(w, _NL_VOWELS, 3)
    end, kind = _NL1.longest(w)
    left = w[: len(w) - len(end)]
    if kind == "heid" and len(left) >= r1:
        w = left + "heid"
    elif kind == "en":
        w = _dutch_en(w, len(end), r1)
    elif kind == "s" and len(left) >= r1 and left and left[-1] not in _NL_VOWELS + "j":
        w = left
    w, removed = _dutch_e(w, r1)
    if w.endswith("heid") and len(w) - 4 >= r2 and not w.endswith("cheid"):
        w = w[:-4]
        if w.endswith("en"):
            w = _dutch_en(w, 2, r1)
    end, kind = _NL3.longest(w)
    left = w[: len(w) - len(end)]
    if end and len(left) >= r2:
        if kind == "end":
            w = left
            w = w[:-2] if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig") else _undoubled(w)
        elif kind == "ig":
            w = w if left.endswith("e") else left
        elif kind == "lijk":
            w = _dutch_e(left, r1)[0]
        elif kind == "baar" or removed:
            w = left
    if len(w) >= 4 and w[-4] not in _NL_VOWELS and w[-3:-1] in ("aa", "ee", "oo", "uu") and w[-1] not in _NL_VOWELS + "I":
        w = w[:-2] + w[-1]
    return w.translate(str.maketrans("IY", "iy"))


# Swedish, Norwegian, Danish

_SV1 = table(cut="a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast", s="s")
_SV2 = Endings("dd gd nn dt gt kt tt".split())
_SV3 = table(cut="lig ig els", last="löst fullt")


def swedish(word: str) -> str:
    w = word
    r1, _ = regions(w, "aeiouyäåö", 3)
    end, kind = _SV1.longest(w, r1)
    if kind == "cut" or kind == "s" and w[-2:-1] and w[-2] in "bcdfghjklmnoprtvy":
        w = w[: -len(end)]
    if _SV2.longest(w, r1)[0]:
        w = w[:-1]
    end, kind = _SV3.longest(w, r1)
    return w[: -len(end)] if kind == "cut" else w[:-1] if kind == "last" else w


_NO_VOWELS = "aeiouyæåø"
_NO1 = table(cut="a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast", s="s", er="erte ert")
_NO2 = Endings(["dt", "vt"])
_NO3 = Endings("leg eleg ig eig lig elig els lov elov slov hetslov".split())


def norwegian(word: str) -> str:
    w = word
    r1, _ = regions(w, _NO_VOWELS, 3)
    end, kind = _NO1.longest(w, r1)
    if kind == "cut":
        w = w[: -len(end)]
    elif kind == "er":
        w = w[: -len(end)] + "er"
    elif kind == "s" and w[-2:-1] and (w[-2] in "bcdfghjlmnoprtvyz" or w[-2] == "k" and len(w) > 2 and w[-3] not in _NO_VOWELS):
        w = w[:-1]
    if _NO2.longest(w, r1)[0]:
        w = w[:-1]
    return w[: len(w) - len(_NO3.longest(w, r1)[0])]


_DA_VOWELS = "aeiouyæåø"
_DA1 = table(cut="hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret", s="s")
_DA2 = Endings("gd dt gt kt".split())
_DA3 = table(cut="ig lig elig els", last="løst")


def danish(word: str) -> str:
    w = word
    r1, _ = regions(w, _DA_VOWELS, 3)
    end, kind = _DA1.longest(w, r1)
    if kind == "cut" or kind == "s" and w[-2:-1] and w[-2] in "abcdfghjklmnoprtvyzå":
        w = w[: -len(end)]
    if _DA2.longest(w, r1)[0]:
        w = w[:-1]
    if w.endswith("igst"):
        w = w[:-2]
    end, kind = _DA3.longest(w, r1)
    if kind == "cut":
        w = w[: -len(end)]
        if _DA2.longest(w, r1)[0]:
            w = w[:-1]
    elif kind == "last":
        w = w[:-1]
    return w[:-1] if len(w) - 1 >= r1 and len(w) > 1 and w[-1] == w[-2] and w[-1] not in _DA_VOWELS else w


# Russian

_RU_VOWELS = "аеиоуыэюя"
_RU_GERUND = table(a="в вши вшись", cut="ив ивши ившись ыв ывши ывшись")
_RU_ADJECTIVE = Endings("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split())
_RU_PARTICIPLE = table(a="ем нн вш ющ щ", cut="ивш ывш ующ")
_RU_VERB = table(
    a="ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", cut="ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
)
_RU_NOUN = Endings("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split())


def _russian(w: str, endings: Endings, rv: int) -> str | None:
    """``w`` without its ending of the table, of a group ``a`` only after а or я."""
    end, kind = endings.longest(w, rv)
    left = w[: len(w) - len(end)]
    return left if end and (kind != "a" or len(left) > rv and left[-1] in "ая") else None


def russian(word: str) -> str:
    w = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in _RU_VOWELS), len(w))
    _, r2 = regions(w, _RU_VOWELS)
    found = _russian(w, _RU_GERUND, rv)
    if found is None:
        w = cut(w, rv, "ся", "сь")
        found = _russian(w, _RU_ADJECTIVE, rv)
        if found is not None:
            participle = _russian(found, _RU_PARTICIPLE, rv)
            found = found if participle is None else participle
        else:
            found = _russian(w, _RU_VERB, rv)
            if found is None:
                found = _russian(w, _RU_NOUN, rv)
    w = w if found is None else found
    w = cut(w, rv, "и")
    w = cut(w, max(rv, r2), "ость", "ост")
    if w.endswith(("ейш", "ейше")) and len(w) - (3 if w.endswith("ш") else 4) >= rv:
        w = w[: -3 if w.endswith("ш") else -4]
        return w[:-1] if w.endswith("нн") and len(w) - 2 >= rv else w
    if w.endswith("нн") and len(w) - 2 >= rv:
        return w[:-1]
    return cut(w, rv, "ь")


#: By code and by name.
STEMMERS: dict[str, Callable[[str], str]] = {
    "en": porter2, "de": german, "es": spanish, "fr": french, "it": italian, "pt": portuguese, "nl": dutch, "sv": swedish, "no": norwegian, "da": danish, "ru": russian,
}
NAMES = {"english": "en", "german": "de", "spanish": "es", "french": "fr", "italian": "it", "portuguese": "pt", "dutch": "nl", "swedish": "sv", "norwegian": "no", "danish": "da", "russian": "ru"}


@lru_cache(maxsize=64)
def stemmer(language: str | None) -> Callable[[str], str]:
    """The stemmer of a language's code or name; words of others stay as they are."""
    code = (language or "").strip().lower()
    return STEMMERS.get(NAMES.get(code, code), lambda word: word)


def stem(word: str, language: str | None) -> str:
    """The stem of a lower-case word."""
    return stemmer(language)(word)
