"""Stemmers and phonetic codes.

The S-stripper and the identity are built-in expressions. The others are plain functions from word to stem, applied
to distinct terms through :func:`stem_udf`. A stemmer also names its scan prefix: the number of first
characters that a conflated term must share with the query's stem.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiou"


def s_strip(term: Column) -> Column:
    """ies to y, es to nothing, s to nothing."""
    return F.when(term.endswith("ies"), F.concat(F.substring(term, F.lit(1), F.length(term) - 3), F.lit("y"))).when(term.endswith("es"), F.substring(term, F.lit(1), F.length(term) - 2)).when(term.endswith("s"), F.substring(term, F.lit(1), F.length(term) - 1)).otherwise(term)


def s_strip_word(w: str) -> str:
    return w[:-3] + "y" if w.endswith("ies") else w[:-2] if w.endswith("es") else w[:-1] if w.endswith("s") else w


def _consonant(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    shape = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", shape))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 1) and w[-1] not in "wxy"


# Suffixes of the published algorithm (M. F. Porter, 1980), steps 2 to 4.
_STEP2 = "ational ate|tional tion|enci ence|anci ance|izer ize|abli able|alli al|entli ent|eli e|ousli ous|ization ize|ation ate|ator ate|alism al|iveness ive|fulness ful|ousness ous|aliti al|iviti ive|biliti ble"
_STEP3 = "icate ic|ative |alize al|iciti ic|ical ic|ful |ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_PAIRS2 = sorted((tuple(x.split(" ")) for x in _STEP2.split("|")), key=lambda p: -len(p[0]))
_PAIRS3 = sorted((tuple(x.split(" ")) for x in _STEP3.split("|")), key=lambda p: -len(p[0]))
_LONGEST4 = sorted(_STEP4.split(), key=lambda s: -len(s))


def porter(w: str) -> str:
    """The 1980 algorithm, on lower-case ASCII words of three letters or more."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                head = w[: -len(end)]
                if _has_vowel(head):
                    w = head
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for pairs in (_PAIRS2, _PAIRS3):
        for end, to in pairs:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + to
                break
    for end in _LONGEST4:
        if w.endswith(end):
            head = w[: -len(end)]
            if _measure(head) > 1 and (end != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def _r1(w: str, vowels: str) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    for i in range(1, len(w)):
        if w[i] not in vowels and w[i - 1] in vowels:
            return i + 1
    return len(w)


# Exceptions of the published English Snowball algorithm.
_ENGLISH_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_ENGLISH_STOP = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_ENGLISH2 = "tional tion|enci ence|anci ance|abli able|entli ent|izer ize|ization ize|ational ate|ation ate|ator ate|alism al|aliti al|alli al|fulness ful|ousli ous|ousness ous|iveness ive|iviti ive|biliti ble|bli ble|fulli ful|lessli less"
_ENGLISH3 = "tional tion|ational ate|alize al|icate ic|iciti ic|ical ic|ful |ness "
_E2 = sorted((tuple(x.split(" ")) for x in _ENGLISH2.split("|")), key=lambda p: -len(p[0]))
_E3 = sorted((tuple(x.split(" ")) for x in _ENGLISH3.split("|")), key=lambda p: -len(p[0]))
_E4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), key=lambda s: -len(s))


def english(w: str) -> str:
    """The English Snowball algorithm."""
    if len(w) <= 2:
        return w
    w = w.lstrip("'")
    if w in _ENGLISH_WHOLE:
        return _ENGLISH_WHOLE[w]
    w = re.sub("^y", "Y", w)
    w = re.sub("(?<=[aeiouy])y", "Y", w)
    v = "aeiouy"
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _r1(w, v) if r1 is None else r1
    r2 = r1 + _r1(w[r1:], v)
    short_end = lambda x: bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", x) or re.fullmatch("[aeiouy][^aeiouy]", x))
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _ENGLISH_STOP:
        return w
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            if end in ("eed", "eedly"):
                if len(w) - len(end) >= r1:
                    w = w[: -len(end)] + "ee"
            elif re.search("[aeiouy]", w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                    w = w[:-1]
                elif short_end(w) and r1 >= len(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in v:
        w = w[:-1] + "i"
    for end, to in [*_E2, ("ogi", "og"), ("li", "")]:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ogi" or w.endswith("logi")) and (end != "li" or re.search("[cdeghkmnrt]li$", w)):
                w = w[: -len(end)] + to
            break
    for end, to in [*_E3, ("ative", "")]:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + to
            break
    for end in _E4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
                w = w[: -len(end)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def german(w: str) -> str:
    """The German Snowball algorithm."""
    v = "aeiouyäöü"
    w = w.replace("ß", "ss")
    w = re.sub(f"(?<=[{v}])u(?=[{v}])", "U", w)
    w = re.sub(f"(?<=[{v}])y(?=[{v}])", "Y", w)
    r1 = _r1(w, v)
    r2 = r1 + _r1(w[r1:], v)
    r1 = max(r1, 3)
    for end in ("ern", "em", "er", "en", "es", "e", "s"):
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "s" or re.search("[bdfghklmnrt]s$", w)):
                w = w[: -len(end)]
                if end in ("en", "es", "e") and w.endswith("niss"):
                    w = w[:-1]
            break
    for end in ("est", "en", "er", "st"):
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "st" or re.search("...[bdfghklmnt]st$", w)):
                w = w[: -len(end)]
            break
    for end in ("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"):
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                head = w[: -len(end)]
                if end in ("end", "ung"):
                    w = head
                    if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                        w = w[:-2]
                elif end in ("ig", "ik", "isch"):
                    w = w if head.endswith("e") else head
                elif end in ("lich", "heit"):
                    w = head
                    if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                        w = w[:-2]
                else:
                    w = head
                    for more in ("lich", "ig"):
                        if w.endswith(more):
                            if len(w) - len(more) >= r2:
                                w = w[: -len(more)]
                            break
            break
    return w.lower().replace("ä", "a").replace("ö", "o").replace("ü", "u")


# Rules of the published Lancaster algorithm (C. Paice and G. Husk, 1990): ending written
# backwards, "*" for words that are still whole, letters to take off, letters to add, "." to end, ">" to go on.
_LANCASTER = """ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1.
ht*2. hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3>
lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1.
rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv.
tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3. yfi3. ycn2t> yca3> zi2> zy1s."""
_RULES: dict[str, list[tuple[str, bool, int, str, bool]]] = {}
for _rule in _LANCASTER.split():
    _m = re.fullmatch(r"([a-z]+)(\*?)(\d)([a-z]*)([.>])", _rule)
    _RULES.setdefault(_m[1][0], []).append((_m[1][::-1], bool(_m[2]), int(_m[3]), _m[4], _m[5] == ">"))


def lancaster(w: str) -> str:
    """Rules looked up by the last letter, again and again until one ends the work or none fits."""
    whole, going = True, True
    while going:
        going = False
        for end, only_whole, off, add, again in _RULES.get(w[-1:], ()):
            if not w.endswith(end) or only_whole and not whole:
                continue
            new = w[: len(w) - off] + add
            head = w[: len(w) - off]
            fits = len(head) >= 2 if head[:1] and head[0] in "aeiouy" else len(head) >= 3 and bool(re.search("[aeiouy]", head))
            if off and not fits:
                continue
            w, whole, going = new, False, again
            break
    return w


# Soundex digits.
_DIGIT = {c: d for d, letters in zip("123456", ("bfpv", "cgjkqsxz", "dt", "l", "mn", "r")) for c in letters}


def soundex(w: str) -> str:
    """First letter and three digits; equal neighbouring digits count once, h and w between them too.

    Words that don't begin with an ASCII letter stand for themselves.
    """
    letters = [c for c in w.lower() if "a" <= c <= "z"]
    if not letters or not w[:1].lower().isascii() or not w[:1].isalpha():
        return w
    out, last = letters[0], _DIGIT.get(letters[0])
    for c in letters[1:]:
        d = _DIGIT.get(c)
        if d and d != last:
            out += d
        if c not in "hw":
            last = d
    return (out + "000")[:4]


def metaphone(w: str, length: int = 4) -> str:
    """Metaphone key of an English word (L. Philips, 1990), cut to ``length``."""
    w = re.sub("[^a-z]", "", w.lower())
    w = re.sub(r"([abd-z])\1+", r"\1", w)
    for head, to in (("kn", "n"), ("gn", "n"), ("pn", "n"), ("ae", "e"), ("wr", "r"), ("x", "s"), ("wh", "w")):
        if w.startswith(head):
            w = to + w[len(head) :]
            break
    out, i = "", 0
    while i < len(w):
        c, nxt, prev = w[i], w[i + 1 : i + 2], w[i - 1 : i] if i else ""
        if c in _VOWELS:
            out += c.upper() if i == 0 else ""
        elif c == "b":
            out += "" if i == len(w) - 1 and prev == "m" else "B"
        elif c == "c":
            if nxt and nxt in "iey":
                out += "X" if w[i : i + 3] == "cia" else "" if prev == "s" else "S"
            elif nxt == "h":
                out += "K" if prev == "s" else "X"
                i += 1
            else:
                out += "K"
        elif c == "d":
            out += "J" if nxt == "g" and w[i + 2 : i + 3] in ("e", "i", "y") else "T"
        elif c == "g":
            if nxt == "h" and (i + 2 < len(w) and w[i + 2] not in _VOWELS or i + 2 == len(w)) or nxt == "n" and (i + 2 == len(w) or w[i + 2 :] == "ed"):
                pass
            elif nxt and nxt in "iey" and prev != "g":
                out += "" if prev == "d" else "J"
            else:
                out += "K"
        elif c == "h":
            out += "H" if nxt and nxt in _VOWELS and prev not in ("c", "s", "p", "t", "g") else ""
        elif c == "k":
            out += "" if prev == "c" else "K"
        elif c == "p":
            out += "F" if nxt == "h" else "P"
        elif c == "q":
            out += "K"
        elif c == "s":
            if nxt == "h" or w[i : i + 3] in ("sio", "sia"):
                out += "X"
            else:
                out += "S"
        elif c == "t":
            if w[i : i + 3] in ("tia", "tio"):
                out += "X"
            elif nxt == "h":
                out += "0"
                i += 1
            elif w[i : i + 3] != "tch":
                out += "T"
        elif c == "v":
            out += "F"
        elif c in "wy":
            out += c.upper() if nxt and nxt in _VOWELS else ""
        elif c == "x":
            out += "KS"
        elif c == "z":
            out += "S"
        else:
            out += c.upper()
        i += 1
    return out[:length]


@dataclass(frozen=True)
class Stemmer:
    word: Callable[[str], str]
    #: First characters that conflated terms share with the query's stem.
    prefix: int
    expression: Callable[[Column], Column] | None = None


STEMMERS: dict[str, Stemmer] = {
    "none": Stemmer(lambda w: w, 1, lambda c: c),
    "s": Stemmer(s_strip_word, 1, s_strip),
    "porter": Stemmer(porter, 2),
    "english": Stemmer(english, 2),
    "german": Stemmer(german, 2),
    "lancaster": Stemmer(lancaster, 3),
    "soundex": Stemmer(soundex, 1),
    "metaphone": Stemmer(metaphone, 1),
}


def stem_udf(name: str):
    """Vectorised stemmer over a column of distinct terms."""
    stem = STEMMERS[name].word

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda w: None if w is None else stem(w))

    return run


def stem(term: Column, name: str) -> Column:
    """Stem of a term; numbers and words of three bytes or fewer stand for themselves (phonetic codes take all words)."""
    s = STEMMERS[name]
    made = s.expression(term) if s.expression else stem_udf(name)(term)
    least = 0 if name in ("soundex", "metaphone") else 3
    return F.when((F.octet_length(term) > least) & term.rlike(r"^\p{L}"), made).otherwise(term)
