"""English stems by the public Snowball "English" (Porter 2) rules, as column expressions and for single words.

Steps are tables of endings; the first ending of a step that a word has decides, longest first.  Regions are places: R1
starts behind the first non-vowel after a vowel, R2 likewise within R1.  Endings change, the regions' places don't.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules of the algorithm.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
_KEPT_LATER = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_R1 = r"^(?:(?:gener|commun|arsen)|.*?[aeiouy][^aeiouy])"
_R2 = r"^.*?[aeiouy][^aeiouy]"
_SHORT = r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
#: Ending, what takes its place, condition on what stands before it: r1, r2 (the ending lies there), or a pattern.
_Step = list[tuple[str, str, str]]
_STEP0: _Step = [("'s'", "", ""), ("'s", "", ""), ("'", "", "")]
_STEP1A: _Step = [("sses", "ss", ""), ("ied", "i", "..$"), ("ies", "i", "..$"), ("us", "us", ""), ("ss", "ss", ""), ("s", "", "[aeiouy].+$")]
_STEP1B: _Step = [("eedly", "ee", "r1"), ("ingly", "", "[aeiouy]"), ("edly", "", "[aeiouy]"), ("eed", "ee", "r1"), ("ing", "", "[aeiouy]"), ("ed", "", "[aeiouy]")]
_STEP1C: _Step = [("y", "i", ".[^aeiouy]$"), ("Y", "i", ".[^aeiouy]$")]
_STEP2: _Step = [
    ("ational", "ate", "r1"), ("fulness", "ful", "r1"), ("iveness", "ive", "r1"), ("ization", "ize", "r1"), ("ousness", "ous", "r1"), ("biliti", "ble", "r1"), ("lessli", "less", "r1"),
    ("tional", "tion", "r1"), ("alism", "al", "r1"), ("aliti", "al", "r1"), ("ation", "ate", "r1"), ("entli", "ent", "r1"), ("fulli", "ful", "r1"), ("iviti", "ive", "r1"), ("ousli", "ous", "r1"),
    ("abli", "able", "r1"), ("alli", "al", "r1"), ("anci", "ance", "r1"), ("ator", "ate", "r1"), ("enci", "ence", "r1"), ("izer", "ize", "r1"), ("bli", "ble", "r1"), ("ogi", "og", "r1&l$"), ("li", "", "r1&[cdeghkmnrt]$"),
]
_STEP3: _Step = [("ational", "ate", "r1"), ("tional", "tion", "r1"), ("alize", "al", "r1"), ("ative", "", "r2"), ("icate", "ic", "r1"), ("iciti", "ic", "r1"), ("ical", "ic", "r1"), ("ness", "", "r1"), ("ful", "", "r1")]
_STEP4: _Step = [(x, "", "r2") for x in ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ism", "iti", "ive", "ize", "ous")] + [("ion", "", "r2&[st]$")] + [(x, "", "r2") for x in ("al", "er", "ic")]
_DOUBLE = r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _conditions(condition: str) -> tuple[str | None, str | None]:
    """The region, and the pattern of what stands before the ending."""
    region, _, pattern = condition.partition("&") if condition[:2] in ("r1", "r2") else (None, "", condition)
    return region, pattern or None


def _stepped(w: Column, steps: _Step, r1: Column, r2: Column) -> Column:
    out = w
    for ending, to, condition in reversed(steps):
        region, pattern = _conditions(condition)
        size = F.char_length(w) - len(ending)
        before = F.substring(w, F.lit(1), size)
        holds = F.lit(True)
        if region:
            holds = size >= (r1 if region == "r1" else r2)
        if pattern:
            holds = holds & before.rlike(pattern)
        # Of "ied" and "ies" behind one letter, "ie" is left.
        otherwise = F.concat(before, F.lit("ie")) if ending in ("ied", "ies") else w
        out = F.when(F.endswith(w, F.lit(ending)), F.when(holds, F.concat(before, F.lit(to))).otherwise(otherwise)).otherwise(out)
    return out


def _after_1b(w: Column, before: Column, r1: Column) -> Column:
    """What is left once "ed" or "ing" has gone."""
    gone = (w != before) & ~F.endswith(before, F.lit("eed")) & ~F.endswith(before, F.lit("eedly"))
    short = w.rlike(_SHORT) & (r1 >= F.char_length(w))
    mended = F.when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(_DOUBLE), F.substring(w, F.lit(1), F.char_length(w) - 1)).when(short, F.concat(w, F.lit("e"))).otherwise(w)
    return F.when(gone, mended).otherwise(w)


def _step5(w: Column, r1: Column, r2: Column) -> Column:
    size = F.char_length(w) - 1
    before = F.substring(w, F.lit(1), size)
    e = (size >= r2) | ((size >= r1) & ~before.rlike(_SHORT))
    return F.when(F.endswith(w, F.lit("e")) & e, before).when(F.endswith(w, F.lit("ll")) & (size >= r2), before).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-cased word; words without a-z, and those of up to two letters, are their own."""

    def regular(w: Column) -> Column:
        marked = _let(F.regexp_replace(F.regexp_replace(w, "^'", ""), "(^|[aeiouy])y", "$1Y"), lambda m: m)
        return _let(marked, _regions)

    def _regions(m: Column) -> Column:
        first = F.regexp_extract(m, f"({_R1})", 1)
        r1 = F.when(m.rlike(_R1), F.char_length(first)).otherwise(F.char_length(m))

        def inner(at: Column) -> Column:
            rest = F.substring(m, at + 1, F.char_length(m))
            r2 = F.when(rest.rlike(_R2), at + F.char_length(F.regexp_extract(rest, f"({_R2})", 1))).otherwise(F.char_length(m))
            return _let(r2, lambda two: _steps(m, at, two))

        return _let(r1, inner)

    def _steps(m: Column, r1: Column, r2: Column) -> Column:
        def step(steps: _Step) -> Callable[[Column], Column]:
            return lambda x: _stepped(x, steps, r1, r2)

        def rest(a: Column) -> Column:
            b = _let(_stepped(a, _STEP1B, r1, r2), lambda x: _after_1b(x, a, r1))
            c = _let(b, step(_STEP1C))
            for following in (step(_STEP2), step(_STEP3), step(_STEP4)):
                c = _let(c, following)
            return F.lower(_let(c, lambda x: _step5(x, r1, r2)))

        one = _let(_let(m, step(_STEP0)), step(_STEP1A))
        return _let(one, lambda a: F.when(F.lower(a).isin(*_KEPT_LATER), F.lower(a)).otherwise(rest(a)))

    whole = F.create_map(*[F.lit(x) for pair in _WHOLE.items() for x in pair])
    return F.when(word.isin(*_KEPT) | (F.char_length(word) < 3) | ~word.rlike("^[a-z']+$"), word).when(word.isin(*_WHOLE), whole[word]).otherwise(regular(word))


def stem_word(word: str) -> str:
    """As stem, of one word, for the words of a query."""
    if word in _KEPT or len(word) < 3 or not re.match(r"^[a-z']+$", word):
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = re.sub("(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    found = re.match(_R1, w)
    r1 = found.end() if found else len(w)
    found = re.match(_R2, w[r1:])
    r2 = r1 + found.end() if found else len(w)

    def stepped(w: str, steps: _Step) -> str:
        for ending, to, condition in steps:
            if w.endswith(ending):
                region, pattern = _conditions(condition)
                before = w[: len(w) - len(ending)]
                holds = (region is None or len(before) >= (r1 if region == "r1" else r2)) and (pattern is None or re.search(pattern, before) is not None)
                return before + to if holds else before + "ie" if ending in ("ied", "ies") else w
        return w

    w = stepped(stepped(w, _STEP0), _STEP1A)
    if w.lower() in _KEPT_LATER:
        return w.lower()
    before, w = w, stepped(w, _STEP1B)
    if w != before and not before.endswith(("eed", "eedly")):
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(_DOUBLE, w):
            w = w[:-1]
        elif re.search(_SHORT, w) and r1 >= len(w):
            w += "e"
    for steps in (_STEP1C, _STEP2, _STEP3, _STEP4):
        w = stepped(w, steps)
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not re.search(_SHORT, w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
