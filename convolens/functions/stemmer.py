"""Porter's suffix-stripping stemmer with the widely used extensions to the 1980 rules.

M.F. Porter, "An algorithm for suffix stripping", Program 14(3), 1980. Every step is a table of
(suffix, replacement, condition on the stem); the first suffix that matches decides its step.
"""

from __future__ import annotations

from functools import lru_cache

# Irregular forms.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# Suffix tables of steps 2 to 4.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """`c` or `v` for every letter; y is a vowel behind a consonant."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    shape = _shape(word)
    if shape == "vc":
        return True
    return shape.endswith("cvc") and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("s") and not w.endswith("ss"):
        return w[:-1]
    return w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        stem = w[: -len(suffix)]
        if w.endswith(suffix) and "v" in _shape(stem):
            break
    else:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_end(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    if _measure(stem) == 1 and _short_end(stem):
        return stem + "e"
    return stem


def _final_y(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _shape(w)[-2] == "c":
        return w[:-1] + "i"
    return w


def _double_suffix(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _double_suffix(w[:-2])
    for suffix, instead in STEP2:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + instead if _measure(stem) > 0 else w
    # Here the l of the ending counts as part of the stem that is measured.
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return w


def _ending(w: str) -> str:
    for suffix, instead in STEP3:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + instead if _measure(stem) > 0 else w
    return w


def _bare(w: str) -> str:
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            fits = _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem if fits else w
    return w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short_end(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    for step in (_plural, _past, _final_y, _double_suffix, _ending, _bare, _tidy):
        w = step(w)
    return w
