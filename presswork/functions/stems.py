"""Stems of English words by the published Snowball (Porter 2) rules, and words that are no terms."""

from __future__ import annotations

from functools import lru_cache

# English words that searches leave out.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now""".split()
)
# Words with stems of their own, and endings with what they become (in the order in which they are tried).
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
DONE_EARLY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
SECOND = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
THIRD = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
FOURTH = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
VOWELS = "aeiouy"


def _after(word: str, start: int) -> int:
    """Where the region begins after the first consonant that follows a vowel, from a place on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-3] not in VOWELS and word[-2] in VOWELS and word[-1] not in VOWELS and word[-1] not in "wxY"


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")) or not w.endswith("s"):
        return w
    return w[:-1] if any(c in VOWELS for c in w[:-2]) else w


def _past(w: str, r1: int) -> str:
    for end in ("eedly", "eed"):
        if w.endswith(end):
            return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    for end in ("ingly", "edly", "ing", "ed"):
        if not w.endswith(end):
            continue
        rest = w[: -len(end)]
        if not any(c in VOWELS for c in rest):
            return w
        if rest.endswith(("at", "bl", "iz")):
            return rest + "e"
        if rest[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            return rest[:-1]
        return rest + "e" if r1 >= len(rest) and _short_end(rest) else rest
    return w


def _ending(w: str, r1: int, r2: int, endings: list[tuple[str, str]]) -> str:
    """The first ending that w has, replaced if it lies in its region and its letter before allows it."""
    for end, new in endings:
        if w.endswith(end):
            rest = w[: -len(end)]
            inside = len(rest) >= (r2 if end == "ative" else r1)
            if not inside or (end == "ogi" and not rest.endswith("l")) or (end == "li" and rest[-1:] not in tuple("cdeghkmnrt")):
                return w
            return rest + new
    return w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3 or word in UNCHANGED:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in VOWELS) else c for i, c in enumerate(word))
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _after(w, 0)
    r2 = _after(w, r1)
    w = _plural(w)
    if w in DONE_EARLY:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = _ending(w, r1, r2, SECOND)
    w = _ending(w, r1, r2, THIRD)
    for end in FOURTH:
        if w.endswith(end):
            rest = w[: -len(end)]
            if len(rest) >= r2 and (end != "ion" or rest[-1:] in ("s", "t")):
                w = rest
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
