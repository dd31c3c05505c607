"""The published Snowball algorithm for Portuguese, for use on distinct tokens.

Regions: RV starts after the next vowel or consonant as the algorithm defines; R1 follows the first
consonant after a vowel, R2 the same within R1.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Vowels and suffix lists of the published algorithm, nasal vowels written a~ and o~.
VOWELS = "aeiouáéíóúâêô"
STEP1 = (
    ("delete", "R2", "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância"),
    ("log", "R2", "logia logias"),
    ("u", "R2", "uça~o uço~es"),
    ("ente", "R2", "ência ências"),
    ("amente", "R1", "amente"),
    ("mente", "R2", "mente"),
    ("idade", "R2", "idade idades"),
    ("iva", "R2", "iva ivo ivas ivos"),
    ("ir", "RV", "ira iras"),
)
STEP2 = """ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam
iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as
adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes
estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos
ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos
íssemos imos armos ermos irmos eu iu ou ira iras""".split()
RESIDUAL = ("os", "a", "i", "o", "á", "í", "ó")

_STEP1 = {suffix: (action, region) for action, region, words in STEP1 for suffix in words.split()}
_STEP1_ORDER = sorted(_STEP1, key=len, reverse=True)
_STEP2_ORDER = sorted(STEP2, key=len, reverse=True)


def _after_vowel_consonant(word: str, start: int) -> int:
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if len(word) < 2:
        return len(word)
    if word[1] not in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
    if word[0] in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
    return 3 if len(word) >= 3 else len(word)


def stem(word: str) -> str:
    """Stem of a lower-case word.

    >>> stem("processos"), stem("engloba")
    ('process', 'englob')
    """
    word = word.replace("ã", "a~").replace("õ", "o~")
    r1 = _after_vowel_consonant(word, 0)
    r2 = _after_vowel_consonant(word, r1)
    rv = _rv(word)
    start = {"R1": r1, "R2": r2, "RV": rv}
    before = word

    def cut(suffix: str, region: int) -> bool:
        nonlocal word
        if word.endswith(suffix) and len(word) - len(suffix) >= region:
            word = word[: len(word) - len(suffix)]
            return True
        return False

    done = False
    suffix = next((s for s in _STEP1_ORDER if word.endswith(s)), None)
    if suffix:
        action, region = _STEP1[suffix]
        if action == "ir":
            if len(word) - len(suffix) >= rv and word[: len(word) - len(suffix)].endswith("e"):
                word = word[: len(word) - len(suffix)] + "ir"
                done = True
        elif cut(suffix, start[region]):
            done = True
            if action in ("log", "u", "ente"):
                word += action
            elif action == "amente":
                if cut("iv", r2):
                    cut("at", r2)
                elif not any(cut(s, r2) for s in ("os", "ic", "ad")):
                    pass
            elif action == "mente":
                any(cut(s, r2) for s in ("ante", "avel", "ável", "ível"))
            elif action == "idade":
                any(cut(s, r2) for s in ("abil", "ic", "iv"))
            elif action == "iva":
                cut("at", r2)
    if not done:
        suffix = next((s for s in _STEP2_ORDER if word.endswith(s) and len(word) - len(s) >= rv), None)
        if suffix:
            word = word[: len(word) - len(suffix)]
            done = True
    if done and word != before:
        if word.endswith("i") and word[:-1].endswith("c") and len(word) - 1 >= rv:
            word = word[:-1]
    else:
        suffix = next((s for s in RESIDUAL if word.endswith(s)), None)
        if suffix:
            cut(suffix, rv)
    if word.endswith(("e", "é", "ê")) and len(word) - 1 >= rv:
        word = word[:-1]
        if word.endswith("u") and word[:-1].endswith("g") and len(word) - 1 >= rv:
            word = word[:-1]
        elif word.endswith("i") and word[:-1].endswith("c") and len(word) - 1 >= rv:
            word = word[:-1]
    elif word.endswith("ç"):
        word = word[:-1] + "c"
    return word.replace("a~", "ã").replace("o~", "õ")


def stemmed(token: Column) -> Column:
    """Stem of each token; null stays null. Meant for distinct tokens."""

    @F.pandas_udf("string")
    def apply(tokens: pd.Series) -> pd.Series:
        return tokens.map(stem, na_action="ignore")

    return apply(token)
