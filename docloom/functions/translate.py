"""Term and phrase translation: ordered literal rules, and one-pass whole-word rules."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.textclean import DIGIT_WORDS

#: Up to so many rules are nested replacements in the JVM; more are looked up in an Arrow function, with the same result.
NESTED_RULES = 40
#: Most rules a translator may have: they are sent to every task.
MAX_RULES = 1_000_000


def _ascii(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def prepare_term(term: str, output: bool) -> str:
    """A term of a rule as the tokenizer would see it: its words in plain letters.

    Digits are words of their own. An input has its words between single blanks. An output is one compound, its words
    between single underscores; symbols at its begin, but not at its end, leave an underscore.

    >>> prepare_term("Código 2", False), prepare_term("código civil", True)
    ('codigo dois', 'codigo_civil')
    """
    spelt = re.sub("[0-9]", lambda m: f" {DIGIT_WORDS[int(m.group())]} ", term)
    plain = _ascii(spelt.lower()).strip()
    words = re.findall("[a-z0-9]+", plain)
    if not output:
        return " ".join(words)
    return ("_" if words and not plain.startswith(words[0]) else "") + "_".join(words)


def parse_rules(lines: list[str]) -> list[tuple[str, str]]:
    """Rules from lines ``a b => c``, longest input first.

    Without a right side the input is removed. The first rule of an input counts.

    >>> parse_rules(["de", "dano moral => dano_moral"])
    [('dano moral', 'dano_moral'), ('de', '')]
    """
    rules: dict[str, str] = {}
    for line in lines:
        left, arrow, right = line.partition("=>")
        source = prepare_term(left, False)
        if source:
            rules.setdefault(source, prepare_term(right, True) if arrow else "")
    return sorted(rules.items(), key=lambda rule: len(rule[0]), reverse=True)


def rules_frame(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as rows ``ord, src, dst``; the order matters."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rules)], "ord int, src string, dst string")


def translate_terms(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal rules applied one after the other, longest first, case-sensitive, between blanks.

    Later rules see what earlier ones made; of rules with the same input the first counts. A match takes the blanks on both sides, so of two adjacent equal terms
    only the first is replaced.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    # A removed term leaves the two blanks of its padding, which a rule with one blank doesn't match.
    first = {a.strip(): b for a, b in reversed(rules) if a.strip()}
    padded = sorted(((f" {a} ", f" {first[a]} ") for a in dict.fromkeys(a.strip() for a, _ in rules) if a), key=lambda rule: len(rule[0]), reverse=True)
    if len(padded) <= NESTED_RULES:
        start = F.concat(F.lit(" "), text, F.lit(" "))
        return F.trim(functools.reduce(lambda c, rule: F.replace(c, F.lit(rule[0]), F.lit(rule[1])), padded, start))

    # Where each rule stands, by its words: a text is looked up word by word and never searched for all rules.
    rank: dict[tuple[str, ...], int] = {}
    for i, (source, _) in enumerate(padded):
        rank.setdefault(tuple(source[1:-1].split(" ")), i)
    lengths = sorted({len(words) for words in rank})

    def next_rule(value: str, after: int) -> int | None:
        words = value.split(" ")[1:-1]
        grams = (tuple(words[i : i + n]) for n in lengths for i in range(len(words) - n + 1))
        return min((r for gram in grams if (r := rank.get(gram, -1)) > after), default=None)

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        def one(value: str) -> str:
            value, turn = f" {value} ", next_rule(f" {value} ", -1)
            while turn is not None:
                value = value.replace(*padded[turn])
                turn = next_rule(value, turn)
            return value.strip(" ")

        return texts.map(one, na_action="ignore")

    return apply(text)


def replace_words(text: Column, rules: dict[str, str], ignore_case: bool = True) -> Column:
    """Whole-word rules in one pass: what a rule makes isn't looked at again. Earlier rules win."""
    if not rules:
        return text
    pattern = r"\b(" + "|".join(re.escape(a) for a in rules) + r")\b"
    table = {a.lower() if ignore_case else a: b for a, b in rules.items()}

    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        compiled = re.compile(pattern, re.IGNORECASE if ignore_case else 0)

        def one(value: str) -> str:
            return compiled.sub(lambda m: table[m.group().lower() if ignore_case else m.group()], value)

        return texts.map(one, na_action="ignore")

    return apply(text)
