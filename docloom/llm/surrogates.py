"""Keyed replacements that keep type, gender, script and format.

Every replacement is a keyed permutation without fixed points of a set that depends on form alone: number strings of
one length, given names of one gender, words with one pattern of letters. So the same original has the same replacement
in every text, different ones never share one, none stays as it is, and no state or collision check is needed, however
many names there are.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import unicodedata

# Vowels of the scripts whose words keep their pattern of vowels and consonants.
VOWELS = ("aeiou", "áéíóúâêôãõàüäöëï", "аеиоуыэюяё", "αεηιουω", "άέήίόύώ")
PARTICLES = re.compile(r"d[aeo]s?|del|van|von|la|las|los|e|y", re.I)


@functools.cache
def alphabet(char: str) -> str:
    """The lower-case letters a letter may become: those of its script that are vowels, or consonants, as it is.

    A letter of a script without such a division becomes one of the letters among the 128 characters around it.
    """
    for vowels in VOWELS:
        if char in vowels:
            return vowels
    around = map(chr, range(ord(char) & ~127, (ord(char) & ~127) + 128))
    kind = unicodedata.category(char)
    every_vowel = "".join(VOWELS)
    return "".join(c for c in around if unicodedata.category(c) == kind and c.lower() == c and len(c.upper()) == 1 and c not in every_vowel) or char


@functools.lru_cache(100_000)
def factors(size: int) -> tuple[int, int]:
    """Two factors of a number as near to each other as there are, the larger first."""
    root = max(1, math.isqrt(size))
    while root > 1 and size % root:
        root -= 1
    return size // root, root


class Surrogates:
    """Replacements under one key. ``given``: the given names of each gender, in plain lower case; without, names are words like others."""

    def __init__(self, key: bytes, given: dict[str, tuple[str, ...]] | None = None):
        self.key = key
        self.given = given or {}
        self.gender = {name: gender for gender, names in self.given.items() for name in names}
        self.word_of = functools.lru_cache(100_000)(self._word_of)
        self.digits_of = functools.lru_cache(100_000)(self._digits_of)
        self.word = functools.lru_cache(100_000)(self._word)
        # The key is taken in once; every number starts from a copy of that state.
        self.keyed = hashlib.blake2b(key=key[:64], digest_size=32)

    def _number(self, what: str) -> int:
        state = self.keyed.copy()
        state.update(what.encode("utf-8", "surrogatepass"))
        return int.from_bytes(state.digest(), "big")

    def _mixed(self, value: int, size: int, what: str, back: bool = False) -> int:
        """A keyed permutation of the numbers below ``size`` (alternating sums over two factors), or its inverse."""
        sizes = factors(size)
        root = sizes[1]
        if root == 1:
            # No factors: a rotation alone.
            shift = self._number(f"{what}|{size}") % size
            return (value - shift if back else value + shift) % size
        left, right = divmod(value, root)
        own = f"{what}|{size}|"
        for turn in reversed(range(6)) if back else range(6):
            if turn % 2 == 0:
                shift = self._number(f"{own}{turn}|{right}")
                left = (left - shift if back else left + shift) % sizes[0]
            else:
                shift = self._number(f"{own}{turn}|{left}")
                right = (right - shift if back else right + shift) % sizes[1]
        return left * root + right

    def moved(self, value: int, size: int, what: str) -> int:
        """A keyed permutation of the numbers below ``size`` without fixed points (for ``size`` above one).

        One step along a cycle through all numbers, in an order that the key decides.
        """
        return self._mixed((self._mixed(value, size, what) + 1) % size, size, what, back=True)

    def digits(self, digits: str) -> str:
        """Another string of as many digits."""
        # Short ones (house numbers, say) come again and again.
        return self.digits_of(digits) if len(digits) < 6 else self._digits_of(digits)

    def _digits_of(self, digits: str) -> str:
        return str(self.moved(int(digits), 10 ** len(digits), "d")).zfill(len(digits)) if digits else ""

    def number(self, text: str, keep: int = 0) -> str:
        """Digits replaced from the ``keep``-th on, all other characters kept."""
        own = re.sub("[^0-9]", "", text)
        fresh = iter(own[:keep] + self.digits(own[keep:]))
        return re.sub("[0-9]", lambda _: next(fresh), text)

    def _word_of(self, low: str) -> str:
        gender = self.gender.get(low)
        if gender:
            names = self.given[gender]
            return names[self.moved(names.index(low), len(names), f"n{gender}")]
        letters = [alphabet(c) for c in low]
        size = 1
        for own in letters:
            size *= len(own)
        if size < 2:
            return low
        place = 0
        for c, own in zip(low, letters):
            place = place * len(own) + own.index(c)
        while True:
            place, rest, out = self.moved(place, size, "w"), 0, []
            rest = place
            for own in reversed(letters):
                rest, digit = divmod(rest, len(own))
                out.append(own[digit])
            # Listed names are the replacements of listed names alone: the walk goes on to the next that isn't one.
            if (word := "".join(reversed(out))) not in self.gender:
                return word

    def _word(self, text: str) -> str:
        """One word in the case of the original; particles of names stay."""
        if PARTICLES.fullmatch(text):
            return text
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
        out = self.word_of(low)
        if text.isupper() and len(text) > 1:
            return "".join(c if len(x := c.upper()) != 1 else x for c in out)
        if len(out) == len(low) and not self.gender.get(low):
            return "".join(x if a.isupper() and len(x := o.upper()) == 1 else o for a, o in zip(text, out))
        return out[:1].upper() + out[1:] if text[:1].isupper() else out

    def words(self, text: str) -> str:
        """Every run of letters replaced as a word, every run of digits as a number."""
        return re.sub(r"[^\W\d_]+|[0-9]+", lambda m: self.digits(m.group()) if m.group()[0].isdigit() else self.word(m.group()), text)

    def replace(self, kind: str, text: str) -> str:
        """The surrogate of a mention."""
        if kind == "TELEFONE":
            country = re.match(r"(?:\+|00)\d{1,2}(?=\D)", text)
            return self.number(text, len(re.sub(r"\D", "", country.group())) if country else 0)
        if kind == "EMAIL":
            # The last label stays and a reserved one is added, so that no address can be a real one.
            return self.words(text[: max(0, text.rfind("."))]) + text[max(0, text.rfind(".")) :] + (".INVALID" if text.isupper() else ".invalid")
        if kind == "ENDERECO":
            first, blank, rest = text.partition(" ")
            if first.isdigit():
                middle, blank2, road = rest.rpartition(" ")
                return f"{self.number(first)}{blank}{self.words(middle)}{blank2}{road}"
            # The words before a house number.
            keep = re.compile(r"(?<!\w)(?:n[º°]?\.?º?|número|numero|núm|num|no|s/n[º°]?)(?!\w)", re.I)
            parts, last = [], 0
            for m in keep.finditer(rest):
                parts += [self.words(rest[last : m.start()]), m.group()]
                last = m.end()
            return f"{first}{blank}{''.join(parts)}{self.words(rest[last:])}"
        return self.words(text)
