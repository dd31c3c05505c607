"""Text cleaning as Column expressions: links, accents, acronyms, digits, symbols, quick tokens.

All functions take and give Columns and stay in the JVM. Null stays null. Texts of any length are
cleaned whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digit words, and the patterns of links and addresses that cleaning removes.
DIGIT_WORDS = ("zero", "um", "dois", "tres", "quatro", "cinco", "seis", "sete", "oito", "nove")
URL = (
    r"\b(https?:\/\/(?:www\.|(?!www))[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]\.[^\s]{2,}"
    r"|www\.[a-zA-Z0-9][a-zA-Z0-9-]+[a-zA-Z0-9]\.[^\s]{2,}"
    r"|https?:\/\/(?:www\.|(?!www))[a-zA-Z0-9]+\.[^\s]{2,}|www\.[a-zA-Z0-9]+\.[^\s]{2,})\b"
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
# The dot first: the look-behind is then tried at dots only.
ACRONYM_DOT = r"\.(?<=\W[a-z]\.)(?=[a-z]\W)"
# Fixed value: characters that stay; any other becomes a blank.
SYMBOL = "[^a-z0-9á-ú]"



@functools.cache
def folding() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Of all Unicode: characters that fold to one ASCII character, what to, and those that fold to several."""
    single, target, several = [], [], []
    for code in range(0x80, 0x110000):
        char = chr(code)
        if unicodedata.decomposition(char):
            plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
            if len(plain) == 1:
                single.append(char)
                target.append(plain)
            elif plain:
                several.append((char, plain))
    return "".join(single), "".join(target), tuple(several)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def remove_accents(text: Column) -> Column:
    """Compatibility decomposition (NFKD) reduced to ASCII; characters without an ASCII base are dropped.

    Characters that fold to one are translated in one pass. Only of a text that then still has others are those that
    fold to several replaced, each distinct one once.
    """
    single, target, several = folding()
    chars, plains = F.split(F.lit("\x1f".join(c for c, _ in several)), "\x1f"), F.split(F.lit("\x1f".join(p for _, p in several)), "\x1f")
    others = r"[^\x00-\x7F]+"

    def spelt(folded: Column) -> Column:
        present = F.array_intersect(F.regexp_extract_all(F.regexp_replace(folded, r"[\x00-\x7F]+", ""), F.lit("(?s)(.)"), 1), chars)
        done = F.aggregate(present, folded, lambda text, c: F.replace(text, c, F.element_at(plains, F.array_position(chars, c).cast("int"))))
        return F.when(folded.rlike(others), F.regexp_replace(done, others, "")).otherwise(folded)

    return let(F.translate(text, single, target), spelt)


def strip_links(text: Column) -> Column:
    """URLs and e-mail addresses become one blank each. Schemes match in lower case only.

    The patterns are tried only on texts that hold what they begin with or need.
    """
    plain = F.when(text.contains("http") | text.contains("www."), F.regexp_replace(text, f"(?U){URL}", " ")).otherwise(text)
    return let(plain, lambda t: F.when(t.contains("@"), F.regexp_replace(t, f"(?U){EMAIL}", " ")).otherwise(t))


def lower_lines(text: Column) -> Column:
    """Lower case; ``<br>`` and newlines become blanks."""
    return F.replace(F.replace(F.lower(text), F.lit("<br>"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def join_acronyms(text: Column) -> Column:
    """Dots between single letters go: `` s.t.f. `` becomes `` stf. ``. The text gets a blank on each side."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), ACRONYM_DOT, "")


def digits_to_words(text: Column) -> Column:
    """Each digit becomes its word between blanks."""
    return functools.reduce(lambda c, d: F.replace(c, F.lit(str(d[0])), F.lit(f" {d[1]} ")), enumerate(DIGIT_WORDS), text)


def symbols_to_blanks(text: Column) -> Column:
    """Every character but ``a-z`` and digits becomes one blank; runs aren't collapsed."""
    symbols = "".join(c for c in map(chr, range(0x80)) if not re.match("[a-z0-9]", c))
    plain = F.translate(text, symbols, " " * len(symbols))
    return let(plain, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), F.regexp_replace(t, SYMBOL, " ")).otherwise(t))


def clean(text: Column) -> Column:
    """All steps in order, before translation and splitting."""
    return symbols_to_blanks(digits_to_words(join_acronyms(remove_accents(lower_lines(strip_links(text))))))


def drop_orphan_underscores(text: Column) -> Column:
    """An underscore next to a blank goes."""
    return F.replace(F.replace(text, F.lit("_ "), F.lit(" ")), F.lit(" _"), F.lit(" "))


def split_tokens(text: Column) -> Column:
    """Words between blanks, without empty ones."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def quick_text(text: Column) -> Column:
    """Cleaned text as one string."""
    return F.trim(drop_orphan_underscores(clean(text)))


def quick_tokens(text: Column) -> Column:
    """Cleaned text as a token list; empty for a blank text."""
    return split_tokens(quick_text(text))


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def preview(text: Column, length: int = 250) -> Column:
    """The first characters, with a mark if there are more."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(" [..]"))).otherwise(text)


def pad(text: Column, width: int) -> Column:
    """Padded with blanks on the right, never cut."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)
