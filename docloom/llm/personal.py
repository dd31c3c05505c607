"""Problem 10: personal information inside free text.

One pass of a multi-pattern automaton finds the anchors of a text (given names, titles, document
words, street words, at signs); patterns tried at the anchors alone delimit the mentions. Telephone
numbers and initials, which have no word to hold on to, are found by their shape. Names that are in no list are runs of
capitalised words that a model fitted on the collection itself takes for names (:mod:`docloom.llm.names`).

Mentions are replaced by surrogates (:mod:`docloom.llm.surrogates`): keyed replacements of the same type, gender, script
and format, the same for the same person in all texts; or by a placeholder of their type.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import names as learnt
from docloom.llm.surrogates import Surrogates

EMAIL, PHONE, IDENTITY, ADDRESS, NAME = "EMAIL", "TELEFONE", "IDENTIDADE", "ENDERECO", "NOME"

# Common given names of Portuguese, Spanish and English, by gender.
WOMEN = """adriana ágata alice amanda ana andrea ángela antónia aurora beatriz bianca camila carla carmen carolina catarina cecília
clara clarice cláudia cristina daniela débora diana edith eduarda elena elisa emily emma estela esther eva fernanda flávia francisca gabriela
giovana gloria grace harriet heloísa helena inês irene íris isabel isabela janaína jane joana josefa júlia juliana karen larissa laura
letícia lívia lorena lúcia luísa luiza luzia manuela marcela márcia margarida maria mariana marina marta mary mercedes mónica nadine natália
noêmia nuria olga olivia patrícia paula pilar phoebe priscila rafaela raíssa raquel regina renata rita rocío rosa rosana sandra sara sarah silvana sílvia
sofia sónia susana sylvia tatiana teresa tereza úrsula valentina vanessa vera verónica victoria vitória violet vivian winifred zélia
agnes dorothy florence hazel ivy leocadia mabel martha muriel ruth""".split()
MEN = """abel adriano agustín alberto alejandro alexandre alfredo álvaro andré anselmo antónio antonio arthur augusto benedito benjamin
bernardo bruno caetano caio carlos césar charles cláudio damián daniel danilo david desmond diego diogo eduardo emílio enrique ernesto esteban estêvão
evaristo fábio fabrício felipe fernando francisco frederico gareth genésio george geraldo gilberto gonzalo guilherme gustavo heitor henrique
hugo ignacio ivo jaime james javier joão joaquim john jorge josé juan julián júlio leandro leonardo lucas luís luiz manuel marcelo márcio marcos mário
martín mateus maurício michael miguel moisés murilo nelson nicolás octavio otávio óscar pablo patrick paulo pedro peter rafael ramón raúl renato
ricardo robert roberto rodrigo rogério rubén rupert samuel sebastián sérgio simón thomas tiago tobias tomás ubirajara vicente víctor vinícius walter
warren william wilson
basil cedric clive cyril edgar efraín ernest fermín frank hugh íñigo leonard lionel nigel norman oscar percy ralph rodolfo salvador stanley vincent""".split()
# Forms of address and roles that stand before a name.
TITLES = """sr. sra. srs. sras. srta. dr. dra. drs. dras. des. desa. exmo. exma. ilmo. ilma. prof. profa. mr. mrs. ms. miss mme mlle
senhor senhora señor señora don doña doutor doutora desembargador desembargadora herr frau""".split()
# Words by which a personal document is named.
DOCUMENTS = """cpf c.p.f. rg r.g. cnh dni nie nif ssn ctps passaporte pasaporte passport identidade identidad cédula
social·security·number identity·card id·card driver·license driver's·licence""".replace("·", "\x00").split()
# Given names that are also common words, and words that open a sentence before a name.
COMMON_NAMES = set("rosa clara pilar vera vitoria victoria marina iris grace carmen mercedes gloria mary ruth hazel ivy violet frank jane irene sara rocio salvador clive".split())
STARTERS = set("comparece compareceu comparecem segundo conforme perante para por com nome name witness counsel ouvido ouvida testemunha testigo qualificação recado eng el la the".split())
# Words a street's name starts with (Portuguese and Spanish), and ends with (English).
STREETS = "rua r. avenida av. alameda al. travessa tv. trav. praça pça. rodovia rod. estrada est. largo viela beco ladeira calle c/ plaza avda. paseo camino carretera ronda travesía glorieta".split()
ROADS = "street st. road rd. lane ln. avenue ave. drive dr. boulevard blvd. court ct. square sq. terrace way place".split()
# Capitalised words that begin no person's name.
INSTITUTIONS = set(
    """público pública câmara turma vara corte tribunal juízo juiz juíza ministro ministra ministério relator relatora presidente desembargador
    desembargadora procurador procuradora exa exas sa ltda cia estado município união fazenda banco lei súmula seção sala audiencia court judge justice
    panel section réu ré autor autora advogado advogada agravante agravado apelante apelado perito perita testemunha parte nos o a os as de do da em no na""".split()
)
_TITLES = frozenset(TITLES)
_OFFICES = INSTITUTIONS - {"de", "da", "do", "e"}
_PLACES = set("são santa santo porto vila villa vale lagoa serra ribeira pedra campos rio monte nova novo belo bela ponta barra praia ilha puerto ciudad fort lake".split())
_NOT_OF_A_PERSON = re.compile(r"(?:fórum|foro|escola|colégio|hospital|edifício|edif\.|condomínio|fundação|instituto|banco|construtora|cidade de|município de|comarca de|vila|school|hospital of) +(?:\w+ +){0,2}$", re.I)
_STREET_BEFORE = re.compile(r"(?:\b(?:rua|avenida|alameda|travessa|praça|rodovia|estrada|largo|calle|plaza|paseo|camino|carretera)|\b(?:av|al|tv|rod|avda)\.|\bc/) +(?:[\w.]+ +){0,3}$", re.I)
_COMPANY_AFTER = re.compile(r"[\s,]*(?:&|Ltda|S\.?/?A\b|S\.A\.|Inc\b|LLC|Cia\b|EIRELI|ME\b|GmbH|S\.L\.)")

_UP, _LOW = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĔĘĚĞĢĪİĶŁĹĽŃŇŌŐŒŔŘŚŞŠŢŤŪŮŰŹŻŽ", "a-zà-öø-ÿāăąćčďđēĕęěğģīıķłĺľńňōőœŕřśşšţťūůűźżž"
_GAP = r"[ \t\xa0]+"
_CAPITAL = rf"[{_UP}][{_UP}{_LOW}'’-]*[{_LOW}](?![{_UP}{_LOW}])"
_SHOUT = rf"[{_UP}][{_UP}'’-]+(?![{_UP}{_LOW}])"
# Patterns tried at every place begin with the capital itself, which the engine looks for fastest; what is before it comes second.
_FIRST = len(f"[{_UP}]")
_SOFT = rf"[{_LOW}][{_LOW}'’-]+"
_LINK = r"(?:d[aeo]s?|del|de la|e la|van|von)"
_MORE = re.compile(rf"(?:{_GAP}(?:{_LINK}{_GAP})?(?:{_CAPITAL}|[{_UP}]\.(?={_GAP}[{_UP}])))+")
_ONE_SHOUTED = re.compile(rf"{_GAP}(?:(?:D[AEO]S?|DEL){_GAP})?({_SHOUT})")
_ONE_SOFT = re.compile(rf"{_GAP}(?:{_LINK}{_GAP})?({_SOFT})")
_RUN = re.compile(
    rf"[{_UP}](?<![\w@.-][{_UP}])(?:(?:{_CAPITAL[_FIRST:]}|\.[ \xa0]?(?:[{_UP}]\.[ \xa0]?)*{_CAPITAL})(?:{_GAP}(?:{_LINK}{_GAP})?(?:{_CAPITAL}|[{_UP}]\.(?={_GAP}[{_UP}])))*"
    rf"|{_SHOUT[_FIRST:]}(?:{_GAP}(?:(?:D[AEO]S?|DEL){_GAP})?{_SHOUT})+)"
)
_AFTER_TITLE = re.compile(rf"{_GAP}((?:(?:{_CAPITAL}|[{_UP}]\.){_GAP}(?:{_LINK}{_GAP})?)*{_CAPITAL}|(?:{_SHOUT}{_GAP}(?:(?:D[AEO]S?){_GAP})?)*{_SHOUT})")
_INITIALS = re.compile(rf"[{_UP}](?<![\w.@-][{_UP}])\.[ \xa0]?(?:[{_UP}]\.[ \xa0]?){{0,2}}(?:{_LINK}{_GAP})?(?:{_CAPITAL}|{_SHOUT})(?:{_GAP}(?:{_LINK}{_GAP})?{_CAPITAL})*")
_INITIAL = re.compile(rf"[{_UP}]\.[ \xa0]?$")
_SURNAME_BEFORE = re.compile(rf"(?:(?:{_CAPITAL}{_GAP}(?:{_LINK}{_GAP})?)?{_CAPITAL}|(?:{_SHOUT}{_GAP})?{_SHOUT}),{_GAP}$")
# Words after which a common word may be meant as a given name.
_CUE_BEFORE = re.compile(r"(?:^|[.!?:\n]|patron[oa]|advogad[oa]s?|letrad[oa]|doña|don|testigo|testemunhas?|autora?|réu|ré|desembargadora?|name|nome|sr\.|sra\.|dr\.|dra\.)\s*$", re.I)
# Words that end a name written without capitals, or in capitals amid capitals.
_STOP = set(
    """a o as os e é em no na nos nas de que não foi ser era com por para ao aos à às sob se um uma x y n cpf rg cnh tel ou já mas the of and was gave holds in at to el la los las con en
    brasileira brasileiro casada casado solteira solteiro inscrita inscrito portadora portador residente vizinho vizinha ligar declarou respondeu juntou compareceu mudou calou requer
    réu ré autor autora advogado advogada endereço dijo según informou assinou perguntado perguntada disse alegou afirmou
foram são tem havia pelo pela entre quando onde cujo cuja""".split()
)

_MAIL = re.compile(r"[\w.+%'-]+(?: @ |@)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w])")
_LOCAL = re.compile(r"[\w.+%-]")
_MAIL_SPELT = re.compile(r"[\w.+%-]+\s?[(\[]\s?(?:arroba|at)\s?[)\]]\s?[A-Za-z0-9-]+(?:(?:\.|\s?[(\[](?:ponto|punto|dot)[)\]]\s?)[A-Za-z0-9-]+)+", re.I)
_NUMBERING = r"(?:(?:sob|under|com|con|de|do|da|o|a|os|número|numero|number|núm\.?|num\.?|no\.?|nº|n°|n\.º|n\.|n|is|es|é|:|,|\()\s*)*"
_DOCUMENT = re.compile(rf"(?:/MF|/SSP)?\s*{_NUMBERING}((?:[A-Z]{{1,3}}[ -]?)?\d(?:[ .\-/]?\d){{4,13}}(?:-[A-Za-z0-9](?!\w))?(?:[A-Z](?!\w))?)(?!\w)", re.I)
_PHONE = re.compile(
    r"(?<![\w.,/+-])(?:"
    r"(?:(?:\+|00)55[ .-]?)?\(\d{2,3}\) ?9?\d{4}[ .-]?\d{4}"
    r"|(?:\+|00)55[ .-]?\d{2}[ .-]?9?\d{4}[ .-]?\d{4}"
    r"|0\d{2}[ -]9?\d{4}-\d{4}"
    r"|\d{2} 9?\d{4}[.-]\d{4}"
    r"|(?:\+|00)34[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{3}"
    r"|\d{3} \d{3} \d{3}"
    r"|(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
    r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
    r")(?!\w|[./-]\d| \d{2}(?!\d))"
)
#: Runs of digits and their signs, long enough for a telephone number.
_NUMBERS = re.compile(r"[(+\d][\d() .+-]{7,}")
_PHONE_CUE = re.compile(r"(?:\btel|fone|phone|celular|whats|móvil|ligar|contato|linha|número|call|fax)[^\d+(]{0,25}$", re.I)
_LOCAL_PHONE = re.compile(r"(?<![\w.,/+-])(?:9?\d{4}[-. ]\d{4})(?!\w|[./-]\d)")

_WORD = rf"(?:[{_UP}0-9][\w'’.-]*|[Dd][AaEeOo][Ss]?|[Dd][Ee][Ll]|[Ll][AaOo][Ss]?|[Ee]|[Yy])"
_HOUSE = re.compile(rf"\s*(?:{_WORD}\s+){{0,7}}?{_WORD}\s*?(?:,\s*|\s+)(?:(?:n\.º|nº|n°|n\.|n|número|numero|núm\.|num\.|no\.)\s*)?(?:\d{{1,3}}(?:\.\d{{3}})+|\d{{1,6}}|s/n[º°]?)(?![\w/]|[.,-]\d)", re.I)
_FIRST_WORD = re.compile(rf"\s*(?:(?:[Dd][AaEeOo][Ss]?|[Dd][Ee][Ll]|[Ll][AaOo][Ss]?|[Ee][Ll])\s+)*[{_UP}0-9]")
_NUMBER_BEFORE = re.compile(rf"(?<![\w.,/-])\d{{1,6}}[A-Z]?\s+(?:[{_UP}][\w'’-]*\.?\s+){{1,4}}$")


_FOLD = str.maketrans("áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")


def _plain(name: str) -> str:
    return name.translate(_FOLD)


@functools.cache
def given_names() -> dict[str, str]:
    """Gender of each given name without its accents."""
    return {_plain(name): gender for names, gender in ((MEN, "m"), (WOMEN, "f")) for name in names}


def _accented(name: str) -> Iterator[str]:
    """The name with one vowel accented."""
    for i, c in enumerate(name):
        for mark in {"a": "áâã", "e": "éê", "i": "í", "o": "óôõ", "u": "ú"}.get(c, ""):
            yield name[:i] + mark + name[i + 1 :]


@functools.cache
def anchors() -> ahocorasick.Automaton:
    """All anchors in lower case with kinds and length; names also without accents and with an accent on any one vowel."""
    automaton = ahocorasick.Automaton()
    for kind, words in (("road", ROADS), ("street", STREETS), ("document", [d.replace("\x00", " ") for d in DOCUMENTS]), ("title", TITLES), ("name", [*MEN, *WOMEN]), ("mail", "@"), ("spelt", ["arroba)", "arroba]", "(at)", "[at]"])):
        forms = {form for word in words for form in (word, _plain(word), *(_accented(_plain(word)) if kind == "name" else ()))}
        for word in sorted(forms):
            held = automaton.get(word, None)
            automaton.add_word(word, (len(word), (*(held[1] if held else ()), kind)))
    automaton.make_automaton()
    return automaton


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@functools.cache
def _steps(words: int) -> re.Pattern:
    """So many words of a reversed text, or those up to the end of the line before and its mark."""
    return re.compile(rf"(?:[ \t\xa0]*+\S++){{{words}}}|(?:[ \t\xa0]*+\S++)*+[ \t\xa0]*+\n?")


def _back(text: str, at: int, words: int) -> int:
    """Begin of the last so many words of a line before a place."""
    width = 80
    while True:
        reached = _steps(words).match(text[max(0, at - width) : at][::-1]).end()
        if reached < width or at <= width:
            return at - reached
        width *= 4


def _local_start(text: str, at: int) -> int:
    """Begin of the local part of an address that ends at a place, a blank before it allowed."""
    begin = at - (at > 0 and text[at - 1].isspace())
    while begin > 0 and _LOCAL.match(text, begin - 1):
        begin -= 1
    return begin


class Taken:
    """Places of a text that belong to a mention."""

    def __init__(self, size: int):
        self.held = bytearray(size)

    def add(self, a: int, b: int) -> None:
        self.held[a:b] = b"\1" * (b - a)

    def hits(self, a: int, b: int) -> bool:
        return self.held.find(1, a, b) >= 0


def _stepped(text: str, end: int, one: re.Pattern) -> int:
    """End of a name that goes on word by word until one that ends it."""
    while (m := one.match(text, end)) and m.group(1).lower().strip(".,;:").split("-")[0] not in _STOP:
        end = m.end()
    return end


def _name_at(text: str, a: int, b: int, low: str) -> tuple[int, int] | None:
    """The name around the given name ``text[a:b]``, or None if it is none."""
    word = text[a:b]
    names = given_names()
    if word[1:].islower() and word[0].isupper():
        more = _MORE.match(text, b)
        end = more.end() if more else b
        if more:
            while (tail := re.search(r"\S+$", text[b:end])) and tail.group().lower().strip(".") in INSTITUTIONS:
                end = b + tail.start()
                end = len(text[:end].rstrip()) if end > b else b
    elif word.isupper():
        end = _stepped(text, b, _ONE_SHOUTED)
    elif word.islower():
        end = _stepped(text, b, _ONE_SOFT)
        if end == b:
            return None
        if _plain(low[a:b]) in COMMON_NAMES and _plain(low[b:end]).split()[0] not in names and not _CUE_BEFORE.search(text, _back(text, a, 2), a):
            return None
    else:
        return None
    if _COMPANY_AFTER.match(text, end) or _NOT_OF_A_PERSON.search(text, _back(text, a, 5), a):
        return None
    first = a
    while m := _INITIAL.search(text, max(0, first - 3), first):
        first = m.start()
    if first < a and not (first and (text[first - 1].isalnum() or text[first - 1] in "_.")):
        a = first
    own = _plain(low[a:end]).split()
    if all(w.strip(".") in names or len(w.strip(".")) == 1 for w in own):
        m = _SURNAME_BEFORE.search(text, _back(text, a, 4), a)
        if m:
            begin = m.start()
            parts = re.findall(r"[^\W\d_]+", m.group().lower())
            if len(parts) > 1 and (parts[0] in STARTERS or parts[0] in INSTITUTIONS or parts[0] in TITLES):
                parts = parts[1:]
                begin += re.match(r"\S+\s+", m.group()).end()
            if parts[0] not in _PLACES and not {_plain(p) for p in parts} & set(names) and not set(parts) & INSTITUTIONS and not set(parts) & STARTERS:
                return begin, end
        if len(own) == 1 and not re.search(r"(?:\bsr|\bsra|\bdr|\bdra|\bmr|\bmrs|\bms|\bdon|\bdoña)\.?\s+$", low[max(0, a - 10) : a]):
            return None
    return a, end


def _anchored(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]], Taken]:
    """Mentions other than names, names that a list, a title or initials give away, and the places of the former."""
    low = _lower(text)
    names: list[tuple[int, int]] = []
    titles: list[int] = []
    taken = Taken(len(text))
    found: list[tuple[str, int, int]] = []
    streets: list[tuple[int, int]] = []
    n = len(text)

    def keep(kind: str, a: int, b: int) -> None:
        found.append((kind, a, b))
        taken.add(a, b)

    for last, (size, kinds) in anchors().iter(low):
        a, b = last - size + 1, last + 1
        if kinds == ("mail",):
            begin = _local_start(text, a)
            if begin < a and (m := _MAIL.match(text, begin)) and m.end() > b:
                keep(EMAIL, m.start() + (text[m.start()] in ".'-"), m.end())
            continue
        if kinds == ("spelt",):
            begin = max(text.rfind("(", 0, b), text.rfind("[", 0, b))
            begin = _local_start(text, begin) if 0 <= begin < b else a
            if (m := _MAIL_SPELT.match(text, begin)) and m.end() > a:
                keep(EMAIL, m.start(), m.end())
            continue
        if a and (low[a - 1].isalnum() or low[a - 1] in "_@"):
            continue
        if b < n and (low[b].isalnum() or low[b] == "_") and low[b - 1] not in "/.":
            continue
        for kind in kinds:
            if kind == "name":
                names.append((a, b))
            elif kind == "title":
                titles.append(b)
            elif kind == "document":
                if m := _DOCUMENT.match(text, b):
                    keep(IDENTITY, m.start(1), m.end(1))
            elif kind == "street":
                if _FIRST_WORD.match(text, b):
                    streets.append((a, b))
            elif text[a].isupper():
                if m := _NUMBER_BEFORE.search(text, _back(text, a, 5), a):
                    keep(ADDRESS, m.start(), b)
    until = 0
    for a, b in streets:
        if a < until:
            continue
        m = _HOUSE.match(text, b)
        if m and "\n\n" not in m.group():
            keep(ADDRESS, a, m.end())
            until = m.end()
    for run in _NUMBERS.finditer(text):
        for m in _PHONE.finditer(text, run.start(), run.end() + 4):
            if not taken.hits(*m.span()):
                keep(PHONE, *m.span())
        # The word for a telephone is at most 25 characters before its number.
        if not taken.hits(*run.span()) and _PHONE_CUE.search(text, max(0, run.start() - 40), run.start()):
            for m in _LOCAL_PHONE.finditer(text, run.start(), run.end() + 4):
                keep(PHONE, *m.span())
    persons: list[tuple[int, int]] = []
    known = Taken(n)

    def person(a: int, b: int) -> None:
        persons.append((a, b))
        known.add(a, b)

    until = 0
    for a, b in names:
        if a < until or taken.hits(a, b) or _STREET_BEFORE.search(text, _back(text, a, 6), a):
            continue
        span = _name_at(text, a, b, low)
        if span and not taken.hits(*span):
            person(*span)
            until = span[1]
    for b in titles:
        if m := _AFTER_TITLE.match(text, b):
            a, end = m.span(1)
            first = text[a:end].lower().split()[0].strip(".")
            if first + "." in TITLES or first in INSTITUTIONS or m.group(1).isupper() and len(m.group(1)) < 4:
                continue
            if not _STREET_BEFORE.search(text, _back(text, b, 6), a) and not _COMPANY_AFTER.match(text, end) and not known.hits(a, end) and not taken.hits(a, end):
                person(a, end)
    for m in _INITIALS.finditer(text):
        a, end = m.span()
        parts = [w.strip(".").lower() for w in m.group().split()]
        if not known.hits(a, end) and not taken.hits(a, end) and not set(w for w in parts if len(w) > 1) & INSTITUTIONS and not _COMPANY_AFTER.match(text, end) and not _STREET_BEFORE.search(text, _back(text, a, 6), a):
            person(a, end)
    for a, b in persons:
        taken.add(a, b)
    return found, persons, taken


def _runs(text: str, taken: Taken) -> Iterator[tuple[int, int]]:
    """Runs of two capitalised words or more that may be a person's name: not of an address, a company or an office."""
    for m in _RUN.finditer(text):
        run = m.group()
        words = run.split()
        if len(words) < 2:
            continue
        a, b = m.span()
        lows = run.lower().split()
        while words and (lows[0] in STARTERS or lows[0].strip(".") + "." in _TITLES or lows[0] in INSTITUTIONS):
            a += len(words[0])
            a += len(text[a:b]) - len(text[a:b].lstrip())
            words, lows = words[1:], lows[1:]
        if len(words) < 2 or taken.hits(a, b) or _COMPANY_AFTER.match(text, b) or any(w.strip(".") in _OFFICES for w in lows):
            continue
        if not _STREET_BEFORE.search(text, _back(text, a, 6), a) and not _NOT_OF_A_PERSON.search(text, _back(text, a, 5), a):
            yield a, b


def mentions(text: str, weights: np.ndarray | None = None) -> list[tuple[str, int, int]]:
    """``type, start, end`` of every mention, in order and without overlaps.

    ``weights``: a model of :func:`fitted`; without one only names that a list, a title or initials give away are found.
    """
    found, persons, taken = _anchored(text)
    found += [(NAME, a, b) for a, b in persons]
    if weights is not None:
        found += [(NAME, a, b) for a, b in _runs(text, taken) if learnt.probability(weights, text, a, b) >= learnt.LEAST]
    found.sort(key=lambda x: (x[1], -x[2]))
    out: list[tuple[str, int, int]] = []
    for kind, a, b in found:
        if not out or a >= out[-1][2]:
            out.append((kind, a, b))
    return out


def examples(text: str) -> Iterator[tuple[bool, list[int], list[int]]]:
    """What a text teaches: the names found in it by list, title or initials, and its other runs of capitalised words."""
    _, persons, taken = _anchored(text)
    for a, b in persons:
        if len(text[a:b].split()) > 1 and not text[a:b].islower():
            yield True, *learnt.features(text, a, b)
    for a, b in _runs(text, taken):
        yield False, *learnt.features(text, a, b)


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = learnt.SAMPLE_DOCUMENTS, most: int = learnt.EXAMPLES) -> np.ndarray:
    """A model of names, fitted on the examples of about ``documents`` documents drawn by hash of their id, at most ``most`` of them.

    Both bounds are what the driver may hold, whatever the collection; the model is then applied to every text.
    """
    rows = docs.select(F.xxhash64(id_col, F.lit(11)).alias("h"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    every = max(1, rows.count() // max(1, documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, *e) for h, text in zip(batch.column("h").to_pylist(), batch.column("t").to_pylist()) for e in examples(text)]
            h, name, outer, inner = zip(*found) if found else ((), (), (), ())
            yield pa.record_batch([pa.array(h, pa.int64()), pa.array(name, pa.bool_()), pa.array(outer, pa.list_(pa.int32())), pa.array(inner, pa.list_(pa.int32()))], names=["h", "nome", "fora", "dentro"])

    drawn = rows.where(F.pmod("h", F.lit(every)) == 0).mapInArrow(run, "h bigint, nome boolean, fora array<int>, dentro array<int>")
    held = drawn.orderBy(F.xxhash64("h", "fora"), "h", "fora", "dentro", "nome").limit(most).toArrow()
    return learnt.fit(list(zip(held.column("nome").to_pylist(), held.column("fora").to_pylist(), held.column("dentro").to_pylist())))


def placeholder(kind: str) -> str:
    """The placeholder of a type."""
    return f"[{kind}]"


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each mention replaced by its placeholder and nothing else changed."""
    out, last = [], 0
    for kind, a, b in spans:
        out += [text[last:a], placeholder(kind)]
        last = b
    return "".join(out) + text[last:]


@functools.cache
def maker(key: bytes) -> Surrogates:
    """The surrogates under a key."""
    own = {"m": tuple(dict.fromkeys(map(_plain, MEN))), "f": tuple(dict.fromkeys(map(_plain, WOMEN)))}
    return Surrogates(key, {"m": tuple(n for n in own["m"] if n not in own["f"]), "f": own["f"]})


def with_surrogates(text: str, spans: list[tuple[str, int, int]], key: bytes) -> str:
    """The text with each mention replaced by its surrogate."""
    out, last = [], 0
    for kind, a, b in spans:
        out += [text[last:a], maker(key).replace(kind, text[a:b])]
        last = b
    return "".join(out) + text[last:]


def _mapped(docs: DataFrame, id_col: str, text_col: str, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                yield make(part.column("doc_id"), part.column("t").to_pylist())

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where("t IS NOT NULL").mapInArrow(run, f"doc_id {kind}, {schema}")


def replaced(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", model: np.ndarray | None = None) -> DataFrame:
    """``doc_id, texto, trocas ARRAY<STRUCT<tipo, inicio, fim, substituto>>`` of every text that isn't null.

    ``texto`` has every mention replaced by its surrogate; ``trocas`` has what was replaced, offsets in code points of the original
    text, end exclusive. The same key gives the same surrogate of a person or number in all texts, and no other one has it.
    Empty and blank texts have no mention; each row is searched whole, repeated rows each for themselves. Extra columns are
    ignored; an empty table gives no rows. ``model``: one of :func:`fitted`, else it is fitted on these texts.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fitted(docs, id_col, text_col) if model is None else model)
    parts = ("tipo", pa.string()), ("inicio", pa.int32()), ("fim", pa.int32()), ("substituto", pa.string())

    def make(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        fresh, swaps, ends = [], [], [0]
        for text in texts:
            last, out = 0, []
            for k, a, b in mentions(text, weights.value):
                new = maker(key).replace(k, text[a:b])
                swaps.append((k, a, b, new))
                out += [text[last:a], new]
                last = b
            fresh.append("".join(out) + text[last:])
            ends.append(len(swaps))
        columns = [pa.array(values, kind) for values, (_, kind) in zip(zip(*swaps) if swaps else [()] * 4, parts)]
        held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [name for name, _ in parts]))
        return pa.record_batch([ids, pa.array(fresh, pa.string()), held], names=["doc_id", "texto", "trocas"])

    return _mapped(docs, id_col, text_col, "texto string, trocas array<struct<tipo: string, inicio: int, fim: int, substituto: string>>", make)


def found_mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: np.ndarray | None = None, key: bytes = b"docloom") -> DataFrame:
    """``doc_id, tipo, inicio, fim``: one row per mention that :func:`replaced` replaces."""
    swaps = replaced(docs, key, id_col, text_col, model).select("doc_id", F.explode("trocas").alias("x"))
    return swaps.select("doc_id", "x.tipo", "x.inicio", "x.fim")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: np.ndarray | None = None) -> DataFrame:
    """``doc_id, texto``: every text that isn't null with typed placeholders in place of its mentions."""
    weights = docs.sparkSession.sparkContext.broadcast(fitted(docs, id_col, text_col) if model is None else model)

    def make(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        return pa.record_batch([ids, pa.array([redact(t, mentions(t, weights.value)) for t in texts], pa.string())], names=["doc_id", "texto"])

    return _mapped(docs, id_col, text_col, "texto string", make)


def surrogated(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", model: np.ndarray | None = None) -> DataFrame:
    """``doc_id, texto``: every text that isn't null with keyed surrogates in place of its mentions, as :func:`replaced` makes them."""
    return replaced(docs, key, id_col, text_col, model).select("doc_id", "texto")
