"""Problem 7: sentence boundaries across languages and scripts.

Three steps. A lexer finds the places that matter (marks, quotes, brackets, blank lines) and decides
for each mark from its neighbourhood whether a sentence could end there: abbreviations, initials,
decimals, ordinals and paragraph numbers can't. The resulting symbols run through a finite
transducer whose state is the quotation or bracket one is in; it lets a boundary out only where the
text is outside of any. The transducer is applied to blocks of symbols as functions from state to
state, which are composed by a prefix scan, so one very long text is worked on in all its blocks at once.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that never end a sentence when more text follows, in lower case.
ABBREVIATIONS = set(
    """art arts fl fls cf sr sra srs sras srta dr dra drs dras des min exmo exma ilmo ilma adv rel inc dec súm sum doc docs
    pág págs pag pags proc com ind nº núm num obs prof profa eng gen cel cap sgt sto sta fig figs ed vol vols av al
    aud exp expte depto dpto lic ing ud uds vda tel séc ss op cit ibid id vs mr mrs ms messrs hon rev st ste mt gov sen rep
    jan feb mar apr jun jul aug sep sept oct nov sec secs para paras pp no nos ex exh fed supp app approx dept est esq
    mme mmes mlle mm me abs nr bzw usw ca str geb hr fr evtl ggf vgl ziff rn aufl hrsg
    ст стр руб коп гл см ср им пп тыс млн млрд ред ул обл гор
    डॉ श्री श्रीमती प्रो सं नं कु पं κ κα αρ παρ σελ αριθ""".split()
)
# Abbreviations with which a sentence may well end; then a capital must follow.
FINAL_ABBREVIATIONS = set("etc ltda ltd cia inc corp co llc jr s.a a.m p.m s.a.s s.l s.r.l gmbh usw u.a руб коп тыс гг др".split())
# German months, before which a number with a point is an ordinal.
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember".split())
# Words after a closing quotation mark by which a sentence goes on in scripts without case.
GOES_ON = ("और", "तथा", "लेकिन", "किंतु", "परंतु", "कहकर", "と", "って", "という", "라고", "라며", "하고", "고 ", "ثم", "و")

_PAIRS = {'"': '"', "“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉"}
_KINDS = list(_PAIRS)
_NESTS = {"(": 3, "[": 2, "（": 2}
_CLOSERS = "".join(sorted(set("".join(_PAIRS.values()))))
_FULL_STOPS = "。！？｡．"
_MARKS = ".!?…‥؟۔।॥።։።" + _FULL_STOPS

_BREAK = r"(?:\r\n|[\r\n\x0b\x0c\x85 ])"
_EVENT = regex.compile(
    rf"(?P<par>(?:{_BREAK}[^\S\r\n\x0b\x0c\x85 ]*){{2,}}\s*| \s*)"
    rf"|(?P<mark>[{regex.escape(_MARKS)}]+|(?<=\p{{Greek}})[;;](?=\s|$|[{regex.escape(_CLOSERS)}]))(?P<close>(?:[^\S\r\n]?[»›]|[{regex.escape(_CLOSERS)}’'])*)"
    rf"|(?P<thai>(?<=[฀-๿0-9๐-๙%])\s+(?=\S))"
    rf"|(?P<edge>[{regex.escape(''.join(_PAIRS) + _CLOSERS)}])"
)
_PARAGRAPH = regex.compile(rf"(?:{_BREAK}[^\S\r\n\x0b\x0c\x85 ]*){{2,}}| ")
_WORD_BEFORE = regex.compile(r"[\p{L}\p{M}\p{N}º°ª]+(?:\.[\p{L}\p{M}\p{N}º°ª]+)*$")
_THAI_END = regex.compile(r"[฀-๿]\S*$")
_ROMAN = regex.compile(r"\s+[IVXLCDM]+\b")
_NUMBER = regex.compile(r"\d+(?:\.\d+)*$")
_ORDINAL_AFTER = regex.compile(r"\s+(\p{L}+)")
_BEFORE_ORDINAL = regex.compile(r"\b(?:am|vom|zum|bis|dem|den|der|die|das|im)\s+\d{1,2}$")
_LEADING = regex.compile(r"[\s\"“„«‹「『(\[（【《〈¿¡'‘–—-]*")


class Transducer:
    """States: outside, or inside a pair of some kind and depth. Symbols are small numbers."""

    RESET, PARAGRAPH, MARK = 0, 1, 2

    def __init__(self) -> None:
        self.states = [None] + [(k, d) for k in _KINDS for d in range(1, _NESTS.get(k, 1) + 1)]
        number = {s: i for i, s in enumerate(self.states)}
        #: Symbols of characters: opening, closing, closing where a sentence may end.
        self.opening = {k: 3 + i for i, k in enumerate(_KINDS)}
        self.closing = {c: 3 + len(_KINDS) + 2 * i for i, c in enumerate(_CLOSERS)}
        symbols = 3 + len(_KINDS) + 2 * len(_CLOSERS)
        self.next = np.tile(np.arange(len(self.states), dtype=np.uint8)[:, None], (1, symbols))
        self.out = np.zeros((len(self.states), symbols), bool)
        self.next[:, [self.RESET, self.PARAGRAPH]] = 0
        self.out[:, [self.RESET, self.PARAGRAPH]] = True
        self.out[0, self.MARK] = True
        for kind, symbol in self.opening.items():
            self.next[0, symbol] = number[kind, 1]
            for depth in range(1, _NESTS.get(kind, 1)):
                self.next[number[kind, depth], symbol] = number[kind, depth + 1]
        for char, symbol in self.closing.items():
            self.out[0, symbol + 1] = True
            for kind in _KINDS:
                if char in _PAIRS[kind]:
                    for depth in range(1, _NESTS.get(kind, 1) + 1):
                        self.next[number[kind, depth], symbol : symbol + 2] = number.get((kind, depth - 1), 0)
                    self.out[number[kind, 1], symbol + 1] = True
        for char in set(self.opening) & set(self.closing):
            # A character that opens one pair and closes another, or both ends of one: what it does depends on the state.
            for symbol in (self.closing[char],):
                self.next[0, symbol] = number[char, 1]
            self.next[1:, self.opening[char]] = self.next[1:, self.closing[char]]

    def run(self, symbols: np.ndarray, block: int = 512) -> np.ndarray:
        """Whether each symbol lets a boundary out, starting outside."""
        n = symbols.size
        if not n:
            return np.zeros(0, bool)
        rows = -(-n // block)
        padded = np.full(rows * block, self.MARK, symbols.dtype)
        padded[:n] = symbols
        grid = padded.reshape(rows, block)
        # Each block as a function: the state after it for each state before it.
        after = np.tile(np.arange(len(self.states), dtype=np.uint8), (rows, 1))
        for step in range(block):
            after = self.next[after, grid[:, step, None]]
        # Prefix scan by doubling: function of the first 2^k blocks up to each one.
        reach = 1
        while reach < rows:
            composed = after.copy()
            composed[reach:] = np.take_along_axis(after[reach:], after[:-reach], 1)
            after, reach = composed, 2 * reach
        state = np.r_[np.uint8(0), after[:-1, 0]]
        out = np.empty((rows, block), bool)
        for step in range(block):
            out[:, step] = self.out[state, grid[:, step]]
            state = self.next[state, grid[:, step]]
        return out.ravel()[:n]


_TRANSDUCER = Transducer()


def _word(text: str, end: int) -> str:
    m = _WORD_BEFORE.search(text, max(0, end - 40), end)
    return m.group() if m else ""


def _may_end(text: str, start: int, mark: str, follow: int, fresh: bool, led: bool) -> bool:
    """Whether a sentence could end at the mark at ``start``; ``follow``: where text goes on after mark and closers.

    ``fresh``: nothing but a number stands between the last possible end and the mark. ``led``: the last quotation
    opened the sentence, so in scripts without spaces what follows it says who spoke.
    """
    rest = _LEADING.match(text, follow)
    nxt = text[rest.end()] if rest.end() < len(text) else ""
    closed = follow > start + len(mark)
    if mark[-1] in _FULL_STOPS:
        if not closed or not nxt:
            return True
        if nxt in "，、,；;：:" or text.startswith(GOES_ON, follow):
            return False
        return not (led and text[follow : follow + 1].isalnum())
    if not nxt:
        return True
    spaced = text[follow : follow + 1].isspace()
    if not spaced:
        # Scripts without spaces after a full stop have marks of their own, above.
        return mark[-1] in "।॥؟۔" and not closed
    if nxt.islower() or nxt in ",;:،؛)]}»”%/=+*":
        return False
    if closed and text.startswith(GOES_ON, rest.end()) and not nxt.isupper():
        return False
    if mark != ".":
        return True
    word = _word(text, start)
    low = word.lower()
    if not word:
        return True
    if _NUMBER.match(word):
        if fresh and nxt.isalpha():
            return False
        if len(word) <= 2 and nxt.isupper():
            after = _ORDINAL_AFTER.match(text, follow)
            if after and after.group(1).lower() in MONTHS or _BEFORE_ORDINAL.search(text, max(0, start - 12), start):
                return False
        return True
    if low in FINAL_ABBREVIATIONS:
        if low == "inc" and _ROMAN.match(text, follow):
            return False
        return nxt.isupper() or not nxt.isalnum()
    if len(word) == 1:
        before = text[max(0, start - 12) : start - 1].rstrip()
        unit = word.islower() and before[-1:].isdigit()
        return unit and nxt.isupper()
    if "." in word:
        # Initials run together; a word or number with a point inside (an address, a date) isn't an abbreviation.
        return any(len(p) > 3 or p.isdigit() for p in word.split("."))
    if low == "no" or low == "nos":
        return not nxt.isdigit()
    return low not in ABBREVIATIONS


def lex(text: str) -> tuple[list[int], list[int]]:
    """Symbols of a text and, for each, the offset at which a boundary would lie."""
    machine = _TRANSDUCER
    symbols, places = [machine.RESET], [0]
    breaks = [m.start() for m in _PARAGRAPH.finditer(text)] + [len(text)]
    known: dict[str, tuple[int, int]] = {}

    def closed_later(kind: str, at: int) -> bool:
        limit = breaks[bisect.bisect_left(breaks, at)]
        found, until = known.get(kind, (-1, -1))
        if not (at < found or found < 0 and until == limit):
            hits = [p for c in _PAIRS[kind] if (p := text.find(c, at + 1, limit)) >= 0]
            found = min(hits, default=-1)
            known[kind] = (found, limit)
        return found > at

    last_end, low_quote, led = 0, False, False
    at = 0
    while (m := _EVENT.search(text, at)) is not None:
        start, stop = m.span()
        at = stop
        if m.group("par") is not None:
            symbols.append(machine.PARAGRAPH)
            places.append(start)
            last_end = stop
        elif m.group("thai") is not None:
            if not _THAI_END.search(text, max(last_end, start - 200), start):
                continue
            symbols.append(machine.MARK)
            places.append(start)
            last_end = stop
        elif m.group("mark") is not None:
            mark, close = m.group("mark"), m.group("close")
            if "“" in close and not low_quote:
                # After no low quotation mark this one opens: it is looked at by itself.
                close = close[: close.index("“")].rstrip()
            begin = m.start("mark")
            at = stop = begin + len(mark) + len(close)
            tail = text[last_end:begin].strip()
            may = _may_end(text, begin, mark, stop, bool(_NUMBER.fullmatch(tail)), led)
            if not close:
                if may:
                    symbols.append(machine.MARK)
                    places.append(stop)
            else:
                real = [i for i, c in enumerate(close) if c in machine.closing]
                for i in real:
                    symbols.append(machine.closing[close[i]] + (may and i == real[-1]))
                    places.append(stop)
                if not real and may:
                    symbols.append(machine.MARK)
                    places.append(stop)
            if may:
                last_end = stop
        else:
            char = m.group("edge")
            if char == '"':
                before, after = text[start - 1 : start], text[start + 1 : start + 2]
                opens = bool(after) and not after.isspace() and not before.isalnum()
            else:
                opens = char in machine.opening and not (char == "“" and low_quote)
            if opens:
                if closed_later(char, start):
                    symbols.append(machine.opening[char])
                    places.append(start)
                    if not text[last_end:start].strip():
                        led = True
                    elif char not in "([（":
                        led = False
                low_quote = char == "„"
            else:
                symbols.append(machine.closing[char])
                places.append(start)
                low_quote = low_quote and char not in "“”"
    return symbols, places


def boundaries(texts: list[str]) -> Iterator[list[tuple[int, int]]]:
    """Offsets ``start, end`` of the sentences of each text, without white space around them."""
    lexed = [lex(text) for text in texts]
    symbols = np.fromiter((s for symbols, _ in lexed for s in symbols), np.uint8)
    out = _TRANSDUCER.run(symbols)
    at = 0
    for text, (own, places) in zip(texts, lexed):
        cuts = sorted({p for p, ends in zip(places, out[at : at + len(own)].tolist()) if ends} | {0, len(text)})
        at += len(own)
        spans = []
        for a, b in zip(cuts, cuts[1:]):
            part = text[a:b]
            lead = len(part) - len(part.lstrip())
            size = len(part.strip())
            if size:
                spans.append((a + lead, a + lead + size))
        yield spans


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "texto") -> DataFrame:
    """``doc_id, ordem, inicio, fim, frase`` of every sentence, in order and in the original wording.

    Offsets are code points of the text as stored, end exclusive. Null, empty and blank texts have no sentences; repeated rows
    count once; texts of any length are read whole. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = part.column("t").to_pylist()
                which, order, begin, end, words = [], [], [], [], []
                for row, (text, spans) in enumerate(zip(texts, boundaries(texts))):
                    for k, (a, b) in enumerate(spans):
                        which.append(row)
                        order.append(k + 1)
                        begin.append(a)
                        end.append(b)
                        words.append(text[a:b])
                if which:
                    yield pa.record_batch([part.column("doc_id").take(pa.array(which, pa.int32())), pa.array(order, pa.int32()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(words, pa.string())], names=["doc_id", "ordem", "inicio", "fim", "frase"])

    kind = docs.schema[id_col].dataType.simpleString()
    once = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    return once.mapInArrow(run, f"doc_id {kind}, ordem int, inicio int, fim int, frase string")
