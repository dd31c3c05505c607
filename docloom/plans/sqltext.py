"""The cleaning steps as SQL text, for comparison with the Column functions.

The SQL engine has no look-around, so dots of acronyms are marked in three passes and then dropped.
"""

from __future__ import annotations

import functools
import unicodedata

from docloom.functions import textclean
from docloom.functions.stem import RESIDUAL, STEP1, STEP2

_MARK = "chr(1)"


def quote(text: str) -> str:
    """A string as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


@functools.cache
def folding() -> tuple[str, str, dict[str, str]]:
    """What each character of Unicode leaves of itself in ASCII, found here anew: one character, or several."""
    plain = {}
    for char in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))):
        left = "".join(c for c in unicodedata.normalize("NFKD", char) if c < "\x80") if unicodedata.decomposition(char) else ""
        if left:
            plain[char] = left
    one = {c: t for c, t in plain.items() if len(t) == 1}
    return "".join(one), "".join(one.values()), {c: t for c, t in plain.items() if len(t) > 1}


def mapped(expr: str, table: dict[str, str]) -> str:
    """Characters replaced from a table, in texts that hold any of them."""
    pairs = ", ".join(f"{quote(c)}: {quote(t)}" for c, t in table.items())
    return f"CASE WHEN regexp_matches({expr}, '[^\\x00-\\x7F]') THEN array_to_string(list_transform(string_split({expr}, ''), lambda c: CASE WHEN c > '~' THEN coalesce((MAP {{{pairs}}})[c], c) ELSE c END), '') ELSE {expr} END"


@functools.cache
def decompositions() -> dict[str, str]:
    """Canonical decomposition of every character that has one."""
    return {c: unicodedata.normalize("NFD", c) for c in map(chr, (*range(0x80, 0xAC00), *range(0xF900, 0x30000))) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.normalize("NFD", c) != c}


def quick_steps(source: str, text: str, keep: str) -> str:
    """A chain of CTEs from ``source`` (a table or query) to ``limpo(<keep>, t)`` with the quick text; texts without links only have e-mails stripped."""
    acronyms = "c3"
    single, target, several = folding()
    steps = [
        f"c1 AS (SELECT {keep}, regexp_replace({text}, '{textclean.EMAIL}', ' ', 'g') AS t FROM {source})",
        f"c1a AS (SELECT {keep}, translate(replace(replace(lower(t), '<br>', ' '), chr(10), ' '), {quote(single)}, {quote(target)}) AS t FROM c1)",
        f"c2 AS (SELECT {keep}, regexp_replace({mapped('t', several)}, '[^\\x00-\\x7F]', '', 'g') AS t FROM c1a)",
        f"c3 AS (SELECT {keep}, ' ' || t || ' ' AS t FROM c2)",
    ]
    for k in range(3):
        steps.append(f"c3{k} AS (SELECT {keep}, regexp_replace(t, '(\\W[a-z])\\.([a-z]\\W)', '\\1' || {_MARK} || '\\2', 'g') AS t FROM {acronyms})")
        acronyms = f"c3{k}"
    digits = f"replace(t, {_MARK}, '')"
    for digit, word in enumerate(textclean.DIGIT_WORDS):
        digits = f"replace({digits}, '{digit}', ' {word} ')"
    steps.append(f"limpo AS (SELECT {keep}, trim(regexp_replace({digits}, '[^a-z0-9]', ' ', 'g')) AS t FROM {acronyms})")
    return ",\n".join(steps)


def tokens_of(expr: str) -> str:
    """Token list of a cleaned text."""
    return f"list_filter(string_split({expr}, ' '), lambda w: w <> '')"


def singular(expr: str) -> str:
    """Singular of one plain token."""
    from docloom.functions.vocabulary import PLURALS

    cases = " ".join(f"WHEN {expr} LIKE '%{a}' THEN left({expr}, length({expr}) - {len(a)}) || '{b}'" for a, b in PLURALS)
    words = ", ".join(quote(w) for w in textclean.DIGIT_WORDS)
    return f"CASE WHEN length({expr}) <= 1 OR {expr} IN ({words}) THEN {expr} {cases} ELSE {expr} END"


def stems(source: str, word: str) -> str:
    """CTEs to ``radicais(token, radical)``: the stem of every distinct word of a table, by string functions only.

    Only the published suffix lists are shared with the stemmer.
    """
    v, c = "[aeiouáéíóúâêô]", "[^aeiouáéíóúâêô]"
    group = {suffix: (action, region) for action, region, words in STEP1 for suffix in words.split()}
    longest = " ".join(f"WHEN ends_with(x, '{s}') THEN '{s}'" for s in sorted(group, key=len, reverse=True))
    place = {"R1": "p1", "R2": "p2", "RV": "pv"}
    cut = lambda e, s: f"left({e}, length({e}) - {len(s)})"
    after_e = lambda s: f" AND ends_with({cut('x', s)}, 'e')"
    actions = " ".join(f"WHEN suf = '{s}' AND n - {len(s)} >= {place[r]}{after_e(s) if a == 'ir' else ''} THEN '{a}'" for s, (a, r) in group.items())
    tail = lambda e, s, p="p2": f"ends_with({e}, '{s}') AND length({e}) - {len(s)} >= {p}"
    first = lambda e, words, p="p2": "CASE " + " ".join(f"WHEN {tail(e, s, p)} THEN {cut(e, s)}" for s in words) + f" ELSE {e} END"
    verbs = " ".join(f"WHEN {tail('x', s, 'pv')} THEN {cut('x', s)}" for s in sorted(STEP2, key=len, reverse=True))
    residual = " ".join(f"WHEN ends_with(x, '{s}') THEN CASE WHEN n - {len(s)} >= pv THEN {cut('x', s)} ELSE x END" for s in RESIDUAL)
    return f"""
s0 AS (SELECT DISTINCT {word} AS token, replace(replace({word}, 'ã', 'a~'), 'õ', 'o~') AS x FROM {source}),
s1 AS (SELECT token, x, length(x) AS n, regexp_extract(x, '^{c}*{v}+{c}(.*)$', 1) AS r1, CASE WHEN regexp_matches(x, '^.{c}') THEN regexp_extract(x, '^.{c}+{v}(.*)$', 1) WHEN regexp_matches(x, '^{v}{v}') THEN regexp_extract(x, '^{v}{v}+{c}(.*)$', 1) ELSE substr(x, 4) END AS rv FROM s0),
s2 AS (SELECT token, x, n, n - length(r1) AS p1, n - length(regexp_extract(r1, '^{c}*{v}+{c}(.*)$', 1)) AS p2, n - length(rv) AS pv, CASE {longest} END AS suf FROM s1),
s3 AS (SELECT *, CASE {actions} END AS acao, left(x, n - length(suf)) AS y FROM s2),
s4 AS (SELECT *, CASE acao WHEN 'delete' THEN y WHEN 'log' THEN y || 'log' WHEN 'u' THEN y || 'u' WHEN 'ente' THEN y || 'ente' WHEN 'ir' THEN y || 'ir'
  WHEN 'amente' THEN CASE WHEN {tail('y', 'iv')} THEN {first(cut('y', 'iv'), ['at'])} ELSE {first('y', ['os', 'ic', 'ad'])} END
  WHEN 'mente' THEN {first('y', ['ante', 'avel', 'ável', 'ível'])} WHEN 'idade' THEN {first('y', ['abil', 'ic', 'iv'])} WHEN 'iva' THEN {first('y', ['at'])} END AS um FROM s3),
s5 AS (SELECT *, CASE WHEN um IS NOT NULL THEN um {verbs} END AS d FROM s4),
s6 AS (SELECT *, CASE WHEN d <> x THEN CASE WHEN ends_with(d, 'ci') AND length(d) - 1 >= pv THEN {cut('d', 'i')} ELSE d END {residual} ELSE x END AS f FROM s5),
s7 AS (SELECT token, f, CASE WHEN right(f, 1) IN ('e', 'é', 'ê') AND length(f) - 1 >= pv THEN CASE WHEN substr(f, length(f) - 2, 2) IN ('gu', 'ci') AND length(f) - 2 >= pv THEN left(f, length(f) - 2) ELSE left(f, length(f) - 1) END WHEN ends_with(f, 'ç') THEN left(f, length(f) - 1) || 'c' ELSE f END AS g FROM s6),
radicais AS (SELECT token, replace(replace(g, 'a~', 'ã'), 'o~', 'õ') AS radical FROM s7)
"""


def fragments(prefix: str = "prefixo", suffix: str = "sufixo") -> str:
    """CTE ``partes(token, prefixo, sufixo)`` from ``radicais``; words that stay whole have empty parts."""
    tail = "CASE WHEN length(radical) < length(token) THEN substr(token, length(radical) + 1) ELSE '' END"
    whole = f"length(token) <= 1 OR contains(token, '_') OR (radical = token AND {tail} = '')"
    return f"partes AS (SELECT token, CASE WHEN {whole} THEN '' ELSE radical END AS {prefix}, CASE WHEN {whole} THEN '' ELSE {tail} END AS {suffix} FROM radicais)"


def strange(term: str) -> str:
    """Whether a word looks like none, without back references."""
    same = f"len(list_filter(range(1, length({term}) - 1), lambda i: substr({term}, i, 1) = substr({term}, i + 1, 1) AND substr({term}, i, 1) = substr({term}, i + 2, 1) AND (substr({term}, i, 1) NOT IN ('r', 's', 'a', 'e', 'i') OR substr({term}, i, 1) IN ('a', 'e', 'i', 'o', 'u')))) > 0"
    return f"CASE WHEN {same} OR regexp_matches({term}, '[^rsaeiounl_\\n]{{3,}}|[aeiou]{{4,}}|^_|_$') OR NOT regexp_matches({term}, '[aeiouáéíóú]') THEN 'S' ELSE 'N' END"


def cover(ranked: str, limit: float, last: bool = False) -> str:
    """CTEs ``donos(id, centro, sim)`` from ``ranked(id, rn, v)`` with unit vectors: centroids one after the other, then the best for each.

    ``last``: of centroids as similar the last by ``rn`` counts.
    """
    return f"""
viz AS (SELECT p.rn, list(q.rn) FILTER (q.rn IS NOT NULL) AS antes FROM {ranked} p LEFT JOIN {ranked} q ON q.rn < p.rn AND round(list_dot_product(p.v, q.v), 12) >= {limit} GROUP BY p.rn),
passos AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS cabecas UNION ALL SELECT i + 1, CASE WHEN list_has_any(coalesce(antes, []::BIGINT[]), cabecas) THEN cabecas ELSE list_append(cabecas, i + 1) END FROM passos JOIN viz ON viz.rn = i + 1),
cab AS (SELECT r.* FROM {ranked} r WHERE rn IN (SELECT unnest(cabecas) FROM passos WHERE i = (SELECT max(i) FROM passos))),
lig AS (SELECT r.id, c.id AS centro, round(list_dot_product(r.v, c.v), 12) AS sim, c.rn FROM {ranked} r JOIN cab c ON r.id <> c.id AND round(list_dot_product(r.v, c.v), 12) >= {limit} WHERE r.id NOT IN (SELECT id FROM cab)),
donos AS (SELECT id, centro, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, rn {'DESC' if last else ''}) AS k FROM lig) WHERE k = 1 UNION ALL SELECT id, id, 1.0 FROM cab)
"""
