"""License scans: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser evaluates license expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import OWN, chunks, picked

#: Phrases and their labels that every scan has.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Phrases and labels of this scanner's own.
NOTICES = {
    "apache license": "apache", "mit license": "mit", "bsd license": "bsd", "mozilla public license": "mpl", "lesser general public license": "lgpl", "affero general public license": "agpl", "eclipse public license": "epl",
    "public domain": "public-domain", "creative commons": "creative-commons", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "boost software license": "boost", "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd", "terms of service": "terms", "isc license": "isc", "classpath exception": "classpath-exception", "linking exception": "linking-exception", "runtime library exception": "runtime-exception",
}
#: Labels of notices that let a text be used with attribution at most.
OPEN_LABELS = frozenset({"apache", "mit", "bsd", "isc", "boost", "public-domain", "cc-by"})
#: Words that may stand between two notices beside the one that joins them.
LINKS = frozenset("the a an gnu version versions v license licence licensed under terms of either both at your option any later its as well".split())
#: Words of the identifier tag, and where its expression stands in the text.
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n*]+)", re.IGNORECASE)
#: Identifiers, by their beginning, that let a text be used with attribution at most.
OPEN = ("MIT", "Apache-", "BSD-", "ISC", "Zlib", "Unlicense", "CC0-", "CC-BY-1", "CC-BY-2", "CC-BY-3", "CC-BY-4", "BSL-", "0BSD", "Python-", "PSF-")

#: Deletes nothing; every byte that can't be in a word becomes a space, A-Z become lower case.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


#: What an identifier in a tag's line looks like: a known beginning, a reference, or letters with a dash and a version.
_SPDX = re.compile(r"(?:MIT|ISC|Zlib|Unlicense|0BSD|(?:A|L)?GPL|MPL|EPL|BSL|Apache|BSD|CC0?|Python|PSF|Artistic|WTFPL|X11|NCSA|Classpath|GCC|LLVM|Bison|Font|Linux)(?:-[A-Za-z0-9.+\-]*[A-Za-z0-9+])?|(?:DocumentRef-[A-Za-z0-9.\-]+:)?LicenseRef-[A-Za-z0-9.\-]+|[A-Za-z][A-Za-z0-9.]*-[A-Za-z0-9.+\-]*[0-9][A-Za-z0-9.+\-]*", re.IGNORECASE)


class ExpressionError(ValueError):
    """An expression that doesn't parse."""


_RANK = {"OR": 1, "AND": 2, "WITH": 3}
_TOKEN = re.compile(r"[()]|[^\s()]+")
_NAME = re.compile(r"[A-Za-z0-9.:+\-]+")


def yard(tokens: list[str], named=lambda token: _NAME.fullmatch(token) is not None) -> tuple[list[str], int, str]:
    """The shunting-yard form of the longest leading part that is an expression, its number of tokens, and what stopped it ("" at the end).

    Operands, and operators after their operands. WITH binds closest and stands between one identifier and one exception only, then
    AND, then OR. ``named`` says which tokens can be an identifier.
    """
    out: list[str] = []
    held: list[str] = []
    done: tuple[list[str], int] = ([], 0)
    operand, simple, why = True, False, ""  # simple: a single identifier stands to the left, so WITH may follow
    for at, token in enumerate(tokens):
        word = token.upper()
        if word in _RANK:
            if operand:
                why = f"{token} without a left side"
                break
            if word == "WITH" and not simple:
                why = "WITH after more than one identifier"
                break
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[word]:
                out.append(held.pop())
            held.append(word)
            operand = True
        elif token == "(":
            if not operand or (held and held[-1] == "WITH"):
                why = "a bracket after an identifier or WITH"
                break
            held.append(token)
        elif token == ")":
            if operand or "(" not in held:
                why = "a bracket that closes too early or was never opened"
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            simple = False
        else:
            if not operand or not named(token):
                why = f"unexpected {token}"
                break
            out.append(token)
            operand, simple = False, not (held and held[-1] == "WITH")
        if not operand and "(" not in held:
            done = (out + held[::-1], at + 1)
    if not why and done[1] < len(tokens):
        why = "the expression ends early"
    return done[0], done[1], why


def postfix(expression: str) -> list[str]:
    """The shunting-yard form of a whole expression; one that doesn't parse to its end is an error."""
    out, size, why = yard(_TOKEN.findall(expression))
    if why or not size:
        raise ExpressionError(why or "an empty expression")
    return out


def leading(text: str) -> str:
    """The expression that a line begins with: it ends before prose or a comment's end. A line that begins with none, or breaks off after an operator or an open bracket, is an error."""
    tokens = _TOKEN.findall(text)
    _, size, why = yard(tokens, lambda t: _SPDX.fullmatch(t) is not None)
    rest = [t for t in tokens[size:] if t.upper() not in _RANK and t not in "()"]
    if not size or (tokens[size:] and not rest):
        raise ExpressionError(why or "an empty expression")
    return " ".join(tokens[:size]).replace("( ", "(").replace(" )", ")")


def evaluate(expression: str, allowed=lambda name: name.startswith(OPEN)) -> tuple[bool, list[str]]:
    """Whether the expression can be met by allowed licenses alone, and its identifiers. An exception after WITH only widens its license."""
    stack: list[bool] = []
    names, tokens = set(), postfix(expression)
    for k, token in enumerate(tokens):
        if token == "WITH":
            continue
        if token in _RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(left and right if token == "AND" else left or right)
        elif k + 1 == len(tokens) or tokens[k + 1] != "WITH":  # else it is an exception, whose license is on the stack
            names.add(token)
            stack.append(allowed(token))
    return stack.pop(), sorted(names)


def between(words: list[str], right: str) -> str | None:
    """The operator that the words between two notices mean, or None: one of or, and, with, beside words that only lead to a notice."""
    gap = re.sub(r"\bor (?:\(?at your option\)? )?(?:any )?(?:later|newer|above)(?: version)?", "", " ".join(words)).split()
    found = [w.upper() for w in gap if w.upper() in _RANK]
    if len(found) != 1 or any(w.upper() not in _RANK and w not in LINKS and not w.isdigit() for w in gap) or (found[0] == "WITH") != right.endswith("exception"):
        return None
    return found[0]


class Scanner:
    def __init__(self, notices: Mapping[str, str]):
        self.automaton = ahocorasick.Automaton()
        for phrase in dict.fromkeys([*BASE, *notices, TAG]):
            self.automaton.add_word(f" {phrase} ".encode().decode("latin-1"), (phrase, len(phrase) + 1))
        self.automaton.make_automaton()
        self.labels = {**notices, **BASE}

    def joined(self, line: str, found: list[tuple[int, str]]) -> list[str]:
        """The expressions that the notices of a text make: those that or, and or with joins are one, any other is its own."""
        spans = sorted({(at, at + len(phrase), self.labels[phrase]) for at, phrase in found if phrase != TAG}, key=lambda x: (x[0], -x[1]))
        out, end = [], -1
        for start, stop, label in spans:
            if stop <= end:  # a part of a longer notice
                continue
            op = between(line[end + 1 : start].split(), label) if out and start > end else None
            if op and not (op == "WITH" and " WITH " in out[-1].rpartition(" OR ")[2].rpartition(" AND ")[2]):
                out[-1] += f" {op} {label}"
            else:
                out.append(label)
            end = stop
        return out

    def scan(self, text: str) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, usable) of a text."""
        words = text.encode("utf-8").translate(WORDS).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        found = [(end - size, phrase) for end, (phrase, size) in self.automaton.iter(line)]
        if not found:
            return len(words), 0, None, None, "", "", 0.0, [], None
        base = [at for at, phrase in found if phrase in BASE]
        first, last = (line.count(" ", 0, min(base)), line.count(" ", 0, max(base))) if base else (None, None)
        own, named = {self.labels[p] for _, p in found if p != TAG}, {BASE[p] for _, p in found if p in BASE}
        expressions, tags = self.joined(line, found), 0
        met = [evaluate(e, OPEN_LABELS.__contains__)[0] for e in expressions]
        own |= {"license-choice"} if any(" OR " in e for e in expressions) else set()
        for raw in TAG_LINE.findall(text) if any(p == TAG for _, p in found) else ():
            try:
                expression = leading(raw)
                usable, names = evaluate(expression)
            except ExpressionError:
                own.add("invalid-expression")
                continue
            tags += 1
            expressions.append(expression)
            met.append(usable)
            own |= {f"spdx:{x.lower()}" for x in names}
        return len(words), len(base), first, last, ",".join(sorted(named)), ",".join(sorted(own)), 1 - 0.5 ** (len(found) + tags), expressions, all(met) if met else None


@cache
def scanner(notices: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(notices))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions and usable.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. Places may overlap and all count. The
    score is 1 - 0.5 to the number of places and valid tags. ``expressions`` has those of the tags and those that notices make: with
    or, and or with between them several are one expression, else each is its own. ``usable`` says whether all expressions can be
    met by open licenses, null without any. A null or empty text has no words, labels "" and score 0. Ids may be null or repeat; each row is
    scanned by itself. An empty table gives no rows. Other columns are ignored.
    """
    fixed = tuple(sorted(notices.items()))

    def run(batches: Iterator[pa.RecordBatch]):
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_()]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "usable"]
        for batch in batches:
            for part in chunks(batch, 1, 8 << 20):
                rows = list(zip(*map(scanner(fixed).scan, part.column(1).to_pylist()), strict=True))
                yield pa.record_batch([part.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], names=names)

    return picked(docs, id_col, text_col).select(OWN + "id", OWN + "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, usable boolean")
