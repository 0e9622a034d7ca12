"""Licence scan: phrases and identifier tags by Aho-Corasick, expressions by shunting-yard."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Phrases of words and the labels they stand for.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "creative commons": "cc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
}
TAG = "spdx license identifier"
# Identifier families that leave nearly all uses open.
PERMISSIVE = re.compile(
    r"(mit|mit-0|apache-\d.*|bsd.*|0bsd|isc|zlib|unlicense|cc0.*|cc-by-\d.*|bsl-.*|python.*|postgresql|public-domain)\+?$"
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
# Forms of published identifiers, by family, and of exceptions.
IDENTIFIER = re.compile(
    r"mit(-0|-cmu|-modern-variant|-open-group)?|isc|zlib|unlicense|wtfpl|x11|ntp|curl|postgresql|libpng(-2\.0)?|openssl|vim|beerware"
    r"|apache-(1\.0|1\.1|2\.0)|0bsd|bsd-(1|2|3|4)-clause(-[a-z]+)*|bsl-1\.0|busl-1\.1|sspl-1\.0|ms-(pl|rl)|psf-2\.0|python-2\.0(\.1)?"
    r"|(a|l)?gpl-[123]\.[01](-only|-or-later|\+)?|mpl-(1\.0|1\.1|2\.0)(-no-copyleft-exception)?|epl-[12]\.0|eupl-1\.[012]|cddl-1\.[01]|cpl-1\.0"
    r"|cc0-1\.0|cc-by(-nc)?(-sa|-nd)?-[1234]\.[05]|cc-pddc|ofl-1\.[01]|odbl-1\.0|odc-by-1\.0|pddl-1\.0|gfdl-1\.[123](-only|-or-later)?"
    r"|artistic-(1\.0(-perl)?|2\.0)|afl-[123]\.[01]|ecl-[12]\.0|osl-[123]\.[01]|mulanpsl-[12]\.0|upl-1\.0|unicode-(3\.0|dfs-201[56])|ruby|php-3\.0[1]?"
    r"|(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+"
)
EXCEPTION = re.compile(r"[a-z0-9.-]*-exception(-[a-z0-9.-]+)?|linux-syscall-note|additionref-[a-z0-9.-]+")
TOKEN = re.compile(r"\s*([()]|[a-z0-9]+(?:[.:-]+[a-z0-9]+)*\+?)")
BINDING = {"or": 1, "and": 2, "with": 3}


def expression_tokens(text: str) -> list[str]:
    """Tokens of the expression that a text begins with.

    It ends before the first token that cannot continue it: a word that is no published
    identifier, an operator without a left side, a bracket that closes nothing. What is
    left open there goes too, so the result is a whole expression or empty.
    """
    tokens: list[str] = []
    depth, whole, at, text = 0, 0, 0, text.translate(LOWER)
    while found := TOKEN.match(text, at):
        token, before = found[1], tokens[-1] if tokens else ""
        after_operand = bool(tokens) and before != "(" and before not in BINDING
        if token == "(":
            fits = not after_operand and before != "with"
        elif token == ")":
            fits = after_operand and depth > 0
        elif token in BINDING:
            fits = after_operand and (token != "with" or before != ")")
        else:
            fits = not after_operand and bool((EXCEPTION if before == "with" else IDENTIFIER).fullmatch(token))
        if not fits:
            break
        depth += (token == "(") - (token == ")")
        tokens.append(token)
        at = found.end()
        if depth == 0 and token != "(" and token not in BINDING:
            whole = len(tokens)
    return tokens[:whole]


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: identifiers and operators in postfix order; None without an expression.

    ``with`` binds before ``and``, ``and`` before ``or``; case does not matter. Text
    behind the expression is left alone.
    """
    out: list[str] = []
    waiting: list[str] = []
    for token in expression_tokens(expression):
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in BINDING:
            while waiting and BINDING.get(waiting[-1], 0) >= BINDING[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + waiting[::-1] or None


def evaluate(postfix: list[str]) -> tuple[set[str], bool] | None:
    """Licence identifiers of an expression, and whether a permissive choice satisfies it.

    ``or`` is satisfied by either side, ``and`` by both; ``with`` adds an exception,
    which is kept among the identifiers and only widens what its licence allows.
    """
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token not in BINDING:
            stack.append(({token}, bool(PERMISSIVE.match(token))))
            continue
        if len(stack) < 2:
            return None
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0] | right[0], left[1]))
        else:
            free = left[1] or right[1] if token == "or" else left[1] and right[1]
            stack.append((left[0] | right[0], free))
    return stack[0] if len(stack) == 1 else None


@lru_cache(maxsize=4)
def _machine():
    """The automaton over ``' word word '``; a space on both sides keeps words whole."""
    machine = ahocorasick.Automaton()
    for phrase, label in NOTICES.items():
        machine.add_word(f" {phrase} ", (phrase, label, False))
    for phrase, label in BASE_PHRASES.items():
        machine.add_word(f" {phrase} ", (phrase, label, True))
    machine.add_word(f" {TAG} ", (TAG, None, False))
    machine.make_automaton()
    return machine


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, expressions, permissive, score."""
    lower = (text or "").translate(LOWER)
    words = WORD.findall(lower)
    if not words:
        return 0, 0, None, None, "", "", [], None, 0.0
    joined = f" {' '.join(words)} "
    hits = list(_machine().iter(joined))
    if not hits:
        return len(words), 0, None, None, "", "", [], None, 0.0
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    base_at, base, labels, tags, notices = [], set(), set(), [], 0
    for end, (phrase, label, is_base) in hits:
        at = int(np.searchsorted(starts, end - len(phrase) - 1))
        if is_base:
            base_at.append(at)
            base.add(label)
        if label is None:
            tags.append(at + TAG.count(" "))
        else:
            labels.add(label)
            notices += 1
    expressions, free = [], []
    if tags:
        ends = [m.end() for m in WORD.finditer(lower)]
        for last in tags:
            line = lower[ends[last] : _line_end(lower, ends[last])]
            postfix = to_postfix(line.lstrip(": \t"))
            value = evaluate(postfix) if postfix else None
            if value:
                expressions.append(" ".join(postfix))
                labels |= value[0]
                free.append(value[1])
    score = 1 - 0.4**notices * 0.05 ** len(expressions)
    return (
        len(words), len(base_at), min(base_at, default=None), max(base_at, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), expressions, all(free) if free else None, score,
    )


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, expressions array<string>, permissive boolean, score double"
)
TYPES = [
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.float64(),
]
NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "expressions", "permissive", "score"]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(scan(text.as_py()) for text in batch.column(1)))
        columns = [pa.array(list(values), kind) for values, kind in zip(rows, TYPES)]
        if columns:
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *NAMES])


def licence_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence labels of every row of ``docs``, and where its base phrases stand.

    Words are ``WORD`` after A-Z are lower-cased. ``n_base`` counts every place of every
    base phrase, overlaps included; ``first_word`` and ``last_word`` are the smallest and
    largest start (null without one). ``labels`` adds notice phrases and the identifiers
    of tagged expressions; malformed expressions are left out. ``permissive``: every
    tagged expression can be met by a permissive licence; null without one. ``score``:
    1 - 0.4^notices * 0.05^expressions. A null or empty text has 0 words and no label.
    Repeated rows come out as often as they go in; other columns are ignored.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return texts.mapInArrow(_scan_batches, SCHEMA)
