"""Many terms in one walk: a trie with failure links over the terms of all labels, built once for each worker and walked once for each text."""

from __future__ import annotations

import re
import sys
import types
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (name, whole words, substrings) of each label, by its number.
Terms = list[tuple[str, list[str], list[str]]]


@lru_cache(4096)
def wordish(c: str) -> bool:
    """Whether a character is part of a word: a letter, a digit of any script, or an underscore."""
    return c == "_" or unicodedata.category(c)[0] in "LN"


def _built(terms: Terms):
    """The automaton, whose hits carry the term's length and, for each label that has it, the label's number and whether it counts as a whole word only."""
    import ahocorasick

    held: dict[str, set[tuple[int, bool]]] = {}
    for number, (_, words, parts) in enumerate(terms):
        for whole, own in ((True, words), (False, parts)):
            for term in own:
                held.setdefault(term, set()).add((number, whole))
    out = ahocorasick.Automaton()
    for term, labels in held.items():
        if term:
            out.add_word(term, (len(term), bool(re.match(r"\w", term)), bool(re.search(r"\w\Z", term)), tuple(sorted(labels))))
    if len(out):
        out.make_automaton()
    return out


def _worker_automaton(key: str, terms: Terms):
    """The automaton of a worker, in a module of its own, as functions travel by value and would build one for each task."""
    held = sys.modules.setdefault("corvane_automata", types.ModuleType("corvane_automata")).__dict__
    if key not in held:
        held[key] = _built(terms)
    return held[key]


def labels_of(text: str, automaton, n: int) -> list[int]:
    """The numbers of labels that have a term in a text. Bounds of whole words are looked at where a term is found."""
    found: set[int] = set()
    for end, (length, opens, closes, labels) in automaton.iter(text) if len(automaton) else ():
        whole = None
        for number, bounded in labels:
            if number in found:
                continue
            if bounded:
                if whole is None:
                    start = end - length
                    whole = (start >= 0 and wordish(text[start])) != opens and (end + 1 < len(text) and wordish(text[end + 1])) != closes
                if not whole:
                    continue
            found.add(number)
        if len(found) == n:
            break
    return sorted(found)


def hits(text: Column, terms: Terms) -> Column:
    """The names of labels of which a text has a term, in order of their numbers; none for a null text."""
    key = str(hash(tuple((a, tuple(b), tuple(c)) for a, b, c in terms)))
    names = [name for name, _, _ in terms]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def walk(texts: pd.Series) -> pd.Series:
        automaton = _worker_automaton(key, terms)
        return pd.Series([[names[k] for k in labels_of(x or "", automaton, len(names))] for x in texts])

    return walk(text)
