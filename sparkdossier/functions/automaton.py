"""Many strings sought in a text at once: the words of a fixed list, or the values that were found in that very text.

One pass over the text answers for all strings, however many there are. As the scanners do, these give arrays of structs by small
Arrow UDFs, and what follows from a hit is an expression. Positions count code points from 0.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkdossier.functions.scanners import PAGE_MARK

_WORDS = "array<struct<start:int,slutt:int,ord:string>>"
_PLACES = "array<struct<start:int,side:int,antall:int>>"
_MARK, _NOT_BARE = re.compile(PAGE_MARK), re.compile(r"[\W_]+")


def automaton(words: Iterable[str]) -> ahocorasick.Automaton | None:
    """An automaton of the words that are not empty; None without any."""
    out = ahocorasick.Automaton()
    for w in words:
        if w:
            out.add_word(w, w)
    if not len(out):
        return None
    out.make_automaton()
    return out


def word_hits(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Hits that lie inside no longer one, by place: in order of start, the longer first, a hit that ends no later than one before it."""
    found = sorted(((end - len(w) + 1, -end - 1, w) for end, w in words.iter(text)))
    out, reach = [], -1
    for start, end, w in found:
        if -end > reach:
            out.append((start, -end, w))
            reach = -end
    return out


@functools.cache
def _word_udf(words: tuple[str, ...]):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        built = automaton(words)
        for part in parts:
            rows = [[] if not t or built is None else [{"start": s, "slutt": e, "ord": w} for s, e, w in word_hits(t, built)] for t in part]
            yield pd.Series(rows, dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, _WORDS)


def scan_words(text: Column, words: Iterable[str]) -> Column:
    """Where words of a fixed list stand in a text, in whatever surroundings; of hits inside one another the longest.

    A null or empty text has no hits (an empty array); hits that overlap without one holding the other all stay.
    """
    return _word_udf(tuple(sorted(set(words))))(text)


def bare_text(text: str) -> str:
    """Letters and digits of a text, each in lower case by itself."""
    kept = _NOT_BARE.sub("", text)
    low = kept.lower()
    return low if len(low) == len(kept) and "Σ" not in kept else "".join(c.lower() for c in kept)


def bare_places(text: str) -> list[int]:
    """The place in the text of each character of its ``bare_text``."""
    return [i for i, c in enumerate(text) if c.isalnum() for _ in c.lower()]


def _first_and_second(text: str, words: set[str]) -> dict[str, tuple[int, int]]:
    """For each word that stands in the text, its first place and how often it stands there without overlap, up to two."""
    out: dict[str, tuple[int, int]] = {}
    built = automaton(words)
    if built is not None:
        for end, w in built.iter(text):
            start = end - len(w) + 1
            known = out.get(w)
            if known is None:
                out[w] = (start, 1)
            elif known[1] == 1 and start >= known[0] + len(w):
                out[w] = (known[0], 2)
    return out


def value_places(text: str, values: list[tuple[str | None, str | None, int | None]]) -> list[dict]:
    """For each value (its second spelling, its stated place) the first place, the page there, and how often it stands in the text, up to two."""
    at: list[int] = []
    strip = {v: bare_text(v) for value, second, _ in values for v in (value, second) if v}
    plain = _first_and_second(text, {v for v, _, _ in values if v and v.strip()})
    loose = _first_and_second(bare_text(text), set(strip.values()))
    marks = [(m.start(), int(m[1])) for m in _MARK.finditer(text)]
    out = []
    for value, second, place in values:
        times = 0
        if value and value.strip():
            first, times = plain.get(value, (None, 0))
            for spelling in (value, second):
                if first is None and spelling and strip[spelling] in loose:
                    at = at or bare_places(text)
                    first = at[loose[strip[spelling]][0]]
            place = first if place is None else place
            if times < 2 and strip[value]:  # the bare form finds both ways of writing, so it is what counts
                times = loose.get(strip[value], (None, 0))[1]
        out.append({"start": place, "side": page_at(place, marks), "antall": times})
    return out


def page_at(place: int | None, marks: list[tuple[int, int]]) -> int | None:
    """The page of the last marker at or before a place: 1 where there are no markers, none before the first one."""
    if place is None:
        return None
    i = bisect.bisect_right(marks, place, key=lambda m: m[0])
    return 1 if not marks else marks[i - 1][1] if i else None


@functools.cache
def _place_udf():
    def run(text: pd.Series, values: pd.Series, seconds: pd.Series, places: pd.Series) -> pd.Series:
        rows = []
        for t, *given in zip(text, values, seconds, places, strict=True):
            entries = [] if given[0] is None else [(v, s, None if p is None or p != p else int(p)) for v, s, p in zip(*given, strict=True)]
            rows.append(value_places(t, entries) if t else [{"start": p, "side": page_at(p, []), "antall": None} for _, _, p in entries])
        return pd.Series(rows, dtype=object)

    return F.pandas_udf(run, _PLACES)


def scan_values(text: Column, values: Column, seconds: Column, places: Column) -> Column:
    """Where the values of an array stand in a text: verbatim, else as letters and digits alone, else so in their second spelling.

    One entry for each value in order: ``start`` (the stated place, else the first one), ``side`` (the page there) and ``antall``
    (0, 1, or 2 for more; null for a null or empty text, in which only stated places have a page). An absent, empty or blank value
    has no place but a stated one and stands nowhere.
    """
    return _place_udf()(text, values, seconds, places)
