"""Scanners: where dates, amounts, digit runs, telephone numbers, references and mail addresses stand in a text.

Positions of all matches are what native expressions cannot give, so each scanner is a small Arrow UDF that returns an array of
structs; whatever is decided about a match is an expression or a join over its rows. All patterns have bounded repeats, so the
time grows with the text's length. ``register`` makes the scanners functions of a session's SQL.

A null text has no matches (an empty array). Positions count code points from 0; ``slutt`` is behind the last one.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import itertools
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from sparkdossier.functions import identifiers as I

# Month names of both languages.
MONTHS = {
    "januar": 1, "februar": 2, "mars": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "desember": 12,
    "january": 1, "february": 2, "march": 3, "may": 5, "june": 6, "july": 7, "october": 10, "december": 12,
}
# Forms of an amount, of a telephone number, of a mail address, of a labelled reference; what stands within a number.
NUMBER = r"\d+(?:[ .][\dOo]{3}){0,7}(?:[.,]\d{2}|,-)?"
PHONE = r"(?:\+47|0047)?[ ]?(?:(\d{2})[ ]?(\d{2})[ ]?(\d{2})[ ]?(\d{2})|(\d{3})[ ]?(\d{2})[ ]?(\d{3}))\b"
NO_PHONE = r"(?:faktura(?:nummer|nr)?|kunde(?:nummer|nr)?|ordre(?:nummer|nr)?|saksnr\.?|saksnummer)[.:\s]*$"
EMAIL = r"(?<![\w.+-])[\w.+-]{1,64}@[\w-]{1,63}\.[\w.]{2,24}(?![\w.-])"
REFERENCE_LABEL = r"\bkid[\s-]*(?:nummer|nr\.?)?[.:\s-]*"
NUMBER_LABELS = {
    "kontonummer": r"\bkonto(?:nummer|nr\.?)?[.:\s]*",
    "fodselsnummer": r"\b(?:f(?:ø|oe?)dselsnummer|fnr|personnummer|d-?nummer)[.:\s]*",
    "organisasjonsnummer": r"\b(?:organisasjonsnummer|orgnr\.?|org\.?\s*nr\.?)[.:\s]*",
    "kid": REFERENCE_LABEL,
}
GROUPED = r"\d+(?:[ .\u00A0\u202F]\d+)*(?:,\d+)?"
PAGE_MARK = r"\[Side (\d+) av \d+\]"
# A page shorter than this has no foot; a foot is so many characters, or a fifth of its page if that is more.
LEAST_PAGE, FOOT, FOOT_SHARE = 200, 600, 5
# The forms of a date (and whether its year has two digits), of an amount, and of codes.
CODES = (r"(?<!\d)\d{4,10}(?!\d)", r"\b(?=[A-Z0-9]{0,11}[A-Z])(?=[A-Z0-9]{0,11}\d)[A-Z0-9]{6,12}\b")

_NAMES = "|".join(MONTHS)
# Dates in digits, from every place where one may begin; a year of two digits is one of four that ends early, never both.
# Patterns that begin with a digit are sought much faster than those that look behind themselves first.
_DIGIT_DATE = re.compile(r"\d(?<!\d\d)(?=(\d?) *[./] *(\d{1,2}) *[./] *(\d{4}|\d{2})(?!\d)())")
_ISO_DATE = re.compile(r"(?P<y>\d(?<!\d\d)\d{3})-(?P<m>\d{2})-(?P<d>\d{2})(?!\d)")
_NAMED_DATES = (
    re.compile(rf"(?P<d>\d(?<!\d\d)\d?)[.\s]+(?P<m>{_NAMES})[.\s]+(?P<y>\d{{4}})(?!\d)", re.I),
    re.compile(rf"\b(?P<m>{_NAMES})\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}})\b", re.I),
)
_YEAR_BEHIND_DAY = re.compile(r"\d,?\s+\d{4}\b")
# What every month's name holds, and every label of a number; and letters that have no lower case of their own.
_IN_MONTHS = ("ma", "jan", "feb", "apr", "jun", "jul", "aug", "embe", "okto", "octo")
_IN_LABELS = {"kontonummer": ("konto",), "fodselsnummer": ("dselsnummer", "fnr", "personnummer", "dnummer", "d-nummer"), "organisasjonsnummer": ("org",), "kid": ("kid",)}
_ODD_LETTERS = "\u0130\u0131\u017f"
_AMOUNT = re.compile(
    rf"(?:kr\.?|NOK)\s?(?P<a>{NUMBER})|\b(?P<b>\d{{1,3}}(?:[ .]\d{{3}}){{1,7}}(?:,\d{{2}}|,-))|\b(?P<c>\d{{1,6}},\d{{2}})\b|\b(?P<e>{NUMBER})\s?(?:kr\.?|kroner|NOK)\b", re.I
)
_CURRENCY = re.compile(r"k(?:r\.?\s?\d|r(?<=[\do-]kr)|r(?<=[\do-]\skr))|n(?:ok\s?\d|ok(?<=[\do-]nok)|ok(?<=[\do-]\snok))")
_LINE_GAP, _GAPS = re.compile(r"\r?\n[ \t]*"), frozenset(" .-\u2010\u2011\u2012\u2013\u2014\u2015")
_BLOCK, _CENTS = re.compile(r"\d+"), re.compile(r"\d,[\d-]")
_GROUPED = re.compile(GROUPED)
_NOT_DIGIT, _BREAK = re.compile(r"\D"), re.compile("\n")
_LOCAL, _MAY_SPOIL = re.compile(r"[\w.+-]{1,65}"), re.compile(r"[aerAER][.:\s]*$")
_PHONE_PART = re.compile(r"[+ \d]{8,}")
_PHONE, _SPOILED, _EMAIL = re.compile(PHONE), re.compile(NO_PHONE, re.I), re.compile(EMAIL)
_REFERENCE = re.compile(REFERENCE_LABEL + r"((?:\d[ .]?){2,30}\d)", re.I)
_MARK = re.compile(PAGE_MARK)


def _may_hold(text: str, parts: tuple[str, ...]) -> bool:
    """Whether a pattern that needs one of the parts, in whatever case, can match at all: cheaper than the pattern itself."""
    low = text.lower()
    return any(p in low for p in parts) or any(c in text for c in _ODD_LETTERS)


def _written_dates(text: str) -> Iterator[tuple[int, int, str, str, str, bool]]:
    """Start, end, day, month, year, and whether the year has two digits; of one form no two overlap."""
    reach = {4: 0, 2: 0}
    for m in _DIGIT_DATE.finditer(text):
        day, month, year, _ = m.groups()
        if m.start() >= reach[len(year)]:
            reach[len(year)] = m.end(4)
            yield m.start(), m.end(4), m[0] + day, month, year, len(year) == 2
    named = _NAMED_DATES[: 2 if _YEAR_BEHIND_DAY.search(text) else 1] if _may_hold(text, _IN_MONTHS) else ()
    for pattern in (*((_ISO_DATE,) if "-" in text else ()), *named):
        for m in pattern.finditer(text):
            yield m.start(), m.end(), m["d"], m["m"], m["y"], False


def date_hits(text: str, as_of_year: int) -> list[tuple[int, int, datetime.date, bool]]:
    """Valid dates by place: start, end, date, and whether the century was assumed (from two digits, up to ``as_of_year``'s)."""
    out = []
    for start, end, day, month, year, short in _written_dates(text):
        year = int(year)
        if short:
            year += 2000 if year <= as_of_year % 100 else 1900
        try:
            date = datetime.date(year, int(month) if month.isdecimal() else MONTHS[month.lower()], int(day))
        except (KeyError, ValueError):
            continue
        if 1854 <= year <= as_of_year + 1:
            out.append((start, end, date, short))
    return sorted(out, key=lambda x: x[0])


def amount_hits(text: str) -> list[tuple[int, int, str]]:
    """Amounts by place: start, end (currency included), and the number as written."""
    if not _CENTS.search(text) and not _CURRENCY.search(text.lower()) and not any(c in text for c in _ODD_LETTERS):
        return []
    return [(m.start(), m.end(), m[m.lastgroup]) for m in _AMOUNT.finditer(text)]


def _runs(text: str) -> list[list[tuple[int, int]]]:
    """Starts and ends of the digit blocks of each run: one separator at most between blocks, or a line break with blanks behind it."""
    runs, edge = [], -1
    for m in _BLOCK.finditer(text):
        start, end = m.span()
        if runs and (start - edge == 1 and text[edge] in _GAPS or text[edge] in "\r\n" and _LINE_GAP.fullmatch(text, edge, start)):
            runs[-1].append((start, end))
        else:
            runs.append([(start, end)])
        edge = end
    return [run for run in runs if len(run) > 1 or run[0][1] - run[0][0] > 1]


def _stretches(runs: list[list[tuple[int, int]]], length: int) -> list[tuple[int, int]]:
    """Where blocks in a row hold ``length`` digits: start and end; both ends of a stretch move forward only."""
    out = []
    for blocks in runs:
        if blocks[-1][1] - blocks[0][0] < length:
            continue
        last, held = 0, 0
        for start, end in blocks:
            while last < len(blocks) and held < length:
                held += blocks[last][1] - blocks[last][0]
                last += 1
            if held < length:
                break
            if held == length:
                out.append((start, blocks[last - 1][1]))
            held -= end - start
    return out


def _free(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those that overlap nothing taken: as many taken ones end before such a one begins as begin before it ends."""
    begins, ends = sorted(s for s, _ in taken), sorted(e for _, e in taken)
    return [(a, z) for a, z in found if bisect.bisect_right(ends, a) == bisect.bisect_left(begins, z)]


def number_hits(text: str, length: int, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Digit blocks in a row that add up to ``length`` and overlap nothing ``taken``: start, end, digits."""
    found = _stretches(_runs(text), length)
    return [(a, z, _NOT_DIGIT.sub("", text[a:z])) for a, z in (_free(found, taken) if taken else found)]


def _too_long(part: str) -> bool:
    """A block of more than eight digits without a country's code: whatever ends it has a digit right before."""
    return len(part) > 8 and part.isdecimal() and not part.startswith("0047")


def phone_hits(text: str) -> Iterator[tuple[int, int, str]]:
    """Telephone numbers by place; a digit or a label of other numbers right before one spoils it, and so do 0 and 1 as its first digit."""
    # A number lies in one stretch of these characters; the one behind it tells whether the number's last digit ends a word.
    parts = (part for part in _PHONE_PART.finditer(text) if not _too_long(part[0].strip(" ")))
    for m in (m for part in parts for m in _PHONE.finditer(text, part.start(), part.end() + 1)):
        number = "".join(filter(None, m.groups()))
        if number[0] in "01" or text[max(0, m.start() - 1) : m.start()].isdecimal():
            continue
        before = _before(text, m.start(), 24)
        if not (_MAY_SPOIL.search(before) and _SPOILED.search(before)):
            yield m.end() - len(m[0].lstrip(" ")), m.end(), number


def _mails(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Mail addresses by place, each sought from its @; its name is the whole run of letters before that."""
    edge, at = 0, text.find("@")
    while at >= 0:
        name = _LOCAL.match(text[max(0, at - 65) : at][::-1])
        m = _EMAIL.match(text, at - name.end()) if name and name.end() <= min(64, at - edge) else None
        if m:
            edge = m.end()
            yield m.start(), edge, m[0], ""
        at = text.find("@", max(edge, at + 1))


def _before(text: str, start: int, n: int) -> str:
    return text[max(0, start - n) : start]


def _days(text: str, as_of_year: int) -> list[tuple]:
    return date_hits(text, int(as_of_year))


class Placing:
    """Where places of a text lie among its lines and pages, by bisection among the line breaks and page marks."""

    def __init__(self, text: str):
        self.breaks = [-1, *(m.start() for m in _BREAK.finditer(text)), len(text)]
        marks = list(_MARK.finditer(text)) if "[Side " in text else []
        self.mark_at, self.mark_no = [m.start() for m in marks], [1, *(int(m[1]) for m in marks)]
        self.tops = self.mark_at if self.mark_at[:1] == [0] else [0, *self.mark_at]
        self.edges = [*self.tops, len(text)]

    def of(self, start: int, end: int) -> tuple[int, int, int, int, bool]:
        """Start and end of its lines, the page's number, the line's number in the page, and whether it lies in the page's foot."""
        page, at = bisect.bisect_right(self.tops, start) - 1, bisect.bisect_left(self.breaks, start)
        top, bottom = self.edges[page], self.edges[page + 1]
        size = bottom - top
        low = size >= LEAST_PAGE and start >= max(bottom - max(FOOT, size // FOOT_SHARE), top + size // 2)
        number = self.mark_no[bisect.bisect_right(self.mark_at, start)]
        return self.breaks[at - 1] + 1, self.breaks[bisect.bisect_left(self.breaks, end)], number, at - bisect.bisect_left(self.breaks, top), low


def context(text: str, start: int, end: int) -> str:
    """45 characters before a place and 30 behind it, with single blanks."""
    return " ".join(text[max(0, start - 45) : end + 30].split())


def _dates(text: str, as_of_year: int) -> list[tuple]:
    """Dates with their line and page."""
    hits = date_hits(text, int(as_of_year))
    if not hits:
        return []
    placing, out = Placing(text), []
    for nr, (a, z, date, assumed) in enumerate(hits):
        head, foot, page, in_page, low = placing.of(a, z)
        gap = hits[nr + 1][0] - z if nr + 1 < len(hits) else None
        line = text[head:foot]
        out.append((
            nr, a, z, text[a:z], date, assumed, page, _before(text, a, min(80, a - head)), line[:400], len(line.strip()),
            in_page, low, text[z : z + max(gap, 0)] if gap is not None and gap <= 8 else None,
            text[max(0, a - 120) : z + 200], context(text, a, z),
        ))
    return out


def number_parts(raw: str) -> list[str]:
    """The blocks of a number as written, decimals with the last one: a comma's, or those behind the only dot if they are one or two."""
    whole, _, cents = raw.partition(",")
    if not cents and whole.count(".") == 1 and whole[-3:].rfind(".") in (0, 1) and whole[whole.rfind(".") + 1 :].isdecimal():
        whole, _, cents = whole.rpartition(".")
    cents = cents.rstrip("0")
    blocks = _BLOCK.findall(whole)
    return [*blocks[:-1], blocks[-1] + ("," + cents if cents else "")]


def stated_numbers(text: str) -> list[dict]:
    """Dates and numbers of an answer, as written and in one spelling: with what else each may be, the blocks of a run apart."""
    dates, at, out = date_hits(text, 9998), 0, []
    for start, end, date, _ in [*dates, (len(text), len(text), None, False)]:
        if start < at:  # within a date that was taken
            continue
        for m in _GROUPED.finditer(text, at, start):
            parts = number_parts(m[0])
            out.append({"raa": m[0], "tall": "".join(parts), "deler": parts if len(parts) > 1 else []})
        if date is not None:
            out.append({"raa": text[start:end], "tall": date.isoformat(), "deler": []})
        at = end
    return out


def known_numbers(text: str, most: int = 12) -> list[str]:
    """All that a text supports: its dates, and of each run of blocks every stretch of up to ``most`` blocks, joined."""
    known = {date.isoformat() for _, _, date, _ in date_hits(text, 9998)}
    for m in _GROUPED.finditer(text):
        parts = number_parts(m[0])
        if len(parts) == 1:
            known.add(parts[0])
        else:
            known.update("".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, min(len(parts), i + most) + 1))
    return sorted(known)


def _numbers(text: str, length: int, guard: bool) -> list[dict]:
    found = _stretches(_runs(text), int(length))
    if guard and found:  # most texts have no candidate
        found = _free(found, [(s, e) for s, e, *_ in (*date_hits(text, 9998), *amount_hits(text))])
    return [{"start": s, "slutt": e, "tall": _NOT_DIGIT.sub("", text[s:e]), "foran": _before(text, s, 28)} for s, e in found]


_PLAIN_ELEVEN = re.compile(r"\d(?:[ .\-]?\d){10}")


def _above(text: str, edge: int, start: int, lines: int) -> str:
    """The end of ``text[edge:start]`` with at least its last ``lines`` lines that are not blank whole; all of it if there are fewer."""
    reach = 250
    while True:
        part = text[max(edge, start - reach) : start]
        if start - reach <= edge or sum(1 for line in part.splitlines()[1:] if line.strip()) >= lines:
            return part
        reach *= 2


def person_hits(text: str, before: int, lines: int) -> list[tuple]:
    """Valid persons' numbers written with at most one separator between digits: place, digits, the ``before`` characters before them, and
    the ``lines`` lines above that lie behind the last run of eleven digits without a gap. A number counts wherever it stands if it
    stands once outside dates and amounts."""
    found = [(s, e, text[s:e] if e - s == 11 else _NOT_DIGIT.sub("", text[s:e])) for s, e in _stretches(_runs(text), 11)]
    asked = {n for n in {n for _, _, n in found} if I.is_person(n)}
    valid, taken = set(), [(s, e) for s, e, _ in amount_hits(text)] if asked else []
    # No date can overlap eleven digits in a row, so dates are looked for only where all places of a number have gaps.
    for plain in (True, False):
        left = [(s, e) for s, e, n in found if n in asked and n not in valid and (e - s == 11) == plain]
        if left:
            taken = taken if plain else [*taken, *((s, e) for s, e, *_ in date_hits(text, 9998))]
            free = set(_free(left, taken)) if taken else left
            valid |= {n for s, e, n in found if n in asked and (s, e) in free}
    out, edge = [], 0
    for s, e, n in found if valid else ():
        if n in valid and _PLAIN_ELEVEN.fullmatch(text, s, e):
            out.append((s, n, _before(text, s, int(before)), _above(text, edge, s, int(lines))))
        if e - s == 11:
            edge = max(edge, e)
    return out


def _amounts(text: str) -> list[dict]:
    return [{"start": s, "slutt": e, "raa": d, "tekst": text[s:e].strip(), "kontekst": " ".join(text[max(0, s - 35) : e + 15].split())} for s, e, d in amount_hits(text)]


def _codes(text: str) -> list[dict]:
    out = []
    for pattern in CODES:
        out += [{"start": m.start(), "slutt": m.end(), "tall": m[0], "foran": " ".join(text[max(0, m.start() - 35) : m.end() + 20].split())} for m in re.finditer(pattern, text)]
    return out


def identifier_hits(text: str, forms: str = "elleve,ni,kid,telefon,epost,merket") -> list[tuple]:
    """Whatever may be an identifier, in one go: runs of eleven and nine digits, references, telephones, addresses, and labelled runs.

    ``form`` is ``elleve``, ``ni``, ``kid``, ``telefon`` or ``epost``, and ``merket:`` with the kind that a run's label names. Only
    the ``forms`` asked for are looked for.
    """
    asked, low = forms.split(","), text.lower()
    odd = any(c in text for c in _ODD_LETTERS)
    holds = lambda kind: odd or any(p in low for p in _IN_LABELS[kind])
    out, taken, runs = [], None, _runs(text) if "elleve" in asked or "ni" in asked else []
    for form, length in (("elleve", 11), ("ni", 9)):
        if form in asked and (found := _stretches(runs, length)):
            taken = [(s, e) for s, e, *_ in (*date_hits(text, 9998), *amount_hits(text))] if taken is None else taken
            out += [(form, s, e, _NOT_DIGIT.sub("", text[s:e]), _before(text, s, 28)) for s, e in _free(found, taken)]
    if "kid" in asked and holds("kid"):
        out += [("kid", *hit.values()) for hit in _SCANNERS["references"][2](text)]
    if "telefon" in asked:
        out += [("telefon", s, e, d, _before(text, s, 28)) for s, e, d in phone_hits(text)]
    if "epost" in asked and "@" in text:
        out += [("epost", *hit) for hit in _mails(text)]
    for kind, pattern in _LABELS.items() if "merket" in asked else ():
        if holds(kind):
            found = pattern.finditer(text) if odd or kind not in _BEGUN else _begun(pattern, text, low, *_IN_LABELS[kind])
            out += [(f"merket:{kind}", m.start(1), m.end(1), _UNGROUPED.sub("", m[1]), text[m.start() : m.start(1)].strip()) for m in found]
    return out


def _begun(pattern: re.Pattern, text: str, low: str, begin: str) -> Iterator[re.Match]:
    """Matches of a pattern that begins with the letters ``begin``, in whatever case; ``low`` is the text in lower case."""
    at = low.find(begin)
    while at >= 0:
        m = pattern.match(text, at)
        if m:
            yield m
        at = low.find(begin, m.end() if m else at + 1)


_ACCOUNT_BEFORE = re.compile(r"konto(?:nummer|nr)?[.:\s]*(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z", re.I | re.A)
_CHECKS = {"kontonummer": I.is_account, "fodselsnummer": I.is_person, "organisasjonsnummer": I.is_company, "kid": I.is_payment_reference}


def _proved(form: str, number: str, before: str) -> str | None:
    """What a hit proves to be by its checksum or form; None for what fails and for labelled runs."""
    if form == "elleve":
        person, account = I.is_person(number), I.is_account(number)
        return "kontonummer" if account and not (person and not _ACCOUNT_BEFORE.search(before)) else "fodselsnummer" if person else None
    if form == "ni":
        return "organisasjonsnummer" if I.is_company(number) else None
    if form == "kid":
        return form if I.is_payment_reference(number) else None
    return form if form in ("telefon", "epost") else None


def _wrong(form: str, number: str) -> str | None:
    """Why a labelled run fails its checksum; None for those that pass and for all other hits."""
    kind = form.removeprefix("merket:")
    if kind == form or _CHECKS[kind](number):
        return None
    return "kontrollsiffer_feilet" if kind == "kid" or len(number) in (9, 11) else "feil_lengde"


def judged_hits(text: str, forms: str) -> list[tuple]:
    """``identifier_hits`` with what each proves to be (``type``) and why a labelled run fails (``grunn``)."""
    return [(*hit, _proved(hit[0], hit[3], hit[4]), _wrong(hit[0], hit[3])) for hit in identifier_hits(text, forms)]


_UNGROUPED, _BEGUN = re.compile("[ .-]"), ("kontonummer", "organisasjonsnummer", "kid")
_RUN_BEHIND = r"((?:\d[ .-]?){4,30}\d)"
_LABELS = {kind: re.compile(f"(?i){label}{_RUN_BEHIND}") for kind, label in NUMBER_LABELS.items()}
_SPAN = "struct<start:int,slutt:int,tall:string,foran:string>"
_DATE_ROW = (
    "struct<nr:int,start:int,slutt:int,raa:string,dato:date,antatt:boolean,side:int,foran:string,linje:string,linjelengde:int,linje_i_side:int,nederst:boolean,"
    "mellom:string,rundt:string,kontekst:string>"
)
def _spans(pattern: re.Pattern, text: str, clean: str = "") -> list[dict]:
    """Matches of ``pattern`` (of its group, if it has one) without the characters of ``clean``, and the label before the group."""
    g = 1 if pattern.groups else 0
    return [{"start": m.start(g), "slutt": m.end(g), "tall": re.sub(f"[{clean}]", "", m[g]) if clean else m[g], "foran": text[m.start() : m.start(g)].strip()} for m in pattern.finditer(text)]


# What each scanner gives, by how many arguments; its rows are dicts, or tuples in the order of the fields.
_SCANNERS: dict[str, tuple[int, str, Callable[..., list]]] = {
    "days": (2, "struct<start:int,slutt:int,dato:date,antatt:boolean>", _days),
    "dates": (2, _DATE_ROW, _dates),
    "numbers": (3, _SPAN, _numbers),
    "persons": (3, "struct<start:int,tall:string,vindu:string,over:string>", person_hits),
    "amounts": (1, "struct<start:int,slutt:int,raa:string,tekst:string,kontekst:string>", _amounts),
    "codes": (1, _SPAN, _codes),
    "identifiers": (1, "struct<form:string,start:int,slutt:int,tall:string,foran:string>", identifier_hits),
    "judged": (2, "struct<form:string,start:int,slutt:int,tall:string,foran:string,type:string,grunn:string>", judged_hits),
    "stated": (1, "struct<raa:string,tall:string,deler:array<string>>", stated_numbers),
    "known": (1, "string", known_numbers),
    "phones": (1, _SPAN, lambda t: [{"start": s, "slutt": e, "tall": d, "foran": _before(t, s, 28)} for s, e, d in phone_hits(t)]),
    "emails": (1, _SPAN, lambda t: list(_mails(t))),
    "references": (1, _SPAN, lambda t: _spans(_REFERENCE, t, " .")),
    "labelled": (2, _SPAN, lambda t, label: _spans(re.compile(f"(?i){label}{_RUN_BEHIND}"), t, " .-")),
}


#: Scanners whose rows are tuples.
_TUPLED = ("days", "dates", "persons", "judged", "identifiers", "emails")


@functools.cache
def _udf(name: str):
    """The Arrow UDF of a scanner, made on first use: its arguments beyond the text are constants, its rows go into an Arrow array at once."""
    arity, kind, rows = _SCANNERS[name]
    made = to_arrow_type(DataType.fromDDL(f"array<{kind}>"))

    def run(text: pa.Array, *more: pa.Array) -> pa.Array:
        found = [rows(t, *given) if t is not None else [] for t, *given in zip(text.to_pylist(), *(m.to_pylist() for m in more), strict=True)]
        return listed(found, made) if name in _TUPLED else pa.array(found, type=made)

    def one(text: pa.Array) -> pa.Array:
        return run(text)

    def two(text: pa.Array, a: pa.Array) -> pa.Array:
        return run(text, a)

    def three(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        return run(text, a, b)

    return F.arrow_udf({1: one, 2: two, 3: three}[arity], f"array<{kind}>")


def scan_days(text: Column, as_of_year: int) -> Column:
    """Dates of five grammars by place: ``start, slutt, dato, antatt`` only."""
    return _udf("days")(text, F.lit(as_of_year))


def scan_dates(text: Column, as_of_year: int) -> Column:
    """Dates of five grammars by place, with what their classification looks at."""
    return _udf("dates")(text, F.lit(as_of_year))


def scan_numbers(text: Column, length: int, guard: bool = True) -> Column:
    """Digit runs of a length, however they are grouped; with ``guard`` none that overlaps a date or an amount."""
    return _udf("numbers")(text, F.lit(length), F.lit(guard))


def scan_persons(text: Column, before: int, lines: int) -> Column:
    """Valid persons' numbers by place, with the ``before`` characters before each and the ``lines`` lines above it."""
    return _udf("persons")(text, F.lit(before), F.lit(lines))


def scan_labelled(text: Column, label: str) -> Column:
    """Runs of 5 to 31 digits behind a label."""
    return _udf("labelled")(text, F.lit(label))


def scan_judged(text: Column, forms: Sequence[str]) -> Column:
    """What may be an identifier of the ``forms`` asked for (``elleve``, ``ni``, ``kid``, ``telefon``, ``epost``, ``merket``), with what it
    proves to be and why a labelled run fails."""
    return _udf("judged")(text, F.lit(",".join(forms)))


def scan(name: str, text: Column) -> Column:
    """``amounts``, ``codes``, ``phones``, ``emails`` or ``references`` (labelled payment references) of a text; its numbers as ``stated`` or ``known``."""
    return _udf(name)(text)


def register(spark: SparkSession) -> None:
    """Makes the scanners SQL functions: ``scan_dates(text, year)``, ``scan_numbers(text, length, guard)`` and so on."""
    for name in _SCANNERS:
        spark.udf.register(f"scan_{name}", _udf(name))


def _cut(text: str, spans) -> str:
    out, at = [], 0
    for start, end, kind, _ in spans:
        out += [text[at:start], f"[SLADDET {kind}]"]
        at = end
    return "".join([*out, text[at:]])


def leftmost(spans: list[tuple]) -> list[tuple]:
    """Spans (start, end, type, value) without overlap: from the left, the longer first at one start, each that begins behind the last kept."""
    kept, edge = [], 0
    for s in sorted(spans, key=lambda s: (s[0], -s[1], s[2], s[3] or "")):
        if s[0] >= edge:
            kept.append(s)
            edge = s[1]
    return kept


def _outside(spans: list[tuple], points: list[tuple]) -> list[tuple]:
    """Those of the points that lie in no span; the spans are sorted and do not overlap, so only the last one that begins before counts."""
    starts = [s[0] for s in spans]
    holds = lambda p, i: i > 0 and p[1] <= spans[i - 1][1]
    return [p for p in points if not holds(p, bisect.bisect_right(starts, p[0]))]


def proved_spans(hits: list[tuple], kinds: Sequence[str]) -> list[tuple]:
    """Start, end, type and value of the judged hits that prove to be of one of the kinds."""
    return [(start, end, kind, number) for _, start, end, number, _, kind, _ in hits if kind in kinds]


def removal(text: str, forms: str, kinds: Sequence[str]) -> tuple[str, list[str], list[tuple]]:
    """The text with a visible mark for each of its spans that stay, their types in order, and the suspects (start, end, type, reason) that
    lie in none of them."""
    hits = judged_hits(text, forms)
    kept = leftmost(proved_spans(hits, kinds))
    suspects = [(start, end, form.rpartition(":")[2], wrong) for form, start, end, _, _, _, wrong in hits if wrong is not None]
    return _cut(text, kept), [s[2] for s in kept], sorted(_outside(kept, suspects), key=lambda p: (p[0], p[2], p[3])) if suspects else []


_SUSPECT = "array<struct<start:int,slutt:int,type:string,grunn:string>>"
_REMOVED = f"struct<sladdet:string,typer:array<string>,mistenkt:{_SUSPECT}>"
_KEPT = "array<struct<start:int,slutt:int,type:string,verdi:string>>"


def listed(rows: Sequence[Sequence[tuple]], kind: pa.ListType) -> pa.Array:
    """Lists of tuples as an array of lists of structs, made field by field."""
    ends = pa.array(itertools.accumulate(map(len, rows), initial=0), pa.int32())
    fields = list(kind.value_type)
    columns = list(zip(*itertools.chain.from_iterable(rows), strict=True)) or [()] * len(fields)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields), type=kind)


def tuples(lists: pa.ListArray) -> list[list[tuple]]:
    """An array of lists of structs as lists of tuples, read field by field; null lists are empty."""
    flat = zip(*(c.to_pylist() for c in lists.flatten().flatten()), strict=True)
    return [list(itertools.islice(flat, n or 0)) for n in lists.value_lengths().to_pylist()]


@functools.cache
def _removing():
    made = to_arrow_type(DataType.fromDDL(_REMOVED))

    def run(text: pa.Array, forms: pa.Array, kinds: pa.Array) -> pa.Array:
        asked = [(f, k.split(",")) for f, k in zip(forms.to_pylist(), kinds.to_pylist(), strict=True)]
        rows = [(None, [], []) if t is None else removal(t, f, k) for t, (f, k) in zip(text.to_pylist(), asked, strict=True)]
        cut, types, suspects = zip(*rows, strict=True) if rows else ((), (), ())
        columns = [pa.array(cut, made.field(0).type), pa.array(types, made.field(1).type), listed(suspects, made.field(2).type)]
        return pa.StructArray.from_arrays(columns, fields=list(made))

    return F.arrow_udf(run, _REMOVED)


@functools.cache
def _proving():
    made = to_arrow_type(DataType.fromDDL(_KEPT))

    def run(text: pa.Array, forms: pa.Array, kinds: pa.Array) -> pa.Array:
        asked = [(f, k.split(",")) for f, k in zip(forms.to_pylist(), kinds.to_pylist(), strict=True)]
        return listed([[] if t is None else proved_spans(judged_hits(t, f), k) for t, (f, k) in zip(text.to_pylist(), asked, strict=True)], made)

    return F.arrow_udf(run, _KEPT)


@functools.cache
def _keeping():
    made = to_arrow_type(DataType.fromDDL(_KEPT))

    def run(spans: pa.Array) -> pa.Array:
        return listed([leftmost(s) for s in tuples(spans)], made)

    return F.arrow_udf(run, _KEPT)


def remove_identifiers(text: Column, forms: Sequence[str], kinds: Sequence[str]) -> Column:
    """``sladdet, typer, mistenkt`` of a text in one pass: all that proves to be of the ``kinds`` is found among the ``forms`` and removed,
    with a visible mark for each span that stays without overlap; their types in order; and the labelled runs (``start, slutt, type,
    grunn``) that fail their checksum and lie in none of them."""
    return _removing()(text, F.lit(",".join(forms)), F.lit(",".join(kinds)))


def scan_proved(text: Column, forms: Sequence[str], kinds: Sequence[str]) -> Column:
    """``start, slutt, type, verdi`` of what proves to be of the ``kinds`` among the ``forms``, overlaps included."""
    return _proving()(text, F.lit(",".join(forms)), F.lit(",".join(kinds)))


def leftmost_spans(spans: Column) -> Column:
    """Those of an array's spans (``start, slutt, type, verdi``) that stay without overlap, from the left, the longer first."""
    return _keeping()(spans)
