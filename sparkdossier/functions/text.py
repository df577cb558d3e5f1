"""Text scalars as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkdossier.functions.scanners import EMAIL

# Routes that are counted, longest first, and the label of all others.
ROUTES = ("/dokument/operasjoner", "/dokument", "/forhandssjekk", "/sladd", "/ekko", "/spor", "/jobb", "/innsyn", "/hjelp", "/metrics", "/dokumentasjon", "/openapi.json")
OTHER_ROUTE = "annet"
# Words that tell two languages apart.
NORWEGIAN = ("og", "i", "på", "det", "som", "til", "er", "av")
ENGLISH = ("the", "and", "of", "to", "is", "for")


# Spellings that are folded, in this order.
FOLDS = (("æ", "a"), ("ø", "o"), ("å", "a"), ("ae", "a"), ("oe", "o"), ("aa", "a"))


def fold(c: Column) -> Column:
    """Lower case with the letters that are spelled in two ways made one: æ, ae, å and aa to a, ø and oe to o."""
    out = F.lower(c)
    for old, new in FOLDS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def folded(word: str) -> str:
    """``fold`` of a constant."""
    word = word.lower()
    for old, new in FOLDS:
        word = word.replace(old, new)
    return word


def route(path: Column) -> Column:
    """The known route a path lies below; a version prefix and the query string do not count."""
    p = F.regexp_replace(F.substring_index(F.coalesce(path, F.lit("")), "?", 1), "^(/api/v1)+", "")
    out = F.lit(OTHER_ROUTE)
    for r in reversed(ROUTES):
        out = F.when((p == r) | p.startswith(r + "/"), r).otherwise(out)
    return out


def count_word(text: Column, word: str) -> Column:
    """Times `` word `` stands between single spaces; occurrences that share a space count once."""
    spaced = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(f" {word} "), F.lit("")))) / (len(word) + 2)).cast("int")


def guess_language(text: Column) -> Column:
    no = sum((count_word(text, w) for w in NORWEGIAN), F.lit(0))
    en = sum((count_word(text, w) for w in ENGLISH), F.lit(0))
    return F.when((no >= 2) & (no > en), "norsk").when((en >= 2) & (en > no), "engelsk").otherwise("")


def plausibility(text: Column, odd: str = r"[^\x00-\x7fæøåéèêóòôäöü]") -> Column:
    """1 less three times the share of visible characters outside the usual ones, not below 0; 0 without any."""
    low = F.lower(text)
    seen = F.length(F.regexp_replace(low, r"(?U)\s", ""))
    return F.when(seen == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 3.0 * F.regexp_count(low, F.lit(odd)) / seen))


def amount(raw: Column) -> Column:
    """Amount as written with blanks and dots between thousands and a comma or ``,-`` behind; letters O are zeros."""
    s = F.replace(F.regexp_replace(F.translate(raw, "oO", "00"), r"(?U)\s", ""), F.lit(",-"))
    comma = F.replace(F.replace(s, F.lit(".")), F.lit(","), F.lit("."))
    dotted = F.when(s.rlike(r"\.\d{2}$"), F.concat(F.replace(F.regexp_replace(s, r"\.\d{2}$", ""), F.lit(".")), F.lit("."), F.right(s, F.lit(2)))).otherwise(F.replace(s, F.lit(".")))
    return F.when(s.contains(","), comma).otherwise(dotted).try_cast("double")


def pick_engine(text_a: Column, sure_a: Column, text_b: Column, sure_b: Column) -> Column:
    """Which of two readings of a region stands: digits protect the first unless it has all but given up."""
    return (
        F.when(F.coalesce(text_b, F.lit("")) == "", "easyocr")
        .when((F.regexp_count(text_a, F.lit(r"\d")) >= 2) & (sure_a >= 0.35), "easyocr")
        .when((sure_a < 0.45) & (sure_b >= 0.5), "norhand")
        .when(sure_b - sure_a > 0.3, "norhand")
        .otherwise("easyocr")
    )


def sampled(key: Column, share: float, salt: str = "kalibrering:") -> Column:
    """Whether a key belongs to a fixed share of all keys."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key), 256), 1, 8), 16, 10).cast("long")
    return h % 10000 < int(share * 10000)


def emails(text: Column) -> Column:
    """Mail addresses in order, each once; letters of any script may stand in them."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?U)({EMAIL})"), 1))


def title_lines(text: Column) -> Column:
    """The first two lines that are neither blank, a page marker, nor a label with its value."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*\[Side \d+ av \d+\]") & ~x.rlike(r"^\s*[^:\n]{1,40}:\s*\S"))
    return F.slice(lines, 1, 2)


def statutes(text: Column) -> Column:
    """Sections cited as § a-b or § n, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"§\s*(\d{1,3}(?:-\d{1,3})?)"), 1))
