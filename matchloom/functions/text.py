"""Scalar text functions of the linkage operators, as Column → Column functions.

Everything is built-in Spark except Unicode normalisation and case folding, which the JVM's functions do not offer; those are
Arrow-backed pandas UDFs that run once per record, never per pair.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the linkage rules.
LEGAL_SUFFIXES = ("corp", "corporation", "pvt", "private", "ltd", "limited")
LEGAL_WORDS = ("inc", "llc", "ltd", "co", "corp", "limited", "private", "pvt", "the", "and", "of", "company")
ABBREVIATIONS = {
    "r": "rue", "av": "avenue", "ave": "avenue", "bd": "boulevard", "blvd": "boulevard", "pl": "place", "ch": "chemin",
    "imp": "impasse", "rte": "route", "fbg": "faubourg", "rd": "road", "ln": "lane", "dr": "drive", "nr": "near",
    "opp": "opposite", "hwy": "highway", "sq": "square", "ct": "court", "pkwy": "parkway", "cir": "circle", "mg": "marg",
}
SCRIPTS = ("LATIN", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "ARABIC", "OTHER")
STREET_NOISE = ("n", "no", "bis", "ter", "numero")

_SEPARATORS = frozenset("PSZC")
_DIGITS = "".join(chr(c) for c in range(128, 0x20000) if unicodedata.category(chr(c)) == "Nd")
_ASCII_DIGITS = "".join(str(unicodedata.digit(c)) for c in _DIGITS)


class _Blank(dict):
    """Translation table that learns: punctuation, symbols, separators and controls become blanks."""

    def __missing__(self, code: int):
        char = chr(code)
        self[code] = " " if unicodedata.category(char)[0] in _SEPARATORS else char
        return self[code]


_BLANK = _Blank()
# Signs that combine with the character before them, as a pattern's set, and a run of them behind an ASCII character.
_COMBINING = "".join(re.escape(chr(c)) for c in range(0x300, 0x20000) if unicodedata.combining(chr(c)))
_MARKS = re.compile(f"[{_COMBINING}]+")
_ACCENTED = re.compile(f"([\\x00-\\x7f])[{_COMBINING}]+")


def normalize(value: str | None) -> str:
    """NFKC, case-folded, separators to single blanks; "" for null. Letters, digits and marks of all scripts stay."""
    if not value:
        return ""
    return " ".join(unicodedata.normalize("NFKC", value).casefold().translate(_BLANK).split())


def audit_normalize(value: str | None) -> str:
    """The audit's rule: ``&`` is a word, everything that is not a word character is a blank."""
    folded = unicodedata.normalize("NFKC", value or "").casefold().replace("&", " and ")
    return " ".join(re.sub(r"[^\w]+", " ", folded).replace("_", " ").split())


def unaccented(value: str | None) -> str:
    """Decomposed, lower case, without combining marks."""
    return _MARKS.sub("", unicodedata.normalize("NFKD", value or "").lower())


def fold_latin(value: str | None) -> str:
    """Accents dropped from ASCII letters only (signs of other scripts stay); compatibility forms folded."""
    return unicodedata.normalize("NFKC", _ACCENTED.sub(r"\1", unicodedata.normalize("NFKD", value or "")))


def _udf(function):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(function)

    return run


def normalize_text(column: Column) -> Column:
    return _udf(normalize)(column)


def audit_normalize_text(column: Column) -> Column:
    return _udf(audit_normalize)(column)


def fold_latin_text(column: Column) -> Column:
    return _udf(fold_latin)(column)


def has_non_ascii(column: Column) -> Column:
    return F.coalesce(column.rlike(r"[^\x00-\x7F]"), F.lit(False))


def words(column: Column) -> Column:
    """Blank-separated words; an empty array for an empty or null text."""
    return F.filter(F.split(F.coalesce(column, F.lit("")), " "), lambda w: w != "")


def strip_legal_suffix(name: Column) -> Column:
    """At most two trailing legal words are dropped, never the only word."""
    return F.regexp_replace(name, rf"(?<=\S)( ({'|'.join(LEGAL_SUFFIXES)})){{1,2}}$", "")


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(words(name), lambda t: F.length(t) >= 2))


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{Nd}+"), F.lit(0))


def address_digits(address: Column) -> Column:
    return F.array_distinct(F.filter(digit_runs(address), lambda t: F.length(t) >= 2))


def ascii_digits(text: Column) -> Column:
    """Decimal digits of all scripts as 0 to 9, so that they can be read as numbers."""
    return F.when(text.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(text, _DIGITS, _ASCII_DIGITS)).otherwise(text)


def _without_zeros(token: Column) -> Column:
    stripped = F.regexp_replace(token, "^0+", "")
    return F.when(stripped == "", F.lit("0")).otherwise(stripped)


def record_digits(address: Column, limit: int = 4) -> Column:
    """Distinct digit runs in order, leading zeros dropped (``0`` stays)."""
    return F.slice(F.array_distinct(F.transform(digit_runs(address), _without_zeros)), 1, limit)


def record_name_tokens(name: Column, limit: int = 8) -> Column:
    return F.slice(name_tokens(name), 1, limit)


def record_address_tokens(address: Column, limit: int = 10) -> Column:
    keep = F.filter(words(address), lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\p{Nd}+$"))
    return F.slice(F.array_distinct(keep), 1, limit)


def token_hash(token: Column) -> Column:
    """crc32 with 0 moved to 1, as 0 means "no token" in padded stores."""
    return F.greatest(F.crc32(token.cast("binary")), F.lit(1))


def number_codes(address: Column, limit: int = 4) -> Column:
    """Distinct numbers of an address in order; runs over 12 digits by their crc32."""
    code = lambda t: F.when(F.length(t) <= 12, ascii_digits(t).cast("long")).otherwise(F.crc32(t.cast("binary")))
    return F.slice(F.array_distinct(F.transform(digit_runs(address), code)), 1, limit)


def token_codes(name: Column, limit: int = 6) -> Column:
    """Distinct words of a normalised name without legal words, in order."""
    return F.slice(F.array_distinct(F.filter(words(name), lambda t: ~t.isin(*LEGAL_WORDS))), 1, limit)


def street_without_numbers(normalised_address: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(normalised_address, r"\p{Nd}+", " "), " +", " "))


def street_text(address: Column) -> Column:
    """Unaccented words without digits, abbreviations written out, noise words dropped."""
    runs = F.regexp_extract_all(_udf(unaccented)(F.coalesce(address, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    written = F.transform(runs, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return F.array_join(F.filter(written, lambda w: ~w.isin(*STREET_NOISE)), " ")


def first_number(address: Column) -> Column:
    """The first digit run as a number; -1 if there is none or it has more than 12 digits."""
    run = F.regexp_extract(F.coalesce(address, F.lit("")), r"\p{Nd}+", 0)
    return F.when((run != "") & (F.length(run) <= 12), ascii_digits(run).cast("long")).otherwise(F.lit(-1).cast("long"))


def canonical(text: Column, mapping: Column) -> Column:
    """Accent-folded words, replaced by their canonical form where the map has one."""
    return F.array_join(F.transform(words(fold_latin_text(F.coalesce(text, F.lit("")))), lambda w: F.coalesce(F.try_element_at(mapping, w), w)), " ")


def script_code(text: Column) -> Column:
    """Script of the first letter as its place in ``SCRIPTS``: 0 for ASCII letters and texts without letters."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), r"\p{L}", 0)
    code = F.when(~first.rlike(r"[^\x00-\x7F]"), 0)
    for place, name in enumerate(SCRIPTS[:-1]):
        code = code.when(first.rlike(rf"\p{{Is{name.capitalize()}}}"), place)
    return code.otherwise(len(SCRIPTS) - 1)


def first_foreign_script(text: Column) -> Column:
    """Name of the script of the first letter outside ASCII; LATIN without one."""
    code = script_code(F.regexp_extract(F.coalesce(text, F.lit("")), r"[\p{L}&&[^\x00-\x7F]]", 0))
    return F.element_at(F.array(*[F.lit(s) for s in SCRIPTS]), code + 1)


def beyond_latin(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x{0000}-\x{024F}]"), F.lit(False))


def digit_key(digits: Column) -> Column:
    """Order-free key of a set of numbers; null for none."""
    return F.when(F.size(digits) > 0, F.array_join(F.array_sort(digits), "|"))


def record_text(name: Column, address: Column) -> Column:
    """``name | address``, or the name alone where there is no address; blanks collapsed."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(clean(address) == "", clean(name)).otherwise(F.concat_ws(" | ", clean(name), clean(address)))


def encode_id(entity_id: Column) -> Column:
    """``S2-17`` → 34, ``S3-17`` → 35: the number shifted, the source in the lowest bit."""
    number = F.regexp_extract(entity_id, r"^S[23]-(\d+)$", 1).cast("long")
    return F.shiftleft(number, 1).bitwiseOR(F.when(entity_id.startswith("S3-"), 1).otherwise(0).cast("long"))


def decode_id(code: Column) -> Column:
    return F.concat(F.when(code.bitwiseAND(F.lit(1)) == 1, F.lit("S3-")).otherwise(F.lit("S2-")), F.shiftright(code, 1).cast("string"))


def numeric_id(entity_id: Column, prefix: str) -> Column:
    """The number behind ``PREFIX-`` if it is below 10^9, else null."""
    number = F.regexp_extract(F.coalesce(entity_id, F.lit("")), rf"^{prefix}-(\d{{1,18}})$", 1).try_cast("long")
    return F.when(number < 1_000_000_000, number)


def match_bucket(n: Column) -> Column:
    return F.when(n >= 6, F.lit("6+")).otherwise(n.cast("string"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(40.0)), F.lit(-40.0))))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def signature(*columns: Column) -> Column:
    """64-bit digest of several fields; only equality is meaningful."""
    return F.xxhash64(F.concat_ws("\u001f", *[F.coalesce(c, F.lit("\u0000")) for c in columns]))


def stable_fold(entity_id: Column, folds: int = 5) -> Column:
    """Fold of an id by the first 32 bits of its md5."""
    return F.pmod(F.conv(F.substring(F.md5(entity_id.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def order_key(entity_id: Column, seed: int = 0) -> Column:
    """Seeded pseudo-random order of ids (md5 as text)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), entity_id).cast("binary"))
