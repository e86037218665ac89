"""Keys of many markets: accent folding, postcodes and their local form, house-number spellings, town keys."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters that decomposition leaves, with their plain spelling.
PLAIN = {"ß": "SS", "ẞ": "SS", "đ": "D", "Đ": "D", "ł": "L", "Ł": "L", "ø": "O", "Ø": "O", "æ": "AE", "Æ": "AE", "œ": "OE", "Œ": "OE", "ð": "D", "Ð": "D", "þ": "TH", "Þ": "TH", "ı": "I"}
#: Cyrillic letters and their transliteration.
CYRILLIC = dict(zip("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЬЮЯЁЫЭӘҒҚҢӨҰҮҺІ", "A B V G D E ZH Z I Y K L M N O P R S T U F H TS CH SH SHT A Y YU YA YO Y E A G K N O U U H I".split(), strict=True))
#: Arabic letters written in several forms, and the form that stands for all; marks and the lengthening stroke go.
ARABIC = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ة": "ه", "ى": "ي", "ؤ": "و", "ئ": "ي", "ـ": ""}
#: Japanese numerals.
KANJI = {"〇": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
#: How each market writes a postcode whose blanks and hyphens are gone, as (market, pattern, form).
POSTCODE_FORMS = (
    ("CA", "^([A-Z][0-9][A-Z])([0-9][A-Z][0-9])$", "$1 $2"), ("GB", "^([A-Z0-9]+?)([0-9][A-Z]{2})$", "$1 $2"), ("IE", "^([A-Z0-9]{3})([A-Z0-9]{4})$", "$1 $2"), ("NL", "^([0-9]{4})([A-Z]{2})$", "$1 $2"),
    ("BR", "^([0-9]{5})([0-9]{3})$", "$1-$2"), ("PT", "^([0-9]{4})([0-9]{3})$", "$1-$2"), ("PL", "^([0-9]{2})([0-9]{3})$", "$1-$2"), ("CZ", "^([0-9]{3})([0-9]{2})$", "$1 $2"),
    ("SK", "^([0-9]{3})([0-9]{2})$", "$1 $2"), ("SE", "^([0-9]{3})([0-9]{2})$", "$1 $2"), ("JP", "^([0-9]{3})([0-9]{4})$", "$1-$2"), ("LT", "^([0-9]{5})$", "LT-$1"), ("LV", "^([0-9]{4})$", "LV-$1"), ("LU", "^([0-9]{4})$", "L-$1"),
)


def kanji_number(s: str) -> int:
    """A Japanese number up to 99."""
    total = ones = 0
    for c in s:
        total, ones = (total + 10 * (ones or 1), 0) if c == "十" else (total, 10 * ones + KANJI[c])
    return total + ones


def _blocks(s: str) -> str:
    """Japanese districts, blocks and numbers in one form: 丸の内二丁目7番9号 as 丸の内 2CHOME 7-9."""
    s = re.sub("([〇一二三四五六七八九十]+)(?=丁目)", lambda m: str(kanji_number(m[1])), s)
    s = re.sub(r"([0-9]+)(?:丁目|[\s-]*CHOME\b)[\s-]*", r" \1CHOME ", s)
    s = re.sub(r"([0-9]+)番地?(?=([0-9])?)", lambda m: m[1] + ("-" if m[2] else " "), s)
    return " ".join(re.sub("(?<=[0-9])号", " ", s).split())


def fold_text(s: str | None) -> str | None:
    """Compatibility forms and native digits unified, accents and apostrophes between letters gone, upper case.

    Cyrillic is transliterated, Arabic letters have one form each, Japanese block numbers one spelling.
    """
    if s is None:
        return None
    if s.isascii():
        s = s.upper()
    else:
        s = "".join(PLAIN.get(c, c) for c in unicodedata.normalize("NFKC", s))
        s = "".join(str(unicodedata.digit(c)) if not c.isascii() and c.isdigit() else c for c in s)
        s = "".join(ARABIC.get(c, c) for c in s if not "\u064b" <= c <= "\u065f" and c != "\u0670").upper()
        s = "".join(CYRILLIC.get(c, c) for c in s)
        kept = [c for c in unicodedata.normalize("NFD", s) if not ("̀" <= c <= "ͯ")]
        s = unicodedata.normalize("NFC", "".join(kept)).upper()
    for mark in "'’`":
        if mark in s:
            s = "".join(c for i, c in enumerate(s) if c != mark or not (0 < i < len(s) - 1 and s[i - 1].isalpha() and s[i + 1].isalpha()))
    return _blocks(s) if "丁目" in s or "番" in s or "CHOME" in s else s


@F.pandas_udf(StringType())
def _fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(fold_text)


def fold(df: DataFrame, column: str) -> DataFrame:
    """The column folded; a step of its own, since higher-order functions can't hold a Python function."""
    return df.withColumn(column, _fold(F.col(column)))


def norm_postcode(code: Column, market: Column) -> Column:
    """A folded postcode without blanks, hyphens and country prefix; null counts as empty."""
    s = F.regexp_replace(F.upper(F.coalesce(code, F.lit(""))), r"[\s〒-]", "")
    bare = F.regexp_extract(s, "^[A-Z]{1,2}([0-9]{4,5})$", 1)
    s = F.when((bare != "") & ~market.isin("GB", "IE", "CA", "NL"), bare).otherwise(s)
    four = F.regexp_extract(s, "[0-9]{4}", 0)
    return F.when((market == "AR") & (four != ""), four).otherwise(s)


def local_postcode(code: Column, market: Column) -> Column:
    """A normalised postcode as its market writes it."""
    out = F.lit(None).cast("string")
    for m, pattern, form in POSTCODE_FORMS:
        out = F.when(market == m, F.regexp_replace(code, pattern, form)).otherwise(out)
    return F.coalesce(out, code)


def number_spellings(number: Column, country: Column) -> Column:
    """A house number's spellings, itself first: the first part of a range or slash, and the second where that is a number of its own."""
    n = F.upper(F.regexp_replace(number, r"\s+", ""))
    pattern = "^([0-9]+[A-Z]?)([-/])([0-9]+[A-Z]?)$"
    first, mark, second = (F.regexp_extract(n, pattern, k) for k in (1, 2, 3))
    return F.array_distinct(F.array_compact(F.array(n, F.when(first != "", first), F.when((mark == "-") | ((mark == "/") & country.isin("CZ", "SK")), second))))


def locality_key(name: Column) -> Column:
    """A town's key: without brackets and what follows a comma, letters and digits only."""
    head = F.split(F.coalesce(name, F.lit("")), ",")[0]
    return F.trim(F.regexp_replace(F.upper(F.regexp_replace(head, r"\([^)]*\)", " ")), r"[^\p{L}\p{N}\p{M}]+", " "))
