"""Numbers, symbols and sides in free text, as column expressions.

Word borders are spelled out for ASCII: the engine's own would count letters of
other alphabets as parts of words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what counts as a number, and the borders of words
NUMBER = r"(?<![A-Za-z])([0-9][0-9.,]*)(?![0-9])"
BORDER_L, BORDER_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def number(s: Column) -> Column:
    """'1.234,56' -> 1234.56, '63,000' -> 63000, '0,45' -> 0.45; a trailing mark is ignored; else null."""
    # fixed values: decimal comma after points, thousands with commas, leading number
    s = F.regexp_replace(s, r"\s", "")
    local = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    text = F.when(s.rlike(r",\d{1,2}$") & s.contains("."), local).when(s.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(s, F.lit(","), F.lit("")))
    text = text.otherwise(F.regexp_replace(s, r"^([^,]*),", r"$1."))
    return F.nullif(F.regexp_extract(text, r"^(\d+(?:\.\d*)?)", 1), F.lit("")).try_cast("double")


def numbers(s: Column) -> Column:
    """All numbers not preceded by a letter."""
    return F.filter(F.transform(F.regexp_extract_all(s, F.lit(NUMBER), 1), number), lambda x: x.isNotNull())


def written_numbers(s: Column) -> Column:
    """As ``numbers``, each with whether it is written as a lone digit from 1 to 9: '8' and '8.' are, '8.00' is not."""
    found = F.transform(F.regexp_extract_all(s, F.lit(NUMBER), 1), lambda x: F.struct(number(x).alias("v"), x.rlike(r"^0*[1-9][.,]*$").alias("digit")))
    return F.filter(found, lambda x: x["v"].isNotNull())


def clean_symbol(s: Column) -> Column:
    return F.regexp_replace(F.upper(s), "[^A-Z0-9]", "")


def usdt_symbol(s: Column) -> Column:
    """Separators and perpetual suffixes off, USDT on; '' stays ''."""
    x = F.regexp_replace(F.regexp_replace(F.upper(F.trim(s)), r"[/\-\s]", ""), r"\.P$|PERP$", "")
    return F.when(x == "", "").when(x.endswith("USDT"), x).otherwise(F.concat(x, F.lit("USDT")))


def side_word(s: Column) -> Column:
    x = F.lower(F.trim(s))
    return F.when(x.rlike(r"^(1|\+1|long|l|buy|al)$"), 1).when(x.rlike(r"^(-1|short|s|sell|sat)$"), -1)


def funding_year(avg: Column) -> Column:
    return avg * 3 * 365
