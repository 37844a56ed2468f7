"""Numbers in Japanese company texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("-", "", "None", "null", "N/A")


def halfwidth(c: Column) -> Column:
    """Full-width digits, comma and point as ASCII."""
    return F.translate(c, "０１２３４５６７８９，．", "0123456789,.")


def cleaned(c: Column) -> Column:
    """Null for what stands for a missing value."""
    t = F.trim(c)
    return F.when(~t.isin(*MISSING), t)


def _amount(c: Column, unit: str) -> Column:
    digits = F.replace(F.regexp_extract(c, rf"([0-9][0-9,]*(?:\.[0-9]+)?)\s*{unit}", 1), F.lit(","), F.lit(""))
    return F.when(digits != "", digits)


def capital_millions(c: Column) -> Column:
    """Capital in millions of yen: by unit, halves to even; under a million counts as 0."""
    t = halfwidth(c)
    million, hundred, thousand = (_amount(t, u) for u in ("百万円", "億円", "千円"))
    k = F.try_divide(thousand.cast("double"), F.lit(1000.0))
    return (
        F.when(t.contains("百万円"), F.floor(million.cast("double")))
        .when(t.contains("億円"), F.bround(hundred.cast("double") * 100))
        .when(t.contains("千円"), F.when(k >= 1, F.bround(k)).when(k.isNotNull(), F.lit(0)))
        .otherwise(F.floor(_amount(t, "").cast("double")))
        .cast("long")
    )


def salary(c: Column) -> Column:
    """Yen; amounts in thousands times 1000."""
    t = halfwidth(c)
    return F.when(t.contains("千円"), F.floor(_amount(t, "千円").cast("double")) * 1000).otherwise(F.floor(_amount(t, "").cast("double"))).cast("long")


def first_number(c: Column) -> Column:
    """The first run of digits, commas aside; null for missing values."""
    digits = F.regexp_extract(F.replace(halfwidth(cleaned(c)), F.lit(","), F.lit("")), r"([0-9]{1,18})", 1)
    return F.when(digits != "", digits).cast("long")


def established(c: Column, this_year: int) -> tuple[Column, Column]:
    """(year, month): 2006年01月, 2006年, 2006/01 or 2006-01; years 1800 to now, months 1 to 12. A month out of range falls back to the year."""
    t = halfwidth(c)
    year = lambda p: F.when(F.regexp_extract(t, p, 1) != "", F.regexp_extract(t, p, 1)).cast("int")
    month = lambda p: F.when(F.regexp_extract(t, p, 2) != "", F.regexp_extract(t, p, 2)).cast("int")
    kanji, plain, slash = r"([0-9]{4})年\s*([0-9]{1,2})月", r"([0-9]{4})年", r"([0-9]{4})[/-]([0-9]{1,2})"
    okay = lambda y, m: y.between(1800, this_year) & m.between(1, 12)
    full, cut = okay(year(kanji), month(kanji)), okay(year(slash), month(slash))
    only = year(plain).between(1800, this_year)
    return F.when(full, year(kanji)).when(only, year(plain)).when(cut, year(slash)), F.when(full, month(kanji)).when(only, F.lit(None).cast("int")).when(cut, month(slash))


def postal(c: Column) -> Column:
    digits = F.regexp_replace(halfwidth(c), r"[^0-9]", "")
    return F.when(F.length(digits) == 7, F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 4)))


def phone(c: Column) -> Column:
    """10 digits as 2-4-4, 11 as 3-4-4, others as they are."""
    d = F.regexp_replace(halfwidth(c), r"[^0-9]", "")
    return (
        F.when(F.length(d) == 10, F.concat_ws("-", F.substring(d, 1, 2), F.substring(d, 3, 4), F.substring(d, 7, 4)))
        .when(F.length(d) == 11, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 4), F.substring(d, 8, 4))).otherwise(d)
    )


def memory_size(mb: Column, step: int = 256) -> Column:
    return (F.ceil(mb / step) * step).cast("long")


def whole_number(c: Column, unit: str, low: int = 0, high: int = 10**9) -> Column:
    """The number before a unit, within bounds; null else: an age (歳), employees (人, 名), a closing month (月, 1 to 12)."""
    n = F.floor(_amount(halfwidth(cleaned(c)), rf"(?:{unit})").cast("double")).cast("long")
    return F.when(n.between(low, high), n)
