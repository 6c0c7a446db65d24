"""Column functions: parsing, units, calendars, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that stand for a missing value, and the compass points in degrees.
MISSING_MARKS = ("", ".", "?", "M", "///", "#", "--", "×", ")")
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
COMPASS_GLYPHS = ("北南東西", "NSEW")


def number(text: Column) -> Column:
    """The number a text holds, else null. Marks of missing values, blanks round it and NaN give null."""
    bare = F.trim(text)
    value = F.when(~bare.isin(*MISSING_MARKS), bare).try_cast("double")
    return F.when(~F.isnan(value), value)


def number_or_zero(text: Column) -> Column:
    return F.coalesce(number(text), F.lit(0.0))


def compass_degrees(text: Column) -> Column:
    """Degrees of a compass point in Latin or East Asian letters; -1 for calm or unknown."""
    point = F.translate(F.trim(text), *COMPASS_GLYPHS)
    degrees = F.create_map(*[F.lit(v) for i, p in enumerate(COMPASS) for v in (p, 22.5 * i)])
    return F.coalesce(degrees[point], F.lit(-1.0))


def fahrenheit_to_celsius(f: Column) -> Column:
    return (f - 32) * 5 / 9


def knots_to_mps(k: Column) -> Column:
    return k * 1852 / 3600


def inches_to_hpa(p: Column) -> Column:
    return F.lit(1013.25) * (p / 29.92)


def cyclic_month(month: Column) -> tuple[Column, Column]:
    angle = month * (2 * F.pi()) / 12
    return F.sin(angle), F.cos(angle)


def hour24(day: Column, hhmm: Column) -> Column:
    """Timestamp of a day and 'HH:mm'; 24:00 is midnight of the next day."""
    late = hhmm == "24:00"
    when = F.concat_ws(" ", F.when(late, F.date_add(day, 1)).otherwise(day).cast("string"), F.when(late, "00:00").otherwise(hhmm))
    return F.to_timestamp(when, "yyyy-MM-dd HH:mm")


def fill_date_after_max(day: Column, latest: Column, days: int = 31) -> Column:
    return F.coalesce(day, F.date_add(latest, days))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def color_bucket(x: Column, low: Column, high: Column, levels: int = 10) -> Column:
    """0 .. levels - 1 for low .. high; the highest value stays in the last level."""
    return F.floor((x - low) / F.nullif(high - low, F.lit(0.0)) * (levels - 0.1)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v))


def edges(low: Column, high: Column, n: int) -> Column:
    """n + 1 evenly spaced edges."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: low + i * (high - low) / n)


def arg_max(a: Column) -> Column:
    """0-based place of the largest element, the first of equals."""
    return F.array_position(a, F.array_max(a)) - 1


def determinant(m: Column, n: int) -> Column:
    """Of an n x n array of arrays, n up to 3; for larger ones see operators.linalg."""
    e = lambda i, j: m[i][j]
    if n == 1:
        return e(0, 0)
    if n == 2:
        return e(0, 0) * e(1, 1) - e(0, 1) * e(1, 0)
    if n == 3:
        minor = lambda a, b: e(1, a) * e(2, b) - e(1, b) * e(2, a)
        return e(0, 0) * minor(1, 2) - e(0, 1) * minor(0, 2) + e(0, 2) * minor(0, 1)
    raise ValueError("n is 3 at most")


#: Punctuation that becomes a token of its own.
PUNCTUATION = r"([.,!?;:()\[\]{}\"'])"


def spaced_tokens(text: Column, keep_lines: bool = False) -> Column:
    """Lower-case tokens; punctuation marks are tokens. A newline parts words unless ``keep_lines`` glues them."""
    line = F.regexp_replace(F.lower(text), "[\\r\\n]+", "" if keep_lines else " ")
    return F.filter(F.split(F.trim(F.regexp_replace(line, PUNCTUATION, " $1 ")), r"\s+"), lambda w: w != "")


def spaced_words(text: Column) -> Column:
    """The tokens of spaced_tokens() as one text, with a space between two."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, " $1 "), r"\s+", " "))


def local_epoch(day: Column, zone: str) -> Column:
    """Seconds from 1970-01-01 UTC to the start of a date in a zone; for sessions whose zone is UTC."""
    return F.unix_timestamp(F.to_utc_timestamp(day.cast("timestamp"), zone))
