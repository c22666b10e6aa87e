"""Small scalar expressions: names, severities, quarter ends, loose equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import normalize as nz

# Words accepted for each severity.
SEVERITY_WORDS = {
    "P1": ("P1", "1", "SHOWSTOPPER", "CRITICALBLOCKER"),
    "P2": ("P2", "2", "CRITICAL"),
    "P3": ("P3", "3", "MAJOR"),
    "P4": ("P4", "4", "MEDIUM", "MINOR"),
}
SLUG_LENGTH = 50


def severity(c: Column, default: str = "P3") -> Column:
    """P1..P4 from a free word; unknown words and NULL give the default."""
    word = F.regexp_replace(F.upper(nz.stripped(c)), "[- ]", "")
    level = F.lit(default)
    for name, words in SEVERITY_WORDS.items():
        level = F.when(word.isin(*words), name).otherwise(level)
    return level


def severity_of(value, default: str = "P3") -> str:
    """The same mapping for one value of a specification."""
    word = "" if value is None else str(value).strip().upper().replace("-", "").replace(" ", "")
    return next((name for name, words in SEVERITY_WORDS.items() if word in words), default)


def slug(c: Column) -> Column:
    """A name safe for files: letters and digits kept, the rest underscored, 50 characters."""
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}]", "_"), 1, SLUG_LENGTH)


def quarter_end_plus(day: Column, days: int = 0) -> Column:
    """Last calendar quarter end on or before a date, plus a number of days."""
    start = F.trunc(F.date_add(day, 1), "quarter")
    return F.date_add(F.date_sub(start, 1), days)


def plain_number(c: Column, dtype: T.DataType) -> Column:
    """Number of a value without dropping separators or currency marks from text."""
    if isinstance(dtype, T.StringType):
        return nz.parsed_number(nz.stripped(c))
    return nz.number(c, dtype)


def folded(c: Column, dtype: T.DataType) -> Column:
    return nz.folded(nz.stripped(nz.as_text(c, dtype)))


def folded_value(value) -> str:
    return str(value).strip().casefold()


def loosely_equals(c: Column, dtype: T.DataType, expected) -> Column:
    """Equality with a constant as folded text or as a number; NULL never equals one."""
    if expected is None:
        return nz.nullish(c, dtype)
    equal = folded(c, dtype) == F.lit(folded_value(expected))
    try:
        wanted = float(expected)
    except (TypeError, ValueError):
        wanted = None
    if wanted is not None and wanted == wanted and not isinstance(dtype, (
            T.DateType, T.TimestampType, T.TimestampNTZType)):
        equal = equal | F.coalesce(plain_number(c, dtype) == F.lit(wanted), F.lit(False))
    return F.coalesce(equal, F.lit(False))


def loosely_in(c: Column, dtype: T.DataType, values) -> Column:
    """Membership as folded text; NULL is in no set."""
    wanted = [folded_value(v) for v in values]
    return F.coalesce(folded(c, dtype).isin(wanted), F.lit(False)) if wanted else F.lit(False)
