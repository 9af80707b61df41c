"""Times from texts in mixed forms, and texts from times. All are times of day without a zone: one in a text is dropped, not converted.

Everything is a column expression that doesn't hang on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms beside the usual one (year-month-day, then T or a space and the time of day, any zone last), and the usual form of each.
FORMS = (
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})(.*)$", "$1-$2-$3$4"),  # 2024/1/31 12:00:00
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(.*)$", "$3-$1-$2$4"),  # 1/31/2024 12:00:00, the month first
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6"),  # 20240131T120000
    (r"^(\d{4})(\d{2})(\d{2})((?:[T ].*)?)$", "$1-$2-$3$4"),  # 20240131, 20240131 12:00:00
)


def parsed(text: Column, forms: tuple[tuple[str, str], ...] = FORMS) -> Column:
    """A time without a zone from a text; null from null and from what is no time, such as the 30th of February. Times and dates pass through."""
    usual = F.trim(text.cast("string"))
    for form, into in forms:
        usual = F.regexp_replace(usual, form, into)
    return usual.try_cast("timestamp_ntz")


def strictly_parsed(text: Column, name: str = "time", forms: tuple[tuple[str, str], ...] = FORMS) -> Column:
    """The same, but a text that is no time fails the query and is named."""
    found = parsed(text, forms)
    return F.when(found.isNull() & text.isNotNull(), F.raise_error(F.concat(F.lit(f"{name}: no time in '"), text.cast("string"), F.lit("'"))).cast("timestamp_ntz")).otherwise(found)


def written(time: Column, pattern: str = "yyyy-MM-dd", forms: tuple[tuple[str, str], ...] = FORMS) -> Column:
    """Times, or texts of times in any of the forms, in one form; null where there is no time."""
    return F.date_format(parsed(time, forms), pattern)
