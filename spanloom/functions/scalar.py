"""Scalar helpers, Column in and Column out; all built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_in(x: Column | str, values: Sequence) -> Column:
    """Membership that is false, not null, for a missing value."""
    return F.coalesce(_c(x).isin(*values), F.lit(False))


def detect(x: Column | str, pattern: str, ignore_case: bool = False, negate: bool = False) -> Column:
    found = _c(x).rlike(f"(?i){pattern}" if ignore_case else pattern)
    return ~found if negate else found


def any_pattern(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def replace_all(x: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply regex rewrite rules in order."""
    out = _c(x)
    for pattern, new in rules:
        out = F.regexp_replace(out, pattern, new)
    return out


def capture(x: Column | str, pattern: str, group: int = 1) -> Column:
    """Capture group, null when the pattern does not match."""
    return F.when(_c(x).rlike(pattern), F.regexp_extract(_c(x), pattern, group))


def piece(x: Column | str, sep: str, n: int) -> Column:
    """n-th piece (1-based) of a split; null when there are fewer."""
    return F.try_element_at(F.split(_c(x), sep), F.lit(n))


def sentence_case(x: Column | str) -> Column:
    x = _c(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2**31 - 1)))


def paste(*cols: Column | str, sep: str = " ") -> Column:
    """Paste values; a missing value prints as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit("NA")) for c in cols])


def paste_present(*cols: Column | str, sep: str = " ") -> Column:
    """Paste the values that are present; null when none is."""
    texts = [F.nullif(_c(c).cast("string"), F.lit("")) for c in cols]
    return F.nullif(F.concat_ws(sep, *texts), F.lit(""))


def parse_number(x: Column | str) -> Column:
    """First number inside a text, grouping commas ignored, else null."""
    found = F.regexp_extract(F.replace(_c(x), F.lit(","), F.lit("")), r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def abbreviate(x: Column | str, form: str = "%s_%s") -> Column:
    """``Genus_epithet`` -> ``G_epithet``; pieces after the second are dropped."""
    first, second = piece(x, "[^A-Za-z0-9]+", 1), piece(x, "[^A-Za-z0-9]+", 2)
    return F.when(second.isNotNull(), F.format_string(form, F.substring(first, 1, 1), second))


def parse_time(x: Column | str, *formats: str) -> Column:
    """Timestamp by the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(_c(x), F.lit(f)) for f in formats])


def days_between(start: Column | str, end: Column | str) -> Column:
    """Difference in days, always days whatever its size."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(86_400_000_000.0)


def ratio(x: Column | str, y: Column | str) -> Column:
    """Division that is null where the divisor is zero or missing."""
    return F.try_divide(_c(x), _c(y))


def fixed(x: Column | str, digits: int) -> Column:
    """Fixed-decimal text, null for null.

    Decimal casts stay in generated code and are several times faster than
    ``format_string``, which is kept for sizes a decimal cannot hold.
    """
    x = F.round(_c(x).cast("double"), digits)
    small = F.abs(x) < 1e18
    return F.when(small, x.cast(f"decimal({19 + digits},{digits})").cast("string")).when(
        x.isNotNull(), F.format_string(f"%.{digits}f", x)
    )


def percent_text(x: Column | str, digits: int = 0) -> Column:
    return F.concat(fixed(_c(x) * 100, digits), F.lit("%"))


def p_text(p: Column | str, digits: int = 3) -> Column:
    least = 10.0**-digits
    return F.when(_c(p) < least, F.lit(f"< {least:.{digits}f}")).otherwise(fixed(p, digits))


def mean_sd_text(mean: Column | str, sd: Column | str, digits: int = 2) -> Column:
    """``mean ± sd``; the mean alone when there is no spread."""
    return F.concat_ws(" ± ", fixed(mean, digits), fixed(sd, digits))


def stars(p: Column | str) -> Column:
    # Significance bands.
    p = _c(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "")


def word_list(words: Column | str) -> Column:
    """``a``, ``a and b``, ``a, b, and c`` from an array."""
    words = _c(words)
    n = F.size(words)
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    last = F.try_element_at(words, F.lit(-1))
    two = F.concat(head, F.lit(" and "), last)
    more = F.concat(head, F.lit(", and "), last)
    return F.when(n == 0, "").when(n == 1, last).when(n == 2, two).otherwise(more)


def recode(x: Column | str, table: Mapping[str, str], keep_unmatched: bool = False) -> Column:
    """Look a short code up in a literal table; unmatched gives null."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    found = F.try_element_at(F.create_map(*pairs), _c(x))
    return F.coalesce(found, _c(x)) if keep_unmatched else found


def dms_to_degrees(x: Column | str, degree_digits: int, hemisphere: str) -> Column:
    """Degrees-minutes-seconds digits without separators -> signed degrees.

    ``173250`` is 17 deg 32 min 50 s; with a decimal point the rest after the
    degrees is decimal minutes, ``1732.881`` is 17 deg 32.881 min.
    """
    text = _c(x)
    degrees = F.substring(text, 1, degree_digits)
    rest = F.substr(text, F.lit(degree_digits + 1))
    has_point = F.contains(text, F.lit("."))
    minutes = F.when(has_point, rest).otherwise(F.substring(rest, 1, 2))
    seconds = F.when(has_point, F.lit("")).otherwise(F.substring(rest, 3, 2))

    def number(part: Column) -> Column:
        return F.nullif(part, F.lit("")).try_cast("double")

    size = number(degrees) + number(minutes) / 60 + F.coalesce(number(seconds), F.lit(0.0)) / 3600
    return F.lit(-1.0 if hemisphere in ("S", "W") else 1.0) * size


def as_missing(x: Column | str, *tokens: str) -> Column:
    """Null for any of several missing-value tokens."""
    return F.when(~is_in(x, tokens), _c(x))


def nan_to_null(x: Column | str) -> Column:
    return F.when(~F.isnan(_c(x)), _c(x))
