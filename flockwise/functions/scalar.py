"""Column functions: times, ids, languages, handles, coercions, previews."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from flockwise.settings import Settings

#: The decay constant, a shortened ln 2 that results depend on.
DECAY = -0.693147


def moment(value: str | datetime | Column) -> Column:
    """A time without zone from text, a datetime or a column."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def days_before(at: Column, days: float) -> Column:
    """`at` minus a number of days."""
    return at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(days) * 86400).cast("decimal(18,6)"))


def whole_days(start: Column, end: Column) -> Column:
    """Completed days between two times (not crossings of midnight)."""
    return F.timestamp_diff("DAY", start, end)


def whole_hours(start: Column, end: Column) -> Column:
    """Completed hours between two times."""
    return F.timestamp_diff("HOUR", start, end)


def decay(days: Column, half_life_days: float) -> Column:
    """Share of a signal that is left after some days; days may be a fraction."""
    return F.exp(F.lit(DECAY) * days / F.lit(float(half_life_days)))


def snowflake_floor(at: Column) -> Column:
    """The smallest id of that millisecond: milliseconds since 1970, shifted by 16 bits."""
    return F.shiftleft(F.unix_millis(at.cast("timestamp")), 16)


def snowflake_time(id_: Column) -> Column:
    """The time in an id, to the millisecond."""
    return F.timestamp_millis(F.shiftright(id_, 16)).cast("timestamp_ntz")


def recency(age_hours: Column, s: Settings) -> Column:
    """Falls with age; whole hours, negative ages follow the same formula."""
    return F.lit(s.recency_numerator) / (age_hours / F.lit(24.0) + F.lit(s.recency_smoothing))


def language_boost(post: Column, ui: Column, chosen: Column, s: Settings) -> Column:
    """Five arms in order: no post language; a user without languages; the user's own; a chosen one; none."""
    low, high = F.lit(s.language_weight), F.lit(s.ui_language_weight)
    none = ui.isNull() & (chosen.isNull() | (F.size(chosen) == 0))
    return (
        F.when(post.isNull(), low)
        .when(none, low)
        .when(ui.isNotNull() & (post == ui), high)
        .when(chosen.isNotNull() & F.array_contains(chosen, post), low)
        .otherwise(F.lit(0.0))
    )


def popularity(local: Column, global_: Column, s: Settings) -> Column:
    """log10 of smoothed counts: of the graph, of the whole network, or a blend."""
    near, far = F.log10(local + F.lit(s.popularity_smoothing)), F.log10(global_ + F.lit(s.global_smoothing))
    if s.popularity_mode == "local":
        return near
    return far if s.popularity_mode == "global" else F.lit(s.blend_local) * near + F.lit(s.blend_global) * far


def primary_subtag(tag: Column) -> Column:
    """'pt' of 'pt-BR' or 'PT_br': up to the first hyphen, else the first underscore, in lower case; null for blank."""
    plain = F.lower(F.trim(tag))
    head = F.when(plain.contains("-"), F.substring_index(plain, "-", 1)).otherwise(F.substring_index(plain, "_", 1))
    return F.when(head != "", head)


def primary_subtags(tags: Column) -> Column:
    """Subtags of an array of tags, without repeats, in order."""
    return F.array_distinct(F.array_compact(F.transform(tags, primary_subtag)))


def handle_user(handle: Column) -> Column:
    """'ann' of '@ann@host.test', 'ann@host.test' or 'ann'."""
    return F.split(F.regexp_replace(F.trim(handle), "^@", ""), "@").getItem(0)


def handle_domain(handle: Column) -> Column:
    """'host.test' of the same; null if there is none."""
    parts = F.split(F.regexp_replace(F.trim(handle), "^@", ""), "@")
    return F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(2)))


def status_reference(reference: Column) -> Column:
    """The id in '.../statuses/ID', '.../@user/ID' or bare digits, else null."""
    found = F.regexp_extract(F.trim(reference), r"(?:/statuses/|/@[^/]+/|^)(\d+)/?(?:[?#].*)?$", 1)
    return F.when(found != "", found).try_cast("bigint") if hasattr(Column, "try_cast") else F.when(found != "", found).cast("bigint")


def without_secrets(dsn: Column) -> Column:
    """A connection string with the password masked."""
    return F.regexp_replace(dsn, r"(://[^:/@\s]*):[^@/\s]*@", "$1:***@")


def preview(text: Column, length: int) -> Column:
    """One line of at most `length` characters, with an ellipsis if cut; null becomes empty; pipes are escaped."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")
    cut = F.when(F.length(plain) > length, F.concat(F.substring(plain, 1, length), F.lit("..."))).otherwise(plain)
    return F.replace(cut, F.lit("|"), F.lit("\\|"))


def _strict(value: Column, made: Column, kind: str) -> Column:
    """`made`, or an error where there is a value that isn't one of that kind."""
    wrong = F.raise_error(F.concat(F.lit(f"not a {kind}: "), value.cast("string")))
    return F.when(value.isNotNull() & made.isNull(), wrong).otherwise(made)


def to_long(value: Column, default: int = 0, strict: bool = False) -> Column:
    """A whole number from any value; the default if it isn't one, or, if strict, an error for any value but null."""
    made = value.try_cast("bigint")
    return F.coalesce(_strict(value, made, "whole number") if strict else made, F.lit(default).cast("bigint"))


def to_double(value: Column, default: float = 0.0, strict: bool = False) -> Column:
    """A number from any value; the default if it isn't one, or, if strict, an error for any value but null."""
    made = value.try_cast("double")
    return F.coalesce(_strict(value, made, "number") if strict else made, F.lit(float(default)))


def to_text(value: Column, default: str = "") -> Column:
    """Text from any value; the default for null."""
    return F.coalesce(value.cast("string"), F.lit(default))
