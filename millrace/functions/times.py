"""Times of feeds and viewing histories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text, trim_white

_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
_DAY, _MONTH = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)", "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_RFC1123 = rf"^{_DAY}, (\d{{2}}) {_MONTH} (\d{{4}}) (\d{{2}}:\d{{2}}:\d{{2}})(?:[.,]\d+)? ([+-]\d{{4}}|[A-Z]{{3,4}}(?:[+-]\d{{1,2}})?)$"
_RFC822 = rf"^(\d{{2}}) {_MONTH} (\d{{2}}) (\d{{2}}:\d{{2}}) ([+-]\d{{4}}|[A-Z]{{3,4}}(?:[+-]\d{{1,2}})?)$"
_LOCAL = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}([.,]\d+)?)?$"


def _zone(z: Column) -> Column:
    """+hhmm or a zone's name as an offset; names other than GMT+h count as 0."""
    hours = F.regexp_extract(z, r"^GMT([+-])(\d{1,2})$", 2)
    named = F.concat(F.regexp_extract(z, r"^GMT([+-])", 1), F.lpad(hours, 2, "0"), F.lit("00"))
    return F.when(z.rlike(r"^[+-]"), z).when(hours != "", named).otherwise(F.lit("+0000"))


def parse_feed_time(c: Column | str) -> Column:
    """A timestamp, or null, from ISO 8601 with or without zone, RFC 1123 and RFC
    822 dates and plain dates; without zone UTC; two-digit years from 69 are 19xx."""
    s = trim_white(c)
    iso = F.try_to_timestamp(F.when(s.rlike(_ISO), F.replace(s, F.lit(","), F.lit("."))))
    part = lambda pattern, i: F.regexp_extract(s, pattern, i)
    long = F.concat_ws(" ", part(_RFC1123, 1), part(_RFC1123, 2), part(_RFC1123, 3), part(_RFC1123, 4), _zone(part(_RFC1123, 5)))
    year = part(_RFC822, 3)
    century = F.when(year >= "69", F.lit("19")).otherwise(F.lit("20"))
    short = F.concat_ws(" ", part(_RFC822, 1), part(_RFC822, 2), F.concat(century, year), F.concat(part(_RFC822, 4), F.lit(":00")), _zone(part(_RFC822, 5)))
    dated = lambda pattern, value: F.try_to_timestamp(F.when(s.rlike(pattern), value), F.lit("dd MMM yyyy HH:mm:ss xx"))
    local = F.try_to_timestamp(F.when(s.rlike(_LOCAL), F.concat(F.replace(F.replace(s, F.lit(" "), F.lit("T")), F.lit(","), F.lit(".")), F.when(F.length(s) == 10, F.lit("T00:00:00")).otherwise(F.lit("")), F.lit("Z"))))
    return F.coalesce(iso, dated(_RFC1123, long), dated(_RFC822, short), local)


def parse_viewed_at(c: Column | str, tz: str = "UTC") -> Column:
    """ISO 8601 with a zone, else a time without one in ``tz``; null otherwise."""
    s = trim_white(c)
    iso = F.try_to_timestamp(F.when(s.rlike(_ISO), s))
    naive = F.try_to_timestamp(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?$"), F.concat(s, F.lit("Z"))))
    return F.coalesce(iso, F.to_utc_timestamp(naive, tz))


def published_or_fetched(published: Column | str, fetched: Column | str) -> Column:
    """The time of publication, else that of fetching, to the second."""
    return F.date_trunc("second", F.coalesce(F.col(published) if isinstance(published, str) else published, F.col(fetched) if isinstance(fetched, str) else fetched))


def stamp(c: Column | str) -> Column:
    """A timestamp as ISO 8601 text in UTC to the second, '' for null."""
    return text(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
