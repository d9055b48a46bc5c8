"""Normal forms of dates, times, prices, days and URLs. ``compat`` keeps known deviations."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.functions.text import let

# Weekday names by their first two letters.
DAYS = {"mo": "Montag", "di": "Dienstag", "mi": "Mittwoch", "do": "Donnerstag", "fr": "Freitag", "sa": "Samstag", "so": "Sonntag"}
# The first three letters of month names, and their numbers.
MONTHS = [
    ("jan", "01"), ("feb", "02"), ("mar", "03"), ("mär", "03"), ("apr", "04"), ("mai", "05"), ("may", "05"), ("jun", "06"), ("jul", "07"),
    ("aug", "08"), ("sep", "09"), ("okt", "10"), ("oct", "10"), ("nov", "11"), ("dez", "12"), ("dec", "12"),
]


def day_name(text: Column) -> Column:
    """The weekday that a text begins with, by two letters; else empty."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in DAYS.items() for x in pair]), F.lower(F.substring(text, 1, 2)))
    return F.coalesce(found, F.lit(""))


def month_numbers(text: Column) -> Column:
    """The month name of a text as its number and a dot; names count from their first three letters."""
    word = "(?iu)(" + "|".join(n for n, _ in MONTHS) + ")[a-zäöü]*"
    number = F.element_at(F.create_map(*[F.lit(x) for pair in MONTHS for x in pair]), F.lower(F.regexp_extract(text, word, 1)))
    return F.coalesce(F.regexp_replace(text, F.lit(word), F.concat(number, F.lit("."))), text)


def date_digits(text: Column) -> Column:
    """Day and month of two digits each, then the year as it stands, without separators."""
    t = month_numbers(text)
    t = F.regexp_replace(t, r"(?<![0-9])([0-9])(?![0-9])", "0$1")
    return F.regexp_replace(t, "[^0-9]", "")


def normal_date(text: Column, today: datetime.date, pivot: int = 12) -> Column:
    """``YYYY-MM-DD``, or empty. Two-digit years are of this century if above the pivot or 00;
    without a year the date is the next such day from today on."""
    return let(date_digits(text), lambda d: _dated(d, today, pivot))


def _dated(d: Column, today: datetime.date, pivot: int) -> Column:
    n = F.char_length(d)
    day, month, yy = F.substring(d, 1, 2), F.substring(d, 3, 2), F.substring(d, 5, 2)
    coming = F.concat(month, day) >= F.lit(today.strftime("%m%d"))
    year = (
        F.when(n == 8, F.substring(d, 5, 4))
        .when((n == 6) & ((yy.try_cast("int") > pivot) | (yy == "00")), F.concat(F.lit("20"), yy))
        .when((n == 4) & (day != "20"), F.when(coming, F.lit(f"{today.year:04d}")).otherwise(F.lit(f"{today.year + 1:04d}")))
    )
    good = day.try_cast("int").between(1, 31) & month.try_cast("int").between(1, 12)
    return F.coalesce(F.when(good, F.concat(year, F.lit("-"), month, F.lit("-"), day)), F.lit(""))


def normal_time(text: Column, compat: bool = False) -> Column:
    """``HH:MM`` from the digits of a text, or empty; minutes are multiples of five."""
    return let(F.regexp_replace(text, "[^0-9]", ""), lambda d: _clock(d, compat))


def _clock(d: Column, compat: bool) -> Column:
    n = F.char_length(d)
    five = F.substring(d, -1, 1).isin("0", "5")
    one = F.lit("") if compat else F.concat(F.lit("0"), d, F.lit(":00"))
    return (
        F.when((n == 4) & five, F.concat(F.substring(d, 1, 2), F.lit(":"), F.substring(d, 3, 2)))
        .when((n == 3) & five, F.concat(F.lit("0"), F.substring(d, 1, 1), F.lit(":"), F.substring(d, 2, 2)))
        .when(n == 2, F.concat(d, F.lit(":00")))
        .when(n == 1, one)
        .otherwise(F.lit(""))
    )


def normal_url(url: Column) -> Column:
    """Lower case, with any scheme (or none) as http."""
    return F.concat(F.lit("http://"), F.regexp_replace(F.lower(url), r"^[a-z]+://", ""))


def repair_url(text: Column) -> Column:
    """What reading errors do to URLs undone: spaces, a lost dot after www, a lost last dot."""
    t = F.replace(F.replace(F.lower(text), F.lit(" "), F.lit("-")), F.lit("www-"), F.lit("www."))
    return F.regexp_replace(t, r"-([^-.]*)$", ".$1")


def url_host(url: Column) -> Column:
    """Host of a URL with a scheme, without port."""
    return F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]*)", 1)


def ticket(text: Column, compat: bool = False) -> Column:
    """(price, currency) of a price: by form, or with compat by cutting off what the last escaped two bytes are."""
    if compat:
        from noticeloom.functions.text import escape_umlauts, unescape_umlauts

        t = escape_umlauts(text)
        return F.struct(unescape_umlauts(F.substring(t, F.lit(1), F.greatest(F.char_length(t) - 2, F.lit(0)))).alias("price"), unescape_umlauts(F.substring(t, -2, 2)).alias("currency"))
    form = r"^\s*([0-9][0-9,. ]*?)\s*(€|\$|EUR|,-)\s*$"
    return F.struct(F.regexp_extract(text, form, 1).alias("price"), F.regexp_extract(text, form, 2).alias("currency"))


def weekday_of(date: Column) -> Column:
    """German name of a date's weekday; date is YYYY-MM-DD."""
    names = [DAYS[k] for k in ("so", "mo", "di", "mi", "do", "fr", "sa")]
    return F.element_at(F.array(*map(F.lit, names)), F.dayofweek(F.try_to_date(date)))


def start_times(date: Column, times: Column) -> Column:
    """ISO starts: the date with every time, the date alone if there is none, nothing without a date."""
    made = F.transform(times, lambda t: F.concat(date, F.lit("T"), t, F.lit(":00.000")))
    return F.when(F.coalesce(date, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(times) > 0, made).otherwise(F.array(date))


def display_date(start: Column, all_day: Column) -> Column:
    """``DD.MM.YYYY, HH:mm Uhr``, or the day alone."""
    return F.when(all_day, F.date_format(start, "dd.MM.yyyy")).otherwise(F.concat(F.date_format(start, "dd.MM.yyyy, HH:mm"), F.lit(" Uhr")))


def geocode_fields(response: Column) -> Column:
    """Typed place from one geocoder hit as JSON text; the town is the best of its levels, a house number counts with its road only."""
    g = lambda path: F.get_json_object(response, path)
    return F.struct(
        g("$.lat").try_cast("double").alias("latitude"), g("$.lon").try_cast("double").alias("longitude"),
        F.coalesce(g("$.address.city"), g("$.address.town"), g("$.address.village"), g("$.address.residential")).alias("city"),
        g("$.address.state").alias("region"), g("$.address.country").alias("country"), g("$.address.postcode").alias("postal_code"),
        F.when(g("$.address.road").isNotNull(), F.concat_ws(" ", g("$.address.road"), g("$.address.house_number"))).otherwise(F.lit("")).alias("address"))
