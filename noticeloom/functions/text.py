"""String functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Escapes of characters outside ASCII, in the order of replacement.
UMLAUTS = [("ä", "'a"), ("ö", "'o"), ("ü", "'u"), ("Ä", "'A"), ("Ö", "'O"), ("Ü", "'U"), ("ß", "'s"), ("€", "'e"), ("$", "'t")]
# Characters that a URL escapes; the percent sign comes first.
URL_ESCAPES = [
    ("%", "%25"), (" ", "%20"), ("!", "%21"), ('"', "%22"), ("#", "%23"), ("$", "%24"), ("&", "%26"), ("'", "%27"), ("(", "%28"), (")", "%29"),
    ("*", "%2A"), ("+", "%2B"), (",", "%2C"), ("/", "%2F"), (":", "%3A"), (";", "%3B"), ("=", "%3D"), ("?", "%3F"), ("@", "%40"),
    ("[", "%5B"), ("\\", "%5C"), ("]", "%5D"), ("{", "%7B"), ("|", "%7C"), ("}", "%7D"),
    ("ä", "%C3%A4"), ("ö", "%C3%B6"), ("ü", "%C3%BC"), ("ß", "%C3%9F"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(x) with x bound to value: a long expression that is used often stands in the plan once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_all(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def replace_each(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = replace_all(text, old, new)
    return text


def escape_umlauts(text: Column) -> Column:
    return replace_each(text, UMLAUTS)


def unescape_umlauts(text: Column) -> Column:
    """Inverse of escape_umlauts, except where a text already held an escape."""
    return replace_each(text, [(b, a) for a, b in UMLAUTS])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_encode(text: Column) -> Column:
    """Lower-cased, with reserved characters and German letters percent-encoded."""
    return replace_each(ascii_lower(text), URL_ESCAPES)


def split_fields(text: Column, separator: str) -> Column:
    """Fields between separators; a last empty field is dropped, as reading line by line does."""
    parts = F.split(text, "\\Q" + separator + "\\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.filter(F.split(text, r"[\x09-\x0D ]+", -1), lambda x: x != "")


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"[\n ]", "")


def ngrams(words: Column, longest: int | None = None) -> Column:
    """Every contiguous run of words by start and then length: n(n+1)/2 of them, or those of at most so many characters."""

    def runs(w: Column) -> Column:
        upto = lambda i: F.size(w) - i + 1
        if longest is not None:  # words have a character at least, and a space stands between two
            upto = lambda i: F.least(F.size(w) - i + 1, F.lit(longest // 2 + 1))
        found = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), upto(i)), lambda k: F.array_join(F.slice(w, i, k), " "))))
        found = found if longest is None else F.filter(found, lambda x: F.char_length(x) <= longest)
        return F.when(F.size(w) > 0, found).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def strip_data_url(text: Column) -> Column:
    """What follows the first colon, and then the first comma, where there is one."""
    return F.regexp_replace(F.regexp_replace(text, r"^[^:]*:", ""), r"^[^,]*,", "")


def plain_base64(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.translate(F.base64(data), "\r\n", "")


def data_url(content_type: Column, data: Column) -> Column:
    """Attachment as a data URL; data is binary."""
    return F.concat(F.lit("data:"), content_type, F.lit(";base64,"), plain_base64(data))


def record_id(*parts: Column) -> Column:
    """A deterministic name in the form of a UUID from its parts."""
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def address_line(street: Column, postal_code: Column, city: Column) -> Column:
    """``street, code city`` from what is known."""
    town = F.concat_ws(" ", blank_to_null(postal_code), blank_to_null(city))
    return F.concat_ws(", ", blank_to_null(street), blank_to_null(town))


def venue_label(venue: Column, address: Column, title: Column) -> Column:
    return F.coalesce(blank_to_null(venue), blank_to_null(address), title)


def geo_uri(latitude: Column, longitude: Column, name: Column) -> Column:
    return F.concat(F.lit("geo://0,0?q="), latitude.cast("string"), F.lit(","), longitude.cast("string"), F.lit("("), name, F.lit(")"))


def event_text(title: Column, when: Column, place: Column, description: Column) -> Column:
    """A short text of an event, one known part a line."""
    return F.concat_ws("\n", *(blank_to_null(c) for c in (title, when, place, description)))
