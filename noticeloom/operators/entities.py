"""Regular-expression entities of texts."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of each kind, in the order of kinds.
PATTERNS = {
    "city": r"\b\d{5} +(?:[a-zA-ZäöüßÄÖÜ\-]|\. ){4,}",
    "date": r"(?:am |AM |vom |VOM |zum |ZUM |bis |BIS )?(?:31|30|[012]\d|\d)[./\s]+(?:0\d|1[012]|[1-9]|(?:Jan|Feb|Mar|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez|jan|feb|mar|apr|mai|jun|jul|aug|sep|okt|nov|dez|JAN|FEB|MAR|APR|MAI|JUN|JUL|AUG|OKT|NOV|DEZ|Mär|mär|MÄR|Oct|oct|OCT|Dec|dec|DEC)[a-zA-Z]*)(?:[./\s]+(?:20)?\d{2})?(?!\d)",
    "datetime": r"(?:um |ab |gegen |Einlass |EINLASS |UM |AB |GEGEN |Beginn |BEGINN |Start |START |von |VON |bis |BIS )*(?:1[0-9]|2[0-3]|[1-9])(?:[:.\s][0-5][05])?(?:[,\-\s]*(?:Uhr|H|UHR|h|uhr|AM|PM|am|pm))?(?!\d)",
    "dayofweek": r"(?:Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|MONTAG|DIENSTAG|MITTWOCH|DONNERSTAG|FREITAG|SAMSTAG|SONNTAG|Mo|Di|Mi|Do|Fr|Sa|So|MO|DI|MI|DO|FR|SA|SO)",
    "email": r"[a-zA-Z][a-z0-9_.-]+@[\da-z.-]+[. ][a-z.]{2,6}",
    "price": r"\b[0-9][0-9,. ]*(?:€|\$|EUR|,-)",
    "streetaddress": r"(?<![a-zA-ZäöüßÄÖÜ\- ])[a-zA-ZäöüßÄÖÜ\- ]{4,}+\d{1,4}(?!\d)",
    "url": r"(?:https?://)?[a-zA-Z][\da-zA-Z-]+\.*[. ][a-zA-Z.]{2,6}[/\w .-]*/?",
}
#: What every match of a kind holds, one of several strings or a short pattern: texts without it are not searched.
NEEDS = {"city": "[0-9]{5} ", "date": "[0-9]", "datetime": "[0-9]", "streetaddress": "[0-9]", "email": ("@",), "price": ("€", "$", "EUR", ",-")}
SHORT_KINDS = ("price", "dayofweek")


def may_match(text: Column, kind: str) -> Column:
    """Whether a text holds what every match of a kind does."""
    need = NEEDS.get(kind, "")
    return text.rlike(need) if isinstance(need, str) else functools.reduce(operator.or_, (text.contains(n) for n in need))


def matches(text: Column, kind: str) -> Column:
    """All matches of a kind, in order; except for prices and days, those of more than three bytes."""
    pattern = PATTERNS[kind].replace(r"\b", "(?<![0-9A-Za-z_])")  # before digits; Java's own takes letters beyond ASCII as parts of words
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.when(~may_match(text, kind), F.array().cast("array<string>")).otherwise(found) if kind in NEEDS else found
    return found if kind in SHORT_KINDS else F.filter(found, lambda x: F.octet_length(x) > 3)


def extract(rows: DataFrame, text: str = "text", kinds=tuple(PATTERNS), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, kind, ord, value): one row a match, duplicates kept; one scan for all kinds."""
    every = F.array(*(F.struct(F.lit(k).alias("kind"), matches(F.col(text), k).alias("values")) for k in sorted(kinds)))
    out = rows.select(*keys, F.explode(every).alias("m")).select(*keys, F.col("m.kind").alias("kind"), F.posexplode("m.values").alias("ord", "value"))
    return out.select(*keys, "kind", "ord", "value")


def distinct_values(entities: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, kind, vals): sorted distinct values of each kind."""
    return entities.groupBy(*keys, "kind").agg(F.array_sort(F.collect_set("value")).alias("vals"))
