"""Shapes of text as Catalyst predicates, and the same in Python for contract values."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of Unicode, which email and uri values must not hold.
BLANKS = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
#: RFC 3339 with a mandatory offset. `T` and `Z` in either case; no space for T, no leap second.
TIME = r"[Tt](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])"
UUID = r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
URI = rf"[A-Za-z][A-Za-z0-9+.-]*:[^{BLANKS}]+"


def _whole(c: Column, pattern: str) -> Column:
    return c.rlike(rf"\A(?:{pattern})\z")


def _day(c: Column) -> Column:
    return F.substring(c, 1, 10).try_cast("date").isNotNull() & (F.substring(c, 1, 4) != "0000")


def is_date(c: Column) -> Column:
    return _whole(c, DATE) & _day(c)


def is_timestamp(c: Column) -> Column:
    return _whole(c, DATE + TIME) & _day(c)


def is_uuid(c: Column) -> Column:
    return _whole(c, UUID)


def is_email(c: Column) -> Column:
    """One @, something before it, and behind it a domain with a dot inside; no white space."""
    sides = F.split(c, "@", -1)
    domain = F.try_element_at(sides, F.lit(2))
    inner = domain.contains(".") & ~domain.startswith(".") & ~domain.endswith(".")
    return (F.size(sides) == 2) & (sides[0] != "") & F.coalesce(inner, F.lit(False)) & ~c.rlike(f"[{BLANKS}]")


def is_uri(c: Column) -> Column:
    return _whole(c, URI)


SHAPES = {"timestamp": is_timestamp, "date": is_date, "uuid": is_uuid}
FORMATS = {"email": is_email, "uri": is_uri}


_BLANK = re.compile(f"[{BLANKS}]")


def fits_format(kind: str, text: str) -> bool:
    """is_email() and is_uri() of one text."""
    if kind == "uri":
        return re.fullmatch(URI, text) is not None
    local, _, domain = text.partition("@")
    inside = "." in domain and domain[0] != "." != domain[-1]
    return bool(local) and "@" not in domain and inside and not _BLANK.search(text)


def fits(kind: str, text: str) -> bool:
    """Whether a value of a contract has the shape of its type."""
    if kind == "uuid":
        return re.fullmatch(UUID, text) is not None
    if not re.fullmatch(DATE if kind == "date" else DATE + TIME, text):
        return False
    try:
        datetime.date.fromisoformat(text[:10])
    except ValueError:
        return False
    return True


def preview(c: Column, limit: int = 64) -> Column:
    """The text, cut to `limit` characters and marked if it was longer."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def observed(kind: Column, length: Column, canonical: Column) -> Column:
    """What may be told of a value without telling it: kind, length, digest of kind and canonical text."""
    return F.struct(kind.alias("kind"), length.alias("length"), F.sha2(F.concat(kind, F.lit("\0"), canonical), 256).alias("digest"))
