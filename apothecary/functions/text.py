"""Column expressions for identifiers, names and texts (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it, for the ASCII and common Unicode cases.
_WS = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


#: The same characters one by one, for trimming without a pattern.
_WS_CHARS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Trim any white space on both sides; NULL stays NULL."""
    return F.btrim(c, F.lit(_WS_CHARS))


def is_blank(c: Column) -> Column:
    """True for NULL, empty and white space only; never NULL."""
    return F.coalesce(strip(c) == "", F.lit(True))


def squash(c: Column) -> Column:
    """Lower case without any white space; blank becomes NULL."""
    return F.nullif(F.lower(F.regexp_replace(c, f"{_WS}+", "")), F.lit(""))


def normalize_ndc(c: Column) -> Column:
    """Bring a drug code to 11 digits (package) or 9 digits (product), else NULL.

    An NDC prefix is dropped. Plain digits count only with 9 or 11 places; hyphenated
    codes have two or three parts, each padded to 5, 4 and 2 places. A part that is
    too long makes the code NULL: ``lpad`` alone would cut it off silently.
    """
    code = F.regexp_replace(strip(c), r"(?i)^NDC\s*[:#]?\s*", "")
    part = F.split(code, "-")
    p1, p2, p3 = (F.get(part, F.lit(i)) for i in range(3))
    fits2 = (F.length(p1) <= 5) & (F.length(p2) <= 4)
    return (
        F.when(code.rlike(r"^(\d{9}|\d{11})$"), code)
        .when(code.rlike(r"^\d+-\d+$") & fits2, F.concat(F.lpad(p1, 5, "0"), F.lpad(p2, 4, "0")))
        .when(
            code.rlike(r"^\d+-\d+-\d+$") & fits2 & (F.length(p3) <= 2),
            F.concat(F.lpad(p1, 5, "0"), F.lpad(p2, 4, "0"), F.lpad(p3, 2, "0")),
        )
    )


def package_key(c: Column) -> Column:
    """The 11 digits of a package code, else NULL."""
    n = normalize_ndc(c)
    return F.when(F.length(n) == 11, n)


def recall_key(c: Column) -> Column:
    """A recall number trimmed and in upper case; blank becomes NULL."""
    return F.nullif(F.upper(strip(c)), F.lit(""))


def record_key(feed: str) -> Column:
    return recall_key(F.col("recall_number")) if feed == "recalls" else package_key(F.col("package_ndc"))
