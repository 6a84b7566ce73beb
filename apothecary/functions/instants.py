"""Normalise date and time texts of mixed formats and zones to UTC microseconds.

The texts run through an ordered cascade of anchored patterns. A pattern either
matches the whole text or not at all, so no value is parsed in part. Everything is a
column expression; no time-zone setting of the session plays a role.

Fixed policy for local times, chosen by parameter: those that occur twice
(``ambiguous``) mean the ``earlier`` or ``later`` instant or are rejected; those that
never occur (``nonexistent``) take the offset ``before`` the change or are rejected.

NULL, blank, impossible (month 13, 30 February, 25:00) and unknown-zone values yield
NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.functions.text import strip

# Abbreviations that mean one fixed offset, in minutes.
FIXED_OFFSETS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "CET": 60, "CEST": 120,
}

#: Zone of the wall-clock times of each source that has none of its own.
SOURCE_ZONES = {"shortages": "America/New_York", "recalls": "America/New_York"}

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_LONG = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MON = "(?:" + "|".join(sorted({*MONTHS, *_LONG, "sept"}, key=len, reverse=True)) + r")\.?"
_TIME = r"(?:(?:[T ]|, ?| +)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp])\.?[Mm]\.?(?![A-Za-z]))?(?: ?(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,5}|[A-Za-z]+(?:/[A-Za-z_+-]+)+))?)?"

#: name, anchored pattern, groups of (year, month, day), groups before the time. In order.
_CASCADE = (
    ("iso", r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", (1, 2, 3), 3),
    ("month_first", r"(\d{1,2})([/-])(\d{1,2})\2(\d{4}|\d{2})", (4, 1, 3), 4),
    ("day_first", r"(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})", (3, 2, 1), 3),
    ("day_month_name", rf"(?:[A-Za-z]{{3,9}}, ?)?(\d{{1,2}})[ -]({_MON})[ -](\d{{4}}|\d{{2}})", (3, 2, 1), 3),
    ("month_name_day", rf"(?:[A-Za-z]{{3,9}}, ?)?({_MON}) (\d{{1,2}}),? (\d{{4}})", (3, 1, 2), 3),
)
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})(\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:?\d{2})?)?$"


def known_zones(spark: SparkSession) -> list[str]:
    """Region names the JVM knows, so that no unknown one reaches the conversion."""
    ids = spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()
    return sorted(z for z in ids if "/" in z)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once: a lambda variable is never expanded in place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _canonical(v: Column) -> Column:
    """``format|year|month|day|hour|minute|second|fraction|am or pm|zone`` by the first pattern that matches."""
    c = F.when(v.rlike(r"^\d{10}$"), F.concat(F.lit("epoch_s|"), v)).when(v.rlike(r"^\d{13}$"), F.concat(F.lit("epoch_ms|"), v))
    c = c.when(v.rlike(_COMPACT), F.regexp_replace(v, _COMPACT, "compact|$1|$2|$3|$4|$5|$6|$7||$8"))
    for name, pattern, ymd, n in _CASCADE:
        whole = f"(?i)^{pattern}{_TIME}$"
        c = c.when(v.rlike(whole), F.regexp_replace(v, whole, "|".join([name, *[f"${i}" for i in (*ymd, *range(n + 1, n + 7))]])))
    return c


def _wall(p: Column) -> Column:
    """The wall-clock time of canonical parts, as if it were UTC; NULL if there is none such."""
    year = F.when(F.length(p[1]) == 2, F.concat(F.lit("20"), p[1])).otherwise(p[1])
    named = F.instr(F.lit("".join(MONTHS)), F.lower(F.substring(p[2], 1, 3)))
    month = F.when(named > 0, F.floor((named + 2) / 3).cast("string")).otherwise(p[2])
    hour, half = p[4].try_cast("int"), F.lower(p[8])
    h24 = F.when(half == "", p[4]).when(hour.between(1, 12), (hour % 12 + F.when(half == "p", 12).otherwise(0)).cast("string"))
    second = F.when(p[6] == "", "00").otherwise(p[6])
    time = F.when(p[4] == "", "00:00:00").otherwise(F.concat(h24, F.lit(":"), p[5], F.lit(":"), second, F.lit("."), F.rpad(F.substring(p[7], 1, 6), 6, "0")))
    return F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(p[3], 2, "0"), F.lit("T"), time, F.lit("Z")).try_cast("timestamp")


def _fixed(zone: Column) -> Column:
    """Offset in microseconds of an abbreviation or a numeric zone; NULL for others."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hh, mm = F.substring(digits, 1, 2).try_cast("int"), F.when(F.length(digits) == 4, F.substring(digits, 3, 2).try_cast("int")).otherwise(0)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    named = F.element_at(F.create_map(*[F.lit(x) for kv in FIXED_OFFSETS.items() for x in kv]), F.upper(zone))
    minutes = F.coalesce(named, F.when(zone.rlike(r"^[+-]") & (hh <= 18) & (mm <= 59), sign * (hh * 60 + mm)))
    return minutes.cast("long") * F.lit(60_000_000)


def parse_instant(df: DataFrame, source: str, default_zone: Column | str, ambiguous: str = "earlier", nonexistent: str = "before") -> DataFrame:
    """Add ``instant_us``, ``instant_format``, ``instant_zone``, ``instant_case`` for the text column ``source``.

    ``instant_case`` is ``plain``, ``ambiguous`` or ``nonexistent``. Rows are kept, whatever
    their value; fraction digits beyond microseconds are cut off. Extra columns pass
    through; a column named ``_instant`` is reserved.
    """
    if ambiguous not in ("earlier", "later", "reject") or nonexistent not in ("before", "reject"):
        raise ValueError("ambiguous: earlier, later or reject; nonexistent: before or reject")
    zones = known_zones(df.sparkSession)
    zone0 = F.lit(default_zone) if isinstance(default_zone, str) else default_zone
    day = F.lit(86_400_000_000).cast("long")

    def row(us: Column, fmt: Column, zone: Column, case: Column | str) -> Column:
        case = F.lit(case) if isinstance(case, str) else case
        return F.struct(us.cast("long").alias("us"), fmt.alias("format"), zone.alias("zone"), case.alias("case"))

    def regional(p: Column, wall: Column, zone: Column) -> Column:
        local = F.unix_micros(wall)
        back = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))

        def decide(e: Column) -> Column:
            second = local - (back(e["first"] + day) - (e["first"] + day))
            case = F.when(back(e["first"]) != local, "nonexistent").when((second != e["first"]) & (back(second) == local), "ambiguous").otherwise("plain")
            return _let(F.struct(case.alias("case"), second.alias("second")), lambda k: row(chosen(e["first"], k), p[0], zone, k["case"]))

        def chosen(first: Column, k: Column) -> Column:
            out = first
            if ambiguous != "earlier":
                out = F.when(k["case"] != "ambiguous", first).otherwise(k["second"] if ambiguous == "later" else F.lit(None))
            return F.when(k["case"] != "nonexistent", out) if nonexistent == "reject" else out

        return _let(F.struct(F.unix_micros(F.to_utc_timestamp(wall, zone)).alias("first")), decide)

    def civil(p: Column) -> Column:
        def of(x: Column) -> Column:
            none = row(F.lit(None), F.lit(None).cast("string"), F.lit(None).cast("string"), "plain")
            return (
                F.when(x["wall"].isNull() | (x["fixed"].isNull() & x["zone"].isNull()), none)
                .when(x["fixed"].isNotNull(), row(F.unix_micros(x["wall"]) - x["fixed"], p[0], F.upper(p[9]), "plain"))
                .otherwise(regional(p, x["wall"], x["zone"]))
            )

        zone = F.when(p[9] == "", zone0).when(p[9].isin(zones), p[9])
        return _let(F.struct(_wall(p).alias("wall"), _fixed(p[9]).alias("fixed"), zone.alias("zone")), of)

    def parsed(p: Column) -> Column:
        utc = F.lit("UTC")
        return (
            F.when(p[0] == "epoch_s", row(p[1].try_cast("long") * 1_000_000, p[0], utc, "plain"))
            .when(p[0] == "epoch_ms", row(p[1].try_cast("long") * 1_000, p[0], utc, "plain"))
            .otherwise(civil(p))
        )

    text = F.regexp_replace(strip(F.col(source)), r"\s+", " ")
    found = _let(text, lambda v: _let(F.split(_canonical(v), r"\|", -1), lambda p: F.when(p.isNotNull(), parsed(p))))
    # A generator keeps the optimiser from expanding the parse into every later expression.
    out = df.select("*", F.explode(F.array(found)).alias("_instant"))
    made = {"us": "instant_us", "format": "instant_format", "zone": "instant_zone"}
    out = out.withColumns({**{new: F.col(f"_instant.{old}") for old, new in made.items()}, "instant_case": F.coalesce("_instant.case", F.lit("plain"))})
    return out.drop("_instant")
