"""Comparable forms of names, strengths, application numbers and reason texts; stable hashes."""

from __future__ import annotations

import datetime as dt
import unicodedata
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from apothecary.functions.text import is_blank, normalize_ndc, strip

# Legal forms dropped from the end of a firm's name, as words.
LEGAL_FORMS = (
    "s a de c v", "pty ltd", "co ltd", "l l c", "l l p", "l p", "a s", "incorporated", "corporation", "company", "limited",
    "corp", "inc", "llc", "llp", "plc", "ltd", "gmbh", "ag", "lp", "sa", "co",
)
REASON_MISSING = "[fda reason missing]"


@lru_cache
def _forms(fold: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """By rule, what other characters become: those that become one character, in two equal strings, and those that become several.

    ``ascii`` decomposes and keeps ASCII only; ``text`` composes compatible forms and folds case.
    """
    one, several = [], []
    for i in chain(range(0x80, 0xD800), range(0xF900, 0x10000), range(0x1D400, 0x1D800)):
        c = chr(i)
        to = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() if fold == "ascii" else unicodedata.normalize("NFKC", c).casefold()
        if to == c or (fold == "ascii" and not to):
            continue
        if len(to) == 1:
            one.append((c, to))
        elif i < 0x10000:
            several.append((c, to))
    return "".join(c for c, _ in one), "".join(t for _, t in one), tuple(several)


def _folded(c: Column, fold: str) -> Column:
    """``c`` with other characters in their plain forms; plain ASCII is left as it is."""
    source, target, several = _forms(fold)
    # One literal, so that plans stay small.
    apart = F.str_to_map(F.lit("\x01".join("\x02".join(kv) for kv in several)), F.lit("\x01"), F.lit("\x02"))
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(F.octet_length(x) == 1, x).otherwise(F.coalesce(F.element_at(apart, x), x))), "")
    # Looked up by character, unlike a pattern of so many; most texts hold none of them.
    odd = F.length(F.translate(c, "".join(k for k, _ in several), "")) < F.length(c)
    return F.when(F.length(c) == F.octet_length(c), c).when(odd, F.translate(spelled, source, target)).otherwise(F.translate(c, source, target))


def words(c: Column) -> Column:
    """Runs of a-z and 0-9, accents and compatible forms folded, ``&`` read as ``and``; joined by one blank, NULL if there are none."""
    ascii_only = F.regexp_replace(_folded(c, "ascii"), r"[^\x00-\x7F]", "")
    spelled = F.replace(F.lower(ascii_only), F.lit("&"), F.lit(" and "))
    return F.nullif(F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " ")), F.lit(""))


def normalize_manufacturer(c: Column) -> Column:
    """A firm's words without parent-company remark and legal forms; NULL if nothing is left."""
    own = F.regexp_replace(strip(c), r"(?i),?\s+a\s+.+?\s+company\s*$", "")
    forms = "|".join(LEGAL_FORMS)
    return F.nullif(F.trim(F.regexp_replace(F.concat(F.lit(" "), words(own)), f"( ({forms}))+$", "")), F.lit(""))


def normalize_drug_name(c: Column) -> Column:
    return words(c)


def display_key(c: Column) -> Column:
    """Grouping key of a firm: its normal form, or its plain words where only legal forms stand."""
    return F.coalesce(normalize_manufacturer(c), words(c))


def normalize_application(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), F.lit(""))


def normalize_strength(c: Column) -> Column:
    return F.replace(words(c), F.lit(" "), F.lit(""))


def product_of_package(c: Column) -> Column:
    """The nine product digits of any usable code."""
    return F.substring(normalize_ndc(c), 1, 9)


def reason_text(c: Column) -> Column:
    """Compatible forms and case folded, single blanks; a fixed placeholder for NULL and blank.

    Accents that stand apart from their letters stay apart.
    """
    plain = F.lower(strip(F.regexp_replace(_folded(c, "text"), r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ")))
    return F.when(is_blank(c), REASON_MISSING).otherwise(plain)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and SHA-256 of the parts joined by the unit separator; NULL counts as empty."""
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256))


def short_hash(c: Column, digits: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def shortage_source_id() -> Column:
    """Package code and a hash of what else tells shortage entries apart."""
    parts = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in ("package_ndc", "initial_posting_date", "presentation", "company_name")])
    return F.concat(F.coalesce("package_ndc", F.lit("missing")), F.lit(":"), short_hash(parts, 10))


def recall_source_id() -> Column:
    """Recall number, or event and a hash where there is none."""
    parts = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in ("product_description", "recall_initiation_date")])
    return F.coalesce(F.nullif("recall_number", F.lit("")), F.concat(F.lit("event-"), F.coalesce("event_id", F.lit("missing")), F.lit("-"), short_hash(parts, 10)))


def shortage_incident_id() -> Column:
    """One incident a generic name, company and first posting; the record itself where all three are blank."""
    cols = [F.col(c) for c in ("generic_name", "company_name", "initial_posting_date")]
    named = stable_id("shortage_event", *[reason_text(c) for c in cols])
    blank = is_blank(cols[0]) & is_blank(cols[1]) & is_blank(cols[2])
    return F.when(blank, F.concat(F.lit("shortage_record:"), shortage_source_id())).otherwise(named)


def recall_incident_id() -> Column:
    event = F.trim(F.coalesce("event_id", F.lit("")))
    return F.when(event != "", F.concat(F.lit("recall_event:"), event)).otherwise(F.concat(F.lit("recall_record:"), recall_source_id()))


def context(fields: tuple[str, ...]) -> Column:
    """A record's own context as a map of its filled fields; blank counts as absent."""
    pairs = F.array(*[F.struct(F.lit(f).alias("k"), F.nullif(F.trim(F.col(f)), F.lit("")).alias("v")) for f in fields])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


# The fields that speak for a record of each feed.
CONTEXT_FIELDS = {
    "recalls": ("recall_number", "event_id", "classification", "status", "recalling_firm", "product_description", "recall_initiation_date"),
    "shortages": ("package_ndc", "generic_name", "company_name", "status", "availability", "related_info", "initial_posting_date"),
}


def resolve_as_of(explicit: str | None, snapshot: str | None, generated_at: str | None) -> str:
    """The day that ongoing shortages are counted to: stated, else the snapshot's, else the day the data was made.

    Never today: the same input gives the same result on any day.
    """
    for told in (explicit, (snapshot or "")[:10], (generated_at or "")[:10]):
        if told:
            return dt.date.fromisoformat(told).isoformat()
    raise ValueError("no day is stated and neither snapshot nor data tells one")


def feed_date(c: Column) -> Column:
    """A calendar date by the first of four formats that fits."""
    return F.coalesce(*[F.try_to_date(c, f) for f in ("M/d/yyyy", "yyyyMMdd", "yyyy-M-d", "M-d-yyyy")])


def missing(c: Column, kind: str) -> Column:
    """True for NULL, empty text and empty lists."""
    if kind.startswith("array") or kind.startswith("map"):
        return F.coalesce(F.size(c) == 0, F.lit(True))
    return F.coalesce(c == "", F.lit(True)) if kind == "string" else c.isNull()


# The same expressions for SQL engines with RE2 patterns, used by the oracle queries.


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def sql_ndc(c: str) -> str:
    code = rf"regexp_replace({sql_strip(c)}, '(?i)^NDC\s*[:#]?\s*', '')"
    part = lambda i: f"split_part({code}, '-', {i})"
    short = f"length({part(1)}) <= 5 and length({part(2)}) <= 4"
    return rf"""case when regexp_full_match({code}, '\d{{9}}|\d{{11}}') then {code}
      when regexp_full_match({code}, '\d+-\d+') and {short} then lpad({part(1)}, 5, '0') || lpad({part(2)}, 4, '0')
      when regexp_full_match({code}, '\d+-\d+-\d+') and {short} and length({part(3)}) <= 2 then lpad({part(1)}, 5, '0') || lpad({part(2)}, 4, '0') || lpad({part(3)}, 2, '0') end"""


def sql_words(c: str) -> str:
    return rf"nullif(trim(regexp_replace(replace(lower(regexp_replace(strip_accents({c}), '[^\x00-\x7F]', '', 'g')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '')"


def sql_manufacturer(c: str) -> str:
    own = rf"regexp_replace({sql_strip(c)}, '(?i),?\s+a\s+.+?\s+company\s*$', '')"
    return f"nullif(trim(regexp_replace(' ' || {sql_words(own)}, '( ({'|'.join(LEGAL_FORMS)}))+$', '')), '')"


def sql_reason(c: str) -> str:
    return rf"case when {c} is null or {sql_strip(c)} = '' then '{REASON_MISSING}' else lower(trim(regexp_replace({c}, '[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))) end"
