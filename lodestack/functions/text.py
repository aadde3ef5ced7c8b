"""Text functions as columns. Entities are decoded by an Arrow UDF; all else stays in the JVM.

Patterns carry (?U) so that letters, digits and word ends mean what they mean in Unicode; white
space also includes the four separators U+001C to U+001F.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions.arrow import row_by_row

# Lists and patterns that results depend on.
CURRENCY_CODES = ["usd", "eur", "gbp", "cad", "aud", "inr", "chf", "sek", "nok", "dkk", "pln", "ils", "brl", "jpy"]
CURRENCY_SYMBOLS = {"$": "USD", "£": "GBP", "€": "EUR", "₹": "INR"}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
EMPLOYMENT_TYPES = {
    "full-time": "full-time", "full time": "full-time", "fulltime": "full-time", "part-time": "part-time", "part time": "part-time",
    "contract": "contract", "contractor": "contract", "freelance": "contract", "internship": "internship", "intern": "internship", "temporary": "temporary",
}
INTERNSHIP = r"\b(intern|internship|co-?op|apprentice)\b"
REMOTE = r"\b(remote|work from home|wfh|distributed|anywhere|fully remote)\b"
TECH_TAGS = [
    "python", "django", "flask", "fastapi", "go", "golang", "rust", "java", "kotlin", "typescript", "javascript", "react", "node", "postgres",
    "postgresql", "kubernetes", "docker", "aws", "gcp", "terraform", "machine learning", "data engineering", "devops", "security", "mobile", "ios", "android",
]
TAG_SEPARATORS = [",", "|", ";", "·"]
REDACTED = "[redacted]"
PHONE_DIGITS = (7, 15)
DESCRIPTION_LIMIT = 4000

_SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Runs that are not a single plain space already.
_UNEVEN = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"
_SCRIPTS = re.compile(r"<(script|style)\b.*?</\1>", re.I | re.S)
#: Stands for a separator while entities are decoded: three private characters that no text holds in a row.
_MARK = "\ue000\uf8ff\ue000"


def unescape(c: Column) -> Column:
    """HTML entities of the full table become characters."""
    return _unescape(c)


_unescape = row_by_row(lambda t: html.unescape(t) if t is not None and "&" in t else t, T.StringType(), pa.string())


def normalise_ws(c: Column) -> Column:
    """Runs of white space become one space, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _UNEVEN, " "))


def let(c: Column, of) -> Column:
    """of(c) with c computed once, however often of() names it."""
    return F.element_at(F.transform(F.array(c), of), 1)


def _only(c: Column, test, change) -> Column:
    """change(c) where test(c), or where c holds the text test, without which there is nothing to change."""
    return let(c, lambda x: F.when(x.contains(test) if isinstance(test, str) else test(x), change(x)).otherwise(x))


def strip_scripts(c: Column) -> Column:
    return _only(c, "</", lambda x: F.regexp_replace(x, r"(?isU)<(script|style)\b.*?</\1>", " "))


def normalise_text(c: Column) -> Column:
    """Scripts and styles out, entities decoded, white space collapsed."""
    return normalise_ws(unescape(strip_scripts(F.coalesce(c, F.lit("")))))


def strip_tags(c: Column) -> Column:
    """Markup becomes text with line ends after blocks; entities stay."""
    c = strip_scripts(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, r"(?iU)</(p|div|li|tr|h[1-6]|br)\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?iU)<br\s*/?>", "\n")
    return F.regexp_replace(c, r"<[^>]+>", " ")


def lines_of(stripped: str) -> str:
    """Entities decoded, then each line without scripts, decoded again and with its white space collapsed; empty lines go."""
    cut = (_SCRIPTS.sub(" ", line) if "</" in line else line for line in html.unescape(stripped).splitlines())
    return "\n".join(clean for line in cut if (clean := " ".join(html.unescape(line).split())))


_lines = row_by_row(lines_of, T.StringType(), pa.string())


def html_to_text(c: Column) -> Column:
    """Readable lines of a fragment. Entities are decoded twice, per text and per line, by definition."""
    return _lines(strip_tags(c))


def truncate(c: Column, limit: int = DESCRIPTION_LIMIT) -> Column:
    """Texts beyond the limit end in an ellipsis that counts."""
    cut = F.regexp_replace(F.substring(c, 1, limit - 1), r"(?U)[\s\x1c-\x1f]+$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("…")))


# money ---------------------------------------------------------------------------------------

# Patterns of amounts and of what makes digits an amount.
_CODES = "|".join(CURRENCY_CODES)
MONEY = rf"(?iU)([$£€₹]|\b(?:{_CODES})\b)?\s*(\d{{1,3}}(?:[,\x{{00a0}} ]\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*([kKmM])?\b"
_HINT = (
    r"(?iU)\b(?:salary|comp(?:ensation)?|pay|rate|base|per year|per hour|/hour|/yr|per month)\b|[$£€₹]"
    rf"|\b(?:{_CODES})\b|\d\s*(?:-|–|—|\bto\b)\s*[\d$£€₹]"
)


def money_tokens(c: Column) -> Column:
    """All amounts of a text, in order."""
    text = F.coalesce(c, F.lit(""))
    numbers = F.regexp_extract_all(text, F.lit(MONEY), F.lit(2))
    units = F.regexp_extract_all(text, F.lit(MONEY), F.lit(3))

    def amount(n: Column, unit: Column) -> Column:
        times = F.when(F.lower(unit) == "k", 1000.0).when(F.lower(unit) == "m", 1000000.0).otherwise(1.0)
        return F.round(F.regexp_replace(n, r"[,\x{00a0} ]", "").try_cast("double") * times, 2)

    return F.filter(F.zip_with(numbers, units, amount), lambda x: x.isNotNull())


def parse_money(c: Column) -> Column:
    """The first amount, or null."""
    return F.try_element_at(money_tokens(c), F.lit(1))


def detect_currency(c: Column) -> Column:
    """ISO code: a code in the text, else by the first symbol in the order of CURRENCY_SYMBOLS."""
    code = F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?iU)\b({_CODES})\b", 1))
    found = F.when(code != "", code)
    for symbol, name in CURRENCY_SYMBOLS.items():
        found = found.when(c.contains(symbol), name)
    return found


def parse_salary(c: Column) -> Column:
    """struct(min, max, currency). Digits count only beside a currency, a salary word or a range."""
    currency, tokens = detect_currency(c), money_tokens(c)
    first, second = F.try_element_at(tokens, F.lit(1)), F.try_element_at(tokens, F.lit(2))
    second = F.coalesce(second, first)
    trusted = F.coalesce(currency.isNotNull() | c.rlike(_HINT), F.lit(False))
    return F.struct(
        F.when(trusted, F.least(first, second)).alias("min"), F.when(trusted, F.greatest(first, second)).alias("max"), F.when(trusted, currency).alias("currency")
    )


# dates ---------------------------------------------------------------------------------------

# The forms of dates, in the order in which they are tried.
_NAMES = "|".join([*MONTHS, *(m[:3] for m in MONTHS)])
ISO_DATE = r"(?U)\b(\d{4})-(\d{2})-(\d{2})\b"
MONTH_FIRST = rf"(?iU)\b({_NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b"
DAY_FIRST = rf"(?iU)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_NAMES})\.?,?\s+(\d{{4}})\b"
SLASHED = r"(?U)\b(\d{1,2})/(\d{1,2})/(\d{4})\b"


def _day(year: Column, month: Column, day: Column) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp(year.try_cast("int"), month.try_cast("int"), day.try_cast("int"), zero, zero, F.lit(0).cast("decimal(16,6)"))


def parse_date(c: Column) -> Column:
    """UTC timestamp of the first form that occurs: ISO day, month name first, day first, slashes, ISO with a time.

    The first form that matches decides; a day that does not exist is null. Slashes are month/day
    unless only day/month can be. A time without an offset is UTC.
    """
    text = F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    month = lambda name: F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    a, b = part(SLASHED, 1).try_cast("int"), part(SLASHED, 2).try_cast("int")
    swap = (a > 12) & (b <= 12)
    timed = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?([+-]\d{2}:?\d{2}|Z)?$"
    full = F.regexp_replace(F.regexp_replace(text, r"(T\d{2})(?![\d:])", "$1:00"), ",", ".")
    return (
        F.when(text.rlike(ISO_DATE), _day(part(ISO_DATE, 1), part(ISO_DATE, 2), part(ISO_DATE, 3)))
        .when(text.rlike(MONTH_FIRST), _day(part(MONTH_FIRST, 3), month(part(MONTH_FIRST, 1)), part(MONTH_FIRST, 2)))
        .when(text.rlike(DAY_FIRST), _day(part(DAY_FIRST, 3), month(part(DAY_FIRST, 2)), part(DAY_FIRST, 1)))
        .when(text.rlike(SLASHED), _day(part(SLASHED, 3), F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)))
        .when(text.rlike(timed), full.try_cast("timestamp"))
    )


def posted_from_epoch(seconds: Column, text: Column | None = None) -> Column:
    """Epoch seconds, else the date in text."""
    moment = F.timestamp_seconds(seconds)
    return moment if text is None else F.coalesce(moment, parse_date(text))


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number, or an HTTP date against now. Garbage is null."""
    text = F.trim(value)
    seconds = F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    when = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    return F.greatest(F.lit(0.0), F.coalesce(seconds, when.cast("double") - now.cast("double"))) + F.when(seconds.isNull() & when.isNull(), F.lit(None).cast("double")).otherwise(0.0)


# classification ------------------------------------------------------------------------------


def looks_remote(*texts: Column) -> Column:
    found = F.lit(False)
    for t in texts:
        found = found | F.coalesce(t.rlike("(?iU)" + REMOTE), F.lit(False))
    return found


def detect_employment_type(*texts: Column) -> Column:
    """Label of the first text that has one; needles are substrings, in the order of EMPLOYMENT_TYPES."""

    def of(t: Column) -> Column:
        low, found = F.lower(t), None
        for needle, label in EMPLOYMENT_TYPES.items():
            found = (F if found is None else found).when(low.contains(needle), label)
        return found.when(low.rlike("(?iU)" + INTERNSHIP), "internship")

    return F.coalesce(*[of(t) for t in texts])


def tech_tags(c: Column) -> Column:
    """Tags whose name is a substring of the text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*[F.lit(t) for t in TECH_TAGS]), lambda t: F.contains(low, t))


def is_hiring_thread(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    # What titles of such threads hold.
    return low.contains("who is hiring") | low.contains("who wants to be hired")


# Fixed value: what a comment says that offers nothing.
NOT_A_POSTING = r"\b(i'?m not hiring|we'?re not hiring|no longer hiring|not hiring|closed)\b"


def is_posting(c: Column) -> Column:
    return ~F.coalesce(c.rlike("(?iU)" + NOT_A_POSTING), F.lit(False))


# personal data -------------------------------------------------------------------------------

# What is redacted.
EMAIL = r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b"
PHONE = r"(?U)(?<![\w$+])\+?\d[\d\s()./-]{5,24}\d(?![\w])"


def redact_phones(c: Column) -> Column:
    """Digit runs that can be phone numbers: 7 to 15 digits and not an ISO day."""

    def redact(run: Column) -> Column:
        digits = F.length(F.regexp_replace(run, r"(?U)\D", ""))
        return F.when(digits.between(*PHONE_DIGITS) & ~F.trim(run).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.lit(REDACTED)).otherwise(run)

    def change(x: Column) -> Column:
        runs, between = F.regexp_extract_all(x, F.lit(PHONE), F.lit(0)), F.split(x, PHONE, -1)
        return F.array_join(F.zip_with(between, F.transform(runs, redact), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return _only(c, lambda x: x.rlike(r"(?U)\d[\d\s()./-]{5,24}\d"), change)


def redact_emails(c: Column) -> Column:
    return _only(c, "@", lambda x: F.regexp_replace(x, EMAIL, REDACTED))


def scrub_pii(c: Column) -> Column:
    """Addresses, phone numbers and long numbers redacted, queries of urls dropped; then normalise_text, which joins lines."""
    c = redact_phones(redact_emails(F.coalesce(c, F.lit(""))))
    c = _only(c, lambda x: x.rlike(r"(?U)\d{9}"), lambda x: F.regexp_replace(x, r"(?U)\b\d{9,}\b", REDACTED))
    c = _only(c, "://", lambda x: F.regexp_replace(x, r"(?U)\b(https?://[^\s?]+)\?\S*", "$1"))
    return normalise_text(c)


# arrays --------------------------------------------------------------------------------------


def split_tags(c: Column, separators: list[str] | None = None) -> Column:
    """Parts between separators, normalised, empties dropped."""
    seps = TAG_SEPARATORS if separators is None else separators
    text = F.coalesce(c, F.lit(""))
    parts = F.array_join(F.split(text, "|".join(re.escape(s) for s in seps)), _MARK) if seps else text
    return F.filter(F.transform(F.split(unescape(strip_scripts(parts)), _MARK), normalise_ws), lambda x: x != "")


def collect_tags(values: Column, separators: list[str] | None = None) -> Column:
    """The tags of all values of an array, in order."""
    seps = TAG_SEPARATORS if separators is None else separators
    return split_tags(F.array_join(values, seps[0] if seps else "\n"), seps or ["\n"])


def clean_tags(tags: Column) -> Column:
    """Trimmed, without empties, first occurrences only."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), normalise_ws), lambda x: x != ""))


def with_remote_tag(tags: Column, remote: Column) -> Column:
    """Append the tag remote to remote items that lack it in any case."""
    return F.when(remote & ~F.exists(tags, lambda t: F.lower(t) == "remote"), F.array_append(tags, F.lit("remote"))).otherwise(tags)


def search_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits; no stemming, no stop words."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
