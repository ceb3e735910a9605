"""Column functions over plain text: whitespace, snippets, labels, markers."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import vocab

# Characters that count as white space in the data contract (Unicode white space plus the
# four ASCII information separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\x1c-\x1f]"  # only under the (?U) flag


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and evaluate ``body`` over it.

    A column that is mentioned inside a lambda is otherwise recomputed for every element,
    because the optimizer inlines projections into the lambda body.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(key: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """Constant-table lookup as a CASE expression (stays inside generated code)."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(default)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def blank_to_null(text: Column) -> Column:
    return F.when(~is_blank(text), text)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def collapse_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"(?U){WS}+", " "))


def normalise_text(text: Column) -> Column:
    """Drop one leading byte-order mark, unify line ends, squeeze runs of blank lines."""
    no_bom = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\x{FEFF}", "")
    unix = F.regexp_replace(no_bom, r"\r\n?", "\n")
    return F.regexp_replace(unix, r"\n{3,}", "\n\n")


def shorten(text: Column, max_chars: int) -> Column:
    """Cut at ``max_chars`` with an ellipsis as the last character."""
    return F.when(
        F.length(text) > max_chars, F.concat(F.left(text, F.lit(max_chars - 1)), F.lit("…"))
    ).otherwise(text)


def snippet(text: Column, max_chars: int = vocab.PROMPT_SNIPPET_CHARS) -> Column:
    """One-line excerpt: white space collapsed, then shortened."""
    return shorten(collapse_whitespace(text), max_chars)


def humanise(code: Column) -> Column:
    """``impact_pathway`` becomes ``Impact Pathway``."""
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def page_note(page: Column) -> Column:
    return F.coalesce(F.concat(F.lit("p. "), page.cast("string")), F.lit("p. n/a"))


def section_or_na(heading: Column) -> Column:
    return F.coalesce(empty_to_null(heading), F.lit("n/a"))


def title_or_untitled(title: Column) -> Column:
    return F.coalesce(empty_to_null(title), F.lit("untitled"))


def escape_pipes(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def citation_markers(text: Column, max_digits: int | None = None) -> Column:
    """Digits of every ``[N]`` in order, as canonical digit strings (``[007]`` gives ``7``).

    Strings rather than numbers: an unbounded marker may exceed every numeric type.
    """
    digits = r"\d+" if max_digits is None else r"\d{1,%d}" % max_digits
    found = F.regexp_extract_all(text, F.lit(r"\[(%s)\]" % digits), F.lit(1))
    return F.transform(found, lambda d: F.regexp_replace(d, r"^0+(?=\d)", ""))


def infer_section_type(heading: Column) -> Column:
    """Ordered substring rules over a lower-cased heading; no hit means ``other``."""
    lowered = F.lower(F.coalesce(heading, F.lit("")))
    rules = iter(vocab.SECTION_TYPE_RULES)
    needle, section = next(rules)
    out = F.when(lowered.contains(needle), section)
    for needle, section in rules:
        out = out.when(lowered.contains(needle), section)
    return out.otherwise("other")


def iso_utc(moment: Column) -> Column:
    """ISO 8601 text of a timestamp in UTC, whatever the session's time zone; microseconds if there are any."""
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    micros = F.unix_micros(moment) % 1_000_000
    fraction = F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0")))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))
