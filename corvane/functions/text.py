"""Text rules as columns. White space, words and lower-casing follow Unicode."""

from __future__ import annotations

import html
import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space and the four information separators.
WHITE = r"(?U)[\s\x1c-\x1f]+"
#: Line ends: the usual ones, and form feeds and separators as journal pages have them.
LINES = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
#: What a word is made of, for whole-word terms.
WORDISH = r"[\p{L}\p{N}_]"


@F.arrow_udf(T.StringType())
def decode_references(text: pa.Array) -> pa.Array:
    """HTML character references decoded; the one text rule that no built-in has."""
    held = pc.fill_null(pc.match_substring(text, "&"), False)
    if not pc.any(held).as_py():
        return text
    return pc.replace_with_mask(text, held, pa.array([html.unescape(x) for x in text.filter(held).to_pylist()], text.type))


def squeeze(c: Column) -> Column:
    """Null as empty, white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WHITE, " "))


def clean_text(c: Column) -> Column:
    """squeeze, after character references are decoded."""
    return squeeze(decode_references(c))


def _clean_items(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, squeeze), lambda x: x != ""))


def clean_list(c: Column) -> Column:
    """Each value cleaned, empty ones dropped, of equal ones the first kept. Null is an empty list.

    Values cross to the decoder joined by a separator that no value holds.
    """
    gap = "\x1e\x1f"
    joined = F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit(""))), gap)
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, _clean_items(F.split(decode_references(joined), gap, -1))).otherwise(F.array().cast("array<string>"))


def norm_date(c: Column) -> Column:
    """YYYY-MM-DD or YYYYMMDD as the former, anything else cleaned; days are not checked against a calendar."""
    return F.regexp_replace(clean_text(c), r"^(\d{4})-?(\d{2})-?(\d{2})\z", "$1-$2-$3")


def day_first_date(c: Column) -> Column:
    """dd/mm/yyyy as ISO, anything else empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}\z"), F.regexp_replace(c, r"^(\d{2})/(\d{2})/(\d{4})\z", "$3-$2-$1")).otherwise("")


def application_number(c: Column) -> Column:
    """Cleaned, upper case, without spaces; null and empty stay."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.upper(F.replace(clean_text(c), F.lit(" "), F.lit("")))).otherwise(c)


def patent_key(appl_no: Column) -> Column:
    """What one application's numbers share across sources: letters and digits, without the publication-stage code.

    The code, a letter and perhaps a digit at the end, goes only where at least
    eight characters that end in a digit stand before it. Null where nothing is left.
    """
    raw = F.regexp_replace(F.upper(squeeze(appl_no)), "[^A-Z0-9]", "")
    stem = F.regexp_extract(raw, r"^(.*\d)[A-Z]\d?\z", 1)
    return F.nullif(F.when(F.length(stem) >= 8, stem).otherwise(raw), F.lit(""))


def record_id(appl_no: Column, source_id: Column, source_url: Column) -> Column:
    """The application number, or the source and ten hex digits of SHA-1 over source and address."""
    none = F.lit("None")
    digest = F.substring(F.sha1(F.concat_ws("|", F.coalesce(source_id, none), F.coalesce(source_url, none))), 1, 10)
    return F.coalesce(F.nullif(squeeze(appl_no), F.lit("")), F.concat_ws("-", F.coalesce(source_id, F.lit("src")), digest))


def tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order, repeats included; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def query_tokens(q: str | None) -> list[str]:
    """tokens of a query that is known when the plan is built."""
    return re.findall("[a-z0-9]+", (q or "").lower())


def org_form(c: Column) -> Column:
    """An organisation's name for comparison: lower case, nine punctuation characters as spaces, squeezed."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"""[.,()"'&/\\-]""", " "))


def file_slug(journal_no: Column, label: Column) -> Column:
    """A file-safe name of a journal part."""
    safe = F.regexp_replace(label, "[^A-Za-z0-9]+", "-")
    return F.concat(F.replace(journal_no, F.lit("/"), F.lit("-")), F.lit("_"), F.regexp_replace(safe, "^-+|-+$", ""))


def strip_tags(c: Column) -> Column:
    """Tags as spaces, then clean_text."""
    return clean_text(F.regexp_replace(c, "<[^>]+>", " "))


def whole_word(term: str) -> str:
    """A pattern for a term that no letter, digit or underscore adjoins, in any Unicode script."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", term)
    before = rf"(?<!{WORDISH})" if re.match(r"\w", term) else rf"(?<={WORDISH})"
    after = rf"(?!{WORDISH})" if re.search(r"\w\Z", term) else rf"(?={WORDISH})"
    return before + quoted + after


def terms_pattern(words: list[str], parts: list[str]) -> str | None:
    """One alternation for whole-word terms and substring terms, or null where there are none."""
    quoted = [re.sub(r"([^\w\s])", r"\\\1", p) for p in sorted(parts)]
    every = [whole_word(w) for w in sorted(words)] + quoted
    return "|".join(every) or None


def first_text(items: Column, language: str | None = None, field: str = "text", language_field: str = "language") -> Column:
    """The text of the first item, or of the first in a language; empty where there is none."""
    if language:
        items = F.filter(items, lambda x: x[language_field] == language)
        return F.get(items, F.lit(0))[field]
    return clean_text(F.get(items, F.lit(0))[field])


def preferred_text(items: Column, language: str = "en", field: str = "text", language_field: str = "lang") -> Column:
    """The first text in a language, else the first of any, else empty."""
    own = F.get(F.filter(items, lambda x: x[language_field] == language), F.lit(0))[field]
    return F.coalesce(own, F.get(items, F.lit(0))[field], F.lit(""))


def filled(c: Column, kind: str) -> Column:
    """Whether a value counts as present: a text that is not empty, or a list that has items."""
    return F.coalesce(F.size(c) > 0, F.lit(False)) if kind.startswith("array") else F.coalesce(c.cast("string") != "", F.lit(False))


@F.pandas_udf(T.StringType())
def two_decimals(n: pd.Series) -> pd.Series:
    """A double's exact value with two decimals, ties to even, as C prints it. Java's formatter rounds half up, and its shortest digits rather than its value."""
    return n.map("{:.2f}".format)


def human_size(n: Column) -> Column:
    """Bytes in binary GB, two decimals; null stays."""
    return F.when(n.isNotNull(), F.concat(two_decimals(n / float(1 << 30)), F.lit(" GB")))
