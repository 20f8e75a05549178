r"""Text expressions, all on the JVM side.

Character classes are ASCII unless said otherwise; Java's ``\w`` and ``\s`` are.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import bound

# The usual English list of words without content, as results depend on it.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when where why how all any
    both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re
    ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn""".split()
)


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " "))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


# The patterns of the cleaning steps, whose results are to be matched.
TAG = r"<[^>]+>"
ADDRESS = r"(?i)(?:https?://|ftp://|www\.)\S+"
MAIL = r"\b[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}\b"
HANDLE = r"[@#]\w+"
UNPRINTABLE = r"[^\x20-\x7E\n\t]"
MARKS = r"([!?.]){2,}"
#: Java's name for Unicode-aware classes and word boundaries.
UNICODE = "(?U)"


def clean_markup(c: Column) -> Column:
    """Tags, addresses, mail addresses, handles and hashtags taken out; null reads as empty."""
    c = strip_tags(F.coalesce(c, F.lit("")))
    for pattern in (ADDRESS, MAIL, HANDLE):
        c = F.regexp_replace(c, UNICODE + pattern, " ")
    return c


def clean_marks(c: Column, lower: bool = True) -> Column:
    """What isn't printable ASCII taken out, runs of marks cut to their last, white space collapsed."""
    c = squeeze(F.regexp_replace(F.regexp_replace(c, UNPRINTABLE, " "), MARKS, "$1"))
    return F.lower(c) if lower else c


def clean(c: Column, lower: bool = True) -> Column:
    """All steps of ``clean_full`` that Spark has functions for; the same where a text has neither entities nor compatibility forms."""
    return clean_marks(clean_markup(c), lower)


@F.pandas_udf(T.StringType())
def unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """HTML entities resolved, which Spark has no function for."""
    for s in batches:
        yield s.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility forms folded."""
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def strip_accents(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def clean_full(c: Column, lower: bool = True) -> Column:
    """Entities first, then markup, compatibility forms, and marks; only texts with an ampersand or beyond ASCII go to Python."""
    c = F.coalesce(c, F.lit(""))
    c = clean_markup(F.when(c.contains("&"), unescape(c)).otherwise(c))
    return clean_marks(F.when(F.octet_length(c) > F.length(c), nfkc(c)).otherwise(c), lower)


def clean_code(c: Column) -> Column:
    """Fenced, then inline code that isn't empty, replaced by a blank."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?```", " "), "`[^`]+`", " "))


def words(c: Column) -> Column:
    """Parts between white space; none for a blank text."""
    return F.filter(F.split(squeeze(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")


def tokens(c: Column, pattern: str = "[A-Za-z0-9_][A-Za-z0-9_]+") -> Column:
    """Lower-cased matches of a token pattern."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


def nlp_tokens(c: Column) -> Column:
    """Tags and addresses out, folded, lower-cased, split, without stop words and tokens of up to two characters; unstemmed."""
    c = F.regexp_replace(strip_tags(F.coalesce(c, F.lit(""))), r"(?U)https?://\S+", " ")
    c = F.lower(F.when(F.octet_length(c) > F.length(c), nfkc(c)).otherwise(c))
    c = F.regexp_replace(c, r"[^a-z0-9 \t\n\x0B\f\r]", " ")
    return F.filter(words(c), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def _run(items: Column, n: int, between: str):
    """The ``n`` elements from a position on; got one by one, since a slice would go through the whole array."""
    return lambda i: F.concat_ws(between, *(F.get(items, i + j) for j in range(n)))


def _runs(items: Column, low: int, high: int, between: str) -> Column:
    parts = []
    for n in range(low, high + 1):
        at = F.when(F.size(items) >= n, F.sequence(F.lit(0), F.size(items) - n)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(at, _run(items, n, between)))
    return F.flatten(F.array(*parts))


def ngrams(arr: Column, low: int, high: int) -> Column:
    """Token n-grams of the orders low to high, joined by blanks."""
    return bound(arr, lambda a: _runs(a, low, high, " "))


def char_ngrams(c: Column, low: int, high: int) -> Column:
    """Character n-grams of the orders low to high; the text is parted once, so long texts take time in proportion."""
    letters = F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
    return bound(letters, lambda a: _runs(a, low, high, ""))


def quality_ok(c: Column, diversity: float = 0.05, digits: float = 0.5, least_words: int = 20) -> Column:
    """Enough distinct characters, few digits, more than ``least_words`` words."""
    n = F.length(c)
    distinct = F.size(F.array_distinct(F.split(c, "")))
    digit = n - F.length(F.regexp_replace(c, "[0-9]", ""))
    return F.when(n > 0, (distinct / n > diversity) & (digit / n < digits) & (F.size(words(c)) > least_words)).otherwise(False)


def slug(c: Column, most: int = 200, default: str = "unknown") -> Column:
    """A name that file systems take."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9_.\-]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(s == "", default).otherwise(F.coalesce(s, F.lit(default))), 1, most)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def top_segment(c: Column) -> Column:
    first = F.split_part(c, F.lit("/"), F.lit(1))
    return F.when(first == ".", "_root").otherwise(first)


def tex_escape(c: Column) -> Column:
    """TeX specials escaped; a backslash becomes a slash."""
    c = F.replace(c, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(c, r"([#_%&])", r"\\$1")


def fixed_or_dash(c: Column, digits: int = 4, dash: str = "---") -> Column:
    return F.when(c.isNull(), dash).otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def skip_line(c: Column) -> Column:
    """Lines that dedup leaves alone: short ones, table rows, captions, short numbered items."""
    t = F.trim(c)
    caption = t.rlike(r"^(?i:figure|table) ?[0-9]+")
    item = t.rlike(r"^[0-9]+[.)]") & (F.length(t) < 40)
    return (F.length(t) < 22) | t.startswith("|") | caption | item


def line_key(c: Column) -> Column:
    """A line by its words: white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def trimmed(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_footer(c: Column, date: str = r"^[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}$") -> Column:
    """Whether a line is a page number of one or two digits or a written date."""
    t = F.trim(c)
    return t.rlike(r"^[0-9]{1,2}$") | t.rlike(date)


def page_bodies(c: Column) -> Column:
    """The body lines of pages: for each chunk after a page header, what lies between its first image line and its last rule.

    Blank lines, headers, images and rules aren't body lines; a chunk without an image has none.
    """
    chunks = F.slice(F.split(c, r"## Page [0-9]+[ \t]*\n"), 2, 1_000_000)

    image = r"(?s)^.*?!\[[^\]]*\]\([^)]+\)[ \t]*\n"
    with_image = F.filter(chunks, lambda x: x.rlike(r"!\[[^\]]*\]\([^)]+\)[ \t]*\n"))
    bodies = F.transform(with_image, lambda x: F.regexp_replace(F.regexp_replace(x, image, ""), r"(?s)\n---(?!.*\n---).*$", ""))
    return F.filter(F.flatten(F.transform(bodies, lambda x: F.split(x, "\n"))), lambda line: (F.trim(line) != "") & ~line.rlike(r"^(## Page [0-9]+\s*$|!\[|---\s*$)"))
