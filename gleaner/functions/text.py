"""Text functions as column expressions: tokens, estimates, sentences, Markdown and HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that tokenisation leaves out.
STOP_WORDS = (
    "a an the and or but if then else of to in on at by for with about against between into through during before after "
    "above below from up down out off over under again further once here there all any both each few more most other some "
    "such no nor not only own same so than too very can will just should now is are was were be been being have has had do "
    "does did this that these those it its as i you he she they we what which who whom"
).split()

TOKEN = "[a-z0-9]+"


def raw_tokens(text: Column | str) -> Column:
    """All runs of lower-case ASCII letters and digits; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def keeps(token: Column) -> Column:
    """Tokens that count: two characters and more, no stop word (a hash lookup)."""
    return (F.length(token) > 1) & ~token.isin(*STOP_WORDS)


def tokens(text: Column | str) -> Column:
    return F.filter(raw_tokens(text), keeps)


def estimate_tokens(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def strip(text: Column | str) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column | str) -> Column:
    """The parts between white space that follows a full stop, an exclamation or a question mark."""
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of distinct elements; 0 where one is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0))


# --- Markdown -----------------------------------------------------------------------------------------------------

_FRONT = r"^---([\s\S]*?)\n---"


def front_matter_block(text: Column | str) -> Column:
    """The lines between a leading ``---`` and the next; empty where there are none."""
    return F.regexp_extract(text, _FRONT, 1)


def front_matter(text: Column | str) -> Column:
    """Flat ``key: value`` lines of the front matter as a map; comments and lines without a colon are skipped, quotes at
    the ends of values stripped, and of a repeated key the last value counts."""
    lines = F.filter(F.split(front_matter_block(text), "\n"), lambda x: F.contains(x, F.lit(":")) & ~F.startswith(F.ltrim(x), F.lit("#")))
    def pair(x: Column) -> Column:
        value = F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"']+|[\"']+$", "")
        return F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), value.alias("value"))

    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda p, i: (p["key"] != "") & ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def body(text: Column | str) -> Column:
    """What follows the front matter, without leading white space; the text itself where there is none."""
    return F.regexp_replace(text, r"(?U)" + _FRONT + r"\s*", "")


def headings(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?md)^#{1,6}\s+(.*)$"), F.lit(1)), lambda x: F.trim(x))


# --- HTML ---------------------------------------------------------------------------------------------------------


def html_title(html: Column | str) -> Column:
    """The collapsed content of the title element; null where there is none or it is blank."""
    t = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.when(t != "", t)


def html_text(html: Column | str) -> Column:
    """Text without scripts, styles and tags, with two entities decoded and white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    t = F.replace(F.regexp_replace(t, "&nbsp;?", " "), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(t, r"\s+", " "))
