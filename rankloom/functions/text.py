"""Text functions as column expressions: they stay in the JVM and inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern and the stop words of the keyword rewrite.
TOKEN_PATTERN = "[a-z0-9_][a-z0-9_./:+#-]*|[一-鿿]"
STOPWORDS = (
    "a about according after all an and are as at be before by can company did do does during for from has have how i "
    "in into is it its me new of on or our should stated that the their they this to was we were what when where which "
    "who why with"
).split()

WORD_PATTERN = r"[\p{L}\p{N}]+"


def clean_text(text: Column) -> Column:
    """Null becomes empty; line ends become LF; runs of blanks become one; three or more line ends become two; the ends lose
    every character up to U+0020."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r", "\n")
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\n\x0b\f\r]+", " "), r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def tokens(text: Column) -> Column:
    """The project's tokens in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))


def token_count(text: Column) -> Column:
    """The number of tokens as bigint; 0 for null."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(TOKEN_PATTERN)), F.lit(0)).cast("bigint")


def words(text: Column) -> Column:
    """Longest runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD_PATTERN})"), F.lit(1))


def keyword_query(text: Column) -> Column:
    """Keep the tokens that carry meaning: stop words go, and single characters unless they are digits or Han.
    Blank or null gives an empty text; where nothing is left the text itself with single blanks."""
    plain = collapse_blanks(F.coalesce(text, F.lit("")))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    kept = F.filter(
        tokens(plain),
        lambda t: ~F.array_contains(stop, t) & ((F.length(t) > 1) | t.rlike("^[0-9一-鿿]$")),
    )
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(plain)


def is_distinct_variant(original: Column, rewritten: Column) -> Column:
    """Whether a rewrite differs from the original by more than case and blanks; false for null or blank."""
    known = original.isNotNull() & rewritten.isNotNull() & (F.trim(F.coalesce(rewritten, F.lit(""))) != "")
    return F.coalesce(known & (F.lower(collapse_blanks(original)) != F.lower(rewritten)), F.lit(False))


def normal_id(value: Column) -> Column:
    """Ids and source names compare without surrounding blanks and without regard to case."""
    return F.lower(F.trim(value))
