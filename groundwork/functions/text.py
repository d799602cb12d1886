"""Text expressions. Everything here is a JVM-side column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern, question stop list, sentence boundary, heading and URL forms.
TOKEN = "[a-z0-9]+"
STOP_WORDS = (
    "the a an of to in on for and or is are what which how who when where does do did was were be "
    "with that this it as by at from our we you i can will should must may"
).split()
SENTENCE_BREAK = r"(?<=[.!?])\s+"
URL = r"https?://\S+"


def tokens(c: Column | str) -> Column:
    """Lower-cased ``[a-z0-9]+`` runs, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def content_tokens(c: Column | str) -> Column:
    """Distinct tokens outside the stop list."""
    return F.array_except(F.array_distinct(tokens(c)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def query_tokens(c: Column | str) -> Column:
    """Tokens outside the stop list, repeats kept."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(tokens(c), lambda t: ~F.array_contains(stop, t))


def words(c: Column | str) -> Column:
    """Whitespace-separated words of the trimmed text, none when blank."""
    t = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\s+|\s+$", "")
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def sentences(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    parts = F.transform(
        F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), SENTENCE_BREAK),
        lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""),
    )
    return F.filter(parts, lambda s: s != "")


def paragraphs(c: Column | str, delimiter: str = r"\n\s*\n") -> Column:
    """Trimmed non-empty pieces. The delimiter is a regex; the default is a blank line."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.transform(F.split(c, delimiter), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def abstract(c: Column | str) -> Column:
    """First sentence, or the first 120 characters."""
    return _lead(c, 1, 120)


def overview(c: Column | str) -> Column:
    """First two sentences, or the first 280 characters."""
    return _lead(c, 2, 280)


def _lead(c: Column | str, n: int, fallback: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    got = F.array_join(F.slice(F.split(t, SENTENCE_BREAK), 1, n), " ")
    return F.when(got != "", got).otherwise(F.substring(c, 1, fallback))


def collapse(c: Column | str) -> Column:
    """Runs of whitespace to one blank, ends trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal_question(c: Column | str) -> Column:
    """Question key form: lower case, only letters, digits and single blanks."""
    c = F.col(c) if isinstance(c, str) else c
    low = F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(low, r"\s+", " "))


def repeat_key_text(c: Column | str) -> Column:
    """Form under which a repeated question meets its earlier answer."""
    return F.lower(collapse(c))


def is_heading(c: Column) -> Column:
    """Section labels, list headers and URL lines, as opposed to prose sentences."""
    low = F.lower(c)
    return (
        (F.length(c) < 25)
        | low.contains("http")
        | c.contains("://")
        | c.endswith(":")
        | (~F.substring(c, -1, 1).isin(".", "!", "?") & (F.size(F.split(c, r"\s+")) <= 6))
    )


def clean_sentence(c: Column) -> Column:
    """Strip inline URLs and a leading section label, collapse double blanks."""
    s = F.trim(F.regexp_replace(c, URL, ""))
    s = F.trim(F.regexp_replace(s, r"^[A-Z][A-Za-z0-9 .&/'’-]{0,40}:\s+", ""))
    return F.regexp_replace(s, r"\s{2,}", " ")


def token_count(c: Column | str) -> Column:
    """Words times 1.3, rounded half-even, at least one."""
    return F.greatest(F.lit(1), F.bround(F.size(words(c)) * F.lit(1.3), 0).cast("long"))


def half_even(c: Column, places: int) -> Column:
    """Half-even rounding, the rounding of the reported metrics."""
    return F.bround(c, places)
