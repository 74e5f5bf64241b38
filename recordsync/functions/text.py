"""Words, escapes and text pieces as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and the Latin-1 letters; other characters part words.
WORD = "[a-z0-9À-ÿ]+"


def word_set(text: Column, mode: str = "unicode", ordered: bool = True) -> Column:
    """Set of the lower-cased words of a text, sorted if ``ordered``; null for null.

    mode: ``unicode`` reads characters; ``latin1_bytes`` reads the UTF-8 bytes as Latin-1 characters,
    as byte-oriented indexes do, which cuts words at continuation bytes.
    """
    if mode == "latin1_bytes":
        text = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    elif mode != "unicode":
        raise ValueError(f"no such mode: {mode}")
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    return F.array_sort(words) if ordered else words


def strip(text: Column) -> Column:
    """Text without blanks, tabs and line ends around it."""
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def decomment(text: Column) -> Column:
    """What stands before the first ``#``."""
    return F.substring_index(text, "#", 1)


def split_once(text: Column, mark: str) -> Column:
    """Struct of what stands before the first ``mark`` and after it; after is null without one."""
    at = F.instr(text, mark)
    return F.struct(
        F.when(at > 0, F.substring_index(text, mark, 1)).otherwise(text).alias("before"),
        F.when(at > 0, F.substr(text, at + len(mark))).alias("after"),
    )


def split_list(text: Column) -> Column:
    """Parts of a list that commas or blanks separate, without empty ones."""
    return F.filter(F.split(text, r"[, \t\r\n]+"), lambda x: x != "")


def escape_field(text: Column) -> Column:
    """Text safe inside a colon-separated line: ``%`` doubled, ``:`` and bytes from 128 as %HH."""
    ascii_only = F.replace(F.replace(text, F.lit("%"), F.lit("%%")), F.lit(":"), F.lit("%3A"))
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    by_byte = F.transform(
        pairs,
        lambda p: F.when(p == "25", F.lit("%%")).when((p == "3A") | (p >= "80"), F.concat(F.lit("%"), p)).otherwise(F.decode(F.unhex(p), "ISO-8859-1")),
    )
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), ascii_only).otherwise(F.array_join(by_byte, ""))


def html_quote(text: Column) -> Column:
    """Text with ``& < > " ' /`` as entities."""
    # Entities.
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def url_options(url: Column) -> Column:
    """The query string as a map of decoded names to values; of repeated names the last counts.

    The session needs no ``mapKeyDedupPolicy``: repeats are resolved here.
    """
    query = F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit(""))
    parts = F.filter(F.split(query, "&"), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.instr(p, "=") + 1).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"])
    return F.map_from_arrays(names, F.transform(last, lambda v: F.url_decode(v)))


def url_encode(text: Column) -> Column:
    """Text for a query string: blanks as ``+``; ``= & " + `` and line ends as %HH; all else as it is."""
    # Escaped marks, the plus first since blanks become one.
    for mark, code in (("+", "%2B"), ("=", "%3D"), ("&", "%26"), ('"', "%22"), ("\r", "%0D"), ("\n", "%0A"), (" ", "+")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text
