"""Text functions as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four ASCII separators; Java's ``\s`` lacks several of them.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]+"
#: The same class for RE2, in SQL twins.
SPACE_RE2 = r"[\s\x{0b}\x{85}\x{a0}\x{1c}-\x{1f}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: What full case folding makes of characters that lower-casing leaves.
FOLDS = {"ß": "ss", "ẞ": "ss", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ŉ": "ʼn", "ǰ": "ǰ", "ẖ": "ẖ", "ẗ": "ẗ", "ẘ": "ẘ", "ẙ": "ẙ", "ẚ": "aʾ"}
#: Words that stay small inside a title.
SMALL_WORDS = "a an and as at but by for from in into nor of on onto or over the to up with".split()


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truthy(x: Column | str) -> Column:
    """A string that is neither null nor empty."""
    return F.coalesce(c(x) != "", F.lit(False))


def first_truthy(*xs: Column | str) -> Column:
    return F.coalesce(*(F.nullif(c(x), F.lit("")) for x in xs), F.lit(""))


def squeeze(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(c(x), SPACE, " "))


def casefold(x: Column | str) -> Column:
    out = c(x)
    for a, b in FOLDS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.lower(out)


def fold(x: Column | str) -> Column:
    """Identity of a tag: case-folded letters and digits only."""
    return F.regexp_replace(casefold(x), "[^a-z0-9]+", "")


def word_fold(x: Column | str) -> Column:
    """Identity in the ledger: lower case, single spaces."""
    return F.lower(squeeze(x))


def loose_tag(x: Column | str) -> Column:
    """Identity of a reply: exotic spaces are spaces."""
    return F.lower(F.trim(F.regexp_replace(F.translate(c(x), "   ", "   "), r"\s+", " ")))


def plain_ascii(x: Column | str) -> Column:
    """The ASCII that compatibility decomposition leaves. Only texts with other characters go through Python."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())

    t = c(x)
    odd = t.rlike(r"[^\x00-\x7f]")
    return F.when(odd, F.pandas_udf(run, "string")(F.when(odd, t))).otherwise(t)


def slug(x: Column | str, apostrophe: str = "") -> Column:
    """URL name of a text; ``apostrophe`` replaces quotes inside words."""
    dashed = F.regexp_replace(F.regexp_replace(plain_ascii(x), "['`]", apostrophe), "[^A-Za-z0-9]+", "-")
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(dashed, "^-+|-+$", "")), F.lit("")), F.lit("untitled"))


def squash(x: Column | str) -> Column:
    """Comparison form: ASCII, lower case, words apart by single spaces."""
    return F.trim(F.regexp_replace(F.lower(plain_ascii(x)), "[^a-z0-9_]+", " "))


def strip_controls(x: Column | str) -> Column:
    return F.regexp_replace(F.translate(c(x), "\t\r\n", "   "), r"[\x00-\x1f\x7f\u0080-\u009f]", "")


def prose(x: Column | str) -> Column:
    """HTML to running text; bodies of scripts stay."""
    return squeeze(F.regexp_replace(c(x), "<[^>]+>", " "))


def stem_of(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(c(x), "([^/]*)$", 1), r"\.[^.]*$", "")


def base_of(stem: Column | str) -> Column:
    return F.regexp_replace(c(stem), "-[0-9]+$", "")


def timecode(seconds: Column | str) -> Column:
    s = F.greatest(F.floor(c(seconds)), F.lit(0)).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)


def seconds_of(stamp: Column | str) -> Column:
    """Up to three digit groups of a stamp, read in base 60."""
    groups = F.slice(F.regexp_extract_all(c(stamp), F.lit(r"(\d+)"), 1), 1, 3)
    return F.aggregate(F.transform(groups, lambda g: g.cast("long")), F.lit(0).cast("long"), lambda a, g: a * 60 + g)


def clean_quote(x: Column | str) -> Column:
    return squeeze(F.regexp_replace(c(x), r"\[?\d+:\d\d(:\d\d)?\]?", " "))


def _chunks(piece: Column, most: int, full: int) -> Column:
    """A piece of more than ``most`` characters in runs of words that pass ``full``."""
    words = F.filter(F.split(piece, SPACE), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def add(state: Column, word: Column) -> Column:
        line = F.when(state["open"] == "", word).otherwise(F.concat(state["open"], F.lit(" "), word))
        n = state["n"] + F.length(word) + 1
        return F.when(n > full, F.struct(F.concat(state["done"], F.array(line)).alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))).otherwise(F.struct(state["done"].alias("done"), line.alias("open"), n.alias("n")))

    end = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
    return F.when(F.length(piece) > most, F.aggregate(words, start, add, end)).otherwise(F.array(piece))


def sentences(x: Column | str, most: int = 320, full: int = 240) -> Column:
    """Sentences of a text: terminator, closers, white space, then a capital or digit; those over ``most`` characters in chunks."""
    marked = F.regexp_replace(c(x), r"(\.\.[.!?])\s+|([.!?])[\"')\]]*\s+([\"'(\[]*[A-Z0-9])", "$1$2\u0001$3")
    whole = F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")  # bare F.trim would get the place too, as characters to trim
    return F.flatten(F.transform(whole, lambda s: _chunks(s, most, full)))


def numbered(pieces: Column | str, name: Callable[[Column], Column], text: Callable[[Column], Column]) -> Column:
    """Lines of a transcript, each with its id in brackets."""
    return F.transform(c(pieces), lambda p: F.concat(F.lit("["), name(p), F.lit("] "), text(p)))


def truncate(x: Column | str, n: int) -> Column:
    return F.substring(c(x), 1, n)


def release_date(x: Column | str) -> Column:
    """A leading ``YYYY[-MM[-DD]]``; else empty."""
    return F.regexp_extract(c(x), r"^\s*([0-9]{4}(?:-[0-9]{2}(?:-[0-9]{2})?)?)", 1)


def machine_made(title: Column | str) -> Column:
    t = F.trim(c(title))
    digits = F.length(F.regexp_replace(t, r"[^0-9]", ""))
    return (t != "") & ~t.contains(" ") & (digits >= 6) & (digits / F.length(t) >= 0.35)


def inner_caps(t: Column | str) -> Column:
    return F.length(F.regexp_replace(F.substring(c(t), 2, 1_000_000), "[^A-Z]", ""))


def not_a_title(title: Column | str) -> Column:
    t = F.trim(c(title))
    run = t.rlike("(?i)^[a-z0-9]{10,}$") & ((inner_caps(t) >= 2) | t.rlike("[A-Za-z][0-9]"))
    return (t != "") & ~t.contains(" ") & (machine_made(t) | (t.contains("_") & (F.length(t) >= 8)) | run)


def unrun(title: Column | str) -> Column:
    """A run-together title split at changes of case and before a closing number."""
    t = squeeze(title)
    caps, number = inner_caps(t), t.rlike("[A-Za-z][0-9]+$")
    split = F.regexp_replace(t, "(?<=[A-Za-z])(?=[0-9]+$)", " ")
    split = F.regexp_replace(split, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    whole = t.contains(" ") | machine_made(t) | (caps < 1) | ((caps < 2) & ~number)
    return F.when(t.contains(" "), t).when(t.contains("_"), squeeze(F.replace(t, F.lit("_"), F.lit(" ")))).when(whole, t).otherwise(squeeze(split))


def tidy_case(title: Column | str) -> Column:
    words = F.split(squeeze(title), " ")
    small = F.array(*map(F.lit, SMALL_WORDS))
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & (i < F.size(words) - 1) & F.array_contains(small, F.lower(w)), F.lower(w)).otherwise(w)), " ")


def title_parts(title: Column | str) -> list[Column]:
    """Quality of a title as five integers, best first."""
    t = F.trim(c(title))
    return [(~t.rlike(r"(?i)mixdown|[-_](hq|lq)$|[\s._-]mp3$|\.(mp3|wav|m4a)\b|\.com\b")).cast("int"), (~t.rlike("(?i)^[a-z0-9]{10,}$")).cast("int"), t.contains(" ").cast("int"), (~t.contains("_")).cast("int"), F.length(t)]


def split_tag(tag: Column | str) -> tuple[Column, Column]:
    """Prefix and value at the first colon; no colon: no prefix."""
    t = c(tag)
    has = t.contains(":")
    return F.when(has, F.trim(F.substring_index(t, ":", 1))).otherwise(""), F.when(has, F.trim(F.regexp_replace(t, "^[^:]*:", ""))).otherwise(F.trim(t))


def portable(path: Column | str, root: str) -> Column:
    """A path under ``root`` relative to it; others as they are."""
    return F.when(c(path).startswith(root), F.substring(c(path), len(root) + 1, 1_000_000)).otherwise(c(path))


def first_line(x: Column | str) -> Column:
    return F.trim(F.substring_index(c(x), "\n", 1))


def json_part(x: Column | str) -> Column:
    """The JSON object of a reply: the whole of it without a fence, else its outermost braces; null if neither parses."""
    t = F.trim(c(x))
    bare = F.regexp_extract(t, r"(?s)^```[a-zA-Z]*\s*(.*?)\s*```$", 1)
    whole, braces = F.coalesce(F.nullif(bare, F.lit("")), t), F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    parses = lambda j: F.coalesce(F.get_json_object(j, "$").startswith("{"), F.lit(False))
    return F.when(parses(whole), whole).when(parses(braces), braces)
