"""Clean-up of titles and folding of proposed tags, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import c, squeeze, unrun

# What is cut from titles, and what proposals are told by.
DURATION = r"\s*[\[(]\s*\d{1,2}:\d{2}(?::\d{2})?\s*[\])]\s*$"
SCRIPT_BY = r"(?i)[\[(]?\s*script(?:\s+fill)?\s+by\s*:?\s*(?:/u/|u/)?([A-Za-z0-9_.\-]+)\s*[\])]?"
AUDIENCE = r"(?i)^\s*\[?\s*[fma]4[fma]\+?\s*\]\s*"
GROUP = r"\[[^\[\]]*\]"
FRAGMENT = r"\s*\(\s*[a-z]+\s*\)\s*$"
TRAILING_LOWER = r"(\s+[a-z][a-z'\-]*)+$"
ENCODE = r"(?i)[\s._-]*(?:video|audio)?[\s._-]*(?:h\.?26[45]|x26[45]|hq|lq|sq|\d{3,4}p|\d+kbps|mixdown|remux|reencode)\b"
EXTENSION = r"(?i)[\s._-]+(?:mp3|mp4|m4a|m4v|wav|flac|ogg|wma|wmv|aac)\s*$"
DOMAIN = r"[\w-]+\.(?:com|net|org|nl)"
EDGES = " -–—:;,._"
SOFTENERS = r"(?i)^(?:a\s+little|a\s+bit\s+of|a\s+touch\s+of|slightly|slight|mild|mildly|some|light|lightly|gentle\s+amount\s+of|minor)\s+"
MENTIONS = r"(?i)^(?:a\s+mention\s+of|mentions?\s+of|brief|briefly|passing|implied|implies|hint\s+of|hints\s+of|references?\s+to|allusions?\s+to|suggestions?\s+of)\s+"
NOT_A_TAG = (
    r"(?i)^(?:adults?\s+only|18\+|nsfw|sfw|audio\s*\d*\s*(?:of\s*\d+)?$|(?:part|track|file|disc)\s+\d+(?:\s+of\s+\d+)?\b|\d+\s+of\s+\d+$"
    r"|mp3|wav|m4a|full\s+file|complete\s+file|part\s+\d+\s+of\s+the\s+ongoing\s+series\b)"
)
#: Names of sites, as patterns, that lead titles besides domains; a library adds its own.
SITES: tuple[str, ...] = ()


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` evaluated once, so that chains don't grow with every use of a step."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _four_times(start: Column, step: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.array(*map(F.lit, range(4))), start, lambda s, _: step(s))


def _bracketed(t: Column) -> Column:
    """A title in brackets: what follows them if that is 12 characters or more, else what is inside; other titles up to a bracket."""
    shape = r"(?s)^\[([^\[\]]*)\]?(.*)$"
    head, rest = F.trim(F.regexp_extract(t, shape, 1)), squeeze(F.regexp_replace(F.regexp_extract(t, shape, 2), GROUP, " "))
    return F.when(t.startswith("["), let(rest, lambda r: F.when(F.length(r) >= 12, r).otherwise(head))).otherwise(F.substring_index(t, "[", 1))


def _closed(t: Column) -> Column:
    loose = F.regexp_replace(F.trim(F.regexp_replace(t, r"\]$", "")), TRAILING_LOWER, "")
    return F.when(t.endswith("]") & ~t.contains("["), loose).otherwise(t)


def _strip(pattern: str) -> Callable[[Column], Column]:
    """What ``pattern`` leaves, as long as three characters or more stay."""
    return lambda t: let(F.btrim(F.regexp_replace(t, pattern, ""), F.lit(EDGES)), lambda short: F.when(F.length(short) < 3, t).otherwise(short))


def _strip_encode(state: Column) -> Column:
    """The same for traces of encoding; the first of each pass is noted as the variant, once."""
    t, noted = state["title"], state["variant"]
    cut = F.btrim(squeeze(F.replace(F.regexp_extract(t, f"({ENCODE})", 1), F.lit("_"), F.lit(" "))), F.lit(EDGES))

    def note(short: Column, found: Column) -> Column:
        fresh = (short != t) & (F.length(short) >= 3) & (found != "") & ~F.contains(F.lower(noted), F.lower(found))
        return F.struct(F.when(F.length(short) < 3, t).otherwise(short).alias("title"), F.when(fresh, F.trim(F.concat_ws(" ", noted, found))).otherwise(noted).alias("variant"))

    return let(F.btrim(F.regexp_replace(t, ENCODE, ""), F.lit(EDGES)), lambda short: let(cut, lambda found: note(short, found)))


def tidy_title(title: Column | str, sites: Sequence[str] = SITES) -> Column:
    """``(title, script_by, variant)``: a title without durations, credits, audience codes, brackets, site names, traces of encoding and extensions.

    What is told by a credit or an encoding is kept beside it, else empty. A null title gives nulls.
    """
    site = r"(?i)^\s*(?:" + "|".join([*sites, DOMAIN]) + r")\s*[-–—:]*\s*"
    credit = f"(?s)^(.*?){SCRIPT_BY.replace('(?i)', '(?i:', 1)})(.*)$"
    timed = F.regexp_replace(squeeze(title), DURATION, "")

    def rest(t: Column) -> Column:
        by = F.regexp_extract(t, credit, 2)
        bare = F.when(by == "", t).otherwise(F.trim(F.concat(F.regexp_extract(t, credit, 1), F.lit(" "), F.regexp_extract(t, credit, 3))))
        steps: list[Callable[[Column], Column]] = [lambda x: F.regexp_replace(x, AUDIENCE, ""), _bracketed, _closed, lambda x: F.regexp_replace(x, FRAGMENT, ""), lambda x: _four_times(x, _strip(site))]
        for f in steps:
            bare = let(bare, f)
        coded = let(bare, lambda x: _four_times(F.struct(x.alias("title"), F.lit("").alias("variant")), _strip_encode))
        named = lambda s: let(_four_times(s["title"], _strip(EXTENSION)), lambda x: F.btrim(squeeze(unrun(x)), F.lit(EDGES[:-2])))
        return let(coded, lambda s: F.struct(named(s).alias("title"), by.alias("script_by"), s["variant"].alias("variant")))

    return let(timed, rest)


def title_words(x: Column | str) -> Column:
    """Each run of letters with a capital first and small letters after it."""
    runs = F.regexp_extract_all(c(x), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), "")


def without_qualifier(x: Column, pattern: str) -> Column:
    """A tag without up to four of the qualifiers in front of it; never empty."""
    return _four_times(x, lambda t: let(F.trim(F.regexp_replace(t, pattern, "")), lambda s: F.when(s == "", t).otherwise(s)))


def proposal_forms(tag: Column | str) -> Column:
    """``[(form, why)]``: the registered tags that a proposal may stand for, first choice first."""
    t = F.trim(c(tag))

    def forms(pattern: str, lead: str, why: str) -> Column:
        some = lambda b: F.array(*(F.struct(F.concat(F.lit(lead), f).alias("form"), F.lit(why).alias("why")) for f in (b, title_words(b))))
        none = F.array().cast("array<struct<form:string,why:string>>")
        return F.when(t.rlike(pattern), let(without_qualifier(t, pattern), some)).otherwise(none)

    return F.concat(forms(SOFTENERS, "", "a qualifier that only softens"), forms(MENTIONS, "CW: ", "mentioned rather than featured"))
