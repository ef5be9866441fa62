"""Small functions on lists, records and scalars."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import c, first_truthy

# Fixed values.
GENERATED_FIELDS = ("title", "summary", "description", "synopsis", "cover", "image", "tags", "spoilers")
NATURAL_ENGINES = ("flux", "sd3", "natural")
CATCH_ALL = r"^(unknown|various|assorted|misc)"
SENTENCE_ID = r"s[0-9]+"


def mark_generated(old: Column | str, new: Column | str) -> Column:
    """Sorted names of generated fields: the old ones and those of ``new`` that may be marked."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(c(old), none), F.array_intersect(F.coalesce(c(new), none), F.array(*map(F.lit, GENERATED_FIELDS)))))


def add_proposals(old: Column | str, tags: Column | str, why: str) -> Column:
    """Proposals ``(tag, why)`` with those of ``tags`` behind them that aren't there yet."""
    was = F.coalesce(c(old), F.array().cast("array<struct<tag:string,why:string>>"))
    fresh = F.array_except(F.coalesce(c(tags), F.array().cast("array<string>")), F.transform(was, lambda p: p["tag"]))
    return F.concat(was, F.transform(fresh, lambda t: F.struct(t.alias("tag"), F.lit(why).alias("why"))))


def added_tags(resolved: Column | str, own: Column | str) -> Column:
    """What resolution gave beyond the creator's own tags, in order."""
    return F.array_except(c(resolved), F.coalesce(c(own), F.array().cast("array<string>")))


def catch_all(author: Column | str) -> Column:
    """Whether an author names no one in particular; null counts as empty."""
    a = F.lower(F.trim(F.coalesce(c(author), F.lit(""))))
    return a.rlike(CATCH_ALL) | a.isin("", "compilation")


def wrap_words(words: Column | str, rows: int) -> Column:
    """Words in at most ``rows`` lines of about equal numbers; the last line takes the rest."""
    w = c(words)
    n = F.size(w)
    per = F.greatest(F.lit(1), F.rint(n / F.lit(float(max(rows, 1)))).cast("int"))
    last = F.least(F.lit(rows), F.ceil(n / per).cast("int"))
    line = lambda i: F.array_join(F.slice(w, i * per + 1, F.when(i == last - 1, F.greatest(n - i * per, F.lit(0))).otherwise(per)), " ")
    return F.when((F.lit(rows) <= 1) | (n < 2), F.array(F.array_join(w, " "))).otherwise(F.transform(F.sequence(F.lit(0), last - 1), line))


def art_key(text: Column | str, negative: Column | str, engine: Column | str) -> Column:
    """BLAKE2b-128 of prompt, negative prompt and engine; nulls are empty."""

    def digest(joined: pd.Series) -> pd.Series:
        return joined.map(lambda t: hashlib.blake2b(t.encode(), digest_size=16).hexdigest())

    t, n, e = (F.trim(F.coalesce(c(x), F.lit(""))) for x in (text, negative, engine))
    return F.pandas_udf(digest, "string")(F.concat_ws("\u0000", t, n, F.lower(e)))


def prompt_for(engine: Column | str, kept_tagged: Column | str, kept_natural: Column | str, tagged: Column | str, natural: Column | str) -> Column:
    """``(prompt, form)`` for an engine: running text for those that read it, else tags; the other form where one is empty."""
    t, n = F.trim(first_truthy(kept_tagged, tagged)), F.trim(first_truthy(kept_natural, natural))
    prefers = F.lower(F.coalesce(c(engine), F.lit(""))).isin(*NATURAL_ENGINES)
    use = F.when(prefers, n != "").otherwise(t == "")
    return F.struct(F.when(use, n).otherwise(t).alias("prompt"), F.when(use, "natural").otherwise("tagged").alias("form"))


def spoilers_from(spoilers: Column | str) -> Column:
    """Spoilers with what their writers left out: medium severity and confidence, undisclosed."""
    filled = lambda s, f, d: first_truthy(s[f], F.lit(d)).alias(f)
    return F.transform(c(spoilers), lambda s: F.struct(s["text"].alias("text"), filled(s, "severity", "medium"), filled(s, "disclosure", "undisclosed"), filled(s, "confidence", "medium")))


def trusted_labels(labels: Column | str, fits: Column | str, n: int) -> Column:
    """The first ``n`` zero-shot labels, or none where they were found not to fit."""
    return F.when(F.coalesce(c(fits), F.lit(True)), F.slice(F.filter(c(labels), lambda x: F.coalesce(x != "", F.lit(False))), 1, n)).otherwise(F.array().cast("array<string>"))


def voice_confidence(scores: Column | str, allowed: Sequence[str]) -> Column:
    """The largest score in ``[(label, score)]`` over the allowed labels; 0 where there is none."""
    of = F.filter(c(scores), lambda s: s["label"].isin(*allowed))
    return F.coalesce(F.array_max(F.transform(of, lambda s: s["score"])), F.lit(0.0))


def merged(base: Column | str, over: Column | str) -> Column:
    """Shallow merge of two maps; the second wins."""
    b, o = c(base), c(over)
    return F.map_concat(F.map_filter(b, lambda k, _: ~F.array_contains(F.map_keys(o), k)), o)


def same_value(a: Column | str, b: Column | str) -> Column:
    """Equality of values that may be typed unlike: both null, or alike in print."""
    return c(a).cast("string").eqNullSafe(c(b).cast("string"))


def prune_record(value: Any, valid: set[str], cited: Callable[[str], bool], dropped: list[str]) -> Any:
    """A JSON value without citations outside ``valid``: they leave lists, and empty texts elsewhere."""
    stray = lambda v: isinstance(v, str) and cited(v) and v not in valid
    if isinstance(value, dict):
        return {k: prune_record(v, valid, cited, dropped) for k, v in value.items()}
    if isinstance(value, list):
        dropped += [v for v in value if stray(v)]
        return [prune_record(v, valid, cited, dropped) for v in value if not stray(v)]
    if stray(value):
        dropped.append(value)
        return ""
    return value


def prune_citations(record: Column | str, ids: Column | str, form: str = SENTENCE_ID) -> Column:
    """A JSON object without citations of sentences that the transcript lacks; a warning names up to 20 of them.

    ``ids``: the sentences that exist, null as none. Null, broken and other JSON stays as it is.
    """
    cited = re.compile(form).fullmatch

    def one(text: str | None, known: Any) -> str | None:
        try:
            value = json.loads(text) if text else None
        except ValueError:
            return text
        if not isinstance(value, dict):
            return text
        dropped: list[str] = []
        out = prune_record(value, set() if known is None else set(known), lambda s: cited(s) is not None, dropped)
        if dropped:
            was = out.get("_warnings")
            out["_warnings"] = [*(was if isinstance(was, list) else []), f"{len(dropped)} cited sentence ids were not in the transcript: {', '.join(sorted(set(dropped))[:20])}"]
        return json.dumps(out, ensure_ascii=False)

    def run(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([one(t, k) for t, k in zip(texts, known, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(c(record), c(ids))
