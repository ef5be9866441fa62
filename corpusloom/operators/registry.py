"""Edits of a controlled vocabulary: planned whole in memory, then applied to items and mappings in one pass without a shuffle."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import fold, word_fold
from corpusloom.plans.catalogue import Catalogue, table

REGISTRY = Catalogue()
#: Edits and rulings are written by people or by one run of adjudication; their tables travel in the plan, so their number is bounded.
MOST = 20_000


class EditError(ValueError):
    """An edit that the registry can't take."""


def key_of(tag: str) -> str:
    """The identity of a tag, as ``fold`` gives it on columns."""
    return re.sub("[^a-z0-9]+", "", tag.casefold())


def split(tag: str) -> tuple[str, str]:
    head, colon, value = tag.partition(":")
    return (head.strip(), value.strip()) if colon else ("", tag.strip())


@dataclass(frozen=True)
class Registry:
    """``kinds``: namespaces and their prefixes, one of them empty; ``meanings``: full names of tags and what they mean; ``about``: what namespaces are for."""

    kinds: Mapping[str, str]
    meanings: Mapping[str, str]
    about: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        claims: dict[str, set[str]] = {}
        for name in self.meanings:
            claims.setdefault(key_of(split(name)[1]), set()).add(name)
        spelling = {k: next(iter(v)) for k, v in claims.items() if len(v) == 1}
        object.__setattr__(self, "_spelling", spelling | {key_of(name): name for name in self.meanings})

    def known(self, tag: str) -> str:
        """The registered name of a tag, else empty; a bare value counts where one name alone has it."""
        return self._spelling.get(key_of(tag), "")  # type: ignore[attr-defined]

    def place(self, tag: str) -> str:
        """The namespace of a new name; a prefix that is none of them is refused."""
        prefix = split(tag)[0]
        for kind, p in self.kinds.items():
            if p == prefix:
                return kind
        raise EditError(f"{tag!r} starts with {prefix + ':'!r}, which is not a namespace; use one of {' '.join(p + ':' for p in self.kinds.values() if p)}, or no prefix")

    def changed(self, drop: str = "", add: Mapping[str, str] | None = None) -> Registry:
        kept = {k: v for k, v in self.meanings.items() if k != drop}
        return replace(self, meanings=kept | dict(add or {}))

    def describe_kind(self, kind: str, about: str) -> Registry:
        """A registry whose namespace ``kind`` is for ``about``; empty takes the line away."""
        key = kind.strip().removesuffix(":").lower()
        if key not in self.kinds:
            raise EditError(f"{kind!r} is not a namespace; use one of {', '.join(self.kinds)}")
        rest = {k: v for k, v in self.about.items() if k != key}
        return replace(self, about=rest | ({key: about.strip()} if about.strip() else {}))

    def block(self) -> str:
        """All tags as text, by namespace and name."""
        out = []
        for kind, prefix in self.kinds.items():
            names = sorted((n for n in self.meanings if split(n)[0] == prefix or not prefix and split(n)[0] not in self.kinds.values()), key=str.casefold)
            if names:
                out.append("\n".join([f"{kind}: {self.about[kind]}" if kind in self.about else f"{kind}:", *(f"  {n}: {self.meanings[n]}" for n in names)]))
        return "\n".join(out)


@dataclass
class Plan:
    """What a list of edits comes to: the new registry, where old names go (empty: nowhere), names that proposals may now have, notes, rulings and steps."""

    registry: Registry
    day: str
    changes: dict[str, str] = field(default_factory=dict)
    accept: dict[str, str] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)
    rulings: list[dict[str, str]] = field(default_factory=list)
    steps: list[dict[str, str]] = field(default_factory=list)

    def moved(self, old: str, new: str, note: str) -> None:
        """``old`` is now ``new``, and so is all that had become ``old`` before."""
        self.changes = {a: new if b and key_of(b) == key_of(old) else b for a, b in self.changes.items()} | {old: new}
        self.accept = {k: b for k, t in self.accept.items() if (b := new if key_of(t) == key_of(old) else t)}
        self.notes[old] = note

    def ruled(self, tag: str, verdict: str, into: str = "", why: str = "", **more: str) -> None:
        said = {"when": self.day, "tag": tag, "verdict": verdict, "model": "by hand", "into": into, "why": why}
        self.rulings.append({k: v for k, v in said.items() if v} | more)

    def must(self, verb: str, tag: str) -> str:
        if not (name := self.registry.known(tag)):
            raise EditError(f"{verb} {tag!r}: the registry has no such tag")
        return name


def _add(p: Plan, tag: str, description: str = "", why: str = "") -> None:
    tag, description = tag.strip(), description.strip()
    if not tag or not description:
        raise EditError(f"add {tag!r}: a tag and a description are both required")
    if found := p.registry.known(tag):
        raise EditError(f"add {tag!r}: the registry already has {found!r}")
    p.registry.place(tag)
    p.registry = p.registry.changed(add={tag: description})
    p.accept[key_of(tag)] = tag
    p.ruled(tag, "approve", why=why, name=tag, description=description)
    p.steps.append({"action": "add", "tag": tag})


def _describe(p: Plan, tag: str, description: str = "") -> None:
    name = p.must("describe", tag)
    if not description.strip():
        raise EditError(f"describe {tag!r}: a description is required")
    p.steps.append({"action": "describe", "tag": name, "was": p.registry.meanings[name], "now": description.strip()})
    p.registry = p.registry.changed(add={name: description.strip()})


def _remove(p: Plan, tag: str, why: str = "") -> None:
    name = p.must("remove", tag)
    p.registry = p.registry.changed(name)
    p.moved(name, "", f"removed from the registry on {p.day}" + (f": {why}" if why else ""))
    p.ruled(name, "omit", why=why)
    p.steps.append({"action": "remove", "tag": name})


def _rename(p: Plan, tag: str, to: str = "", description: str = "") -> None:
    name, to = p.must("rename", tag), to.strip()
    if not to:
        raise EditError(f"rename {tag!r}: a new name is required")
    if (found := p.registry.known(to)) and found != name:
        raise EditError(f"rename {tag!r}: the registry already has {found!r}; merge the two instead")
    p.registry.place(to)
    p.registry = p.registry.changed(name, {to: description.strip() or p.registry.meanings[name]})
    p.moved(name, to, f"renamed to {to}")
    p.ruled(name, "rework", to, description)
    p.steps.append({"action": "rename", "tag": name, "target": to})


def _merge(p: Plan, tag: str, into: str = "") -> None:
    name, survivor = p.must("merge", tag), p.registry.known(into)
    if not survivor:
        raise EditError(f"merge {tag!r} into {into!r}: the registry has no {into!r}; rename it instead")
    if survivor == name:
        raise EditError(f"merge {tag!r} into {into!r}: they are the same tag")
    p.registry = p.registry.changed(name)
    p.moved(name, survivor, f"merged into {survivor}")
    p.ruled(name, "merge", survivor)
    p.steps.append({"action": "merge", "tag": name, "target": survivor})


VERBS: dict[str, Callable[..., None]] = {"add": _add, "describe": _describe, "remove": _remove, "rename": _rename, "merge": _merge}


def plan(registry: Registry, edits: Iterable[Mapping[str, str]], day: str) -> Plan:
    """All edits in order, or an ``EditError`` that names the first that can't be made; ``registry`` itself never changes."""
    p = Plan(registry, day)
    for n, edit in enumerate(edits, 1):
        if n > MOST:
            raise EditError(f"more than {MOST} edits")
        rest = {k: v for k, v in edit.items() if k != "action"}
        try:
            VERBS[edit["action"]](p, **rest)
        except (KeyError, TypeError) as e:
            raise EditError(f"edit {n}: no such action or field: {e}") from e
        except EditError as e:
            raise EditError(f"edit {n}: {e}") from e
    return p


def lookup(pairs: Mapping[str, str]) -> Column:
    """A constant map."""
    return F.from_json(F.lit(json.dumps(dict(pairs))), "map<string,string>")


def _list(x: str) -> Column:
    return F.coalesce(F.col(x), F.array().cast("array<string>"))


def _wishes() -> Column:
    return F.coalesce(F.col("proposals"), F.array().cast("array<struct<tag:string,why:string>>"))


def rewrite_items(items: DataFrame, p: Plan) -> DataFrame:
    """Items after a plan: ``tags``, ``added`` and ``proposals`` rewritten, with ``retagged``, ``removed``, ``granted``, ``requeued`` (counts) and ``touched``.

    ``items``: any columns, of them ``tags`` and ``added`` (lists of texts) and
    ``proposals`` (list of ``(tag, why)``), null as empty. Tags are compared
    folded. A tag taken out of the registry becomes a proposal again where an
    item had it; a proposal whose tag was added is granted. An item that no
    edit concerns stays as it is, repeated tags included; ``added`` is sorted
    where it changes.
    """
    folded = lookup({key_of(a): b for a, b in p.changes.items()})
    accept, gone = lookup(p.accept), [(a, p.notes[a]) for a, b in p.changes.items() if not b]
    to = lambda t: F.try_element_at(folded, fold(t))
    moved = lambda ts: F.filter(F.transform(ts, lambda t: F.coalesce(to(t), t)), lambda t: t != "")
    ruled = lambda ts: F.exists(ts, lambda t: to(t).isNotNull())
    grant = lambda w: F.try_element_at(accept, fold(w["tag"]))
    tags, added, wishes = F.col("__tags"), F.col("__added"), F.col("__wishes")
    base = items.withColumns({"__tags": _list("tags"), "__added": _list("added"), "__wishes": _wishes()})
    kept = F.array_distinct(moved(tags))
    granted = F.array_except(F.array_compact(F.transform(wishes, grant)), kept)
    open_ = F.filter(wishes, lambda w: grant(w).isNull())
    left = F.transform(open_, lambda w: F.struct(F.coalesce(F.nullif(to(w["tag"]), F.lit("")), w["tag"]).alias("tag"), w["why"].alias("why")))
    back = F.array(*(F.struct(F.lit(a).alias("tag"), F.lit(n).alias("why")) for a, n in gone)) if gone else F.array().cast("array<struct<tag:string,why:string>>")
    had = lambda r: F.exists(tags, lambda t: fold(t) == fold(r["tag"])) & ~F.exists(left, lambda w: fold(w["tag"]) == fold(r["tag"]))
    base = base.withColumns({
        "__kept": kept, "__granted": granted, "__left": left, "__back": F.filter(back, had),
        "retagged": F.size(F.filter(tags, lambda t: to(t) != "")), "removed": F.size(F.filter(tags, lambda t: to(t) == "")),
    })
    base = base.withColumns({
        "granted": F.size("__granted"), "requeued": F.size("__back"),
        "touched": F.coalesce(ruled(tags) | ruled(added) | F.exists(wishes, lambda w: grant(w).isNotNull() | F.coalesce(to(w["tag"]) != "", F.lit(False))) | (F.size("__back") > 0), F.lit(False)),
    })
    out = {
        "tags": F.when(F.col("touched"), F.concat("__kept", "__granted")).otherwise(tags),
        "added": F.when(ruled(added), F.array_sort(F.array_distinct(moved(added)))).otherwise(added),
        "proposals": F.when(F.col("touched"), F.concat("__left", "__back")).otherwise(wishes),
    }
    return base.withColumns(out).drop("__tags", "__added", "__wishes", "__kept", "__granted", "__left", "__back")


def rewrite_mapping(mapping: DataFrame, p: Plan) -> DataFrame:
    """A creator's mapping after a plan: ``to`` follows its tag; a row whose tag is gone keeps it and gets ``retired_on`` and ``retired_why``. Rows without ``to`` stay."""
    folded, notes = lookup({key_of(a): b for a, b in p.changes.items()}), lookup({key_of(a): n for a, n in p.notes.items()})
    goal = F.try_element_at(folded, fold("to"))
    gone = (goal == "") & (F.col("to") != "")
    return mapping.withColumns({
        "retired_on": F.when(gone, F.lit(p.day)), "retired_why": F.when(gone, F.try_element_at(notes, fold("to"))),
        "to": F.when((goal != "") & (F.col("to") != ""), goal).otherwise(F.col("to")),
    })


def rewrite_pending(pending: DataFrame, p: Plan) -> DataFrame:
    """Pending tags after a plan: those added or removed leave, others follow their names."""
    folded, accept = lookup({key_of(a): b for a, b in p.changes.items()}), lookup(p.accept)
    goal = F.try_element_at(folded, fold("tag"))
    rows = pending.where(F.try_element_at(accept, fold("tag")).isNull() & F.coalesce(goal != "", F.lit(True)))
    return rows.withColumn("tag", F.coalesce(goal, "tag"))


def adjudicate(registry: Registry, rulings: Iterable[Mapping[str, str]]) -> tuple[Registry, dict[str, str], list[str]]:
    """The registry after rulings, where each ruled tag goes (empty: nowhere), and names that were refused.

    The last ruling on a tag counts. Granted names with a meaning are added
    where the registry lacks them. A tag ruled out that the registry has is
    that tag; a target it doesn't have is an error.
    """
    decided: dict[str, str] = {}
    refused = []
    for n, r in enumerate(rulings, 1):
        if n > MOST:
            raise EditError(f"more than {MOST} rulings")
        tag, verdict = (r.get("tag") or "").strip(), r.get("verdict")
        grants = verdict in ("approve", "rework")
        name, meaning = ((r.get("name") or "").strip() or tag), (r.get("description") or "").strip()
        if grants and name and meaning and not registry.known(name):
            try:
                registry.place(name)
                registry = registry.changed(add={name: meaning})
            except EditError as e:
                refused.append(f"{name}: {e}")
        if tag:
            decided[tag] = name if grants else (r.get("merge_into") or "").strip() if verdict == "merge" else ""
    for tag, target in decided.items():
        decided[tag] = registry.known(target or tag)
        if target and not decided[tag]:
            raise EditError(f"ruling for {tag!r} names an unregistered target {target!r}")
    return registry, decided, refused


def apply_rulings(items: DataFrame, decided: Mapping[str, str]) -> DataFrame:
    """Items after adjudication: ruled proposals leave; their tags are gained, moved or dropped, in ``added`` too. Adds ``gained`` and ``dropped`` (lists) and ``ruled``."""
    goal = lookup(decided)
    base = items.withColumns({"__tags": _list("tags"), "__added": _list("added"), "__wishes": _wishes()})
    tags, wishes = F.col("__tags"), F.col("__wishes")
    to = lambda w: F.try_element_at(goal, F.trim(w["tag"]))
    base = base.withColumns({
        "gained": F.array_except(F.array_compact(F.transform(wishes, lambda w: F.nullif(to(w), F.lit("")))), tags),
        "dropped": F.array_intersect(F.transform(F.filter(wishes, lambda w: to(w) != F.trim(w["tag"])), lambda w: F.trim(w["tag"])), tags),
        "ruled": F.exists(wishes, lambda w: to(w).isNotNull()),
    })
    moved = (F.size("gained") + F.size("dropped")) > 0
    without = lambda ts: F.filter(ts, lambda t: ~F.array_contains("dropped", t))
    out = {
        "tags": F.when(moved, F.concat(without(tags), "gained")).otherwise(tags),
        "added": F.when(moved & (F.size("__added") > 0), F.array_sort(without(F.array_union("__added", "gained")))).otherwise(F.col("__added")),
        "proposals": F.filter(wishes, lambda w: to(w).isNull()),
    }
    return base.withColumns(out).drop("__tags", "__added", "__wishes")


def proposed_or_granted(proposed: DataFrame, rulings: DataFrame) -> DataFrame:
    """``proposed(id, tag)`` with the standing ``verdict`` and ``name`` of its tag in ``rulings(tag, verdict, name)``, compared word-folded; null where no one has ruled."""
    r = rulings.select(word_fold("tag").alias("__k"), "verdict", F.coalesce(F.nullif("name", F.lit("")), "tag").alias("name"))
    return proposed.join(r, word_fold("tag") == F.col("__k"), "left").drop("__k")


_KINDS = {"content": "", "place": "Place"}
_TAGS = {"PROMO": "on offer", "ECONOMY": "cheap", "SMALL": "little", "STANDARD": "plain", "Place: Old": "used"}
_EDITS = [
    {"action": "merge", "tag": "economy", "into": "promo"},
    {"action": "rename", "tag": "PROMO", "to": "Special"},
    {"action": "remove", "tag": "small", "why": "too vague"},
    {"action": "add", "tag": "bolt", "description": "a fastener"},
]


@REGISTRY.query(
    "registry_edit_rewrite",
    """WITH t AS (SELECT p_partkey, p_type, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part), u AS (SELECT *, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'Special' WHEN p_type = 'SMALL' THEN '' ELSE p_type END AS k FROM t)
SELECT p_partkey, array_to_string(list_filter([k, CASE WHEN w1 = 'small' THEN '' ELSE w1 END, CASE WHEN w2 = 'bolt' THEN w2 ELSE '' END], lambda x: x <> ''), '|') AS tags, k AS added,
concat_ws('|', CASE WHEN w2 <> 'bolt' THEN w2 END, CASE WHEN p_type = 'SMALL' OR w1 = 'small' THEN 'SMALL' END) AS proposals, p_type IN ('PROMO', 'ECONOMY', 'SMALL') OR w1 = 'small' OR w2 = 'bolt' AS touched FROM u""",
)
def q_edit(spark: SparkSession, d: str) -> DataFrame:
    """Four edits applied to parts that stand for items: their type and first word are tags, the second word is proposed."""
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    items = table(spark, d, "part").select("p_partkey", F.array("p_type", first).alias("tags"), F.array("p_type").alias("added"), F.array(F.struct(second.alias("tag"), F.lit("asked").alias("why"))).alias("proposals"))
    out = rewrite_items(items, plan(Registry(_KINDS, _TAGS), _EDITS, "2024-01-01"))
    return out.select("p_partkey", F.array_join("tags", "|").alias("tags"), F.array_join("added", "|").alias("added"), F.array_join(F.col("proposals.tag"), "|").alias("proposals"), "touched")
