"""Plan a documentation query: a topic becomes terms and ranked facets.

Planning is about one short string, so it runs in Python; the same term rules as Column functions are in
``functions.text``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex

from lexispark.functions.text import IDENTIFIER, STOP_WORDS, TERM, TOKEN

MOST_TERMS, MOST_ALL, MOST_IDENTIFIERS, MOST_PHRASES = 18, 8, 6, 3


@dataclass(frozen=True)
class Facet:
    """Units, each a phrase of tokens; mode "any" or "all" of them."""

    mode: str
    units: tuple[tuple[str, ...], ...]


def terms(topic: str) -> list[str]:
    """Distinct terms of a topic in order."""
    bare = (t.strip("/#") for t in regex.findall(TERM, topic.lower()))
    return list(dict.fromkeys(t for t in bare if len(t) > 1 and t not in STOP_WORDS))


def phrase(text: str) -> tuple[str, ...]:
    return tuple(regex.findall(TOKEN, text.lower()))


def plan_query(topic: str) -> list[Facet]:
    """Any of the terms, all of the first ones, each identifier, each quoted phrase; equal facets count once."""
    known = terms(topic)[:MOST_TERMS]
    if not known:
        return []
    camel = [t.lower() for t in regex.findall(TERM, topic) if re.search("[a-z][A-Z]", t)]
    names = dict.fromkeys([t for t in known if re.search(IDENTIFIER, t)] + camel)
    quoted = [" ".join(terms(q)) for q in re.findall("[\"'`](.{2,80}?)[\"'`]", topic)]
    wanted: dict[tuple, Facet] = {}

    def add(mode: str, texts: list[str]) -> None:
        units = [phrase(t) for t in texts]
        if mode == "any" or len(texts) == 1:
            units = [u for u in units if u]
        # One unit is the same facet whether any or all of it is asked for.
        wanted.setdefault((mode if len(texts) > 1 else "all", *texts), Facet(mode, tuple(units)))

    add("any", known)
    add("all", known[:MOST_ALL])
    for name in list(names)[:MOST_IDENTIFIERS]:
        add("all", [name])
    for q in [q for q in quoted if q][:MOST_PHRASES]:
        add("all", [q])
    return list(wanted.values())


def candidate_limit(limit: int | None) -> int:
    return max(40, min(8 * (limit if limit is not None else 12), 120))


def token_budget(topic: str, asked: int | None = None) -> int:
    """How many tokens an answer may have."""
    return max(500, min(asked, 10_000)) if asked is not None else min(5_000, 1_600 + 180 * len(terms(topic)))
