"""Designation to persona, depth and emphasis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords in order, most specific first; a bare "lead" comes last.
KEYWORDS = [
    ("executive", "ceo cto coo cio cfo chief director vp|vice president|head of|founder"),
    ("delivery", "delivery manager scrum|project lead|program|product owner"),
    ("quality", "tester|test engineer|qe qa sdet quality automation"),
    ("developer", "developer engineer architect devops sre programmer sde"),
    ("curation", "curator|knowledge manager|steward"),
    ("operations", "admin operator platform"),
]
DEPTH = {"developer": 3, "quality": 3, "delivery": 2, "executive": 1, "curation": 3, "operations": 3, "general": 3}
EMPHASIS = {"developer": "code", "quality": "test", "delivery": "authority", "executive": "authority"}


def _words(spec: str) -> list[str]:
    out = []
    for part in spec.split("|"):
        multi = part in ("vice president", "head of", "project lead", "product owner", "test engineer", "knowledge manager")
        out += [part] if multi else part.split()
    return out


def persona_for(designation: Column) -> Column:
    d = F.lower(F.trim(F.coalesce(designation, F.lit(""))))
    out = F.when(d == "", "general")
    for persona, spec in KEYWORDS:
        for w in _words(spec):
            out = out.when(d.contains(w), persona)
    return out.when(d.contains("lead"), "delivery").otherwise("general")


def depth_cap(persona: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in DEPTH.items() for x in (F.lit(k), F.lit(v))]), persona)


def emphasis(persona: Column) -> Column:
    m = F.create_map(*[x for k, v in EMPHASIS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, persona), F.lit("none"))
