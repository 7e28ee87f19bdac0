"""All queries of the library, and their SQL."""

from __future__ import annotations

from gridfield.plans import elements, registry

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
SECTIONS = (registry, elements)
