"""All registered queries of the library: importing the modules fills the registry."""

from __future__ import annotations

from . import registry, registry_analytics, registry_feeds, registry_forest, registry_operators, registry_rules, registry_streams  # noqa: F401

QUERIES, SQL = registry.QUERIES, registry.SQL
