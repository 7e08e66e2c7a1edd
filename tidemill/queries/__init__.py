"""Registered queries: each applies operators to the test tables; most have the same in SQL beside them."""

from . import audits, drafts, entities, filing, landing, logs, merges, names, records, rules, syncs, takeup, views
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "audits", "drafts", "entities", "filing", "landing", "logs", "merges", "names", "records", "rules", "syncs", "takeup", "views"]
