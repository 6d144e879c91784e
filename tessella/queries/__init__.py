"""Registered queries, by subject. Importing this package registers them all."""

from tessella.queries import ingest, memory, scalar, search, shapes, streams, structure  # noqa: F401
from tessella.plans.registry import QUERIES, SQL  # noqa: F401
