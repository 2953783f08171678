"""Registered queries: operators applied to the driver's tables, with their SQL."""

from minuteworks.plans import sidecars, speech, streams, tables, writing  # noqa: F401

QUERIES = {**tables.QUERIES}  # speech adds its own to the same registry
ORACLES = {**tables.ORACLES}
