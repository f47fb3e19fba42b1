"""Named queries over the sample tables, each with the SQL that states its expected result."""

from opswatch.catalog import alerts, feed, health, pii, reports, runs, schedules, sequences, streams  # noqa: F401
from opswatch.catalog.registry import ORACLES, QUERIES  # noqa: F401
