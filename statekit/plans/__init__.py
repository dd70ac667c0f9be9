"""The registered queries, each next to the SQL that must give the same rows."""

from statekit.plans import lineage, log, manifest, metrics, probes, reshape, routing, streams, tiering, upkeep  # noqa: F401
from statekit.plans.registry import REGISTRY  # noqa: F401
