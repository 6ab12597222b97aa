"""All registered queries."""

from packetloom.plans import detection, inputs, live, quality, scoring, sequences, state, traffic  # noqa: F401
from packetloom.plans.registry import ORACLES, QUERIES  # noqa: F401
