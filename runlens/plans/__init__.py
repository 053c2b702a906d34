"""Named query plans; importing this package fills the registry."""

from runlens.plans import (  # noqa: F401
    instance_plans,
    io_plans,
    leak_plans,
    message_plans,
    rl_plans,
    scoring_plans,
    stats_plans,
    step_plans,
    stream_plans,
    testlog_plans,
)
from runlens.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
