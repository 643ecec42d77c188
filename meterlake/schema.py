"""Data model. Money is kept as integer micro-dollars, so that sums do not depend on order;
``cost_usd`` is derived by one division where a result leaves the engine."""

from __future__ import annotations

# The two sources, and the device of rows uploaded before devices existed.
SOURCES = ("claude-code", "codex")
LEGACY = "legacy"

LOGICAL = ["user_id", "usage_date", "source", "model"]
PHYSICAL = ["user_id", "device_id", "source", "usage_date", "model"]
TOKENS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens"]
MEASURES = [*TOKENS, "cost_micros", "session_count"]
SUMMED = [*TOKENS, "tokens_without_cache_read", "cost_micros", "session_count"]

USAGE = (
    "user_id string, device_id string, source string, usage_date string, model string, timezone string, "
    "input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, cache_read_tokens bigint, total_tokens bigint, "
    "cost_micros bigint, session_count bigint, synced_at string, snapshot_hash string"
)


def unused(rows, name: str) -> str:
    """A column name that ``rows`` does not have, from ``name``."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name
