"""Fixed values of the recorded state: kinds, their groups, and table schemas (DDL)."""

from __future__ import annotations

# Names of states, actions, conditions and reports.
STATE_KINDS = (
    "submitted", "ready", "claimed", "running", "committing", "cancelling", "relocating",
    "transferring", "waiting", "paused", "succeeded", "failed", "cancelled",
)
TERMINAL_KINDS = ("succeeded", "failed", "cancelled")
QUIESCENT_KINDS = ("submitted", "ready", "waiting", "paused", "failed", "succeeded", "cancelled")
COLLECTABLE_KINDS = ("succeeded", "failed", "cancelled", "paused")
LIVE_KINDS = ("claimed", "running", "committing", "cancelling")
JOIN_CONDITIONS = ("all_succeeded", "all_terminal", "any_succeeded", "any_terminal", "at_least")
RETENTION_CATEGORIES = (
    "attempt_control", "transaction_trash", "retired_bundles", "transfer_records", "tmp_entries",
    "retired_requests", "journal_segments", "manager_directories", "placement_directories",
)
#: Which operator action is legal in which state.
ACTION_KINDS = {
    "cancel": ("submitted", "ready", "claimed", "running", "committing", "cancelling", "relocating", "transferring", "waiting", "paused"),
    "set_priority": ("submitted", "ready", "waiting", "paused", "failed"),
    "pause": ("submitted", "ready", "waiting", "claimed", "running", "committing", "paused"),
    "continue": ("failed", "paused"),
    "override_step": ("failed", "paused"),
}
