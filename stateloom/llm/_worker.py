"""What a Python worker keeps from task to task: the tables of one tokeniser, never of several."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_held: dict[tuple, Any] = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """The object of this key, made on first use; another key's object is let go first."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go of the tables, before work that needs none."""
    _held.clear()
