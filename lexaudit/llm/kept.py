"""What a Python worker keeps from task to task."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")

# One object with its caches, by the id of the broadcast that it is made of.
_made: dict[int, object] = {}


def kept(key: int, make: Callable[[], T]) -> T:
    """The object of ``key`` that this worker made last, whichever operator
    made it; that of another key goes first, so a worker that serves several
    stages holds the caches of one."""
    if key not in _made:
        _made.clear()
        _made[key] = make()
    return _made[key]
