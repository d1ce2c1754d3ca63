"""Results for strings that come again: lines of logs, whole outputs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Memo(dict):
    """memo[s] is make(s), made once for the strings of late; about ``most`` characters of them are held."""

    def __init__(self, make: Callable[[str], Any], most: int = 1 << 23):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key: str) -> Any:
        made = self.make(key)
        # what is made, and the entry itself, count as much as a line of some length
        size = len(key) + 256
        if size > self.most:
            return made
        if self.held + size > self.most:
            self.clear()
            self.held = 0
        self.held += size
        self[key] = made
        return made
