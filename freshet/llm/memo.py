"""A bounded memory of what was worked out lately."""

from __future__ import annotations

#: Texts that are looked up together: few, so that they stay in the processor's caches.
TOGETHER = 8
#: Longer keys aren't kept.
LONGEST_MEMO = 64
#: Bytes that an entry takes besides its characters, about: two object heads and a place in the map.
ENTRY = 180


class Recent:
    """A map that keeps what was looked up lately, in about ``most`` bytes: half of it new, half
    of it what was new before."""

    def __init__(self, most: int):
        self.most = most // 2
        self.held = 0
        self.now: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def known(self, keys: set[str]) -> dict[str, bytes]:
        """Those of keys that are there, with their values."""
        get, older = self.now.get, self.older.get
        found = {k: v for k in keys if (v := get(k)) is not None}
        if self.older:
            again = {k: v for k in keys - found.keys() if (v := older(k)) is not None}
            self.add(again)
            found.update(again)
        return found

    def add(self, entries: dict[str, bytes]) -> None:
        if max(map(len, entries), default=0) > LONGEST_MEMO:
            entries = {k: v for k, v in entries.items() if len(k) <= LONGEST_MEMO}
        size = len(entries) * ENTRY + sum(map(len, entries)) + sum(map(len, entries.values()))
        if self.held + size > self.most:
            self.now, self.older, self.held = {}, self.now, 0
        self.now.update(entries)
        self.held += size
