"""How many workers a job gets, and a pacer for a steady rate."""

from __future__ import annotations

import os
from dataclasses import dataclass


def cpu_budget(requested: int | None = None, on_host: bool = False, cpus: int | None = None) -> int:
    """Half the CPUs where the brokers run too, else all but one."""
    have = cpus if cpus is not None else (os.cpu_count() or 1)
    most = max(1, have // 2 if on_host else have - 1)
    if requested is None:
        return most
    if not 1 <= requested <= most:
        raise ValueError(f"{requested} workers wanted, {most} at most")
    return requested


def processes(partitions: int, requested: int | None = None, per_process: int = 1, on_host: bool = False, cpus: int | None = None) -> int:
    """No more processes than CPUs, nor than there are partitions for each one's workers."""
    if partitions < 1 or per_process < 1:
        raise ValueError("at least one partition and one worker")
    most = min(cpu_budget(None, on_host, cpus), max(1, partitions // per_process))
    if requested is not None and not 1 <= requested <= most:
        raise ValueError(f"{requested} processes wanted, {most} at most")
    return requested or most


@dataclass
class TokenBucket:
    """Admits n items at a time at a steady rate; starts full; no rate means no pace."""

    rate: float | None
    burst: int = 4096
    now: float = 0.0

    def __post_init__(self):
        self.tokens = float(self.burst)

    def wait(self, n: int, now: float) -> float:
        """Seconds to wait before n items may go at time now."""
        if n > self.burst:
            raise ValueError(f"{n} is more than a burst of {self.burst}")
        if self.rate is None:
            return 0.0
        self.tokens = min(float(self.burst), self.tokens + (now - self.now) * self.rate)
        self.now = now
        self.tokens -= n
        return max(0.0, -self.tokens / self.rate)


def transactional_id(group: str, ordinal: int) -> str:
    if not group or ordinal < 0:
        raise ValueError("a group and an ordinal from 0")
    return f"{group}-{ordinal}"
