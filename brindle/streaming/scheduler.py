"""When to take a snapshot: after a time, or once the log has grown; never on a follower."""

from __future__ import annotations

import time
from collections.abc import Callable

from ..sources.changelog import ChangeLog

#: A quarter of an hour, 50 MiB, and half a minute between looks.
EVERY_SECONDS, GROWTH_BYTES, POLL_SECONDS = 900, 50 << 20, 30
ROLES = ("standalone", "leader", "follower")


class SnapshotScheduler:
    def __init__(self, log: ChangeLog, role: str = "standalone", every: float = EVERY_SECONDS, growth: int = GROWTH_BYTES, clock: Callable[[], float] = time.monotonic):
        if role not in ROLES:
            raise ValueError(f"role must be one of {ROLES}")
        self.log, self.role, self.every, self.growth, self.clock = log, role, every, growth, clock
        self.last_time, self.last_bytes = clock(), self.log_bytes()

    def log_bytes(self) -> int:
        fs, p = self.log._fs(f"{self.log.path}/log")
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def due(self) -> bool:
        if self.role == "follower":
            return False
        return self.clock() - self.last_time >= self.every or self.log_bytes() - self.last_bytes >= self.growth

    def tick(self) -> int | None:
        """Takes a snapshot if one is due; its seq, or None."""
        if not self.due() or self.log.head() < 0:
            return None
        seq = self.log.snapshot()
        self.last_time, self.last_bytes = self.clock(), self.log_bytes()
        return seq

    def run(self, rounds: int | None = None, poll: float = POLL_SECONDS, sleep: Callable[[float], None] = time.sleep) -> None:
        """Looks again and again; forever without rounds."""
        n = 0
        while rounds is None or n < rounds:
            self.tick()
            sleep(poll)
            n += 1
