"""Live snapshots: pinned sequence numbers, which compaction must keep readable."""

from __future__ import annotations

from collections import Counter


class Snapshots:
    """Ascending sequence numbers; one that is taken twice is released twice."""

    def __init__(self) -> None:
        self._held: Counter[int] = Counter()

    def acquire(self, seq: int) -> int:
        if self._held and seq < max(self._held):
            raise ValueError("a snapshot can't be older than the newest")
        self._held[seq] += 1
        return seq

    def release(self, seq: int) -> None:
        if self._held[seq] <= 1:
            del self._held[seq]
        else:
            self._held[seq] -= 1

    def oldest(self, last_sequence: int) -> int:
        """What every reader sees at least: the oldest snapshot, or all there is."""
        return min(self._held, default=last_sequence)

    def newest(self) -> int | None:
        return max(self._held, default=None)

    def __len__(self) -> int:
        return len(self._held)
