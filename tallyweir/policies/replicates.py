"""Many runs of the replicate policy at once: the state of a bucket is an array over the runs, and a packet is one step for all.

Runs differ by their seed alone, so they see the same packets, and differ only in which flow holds a bucket. The draws are
those of the counter generator, so each run gives what a simulation by itself does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tallyweir.policies.engine import Settings, packet_stream

# The increment and the multipliers of the counter generator.
STEP, FIRST, SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def absorbed(z: np.ndarray, part) -> np.ndarray:
    """The generator's state after one more part of a place."""
    z = (z ^ np.asarray(part, np.uint64)) + STEP
    z = (z ^ z >> np.uint64(30)) * FIRST
    z = (z ^ z >> np.uint64(27)) * SECOND
    return z ^ z >> np.uint64(31)


class Bucket:
    """A bucket in each run: who holds it (-1: nobody), packets held, last second, and the UDP keys that were let in."""

    def __init__(self, group: tuple[int, int], seeds: np.ndarray):
        n = len(seeds)
        self.holder, self.count, self.last, self.udp = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        self.drawn = np.zeros(n, np.uint64)
        self.place = absorbed(absorbed(seeds, group[0]), group[1])
        self.numbers: dict[tuple, int] = {}
        self.known: dict[int, np.ndarray] = {}

    def heads(self, which: np.ndarray) -> np.ndarray:
        """An even draw, of the chosen runs."""
        z = absorbed(self.place[which], self.drawn[which])
        self.drawn[which] += np.uint64(1)
        out = np.zeros(len(which), bool)
        out[which] = (z >> np.uint64(32)) % np.uint64(2) == 0
        return out


def capped_runs(settings: Settings, runs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A fold over packets by bucket, in order: (run, name, value) with the flows that reached the cap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.arange(runs, dtype=np.uint64) + np.uint64(settings.seed & 0xFFFFFFFFFFFFFFFF)
        full, state, at = np.zeros(runs, np.int64), None, None
        for group, p in packet_stream(batches):
            if group != at:
                at, state = group, Bucket(group, seeds)
            b, now = state, p.second
            k = b.numbers.setdefault(p.key, len(b.numbers))
            b.holder[b.udp & (b.holder >= 0) & (now - b.last >= settings.idle)] = -1
            mine = b.holder == k
            if p.udp or p.syn:
                empty = b.holder < 0
                won = b.heads(~(empty | mine))
                takes = empty | won
                if p.udp:
                    known = b.known.setdefault(k, np.zeros(runs, bool))
                    takes, known[:] = takes & ~known, known | takes
                b.holder[takes], b.count[takes], b.udp[takes] = k, 0, p.udp
                mine |= takes
            b.count[mine] += 1
            b.last[mine] = now
            done = mine & (b.count == settings.cap)
            full += done
            b.holder[done] = -1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(runs)), pa.array(["flows_cap"] * runs, pa.string()), pa.array(full)], names=["run", "name", "value"])

    return run
