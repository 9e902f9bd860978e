"""Workers that stay give their free memory back."""

import os

from kmerloom.llm.arrowmap import tidy


def resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE") / 1e6


def test_memory_goes_back_after_a_task():
    def run(batches):
        held = [bytes(2000) for _ in range(150_000)]
        kept.append(held[-1])  # the last one pins what lies before it
        yield from batches

    kept: list[bytes] = []
    before = resident_mb()
    assert list(tidy(run)([1, 2])) == [1, 2]
    assert resident_mb() < before + 100
