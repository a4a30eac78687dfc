"""What a task's Python worker holds at a time."""

import tracemalloc

import numpy as np

from burnwatch.llm import suffix_dedup, worker_memory


def test_anchors_of_the_largest_buffer_take_little_room():
    buffer = np.random.default_rng(3).integers(97, 123, 2 * suffix_dedup.CHUNK - 200).astype(np.uint8)
    half = len(buffer) // 2
    tracemalloc.start()
    try:
        piece, *_ = suffix_dedup.anchors([buffer[:half], buffer[half:]], 200)
        _, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert set(piece) == {0, 1}
    assert most < 100 << 20
    assert suffix_dedup._UP.nbytes + suffix_dedup._DOWN.nbytes <= 16 << 20


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_release_gives_free_memory_back():
    small = [bytes(900) for _ in range(200_000)]
    spread = small[::400]  # keeps the heap from shrinking at its end
    del small
    before = resident()
    worker_memory.release()
    assert before - resident() > 50 << 20
    assert len(spread) == 500
