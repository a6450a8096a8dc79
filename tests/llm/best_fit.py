"""Best-fit decreasing one length after the other, as the brute force for packing."""

from bisect import bisect_left, insort

CAPACITY = 1024


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go: (length, first rank, past the last rank, first sequence, pieces per sequence, offset).

    counts: the number of pieces of each length. Piece r of a range goes to sequence first + (r - first rank) // per.
    """
    moves: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # by what is left: ranges of sequences
    sizes: list[int] = []
    opened = 0

    def put_back(left: int, first: int, past: int) -> None:
        if left > 0 and past > first:
            if left not in gaps:
                gaps[left] = []
                insort(sizes, left)
            gaps[left].append((first, past))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                first, past = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size]
                    sizes.pop(at)
            else:
                size, first = capacity, opened
                past = opened = first + -(-(total - rank) // (capacity // length))
            each = size // length
            full = min(past - first, (total - rank) // each)
            if full:
                moves.append((length, rank, rank + full * each, first, each, capacity - size))
                rank += full * each
                put_back(size - each * length, first, first + full)
                first += full
            if first < past and rank < total:  # fewer are left than one gap takes
                moves.append((length, rank, total, first, each, capacity - size))
                put_back(size - (total - rank) * length, first, first + 1)
                rank, first = total, first + 1
            put_back(size, first, past)
    return moves


def sequences(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """How many sequences best-fit decreasing needs."""
    return max((first + -(-(past - low) // each) for _, low, past, first, each, _ in sweep(counts, capacity)), default=0)
