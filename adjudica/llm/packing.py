"""Sum-of-squares packing of tokenised documents into windows."""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from adjudica.llm.bpe import encode_column
from adjudica.llm.columns import id_and_text, map_batches

#: Sequence ids of one task start at its number times this.
TASK_STRIDE = 1 << 40
#: Tokens handed to Spark in one batch.
BATCH_TOKENS = 2_000_000


class SumOfSquares:
    """Places one item after another into windows of ``size``.

    ``levels[h]`` counts the open windows filled up to h. An item of length s goes to the level h, or
    to a new window (h = 0), for which the sum of squared counts of partially filled windows becomes
    least; ties go to the fullest window. Each level keeps its windows on a stack.
    """

    def __init__(self, size: int):
        self.size = size
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.windows: list[list[int]] = [[] for _ in range(size)]

    def place(self, length: int, new_window) -> tuple[int, int]:
        """(window, offset) for an item of 0 < length < size."""
        size, levels = self.size, self.levels
        start = np.flatnonzero(levels[1 : size - length + 1]) + 1
        # Leaving level h changes the sum by 1 - 2 n(h), reaching h + s by 2 n(h + s) + 1; a full
        # window counts no more.
        gained = np.where(start + length == size, 0, 2 * levels[start + length] + 1)
        change = 1 - 2 * levels[start] + gained
        best = len(start) - 1 - int(np.argmin(change[::-1])) if len(start) else -1
        if best < 0 or change[best] > 2 * levels[length] + 1:
            window, offset = new_window(), 0
        else:
            offset = int(start[best])
            window = self.windows[offset].pop()
            levels[offset] -= 1
        if offset + length < size:
            levels[offset + length] += 1
            self.windows[offset + length].append(window)
        return window, offset


def _pack_task(batches, vocabulary: str, end_id: int, size: int):
    """Pieces (doc_id, start, ids, doc_tokens, sequence_id, offset, placed) of one task's documents."""
    packer = SumOfSquares(size)
    base = TaskContext.get().partitionId() * TASK_STRIDE
    used = 0
    open_pieces: dict[int, list[tuple]] = {}
    end = end_id.to_bytes(4, "little")

    def new_window() -> int:
        nonlocal used
        used += 1
        return base + used - 1

    for batch in batches:
        for doc_id, ids in zip(batch["doc_id"], encode_column(batch["text"], vocabulary)):
            ids += end
            total = len(ids) // 4
            whole = total - total % size
            for start in range(0, whole, size):
                yield doc_id, start, ids[4 * start : 4 * (start + size)], total, new_window(), 0, True
            if whole < total:
                window, offset = packer.place(total - whole, new_window)
                piece = (doc_id, whole, ids[4 * whole :], total)
                if offset + total - whole == size:
                    filled = 0
                    for kept in [*open_pieces.pop(window, []), piece]:
                        yield *kept, window, filled, True
                        filled += len(kept[2]) // 4
                else:
                    open_pieces.setdefault(window, []).append(piece)

    yield from _close(list(open_pieces.items()), size, new_window)


def _close(open_windows: list[tuple[int, list[tuple]]], size: int, new_window):
    """Pieces of the windows that are open at the end; all keep their place but those of donors.

    As many of the fullest windows stay as all open tokens can fill. The others are donors: their
    pieces, those of the emptiest first, are cut to fill the rooms of the windows that stay, which
    moves the fewest tokens that padding nothing allows. What remains, less than a window, is cut
    into powers of two.
    """
    fills = {window: sum(len(piece[2]) // 4 for piece in pieces) for window, pieces in open_windows}
    order = sorted(open_windows, key=lambda found: (fills[found[0]], found[0]))
    donors = len(order) - sum(fills.values()) // size
    given = [piece for _, pieces in order[:donors] for piece in pieces][::-1]

    def give(window: int, at: int, end: int):
        while at < end:
            doc_id, start, ids, total = given.pop()
            taken = ids[: 4 * (end - at)]
            count = len(taken) // 4
            if len(taken) < len(ids):
                given.append((doc_id, start + count, ids[len(taken) :], total))
            yield doc_id, start, taken, total, window, at, False
            at += count

    for window, pieces in order[donors:]:
        at = 0
        for piece in pieces:
            yield *piece, window, at, True
            at += len(piece[2]) // 4
        yield from give(window, at, size)
    while left := sum(len(piece[2]) // 4 for piece in given):
        yield from give(new_window(), 0, 1 << (left.bit_length() - 1))


def pack_documents(
    docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = 1024
) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of at most ``size`` tokens.

    A document is its ids in ``vocabulary`` followed by ``end_id``. Whole windows are cut off its
    front; the tail is placed by the sum of squares among the windows of its task. At the end of a
    task the emptiest of its open windows are cut to fill the others, so that a task pads nothing:
    sequences are full or a power of two long.

    Returns doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset and
    placed: whether the piece stands where the sum of squares put it (whole windows do).
    Null text counts as empty: one piece holding the end id. Null ids stay null, repeated rows are
    packed each, an empty table gives no piece. The plan has no shuffle; a lost task packs its rows
    again to the same pieces. Memory: the pieces of a task's open windows.
    """

    names = ("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "placed")

    def work(batches):
        rows, tokens = [], 0
        for piece in _pack_task(batches, vocabulary, end_id, size):
            rows.append(piece)
            tokens += len(piece[2]) // 4
            if tokens >= BATCH_TOKENS:
                yield dict(zip(names, map(list, zip(*rows))))
                rows, tokens = [], 0
        if rows:
            yield dict(zip(names, map(list, zip(*rows))))

    return map_batches(
        id_and_text(docs),
        work,
        "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, placed boolean",
    )
