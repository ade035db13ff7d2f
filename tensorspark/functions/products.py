"""Products of factor rows, shared by the outputs of several modes, and their sums.

Tables and sums are held by component: ``R`` rows of one value for each index.  A component
of a factor then stays in cache while the nonzeros of a chunk read it, and every step is one
NumPy call over thousands of nonzeros.  For all modes at once, the products of the factors
before and after each mode are built up once and shared: ``3 N - 4`` multiplications for a
nonzero and component, where one pass for each mode takes ``N (N - 1)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa

from tensorspark.functions.factors import factor_columns
from tensorspark.plans.strategy import SUM_BYTES

# Nonzeros that one call handles: buffers of half a megabyte.
STEP = 1 << 16
# Bits of an index inside a piece; a piece of an output is summed up by itself.
PIECE_BITS = 12
PIECES = "mode int, piece bigint, i binary, y binary"


def add_products(
    at: Sequence[np.ndarray],
    val: np.ndarray,
    tables: Sequence[np.ndarray | None],
    sums: Mapping[int, np.ndarray],
    to: Mapping[int, np.ndarray] | None = None,
) -> int:
    """Adds ``val * prod_{w != n} tables[w][:, at[w]]`` to ``sums[n]`` for each ``n`` of sums.

    ``to[n]`` gives the places in ``sums[n]``, by default ``at[n]``.  Returns the number of
    vector multiplications for each nonzero and component.
    """
    num_modes, targets = len(at), sorted(sums)
    needed = [w for w in range(num_modes) if targets != [w]]
    first, last = targets[0], targets[-1]
    rank = next(iter(sums.values())).shape[0]
    size = min(STEP, len(val))
    rows = {w: np.empty(size) for w in needed}
    after = {n: np.empty(size) for n in range(first, num_modes - 2)}
    before, term = np.empty(size), np.empty(size)
    val = val.astype(np.float64)  # a copy: buffers of rows are unaligned
    places = {w: x.astype(np.intp) for w, x in enumerate(at)}
    places |= {("to", n): (to or {}).get(n, places[n]) for n in targets}
    steps = [slice(lo, min(lo + STEP, len(val))) for lo in range(0, len(val), STEP)]
    cut = [(val[s], {w: x[s] for w, x in places.items()}) for s in steps]
    count = 0
    for r in range(rank):  # outside: one component of tables and sums stays in cache
        for v, place in cut:
            k, count = len(v), 0
            part = {
                w: np.take(tables[w][r], place[w], out=rows[w][:k], mode="clip") for w in needed
            }
            # Products of the factors after each mode, from the last one down.
            behind = {num_modes - 2: part.get(num_modes - 1)}
            for n in range(num_modes - 3, first - 1, -1):
                behind[n] = np.multiply(part[n + 1], behind[n + 1], out=after[n][:k])
                count += 1
            ahead = v
            for n in range(last + 1):
                if n in sums:
                    product = ahead
                    if n < num_modes - 1:
                        product = np.multiply(ahead, behind[n], out=term[:k])
                        count += 1
                    np.add.at(sums[n][r], place["to", n], product)
                if n < last:
                    ahead = np.multiply(ahead, part[n], out=before[:k])
                    count += 1
    return count


class TaskSums:
    """Output pieces of one task: ``[mode, piece, i, y]``, with rows as raw buffers.

    A mode whose sums fit the budget is kept to the end; a larger one is summed and sent
    chunk by chunk, so memory never grows with the mode.
    """

    def __init__(self, mode_sizes: Sequence[int], rank: int, modes: Sequence[int]):
        self.modes, self.rank = list(modes), rank
        self.kept: dict[int, np.ndarray] = {}
        self.touched: dict[int, np.ndarray] = {}
        budget = SUM_BYTES
        for n in self.modes:
            need = mode_sizes[n] * rank * 8
            if need <= budget:
                budget -= need
                self.kept[n] = np.zeros((rank, mode_sizes[n]))
                self.touched[n] = np.zeros(mode_sizes[n], dtype=bool)

    def add(
        self, idx: Sequence[np.ndarray], val: np.ndarray, tables: Sequence[np.ndarray | None]
    ) -> Iterator[pa.RecordBatch]:
        """Adds one chunk; yields the pieces of the modes that are not kept."""
        sums, to, ids = dict(self.kept), {}, {}
        for n in self.modes:
            if n in self.kept:
                self.touched[n][idx[n]] = True
            else:
                ids[n], to[n] = np.unique(idx[n], return_inverse=True)
                sums[n] = np.zeros((self.rank, len(ids[n])))
        add_products(idx, val, tables, sums, to)
        for n, i in ids.items():
            yield from pieces_of(n, i, sums[n])

    def finish(self) -> Iterator[pa.RecordBatch]:
        for n, sums in self.kept.items():
            for lo in range(0, sums.shape[1], STEP):  # whole pieces, and no second copy of all
                i = lo + np.flatnonzero(self.touched[n][lo : lo + STEP])
                yield from pieces_of(n, i, sums[:, i])


def pieces_of(mode: int, i: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of pieces; ``i`` is ascending and ``sums`` has a column for each."""
    piece = i.astype(np.int64) >> PIECE_BITS
    cuts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True]) if len(i) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield pa.record_batch(
            [
                pa.array([mode], pa.int32()),
                pa.array([piece[lo]], pa.int64()),
                pa.array([i[lo:hi].astype("<i8").tobytes()], pa.binary()),
                pa.array([np.ascontiguousarray(sums[:, lo:hi].T).tobytes()], pa.binary()),
            ],
            names=["mode", "piece", "i", "y"],
        )


def read_pieces(
    batches: Iterator[pa.RecordBatch], rank: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Mode, piece, indices and rows of each piece."""
    for batch in batches:
        heads = zip(batch.column("mode").to_pylist(), batch.column("piece").to_pylist())
        for k, (mode, piece) in enumerate(heads):
            i = np.frombuffer(batch.column("i")[k].as_buffer(), "<i8")
            y = np.frombuffer(batch.column("y")[k].as_buffer(), "<f8")
            yield mode, piece, i, y.reshape(-1, rank)


def rows_schema(rank: int) -> str:
    return ", ".join(["mode int", "i bigint", *[f"{c} double" for c in factor_columns(rank, "y")]])


def add_pieces(batches: Iterator[pa.RecordBatch], rank: int) -> Iterator[pa.RecordBatch]:
    """Rows ``[mode, i, y0 ..]`` of pieces that come in order of mode and piece."""
    of, size = None, 1 << PIECE_BITS
    sums, touched = np.zeros((size, rank)), np.zeros(size, dtype=bool)

    def rows() -> pa.RecordBatch:
        place = np.flatnonzero(touched)
        columns = np.ascontiguousarray(sums[place].T)
        head = [np.full(len(place), of[0], np.int32), place + (of[1] << PIECE_BITS)]
        return pa.record_batch(
            [pa.array(c) for c in (*head, *columns)], names=["mode", "i", *factor_columns(rank, "y")]
        )

    for mode, piece, i, y in read_pieces(batches, rank):
        if of != (mode, piece):
            if of:
                yield rows()
            of = mode, piece
            sums[:], touched[:] = 0.0, False
        place = i - (piece << PIECE_BITS)  # distinct within a piece of one task's chunk
        sums[place] += y
        touched[place] = True
    if of:
        yield rows()
