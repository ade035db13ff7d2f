"""Streamed chunks, and saved states in the sectioned binary."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from tensorspark.functions.factors import from_dense, integer_factor_array
from tensorspark.functions.morton import MortonPlan
from tensorspark.operators import blocked
from tensorspark.operators import mttkrp as mt
from tensorspark.operators.mttkrp import mttkrp_all_arrow
from tensorspark.sources import dnp
from tensorspark.sources.dnb import append_frame, write_frame
from tensorspark.sources.reader import read_tensor
from tensorspark.streaming import chunks
from tensorspark.streaming.chunks import StreamedSums, _StreamReader, stream_chunks
from tensorspark.tensor import SparseTensor

SIZES = (30, 20, 7)


def nonzeros(spark, seed, n=500):
    rng = np.random.default_rng(seed)
    rows = [(*map(int, r), float(rng.integers(1, 6))) for r in rng.integers(0, SIZES, (n, 3))]
    return spark.createDataFrame(rows, "i0 long, i1 long, i2 long, val double")


def arrays():
    return [integer_factor_array(s, n, 3) for n, s in enumerate(SIZES)]


def want(frame):
    return sorted(map(tuple, mttkrp_all_arrow(SparseTensor.from_frame(frame, SIZES), arrays(), 3).collect()))


def got(out):
    return sorted(map(tuple, out.select("mode", "i", "y0", "y1", "y2").collect()))


# ---- streams -----------------------------------------------------------------


def test_a_restart_neither_loses_nor_repeats_a_chunk(spark, tmp_path):
    path, folder = str(tmp_path / "t.dnb"), str(tmp_path / "state")
    first, second, third = (nonzeros(spark, k) for k in (1, 2, 3))
    write_frame(first, 3, path, SIZES)
    sums = StreamedSums(path, arrays(), 3, folder)
    assert got(sums.run(spark, 64)) == want(first)
    assert got(sums.run(spark, 64)) == want(first)  # nothing new
    append_frame(second, 3, path)
    assert got(StreamedSums(path, arrays(), 3, folder).run(spark, 100)) == want(first.union(second))

    class Fails(StreamedSums):
        """Dies after a batch is written and before it is committed."""

        def add(self, batch, number):
            super().add(batch, number)
            raise OSError("driver lost")

    append_frame(third, 3, path)
    with pytest.raises(Exception, match="driver lost"):
        Fails(path, arrays(), 3, folder).run(spark, 64)
    again = StreamedSums(path, arrays(), 3, folder)
    assert got(again.run(spark, 64)) == want(first.union(second).union(third))
    assert len(again._numbers()) == 2


def test_a_batch_that_dies_before_its_sums_is_read_again(spark, tmp_path):
    path, folder = str(tmp_path / "t.dnb"), str(tmp_path / "state")
    write_frame(nonzeros(spark, 4), 3, path, SIZES)

    class Fails(StreamedSums):
        def add(self, batch, number):
            raise OSError("driver lost")

    with pytest.raises(Exception, match="driver lost"):
        Fails(path, arrays(), 3, folder).run(spark)
    assert got(StreamedSums(path, arrays(), 3, folder).run(spark)) == want(nonzeros(spark, 4))


@pytest.mark.parametrize("limit", [0, 1000])
@pytest.mark.parametrize("frames", [True, False])
def test_large_factors_travel_to_batches(spark, tmp_path, monkeypatch, limit, frames):
    """Factors beyond the limits, all by demand or only the largest; a batch adds to the last."""
    path, folder = str(tmp_path / "t.dnb"), str(tmp_path / "state")
    first, second = nonzeros(spark, 7), nonzeros(spark, 8)
    wanted = want(first), want(first.union(second))
    monkeypatch.setattr(mt, "BROADCAST_BYTES", 8)  # none could be sent whole before
    monkeypatch.setattr(chunks, "COLLECT_BYTES", limit, raising=False)
    monkeypatch.setattr(blocked.mttkrp_all_blocked, "__defaults__", (limit,))
    factors = [from_dense(spark, a) for a in arrays()] if frames else arrays()
    write_frame(first, 3, path, SIZES)
    assert got(StreamedSums(path, factors, 3, folder).run(spark, 64)) == wanted[0]
    append_frame(second, 3, path)
    assert got(StreamedSums(path, factors, 3, folder).run(spark, 30)) == wanted[1]


def test_offsets_count_nonzeros(spark, tmp_path):
    path = str(tmp_path / "t.dnb")
    write_frame(nonzeros(spark, 5).coalesce(1), 3, path, SIZES)
    append_frame(nonzeros(spark, 6, 100).coalesce(1), 3, path)
    reader = _StreamReader(path, stream_chunks(spark, path).schema, 200)
    assert reader.latestOffset() == {"nnz": 600}
    counts = [(p.first, p.count) for p in reader.partitions({"nnz": 450}, {"nnz": 590})]
    assert counts == [(450, 50), (0, 90)]
    assert reader.partitions({"nnz": 600}, {"nnz": 600}) == []
    with pytest.raises(ValueError, match="seen before"):
        reader.partitions({"nnz": 0}, {"nnz": 700})


def test_small_chunks_share_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunks, "TASKS", 10, raising=False)
    path = str(tmp_path / "t.dnb")
    write_frame(nonzeros(spark, 5).coalesce(1), 3, path, SIZES)
    reader = _StreamReader(path, stream_chunks(spark, path).schema, 7)
    tasks = reader.partitions({"nnz": 3}, {"nnz": 500})
    assert len(tasks) <= 10 and tasks[0].first == 3
    batches = [b for t in tasks for b in reader.read(t)]
    assert {b.num_rows for b in batches[:-1]} == {7} and batches[-1].num_rows <= 7
    whole = _StreamReader(path, stream_chunks(spark, path).schema, None)
    (one,) = whole.partitions({"nnz": 0}, {"nnz": 500})
    rows = [r for b in whole.read(one) for r in b.to_pylist()]
    assert [r for b in batches for r in b.to_pylist()] == rows[3:]


# ---- saved states ------------------------------------------------------------


def header(layout, nnz, sizes=SIZES, **change):
    given = dict(magic=b"DNP1", version=1, value=4, index=4) | change
    full = [*sizes, *[0] * (8 - len(sizes))]
    return struct.pack(
        dnp.HEADER, given["magic"], given["version"], given["value"], given["index"], layout,
        len(sizes), nnz, *full, 3, 12.5, *[0] * 14,
    )


def schedule(modes):
    """Sections of three threads, of lengths that differ."""
    out = struct.pack(dnp.SLAB_HEAD, *[1] * 16, *[-2] * 8, 5, *[0.5] * 8, *[1] * 8, -1, 9)
    for n in range(modes):
        out += struct.pack("<QQ", n, n) + b"b" * n
    for n in range(modes):
        out += struct.pack("<Q", n + 1) + b"s" * (16 * (n + 1))
    for n in range(modes):
        out += struct.pack("<Q", 3)
        for t in range(3):
            out += struct.pack("<Q", t) + b"t" * (8 * t)
    for n in range(modes):
        out += struct.pack("<Q", 2 * n) + b"o" * (16 * n)
    return out


def state(layout, idx, val):
    body = b"".join([val.astype("<f4").tobytes(), *[i.astype("<u4").tobytes() for i in idx]])
    head = header(layout, len(val))
    if layout == dnp.KEYS:
        plan = MortonPlan.of(SIZES)
        keys = np.zeros(len(val), np.uint64)
        for i, places in zip(idx, plan.positions):
            for b, place in enumerate(places):
                keys |= (i.astype(np.uint64) >> np.uint64(b) & np.uint64(1)) << np.uint64(place)
        masks, bits = [*plan.masks, *[0] * 5], [*plan.bits, *[0] * 5]
        return head + struct.pack(dnp.KEY_HEAD, *masks, *bits) + keys.tobytes() + val.astype("<f4").tobytes()
    if layout == dnp.COPIES:
        flags = struct.pack(dnp.COPY_FLAGS, *[0] * 8, *[0, 1, 1, 0, 0, 0, 0, 0])
        starts = [b"", b"r" * (8 * (SIZES[1] + 1)), b"r" * (8 * (SIZES[2] + 1))]
        others = b"x" * len(body)
        return head + schedule(3) + flags + body + others + starts[1] + others + starts[2]
    return head + schedule(3) + body


@pytest.mark.parametrize("layout", [dnp.KEYS, dnp.COPIES, dnp.TWO_BUFFERS, dnp.ONE_BUFFER])
def test_saved_states_open_as_tensors(spark, tmp_path, layout):
    assert dnp.HEADER_BYTES == 132
    rng = np.random.default_rng(layout)
    idx = [rng.integers(0, s, 700) for s in SIZES]
    val = rng.integers(1, 9, 700).astype(float)
    path = tmp_path / "s.dnp"
    raw = state(layout, idx, val)
    path.write_bytes(raw)
    t = read_tensor(spark, f"file:{path}", chunk_nnz=300)
    assert t.mode_sizes == SIZES and t.nnz == 700 and t.df.rdd.getNumPartitions() == 3
    rows = sorted(tuple(r) for r in t.df.collect())
    assert rows == sorted(zip(*[i.tolist() for i in idx], val.tolist()))
    assert dnp.DnpState.read(str(path)).norm_sq == 12.5
    for cut in (len(raw) - 1, 500 if layout else 250, 100):
        path.write_bytes(raw[:cut])
        with pytest.raises(ValueError, match="truncated"):
            dnp.DnpState.read(str(path))


@pytest.mark.parametrize(
    "raw,message",
    [
        (header(2, 5, magic=b"DNB1"), "magic"),
        (header(2, 5, version=2), "version"),
        (header(2, 5, value=8), "bytes"),
        (header(9, 5), "layout"),
        (header(2, 0), "nonzeros"),
        (header(2, 5, ()), "modes"),
        (header(0, 1) + struct.pack(dnp.KEY_HEAD, 31, 31 << 4, 0, *[0] * 13) + b"0" * 12, "masks"),
    ],
)
def test_bad_states_fail_clearly(tmp_path, raw, message):
    path = tmp_path / "bad.dnp"
    path.write_bytes(raw)
    with pytest.raises(ValueError, match=message):
        dnp.DnpState.read(str(path))
