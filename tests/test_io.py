from __future__ import annotations

import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs as pafs

from tensorspark.functions.factors import from_dense, random_factor_array, to_dense
from tensorspark.sources import dnb, factor_files, files
from tensorspark.sources.dnb import (
    HEADER_BYTES,
    DnbHeader,
    export_file,
    read_chunk,
    read_dnb,
    read_parts,
    write_dnb,
)
from tensorspark.sources.reader import read_tensor
from tensorspark.sources.tns import read_tns, write_tns
from tensorspark.tensor import SparseTensor

DATA = os.path.join(os.path.dirname(__file__), "data")
TINY = os.path.join(DATA, "tiny_3mode.tns")


def rows(tensor: SparseTensor) -> list[tuple]:
    return sorted(tuple(r) for r in tensor.df.collect())


def read(spark, tmp_path, text: str) -> SparseTensor:
    path = tmp_path / "x.tns"
    path.write_bytes(text.encode())
    return read_tns(spark, str(path))


def test_tiny(spark):
    t = read_tns(spark, TINY)
    assert t.mode_sizes == (4, 4, 3)
    assert (t.nnz, t.norm_sq) == (9, 304.0)
    assert rows(t)[0] == (0, 0, 0, 1.0)
    assert rows(t)[-1] == (3, 0, 1, 5.0)


def test_comments_blank_lines_crlf_and_no_final_newline(spark, tmp_path):
    t = read(spark, tmp_path, "# head\r\n\r\n1 1  2\r\n  # mid\r\n\t2 3 -1.5e1 \r\n3 1 0")
    assert rows(t) == [(0, 0, 2.0), (1, 2, -15.0), (2, 0, 0.0)]
    assert t.mode_sizes == (3, 3)


def test_header_sizes_are_kept_and_widened(spark, tmp_path):
    assert read(spark, tmp_path, "3\n9 9 9\n1 2 3 4\n").mode_sizes == (9, 9, 9)
    t = read(spark, tmp_path, "3\n1 1 1\n1 2 3 4\n")
    assert t.mode_sizes == (1, 2, 3) and rows(t) == [(0, 1, 2, 4.0)]


def test_duplicates_are_kept(spark, tmp_path):
    t = read(spark, tmp_path, "1 1 2\n1 1 3\n2 2 1\n")
    assert (t.nnz, t.norm_sq) == (3, 14.0)
    c = t.combined()
    assert (c.nnz, c.norm_sq) == (2, 26.0)


def test_number_spellings(spark, tmp_path):
    t = read(spark, tmp_path, "+1 2 +3.5\n2 1 .5\n3 3 -1E-2\n")
    assert rows(t) == [(0, 1, 3.5), (1, 0, 0.5), (2, 2, -0.01)]


def test_fractional_index_is_truncated(spark, tmp_path):
    assert rows(read(spark, tmp_path, "1.9 2.2 5\n")) == [(0, 1, 5.0)]


@pytest.mark.parametrize(
    "text",
    [
        "",
        "# nothing\n",
        "0 1 2\n",
        "-3 1 2\n",
        "1 1 1\n1 1 1 1\n",
        "1 1 1 1\n1 1 1\n",
        "1 x 1\n",
        "1 1 1.0d\n",
        "3\n4 4 4\n1 1 1 1\n2 2 2\n",
        "1 1 1 1 1 1 1 1 1 1\n",
    ],
)
def test_malformed_text_fails(spark, tmp_path, text):
    with pytest.raises(Exception):
        rows(read(spark, tmp_path, text))


@pytest.mark.parametrize("modes", [1, 2, 5, 8])
def test_mode_counts(spark, tmp_path, modes):
    t = read(spark, tmp_path, " ".join(["2"] * modes) + " 7\n")
    assert t.mode_sizes == (2,) * modes and rows(t) == [(1,) * modes + (7.0,)]


def test_tns_round_trip(spark, tmp_path):
    t = read_tns(spark, TINY)
    write_tns(t, str(tmp_path / "out"))
    assert rows(read_tns(spark, str(tmp_path / "out"))) == rows(t)


def test_tns_digits(spark, tmp_path):
    t = read(spark, tmp_path, "1 1 0.1\n1 2 1e20\n2 1 3\n")
    write_tns(t, str(tmp_path / "out"), one_indexed=False)
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["0 0 0.1", "0 1 1e+20", "1 0 3"]


def test_dnb_parts_and_single_file(spark, tmp_path):
    t = read_tns(spark, TINY)
    folder, single = str(tmp_path / "t.parts"), str(tmp_path / "t.dnb")
    write_dnb(t, folder)
    back = read_dnb(spark, folder)
    assert rows(back) == rows(t) and back.mode_sizes == t.mode_sizes
    head = export_file(spark, folder, single)
    assert HEADER_BYTES == 88
    assert os.path.getsize(single) == 88 + 9 * 4 * 4
    assert head == DnbHeader.read(single) and head.nnz == 9
    assert rows(read_tensor(spark, single)) == rows(t)
    assert read_parts(single)[1] == (4, 4, 3)


def test_dnb_hand_made_file_and_chunks(spark, tmp_path):
    path = str(tmp_path / "h.dnb")
    n = 1000
    rng = np.random.default_rng(1)
    idx = [rng.integers(0, s, n).astype("<u4") for s in (50, 7)]
    val = rng.standard_normal(n).astype("<f4")
    with open(path, "wb") as f:
        f.write(DnbHeader(2, n, (60, 7)).pack())
        for c in (val, *idx):
            c.tofile(f)
    t = read_dnb(spark, path, chunk_nnz=300)
    assert t.df.rdd.getNumPartitions() == 4
    assert t.mode_sizes == (60, 7) and t.nnz == n
    want = sorted(zip(idx[0].tolist(), idx[1].tolist(), val.astype(float).tolist()))
    assert rows(t) == want


def test_dnb_rejects_bad_files(tmp_path):
    path = tmp_path / "bad.dnb"
    good = DnbHeader(2, 1, (1, 1)).pack()
    for raw in (b"", b"XXXX" + good[4:], good, DnbHeader(2, 0, (1, 1)).pack()):
        path.write_bytes(raw)
        with pytest.raises(ValueError):
            DnbHeader.read(str(path))


ODD = "1 1 0.1\n1 2 16777217\n2 1 -3e-40\n"


def test_cache_keeps_values_and_follows_its_source(spark, tmp_path, capsys):
    source = tmp_path / "c.tns"
    source.write_text(ODD)
    plain = rows(read_tensor(spark, str(source)))
    assert plain == [(0, 0, 0.1), (0, 1, 16777217.0), (1, 0, -3e-40)]
    for _ in range(2):
        assert rows(read_tensor(spark, str(source), cache=True)) == plain
    source.write_text("1 1 5\n")
    later = time.time() + 10
    os.utime(source, (later, later))
    assert rows(read_tensor(spark, str(source), cache=True)) == [(0, 0, 5.0)]
    # Where the cache can't be written, values are the same.
    other = tmp_path / "d.tns"
    other.write_text(ODD)
    (tmp_path / "d.tns.cache").write_text("in the way")
    assert rows(read_tensor(spark, str(other), cache=True)) == plain
    assert "no cache" in capsys.readouterr().out


def test_paths_and_uris(tmp_path):
    local = [files.open_fs(p)[1] for p in ("/a/b", "a/b:c", "file:/a/b", "file:///a/b")]
    assert local == ["/a/b", "a/b:c", "/a/b", "/a/b"]
    with pytest.raises(Exception):
        files.open_fs("nosuch://a/b")


def batch(lo, n):
    columns = [pa.array(range(lo, lo + n)), pa.array([1] * n), pa.array([float(lo)] * n)]
    return pa.record_batch(columns, names=["i0", "i1", "val"])


@pytest.fixture
def remote(monkeypatch):
    """A file system that is no disk: only what goes through Arrow can reach it."""
    store = pafs._MockFileSystem()
    monkeypatch.setattr(files, "open_fs", lambda uri: (store, uri.removeprefix("mock://")))
    return store


def stored(path):
    parts, sizes = read_parts(path)
    found = [b for p, n in parts for lo in range(0, n, 3) for b in read_chunk(p, lo, min(3, n - lo))]
    return sorted(zip(*(pa.Table.from_batches(found).to_pydict()[c] for c in ("i0", "i1", "val")))), sizes


def test_parts_on_a_remote_file_system(remote, monkeypatch):
    monkeypatch.setattr(dnb, "PART_NNZ", 4)
    path = "mock://bucket/t.dnb"
    writer = dnb._Writer(path, 2, [0, 9], True)

    def dies():
        yield batch(100, 5)
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(dies())
    done = [writer.write(iter([batch(0, 5), batch(5, 2)])), writer.write(iter([batch(7, 1)])), writer.write(iter([]))]
    late = writer.write(iter([batch(0, 5)]))  # the same task once more: it doesn't count
    assert len(late.files) == 1
    writer.commit([*done, None])
    want = [(k, 1, float(5 * (k >= 5) if k < 7 else 7)) for k in range(8)]
    assert stored(path) == (want, (8, 9))
    # A manifest that its writer didn't finish is passed over; files of no manifest are gone.
    with remote.open_output_stream("bucket/t.dnb/_manifest-000000002.json") as f:
        f.write(b"{")
    assert stored(path) == (want, (8, 9))
    kept = [n for n in files.names(remote, "bucket/t.dnb") if n.endswith(".dnb")]
    assert sorted(kept) == sorted(n for m in done for n, _ in m.files)
    again = dnb._Writer(path, 2, [0, 0], False)
    again.commit([again.write(iter([batch(20, 1)]))])
    assert stored(path) == ([*want, (20, 1, 20.0)], (21, 9))
    gone = dnb._Writer(path, 2, [0, 0], True)
    gone.abort([gone.write(iter([batch(30, 1)]))])
    assert len(stored(path)[0]) == 9
    over = dnb._Writer(path, 2, [0, 0], True)
    over.commit([over.write(iter([batch(1, 1)]))])
    assert stored(path) == ([(1, 1, 1.0)], (2, 2))
    assert len(files.names(remote, "bucket/t.dnb")) == 2


def test_factor_files_on_a_remote_file_system(remote):
    f = np.arange(6.0).reshape(3, 2)
    remote.create_dir("bucket")
    factor_files.write_binary(f, "mock://bucket/f.bin", 3, 2)
    assert factor_files.read_header("mock://bucket/f.bin") == (3, 2)
    factor_files.write_lambda(np.array([2.0, 0.5]), "mock://bucket/lam")
    assert factor_files.read_lambda("mock://bucket/lam").tolist() == [2.0, 0.5]
    with pytest.raises(ValueError):
        factor_files.read_header("mock://bucket/lam")


def test_uris_through_spark(spark, tmp_path):
    t, uri = read_tns(spark, TINY), f"file:{tmp_path}"
    write_dnb(t, f"{uri}/t")
    assert rows(read_dnb(spark, f"{uri}/t")) == rows(t)
    export_file(spark, f"{uri}/t", f"{uri}/one.dnb")
    assert rows(read_dnb(spark, f"{uri}/one.dnb")) == rows(t)
    frame = from_dense(spark, np.arange(6.0).reshape(3, 2)).where("i <> 1")
    factor_files.write_binary(frame, f"{uri}/f.bin", 4, 2)
    back = to_dense(factor_files.read_binary(spark, f"{uri}/f.bin"), 4, 2)
    assert back.tolist() == [[0, 1], [0, 0], [4, 5], [0, 0]]
    assert os.listdir(tmp_path / "f.bin.parts") == []


def test_headers_anywhere(spark, tmp_path):
    """A first split of comments alone, and a folder where only some files have a header."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        t = read(spark, tmp_path, "# nothing here\n" * 200 + "2\n7 8\n1 2 3\n4 5 6\n")
        assert t.mode_sizes == (7, 8) and rows(t) == [(0, 1, 3.0), (3, 4, 6.0)]
        folder = tmp_path / "parts"
        folder.mkdir()
        (folder / "a.tns").write_text("2\n9 9\n1 1 1\n")
        (folder / "b.tns").write_text("".join(f"{k} 2 1\n" for k in range(1, 9)) * 40)
        (folder / "c.tns").write_text("# c\n2\n9 9\n2 2 2\n")
        t = read_tns(spark, str(folder))
        assert t.mode_sizes == (9, 9) and t.nnz == 322
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("line", ["1 1 nan", "1 1 inf", "inf 1 1", "nan 1 1"])
def test_numbers_must_be_finite(spark, tmp_path, line):
    with pytest.raises(Exception, match="finite"):
        rows(read(spark, tmp_path, f"1 1 1\n{line}\n"))


def test_factor_files(spark, tmp_path):
    f = random_factor_array(40000, 0, 3, seed=5).astype(np.float32).astype(np.float64)
    f[17] = 0.0
    frame = from_dense(spark, f).where("i <> 17").repartition(5)
    for name, source in (("a", f), ("d", frame)):
        path = str(tmp_path / f"{name}.bin")
        factor_files.write_binary(source, path, len(f), 3)
        assert factor_files.read_header(path) == (40000, 3)
        assert (to_dense(factor_files.read_binary(spark, path), len(f), 3) == f).all()
        text = str(tmp_path / f"{name}.txt")
        factor_files.write_text(source, text, len(f), 3)
        parts = sorted(p for p in os.listdir(text) if p.startswith("part-"))
        lines = [ln for p in parts for ln in open(os.path.join(text, p))]
        assert np.allclose(np.array([ln.split() for ln in lines], float), f, rtol=1e-6)
    assert (tmp_path / "a.bin").read_bytes() == (tmp_path / "d.bin").read_bytes()
    factor_files.write_lambda(np.array([1.0, 2.5]), str(tmp_path / "lam"))
    assert factor_files.read_lambda(str(tmp_path / "lam")).tolist() == [1.0, 2.5]


def test_save_and_load(spark, tmp_path):
    t = read_tns(spark, TINY)
    t.save(str(tmp_path / "s"))
    back = SparseTensor.load(spark, str(tmp_path / "s"))
    assert rows(back) == rows(t)
    assert (back.mode_sizes, back.nnz, back.norm_sq) == (t.mode_sizes, t.nnz, t.norm_sq)
    assert rows(read_tensor(spark, str(tmp_path / "s"))) == rows(t)
