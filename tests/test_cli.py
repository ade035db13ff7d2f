from __future__ import annotations

import os

import numpy as np
import pytest

from tensorspark.cli import main
from tensorspark.sources import factor_files

DATA = os.path.join(os.path.dirname(__file__), "data")
TINY = os.path.join(DATA, "tiny_3mode.tns")
CUBE = os.path.join(DATA, "dense_rank5.tns")


def run(spark, *args: str) -> int:
    return main([*map(str, args)], spark)


@pytest.mark.parametrize("extra", [[], ["--all-modes"]])
def test_mttkrp_verifies(spark, capsys, extra):
    assert run(spark, TINY, "--rank", 8, "--verify", "--no-cache", *extra) == 0
    out = capsys.readouterr().out
    assert "PASS" in out and "[summary]" in out


def test_dumps(spark, tmp_path):
    prefix = tmp_path / "y"
    assert run(spark, TINY, "--rank", 2, "--dump", prefix, "--no-cache") == 0
    assert run(spark, TINY, "--rank", 2, "--dump", prefix, "--dump-bin", "--no-cache") == 0
    for n, size in enumerate((4, 4, 3)):
        parts = sorted(os.listdir(f"{prefix}.fm{n}_out.txt"))
        lines = [ln for p in parts if p.startswith("part") for ln in open(f"{prefix}.fm{n}_out.txt/{p}")]
        text = np.loadtxt(lines)
        assert factor_files.read_header(f"{prefix}.fm{n}_out.bin") == (size, 2)
        assert text.shape == (size, 2)


def test_decompose_save_and_reload(spark, tmp_path, capsys):
    saved, prefix = tmp_path / "state", tmp_path / "cp"
    common = ["--decompose", "cpals", "--rank", 3, "--cp-iters", 3]
    assert run(
        spark, CUBE, *common, "--no-cache", "--save-processed", saved,
        "--cp-dump", prefix, "--cp-dump-init", prefix,
    ) == 0
    first = capsys.readouterr().out
    assert run(spark, saved, "--runtime", *common) == 0
    second = capsys.readouterr().out
    fits = [
        [ln.split("fit ")[1].split(",")[0] for ln in text.splitlines() if "] sweep " in ln]
        for text in (first, second)
    ]
    assert fits[0] == fits[1] and len(fits[0]) == 3
    for n, size in enumerate((20, 25, 30)):
        assert factor_files.read_header(f"{prefix}.cp_fm{n}.bin") == (size, 3)
        assert factor_files.read_header(f"{prefix}.cp_init_fm{n}.bin") == (size, 3)
    assert len(factor_files.read_lambda(f"{prefix}.cp_lambda.bin")) == 3


def test_cache_is_written_and_used(spark, tmp_path):
    path = tmp_path / "t.tns"
    path.write_text("1 1 1\n2 2 2\n")
    for _ in range(2):
        assert run(spark, path, "--rank", 1) == 0
        assert (tmp_path / "t.tns.cache").exists()


def test_exit_codes(spark, tmp_path):
    assert run(spark) == 1
    assert run(spark, TINY, "--nope") == 1
    assert run(spark, "-h") == 0
    assert run(spark, tmp_path / "missing.tns") == 2
    assert run(spark, TINY, "--no-cache", "--decompose", "cpals", "--cp-iters", 0, "--rank", 1) == 4
    assert run(spark, TINY, "--decompose", "tucker") == 5
    assert run(spark, TINY, "--ooc", "on") == 6
    assert run(spark, TINY, "--layout", "morton", "--verify") == 7
    assert run(spark, TINY, "--runtime", "--verify") == 7
    blocked = tmp_path / "file"
    blocked.write_text("")
    assert run(spark, TINY, "--no-cache", "--rank", 1, "--save-processed", blocked / "x") == 8


def test_out_of_core(spark):
    assert run(
        spark, TINY, "--no-cache", "--ooc", "on", "--decompose", "cpals", "--rank", 1,
        "--cp-iters", 1, "--threads", 4,
    ) == 0


def test_layouts(spark, capsys):
    assert run(spark, TINY, "--no-cache", "--rank", 2, "--layout", "morton") == 0
    assert run(
        spark, TINY, "--no-cache", "--layout", "morton", "--decompose", "cpals", "--rank", 1,
        "--cp-iters", 2,
    ) == 0
    assert run(spark, TINY, "--no-cache", "--rank", 2, "--layout", "inplace") == 0
    assert "no counterpart" in capsys.readouterr().out


def test_tools(spark, tmp_path, capsys):
    from tensorspark.sources.reader import read_tensor
    from tensorspark.tools import main as tool

    text, binary, back, dump = (str(tmp_path / n) for n in ("t", "t.dnb", "b", "truth"))
    sizes = ["5", "4", "3"]
    assert tool(["generate", text, "--sizes", *sizes, "--rank", "2", "--truth", dump], spark) == 0
    assert tool(["check", "--tensor", text, "--cp-dump", dump], spark) == 0
    out = capsys.readouterr().out
    assert float(out.split("fit ")[1]) > 0.999
    both = ["--tensor", text, "--cp-dump", dump, "--reference", dump]
    assert tool(["compare", *both], spark) == 0
    assert "factor similarity 1.0000" in capsys.readouterr().out
    assert tool(["convert", text, binary], spark) == 0
    assert tool(["convert", binary, back], spark) == 0
    counts = [read_tensor(spark, p).nnz for p in (text, binary, back)]
    assert counts == [60, 60, 60]
    assert tool(["generate", str(tmp_path / "u"), "--sizes", "9", "9", "--nnz", "20"], spark) == 0
    assert tool(["generate", str(tmp_path / "v"), "--sizes", "9", "9"], spark) == 1
