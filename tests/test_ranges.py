"""Sources read in ranges against whole files."""

import numpy as np
import pytest

from strandlake.sources import fasta, tables


def test_scan_equals_parse_at_any_cut(spark, tmp_path):
    rng = np.random.default_rng(0)
    for k in range(3):
        parts = ["dropped\n"] if k == 0 else ["\n"] if k == 1 else []
        for i in range(40):
            parts.append(f">r{i} f|{i % 2} >inside\r\n" if i % 3 else f"  >r{i}\n")
            parts += ["".join(rng.choice(list("acdEF ")) for _ in range(int(rng.integers(0, 60)))) + ("\r\n" if rng.random() < 0.3 else "\n") for _ in range(int(rng.integers(0, 5)))]
            parts += ["\n"] * int(rng.integers(0, 3))
        (tmp_path / f"f{k}.fasta").write_bytes("".join(parts).encode())
    own = lambda df: sorted((r["file"].split("/")[-1], r["record"], r["header"], r["sequence"]) for r in df.collect())
    want = own(fasta.parse(fasta.read_files(spark, str(tmp_path))))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("97b", "1000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            scanned = fasta.scan(spark, str(tmp_path))
            assert own(scanned) == want and len(want) == 120
            if size == "97b":
                assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    with pytest.raises(Exception, match="before the first header"):
        fasta.scan(spark, str(tmp_path / "f0.fasta"), strict=True).count()


def test_matrix_by_row_ranges(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(103, 7)).astype(np.float32)
    np.save(tmp_path / "m.npy", m)
    got = tables.scan_matrix(spark, str(tmp_path / "m.npy"), rows=10)
    assert got.rdd.getNumPartitions() == 11
    rows = sorted((r["row_idx"], tuple(r["values"])) for r in got.collect())
    assert rows == [(k, tuple(map(float, x))) for k, x in enumerate(m)]
    np.save(tmp_path / "none.npy", m[:0])
    assert tables.scan_matrix(spark, str(tmp_path / "none.npy")).count() == 0
    (tmp_path / "short.npy").write_bytes((tmp_path / "m.npy").read_bytes()[:-5])
    np.save(tmp_path / "line.npy", m[0])
    for bad in ("short.npy", "line.npy"):
        with pytest.raises(ValueError):
            tables.scan_matrix(spark, str(tmp_path / bad))


def test_sets_filtered_and_first_kept(spark):
    files = spark.createDataFrame([("a", ">x|1\nACD\n>y|0\nacd\n>z|0\nBZ\n>w|0\nGG\n"), ("b", ">v|1\nGG\n")], "file string, content string")
    got = fasta.load_sets({"train": (files, None)}, {"train": (2, 1, 1)}, drop_invalid=True, distinct=True)
    assert sorted((r["file"], r["record_id"], r["sequence"], r["label"]) for r in got.collect()) == [("a", "w|0", "GG", 0), ("a", "x|1", "ACD", 1)]
    assert fasta.load_sets({"t": (fasta.parse(files), None)}, {"t": 4}, drop_invalid=True).count() == 4
    for want in ({"t": 3}, {"t": (4, 1, 3)}):
        with pytest.raises(ValueError):
            fasta.load_sets({"t": (files, None)}, want, drop_invalid=True)
    with pytest.raises(ValueError):
        fasta.load_sets({"t": (files, None)})
