import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from compassframe.plans import verifying as V
from compassframe.session import written
from compassframe.sources import filetree as T
from compassframe.sources import quoted_csv as Q


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def roots(spark, path, r=1000):
    return {os.path.basename(x.file): (x["size"], x.root) for x in T.file_roots(spark, str(path), r).collect()}


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    d = tmp_path / "f"
    d.mkdir()
    (d / "a.bin").write_bytes(bytes(rng.randrange(256) for _ in range(30_000)))
    (d / "b.txt").write_bytes(b"".join(b"line %d\n" % k for k in range(3000)))
    (d / "c.txt").write_bytes(b"x" * 7000)
    (d / "d.txt").write_bytes(b"")
    (d / "e.txt").write_bytes(b"\n")
    (d / "g.txt").write_bytes(b"\r\n\r\nend")
    return d


def test_roots_do_not_depend_on_blocks(spark, folder, small_blocks):
    small = roots(spark, folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert roots(spark, folder) == small and len(small) == 5
    assert len({r for _, r in small.values()}) == 5


def test_every_changed_byte_shows(spark, folder, small_blocks):
    manifest = T.file_roots(spark, str(folder), 1000).select(T.name_in().alias("file"), "root")
    manifest = spark.createDataFrame(manifest.collect(), "file string, root string")
    ranges = spark.createDataFrame([tuple(r) for r in T.range_digests(spark, str(folder), 1000).collect()], "file string, size bigint, range bigint, digest string")
    now = lambda: T.file_roots(spark, str(folder), 1000).select(T.name_in().alias("file"), "root")
    assert T.verify(now(), manifest).isEmpty()
    data = bytearray((folder / "a.bin").read_bytes())
    data[12_345] ^= 1
    (folder / "a.bin").write_bytes(data)
    (folder / "b.txt").write_bytes((folder / "b.txt").read_bytes()[:-1])  # only the last line end
    (folder / "c.txt").unlink()
    (folder / "new.txt").write_bytes(b"n")
    assert {(r.file, r.problem) for r in T.verify(now(), manifest).collect()} == {
        ("a.bin", "changed"), ("b.txt", "changed"), ("c.txt", "missing"), ("new.txt", "unexpected")}
    changed = {r.range for r in T.changed_ranges(ranges, T.range_digests(spark, str(folder), 1000)).where("file LIKE '%a.bin'").collect()}
    assert changed and all(abs(k - 12) <= 1 for k in changed)


def quoted(rows):
    cell = lambda x: "" if x is None else '"' + x.replace('"', '""') + '"'
    return "\n".join(",".join(cell(x) for x in r) for r in rows)


def test_quoted_records_equal_a_whole_read(spark, tmp_path, small_blocks):
    rng, d = random.Random(2), tmp_path / "csv"
    d.mkdir()
    for f in range(3):
        rows = [("id", "note", "other")]
        for k in range(200):
            note = rng.choice(["plain", "two\nlines", 'say "x"', "a,b", "", "\n\n", 'q"\n"q', "long " * 900 + "\n" + "more " * 900, "é 数\n据"])
            rows.append((f"{f}-{k}", note, rng.choice(["o", None, "p\nq"])))
        (d / f"{f}.csv").write_text(quoted(rows) + ("\n" if f else ""))
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(d))
    got = Q.read_csv(spark, str(d), ["id", "note", "other"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert Q.blocks.lines(spark, str(d)).rdd.getNumPartitions() > 20
    assert Q.read_csv(spark, str(d), ["other"]).columns == ["other"]
    assert Q.records(spark, str(d)).where("first").count() == 3


def test_headers_are_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note\n1,x\n")
    with pytest.raises(ValueError, match="missing required"):
        Q.read_csv(spark, str(tmp_path), ["id", "text"])
    (tmp_path / "b.csv").write_text("note,id\nx,1\n")
    with pytest.raises(ValueError, match="different headers"):
        Q.read_csv(spark, str(tmp_path), ["id"])
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text("id,note\r\n1,x\r\n\r\n2,\"y\r\nz\"\r\n")
    assert [(r.id, r.note.replace("\r", "")) for r in Q.read_csv(spark, str(tmp_path / "c"), ["id", "note"]).orderBy("id").collect()] == [("1", "x"), ("2", "y\nz")]


def test_any_value_survives_a_quoted_file(spark, tmp_path, small_blocks):
    odd = [None, "", "\\N", "\\\\N", "\\", '"', '""', ",", "\r", "a\r\nb\n", "\0", "a\0", 'q"\0"', "\x01" + "0", "\x01\0", " x "]
    rows = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in odd for b in odd)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda x: None if x is None else hashlib.sha256(x.encode()).hexdigest()
    got = {(r.doc_id, r.text_sha256, r.source) for r in V.quoted_csv(spark, str(tmp_path)).collect()}
    assert got == {(k, sha(a), b) for k, a, b in rows}


def test_no_line_is_lost_when_cores_come_or_go(spark, tmp_path, monkeypatch):
    """Spark cuts files by the cores it has; here their number changes between the two scans."""
    (tmp_path / "a.csv").write_text(quoted([("id", "note"), *[(str(k), "two\nlines") for k in range(2000)]]))
    cores = iter(range(3, 30, 4))

    def then_other_cores(df, label):
        out = written(df, label)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(next(cores)))
        return out

    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    monkeypatch.setattr(Q.blocks, "written", then_other_cores)
    try:
        got = Q.read_csv(spark, str(tmp_path), ["id", "note"]).collect()
        ranges = T.range_digests(spark, str(tmp_path), 1000).collect()
    finally:
        for name in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(name)
    assert sorted(int(r.id) for r in got) == list(range(2000)) and {r.note for r in got} == {"two\nlines"}
    assert len(ranges) == -(-(tmp_path / "a.csv").stat().st_size // 1000)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
