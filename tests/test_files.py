"""Files and archives that are damaged, large, or cannot be read."""

import bz2
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from webquire.plans.combine import combine
from webquire.sources import readers as R


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_file_that_cannot_be_read_is_a_row(spark, tmp_path):
    for name, text in (("a.md", "one two"), ("sub/b c%20.md", "three ü"), ("page.html", "<p>x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "sub" / "_none.MD").touch()
    os.symlink("/proc/self/mem", tmp_path / "bad.md")  # opens, but every read fails
    got = rows(R.read_markdown(spark, str(tmp_path), errors=True).withColumn("error", F.substring("error", 1, 14)))
    assert got == [("a.md", "one two", None), ("bad.md", None, "cannot be read"), ("sub/_none.MD", "", None), ("sub/b c%20.md", "three ü", None)]
    docs = R.read_markdown(spark, str(tmp_path))
    assert docs.columns == ["path", "content"]
    done = combine(docs, 100)
    assert [tuple(r) for r in done.summary.collect()] == [("", 4, 4, 1)]
    assert [(p.files, p.content) for p in done.parts.collect()] == [(3, "one two\n\n---\n\n\n\n---\n\nthree ü")]
    assert R.read_html(spark, str(tmp_path)).columns == ["path", "content"]


def test_a_listing_by_rounds(spark, tmp_path, monkeypatch):
    """Tasks hand on the folders that they did not reach."""
    names = [f"d{i % 7}/e{i % 3}/{i}.md" for i in range(100)]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * (len(name) % 3))
    expected = sorted((n, len(n) % 3) for n in names)
    assert rows(R.list_files(spark, str(tmp_path), ".md")) == expected
    monkeypatch.setattr(R, "WALKED", 5)
    assert rows(R.list_files(spark, "file://" + str(tmp_path) + "/", ".md")) == expected
    monkeypatch.setattr(R, "LISTERS", 2)
    assert rows(R.list_files(spark, str(tmp_path), ".md")) == expected
    assert R.list_files(spark, str(tmp_path), ".html").count() == 0 == R.read_html(spark, str(tmp_path)).count()


def test_an_archive_beyond_two_gigabytes_on_several_tasks(spark, tmp_path, monkeypatch):
    big = tmp_path / "big.zip"
    with open(big, "wb") as f:
        f.truncate(2_300_000_000)  # sparse: what stands before the entries
    names = [f"d/{i:03d}.html" for i in range(300)]
    with zipfile.ZipFile(big, "a") as z:
        for k, name in enumerate(names):
            z.writestr(name, f"page {k} ü " * 50, (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2)[k % 3])
    assert os.path.getsize(big) > 1 << 31
    monkeypatch.setattr(R, "DEAL_BYTES", 4_000)
    got = R.read_zip(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.archive, r.path, r.content, r.error) for r in got) == [("big.zip", n, f"page {k} ü " * 50, None) for k, n in enumerate(names)]
    assert len({r.task for r in got}) > 3
    assert R.read_zip(spark, str(big)).count() == 300


def test_entries_by_every_fault(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("twice.html", "first")
        z.writestr("sub/../twice.html", "last")
        z.writestr("empty.html", "")
        z.writestr("long.html", b"\0" * 5_000_000, zipfile.ZIP_DEFLATED)
        z.writestr("lz.html", "x" * 100, zipfile.ZIP_LZMA)
        z.writestr("../out.html", "no")
        z.writestr("note.txt", "no")
    raw = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "nothing.zip").write_bytes(b"")
    (tmp_path / "text.zip").write_bytes(b"no archive at all" * 100)
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    at = raw.index(b"PK\x03\x04", raw.index(b"empty.html") + 1)
    (tmp_path / "moved.zip").write_bytes(raw[:at] + b"XX" + raw[at + 2 :])
    got = {(r.archive, r.path): (r.content, r.error) for r in R.read_zip(spark, str(tmp_path)).collect()}
    for name in ("a.zip", "moved.zip"):
        assert got[name, "twice.html"] == ("last", None) and got[name, "empty.html"] == ("", None)
        assert "method 14" in got[name, "lz.html"][1]
    assert got["a.zip", "long.html"] == ("\0" * 5_000_000, None)
    assert got["moved.zip", "long.html"][0] is None and "no entry" in got["moved.zip", "long.html"][1]
    assert {k for k in got if k[1] is None} == {("nothing.zip", None), ("text.zip", None)}
    assert len(got) == 10


@pytest.mark.parametrize("packed", [bz2.compress(b"y" * 3_000_000), b"BZh9 nothing"])
def test_bzip2_entries(spark, tmp_path, packed):
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("b.html", b"y" * 3_000_000)
    raw = (tmp_path / "b.zip").read_bytes()
    good = raw.index(b"BZh")
    if packed[3:4] == b"9" and len(packed) > 20:
        assert [len(r.content) for r in R.read_zip(spark, str(tmp_path)).collect()] == [3_000_000]
    else:
        (tmp_path / "b.zip").write_bytes(raw[: good + 4] + b"\0\0\0\0" + raw[good + 8 :])
        assert [(r.content, r.error is None) for r in R.read_zip(spark, str(tmp_path)).collect()] == [(None, False)]
