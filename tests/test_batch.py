import io
import os
import zipfile

import pytest

from quire.plans import batch as B
from quire.plans import naming
from quire.sources import reader
from quire.sources.datasource import detect_file, register


def put(path, data=b"Chapter I\n\nSome words.\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


def archive(extra=0):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("big.bin", os.urandom(extra))
    return out.getvalue()


@pytest.fixture
def library(tmp_path):
    put(tmp_path / "lib" / "a.epub", archive())
    put(tmp_path / "lib" / "n.txt")
    put(tmp_path / "lib" / "sub" / "b.fb2", b"<FictionBook/>")
    put(tmp_path / "lib" / "sub" / "skip.doc")
    put(tmp_path / "texts" / "only.html", b"<p>x</p>")
    (tmp_path / "empty").mkdir()
    return tmp_path


def names(df):
    return sorted(r["path"].rsplit("/", 1)[-1] for r in df.select("path").collect())


def test_folders_are_read_flat_or_deep(spark, library):
    lib = str(library / "lib")
    assert names(reader.discover(spark, lib)) == ["a.epub"] and names(reader.discover(spark, lib + "/", texts=True)) == ["a.epub", "n.txt"]
    assert names(reader.discover(spark, lib, recursive=True)) == ["a.epub", "b.fb2"]
    assert [os.path.basename(p) for p in B.books_in(lib)] == ["a.epub"] and len(B.books_in(lib, True, True)) == 3 and B.books_in(str(library / "none")) == []


def test_formats_are_told_without_reading_whole_archives(spark, library, monkeypatch):
    big = put(library / "big.bin", archive(3 << 20))
    read = []
    real = open

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n=-1):
            data = self.f.read(n)
            read.append(len(data))
            return data

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.f.close()

    monkeypatch.setattr("builtins.open", lambda p, *a, **k: Counted(real(p, *a, **k)) if p == big else real(p, *a, **k))
    assert detect_file(big) == "epub" and sum(read) < 200_000
    monkeypatch.undo()
    assert B.is_convertible(big) and not B.is_convertible(put(library / "x.bin", b"\0\1")) and B.is_convertible("anything.PRC") and not B.is_convertible(str(library / "missing"))
    register(spark)
    got = {os.path.basename(r["path"]): r["format"] for r in spark.read.format("book_heads").option("recursive", "true").load(str(library / "lib")).collect()}
    assert got == {"a.epub": "epub", "n.txt": "text", "b.fb2": "fb2", "skip.doc": "unknown"}


def test_inputs(library):
    lib, epub = str(library / "lib"), str(library / "lib" / "a.epub")
    assert B.collect_inputs([f' "{epub}" ', lib, "", epub], first=epub, lines=[" ", f"{lib}/n.txt \n"]) == [epub, f"{lib}/n.txt"]
    assert len(B.collect_inputs([lib], recursive=True, texts=True)) == 3
    for args, more, error in (([str(library / "texts")], {}, "texts"), ([str(library / "empty")], {}, "no files"), ([str(library / "lib" / "sub" / "skip.doc")], {}, "none of"), ([lib], {"texts": True, "output": "x.pdf"}, "2 books")):
        with pytest.raises(ValueError, match=error):
            B.collect_inputs(args, **more)
    with pytest.raises(FileNotFoundError):
        B.collect_inputs([str(library / "nothing")])
    assert B.collect_inputs([epub], output="x.pdf") == [epub]


def test_outputs_and_dry_run(library):
    out = B.output_for({"output": {"dir": "/c", "suffix": "_c", "conflict": "rename"}}, {}, True)
    assert out == B.Output("", "/c", "_c", "rename")
    assert B.output_for({"output": {"conflict": "odd"}}, {"output": "p.pdf", "output_dir": "/f", "overwrite": True, "skip_existing": True}, False) == B.Output("", "/f", "", "overwrite")
    there = put(library / "out" / "a.pdf", b"x")
    o = B.Output(folder=str(library / "out"), mode="skip")
    rows = B.dry_run([str(library / "lib" / "a.epub"), str(library / "lib" / "n.txt")], o)
    assert [(r[1], r[2]) for r in rows] == [(there, "skip"), (str(library / "out" / "n.pdf"), "write")]
    assert B.dry_run(["a.epub"], B.Output(folder=str(library / "new")))[0][2] == "write" and not (library / "new").exists()
    assert B.dry_run([str(library / "lib" / "a.epub")], B.Output(folder=str(library / "out")))[0][2].startswith("error")


def test_batch_runs_in_order_and_stops(spark, library):
    paths = [put(library / "in" / f"{k}.txt") for k in "dacb"] + [put(library / "in" / "bad.mobi", b"x")]
    out = B.Output(folder=str(library / "out"))
    got = B.run_batch(spark, paths, output=out, jobs=3).collect()
    assert not [r["error"] for r in got[:4] if r["error"]]
    assert [r["pos"] for r in got] == [1, 2, 3, 4, 5] and [r["outcome"] for r in got] == ["converted"] * 4 + ["failed"]
    assert got[0]["pages"] >= 1 and got[0]["font"] and got[4]["error"] and open(got[0]["output"], "rb").read(5) == b"%PDF-"
    again = B.run_batch(spark, paths[:1], output=B.Output(folder=str(library / "out"), mode="skip")).collect()
    assert again[0]["outcome"] == "skipped" and not [f for f in os.listdir(library / "out") if f.endswith(".part")]
    assert B.run_batch(spark, paths, output=out, stop=put(library / "stop")).count() == 0 and B.run_batch(spark, []).count() == 0


def test_settings_levels_and_stages(tmp_path, monkeypatch):
    path = str(tmp_path / "c" / "config.yaml")
    assert naming.load_config(path) == (naming.DEFAULTS, None)
    pytest.importorskip("yaml")
    naming.save_config(path, {"preset": "compact", "output": {"conflict": "skip"}})
    got, error = naming.load_config(path)
    assert error is None and got["preset"] == "compact" and got["output"] == {"suffix": "", "conflict": "skip"} and got["ui"] == naming.DEFAULTS["ui"]
    (tmp_path / "c" / "config.yaml").write_text("[1, 2")
    assert naming.load_config(path)[0] == naming.DEFAULTS and naming.load_config(path)[1]
    (tmp_path / "c" / "config.yaml").write_text("just text")
    assert naming.load_config(path)[1]
    assert (B.log_level("WARNING"), B.log_level("x"), B.log_level("error"), B.log_level(None)) == (30, 20, 40, 20)
    monkeypatch.setenv("QUIRE_LOG_LEVEL", "debug")
    assert B.log_level("error") == 10 and B.stage_name("render") == "Laying out pages" and B.stage_name("?") == "Working"
