"""Batches: which files a request names, what it would write, and the run itself as one Spark job with a row for each book in the order of the request."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import pdf
from quire.operators.flatten import flatten
from quire.operators.paginate import Options, paginate
from quire.plans.naming import MODES, Exists, output_path
from quire.runtime import arrow_map, checkpointed
from quire.sources import reader
from quire.sources.datasource import detect_file

# Suffixes of books and of texts, the names of the stages of a conversion, log levels by name.
BOOKS = (".azw3", ".azw", ".mobi", ".prc", ".epub", ".cbz", ".fb2", ".fb2.zip", ".txt", ".html", ".htm", ".xhtml")
TEXTS = (".txt", ".html", ".htm", ".xhtml")
STAGES = {"read": "Reading book", "parse": "Parsing markup", "render": "Laying out pages", "write": "Writing PDF", "done": "Done"}
LEVELS = {"debug": 10, "info": 20, "warn": 30, "warning": 30, "error": 40}


def stage_name(stage: str) -> str:
    return STAGES.get(stage, "Working")


def log_level(name: str) -> int:
    """The level of a name; the environment's ``QUIRE_LOG_LEVEL`` comes first, unknown names mean ``info``."""
    return LEVELS.get((os.environ.get("QUIRE_LOG_LEVEL") or name or "").lower(), LEVELS["info"])


def is_convertible(path: str) -> bool:
    """Whether a file that is named directly can be converted: by its suffix, else by its content, so a book under a wrong name still works."""
    if path.lower().endswith(BOOKS):
        return True
    try:
        return detect_file(path) != "unknown"
    except (OSError, ValueError):
        return False


def books_in(folder: str, recursive: bool = False, texts: bool = False) -> list[str]:
    """The book files of a folder, sorted; those below it only if asked for. Folders are never books, and what cannot be listed is left out."""
    found = []
    for here, below, files in os.walk(folder, onerror=lambda _: None):
        below.sort()
        found += [os.path.join(here, f) for f in sorted(files)]
        if not recursive:
            break
    return [p for p in found if p.lower().endswith(BOOKS) and (texts or not p.lower().endswith(TEXTS))]


def collect_inputs(args: Iterable[str], first: str = "", lines: Iterable[str] = (), recursive: bool = False, texts: bool = False, output: str = "") -> list[str]:
    """The files that a request names, each once, in order: ``first``, the arguments, then the lines of standard input.

    Blanks and double quotes around a name are left out, folders give their books. A file that is no book, a folder without books (with a hint where it holds texts only),
    and one output name for several books are refused.
    """
    out: dict[str, str] = {}
    for name in (x.strip().strip('"').strip() for x in (first, *args, *lines)):
        if not name:
            continue
        if os.path.isdir(name):
            got = books_in(name, recursive, texts)
            if not got:
                more = " that are books; it holds texts, which are converted only if asked for" if not texts and books_in(name, recursive, True) else " that are books"
                raise ValueError(f"{name} has no files{more}")
        elif not os.path.exists(name):
            raise FileNotFoundError(name)
        elif not is_convertible(name):
            raise ValueError(f"{os.path.basename(name)} is none of {', '.join(BOOKS)}")
        else:
            got = [name]
        for p in got:
            out.setdefault(os.path.abspath(p), p)
    if output and len(out) > 1:
        raise ValueError(f"one output name cannot serve {len(out)} books")
    return list(out.values())


@dataclass(frozen=True)
class Output:
    """Where files go: a path for a single book, else a folder and a suffix; what happens to existing ones."""

    path: str = ""
    folder: str = ""
    suffix: str = ""
    mode: str = "fail"


def output_for(config: dict | None, flags: dict, single: bool) -> Output:
    """Output options from the configuration, then from flags. Of the modes, the first flag set counts in the order overwrite, rename, skip."""
    c = (config or {}).get("output") or {}
    mode = c.get("conflict") if c.get("conflict") in MODES else "fail"
    for flag, m in (("overwrite", "overwrite"), ("auto_rename", "rename"), ("skip_existing", "skip")):
        if flags.get(flag):
            mode = m
            break
    return Output(flags.get("output", "") if single else "", flags.get("output_dir") or c.get("dir") or "", flags.get("suffix") or c.get("suffix") or "", mode)


def planned(paths: list[str], output: Output) -> list[dict]:
    """For each input in order its output, or why there is none: one that exists, or that an earlier input takes, counts as existing. Nothing is written."""
    rows, taken = [], set()
    for pos, p in enumerate(paths, 1):
        row: dict = {"pos": pos, "path": p}
        try:
            row["output"] = output_path(p, output.path, output.folder, output.suffix, output.mode, taken)
            taken.add(row["output"])
        except Exists as e:
            row |= {"output": str(e), "outcome": "skipped"}
        except Exception as e:
            row |= {"outcome": "failed", "error": f"{type(e).__name__}: {e}"}
        rows.append(row)
    return rows


def dry_run(paths: list[str], output: Output) -> list[tuple[str, str | None, str]]:
    """(input, output, what would happen): ``write``, ``skip`` or the error."""
    return [(r["path"], r.get("output"), "error: " + r["error"] if "error" in r else "skip" if "outcome" in r else "write") for r in planned(paths, output)]


RESULT = "pos int, path string, output string, outcome string, pages int, headings int, images int, dropped int, font string, in_bytes bigint, out_bytes bigint, elapsed_ms bigint, error string"
_FIELDS = [(x.split()[0], {"int": pa.int32(), "bigint": pa.int64()}.get(x.split()[1], pa.string())) for x in RESULT.split(", ")]


def convert_file(path: str, target: str, options: Options) -> dict:
    """One file to one PDF, which appears under its name only when it is whole; a second run writes the same file again."""
    start = time.monotonic()
    row: dict = {"path": path, "output": target, "outcome": "failed"}
    try:
        with open(path, "rb") as f:
            data = f.read()
        row["in_bytes"] = len(data)
        book = reader.decode(data, os.path.abspath(path))
        blocks = flatten(book["html"], tuple(book["flows"]))
        if not blocks:
            raise ValueError("the book contains no readable text")
        pictures = {k: d for k, _, d in book["resources"]}
        laid = paginate(blocks, options, book | {"cover_index": book["cover"]}, pictures)
        body = pdf.write(laid, book["title"], pictures)
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        part = f"{target}.{uuid.uuid4().hex}.part"
        try:
            with open(part, "wb") as f:
                f.write(body)
            os.replace(part, target)
        finally:
            if os.path.exists(part):
                os.remove(part)
        row |= {"outcome": "converted", "pages": len(laid.pages), "headings": laid.headings, "images": laid.images, "dropped": laid.dropped, "font": laid.font(options), "out_bytes": len(body)}
    except Exception as e:  # one bad book never stops the others
        row["error"] = str(e)
    row["elapsed_ms"] = int((time.monotonic() - start) * 1000)
    return row


def run_batch(spark: SparkSession, paths: list[str], options: Options | None = None, output: Output | None = None, jobs: int = 0, stop: str = "") -> DataFrame:
    """A row for each book that was begun, in the order of ``paths``; at most ``jobs`` books at a time (0: as many as the session has cores).

    Once a file named ``stop`` exists no further book is begun, so a stopped batch has fewer rows than paths. Paths and outputs must lie where all executors reach them. Outputs are
    planned before the run, so a task that is run again after a lost executor writes the same files; results are kept before they are sorted, so no book is converted for a sort.
    """
    tasks = max(1, min(jobs or spark.sparkContext.defaultParallelism, len(paths) or 1))
    options, output = options or Options(), output or Output()

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for r in b.to_pylist():
            if stop and os.path.exists(stop):
                break
            rows.append(r if r["outcome"] else {"pos": r["pos"], **convert_file(r["path"], r["output"], options)})
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _FIELDS], names=[n for n, _ in _FIELDS])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    plan = [tuple(r.get(c) for c in ("pos", "path", "output", "outcome", "error")) for r in planned(paths, output)]
    asked = spark.createDataFrame(plan, "pos int, path string, output string, outcome string, error string")
    return checkpointed(arrow_map(asked.repartition(tasks, F.col("pos") % tasks), kernel, RESULT)).orderBy("pos")
