"""A data source for files of pages: ``spark.read.format("leafmill_pages").load(path)`` after ``register``.

A file is an array of page objects, or an object a line.  Where objects begin on lines of their own, as writers with an
indent and writers of lines leave them, a file is split by ranges of bytes and each object is parsed once, by the task
whose range it begins in; an array on one line is one task's.  Rows say which file they come from, so pages of several
files stay apart.  Paths are opened by pyarrow, so local and mounted folders and the stores it knows are read; for any
other store there is ``sources.pages.read_pages``.

Defined cases: number and text are taken under any of their names; a page without a number has its place in the file; one
without text has that of its blocks; a blank file has no rows; an object that is no JSON is an error that names the file.
Options: bytes of a range; with ``blank`` "keep" a text that is there stays as it is, blank or not; with ``places`` "false" the
place is null, and what comes before a range is read only for pages without a number.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .pages import BLOCKS

SCHEMA = f"file string, place int, page long, text string, blocks {BLOCKS}"
NUMBERS, TEXTS = ("page", "page_number", "page_num", "number"), ("text", "content", "page_text", "full_text")
#: Bytes of a range, and how many are read at once to find where the object after it begins.
RANGE, AHEAD = 16 << 20, 1 << 16


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, mark: bytes | None) -> None:
        self.file, self.start, self.end, self.mark = file, start, end, mark


def _opened(path: str):
    """The store of a path, as Hadoop writes it, and the place there."""
    from pyarrow import fs

    found = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/]*))?(/.*)?$", path)
    if not found or found[1] == "file":
        return fs.LocalFileSystem(), found[3] if found else path
    store, root = fs.FileSystem.from_uri(f"{found[1]}://{found[2] or ''}/")
    return store, root.rstrip("/") + (found[3] or "/")


def listed(path: str) -> list[str]:
    """The files of a path: itself, those of a folder, or those that a pattern in its last part names."""
    import fnmatch

    from pyarrow import fs

    store, at = _opened(path)
    folder, _, last = at.rpartition("/")
    head = path[: len(path) - len(at)]
    if any(c in last for c in "*?["):
        found = [f.path for f in store.get_file_info(fs.FileSelector(folder or ".")) if f.is_file and fnmatch.fnmatch(f.base_name, last)]
    else:
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no pages at {path}")
        found = [info.path] if info.is_file else [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and not f.base_name.startswith((".", "_"))]
    return sorted(head + f for f in found)


def mark_of(begin: bytes) -> bytes | None:
    """What stands before each object of a file that begins so; null where objects are on one line."""
    text = begin.lstrip(b"\xef\xbb\xbf \t\r\n")
    if text.startswith(b"{"):
        return b"\n{" if b"}\n" in begin or b"}\r\n" in begin else None
    found = re.match(rb"\[\s*?\n([ \t]+)\{", text)
    return b"\n" + found[1] + b"{" if found else None


def _begin(f) -> bytes:
    """The beginning of a file; of one that starts with an object, what comes before the end of its first line is left out."""
    begin = f.read(AHEAD)
    if begin.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"{") and b"\n" not in begin.lstrip(b"\xef\xbb\xbf \t\r\n"):
        last = begin
        while b"\n" not in last[2:] and (more := f.read(AHEAD)):
            last = last[-2:] + more
        begin += last
    return begin


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("bytes", RANGE))
        self.keep, self.places = options.get("blank") == "keep", options.get("places") != "false"
        if self.size < 1:
            raise ValueError("a range has a byte at least")

    def partitions(self) -> list[Range]:
        out = []
        for file in listed(self.path):
            store, at = _opened(file)
            with store.open_input_file(at) as f:
                size, mark = f.size(), mark_of(_begin(f))
            step = self.size if mark else max(1, size)
            out += [Range(file, i, min(i + step, size), mark) for i in range(0, size, step)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, at = _opened(partition.file)
        with store.open_input_file(at) as f:
            objects, before = self._objects(f, partition)
            base = None
            for k, x in enumerate(objects):
                number = next((n for n in (_number(x.get(c)) for c in NUMBERS) if n is not None), None)
                if self.places or number is None:
                    base = before() if base is None else base
                place = None if base is None else base + k + 1
                yield partition.file, place if self.places else None, place if number is None else number, *_contents(x, self.keep)

    def _objects(self, f, p: Range):
        """The objects that begin in a range, and a function for how many begin before it."""
        if p.mark is None:
            text = f.read().decode("utf-8-sig").strip()
            found = json.loads(text) if text else []
            return (found if isinstance(found, list) else [found]), lambda: 0
        lines = p.mark == b"\n{"
        f.seek(p.start)
        data = f.read(p.end - p.start + len(p.mark) - 1)
        if p.start == 0 and lines:  # the first line has no line before it
            data = b"\n" + data.removeprefix(b"\xef\xbb\xbf").lstrip()
        starts = [m.start() for m in re.finditer(re.escape(p.mark), data)]
        if starts:
            # the last object ends where the next begins
            while (end := data.find(p.mark, starts[-1] + 1)) < 0 and (more := f.read(AHEAD)):
                data += more
            data = data if end < 0 else data[:end]

        def parsed() -> Iterator[dict]:
            decoder = json.JSONDecoder()
            for a, b in zip(starts, [*starts[1:], len(data)], strict=False):
                try:
                    yield decoder.raw_decode(data[a:b].decode("utf-8").lstrip())[0]
                except ValueError as e:
                    raise ValueError(f"{p.file} has an object that is no JSON: {e}") from e

        def before() -> int:
            f.seek(0)
            head = f.read(p.start + len(p.mark) - 1)
            return head.count(p.mark) + int(lines and p.start > 0 and head.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"{") and not head.startswith(b"\n"))

        return parsed(), before


def _contents(x: dict, keep: bool) -> tuple:
    blocks = [b if isinstance(b, dict) else {"text": str(b)} for b in x.get("blocks") or []]
    text = next((x[c] for c in TEXTS if isinstance(x.get(c), str) and (keep or x[c].strip(" "))), None)
    if text is None:
        text = "\n".join(b["text"] for b in blocks if b.get("text") is not None)
    cells = [tuple(_double(b.get(c)) for c in ("x0", "y0", "x1", "y1")) + (b.get("text"),) for b in blocks]
    return text, None if x.get("blocks") is None else cells


def _number(v) -> int | None:
    try:
        return None if isinstance(v, bool) or v is None else int(str(v).strip())
    except ValueError:
        return None


def _double(v) -> float | None:
    return None if v is None else float(v)


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leafmill_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageFiles)
