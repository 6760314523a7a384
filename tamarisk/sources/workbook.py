"""Workbooks (xlsx) as tables: a task a sheet, the zip and its XML read as a stream, no Excel engine."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHEETS = "path string, number int, sheet string, header array<string>"
ROWS = "path string, number int, row int, cells array<string>"
_CELL = re.compile(r"([A-Z]+)")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part of the zip) of the sheets in the workbook's order."""
    targets = {}
    for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        target = e.get("Target", "")
        targets[e.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    out = []
    for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _local(e.tag) == "sheet":
            out.append((e.get("name", ""), targets[next(v for k, v in e.attrib.items() if _local(k) == "id")]))
    return out


def _text(element) -> str:
    """The text of a string item, without the readings beside it."""
    if _local(element.tag) == "rPh":
        return ""
    own = element.text or "" if _local(element.tag) == "t" else ""
    return own + "".join(_text(child) for child in element)


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if _local(e.tag) == "si":
                out.append(_text(e))
                e.clear()
    return out


def _column(reference: str | None, following: int) -> int:
    if not reference or not (m := _CELL.match(reference)):
        return following
    n = 0
    for c in m[1]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _value(cell, shared: list[str]) -> str | None:
    kind, value = cell.get("t", "n"), next((e for e in cell if _local(e.tag) in ("v", "is")), None)
    if value is None:
        return None
    if kind == "inlineStr":
        return _text(value)
    raw = value.text or ""
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "True" if raw == "1" else "False"
    return None if kind == "e" else raw


def sheet_rows(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[list[str | None]]:
    """The cells of each row, as text; rows without any are left out, as are empty cells at a row's end."""
    with book.open(part) as f:
        for _, e in ElementTree.iterparse(f):
            if _local(e.tag) != "row":
                continue
            cells: list[str | None] = []
            for c in e:
                at = _column(c.get("r"), len(cells))
                cells += [None] * (at + 1 - len(cells))
                cells[at] = _value(c, shared)
            e.clear()
            while cells and cells[-1] is None:
                cells.pop()
            if cells:
                yield cells


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, sheet, header) of the sheets of a workbook, or of all below a folder or pattern; ``header`` is the first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    shared = _shared(book)
                    found = [(p, i, name, next(sheet_rows(book, part, shared), [])) for i, (name, part) in enumerate(_parts(book))]
                columns = list(zip(*found, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())), strict=True)], names=["path", "number", "sheet", "header"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SHEETS)


def read_workbook(spark: SparkSession, path: str, wanted: list[int | str] | None = None, names: list[str] | None = None) -> DataFrame:
    """The ``wanted`` sheets (names, or places from 0; None: all) one below the other, every cell as text.

    Columns are named by each sheet's first row and joined by name, what a sheet lacks is null, and
    a column of an empty name is left out; with ``names`` there is no such row and columns go by place. A sheet that is not
    there is an error. Numbers and dates are as the file holds them, errors null, booleans ``True`` or ``False``.
    """
    told = sheets(spark, path).collect()  # a row a sheet
    some = [s for s in told if wanted is None or s.sheet in wanted or s.number in wanted]
    missing = [w for w in wanted or [] if not any(w in (s.sheet, s.number) for s in told)]
    if missing:
        raise ValueError(f"no sheet {missing} in {path}")
    order = {w: i for i, w in enumerate(wanted or [])}
    if wanted is not None:
        some.sort(key=lambda s: order.get(s.sheet, order.get(s.number)))
    if not some:
        raise ValueError(f"no sheets in {path}")
    first = 0 if names else 1
    pairs = spark.createDataFrame([(s.path, s.number, i) for i, s in enumerate(some)], "path string, number int, place int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())), strict=True)], names=["path", "number", "row", "cells"])

        for batch in batches:
            for p, content, number in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "number")), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    rows = []
                    for i, cells in enumerate(sheet_rows(book, _parts(book)[number][1], _shared(book))):
                        if i >= first:
                            rows.append((p, number, i, cells))
                        if len(rows) >= 5000:
                            yield out(rows)
                            rows = []
                    yield out(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    # one task a sheet: the few pairs go to the files and each is dealt to a partition of its own
    dealt = files.join(F.broadcast(pairs), "path").repartitionById(len(some), F.col("place"))
    rows = dealt.select("path", "content", "number").mapInArrow(run, ROWS)
    every = list(names) if names else list(dict.fromkeys(h for s in some for h in s.header if h))
    place = F.lit(None).cast("array<int>")
    for s in some:
        own = list(range(len(every))) if names else [next((i for i, h in enumerate(s.header) if h == c), -1) for c in every]
        place = F.when((F.col("path") == s.path) & (F.col("number") == s.number), F.array(*map(F.lit, own)).cast("array<int>")).otherwise(place)
    rows = rows.withColumn("place", place)
    return rows.select(*(F.get("cells", F.get("place", F.lit(i))).alias(c) for i, c in enumerate(every)))
