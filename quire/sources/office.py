"""Office files as Markdown, from their XML alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
CONVERTERS: dict[str, Callable[[bytes], str]] = {}


def converter(extension: str) -> Callable:
    def register(function: Callable[[bytes], str]) -> Callable[[bytes], str]:
        CONVERTERS[extension] = function
        return function

    return register


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in archive.namelist():
        return None
    raw = archive.read(name)
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ValueError(f"{name} declares entities")
    return ElementTree.fromstring(raw)


def table(rows: list[list[str]]) -> str:
    body = "".join("<tr>" + "".join(f"<{'th' if i == 0 else 'td'}>{c}</{'th' if i == 0 else 'td'}>" for c in r) + "</tr>" for i, r in enumerate(rows))
    return f"<table>{body}</table>"


def _run(r: ElementTree.Element) -> str:
    text = "".join(t.text or "" for t in r.iter(f"{W}t"))
    style = r.find(f"{W}rPr")
    if style is None or not text.strip():
        return text
    on = lambda tag: (e := style.find(W + tag)) is not None and e.get(f"{W}val", "1") not in ("0", "false", "none")
    for tag, left, right in (("strike", "~~", "~~"), ("i", "*", "*"), ("b", "**", "**"), ("u", "<u>", "</u>")):
        if on(tag):
            text = f"{left}{text}{right}"
    return text


@converter("docx")
def docx(data: bytes) -> str:
    out, numbers = [], {}
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = _xml(archive, "word/document.xml").find(f"{W}body")
        for e in body:
            if e.tag == f"{W}tbl":
                numbers.clear()
                out.append(table([["".join(t.text or "" for t in c.iter(f"{W}t")) for c in r.findall(f"{W}tc")] for r in e.findall(f"{W}tr")]))
            elif e.tag == f"{W}p":
                text = "".join(_run(r) for r in e.iter(f"{W}r"))
                style = e.find(f"{W}pPr/{W}pStyle")
                level = re.fullmatch(r"[Hh]eading ?(\d)", style.get(f"{W}val", "")) if style is not None else None
                listed = e.find(f"{W}pPr/{W}numPr")
                if listed is not None:
                    key = tuple((x.get(f"{W}val") if (x := listed.find(W + k)) is not None else "0") for k in ("numId", "ilvl"))
                    numbers[key] = numbers.get(key, 0) + 1
                    text = f"{'  ' * int(key[1])}{numbers[key]}. {text}"
                else:
                    numbers.clear()
                    text = f"{'#' * int(level[1])} {text}" if level else text
                if text.strip():
                    out.append(text)
    return "\n\n".join(out)


@converter("xlsx")
def xlsx(data: bytes) -> str:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        shared = _xml(archive, "xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in s.iter(f"{S}t")) for s in shared] if shared is not None else []
        names = [s.get("name", "") for s in _xml(archive, "xl/workbook.xml").iter(f"{S}sheet")]
        for i, name in enumerate(names, 1):
            sheet = _xml(archive, f"xl/worksheets/sheet{i}.xml")
            cells: dict[tuple[int, int], str] = {}
            for c in sheet.iter(f"{S}c") if sheet is not None else ():
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                column = 0
                for x in letters:
                    column = column * 26 + ord(x) - 64
                value = c.find(f"{S}v")
                text = "".join(t.text or "" for t in c.iter(f"{S}t")) if c.get("t") == "inlineStr" else "" if value is None else strings[int(value.text)] if c.get("t") == "s" else value.text or ""
                if text:
                    cells[int(row), column] = text
            if cells:
                (top, bottom), (left, right) = ((min(v), max(v)) for v in zip(*cells))
                out.append(f"## {name}\n\n" + table([[cells.get((r, c), "") for c in range(left, right + 1)] for r in range(top, bottom + 1)]))
    return "\n\n".join(out)


@converter("pptx")
def pptx(data: bytes) -> str:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        names = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for name in names:
            paragraphs = ["".join(t.text or "" for t in p.iter(f"{A}t")) for p in _xml(archive, name).iter(f"{A}p")]
            out.append("\n\n".join(p for p in paragraphs if p.strip()))
    return "\n\n---\n\n".join(out)


def converted(files: DataFrame) -> DataFrame:
    """(path, markdown, error) of files (path, content): by extension; what isn't known or can't be read has an error and no text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"]):
                kind = path.rsplit(".", 1)[-1].lower()
                try:
                    if kind not in CONVERTERS:
                        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(sorted(CONVERTERS))}")
                    rows.append((path, CONVERTERS[kind](bytes(data)), None))
                except (ValueError, KeyError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    rows.append((path, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, markdown string, error string")


def read_office(spark: SparkSession, folder: str) -> DataFrame:
    return converted(spark.read.format("binaryFile").load(folder))
