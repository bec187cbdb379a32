"""Binary sources: archives and XML documents, taken apart where they are read."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quillspark.sources import markup


def read_binary(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "content")


def members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """The files of a tar (compressed or not), a zip or a gzip; a plain file is its own member."""
    stream = io.BytesIO(content)
    if tarfile.is_tarfile(stream):
        stream.seek(0)
        with tarfile.open(fileobj=stream) as tar:
            for info in tar:
                if info.isfile() and (held := tar.extractfile(info)):
                    yield info.name, held.read()
        return
    if zipfile.is_zipfile(stream):
        with zipfile.ZipFile(stream) as archive:
            for item in archive.infolist():
                if not item.is_dir():
                    yield item.filename, archive.read(item)
        return
    if content[:2] == b"\x1f\x8b":
        yield name.removesuffix(".gz").rsplit("/", 1)[-1], gzip.decompress(content)
        return
    yield name.rsplit("/", 1)[-1], content


def unpack(files: DataFrame) -> DataFrame:
    """(path, member, content, error) of the archives in (path, content); a broken archive gives one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = []
                try:
                    rows += [(path, m, c, None) for m, c in members(path, bytes(content))]
                except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError) as error:
                    rows.append((path, None, None, str(error)[:200]))
                yield pd.DataFrame(rows, columns=["path", "member", "content", "error"])

    return files.mapInPandas(run, "path string, member string, content binary, error string")


def decode(content: bytes) -> str:
    """Text of unknown encoding: UTF-8 if it is valid, else Latin-1."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


_INPUT = re.compile(r"\\(?:input|include|subfile)\s*\{([^}]+)\}|\\(?:input|include)\s+([^\s{}\\]+)")
_REMARK = re.compile(r"(?<!\\)%.*")


def flatten_latex(sources: dict[str, bytes]) -> str | None:
    """The main LaTeX file of an archive with the files it includes in their places; None if there is none.

    The main file is the one with a document class, the shortest path first; a file that
    includes itself, and one that is not there, add nothing.
    """
    texts = {name: "\n".join(_REMARK.sub("%" if _REMARK.search(line) else "", line) for line in decode(content).splitlines()) for name, content in sources.items() if name.lower().endswith((".tex", ".ltx", ".bbl")) or "." not in name.rsplit("/", 1)[-1]}
    mains = sorted((n for n, t in texts.items() if re.search(r"\\document(?:class|style)", t)), key=lambda n: (n.count("/"), len(n), n))
    if not mains:
        return None
    folder = mains[0].rpartition("/")[0]

    def whole(name: str, above: tuple[str, ...]) -> str:
        def put(m: re.Match) -> str:
            asked = (m.group(1) or m.group(2)).strip().removeprefix("./")
            for option in (asked, asked + ".tex"):
                found = f"{folder}/{option}" if folder else option
                if found in texts and found not in above:
                    return whole(found, (*above, found))
            return ""

        return _INPUT.sub(put, texts[name])

    text = whole(mains[0], (mains[0],))
    # the formatted bibliography stands in for the commands that would read it
    bbl = next((texts[n] for n in (mains[0].rsplit(".", 1)[0] + ".bbl", *sorted(t for t in texts if t.endswith(".bbl"))) if n in texts), None)
    return re.sub(r"\\bibliography\{[^}]*\}", lambda _: bbl, text) if bbl else text


Converter = Callable[[bytes], bytes]


def convert(files: DataFrame, pdf: Converter | None = None, latex: Converter | None = None) -> DataFrame:
    """Papers of uploaded files by their kind: XML is read as it is, PDFs and LaTeX (also archives of it) go through converters to XML first.

    ``files`` has path and content.  Converters are calls of outer programs or services; without
    one, and for other kinds, the row has an error.
    """

    def one(path: str, content: bytes) -> dict:
        kind = path.lower()
        if kind.endswith(".pdf"):
            if pdf is None:
                raise ValueError("no converter of PDFs")
            return markup.parse(pdf(content))
        if kind.endswith((".xml", ".nxml", ".tei")):
            return markup.parse(content)
        if kind.endswith((".tex", ".gz", ".zip", ".tar", ".tgz")):
            text = flatten_latex(dict(members(path, content)))
            if text is None or latex is None:
                raise ValueError("no LaTeX found" if text is None else "no converter of LaTeX")
            return markup.parse(latex(text.encode()))
        raise ValueError("unknown kind of file")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows.append({"file": path, "error": None, **one(path, bytes(content))})
                except Exception as error:  # whatever a converter or a broken file raises belongs to its row
                    rows.append({"file": path, "error": f"{type(error).__name__}: {error}"[:200], **dict.fromkeys(markup.FIELDS)})
            yield pd.DataFrame(rows, columns=["file", "error", *markup.FIELDS], dtype=object)

    return files.select("path", "content").mapInPandas(run, f"file string, error string, {markup.SCHEMA}")


def parse_documents(files: DataFrame, name: str = "member") -> DataFrame:
    """Papers of XML files; the reader is chosen by the root element, and errors are kept as a column."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame[name], frame["content"]):
                try:
                    rows.append({"file": path, "error": None, **markup.parse(bytes(content))})
                except (markup.ET.ParseError, ValueError) as error:
                    rows.append({"file": path, "error": str(error)[:200], **dict.fromkeys(markup.FIELDS)})
            yield pd.DataFrame(rows, columns=["file", "error", *markup.FIELDS], dtype=object)

    return files.select(name, "content").mapInPandas(run, f"file string, error string, {markup.SCHEMA}")
