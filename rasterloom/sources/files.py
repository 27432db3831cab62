"""Sink "print_files": rows (path, content) become files of a folder, all of them or none.

A task checks each file and writes it under a name of its own in a hidden folder; when all
tasks are done the commit renames the files into place, so readers never see a part of one,
and equal rows give equal bytes.  If a task or a check fails, nothing is put in place and the
hidden folder goes.  The folder must be mounted at one path on the driver and all executors.
"""

from __future__ import annotations

import io
import os
import shutil
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: The entries without which a package is none.
PACKAGE_ENTRIES = ("[Content_Types].xml", "_rels/.rels", "3D/3dmodel.model")


def fault(path: str | None, content: bytes | None) -> str | None:
    """Why a file may not be put in place, or None."""
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in path.split("/")) or "\\" in path:
        return "the path leaves the folder"
    if not content:
        return "the file is empty"
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "png" and not content.startswith(b"\x89PNG\r\n\x1a\n"):
        return "no PNG"
    if kind == "stl" and (len(content) < 84 or len(content) != 84 + 50 * struct.unpack("<I", content[80:84])[0]):
        return "the number of faces does not fit the length"
    try:
        if kind == "3mf":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = z.namelist()
                if z.testzip() or len(names) != len(set(names)) or not set(PACKAGE_ENTRIES) <= set(names):
                    return "an entry is missing, doubled or broken"
                for n in names:
                    if n.endswith((".model", ".xml", ".rels")):
                        ElementTree.fromstring(z.read(n))
        elif kind == "svg":
            ElementTree.fromstring(content)
    except (zipfile.BadZipFile, ElementTree.ParseError) as error:
        return f"not readable: {error}"
    return None


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class PrintFiles(DataSource):
    """Options: ``path``, the folder; ``run``, the name of this write's hidden folder."""

    @classmethod
    def name(cls) -> str:
        return "print_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"].removeprefix("file://"), self.options["run"])


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, run: str):
        self.folder, self.hidden = folder, f"{folder}/.pending-{run}"

    def write(self, iterator: Iterator) -> Written:
        done = []
        for row in iterator:
            content = bytes(row["content"]) if row["content"] is not None else None
            why = fault(row["path"], content)
            if why:
                raise ValueError(f"{row['path']}: {why}")
            own = f"{self.hidden}/{uuid.uuid4().hex}"
            with open(own, "wb") as f:
                f.write(content)
                f.flush()
                os.fsync(f.fileno())
            done.append((own, row["path"]))
        return Written(done)

    def commit(self, messages: list) -> None:
        files = sorted(f for m in messages if m for f in m.files)
        names = [name for _, name in files]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("a path occurs twice")
        for own, name in files:
            os.makedirs(os.path.dirname(f"{self.folder}/{name}"), exist_ok=True)
            os.replace(own, f"{self.folder}/{name}")
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


def put(files: DataFrame, folder: str) -> None:
    """Write (path, content) as files of ``folder``; replaces files of the same names and leaves others."""
    run, own = uuid.uuid4().hex, folder.removeprefix("file://")
    files.sparkSession.dataSource.register(PrintFiles)
    # made here alone: a task that still runs when the write is given up finds no folder and leaves nothing behind
    os.makedirs(f"{own}/.pending-{run}")
    files.select("path", "content").write.format("print_files").option("path", own).option("run", run).mode("append").save()
