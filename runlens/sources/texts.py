"""A text sink for many documents: whole files, many for each task, all of a job or none; and a source that reads such files back.

A task writes the files of its rows below a staging folder of its own attempt. Only when all tasks are done does the commit move
each successful attempt's folder into place, one rename per task, however many files it holds; an abort removes what was
staged. Attempts that were lost or ran twice are never seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

STAGING = "_staging"  # readers pass over names that begin with an underscore


@dataclass
class Attempt(WriterCommitMessage):
    """The folder one task has filled, or None if it had no rows."""

    folder: str | None


def files_at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    files, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return files, root.rstrip("/")


class TextFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, folders: bool = False):
        self.path, self.overwrite, self.folders, self.job = path, overwrite, folders, uuid.uuid4().hex

    def _files(self) -> tuple[fs.FileSystem, str]:
        return files_at(self.path)

    def write(self, iterator: Iterator[Row]) -> Attempt:
        """Rows (file_name, value): those of one file come together, in order; each value is a line or several, null an empty one.

        With ``folders`` a file name may lead into folders of its own, else its slashes become underscores.
        """
        files, root = self._files()
        folder, now, out = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}", None, None
        try:
            for row in iterator:
                if row.file_name != now:
                    if out is None:
                        files.create_dir(folder, recursive=True)
                    else:
                        out.close()
                    if self.folders:
                        name = "/".join(part for part in row.file_name.split("/") if part.strip("."))  # stays below the folder
                    else:
                        name = row.file_name.replace("/", "_")
                    if "/" in name:
                        files.create_dir(f"{folder}/{name.rsplit('/', 1)[0]}", recursive=True)
                    now, out = row.file_name, files.open_output_stream(f"{folder}/{name}")
                out.write(f"{'' if row.value is None else row.value}\n".encode())
        finally:
            if out is not None:
                out.close()
        return Attempt(None if out is None else folder)

    def commit(self, messages: list[Attempt | None]) -> None:
        files, root = self._files()
        before = [f.path for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("part-")]
        for message in messages:
            if message is not None and message.folder is not None:
                files.move(message.folder, f"{root}/part-{message.folder.rsplit('/', 1)[1]}")
        if self.overwrite:
            for folder in before:
                files.delete_dir(folder)
        self._clear(files, root)

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear(*self._files())

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        staged = f"{root}/{STAGING}/{self.job}"
        if files.get_file_info(staged).type == fs.FileType.Directory:
            files.delete_dir(staged)


@dataclass
class Share(InputPartition):
    """Every ``of``-th entry of the folder, from ``no`` on."""

    no: int
    of: int


class TextFilesReader(DataSourceReader):
    """Each task lists the folder itself and goes through its own share of the entries, so no file name passes the driver.

    Like Spark's own readers it passes over empty files and names that begin with a dot or an underscore.
    """

    def __init__(self, path: str, suffix: str, tasks: int):
        self.path, self.suffix, self.tasks = path, suffix, tasks

    def partitions(self) -> list[InputPartition]:
        return [Share(no, self.tasks) for no in range(self.tasks)]

    def read(self, share: Share) -> Iterator[tuple[str, bytes]]:
        files, root = files_at(self.path)

        def below(folder: str) -> list[fs.FileInfo]:
            found = [f for f in files.get_file_info(fs.FileSelector(folder)) if not f.base_name.startswith((".", "_"))]
            return sorted(found, key=lambda f: f.path)

        waiting = below(root)[share.no :: share.of][::-1]
        while waiting:
            entry = waiting.pop()
            if entry.type == fs.FileType.Directory:
                waiting += below(entry.path)[::-1]
            elif entry.size and entry.base_name.endswith(self.suffix):
                with files.open_input_stream(entry.path) as data:
                    yield entry.path, data.read()


class TextFiles(DataSource):
    """``df.write.format("text_files").save(path)`` for rows (file_name, value), and whole files read back: (file_name, content).

    Options: ``folders`` (writing: names lead into folders), ``suffix`` (reading: of the files wanted), ``tasks`` (reading: how many).
    """

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "file_name string, content binary"

    def reader(self, schema) -> TextFilesReader:
        return TextFilesReader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("tasks", "64")))

    def writer(self, schema, overwrite: bool) -> TextFilesWriter:
        return TextFilesWriter(self.options["path"], overwrite, self.options.get("folders", "false").lower() == "true")
