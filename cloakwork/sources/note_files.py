"""A file for each note, for viewers: a data source that writes (name, body) rows as files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cloakwork.schema import ITEMS, SPANS
from cloakwork.sources.io import span_objects


@dataclass
class Written(WriterCommitMessage):
    """How many rows a task has written."""

    rows: int


class FileWriter(DataSourceArrowWriter):
    """Tasks write each body under a name of its own and then move it to the row's name, so that a file is whole or
    absent, and a task that runs again puts the same files in place. overwrite: into a new folder, which takes the
    path's place when all tasks are done and is removed if they fail. append: into the folder itself."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.folder = f"{self.path}.new-{uuid.uuid4().hex}" if overwrite else self.path

    def _open(self, uri: str):
        """File system and path; a bare path is a local one."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyarrow import fs

        store, folder = self._open(self.folder)
        store.create_dir(folder, recursive=True)
        rows = 0
        for batch in iterator:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                data, target = body.encode(), f"{folder}/{name}"
                if store.get_file_info(target).type == fs.FileType.File and not self._replaces(store, target, data):
                    raise ValueError(f"two different notes are named {name}")
                part = f"{folder}/.{uuid.uuid4().hex}.part"
                try:
                    with store.open_output_stream(part) as out:
                        out.write(data)
                    store.move(part, target)
                except BaseException:
                    if store.get_file_info(part).type == fs.FileType.File:
                        store.delete_file(part)
                    raise
                rows += 1
        return Written(rows)

    def _replaces(self, store, target: str, data: bytes) -> bool:
        """Whether an existing file may be replaced: always an earlier run's; of this run, only by the same bytes."""
        if not self.overwrite:
            return True
        with store.open_input_stream(target) as had:
            return had.read() == data

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        if not self.overwrite:
            return
        store, folder = self._open(self.folder)
        _, path = self._open(self.path)
        store.create_dir(folder, recursive=True)  # if there were no rows
        stray = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.endswith(".part")]
        for f in stray:  # of tasks that were killed
            store.delete_file(f)
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)
        store.move(folder, path)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        if self.overwrite:
            store, folder = self._open(self.folder)
            if store.get_file_info(folder).type == fs.FileType.Directory:
                store.delete_dir(folder)


class NoteFiles(DataSource):
    """df(name, body).write.format("note_files").mode("overwrite" or "append").save(path)"""

    @classmethod
    def name(cls) -> str:
        return "note_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if schema.simpleString() != "struct<name:string,body:string>":
            raise ValueError(f"note files are written of (name string, body string), not {schema.simpleString()}")
        return FileWriter(self.options["path"], overwrite)


def file_name(key: Column) -> Column:
    """<key>.json; a key that is no plain name goes by its SHA-256 after a %, and a null one as %null, so that no two
    keys share a file."""
    plain = key.rlike(r"^[A-Za-z0-9_-][A-Za-z0-9._-]{0,199}$")
    return F.concat(F.when(key.isNull(), F.lit("%null")).when(plain, key).otherwise(F.concat(F.lit("%"), F.sha2(key.cast("binary"), 256))), F.lit(".json"))


def write_note_files(df: DataFrame, path: str, key: str, body: Column, distinct: bool = False, mode: str = "overwrite") -> None:
    """body (text) of each row of df as a file <key>.json in path, without an exchange.

    Rows of one key must have the same body. overwrite: a second, different one is an error where it is seen; append: it
    replaces the first, as it does a file of an earlier run, so keys must be unique. distinct: the name
    also has the first 16 digits of the body's SHA-256, so that each different body has a file whatever its key.
    overwrite replaces the folder at the end, by a move, and so needs a store that can move folders; append does not.

    Defined cases: a null body is an empty file; an empty table makes an empty folder.
    """
    text = F.coalesce(body, F.lit(""))
    id_ = F.col(key).cast("string")
    name = file_name(F.concat_ws("~", F.coalesce(id_, F.lit("")), F.substring(F.sha2(text.cast("binary"), 256), 1, 16)) if distinct else id_)
    df.sparkSession.dataSource.register(NoteFiles)
    df.select(name.alias("name"), text.alias("body")).write.format("note_files").mode(mode).save(path)


def write_recognizer_files(df: DataFrame, path: str, key: str = "text_hash", mode: str = "overwrite") -> None:
    """df(key, note_text, spans): {key, value, recognizer_results} a note; a missing text is empty, missing spans none."""
    spans = span_objects(F.coalesce(F.col("spans").cast(SPANS), F.array().cast(SPANS)))
    body = F.to_json(F.struct(F.col(key).cast("string").alias("key"), F.coalesce("note_text", F.lit("")).alias("value"), spans.alias("recognizer_results")))
    write_note_files(df, path, key, body, mode=mode)


def write_anonymizer_files(df: DataFrame, path: str, key: str = "row_id", mode: str = "overwrite") -> None:
    """df(key, anonymized_note_text, items): {text, items} a note."""
    items = F.coalesce(F.col("items").cast(ITEMS), F.array().cast(ITEMS))
    body = F.to_json(F.struct(F.coalesce("anonymized_note_text", F.lit("")).alias("text"), items.alias("items")))
    write_note_files(df, path, key, body, mode=mode)
