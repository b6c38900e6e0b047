"""A folder of song texts that changes as a whole: a data source writer with a two-phase commit.

Tasks write one file a song into a new version's folder; the driver then replaces one small file, ``CURRENT``,
that names the version. Readers follow it, so they see the old set or the new one and never a mixture. A job
that fails leaves ``CURRENT`` as it was and takes its own folder away; a job that succeeds takes the old
version's folder away, and with it the texts of songs that are gone. A task that runs again writes the same
names with the same texts. The driver handles two names, however many songs there are.

The path may be of any store that pyarrow's file systems know, and must be reachable for all executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from strophe.operators.parse import song_to_text
from strophe.operators.ranking import best_of
from strophe.sources.readers import text_dir

POINTER = "CURRENT"


def _store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def current(path: str) -> str | None:
    """The folder of the version that counts, or null where nothing was written yet."""
    from pyarrow import fs

    store, base = _store(path)
    if store.get_file_info(f"{base}/{POINTER}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{base}/{POINTER}") as f:
        return f"{path}/{f.read().decode()}"


@dataclass
class Written(WriterCommitMessage):
    songs: int


class SongFolderWriter(DataSourceWriter):
    """Rows are (file, text)."""

    def __init__(self, path: str) -> None:
        self.path, self.version = path.rstrip("/"), f"version-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = _store(self.path)
        store.create_dir(f"{base}/{self.version}", recursive=True)
        n = 0
        for row in iterator:
            name = f"{base}/{self.version}/{row['file']}"
            part = f"{base}/{self.version}/.{row['file']}-{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(row["text"].encode())
            store.move(part, name)
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        before = current(self.path)
        store, base = _store(self.path)
        store.create_dir(f"{base}/{self.version}", recursive=True)  # no songs at all
        with store.open_output_stream(f"{base}/.{POINTER}-{self.version}") as f:
            f.write(self.version.encode())
        store.move(f"{base}/.{POINTER}-{self.version}", f"{base}/{POINTER}")
        if before:
            store.delete_dir(_store(before)[1])

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = _store(self.path)
        if store.get_file_info(f"{base}/{self.version}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.version}")


class SongFolder(DataSource):
    """``df.write.format("song_folder").mode("overwrite").save(path)`` of (file, text) rows."""

    @classmethod
    def name(cls) -> str:
        return "song_folder"

    def writer(self, schema: StructType, overwrite: bool) -> SongFolderWriter:
        if not overwrite:
            raise ValueError("a song folder is replaced as a whole: use mode('overwrite')")
        return SongFolderWriter(self.options["path"])


def song_rows(songs: DataFrame) -> DataFrame:
    """(file, text): NNNN.txt and the text of each song; of songs with the same number the last one by ``id``."""
    return song_to_text(best_of(songs, ["n"], F.desc("id"))).select(F.concat(F.lpad(F.col("n").cast("string"), F.greatest(F.lit(4), F.length(F.col("n").cast("string"))), F.lit("0")), F.lit(".txt")).alias("file"), "text")


def write(rows: DataFrame, path: str) -> None:
    """Replace the texts under ``path`` by those of (file, text) rows."""
    rows.sparkSession.dataSource.register(SongFolder)
    rows.select("file", "text").write.format("song_folder").mode("overwrite").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the version that counts."""
    folder = current(path)
    return text_dir(spark, folder) if folder else spark.createDataFrame([], "file string, text string")
