"""Folders that driver and executors share, and files written by executors."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name under ``spark.checkpoint.dir``; where that is unset, a temporary one if all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: driver and executors need a folder that all of them see")
        own = tempfile.mkdtemp(prefix="quillstone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or path, and the path there; paths are taken as they are, without escapes."""
    scheme, colon, rest = uri.partition(":/")
    if not colon or scheme == "file":
        return _file_system("file:///")[0], "/" + (rest if colon else uri).lstrip("/")
    authority, _, path = rest.removeprefix("/").partition("/")
    fs, root = _file_system(f"{scheme}://{authority}/")
    return fs, f"{root.rstrip('/')}/{path}"


@functools.cache
def _file_system(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def write_files(df: DataFrame, folder: str) -> int:
    """Writes each row ``(name, content)`` as a file and returns how many. A task that runs again, or twice at once, writes the same files:
    each attempt under a name of its own, then moved."""

    def run(batches):
        (fs, root), made = pafs.FileSystem.from_uri(folder), set()
        for b in batches:
            names, contents = b.column(0), b.column(1)
            for i in range(b.num_rows):  # one content at a time
                path = f"{root}/{names[i].as_py()}"
                if (parent := path.rpartition("/")[0]) not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                own = f"{path}._{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as out:
                    out.write(contents[i].as_buffer())
                fs.move(own, path)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return df.select("name", "content").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


def write_named_texts(df: DataFrame, folder: str, by: list[str]) -> None:
    """Writes each row's ``content``, a text of one line, as a file of its own in the folder of its ``by``. Spark's writer does it, row by
    row: however large the texts are, no batch of them is held."""
    df.select(*by, "content").write.partitionBy(*by).text(folder)
