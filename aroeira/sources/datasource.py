"""``spark.read.format("dbc")`` and ``df.write.format("dbc")``.

One task per file.  Options: ``path`` (a file, a folder, a pattern, or several with
commas, as paths or URIs of storage all executors see: local, HDFS, object stores), ``encoding``, ``columns`` (names with commas:
only these are decoded), ``file_column`` (name of an added column with the file's name),
``criteria`` (equality and membership criteria as JSON, applied while decoding, the
text fields they name need not be selected).  Filters of a query are left to Spark: a
reader that takes them keeps them for later queries on the same DataFrame.
"""

from __future__ import annotations

import fnmatch
import glob
import json
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..session import ship
from . import dbc, dbf


def files_of(path: str) -> list[str]:
    """The files a path option names; a folder gives its DBC and DBF files, a pattern those of its folder that fit."""
    out: list[str] = []
    for p in (x.strip() for x in path.split(",")):
        system, inner = dbc.located(p)
        scheme = p[: len(p) - len(inner)] if "://" in p and p.endswith(inner) else ""
        info = system.get_file_info(inner)
        folder, pattern = (inner, "*.[dD][bB][cCfF]") if info.type == fs.FileType.Directory else os.path.split(inner)
        if info.type == fs.FileType.File or not any(c in pattern for c in "*?["):
            out.append(p)
            continue
        found = system.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
        out += sorted(scheme + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern))
    return list(dict.fromkeys(out))


@dataclass
class FilePartition(InputPartition):
    path: str


class DbcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbc"

    def schema(self) -> T.StructType:
        files = files_of(self.options["path"])
        if not files:
            raise ValueError("no file to take the schema from")
        fields = {}
        with ThreadPoolExecutor(16) as pool:  # only headers are read, many at a time
            for header in pool.map(lambda p: dbf.read_header(dbc.read_bytes(p, 65536)), files):
                for s in header.schema:
                    fields.setdefault(s.name, s)
        wanted = [c for c in self.options.get("columns", "").split(",") if c]
        chosen = [fields[c] for c in wanted] if wanted else list(fields.values())
        if self.options.get("file_column"):
            chosen.append(T.StructField(self.options["file_column"], T.StringType()))
        return T.StructType(chosen)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DbcFileReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return DbcFileWriter(dict(self.options), schema, overwrite)


class DbcFileReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.options, self.schema = options, schema
        objects = json.loads(options.get("criteria", "[]"))
        self.tests = [(o["prop"], [o["value"]] if o["type"] == "string" else list(o["value"])) for o in objects]

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(p) for p in files_of(self.options["path"])]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        reader = dbc.DbcReader(partition.path, self.options.get("encoding", "latin-1"))
        for batch in reader.batches([*self.schema.names, *(c for c, _ in self.tests)]):
            for c, values in self.tests:
                if c not in batch.schema.names or not pa.types.is_string(batch.schema.field(c).type):
                    batch = batch.slice(0, 0)
                else:
                    batch = batch.filter(pc.is_in(batch.column(c), pa.array(values, pa.string())))
            columns = []
            for f in target:
                if f.name == self.options.get("file_column"):
                    columns.append(pa.array([os.path.basename(partition.path)] * batch.num_rows, f.type))
                elif f.name in batch.schema.names:
                    columns.append(batch.column(f.name).cast(f.type))
                else:
                    columns.append(pa.nulls(batch.num_rows, f.type))
            yield pa.RecordBatch.from_arrays(columns, schema=target)


@dataclass
class Written(WriterCommitMessage):
    path: str
    final: str


class DbcFileWriter(DataSourceWriter):
    """One file per task under ``path``, which must be on shared storage; use ``coalesce(1)`` for a single file."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.folder, self.overwrite, self.encoding = options["path"].removeprefix("file://"), overwrite, options.get("encoding", "latin-1")
        sizes = dict(x.split(":") for x in options.get("sizes", "").split(",") if x)
        self.fields = dbf.fields_of(schema, {k: int(v) for k, v in sizes.items()})

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        final = os.path.join(self.folder, f"part-{task.partitionId():05d}.dbc")
        path = f"{final}.{task.taskAttemptId()}"
        table = dbf.write_table(self.fields, (r.asDict() for r in iterator), self.encoding)
        with open(path, "wb") as out:
            out.write(dbc.from_dbf(table))
        return Written(path, final)

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for old in glob.glob(os.path.join(self.folder, "*.dbc")):
                os.remove(old)
        for i, m in enumerate(x for x in messages if x is not None):
            final = m.final
            if not self.overwrite:
                while os.path.exists(final):
                    final = f"{final.removesuffix('.dbc')}-{i}.dbc"
            os.replace(m.path, final)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(DbcDataSource)
