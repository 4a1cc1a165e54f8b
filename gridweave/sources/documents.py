"""Documents in one file, written in parallel.

    df.write.format("one_document").option("head", "[").option("separator", ",").option("foot", "]").mode("append").save(folder)

Rows have one text each and are dealt in the order of the document. Each task writes its part in the shared store; when
all are done, the driver joins the parts in their order by blocks, so neither a task nor the driver ever holds
more than a block, and a document appears whole or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from gridweave.sources.stores import store
from gridweave.workspace import ship

BLOCK = 1 << 22


class Part(WriterCommitMessage):
    def __init__(self, number: int, path: str, rows: int):
        self.number, self.path, self.rows = number, path, rows


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"].rstrip("/"), overwrite
        self.head, self.foot, self.separator = (options.get(k, d) for k, d in (("head", ""), ("foot", ""), ("separator", "\n")))
        self.name, self.run = options.get("name", "document"), uuid.uuid4().hex

    def _parts(self) -> str:
        return f"{self.folder}/_parts-{self.run}"

    def write(self, batches: Iterator) -> Part:
        files, folder = store(self._parts())
        files.create_dir(folder, recursive=True)
        context = TaskContext.get()
        path, n = f"{folder}/{context.partitionId():08d}-{context.taskAttemptId()}", 0
        with files.open_output_stream(path) as out:
            for batch in batches:
                if batch.num_rows:
                    out.write(((self.separator if n else "") + self.separator.join(batch.column(0).to_pylist())).encode())
                    n += batch.num_rows
        return Part(context.partitionId(), path, n)

    def commit(self, messages: list[Part | None]) -> None:
        files, folder = store(self.folder)
        files.create_dir(folder, recursive=True)
        parts, first = sorted((m for m in messages if m), key=lambda m: m.number), True
        whole = f"{store(self._parts())[1]}/whole"
        files.create_dir(store(self._parts())[1], recursive=True)
        with files.open_output_stream(whole) as out:
            out.write(self.head.encode())
            for p in parts:
                if p.rows:
                    out.write(b"" if first else self.separator.encode())
                    first = False
                    with files.open_input_stream(p.path) as part:
                        while block := part.read(BLOCK):
                            out.write(block)
                    files.delete_file(p.path)  # so that the store never holds the document twice
            out.write(self.foot.encode())
        target = f"{folder}/{self.name}"
        if self.overwrite and files.get_file_info(target).type.name == "File":
            files.delete_file(target)
        files.move(whole, target)
        self._forget()

    def abort(self, messages: list[Part | None]) -> None:
        self._forget()

    def _forget(self) -> None:
        files, folder = store(self._parts())
        if files.get_file_info(folder).type.name == "Directory":
            files.delete_dir(folder)


class OneDocument(DataSource):
    """A writer of one text file from rows of one text each."""

    @classmethod
    def name(cls) -> str:
        return "one_document"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if len(schema.fields) != 1:
            raise ValueError("a document is written from one column of texts")
        return _Writer(self.options, overwrite)


def write_document(rows: DataFrame, order: list[Column] | None, folder: str, name: str, head: str = "", separator: str = "\n", foot: str = "") -> None:
    """Write ``value`` of all rows, by ``order``, as the one file ``name`` in a folder; null texts are left out.

    A name that is there already is replaced; other files of the folder stay.
    """
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(OneDocument)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
    texts = dealt.where("value is not null").select("value")
    texts.write.format("one_document").options(head=head, separator=separator, foot=foot, name=name).mode("overwrite").save(folder)
