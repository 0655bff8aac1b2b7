"""Sinks for graphs, written by executors and put in place by one commit, and their readers.

    spark.dataSource.register(GraphFiles)
    edges.write.format("graph_files").option("kind", "graphml").mode("append").save(path)

Each task writes one whole document of the kind (its edges and the nodes they touch) under
``path/_writing/<job>``; the commit moves the documents next to each other under ``path``
and marks them, an abort removes what the job has written. A task that fails or is run
twice leaves only files that the commit does not name. ``path`` may be any file system
Arrow knows (``file:``, ``hdfs:``, ``s3:``), shared by all executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

KINDS = ("graphml", "gexf")
HEADS = {
    "graphml": '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="weight" for="edge" attr.name="weight" attr.type="double"/>\n<graph edgedefault="directed">\n',
    "gexf": '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n<graph defaultedgetype="directed" mode="static">\n<edges>\n',
}


def _edge(kind: str, i: int, src: str, dst: str, weight: float | None) -> str:
    a, b = quoteattr(src), quoteattr(dst)
    if kind == "graphml":
        data = "" if weight is None else f'<data key="weight">{weight!r}</data>'
        return f"<edge source={a} target={b}>{data}</edge>\n"
    w = "" if weight is None else f' weight="{weight!r}"'
    return f'<edge id="{i}" source={a} target={b}{w}/>\n'


def _tail(kind: str, nodes: list[str]) -> Iterator[str]:
    if kind == "graphml":
        yield from (f"<node id={quoteattr(n)}/>\n" for n in nodes)
        yield "</graph>\n</graphml>\n"
    else:
        yield "</edges>\n<nodes>\n"
        yield from (f"<node id={quoteattr(n)} label={quoteattr(n)}/>\n" for n in nodes)
        yield "</nodes>\n</graph>\n</gexf>\n"


@dataclass
class Written(WriterCommitMessage):
    """A task's document, or none where it had no edges."""

    file: str | None
    edges: int


class GraphWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str):
        self.path, self.kind, self.job = path.rstrip("/"), kind, uuid.uuid4().hex

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        files, top = self._place()
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.{self.kind}"
        nodes: dict[str, None] = {}
        n, out = 0, None
        try:
            for row in iterator:
                if out is None:
                    files.create_dir(f"{top}/_writing/{self.job}", recursive=True)
                    out = files.open_output_stream(f"{top}/_writing/{self.job}/{name}")
                    out.write(HEADS[self.kind].encode())
                src, dst = str(row["src"]), str(row["dst"])
                weight = row.asDict().get("weight")
                out.write(_edge(self.kind, n, src, dst, None if weight is None else float(weight)).encode())
                nodes[src] = nodes[dst] = None
                n += 1
            if out is not None:
                for line in _tail(self.kind, sorted(nodes)):
                    out.write(line.encode())
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, top = self._place()
        files.create_dir(top, recursive=True)
        for m in messages:
            if m is not None and m.file is not None:
                files.move(f"{top}/_writing/{self.job}/{m.file}", f"{top}/{self.job}-{m.file}")
        self._clear(files, top)
        files.open_output_stream(f"{top}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._place())

    def _clear(self, files, top: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{top}/_writing/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{top}/_writing/{self.job}")
        if files.get_file_info(f"{top}/_writing").type != fs.FileType.NotFound and not files.get_file_info(fs.FileSelector(f"{top}/_writing")):
            files.delete_dir(f"{top}/_writing")


class GraphFiles(DataSource):
    """Sink of edges ``(src, dst[, weight])``; options ``path`` and ``kind`` (graphml or gexf)."""

    @classmethod
    def name(cls) -> str:
        return "graph_files"

    def schema(self) -> str:
        return "src string, dst string, weight double"

    def writer(self, schema, overwrite: bool) -> GraphWriter:
        kind = self.options.get("kind", "graphml")
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        if overwrite:
            raise ValueError("graph_files only appends")
        return GraphWriter(self.options["path"], kind)


def write_graph(edges: DataFrame, path: str, kind: str = "graphml") -> None:
    """Edges as documents under ``path``, one for each partition that has any."""
    edges.sparkSession.dataSource.register(GraphFiles)
    edges.write.format("graph_files").option("kind", kind).mode("append").save(path)


def read_graph(spark: SparkSession, path: str, kind: str = "graphml") -> DataFrame:
    """(src, dst, weight) of all documents under ``path``."""
    fields = "_source string, _target string, " + ("data struct<_VALUE: double, _key: string>" if kind == "graphml" else "_weight double")
    rows = spark.read.format("xml").option("rowTag", "edge").schema(fields).load(f"{path}/*.{kind}")
    return rows.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.col("data._VALUE" if kind == "graphml" else "_weight").alias("weight"))
