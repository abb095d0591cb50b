"""The N best items of every group, by skipping row groups on their statistics.

1. Rows are clustered: range-partitioned by (group, score, ties), repeated rows
   removed on the way, and written to the shared folder as Parquet. A file holds
   a run of groups, a group of millions of items spreads over many files. Row
   groups end at group edges or within a group's run: the first ``head`` items
   of a run, and all that tie with the last of them, go to head row groups, the
   rest to tail row groups. Both hold many small groups or part of a large one.
2. A file's footer says of every row group which runs it contains, with their
   rows, best and worst score. ``head`` items or more in one place bound the
   group's N-th score. The runs at a file's edges may go on in other files; their
   first scores are listed beside the path and bound the group everywhere.
3. Each task takes the row groups of a file in order of their best score, keeps
   the N best of every run and lowers the runs' N-th scores as it reads. It skips
   a row group that is strictly worse than the current N-th score of every group
   it contains. What the tasks keep, at most N per group and file, is ranked
   once more.

Scores ascend (lowest first); negate for highest first. ``head`` is a matter of
layout, not of N: with N above it tails are read until N items are found.

Defined results
    Rows with a null or non-finite score or tie column are left out, as the
    caller's ``eligible`` filter is. Ties are settled by the tie columns, which
    should end in a unique one; rows equal in group, score and ties count once.
    Groups with fewer items give all. Null group columns are a group. A file
    whose footer lacks the statistics, or has those of another cut, is read whole. Empty tables give an empty
    result; other columns are not carried.

A task that is lost and run again writes a file of its own; only files named in
the index, which is written when all are done, are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.functions.scalars import is_finite
from strandline.session import scratch_table

#: Key of the runs' statistics in a file's footer; one record per row group and run.
RUNS = b"runs"
RUN_RECORD = np.dtype([("row_group", "<i4"), ("run", "<i8"), ("rows", "<i8"), ("best", "<f8"), ("worst", "<f8")])
REPORT_SCHEMA = "path string, row_groups int, read int, rows bigint, rows_read bigint"


def _located(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that are equal where the values are; null is a value."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


class _Clusterer:
    """Writes sorted batches as one file with head and tail row groups and gathers the runs' statistics."""

    def __init__(self, path: str, schema: pa.Schema, groups: Sequence[str], score: str, order: Sequence[str], head: int, row_group_rows: int) -> None:
        self.filesystem, inside = _located(path)
        self.writer = pq.ParquetWriter(inside, schema, filesystem=self.filesystem, compression="zstd", use_dictionary=False)
        self.schema, self.groups, self.score, self.order, self.head, self.most = schema, list(groups), score, list(order), head, row_group_rows
        self.last: pa.Table | None = None
        self.run, self.place, self.edge = -1, 0, np.nan  # of the last row; score that ends the head
        self.waiting: tuple[list, list] = ([], [])
        self.count = [0, 0]
        self.records: list[np.ndarray] = []
        self.row_groups = self.rows = 0
        self.first_scores: list[float] = []
        self.last_scores: list[float] = []
        self.first_row: pa.Table | None = None

    def add(self, batch: pa.RecordBatch) -> None:
        table = pa.Table.from_batches([batch.cast(self.schema)])
        whole = (table if self.last is None else pa.concat_tables([self.last, table])).combine_chunks()
        codes = {c: _codes(whole.column(c).combine_chunks() if isinstance(whole.column(c), pa.ChunkedArray) else whole.column(c)) for c in self.order}
        differs = lambda names: np.any([codes[c][1:] != codes[c][:-1] for c in names], axis=0)
        start = whole.num_rows - table.num_rows
        new_group, new_row = np.ones(whole.num_rows, bool), np.ones(whole.num_rows, bool)
        new_group[1:], new_row[1:] = differs(["group_no", *self.groups]), differs(self.order)
        keep = np.flatnonzero(new_row[start:]) + start
        if self.first_row is None:
            self.first_row = table.slice(0, 1)
        self.last = whole.slice(whole.num_rows - 1)
        if not len(keep):
            return
        whole = whole.take(pa.array(keep))
        # a repeated row may carry a group's first mark only together with its row's mark: marks survive
        change, scores = new_group[keep], whole.column(self.score).to_numpy()
        run = self.run + np.cumsum(change)
        starts = np.flatnonzero(change)
        first = np.concatenate([[0], starts]) if not change[0] else starts
        offset = np.zeros(len(first), np.int64)
        if not change[0]:
            offset[0] = self.place + 1
        size = np.diff([*first, len(run)])
        place = np.arange(len(run)) - np.repeat(first - offset, size)
        # the score of the run's last head item: carried, in this batch, or not reached yet
        at = first + (self.head - 1 - offset)
        edge = np.full(len(first), np.inf)
        inside = (at >= first) & (at < first + size)
        edge[inside] = scores[at[inside]]
        if not change[0] and offset[0] >= self.head:
            edge[0] = self.edge
        tail = (place >= self.head) & (scores > np.repeat(edge, size))
        self.run, self.place, self.edge = int(run[-1]), int(place[-1]), float(edge[-1])
        for k, mine in enumerate((~tail, tail)):
            where = np.flatnonzero(mine)
            if len(where):
                self.waiting[k].append((whole.take(pa.array(where)), run[where]))
                self.count[k] += len(where)
                while self.count[k] >= self.most:
                    self._flush(k)
        if len(self.first_scores) < self.head:
            self.first_scores += scores[(run == 0) & (place < self.head)].tolist()
        if starts.size:
            self.last_scores = []
        self.last_scores += scores[(run == run[-1]) & (place < self.head)].tolist()

    def _flush(self, k: int) -> None:
        """One row group of at most ``most`` rows."""
        table, run = pa.concat_tables([t for t, _ in self.waiting[k]]), np.concatenate([r for _, r in self.waiting[k]])
        rest = (table.slice(self.most), run[self.most :])
        table, run = table.slice(0, self.most), run[: self.most]
        self.waiting[k][:] = [rest] if len(rest[1]) else []
        self.count[k] = len(rest[1])
        self.writer.write_table(table, row_group_size=self.most)
        scores = table.column(self.score).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        record = np.zeros(len(first), RUN_RECORD)
        record["row_group"], record["run"], record["rows"] = self.row_groups, run[first], np.diff([*first, len(run)])
        record["best"], record["worst"] = scores[first], np.maximum.reduceat(scores, first)
        self.records.append(record)
        self.row_groups += 1
        self.rows += len(run)

    def close(self) -> None:
        for k in (0, 1):
            if self.count[k]:
                self._flush(k)
        self.writer.add_key_value_metadata({RUNS: np.concatenate(self.records).tobytes().hex()})
        self.writer.close()


def cluster(frame: DataFrame, groups: Sequence[str], score: str, ties: Sequence[str], path: str, *, head: int = 16, row_group_rows: int = 4096) -> DataFrame:
    """Writes the clustered files below ``path`` and returns their index: path, rows and edges (group, first scores in this file)."""
    spark = frame.sparkSession
    order = ["group_no", *groups, score, *ties]
    ranged = frame.select(F.xxhash64(*groups).alias("group_no"), *groups, score, *ties).repartitionByRange(*order).sortWithinPartitions(*order)
    edge = StructType([*ranged.select(*groups).schema.fields]).simpleString()
    schema = f"path string, rows bigint, row_groups int, edges array<struct<place:string,group:{edge},scores:array<double>>>"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, name = None, f"{path}/{uuid.uuid4().hex}.parquet"
        for batch in batches:
            if not batch.num_rows:
                continue
            if own is None:
                types = pa.schema([pa.field(f.name, f.type) for f in batch.schema])
                own = _Clusterer(name, types, groups, score, order, head, row_group_rows)
            own.add(batch)
        if own is not None:
            own.close()
            key = lambda row: {c: row.column(c)[0].as_py() for c in groups}
            edges = [{"place": "first", "group": key(own.first_row), "scores": own.first_scores}]
            if own.run:
                edges.append({"place": "last", "group": key(own.last), "scores": own.last_scores})
            group = pa.struct([own.schema.field(c) for c in groups])
            kind = pa.list_(pa.struct([("place", pa.string()), ("group", group), ("scores", pa.list_(pa.float64()))]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([own.rows]), pa.array([own.row_groups], pa.int32()), pa.array([edges], kind)], names=["path", "rows", "row_groups", "edges"]
            )

    _make_folder(frame, path)
    index = f"{path}/index"
    ranged.mapInArrow(write, schema).write.parquet(index)
    return spark.read.schema(schema).parquet(index)


def _make_folder(frame: DataFrame, path: str) -> None:
    jvm = frame.sparkSession._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).mkdirs(folder)


def edge_bounds(index: DataFrame, n: int) -> DataFrame:
    """(path, first_bound, last_bound): the least N-th score that any file gives for the groups at a file's edges."""
    edges = index.select("path", F.explode("edges").alias("edge")).select("path", "edge.place", F.struct("edge.group").alias("key"), F.try_element_at("edge.scores", F.lit(n)).alias("nth"))
    # a hot group is an edge of every file it reaches: counted per file, not per row
    bound = edges.groupBy("key").agg(F.min("nth").alias("bound"))
    joined = edges.select("path", "place", "key").join(bound, edges["key"].eqNullSafe(bound["key"]))
    of = lambda place: F.max(F.when(F.col("place") == place, F.col("bound")))
    return joined.groupBy("path").agg(of("first").alias("first_bound"), of("last").alias("last_bound"))


def _runs(metadata: pq.FileMetaData) -> np.ndarray | None:
    found = (metadata.metadata or {}).get(RUNS)
    if found is None:
        return None
    records = np.frombuffer(bytes.fromhex(found.decode()), RUN_RECORD)
    # statistics carried over to a file that was cut anew are none
    rows = np.bincount(records["row_group"], records["rows"], metadata.num_row_groups)
    return records if [metadata.row_group(k).num_rows for k in range(metadata.num_row_groups)] == rows.tolist() else None


class _Reader:
    """The row groups of a file that may hold one of the N best, in order of their best score."""

    def __init__(self, path: str, n: int, first_bound: float | None, last_bound: float | None) -> None:
        filesystem, inside = _located(path)
        self.file, self.n = pq.ParquetFile(inside, filesystem=filesystem), n
        self.total = self.file.metadata.num_row_groups
        self.read = self.rows_read = 0
        self.records = _runs(self.file.metadata)
        if self.records is None:
            return
        runs = int(self.records["run"].max()) + 1
        self.nth = np.full(runs, np.inf)
        enough = self.records[self.records["rows"] >= n]
        np.minimum.at(self.nth, enough["run"], enough["worst"])
        for run, bound in ((0, first_bound), (runs - 1, last_bound)):
            if bound is not None:
                self.nth[run] = min(self.nth[run], bound)

    def parts(self, columns: Sequence[str], groups: Sequence[str], score: str) -> Iterator[pa.Table]:
        if self.records is None:
            for k in range(self.total):
                yield self._take(k, columns, groups)[0]
            return
        first = np.flatnonzero(np.concatenate([[True], self.records["row_group"][1:] != self.records["row_group"][:-1]]))
        for k in np.argsort(np.minimum.reduceat(self.records["best"], first), kind="stable").tolist():
            mine = self.records[first[k] : first[k + 1] if k + 1 < len(first) else None]
            if (mine["best"] > self.nth[mine["run"]]).all():
                continue
            part, starts, size = self._take(int(mine["row_group"][0]), columns, groups)
            if len(starts) == len(mine):
                full = size >= self.n
                scores = part.column(score).to_numpy()
                at = np.cumsum(np.minimum(size, self.n)) - 1
                self.nth[mine["run"][full]] = np.minimum(self.nth[mine["run"][full]], scores[at[full]])
            yield part

    def _take(self, k: int, columns: Sequence[str], groups: Sequence[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """The N first rows of each run of a row group."""
        table = self.file.read_row_group(k, columns=["group_no", *columns])
        self.read, self.rows_read = self.read + 1, self.rows_read + table.num_rows
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for c in ("group_no", *groups):
            codes = _codes(table.column(c).combine_chunks())
            change[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(change)
        size = np.diff([*starts, table.num_rows])
        place = np.arange(table.num_rows) - np.repeat(starts, size)
        return table.select(columns).filter(pa.array(place < self.n)), starts, size


def _plan(index: DataFrame, n: int) -> DataFrame:
    files = index.join(edge_bounds(index, n), "path", "left").select("path", "rows", "row_groups", "first_bound", "last_bound")
    # paths are few bytes each: by size the plan would shrink to one task
    return files.repartition(max(1, index.count()))


def prepared(frame: DataFrame, groups: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """Rows that can be ranked: finite scores and ties; minus zero and zero are one score."""
    numeric = [c for c in (score, *ties) if frame.schema[c].dataType.simpleString() in ("double", "float")]
    usable = frame.select(*groups, score, *ties)
    for c in (score, *ties):
        usable = usable.where(is_finite(c) if c in numeric else F.col(c).isNotNull())
    return usable.withColumns({c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)).cast("double") for c in {*numeric, score}})


def best_of_index(index: DataFrame, schema: StructType, groups: Sequence[str], score: str, ties: Sequence[str], n: int) -> DataFrame:
    """(groups, score, ties, rank) of the ``n`` lowest scores of each group of clustered files."""
    columns = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = _Reader(row["path"], n, row["first_bound"], row["last_bound"])
                for part in reader.parts(columns, groups, score):
                    yield from part.combine_chunks().to_batches()

    kept = _plan(index, n).mapInArrow(read, schema)
    best = Window.partitionBy(*groups).orderBy(score, *ties)
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def skipping_report(index: DataFrame, schema: StructType, groups: Sequence[str], score: str, n: int) -> DataFrame:
    """(path, row_groups, read, rows, rows_read): what reading the ``n`` best of each file takes."""
    columns = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = _Reader(row["path"], n, row["first_bound"], row["last_bound"])
                for _ in reader.parts(columns, groups, score):
                    pass
                values = (row["path"], reader.total, reader.read, row["rows"], reader.rows_read)
                types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[x.split()[0] for x in REPORT_SCHEMA.split(", ")])

    return _plan(index, n).mapInArrow(read, REPORT_SCHEMA)


def top_n(frame: DataFrame, groups: Sequence[str], score: str, ties: Sequence[str], n: int, *, head: int = 16, row_group_rows: int = 4096) -> DataFrame:
    """(groups, score, ties, rank) of the ``n`` lowest scores of each group."""
    if n < 1:
        raise ValueError("n must be positive")
    usable = prepared(frame, groups, score, ties)
    index = cluster(usable, groups, score, ties, scratch_table(frame.sparkSession, "topn"), head=head, row_group_rows=row_group_rows)
    return best_of_index(index, usable.schema, groups, score, ties, n)
