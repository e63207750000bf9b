"""Top N items within every group by statistics-guided skipping.

The edges are written once, clustered by group: range-partitioned and sorted by (group, score
descending), so a huge group spans several files and each file holds few groups. The footers then
give every row group's range of groups and best score, without reading rows. Row groups of one single group are read together, whatever
file they lie in, in descending best score; once a group has N items, every further row group whose best score is strictly below
its N-th score is left unread. Row groups of several small groups are read as a whole. At most N rows per group and reader remain and are merged.

Defined results: rows with a null group, item or score, with a NaN score, or whose item is the group itself
are left out; an item given several times counts once with its highest score; ties go to the lesser item;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F

from tastegrid.plans.scratch import parallelism, ship_package, write_table

ROW_GROUP_ROWS = 8192
_OUT = "grp string, item string, score double"


def _open(path: str) -> pq.ParquetFile:
    fs, name = pafs.FileSystem.from_uri(path)
    return pq.ParquetFile(fs.open_input_file(name))


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per row group from the footers: path, number, first and last group, best score."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            meta = _open(path).metadata
            out = []
            for i in range(meta.num_row_groups):
                g = meta.row_group(i)
                stats = {g.column(c).path_in_schema: g.column(c).statistics for c in range(g.num_columns)}
                s, k = stats["score"], stats["grp"]
                known = s is not None and s.has_min_max and k is not None and k.has_min_max
                out.append((path, i, *((k.min, k.max, s.max) if known else (None, None, float("inf")))))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64()))], names=["path", "rg", "lo", "hi", "best"])


class _Best:
    """Current best items of a group: item -> score, at most n of them, with the n-th score."""

    def __init__(self, n: int) -> None:
        self.n, self.score = n, {}
        self.nth = float("-inf")

    def add(self, items: list[str], scores: np.ndarray) -> None:
        held = self.score
        for item, s in zip(items, scores.tolist()):
            if s > held.get(item, float("-inf")) or item not in held:
                held[item] = s
        if len(held) >= self.n:
            top = sorted(held.items(), key=lambda x: (-x[1], x[0].encode()))[: self.n]
            self.score, self.nth = dict(top), top[-1][1]


def _add(table: pa.Table, tops: dict[str, _Best], n: int) -> None:
    group = table.column("grp").combine_chunks().dictionary_encode()
    code, names = group.indices.to_numpy(), group.dictionary.to_pylist()
    items, score = np.array(table.column("item").to_pylist(), object), table.column("score").to_numpy()
    order = np.argsort(code, kind="stable")
    bounds = np.searchsorted(code[order], np.arange(len(names) + 1))
    for k, name in enumerate(names):
        at = order[bounds[k] : bounds[k + 1]]
        top = tops.setdefault(name, _Best(n))
        at = at[score[at] >= top.nth]
        if len(at) > 4 * n:
            best_of: dict[str, float] = {}
            for i in at[np.argsort(-score[at], kind="stable")].tolist():
                best_of.setdefault(items[i], score[i])
                if len(best_of) == n:  # n different items score at least this
                    at = at[score[at] >= score[i]]
                    break
        top.add(items[at].tolist(), score[at])


def _reader(n: int, report: bool) -> Callable:
    """Best rows of the row groups that arrive; with ``report`` (rows groups listed, row groups read) instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes: dict[tuple, list[tuple]] = {}
        listed = read = 0
        for batch in batches:
            for path, rg, lo, hi, best in zip(*(batch.column(c).to_pylist() for c in range(5))):
                homes.setdefault(("group", lo) if lo is not None and lo == hi else ("file", path), []).append((best, path, rg))
        for (kind, name), row_groups in homes.items():
            tops: dict[str, _Best] = {}
            files: dict[str, pq.ParquetFile] = {}
            listed += len(row_groups)
            for best, path, rg in sorted(row_groups, key=lambda x: (-x[0], x[1:])):
                if kind == "group" and name in tops and best < tops[name].nth:
                    break  # the rest are no better
                if path not in files:
                    files[path] = _open(path)
                _add(files[path].read_row_group(rg, columns=["grp", "item", "score"]), tops, n)
                read += 1
            if report:
                continue
            rows = [(g, i, s) for g, t in tops.items() for i, s in sorted(t.score.items(), key=lambda x: (-x[1], x[0].encode()))[:n]]
            for i in range(0, len(rows), 50_000):
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 50_000]), (pa.string(), pa.string(), pa.float64()))], names=["grp", "item", "score"])
        if report and listed:
            yield pa.record_batch([pa.array([listed]), pa.array([read])], names=["listed", "read"])

    return run


def _row_groups(edges: DataFrame, group_col: str, item_col: str, score_col: str, row_group_rows: int) -> DataFrame:
    """Writes the clustered table; its row groups, those of one group in one partition, the others by file."""
    spark = edges.sparkSession
    ship_package(spark)
    clean = edges.select(F.col(group_col).cast("string").alias("grp"), F.col(item_col).cast("string").alias("item"), F.col(score_col).cast("double").alias("score")).where("grp is not null and item is not null and score is not null and not isnan(score) and grp <> item")
    clustered = clean.repartitionByRange(parallelism(spark), "grp", F.desc("score")).sortWithinPartitions("grp", F.desc("score"))
    path = write_table(clustered, "topn", **{"parquet.block.row.count.limit": str(row_group_rows), "compression": "zstd"})
    files = spark.read.schema(_OUT).parquet(path).inputFiles()
    tasks = max(1, min(len(files), 4 * parallelism(spark)))
    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(tasks)
    manifest = listed.mapInArrow(_manifest, "path string, rg int, lo string, hi string, best double")
    home = F.when(F.col("lo") == F.col("hi"), F.concat(F.lit("group "), "lo")).otherwise(F.concat(F.lit("file "), "path"))
    return manifest.repartition(tasks, home)


def row_groups_read(edges: DataFrame, group_col: str, item_col: str, score_col: str, n: int, *, row_group_rows: int = ROW_GROUP_ROWS) -> tuple[int, int]:
    """(row groups of the clustered table, those read for the ``n`` best items of every group)."""
    done = _row_groups(edges, group_col, item_col, score_col, row_group_rows).mapInArrow(_reader(n, True), "listed long, read long").agg(F.sum("listed"), F.sum("read")).first()
    return done[0] or 0, done[1] or 0


def top_n(edges: DataFrame, group_col: str, item_col: str, score_col: str, n: int, *, row_group_rows: int = ROW_GROUP_ROWS) -> DataFrame:
    """(group_col, item_col, score_col, rank): the ``n`` best items of every group, rank 1 first."""
    found = _row_groups(edges, group_col, item_col, score_col, row_group_rows).mapInArrow(_reader(n, False), _OUT)
    merged = found.groupBy("grp", "item").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "item"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= n).toDF(group_col, item_col, score_col, "rank")
