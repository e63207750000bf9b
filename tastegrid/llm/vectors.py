"""Most similar vectors of every vector: block matrix join on int8 tiles with quantisation error bounds.

Vectors are ordered by the nearest of a bounded sample of pivots and written once to the shared folder as packs of unit vectors,
quantised to int8 with one scale a pack; the norm of each residual is kept, which bounds the
error of a tile's product: |x.y - x'.y'| <= r_x + r_y + r_x*r_y. Each task takes one strip of a pack and streams the other packs past it, those with the
nearest centres first, multiplying tiles of the codes as they are. (Products of int8 codes are whole numbers below 2**24, which float32 holds
exactly; NumPy has no fast integer product, so the tiles are multiplied in that type.) A pair survives if its upper bound reaches the row's
current k-th similarity or the threshold; survivors are recomputed in double precision from the packs and merged into the rows' heaps.

A pack is skipped unread where the angle of the centres less both radii is too wide for any pair to survive. That helps where vectors are
clustered; where they fill all dimensions evenly nothing can be skipped and products grow with the square of the vectors by the method.
The strips read packs from storage instead of shuffling them, so the shuffle stays linear in the vectors. Results are exact: recall is 1.

Defined results: vectors that are null, of another length, with null, NaN or infinite entries, or all zero take
no part; repeated ids count once (latest by ``order_col`` where given); ties go to the lesser id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F

from tastegrid.plans.scratch import cut, parallelism, ship_package, write_table

PACK_ROWS = 8192
TILE_ROWS = 512
TILE_COLUMNS = 1024
#: Vectors sampled as pivots at most.
MAX_PIVOTS = 512
_PACK = "ids binary, codes binary, scale double, residual binary, vectors binary, centre binary, radius double, n int"


@dataclass(frozen=True)
class Pack:
    """Where a pack lies, its rows, and the centre and widest angle of its vectors."""

    path: str
    group: int
    n: int
    centre: np.ndarray
    radius: float


def reachable(packs: list[Pack], mine: int, least: float) -> list[int]:
    """Other packs that can hold a vector of at least this cosine to one of pack ``mine``, nearest centres first."""
    centres, radii = np.stack([p.centre for p in packs]), np.array([p.radius for p in packs])
    gap = np.maximum(np.arccos(np.clip(centres @ packs[mine].centre, -1, 1)) - radii - packs[mine].radius, 0)
    near = np.flatnonzero(np.cos(gap) >= least - 1e-6)
    return [int(i) for i in near[np.argsort(gap[near], kind="stable")] if i != mine]


def _packer(dim: int) -> Callable:
    schema = pa.schema([("ids", pa.binary()), ("codes", pa.binary()), ("scale", pa.float64()), ("residual", pa.binary()), ("vectors", pa.binary()), ("centre", pa.binary()), ("radius", pa.float64()), ("n", pa.int32())])

    def pack(ids: list[str], vectors: np.ndarray) -> pa.RecordBatch:
        x = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        scale = float(np.abs(x).max()) / 127
        codes = np.rint(x / scale).astype(np.int8)
        residual = np.sqrt(((x - codes * scale) ** 2).sum(axis=1)) + 1e-9
        centre = x.mean(axis=0)
        length = float(np.sqrt((centre * centre).sum()))
        centre = centre / length if length > 1e-9 else x[0]
        radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1))) + 1e-6
        names = pa.ipc.new_stream
        sink = pa.BufferOutputStream()
        with names(sink, pa.schema([("id", pa.string())])) as writer:
            writer.write_batch(pa.record_batch([pa.array(ids)], names=["id"]))
        values = (sink.getvalue().to_pybytes(), codes.tobytes(), scale, residual.astype(np.float32).tobytes(), x.tobytes(), centre.tobytes(), radius, len(ids))
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[str] = []
        held: list[np.ndarray] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            held.append(batch.column(1).values.to_numpy(zero_copy_only=False).reshape(-1, dim)[: batch.num_rows] if batch.column(1).offset == 0 else np.array(batch.column(1).to_pylist()))
            while len(ids) >= PACK_ROWS:
                block = np.concatenate(held)
                yield pack(ids[:PACK_ROWS], block[:PACK_ROWS])
                ids, held = ids[PACK_ROWS:], [block[PACK_ROWS:]]
        if ids:
            yield pack(ids, np.concatenate(held))

    return run


def _read(path: str, row_group: int, columns: list[str]) -> dict:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        return pq.ParquetFile(f).read_row_group(row_group, columns=columns).to_pylist()[0]


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Manifest: one row per pack of the files named."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, name = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as f:
                meta = pq.ParquetFile(f)
                rows = [(path, i, *(meta.read_row_group(i, columns=["n", "centre", "radius"]).to_pylist()[0][c] for c in ("n", "centre", "radius"))) for i in range(meta.metadata.num_row_groups)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.float64()))], names=["path", "rg", "n", "centre", "radius"])


def _placer(pivots: np.ndarray, dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, dim)
            cell = np.argmax(x @ pivots.T, axis=1) if len(pivots) else np.zeros(len(x))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], names=["rep", "v", "cell"])

    return run


def _merge(best: np.ndarray, who: np.ndarray, x: np.ndarray, y: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Put candidates (row x, vector y, similarity) into the rows' heaps; returns the touched rows."""
    touched = np.unique(x)
    cx = np.concatenate((x, np.repeat(touched, k)))
    cs = np.concatenate((sim, best[touched].ravel()))
    cy = np.concatenate((y, who[touched].ravel()))
    order = np.lexsort((cy, -cs, cx))
    cx, cs, cy = cx[order], cs[order], cy[order]
    place = np.arange(len(cx)) - np.searchsorted(cx, cx)
    top = place < k
    best[cx[top], place[top]] = cs[top]
    who[cx[top], place[top]] = cy[top]
    return touched


def _strip(packs: list[Pack], dim: int, k: int, least: float) -> Callable:
    """Task of one strip. With a threshold every pack pair is multiplied once and both directions are reported."""
    offsets = np.concatenate(([0], np.cumsum([p.n for p in packs])))
    once = least > -1

    def load(number: int) -> tuple[np.ndarray, float, np.ndarray]:
        r = _read(packs[number].path, packs[number].group, ["codes", "scale", "residual"])
        return np.frombuffer(r["codes"], np.int8).reshape(-1, dim).astype(np.float32), r["scale"], np.frombuffer(r["residual"], np.float32)

    def exact(number: int) -> np.ndarray:
        return np.frombuffer(_read(packs[number].path, packs[number].group, ["vectors"])["vectors"], np.float64).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, begin, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                left, scale_l, res_l = load(mine)
                left, res_l = left[begin:end], res_l[begin:end]
                own = exact(mine)[begin:end]
                rows = end - begin
                best, who = np.full((rows, k), -np.inf), np.full((rows, k), -1, np.int64)
                floor = np.full(rows, least, np.float32)
                tile_of, hit_of = np.empty((TILE_ROWS, TILE_COLUMNS), np.float32), np.empty((TILE_ROWS, TILE_COLUMNS), bool)
                others = [mine, *(i for i in reachable(packs, mine, least) if i > mine or not once)]
                centre, radius = packs[mine].centre, packs[mine].radius
                for other in others:
                    gap = float(np.arccos(np.clip(centre @ packs[other].centre, -1, 1))) - radius - packs[other].radius
                    if other != mine and np.cos(max(gap, 0.0)) < floor.min() - 1e-6:
                        continue
                    right, scale_r, res_r = load(other)
                    unit = np.float32(scale_l * scale_r)
                    vectors = None
                    back = once and other != mine
                    if back:
                        best_r, who_r = np.full((len(right), k), -np.inf), np.full((len(right), k), -1, np.int64)
                        floor_r = np.full(len(right), least, np.float32)
                    for c in range(0, len(right), TILE_COLUMNS):
                        d = min(len(right), c + TILE_COLUMNS)
                        block, worst = np.ascontiguousarray(right[c:d].T), float(res_r[c:d].max())
                        for a in range(0, rows, TILE_ROWS):
                            b = min(rows, a + TILE_ROWS)
                            tile, hit = tile_of[: b - a, : d - c], hit_of[: b - a, : d - c]
                            np.matmul(left[a:b], block, out=tile)
                            slack = res_l[a:b] + worst + res_l[a:b] * worst + 1e-5
                            # a pair survives if its upper bound reaches the floor of its row or, both ways, of its column
                            # (in units of the whole products)
                            need = (floor[a:b] - slack) / unit
                            if other == mine:
                                i = np.arange(max(c, begin + a), min(d, begin + b))
                                tile[i - begin - a, i - c] = -np.inf
                            if not once and not np.isfinite(best[a:b, -1]).all() and k < d - c:
                                need = np.maximum(need, np.partition(tile, -k, axis=1)[:, -k] - 2 * slack / unit)
                            np.greater_equal(tile, need[:, None], out=hit)
                            if back:
                                hit |= tile >= (floor_r[c:d] - slack.max()) / unit
                            if not hit.any():
                                continue
                            x, y = np.nonzero(hit)
                            if vectors is None:
                                vectors = exact(other)
                            sim = np.einsum("ij,ij->i", own[a + x], vectors[c + y])
                            ok = sim >= least
                            x, y, sim = x[ok] + a, y[ok] + c, sim[ok]
                            if not len(x):
                                continue
                            touched = _merge(best, who, x, y + offsets[other], sim, k)
                            floor[touched] = np.maximum(floor[touched], best[touched, -1])
                            if back:
                                touched = _merge(best_r, who_r, y, x + offsets[mine] + begin, sim, k)
                                floor_r[touched] = np.maximum(floor_r[touched], best_r[touched, -1])
                    if back and len(at := np.argwhere(who_r >= 0)):
                        r, c = at.T
                        yield pa.record_batch([pa.array(offsets[other] + r), pa.array(who_r[r, c]), pa.array(best_r[r, c])], names=["a", "b", "similarity"])
                r, c = np.nonzero(who >= 0)
                yield pa.record_batch([pa.array(offsets[mine] + begin + r), pa.array(who[r, c]), pa.array(best[r, c])], names=["a", "b", "similarity"])

    return run


def _ids(packs: list[Pack]) -> Callable:
    offsets = np.concatenate(([0], np.cumsum([p.n for p in packs])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                ids = pa.ipc.open_stream(_read(packs[number].path, packs[number].group, ["ids"])["ids"]).read_all().column(0).combine_chunks()
                yield pa.record_batch([pa.array(offsets[number] + np.arange(len(ids))), ids], names=["at", "id"])

    return run


def most_similar(vectors: DataFrame, id_col: str, vector_col: str, k: int, *, dim: int = 64, min_similarity: float = -1.0, order_col: str | None = None) -> DataFrame:
    """(id, neighbor_id, similarity): up to ``k`` other vectors of the largest cosine, of at least ``min_similarity``."""
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("string").alias("id"), v.alias("v"), (F.col(order_col) if order_col else F.lit(0)).alias("o")).where(F.col("id").isNotNull() & (F.size("v") == dim))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0)).withColumn("cls", F.struct(F.xxhash64("v").alias("p"), F.hash("v").alias("q")))
    # equal vectors are one class: its k+1 least ids stand for all of them
    members = cut(rows.groupBy("id").agg(F.max_by("cls", F.struct("o", "cls")).alias("cls")))
    first = members.withColumn("i", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("i") <= k + 1).groupBy("cls").agg(F.min("id").alias("rep"), F.collect_list("id").alias("ids"))
    one = rows.groupBy("cls").agg(F.first("v").alias("v")).join(first.select("cls", "rep"), "cls").select("rep", "v")
    slots = 4 * parallelism(spark)
    wanted = min(MAX_PIVOTS, -(-first.count() // PACK_ROWS))
    pivots = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").select("v").limit(wanted).collect()], np.float64).reshape(-1, dim) if wanted > 1 else np.zeros((0, dim))
    pivots = pivots / np.maximum(np.sqrt((pivots * pivots).sum(axis=1)), 1e-300)[:, None]
    placed = one.mapInArrow(_placer(pivots, dim), "rep string, v array<double>, cell int").orderBy("cell", "rep").select("rep", "v")
    path = write_table(placed.mapInArrow(_packer(dim), _PACK), "packs", **{"parquet.block.row.count.limit": "1", "compression": "uncompressed"})
    files = spark.createDataFrame([(f,) for f in spark.read.schema(_PACK).parquet(path).inputFiles()], "path string")
    # one entry per PACK_ROWS vectors: their sizes, centres and radii are all the driver sees
    listed = files.repartition(slots).mapInArrow(_packs, "path string, rg int, n int, centre binary, radius double").orderBy("path", "rg").collect()
    packs = [Pack(r["path"], r["rg"], r["n"], np.frombuffer(r["centre"], np.float64), r["radius"]) for r in listed]
    total = sum(p.n for p in packs)
    step = min(PACK_ROWS, max(TILE_ROWS, -(-total // slots)))
    strips = [(i, a, min(p.n, a + step)) for i, p in enumerate(packs) for a in range(0, p.n, step)]
    work = spark.createDataFrame([(i, *s) for i, s in enumerate(strips)], "i int, pack int, first int, last int").repartitionById(max(1, len(strips)), F.col("i")).select("pack", "first", "last")
    near = work.mapInArrow(_strip(packs, dim, k, min_similarity), "a long, b long, similarity double")
    named = spark.range(len(packs)).repartition(max(1, min(len(packs), slots))).mapInArrow(_ids(packs), "at long, rep string")
    # per class: its own least ids and those of the nearest classes; the k+1 best of them hold the k best of every member
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    close = near.withColumn("place", place).where(F.col("place") <= k).drop("place")
    others = close.join(named.toDF("a", "rep"), "a").join(named.toDF("b", "other"), "b").join(first.select(F.col("rep").alias("other"), "ids"), "other").select("rep", "similarity", F.explode("ids").alias("n"))
    same = first.where(F.size("ids") > 1).select("rep", F.lit(1.0).alias("similarity"), F.explode("ids").alias("n"))
    best = others.unionByName(same).groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("d"), "n"))), 1, k + 1).alias("best"))
    lists = first.select("cls", "rep").join(best, "rep").select("cls", "best")
    found = members.join(lists, "cls").select("id", F.explode(F.slice(F.filter("best", lambda x: x["n"] != F.col("id")), 1, k)).alias("x"))
    return found.select("id", F.col("x.n").alias("neighbor_id"), (-F.col("x.d")).alias("similarity"))
