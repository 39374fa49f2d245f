"""Approximate vector search: cells around centroids, with product-quantised residuals.

Centroids and codebooks are fitted in rounds over a sample of bounded size, SAMPLE rows by a hash of their id; every row is indexed.
A round assigns the sample in tasks and brings one sum a centroid back. Cells that draw much more than their share are divided
among those that draw little. How many cells a search reads is measured on the sample: so many that TARGET of the true neighbours lie in them.

The index is a table partitioned by cell. A row is a block of up to BLOCK vectors: their ids, and for each the
numbers of the nearest codewords of its residual's parts. A search reads the cells that its questions are near to and no
others, rebuilds vectors from codes block by block, and keeps a few times k candidates of each question, which are then compared
exactly. Cells of many blocks and cells of many questions are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.session import cut_lineage

SAMPLE = 65_536
MOST_CELLS = 16_384
CODES = 256
ROUNDS = 6
UNEVEN = 3
BLOCK = 4_096
PACK = 256  # questions compared with a block at once, about
TASK_SIDE = 16  # blocks, and packs, of one cell that one join key may hold
TARGET = 0.96
TRIAL, TRIAL_K = 256, 10
RERANK = 6
SCALE = 1 << 24  # sums over the sample are whole numbers, the same in any order


@dataclass
class Model:
    centroids: np.ndarray  # cells x width
    books: np.ndarray  # parts x codewords x width of a part
    probes: int

    @property
    def width(self) -> int:
        return self.centroids.shape[1]


def _rows_of(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a column can be used, and these as unit vectors: not null, not zero, without gaps, all of one width."""
    held = [v if v is not None and len(v) and None not in v else None for v in column.to_pylist()]
    width = width or next((len(v) for v in held if v), 0)
    usable = np.array([v is not None and len(v) == width and any(v) for v in held], bool)
    rows = np.array([v for v, ok in zip(held, usable, strict=True) if ok], np.float64).reshape(-1, width)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    usable[usable] = np.isfinite(norms[:, 0])
    return usable, (rows / norms)[np.isfinite(norms[:, 0])].astype(np.float32)


def _nearest_code(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The number of the nearest center of each part: x is rows x parts x width."""
    half = (centers * centers).sum(axis=2) / 2
    return np.stack([np.argmin(half[p][None, :] - x[:, p] @ centers[p].T, axis=1) for p in range(centers.shape[0])], axis=1)


def _packed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _refine(sample: DataFrame, width: int, centers: np.ndarray, rounds: int, balance: bool) -> np.ndarray:
    """Centers (parts x codes x width of a part) after some rounds over rows (v: bytes of a vector)."""
    parts, codes, part_width = centers.shape
    for turn in range(rounds):
        sent = sample.sparkSession.sparkContext.broadcast(centers)

        def sums(batches, sent=sent):
            total = np.zeros((parts * codes, part_width + 1), np.int64)
            for batch in batches:
                x = _packed(batch.column(0), width).reshape(-1, parts, part_width)
                at = _nearest_code(x, sent.value) + np.arange(parts)[None, :] * codes
                np.add.at(total, at.ravel(), np.append(np.rint(x.reshape(-1, part_width) * SCALE).astype(np.int64), np.ones((at.size, 1), np.int64), axis=1))
            some = np.nonzero(total[:, -1])[0]
            flat = np.repeat(some, part_width + 1) * (part_width + 1) + np.tile(np.arange(part_width + 1), len(some))
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(total[some].ravel())], names=["i", "s"])

        got = sample.mapInArrow(sums, "i long, s long").groupBy("i").agg(F.sum("s").alias("s")).toPandas()  # one row a coordinate of a center
        total = np.zeros(parts * codes * (part_width + 1), np.int64)
        total[got["i"].to_numpy(np.int64)] = got["s"].to_numpy(np.int64)
        total = total.reshape(parts, codes, part_width + 1)
        n = total[..., -1:]
        centers = np.where(n > 0, total[..., :-1] / SCALE / np.maximum(1, n), centers).astype(np.float32)
        if balance and turn < rounds - 2:
            drawn, rng = n[0, :, 0], np.random.default_rng(turn)
            large = [c for c in np.argsort(-drawn, kind="stable") if drawn[c] > UNEVEN * drawn.mean()]
            for c, small in zip(large, np.argsort(drawn, kind="stable"), strict=False):
                if drawn[small] < drawn.mean() / UNEVEN:
                    centers[0, small] = centers[0, c] + rng.standard_normal(part_width).astype(np.float32) * 0.05
    return centers


def parts_of(width: int) -> int:
    """How many codes a vector has: one for two numbers where that divides the width, 96 at most."""
    return max(p for p in range(1, min(96, max(1, width // 2)) + 1) if width % p == 0)


def fit(vectors: DataFrame, id_col: str = "document_id", sample_rows: int = SAMPLE, cells: int | None = None, target: float = TARGET) -> Model | None:
    """A model from at most about ``sample_rows`` rows of (id, embedding); None where there is no vector.

    The width is the first usable one's by hash of the id; vectors of another width, zero and null ones take no part.
    """
    spark = vectors.sparkSession
    usable = vectors.where(F.col("embedding").isNotNull() & F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col("embedding").cast("array<float>").alias("v"))
    n = usable.count()
    first = usable.where(F.size("v") > 0).orderBy("h", F.xxhash64("v")).first()
    if first is None:
        return None
    width = len(first.v)
    picked = usable.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(min(1.0, sample_rows / n) * (1 << 30)))

    def pack(batches):
        for batch in batches:
            ok, rows = _rows_of(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["h", "v"])

    sample = cut_lineage(picked.mapInArrow(pack, "h long, v binary").repartition(max(1, min(64, n // 2_048))))
    n_sample = sample.count()
    if not n_sample:
        return None
    some = lambda df, k, *order: np.frombuffer(b"".join(bytes(r.v) for r in df.orderBy(*order).limit(k).collect()), np.float32).reshape(-1, width)
    cells = cells or int(np.clip(round(n**0.5), 1, min(MOST_CELLS, n_sample)))
    start = some(sample, cells, "h", "v")
    coarse = _refine(sample.select("v"), width, start[None], ROUNDS, balance=True)[0]
    sent = spark.sparkContext.broadcast(coarse)

    def rest(batches):
        for batch in batches:
            x = _packed(batch.column(1), width)
            left = x - sent.value[_nearest_code(x[:, None], sent.value[None])[:, 0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in left], pa.binary())], names=["h", "v"])

    residuals = cut_lineage(sample.mapInArrow(rest, "h long, v binary"))
    parts = parts_of(width)
    words = some(residuals, CODES, "h", "v")
    books = np.ascontiguousarray(words.reshape(len(words), parts, width // parts).swapaxes(0, 1))
    books = _refine(residuals.select("v"), width, books, ROUNDS - 2, balance=False)
    # questions from the other end of the order: rows that centroids began at lie nearer to them than others
    return Model(coarse, books, _probes(sample, coarse, some(sample, TRIAL, F.desc("h"), "v"), target))


def _probes(sample: DataFrame, centroids: np.ndarray, trial: np.ndarray, target: float) -> int:
    """How many of the nearest cells hold ``target`` of the nearest rows of the sample, for TRIAL questions out of it."""
    sent = sample.sparkSession.sparkContext.broadcast((centroids, trial))

    def near(batches):
        centroids, trial = sent.value
        half = (centroids * centroids).sum(axis=1) / 2
        place = np.argsort(np.argsort(half[None, :] - trial @ centroids.T, axis=1, kind="stable"), axis=1, kind="stable")
        for batch in batches:
            x = _packed(batch.column(0), centroids.shape[1])
            cell, sims = _nearest_code(x[:, None], centroids[None])[:, 0], trial @ x.T
            best = np.argsort(-sims, axis=1, kind="stable")[:, : TRIAL_K + 1]
            q = np.repeat(np.arange(len(trial)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(sims[q, best.ravel()].astype(np.float64)), pa.array(place[q, cell[best.ravel()]])], names=["q", "s", "place"])

    found = sample.select("v").mapInArrow(near, "q long, s double, place long")
    side = Window.partitionBy("q").orderBy(F.desc("s"), "place")
    places = [r.place for r in found.withColumn("k", F.row_number().over(side)).where((F.col("k") > 1) & (F.col("k") <= TRIAL_K + 1)).select("place").collect()]  # TRIAL x TRIAL_K
    return int(np.quantile(places, target, method="higher")) + 1 if places else len(centroids)


def encode(vectors: DataFrame, model: Model, id_col: str = "document_id") -> DataFrame:
    """(cell, id, code) of every vector that can be compared."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    width = model.width

    def run(batches):
        m = sent.value
        for batch in batches:
            ok, x = _rows_of(batch.column(1), width)
            cell = _nearest_code(x[:, None], m.centroids[None])[:, 0] if len(x) else np.zeros(0, np.int64)
            left = (x - m.centroids[cell]).reshape(len(x), m.books.shape[0], -1)
            codes = _nearest_code(left, m.books).astype(np.uint8) if len(x) else np.zeros((0, m.books.shape[0]), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0).filter(pa.array(ok)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "id", "code"])

    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), "embedding").mapInArrow(run, "cell int, id long, code binary")


def write_index(vectors: DataFrame, model: Model, path: str, id_col: str = "document_id") -> None:
    """Writes the blocks, partitioned by cell, and the model beside them. Cells of many rows are dealt to several tasks."""
    spark = vectors.sparkSession
    coded = cut_lineage(encode(vectors, model, id_col))
    sizes = coded.groupBy("cell").agg(F.count("*").alias("rows"))  # a row a cell
    chunks = F.greatest(F.lit(1), F.ceil(F.col("rows") / (8 * BLOCK))).cast("int")
    dealt = coded.join(F.broadcast(sizes.select("cell", chunks.alias("chunks"))), "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    placed = dealt.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "id").select("cell", "chunk", "id", "code")

    def pack(batches):
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int32()), pa.array([rows[0][1]], pa.int32()), pa.array([rows[0][2]], pa.int64()), pa.array([[r[2] for r in rows]], pa.list_(pa.int64())), pa.array([b"".join(r[3] for r in rows)], pa.binary())], names=["cell", "chunk", "least", "ids", "codes"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (held[0][:2] != row[:2] or len(held) == BLOCK):
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    placed.mapInArrow(pack, "cell int, chunk int, least long, ids array<long>, codes binary").write.partitionBy("cell").parquet(f"{path}/blocks")
    books = model.books
    row = (model.centroids.tobytes(), model.width, books.tobytes(), books.shape[0], books.shape[1], model.probes)
    spark.createDataFrame([row], "centroids binary, width int, books binary, parts int, codes int, probes int").coalesce(1).write.parquet(f"{path}/model")


def read_model(spark: SparkSession, path: str) -> Model:
    row = spark.read.parquet(f"{path}/model").first()
    books = np.frombuffer(bytes(row.books), np.float32).reshape(row.parts, row.codes, row.width // row.parts)
    return Model(np.frombuffer(bytes(row.centroids), np.float32).reshape(-1, row.width), books, row.probes)


def build_index(vectors: DataFrame, path: str, id_col: str = "document_id", **how) -> bool:
    """Fits and writes an index of all vectors; False, and nothing written, where there is none."""
    model = fit(vectors, id_col, **how)
    if model is not None:
        write_index(vectors, model, path, id_col)
    return model is not None


def _routed(queries: DataFrame, model: Model, probes: int) -> DataFrame:
    """(cell, query_id, q) for the cells that each question reads."""
    sent = queries.sparkSession.sparkContext.broadcast(model.centroids)
    width = model.width

    def run(batches):
        centroids = sent.value
        half = (centroids * centroids).sum(axis=1) / 2
        for batch in batches:
            ok, q = _rows_of(batch.column(1), width)
            ids = batch.column(0).filter(pa.array(ok))
            cells = np.argsort(half[None, :] - q @ centroids.T, axis=1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(len(q)), cells.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), ids.take(pa.array(at)), pa.array([q[i].tobytes() for i in range(len(q))], pa.binary()).take(pa.array(at))], names=["cell", "query_id", "q"])

    return queries.where("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "embedding").mapInArrow(run, "cell int, query_id long, q binary")


def _candidates(pairs: DataFrame, model: Model, most: int) -> DataFrame:
    """(query_id, id, near): of what each task compares, the ``most`` nearest of each question by rebuilt vectors."""
    sent, width = pairs.sparkSession.sparkContext.broadcast(model), model.width
    kinds = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("near", pa.float64())])

    def told(best: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids = np.concatenate([np.full(len(i), q) for q, (_, i) in best.items()])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([i for _, i in best.values()])), pa.array(np.concatenate([d for d, _ in best.values()]))], schema=kinds)

    def run(batches) -> Iterator[pa.RecordBatch]:
        m = sent.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        group = None
        for batch in batches:
            for side, cell, ids, codes, asked in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if best and side != group:
                    yield told(best)
                    best = {}
                group = side
                code = np.frombuffer(codes, np.uint8).reshape(len(ids), -1)
                rebuilt = (m.books[np.arange(code.shape[1])[None, :], code].reshape(len(ids), width) + m.centroids[cell]).astype(np.float32)
                q = np.frombuffer(b"".join(x["q"] for x in asked), np.float32).reshape(-1, width)
                near = (1.0 - q @ rebuilt.T).astype(np.float64)
                own, k = np.array(ids, np.int64), min(most, len(ids))
                top = np.argpartition(near, k - 1, axis=1)[:, :k]
                for r, x in enumerate(asked):
                    d, i = near[r, top[r]], own[top[r]]
                    if x["query_id"] in best:
                        d, i = np.concatenate([best[x["query_id"]][0], d]), np.concatenate([best[x["query_id"]][1], i])
                    order = np.lexsort((i, d))[:most]
                    best[x["query_id"]] = d[order], i[order]
        if best:
            yield told(best)

    return pairs.mapInArrow(run, "query_id long, id long, near double")


def search(path: str, queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "document_id", probes: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank): about the k nearest vectors of each question (query_id, embedding), by an index of ``vectors``.

    Distances are exact, equal ones go by id; what may be missing are rows of cells that weren't read. More ``probes`` miss fewer, all
    cells none but for the codes' error. Questions that are null, zero or of another width find nothing.
    """
    spark = queries.sparkSession
    model = read_model(spark, path)
    probes = min(probes or model.probes, len(model.centroids))
    routed = cut_lineage(_routed(queries, model, probes))
    n_asked = routed.select("query_id").distinct().count()
    packs = max(1, -(-n_asked // PACK))
    pack = F.pmod(F.xxhash64("query_id"), F.lit(packs)).cast("int")
    asked = routed.groupBy("cell", pack.alias("pack")).agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))  # about PACK questions by their hash
    wanted = [r.cell for r in routed.select("cell").distinct().collect()]  # a row a cell
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("cell").isin(wanted))
    # (cell, chunk) holds 8 blocks or so, a side TASK_SIDE packs: both are keys of the join
    sides = -(-packs // TASK_SIDE)
    chunks = blocks.groupBy("cell").agg(F.max("chunk").alias("last"))
    asked = asked.join(F.broadcast(chunks), "cell").withColumns({"chunk": F.explode(F.sequence(F.lit(0), "last")), "side": F.floor(F.col("pack") / TASK_SIDE).cast("int")})
    spread = blocks.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))) if sides > 1 else blocks.withColumn("side", F.lit(0))
    pairs = spread.join(asked.select("cell", "chunk", "side", "asked"), ["cell", "chunk", "side"])
    most = RERANK * k
    found = _candidates(pairs.sortWithinPartitions("side").select("side", "cell", "ids", "codes", "asked"), model, most)
    near = Window.partitionBy("query_id").orderBy("near", "id")
    held = found.withColumn("place", F.row_number().over(near)).where(F.col("place") <= most).select("query_id", "id").distinct()
    exact = held.join(vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").alias("v")), "id").join(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").alias("q")), "query_id")

    def measure(batches):
        for batch in batches:
            (ok_q, q), (ok_v, v) = _wide(batch.column(2)), _wide(batch.column(3))
            keep = pa.array(ok_q & ok_v)
            d = 1.0 - (q[ok_q & ok_v] * v[ok_q & ok_v]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(d)], names=["query_id", id_col, "distance"])

    width = model.width

    def _wide(column):
        rows = [v if v is not None and len(v) == width and None not in v and any(v) else None for v in column.to_pylist()]
        ok = np.array([r is not None for r in rows], bool)
        x = np.array([r or [1.0] * width for r in rows], np.float64).reshape(-1, width)
        return ok, x / np.linalg.norm(x, axis=1, keepdims=True)

    told = exact.select("query_id", "id", "q", "v").mapInArrow(measure, f"query_id long, {id_col} long, distance double")
    ranked = Window.partitionBy("query_id").orderBy(F.round("distance", 12), id_col)
    return told.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
