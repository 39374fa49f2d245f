"""What becomes of uploads: one decision each against the catalogue, and the catalogue and chunks after it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators.answers import reject_reason
from docquarry.operators.catalog import next_version, upsert
from docquarry.operators.components import connected_components
from docquarry.operators.ranges import scan, spread_join
from docquarry.session import cut_lineage


def decide(uploads: DataFrame, catalogue: DataFrame, most: int) -> DataFrame:
    """(upload_id, workspace_id, filename, file_hash, decision, document_id, version, reason), one row an upload.

    uploads: (upload_id, workspace_id, filename, content, mime_type); catalogue: (workspace_id, document_id, filename,
    file_hash, status, version), a file name once a workspace. Each upload is decided against the catalogue as it is.

    rejected: too large, empty or of no supported type. deduplicated: the same bytes are ready under any name, the smallest
    id of them. requeued: the same bytes are there and not ready, or under this name. new_version: other bytes under this name; the
    version counts on. new: nothing of either; the document is the upload, at v1.
    """
    bare = uploads.select("upload_id", "workspace_id", "filename", F.sha2("content", 256).alias("file_hash"), reject_reason(F.octet_length("content"), F.col("mime_type"), most).alias("reason"))
    best = F.min(F.struct((F.col("status") != "ready").alias("waits"), "document_id", "version")).alias("same")
    same = catalogue.groupBy("workspace_id", "file_hash").agg(best)
    named = catalogue.select("workspace_id", "filename", F.struct("document_id", "version", "file_hash").alias("named"))
    both = bare.join(same, ["workspace_id", "file_hash"], "left").join(named, ["workspace_id", "filename"], "left")
    decision = (
        F.when(F.col("reason").isNotNull(), "rejected")
        .when(~F.col("same.waits"), "deduplicated")
        .when(F.col("same").isNotNull(), "requeued")
        .when(F.col("named").isNotNull(), "new_version")
        .otherwise("new")
    )
    out = both.withColumn("decision", decision)
    of = lambda same, named, fresh: F.when(F.col("decision").isin("deduplicated", "requeued"), same).when(F.col("decision") == "new_version", named).when(F.col("decision") == "new", fresh)
    document = of(F.col("same.document_id"), F.col("named.document_id"), F.col("upload_id"))
    version = of(F.col("same.version"), next_version(F.col("named.version")), F.lit("v1"))
    return out.select("upload_id", "workspace_id", "filename", "file_hash", "decision", document.alias("document_id"), version.alias("version"), "reason")


CHAIN = ("workspace", "name")


class _Documents:
    """The documents that some uploads may meet, by bytes and by name; of several the ready one counts, then the one of the smallest id."""

    def __init__(self):
        self.of: dict[str, list] = {}  # id: hash, name, waits, version
        self.by: dict[tuple[str, str], set[str]] = {}

    def put(self, doc, file_hash: str, name: str, waits: bool, version: str) -> None:
        if doc in self.of:
            for key in (("hash", self.of[doc][0]), ("name", self.of[doc][1])):
                self.by[key].discard(doc)
                if not self.by[key]:
                    del self.by[key]
        self.of[doc] = [file_hash, name, waits, version]
        for key in (("hash", file_hash), ("name", name)):
            self.by.setdefault(key, set()).add(doc)

    def find(self, kind: str, value: str):
        return min(self.by.get((kind, value), ()), key=lambda d: (self.of[d][2], d), default=None)


def _bumped(version: str, times: int) -> str:
    """``next_version`` so many times."""
    if not times:
        return version
    digits = version[1:] if version and version[0] == "v" and version[1:].isascii() and version[1:].isdigit() else "1"
    return f"v{int(digits) + times}"


def decide_in_order(uploads: DataFrame, catalogue: DataFrame, most: int) -> DataFrame:
    """The same columns as ``decide``, each upload decided after all before it, by upload_id, have taken effect.

    An upload whose bytes are a document's that isn't ready, whatever its name, requeues it under the upload's name. Otherwise it
    is the next version of the document of that name, or a new one; documents that this batch touches aren't ready. A null name is no other
    row's name. Where several documents have the bytes or the name, the ready one counts, then that of the smallest id.

    Uploads of one name are a chain. Most bytes come in one place of one chain only: for these a chain is counted by a scan over range
    partitions, however many uploads it has. Only bytes that come again elsewhere, or are in the catalogue, are events of their own,
    as are the runs between them. Events that share a name or such bytes are folded one after another where they stream by
    in order, with the documents of those names in memory; all other names are folded apart.
    """
    word = lambda c, own: F.when(F.col(c).isNull(), F.concat(F.lit("\0"), F.col(own).cast("string") if own else F.lit(""))).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    bare = uploads.select(F.col("upload_id").cast("long").alias("upload_id"), "workspace_id", "filename", F.sha2("content", 256).alias("file_hash"), reject_reason(F.coalesce(F.octet_length("content"), F.lit(0)), F.col("mime_type"), most).alias("reason"))
    bare = cut_lineage(bare.withColumns({"workspace": word("workspace_id", None), "name": word("filename", "upload_id")}))
    have = cut_lineage(catalogue.select(F.col("document_id").cast("long").alias("document_id"), word("workspace_id", None).alias("workspace"), word("filename", "document_id").alias("name"), F.coalesce("file_hash", F.lit("")).alias("file_hash"), (F.coalesce("status", F.lit("")) != "ready").alias("waits"), F.coalesce("version", F.lit("")).alias("version")))
    chain = scan(bare.where("reason IS NULL"), CHAIN, ["upload_id"], lags={"prev": (F.col("file_hash"), 1)})
    chain = chain.withColumn("fresh", ~F.col("prev").eqNullSafe(F.col("file_hash")))
    places = chain.groupBy("workspace", "file_hash").agg(F.count("*").alias("size"), F.sum(F.col("fresh").cast("long")).alias("places"))
    there = have.select("workspace", "file_hash").distinct().withColumn("there", F.lit(True))
    known = places.join(there, ["workspace", "file_hash"], "left").select("workspace", "file_hash", "size", (F.col("there").isNotNull() | (F.col("places") > 1)).alias("again"))
    marked = spread_join(chain, known, ("workspace", "file_hash"), "size")
    told = scan(marked, CHAIN, ["upload_id"], lags={"was": (F.col("again"), 1)})
    told = told.withColumn("starts", F.col("again") | F.coalesce("was", F.lit(True)))
    rows = cut_lineage(scan(told, CHAIN, ["upload_id"], sums={"run": F.col("starts").cast("long"), "changes": (F.col("fresh") & ~F.col("starts")).cast("long")}))
    run = (*CHAIN, "run")
    runs = cut_lineage(rows.groupBy(*run).agg(F.min("upload_id").alias("at"), F.min_by("file_hash", "upload_id").alias("first_hash"), F.max_by("file_hash", "upload_id").alias("last_hash"), F.min("changes").alias("from"), F.max("changes").alias("upto"), F.first("again").alias("again"), F.count("*").alias("size")))
    node = lambda kind, c: F.xxhash64(F.lit(kind), "workspace", c)
    by_name = node("name", "name")
    tied = runs.where("again").select(by_name.alias("u"), node("hash", "first_hash").alias("v")).union(have.select(by_name.alias("u"), node("hash", "file_hash").alias("v")))
    roots = connected_components(tied)
    none = lambda kind: F.lit(None).cast(kind)
    docs = have.select(by_name.alias("node"), F.lit(0).alias("kind"), F.col("document_id").alias("at"), *CHAIN, none("long").alias("run"), F.col("file_hash").alias("first_hash"), F.col("file_hash").alias("last_hash"), F.lit(0).cast("long").alias("changes"), "waits", "version")
    events = runs.select(by_name.alias("node"), F.lit(1).alias("kind"), "at", *CHAIN, "run", "first_hash", "last_hash", (F.col("upto") - F.col("from")).alias("changes"), none("boolean").alias("waits"), none("string").alias("version"))
    parts = int(uploads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.unionByName(events).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # workspaces that a hash of 64 bits throws together are told apart by name
    order = ("root", "workspace", "kind", "at")
    placed = placed.repartition(parts, "root", "workspace").sortWithinPartitions(*order).select("root", "workspace", "kind", "at", "name", "run", "first_hash", "last_hash", "changes", "waits", "version")
    kinds = pa.schema([("workspace", pa.string()), ("name", pa.string()), ("run", pa.int64()), ("decision", pa.string()), ("document_id", pa.int64()), ("base", pa.string())])

    def fold(batches):
        group, held = None, _Documents()
        for batch in batches:
            out = []
            for root, workspace, kind, at, name, number, first, last, changes, waits, version in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (root, workspace):
                    group, held = (root, workspace), _Documents()
                if kind == 0:
                    held.put(at, first, name, waits, version)
                    continue
                same = held.find("hash", first)
                if same is not None and not held.of[same][2]:
                    out.append((workspace, name, number, "deduplicated", same, held.of[same][3]))
                    continue
                doc = held.find("name", name) if same is None else same
                decision = "new" if doc is None else "new_version" if same is None else "requeued"
                base = "v1" if doc is None else _bumped(held.of[doc][3], int(same is None))
                doc = at if doc is None else doc
                held.put(doc, last, name, True, _bumped(base, changes))
                out.append((workspace, name, number, decision, doc, base))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    folded = placed.mapInArrow(fold, "workspace string, name string, run long, decision string, document_id long, base string")
    found = spread_join(rows, runs.select(*run, "from", "size").join(folded, list(run)), run, "size")
    decision = F.when(F.col("starts"), F.col("decision")).otherwise(F.when(F.col("fresh"), "new_version").otherwise(F.lit("requeued")))
    later = F.col("changes") - F.col("from")
    digits = F.regexp_extract("base", "^v([0-9]+)$", 1)
    version = F.when(later == 0, F.col("base")).otherwise(F.concat(F.lit("v"), (F.when(digits != "", digits.cast("decimal(38,0)")).otherwise(F.lit(1)) + later).cast("string")))
    names = ("upload_id", "workspace_id", "filename", "file_hash")
    taken = found.select(*names, decision.alias("decision"), "document_id", version.alias("version"), F.lit(None).cast("string").alias("reason"))
    refused = bare.where("reason IS NOT NULL").select(*names, F.lit("rejected").alias("decision"), none("long").alias("document_id"), none("string").alias("version"), "reason")
    return taken.unionByName(refused)


def apply_decisions(decisions: DataFrame, catalogue: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalogue, chunks) once all decisions hold: taken uploads are pending, and no chunk of what they replace is left.

    Of several uploads that change one document in a batch the last by id counts. Chunks are rows with a document_id.
    """
    taken = decisions.where(F.col("decision").isin("requeued", "new_version", "new"))
    last = taken.groupBy("document_id").agg(F.max_by(F.struct("workspace_id", "filename", "file_hash", "version"), "upload_id").alias("u"))
    changed = last.select("u.workspace_id", "document_id", "u.filename", "u.file_hash", F.lit("pending").alias("status"), "u.version")
    return upsert(catalogue.select(*changed.columns), changed, "document_id"), chunks.join(last.select("document_id"), "document_id", "left_anti")


def requeue(catalogue: DataFrame, workspace: str) -> DataFrame:
    """The catalogue with every document of a workspace pending again."""
    return catalogue.withColumn("status", F.when(F.col("workspace_id") == workspace, "pending").otherwise(F.col("status")))


def clashes(wanted: DataFrame, taken: DataFrame, name: str) -> DataFrame:
    """Rows whose name, trimmed and in lower case, is taken already or wanted by an earlier row (by id) too."""
    key = F.lower(F.trim(F.col(name)))
    first = wanted.groupBy(key.alias("__key")).agg(F.min("id").alias("__first"))
    have = taken.select(key.alias("__key")).distinct().withColumn("__taken", F.lit(True))
    rows = wanted.withColumn("__key", key).join(first, "__key").join(have, "__key", "left")
    return rows.where(F.col("__taken") | (F.col("id") > F.col("__first"))).drop("__key", "__first", "__taken")
