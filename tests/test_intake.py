"""Upload decisions, what they do to catalogue and chunks, name clashes and retries."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docquarry.operators import intake as I
from docquarry.operators import jobs as J
from docquarry.operators import retrieval as R

V1, V2, V3 = (f"# text {i}".encode() for i in (1, 2, 3))
sha = lambda b: hashlib.sha256(b).hexdigest()
CATALOGUE = "workspace_id string, document_id long, filename string, file_hash string, status string, version string"
UPLOADS = "upload_id long, workspace_id string, filename string, content binary, mime_type string"


def run(spark, uploads, catalogue, most=100):
    cat = spark.createDataFrame(catalogue, CATALOGUE)
    made = I.decide(spark.createDataFrame(uploads, UPLOADS), cat, most)
    return cat, made, {r.upload_id: (r.decision, r.document_id, r.version, r.reason) for r in made.collect()}


def test_each_kind_of_upload(spark):
    catalogue = [("w", 1, "a.md", sha(V1), "ready", "v1"), ("w", 2, "b.md", sha(V2), "failed", "v3"), ("other", 3, "a.md", sha(V3), "ready", "v1"), ("w", 4, "odd.md", sha(b"x"), "ready", "draft")]
    md = "text/markdown"
    uploads = [
        (10, "w", "a.md", V1, md), (11, "w", "c.md", V1, md), (12, "w", "a.md", V3, md), (13, "w", "b.md", V2, md), (14, "w", "new.md", V3, md),
        (15, "w", "z.md", V2, md), (16, "w", "a.md", b"y" * 101, md), (17, "w", "a.md", b"", md), (18, "w", "a.bin", V1, None), (19, "w", "odd.md", V3, md), (20, "new", "a.md", V1, md),
    ]
    cat, made, got = run(spark, uploads, catalogue)
    assert got == {
        10: ("deduplicated", 1, "v1", None), 11: ("deduplicated", 1, "v1", None), 12: ("new_version", 1, "v2", None), 13: ("requeued", 2, "v3", None), 14: ("new", 14, "v1", None), 15: ("requeued", 2, "v3", None),
        16: ("rejected", None, None, "too large"), 17: ("rejected", None, None, "empty"), 18: ("rejected", None, None, "unsupported type"), 19: ("new_version", 4, "v2", None), 20: ("new", 20, "v1", None),
    }
    chunks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)], "document_id long, ordinal int")
    after, left = I.apply_decisions(made, cat, chunks)
    rows = {r.document_id: r for r in after.collect()}
    assert rows[1].file_hash == sha(V3) and rows[1].version == "v2" and rows[1].status == "pending" and rows[2].filename == "z.md"
    assert rows[3].status == "ready" and sorted(rows) == [1, 2, 3, 4, 14, 20]
    assert sorted(r.document_id for r in left.collect()) == [3]


def test_a_changed_document_counts_on_and_back(spark):
    catalogue = [("w", 1, "a.md", sha(V1), "ready", "v1")]
    for n, data in enumerate((V2, V3, V1), 2):
        cat, made, got = run(spark, [(n, "w", "a.md", data, "text/plain")], catalogue)
        assert got[n][:3] == ("new_version", 1, f"v{n}")
        after, _ = I.apply_decisions(made, cat, spark.createDataFrame([], "document_id long"))
        catalogue = [(r.workspace_id, r.document_id, r.filename, r.file_hash, "ready", r.version) for r in after.collect()]
    assert I.requeue(spark.createDataFrame(catalogue, CATALOGUE), "w").first().status == "pending"
    assert run(spark, [], catalogue)[2] == {}


def test_names_are_taken_whatever_their_case(spark):
    wanted = spark.createDataFrame([(1, "New"), (2, "new "), (3, "Old"), (4, None)], "id long, slug string")
    taken = spark.createDataFrame([("old",)], "slug string")
    assert sorted(r.id for r in I.clashes(wanted, taken, "slug").collect()) == [2, 3]


def test_retries(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(J.retryable(lit(None).cast("int"), lit(""), F.array(lit("httpx.X"), lit("ReadError"))))
    assert not one(J.retryable(lit(400), lit("quota project"), F.array(lit("ValueError"))))
    assert one(J.rate_limited(lit(429), lit(None).cast("string"))) and one(J.rate_limited(lit(None).cast("int"), lit("RESOURCE_EXHAUSTED now"))) and not one(J.rate_limited(lit(403), lit("quota")))
    none = lit(None).cast("double")
    assert [one(J.retry_wait(lit(3), none, lit(x))) for x in (0.0, 1.0)] == [2.0, 6.0]
    assert one(J.retry_wait(lit(1), lit(53.0), lit(1.0))) == 55.0
    assert one(J.retry_wait(lit(1), lit(53.0), lit(0.0), interactive=True)) is None and one(J.retry_wait(lit(1), none, lit(0.5), interactive=True)) == 1.0


def test_citations_name_their_result(spark):
    cited = spark.createDataFrame([("g", 0, 2), ("g", 1, 9)], "g string, rank int, number int")
    results = spark.createDataFrame([("g", 1, "a.md"), ("g", 2, "b.md"), ("h", 2, "c.md")], "g string, rank int, filename string")
    assert [(r.number, r.filename) for r in R.cited_sources(cited, results, ("g",)).collect()] == [(2, "b.md")]
    replies = spark.createDataFrame([("g", " yes [1] "), ("h", "That is Not in the Documents."), ("i", "made up"), ("j", None)], "g string, reply string")
    got = {r.g: (r.text, r.refused) for r in R.answer(results, replies, ("g",), "no").collect()}
    assert got == {"g": ("yes [1]", False), "h": ("no", True), "i": ("no", True), "j": ("no", True)}


def test_sections_are_described_by_their_first_chunk(spark):
    from docquarry.operators import enrich as E

    rows = [(1, 0, "d.md", "a", ["a"], "first of a"), (1, 1, "d.md", "a", ["a"], "second of a"), (1, 2, "d.md", None, None, "no section"), (2, 0, "e.md", "a", ["a", "b"], "fails")]
    chunks = spark.createDataFrame(rows, "doc_id long, ordinal int, document string, section string, path array<string>, content string")

    def client(texts):
        if "fails" in texts:
            raise RuntimeError("busy")
        return [f" about: {t} " if t != "no section" else "  " for t in texts]

    got = {(r.doc_id, r.ordinal): r.header for r in E.contextualise(chunks.repartition(1, "doc_id").where("doc_id = 1"), client).collect()}
    assert got == {(1, 0): "d.md > a - about: first of a", (1, 1): "d.md > a - about: first of a", (1, 2): "d.md"}
    assert [r.header for r in E.contextualise(chunks.where("doc_id = 2"), client).collect()] == ["e.md > a > b"]
    assert {r.ordinal: r.header for r in E.contextualise(chunks.where("doc_id = 1"), client, per_chunk=True).collect()}[1] == "d.md > a - about: second of a"


def test_profiles(spark):
    from docquarry.operators import enrich as E

    replies = ['```json\n{"document_type": " policy ", "topics": ["A", "a ", "", "B"]}\n```', 'so {"topics": []} it is', "nothing", None, "{broken"]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    got = [(r.p.document_type, r.p.topics, r.p.entities) for r in df.select("i", E.profile(F.col("reply")).alias("p")).orderBy("i").collect()]
    assert got == [("policy", ["A", "B"], []), ("", [], []), ("", [], []), ("", [], []), ("", [], [])]


def test_events_are_appended(spark):
    log = spark.createDataFrame([(1, "2024-01-01 00:00:00", "signup", 5)], "job_id long, ts string, event string, event_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    jobs = spark.createDataFrame([(2,), (1,), (2,)], "job_id long")
    after = J.append_events(log, jobs, "view", F.lit("2024-01-02").cast("timestamp"))
    assert sorted((r.job_id, r.event, r.event_id) for r in after.collect()) == [(1, "signup", 5), (1, "view", 6), (2, "view", 7)]
    assert {r.job_id: r.status for r in J.job_states(after).collect()} == {1: "running", 2: "running"}


def test_small_rules(spark):
    import numpy as np
    import pytest

    from docquarry.operators import answers as A
    from docquarry.operators import catalog as C

    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert [one(J.stage_progress(lit(s), lit(1), lit(4))) for s in ("parse", "profile", "chunk", "write", "embed", "done", "odd")] == [10, 25, 40, 50, 62, 100, 0]
    assert one(A.credentials_ok(lit(" ab "), lit("12345678"))) and not one(A.credentials_ok(lit(" a "), lit("12345678"))) and not one(A.credentials_ok(lit("ab"), lit(None).cast("string")))
    files = spark.createDataFrame([("w", 1, bytearray(b"x"))], "workspace_id string, document_id long, content binary")
    assert C.stored_bytes(files, "w", 1) == b"x"
    with pytest.raises(LookupError):
        C.stored_bytes(files, "other", 1)
    docs = spark.createDataFrame([("w", "ready", 3), ("w", "failed", 5), ("v", "ready", None)], "workspace_id string, status string, changed_at int")
    assert {r.workspace_id: r.last_change for r in C.status_counts(docs).collect()} == {"w": 5, "v": None}
    told = A.embed_texts(spark.createDataFrame([(1, "a")], "id long, t string"), "id", "t", lambda texts, task: np.full((len(texts), 2), float(task == "query")), 2, task="query")
    assert told.first().embedding == [1.0, 1.0]
    messages = spark.createDataFrame([("w", 1, 3, "user", "old")], "workspace_id string, user_id long, turn long, role string, content string")
    exchanges = spark.createDataFrame([("w", 1, 2, "q2", "a2"), ("w", 1, 1, "q1", None), ("w", 2, 1, "q", "a")], "workspace_id string, user_id long, seq int, question string, answer string")
    got = sorted((r.user_id, r.turn, r.role, r.content) for r in A.save_exchanges(messages, exchanges).collect())
    assert got == [(1, 3, "user", "old"), (1, 4, "user", "q1"), (1, 5, "assistant", None), (1, 6, "user", "q2"), (1, 7, "assistant", "a2"), (2, 0, "user", "q"), (2, 1, "assistant", "a")]


def in_order(uploads, catalogue, most):
    """One upload after another, as a plain loop."""
    docs = [dict(zip(("ws", "id", "name", "hash", "status", "version"), c, strict=True)) for c in catalogue]
    out = {}
    for upload, ws, name, content, mime in sorted(uploads, key=lambda u: u[0]):
        if content is None or len(content) == 0 or len(content) > most or mime is None:
            out[upload] = ("rejected", None, None)
            continue
        digest = hashlib.sha256(content).hexdigest()
        pick = lambda found: min(found, key=lambda d: (d["status"] != "ready", d["id"]), default=None)
        same = pick([d for d in docs if d["ws"] == ws and d["hash"] == digest])
        if same and same["status"] == "ready":
            out[upload] = ("deduplicated", same["id"], same["version"])
            continue
        doc = same or pick([d for d in docs if d["ws"] == ws and name is not None and d["name"] == name])
        decision = "requeued" if same else "new_version" if doc else "new"
        if doc is None:
            doc = {"ws": ws, "id": upload, "version": "v1"}
            docs.append(doc)
        elif not same:
            found = re.fullmatch("v([0-9]+)", doc["version"])
            doc["version"] = f"v{int(found[1]) + 1}" if found else "v2"
        doc |= {"hash": digest, "name": name, "status": "pending"}
        out[upload] = (decision, doc["id"], doc["version"])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_uploads_of_a_batch_see_each_other(spark, seed):
    rng = random.Random(seed)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    names = [None, *(f"n{i}" for i in range(6 + 20 * seed))]
    catalogue = [(ws, 10_000 + 10 * i + k, f"n{i}", sha(f"c{rng.randrange(8)}".encode()), rng.choice(["ready", "failed", None]), rng.choice(["v1", "v9", "draft", "v"])) for i in range(5) for k, ws in enumerate(("a", "b"))]
    uploads = []
    for i in range(500):
        content = rng.choice([None, b"", b"x" * 99, *[f"c{rng.randrange(8 + 60 * seed)}".encode()] * 9])
        uploads.append((i, rng.choice(["a", "a", "b", None]), rng.choice(names), content, rng.choice(["text/plain"] * 9 + [None])))
    # one hot name with bytes of its own, which come again now and then
    uploads += [(1_000 + i, "a", "hot", f"own {i // 3 if i % 100 else rng.randrange(9)}".encode(), "text/plain") for i in range(1_500)]
    catalogue.append(("a", 99_999, "kept", sha(b"keep"), "ready", "v3"))
    uploads += [(3_000, "a", None, b"keep", "text/plain"), (3_001, "b", "kept", b"keep", "text/plain"), (3_002, "a", "kept", b"other", "text/plain"), (3_003, "a", "x", b"keep", "text/plain")]
    got = I.decide_in_order(spark.createDataFrame(rng.sample(uploads, len(uploads)), "upload_id long, workspace_id string, filename string, content binary, mime_type string").repartition(3), spark.createDataFrame(catalogue, "workspace_id string, document_id long, filename string, file_hash string, status string, version string"), 50).collect()
    assert len(got) == len(uploads)
    assert {r.upload_id: (r.decision, r.document_id, r.version) for r in got} == in_order(uploads, catalogue, 50)
    assert {r.decision for r in got} == {"rejected", "deduplicated", "requeued", "new_version", "new"}


def test_no_uploads_or_no_catalogue_in_order(spark):
    uploads, catalogue = "upload_id long, workspace_id string, filename string, content binary, mime_type string", "workspace_id string, document_id long, filename string, file_hash string, status string, version string"
    assert I.decide_in_order(spark.createDataFrame([], uploads), spark.createDataFrame([("a", 1, "n", "h", "ready", "v1")], catalogue), 50).count() == 0
    got = I.decide_in_order(spark.createDataFrame([(1, "a", "n", b"x", "text/plain"), (2, "a", "m", b"x", "text/plain"), (3, "a", "n", b"y", "text/plain")], uploads), spark.createDataFrame([], catalogue), 50)
    assert [(r.decision, r.document_id, r.version) for r in got.orderBy("upload_id").collect()] == [("new", 1, "v1"), ("requeued", 1, "v1"), ("new", 3, "v1")]
