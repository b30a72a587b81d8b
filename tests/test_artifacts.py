"""Archived files and published artifacts."""

import hashlib
import os
import resource
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldmark.operators import publication
from veldmark.sources import archive, artifact, delimited


def test_files_are_stored_once_under_their_digest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    contents = {"a": b"one", "b": b"one", "c": b"", "d": os.urandom(3 * archive.RANGE // 2)}
    for n, c in contents.items():
        (folder / n).write_bytes(c)
    files = archive.listed(spark, str(folder))
    first = {r["file"].rpartition("/")[2]: r for r in archive.stored(files, f"file://{tmp_path}/kept").collect()}
    for n, c in contents.items():
        assert (first[n]["byte_size"], first[n]["sha256"]) == (len(c), hashlib.sha256(c).hexdigest())
        with open(first[n]["archived"].removeprefix("file://"), "rb") as f:
            assert f.read() == c
    assert not any(r["is_new"] for r in archive.stored(files, f"file://{tmp_path}/kept").collect())
    assert len([p for p in (tmp_path / "kept").rglob("*") if p.is_file()]) == 3
    told = {r["file"].rpartition("/")[2]: (r["byte_size"], r["sha256"]) for r in delimited.archive(spark, str(folder)).collect()}
    assert told == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}


def test_large_files_take_bounded_memory(spark, tmp_path):
    path = tmp_path / "large"
    with open(path, "wb") as f:
        f.truncate(1 << 30)  # no disk, all zeros

    state = hashlib.sha256()
    for _ in range(1 << 10):
        state.update(bytes(1 << 20))

    def told(batches):
        import pyarrow as pa

        for _ in batches:
            h = hashlib.sha256()
            for part in archive.ranges(*archive.opened(str(path))):
                h.update(part)
            yield pa.RecordBatch.from_pylist([{"sha256": h.hexdigest(), "mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024}])

    got = spark.range(1).coalesce(1).mapInArrow(told, "sha256 string, mb long").head()
    assert got["sha256"] == state.hexdigest() and got["mb"] < 512


def lines(spark, n, parts=5):
    return spark.range(n).select(F.col("id").alias("ordinal"), F.concat(F.lit("é;"), F.col("id")).alias("line")).repartition(parts)


def content(path):
    return b"".join((path / n).read_bytes() for n in sorted(os.listdir(path)) if n.startswith("page-"))


def test_artifact_has_the_hash_of_its_bytes(spark, tmp_path):
    want = "".join(f"é;{i}\n" for i in range(1000)).encode()
    told = artifact.write_artifact(lines(spark, 1000), f"file://{tmp_path}/out", hashlib.sha256(want).hexdigest())
    assert content(tmp_path / "out") == want and told["sha256"] == hashlib.sha256(want).hexdigest() and (told["rows"], told["bytes"]) == (1000, len(want))
    assert [hashlib.sha256((tmp_path / "out" / p["name"]).read_bytes()).hexdigest() for p in told["pages"]] == [p["sha256"] for p in told["pages"]]
    empty = artifact.write_artifact(lines(spark, 0), f"file://{tmp_path}/none")
    assert empty["sha256"] == hashlib.sha256(b"").hexdigest() and empty["pages"] == []
    with pytest.raises(Exception, match="ARTIFACT_EXISTS"):
        artifact.write_artifact(lines(spark, 3), f"file://{tmp_path}/out")
    assert content(tmp_path / "out") == want


def test_what_fails_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="ARTIFACT_CONTENT_CHANGED"):
        artifact.write_artifact(lines(spark, 10), f"file://{tmp_path}/a", "0" * 64)
    with pytest.raises(Exception, match="PUBLICATION_TIMEOUT"):
        artifact.write_artifact(lines(spark, 10), f"file://{tmp_path}/b", seconds=-1)
    with pytest.raises(Exception, match="in order|overlap"):
        spark.dataSource.register(artifact.Artifact)
        lines(spark, 100).write.format("artifact").mode("append").option("path", f"file://{tmp_path}/c").save()
    with pytest.raises(Exception, match="in order"):
        artifact.write_artifact(lines(spark, 5).unionByName(lines(spark, 5)), f"file://{tmp_path}/d")
    assert os.listdir(tmp_path) == []


def test_a_task_that_outlives_the_abort_leaves_nothing(tmp_path):
    rows = pa.RecordBatch.from_pydict({"ordinal": pa.array([1, 2], pa.int64()), "line": ["a", "b"]})
    for before in (0, 1):  # batches that the task has written when the write is aborted
        pages = artifact.Artifact({"path": f"file://{tmp_path}/x"}).writer(None, False)

        def late(pages=pages, before=before):
            if before:
                yield rows
            pages.abort([])
            yield rows.set_column(0, "ordinal", pa.array([3, 4], pa.int64()))

        with pytest.raises(RuntimeError, match="ARTIFACT_ABORTED"):
            pages.write(late())
        with pytest.raises(RuntimeError, match="ARTIFACT_ABORTED"):
            pages.write(iter([rows]))
        assert os.listdir(tmp_path) == []


def test_a_task_that_outlives_the_commit_harms_nothing(tmp_path):
    rows = pa.RecordBatch.from_pydict({"ordinal": pa.array([1, 2], pa.int64()), "line": ["a", "b"]})
    pages = artifact.Artifact({"path": f"file://{tmp_path}/x"}).writer(None, False)
    pages.commit([pages.write(iter([rows]))])
    with pytest.raises(RuntimeError, match="ARTIFACT_ABORTED"):
        pages.write(iter([rows]))
    assert os.listdir(tmp_path) == ["x"] and sorted(os.listdir(tmp_path / "x")) == ["_artifact.json", "page-000000"]


def test_a_tampered_snapshot_is_refused(spark, tmp_path):
    snapshot = spark.createDataFrame([("b1", 1, 5_000_000), ("b1", 2, 7_500_000), ("b2", 3, 1)], "bundle_id string, id long, amount long")
    components = spark.createDataFrame([(1, "AKP", 50)], "id long, component_code string, percentage long")
    sealed = {r["bundle_id"]: r["snapshot_hash"] for r in publication.snapshot_hash(snapshot, components).collect()}
    out = lambda s: s.where("bundle_id = 'b1'").select(F.col("id").alias("ordinal"), F.col("amount").cast("string").alias("line"))
    other = snapshot.withColumn("amount", F.when(F.col("id") == 2, 7_500_001).otherwise(F.col("amount")))
    with pytest.raises(publication.ContentChanged):
        publication.publish("b1", other, components, sealed["b1"], out(other), f"file://{tmp_path}/p")
    with pytest.raises(publication.ContentChanged):
        publication.publish("b9", snapshot, components, sealed["b1"], out(snapshot), f"file://{tmp_path}/p")
    told = publication.publish("b1", snapshot, components, sealed["b1"], out(snapshot), f"file://{tmp_path}/p", seconds=600)
    assert told["rows"] == 2 and content(tmp_path / "p") == b"5000000\n7500000\n" and time.time() > 0


def test_a_bundle_waits_while_another_touches_its_offers(spark):
    rows = spark.createDataFrame([("b1", "x1", "PLANNED", 1), ("b1", "x2", "PLANNED", 1), ("b2", "x3", "PLANNED", 2), ("b3", "x4", "AWAITING_APPROVAL", 3)], "bundle_id string, identity_hash string, status string, batch_id int")
    live = spark.createDataFrame([("b9", "x2"), ("b1", "x1"), ("b9", "x7")], "bundle_id string, identity_hash string")
    got = {r.bundle_id: (r.undecided, r.conflicts, r.conflicts_between) for r in publication.preflight(rows, rows.limit(0), live).collect()}
    assert got == {"b1": (0, 0, 1), "b2": (0, 0, 0), "b3": (1, 0, 0)}
    assert publication.preflight(rows, rows.limit(0)).columns == ["bundle_id", "undecided", "stale", "conflicts"]
