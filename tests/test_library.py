"""Versions of several tables, a landing directory as a source, lists of latest values, and deliveries as a stream."""

import datetime
import os
import random
import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veldmark.functions import fingerprint as fp
from veldmark.functions.transforms import FieldMapping
from veldmark.operators import baseline as b, issues, prices, screening
from veldmark.sources.delimited import Structure
from veldmark.sources.directory import Landing
from veldmark.streaming.library import STATE, Library, follow_deliveries

PAIR = {"t": b.Kept("k string, v long", ("k",)), "u": b.Kept("k string, v long", ("k",))}
PROFILE = screening.Profile(
    Structure(("S", "G", "R", "N", "P", "E")),
    (FieldMapping("supplier", "S"), FieldMapping("grp", "G"), FieldMapping("reference", "R"), FieldMapping("description", "N"), FieldMapping("base_price", "P", type="DECIMAL"), FieldMapping("EAN", "E")),
    reference_types=("EAN",), creation_percent=100, rejected_percent=50, critical_percent=None,
)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k string, v long")


def content(df):
    return dict(map(tuple, df.collect()))


def test_versions_replace_rows_and_settle(spark, tmp_path):
    base = b.Baseline(spark, f"file://{tmp_path}", PAIR)
    assert base.last() == 0 and base.read("t").count() == 0
    want, rng, seen = {}, random.Random(1), []
    for n in range(12):
        change = {f"k{rng.randrange(40)}": n for _ in range(5)}
        assert base.publish(n, {"t": rows(spark, list(change.items()))}) == n + 1
        want |= change
        seen.append(dict(want))
        assert content(base.read("t")) == want
    assert content(base.read("t", 3)) == seen[2]
    sizes = [s["rows"] for s in base.manifest(12)["t"]]
    assert len(sizes) <= 4 and all(x > 2 * y for x, y in zip(sizes, sizes[1:]))
    assert base.prune() > 0 and base.versions() == [11, 12]
    assert content(base.read("t")) == want and content(base.read("t", 11)) == seen[10]


def test_one_of_two_publications_wins(spark, tmp_path, monkeypatch):
    one, two = (b.Baseline(spark, f"file://{tmp_path}", PAIR) for _ in range(2))
    one.publish(0, {"t": rows(spark, [("a", 1)])})
    with pytest.raises(b.VersionTaken):
        two.publish(0, {"t": rows(spark, [("a", 2)])})
    # the other publishes between the look and the rename
    real = two._write
    monkeypatch.setattr(two, "_write", lambda *a: (real(*a), one.publish(1, {"u": rows(spark, [("z", 9)])}) if one.last() == 1 else None)[0])
    with pytest.raises(b.VersionTaken):
        two.publish(1, {"t": rows(spark, [("a", 3)])})
    assert one.last() == 2 and content(one.read("t")) == {"a": 1} and content(one.read("u")) == {"z": 9}
    assert [p for p in os.listdir(tmp_path / "versions") if p.startswith(".draft")] == []
    with pytest.raises(ValueError, match="more than once"):
        one.publish(2, {"t": rows(spark, [("a", 1), ("a", 2)])})
    assert one.last() == 2


OBSERVED = "identity_hash string, component_code string, observation_date date, amount decimal(24,0)"


def test_lists_tell_what_history_tells(spark):
    rng = random.Random(5)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n)
    history = {(f"i{rng.randrange(6)}", c, day(rng.randrange(90))): Decimal(rng.randrange(-999, 9999)) for c in ("BASE", "AKP") for _ in range(300)}
    order = sorted(history, key=lambda k: (rng.random(), k))
    lists = prices.latest_values(spark.createDataFrame([], OBSERVED), 30)
    for at in range(0, len(order), 150):
        new = spark.createDataFrame([(*k, history[k]) for k in order[at : at + 150]] + [(*k, Decimal(-5)) for k in order[max(0, at - 20) : at]], OBSERVED)
        changed = prices.with_observations(lists, new, 30)
        rest = lists.join(changed.select(*prices.KEY), prices.KEY, "left_anti")
        lists = spark.createDataFrame(rest.unionByName(changed).collect(), lists.schema)
    assert lists.where(F.size("values") > 30).count() == 0
    whole = spark.createDataFrame([(*k, v) for k, v in history.items()], OBSERVED)
    assert sorted(prices.averages_of(lists, 7, 30).collect()) == sorted(prices.averages(whole, None, 7, 30).collect())
    assert sorted(prices.averages_of(prices.latest_values(whole, 30), 7, 30).collect()) == sorted(prices.averages(whole, None, 7, 30).collect())


def test_tallies_merge_in_any_order(spark):
    rng = random.Random(2)
    parts = [(spark.createDataFrame([(rng.choice("ab"), rng.choice("xy"), "ERROR", rng.randrange(99)) for _ in range(20)], "code string, signature string, severity string, row_number long"), f"2024-01-{n:02d}") for n in range(1, 5)]
    timed = [issues.timed_tally(p, F.lit(d).cast("date")) for p, d in parts]
    whole = sorted(issues.merged_tallies(*timed).collect())
    assert sorted(issues.merged_tallies(issues.merged_tallies(timed[3], timed[1]), issues.merged_tallies(timed[2], timed[0])).collect()) == whole
    assert sum(r.occurrences for r in whole) == 80


def put(folder, name, lines, mtime):
    (folder / name).write_text("\n".join(["S;G;R;N;P;E", *lines]) + "\n")
    os.utime(folder / name, (mtime, mtime))


def test_directory_stream_takes_files_once_in_order(spark, tmp_path):
    spark.dataSource.register(Landing)
    folder = tmp_path / "in"
    folder.mkdir()
    taken = []

    def run():
        files = spark.readStream.format("landing").option("path", str(folder)).option("names", r".*\.csv").option("mostBytes", 500).option("leastAge", 60).load()
        files.writeStream.foreachBatch(lambda d, _: taken.append([r["name"] for r in d.orderBy("mtime", "name").collect()])).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()

    put(folder, "old.csv", [], 1000)
    put(folder, "b.csv", [], 2000)
    put(folder, ".hidden.csv", [], 3000)
    put(folder, "c.txt", [], 3000)
    (folder / "link.csv").symlink_to(folder / "c.txt")
    run()
    run()
    put(folder, "a.csv", [], 2000)  # at the watermark's time, before its name
    put(folder, "late.csv", [], 1500)
    put(folder, "d.csv", [], 2000)
    put(folder, "big.csv", ["x" * 600], 2500)
    put(folder, "c.csv", [], 2100)
    put(folder, "young.csv", [], 2**31)
    run()
    assert [x for x in taken if x] == [["b.csv"], ["d.csv", "c.csv"]]
    listed = spark.read.format("landing").option("path", str(folder)).option("names", r".*\.csv").load()
    assert {r["name"] for r in listed.collect()} == {"old.csv", "b.csv", "a.csv", "late.csv", "d.csv", "big.csv", "c.csv", "young.csv"}
    assert spark.read.format("landing").option("path", str(tmp_path / "ck")).option("names", "none").load().count() == 0


def lines(n, price):
    return [f"s;g;{i};n{i};{price(i)};e{i}" for i in n]


def test_streamed_deliveries(spark, tmp_path):
    spark.dataSource.register(Landing)
    folder = tmp_path / "in"
    folder.mkdir()
    library = Library(spark, f"file://{tmp_path}/library", PROFILE)
    files = lambda: spark.readStream.format("landing").option("path", str(folder)).load()
    run = lambda ck: follow_deliveries(files(), library, f"file://{tmp_path}/{ck}").awaitTermination()
    put(folder, "1.csv", lines(range(1, 6), lambda i: i), 86_400)
    run("ck")
    put(folder, "2.csv", lines(range(1, 7), lambda i: i + (i == 2)), 2 * 86_400)
    put(folder, "3.csv", lines([1, 1], lambda i: i), 3 * 86_400)  # an identity twice: blocked
    put(folder, "4.csv", lines(range(2, 6), lambda i: i + (i == 3)), 4 * 86_400)
    put(folder, "5.csv", ["no;columns"], 5 * 86_400)
    run("ck")
    run("new-ck")  # a lost checkpoint: the newest comes again, and is known
    told = sorted((r["name"], r["outcome"], r["accepted"], r["n_mutations"]) for r in library.read("deliveries").collect())
    assert told == [("1.csv", "REVIEW_REQUIRED", True, 5), ("2.csv", "VALID_WITH_WARNINGS", True, 2), ("3.csv", "BLOCKING", False, 0), ("4.csv", "VALID_WITH_WARNINGS", True, 2), ("5.csv", "BLOCKING", False, 0)]
    assert library.baseline.last() == 5
    price = {r["base_price"] for r in library.read("state").collect()}
    assert price == {1_000_000, 2_000_000, 4_000_000, 5_000_000, 6_000_000} | {4_000_000}
    values = {len(r["values"]) for r in library.read("latest").collect()}
    assert values == {1, 2, 3} and library.read("references").count() == 6 and library.read("mutations").count() == 9
    tally = {r["code"]: r for r in library.read("tallies").collect()}
    assert tally["DUPLICATE_IDENTITY_IN_DELIVERY"]["occurrences"] == 2 and str(tally["DUPLICATE_IDENTITY_IN_DELIVERY"]["first_at"]) == "1970-01-04"


def test_what_is_known_is_not_worked_out_again(spark, tmp_path):
    """References are matched once a delivery, the judgement is a row, and tables that are only added to have no shuffle."""
    folder = f"file://{tmp_path}/out"
    refs = spark.createDataFrame([("x", "EAN", "e1")], "identity_hash string, reference_type string, value string")
    put(tmp_path, "1.csv", lines(range(1, 4), lambda i: i), 86_400)
    run = screening.screen(spark, f"file://{tmp_path}/1.csv", PROFILE, spark.createDataFrame([], STATE), spark.createDataFrame([], OBSERVED), folder, refs)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "n_foreign" not in plan(run.mutations) and "Aggregate" not in plan(run.judgement)
    assert [(r.code, r.row_number) for r in run.issues.collect()] == [("REFERENCE_LINK_PROPOSED", 2)]
    base = b.Baseline(spark, f"file://{tmp_path}/base", {"a": b.Kept("k string", ("k",), added=True)})
    for n in range(3):
        base.publish(n, {"a": spark.createDataFrame([(f"k{n}-{i}",) for i in range(9)], "k string")})
    assert base.read("a").count() == 27 and "Aggregate" not in plan(base.read("a"))


def test_digests_travel_as_bytes(spark):
    digest = "0123456789abcdef" * 4
    texts = [digest, digest.upper(), digest[:-1], f"{digest[:-1]}\n", f"{digest}\n", "", "é", "\0" * 32, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fp.packed(F.col("t")).alias("p")).select("t", "p", fp.unpacked(F.col("p")).alias("u")).collect()
    assert [r.u for r in got] == texts and len({bytes(r.p) for r in got if r.p is not None}) == 8 and len(got[0].p) == 32


def test_merged_digests_and_keys_stay(spark, tmp_path):
    kept = {"t": b.Kept("k string, d string, n long", ("k",), ("k", "d"))}
    base = b.Baseline(spark, f"file://{tmp_path}", kept)
    for n, rows in enumerate(([("ab" * 32, "CD" * 32, 1), ("plain", None, 2)], [("ab" * 32, "cd" * 32, 3), ("new", "", 4)])):
        base.publish(n, {"t": spark.createDataFrame(rows, kept["t"].schema)})
    assert len(base.manifest(2)["t"]) == 1
    assert sorted(map(tuple, base.read("t").collect())) == [("ab" * 32, "cd" * 32, 3), ("new", "", 4), ("plain", None, 2)]


def test_a_crash_between_any_two_writes_leaves_a_whole_version(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "1.csv", lines(range(1, 4), lambda i: i), 86_400)
    put(tmp_path / "in", "2.csv", lines(range(1, 5), lambda i: i * 1.01), 2 * 86_400)
    library = Library(spark, f"file://{tmp_path}/library", PROFILE)
    library.advance(f"file://{tmp_path}/in/1.csv", "1970-01-02")
    before = {t: sorted(map(str, library.read(t).collect())) for t in ("state", "latest", "deliveries", "references", "cases", "tallies", "mutations")}
    real, n_writes, lock = b.Baseline._write, [], threading.Lock()
    for stop in (0, 3, 6, 99):
        done = []

        def write(self, *a):
            with lock:
                if len(done) >= stop:
                    raise RuntimeError("lost")
                done.append(a)
            return real(self, *a)

        monkeypatch.setattr(b.Baseline, "_write", write)
        try:
            assert library.advance(f"file://{tmp_path}/in/2.csv", "1970-01-03") == 2
            break
        except RuntimeError:
            n_writes.append(len(done))
            assert library.baseline.last() == 1
            assert {t: sorted(map(str, library.read(t).collect())) for t in ("state", "mutations")} == {t: before[t] for t in ("state", "mutations")}
    assert n_writes == [0, 3, 6]
    assert library.read("state").count() == 4 and library.read("deliveries").count() == 2
    assert library.advance(f"file://{tmp_path}/in/2.csv", "1970-01-03") is None
