"""Registered queries over streams of deliveries, versions, archives and artifacts, on files that are made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldmark.functions.transforms import FieldMapping
from veldmark.operators import prices, publication, screening
from veldmark.operators.baseline import Baseline, Kept, VersionTaken
from veldmark.plans import adapt
from veldmark.plans.catalog import query
from veldmark.plans.places import folder
from veldmark.sources import archive
from veldmark.sources.delimited import Structure
from veldmark.sources.directory import Landing
from veldmark.streaming.library import Library, follow_deliveries

DAY = 86_400
PROFILE = screening.Profile(
    Structure(("S", "G", "R", "N", "P", "E")),
    (FieldMapping("supplier", "S"), FieldMapping("grp", "G"), FieldMapping("reference", "R"), FieldMapping("description", "N"), FieldMapping("base_price", "P", type="DECIMAL"), FieldMapping("EAN", "E")),
    reference_types=("EAN",), version=2, creation_percent=100, critical_percent=None, deviation_percent=15, bulk_percent=1,
)


def _landed(rows: DataFrame, place: str, name: str, day: int, header: str = "S;G;R;N;P;E") -> str:
    """One file below place, as it would have come on that day: a header, then the values of rows in order of n."""
    spark = rows.sparkSession
    lines = spark.createDataFrame([(-1, header)], "n long, value string").unionByName(rows.select(F.col("n").cast("bigint").alias("n"), "value"))
    lines.coalesce(1).sortWithinPartitions("n").select("value").write.text(f"{place}.parts/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = (f.getPath() for f in files.listStatus(path(f"{place}.parts/{name}")) if f.getPath().getName().startswith("part-"))
    files.mkdirs(path(place))
    files.rename(part, path(f"{place}/{name}"))
    files.setTimes(path(f"{place}/{name}"), day * DAY * 1000, -1)
    return f"{place}/{name}"


#: Delivery d leaves out the parts whose key divided by 5 leaves d; a third of the parts never change their price.
_CENTS = "cast(round(p_retailprice * 100) as bigint) + (p_partkey % 3) * {d} * 25"


def _delivered(spark, sf: str, d: int) -> DataFrame:
    price = (F.round(F.col("p_retailprice") * 100).cast("bigint") + F.col("p_partkey") % 3 * d * 25).cast("decimal(18,0)") / 100
    value = F.concat_ws(";", F.concat(F.lit("S"), F.col("p_partkey") % 10), "p_brand", F.col("p_partkey").cast("string"), "p_name", price.cast("decimal(18,2)").cast("string"), F.concat(F.lit("E"), F.col("p_partkey")))
    return adapt.table(spark, sf, "part").where(F.col("p_partkey") % 5 != d).select(F.col("p_partkey").alias("n"), value.alias("value"))


def followed(spark, sf: str) -> Library:
    """Four deliveries that land between runs of a stream, the last ones twice: by another checkpoint, and by hand."""
    spark.dataSource.register(Landing)
    root = folder(spark, "stream")
    library = Library(spark, f"{root}/library", PROFILE)

    def run(checkpoint: str) -> None:
        files = spark.readStream.format("landing").option("path", f"{root}/in").option("names", r"d[0-9]\.csv").load()
        follow_deliveries(files, library, f"{root}/{checkpoint}").awaitTermination()

    _landed(_delivered(spark, sf, 0), f"{root}/in", "d0.csv", 1)
    run("checkpoint")
    for d in (1, 2, 3):
        path = _landed(_delivered(spark, sf, d), f"{root}/in", f"d{d}.csv", d + 1)
    run("checkpoint")
    run("lost")
    name, size, ms = archive.files_at(spark, path)[0]
    library.advance(path, "1970-01-05", f"d3.csv:{ms // 1000}:{size}")
    return library


_STREAM = f"""with d as (select unnest(range(4)) as d), s as (select p_partkey, d, ({_CENTS.format(d="d")}) * 10000 as price, lag(({_CENTS.format(d="d")}) * 10000) over (partition by p_partkey order by d) as before from part, d where p_partkey % 5 <> d),
o as (select * from s where before is null or price <> before),
"""
_IDENTITY = "sha256('2' || chr(31) || 'S' || cast(p_partkey % 10 as varchar) || chr(31) || p_brand || chr(31) || cast(p_partkey as varchar))"


@query("t01_t06_streamed_deliveries", _STREAM + f"""v as (select p_partkey, count(*) as n_values, sum(price) as total, arg_max(price, d) as price from o group by 1)
select {_IDENTITY} as identity_hash, cast(price as varchar) as base_price, n_values, cast((2 * total + n_values) // (2 * n_values) as varchar) as avg_long, 'E' || cast(p_partkey as varchar) as ean from v join part using (p_partkey)""")
def _(spark, sf):
    """The accepted offers after the stream, with the means of their lists of values and their references."""
    library = followed(spark, sf)
    means = prices.averages_of(library.read("latest")).select("identity_hash", F.col("avg_long").cast("string").alias("avg_long"))
    n = library.read("latest").select("identity_hash", F.size("values").cast("bigint").alias("n_values"))
    refs = library.read("references").select("identity_hash", F.col("value").alias("ean"))
    rows = library.read("state").join(n, "identity_hash").join(means, "identity_hash").join(refs, "identity_hash")
    return rows.select("identity_hash", F.col("base_price").cast("string").alias("base_price"), "n_values", "avg_long", "ean")


@query("s12_landing_directory", """with f as (select n_name as name, 10000 + n_regionkey as mtime, n_nationkey from nation), w as (select *, row_number() over (order by mtime, name) as place from f where n_nationkey <> 7)
select name, mtime, case when place < (select max(place) from w where mtime < 10003) then 'OLDER_THAN_WATERMARK' when mtime < 10003 then 'FIRST' else 'LATER' end as taken, place from w""")
def _(spark, sf):
    """A file for each nation, dated by its region, lands before or after the first run of a stream; which batch took it, and at which place. One file has an unwanted name."""
    spark.dataSource.register(Landing)
    root = folder(spark, "landing")
    nations = [tuple(r) for r in adapt.table(spark, sf, "nation").select("n_name", "n_regionkey", "n_nationkey").collect()]  # one file each
    path, context = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    files = path(f"{root}/in").getFileSystem(context)

    def land(first: bool) -> None:
        for name, region, key in nations:
            if (region < 3) == first:
                at = path(f"{root}/in/{'.' if key == 7 else ''}{name}")
                files.create(at, True).close()
                files.setTimes(at, (10_000 + region) * 1000, -1)

    def run() -> None:
        rows = spark.readStream.format("landing").option("path", f"{root}/in").load()
        rows.writeStream.format("parquet").option("path", f"{root}/taken").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    land(True)
    run()
    land(False)
    run()
    there = spark.read.format("landing").option("path", f"{root}/in").load().select("name", "mtime")
    took = spark.read.parquet(f"{root}/taken").groupBy("name").agg(F.count(F.lit(1)).alias("times"))
    taken = F.when(F.col("times").isNull(), "OLDER_THAN_WATERMARK").when(F.col("times") > 1, "TWICE").when(F.col("mtime") < 10_003, "FIRST").otherwise("LATER")
    return there.join(took, "name", "left").select("name", "mtime", taken.alias("taken"), F.row_number().over(Window.orderBy("mtime", "name")).cast("bigint").alias("place"))


@query("w02_latest_lists", adapt.OBSERVATIONS_SQL.format(key="l_suppkey").replace("li as", "with li as", 1) + """, r as (select *, row_number() over (partition by identity_hash order by observation_date desc) as rn from obs)
select identity_hash, count(*) filter (rn <= 200) as n_values, (2 * sum(amount) filter (rn <= 50) + count(*) filter (rn <= 50)) // (2 * count(*) filter (rn <= 50)) as avg_short, (2 * sum(amount) filter (rn <= 200) + count(*) filter (rn <= 200)) // (2 * count(*) filter (rn <= 200)) as avg_long from r group by 1""")
def _(spark, sf):
    """Observations of suppliers come in four parts, by year; lists of at most 200 values move forward, and no part reads the ones before."""
    rows = adapt.observations(spark, sf, "l_suppkey")
    quarter = F.least(F.greatest(F.year("observation_date") - 1994, F.lit(0)), F.lit(3))
    base = Baseline(spark, folder(spark, "lists"), {"latest": Kept(f"identity_hash string, component_code string, values {prices.VALUES}", tuple(prices.KEY))})
    for n in range(4):
        base.publish(n, {"latest": prices.with_observations(base.read("latest", n), rows.where(quarter == n))})
    lists = base.read("latest")
    n_values = lists.select("identity_hash", F.size("values").cast("bigint").alias("n_values"))
    return n_values.join(prices.averages_of(lists), "identity_hash").select("identity_hash", "n_values", "avg_short", "avg_long")


@query("c17_compare_and_swap", "select o_orderpriority as k, count(*) + case when o_orderpriority like '1%' then 1 else 0 end as v, 2 as version from orders group by 1")
def _(spark, sf):
    """Two acceptances start from one version: the second is refused, starts again, and adds to what the first left."""
    root, kept = folder(spark, "swap"), {"t": Kept("k string, v bigint", ("k",))}
    one, two = Baseline(spark, root, kept), Baseline(spark, root, kept)
    counts = adapt.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    base = two.last()
    one.publish(one.last(), {"t": counts})
    try:
        two.publish(base, {"t": counts.withColumn("v", F.lit(-1))})
    except VersionTaken:
        two.publish(two.last(), {"t": two.read("t").where(F.col("k").startswith("1")).withColumn("v", F.col("v") + 1)})
    return one.read("t").withColumn("version", F.lit(one.last()))


_LINE = "cast(p_partkey as varchar) || ';' || p_name || ';' || cast(cast(round(p_retailprice * 100) as bigint) as varchar)"


def _artifact_lines(spark, sf: str) -> DataFrame:
    line = F.concat_ws(";", F.col("p_partkey").cast("string"), "p_name", F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string"))
    return adapt.table(spark, sf, "part").select(F.col("p_partkey").alias("ordinal"), line.alias("line"), "p_brand")


@query("s17_sealed_artifact", f"select sha256(string_agg({_LINE} || chr(10), '' order by p_partkey)) as sha256, count(*) as n_rows, sum(strlen({_LINE}) + 1)::bigint as n_bytes, 'SNAPSHOT_CHANGED' as tampered from part")
def _(spark, sf):
    """An artifact of all parts by a sealed bundle, and what a tampered one gets."""
    rows = _artifact_lines(spark, sf)
    snapshot = adapt.table(spark, sf, "part").select(F.lit("b").alias("bundle_id"), F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("amount"))
    none = spark.createDataFrame([], "id long, component_code string, percentage long")
    sealed = publication.snapshot_hash(snapshot, none).head()["snapshot_hash"]
    root = folder(spark, "artifact")
    told = publication.publish("b", snapshot, none, sealed, rows, f"{root}/a", seconds=3600)
    try:
        publication.publish("b", snapshot.withColumn("amount", F.col("amount") + (F.col("id") == 1).cast("int")), none, sealed, rows, f"{root}/b")
        tampered = "PUBLISHED"
    except publication.ContentChanged as e:
        tampered = str(e).partition(":")[0]
    return spark.createDataFrame([(told["sha256"], told["rows"], told["bytes"], tampered)], "sha256 string, n_rows bigint, n_bytes bigint, tampered string")


@query("s10_archived_files", f"select p_brand as name, sha256('line' || chr(10) || string_agg({_LINE} || chr(10), '' order by p_partkey)) as sha256, (5 + sum(strlen({_LINE}) + 1))::bigint as byte_size, 1 as stored, 2 as seen from part group by 1")
def _(spark, sf):
    """A file for each brand, archived twice: it is stored once, under its digest."""
    rows = _artifact_lines(spark, sf)
    root = folder(spark, "archive")
    brands = [r[0] for r in rows.select("p_brand").distinct().collect()]  # one file each
    for b in brands:
        _landed(rows.where(F.col("p_brand") == b).select(F.col("ordinal").alias("n"), F.col("line").alias("value")), f"{root}/in", b, 1, header="line")
    files = archive.listed(spark, f"{root}/in")
    archive.stored(files, f"{root}/kept").write.parquet(f"{root}/first")
    archive.stored(files, f"{root}/kept").write.parquet(f"{root}/second")
    both = spark.read.parquet(f"{root}/first", f"{root}/second")
    return both.groupBy(F.element_at(F.split("file", "/"), -1).alias("name"), "sha256", "byte_size").agg(F.count_if("is_new").cast("int").alias("stored"), F.count(F.lit(1)).cast("int").alias("seen"))

