"""Mix sources to target weights by pivotal dependent rounding.

Targets fill like water: sources share all words by weight, none above three
times its own. A document of a source is then wanted target/size times, and
the fractional part of that is rounded by the pivotal method: two documents
with fractions p and q trade mass at random until one is 0 or 1, the other
carries p + q (or p + q - 1) on. Below the root every document keeps its expectation,
and the total of a group never moves by more than one fraction.

The rounding runs as a reduction tree. Leaves are groups of similar size
inside a source, so that mass trades between documents of like length and the
words of a source stay near their target; each leaf leaves one residual
fraction, residuals meet in groups of up to FAN, and the last ones of a
source, one of each band of sizes, are rounded together, the longest first,
each to where the source's words come nearest to their target. These few (one of each
quarter octave of sizes) are not rounded at random, so their expectation is not kept.
Only DataFrame functions are used. A leaf holds about LEAF documents, whatever share of
the rows a source or one repeated row has, and randomness is a hash of the row (of
repeated rows, also of their place in the input), so reruns agree.

Defined cases: a null text or one without words has size 0 and is never
taken; a null source is a source, after all others; equal rows count each,
and it is left open which of them is taken; ties between sizes are broken by the hash;
very long texts count whole, and one that is longer than its source's target may miss it; an empty table gives an empty
result; other columns are ignored (``mix`` keeps the input's own columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace, left_join_hot, row_keys, whole_row_key

LEAF = 2048
FAN = 256
BANDS_PER_OCTAVE = 4
#: Source tables up to so many rows are broadcast.
FEW_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, null: 0."""
    text = F.coalesce(text, F.lit(""))
    edge = lambda pattern: text.rlike(pattern).cast("int")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"[\x20\x09-\x0D]+")) - edge(r"\A[\x20\x09-\x0D]") - edge(r"[\x20\x09-\x0D]\z")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size and target, from rows of source and size."""
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", weight.cast("double")).withColumn("total", F.sum("source_size").over(every))
    # in order of the level at which a source is full: level if all before are full and the rest share
    full = most * F.col("source_size") / F.col("weight")
    order = Window.orderBy("full", F.col("source").asc_nulls_last())
    table = table.withColumn("full", full)
    before = F.coalesce(F.sum(most * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    table = table.withColumn("level", (F.col("total") - before) / rest).withColumn("rank", F.row_number().over(order))
    level = F.min_by("level", F.when(F.col("level") <= F.col("full"), F.col("rank"))).over(every)
    return table.select("source", "source_size", F.least(F.lit(float(most)) * F.col("source_size"), level * F.col("weight")).alias("target"))


def _uniform(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def _round_group(items: Column, seed: int) -> Column:
    """Pivotal rounding along an array of items: what is decided, and the item and fraction that are left."""

    def meet(state: Column, item: Column) -> Column:
        p, q, u = state["p"], item["p"], _uniform(item["k1"], item["k2"], F.lit(seed))
        both = p + q
        over = both >= 1
        new_wins = F.when(over, u >= (1 - q) / (2 - both)).otherwise(u < q / both)
        # over: the winner is taken and the loser carries on; else the winner carries the mass of both
        new_goes_on = F.when(over, ~new_wins).otherwise(new_wins)
        done = F.struct(F.when(new_goes_on, state["item"]).otherwise(item).alias("item"), F.when(over, 1).otherwise(0).alias("take"))
        return F.struct(F.when(over, both - 1).otherwise(both).alias("p"), F.when(new_goes_on, item).otherwise(state["item"]).alias("item"), F.concat(state["done"], F.array(done)).alias("done"))

    first = items[0]
    nothing = F.filter(F.array(F.struct(first.alias("item"), F.lit(0).alias("take"))), lambda x: F.lit(False))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.struct(first["p"].alias("p"), first.alias("item"), nothing.alias("done")), meet)


def _round_root(items: Column, words: Column) -> Column:
    """What to take of a source's last items, one of each band, the longest first: each is rounded to where the source's words are nearest to what is wanted, given what was decided below."""
    first = items[0]
    wanted = (first["target"] / first["source_size"] - first["base"]) * first["source_size"]
    open_words = F.aggregate(items, F.lit(0.0), lambda s, x: s + x["p"] * x["size"])
    nothing = F.filter(F.array(F.struct(first.alias("item"), F.lit(0).alias("take"))), lambda x: F.lit(False))

    def nearest(state: Column, item: Column) -> Column:
        low, high = state["off"] - item["p"] * item["size"], state["off"] + (1 - item["p"]) * item["size"]
        up = F.abs(high) < F.abs(low)
        return F.struct(F.when(up, high).otherwise(low).alias("off"), F.concat(state["done"], F.array(F.struct(item.alias("item"), F.when(up, 1).otherwise(0).alias("take")))).alias("done"))

    return F.aggregate(items, F.struct((words + open_words - wanted).alias("off"), nothing.alias("done")), nearest, lambda s: s["done"])


def _salted(sizes: DataFrame) -> DataFrame:
    """With ``salt``: 0, but for rows that repeat the number that they were written with, so that equal rows fall in many leaves."""
    again = sizes.groupBy("k1", "k2").count().where("count > 1").select("k1").distinct().withColumn("again", F.lit(True))
    if not again.limit(1).count():
        return sizes.drop("nth").withColumn("salt", F.lit(0).cast("bigint"))
    return left_join_hot(sizes, again, "k1").withColumn("salt", F.when(F.col("again"), F.col("nth")).otherwise(0)).drop("nth", "again")


def _named_row(documents: DataFrame) -> Column:
    return whole_row_key(documents.drop("__row"))


def copies_of(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7, row: Column | None = None) -> DataFrame:
    """One row per document: doc_id, k1, k2, source, size, source_size, target and copies. row: a name of each row (a whole number), which comes back as ``row``; then chance is a hash of all columns."""
    spark = documents.sparkSession
    work = Workspace(spark, "source-mixing")
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *row_keys(F.col(id_col) if row is None else _named_row(documents), F.col(text_col)), (F.lit(0) if row is None else row).cast("bigint").alias("row"))
    rows = _salted(work.write(rows.withColumn("nth", F.monotonically_increasing_id()), "sizes"))
    table = work.write(targets(rows, weights, most).withColumnRenamed("source", "named"), "targets")
    n_sources, n_rows = table.count(), rows.count()
    known = F.broadcast(table) if n_sources <= FEW_SOURCES else table
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("named"))).drop("named").withColumn("rate", rate)
    rows = rows.withColumn("base", F.floor("rate")).withColumn("p", F.col("rate") - F.floor("rate"))
    whole = (F.col("size") == 0) | (F.col("p") < 1e-12)
    own = ["doc_id", "k1", "k2", "source", "size", "source_size", "target", "row"]
    parts = [rows.where(whole).select(*own, F.when(F.col("size") > 0, F.col("base")).otherwise(0).cast("bigint").alias("copies"))]
    leaves = max(1, -(-n_rows // LEAF))
    item = F.struct("size", _uniform(F.col("k1"), F.col("k2"), F.lit(seed), F.col("salt")).alias("u"), "k1", "k2", "doc_id", "p", "source_size", "target", "base", "row")
    band = F.floor(F.log2("size") * BANDS_PER_OCTAVE).cast("int")
    left = rows.where(~whole).select("source", band.alias("band"), F.pmod(F.xxhash64("k1", F.lit(seed), "salt"), F.lit(leaves)).cast("int").alias("leaf"), item.alias("item"))
    level, decided = 0, []
    while True:
        level += 1
        groups = left.groupBy("source", "band", "leaf").agg(F.array_sort(F.collect_list("item")).alias("items"))
        state = work.write(groups.select("source", "band", "leaf", _round_group(F.col("items"), seed + level).alias("state")), f"level{level}")
        decided.append(state.select("source", F.explode("state.done").alias("d")))
        parts.append(_rows(decided[-1], F.col("d.item"), F.col("d.take"), own))
        rest = state.select("source", "band", "leaf", F.col("state.item").withField("p", F.col("state.p")).alias("item"))
        if leaves == 1:
            break
        leaves = -(-leaves // FAN)
        left = rest.withColumn("leaf", F.floor(F.col("leaf") / FAN).cast("int") if leaves > 1 else F.lit(0))
    words = decided[0]
    for x in decided[1:]:
        words = words.unionByName(x)
    words = words.groupBy(F.col("source").alias("named")).agg(F.sum(F.col("d.take") * F.col("d.item.size")).alias("words"))
    roots = rest.groupBy("source").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
    joined = roots.join(F.broadcast(words) if n_sources <= FEW_SOURCES else words, F.col("source").eqNullSafe(F.col("named")), "left").drop("named")
    parts.append(_rows(joined.select("source", F.explode(_round_root(F.col("items"), F.coalesce("words", F.lit(0)))).alias("d")), F.col("d.item"), F.col("d.take"), own))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.drop("row") if row is None else out


def _rows(table: DataFrame, item: Column, take: Column, own: list[str]) -> DataFrame:
    return table.select(*(F.col("source") if c == "source" else item[c].alias(c) for c in own), (item["base"] + take).cast("bigint").alias("copies"))


def mix(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents that are taken, with their own columns and ``copies``, how often (``mix_copies`` where they have a column of that name). Each row counts for itself, whatever else equals it."""
    own = documents.columns
    work = Workspace(documents.sparkSession, "source-mixing")
    fields = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)))
    # named once and written, so that names stay; the texts are read again where their rows are taken
    rows = work.write(documents.select(fields.alias("own"), F.monotonically_increasing_id().alias("row")), "rows")
    named = rows.select(*(F.col(f"own.c{i}").alias(c) for i, c in enumerate(own)), F.col("row").alias("__row"))
    found = copies_of(named, id_col=id_col, text_col=text_col, source_col=source_col, row=F.col("__row"), **how).where("copies > 0").select("row", F.col("copies").alias("taken"))
    return rows.join(found, "row").select(*(F.col(f"own.c{i}").alias(c) for i, c in enumerate(own)), F.col("taken").alias("mix_copies" if "copies" in own else "copies"))


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    rows = copies_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
