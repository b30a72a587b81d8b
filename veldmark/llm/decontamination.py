"""Benchmark decontamination by template windows.

Texts become templates token by token: a token whose first letter or digit is a
digit is a number, one that begins with a capital and a small letter is a name
(at a sentence's start too), and a unit word after a number is a unit. Case and
punctuation go; the values of the slots are kept beside their placeholders.

What counts is a window of WINDOW tokens, at any place of item and document; all
windows of both are hash-joined, those of documents from each token on:

* template windows with LEAST_WORDS different words outside their slots, which
  also meet a question that was asked with other parameters, and
* value windows with LEAST_WORDS different values, which meet a verbatim copy
  whatever its case and however few words lie outside its slots.

An item shorter than WINDOW is one window of its own length. An item without any
such window says too little to be told from chance inside other text: it is found
where a document holds nothing else.

A hit fixes how item and document lie on each other. There the runs of equal
tokens that hold a window are looked up, and each run is judged by its own slots:
it is consistent if every value of the item becomes one and the same value in the
document, and exact if all values are equal. Inconsistent runs are reported only
on demand, with a flag; they are exact if they hold a value window.

Windows that several items share (a heading that all questions have) would meet
each document once for each item. So a window belongs to one item, the one with
the least id (of each pattern of equal slots, at most 15): a document costs its own
windows, and leaks are reported for these representatives. ``representatives`` tells
for each item which others stand for its windows.

Only DataFrame functions are used. The benchmark's windows are broadcast if there
are at most FEW_WINDOWS of them, else joined by a shuffle. A hit carries the part
of the document that lies under the item, not the document.

Defined cases: null and empty texts have no windows and leak nothing, and null and
empty items are not found; equal rows of documents are one row of the result, equal
rows of the benchmark one item; ties between items go to the least id, then to a hash
of the item; very long texts and items cost their length; empty tables give empty
results; a document may leak several items. Other columns are ignored
(``remove_leaks`` keeps the documents' own, and all of several equal rows or none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, row_keys

WINDOW = 8
LEAST_WORDS = 4
FEW_WINDOWS = 1_000_000
TEMPLATE, VALUE = 1, 2
MARK = "\x01"
#: A slot is a token that holds MARK and one of these before its value.
NUMBER, NAME, UNIT = MARK + "#", MARK + "@", MARK + "%"
SPACE = r"\x20\x09-\x0D"
#: Characters that texts lose before they are cut into tokens.
PUNCTUATION = MARK + ".,;:!?\"'()[]{}…«»“”‘’`"
# Units that may follow a number.
UNITS = "km|cm|mm|m|mi|miles?|ft|feet|inch(?:es)?|kg|g|mg|t|tons?|lbs?|pounds?|l|ml|litres?|liters?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|eur|euros?|usd|dollars?|cents?|percent|degrees?|kmh|mph|hz|khz|mhz|ghz|w|kw|kwh|v|a|kb|mb|gb|tb"


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once a row, and not in each turn of a lambda inside then."""
    return F.transform(F.array(value), then)[0]


def marked(text: Column, units: str = UNITS) -> Column:
    """Lower-case tokens without punctuation, slots with their mark. Patterns begin with what is rare, so that most characters cost one look. A text without tokens gives one empty token."""
    t = F.btrim(F.translate(F.coalesce(text, F.lit("")), PUNCTUATION, ""), F.lit(" \t\n\x0b\x0c\r"))
    t = F.regexp_replace(t, rf"\p{{Lu}}(?<=(?:^|[{SPACE}])\p{{Lu}})(?=\p{{Ll}})", f"{NAME}$0")
    t = F.regexp_replace(t, rf"[0-9](?<=(?:^|[{SPACE}])[^{SPACE}\p{{L}}\p{{N}}]{{0,3}}[0-9])", f"{NUMBER}$0")
    t = F.regexp_replace(t, rf"({NUMBER}[^{SPACE}]*[{SPACE}]+)(?={units_of(units)}(?:[{SPACE}]|\z))", f"$1{UNIT}")
    return F.split(F.lower(t), f"[{SPACE}]+")


def units_of(units: str) -> str:
    return f"(?i:{units})"


def template(tokens: Column) -> Column:
    """Of marked tokens: slots as their marks alone."""
    return F.transform(tokens, lambda t: F.when(F.contains(t, F.lit(MARK)), F.regexp_extract(t, f"{MARK}.", 0)).otherwise(t))


def values(tokens: Column) -> Column:
    """Of marked tokens: all as they were."""
    return F.transform(tokens, lambda t: F.when(F.contains(t, F.lit(MARK)), F.regexp_replace(t, f"{MARK}.", "")).otherwise(t))


def is_slot(token: Column) -> Column:
    return F.contains(token, F.lit(MARK))


def _keyed(tokens: Column, kind: int, widths: list[int]) -> Column:
    """Keys of the runs of tokens of these widths (WINDOW at most): for each width one from each token on. Those that would go beyond the end meet nothing, as their key is of fewer tokens."""
    run = lambda one, w: F.transform(one, lambda x, i: F.xxhash64(F.lit(kind * 100 + w), x, *(F.get(one, i + k) for k in range(1, w))))
    return _let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda one: F.concat(*(run(one, w) for w in widths)))


def _whole_key(values: Column) -> Column:
    return F.xxhash64(F.lit("whole"), values)


def _different(tokens: Column) -> Column:
    return F.size(F.array_distinct(tokens))


def benchmark_items(benchmark: DataFrame, item_col: str, text_col: str, units: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """item_id, item (a key), vals, tokens, width, and said and told: places of the template and of the value windows that say enough."""
    items = benchmark.select(F.col(item_col).alias("item_id"), marked(F.col(text_col), units).alias("m")).where("m[0] <> ''")
    items = items.select("item_id", F.xxhash64("item_id", "m").alias("item"), values(F.col("m")).alias("vals"), template(F.col("m")).alias("tokens")).dropDuplicates(["item"])
    items = items.withColumn("width", F.least(F.lit(WINDOW), F.size("vals")))
    window = lambda c, i: F.slice(c, i + 1, F.col("width"))
    places = F.sequence(F.lit(0), F.size("vals") - F.col("width"))
    said = F.filter(places, lambda i: _different(F.filter(window("tokens", i), lambda t: ~is_slot(t))) >= least_words)
    told = F.filter(places, lambda i: _different(window("vals", i)) >= least_words)
    return items.withColumn("said", said).withColumn("told", told)


def widths_of(items: DataFrame) -> list[int]:
    return sorted(r["width"] for r in items.select("width").distinct().collect()) or [WINDOW]


def benchmark_keys(items: DataFrame, widths: list[int]) -> DataFrame:
    """key, pattern, item_id, item and item_pos of all windows that count."""
    own = ["item_id", "item", "item_pos", "key"]
    parts = []
    for kind, column, places in ((TEMPLATE, "tokens", "said"), (VALUE, "vals", "told")):
        every = F.lit(None).cast("array<bigint>")
        for w in widths:
            every = F.when(F.col("width") == w, _keyed(F.col(column), kind, [w])).otherwise(every)
        of = items.select("item_id", "item", "vals", "tokens", "width", places, F.posexplode(every).alias("item_pos", "key")).where(F.array_contains(places, F.col("item_pos")))
        held = F.slice(F.arrays_zip(F.col("tokens").alias("t"), F.col("vals").alias("v")), F.col("item_pos") + 1, F.col("width"))
        slots = F.transform(F.filter(held, lambda x: is_slot(x["t"])), lambda x: x["v"])
        same = _let(slots, lambda s: F.array_join(F.transform(s, lambda v: F.array_position(s, v).cast("string")), ","))
        parts.append(of.select(*own, (same if kind == TEMPLATE else F.lit("")).alias("pattern")))
    small = items.where((F.size("said") == 0) & (F.size("told") == 0))
    return parts[0].unionByName(parts[1]).unionByName(small.select("item_id", "item", F.lit(0).alias("item_pos"), _whole_key(F.col("vals")).alias("key"), F.lit("").alias("pattern")))


def _owned(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key", "pattern").agg(F.min(F.struct(F.col("item_id").isNull().alias("none"), "item_id", "item", "item_pos")).alias("own"))


def representatives(benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", units: str = UNITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """item_id, representative: the items that stand for an item's windows (often itself)."""
    items = Workspace(benchmark.sparkSession, "decontamination").write(benchmark_items(benchmark, item_col, item_text_col, units, least_words), "items")
    keys = benchmark_keys(items, widths_of(items))
    return keys.join(_owned(keys), ["key", "pattern"]).select("item_id", F.col("own.item_id").alias("representative")).distinct()


def _runs(n: Column, breaks: Column) -> Column:
    """start and stop of the runs of 0 to n - 1 between breaks, the rising places that belong to none."""
    bounds = F.concat(F.array(F.lit(-1)), breaks, F.array(n))
    return F.zip_with(F.slice(bounds, 1, F.size(bounds) - 1), F.slice(bounds, 2, F.size(bounds) - 1), lambda a, b: F.struct((a + 1).alias("start"), b.alias("stop")))


def _places(aligned: Column, hit) -> Column:
    return F.filter(F.transform(aligned, lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull())


def _judged(a: Column, from_: Column, whole: Column, inconsistent: bool) -> Column:
    """The runs of an alignment (t and v of the item over dt and dv of the document), each with its windows and slots."""
    width = F.col("width")

    def with_breaks(b: Column) -> Column:
        free = lambda q, breaks: ~F.exists(breaks, lambda p: (p >= q - from_) & (p < q - from_ + width))
        inside = lambda run, q: (run["start"] <= q - from_) & (q - from_ + width <= run["stop"])
        here = lambda run, places, breaks: F.filter(places, lambda q: inside(run, q) & free(q, breaks))

        def of(run: Column) -> Column:
            own = F.slice(a, run["start"] + 1, run["stop"] - run["start"])
            told = here(run, F.col("told"), b["v"])
            n_windows = F.size(F.array_union(here(run, F.col("said"), b["t"]), told)) + whole.cast("int")
            slots = F.array_distinct(F.transform(F.filter(own, lambda x: is_slot(x["t"])), lambda x: F.struct(x["v"].alias("v"), x["dv"].alias("dv"))))
            consistent = lambda s: F.size(s) == F.size(F.array_distinct(F.transform(s, lambda x: x["v"])))
            equal = ~F.exists(own, lambda x: x["v"] != x["dv"])
            judge = lambda s: F.struct(n_windows.alias("n_windows"), F.size(own).alias("matched"), F.size(s).alias("n_slots"), consistent(s).alias("consistent"), (equal | (~consistent(s) & (F.size(told) > 0))).alias("exact"))
            return _let(slots, judge)

        found = F.filter(F.transform(_runs(F.size(a), b["both"]), of), lambda x: x["n_windows"] > 0)
        return found if inconsistent else F.filter(found, lambda x: x["consistent"])

    differ_t, differ_v = lambda x: x["t"] != x["dt"], lambda x: x["v"] != x["dv"]
    breaks = F.struct(_places(a, differ_t).alias("t"), _places(a, differ_v).alias("v"), _places(a, lambda x: differ_t(x) & differ_v(x)).alias("both"))
    return _let(breaks, with_breaks)


def _summed(runs: Column) -> Column:
    total = lambda c: F.aggregate(F.transform(runs, lambda x: x[c]), F.lit(0), lambda s, x: s + x)
    some = lambda c: F.exists(runs, lambda x: x[c])
    most = F.array_max(F.transform(runs, lambda x: x["matched"]))
    one = F.struct(total("n_windows").alias("n_windows"), most.alias("matched"), total("n_slots").alias("n_slots"), *(some(c).alias(c) for c in ("consistent", "exact")))
    return F.filter(F.array(one), lambda x: x["n_windows"] > 0)


def leaks(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", inconsistent: bool = False, units: str = UNITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """least_words: how many different words a window must say to be found inside longer text; 1 finds every item of the benchmark wherever it stands. Tells k1, k2, doc_id, item_id (of the representative), n_windows, n_matched (longest run), coverage, n_slots, exact and consistent of each leak; inconsistent: with the runs whose slots are not consistent."""
    spark = documents.sparkSession
    work = Workspace(spark, "decontamination")
    items = work.write(benchmark_items(benchmark, item_col, item_text_col, units, least_words), "items")
    widths = widths_of(items)
    known = _owned(benchmark_keys(items, widths)).select("key", "own.item", "own.item_pos")
    known = known_table = work.write(known.join(items.select("item", F.size("vals").alias("size")), "item"), "known")
    few = known.count() <= FEW_WINDOWS
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_keys(F.col(id_col), F.col(text_col)))
    # windows of one kind and width after another, then the whole: places repeat with the number of tokens
    keys = lambda m: F.concat(_keyed(template(m), TEMPLATE, widths), _keyed(values(m), VALUE, widths), F.array(_whole_key(values(m))))
    every = docs.select("k1", "k2", _let(marked(F.col("text"), units), lambda m: F.struct(F.size(m).alias("n"), keys(m).alias("keys"))).alias("s"))
    every = every.select("k1", "k2", F.col("s.n").alias("n"), F.posexplode("s.keys").alias("at", "key"))
    hits = every.join(F.broadcast(known) if few else known, "key").withColumn("pos", F.col("at") % F.col("n"))
    # how an item lies on a document; equal rows hit alike
    laid = work.write(hits.select("k1", "k2", "item", "size", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "laid")
    work.drop(known_table)
    found = laid.groupBy("k1", "k2").agg(F.collect_list(F.struct("item", "size", "shift")).alias("laid"))
    # dealt by key whatever the number of hits: their documents can be most of the corpus
    texts = docs.join(found.hint("merge"), ["k1", "k2"]).select("k1", "k2", "doc_id", "laid", marked(F.col("text"), units).alias("m"))
    texts = texts.select("k1", "k2", "doc_id", "laid", values(F.col("m")).alias("dv"), template(F.col("m")).alias("dt"))
    before = lambda shift: F.greatest(-shift, F.lit(0))
    under = lambda d, h, c: F.slice(d[c], h["shift"] + before(h["shift"]) + 1, h["size"] - before(h["shift"]))
    parts = lambda d: F.transform(d["laid"], lambda h: F.struct(h["item"].alias("item"), h["shift"].alias("shift"), (F.size(d["dv"]) == h["size"]).alias("alone"), under(d, h, "dv").alias("dv"), under(d, h, "dt").alias("dt")))
    pairs = texts.select("k1", "k2", "doc_id", F.inline(_let(F.struct("laid", "dv", "dt"), parts)))
    pairs = pairs.join(F.broadcast(items) if few else items, "item")
    from_ = before(F.col("shift"))
    over = lambda c: F.slice(c, from_ + 1, F.size("dv"))
    aligned = F.arrays_zip(over("tokens").alias("t"), over("vals").alias("v"), F.col("dt"), F.col("dv"))
    whole = F.col("alone") & (F.size("said") == 0) & (F.size("told") == 0)
    # generated, as a filter would be pushed to where these columns are worked out again for each use
    judged = _let(_let(aligned, lambda a: _judged(a, from_, whole, inconsistent)), _summed)
    rows = pairs.select("k1", "k2", "doc_id", "item_id", "item", "shift", F.size("vals").alias("size"), F.inline(judged)).distinct()
    return rows.groupBy("k1", "k2", "doc_id", "item_id").agg(
        F.sum("n_windows").cast("bigint").alias("n_windows"), F.max("matched").cast("bigint").alias("n_matched"), F.round(F.max(F.col("matched") / F.col("size")), 6).alias("coverage"),
        F.max("n_slots").cast("bigint").alias("n_slots"), F.bool_or("exact").alias("exact"), F.bool_or("consistent").alias("consistent"),
    )


def remove_leaks(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The documents that leak no item, with their own columns: those with consistent or exact runs go."""
    own = documents.columns
    k1, k2 = row_keys(F.col(id_col), F.col(text_col))
    found = leaks(documents, benchmark, id_col=id_col, text_col=text_col, inconsistent=True, **columns)
    gone = found.where("exact or consistent").select("k1", "k2").distinct()
    keyed = documents.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)), k1, k2)
    return keyed.join(gone, ["k1", "k2"], "left_anti").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), inconsistent=True)
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "coverage", "n_slots", "exact", "consistent")
