"""Exact n-gram Jaccard join of documents: which texts link, and their components.

A document's set is its distinct word shingles; two documents link when
``100 * |a & b| >= percent * |a | b|``. The join is size-aware:

1. *Who can link at all.* A set of n shingles needs o = ceil(percent * n / 100)
   in common with any partner. Under one order of all shingles (their hash),
   partners share at least c of their first n - o + c shingles, for any c. So
   each set sends that prefix (c is about a fifth of o) to the repeat exchange,
   and only sets with c or more shingles that occur elsewhere go on. All
   documents take part; texts of one set are one node from here on.
2. *Heavy and light.* The whole sets of what is left are exchanged likewise, and
   only those with o shingles that occur elsewhere go on. Their shared shingles
   are ordered anew, rarest first, by the exact number of sets. Light sets
   enumerate subsets of fixed size two of their first (shared - o + 2); a heavy
   set's first (shared - o + 1) go into inverted lists, which are scanned for
   pairs with at least one heavy set. Both lose no link. The boundary may be any
   size and is that which costs least: subsets emitted by the light, against list
   entries of the heavy, each of which is written and meets one node.
3. *Scan.* In each list the first 1, then 16, 256, ... nodes (those with the
   commonest shingles first: a group's original before its copies) meet all
   others of the list that are not yet in their component and of which enough
   shingles are left; pairs are verified on whole sets. A list ends when it
   holds one component or all its pairs have met, so a list of near copies
   costs its length, not its square, and no link between components is lost.

A list with more than one in HOT_SHARE of all entries is dealt over pieces that its
first nodes visit, and nodes and sets that a large share of rows have meet their label
by broadcast; so at most HOT_SHARE keys reach the driver, and besides them a histogram of
sizes with some hundred bins. No other table is broadcast or collected.

Defined cases: ties and repeated rows: equal sets are one node. Null, empty or
blank texts have no set, link with nothing and are their own component. Null
ids are never a component's smallest id, unless it has no other. Very long texts are
one set each, in one row. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import SMALL, U64, mix, slices, spans_hash, windows
from .repeats import answers, blocks_for, by_document, sent_by
from .storage import HOT_SHARE, SMALL_BATCH, Workspace, hot_bound, left_join_hot, row_keys, whole_row_key

SALTS = 32
#: Keys that a task sends at once, at least.
LEAST = 1 << 18


def _need(n, percent):
    return -(-n * percent // 100)


def _common(n, percent):
    """c of a set of n: how many shingles of prefixes partners share at least."""
    o = _need(n, percent)
    return np.minimum(o, np.maximum(2, n * 15 // 100))


def _need_sql(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def shingle_sets(words, k: int):
    """Distinct shingles of each document: their document and hash, by document and then by hash; and how many each has."""
    h = words.hashes(lower=True)
    g, whole = windows(h, words.first, k)
    doc = words.document()
    n_words = np.diff(words.first)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    few = mix(spans_hash(h, words.first[short], words.first[short + 1]), 7) + n_words[short].astype(U64)
    doc, g = np.concatenate([doc[whole], short]), np.concatenate([g[whole], few])
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    doc, g = doc[new], g[new]
    return doc, g, np.bincount(doc, minlength=len(n_words))


def _names(g, sizes):
    """A 64-bit name of each set, whatever the order of its members; 0 for the empty one."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(g, 5))])
        ends = np.cumsum(sizes)
        return np.where(sizes > 0, mix(total[ends] - total[ends - sizes] + sizes.astype(U64), 6), U64(0)).view(np.int64)


def _prefix(sizes, percent):
    """Rank of each shingle in its set, and whether it is in the prefix."""
    ends = np.cumsum(sizes)
    rank = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    length = np.minimum(sizes, sizes - _need(sizes, percent) + _common(sizes, percent))
    return rank, rank < np.repeat(length, sizes)


def _keys(batch):
    return batch.column("k1").to_numpy(zero_copy_only=False), batch.column("k2").to_numpy(zero_copy_only=False)


def _send(k, percent):
    def produce(batches):
        for batch, words in slices(batches, limit=SMALL):
            doc, g, sizes = shingle_sets(words, k)
            rank, chosen = _prefix(sizes, percent)
            yield (*_keys(batch), doc[chosen], rank[chosen], mix(g[chosen], 8), None)  # mixed, as a prefix holds the least hashes

    return produce


def _profile(k):
    def run(batches):
        for batch, words in slices(batches, limit=SMALL):
            _, g, sizes = shingle_sets(words, k)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(_names(g, sizes), pa.int64(), mask=sizes == 0)], ["k1", "k2", "doc_id", "n", "node"])

    return run


def _sets(k, percent):
    """Sets of the documents with enough shingles in their prefix that occur elsewhere."""

    def run(batches):
        for batch, words in slices(batches, limit=SMALL):
            _, g, sizes = shingle_sets(words, k)
            names, ends = _names(g, sizes), np.cumsum(sizes)
            rows = []
            for d, parts in enumerate(batch.column("parts").to_pylist()):
                own = g[ends[d] - sizes[d] : ends[d]]
                flagged = len(np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in parts])))
                if flagged >= int(_common(_need(sizes[d], percent), percent)):
                    rows.append((int(names[d]), int(sizes[d]), own.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["node", "n", "members"])

    return run


def _lists_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists of longs."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy().view(U64)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _send_whole(batches):
    """Whole sets of nodes, for the second look at what occurs elsewhere."""
    for batch in batches:
        names = batch.column("node").to_numpy(zero_copy_only=False)
        values, offsets = _lists_of(batch.column("members"))
        at = 0
        while at < len(names):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + LEAST, side="right")) - 1)
            n = np.diff(offsets[at : to + 1])
            rank = np.arange(n.sum()) - np.repeat(offsets[at:to] - offsets[at], n)
            yield names[at:to], names[at:to], np.repeat(np.arange(to - at), n), rank, mix(values[offsets[at] : offsets[to]], 9), None
            at = to


def _verify(percent):
    def run(batches):
        for batch in batches:
            a, of_a = _lists_of(batch.column("set_a"))
            b, of_b = _lists_of(batch.column("set_b"))
            keep = []
            for i in range(batch.num_rows):
                x, y = a[of_a[i] : of_a[i + 1]], b[of_b[i] : of_b[i + 1]]
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def connect(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, root: the least node of each component of the edges (a, b), by least labels and pointer jumping. Rows of a node that many edges meet (a group's original) are split by adaptive skew joins: no grouping follows them in their stage."""
    both = work.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = work.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("root").alias("up"))
        new = work.write(step.join(up, "next", "left").select("node", F.least("next", F.coalesce("up", "next")).alias("root"), (F.least("next", F.coalesce("up", "next")) < F.col("root")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        work.drop(labels)
        labels = new
        if not moved:
            work.drop(both)
            return labels.select("node", "root")


def _bin(n: Column) -> Column:
    """Sizes up to 64 by themselves, larger ones sixteen to each doubling: some hundred bins, whatever the sizes. The largest size of the bin of n."""
    return F.when(n <= 64, n).otherwise(F.floor(F.pow(F.lit(2.0), F.ceil(F.log2(n) * 16) / 16))).cast("bigint")


def boundary_by_cost(ordered: DataFrame) -> int:
    """The largest light size, by the cost of subsets against the cost of scanning lists.

    A light set costs the subsets it emits. A heavy one costs the entries of the
    lists that it stands in: each is written, and meets the list's first node.
    """
    m = F.greatest(F.col("spare"), F.lit(0))
    light, heavy = (m + 2) * (m + 1) / 2, 2 * (m + 1)
    costs = ordered.groupBy(_bin(F.col("n")).alias("n")).agg(F.sum(light).alias("light"), F.sum(heavy).alias("heavy")).orderBy("n").collect()
    best, at, now = 0.0, 1, 0.0
    for r in costs:
        now += r["light"] - r["heavy"]
        if now < best:
            best, at = now, int(r["n"])
    return at


def _lists(ordered: DataFrame, boundary: int, percent: int) -> DataFrame:
    """heavy, key, node, n, left, hub: inverted lists and, for light sets, those of pairs of shingles. left: how many shared shingles a node has from the key's (first) one on. hub: order in which nodes are to meet the others, those with the commonest shingles first."""
    hub = F.aggregate("ordered", F.lit(0.0), lambda s, x: s + x["df"]) / F.col("n")
    rows = ordered.withColumn("hub", F.struct((-hub).alias("less"), "node")).withColumn("shared", F.size("ordered"))
    first = lambda more: F.slice("ordered", 1, F.greatest(F.col("spare") + more, F.lit(0)))
    heavy = rows.where(F.col("n") >= (boundary + 1) * percent / 100).select("node", "n", "hub", "shared", F.posexplode(F.transform(first(1), lambda x: x["h"])).alias("at", "key"))
    light = rows.where(F.col("n") <= boundary).select("node", "n", "hub", "shared", first(2).alias("pool"))
    pairs = F.transform("pool", lambda x, i: F.transform(F.slice("pool", i + 2, F.size("pool")), lambda y: F.xxhash64(x["h"], y["h"])))
    light = light.select("node", "n", "hub", "shared", F.posexplode(pairs).alias("at", "keys")).select("node", "n", "hub", "shared", "at", F.explode("keys").alias("key"))
    of = lambda kind: ["key", "node", "n", "hub", (F.col("shared") - F.col("at")).alias("left"), F.lit(kind).alias("heavy")]
    return heavy.select(*of(True)).unionByName(light.select(*of(False)))


def _in_pieces(lists: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``piece``: hot lists are dealt over as many pieces as they hold the bound, others are one. live: heavy, key, rows."""
    bound = hot_bound(lists.count())
    hot = live.where(F.col("rows") > bound).select("heavy", "key", F.ceil(F.col("rows") / bound).cast("int").alias("pieces"))
    names = hot.limit(HOT_SHARE).collect()
    if not names:
        return lists.withColumn("piece", F.lit(0)), live.withColumn("pieces", F.lit(1)).withColumn("piece", F.lit(0))
    hot = F.broadcast(lists.sparkSession.createDataFrame(names, hot.schema))
    lists = lists.join(hot, ["heavy", "key"], "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("node"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
    live = live.join(hot, ["heavy", "key"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    return lists, live.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))


def link_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, boundary: int | None = None) -> DataFrame:
    """One row per document: k1, k2 (row keys), doc_id, n_shingles and component, a key of its component (null for empty sets). boundary: the largest light size, instead of that by cost."""
    spark = documents.sparkSession
    work = Workspace(spark, "jaccard-join")
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_keys(F.col(id_col), F.col(text_col)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    id_type = dict(docs.dtypes)["doc_id"]
    profile = work.write(docs.mapInArrow(_profile(shingle), f"k1 long, k2 long, doc_id {id_type}, n long, node long"), "profile", SMALL_BATCH)
    texts = docs.select("k1", "k2", "text")
    able = work.write(by_document(answers(sent_by(texts, _send(shingle, percent), blocks_for(n_chars // 15, partitions), False, LEAST), False)), "able", SMALL_BATCH)
    sets = texts.join(able, ["k1", "k2"]).mapInArrow(_sets(shingle, percent), "node long, n long, members array<long>")
    some = work.write(sets.dropDuplicates(["node"]), "sets", SMALL_BATCH)
    work.drop(able)
    n_members = some.agg(F.sum("n")).first()[0] or 0
    seen = by_document(answers(sent_by(some.select("node", "members"), _send_whole, blocks_for(n_members, partitions), False, LEAST), False))
    n_seen = F.aggregate("parts", F.lit(0), lambda s, x: s + F.octet_length(x)) / 4
    enough = seen.select(F.col("k1").alias("node"), n_seen.alias("seen"))
    nodes = work.write(some.join(enough, "node").where(F.col("seen") >= _need_sql(F.col("n"), percent)), "nodes", SMALL_BATCH)
    work.drop(some)
    shingles = nodes.select("node", "n", F.explode("members").alias("h"))
    df = shingles.groupBy("h").agg(F.count("*").alias("df")).where("df >= 2")
    ordered = shingles.join(df, "h").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("ordered"))
    # spare: shared shingles beyond those that any link needs
    ordered = work.write(ordered.withColumn("spare", (F.size("ordered") - _need_sql(F.col("n"), percent)).cast("int")).where("spare >= 0"), "ordered")
    boundary = boundary_by_cost(ordered) if boundary is None else boundary
    lists = work.write(_lists(ordered, boundary, percent), "lists")
    work.drop(ordered)
    links, roots, width = None, None, 1
    while True:
        if roots is not None:
            lists = lists.drop("root").join(roots, "node", "left")  # a node stands in few lists
        else:
            lists = lists.withColumn("root", F.lit(None).cast("long"))
        lists = lists.withColumn("root", F.coalesce("root", "node"))
        live = lists.groupBy("heavy", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo < hi").select("heavy", "key", "rows")
        whole = ["heavy", "key", "piece"]
        lists, live = _in_pieces(lists, work.write(live, "live"))
        lists = work.write(lists.join(live.select(*whole), whole, "left_semi"), "lists")
        # first in each piece, and of those the first of the list
        first = lambda rows, by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("hub"))).where(F.col("rank") <= width)
        pivots = work.write(first(first(lists, whole).drop("rank"), ["heavy", "key"]), "pivots")
        p = pivots.select("heavy", "key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"), F.col("root").alias("root_a"), F.col("hub").alias("hub_a"))
        p = p.join(live.select(*whole), ["heavy", "key"])
        # at the first shingle that two sets share, neither has more in common than it has left; a later list of theirs may be passed over
        enough = F.least("left", "left_a") * (100 + percent) >= (F.col("n") + F.col("n_a")) * percent
        sized = enough & (F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * percent) & (~F.col("heavy") | (F.greatest("n", "n_a") > boundary))
        met = work.write(lists.join(p, whole).where((F.col("hub_a") < F.col("hub")) & (F.col("root_a") != F.col("root")) & sized).select("a", F.col("node").alias("b")).distinct(), "pairs")
        if met.limit(1).count():
            members = nodes.select("node", "members")
            of_a = members.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
            of_b = members.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
            found = work.write(met.join(of_a, "a").join(of_b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long"), "links")
            links = found if links is None else links.unionByName(found)
            roots = connect(links, work)
        rest = lists.join(pivots.select("heavy", "key", "node"), ["heavy", "key", "node"], "left_anti").drop("piece")
        if not rest.limit(1).count():
            break
        lists = rest
        width *= 16
    if roots is not None:
        profile = left_join_hot(profile, roots, "node").withColumn("component", F.coalesce("root", "node")).drop("root")
    else:
        profile = profile.withColumn("component", F.col("node"))
    return profile.select("k1", "k2", "doc_id", F.col("n").alias("n_shingles"), "component")


def salted_least(linked: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the least value in the row's component. A component that holds a third of all rows is dealt over SALTS keys."""
    linked = linked.withColumn("salt", F.pmod("k1", F.lit(SALTS)))
    least = linked.where("component is not null").groupBy("component").agg(F.min(value).alias(name), F.count("*").alias("rows")).where("rows > 1")
    least = least.select("component", name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    return linked.join(least, ["component", "salt"], "left").withColumn(name, F.coalesce(name, value)).drop("salt")


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    linked = link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return salted_least(linked, F.col("doc_id"), "component_id").select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents, with their own columns, but of each component only that with the least id (then key; of rows equal in id and text that with the least hash of all columns); documents without a set stay."""
    linked = link_documents(documents, id_col=id_col, text_col=text_col, **how)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    # rows without a set are told apart by their keys alone
    alone = linked.where("component is null").select("k1", "k2")
    kept = linked.where("component is not null").groupBy("component").agg(F.min(order).alias("least")).select("least.k1", "least.k2").unionByName(alone).distinct()
    own = documents.columns
    keyed = documents.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)), *row_keys(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), whole_row_key(documents).alias("k3"))
    empty = F.size(F.split(F.coalesce(F.col(f"c{own.index(text_col)}"), F.lit("")), r"[^\x20\x09-\x0D]")) == 1
    joined = keyed.join(kept, ["k1", "k2"], "left_semi")
    # rows equal in id and text have equal keys: one of them stays, which all their columns tell, unless they have no set
    fields = F.struct(*(F.col(f"c{i}") for i in range(len(own)))).alias("own")
    once = joined.where(~empty).groupBy("k1", "k2").agg(F.min_by(fields, "k3").alias("own")).select("own").unionByName(joined.where(empty).select(fields))
    return once.select(*(F.col(f"own.c{i}").alias(c) for i, c in enumerate(own)))
