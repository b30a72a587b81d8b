"""Secrets in texts: patterns, and a battery of randomness tests with false-discovery control.

Base spans come from three patterns. Besides, every run of 16 or more
encoding characters is a candidate. Its encoding is inferred (hex, base32,
upper, lower or mixed alphanumeric, base64), and three tests ask whether its
symbols look random in that alphabet: chi-squared uniformity, the number of
runs about the alphabet's middle, and lag-one serial correlation. Three times
the least p-value says how well the string passes.

Short strings pass easily, so what "passing" is worth is measured by length, on
decoys, which look like candidates and are no secrets: runs of plain letters that
stand in texts, and the plain words of every whole text, joined and cut
into strings of the least length of each class in turn, to the text's end. A candidate's
empirical p-value is the share of decoys of its length class (of it and the shorter ones,
where it has less than LEAST_DECOYS) that look as random as it does, and Benjamini-Hochberg over all candidates of the corpus bounds the
share of false discoveries. The statistics are counts by length class and score, at
most 9 * 41 * 2, whatever the input; nothing else reaches the driver. Only DataFrame
functions are used.

Defined cases: a null text is empty and has no spans; equal rows get equal
results; without decoys nothing is added to the base spans; an empty table
gives an empty result; other columns are ignored (``redact`` keeps them).
A candidate inside a base span is not reported again; digits alone are a number, and
words and numbers between separators an identifier, a path or a date: no candidates. Candidates of equal score and length class are found or not
together. A very long text is one row; its spans cost little more than its length.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let, starts_of
from .storage import Workspace

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
#: What plain identifiers, paths and dates are made of: words and numbers between separators. A candidate has LEAST_MIXED characters beside them.
PLAIN_PIECES = r"(?<![A-Za-z0-9+])(?:[A-Z]?[a-z]{3,}|[A-Z]{3,}|[0-9]+)(?![A-Za-z0-9+])|[_/=-]"
LEAST_MIXED = 12
WORD = r"(?<![A-Za-z0-9+/_-])[A-Z]?[a-z]+(?![A-Za-z0-9+/_-])"
DECOY = r"\A[A-Z]?[a-z]+\z"
KINDS = ("assign", "access", "hex", "random")
#: Alphabets by name: a test of membership and the symbols in order.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    (r"\A[0-9a-f]+\z", DIGITS + "abcdef"),
    (r"\A[0-9A-F]+\z", DIGITS + "ABCDEF"),
    (r"\A[A-Z2-7]+\z", UPPER + "234567"),
    (r"\A[A-Z0-9]+\z", DIGITS + UPPER),
    (r"\A[a-z0-9]+\z", DIGITS + LOWER),
    (r"\A[A-Za-z0-9]+\z", DIGITS + UPPER + LOWER),
    (r"", UPPER + LOWER + DIGITS + "+/-_"),
)
WORST = 40
#: Least lengths of the classes.
CLASSES = (16, 20, 24, 28, 32, 40, 48, 64, 128)
LEAST_DECOYS = 50
#: Between symbols, and not behind the last: an empty one there would count as a run.
SYMBOLS = r"(?!^)(?!\z)"
#: A string is not random at all beyond this score (p of 0.001).
REJECTED = 12


def _found(text: Column, pattern: str) -> Column:
    """start, end and value of the leftmost non-overlapping matches, in code points. Texts without a match are read once, others twice."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def spans(values: Column) -> Column:
        pieces = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(values)), lambda p: F.length(p))
        # before a match lie the pieces up to it and the matches before it
        def put(pairs: Column) -> Column:
            starts = starts_of(F.transform(pairs, lambda x: x["p"] + F.length(x["v"])))
            return F.zip_with(pairs, starts, lambda x, at: F.struct((at + x["p"]).alias("start"), (at + x["p"] + F.length(x["v"])).alias("end"), x["v"].alias("value")))

        return F.when(F.size(values) > 0, let(F.zip_with(pieces, values, lambda p, v: F.struct(p.alias("p"), v.alias("v"))), put)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), by a logistic approximation that is good to about 1e-4 and falls off smoothly beyond."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def _battery(value: Column) -> Column:
    """The score of a string: 0 if it passes, more the less random it looks, WORST at most (four for each power of ten)."""
    core = F.regexp_replace(value, "=+$", "")
    alphabet = F.lit(ALPHABETS[-1][1])
    for test, symbols in reversed(ALPHABETS[:-1]):
        alphabet = F.when(core.rlike(test), symbols).otherwise(alphabet)
    return F.transform(F.array(F.struct(core.alias("s"), alphabet.alias("a"))), lambda x: _score(x["s"], x["a"]))[0]


def _score(s: Column, alphabet: Column) -> Column:
    n, k = F.length(s).cast("double"), F.length(alphabet).cast("double")
    places = F.transform(F.split(s, SYMBOLS), lambda c: F.call_function("instr", alphabet, c) - 1.0)
    counts = F.transform(F.split(alphabet, SYMBOLS), lambda c: (n - F.length(F.replace(s, c, F.lit("")))))
    uniform = _uniform(F.aggregate(counts, F.lit(0.0), lambda t, c: t + c * c), n, k)
    # one pass over the symbols: runs about the middle, and sums for the serial correlation
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("high", "runs", "x", "xx", "xy")), F.lit(-1.0).alias("last"))

    def step(t: Column, x: Column) -> Column:
        high, first = x >= k / 2, t["last"] < 0
        new_run = first | (high != (t["last"] >= k / 2))
        return F.struct(
            (t["high"] + high.cast("double")).alias("high"), (t["runs"] + new_run.cast("double")).alias("runs"), (t["x"] + x).alias("x"),
            (t["xx"] + x * x).alias("xx"), (t["xy"] + F.when(first, 0.0).otherwise(t["last"] * x)).alias("xy"), x.alias("last"),
        )

    return _worst_of(uniform, F.aggregate(places, zero, step, lambda t: _ordered(n, *(t[c] for c in ("high", "runs", "x", "xx", "xy")))))


def _uniform(squares: Column, n: Column, k: Column) -> Column:
    """How likely n symbols out of k are as uneven, from the sum of squares of their counts."""
    chi2 = squares * k / n - n
    df = k - 1
    z = (F.pow(F.greatest(chi2, F.lit(0.0)) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    return _upper_tail(z)


def _ordered(n: Column, high: Column, runs: Column, x: Column, xx: Column, xy: Column) -> Column:
    """How likely their runs about the middle or their serial correlation are as odd."""
    mean = 1 + 2 * high * (n - high) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    by_runs = F.when(var > 0, 2 * _upper_tail(F.abs(runs - mean) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(0.0)
    spread = xx - x * x / n
    r = (xy - x * x / n) / F.greatest(spread, F.lit(1e-9))
    serial = F.when(spread > 0, 2 * _upper_tail(F.abs(r) * F.sqrt(n))).otherwise(0.0)
    return F.least(by_runs, serial)


def _worst_of(uniform: Column, ordered: Column) -> Column:
    p = F.least(3 * F.least(uniform, ordered), F.lit(1.0))
    return F.least(F.floor(-4 * F.log10(F.greatest(p, F.lit(1e-12)))), F.lit(WORST)).cast("int")


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def scan(documents: DataFrame, carry: list[Column], text: Column) -> DataFrame:
    """carry, base (spans of the patterns) and candidates (start, end, length class, score, decoy) of each text."""
    t = documents.select(*carry, F.coalesce(text, F.lit("")).alias("__text"))
    own = [c for c in t.columns if c != "__text"]
    t = t.withColumn("__assign", F.filter(_found(F.col("__text"), ASSIGN), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= 6))
    t = t.withColumn("__access", _found(F.col("__text"), ACCESS)).withColumn("__hex", _found(F.col("__text"), HEX)).withColumn("__runs", _found(F.col("__text"), CANDIDATE))
    base = F.array_sort(F.concat(_of_kind(F.col("__assign"), 0), _of_kind(F.col("__access"), 1), _of_kind(F.col("__hex"), 2)))
    t = t.select(*(F.col(f"`{c}`") for c in own), base.alias("base"), "__runs")
    # the base spans are bound once a row, not worked out for each run
    free = F.transform(F.array("base"), lambda b: F.filter("__runs", lambda x: (x["value"].rlike(DECOY) | (F.length(F.regexp_replace(x["value"], PLAIN_PIECES, "")) >= LEAST_MIXED)) & x["value"].rlike("[A-Za-z]") & ~F.exists(b, lambda y: (y["start"] <= x["start"]) & (y["end"] >= x["end"]))))[0]
    candidate = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _class(F.length(x["value"])).alias("length"), _battery(x["value"]).alias("score"), x["value"].rlike(DECOY).alias("decoy"))
    return t.select(*(F.col(f"`{c}`") for c in own), "base", F.transform(free, candidate).alias("candidates"))


def _class(length: Column) -> Column:
    return (F.size(F.filter(F.array(*map(F.lit, CLASSES)), lambda least: least <= length)) - 1).cast("int")


def decoys(documents: DataFrame, text: Column) -> DataFrame:
    """value: the decoys of all whole texts. The letters of a text's plain words are cut, without what is between them, into one string of the least length of each class in turn, and again from the first class on. Behind the last string for which there are letters come shorter ones of the first class; so only a text's last letters, fewer than those, are in none."""
    block = sum(CLASSES)
    letters = F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "")
    # cut by a pattern, which goes through a long text once, and then within short blocks
    blocks = documents.select(F.explode(F.regexp_extract_all(letters, F.lit(f".{{1,{block}}}"), F.lit(0))).alias("b"))
    ends = [sum(CLASSES[: i + 1]) for i in range(len(CLASSES))]
    has = F.length("b")
    cut = F.array(*(F.when(has >= end, F.substring("b", end - n + 1, n)) for n, end in zip(CLASSES, ends, strict=True)))
    used = F.greatest(F.lit(0), *(F.when(has >= end, end) for end in ends))
    rest = F.when(used < has, F.regexp_extract_all(F.substring("b", used + 1, F.lit(block)), F.lit(f".{{{CLASSES[0]}}}"), F.lit(0)))
    return blocks.select(F.explode(F.concat(cut, F.coalesce(rest, F.array().cast("array<string>")))).alias("value")).where("value is not null")


#: The alphabets of joined words, each of which has a small letter: hex, lower and mixed alphanumeric.
OF_WORDS = (ALPHABETS[0][1], ALPHABETS[4][1], ALPHABETS[5][1])
#: Where the sums of a string's places stand in a long: its last place in the least bits, then of products of neighbours, of squares and of places.
XY, XX, X = 7, 27, 47


def decoy_counts(documents: DataFrame, text: Column) -> DataFrame:
    """length (class), score and n of all decoys: the scores of ``_battery``, from sums of a string's symbols that cost less than its steps, as decoys are as many as all words make."""
    letters = LOWER + UPPER
    by_alphabet = lambda values: F.when(F.col("k") == len(OF_WORDS[0]), values[0]).when(F.col("k") == len(OF_WORDS[1]), values[1]).otherwise(values[2])
    k = F.when(F.col("value").rlike("[A-Z]"), len(OF_WORDS[2])).when(F.col("value").rlike("[g-z]"), len(OF_WORDS[1])).otherwise(len(OF_WORDS[0]))
    rows = decoys(documents, text).select("value", F.length("value").alias("n"), k.alias("k"))
    # each symbol as the character of its place, and as the half that it is in
    places = by_alphabet([F.translate("value", a, "".join(chr(48 + i) for i in range(len(a)))) for a in OF_WORDS])
    halves = by_alphabet([F.translate("value", a, "".join("LH"[2 * i >= len(a)] for i in range(len(a)))) for a in OF_WORDS])
    symbols = F.transform(F.split(places, ""), lambda c: (F.ascii(c) - 48).cast("bigint"))
    sums = F.aggregate(symbols, F.lit(0).cast("bigint"), lambda t, x: t + x * F.lit((1 << X) + 1) + x * x * F.lit(1 << XX) + t.bitwiseAND(F.lit(127)) * (x * F.lit(1 << XY) - F.lit(1)))
    without = F.array(*(F.length(F.replace("value", F.lit(c), F.lit(""))) for c in letters))
    squares = F.aggregate(F.transform(without, lambda m: F.col("n") - m), F.lit(0), lambda t, c: t + c * c)
    rows = rows.select("n", "k", halves.alias("halves"), sums.alias("sums"), squares.alias("squares"))
    without = lambda what, by: F.length("halves") - F.length(F.replace("halves", F.lit(what), F.lit(by)))
    field = lambda at, bits: F.shiftright("sums", at).bitwiseAND(F.lit((1 << bits) - 1)).cast("double")
    rows = rows.select(F.col("n").cast("double").alias("n"), F.col("k").cast("double").alias("k"), F.col("squares").cast("double").alias("squares"), without("H", "").cast("double").alias("high"), (1 + without("LH", "L") + without("HL", "H")).cast("double").alias("runs"), field(X, 14).alias("x"), field(XX, 20).alias("xx"), field(XY, 20).alias("xy"))
    score = _worst_of(_uniform(F.col("squares"), F.col("n"), F.col("k")), _ordered(F.col("n"), *map(F.col, ("high", "runs", "x", "xx", "xy"))))
    return rows.select(_class(F.col("n")).alias("length"), score.alias("score")).groupBy("length", "score").agg(F.count(F.lit(1)).alias("n"))


def thresholds(scanned: DataFrame, joined: DataFrame, rate: float = 0.05) -> list[int]:
    """For each length class the worst score that counts as a discovery, -1: none. joined: length, score and n of the decoys that words make."""
    cells = scanned.select(F.explode("candidates").alias("c")).groupBy("c.length", "c.score", "c.decoy").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.unionByName(joined.withColumn("decoy", F.lit(True))).groupBy("length", "score", "decoy").agg(F.sum("n").alias("n")).collect()
    decoys, real = ({(r["length"], r["score"]): r["n"] for r in cells if r["decoy"] == d} for d in (True, False))

    def p_value(length: int, score: int) -> float:
        own = {s: n for (b, s), n in decoys.items() if b == length}
        if sum(own.values()) < LEAST_DECOYS:  # shorter decoys look more random, so they are too strict, never too lax
            own = Counter()
            for (b, s), n in decoys.items():
                own[s] += n if b <= length else 0
        return (1 + sum(n for s, n in own.items() if s <= score)) / (1 + sum(own.values()))

    cell_p = sorted((p_value(*cell), *cell) for cell in real)
    m, seen, limit = sum(real.values()), 0, 0.0
    for i, (p, length, score) in enumerate(cell_p):
        seen += real[length, score]
        if (i + 1 == len(cell_p) or cell_p[i + 1][0] > p) and p <= rate * seen / m:
            limit = p
    return [max((s for p, b, s in cell_p if b == length and p <= limit and s <= REJECTED), default=-1) for length in range(len(CLASSES))]


def all_spans(found: list[int]) -> Column:
    """Base spans and the discoveries, by start and then kind."""
    limit = F.array(*map(F.lit, found))
    added = F.filter("candidates", lambda c: ~c["decoy"] & (c["score"] <= F.element_at(limit, c["length"] + 1)))
    return F.array_sort(F.concat("base", _of_kind(added, 3)))


def listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """One row per document: doc_id, base and all_spans (arrays of start, kind as a place in KINDS, end)."""
    work = Workspace(documents.sparkSession, "secret-scan")
    scanned = work.write(scan(documents, [F.col(id_col).alias("doc_id")], F.col(text_col)), "scanned")
    return scanned.select("doc_id", "base", all_spans(thresholds(scanned, decoy_counts(documents, F.col(text_col)), rate)).alias("all_spans"))


def redact(documents: DataFrame, *, text_col: str = "text", rate: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret in their text replaced by a mark; the statistics are a first pass over all texts."""
    own = documents.columns
    renamed = documents.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)))
    text = f"c{own.index(text_col)}"
    # the scan is written with the texts: to read them again costs less than to scan them again
    work = Workspace(documents.sparkSession, "secret-scan")
    scanned = work.write(scan(renamed, [F.col(c) for c in renamed.columns], F.col(text)), "scanned")
    spans = scanned.withColumn("spans", all_spans(thresholds(scanned, decoy_counts(scanned, F.col(text)), rate)))

    def cut(state: Column, x: Column) -> Column:
        before = F.substring(F.col(text), state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        new = x["start"] >= state["at"]
        return F.struct(F.greatest(x["end"], state["at"]).alias("at"), F.when(new, F.concat(state["out"], before, F.lit(mark))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", start, cut, lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(text))))
    cleaned = F.when(F.size("spans") > 0, clean).otherwise(F.col(text))
    return spans.select(*((cleaned if c == text else F.col(c)).alias(name) for c, name in zip(renamed.columns, own, strict=True)))


def base_columns() -> list[Column]:
    """Counts by kind of the base spans, and the hash of their list."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")
    return [*(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])), F.sha2(listed(F.col("base")), 256).alias("base_sha256")]


def base_spans(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and base of each document: what the patterns alone tell, without candidates, decoys or thresholds."""
    return scan(documents, [F.col(id_col).alias("doc_id")], F.col(text_col)).select("doc_id", "base")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    rows = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", *base_columns(), listed(F.col("all_spans")).alias("spans"))
