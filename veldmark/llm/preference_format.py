"""Preference pairs as a shared prompt and two masked completions.

A pair is two conversations, chosen and rejected. Their longest common prefix
of whole turns (same role, same text) is rendered once as the prompt; the
rest of each is its completion. A completion comes with a mask: spans of code
points, and whether they count in training: what an assistant said does, up to
and including its end mark, headers and other roles don't.

Only DataFrame functions are used. A conversation is one row after one
grouping by its id; pairs meet in one join or grouping on the pair's id, so a
first turn that a third of all conversations share costs nothing more.

A table of single conversations is turned into pairs by ``pairs_of``: chosen is a
conversation as it is, all its turns; rejected is the same one up to one of its
assistant turns, and goes on as its neighbour does. Which turn it is follows from
the id, so pairs diverge at any turn, and completions have one turn or many.

Defined cases: turns are ordered by number, null numbers first, then role and
text; null roles and texts are empty; equal turns (and whole rows that repeat) stay;
a side without turns is an empty completion; of two equal sides given to
``format_pairs`` all turns but the last are the prompt; very long turns and
conversations cost their length; other columns are ignored, whatever their names; an
empty table gives an empty result. ``pairs_of`` makes no pair where there is no
preference: no neighbour, no assistant turn on one of the sides, or both sides equal;
nor of null ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let, starts_of

HEAD, BODY, END = "<|", "|>\n", "<|end|>\n"


def conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns, an array of role and text in order."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns")).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(BODY), turn["text"], F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Spans start, end and train that cover the rendered turns, two for each turn."""
    head = lambda t: F.length(t["role"]) + len(HEAD) + len(BODY)
    body = lambda t: F.length(t["text"]) + len(END)

    def span(t: Column, at: Column) -> Column:
        said = at + head(t)
        return F.array(F.struct(at.alias("start"), said.alias("end"), F.lit(False).alias("train")), F.struct(said.alias("start"), (said + body(t)).alias("end"), (t["role"] == "assistant").alias("train")))

    return let(turns, lambda ts: F.flatten(F.zip_with(ts, starts_of(F.transform(ts, lambda t: head(t) + body(t))), span)))


def format_pairs(pairs: DataFrame, *, chosen_col: str = "chosen", rejected_col: str = "rejected", keep: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """keep, n_shared, prompt, and of each side completion and mask, from arrays of role and text."""
    empty = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select(*keep, F.coalesce(F.col(chosen_col), empty).alias("c"), F.coalesce(F.col(rejected_col), empty).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, least), F.slice("r", 1, least), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    first_other = F.array_position(same, False)
    shared = F.when(first_other > 0, first_other - 1).otherwise(least)
    # all turns of one side are shared: its last one is left to complete
    shared = F.when((least > 0) & (shared == F.size("c")) & (shared == F.size("r")), shared - 1).otherwise(shared).cast("int")
    rows = rows.select(*keep, "c", "r", shared.alias("n_shared"))
    rest = lambda c: F.slice(c, F.col("n_shared") + 1, F.size(c))
    rows = rows.select(*keep, "n_shared", F.slice("c", 1, F.col("n_shared")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return rows.select(*keep, "n_shared", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen_completion"), _mask(F.col("c")).alias("chosen_mask"), _render(F.col("r")).alias("rejected_completion"), _mask(F.col("r")).alias("rejected_mask"))


def pairs_of(whole: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected of conversations 2k and 2k + 1 (an id that isn't a plain whole number, as a number or as text, has no neighbour and makes no pair): each is chosen once. It parts at one of its assistant turns, which its id tells; the rejected side goes on with the neighbour's turns from that assistant turn on (its last one, if it has fewer)."""
    places = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    number = F.col("conv_id").cast("string").try_cast("bigint")
    plain = F.when(number.cast("string") == F.col("conv_id").cast("string"), number)
    one = whole.select(plain.alias("id"), "conv_id", "turns", places.alias("places")).where("id is not null")
    # two conversations at most
    both = one.groupBy(F.shiftright("id", 1).alias("k")).agg(F.sort_array(F.collect_list(F.struct("id", "conv_id", "turns", "places"))).alias("sides")).where(F.size("sides") == 2)
    turned = F.array(*(F.struct(F.col("sides")[i].alias("own"), F.col("sides")[1 - i].alias("other")) for i in (0, 1)))
    side = both.select(F.inline(turned)).where((F.size("own.places") > 0) & (F.size("other.places") > 0))
    nth = F.pmod(F.shiftright("own.id", 1), F.size("own.places")).cast("int")
    side = side.withColumn("at", F.col("own.places")[nth]).withColumn("on", F.col("other.places")[F.least(nth, F.size("other.places") - 1)])
    rejected = F.concat(F.slice("own.turns", 1, F.col("at") - 1), F.slice("other.turns", F.col("on"), F.size("other.turns")))
    pairs = side.select(F.col("own.conv_id").alias("pair_id"), F.col("own.turns").alias("chosen"), rejected.alias("rejected"))
    return pairs.where(F.col("chosen") != F.col("rejected"))


def op6_preference_format(spark, sf_dir: str) -> DataFrame:
    rows = format_pairs(pairs_of(conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["train"].cast("int").cast("string"))), ",")
    return rows.select(F.col("pair_id").alias("conv_id"), "n_shared", "prompt", "chosen_completion", written("chosen_mask").alias("chosen_mask"), "rejected_completion", written("rejected_mask").alias("rejected_mask"))
