"""Quotation linking: conversations in reply order, without their quotes.

A line that starts with ``>`` marks is quoted, as deep as it has marks.  Runs
of lines of one depth are passages.  Lines are normalised (marks off, blanks
squeezed, A-Z in lower case, empty lines out); a passage is hashed as a whole
and line by line.  Messages offer the hashes of their own whole text and of
their own lines, single and in twos.  In the passage's own conversation a hash
names the earliest message that has it and the last one before the quote, or
else the least other conversation's earliest, so a line which very many
messages share stays one row and a join never multiplies.  Each named message
is weighed by all lines of the passage that it holds (a whole passage
outweighs its lines).  The original is the one with most, then the earliest,
of the same conversation, or else of any other, among all messages and not
only the named ones: what may weigh as much as the best of these must hold one
of the passage's rarer hashes, those that are left when its commonest ones, of
less weight together than that best, are put aside; all messages that hold one
are weighed as well.  Messages that hold the same of all that is quoted weigh
alike, so the earliest of a conversation stands for them, and for quotes of
other conversations that of the two least conversations.
A message replies to the original of its first passage of depth
one that lies in the same conversation; a thread begins at a message that
replies to none.  Messages are ordered by the turn at which their thread
begins, then by turn; a line like "... wrote:" directly above a quote is left
out together with it.

Everything is DataFrame functions.  Numbering goes by ranges of the whole
order, so a conversation with a third of all messages is dealt over all tasks.

Defined results: null texts have no lines; a null conv_id is a conversation of
its own, a null turn stands before all others; repeated rows are kept, each
with its own place, and hits are counted for both; texts of any length are
read whole; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = r"^[ \t]*>[> \t]*+"
#: The tag of a line: its depth between two control characters that are taken out of texts first.
TAG = "\x01\\d+\x02"
#: Stands for a null turn, before all others.
NO_TURN = -(1 << 62)
RUN = "\x01(\\d+)\x02[^\x01]*+(?:\x01\\1\x02[^\x01]*+)*+"


def _norm(line: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(line, r"[ \t\r\f\x0B]+", " ")), UPPER, LOWER)


def _whole(lines: Column) -> Column:
    return F.md5(F.array_join(lines, "\n").cast("binary"))


def parse(messages: DataFrame) -> DataFrame:
    """Adds ``uid`` (hash of the row), ``own`` and ``own_norm`` lines, ``clean_text`` and ``passages`` (no, depth, lines)."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\x01\x02", "")
    lines = F.when(F.length("plain") > 0, F.split("plain", "\n", -1)).otherwise(F.array().cast("array<string>"))
    depth = lambda x: F.length(F.translate(F.regexp_extract(x, MARKS, 0), " \t", ""))
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("plain"))
    messages = messages.withColumn("uid", F.xxhash64("role", "plain")).withColumn("lines", lines)
    messages = messages.withColumn("depths", F.transform("lines", depth))
    here = lambda i: F.element_at("depths", i + 1)
    attribution = lambda x, i: F.rtrim(x).endswith("wrote:") & (i + 1 < F.size("depths")) & (F.coalesce(F.try_element_at("depths", (i + 2).cast("int")), F.lit(0)) > 0)
    messages = messages.withColumn("own", F.filter("lines", lambda x, i: (here(i) == 0) & ~attribution(x, i)))
    messages = messages.withColumn("own_norm", F.filter(F.transform("own", _norm), lambda x: x != ""))
    tagged = F.array_join(F.transform("lines", lambda x, i: F.concat(F.lit("\x01"), here(i).cast("string"), F.lit("\x02"), _norm(F.regexp_replace(x, MARKS, "")))), "")
    runs = F.when(F.exists("depths", lambda d: d > 0), F.regexp_extract_all(tagged, F.lit(RUN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    passages = F.transform(runs, lambda r, i: F.struct(i.alias("no"), F.regexp_extract(r, "\x01(\\d+)", 1).cast("int").alias("depth"), F.filter(F.split(r, TAG), lambda x: x != "").alias("lines")))
    return messages.withColumn("passages", F.filter(passages, lambda p: (p["depth"] > 0) & (F.size(p["lines"]) > 0))).withColumn("clean_text", F.trim(F.array_join("own", "\n"), F.lit(" \n\t\r"))).drop("plain")


def _hashes(lines: Column) -> tuple[Column, Column]:
    """Of single lines and of two lines in a row."""
    pairs = F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit("\n"), F.element_at(lines, i + 2)))
    return F.transform(lines, lambda x: F.md5(x.cast("binary"))), F.transform(pairs, lambda x: F.md5(F.concat(F.lit("\x01"), x).cast("binary")))


def _weighed(named: DataFrame, quoted: DataFrame, offers: DataFrame, passage: list[str]) -> DataFrame:
    """Each named message with all that it holds of the passage."""
    held = _side(named, quoted, passage, "inner").join(offers.select(F.col("conv_id").alias("c"), "at", F.col("hash").alias("h")), (F.col("hash") == F.col("h")) & F.col("source_conv").eqNullSafe(F.col("c")) & (F.col("source_at") == F.col("at")))
    return held.groupBy(*passage, "out", "source_conv", "source_at").agg(F.sum("weight").alias("votes"))


def _further(votes: DataFrame, named: DataFrame, quoted: DataFrame, offers: DataFrame, passage: list[str]) -> DataFrame:
    """All messages besides the named ones that may weigh as much as the best of these, but for later ones that hold the same."""
    marks = [F.sum(F.xxhash64(F.lit(seed), "hash").cast("decimal(38,0)")).alias(f"set{seed}") for seed in (1, 2)]
    kinds = ["set1", "set2"]
    firsts = offers.groupBy("conv_id", "at").agg(*marks).groupBy(*kinds, "conv_id").agg(F.min("at").alias("at"))
    firsts = materialize(firsts, "quotes-kinds")
    least = materialize(firsts.groupBy(*kinds).agg(F.min(F.struct("conv_id", "at")).alias("l")), "quotes-least-kinds")
    other = firsts.join(least, kinds).where(~F.col("conv_id").eqNullSafe(F.col("l.conv_id"))).groupBy(*kinds).agg(F.min(F.struct("conv_id", "at")).alias("l"))
    here = materialize(_side(offers, firsts.select("conv_id", "at"), ["conv_id", "at"], "left_semi"), "quotes-here")
    there = materialize(_side(offers, least.unionByName(other).select("l.conv_id", "l.at"), ["conv_id", "at"], "left_semi"), "quotes-there")
    # The commonest hashes that together weigh less than the best are put aside; two lines in a row weigh nothing themselves.
    bound = votes.groupBy(*passage, "out").agg(F.max("votes").alias("bound"))
    common = Window.partitionBy(*passage).orderBy(F.desc("n"), "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = _side(quoted.where("weight > 0").join(here.groupBy("hash").agg(F.count("*").alias("n")), "hash"), bound, passage, "inner")
    rare = materialize(ranked.withColumn("so_far", F.sum("weight").over(common)).where("so_far >= bound").select(*passage, "out", "hash"), "quotes-rare")
    source = lambda rows: rows.select(F.col("conv_id").alias("source_conv"), F.col("at").alias("source_at"), F.col("hash").alias("h"))
    same, own = F.col("hash") == F.col("h"), F.col("conv_id").eqNullSafe(F.col("source_conv"))
    inside = rare.where("out = 0").join(source(here), same & own & (F.col("source_at") < F.coalesce("turn", F.lit(NO_TURN))))
    outside = rare.where("out = 1").join(source(there), same & ~own)
    found = inside.unionByName(outside).drop("hash", "h").distinct()
    return _without(found, named, [*passage, "out", "source_conv", "source_at"]).select(*named.columns)


def _sources(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages (one row each) and what they quote: ``conv_id, turn, uid, no, depth, source_conv, source_turn``."""
    lines, pairs = _hashes(F.col("p.lines"))
    weighed = lambda hashes, w: F.transform(hashes, lambda h: F.struct(h.alias("hash"), w.alias("weight")))
    units = F.concat(weighed(lines, F.lit(1)), weighed(pairs, F.lit(0)), weighed(F.array(_whole(F.col("p.lines"))), F.size("p.lines") + 1))
    quoted = parsed.select("conv_id", "turn", "uid", F.explode("passages").alias("p"))
    quoted = quoted.select("conv_id", "turn", "uid", F.col("p.no").alias("no"), F.col("p.depth").alias("depth"), F.explode(units).alias("u")).select("conv_id", "turn", "uid", "no", "depth", "u.*")
    passage = ["conv_id", "turn", "uid", "no", "depth"]
    # Rows that are repeated whole have the same passages and weigh all messages alike.
    quoted = materialize(quoted.groupBy(*passage, "hash").agg(F.sum("weight").alias("weight")), "quotes-units")
    lines, pairs = _hashes(F.col("own_norm"))
    offers = parsed.where(F.size("own_norm") > 0).select("conv_id", F.coalesce("turn", F.lit(NO_TURN)).alias("at"), F.explode(F.array_distinct(F.concat(lines, pairs, F.array(_whole(F.col("own_norm")))))).alias("hash"))
    offers = materialize(offers.join(quoted.select("hash").distinct(), "hash", "left_semi").distinct(), "quotes-offers")
    first = materialize(offers.groupBy("conv_id", "hash").agg(F.min("at").alias("first")), "quotes-first")
    # The two least conversations of each hash: one of them is another one, whichever asks.
    least = materialize(first.groupBy("hash").agg(F.min(F.struct("conv_id", "first")).alias("any")), "quotes-least")
    second = first.join(least, "hash").where(~F.col("conv_id").eqNullSafe(F.col("any.conv_id"))).groupBy("hash").agg(F.min(F.struct("conv_id", "first")).alias("next"))
    anywhere = materialize(least.join(second, "hash", "left"), "quotes-anywhere")
    # In the own conversation the earliest message and the last one before the quote.
    asks = quoted.select("hash", "conv_id", F.coalesce("turn", F.lit(NO_TURN)).alias("at")).distinct()
    before = Window.partitionBy("hash", "conv_id").orderBy("at", "offer").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = asks.withColumn("offer", F.lit(0)).unionByName(offers.select("hash", "conv_id", "at").withColumn("offer", F.lit(1)))
    offered = F.when(F.col("offer") == 1, F.col("at"))
    seen = seen.withColumns({"earliest": F.min(offered).over(before), "nearest": F.max(offered).over(before)}).where("offer = 0 and earliest is not null")
    seen = materialize(seen.select(F.col("hash").alias("h"), F.col("conv_id").alias("c"), F.col("at").alias("asked"), "earliest", "nearest"), "quotes-before")
    same = (F.col("hash") == F.col("h")) & F.col("conv_id").eqNullSafe(F.col("c")) & (F.coalesce("turn", F.lit(NO_TURN)) == F.col("asked"))
    inside = quoted.join(seen, same).select(*passage, F.lit(0).alias("out"), F.col("conv_id").alias("source_conv"), F.explode(F.array("earliest", "nearest")).alias("source_at")).distinct()
    outside = F.when(~F.col("any.conv_id").eqNullSafe(F.col("conv_id")), F.col("any")).otherwise(F.col("next"))
    outside = quoted.join(anywhere, "hash").withColumn("other", outside).where("other is not null").select(*passage, F.lit(1).alias("out"), F.col("other.conv_id").alias("source_conv"), F.col("other.first").alias("source_at")).distinct()
    outside = _without(outside, inside, passage)
    named = materialize(inside.unionByName(outside), "quotes-named")
    votes = materialize(_weighed(named, quoted, offers, passage), "quotes-votes")
    further = materialize(_further(votes, named, quoted, offers, passage), "quotes-further")
    votes = votes.unionByName(_weighed(further, quoted, offers, passage))
    best = F.min(F.struct((-F.col("votes")).alias("less"), "source_conv", "source_at", "out")).alias("best")
    turn = F.when(F.col("best.source_at") != NO_TURN, F.col("best.source_at")).alias("source_turn")
    return quoted, votes.groupBy(*passage).agg(best).select(*passage, F.col("best.out").alias("out"), F.col("best.source_conv").alias("source_conv"), turn)


def _roots(replies: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(conv_id, turn, root_turn)`` for replies(conv_id, turn, parent_turn) by pointer doubling."""
    now = replies.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"))
    for _ in range(max_rounds):
        up = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("at"), F.col("root_turn").alias("further"))
        both = now.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("root_turn").eqNullSafe(F.col("at")), "left")
        now = materialize(both.select("conv_id", "turn", F.when(F.col("at").isNotNull(), F.col("further")).otherwise(F.col("root_turn")).alias("root_turn"), F.col("at").isNotNull().alias("moved")), "quotes-roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")
    raise RuntimeError("replies form no forest")


def _numbered(rows: DataFrame, order: list) -> DataFrame:
    """Adds ``position``, from 0 in each conv_id; by ranges of the whole order."""
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mark", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("part", F.shiftright("mark", 33)).withColumn("index", F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))).drop("mark"), "quotes-order")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    # As many rows as the shuffle has partitions.
    placed = rows.join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("index")).drop("before", "index", "part")
    firsts = materialize(placed.groupBy("conv_id").agg(F.min("place").alias("least")).withColumnRenamed("conv_id", "c"), "quotes-firsts")
    return placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("position", F.col("place") - F.col("least")).drop("c", "place", "least")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: its place in its conversation, what it replies to, and its text without quotes."""
    parsed = parse(messages)
    _, found = _sources(parsed)
    sources = materialize(found, "quotes-sources")
    inside = sources.where("out = 0")
    parents = inside.where("depth = 1").groupBy("conv_id", "turn", "uid").agg(F.min(F.struct("no", "source_turn")).alias("p")).select("conv_id", "turn", "uid", F.col("p.source_turn").alias("parent_turn"))
    parents = materialize(parents, "quotes-parents")
    # Of rows that share a turn, the earliest parent stands for the turn in threads.
    roots = _roots(parents.groupBy("conv_id", "turn").agg(F.min(F.struct("parent_turn")).alias("p")).select("conv_id", "turn", F.col("p.parent_turn").alias("parent_turn")))
    linked = sources.groupBy("conv_id", "turn", "uid").agg(F.count("*").alias("n_linked"), F.count_if(F.col("out") == 1).alias("n_other_conv"))
    facts = _side(linked, parents, ["conv_id", "turn", "uid"])
    facts = _side(facts, roots, ["conv_id", "turn"])
    rows = parsed.select("conv_id", "turn", "role", "uid", "clean_text", F.size("passages").cast("long").alias("n_passages"), F.coalesce(F.array_max(F.transform("passages", lambda p: p["depth"])), F.lit(0)).cast("long").alias("max_depth"))
    rows = _side(rows, materialize(facts, "quotes-facts"), ["conv_id", "turn", "uid"])
    rows = rows.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0)), "n_other_conv": F.coalesce("n_other_conv", F.lit(0)), "root_turn": F.when(F.col("parent_turn").isNull(), F.col("turn")).otherwise(F.col("root_turn"))})
    order = [F.col("conv_id").asc_nulls_first(), F.col("root_turn").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("uid")]
    return _numbered(materialize(rows, "quotes-rows"), order).drop("uid")


def _without(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of left that have no keys of right; keys may be null."""
    return _side(left, right.select(*keys).distinct(), keys, "left_anti")


def _side(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join on keys that may be null."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(named, same, how).drop(*[f"_{k}" for k in keys])
