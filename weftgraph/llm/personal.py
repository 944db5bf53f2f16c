"""Personal data: base rules, and candidates that boosted trees choose from.

Base spans come from four patterns and their checks.  Beyond these, high-recall
generators propose overlapping spans of the same kinds: addresses written out
("name at host dot org"), numbers of the internet's sixth version, digit groups
without a plus sign.  Generators read the text with the base spans of their own
kind masked, so no proposal lies in or across one.

Every candidate has a check of its kind (an address ends in letters behind a
dot; octets and hexadecimal groups are well formed; check sums hold; a phone
number has 9 to 15 digits and isn't a date).  A failed check proves a candidate
wrong: those are the negatives, base spans the positives.  The check's own
ingredients are hidden from the trees, which see the rest of the format
(groups, separators, letters, brackets, lengths) and the context (words and
signs before and after).  What passes a check by chance looks like what fails
it in these respects, so the trees tell both apart.

Trees are fitted by gradient boosting to three quarters of the texts (by hash,
so copies stay together).  On the other quarter a threshold is calibrated for
each kind: the least margin above which at least ``PRECISION`` of ``HELD_OUT``
or more labelled candidates are right.  A kind without such a threshold, or
without ``HELD_OUT`` negatives to show for it, selects nothing.  A proposal is
taken if its margin reaches the threshold and it passes its check as well.

Everything that reads rows is DataFrame functions, one narrow pass without a
shuffle.  A pattern marks its matches in one pass; offsets are sums of the
lengths of the parts between, summed in chunks, so that a text with very many
matches takes time in proportion.  For fitting, labelled candidates of all
rows are counted by their features (at most the product of the features'
values), and only these counts reach the driver.

Defined results: null texts count as empty and have no spans; repeated rows
give repeated results; patterns are written so that no text, however long,
is read more than once for a start; columns of the input that clash with new
ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

#: Fixed values, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
# The base patterns; a look behind and possessive repeats only spare restarts inside a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's patterns to be tried at all.
NEEDS = {"email": r"@|[\s(\[](?:at|AT|At)[\s)\]]", "ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]*:", "card": r"[0-9][\x20./-]?[0-9]", "phone": r"\+[0-9]|[0-9][\x20()./-]{0,2}[0-9]"}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+(?:@|[\x20\t]?[(\[](?:at|AT|@)[)\]][\x20\t]?|[\x20\t](?:at|AT)[\x20\t])[A-Za-z0-9-]{1,63}+(?:(?:\.|[\x20\t]?[(\[](?:dot|DOT|\.)[)\]][\x20\t]?|[\x20\t](?:dot|DOT)[\x20\t])[A-Za-z0-9-]{1,63}+){0,8}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,9}+(?:\.[0-9]{1,9}+){3}+|(?:[0-9A-Fa-f]{1,4}+)?(?::{1,2}[0-9A-Fa-f]{1,4}+){2,7}+)(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{2,8}+(?:[\x20./-][0-9]{2,8}+){1,7}+(?![0-9])|(?<![0-9])[0-9]{12,19}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}+\)[\x20-]?|[0-9]{1,4}+[\x20./-])[0-9]{1,4}+(?:[\x20./-][0-9]{2,4}+){1,3}+(?![0-9])",
}
PRECISION, HELD_OUT, TREES, DEPTH, RATE = 0.98, 50, 24, 2, 0.4
OCTETS = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}"
#: Eight groups, or fewer with one gap.  All groups of two digits are clocks and hardware addresses.
HEXADECIMAL = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?!.*::.*::)(?:[0-9A-Fa-f]{1,4})?(?::{1,2}[0-9A-Fa-f]{1,4}){1,6}"
TWO_DIGITS = r"[0-9A-Fa-f]{1,2}(?::[0-9A-Fa-f]{2})+"
DATE = r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}"
#: Words that announce personal data, in a few languages.
CUES = {"email": "mail|contact|kontakt|courriel|correo", "ip": "ip|addr|host|server|from", "card": "card|karte|carte|tarjeta|visa|credit", "phone": "call|phone|tel|mobil|fax|handy|cell"}
#: Elements whose prefix sums are built at once, and characters of a tile of a text.
CHUNK, TILE = 256, 4096


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits."""
    backwards = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    worth = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda total, d: total + d) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    """The contract's check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(f"^{OCTETS}$")
    n = F.length(_digits(match))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), luhn(_digits(match))).otherwise(False)


def _checked(kind: str, match: Column) -> Column:
    """The check of a proposal."""
    if kind == "email":
        return match.rlike(r"(?:\.|dot|DOT|\))[\s]*[A-Za-z]{2,24}$") & match.rlike(r"(?:@|at|AT).*(?:\.|dot|DOT)")
    if kind == "ip":
        return match.rlike(f"^{OCTETS}$") | (match.rlike(f"^(?:{HEXADECIMAL})$") & (match.rlike("::") | match.rlike("^[^:]*(?::[^:]*){7}$")) & ~match.rlike(f"^(?:{TWO_DIGITS})$"))
    if kind == "phone":
        return _valid(kind, match) & ~match.rlike(f"^(?:{DATE})$")
    return _valid(kind, match)


# ---- places of matches -------------------------------------------------------


def _scanned(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``step`` over all values before each; array_append copies, so only short arrays are built."""
    run = lambda first, xs: F.aggregate(xs, F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out")), lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
    pieces = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
    firsts = run(start, F.transform(pieces, lambda p: F.aggregate(p, start, step)))
    return F.flatten(F.zip_with(firsts, pieces, run))


def _sums(values: Column) -> Column:
    """The sum of all values before each."""
    return F.when(F.size(values) <= CHUNK, F.aggregate(values, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])).otherwise(_scanned(values, F.lit(0).cast("bigint"), lambda a, x: a + x))


MATCH = "array<struct<m:string,start:bigint,check:boolean,before:string,after:string>>"


def _parts(text: Column, pattern: str) -> Column:
    """The text up to the first match, and each match behind it followed by a mark and the text up to the next."""
    return F.split(F.regexp_replace(text, f"({pattern})", "\x01$1\x02"), "\x01", -1)


def _matches(docs: DataFrame, parts: str, to: str, check: Callable[[Column], Column]) -> DataFrame:
    """Adds ``to``: the matches with their places, whether ``check`` holds, up to 24 characters before and one after.

    Arrays that a lambda reads by place are columns with several uses: the
    optimizer would put a column used once into the lambda, to be computed again for every element.
    """
    docs = docs.withColumn("_lengths", F.transform(parts, lambda x, i: (F.length(x) - F.when(i > 0, 1).otherwise(0)).cast("bigint")))
    placed = F.zip_with(_sums(F.col("_lengths")), parts, lambda at, x: F.struct(at.alias("start"), F.substring_index(x, "\x02", 1).alias("m"), x.alias("x")))
    rest = lambda x: F.substring(x, F.length(F.substring_index(x, "\x02", 1)) + 2, F.length(x))

    def one(p: Column, i: Column) -> Column:
        last, behind = F.element_at(parts, i), F.substring(rest(p["x"]), F.lit(1), F.lit(1))  # the part before, as element_at counts from 1
        following = F.substring(F.coalesce(F.try_element_at(parts, (i + 2).cast("int")), F.lit("")), F.lit(1), F.lit(1))
        before = F.when(i > 1, F.right(rest(last), F.lit(24))).otherwise(F.right(last, F.lit(24)))
        return F.struct(p["m"].alias("m"), p["start"].alias("start"), check(p["m"]).alias("check"), before.alias("before"), F.when(behind != "", behind).otherwise(following).alias("after"))

    found = F.filter(F.transform(placed, lambda p, i: F.when(i > 0, one(p, i))), lambda x: x.isNotNull())
    return docs.withColumn(to, F.when(F.size(parts) > 1, found).otherwise(F.array().cast(MATCH))).drop("_lengths")


#: Names of the features; all are small whole numbers.
FEATURES = ("kind", "groups", "separator", "digits", "letters", "local", "cue", "before", "after", "paren")


def _features(kind: int, c: Column) -> list[Column]:
    name, m = KINDS[kind], c["m"]
    numeric = name in ("card", "phone")
    n = F.length(_digits(m))
    local = F.length(F.regexp_extract(m, "^([A-Za-z0-9._%+-]*)", 1))
    side = lambda x: F.when(x == "", 0).when(x.rlike(r"^[\s]$"), 1).when(x.rlike(r"^[.,;:!?'\")\]|(\[]$"), 2).when(x.rlike("^[0-9]$"), 3).otherwise(4)
    return [
        F.lit(kind).alias("kind"),
        (F.least(F.size(F.split(m, "[^0-9A-Za-z]+")), F.lit(6)) if numeric else F.lit(0)).alias("groups"),
        (F.when(m.contains(" "), 1).when(m.contains("-"), 2).when(m.contains("."), 3).when(m.contains("/"), 4).otherwise(0) if numeric else F.lit(0)).alias("separator"),
        (F.when(n < 12, 0).when(n < 16, 1).when(n == 16, 2).when(n <= 19, 3).otherwise(4) if name == "card" else F.lit(0)).alias("digits"),
        (m.rlike("[A-Za-z]").cast("int") if name == "ip" else F.lit(0)).alias("letters"),
        (F.when(local < 3, 0).when(local < 6, 1).when(local < 12, 2).otherwise(3) if name == "email" else F.lit(0)).alias("local"),
        F.lower(c["before"]).rlike(CUES[name]).cast("int").alias("cue"),
        side(F.right(c["before"], F.lit(1))).alias("before"),
        side(c["after"]).alias("after"),
        (m.contains("(").cast("int") if name == "phone" else F.lit(0)).alias("paren"),
    ]


# ---- boosted trees -----------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """bias + for each tree, a list of (tests, value); a test is (feature, at most, whether it must hold)."""

    bias: float = 0.0
    leaves: tuple[tuple[tuple[tuple[tuple[str, int, bool], ...], float], ...], ...] = ()
    thresholds: dict[int, float] = field(default_factory=dict)

    def margin(self, row: dict[str, int]) -> float:
        total = self.bias
        for tree in self.leaves:  # in the order of ``column``, so that both are equal to the last bit
            total += next(v for tests, v in tree if all((row[f] <= at) == yes for f, at, yes in tests))
        return total

    def column(self, f: Column) -> Column:
        """The margin as an expression over a struct of features."""
        total = F.lit(self.bias)
        for tree in self.leaves:
            value = F.lit(0.0)
            for tests, v in tree:
                holds = reduce(lambda a, b: a & b, [(f[n] <= at) if yes else (f[n] > at) for n, at, yes in tests], F.lit(True))
                value = F.when(holds, v).otherwise(value)
            total = total + value
        return total


def fit(rows: list[tuple[dict[str, int], int, float]], held: list[tuple[dict[str, int], int, float]] | None = None, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, precision: float = PRECISION, least: float = HELD_OUT) -> Trees:
    """rows: features, label, how often.  Second-order boosting of the logistic loss with exact splits; held: rows for the thresholds."""
    if not any(y for _, y, _ in rows) or all(y for _, y, _ in rows):
        return Trees()
    total = sum(w for *_, w in rows)
    mean = sum(w * y for _, y, w in rows) / total
    bias = math.log(mean / (1 - mean))
    margins, leaves = [bias] * len(rows), []
    cuts = [(f, at) for f in FEATURES for at in sorted({x[f] for x, _, _ in rows})[:-1]]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-max(-30, min(30, m)))) for m in margins]
        grad = [w * (y - q) for (_, y, w), q in zip(rows, p)]
        hess = [w * q * (1 - q) + 1e-9 for (_, _, w), q in zip(rows, p)]
        tree: list[tuple[tuple[tuple[str, int, bool], ...], float]] = []
        stack: list[tuple[tuple, list[int]]] = [((), list(range(len(rows))))]
        while stack:
            tests, inside = stack.pop()
            g, h = sum(grad[i] for i in inside), sum(hess[i] for i in inside)
            best = (1e-6, None, None)
            for f, at in cuts if len(tests) < depth else ():
                low = [i for i in inside if rows[i][0][f] <= at]
                if 0 < len(low) < len(inside):
                    a, b = sum(grad[i] for i in low), sum(hess[i] for i in low)
                    gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = gain, (f, at), set(low)
            if best[1]:
                f, at = best[1]
                stack += [((*tests, (f, at, True)), [i for i in inside if i in best[2]]), ((*tests, (f, at, False)), [i for i in inside if i not in best[2]])]
            else:
                value = rate * g / (h + 1)
                tree.append((tests, value))
                for i in inside:
                    margins[i] += value
        leaves.append(tuple(tree))
    made = Trees(bias, tuple(leaves))
    held = rows if held is None else held
    return replace(made, thresholds={k: t for k in range(len(KINDS)) if (t := _threshold(made, [r for r in held if r[0]["kind"] == k], precision, least)) is not None})


def _threshold(trees: Trees, rows: list[tuple[dict[str, int], int, float]], precision: float, least: float) -> float | None:
    """The least margin, above 0, from which on enough rows are right; None if too few rows show it."""
    if sum(w for _, y, w in rows if not y) < least:
        return None
    found, right, seen = None, 0.0, 0.0
    ranked = sorted(((trees.margin(x), y, w) for x, y, w in rows), reverse=True)
    for i, (m, y, w) in enumerate(ranked):
        right, seen = right + w * y, seen + w
        if (i + 1 == len(ranked) or ranked[i + 1][0] < m) and seen >= least and right >= precision * seen and m > 0:
            found = m
    return found


def measured(trees: Trees, rows: list[tuple[dict[str, int], int, float]]) -> dict[str, tuple[float, float, float, float]]:
    """Of labelled rows by kind: positives, negatives, precision and recall above the threshold (nan without one)."""
    out = {}
    for k, kind in enumerate(KINDS):
        own = [(y, w, trees.margin(x) >= trees.thresholds.get(k, math.inf)) for x, y, w in rows if x["kind"] == k]
        taken, right, all_right = sum(w for _, w, t in own if t), sum(w for y, w, t in own if t and y), sum(w for y, w, _ in own if y)
        out[kind] = all_right, sum(w for y, w, _ in own if not y), right / taken if taken else math.nan, right / all_right if taken and all_right else math.nan
    return out


# ---- on tables ---------------------------------------------------------------


def _candidate(kind: int, c: Column, base: Column) -> Column:
    label = F.when(base, 1).when(~c["check"], 0)
    return F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), (c["start"] + F.length(c["m"])).alias("end"), base.alias("base"), c["check"].alias("check"), label.alias("label"), F.struct(*_features(kind, c)).alias("f"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_base``: the base spans, ``_more``: all candidates with features and labels (null: unknown), ``_part``: 0 for held-out texts."""
    none = F.array().cast("array<string>")
    # Marks are taken out of texts first, a character for a character.
    docs = docs.withColumn("_text", F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "\x01\x02", "\x03\x03"))
    docs = docs.withColumn("_part", F.pmod(F.xxhash64("_text"), F.lit(4)).cast("int"))
    found = []
    for k, kind in enumerate(KINDS):
        docs = docs.withColumn("_parts", F.when(F.col("_text").rlike(NEEDS[kind]), _parts(F.col("_text"), BASE[kind])).otherwise(none))
        docs = _matches(docs, "_parts", f"_b{k}", lambda m: _valid(kind, m)).withColumn(f"_b{k}", F.transform(f"_b{k}", lambda c: _candidate(k, c, c["check"])))
        valid = lambda i: F.element_at(f"_b{k}", i)["base"]  # noqa: E731, B023
        hidden = lambda x: F.concat(F.repeat(F.lit("\x04"), F.length(F.substring_index(x, "\x02", 1))), F.substring(x, F.length(F.substring_index(x, "\x02", 1)) + 2, F.length(x)))
        masked = F.array_join(F.transform("_parts", lambda x, i: F.when(i == 0, x).otherwise(F.when(valid(i), hidden(x)).otherwise(F.translate(x, "\x02", "")))), "")
        docs = docs.withColumn("_masked", masked)
        docs = docs.withColumn("_parts", F.when(F.size("_parts") > 0, _parts(F.col("_masked"), GENERATORS[kind])).otherwise(none))
        docs = _matches(docs, "_parts", f"_g{k}", lambda m: _checked(kind, m)).drop("_masked", "_parts")
        docs = docs.withColumn(f"_g{k}", F.transform(f"_g{k}", lambda c: _candidate(k, c, F.lit(False))))
        found += [f"_b{k}", f"_g{k}"]
    bases = F.filter(F.concat(*(f"_b{k}" for k in range(len(KINDS)))), lambda c: c["base"])
    docs = docs.withColumn("_base", F.transform(bases, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
    return docs.withColumn("_more", F.concat(*found)).drop("_text", *found)


Counts = list[tuple[dict[str, int], int, float]]


def labelled(found: DataFrame) -> tuple[Counts, Counts]:
    """Labelled ``candidates`` of the fitting and of the held-out texts, counted by their features.

    found must be a table: filters on exploded rows would else be pushed into
    the expressions that make them.
    """
    rows = found.select((F.col("_part") == 0).alias("held"), F.explode("_more").alias("c")).where("c.label is not null").groupBy("held", "c.f", "c.label").count().collect()
    parts = [[(r["f"].asDict(), r["label"], float(r["count"])) for r in sorted(rows, key=str) if r["held"] == side] for side in (False, True)]
    return parts[0], parts[1]


def train(found: DataFrame) -> Trees:
    return fit(*labelled(found))


def choose(found: DataFrame, trees: Trees) -> DataFrame:
    """``candidates`` with ``base`` and ``found`` instead: ``array<struct<start, kind, end>>`` in order; found holds base."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    extra = none
    if trees.thresholds:
        limit = lambda c: reduce(lambda rest, k: F.when(c["kind"] == k, trees.thresholds[k]).otherwise(rest), trees.thresholds, F.lit(float("inf")))
        chosen = F.filter("_more", lambda c: ~c["base"] & c["check"] & (trees.column(c["f"]) >= limit(c)))
        extra = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    out = found.withColumn("_extra", F.when(F.size("_more") > 0, extra).otherwise(none))
    return out.drop("base", "found").withColumns({"base": F.array_sort("_base"), "found": F.array_sort(F.concat("_base", "_extra"))}).drop("_base", "_more", "_extra", "_part")


def spans(docs: DataFrame) -> DataFrame:
    """docs with ``base`` and ``found`` by trees fitted to all of them."""
    found = materialize(candidates(docs.drop("base", "found")), "personal-candidates")
    return choose(found, train(found))


def listed(found: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(docs: DataFrame, text: str = "text", found: str = "found") -> DataFrame:
    """docs with ``[KIND]`` in the text for every span of found; spans that overlap are one, named by the first."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    body = F.col(f"`{text}`")
    some = F.size(found) > 0
    ends = F.col("_ends")
    # All ends before a span, and tiles that a cut reads instead of the whole text.
    docs = docs.withColumn("_ends", F.transform(found, lambda s: s["end"]))
    docs = docs.withColumn("_done", F.when(some, _scanned(ends, F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, x)))).withColumn("_tiles", F.when(some, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{TILE}}}"), F.lit(0))))

    def cut(a: Column, b: Column) -> Column:
        tile = lambda x: F.coalesce(F.try_element_at("_tiles", (F.floor(x / TILE) + 1).cast("int")), F.lit(""))
        first, last = F.floor(a / TILE).cast("int"), F.floor(b / TILE).cast("int")
        middle = F.array_join(F.slice("_tiles", first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        apart = F.concat(F.substring(tile(a), (a % TILE + 1).cast("int"), F.lit(TILE)), middle, F.substring(tile(b), F.lit(1), (b % TILE).cast("int")))
        return F.when(first == last, F.substring(tile(a), (a % TILE + 1).cast("int"), (b - a).cast("int"))).otherwise(apart)

    def one(s: Column, i: Column) -> Column:
        done = F.element_at("_done", i + 1)
        return F.when(s["start"] >= done, F.concat(cut(done, s["start"]), F.element_at(names, s["kind"] + 1))).otherwise("")

    clean = F.concat(F.array_join(F.transform(found, one), ""), cut(F.array_max(ends), F.length(body).cast("bigint")))
    return docs.withColumn(text, F.when(some, clean).otherwise(body)).drop("_ends", "_done", "_tiles")
