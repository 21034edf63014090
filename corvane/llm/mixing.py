"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source has a target number of words. Whole copies of all its documents
that fit the target are certain. What is left is drawn without replacement and
with unequal odds: a document's inclusion probability grows with the number of
binary digits of its size (long documents are likelier, by a bounded factor),
scaled so that the expected words are the words left; documents whose
probability would reach one are set aside as certain. Documents are ranked by
their Pareto variable, random odds over inclusion odds, and taken in that order
until the words run out. Documents that would overshoot are passed over in two
further rounds, in which the words still missing go to the next documents in
the same order that fit them.

A source can hold any share of all rows, so none is ever sorted or shuffled:
the ranking variable is cut into 4096 slices whose words are summed (combined
before the shuffle), and only the one slice of a source in which the words run
out is put in order. What a round decides is one row for each source, a
threshold of the ranking, and the documents are compared with it where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, discard, materialise, small_or_shuffled, unused

SLICES = 4096
ROUNDS = 3
CAP = 2.0
SHARE = 1.5
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(seed: str) -> Column:
    """A number in (0, 1) that depends on the document and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def source_key() -> Column:
    """The source as a key that is never null: no source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def targets(sizes: DataFrame) -> DataFrame:
    """(sk, source_size, target) from (sk, source, source_size), one row per source.

    Water filling: source i gets min(2 * size, level * weight). With sources in
    order of the level at which they fill up, the level is found from running
    sums. Its windows hold one narrow row (about 64 bytes) for each source, in
    one task that can spill: fine for millions of sources, not for billions.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    ranked = ranked.select("sk", "source_size", "rank", weight.alias("weight"), F.col("source_size").cast("double").alias("s"))
    order = Window.orderBy((CAP * F.col("s")) / F.col("weight"), "rank")
    whole = Window.partitionBy(F.lit(1))
    level = ranked.select(
        "sk", "source_size", "weight", "s", F.row_number().over(order).alias("k"),
        (SHARE * F.sum("s").over(whole)).alias("budget"),
        F.coalesce(F.sum(CAP * F.col("s")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    )
    level = level.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    fits = F.when(F.col("level") <= CAP * F.col("s") / F.col("weight"), F.struct("k", "level"))
    level = level.withColumn("found", F.min(fits).over(whole)["level"])
    return level.select("sk", "source_size", F.least(CAP * F.col("s"), F.coalesce("found", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def digits(size: Column) -> Column:
    """The measure of a document: how many binary digits its size has (63 at most)."""
    return F.length(F.bin(size)).cast("long")


def inclusion(goal: DataFrame, classes: DataFrame) -> DataFrame:
    """(sk, scale): what a document's measure is multiplied with to give its inclusion probability (1 at most).

    ``goal`` has (sk, need), ``classes`` (sk, digits, words), at most 63 rows a
    source. The longest classes become certain, one after the other, as long as
    the rest's scale takes them to probability one; then the expected words of
    certain and other documents are the words needed.
    """
    down = Window.partitionBy("sk").orderBy(F.col("digits").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("sk").orderBy(F.col("digits").desc()).rowsBetween(0, Window.unboundedFollowing)
    rows = classes.where("words > 0").join(goal.select("sk", "need"), "sk")
    rows = rows.select("sk", "digits", ((F.col("need") - F.coalesce(F.sum("words").over(down), F.lit(0))) / F.sum(F.col("digits") * F.col("words")).over(rest)).alias("scale"))
    open_classes = rows.where(F.col("scale") * F.col("digits") < 1)
    return open_classes.groupBy("sk").agg(F.max_by("scale", "digits").alias("scale"))


def _pareto() -> Column:
    """The Pareto variable of a row (u, size) beside what its source decides: random odds over inclusion odds."""
    odds = F.col("scale") * digits(F.col("size"))
    odds = F.when(odds < 1, odds / (1.0 - odds)).otherwise(float("inf"))
    return F.when(F.col("need") > 0, (F.col("u") / (1.0 - F.col("u"))) / odds).otherwise(float("inf"))


def _slice(q: Column) -> Column:
    return F.when(q == float("inf"), SLICES).otherwise(F.floor(q / (1.0 + q) * SLICES)).cast("int")


def _ranked(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` (sk, doc_id, u, size) with what their source decides, the Pareto variable q and its slice."""
    return rows.join(goal, "sk").withColumn("q", _pareto()).withColumn("slice", _slice(F.col("q")))


def _taken(rounds: int, q: Column | None = None, slice_: Column | None = None) -> Column:
    """Whether the first rounds take a row: it fits the words missing and lies before the round's threshold."""
    q, slice_ = F.col("q") if q is None else q, F.col("slice") if slice_ is None else slice_
    out = F.lit(False)
    for k in range(rounds):
        before = F.coalesce(slice_ < F.col(f"slice{k}"), F.lit(True))
        at = (slice_ == F.col(f"slice{k}")) & F.coalesce(F.struct(q.alias("q"), "doc_id", "size") <= F.col(f"cut{k}"), F.lit(False))
        out |= (F.col("size") <= F.col(f"need{k}")) & (F.col(f"need{k}") > 0) & (before | at)
    return out


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it and wherever a filter moves it."""
    return F.transform(F.array(value), body)[0]


def plan(docs: DataFrame, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The documents' (sk, doc_id, u, size), and one row for each source: its targets, whole copies and thresholds."""
    sized = materialise(docs.select("doc_id", "source", source_key().alias("sk"), word_count(F.col("text")).alias("size"), uniform(seed).alias("u")), "sized")
    classes = materialise(sized.groupBy("sk", "source", digits(F.col("size")).alias("digits")).agg(F.sum("size").alias("words")), "classes")
    goal = targets(classes.groupBy("sk", "source").agg(F.sum("words").alias("source_size"))).withColumn("s", F.col("source_size").cast("double"))
    goal = goal.withColumn("whole", F.when(F.col("s") > 0, F.floor(F.col("target") / F.col("s"))).otherwise(0.0).cast("long"))
    goal = goal.withColumn("need", F.col("target") - F.col("whole") * F.col("s"))
    goal = materialise(goal.join(inclusion(goal, classes), "sk", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0))), "goal")
    discard(classes)
    rows = sized.drop("source")
    now = goal.withColumn("need0", F.col("need"))
    few = goal.count() <= BROADCAST_ROWS

    def per_source(table: DataFrame) -> DataFrame:
        """A table of one row for each source, as the side of a join."""
        return F.broadcast(table) if few else table.hint("merge")

    for k in range(ROUNDS):
        open_rows = _ranked(rows, per_source(now)).where(~_taken(k) & (F.col("size") <= F.col(f"need{k}")) & (F.col(f"need{k}") > 0))
        slices = open_rows.groupBy("sk", "slice", f"need{k}").agg(F.sum("size").alias("words"))
        order = Window.partitionBy("sk").orderBy("slice")
        slices = slices.withColumn("before", F.sum("words").over(order) - F.col("words"))
        whole = F.sum(F.when(F.col("before") + F.col("words") <= F.col(f"need{k}"), F.col("words")).otherwise(0)).alias("used")
        first = F.min(F.when(F.col("before") + F.col("words") > F.col(f"need{k}"), F.struct("slice", "before"))).alias("at")
        ends = slices.groupBy("sk").agg(whole, first).select("sk", "used", F.col("at.slice").alias(f"slice{k}"), F.col("at.before").alias("before"))
        # The running sum takes rows with equal keys together, so equal rows are taken together or not at all.
        inside = Window.partitionBy("sk").orderBy("q", "doc_id", "size")
        last = open_rows.join(per_source(ends), "sk").where(F.col("slice") == F.col(f"slice{k}"))
        last = last.select("sk", "q", "doc_id", "size", "before", f"need{k}", F.sum("size").over(inside).alias("run")).where(F.col("before") + F.col("run") <= F.col(f"need{k}"))
        cuts = last.groupBy("sk").agg(F.max(F.struct("q", "doc_id", "size")).alias(f"cut{k}"), F.max("run").alias("run"))
        left = F.col(f"need{k}") - (F.coalesce("used", F.lit(0)) + F.coalesce("run", F.lit(0)))
        new = now.join(ends.drop("before"), "sk", "left").join(cuts, "sk", "left").withColumn(f"need{k + 1}", left).drop("used", "run")
        now, old = materialise(new, "goal"), now
        discard(old)
    discard(goal)
    return rows, now


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, u, size, source_size, target, taken: one row for every row of ``docs``.

    ``taken`` is a whole multiple of ``size``: 0, 1 or 2 times. A null text has
    size 0; documents without a source form a source of their own, ordered last;
    equal rows are taken together or not at all; an empty table gives no rows.
    Ties of the ranking variable go by doc_id, then size, nulls first. Other
    columns are not read.
    """
    rows, goal = plan(docs, seed)
    return _ranked(rows, small_or_shuffled(goal)).select("doc_id", "u", "size", "source_size", "target", ((F.col("whole") + _taken(ROUNDS).cast("long")) * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``docs`` with ``copies`` (how often the mix repeats the row); rows that it doesn't take are left out.

    Decided where the rows are, by their source's thresholds: no text is
    shuffled. Rows of size 0 are never taken. Equal rows get equal copies. If
    ``docs`` has a column ``copies`` already, that one is replaced.
    """
    rows, goal = plan(docs, seed)
    discard(rows)
    held = unused("__row", docs)
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias(held), "doc_id", source_key().alias("sk"), word_count(F.col("text")).alias("size"), uniform(seed).alias("u"))
    # Filters move into the join, where the Pareto variable would be written out for each of its uses: a method too long to be compiled.
    taken = _bound(_pareto(), lambda q: _bound(_slice(q), lambda slice_: _taken(ROUNDS, q, slice_)))
    copies = F.when(F.col("size") > 0, F.col("whole") + taken.cast("long")).otherwise(0).cast("int")
    found = keyed.join(small_or_shuffled(goal), "sk").withColumn("copies", copies).where("copies > 0")
    return found.select(*[F.col(held)[c].alias(c) for c in docs.columns if c.lower() != "copies"], "copies")
