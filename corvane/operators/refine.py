"""Boundary refinement, joining and merging of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import label_key
from corvane.operators.parsing import boundary_shift, reassignment
from corvane.operators.ranges import coalesce, from_indices, shuffled, to_indices


def _by_idx():
    return Window.partitionBy("doc_id").orderBy("idx")



def owners(groups: DataFrame) -> DataFrame:
    return to_indices(groups.select("doc_id", "gi", "s", "e")).groupBy("doc_id", "idx").agg(F.max("gi").alias("gi"))


def boundaries(owned: DataFrame) -> DataFrame:
    """doc_id, idx, left_gi, right_gi: sentences after which the owner changes."""
    rows = owned.select("doc_id", "idx", F.col("gi").alias("left_gi"), F.lead("gi").over(_by_idx()).alias("right_gi"), F.lead("idx").over(_by_idx()).alias("after"))
    return rows.where("after = idx + 1 and left_gi <> right_gi").drop("after")


def short_candidates(owned: DataFrame, sentences: DataFrame, shortest: int = 40) -> DataFrame:
    """doc_id, idx, from_gi, to_gi, seq: short sentences on either side of a boundary, in the order in which they are asked."""
    sides = boundaries(owned).select("doc_id", F.explode(F.array(
        F.struct("idx", F.col("left_gi").alias("from_gi"), F.col("right_gi").alias("to_gi"), (F.col("idx") * 2).alias("seq")),
        F.struct((F.col("idx") + 1).alias("idx"), F.col("right_gi").alias("from_gi"), F.col("left_gi").alias("to_gi"), (F.col("idx") * 2 + 1).alias("seq")),
    )).alias("c")).select("doc_id", "c.*")
    brief = sentences.where(F.length("text") < shortest).select("doc_id", "idx")
    return shuffled(sides).join(brief, ["doc_id", "idx"], "left_semi")


def reassign_context(asked: DataFrame, owned: DataFrame, sentences: DataFrame, window: int = 3) -> DataFrame:
    """doc_id, seq, text, before, after: each short sentence with up to ``window`` sentences before and after it."""
    rows = sentences.select("doc_id", "idx", "text")
    order = Window.partitionBy("doc_id").orderBy("idx")
    before = F.array_join(F.collect_list("text").over(order.rowsBetween(-window, -1)), "\n")
    after = F.array_join(F.collect_list("text").over(order.rowsBetween(1, window)), "\n")
    around = rows.select("doc_id", "idx", "text", before.alias("before"), after.alias("after"))
    return asked.select("doc_id", "idx", "seq").join(around, ["doc_id", "idx"]).select("doc_id", "seq", "text", "before", "after")


def boundary_context(owned: DataFrame, sentences: DataFrame, window: int = 3) -> DataFrame:
    """doc_id, idx, left_text, right_text: up to ``window`` sentences of each group next to a boundary."""
    order = Window.partitionBy("doc_id", "gi").orderBy("idx")
    runs = shuffled(owned.withColumn("run", F.col("idx") - F.row_number().over(order))).join(sentences.select("doc_id", "idx", "text"), ["doc_id", "idx"])
    # A run's sentences stand together, so the nearest ones are a slice of its ordered texts.
    stretch = runs.groupBy("doc_id", "gi", "run").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("t"))
    left = stretch.select("doc_id", F.col("hi").alias("idx"), F.array_join(F.slice("t", F.greatest(F.size("t") - window + 1, F.lit(1)), F.lit(window)), "\n").alias("left_text"))
    right = stretch.select("doc_id", (F.col("lo") - 1).alias("idx"), F.array_join(F.slice("t", 1, window), "\n").alias("right_text"))
    return boundaries(owned).select("doc_id", "idx").join(shuffled(left), ["doc_id", "idx"]).join(shuffled(right), ["doc_id", "idx"])


def _rebuild(owned: DataFrame, groups: DataFrame) -> DataFrame:
    labels = groups.select("doc_id", "gi", "label").distinct()
    return shuffled(from_indices(owned, "doc_id", "gi")).join(labels, ["doc_id", "gi"]).select("doc_id", "gi", "ri", "label", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


def apply_reassignments(groups: DataFrame, candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Groups after short sentences moved: ``answers`` has (doc_id, seq, answer). The first answer that moves a sentence stands."""
    owned = owners(groups)
    before = owned.select("doc_id", (F.col("idx") + 1).alias("idx"), F.col("gi").alias("before_gi"))
    rows = candidates.join(shuffled(answers), ["doc_id", "seq"]).join(shuffled(before), ["doc_id", "idx"], "left").withColumn("d", reassignment(F.col("answer")))
    to_is_previous = F.coalesce(F.col("before_gi") == F.col("to_gi"), F.lit(False))
    moves = (to_is_previous & (F.col("d") == "previous")) | (~to_is_previous & (F.col("d") == "next"))
    moved = rows.where(moves).groupBy("doc_id", "idx").agg(F.min_by("to_gi", "seq").alias("to_gi"))
    new = owned.join(shuffled(moved), ["doc_id", "idx"], "left").select("doc_id", "idx", F.coalesce("to_gi", "gi").alias("gi"))
    return _rebuild(new, groups)


def apply_shifts(groups: DataFrame, answers: DataFrame, most: int = 2) -> DataFrame:
    """Groups after boundary shifts: ``answers`` has (doc_id, idx, answer) for the boundaries.

    Boundaries are gone through in order over changing owners, one document at
    a time, as a fold over the document's array of owners.
    """
    owned = owners(groups)
    asked = boundaries(owned).join(answers, ["doc_id", "idx"]).withColumn("shift", boundary_shift(F.col("answer"), most)).where("shift <> 0")
    steps = asked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "left_gi", "right_gi", "shift"))).alias("steps"))
    arrays = owned.groupBy("doc_id").agg(F.min("idx").alias("base"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "gi"))), lambda x: x["gi"]).alias("own"))
    rows = arrays.join(steps, "doc_id")

    def step(own, b):
        at = (b["idx"] - F.col("base") + 1).cast("int")  # place of the left sentence, from 1
        n = F.abs(b["shift"]).cast("int")
        run_right = F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: F.forall(F.sequence(F.lit(1), k), lambda j: F.get(own, at + j - 1) == b["right_gi"])))
        run_left = F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: F.forall(F.sequence(F.lit(1), k), lambda j: F.get(own, at - j) == b["left_gi"])))
        right, left = F.least(n, run_right), F.least(n, run_left)
        return F.transform(own, lambda g, i: F.when((b["shift"] > 0) & (i >= at) & (i < at + right), b["left_gi"]).when((b["shift"] < 0) & (i < at) & (i >= at - left), b["right_gi"]).otherwise(g))

    moved = rows.select("doc_id", "base", F.aggregate("steps", F.col("own"), step).alias("own"))
    new = moved.select("doc_id", "base", F.posexplode("own").alias("k", "gi")).select("doc_id", (F.col("base") + F.col("k")).alias("idx"), "gi")
    return _rebuild(new.unionByName(owned.join(steps.select("doc_id"), "doc_id", "left_anti").select("doc_id", "idx", "gi")), groups)


def join_adjacent(groups: DataFrame) -> DataFrame:
    """Neighbouring groups (by gi) with the same label that touch or overlap, joined: doc_id, gi, ri, label, s, e."""
    ends = groups.groupBy("doc_id", "gi", "label").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    order = Window.partitionBy("doc_id").orderBy("gi")
    # Within a stretch of equal labels a group joins if it begins no later than just after all before it in the stretch.
    ends = ends.withColumn("same", F.coalesce(F.lag("label").over(order) == F.col("label"), F.lit(False)))
    ends = ends.withColumn("stretch", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(order))
    inside = Window.partitionBy("doc_id", "stretch").orderBy("gi")
    ends = ends.withColumn("fresh", F.when(F.col("lo") <= F.max("hi").over(inside.rowsBetween(Window.unboundedPreceding, -1)) + 1, 0).otherwise(1))
    ends = ends.withColumn("to_gi", (F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    rows = groups.join(ends.select("doc_id", "gi", "to_gi"), ["doc_id", "gi"])
    labels = rows.groupBy("doc_id", "to_gi").agg(F.min_by("label", "gi").alias("label"))
    joined = coalesce(rows.select("doc_id", "to_gi", "s", "e"), "doc_id", "to_gi")
    return joined.join(labels, ["doc_id", "to_gi"]).select("doc_id", F.col("to_gi").alias("gi"), "ri", "label", "s", "e")


def join_sentences(groups: DataFrame, sentences: DataFrame) -> DataFrame:
    """doc_id, idx, gi, start, end, text: each range as one sentence, numbered in order of groups, then ranges."""
    parts = shuffled(to_indices(groups.select("doc_id", "gi", "s", "e"))).join(sentences, ["doc_id", "idx"])
    out = parts.groupBy("doc_id", "gi", "s", "e").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")).alias("text"),
    )
    order = Window.partitionBy("doc_id").orderBy("gi", "s", "e")
    return out.select("doc_id", (F.row_number().over(order) - 1).cast("int").alias("idx"), "gi", "start", "end", "text")


def merge_similar(groups: DataFrame) -> DataFrame:
    """Groups with the same label key as one, named as first seen, in order of their first sentence."""
    keyed = groups.withColumn("key", label_key(F.col("label")))
    names = keyed.groupBy("doc_id", "key").agg(F.min_by("label", "gi").alias("label"), F.min("s").alias("first"), F.min("gi").alias("old"))
    names = names.withColumn("gi", (F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "old")) - 1).cast("int"))
    return shuffled(coalesce(keyed.select("doc_id", "key", "s", "e"), "doc_id", "key")).join(names, ["doc_id", "key"]).select("doc_id", "gi", "ri", "label", "s", "e")
