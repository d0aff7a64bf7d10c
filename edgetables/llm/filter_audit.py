"""What each of several document filters removes, in every order of applying them.

A document is reduced to a mask of the filters that it fails, and documents with
one mask in one part of the corpus are one cell with its counts.  Every cell folds
across all orders: at each step of an order the failures of the steps before
are added up, and they and the step's own bit say whether the cell is kept,
removed here or removed already.  The outcomes of all orders and steps are one
array of weighted structs, and the arrays of a part's cells are added element by
element.  A part has at most ``2 ** filters`` cells, whatever the size of the
corpus.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from edgetables.llm.common import Folder

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
MARKS = "[#$%&*|]"
LATE_COPY = "E"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text and its words."""
    n_words = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n_words < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n_words,
        "C": 100 * capitals.cast("bigint") > MOST_CAPITALS_PERCENT * F.length(text).cast("bigint"),
        "D": text.rlike(MARKS),
    }


def mask_of(failures: dict[str, Column], filters: str = FILTERS) -> Column:
    """The failures as one number; the first filter is its lowest bit."""
    bits = [F.when(failed, F.lit(1 << filters.index(name))).otherwise(0) for name, failed in failures.items()]
    return reduce(Column.bitwiseOR, bits)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, docs, good, toxic)``: documents by language and by the filters they fail.

    Copies are found without joining them to each other: only the smallest id of
    a text is looked up again, by text and id together.
    """
    folder = Folder(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    ).withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != ""))
    failed = text_failures(F.col("text"), F.col("words"))
    facts = read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_key"), mask_of(failed).alias("mask"))
    facts = facts.groupBy("doc_id", "part", "text_key", "mask").agg(F.count(F.lit(1)).alias("n"))  # repeated rows
    judged = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    facts = folder.store(facts.join(judged, "doc_id", "left"), "facts")
    firsts = facts.filter("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    marked = facts.join(firsts.withColumn("first", F.lit(True)), ["text_key", "doc_id"], "left")
    late = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask").bitwiseOR(mask_of({LATE_COPY: late}))
    return marked.groupBy("part", mask.alias("mask")).agg(
        F.sum("n").alias("docs"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def outcomes(filters: str = FILTERS) -> Column:
    """What becomes of a cell at each step of each order, as one array of structs."""
    mask = F.col("mask")
    all_orders = F.array(*[F.array(*map(F.lit, order)) for order in permutations(range(len(filters)))])

    def failing(position: Column) -> Column:
        return F.getbit(mask, position).cast("int")

    def one_order(order: Column) -> Column:
        name = F.array_join(F.transform(order, lambda position: F.substring(F.lit(filters), position + 1, F.lit(1))), "")

        def one_step(position: Column, step: Column) -> Column:
            failed_before = F.aggregate(F.slice(order, F.lit(1), step), F.lit(0), lambda n, other: n + failing(other))
            here, before = failing(position) == 1, failed_before > 0
            taken = here & ~before

            def weight(condition: Column, column: str) -> Column:
                return F.when(condition, F.col(column)).otherwise(F.lit(0)).cast("bigint")

            return F.struct(
                name.alias("filter_order"),
                (step + 1).alias("step"),
                position.alias("filter"),
                weight(~here & ~before, "docs").alias("kept"),
                weight(taken, "docs").alias("removed"),
                weight(here & before, "docs").alias("redundant"),
                weight(here & (F.bit_count(mask) == 1), "docs").alias("unique_fails"),
                weight(taken, "good").alias("good_lost"),
                weight(taken, "toxic").alias("toxic_lost"),
            )

        return F.transform(order, one_step)

    return F.flatten(F.transform(all_orders, one_order))


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``(part, filter_order, step, kept, ...)`` from cells ``(part, mask, docs, good, toxic)``; one row per part, order and step."""
    folded = counted.select("part", outcomes(filters).alias("steps"))
    gathered = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"))  # one for each mask at most

    def add(one: Column, other: Column) -> Column:
        same = [one[c].alias(c) for c in ("filter_order", "step", "filter")]
        return F.struct(*same, *[(one[c] + other[c]).alias(c) for c in COUNTS])

    sums = F.aggregate(
        F.slice("cells", F.lit(2), F.size("cells")), F.get("cells", F.lit(0)), lambda so_far, cell: F.zip_with(so_far, cell, add)
    )
    summed = gathered.select("part", sums.alias("steps"))

    def share(position: int) -> Column:
        own = F.filter("steps", lambda one: one["filter"] == position)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda total, one: total + one["removed"])

    shares = F.array(*[share(position) for position in range(len(filters))])
    rows = summed.withColumn("shares", shares).select("part", "shares", F.inline("steps"))
    return rows.select("part", "filter_order", "step", *COUNTS, F.get("shares", F.col("filter")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per language, order of the five filters and step, zeros included.

    ``docs (doc_id, text, lang)`` and ``labels (doc_id, quality, toxic)``.  A null
    text counts as empty, a null language as the empty one.  Texts that are equal,
    ties, fail the copy filter but for the smallest id; rows that repeat an id and
    its text are counted each and fail or pass it together; rows without an id
    pass it, have no label and make no other row fail it.  A document with several labels is good or toxic if one of
    them says so.  An empty table of documents gives no rows, an empty one of
    labels no losses.  Further columns are not looked at.
    """
    return interactions(cells(docs, labels))
