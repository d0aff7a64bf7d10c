"""Personal data in texts: fixed patterns, and identifiers found by the words around them.

Four patterns give the seeds.  What stands before a seed becomes a lexical
pattern, and identifier-shaped strings that no fixed pattern claims become
candidates.  Patterns and instances form a bipartite graph with the numbers of
meetings as weights: a pattern is as trustworthy as the instances it meets, an
instance as the patterns it is met with less a small escape, seeds staying
certain.  Strings met mostly behind trusted patterns join the seeds.  Rounds go on
until no score moves any more, so the fixed point decides, not their number.

Everything is built-in functions.  A regular expression yields its matches and,
by splitting, the text between them; adding up lengths gives the positions in
code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from edgetables.functions.ids import big, int_div
from edgetables.llm.common import Folder

KINDS = ["email", "ip", "card", "phone"]

# The patterns asked for.  Loops that cannot end otherwise are possessive, so that long runs need no stack, and a
# match does not start inside a run of which an earlier character would have started it; \G allows the rest of a run
# that a match has ended in.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Stands for every character of a span while candidates are sought; for private use, so no text needs it.
TAKEN = "\ue000"
_JOINED = r"[._#+/@-]*+[\p{L}\p{N}@\x{E000}]"  # the token goes on
#: Shapes wider than the patterns, tried in this order: a word at a word; digits with blanks, brackets, dots and
#: dashes between them; a run of letters, digits and marks that holds a digit.
CANDIDATE = (
    r"(?<![\p{L}\p{N}._%+#/@\x{E000}-])(?:"
    r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}.-]*[\p{L}\p{N}](?![\p{L}\p{N}@\x{E000}])|"
    r"(?:\+?\x20?\((?=[\x20+0-9]++\)[\x20\xA0./-]*+[0-9])\x20?\+?|\+\x20?)?"
    r"[0-9]++(?:[\x20\xA0()./\x{2010}-\x{2015}-]++[0-9]++(?![._#+/@-]*+[\p{L}@\x{E000}]))*+(?!" + _JOINED + r")|"
    r"[\p{L}@._+#/-]*+[0-9](?:[._#+/@-]*+[\p{L}\p{N}])*+(?![@._+#/-]*+\x{E000}))"
)
LEAST_CANDIDATE = 6
CONTEXT_CHARS = 60
BLOCK = 4096  # code points; texts are cut into blocks, lists of matches into groups, so that the work
GROUP = 256  # on a text grows with its length and its matches, not with their product
LEFT_WORDS = r"(\S+\s+)?\S*\s*$"  # the last two words before, with what touches the string

ESCAPE = 0.05  # lost of a trust that goes over to an instance and back; what keeps a few chance seeds from spreading
MOVED = 0.001  # a score that moves less has come to rest
LEAST_SUPPORT = 3  # different trusted instances behind a pattern
TRUST = 0.9
FOUND = "array<struct<start:bigint,kind:int,end:bigint,before:string,value:string>>"


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total, i):
        digit = turned.substr(i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":

        def small(part):
            number = F.regexp_replace(part, "^0+", "")
            return (F.length(number) < 3) | ((F.length(number) == 3) & (number <= "255"))

        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks_of(text: Column) -> Column:
    """The text in pieces of ``BLOCK`` code points, so that no place in it is sought from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` of the text that was cut into ``blocks``."""
    first, last = int_div(start, big(BLOCK)), int_div(end - 1, big(BLOCK))
    joined = F.array_join(F.slice(blocks, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
    inside = joined.substr((start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))
    return F.when(end > start, inside).otherwise("")


def in_groups(items: Column, after, made) -> Column:
    """``made(group, at)`` for each group of ``GROUP`` items, where ``at`` is ``after`` of all groups before.

    An array that is appended to is copied each time; groups keep that short.
    """

    def fold(groups):
        nothing = F.struct(big(0).alias("at"), F.array().cast("array<bigint>").alias("ats"))
        carried = F.aggregate(
            groups,
            nothing,
            lambda held, group: F.struct(
                after(held["at"], group).alias("at"), F.concat(held["ats"], F.array(held["at"])).alias("ats")
            ),
            lambda held: held["ats"],
        )
        return F.zip_with(groups, carried, made)

    def cut(every):
        starts = F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), F.lit(GROUP))
        return let(F.transform(starts, lambda start: F.slice(every, start, GROUP)), fold)

    return let(items, cut)


def matches(text: Column, pattern: str, kind: int, blocks: Column) -> Column:
    """All matches in order: ``start, kind, end, before, value``, with the words before them.

    The words are those of the text that was cut into ``blocks``, which is as long as ``text``.
    """
    between = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")),
    )

    def place(so_far, one):
        start = so_far["at"] + one["gap"]
        end = start + F.length(one["value"])
        left = piece(blocks, F.greatest(start - CONTEXT_CHARS, big(0)), start)
        before = F.trim(F.regexp_replace(F.lower(F.regexp_extract(left, LEFT_WORDS, 0)), r"\s+", " "))
        found = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), before.alias("before"), one["value"].alias("value")
        )
        return F.struct(end.alias("at"), F.concat(so_far["found"], F.array(found)).alias("found"))

    def after(at, group):
        return F.aggregate(group, at, lambda so_far, one: so_far + one["gap"] + F.length(one["value"]))

    def placed(group, at):
        nothing = F.struct(at.alias("at"), F.array().cast(FOUND).alias("found"))
        return F.aggregate(group, nothing, place, lambda held: held["found"])

    return F.flatten(in_groups(F.filter(between, lambda one: one["value"].isNotNull()), after, placed))


def base_spans(text: Column, blocks: Column) -> Column:
    """The valid matches of the four patterns, by start and kind."""
    needed = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike("[0-9]"),
        "phone": F.contains(text, F.lit("+")),
    }
    none = F.array().cast(FOUND)
    found = [
        F.when(
            needed[kind],
            F.filter(matches(text, PATTERNS[kind], k, blocks), lambda one: valid(kind, one["value"])),
        ).otherwise(none)
        for k, kind in enumerate(KINDS)
    ]
    return F.array_sort(F.concat(*found))


def replaced(text: Column, blocks: Column, spans: Column, gap_and_new) -> Column:
    """``text`` with ``gap_and_new(at, span)`` in place of each span and what lies between it and ``at``, the end of those before."""

    def cut(so_far, span):
        return F.struct(
            F.greatest(so_far["at"], span["end"]).alias("at"),
            F.concat(so_far["parts"], F.array(gap_and_new(so_far["at"], span))).alias("parts"),
        )

    def after(at, group):
        return F.aggregate(group, at, lambda so_far, span: F.greatest(so_far, span["end"]))

    def made(group, at):
        nothing = F.struct(at.alias("at"), F.array().cast("array<string>").alias("parts"))
        return F.aggregate(group, nothing, cut, lambda held: F.array_join(held["parts"], ""))

    end = F.array_max(F.transform(spans, lambda span: span["end"]))
    rest = piece(blocks, end, F.length(text).cast("bigint"))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(in_groups(spans, after, made), ""), rest)).otherwise(text)


def masked(text: Column, blocks: Column, spans: Column) -> Column:
    """``text`` with every character of a span replaced by ``TAKEN``."""

    def taken(at, span):
        start = F.greatest(at, span["start"])
        return F.concat(piece(blocks, at, start), F.repeat(F.lit(TAKEN), F.greatest(span["end"] - start, big(0)).cast("int")))

    return replaced(text, blocks, spans, taken)


def candidates(left: Column, blocks: Column) -> Column:
    """Identifier-shaped strings of ``left``, the text of ``blocks`` without its spans."""
    found = F.when(left.rlike("[0-9@]"), matches(left, CANDIDATE, -1, blocks)).otherwise(F.array().cast(FOUND))
    return F.filter(found, lambda one: (F.length(one["value"]) >= LEAST_CANDIDATE) | F.contains(one["value"], F.lit("@")))


def trusted_patterns(strings: DataFrame, folder: Folder) -> DataFrame:
    """``(before, kind)``: patterns behind which strings are taken for personal data of a kind.

    ``strings (before, value, kind)`` are all seeds and candidates, a negative
    kind marking candidates.
    """
    kinds = range(len(KINDS))
    met = (
        strings.filter(F.col("before").rlike(r"(?s)\p{L}.*\p{L}"))
        .groupBy("before", F.xxhash64("value").alias("instance"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"))
    )
    met = folder.store(met, "met")
    # A string is of one kind wherever it stands, a seed if it is one anywhere.
    totals = met.groupBy("instance").agg(F.sum("n").alias("total"), F.max("kind").alias("kind"))
    scores, sums = [f"score_{k}" for k in kinds], [f"sum_{k}" for k in kinds]
    nothing = [F.lit(0.0).alias(c) for c in (*scores, *sums)]
    met = folder.store(met.drop("kind").join(totals, "instance").select("before", "instance", "n", "total", "kind", *nothing), "met-0")
    open_, turn = F.col("kind") < 0, 0
    while True:
        # score = (trusted + from other patterns + score * what comes back to it from open instances) / n, solved for score
        back = F.when(open_, F.col("n") * F.col("n") / F.col("total") / (1 + ESCAPE)).otherwise(0.0)
        parts = [F.sum("n").alias("n"), F.sum(back).alias("back")]
        for k in kinds:
            elsewhere = F.col(sums[k]) - F.col("n") * F.col(scores[k])
            others = elsewhere / F.col("total") / (1 + ESCAPE)
            supports = (2 * F.col(sums[k]) >= F.col("total")) | ((elsewhere > 0) & (2 * elsewhere >= F.col("total") - F.col("n")))
            parts += [
                F.sum(F.col("n") * F.when(open_, others).otherwise((F.col("kind") == k).cast("double"))).alias(f"given_{k}"),
                F.count_if((F.col("kind") == k) | (open_ & supports)).alias(f"support_{k}"),
                F.max(scores[k]).alias(f"old_{k}"),
            ]
        now = [
            F.when(F.col(f"support_{k}") >= LEAST_SUPPORT, F.col(f"given_{k}") / (F.col("n") - F.col("back"))).otherwise(0.0)
            for k in kinds
        ]
        patterns = met.groupBy("before").agg(*parts).select("before", *[f"old_{k}" for k in kinds], *[c.alias(s) for c, s in zip(now, scores)])
        patterns = folder.store(patterns.filter(F.greatest(*scores) > 0), f"patterns-{turn}")
        if patterns.filter(F.greatest(*[F.abs(F.col(s) - F.col(f"old_{k}")) for k, s in enumerate(scores)]) > MOVED).isEmpty():
            break
        scored = met.drop(*scores, *sums).join(patterns.select("before", *scores), "before", "left").fillna(0.0, scores)
        weight = [F.sum(F.col("n") * F.col(s)).alias(c) for s, c in zip(scores, sums)]
        sure = [F.sum(F.when(F.col(s) >= TRUST, F.col("n")).otherwise(0)).alias(f"sure_{k}") for k, s in enumerate(scores)]
        instances = scored.filter(open_).groupBy("instance").agg(*weight, *sure).filter(F.greatest(*sums) > 0)
        scored = scored.join(instances, "instance", "left").fillna(0.0, sums)
        most = F.greatest(*[f"sure_{k}" for k in kinds])
        joins = F.coalesce(*[F.when(F.col(f"sure_{k}") == most, F.lit(k)) for k in kinds])
        kind = F.when(open_ & (most > 0) & (2 * most >= F.col("total")), joins).otherwise(F.col("kind"))
        turn += 1
        met = folder.store(scored.select("before", "instance", "n", "total", kind.alias("kind"), *scores, *sums), f"met-{turn}")
        folder.drop(f"met-{turn - 1}")
        folder.drop(f"patterns-{turn - 1}")
    best = F.greatest(*scores)
    kind = F.coalesce(*[F.when(F.col(c) == best, F.lit(k)) for k, c in enumerate(scores)])
    return patterns.filter(best >= TRUST).select("before", kind.alias("kind"))


def find(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` of ``docs`` (all by default) with ``base`` and ``spans``: arrays of ``(start, kind, end)`` in code points, end exclusive.

    ``base`` holds what the four patterns find; ``spans`` holds that and the strings
    found by context, whose kinds count on after the four (4 is a string like an email).

    A null text counts as empty and gives empty arrays.  Rows that repeat are
    looked at one by one; equal strings at one place, ties, come in the order of
    the kinds.  An empty table gives an empty table.  Columns named ``base`` or
    ``spans`` are replaced, those that begin with an underscore left out.
    """
    folder = Folder(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in columns or docs.columns if c not in ("base", "spans") and c[0] != "_"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(*others, F.monotonically_increasing_id().alias("_row"), text.alias("_text"))
    found = found.withColumn("_blocks", blocks_of(F.col("_text")))
    found = found.withColumn("_base", base_spans(F.col("_text"), F.col("_blocks")))
    found = found.withColumn("_left", masked(F.col("_text"), F.col("_blocks"), F.col("_base")))
    found = found.withColumn("_open", candidates(F.col("_left"), F.col("_blocks"))).drop("_text", "_left", "_blocks")
    found = folder.store(found, "found")
    strings = found.select(F.explode(F.concat("_base", "_open")).alias("one")).select("one.before", "one.value", "one.kind")
    trusted = trusted_patterns(strings, folder)
    more = (
        found.filter(F.size("_open") > 0)
        .select("_row", F.explode("_open").alias("one"))
        .select("_row", "one.start", "one.end", "one.before")
        .join(trusted, "before")
        .groupBy("_row")
        .agg(F.collect_list(F.struct("start", (F.col("kind") + len(KINDS)).alias("kind"), "end")).alias("_more"))
    )
    base = F.transform("_base", lambda one: F.struct(one["start"].alias("start"), one["kind"].alias("kind"), one["end"].alias("end")))
    return (
        found.join(more, "_row", "left")
        .withColumn("base", base)
        .select(*others, "base", F.array_sort(F.concat("base", F.coalesce("_more", F.slice("base", 1, 0)))).alias("spans"))
    )


def span_names(spans: str) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = F.array(*[F.lit(kind) for kind in KINDS], *[F.lit(f"{kind}_context") for kind in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def redact(found: DataFrame) -> DataFrame:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    names = F.array(*[F.lit(f"[{kind.upper()}]") for kind in KINDS * 2])

    def named(at, span):
        fresh = F.concat(piece(F.col("_blocks"), at, span["start"]), F.get(names, span["kind"]))
        return F.when(span["start"] < at, "").otherwise(fresh)

    cut = found.withColumn("_blocks", blocks_of(F.col("text")))
    return cut.withColumn("text", replaced(F.col("text"), F.col("_blocks"), F.col("spans"), named)).drop("_blocks")
