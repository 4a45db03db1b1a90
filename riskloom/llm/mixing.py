"""Call transcripts mixed to target weights over a tree of topics, languages and transcription models.

Only DataFrame functions are used, on whole numbers, so that results are the same everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.texts import WORD_CLASS, free_names, only
from riskloom.session import materialize

BETWEEN = WORD_CLASS.replace("^", "").replace("+", "*")
LEVELS = ("main_topics", "detected_language", "transcription_model")


def _share(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """`given` for each node: the parent's `budget` dealt out by `weight`, at most `capacity` each.

    Nodes are taken in the order of capacity per weight. One is full when its fair share of what the
    fuller ones left is at least its capacity; what it cannot take goes to its siblings. Once one is
    not full, none after it is. Rests of the division go one by one to the first in the order.
    """
    order = [F.col("capacity") / F.col("weight"), F.col(name)]
    own = Window.partitionBy(*parents)
    upto = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = own.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    rows = nodes.withColumns({"taken": F.coalesce(F.sum("capacity").over(upto), F.lit(0)), "open": F.sum("weight").over(onward)})
    full = F.col("capacity").cast("decimal(38,0)") * F.col("open") <= (F.col("budget") - F.col("taken")).cast("decimal(38,0)") * F.col("weight")
    rows = rows.withColumn("full", full)
    rows = rows.withColumns({"spent": F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(own),
                             "shared": F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(own)})
    rest = F.col("budget") - F.col("spent")
    rows = rows.withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(
        F.expr("CAST((CAST(budget - spent AS DECIMAL(38,0)) * weight) DIV shared AS BIGINT)")))
    dealt = F.sum(F.when(~F.col("full"), F.col("given")).otherwise(0)).over(own)
    place = F.row_number().over(own.orderBy(F.col("full"), *order))
    rows = rows.withColumns({"rests": rest - dealt, "place": place})
    return rows.withColumn("given", F.when(~F.col("full") & (F.col("place") <= F.col("rests")), F.col("given") + 1)
                           .otherwise(F.col("given"))).drop("taken", "open", "full", "spent", "shared", "rests", "place")


def leaf_budgets(supply: DataFrame, weights: DataFrame | None, budget: Column, epochs: int) -> DataFrame:
    """Supply (the three levels and tokens) with `capacity` = tokens * epochs and `budget` per leaf.

    `weights` has a row per node that departs from weight 1: the three levels, null below the node's
    own level, and a positive whole number. Capacities are summed up the tree and budgets dealt
    down it, so a shortage is made up by siblings first and reaches an ancestor's siblings only
    when a whole subtree is exhausted. The tree has one row per leaf and does not grow with the texts.
    """
    nodes = supply.withColumn("capacity", F.col("tokens") * epochs)
    levels = list(LEVELS)
    budgets = None
    for depth in range(1, len(levels) + 1):
        here, parents = levels[:depth], levels[:depth - 1]
        level = nodes.groupBy(*here).agg(F.sum("capacity").alias("capacity"))
        if weights is None:
            level = level.withColumn("weight", F.lit(1).cast("bigint"))
        else:
            own = weights.filter(" AND ".join([f"{c} IS NOT NULL" for c in here] + [f"{c} IS NULL" for c in levels[depth:]]))
            level = level.join(own.groupBy(*here).agg(F.max("weight").cast("bigint").alias("weight")), here, "left").withColumn(
                "weight", F.coalesce("weight", F.lit(1)))
        if budgets is None:
            level = level.withColumn("budget", F.least(budget.cast("bigint"), F.sum("capacity").over(Window.partitionBy(F.lit(1)))))
        else:
            level = level.join(budgets, parents)
        budgets = _share(level, parents or [F.lit(1)], here[-1]).select(*here, F.col("given").alias("budget"))
    return nodes.join(budgets, levels)


def mix_transcripts(transcripts: DataFrame, weights: DataFrame | None = None, budget: int | None = None,
                    fraction: tuple[int, int] = (1, 2), epochs: int = 2, seed: str = "mix",
                    transcript_id: str = "transcript_id", full_text: str = "full_text", main_topics: str | Column = "main_topics",
                    detected_language: str = "detected_language", transcription_model: str = "transcription_model") -> DataFrame:
    """The chosen passes over transcripts: transcript_id, the three levels, text_key, epoch, tokens, taken.

    Tokens are words between ASCII blanks. The budget is `budget` tokens or the given fraction of
    all tokens, dealt to the leaves by `leaf_budgets`. Each leaf takes whole passes (epochs) over its
    transcripts and then a prefix of one more, in an order seeded by epoch: the md5 of seed, epoch and
    id. The last transcript is taken in part (`taken` < `tokens`). Whole cells of a histogram of
    that order are accepted or refused by running totals of cells, twice by 256; only the cell at the
    edge is ordered row by row, so no leaf is ever sorted as a whole.

    Null and empty texts have no tokens; they are chosen with the whole passes and inside the prefix.
    Null levels count as the empty text. Transcripts with an equal id follow each other in the order
    of their text; equal rows are repeated. An empty table gives an empty result.
    """
    level = main_topics if isinstance(main_topics, Column) else F.col(f"`{main_topics}`")
    text = F.col(f"`{full_text}`")
    base = transcripts.select(
        F.col(f"`{transcript_id}`").alias("transcript_id"), F.coalesce(level.cast("string"), F.lit("")).alias("main_topics"),
        F.coalesce(F.col(f"`{detected_language}`").cast("string"), F.lit("")).alias("detected_language"),
        F.coalesce(F.col(f"`{transcription_model}`").cast("string"), F.lit("")).alias("transcription_model"),
        F.xxhash64(text).alias("text_key"), F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("bigint").alias("tokens"))
    base = materialize(base, "mix-rows")
    levels = list(LEVELS)
    supply = materialize(base.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), "mix-supply")
    if budget is None:
        budget = (supply.agg(F.sum("tokens")).first()[0] or 0) * fraction[0] // fraction[1]
    leaves = materialize(leaf_budgets(supply, weights, F.lit(budget), epochs).select(
        *levels, F.col("tokens").alias("supply"), "budget"), "mix-leaves")

    whole = F.when(F.col("supply") > 0, F.expr("budget DIV supply")).otherwise(0)
    planned = base.join(leaves, levels).withColumn("passes", whole)
    planned = planned.withColumn("rest", F.col("budget") - F.col("passes") * F.col("supply"))
    full = planned.filter("passes > 0").select(
        "transcript_id", *levels, "text_key", F.explode(F.sequence(F.lit(0), (F.col("passes") - 1).cast("int"))).alias("epoch"),
        "tokens", F.col("tokens").alias("taken"))
    drawn = F.md5(F.concat_ws("|", F.lit(seed), F.col("passes").cast("string"), F.col("transcript_id").cast("string")).cast("binary"))
    part = materialize(planned.filter("rest > 0").select(
        "transcript_id", *levels, "text_key", F.col("passes").cast("int").alias("epoch"), "tokens", "rest", drawn.alias("drawn")), "mix-partial")
    return full.unionByName(_prefix(part, levels).select(*full.columns))


def _prefix(part: DataFrame, levels: list[str]) -> DataFrame:
    """The rows of each leaf that begin before its `rest`, in the order of `drawn`."""
    rows, chosen = part.withColumn("start", F.lit(0).cast("bigint")), []
    keys = list(levels)
    for digit in (1, 3):
        cell = f"cell{digit}"
        rows = rows.withColumn(cell, F.substring("drawn", digit, 2))
        sums = rows.groupBy(*keys, cell).agg(F.sum("tokens").alias("held"), F.first("rest").alias("_rest"), F.first("start").alias("_start"))
        before = F.sum("held").over(Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("at", F.col("_start") + F.coalesce(before, F.lit(0))).filter("at < _rest").select(
            *keys, cell, "at", (F.col("at") + F.col("held") < F.col("_rest")).alias("inside"))
        keys = [*keys, cell]
        met = rows.join(sums, keys)
        chosen.append(met.filter("inside").withColumn("taken", F.col("tokens")).select(*part.columns, "taken"))
        rows = met.filter("NOT inside").withColumn("start", F.col("at")).drop("at", "inside")
    upto = Window.partitionBy(*keys).orderBy("drawn", "transcript_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.withColumn("start", F.col("start") + F.coalesce(F.sum("tokens").over(upto), F.lit(0))).filter("start < rest")
    chosen.append(edge.withColumn("taken", F.least("tokens", F.col("rest") - F.col("start"))).select(*part.columns, "taken"))
    return chosen[0].unionByName(chosen[1]).unionByName(chosen[2])


def take_chosen(transcripts: DataFrame, chosen: DataFrame, transcript_id: str = "transcript_id", full_text: str = "full_text",
                main_topics: str | Column = "main_topics", detected_language: str = "detected_language",
                transcription_model: str = "transcription_model") -> DataFrame:
    """The transcripts with all their columns, once for each row of `chosen`, cut after its `taken` tokens.

    So the tokens of each leaf are its budget. Copies of a row are numbered on both sides, and as many
    of them are taken as were chosen in each pass. What is left of a text keeps its blanks.
    """
    level = main_topics if isinstance(main_topics, Column) else F.col(f"`{main_topics}`")
    text = F.col(f"`{full_text}`")
    own = [F.col(f"`{transcript_id}`"), F.xxhash64(text), *[F.coalesce(c.cast("string"), F.lit("")) for c in (
        level, F.col(f"`{detected_language}`"), F.col(f"`{transcription_model}`"))]]
    theirs = [F.col(c) for c in ("transcript_id", "text_key", *LEVELS)]
    copy, number, tokens, taken, *keys = free_names(transcripts, "copy", "number", "tokens", "taken", *[f"key{i}" for i in range(len(theirs))])
    numbered = transcripts.withColumn(copy, F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(1))))
    passes = chosen.withColumn("place", F.row_number().over(Window.partitionBy(*theirs, "epoch").orderBy(F.col("taken").desc()))).select(
        *[c.alias(n) for c, n in zip(theirs, keys)], F.col("place").alias(number), F.col("tokens").alias(tokens), F.col("taken").alias(taken))
    same = (F.col(f"`{copy}`") == F.col(f"`{number}`")) & own[0].eqNullSafe(F.col(f"`{keys[0]}`"))
    for key, column in zip(keys[1:], own[1:]):
        same = same & (column == F.col(f"`{key}`"))
    # Each piece is a word with the blanks before it.
    words = F.regexp_extract_all(text, F.lit(BETWEEN + WORD_CLASS), F.lit(0))
    cut = F.when(F.col(f"`{taken}`") < F.col(f"`{tokens}`"), F.array_join(F.slice(words, F.lit(1), F.col(f"`{taken}`").cast("int")), "")).otherwise(text)
    return numbered.join(passes, same).select(*[cut.alias(c) if c == full_text else F.col(f"`{c}`") for c in transcripts.columns])
