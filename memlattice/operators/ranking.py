"""Relevance of rows to prompts by shared words, and the top rows of each prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dictionary import dense_ids, hot_keys, look_up
from ..plans.settle import settle


def top_per_group(scored: DataFrame, group: list[str], order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with their rank; Spark drops rows beyond the limit before the shuffle."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit)


#: Letters by which a word and what holds it are brought together.
RUN = 4


def _runs(word: str, least: int, most: int) -> Column:
    """All different runs of ``least`` to ``most`` letters in the word."""
    n = F.length(word)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col(word), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(of(k) for k in range(least, most + 1))))


def token_overlap(prompts: DataFrame, rows: DataFrame, within: list[str], prompt: str = "prompt_id", row: str = "row_id", whole: float = 2.0, part: float = 0.5) -> DataFrame:
    """Columns ``within``, prompt, row and score for all rows that share something with a prompt of the same group.

    Both sides have the columns ``within``, an id and tokens, an array of distinct words. A prompt word found among the
    row's words counts ``whole``; else, if it has more than three letters and holds or is held by one of them, ``part``.
    Containment is decided once per pair of different words of the vocabularies, not per row: what is held has at its start
    a run of up to four letters that is also somewhere in what holds it, so pairs meet by an equality join on such runs and
    are verified after it. Null and empty token arrays match nothing.
    """
    wanted = prompts.select(*within, prompt, F.explode("tokens").alias("word"))
    told = rows.select(*within, row, F.explode("tokens").alias("token"))
    words = wanted.select(*within, "word").distinct()
    vocabulary = told.select(*within, "token").distinct()
    equal = words.select(*within, F.col("word").alias("token"), "word", F.lit(whole).alias("score"))
    long = words.filter(F.length("word") > 3)
    inside = long.select(*within, "word", F.substring("word", 1, RUN).alias("run")).join(vocabulary.select(*within, "token", F.explode(_runs("token", RUN, RUN)).alias("run")), [*within, "run"]).filter(F.col("token").contains(F.col("word")))
    around = long.select(*within, "word", F.explode(_runs("word", 0, RUN)).alias("run")).join(vocabulary.select(*within, "token", F.substring("token", 1, RUN).alias("run")), [*within, "run"]).filter(F.col("word").contains(F.col("token")))
    partly = inside.unionByName(around).filter("token != word").select(*within, "token", "word", F.lit(part).alias("score"))
    known = told.join(equal.unionByName(partly), [*within, "token"]).groupBy(*within, row, "word").agg(F.max("score").alias("score"))
    return wanted.join(known, [*within, "word"]).groupBy(*within, prompt, row).agg(F.sum("score").alias("score"))


def budget_selection(candidates: DataFrame, group: str, limits: dict[str, int], order: list) -> DataFrame:
    """group, kind, candidate_id, position and outcome of all candidates of each group's budget.

    Kinds are served in the order of ``limits`` from one budget ``max_tokens`` (null: no limit); inside a kind candidates
    come in the given order. One beyond the limit of its kind is ``hard-limit``; one that does not fit what is left of the
    budget is ``token-budget`` and is skipped, and the next is tried; the others are ``selected``. Null and negative sizes
    count as 0. Positions come from one range-partitioned numbering of all rows, so no task sorts a whole group; ``order`` must decide
    ties. Only candidates within the limits, a bounded number per group, are folded; the others never meet in one row.
    """
    numbered = dense_ids(settle(candidates.filter(F.col("kind").isin(*limits))), [F.col(group), F.col("kind"), *order], "number")
    firsts = settle(numbered.groupBy(group, "kind").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")))
    hot = hot_keys(firsts, [group, "kind"])
    placed = look_up(numbered, firsts.drop("n"), [group, "kind"], hot).withColumn("position", (F.col("number") - F.col("first") + 1).cast("int"))
    kinds = list(limits)
    turn = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col("kind"))
    inside = placed.filter(F.col("position") <= limit)
    size = F.greatest(F.coalesce("estimated_tokens", F.lit(0)), F.lit(0)).cast("bigint")
    queues = inside.groupBy(group, "max_tokens").agg(F.sort_array(F.collect_list(F.struct(turn.alias("turn"), "position", "kind", "candidate_id", size.alias("size")))).alias("queue"))

    def step(state, c):
        fits = F.col("max_tokens").isNull() | (state["used"] + c["size"] <= F.col("max_tokens"))
        return F.struct((state["used"] + F.when(fits, c["size"]).otherwise(0)).alias("used"), F.concat(state["fits"], F.array(fits)).alias("fits"))

    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("fits"))
    folded = queues.select(group, "queue", F.aggregate("queue", start, step)["fits"].alias("fits"))
    told = folded.select(group, F.inline(F.zip_with("queue", "fits", lambda c, f: F.struct(c["kind"].alias("kind"), c["candidate_id"].alias("candidate_id"), c["position"].alias("position"), F.when(f, "selected").otherwise("token-budget").alias("outcome")))))
    beyond = placed.filter(F.col("position") > limit).select(group, "kind", "candidate_id", "position", F.lit("hard-limit").alias("outcome"))
    return told.unionByName(beyond)
