"""Joins: best of several matches, unique matches, reconciliation, coverage, pairs, designs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_match(left: DataFrame, right: DataFrame, on: Sequence[str], key: Sequence[str], order: Sequence[Column], how: str = "left") -> DataFrame:
    """Each row of left (its key is unique) with the first of its matches in an order that has no ties."""
    joined = left.join(right, list(on), how)
    return joined.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def first_reaching(left: DataFrame, right: DataFrame, on: Sequence[str], least: str, bound: str, key: str, out: str) -> DataFrame:
    """left with the smallest key of the rows of right that agree in ``on`` and whose bound is at least ``least``; null if there is none, or least is null.

    By falling bound, only a row whose key is smaller than all before can be that of
    anyone. Such rows are steps, about as many as the logarithm of a group where
    bounds and keys are independent; a row of left stands on one step and never
    meets the group. Steps are looked for in shares of a group first, so that no
    task sorts a whole one.
    """
    steps = right.where(F.col(bound).isNotNull()).select(*on, F.col(bound).alias("_upto"), F.col(key).alias(out))
    falling = [F.desc("_upto"), out]
    for share in ([F.pmod(F.xxhash64(out), F.lit(64))], []):
        before = F.min(out).over(Window.partitionBy(*on, *share).orderBy(*falling).rowsBetween(Window.unboundedPreceding, -1))
        steps = steps.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(out) < F.col("_before"))).drop("_before")
    steps = steps.withColumn("_over", F.lead("_upto").over(Window.partitionBy(*on).orderBy(*falling)))
    l, r = left.alias("l"), steps.alias("r")
    stands = (F.col(f"l.{least}") <= F.col("r._upto")) & (F.col("r._over").isNull() | (F.col(f"l.{least}") > F.col("r._over")))
    for name in on:
        stands = stands & (F.col(f"l.{name}") == F.col(f"r.{name}"))
    return l.join(r, stands, "left").select("l.*", f"r.{out}")


def fallback(left: DataFrame, first: DataFrame, second: DataFrame, on_first: str, on_second: str, columns: Sequence[str]) -> DataFrame:
    """left with columns of first by on_first, else of second by on_second; both are unique by their key."""
    one = first.select(on_first, *(F.col(c).alias(f"_1_{c}") for c in columns))
    two = second.select(on_second, *(F.col(c).alias(f"_2_{c}") for c in columns))
    both = left.join(one, on_first, "left").join(two, on_second, "left")
    return both.select(*left.columns, *(F.coalesce(f"_1_{c}", f"_2_{c}").alias(c) for c in columns))


def unique_match(targets: DataFrame, rows: DataFrame, on: Sequence[str], key: Sequence[str]) -> DataFrame:
    """targets with the number of rows that match, and a status: missing, matched or ambiguous."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    joined = targets.join(counts, list(on), "left")
    return joined.select(*dict.fromkeys([*key, *on]), n.alias("matches"), F.when(n == 0, "missing").when(n == 1, "matched").otherwise("ambiguous").alias("status"))


def reconcile(stored: DataFrame, current: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Full outer join of two states of the same rows: a flag for each field, reasons, and whether all is alike. Nulls are alike."""
    s, c = stored.select(*key, *fields, F.lit(True).alias("_in")).alias("s"), current.select(*key, *fields, F.lit(True).alias("_in")).alias("c")
    on = None
    for k in key:
        same = F.col(f"s.{k}") == F.col(f"c.{k}")
        on = same if on is None else on & same
    flags = {f: F.col(f"s.{f}").eqNullSafe(F.col(f"c.{f}")) for f in fields}
    in_s, in_c = F.col("s._in").isNotNull(), F.col("c._in").isNotNull()
    reasons = F.array_compact(F.array(F.when(~in_c, "gone"), F.when(~in_s, "new"), *(F.when(in_s & in_c & ~flag, f"{f}_differs") for f, flag in flags.items())))
    return s.join(c, on, "full_outer").select(*(F.coalesce(f"s.{k}", f"c.{k}").alias(k) for k in key), *((in_s & in_c & flag).alias(f"{f}_match") for f, flag in flags.items()), F.array_join(reasons, ";").alias("reasons"), (F.size(reasons) == 0).alias("consistent"))


def first_reason(rows: DataFrame, reasons: Sequence[tuple[str, Column]], out: str = "exclusion_reason") -> DataFrame:
    """rows with the first reason that holds, null for those to be kept."""
    chosen = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        chosen = F.when(condition, name).otherwise(chosen)
    return rows.withColumn(out, chosen)


def known_in(rows: DataFrame, known: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with a flag: whether the key is among those known."""
    marks = known.select(key).where(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return rows.join(marks, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def coverage(inventory: DataFrame, covered: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Items of an inventory, and those of them that are covered."""
    marked = known_in(inventory, covered, key, "_covered")
    return marked.groupBy(*by).agg(F.count("*").alias("items"), F.count_if("_covered").alias("covered"), F.count_if(~F.col("_covered")).alias("missing"))


def paired(rows: DataFrame, subject: str, condition: str, first, second, value: str) -> DataFrame:
    """Subjects under both conditions: both values, their difference, and win, tie or loss of the second."""
    wide = rows.groupBy(subject).agg(F.max(F.when(F.col(condition) == first, F.col(value))).alias("first"), F.max(F.when(F.col(condition) == second, F.col(value))).alias("second"))
    full = wide.where(F.col("first").isNotNull() & F.col("second").isNotNull()).withColumn("delta", F.col("second") - F.col("first"))
    return full.withColumn("outcome", F.when(F.col("delta") > 0, "win").when(F.col("delta") < 0, "loss").otherwise("tie"))


def all_pairs_of_models(rows: DataFrame, model: str, subject: str, value: str) -> DataFrame:
    """For each unordered pair of models, over the subjects that both have: wins, losses, ties and the mean difference. Models are few; subjects are joined."""
    a = rows.select(F.col(model).alias("model_a"), subject, F.col(value).alias("value_a"))
    b = rows.select(F.col(model).alias("model_b"), subject, F.col(value).alias("value_b"))
    both = a.join(b, subject).where(F.col("model_a") < F.col("model_b"))
    d = F.col("value_a") - F.col("value_b")
    return both.groupBy("model_a", "model_b").agg(F.count("*").alias("subjects"), F.count_if(d > 0).alias("a_higher"), F.count_if(d < 0).alias("b_higher"), F.count_if(d == 0).alias("ties"), F.avg(d).alias("mean_difference"))


def design(subjects: DataFrame, key: str, factors: dict[str, Sequence], seed: str | int = 0) -> DataFrame:
    """Each subject under each combination of factor levels, and a repeatable order of execution. Levels are literals, so nothing is joined."""
    rows = subjects
    for name, levels in factors.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, levels))))
    return rows.withColumn("order_key", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), *(F.col(n).cast("string") for n in factors)), 256))


def starts_reversed(*parts: Column) -> Column:
    """Whether a task's conditions run in reverse: the lowest bit of the hash of its identity."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), -1, 1), 16, 10).cast("int") % 2 == 1


def rank_union(first: DataFrame, second: DataFrame, by: str, item: str, limit: int, absent: int = 999) -> DataFrame:
    """Two rankings (by, item, rank) in one: both ranks, and an order by the better one, then the item."""
    a, b = first.select(by, item, F.col("rank").alias("rank_first")), second.select(by, item, F.col("rank").alias("rank_second"))
    both = a.join(b, [by, item], "full_outer")
    better = F.least(F.coalesce("rank_first", F.lit(absent)), F.coalesce("rank_second", F.lit(absent)))
    ranked = both.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(better, item)))
    return ranked.where(F.col("position") <= limit)


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """The union by key; of rows that share one, the incoming one (keys are unique on each side)."""
    kept = existing.join(incoming.select(*key), list(key), "left_anti")
    return kept.unionByName(incoming)


def patched(rows: DataFrame, patch: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """rows with the fields that a patch gives a value for."""
    new = patch.select(key, *(F.col(f).alias(f"_new_{f}") for f in fields))
    return rows.join(new, key, "left").withColumns({f: F.coalesce(f"_new_{f}", f) for f in fields}).drop(*(f"_new_{f}" for f in fields))


def one_to_one(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: Sequence[str], left_order: Column | str, right_order: Column | str) -> DataFrame:
    """(left_id, right_id): what a pass over left in order gives, in which each row takes the first row of right that shares any key with it and is not taken.

    Each round settles the pairs whose left row comes first of all open ones
    that could take the right row, and whose right row is its first choice.
    Null and empty keys match nobody; ids are unique and break ties.
    """
    from fenestra.checkpoints import cut

    def tagged(rows: DataFrame, ident: str, order: Column | str, name: str) -> DataFrame:
        own = F.explode(F.array(*(F.when(F.col(k).cast("string") != "", F.concat_ws("\x1f", F.lit(k), F.col(k).cast("string"))) for k in keys)))
        at = F.struct((F.col(order) if isinstance(order, str) else order).alias("o"), F.col(ident).alias("i"))
        return rows.select(F.col(ident).alias(name), at.alias(f"{name}_at"), own.alias("key")).where(F.col("key").isNotNull())

    pairs = cut(tagged(left, left_id, left_order, "l").join(tagged(right, right_id, right_order, "r"), "key").drop("key").distinct())
    done = None
    while not pairs.isEmpty():
        by_left, by_right = Window.partitionBy("l"), Window.partitionBy("r")
        marked = pairs.withColumns({"choice": F.min("r_at").over(by_left) == F.col("r_at"), "first": F.min("l_at").over(by_right) == F.col("l_at")})
        settled = cut(marked.where("choice and first").select("l", "r"))
        done = settled if done is None else cut(done.unionByName(settled))
        pairs = cut(pairs.join(settled.select("l"), "l", "left_anti").join(settled.select("r"), "r", "left_anti"))
    done = pairs.select("l", "r") if done is None else done
    return done.select(F.col("l").alias(left_id), F.col("r").alias(right_id))
