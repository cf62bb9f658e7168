"""Selections that cover: best pairs and trios of a group, and greedy picks from pools of any size.

A greedy pick changes what all others are worth, but never for the better: an
element that is covered, a category that is there, makes candidates that have it
worth less. So what a candidate was worth is a bound for what it is worth now.
Spark ranks the whole pool under a state of the selection and sends the best
few (``FRONTIER``); picks are made among them, each re-valued only when its bound
beats the best, as long as the best stays above the last that was sent. Then the
pool is ranked anew. The result is that of the pass in order, and the driver
holds the frontier and what has been picked.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from fenestra.checkpoints import cut

#: Candidates that the driver sees at a time.
FRONTIER = 500


# -- what a candidate is worth -----------------------------------------------
@dataclass
class State:
    """What has been picked: how often each element of a column is there, and how many picks there are."""

    seen: dict[str, Counter] = field(default_factory=dict)
    picks: int = 0

    def of(self, column: str) -> Counter:
        return self.seen.setdefault(column, Counter())


@dataclass(frozen=True)
class New:
    """The number of elements of an array column that ``need`` picks don't have yet."""

    column: str
    need: int = 1

    def full(self, state: State) -> list:
        return [e for e, n in state.of(self.column).items() if n >= self.need]

    def ranked(self, state: State) -> Column:
        full = self.full(state)
        left = F.array_except(F.array_distinct(self.column), F.lit(full)) if full else F.array_distinct(self.column)
        return F.size(left).cast("double")

    def worth(self, row: Row, state: State) -> float:
        return float(sum(state.of(self.column)[e] < self.need for e in set(row[self.column])))

    def add(self, row: Row, state: State) -> None:
        state.of(self.column).update(set(row[self.column]))


@dataclass(frozen=True)
class Fresh:
    """1 for a value of a column that no pick has."""

    column: str

    def ranked(self, state: State) -> Column:
        known = list(state.of(self.column))
        return F.when(F.col(self.column).isin(known), 0.0).otherwise(1.0) if known else F.lit(1.0)

    def worth(self, row: Row, state: State) -> float:
        return float(state.of(self.column)[row[self.column]] == 0)

    def add(self, row: Row, state: State) -> None:
        state.of(self.column)[row[self.column]] += 1


@dataclass(frozen=True)
class Fixed:
    """A number that stays."""

    column: str

    def ranked(self, state: State) -> Column:
        return F.col(self.column).cast("double")

    def worth(self, row: Row, state: State) -> float:
        return float(row[self.column])

    def add(self, row: Row, state: State) -> None:
        pass


@dataclass(frozen=True)
class Due:
    """A 0/1 column that counts once the picks that are left are no more than those that must still have it."""

    column: str
    least: int
    target: int

    def due(self, state: State) -> bool:
        return 0 < self.least - state.of(f"due {self.column}")[1] >= self.target - state.picks

    def ranked(self, state: State) -> Column:
        return F.col(self.column).cast("double") if self.due(state) else F.lit(0.0)

    def worth(self, row: Row, state: State) -> float:
        return float(row[self.column]) if self.due(state) else 0.0

    def add(self, row: Row, state: State) -> None:
        state.of(f"due {self.column}")[int(row[self.column])] += 1


Term = New | Fresh | Fixed | Due


def rarity(rows: DataFrame, ident: str, elements: str, out: str = "rarity") -> DataFrame:
    """rows with the sum of 1 / frequency of their elements, frequency being the number of rows that have one; summed in the elements' order, so reruns agree to the last bit."""
    each = rows.select(ident, F.explode(F.array_distinct(elements)).alias("_e"))
    often = each.groupBy("_e").agg(F.count("*").alias("_n"))
    listed = each.join(often, "_e").groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("_e", "_n"))).alias("_l"))
    summed = listed.select(ident, F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.lit(1.0) / x["_n"]).alias(out))
    return rows.join(summed, ident, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


# -- greedy picks ------------------------------------------------------------
def greedy(pool: DataFrame, ident: str, terms: Sequence[Term], target: int, ties: str, state: State, allowed: Callable[[State], tuple[Column | None, Callable[[Row], bool]]], frontier: int = FRONTIER) -> list[Row]:
    """Up to ``target`` rows of pool, best first by terms (highest), then ties and ident (highest); state is carried on.

    allowed gives, for a state, which rows may be picked: as a column, and of a
    row. What is not allowed may be later, but only after allowed has named all
    rows that it forbids; None for the column is all rows.
    """
    picked: list[Row] = []
    last = (ties, ident)
    key = lambda r: (*(t.worth(r, state) for t in terms), *(r[c] for c in last))
    due = lambda: tuple(t.due(state) for t in terms if isinstance(t, Due))
    while len(picked) < target:
        column, may = allowed(state)
        some = pool if column is None else pool.where(column)
        taken = [r[ident] for r in picked]
        if taken:
            some = some.where(~F.col(ident).isin(taken))
        ranked = [t.ranked(state).desc() for t in terms] + [F.col(c).desc() for c in last]
        sent = some.orderBy(*ranked).limit(frontier).collect()
        if not sent:
            break
        complete = len(sent) < frontier
        bound, turn = key(sent[-1]), due()
        heap = [(_Down(key(r)), i) for i, r in enumerate(sent)]
        heapq.heapify(heap)
        while heap and len(picked) < target and due() == turn:
            _, i = heapq.heappop(heap)
            row = sent[i]
            if not may(row):
                continue
            now = key(row)
            if heap and now < heap[0][0].key:  # its bound was too high: another may be better
                heapq.heappush(heap, (_Down(now), i))
                continue
            if not complete and now < bound:
                break
            picked.append(row)
            for t in terms:
                t.add(row, state)
            state.picks += 1
    return picked


@dataclass(frozen=True)
class _Down:
    """A key that sorts from high to low."""

    key: tuple

    def __lt__(self, other: _Down) -> bool:
        return self.key > other.key


def _numbered(picks: list[Row], pool: DataFrame, ident: str) -> DataFrame:
    return pool.sparkSession.createDataFrame([(r[ident], i) for i, r in enumerate(picks, 1)], f"{ident} {dict(pool.dtypes)[ident]}, pick int")


def marginal(pool: DataFrame, ident: str, terms: Sequence[Term], target: int, ties: str, category: str | None = None, cap: int = 0, frontier: int = FRONTIER) -> DataFrame:
    """(ident, pick): greedy picks; at most ``cap`` of a category (0: any number), and one more whenever all that are left are of full categories."""
    pool, state, limit = cut(pool), State(), cap
    picks: list[Row] = []
    while len(picks) < target:
        counts = Counter(r[category] for r in picks) if category else Counter()
        gone = [r[ident] for r in picks]

        def allowed(now: State) -> tuple[Column | None, Callable[[Row], bool]]:
            full = [c for c, n in counts.items() if limit and n >= limit]
            column = ~F.col(category).isin(full) if full else None
            if gone:
                free = ~F.col(ident).isin(gone)
                column = free if column is None else column & free
            return column, lambda r: not (limit and category and counts[r[category]] >= limit)

        def one_by_one(row: Row) -> None:
            if category:
                counts[row[category]] += 1

        before = len(picks)
        picks += greedy(pool, ident, [*terms, _Watch(one_by_one)], target - before, ties, state, allowed, frontier)
        if len(picks) == before:
            if not (limit and category) or pool.where(~F.col(ident).isin(gone)).isEmpty():
                break
            limit += 1
    return _numbered(picks, pool, ident)


@dataclass(frozen=True)
class _Watch:
    """A term that is worth nothing and tells of each pick."""

    tell: Callable[[Row], None]

    def ranked(self, state: State) -> Column:
        return F.lit(0.0)

    def worth(self, row: Row, state: State) -> float:
        return 0.0

    def add(self, row: Row, state: State) -> None:
        self.tell(row)


def covering(pool: DataFrame, ident: str, group: str, elements: str, hard: Sequence, terms: Sequence[Term], target: int, ties: str, size: str | None = None, most: int = 0, frontier: int = FRONTIER) -> DataFrame:
    """(ident, pick): ``target`` rows, one of a group. First, from the rarest on, one for each hard element that no pick has; then the rest by terms.

    Rows over ``most`` in ``size`` are left out, if without them there are groups
    enough and all hard elements are still there. Too few groups are an error.
    """
    groups = lambda df: df.select(group).distinct().count()
    found = lambda df: {r[0]: r[1] for r in df.select(F.explode(F.array_distinct(elements)).alias("e"), ident).where(F.col("e").isin(list(hard))).groupBy("e").count().collect()}  # noqa: E731  at most the hard elements
    pool = cut(pool)
    if groups(pool) < target:
        raise ValueError(f"only {groups(pool)} groups for {target} picks")
    if size and most:
        bounded = pool.where(F.col(size) <= most)
        if groups(bounded) >= target and set(found(pool)) <= set(found(bounded)):
            pool = bounded
    often, state, taken, covered = found(pool), State(), set(), set()

    def tell(row: Row) -> None:
        taken.add(row[group])
        covered.update(row[elements])

    picks: list[Row] = []
    every = [*terms, _Watch(tell)]
    # While hard elements are dealt out, nothing is due.
    early = [Due(t.column, 0, t.target) if isinstance(t, Due) else t for t in every]
    free = lambda: ~F.col(group).isin(list(taken)) if taken else F.lit(True)
    for e in sorted(often, key=lambda e: (often[e], e)):
        if e in covered or len(picks) >= target:
            continue
        picks += greedy(pool, ident, early, 1, ties, state, lambda s, e=e: (free() & F.array_contains(elements, e), lambda r: True), 1)
    picks += greedy(pool, ident, every, target - len(picks), ties, state, lambda s: (free(), lambda r: r[group] not in taken), frontier)
    if len(picks) < target:
        raise ValueError(f"only {len(picks)} of {target} picks")
    return _numbered(picks, pool, ident)


# -- best pairs and trios ----------------------------------------------------
def best_subset(rows: DataFrame, group: str, name: str, score: str, findings: str, most: int, sizes: Sequence[int] = (2, 3), enough: int = 5, too_many: int = 20) -> DataFrame:
    """(group, chosen): of each group's ``most`` best rows (by score, then name) the pair or trio whose findings score highest.

    findings: array of (id, code, error, safe). A subset is worth, first to last:
    different safe codes; few safe findings over ``too_many``; error codes; codes;
    safe findings up to ``enough``; the sum of scores; fewer rows; an earlier place.
    A finding of several rows counts once. Groups of one row are that row.
    """
    best = Window.partitionBy(group).orderBy(F.col(score).desc(), name)
    top = rows.withColumn("_i", F.row_number().over(best)).where(F.col("_i") <= most)
    packed = top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_i", F.col(name).alias("name"), F.col(score).cast("double").alias("score"), F.col(findings).alias("found")))).alias("rows"))
    subsets = [c for k in sizes for c in combinations(range(most), k)]
    distinct = lambda found, keep: F.size(F.array_distinct(F.transform(F.filter(found, keep), lambda x: x["code"])))

    def worth(c: Column) -> Column:
        members = F.transform(c["at"], lambda i: F.get("rows", i))
        found = F.array_distinct(F.flatten(F.transform(members, lambda m: m["found"])))
        safe = F.size(F.filter(found, lambda x: x["safe"]))
        return F.struct(
            distinct(found, lambda x: x["safe"]).alias("a"), (-F.greatest(safe - too_many, F.lit(0))).alias("b"), distinct(found, lambda x: x["error"]).alias("c"), distinct(found, lambda x: F.lit(True)).alias("d"),
            F.least(safe, F.lit(enough)).alias("e"), F.aggregate(members, F.lit(0.0), lambda s, m: s + m["score"]).alias("f"), (-F.size(c["at"])).alias("g"), (-c["place"]).alias("h"), F.transform(members, lambda m: m["name"]).alias("names"),
        )

    every = F.array(*(F.struct(F.array(*map(F.lit, c)).alias("at"), F.lit(i).alias("place")) for i, c in enumerate(subsets)))
    there = F.filter(every, lambda c: F.array_max(c["at"]) < F.size("rows"))
    chosen = F.when(F.size("rows") < min(sizes), F.transform("rows", lambda m: m["name"])).otherwise(F.array_max(F.transform(there, worth))["names"])
    return packed.select(group, chosen.alias("chosen"))


def with_evidence_first(rows: DataFrame, group: str, rank: str, evidence: str, limit: int, times: int = 4) -> DataFrame:
    """(rows, place): ``limit`` of each group: those with evidence among the first ``limit * times`` by rank, then the others by rank. A group of no more than the limit stays in order."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(rank))
    first = rows.withColumn("_n", n).where(F.col("_n") <= limit * times)
    more = F.max("_n").over(Window.partitionBy(group)) > limit
    order = Window.partitionBy(group).orderBy(F.when(F.col("_more") & (F.col(evidence) > 0), 0).otherwise(1), "_n")
    return first.withColumn("_more", more).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("_n", "_more")
