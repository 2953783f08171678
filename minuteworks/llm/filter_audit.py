"""How a chain of filters interacts: what every filter removes in every order of the chain.

Documents become failure masks in Spark and are counted by part and mask; texts never leave the map
side, and copies are told apart by aggregates alone.  What is left of a part, at most one row for each
mask, becomes a decision diagram with one level for each filter and counts below it.  All orders of the
filters are visited by swaps of adjacent levels, each of which touches two levels only; after each swap
the path on which all filters pass gives the steps of that order.
"""

from __future__ import annotations

from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteworks.llm.common import text_or_empty

#: A word: no ASCII white space inside.
BLANK = r"[\x20\x09-\x0D]+"
MOST_FILTERS = 8  # 8! orders of 8 steps for each part


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions on a text: too short, repetitive, shouting, with markup signs."""
    words = F.array_remove(F.split(text, BLANK), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


class Diagram:
    """A count-weighted decision diagram: a node tests the filter of its level, ``low`` is the branch that
    passes and ``high`` the one that fails, and a leaf is the counts of one mask.  Equal nodes of a level
    are one node; empty branches are ``None``.  Levels are never skipped, so a swap is local to two levels.
    """

    def __init__(self, order: str, counts: dict[str, tuple[int, ...]]):
        """``counts``: the letters that fail (in any order) -> counts."""
        self.order, self.unique, self.weights = list(order), {}, {}
        self.width = len(next(iter(counts.values())))
        self.root = self._build(0, {frozenset(k): v for k, v in counts.items()})

    def _build(self, level: int, rows: dict[frozenset, tuple[int, ...]]):
        if not rows:
            return None
        if level == len(self.order):
            (leaf,) = rows.values()
            return self.unique.setdefault(("leaf", leaf), ("leaf", leaf))
        name = self.order[level]
        return self._node(name, self._build(level + 1, {k: v for k, v in rows.items() if name not in k}), self._build(level + 1, {k: v for k, v in rows.items() if name in k}))

    def _node(self, name: str, low, high):
        if low is None and high is None:
            return None
        key = (name, id(low), id(high))
        return self.unique.setdefault(key, (name, low, high))

    def total(self, node) -> tuple[int, ...]:
        """The counts of all masks below a node; kept with the node, as swaps leave most nodes alone."""
        if node is None:
            return (0,) * self.width
        if node[0] == "leaf":
            return node[1]
        found = self.weights.get(id(node))
        if found is None:
            found = self.weights[id(node)] = tuple(map(sum, zip(self.total(node[1]), self.total(node[2]))))
        return found

    def swap(self, level: int) -> None:
        """Exchanges the filters of ``level`` and the next one."""
        upper, lower = self.order[level : level + 2]
        self.order[level : level + 2] = lower, upper
        done = {}

        def cofactors(node):
            return (None, None) if node is None else node[1:]

        def rebuilt(node, depth: int):
            if node is None:
                return None
            if id(node) not in done:
                _, low, high = node
                if depth < level:
                    done[id(node)] = self._node(node[0], rebuilt(low, depth + 1), rebuilt(high, depth + 1))
                else:
                    (pp, pf), (fp, ff) = cofactors(low), cofactors(high)
                    done[id(node)] = self._node(lower, self._node(upper, pp, fp), self._node(upper, pf, ff))
            return done[id(node)]

        self.root = rebuilt(self.root, 0)

    def all_pass(self):
        """For each step of the present order: its filter, the counts that stay and those that go."""
        node = self.root
        for name in self.order:
            low, high = (None, None) if node is None else node[1:]
            yield name, self.total(low), self.total(high)
            node = low


def adjacent_swaps(n: int):
    """Positions whose swaps, one after the other, visit all orders of ``n`` things once (plain changes)."""
    if n < 2:
        return
    down, up = range(n - 2, -1, -1), range(n - 1)
    inner = [*adjacent_swaps(n - 1), None]
    for k, position in enumerate(inner):
        yield from up if k % 2 else down
        if position is not None:
            yield position + (0 if k % 2 else 1)


STEP_COLUMNS = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows(names: str, counts: dict[str, tuple[int, int, int]]) -> list[tuple]:
    """The steps of all orders for one part.  ``counts``: failing letters -> documents, good ones, toxic ones."""
    diagram = Diagram(names, counts)
    fails = {x: sum(v[0] for k, v in counts.items() if x in k) for x in names}
    alone = {x: sum(v[0] for k, v in counts.items() if set(k) == {x}) for x in names}
    shapley, rows = dict.fromkeys(names, 0), []
    for position in [None, *adjacent_swaps(len(names))]:
        if position is not None:
            diagram.swap(position)
        order = "".join(diagram.order)
        for step, (x, stay, go) in enumerate(diagram.all_pass(), 1):
            shapley[x] += go[0]
            rows.append((order, step, stay[0], go[0], fails[x] - go[0], alone[x], go[1], go[2]))
    assert len({r[0] for r in rows}) == factorial(len(names))
    return [(*r, shapley[r[0][r[1] - 1]]) for r in rows]


def failure_masks(docs: DataFrame, labels: DataFrame, failures=text_failures, copies: str = "E", part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counted failure masks: ``part, mask, docs, good, toxic``, where ``mask`` is the letters that fail.

    ``failures`` makes named conditions of a text; a null condition passes.  ``copies`` is the letter of
    the rule that fails a text which a smaller id has already, anywhere in the table.  Null texts and
    parts are empty strings.  A null id comes after all others and has no labels; rows that repeat an id
    count each, and are no copies of one another.  An id is good (toxic) if any of its labels says so.
    Other columns of either table may have any names.
    """
    text = text_or_empty("t")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.coalesce(F.col(part_col), F.lit("")).alias("part"))
    tests = failures(text)
    rows = rows.select("id", "part", F.unhex(F.sha2(text, 256)).alias("hash"), F.concat(*[F.when(c, F.lit(x)).otherwise(F.lit("")) for x, c in tests.items()]).alias("mask"))
    marks = labels.select(F.col("doc_id").alias("label_id"), (F.col("quality") == 1).cast("int").alias("g"), (F.col("toxic") == 1).cast("int").alias("x"))
    marks = marks.groupBy("label_id").agg(F.coalesce(F.max("g"), F.lit(0)).alias("good"), F.coalesce(F.max("x"), F.lit(0)).alias("toxic"))
    marked = rows.join(marks, F.col("id") == F.col("label_id"), "left").select("id", "part", "hash", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # equal texts have one mask: only the class of a row and its id differ among copies, so a group of
    # copies shrinks on the map side to a row for each class, with its smallest id and how often that occurs
    per_id = marked.groupBy("id", "part", "hash", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("c"))
    rank = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("c").alias("c"))
    classes = per_id.groupBy("hash", "mask", "part", "good", "toxic").agg(F.sum("c").alias("n"), F.min(rank).alias("first"))
    # a hash has a row for each part and label here, never one for each copy
    least = classes.withColumn("least", F.min("first").over(Window.partitionBy("hash")))
    first = F.when(F.col("first.id").eqNullSafe(F.col("least.id")), F.col("first.c")).otherwise(F.lit(0))
    split = least.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), first.alias("n")), F.struct(F.concat("mask", F.lit(copies)).alias("mask"), (F.col("n") - first).alias("n")))).alias("s"))
    n = F.col("s.n")
    return split.where("s.n > 0").groupBy("part", F.col("s.mask").alias("mask")).agg(F.sum(n).alias("docs"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def audit_filters(masks: DataFrame, names: str = "ABCDE") -> DataFrame:
    """``part, filter_order, step`` with ``kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley`` for every order of the filters ``names``, from counted masks.  One group is one part: at most
    ``2 ** len(names)`` rows.  Without masks there are no parts and no rows."""
    if not 0 < len(names) <= MOST_FILTERS or len(set(names)) != len(names):
        raise ValueError(f"1 to {MOST_FILTERS} different letters, not {names!r}")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counts = {m: (int(d), int(g), int(t)) for m, d, g, t in zip(frame["mask"], frame["docs"], frame["good"], frame["toxic"])}
        out = pd.DataFrame(audit_rows(names, counts), columns=STEP_COLUMNS)
        out.insert(0, "part", frame["part"].iloc[0])
        return out

    return masks.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in STEP_COLUMNS[2:]))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`audit_filters` of the five filters over whole texts of ``docs``."""
    return audit_filters(failure_masks(docs, labels))
