"""Mixing overlapping sources to target weights by min-cost flow.

A text that stands in several sources belongs to all of them: its membership pattern. Documents are aggregated by pattern and
source; the flow network has an arc for each (convex: the n-th copy of a pattern's texts costs more than the one before), an arc
from a pattern to each of its sources (room for two copies of the rows it has there), and the sources' quotas. The solved
flow says how many words of each class (pattern, source) the mix takes. Within a class, rows are taken in a seeded order until
the words are reached, whole classes first once where more than one copy is due. What rounding to whole documents leaves of a
source's quota is made up by `MENDS` single documents, each of the size that is nearest to it.

Networks of more than `PATTERNS` patterns are dealt at random to as many blocks as it takes, which are solved side by side: each
has its patterns whole, an equal part of every source's own texts, and of each quota the share of its capacity. So every pattern
keeps its memberships and its repetition cost and quotas are met; only the least cost is that of the blocks. One row a source
reaches the driver, and nothing else: patterns, classes and rows stay frames.

Null texts have no words and are never taken; a null source is a source of its own, last. Equal rows are separate rows of one
order. An empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_SEP, WHOLE, read, row_key, settle, split_words, whole_key

WEIGHTS, BUDGET, MOST, SEED = (3, 1, 2), 1.5, 2, 7
#: Patterns of a block of the flow network, and documents that mend a source's rounding.
PATTERNS, MENDS = 4000, 3
#: Bits of the seeded draw that make a level of a class's buckets; two levels are summed, and one last bucket is sorted.
LEVEL_BITS = 6


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float = MOST) -> list[float]:
    """budget shared by weight; no share above most times its size, the excess shared again by weight."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(budget)
    while open_:
        whole = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / whole for i in open_}
        over = [i for i in open_ if share[i] > most * sizes[i]]
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else share[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over] if over else []
    return out


class Flow:
    """Min-cost flow by the primal-dual method: shortest distances, then a blocking flow on the arcs that attain them."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def _distances(self, s: int) -> list[float]:
        d, todo, waiting = [float("inf")] * len(self.out), deque([s]), {s}
        d[s] = 0
        while todo:
            a = todo.popleft()
            waiting.discard(a)
            for e in self.out[a]:
                if self.room[e] and d[a] + self.cost[e] < d[b := self.to[e]]:
                    d[b] = d[a] + self.cost[e]
                    if b not in waiting:
                        waiting.add(b)
                        todo.append(b)
        return d

    def run(self, s: int, t: int) -> None:
        while (d := self._distances(s))[t] < float("inf"):
            while self._push(s, t, d):
                pass

    def _push(self, s: int, t: int, d: list[float]) -> int:
        """A blocking flow on the arcs of shortest paths, layered by hops so that arcs of no cost make no circles."""
        hops, todo = {s: 0}, deque([s])
        while todo:
            a = todo.popleft()
            for e in self.out[a]:
                b = self.to[e]
                if self.room[e] and d[a] + self.cost[e] == d[b] and b not in hops:
                    hops[b] = hops[a] + 1
                    todo.append(b)
        if t not in hops:
            return 0
        at, total = {a: 0 for a in hops}, 0
        while True:
            path, a = [], s
            while a != t:
                while at[a] < len(self.out[a]):
                    e = self.out[a][at[a]]
                    b = self.to[e]
                    if self.room[e] and hops.get(b) == hops[a] + 1 and d[a] + self.cost[e] == d[b]:
                        break
                    at[a] += 1
                else:
                    if a == s:
                        return total
                    back = path.pop()
                    a = self.to[back ^ 1]
                    at[a] += 1
                    continue
                path.append(e)
                a = b
            got = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= got
                self.room[e ^ 1] += got
            total += got


def route(patterns: dict, classes: dict[tuple, int], quotas: Sequence[int], most: int = MOST) -> dict[tuple, int]:
    """Words by class. patterns: words of one copy of a pattern's texts; classes: words of its rows in each source."""
    names = list(patterns)
    node = {p: 1 + i for i, p in enumerate(names)}
    first, t = 1 + len(names), 1 + len(names) + len(quotas)
    net, arcs, room = Flow(t + 1), {}, dict.fromkeys(names, 0)
    for (p, s), words in classes.items():
        arcs[p, s] = net.arc(node[p], first + s, most * words)
        room[p] += most * words
    for p in names:
        copies, width, left = 0, 1, room[p]
        while left > 0 and patterns[p]:
            net.arc(0, node[p], min(left, patterns[p] * width), copies)
            left -= patterns[p] * width
            copies, width = copies + width, width * 2 if copies else 1
    for s, q in enumerate(quotas):
        net.arc(first + s, t, q)
    net.run(0, t)
    return {k: net.room[e ^ 1] for k, e in arcs.items()}


def due_words(classes: DataFrame, goal: Sequence[int], blocks: int) -> DataFrame:
    """classes: pattern, src, held (words), once (words of one copy of the pattern's texts), alone (of one source) -> pattern, src, due."""
    sources = len(goal)
    own = F.when(F.col("alone"), F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.array(F.pmod(F.xxhash64("pattern"), F.lit(blocks)).cast("int")))
    dealt = classes.withColumn("block", F.explode(own))
    part = lambda c: F.when(F.col("alone"), F.floor(F.col(c) / blocks) + F.when(F.col("block") < F.col(c) % blocks, 1).otherwise(0)).otherwise(F.col(c)).cast("long").alias(c)
    dealt = dealt.select("block", "pattern", "src", part("held"), part("once"))
    room = classes.groupBy("src").agg(F.sum("held").alias("room"))
    dealt = dealt.join(F.broadcast(room), "src")  # a row a source

    def solve(t: pa.Table) -> pa.Table:
        rows = t.sort_by([("pattern", "ascending"), ("src", "ascending")]).to_pydict()  # the flow must not depend on the order of rows
        patterns, words, quotas, inside = {}, {}, [0] * sources, [0] * sources
        for p, s, held, once, whole in zip(rows["pattern"], rows["src"], rows["held"], rows["once"], rows["room"], strict=True):
            patterns[p] = max(once, 1)
            words[p, s] = held
            inside[s] += held
            quotas[s] = round(goal[s] * inside[s] / whole) if whole else 0
        flow = route(patterns, words, quotas)
        return pa.table({"pattern": pa.array([p for p, _ in flow], pa.int64()), "src": pa.array([s for _, s in flow], pa.int32()), "due": pa.array(flow.values(), pa.int64())})

    solved = dealt.groupBy("block").applyInArrow(solve, "pattern long, src int, due long")
    return solved.groupBy("pattern", "src").agg(F.sum("due").alias("due"))


def _edges(rows: DataFrame, digit: str, left: str) -> DataFrame:
    """pattern, src, edge and before: the bucket in which a class's words reach what is left of its due, and the words before it."""
    sums = rows.groupBy("pattern", "src", digit).agg(F.sum("size").alias("words"), F.first(left).alias("left"))
    before = F.sum("words").over(W.partitionBy("pattern", "src").orderBy(digit)) - F.col("words")
    at = sums.withColumn("before", before).where("before <= left AND before + words > left")
    return at.select("pattern", "src", F.col(digit).alias("edge"), "before")


def _take(rows: DataFrame, due: DataFrame) -> DataFrame:
    """rows pattern, src, size, draw, ... -> with times. due: pattern, src, held, due."""
    base = F.when(F.col("held") > 0, F.floor(F.col("due") / F.col("held"))).otherwise(0)
    due = due.select("pattern", "src", base.cast("int").alias("base"), (F.col("due") - base * F.col("held")).cast("long").alias("left"))
    digit = lambda k: F.expr(f"cast(shiftrightunsigned(draw, {64 - LEVEL_BITS * k}) & {(1 << LEVEL_BITS) - 1} as int)")
    open_ = settle(rows.join(due, ["pattern", "src"]), "due")
    names, out = [*rows.columns, "times"], None
    for level in (1, 2):
        open_ = open_.withColumn("digit", digit(level))
        edged = settle(open_.join(_edges(open_, "digit", "left"), ["pattern", "src"], "left"), "edges")
        sure = edged.where("edge IS NULL OR digit <> edge").withColumn("times", F.col("base") + F.when(F.col("digit") < F.col("edge"), 1).otherwise(0)).select(*names)
        out = sure if out is None else out.unionByName(sure)
        open_ = edged.where("digit = edge").withColumn("left", F.col("left") - F.col("before")).drop("digit", "edge", "before")
    upto = F.sum("size").over(W.partitionBy("pattern", "src").orderBy("draw", "size", "rid").rowsBetween(W.unboundedPreceding, 0))
    last = open_.withColumn("times", F.col("base") + F.when(upto - F.col("size") / 2 <= F.col("left"), 1).otherwise(0))
    return out.unionByName(last.select(*names))


def _mended(taken: DataFrame, goal: Sequence[int]) -> DataFrame:
    """taken with the times of MENDS documents of each source changed by one, where that brings its words nearer to the goal."""
    spark = taken.sparkSession
    have = [0] * len(goal)
    for s, words in taken.groupBy("src").agg(F.sum(F.col("size") * F.col("times"))).collect():
        have[s] = words or 0
    change: dict[int, int] = {}
    for _ in range(MENDS):
        gaps = [(s, g - h) for s, (g, h) in enumerate(zip(goal, have, strict=True)) if g != h]
        if not gaps:
            break
        gap = F.broadcast(spark.createDataFrame(gaps, "src int, gap long"))
        done = F.broadcast(spark.createDataFrame([(r,) for r in change], "rid long"))
        free = F.when(F.col("gap") > 0, F.col("times") < MOST).otherwise(F.col("times") > 0)
        near = taken.join(gap, "src").where((F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap")) & free).join(done, "rid", "left_anti")
        # how far the size is from the gap, then the draw
        near = near.withColumn("off", F.shiftleft(F.abs(F.col("size") - F.abs("gap")), 31).bitwiseOR(F.shiftrightunsigned("draw", 33)))
        best = F.broadcast(near.groupBy("src").agg(F.min("off").alias("off")))
        found = near.join(best, ["src", "off"]).groupBy("src", "gap", "size").agg(F.min("rid").alias("rid")).collect()
        if not found:
            break
        for r in found:
            step = 1 if r["gap"] > 0 else -1
            change[r["rid"]] = step
            have[r["src"]] += step * r["size"]
    changes = F.broadcast(spark.createDataFrame(list(change.items()), "rid long, step int"))
    return taken.join(changes, "rid", "left").withColumn("times", F.col("times") + F.coalesce("step", F.lit(0))).drop("step")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """id, WHOLE, size, source_size, target and times (0 to 2) for each row of docs."""
    spark = docs.sparkSession
    size = F.size(split_words(F.col(text_col), SPACE_SEP)).cast("long")
    whole = whole_key(docs)
    draw = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), whole)
    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), whole, F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text"), size.alias("size"), draw.alias("draw"), F.monotonically_increasing_id().alias("rid"))
    rows = settle(rows, "mix")
    held = rows.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = [r["size"] for r in held]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(held))], budget * sum(sizes))
    index = spark.createDataFrame([(r["source"], i, r["size"], g) for i, (r, g) in enumerate(zip(held, goal, strict=True))], f"_source {rows.schema['source'].dataType.simpleString()}, src int, source_size long, target double")
    rows = rows.join(F.broadcast(index), F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    texts = rows.groupBy("text").agg(F.array_sort(F.collect_set("src")).alias("srcs"), F.max("size").alias("size"))
    texts = settle(texts.select("text", "size", F.xxhash64("srcs").alias("pattern"), (F.size("srcs") > 1).alias("many")), "texts")
    shared = texts.where("many").select("text", F.col("pattern").alias("_pattern"))
    rows = rows.join(shared, "text", "left").withColumn("pattern", F.coalesce("_pattern", F.xxhash64(F.array("src")))).withColumn("alone", F.col("_pattern").isNull())
    rows = settle(rows.drop("_pattern", "text"), "classes")
    once = texts.groupBy("pattern").agg(F.sum("size").alias("once"))
    classes = settle(rows.groupBy("pattern", "src", "alone").agg(F.sum("size").alias("held")).join(once, "pattern"), "held")
    blocks = 1 + classes.where("NOT alone").select("pattern").distinct().count() // PATTERNS
    whole_goal = [round(g) for g in goal]
    due = settle(due_words(classes, whole_goal, blocks).join(classes.select("pattern", "src", "held"), ["pattern", "src"]), "flow")
    taken = settle(_take(rows.drop("alone"), due), "taken")
    found = _mended(taken, whole_goal)
    return found.select("id", *WHOLE, "size", "source_size", "target", F.when(F.col("size") > 0, F.col("times")).otherwise(0).alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs with each row as often as the mix takes it (not at all, once or twice)."""
    times = plan(docs, id_col, text_col, source_col, **how).groupBy(*WHOLE).agg(F.sum("times").alias("_times"), F.count("*").alias("_rows"))
    times = settle(times, "times")
    own = docs.select(F.struct("*").alias("_row"), *row_key(id_col, text_col), whole_key(docs))
    if not times.where("_rows > 1").isEmpty():  # rows that are equal throughout: their takes are summed over one of them
        own = own.dropDuplicates(WHOLE)
    return own.join(times.where("_times > 0"), WHOLE).select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_row.*")


def op3_mix(spark, sf_dir: str) -> DataFrame:
    found = plan(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))
