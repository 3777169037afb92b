"""Samples whose categories have given shares, with minima, by minimum-cost flow.

Everything is counted first: the flow runs over cells (categories of one or two fields), of which there are as
many as combinations of categories, not rows.  Arcs from a category carry its target and its minimum, arcs of cells
carry what is available, and slack arcs take what can't be met.  The integer quotas of cells are then drawn at
random, with a seed, by a rank within each cell; a crowded cell is ranked in salted parts.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.llm.common import small
from quipu.llm.linking import fold

#: Targets that are broadcast; more are joined.
BROADCAST_ROWS = 100_000
#: Cost of a unit within a minimum, within a share, beyond it, and of one that nothing supplies.
LEAST, SHARE, BEYOND, SLACK = 0, 1, 50, 1000


def category_key(c: Column) -> Column:
    """Category without case, accents and outer spaces."""
    return F.nullif(fold(F.trim(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))), F.lit(""))


class Flow:
    """Minimum-cost flow; costs are whole and not negative.

    Shortest distances give potentials, then all paths of least cost are filled at once, level by level; so there are as many
    rounds as different path costs, not as many as paths.
    """

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)
        self.names: dict[object, int] = {}

    def node(self, name: object) -> int:
        return self.names.setdefault(name, len(self.names))

    def arc(self, a: object, b: object, room: int, cost: int) -> int:
        i, j = self.node(a), self.node(b)
        for x, y, r, c in ((i, j, room, cost), (j, i, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def _distances(self, s: int, height: list[int]) -> dict[int, int]:
        far, heap = {s: 0}, [(0, s)]
        while heap:
            d, u = heappop(heap)
            if d > far[u]:
                continue
            for e in self.out[u]:
                v = self.to[e]
                if self.room[e] > 0 and (n := d + self.cost[e] + height[u] - height[v]) < far.get(v, math.inf):
                    far[v] = n
                    heappush(heap, (n, v))
        return far

    def _fill(self, s: int, t: int, height: list[int], amount: int) -> int:
        """Send what goes along arcs of no reduced cost."""
        flat = lambda e, u: self.room[e] > 0 and self.cost[e] + height[u] == height[self.to[e]]
        sent = 0
        while sent < amount:
            level, queue = {s: 0}, deque([s])
            while queue:
                u = queue.popleft()
                for e in self.out[u]:
                    if flat(e, u) and self.to[e] not in level:
                        level[self.to[e]] = level[u] + 1
                        queue.append(self.to[e])
            if t not in level:
                break
            turn: dict[int, int] = defaultdict(int)
            path: list[int] = []
            u = s
            while True:
                if u == t:
                    step = min(amount - sent, *(self.room[e] for e in path))
                    for e in path:
                        self.room[e] -= step
                        self.room[e ^ 1] += step
                    sent += step
                    path, u = [], s
                    if sent == amount:
                        return sent
                    continue
                own = self.out[u]
                while turn[u] < len(own) and not (flat(own[turn[u]], u) and level.get(self.to[own[turn[u]]]) == level[u] + 1):
                    turn[u] += 1
                if turn[u] < len(own):
                    path.append(own[turn[u]])
                    u = self.to[path[-1]]
                elif not path:
                    break
                else:
                    u = self.to[path.pop() ^ 1]
                    turn[u] += 1
        return sent

    def run(self, source: object, sink: object, amount: int) -> int:
        """Send up to ``amount`` at least cost; gives what was sent."""
        s, t, sent = self.node(source), self.node(sink), 0
        height = [0] * len(self.names)
        while sent < amount:
            far = self._distances(s, height)
            if t not in far:
                break
            top = max(far.values())
            height = [h + far.get(v, top) for v, h in enumerate(height)]
            sent += self._fill(s, t, height, amount - sent)
        return sent

    def sent(self, arc: int) -> int:
        return self.room[arc ^ 1]


Cells = list[tuple[tuple, int]]
Targets = dict[tuple[int, object], tuple[float, int]]


def slack(cells: Cells, targets: Targets, size: float) -> dict[tuple[int, object], int]:
    """Rows that each category lacks of the larger of its minimum and its share of ``size``: what flows through slack arcs.

    Each field by itself: from its categories through their cells, and past them where these are used up.
    """
    out: dict[tuple[int, object], int] = {}
    for field in sorted({f for f, _ in targets}):
        flow, arcs, whole = Flow(), {}, 0
        for (f, c), (share, least) in targets.items():
            if f == field:
                want = math.ceil(max(float(least), share * size))
                flow.arc("source", (c,), want, 0)
                arcs[f, c] = flow.arc((c,), "slack", want, SLACK)
                whole += want
        for i, (cats, n) in enumerate(cells):
            flow.arc((cats[field],), i, n, 0)
            flow.arc(i, "sink", n, 0)
        flow.arc("slack", "sink", whole, 0)
        flow.run("source", "sink", whole)
        out |= {k: flow.sent(a) for k, a in arcs.items()}
    return out


def solve(cells: Cells, targets: Targets, size: int) -> tuple[list[int], dict[tuple[int, object], int]]:
    """Quota of each cell, and what each category lacks of its share and minimum in the sample.

    ``cells``: (category of each field, rows available); ``targets``: (field, category) to (share, minimum), of one or two
    fields (more can't be a flow: put some together to one field).  A unit of flow is a sampled row: it enters by its category
    of the first field, takes a cell and leaves by its category of the second.  Up to its minimum a category is free, up to its
    share cheap, beyond it dear, as are categories without a target.
    """
    flow, fields = Flow(), sorted({f for f, _ in targets})
    if len(fields) > 2 or any(len(c) > 2 for c, _ in cells):
        raise ValueError("a flow takes one or two fields; combine further ones")
    want = {k: max(m, math.floor(share * size + 1e-9)) for k, (share, m) in targets.items()}

    def margin(field: int, c: object, a: object, b: object) -> None:
        full = want.get((field, c), 0)
        least = min(targets.get((field, c), (0.0, 0))[1], full)
        for room, cost in ((least, LEAST), (full - least, SHARE), (size, BEYOND)):
            if room:
                flow.arc(a, b, room, cost)

    two = bool(cells) and len(cells[0][0]) > 1
    for c in dict.fromkeys(cats[0] for cats, _ in cells):
        margin(0, c, "source", (0, c))
    for c in dict.fromkeys(cats[1] for cats, _ in cells) if two else ():
        margin(1, c, (1, c), "sink")
    arcs = []
    for i, (cats, n) in enumerate(cells):
        arcs.append(flow.arc((0, cats[0]), i, n, 0))
        flow.arc(i, (1, cats[1]) if two else "sink", n, 0)
    flow.run("source", "sink", size)
    quotas = [flow.sent(a) for a in arcs]
    got: dict[tuple[int, object], int] = defaultdict(int)
    for (cats, _), q in zip(cells, quotas):
        for f, c in enumerate(cats):
            got[f, c] += q
    return quotas, {k: max(0, want[k] - got[k]) for k in targets}


def eligible(rows: DataFrame, key: str, category: str, targets: DataFrame, latest: Column | None = None) -> DataFrame:
    """``(key, category)``: one row per distinct key by its latest row, categories of the targets only.

    Keys that are null or blank are left out; of equally late rows the one with the larger category counts.
    """
    one = rows.where(F.trim(key) != "").select(F.col(key).alias("key"), category_key(F.col(category)).alias("category"), (F.lit(None).cast("string") if latest is None else latest).alias("at"))
    one = one.groupBy("key").agg(F.max_by("category", F.struct("at", "category")).alias("category"))
    known = targets.select(category_key(F.col("categoria")).alias("category")).distinct()
    return one.join(small(known, BROADCAST_ROWS), "category", "left_semi").select("key", "category")


def _asked(targets: DataFrame) -> list:
    return targets.withColumn("category", category_key(F.col("categoria"))).collect()


def report(pool: DataFrame, targets: DataFrame, part: int = 2) -> DataFrame:
    """``(campo, categoria, target_share, min_rows, available, wanted, quota, slack)`` of every target.

    The sample has ``1/part`` of the pool's rows.  ``slack`` is what a category lacks, in whole rows, of the larger of its
    minimum and its share of that size: what went through its slack arc.  An empty pool gives zero quotas, and only minima
    can fall short.  Categories are as many as the targets name, so the counts are a small table.
    """
    counts = {r["category"]: r["n"] for r in pool.groupBy("category").agg(F.count("*").alias("n")).collect()}
    asked = _asked(targets)
    size = sum(counts.values()) / part
    share = {(0, r["category"]): (r["target_share"] or 0.0, r["min_rows"] or 0) for r in asked}
    cells = [((c,), n) for c, n in sorted(counts.items()) if c is not None]
    quotas, _ = solve(cells, share, math.ceil(size))
    lacks = slack(cells, share, size)
    quota = {c[0]: q for (c, _), q in zip(cells, quotas)}
    rows = []
    for r in asked:
        c, need = r["category"], max(float(r["min_rows"] or 0), (r["target_share"] or 0.0) * size)
        rows.append((r["campo"], r["categoria"], r["target_share"], r["min_rows"], counts.get(c, 0), need, quota.get(c, 0), lacks[0, c]))
    schema = "campo string, categoria string, target_share double, min_rows int, available bigint, wanted double, quota bigint, slack bigint"
    return pool.sparkSession.createDataFrame(rows, schema)


def crossed(pool: DataFrame, first: DataFrame, second: DataFrame, part: int = 2) -> tuple[DataFrame, DataFrame]:
    """Quotas of a pool (key, a, b) whose two fields have targets each.

    * cells ``(category, quota)``, category being both fields' (``a|b``, blank where the field has no target);
    * report ``(campo, categoria, target_share, min_rows, available, quota, slack, missed)``: ``slack`` as in ``report``, and
      ``missed`` what the sample lacks of the target because the other field's leave no cell for it.
    """
    asked = [_asked(t) for t in (first, second)]
    known = [{r["category"] for r in rows} for rows in asked]
    counts = pool.groupBy("a", "b").agg(F.count("*").alias("n"))
    for c, rows in zip("ab", asked):  # categories without a target are one
        names = small(pool.sparkSession.createDataFrame([(r["category"],) for r in rows], f"{c} string").distinct().withColumn("known", F.lit(True)), BROADCAST_ROWS)
        counts = counts.join(names, c, "left").withColumn(c, F.when(F.col("known"), F.col(c))).drop("known")
    merged = {(r["a"], r["b"]): r["n"] for r in counts.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}
    cells = sorted(merged.items(), key=lambda x: (x[0][0] or "", x[0][1] or ""))
    targets = {(f, r["category"]): (r["target_share"] or 0.0, r["min_rows"] or 0) for f, rows in enumerate(asked) for r in rows}
    size = sum(merged.values()) / part
    quotas, missed = solve(cells, targets, math.ceil(size))
    lacks = slack(cells, targets, size)
    rows = []
    for f, some in enumerate(asked):
        for r in some:
            c = r["category"]
            have, got = (sum(v for k, v in pairs if k[f] == c) for pairs in (merged.items(), [(k, q) for (k, _), q in zip(cells, quotas)]))
            rows.append((r["campo"], r["categoria"], r["target_share"], r["min_rows"], have, got, lacks[f, c], missed[f, c]))
    spark = pool.sparkSession
    return (
        spark.createDataFrame([("|".join(x or "" for x in k), q) for (k, _), q in zip(cells, quotas)], "category string, quota bigint"),
        spark.createDataFrame(rows, "campo string, categoria string, target_share double, min_rows int, available bigint, quota bigint, slack bigint, missed bigint"),
    )


def draw(pool: DataFrame, quotas: DataFrame, seed: int = 7) -> DataFrame:
    """``(key, category)`` of pool (key, category) with exactly ``quota`` rows of each category (categoria or category, quota),
    all if there are fewer, by seeded hash order.

    Hash order is cut into 16384 cells whose rows are counted first; only the one cell in which a quota ends is ranked.
    """
    from pyspark.sql import Window

    wanted = quotas.select((category_key(F.col("categoria")) if "categoria" in quotas.columns else F.col("category")).alias("category"), "quota")
    rows = pool.join(small(wanted, BROADCAST_ROWS), "category").withColumn("order", F.xxhash64(F.lit(seed), "key")).withColumn("cell", F.shiftright("order", 50))
    near = rows.groupBy("category", "quota", "cell").agg(F.count("*").alias("n"))
    before = near.withColumn("upto", F.sum("n").over(Window.partitionBy("category").orderBy("cell")))
    place = before.withColumn("before", F.col("upto") - F.col("n")).where("before < quota").select("category", "cell", "before", "n")
    kept = rows.join(place, ["category", "cell"])
    whole = kept.where("before + n <= quota").select("key", "category")
    edge = kept.where("before + n > quota").withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy("order", "key")))
    return whole.unionByName(edge.where("rank <= quota - before").select("key", "category"))
