"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by their membership pattern (the set of sources they belong to), so the flow network has one
node per pattern and one per source, however many documents there are. A pattern offers its tokens once for
nothing and again, up to `max_repeats` times in all, at costs that rise with every repetition; a source asks for its
quota. The flow says how many tokens each pattern gives. Documents of a pattern are then taken in a seeded order:
whole rounds of all of them, and for what is left over each document of the order that still fits. That goes in passes:
a running total, kept by cells so that no pattern needs one task, finds the first document that does not fit, and the
next pass goes on behind it with the documents that fit what is left.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from farspark.llm.tables import WORD, cells_for, running_total
from farspark.operators.settle import settle, temporaries

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 17
#: The flow runs on the driver over one row per distinct set of sources.
MAX_PATTERNS = 100_000


def words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(capacity: Mapping, weights: Mapping, total: int) -> dict:
    """Share `total` by weight; a source stops at its capacity and the excess is shared again among the others."""
    target = {s: Fraction(0) for s in capacity}
    open_, left = {s for s in capacity if weights[s] > 0}, Fraction(total)
    while open_ and left > 0:
        scale = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * scale >= capacity[s]}
        if not full:
            for s in open_:
                target[s] = weights[s] * scale
            break
        for s in full:
            target[s] = Fraction(capacity[s])
            left -= capacity[s]
        open_ -= full
    return target


def flow(offers: Sequence[tuple[tuple, int]], asked: Mapping, max_repeats: int = MAX_REPEATS) -> list[dict]:
    """For each pattern (its sources, its tokens) the tokens it gives to each source: most in all, then least cost.

    The r-th repetition of a pattern costs r * (r - 1) / 2 a token. Shortest augmenting paths with potentials.
    """
    sources = list(asked)
    place = {s: 1 + len(offers) + i for i, s in enumerate(sources)}
    sink = 1 + len(offers) + len(sources)
    to, room, cost, edges = [], [], [], [[] for _ in range(sink + 1)]

    def edge(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            edges[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    given = []
    for i, (members, tokens) in enumerate(offers):
        for r in range(max_repeats):
            edge(0, 1 + i, tokens, r * (r + 1) // 2)
        given.append({s: edge(1 + i, place[s], max_repeats * tokens, 0) for s in members if s in place})
    for s in sources:
        edge(place[s], sink, int(asked[s]), 0)

    potential = [0] * (sink + 1)
    while True:
        far, via, heap = {0: 0}, {}, [(0, 0)]
        done = set()
        while heap:
            d, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            for e in edges[node]:
                if room[e] > 0:
                    nd = d + cost[e] + potential[node] - potential[to[e]]
                    if nd < far.get(to[e], float("inf")):
                        far[to[e]], via[to[e]] = nd, e
                        heapq.heappush(heap, (nd, to[e]))
        if sink not in far:
            return [{s: room[e ^ 1] for s, e in pattern.items()} for pattern in given]
        for node in range(sink + 1):
            potential[node] += far.get(node, far[sink])
        path, node = [], sink
        while node:
            path.append(via[node])
            node = to[via[node] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount


def _take(rows: DataFrame, rest: Mapping[int, int], cells: int) -> tuple[dict[int, int], dict[int, list[tuple]]]:
    """Go through the documents of each pattern in the order of tickets and take each one that fits what is left of `rest`.

    `rows` has `_p` (the pattern's number), `_ticket` and `_size`. Gives what stays open for each pattern, and the passes: a
    document is taken when its ticket is between the first two numbers of a pass (None: no bound) and its size at most the third.
    """
    spark = rows.sparkSession
    gaps, passes = dict(rest), {p: [] for p in rest}
    behind: dict[int, int | None] = {p: None for p, gap in rest.items() if gap > 0}
    cell = F.floor((F.col("_ticket") / F.lit(2.0 ** 64) + 0.5) * cells)
    with temporaries(spark):
        while behind:
            small = spark.createDataFrame([(p, gaps[p], t) for p, t in behind.items()], "_p int, _gap long, _behind long")
            fits = (F.col("_size") > 0) & (F.col("_size") <= F.col("_gap")) & (F.col("_behind").isNull() | (F.col("_ticket") > F.col("_behind")))
            rows = settle(rows.select("_p", "_ticket", "_size").join(F.broadcast(small), "_p").filter(fits))
            ordered = running_total(rows.withColumn("_cell", cell), ["_p"], "_cell", ["_ticket"], F.col("_size"), "_before")
            first = F.min(F.when(F.col("_before") + F.col("_size") > F.col("_gap"), F.struct("_ticket", "_before")))
            found = ordered.groupBy("_p").agg(first.alias("first"), F.sum("_size").alias("all")).collect()
            last, behind = behind, {}
            for r in found:
                p, stop = r["_p"], r["first"]
                passes[p].append((last[p], stop and stop["_ticket"], gaps[p]))
                gaps[p] -= stop["_before"] if stop else r["all"]
                if stop and gaps[p] > 0:
                    behind[p] = stop["_ticket"]
    return gaps, passes


def mix(docs: DataFrame, key: list[str], size: str = "size", members: str = "members", weights: Sequence[int] = WEIGHTS,
        max_repeats: int = MAX_REPEATS, total: int | None = None, seed: int = SEED) -> DataFrame:
    """Add `copies` (0 to `max_repeats`) to every document, and `source_size` and `target` of its first source.

    `members` is the array of the document's sources (null elements are a source of their own, an empty or null array is
    in the source null); `size` its tokens. Sources weigh `weights` in turn by code point, null last, and share `total`
    (all tokens unless given); a source's target stops at `max_repeats` times its tokens and the excess is shared again by
    weight. Documents are whole and a pattern never gives more than its flow; what it gives less is smaller than every document
    it has left out that fits the flow. Where that is as much as an average document, the smallest one left out is taken first and the
    others after it, as long as this comes closer. The order of documents is a seeded hash of `key`, the size and a number
    among the rows equal in both: the same rows give the same mix, and repeated rows may differ in copies. `key` should tell texts
    apart, by a hash of the text where ids repeat. Documents of size 0 are taken 0 times. Result columns replace columns of the same
    name; names with `_` in front are the operator's.
    """
    spark = docs.sparkSession
    sorted_members = F.array_sort(F.array_distinct(F.coalesce(F.col(members), F.array(F.lit(None).cast("string")))))
    pattern = F.when(F.size(sorted_members) == 0, F.array(F.lit(None).cast("string"))).otherwise(sorted_members)
    rows = settle(docs.drop("copies", "source_size", "target").withColumns({
        "_pattern": pattern, "_equal": F.xxhash64(F.lit(seed), *key, size), "_row": F.monotonically_increasing_id()}))
    # Rows equal in key and size are numbered, so that each has a ticket of its own.
    equal = rows.groupBy("_equal").count().agg(F.max("count")).first()[0]
    numbered = running_total(
        rows.withColumn("_cell", F.pmod(F.xxhash64("_row"), F.lit(cells_for(equal or 0)))), ["_equal"], "_cell", ["_row"], F.lit(1), "_nth")
    base = settle(numbered.withColumn("_ticket", F.xxhash64("_equal", "_nth")).drop("_cell", "_row", "_equal", "_nth"))
    offers = [(r["_pattern"], r["tokens"], r["rows"]) for r in base.groupBy("_pattern").agg(
        F.sum(size).alias("tokens"), F.count(F.when(F.col(size) > 0, 1)).alias("rows")).limit(MAX_PATTERNS + 1).collect()]
    if len(offers) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} distinct sets of sources; group sources first")
    offers.sort(key=lambda o: [(s is None, s or "") for s in o[0]])

    held: dict = {}
    for names, tokens, _ in offers:
        for s in names:
            held[s] = held.get(s, 0) + (tokens or 0)
    ranked = sorted(held, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ranked)}
    everything = sum(tokens or 0 for _, tokens, _ in offers) if total is None else total
    target = quotas({s: max_repeats * n for s, n in held.items()}, weight, everything)
    given = flow([(tuple(names), tokens or 0) for names, tokens, _ in offers], {s: round(t) for s, t in target.items()}, max_repeats)

    shares = []
    for p, ((names, tokens, _), parts) in enumerate(zip(offers, given)):
        amount, tokens = sum(parts.values()), tokens or 0
        rounds = min(amount // tokens, max_repeats) if tokens else 0
        shares.append((p, names, rounds, amount - rounds * tokens if rounds < max_repeats else 0, held[names[0]], float(target[names[0]])))

    def with_pattern(more: list[tuple], columns: str) -> DataFrame:
        small = spark.createDataFrame([(*s, *m) for s, m in zip(shares, more)],
                                      f"_p int, _names array<string>, _rounds int, _rest long, source_size long, target double{columns}")
        return base.join(F.broadcast(small), F.col("_pattern").eqNullSafe(F.col("_names")), "left").drop("_names")

    # Cells follow the order of the tickets: the ticket's place in the range of 64-bit numbers.
    cells = cells_for(max((n for *_, n in offers), default=0))
    narrow = settle(with_pattern([()] * len(shares), "").filter((F.col(size) > 0) & (F.col(size) <= F.col("_rest"))).select(
        "_p", "_ticket", F.col(size).cast("long").alias("_size")))
    rest = {p: r for p, _, _, r, *_ in shares}
    gaps, passes = _take(narrow, rest, cells)
    first: dict[int, list[int]] = {p: [] for p in rest}
    held_first = {p: 0 for p in rest}

    in_pass = F.exists("_passes", lambda t: (t["behind"].isNull() | (F.col("_ticket") > t["behind"]))
                       & (t["before"].isNull() | (F.col("_ticket") < t["before"])) & (F.col("_size") <= t["gap"]))
    pass_type = "array<struct<behind: long, before: long, gap: long>>"
    far = {p for p, (_, tokens, n) in enumerate(offers) if n and gaps[p] * n >= tokens}
    while far:
        small = spark.createDataFrame([(p, rest[p] - held_first[p], first[p], passes[p]) for p in far],
                                      f"_p int, _room long, _first array<long>, _passes {pass_type}")
        out = narrow.join(F.broadcast(small), "_p").filter(
            (F.col("_size") <= F.col("_room")) & ~F.array_contains("_first", F.col("_ticket")) & ~in_pass)
        smallest = {r["_p"]: r["least"] for r in out.groupBy("_p").agg(F.min(F.struct("_size", "_ticket")).alias("least")).collect()}
        tried = {p: [*first[p], s["_ticket"]] for p, s in smallest.items()}
        if not tried:
            break
        known = F.broadcast(spark.createDataFrame(list(tried.items()), "_p int, _first array<long>"))
        others = narrow.join(known, "_p").filter(~F.array_contains("_first", F.col("_ticket")))
        new_gaps, new_passes = _take(others, {p: rest[p] - held_first[p] - s["_size"] for p, s in smallest.items()}, cells)
        closer = {p for p in new_gaps if new_gaps[p] < gaps[p]}
        for p in closer:
            gaps[p], passes[p], first[p] = new_gaps[p], new_passes[p], tried[p]
            held_first[p] += smallest[p]["_size"]
        far = {p for p in closer if gaps[p] * offers[p][2] >= offers[p][1]}

    final = with_pattern([(first[p], passes[p]) for p in rest], f", _first array<long>, _passes {pass_type}").withColumn("_size", F.col(size))
    taken = F.coalesce(in_pass | F.array_contains("_first", F.col("_ticket")), F.lit(False))
    copies = F.when(F.col(size) > 0, F.col("_rounds") + taken.cast("int")).otherwise(0)
    return final.withColumn("copies", copies).select(*docs.drop("copies", "source_size", "target").columns, "copies", "source_size", "target")
