"""Bytes covered by a string of fixed length that also starts elsewhere, by refined buckets of positions.

Positions are put in buckets that are told apart to ever greater depth. A bucket's name is a hash of the text it stands
for, so it means the same in every task: the name to depth 2q at a position follows from the names to depth q there and q
further on, and each depth reuses the names of the one before.

1. The first buckets are q-grams. Of all q-grams in the reach of a string of full length one is its anchor: the one with
   the least name, the first of equals. Neighbouring strings share anchors, so a text falls into runs of strings with one
   anchor, a few for a thousand bytes. Copies have equal anchors at equal distance; an anchor seen once settles its run.
2. A run is refined by the names, at full depth, of its first and last string: together they cover everything the run
   reaches. A run seen twice is repeated as a whole.
3. What is left are runs at the edges of repeats. Their strings are cut into blocks by the distance to the anchor, refined by
   what the strings of a block have in common; a block whose common part is seen once has no repeat.
4. Equal blocks are repeated as a whole. What is left is refined to full depth string by string.

Every step counts names by aggregation, so a passage that fills a third of the corpus meets nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from farspark.llm.workers import releasing
from farspark.operators.settle import settle, temporaries

LENGTH = 400
GRAM = 64
#: Strings in a block of step 3, and bytes refined at once: their names of all depths take some ninety times as much (positions must fit the
#: low bits of a packed name).
BLOCK = 42
HELD_BYTES = 1 << 17
#: A table of all runs has some 64 / (length - 64) times the bytes of the texts: it is kept for strings from this length on.
KEPT_FROM = 256
_PLACE = np.uint64((1 << 20) - 1)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _deeper(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names to a greater depth from the names at two offsets."""
    x = a * _A
    x ^= b + (a >> np.uint64(29))
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def names(buf: bytes, length: int) -> dict[int, np.ndarray]:
    """Bucket names of all positions at depths 8, 16, ..., and `length`; `buf` has at least `length` bytes."""
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,)).copy()
    eight ^= eight >> np.uint64(31)
    eight *= _B
    eight ^= eight >> np.uint64(29)
    at, depth = {8: eight}, 8
    while 2 * depth <= length:
        at[2 * depth] = _deeper(at[depth][:-depth], at[depth][depth:])
        if depth != GRAM and 4 * depth < length:
            del at[depth]
        depth *= 2
    if depth < length:
        ahead = length - depth
        at[length] = _deeper(at[depth][:-ahead], at[depth][ahead:])
    return at


def _least(key: np.ndarray, reach: int) -> np.ndarray:
    """Minimum over each window of `reach` values, by doubling."""
    step, low = 1, key
    while 2 * step <= reach:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[:len(low) - (reach - step)], low[reach - step:]) if reach > step else low


def runs_of(segments: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Runs of strings with one anchor in every segment: segment, start, off (anchor - start), run (last - start), names."""
    buf = b"".join(segments)
    sizes = np.array([len(s) for s in segments])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = names(buf, length)
    full, gram = at[length], at[GRAM]
    places = np.arange(len(gram), dtype=np.uint64)
    anchor = (_least((gram & ~_PLACE) | places, length - GRAM + 1) & _PLACE).astype(np.int64)
    real = np.zeros(len(full), bool)
    for s, n in zip(starts, sizes):
        real[s:s + max(0, n - length + 1)] = True
    place = np.flatnonzero(real)
    of = np.searchsorted(starts, place, "right") - 1
    new = np.concatenate([[True], (anchor[place[1:]] != anchor[place[:-1]]) | (of[1:] != of[:-1])])
    first = place[new]
    last = place[np.append(np.flatnonzero(new)[1:], len(place)) - 1]
    return {"segment": of[new], "start": first - starts[of[new]], "off": anchor[first] - first, "run": last - first,
            "anchor": gram[anchor[first]].astype(np.int64), "head": full[first].astype(np.int64), "tail": full[last].astype(np.int64)}


RUN = "d1 long, d2 long, start long, off int, run int, anchor long, head long, tail long"


def _runs(length: int, columns: list[str]):
    """The runs of a batch's texts, with the columns of `RUN` asked for."""
    @releasing
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, held, size = batch.column("d1").to_numpy(), batch.column("d2").to_numpy(), [], 0

            def found() -> pa.RecordBatch:
                r = runs_of([s for _, _, s in held], length)
                row = np.array([i for i, _, _ in held])[r["segment"]]
                start = np.array([a for _, a, _ in held])[r["segment"]] + r["start"]
                out = {"d1": one[row], "d2": two[row], "start": start, "off": r["off"].astype(np.int32), "run": r["run"].astype(np.int32),
                       **{c: r[c] for c in ("anchor", "head", "tail")}}
                return pa.RecordBatch.from_arrays([pa.array(out[c]) for c in columns], columns)

            for i, t in enumerate(batch.column("_text")):
                text = t.as_buffer().to_pybytes()
                for a in range(0, len(text) - length + 1, HELD_BYTES):
                    held.append((i, a, text[a:a + HELD_BYTES + length - 1]))
                    size += len(held[-1][2])
                    if size >= HELD_BYTES - length:
                        yield found()
                        held, size = [], 0
            if held:
                yield found()

    return find


PART = "anchor long, block int, core1 long, core2 long, far int, d1 long, d2 long, first long, strings binary"


def _parts(length: int):
    """Cut the wanted runs of a text into blocks by distance to the anchor, with the names of their strings."""
    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d1, d2, text, wanted in zip(*(batch.column(c) for c in ("d1", "d2", "_text", "wanted"))):
                text, d1, d2, held, size, out = text.as_buffer().to_pybytes(), d1.as_py(), d2.as_py(), [], 0, []
                todo = wanted.as_py()
                for k, w in enumerate(todo):
                    held.append((w, size))
                    size += w["run"] + length
                    if size < HELD_BYTES and k + 1 < len(todo):
                        continue
                    at = names(b"".join(text[w["start"]:w["start"] + w["run"] + length] for w, _ in held), length)
                    # What the strings of a block have in common is covered by two names of one depth.
                    full, top, block = at[length], max(d for d in at if d <= length - BLOCK + 1 and d & (d - 1) == 0), BLOCK
                    second = length - block + 1 - top
                    for w, base in held:
                        off, run = w["off"], w["run"]
                        for b in range((off - run) // block, off // block + 1):
                            far, near = min(block * b + block - 1, off), max(block * b, off - run)
                            core, i = base + off - block * b, base + off - far
                            out.append((w["anchor"], b, at[top][core], at[top][core + second], far, w["start"] + off - far,
                                        full[i:i + far - near + 1].tobytes()))
                    held, size = [], 0
                for a in range(0, len(out), 4096):
                    anchor, b, c1, c2, far, first, strings = zip(*out[a:a + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor, pa.int64()), pa.array(b, pa.int32()), pa.array(np.array(c1).astype(np.int64)),
                         pa.array(np.array(c2).astype(np.int64)), pa.array(far, pa.int32()), pa.array([d1] * len(b), pa.int64()),
                         pa.array([d2] * len(b), pa.int64()), pa.array(first, pa.int64()), pa.array(strings, pa.binary())],
                        ["anchor", "block", "core1", "core2", "far", "d1", "d2", "first", "strings"])

    return cut


@releasing
def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per string of a block: its full name, and one of its anchor and distance."""
    for batch in batches:
        raw = batch.column("strings").to_pylist()
        counts = np.array([len(s) // 8 for s in raw], np.int64)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        of = lambda c: np.repeat(batch.column(c).to_numpy(), counts)
        distance = (of("far") - inside).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.frombuffer(b"".join(raw), np.int64)), pa.array(_deeper(of("anchor").astype(np.uint64), distance).astype(np.int64)),
            pa.array(of("d1")), pa.array(of("d2")), pa.array(of("first") + inside)], ["name", "place", "d1", "d2", "start"])


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row is told apart by hashes of its key and of its text, so that repeated or null keys do no harm."""
    return docs.withColumns({"d1": F.xxhash64(F.lit(1), key), "d2": F.xxhash64(F.lit(2), _bytes(text))})


def _seen_twice(df: DataFrame, by: list[str]) -> DataFrame:
    return settle(df.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"))


# A step settles what the next ones read, with `keep`; its other tables go when it ends, as each is about as large as the texts.


def _anchored(texts: DataFrame, length: int) -> DataFrame:
    """Runs whose anchor is seen twice. Runs of short strings are found twice, first their anchors alone, and never kept as a table."""
    with temporaries(texts.sparkSession):
        runs = texts.mapInArrow(_runs(length, [c.split()[0] for c in RUN.split(", ")]), RUN)
        if length < KEPT_FROM:
            again = _seen_twice(texts.mapInArrow(_runs(length, ["anchor"]), "anchor long"), ["anchor"])
        else:
            runs = settle(runs)
            again = _seen_twice(runs, ["anchor"])
        return settle(runs.join(again, "anchor", "left_semi"), keep=True)


def _whole_runs(texts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Stretches that repeated runs cover, and per text the runs that are still to be refined, `wanted`."""
    with temporaries(texts.sparkSession):
        runs = _anchored(texts, length)
        whole = ["anchor", "off", "run", "head", "tail"]
        kinds = settle(runs.groupBy(*whole).agg(F.count("*").alias("n"), F.min(F.struct("d1", "d2", "start")).alias("one")))
        done = settle(runs.join(kinds.filter("n > 1").select(*whole), whole, "left_semi").select(
            "d1", "d2", "start", (F.col("start") + F.col("run") + length).alias("stop")), keep=True)
        # Anchors with a run that is like no other: all their kinds of runs take part, by one example each.
        unsettled = settle(kinds.filter("n = 1").select("anchor").distinct())
        examples = kinds.join(unsettled, "anchor", "left_semi").select("one.*", "anchor", "off", "run")
        wanted = examples.groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "run", "off", "anchor")).alias("wanted"))
        return done, settle(wanted, keep=True)


def _blocks(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Blocks of the wanted runs whose common part is seen twice."""
    with temporaries(texts.sparkSession):
        parts = settle(texts.join(wanted, ["d1", "d2"]).dropDuplicates(["d1", "d2"]).mapInArrow(_parts(length), PART))
        core = ["anchor", "block", "core1", "core2"]
        return settle(parts.join(_seen_twice(parts, core), core, "left_semi").drop("core1", "core2"), keep=True)


def _whole_blocks(texts: DataFrame, wanted: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Stretches that repeated blocks cover, and one block of each kind that is still to be refined."""
    with temporaries(texts.sparkSession):
        alive = _blocks(texts, wanted, length)
        # Blocks with the same strings throughout are repeated as a whole; one of them stands for all against the others.
        block = ["anchor", "block", "far", "strings"]
        equal = settle(alive.groupBy(*block).agg(F.count("*").alias("n"), F.min(F.struct("d1", "d2", "first")).alias("one")))
        last = F.col("first") + F.octet_length("strings") / 8 - 1
        done = settle(alive.join(equal.filter("n > 1").select(*block), block, "left_semi").select(
            "d1", "d2", F.col("first").alias("start"), (last + length).cast("long").alias("stop")), keep=True)
        unlike = settle(equal.filter("n = 1").select("anchor", "block").distinct())
        others = equal.join(unlike, ["anchor", "block"], "left_semi").select("anchor", "far", "strings", "one.*")
        return done, settle(others, keep=True)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row with a repeat: `d1`, `d2` (hashes of key and text) and `spans`, stretches of bytes that repeated strings cover.

    A string counts as repeated when it also starts anywhere else, in the same text too. Spans may overlap.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings of fewer than {2 * GRAM} bytes are not supported")
    texts = _named(docs, key, text).select("d1", "d2", _bytes(text).alias("_text"))
    with temporaries(docs.sparkSession):
        runs, wanted = _whole_runs(texts, length)
        blocks, others = _whole_blocks(texts, wanted, length)
        strings = others.mapInArrow(_strings, "name long, place long, d1 long, d2 long, start long")
        single = settle(strings.join(_seen_twice(strings, ["name", "place"]), ["name", "place"], "left_semi").select(
            "d1", "d2", "start", (F.col("start") + length).alias("stop")))
        spans = F.collect_list(F.struct("start", "stop")).alias("spans")
        return settle(runs.unionByName(blocks).unionByName(single).groupBy("d1", "d2").agg(spans), keep=True)


def _cut():
    kind = pa.struct([("kept", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    @F.arrow_udf("struct<kept: binary, removed: array<struct<start: bigint, stop: bigint>>>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts, spans):
            text, removed, kept, at = text.as_py(), [], [], 0
            for span in sorted((s["start"], s["stop"]) for s in found.as_py() or ()):
                if removed and span[0] <= removed[-1][1]:
                    removed[-1][1] = max(removed[-1][1], span[1])
                else:
                    removed.append(list(span))
            for start, stop in removed:
                kept.append(text[at:start])
                at = stop
            out.append({"kept": b"".join([*kept, text[at:]]), "removed": [{"start": a, "stop": b} for a, b in removed]})
        return pa.array(out, kind)

    return cut


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every row with `kept` (the bytes that are left) and `removed` (maximal stretches of removed bytes, in order).

    Each byte goes that is covered by a string of `length` bytes which also starts anywhere else, in this text or another;
    strings are judged on the input and never cross texts. Null is empty; texts shorter than `length` stay whole. A
    repeated row is another text, so both lose everything that is long enough. Other columns stay; columns called like a result
    are replaced, and `d1`, `d2`, `spans` and names with `_` in front are the operator's. An empty table gives an empty one.
    """
    found = repeats(docs, key, text, length)
    rest = [c for c in docs.columns if c not in ("kept", "removed")]
    both = _named(docs.select(*rest), key, text).join(found, ["d1", "d2"], "left")
    return both.withColumn("_cut", _cut()(_bytes(text), "spans")).select(*rest, "_cut.kept", "_cut.removed")


def as_text():
    """A function from a column of kept bytes to text; what is left of a character that was cut goes. Only such bytes are sent to Python."""
    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        return pa.array([None if b.as_py() is None else b.as_py().decode("utf-8", "ignore") for b in column], pa.string())

    def text(kept: str | Column) -> Column:
        plain = (F.col(kept) if isinstance(kept, str) else kept).cast("string")
        return F.when(F.is_valid_utf8(plain), plain).otherwise(decode(F.when(~F.is_valid_utf8(plain), plain.cast("binary"))))

    return text
