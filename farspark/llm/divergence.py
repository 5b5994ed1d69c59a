"""Source divergence audit: how the use of words of each source of a language differs from the other sources and the whole.

The first pass over the texts counts exactly how many documents of a language hold each term. Terms in enough documents are kept, dealt
into shards of a language, and each shard becomes a minimal perfect hash with its keys. The second pass recounts: the
shards are broadcast, in rounds of bounded size, and a task raises one dense counter per kept term and group. Everything
after works on a row per group and term that occurs in it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from farspark.llm import perfect_hash as ph
from farspark.operators.settle import settle

SCALE = 1_000_000_000
PRIOR = 5
#: Keys of a shard, on average.
SHARD_KEYS = 1 << 15
#: Bytes of shards broadcast at once; with more, the texts are read once more for each further round.
ROUND_BYTES = 1 << 25
#: Bytes of counters a task holds, and of text it walks at once.
DENSE_BYTES = 1 << 27
BLOCK_BYTES = 1 << 21
#: Terms a task of the first pass holds before it hands on what it has.
HELD_TERMS = 200_000
#: Numbers in the matrix of one cell of terms by all sources of a language.
CELL_VALUES = 1 << 15

_LETTER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of terms stay, capitals become small, all others become spaces. Beyond ASCII every byte belongs to a term.
_TABLE = bytes(b + 32 if b in _LETTER else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
KEY = ["lang", "source"]


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A text of terms and spaces in pieces of about `size` bytes that cut no term."""
    at = 0
    while at < len(text):
        stop = text.find(b" ", at + size)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop]
        at = stop


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text").cast(pa.large_binary()):
        yield value.as_py().translate(_TABLE)


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs): in how many documents of the language a term occurs, counted in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang, counter in held.items():
                terms = pa.array(list(counter), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counter), pa.string()), terms, pa.array(list(counter.values()), pa.int64())], names=["lang", "term", "docs"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch)):
                seen: set[bytes] = set()
                for piece in _pieces(text, BLOCK_BYTES):
                    seen.update(piece.split())
                held.setdefault(lang, Counter()).update(seen)
                if sum(map(len, held.values())) >= HELD_TERMS:
                    yield from handed_on()
        yield from handed_on()

    found = docs.select("lang", "text").mapInArrow(count, "lang string, term string, docs bigint")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


@F.arrow_udf(T.LongType())
def _term_hash(terms: pa.Array) -> pa.Array:
    """What deals a term into a shard, here and in the recount; not negative."""
    _, words = ph.of_list([t.as_py() for t in terms.cast(pa.large_binary())])
    return pa.array((words.hashes() >> np.uint64(1)).astype(np.int64), pa.int64())


def build_shards(kept: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(lang, shard, of, blob): the kept terms of each language as perfect hashes. `of` is the language's number of shards."""
    sizes = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / shard_keys).cast("bigint").alias("of"))
    dealt = kept.join(sizes, "lang").withColumn("shard", F.pmod(_term_hash("term"), F.col("of")))

    def one(group: pa.Table) -> pa.Table:
        blob = ph.build([t.as_py() for t in group.column("term").cast(pa.large_binary())])
        first = {c: [group.column(c)[0].as_py()] for c in ("lang", "shard", "of")}
        return pa.table([pa.array(first["lang"], pa.string()), pa.array(first["shard"], pa.int64()), pa.array(first["of"], pa.int64()),
                         pa.array([blob], pa.binary())], names=["lang", "shard", "of", "blob"])

    return dealt.groupBy("lang", "shard").applyInArrow(one, "lang string, shard bigint, of bigint, blob binary")


def _slot(shard: int, inside: np.ndarray) -> np.ndarray:
    return (shard << 32) + inside


def slot_terms(shards: DataFrame) -> DataFrame:
    """(lang, slot, term) of all shards."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                terms = pa.array(ph.stored_keys(row["blob"]), pa.binary()).cast(pa.string())
                slots = _slot(row["shard"], np.arange(len(terms)))
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(terms), pa.string()), pa.array(slots, pa.int64()), terms],
                                                 names=["lang", "slot", "term"])

    return shards.select("lang", "shard", "blob").mapInArrow(spell, "lang string, slot bigint, term string")


class _Index:
    """The shards of one language that take part in a round; counters of all of them stand side by side."""

    def __init__(self, of: int, shards: dict[int, bytes]):
        self.of = of
        self.shards = {shard: ph.load(blob) for shard, blob in sorted(shards.items())}
        starts = np.cumsum([0, *(s.n for s in self.shards.values())])
        self.starts, self.n = dict(zip(self.shards, starts.tolist())), int(starts[-1])
        self.names = np.concatenate([_slot(k, np.arange(s.n)) for k, s in self.shards.items()])
        self.largest = max(s.largest for s in self.shards.values())

    def counters(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(place in `data`, counter) of each kept term's occurrence."""
        flags = np.concatenate([[False], np.frombuffer(data, dtype=np.uint8) != 0x20, [False]])
        edges = np.flatnonzero(flags[1:] != flags[:-1])
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        short = sizes <= self.largest
        words = ph.Words(data, starts[short], sizes[short])
        home = (words.hashes() >> np.uint64(1)).astype(np.int64) % self.of
        out = np.full(len(home), -1, dtype=np.int64)
        for shard, made in self.shards.items():
            rows = np.flatnonzero(home == shard)
            mine = ph.Words(data, words.starts[rows], words.sizes[rows])
            slots = made.slots(mine, mine.hashes(made.seed))
            out[rows[slots >= 0]] = self.starts[shard] + slots[slots >= 0]
        hit = out >= 0
        return words.starts[hit], out[hit]


def recount(docs: DataFrame, shards: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(lang, source, slot, n): how often each kept term occurs in each group, where it does."""
    spark = docs.sparkSession
    # One row per shard of some 32,000 terms; the blobs stay where they are but for those of a round.
    sizes = shards.select("lang", "shard", F.octet_length("blob").alias("size")).orderBy("lang", "shard").collect()
    rounds: list[list] = []
    for row in sizes:
        if not rounds or sum(r["size"] for r in rounds[-1]) + row["size"] > round_bytes:
            rounds.append([])
        rounds[-1].append(row)
    name = F.struct("lang", "shard")
    out = None
    for chosen in rounds:
        first, last = (F.struct(F.lit(r["lang"]).alias("lang"), F.lit(r["shard"]).alias("shard")) for r in (chosen[0], chosen[-1]))
        parts: dict[str, tuple[int, dict[int, bytes]]] = {}
        for row in shards.filter((name >= first) & (name <= last)).collect():
            parts.setdefault(row["lang"], (row["of"], {}))[1][row["shard"]] = bytes(row["blob"])
        shared = spark.sparkContext.broadcast(parts)
        found = settle(_recount_round(docs, shared))
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "lang string, source string, slot bigint, n bigint")
    return out


def _recount_round(docs: DataFrame, shared) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = {lang: _Index(of, blobs) for lang, (of, blobs) in shared.value.items()}
        dense: dict[tuple[str, str], np.ndarray] = {}
        waiting: dict[str, list[tuple[str, bytes]]] = {}
        held = 0

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), counters in dense.items():
                some = np.flatnonzero(counters)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                     pa.array(indexes[lang].names[some], pa.int64()), pa.array(counters[some], pa.int64())], names=["lang", "source", "slot", "n"])
            dense.clear()

        def raised() -> Iterator[pa.RecordBatch]:
            """Count what waits. Terms of one source stand together, so each source's counters are raised at once."""
            for lang, parts in waiting.items():
                index = indexes[lang]
                parts.sort(key=lambda p: p[0])
                stops = np.cumsum([len(text) + 1 for _, text in parts])
                places, counters = index.counters(b" ".join(text for _, text in parts))
                owner = np.searchsorted(stops, places, side="right")
                ends = np.searchsorted(owner, np.arange(len(parts)), side="right")
                begin = 0
                for i, (source, _) in enumerate(parts):
                    if i + 1 < len(parts) and parts[i + 1][0] == source:
                        continue
                    mine, begin = counters[begin : ends[i]], int(ends[i])
                    if not len(mine):
                        continue
                    if (lang, source) not in dense:
                        if sum(c.nbytes for c in dense.values()) + 8 * index.n > DENSE_BYTES:
                            yield from handed_on()
                        dense[lang, source] = np.zeros(index.n, dtype=np.int64)
                    np.add.at(dense[lang, source], mine, 1)
            waiting.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), _texts(batch)):
                if lang not in indexes:
                    continue
                for piece in _pieces(text, BLOCK_BYTES):
                    waiting.setdefault(lang, []).append((source, piece))
                    held += len(piece)
                    if held >= BLOCK_BYTES:
                        yield from raised()
                        held = 0
        yield from raised()
        yield from handed_on()

    found = docs.select(*KEY, "text").mapInArrow(count, "lang string, source string, slot bigint, n bigint")
    return found.groupBy(*KEY, "slot").agg(F.sum("n").alias("n"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR kept)), in whole numbers of any size."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", whole(n + PRIOR) * F.lit(SCALE), whole(total + F.lit(PRIOR) * kept))


def _pairs(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): summed differences of every two sources of a language, by cells of its terms.

    A cell holds all sources of a language at some of its terms, `CELL_VALUES` numbers or one term; its result is a row per two sources.
    """
    many = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("_sources"), F.max("kept").alias("_kept"))
    width = F.greatest(F.lit(1), F.floor(F.lit(CELL_VALUES) / F.col("_sources")))
    cells = many.select("lang", F.greatest(F.lit(1), F.ceil(F.col("_kept") / width)).cast("bigint").alias("_cells"))
    left = counted.join(cells, "lang").select(
        "lang", F.pmod(F.xxhash64("slot"), F.col("_cells")).alias("cell"), "source", "slot", "p")
    none = F.when(F.col("kept") > 0, _share(F.lit(0).cast("bigint"), F.col("total"), F.col("kept")))
    right = groups.join(cells, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_cells") - 1)).alias("cell"), "source", none.alias("p0"))

    def differences(rows: pa.Table, sources: pa.Table) -> pa.Table:
        sources = sources.sort_by("source")
        names = sources.column("source").combine_chunks()
        at = pc.index_in(rows.column("source"), value_set=names).to_numpy()
        slots, place = np.unique(rows.column("slot").to_numpy(), return_inverse=True)
        matrix = np.repeat(pc.fill_null(sources.column("p0"), 0).to_numpy()[:, None], len(slots), axis=1)
        matrix[at, place] = rows.column("p").to_numpy()
        n = len(names)
        one, two, value = [], [], []
        for i in range(n - 1):
            one.append(np.full(n - 1 - i, i))
            two.append(np.arange(i + 1, n))
            value.append(np.abs(matrix[i + 1 :] - matrix[i]).sum(axis=1))
        flat = lambda x: np.concatenate(x) if x else np.empty(0, dtype=np.int64)
        lang = pa.array([sources.column("lang")[0].as_py()] * len(flat(one)), pa.string())
        return pa.table([lang, names.take(pa.array(flat(one))), names.take(pa.array(flat(two))), pa.array(flat(value), pa.int64())],
                        names=["lang", "a", "b", "value"])

    # Every language and cell has its sources on the right, so no group is without them.
    parts = left.groupBy("lang", "cell").cogroup(right.groupBy("lang", "cell")).applyInArrow(differences, "lang string, a string, b string, value bigint")
    both = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return both.select("lang", sides.alias("s"), "value").select("lang", "s.source", "s.item", "value")


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, shard_keys: int = SHARD_KEYS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of (lang, source) that occurs.

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z as a-z. A language keeps the terms in at least
    `least_docs` of its documents. A term's share in a group or language is 1 + floor(10^9 (count + 5) / (all counts of kept terms + 5 kept
    terms)), in whole numbers. Part `pair` ranks the other sources of the language by the summed differences of shares over
    all kept terms (0 without any), part `term` the `top` kept terms that occur in the group with a larger share than in the
    language, by the difference. Ties go to the smaller item in bytes.

    Null text, lang and source count as empty strings. Repeated rows are documents of their own; a text of any length is counted whole.
    Only `lang`, `source` and `text` are read. An empty table gives no rows, and a language with one source no pairs.
    """
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in (*KEY, "text")))
    kept = settle(document_counts(docs).filter(F.col("docs") >= least_docs).select("lang", "term"))
    shards = settle(build_shards(kept, shard_keys))
    counts = settle(recount(docs, shards, round_bytes))

    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = counts.groupBy(*KEY).agg(F.sum("n").alias("total"))
    groups = settle(docs.select(*KEY).distinct().join(of_lang, "lang", "left").join(totals, KEY, "left").fillna(0, ["kept", "total"]))
    of_lang = groups.groupBy("lang").agg(F.max("kept").alias("kept"), F.sum("total").alias("lang_total"))
    shared = counts.withColumn("lang_n", F.sum("n").over(W.partitionBy("lang", "slot")))
    counted = settle(shared.join(groups.select(*KEY, "total"), KEY).join(of_lang, "lang").select(
        *KEY, "slot", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")))

    rank = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("value"), "item"))
    pairs = _pairs(counted.select(*KEY, "slot", "p"), groups).withColumn("rank", rank)
    above = counted.filter(F.col("p") > F.col("q")).join(slot_terms(shards), ["lang", "slot"])
    # Each task keeps its own `top` rows of a group before the shuffle.
    terms = above.select(*KEY, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", rank).filter(F.col("rank") <= top)
    part = lambda df, name: df.select(*KEY, F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(terms, "term"))
