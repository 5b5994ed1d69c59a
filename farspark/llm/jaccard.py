"""Documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

1. Equal sets are one class, named by a hash of the set; only classes are compared.
2. Shingles are dealt by hash range, packed in blocks, and counted: how many classes hold each one. A class that could
   have a partner must share enough of its shingles with anybody; the others are done here, and shingles that only
   one class holds cannot be in an intersection.
3. The rest sort their shared shingles, rare ones first. Two sets that overlap enough have `level` shingles in common within
   prefixes that are `level` longer than the shortest possible. Each class picks its own level: a higher one
   means more lists to read but fewer candidates to verify. A pair has to share the smaller of its two levels, and for two given
   sizes the overlap they need shortens both prefixes, so a shingle only counts where it stands early enough in both sets.
   Shingles with the same holders, as those of a common passage, are one list: they stand side by side in every holder's
   order, and two holders meet there once, with the number of shingles that are early enough in both.
   Each class has a sketch: `SKETCH` bits, each the parity of how many of its shared shingles fall there. Two sets differ in at least
   as many shingles as their sketches in bits, so a pair whose sketches are too far apart is passed over where it meets.
4. Pairs are verified on whole sets. For components a group of copies needs no pair within it: first every class meets one
   leader of its lists, round by round while that links classes; what is then still apart is verified pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from farspark.llm.components import components
from farspark.llm.workers import releasing, releasing_group
from farspark.operators.settle import settle, temporaries

WIDTH = 5
PERCENT = 75
#: Higher levels read more lists: without a limit the list join made 138,877 rows on 51,282 documents, 17,785 with it before lists were merged.
LEVELS = 4
#: What verifying a candidate costs, in list entries read.
VERIFY_COST = 40.0
#: Leader rounds end when no more than this share of the pairs a round verifies are links; each costs jobs, however few classes are left.
LEADER_YIELD = 0.5
#: Bits of a class's sketch, a multiple of 64.
SKETCH = 1024
#: Shingles in one hash range, and shingles a task holds before it writes blocks.
RANGE_TOKENS = 3_000_000
HELD_TOKENS = 500_000
CACHED_WORDS = 150_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _STEP
    return x ^ (x >> np.uint64(31))


def word_hashes() -> dict:
    class Hashes(dict):
        def __missing__(self, word):
            if len(self) >= CACHED_WORDS:
                self.clear()
            value = self[word] = xxhash.xxh3_64_intdigest(word)
            return value

    return Hashes()


def shingles(text: bytes, hashes: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; a shorter text is one shingle, one without words has none."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    value = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        value = value * _STEP + h[i:len(h) - k + 1 + i]
    return np.unique(mixed(value))


def set_key(tokens: np.ndarray) -> int:
    """One 64-bit name of a set of shingles, whatever their order."""
    both = np.array([np.add.reduce(mixed(tokens)), np.bitwise_xor.reduce(tokens), len(tokens)], np.uint64)
    return xxhash.xxh3_64_intdigest(both.tobytes())


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))


def shingle_sets(docs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """`doc` (the key), `n_shingles` and `set_key` (null for an empty set) of every row."""
    @releasing
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            sets = [shingles(t.as_buffer().to_pybytes(), hashes, width) for t in batch.column("_text")]
            names = [np.uint64(set_key(s)).astype(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64())], ["doc", "n_shingles", "set_key"])

    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(name, f"doc {docs.schema[key].dataType.simpleString()}, n_shingles long, set_key long")


BLOCK = "part int, names binary, sizes binary, counts binary, low binary, high binary"
SHARED = "home int, names binary, sizes binary, counts binary, tokens binary, lists binary"
SUSPECT = "name long, n long, shared long, level long, tokens binary, sketch array<long>, starts array<long>, widths array<long>, prefix array<long>"


def _blocks(parts: int, width: int):
    """Deal the shingles of whole texts into hash ranges; a block holds those of many texts in one range."""
    @releasing
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, seen = word_hashes(), [], 0, set()

        def blocks() -> Iterator[pa.RecordBatch]:
            names = np.array([n for n, _ in held], np.uint64)
            sizes = np.array([len(t) for _, t in held], np.uint32)
            tokens = np.concatenate([t for _, t in held])
            owner = np.repeat(np.arange(len(held)), sizes)
            part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            part, owner, tokens = part[order], owner[order], tokens[order]
            edge = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])]))
            counts, runs, of = np.diff(np.append(edge, len(part))).astype(np.uint32), owner[edge], part[edge]
            low, high = (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32), (tokens >> np.uint64(32)).astype(np.uint8)
            cuts, run_cuts = np.searchsorted(part, np.arange(parts + 1)), np.searchsorted(of, np.arange(parts + 1))
            rows = [(p, names[runs[a:b]].tobytes(), sizes[runs[a:b]].tobytes(), counts[a:b].tobytes(), low[i:j].tobytes(), high[i:j].tobytes())
                    for p, (a, b, i, j) in enumerate(zip(run_cuts[:-1], run_cuts[1:], cuts[:-1], cuts[1:])) if b > a]
            for at in range(0, len(rows), 64):
                columns = zip(*rows[at:at + 64])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(columns)],
                    ["part", "names", "sizes", "counts", "low", "high"])

        for batch in batches:
            for t in batch.column("_text"):
                tokens = shingles(t.as_buffer().to_pybytes(), hashes, width)
                name = set_key(tokens) if len(tokens) else None
                if name is None or name in seen:
                    continue
                seen.add(name)
                held.append((name, tokens))
                size += len(tokens)
                if size >= HELD_TOKENS:
                    yield from blocks()
                    held, size, seen = [], 0, set()
        if held:
            yield from blocks()

    return deal


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _edges(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def list_names(holders: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Names of lists that sort by the number of holders: its leading 20 bits as a float, then 44 bits of the holders' sum."""
    leading = holders.astype(np.float32).view(np.uint32) >> np.uint32(12)
    return leading.astype(np.uint64) << np.uint64(44) | mixed(sums) >> np.uint64(20)


def list_lengths(names: np.ndarray) -> np.ndarray:
    """The number of holders a list's name tells, to one part in two thousand."""
    return ((names >> np.uint64(44)).astype(np.uint32) << np.uint32(12)).view(np.float32).astype(np.float64)


def _count(parts: int):
    """Shingles of one hash range that two or more classes hold, with the list of their holders, dealt by class."""
    @releasing_group
    def count(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        names, sizes, counts = _joined(table, "names", np.uint64), _joined(table, "sizes", np.uint32), _joined(table, "counts", np.uint32)
        tokens = _joined(table, "low", np.uint32).astype(np.uint64)
        tokens |= _joined(table, "high", np.uint8).astype(np.uint64) << np.uint64(32)
        once = np.zeros(len(names), bool)
        once[np.unique(names, return_index=True)[1]] = True
        tokens, owner = tokens[np.repeat(once, counts)], np.repeat(np.flatnonzero(once).astype(np.int32), counts[once])
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order]
        del order
        same = tokens[1:] == tokens[:-1]  # most shingles have one holder: they go before anything is computed for each
        shared = np.concatenate([[False], same])
        shared[:-1] |= same
        tokens, owner = tokens[shared], owner[shared]
        at = _edges(tokens)
        holders = np.diff(np.append(at, len(tokens)))
        sums = np.add.reduceat(mixed(names)[owner], at) if len(at) else np.zeros(0, np.uint64)
        lists = np.repeat(list_names(holders, sums), holders)
        tokens |= np.uint64(part & 0xFFFFFF) << np.uint64(40)
        home = (mixed(names) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((owner, home[owner]))
        tokens, owner, lists = tokens[order], owner[order], lists[order]
        runs = _edges(owner)
        of, held = owner[runs], np.diff(np.append(runs, len(owner))).astype(np.uint32)
        homes = home[of]
        first = _edges(homes)
        rows = [(homes[a], names[of[a:b]].tobytes(), sizes[of[a:b]].tobytes(), held[a:b].tobytes(), tokens[i:j].tobytes(), lists[i:j].tobytes())
                for a, b in zip(first, np.append(first[1:], len(of))) for i, j in [(runs[a], runs[b] if b < len(runs) else len(owner))]]
        columns = list(zip(*rows)) or [()] * 6
        return pa.table([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(columns)],
                        names=["home", "names", "sizes", "counts", "tokens", "lists"])

    return count


def least_overlap(n: int, percent: int) -> int:
    """The fewest common shingles a set of n has with a set similar enough."""
    return -(-percent * n // 100)


def choose_level(holders: np.ndarray, first: np.ndarray, n: int, percent: int, levels: int = LEVELS) -> int:
    """The level of least estimated cost for one set; `holders` are its shared shingles' counts, rare first.

    Reading costs what the prefix's lists hold, each read once, at the shingle that is its `first`. A candidate shares `level`
    shingles of the prefix, which bounds how many there are.
    """
    base = len(holders) - least_overlap(n, percent)
    choice = np.arange(1, max(1, min(levels, len(holders) - base)) + 1)
    read, met = (np.cumsum(x)[base + choice - 1] for x in (holders * first, holders))
    return int(choice[np.argmin(read + VERIFY_COST * met / choice)])


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of how many of the tokens fall on each of `SKETCH` bits, as 64-bit words."""
    counts = np.bincount((mixed(tokens) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _prefixes(percent: int):
    """Put the shared shingles of each class together; of those that share enough, sort them and pick level and prefix."""
    @releasing_group
    def order(table: pa.Table) -> pa.Table:
        names, sizes, counts = _joined(table, "names", np.uint64), _joined(table, "sizes", np.uint32), _joined(table, "counts", np.uint32)
        tokens, lists = _joined(table, "tokens", np.uint64), _joined(table, "lists", np.uint64)
        own, first, of = np.unique(names, return_index=True, return_inverse=True)
        held = np.bincount(np.repeat(of, counts), minlength=len(own))
        enough = held * 100 >= sizes[first].astype(np.int64) * percent
        of = np.repeat(of, counts)
        stays = enough[of]
        tokens, lists, of = tokens[stays], lists[stays], of[stays]
        rank = np.lexsort((tokens, lists, of))
        tokens, lists, of = tokens[rank], lists[rank], of[rank]
        cuts, out = np.append(_edges(of), len(of)), []
        for i, j in zip(cuts[:-1], cuts[1:]):
            n, mine = int(sizes[first[of[i]]]), lists[i:j]
            starts = _edges(mine)
            widths, begins = np.diff(np.append(starts, j - i)), np.zeros(j - i)
            begins[starts] = 1
            level = choose_level(list_lengths(mine), begins, n, percent)
            read = starts < j - i - least_overlap(n, percent) + level
            out.append((own[of[i]].astype(np.int64), n, j - i, level, np.sort(tokens[i:j]).tobytes(), sketch(tokens[i:j]),
                        starts[read], widths[read], mine[starts[read]].astype(np.int64)))
        columns = list(zip(*out)) or [()] * 9
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 4]
        names = ["name", "n", "shared", "level", "tokens", "sketch", "starts", "widths", "prefix"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return order


def suspects(docs: DataFrame, text: str, total: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Classes that share enough shingles with others to have a partner.

    Columns: name, n, how many shingles are `shared`, level, the shared tokens with their sketch, and the prefix of these in the order of lists:
    the lists' names, where each starts and how many shingles it has.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_TOKENS))
    blocks = _texts(docs, text).mapInArrow(_blocks(parts, width), BLOCK)
    shared = blocks.groupBy("part").applyInArrow(_count(parts), SHARED)
    return settle(shared.groupBy("home").applyInArrow(_prefixes(percent), SUSPECT))


def _common():
    @F.arrow_udf("long")
    def size(a: pa.Array, b: pa.Array) -> pa.Array:
        read = lambda x: np.frombuffer(x.as_py(), np.uint64)
        return pa.array([len(np.intersect1d(read(x), read(y), assume_unique=True)) for x, y in zip(a, b)], pa.int64())

    return size


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of candidate pairs (a, b) those similar enough, with their `common` shingles."""
    side = lambda s: sets.select(F.col("name").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"tokens_{s}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    return both.withColumn("common", _common()("tokens_a", "tokens_b")).filter(F.col("common") * 100 >= union * percent).select("a", "b", "common")


SIZES = ("n", "shared", "level", "position", "width")


def _need(percent: int) -> Column:
    """The fewest common shingles of two sets similar enough."""
    return F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))


def _near(percent: int) -> Column:
    """Whether the sketches of two sets are near enough for the overlap that their sizes need."""
    apart = reduce(add, (F.bit_count(F.col(f"bits_a{i}").bitwiseXOR(F.col(f"bits_b{i}"))) for i in range(SKETCH // 64)))
    return apart <= F.col("shared_a") + F.col("shared_b") - 2 * _need(percent)


def _early(percent: int) -> Column:
    """How many common shingles of a list stand early enough in both sets for the overlap that their sizes need."""
    need = _need(percent)
    last = F.least("level_a", "level_b") - need
    early = F.least(F.col("n_a") + last - F.col("position_a"), F.col("n_b") + last - F.col("position_b"), "width_a", "width_b")
    return F.when(F.least("shared_a", "shared_b") >= need, early).otherwise(0)


def _candidates(rows: DataFrame) -> DataFrame:
    """Pairs that share as many early shingles as the smaller level; `rows` has one row per pair and list, with its `early`."""
    counted = rows.groupBy("a", "b").agg(F.first(F.least("level_a", "level_b")).alias("least"), F.sum("early").alias("hits"))
    return counted.filter(F.col("hits") >= F.col("least"))


def _all_pairs(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidates between different groups: per list, members outside its largest group meet all of other groups, if sketches are near."""
    sizes = index.groupBy("token", "group").count()
    largest = sizes.groupBy("token").agg(F.max(F.struct("count", "group"))["group"].alias("main"))
    marked = settle(index.join(largest, "token").join(sets.select("name", "sketch"), "name"))
    side = lambda s: [*(F.col(c).alias(f"{c}_{s}") for c in (*SIZES, "group")),
                      *(F.col("sketch")[i].alias(f"bits_{s}{i}") for i in range(SKETCH // 64))]
    few = marked.filter(F.col("group") != F.col("main")).select("token", F.col("name").alias("a"), *side("a"))
    rest = marked.select(F.col("token").alias("_token"), "main", F.col("name").alias("b"), *side("b"))
    apart = (F.col("group_a") != F.col("group_b")) & ((F.col("group_b") == F.col("main")) | (F.col("a") < F.col("b")))
    met = few.join(rest, (F.col("token") == F.col("_token")) & apart & (_early(percent) > 0) & _near(percent)).withColumn("early", _early(percent))
    # Which of two classes is outside the largest group changes from list to list; hits of a pair are counted together.
    return _candidates(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "level_a", "level_b", "early"))


def _index(sets: DataFrame) -> DataFrame:
    """The lists: a row per class and list of its prefix, with its place among all of the set's shingles, unshared ones first."""
    each = F.inline(F.arrays_zip(F.col("starts").alias("_at"), F.col("widths").alias("width"), F.col("prefix").alias("token")))
    rows = sets.select("name", "n", "shared", "level", each.alias("_at", "width", "token"))
    return rows.select("name", "n", "shared", "level", (F.col("n") - F.col("shared") + F.col("_at")).alias("position"), "width", "token")


def similar_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Every link between different sets: `a` and `b` (set keys as in `shingle_sets`), `common` shingles. Exact."""
    total = shingle_sets(docs, key, text, width).agg(F.sum("n_shingles")).first()[0] or 0
    sets = suspects(docs, text, total, width, percent)
    pairs = _all_pairs(settle(_index(sets).withColumn("group", F.col("name"))), sets, percent)
    return verified(pairs, sets, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common")


def linked_groups(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`name` and `root` of all classes that a chain of links joins to another one."""
    index = settle(_index(sets).withColumn("group", F.col("name")))
    groups, turn, leaders = None, 0, True
    while True:
        # A list is led by the class with the fewest shingles of its own, as it is nearest to all, and by a random one, which changes.
        whole, random = F.struct("name", *SIZES, "group"), F.xxhash64("name", F.lit(turn))
        lists = index.groupBy("token").agg(
            F.min("group").alias("_least"), F.max("group").alias("_most"),
            F.array(F.min_by(whole, F.struct(F.col("n") - F.col("shared"), random)), F.min_by(whole, random)).alias("_leaders")).filter("_least <> _most")
        index = settle(index.join(lists.drop("_least", "_most"), "token"))
        if index.isEmpty():
            break
        if leaders:
            met = index.withColumn("_leader", F.explode(F.array_distinct("_leaders"))).filter(F.col("group") != F.col("_leader.group")).select(
                F.col("name").alias("a"), F.col("_leader.name").alias("b"), *(F.col(c).alias(f"{c}_a") for c in SIZES),
                *(F.col(f"_leader.{c}").alias(f"{c}_b") for c in SIZES)).withColumn("early", _early(percent)).filter("early > 0")
            pairs = _candidates(met).groupBy("a").agg(F.max_by("b", F.struct("hits", "b")).alias("b"))
        else:
            pairs = _all_pairs(index.drop("_leaders"), sets, percent)
        pairs = settle(pairs.select("a", "b"))
        links = settle(verified(pairs, sets, percent))
        last, turn, leaders = not leaders, turn + 1, leaders and links.count() > LEADER_YIELD * pairs.count()
        index = index.drop("_leaders")
        if links.isEmpty():
            if last:
                break
            continue
        if groups is not None:
            old = lambda s: groups.select(F.col("name").alias(s), F.col("root").alias(f"_{s}"))
            links = links.join(old("a"), "a", "left").join(old("b"), "b", "left").select(
                F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        moved = settle(components(links))
        if groups is None:
            groups = moved.select(F.col("node").alias("name"), "root")
        else:
            step = moved.select(F.col("node").alias("name"), F.col("root").alias("_to"))
            known = groups.join(step.withColumnRenamed("name", "root"), "root", "left").select("name", F.coalesce("_to", "root").alias("root"))
            new = step.join(groups, "name", "left_anti").select("name", F.col("_to").alias("root"))
            groups = settle(known.unionByName(new))
        if last:
            break
        now = groups.select("name", F.col("root").alias("_root"))
        index = settle(index.join(now, "name", "left").withColumn("group", F.coalesce("_root", "group")).drop("_root"))
    return groups if groups is not None else sets.select("name", F.col("name").alias("root")).limit(0)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: key, `n_shingles` and `component_id`, the smallest key that links reach.

    Texts are lower-cased in A-Z and split at ASCII white space. A text of fewer words than `width` is one shingle; a null or
    empty one has none and links with nothing. Equal sets are linked; others link when 100 * common >= percent * union.
    Repeated rows each keep their row. A null key never names a component that has another; other columns are
    ignored; an empty table gives an empty one. Sets and shingles are told apart by 64-bit and, within a hash range, 40-bit hashes.
    """
    sets = settle(shingle_sets(docs, key, text, width))
    with temporaries(docs.sparkSession):
        total = sets.agg(F.sum("n_shingles")).first()[0] or 0
        classes = settle(sets.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc").alias("first")))
        groups = settle(linked_groups(suspects(docs, text, total, width, percent), percent))
        rooted = classes.join(groups, F.col("set_key") == F.col("name"), "left").withColumn("root", F.coalesce("root", "set_key"))
        smallest = settle(rooted.filter(F.col("name").isNotNull()).groupBy("root").agg(F.min("first").alias("least")))
        named = settle(rooted.join(smallest, "root", "left").select("set_key", F.coalesce("least", "first").alias("component_id")), keep=True)
    return sets.join(named, "set_key", "left").select(
        F.col("doc").alias(key), "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))
