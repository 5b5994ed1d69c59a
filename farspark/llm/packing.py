"""Best-fit packing of pieces into sequences by exact complements.

How many pieces there are of each length is all a plan needs, and a length is at most the capacity. So the driver
gets one count per length, however large the corpus is, and turns it into *patterns*: a list of lengths that share a
sequence, and how often. A pattern opens with the longest length left and looks for lengths that fill the gap
exactly, in the indexes of single, pair and triple sums of what is available; when none does, the longest length
that fits goes in and the search is repeated. A pattern is used as often as its lengths last, so each one uses up a
length and there are at most a few times as many patterns as lengths.

Pieces are then numbered within their length, and a number falls into the run of one pattern.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farspark.llm.tables import cells_for, running_total, vocabulary
from farspark.llm.workers import releasing
from farspark.operators.settle import settle

CAPACITY = 1024
#: Texts of these characters are split alike by both encoders of the byte-level vocabulary; all others, and texts with a
#: special token's string, go to the reference encoder.
_PLAIN = r"[^\x00-ɏ]|<\|"


def _complement(have: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that sum to `gap`, the longest first; `have` counts pieces by length."""
    if have[gap]:
        return [gap]
    there = (have[:gap + 1] > 0).astype(np.int64)
    pairs = np.convolve(there, there)[:gap + 1]
    pairs[2 * np.flatnonzero(have[:gap // 2 + 1] == 1)] -= 1  # a length used twice needs two pieces

    def pair(total: int, left: np.ndarray) -> list[int] | None:
        first = np.arange(total // 2, total)
        good = first[(left[first] > 0) & (left[total - first] > 0) & ((2 * first != total) | (left[first] > 1))]
        return [int(good[-1]), total - int(good[-1])] if good.size else None

    if pairs[gap] > 0 and (found := pair(gap, have)):
        return found
    for first in np.flatnonzero(there[1:gap - 1])[::-1] + 1:
        if pairs[gap - first] > 0:
            have[first] -= 1
            rest = pair(gap - int(first), have)
            have[first] += 1
            if rest:
                return [int(first), *rest]
    return None


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many sequences each makes, for `counts` pieces by length (1 to `capacity`)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a sequence of {capacity}")
        left[length] = n
    patterns = []
    while left.any():
        bin_, have, gap = [int(np.flatnonzero(left)[-1])], left.copy(), capacity
        gap -= bin_[0]
        have[bin_[0]] -= 1
        while gap:
            take = _complement(have, gap)
            if take is None:
                fits = np.flatnonzero(have[:gap + 1])
                if not fits.size:
                    break
                take = [int(fits[-1])]
            for length in take:
                have[length] -= 1
                gap -= length
            bin_ += take
        uses = Counter(bin_)
        times = min(int(left[length]) // k for length, k in uses.items())
        for length, k in uses.items():
            left[length] -= k * times
        patterns.append((bin_, times))
    return patterns


def runs(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end number, pieces of that length in a sequence, first sequence, offset) of every run."""
    out, numbered, sequence = [], Counter(), 0
    for lengths, times in patterns:
        offset = 0
        for length, k in Counter(lengths).items():
            start = numbered[length]
            numbered[length] = start + k * times
            out.append((length, start, numbered[length], k, sequence, offset))
            offset += k * length
        sequence += times
    return out


def pack(pieces: DataFrame, key: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to every piece, in as few sequences of `capacity` as the patterns allow.

    `key` orders pieces of one length and should tell them apart; equal rows may swap places. Places in a sequence
    have no gaps from 0 on. A piece with a null length or one below 1 holds nothing and gets null for both; a piece longer
    than `capacity` is an error. Other columns stay; columns called like a result are replaced, and names that start
    with `_` are the operator's. An empty table gives an empty one.
    """
    pieces = settle(pieces.drop("sequence_id", "offset"))
    real = F.col(length) >= 1
    counts = {r[length]: r["count"] for r in pieces.filter(real).groupBy(length).count().toLocalIterator()}
    spark = pieces.sparkSession
    cells = cells_for(max(counts.values(), default=0))
    numbered = running_total(
        pieces.filter(real).withColumn("_cell", F.pmod(F.xxhash64(*key), F.lit(cells))), [length], "_cell", key, F.lit(1), "_number")
    rows = {}
    for n, *run in runs(plan(counts, capacity)):
        rows.setdefault(n, []).append(tuple(run))
    # At most `capacity` rows, so the broadcast does not grow with the data.
    places = spark.createDataFrame(
        list(rows.items()), "_length long, _runs array<struct<start: long, stop: long, k: long, sequence: long, offset: long>>")
    run = F.filter("_runs", lambda r: (r["start"] <= F.col("_number")) & (F.col("_number") < r["stop"]))[0]
    placed = (numbered.join(F.broadcast(places), F.col(length) == F.col("_length"))
              .withColumn("_run", run)
              .withColumn("_at", F.col("_number") - F.col("_run.start"))
              .withColumn("sequence_id", F.col("_run.sequence") + F.expr("_at div _run.k"))
              .withColumn("offset", F.col("_run.offset") + F.col("_at") % F.col("_run.k") * F.col(length).cast("long")))
    empty = pieces.filter(~F.coalesce(real, F.lit(False))).withColumns(
        {"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    return placed.select(*pieces.columns, "sequence_id", "offset").unionByName(empty)


def byte_encoder(path: str, end_id: int | None):
    """An Arrow function from texts to their ids, as little-endian unsigned 32-bit numbers, then `end_id`.

    `path` names a `tokenizers` file. Where a rank file of the same vocabulary lies beside it (`.tiktoken`), plain
    texts are encoded through that, which gives the same ids several times faster.
    """

    @F.arrow_udf("binary")
    @releasing
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import base64
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        full = vocabulary(path)
        exact = Tokenizer.from_file(full)
        ranks = os.path.splitext(full)[0] + ".tiktoken"
        fast = None
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        special = re.compile(_PLAIN)
        end = [] if end_id is None else [end_id]
        for column in batches:
            out = []
            for scalar in column:
                text = scalar.as_py() or ""
                if fast is not None and not special.search(text):
                    ids = fast.encode_ordinary(text)
                else:
                    ids = exact.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids + end, "<u4").tobytes())
            yield pa.array(out, pa.binary())

    return encode


def token_pieces(docs: DataFrame, path: str, text: str = "text", end_id: int | None = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: its columns but the text, and `piece`, `start`, `length`, `ids`.

    Documents longer than `capacity` are cut into pieces of that length, of which the first takes what is left over.
    `ids` holds little-endian unsigned 32-bit numbers. A null text is empty, which leaves only `end_id`; without one, an
    empty text has one piece of length 0.
    """
    ids = docs.withColumn("_ids", byte_encoder(path, end_id)(F.coalesce(F.col(text), F.lit("")))).drop(text)
    n = F.expr("octet_length(_ids) div 4")
    first = F.when(n % capacity == 0, F.least(n, F.lit(capacity))).otherwise(n % capacity)
    sized = ids.withColumns({"_n": n.cast("long"), "_first": first.cast("long")})
    last = F.expr(f"(_n - _first) div {capacity}")
    out = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    out = out.withColumn("start", F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("_first") + (F.col("piece") - 1) * capacity).cast("long"))
    out = out.withColumn("length", F.when(F.col("piece") == 0, F.col("_first")).otherwise(capacity).cast("long"))
    return out.withColumn("ids", F.expr("substring(_ids, cast(4 * start + 1 as int), cast(4 * length as int))")).drop("_ids", "_n", "_first")


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """The packed sequences themselves: `sequence_id`, `length` and `ids`, the pieces' ids one after the other."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex(ids).alias("ids"))))
    return (packed.filter(F.col("sequence_id").isNotNull()).groupBy("sequence_id")
            .agg(F.sum("length").alias("length"), F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("ids")))
