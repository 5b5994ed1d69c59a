"""Token counts: texts are encoded in batches inside an Arrow function that hands back lengths only.

Batches hold about `BATCH_BYTES` of text, whatever the number of rows. A longer text is cut where no piece of the
vocabulary can cross: in front of a space that follows another character. The encoder puts a space in front of every
input, so the cut space is left out and the counts of the parts add up to the count of the text. A part without such
a place stays whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from farspark.llm.tables import vocabulary

BATCH_BYTES = 1 << 20
PART_CHARS = 1 << 16
SPACE = "▁"
_CUT = re.compile(f"(?<=[^ {SPACE}]) (?=.)", re.DOTALL)


def parts(text: str, part_chars: int = PART_CHARS) -> list[str]:
    """`text` in parts of at least `part_chars` characters whose token counts add up to that of the whole."""
    out, start = [], 0
    while len(text) - start > part_chars:
        cut = _CUT.search(text, start + part_chars)
        if cut is None:
            break
        out.append(text[start:cut.start()])
        start = cut.start() + 1
    out.append(text[start:])
    return out


def check_pieces(pieces: list[str]) -> None:
    """Refuse a vocabulary with a piece that has a space after another character: cuts would not be safe."""
    crossing = [p for p in pieces if SPACE in p.lstrip(SPACE)]
    if crossing:
        raise ValueError(f"pieces cross a word boundary, e.g. {crossing[0]!r}")


def piece_counter(path: str, batch_bytes: int = BATCH_BYTES, part_chars: int = PART_CHARS):
    """An Arrow function from a column of texts to token counts by the sentence-piece model at `path`."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(path))
        check_pieces([model.id_to_piece(i) for i in range(model.get_piece_size())])
        for column in batches:
            totals = [0] * len(column)
            texts: list[str] = []
            owners: list[int] = []
            held = 0

            def flush() -> None:
                nonlocal held
                for row, ids in zip(owners, model.encode(texts, num_threads=1)):
                    totals[row] += len(ids)
                texts.clear()
                owners.clear()
                held = 0

            for row, scalar in enumerate(column):
                for part in parts(scalar.as_py() or "", part_chars):
                    texts.append(part)
                    owners.append(row)
                    held += len(part)
                    if held >= batch_bytes:
                        flush()
            flush()
            yield pa.array(totals, pa.int64())

    return count


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 4096, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Add `n_bytes` (UTF-8), `n_tokens` and `over_limit` (more than `limit` tokens) to every row.

    No begin, end or other special token is counted, and nothing is cut off. A null text counts as empty: 0 bytes, 0
    tokens. Each row is counted by itself, so repeated rows and ties repeat their result, other columns stay, and an
    empty table gives an empty one. A column already called like a result is replaced.
    """
    value: Column = F.coalesce(F.col(text), F.lit(""))
    counted = df.withColumns({"n_bytes": F.octet_length(value).cast("long"), "n_tokens": piece_counter(path, batch_bytes)(value)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
