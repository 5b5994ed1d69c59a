"""Secret scans: all rules in one pass over the bytes, by a combined deterministic automaton.

The rules are mirrored, and the texts of a batch are read backwards, once, by the minimal automaton of all of them. Its state
after a byte says which rules have a match that starts at that byte. From the few such places the rule's own automaton
walks forward to the end of its longest match; matches of a rule that start inside one of its earlier matches are passed
over, and too short ones are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from farspark.llm.automaton import Automaton, backwards, compile_rules, longest, parse, states_after


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `head` comes first, `body` after it; the body must have `least` characters.

    No head's longest match may keep the body from matching where a shorter one would let it, and the whole rule must match
    one way only; then the longest match is that of a backtracking search too.
    """

    kind: str
    head: str
    body: str
    least: int


def either_case(pattern: str) -> str:
    """ASCII letters outside of escapes match in both cases. Not for patterns with classes."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)


#: The kinds that always count, in order. A run of hex digits is one match, so its length is part of the pattern.
BASE = (
    Rule("assign", either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 8),
    Rule("access", "", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "", "[0-9a-f]{32,}", 32),
)
#: Formats of keys and tokens that issuers have published.
MORE = (
    Rule("private-key", "-----BEGIN ", "(RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY( BLOCK)?-----", 16),
    Rule("github", "(ghp|gho|ghu|ghs|ghr)_", "[A-Za-z0-9]+", 36),
    Rule("github-fine", "github_pat_", "[A-Za-z0-9_]+", 60),
    Rule("gitlab", "glpat-", "[A-Za-z0-9_-]+", 20),
    Rule("slack", "xox[abeoprs]-", "[A-Za-z0-9-]+", 24),
    Rule("google", "", "AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", "(sk|rk)_(live|test)_", "[A-Za-z0-9]+", 24),
    Rule("npm", "npm_", "[A-Za-z0-9]+", 36),
    Rule("pypi", "pypi-AgE", "[A-Za-z0-9_-]+", 50),
    Rule("sendgrid", r"SG\.", r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 60),
    Rule("session", "", "ASIA[A-Z0-9]+", 20),
    Rule("web-token", "", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("bearer", either_case("authorization:") + r"\x20*" + either_case("bearer") + r"\x20+", "[A-Za-z0-9+/_.=~-]+", 16),
    Rule("address", "(https?|ftp|postgres(ql)?|mysql|mongodb|redis|amqp)://", r"[A-Za-z0-9_.%-]+:[A-Za-z0-9_.%!*~+-]+@", 6),
)
RULES = BASE + MORE
#: Bytes walked at once in a worker, and side by side. A longer text is walked in several blocks, whole.
BLOCK_BYTES = 1 << 22
LANES = 4096
SPANS = "array<struct<kind:int,start:bigint,stop:bigint>>"
#: Stands between two texts. It is no byte of UTF-8; only negated classes take it, and no rule has one.
_BETWEEN = b"\xff"


def _match_starts(automaton: Automaton, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where matches start, ascending, and which rules as bits."""
    places, rules, state = [], [], 0
    for stop in range(len(data), 0, -BLOCK_BYTES):
        start = max(0, stop - BLOCK_BYTES)
        states = states_after(automaton, data[start:stop][::-1], state, LANES)
        state = int(states[-1])
        bits = automaton.accepts[states]
        hit = np.flatnonzero(bits)[::-1]
        places.append(stop - 1 - hit)
        rules.append(bits[hit])
    none = np.empty(0, dtype=np.int64)
    return np.concatenate(places[::-1] or [none]), np.concatenate(rules[::-1] or [none])


def find(texts: Sequence[bytes], rules: Sequence[Rule], scanner: Automaton, parts: Sequence[tuple[Automaton, Automaton]]) -> list[list[tuple[int, int, int]]]:
    """(rule, start, stop) of every text in characters, by start and rule. `parts` are the automata of heads and bodies."""
    joined = _BETWEEN.join(texts)
    starts, bits = _match_starts(scanner, np.frombuffer(joined, dtype=np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for number, rule in enumerate(rules):
        head, body = parts[number]
        mine = starts[(bits >> number) & 1 == 1]
        at = 0
        while at < len(mine):
            place = int(mine[at])
            middle = longest(head, joined, place)
            stop = longest(body, joined, middle)
            row = int(np.searchsorted(ends, place, side="right"))
            offset = int(ends[row]) - len(texts[row]) - 1
            if stop < 0:
                raise ValueError(f"rule {rule.kind} has a head that takes what its body needs")
            if stop - middle >= rule.least:
                out[row].append((number, place - offset, stop - offset))
            at = int(np.searchsorted(mine, stop, side="left"))
    for row, spans in enumerate(out):
        if spans:
            spans.sort(key=lambda s: (s[1], s[0]))
            out[row] = _in_characters(texts[row], spans)
    return out


def _in_characters(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(rule, int(before[a]), int(before[b])) for rule, a, b in spans]


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, list[tuple[Automaton, Automaton]]]:
    """The automaton of all mirrored rules, and those of each rule's head and body."""
    scanner = compile_rules([backwards(parse(r.head + r.body)) for r in rules], anywhere=True)
    return scanner, [(compile_rules([parse(r.head)], False), compile_rules([parse(r.body)], False)) for r in rules]


def span_finder(rules: Sequence[Rule] = RULES):
    """An Arrow function from texts to their spans. The automata are made here, once, and travel with it."""
    rules = tuple(rules)
    scanner, parts = compiled(rules)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))

    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found, texts, held = [], [], 0
            for value in column.cast(pa.large_binary()):
                texts.append(value.as_py() or b"")
                held += len(texts[-1])
                if held >= BLOCK_BYTES:
                    found += find(texts, rules, scanner, parts)
                    texts, held = [], 0
            found += find(texts, rules, scanner, parts)
            yield pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in row] for row in found], kind)

    return spans


def scan(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add `secrets` to every row: the spans of all rules as (kind, start, stop), by start, then rule order.

    `kind` numbers `rules` from 0; places are code points, stop exclusive. Matches of one rule are leftmost and do not overlap;
    of different rules they may. A null or empty text has an empty array. Rows are judged one by one, whole: repeated rows
    repeat their result, a long text is walked in blocks, other columns stay (one called like the result is replaced), and an empty
    table gives an empty one. Nothing is shuffled.
    """
    return df.withColumn("secrets", span_finder(rules)(F.coalesce(F.col(text), F.lit(""))))


def listed(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Spans as `kind:start:end`, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column, mark: str = "*") -> Column:
    """The text with every character of a span replaced."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    after = F.aggregate(spans, start, lambda s, h: F.struct(
        F.greatest(s["at"], h["stop"]).alias("at"),
        F.concat(s["out"], piece(s["at"], h["start"]),
                 F.repeat(F.lit(mark), F.greatest(h["stop"] - F.greatest(s["at"], h["start"]), F.lit(0)).cast("int"))).alias("out")))
    return F.concat(after["out"], piece(after["at"], F.length(text).cast("long")))
