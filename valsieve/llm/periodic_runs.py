"""Repeated stretches of words, found by recompression.

The words of many texts stand in one array.  Rounds of block compression (equal
neighbours become one symbol with its length) and pair compression (each symbol
is dealt to the left or the right half of the alphabet, and a left symbol merges
with the right symbol behind it) make a run-length grammar.  Both steps look at
neighbours only, so equal stretches are parsed alike but for their edges, and a
longest common extension climbs and descends the levels with a few comparisons on
each.  No round joins words of two texts.

A run of period q matches the words q further on for at least
``max(LEAST - q, 2 * q)`` places, so a grid of that step has a point in each such
stretch.  All grid points of all periods (a harmonic sum) whose words agree are
extended to both sides by the grammar; runs that several points or several
multiples of a period find are kept once, with the smallest period.

Null and blank texts have no words and no runs.  Rows that repeat an id or a text
are worked on by themselves.  A missing doc_id has the checksum of the empty string
and leaves the words as they are.  A task holds the grammar of one piece of
``PIECE_BYTES`` of text, or of one longer text: some 200 bytes a word.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valsieve.llm.common import pieces, ship, starts_of, text_of, texts_of, words_of

#: A run has at least so many words, and at least so many periods.
LEAST, PERIODS = 24, 3
PIECE_BYTES = 1 << 20
#: Grid points looked at together.
POINTS = 1 << 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Level(NamedTuple):
    """A parse of all words: symbols, the word each begins at (and the end), and how the next level groups them."""

    symbols: np.ndarray
    starts: np.ndarray
    heads: np.ndarray | None = None  # of each symbol of the next level, its first symbol here
    up: np.ndarray | None = None  # the symbol of the next level that holds each symbol
    first: np.ndarray | None = None  # whether a symbol is the first in it
    ends: np.ndarray | None = None  # where the next level is made of blocks: the end of each symbol's block

    def grouped(self, heads: np.ndarray, ends: np.ndarray | None) -> Level:
        first = np.zeros(len(self.symbols), bool)
        first[heads] = True
        return self._replace(heads=heads, up=(np.cumsum(first) - 1).astype(np.int32), first=first, ends=ends)

    def mirrored(self) -> Level:
        """The same parse read from the end."""
        size, words = len(self.symbols), self.starts[-1]
        turned = Level(self.symbols[::-1], words - self.starts[::-1])
        if self.heads is None:
            return turned
        tails = np.append(self.heads[1:], size) - 1
        ends = None
        if self.ends is not None:
            ends = size - self.heads[self.up][::-1]
        return turned.grouped((size - 1 - tails)[::-1], ends)


def block_round(level: Level, fresh: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int] | None:
    """Heads, ends of blocks, symbols and number of names after block compression; nothing where no symbol repeats."""
    symbols = level.symbols
    changes = np.ones(len(symbols), bool)
    changes[1:] = (symbols[1:] != symbols[:-1]) | fresh[1:]
    heads = np.flatnonzero(changes).astype(np.int32)
    if len(heads) == len(symbols):
        return None
    lengths = np.diff(np.append(heads, len(symbols)))
    made, many = symbols[heads].copy(), np.flatnonzero(lengths > 1)
    _, name = np.unique(made[many].astype(np.int64) * (int(lengths.max()) + 1) + lengths[many], return_inverse=True)
    made[many] = names + name
    ends = np.repeat(heads + lengths, lengths).astype(np.int32)
    return heads, ends, made, names + int(name.max()) + 1


def pair_round(level: Level, fresh: np.ndarray, names: int, turn: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Heads, symbols and number of names after pair compression; nothing where no pair merges."""
    symbols = level.symbols
    with np.errstate(over="ignore"):
        side = ((symbols.astype(np.uint64) + np.uint64(turn + 1)) * SPREAD * np.uint64(2 * turn + 3) >> np.uint64(40)) & np.uint64(1)
    right = side.astype(bool)
    second = np.zeros(len(symbols), bool)
    second[1:] = ~right[:-1] & right[1:] & ~fresh[1:]
    at = np.flatnonzero(second) - 1
    if not len(at):
        return None
    _, name = np.unique(symbols[at].astype(np.int64) * names + symbols[at + 1], return_inverse=True)
    made = symbols.copy()
    made[at] = names + name
    heads = np.flatnonzero(~second).astype(np.int32)
    return heads, made[heads], names + int(name.max()) + 1


def grammar(words: np.ndarray, begins: np.ndarray) -> list[Level]:
    """Levels from the words up to (nearly) one symbol a text; ``begins``: the first word of each text that has any."""
    fresh = np.zeros(len(words), bool)
    fresh[begins] = True
    levels = [Level(words.astype(np.int32), np.arange(len(words) + 1, dtype=np.int32))]
    names = int(words.max()) + 1 if len(words) else 0
    idle = turn = 0

    def add(heads, ends, made):
        nonlocal fresh
        level = levels[-1]
        levels[-1] = level.grouped(heads, ends)
        levels.append(Level(made.astype(np.int32), np.append(level.starts[heads], level.starts[-1])))
        fresh = fresh[heads]

    while len(levels[-1].symbols) > len(begins) and idle < 16:
        if (blocks := block_round(levels[-1], fresh, names)) is not None:
            heads, ends, made, names = blocks
            add(heads, ends, made)
        pairs = pair_round(levels[-1], fresh, names, turn)
        if pairs is not None:
            heads, made, names = pairs
            add(heads, None, made)
        idle, turn = (0 if pairs is not None else idle + 1), turn + 1
    return levels


def matching(level: Level, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the right side has ended, and whether both sides have the same symbol."""
    over = level.starts[b] >= stop
    return over, ~over & (level.symbols[a] == level.symbols[np.minimum(b, len(level.symbols) - 1)])


def steps(level: Level, a: np.ndarray, b: np.ndarray) -> np.ndarray | int:
    """Symbols that can be passed at once when both sides have the same."""
    return 1 if level.ends is None else np.minimum(level.ends[a] - a, level.ends[b] - b)


def extensions(levels: list[Level], left: np.ndarray, right: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How many words from ``left`` equal those from ``right`` (``left < right``), which ends at ``stop``."""
    total = (stop - right).astype(np.int64)
    parted: dict[int, list] = {}
    who, a, b = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
    for k, level in enumerate(levels):  # climb as long as both sides agree
        risen: list = []
        while len(who):
            over, same = matching(level, a, b, stop[who])
            away = ~over & ~same
            if away.any():
                parted.setdefault(k, []).append((who[away], a[away], b[away]))
            who, a, b = who[same], a[same], b[same]
            if level.heads is not None:
                ready = level.first[a] & level.first[b]
                risen.append((who[ready], level.up[a[ready]], level.up[b[ready]]))
                who, a, b = who[~ready], a[~ready], b[~ready]
            step = steps(level, a, b)
            a, b = a + step, b + step
        who, a, b = ([np.concatenate([r[i] for r in risen]) for i in range(3)] if risen else (who, a, b))
    who, a, b = who[:0], a[:0], b[:0]
    for k in range(len(levels) - 1, -1, -1):  # descend to the word where they part
        level, edge = levels[k], []
        while len(who):
            over, same = matching(level, a, b, stop[who])
            away = ~over & ~same
            edge.append((who[away], a[away], b[away]))
            who, a, b = who[same], a[same], b[same]
            step = steps(level, a, b)
            a, b = a + step, b + step
        edge += parted.get(k, [])
        if edge:
            who, a, b = (np.concatenate([e[i] for e in edge]) for i in range(3))
        if k == 0:
            total[who] = b - right[who]
        elif len(who):
            a, b = levels[k - 1].heads[a].astype(np.int64), levels[k - 1].heads[b].astype(np.int64)
    return total


def grid(sizes: np.ndarray, least: int = LEAST, times: int = PERIODS):
    """Blocks of (text, period, place) for all texts of ``sizes`` words and all their periods."""
    top = np.where(sizes >= least, sizes // times, 0)
    texts = np.repeat(np.arange(len(sizes)), top)
    periods = np.arange(len(texts)) - np.repeat(np.cumsum(top) - top, top) + 1
    step = np.maximum(least - periods, (times - 1) * periods)
    count = (sizes[texts] - periods - 1) // step + 1
    ends, start = np.cumsum(count), 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + POINTS, side="right")))
        n = count[start:stop]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(texts[start:stop], n), np.repeat(periods[start:stop], n), inside * np.repeat(step[start:stop], n)
        start = stop


def runs_of(words: np.ndarray, starts: np.ndarray, least: int = LEAST, times: int = PERIODS) -> tuple[np.ndarray, ...]:
    """Text, start, length and smallest period of all runs, by text, start and period.

    ``starts``: the first word of each text, and the end.
    """
    sizes = np.diff(starts)
    levels = mirrored = None
    found = np.empty((0, 4), np.int64)  # text, start, end, period
    for text, period, place in grid(sizes, least, times):
        at = starts[text] + place
        same = words[at] == words[at + period]
        text, period, at = text[same], period[same], at[same]
        if not len(text):
            continue
        if levels is None:
            levels = grammar(words, starts[:-1][sizes > 0])
            mirrored = [level.mirrored() for level in levels]
        ahead = extensions(levels, at, at + period, starts[text + 1])
        back = extensions(mirrored, len(words) - at - period, len(words) - at, len(words) - starts[text])
        whole = ahead + back >= np.maximum(least - period, (times - 1) * period)
        text, period, at, ahead, back = (x[whole] for x in (text, period, at, ahead, back))
        first = at - back - starts[text]
        found = np.concatenate([found, np.stack([text, first, first + back + ahead + period, period], axis=1)])
        found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
        fresh = np.ones(len(found), bool)
        fresh[1:] = (found[1:, :3] != found[:-1, :3]).any(axis=1)
        found = found[fresh]
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2] - found[:, 1], found[:, 3]


def repeated(words: np.ndarray, starts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The words with a periodic rest in each text whose mark (not below 0) is a multiple of ten."""
    sizes = np.diff(starts)
    out = words.copy()
    for row in np.flatnonzero((marks >= 0) & (marks % 10 == 0) & (sizes > 0)).tolist():
        n, g = int(sizes[row]), int(marks[row]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = words[starts[row]:starts[row + 1]]
        out[starts[row] + a:starts[row + 1]] = own[a + np.arange(n - a) % p]
    return out


def strongest(length: list[int], period: list[int]) -> int:
    """The place of the greatest length/period, the first of equal ones (they come by start, then period)."""
    best = 0
    for i in range(1, len(length)):
        if length[i] * period[best] > length[best] * period[i]:
            best = i
    return best


def digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def collapse_batches(batches, least: int, times: int, with_text: bool):
    """Arrow task: the runs of each text and the text without their repeats."""
    for batch in pieces(batches, "text", PIECE_BYTES):
        count = batch.num_rows
        rows, codes, distinct = words_of(texts_of(batch), lower=False)
        starts = starts_of(rows, count)
        words = repeated(codes, starts, batch.column("mark").to_numpy(zero_copy_only=False))
        text, first, length, period = runs_of(words, starts, least, times)
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, starts[text] + first + period, 1)
        np.add.at(change, starts[text] + first + length, -1)
        kept = np.cumsum(change[:-1]) == 0
        ends = np.concatenate([[0], np.cumsum(kept)])[starts]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), distinct.take(pa.array(words[kept])).cast(pa.large_string()))
        collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
        data = memoryview(collapsed.buffers()[2] or b"")
        at = np.frombuffer(collapsed.buffers()[1], np.int64)[:count + 1].tolist()
        bounds = np.searchsorted(text, np.arange(count + 1)).tolist()
        empty = digest(b"")
        columns = {name: [None] * count for name in ("start", "length", "period", "exponent_milli")}
        listed = [empty] * count
        for row in np.unique(text).tolist():
            own = slice(bounds[row], bounds[row + 1])
            s, n, q = first[own].tolist(), length[own].tolist(), period[own].tolist()
            listed[row] = digest("".join(f"{x},{y},{z}\n" for x, y, z in zip(s, n, q, strict=True)).encode())
            best = strongest(n, q)
            for name, value in zip(columns, (s[best], n[best], q[best], 1000 * n[best] // q[best]), strict=True):
                columns[name][row] = value
        out = {"doc_id": batch.column("doc_id"), "n_runs": pa.array(np.diff(bounds), pa.int64())}
        out |= {name: pa.array(values, pa.int64()) for name, values in columns.items()}
        out |= {"runs_sha256": pa.array(listed, pa.string()),
                "collapsed_sha256": pa.array([digest(data[at[i]:at[i + 1]]) for i in range(count)], pa.string())}
        if with_text:
            out |= {"runs": pa.array([list(zip(first[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True))
                                      for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
                                     pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
                    "collapsed": collapsed.cast(pa.string())}
        yield pa.RecordBatch.from_pydict(out)


def find_runs(docs: DataFrame, mark: Column | None = None, least: int = LEAST, times: int = PERIODS, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: its number of runs, the strongest run, and digests of all runs and of the collapsed text.

    A run is a stretch of at least ``least`` words and ``times`` (two or more)
    smallest periods that no neighbouring word extends.  A word goes if a run holds it behind its first period.  ``with_text``
    adds the runs themselves and the collapsed text.  ``mark``: for each row a number; a
    multiple of ten makes the words periodic from a word on (for checks), null or
    no mark leaves them.  Other columns of ``docs`` are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
              "runs_sha256 string, collapsed_sha256 string")
    schema += ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string" if with_text else ""
    marked = F.lit(-1) if mark is None else F.coalesce(mark, F.lit(-1))
    narrow = docs.select("doc_id", text_of().alias("text"), marked.cast("bigint").alias("mark"))
    return narrow.mapInArrow(lambda batches: collapse_batches(batches, least, times, with_text), schema)


def marked_runs(docs: DataFrame) -> DataFrame:
    """The runs of ``docs`` with every tenth document, told by the checksum of its id, made periodic."""
    return find_runs(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")), with_text=False)
