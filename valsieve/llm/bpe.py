"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Every distinct piece of text between white space is cut into pre-tokens by the
vocabulary's own rules, and the merges of many pre-tokens run side by side in
numpy: row ``i`` of a matrix is the segment tree of pre-token ``i``.  A leaf
holds ``rank * width + position`` of the pair that starts at its symbol, so the
root is the leftmost pair of the lowest rank.  A merge changes three leaves and
their paths, and a row is done when its root holds no pair.  Merged pre-tokens are
kept as slices of one array by each worker, up to ``CACHE_TOKENS`` of them; beyond that those
that the present batch doesn't use go.

Null texts count as empty: no ids, and the hash of an empty string.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from valsieve.llm.common import pieces, ship, starts_of, texts_of, words_of

NO_PAIR = np.iinfo(np.int64).max
#: Pre-tokens kept merged by one worker.
CACHE_TOKENS = 200_000
#: Pieces that need no further cutting: composed letters that one lower-case letter each stands for, and marks behind them.
MARKS = ".,;:!?"
SIMPLE = r"^[a-zA-ZÀ-ÖØ-öø-ÿ]+[.,;:!?]*$"
#: Unicode white space, and the pre-token pattern as the vocabulary file states it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    return [letters[b] if b in letters else chr(next(spare)) for b in range(256)]


class PairRankTree:
    """A vocabulary with merges; encodes whole batches of pre-tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.base = len(self.names)
        keys = left * self.base + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.pre_token = regex.compile(PRE_TOKEN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def leaf(self, a: np.ndarray, b: np.ndarray, position: np.ndarray, width: int) -> np.ndarray:
        """Leaf values of the pairs (a, b); ``b`` below 0 means no right neighbour."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (b >= 0) & (a >= 0) & (self.keys[at] == key)
        return np.where(known, self.order[at] * width + position, NO_PAIR)

    def merge(self, symbols: np.ndarray, width: int) -> np.ndarray:
        """Merge each row (padded with -1 to ``width``, a power of two) to its end."""
        n = len(symbols)
        places = np.arange(width)
        length = (symbols >= 0).sum(axis=1)
        after = np.broadcast_to(places + 1, (n, width)).copy()
        after[after >= length[:, None]] = width
        before = np.broadcast_to(places - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NO_PAIR, dtype=np.int64)
        neighbour = np.full((n, width), -1, dtype=np.int64)
        neighbour[:, :-1] = symbols[:, 1:]
        tree[:, width:] = self.leaf(symbols, neighbour, places, width)
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], width)
            gone = after[rows, at]
            following, preceding = after[rows, gone], before[rows, at]
            made = self.made[rank]
            symbols[rows, at], symbols[rows, gone] = made, -1
            after[rows, at] = following
            has_next, has_previous = following < width, preceding >= 0
            before[rows[has_next], following[has_next]] = at[has_next]
            right = np.where(has_next, symbols[rows, np.minimum(following, width - 1)], -1)
            left = np.where(has_previous, symbols[rows, np.maximum(preceding, 0)], -1)
            tree[rows, width + gone] = NO_PAIR
            tree[rows, width + at] = self.leaf(made, right, at, width)
            some = rows[has_previous]
            tree[some, width + preceding[has_previous]] = self.leaf(
                left[has_previous], made[has_previous], preceding[has_previous], width)
            for who, leaf in ((rows, gone), (rows, at), (some, preceding[has_previous])):
                node = (leaf + width) >> 1
                while node.size and node[0] >= 1:
                    tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] < NO_PAIR]
        return symbols

    def merge_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens (bytes between offsets, none empty) one behind the other, and how many each has."""
        sizes = np.diff(offsets)
        widths = np.maximum(2, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        found = []
        counts = np.zeros(len(sizes), np.int64)
        for width in np.unique(widths).tolist():
            chosen = np.flatnonzero(widths == width)
            step = max(1, (1 << 19) // width)
            for start in range(0, len(chosen), step):
                part = chosen[start:start + step]
                places = np.arange(width)
                inside = places < sizes[part][:, None]
                letters = data[(offsets[part][:, None] + places)[inside]]
                symbols = np.full((len(part), width), -1, dtype=np.int64)
                symbols[inside] = self.inner[letters]
                symbols[np.arange(len(part)), sizes[part] - 1] = self.last[data[offsets[part + 1] - 1]]
                merged = self.merge(symbols, width)
                left = merged >= 0
                counts[part] = left.sum(axis=1)
                found.append((part, merged[left]))
        starts, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.uint32)
        for part, ids in found:
            out[slices(starts[part], counts[part])] = ids
        return out, counts

    def encode_tokens(self, tokens: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token (UTF-8 bytes, none empty)."""
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens], dtype=np.int64)])
        flat, counts = self.merge_all(np.frombuffer(b"".join(tokens), np.uint8), offsets)
        return np.split(flat.astype(np.int64), np.cumsum(counts)[:-1]) if tokens else []

    def normal(self, text: str) -> str:
        """Composed, then lower case letter by letter (no rule for a final sigma)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def cut_piece(self, text: str) -> list[str | int]:
        """Pre-tokens of a text; ids where it names special tokens."""
        steps: list[str | int] = []
        for part in self.cut.split(text) if self.cut and "<" in text else [text]:
            if part in self.special:
                steps.append(self.special[part])
            elif part:
                steps += self.pre_token.findall(part if part.isascii() and part.islower() else self.normal(part))
        return steps

    def encode_pieces(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; equal pre-tokens are merged once."""
        plan = [self.cut_piece(text) for text in texts]
        index = {t: k for k, t in enumerate(dict.fromkeys(t for steps in plan for t in steps if isinstance(t, str)))}
        ids = self.encode_tokens([t.encode("utf-8") for t in index])
        none = np.empty(0, dtype=np.int64)
        return [np.concatenate([none, *(ids[index[t]] if isinstance(t, str) else np.array([t]) for t in steps)]) for steps in plan]

    def decode(self, ids: np.ndarray) -> str:
        """Token texts joined by one space: the vocabulary file names no decoder."""
        return " ".join(self.names.take(pa.array(ids)).to_pylist())


@lru_cache(maxsize=2)
def load_tree(path: str) -> PairRankTree:
    return PairRankTree(path)


def slices(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of all entries of slices, one slice behind the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class TokenStore:
    """Merged pre-tokens of a worker: token k has ``counts[k]`` ids from ``starts[k]`` on."""

    def __init__(self, tree: PairRankTree):
        self.tree = tree
        self.tokens = pa.array([], pa.large_string())
        self.ids, self.starts, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def places(self, tokens: pa.Array) -> np.ndarray:
        """Where distinct tokens lie; new ones are merged first."""
        at = pc.fill_null(pc.index_in(tokens, value_set=self.tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = at < 0
        if new.any():
            if len(self.tokens) + int(new.sum()) > CACHE_TOKENS:
                held = at[~new]
                self.tokens = self.tokens.take(pa.array(held))
                self.ids = self.ids[slices(self.starts[held], self.counts[held])]
                self.counts = self.counts[held]
                self.starts = np.cumsum(self.counts) - self.counts
                at[~new] = np.arange(len(held))
            fresh = pa.concat_arrays([tokens.filter(pa.array(new)), pa.array([], tokens.type)])  # offsets from 0 on
            ids, counts = self.tree.merge_all(np.frombuffer(fresh.buffers()[2], np.uint8), np.frombuffer(fresh.buffers()[1], np.int64)[:len(fresh) + 1])
            at[new] = len(self.tokens) + np.arange(len(fresh))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            self.tokens = pa.concat_arrays([self.tokens, fresh])
        return at

    def pieces(self, named: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces of text one behind the other, and how many each has."""
        simple = pc.match_substring_regex(named, SIMPLE)
        fast, slow = (np.flatnonzero(m.to_numpy(zero_copy_only=False)) for m in (simple, pc.invert(simple)))
        words = pc.utf8_lower(named.take(pa.array(fast)))
        stems = pc.utf8_rtrim(words, MARKS)
        behind = (pc.utf8_length(words).to_numpy() - pc.utf8_length(stems).to_numpy()).astype(np.int64)
        tokens, owner, order = [stems], [fast], [np.zeros(len(fast), np.int64)]
        for size in np.unique(behind[behind > 0]).tolist():
            some = np.flatnonzero(behind == size)
            tokens.append(pc.utf8_slice_codeunits(words.take(pa.array(some)), -size))
            owner.append(fast[some])
            order.append(np.ones(len(some), np.int64))
        special: list[tuple[int, int, int]] = []
        cut: list[tuple[int, int, str]] = []
        for piece, text in zip(slow.tolist(), named.take(pa.array(slow)).to_pylist(), strict=True):
            for k, step in enumerate(self.tree.cut_piece(text)):
                (cut if isinstance(step, str) else special).append((piece, k, step))
        tokens.append(pa.array([t for _, _, t in cut], pa.large_string()))
        coded = pa.concat_arrays(tokens).dictionary_encode()
        places = self.places(coded.dictionary)
        unit = np.concatenate([coded.indices.to_numpy().astype(np.int64), len(places) + np.arange(len(special))])
        owner = np.concatenate([*owner, *(np.array([x[0] for x in part], np.int64) for part in (cut, special))])
        order = np.concatenate([*order, *(np.array([x[1] for x in part], np.int64) for part in (cut, special))])
        unit = unit[np.lexsort((order, owner))]
        starts = np.concatenate([self.starts[places], len(self.ids) + np.arange(len(special))])
        counts = np.concatenate([self.counts[places], np.ones(len(special), np.int64)])
        ids = np.concatenate([self.ids, np.array([x[2] for x in special], np.uint32)])
        each = np.bincount(np.sort(owner), weights=counts[unit], minlength=len(named)).astype(np.int64)
        return ids[slices(starts[unit], counts[unit])], each


@lru_cache(maxsize=2)
def worker_store(path: str) -> TokenStore:
    return TokenStore(load_tree(path))


def digests(texts: np.ndarray | memoryview, ends: list[int]) -> list[str]:
    return [hashlib.sha256(texts[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode_batches(batches, path: str, with_ids: bool):
    """Arrow task: ids of each text, their number, and the digests of ids and decoded text."""
    store = worker_store(path)
    for batch in pieces(batches, "text"):
        rows, codes, distinct = words_of(texts_of(batch), lower=False)
        ids, counts = store.pieces(distinct.cast(pa.large_string()))
        codes = codes.astype(np.int64)
        ids = ids[slices((np.cumsum(counts) - counts)[codes], counts[codes])].astype("<u4")
        words = np.concatenate([[0], np.cumsum(counts[codes])])
        ends = words[starts_of(rows, batch.num_rows)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), store.tree.names.take(pa.array(ids)))
        said = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
        letters = memoryview(said.buffers()[2] or b"")
        columns = {
            "doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(ends), pa.int64()),
            "ids_sha256": pa.array(digests(memoryview(ids).cast("B"), (4 * ends).tolist()) if len(ids) else [hashlib.sha256(b"").hexdigest()] * batch.num_rows, pa.string()),
            "decoded_sha256": pa.array(digests(letters, np.frombuffer(said.buffers()[1], np.int64)[:batch.num_rows + 1].tolist()), pa.string()),
        }
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int64)))
        yield pa.RecordBatch.from_pydict(columns)


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Ids of every whole text, with digests of ids and decoded text; one row per row of ``docs``.

    ``path``: a vocabulary file that every executor can open.  Other columns of
    ``docs`` are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<bigint>" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: encode_batches(batches, path, with_ids), schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Text of every row's ``ids`` (null: none) as ``decoded``, beside doc_id."""
    ship(tokens.sparkSession)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def task(batches):
        tree = load_tree(path)
        for batch in batches:
            said = [tree.decode(np.asarray(ids or [], dtype=np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(said, pa.string())})

    return tokens.select("doc_id", "ids").mapInArrow(task, f"doc_id {kind}, decoded string")


