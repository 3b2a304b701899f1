"""Toxicity by noisy-channel deobfuscation.

1. A character language model (trigrams of letters inside words, with word edges)
   is counted over all documents.
2. A word that holds digits, symbols or repeated letters, and a run of single
   letters set apart by spaces, is read as a lattice: each character stands for
   itself, for the letters it imitates, for a break between words or for nothing.
   Viterbi finds the likeliest readings under the language model: the ``BEST`` best that
   lie within ``MARGIN`` of the best.  Marks at the edges of a word are tried both as punctuation and as
   letters; a piece without any letter is a word only where its reading looks like one.  A
   word of letters without repetition has one path and needs no search.
3. Restored words and their beginnings are features.  A logistic model learns
   from labelled rows; the score of a text is its probability.

The classifier is fitted on at most ``SAMPLE`` labelled texts, chosen by a hash of
the text; counts of the language model and scores cover every row and whole text.
Null and empty texts have no features and get the base probability.  Without
labels, or with labels of one kind only, every score is the smoothed share of
toxic labels.  Other columns of the documents are never inputs of a score.
"""

from __future__ import annotations

import math
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valsieve.llm.common import fold, named_back, numbered_columns, pieces, ship, stage, text_of, texts_of, words_of

#: Labelled texts the classifier is fitted on at most.
SAMPLE = 20_000
#: Features that go into the fit at most, by evidence; each occurs in so many toxic texts at least
#: (or in half a percent of them).
FEATURES, SUPPORT = 4000, 3
THRESHOLD = 0.7
#: Weight of a toxic text in the fit: to miss one is worse than to doubt one.
TOXIC_WEIGHT = 3.0
#: Step length of the fit.
RATE = 0.05
#: Letters of the model: word edge, a-z, and the other letters folded into the rest.
LETTERS, EDGE = 65, 0
#: Letters that a digit or symbol imitates; a star hides a vowel.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¥": "y",
    "*": "aeiou",
}
#: Costs (natural logarithms) of an imitated letter, and of a break or nothing behind
#: a character that can or cannot imitate one; of a letter repeated on purpose, and of one too many.
COST_LEET, COST_BREAK, COST_DROP = 0.5, (8.0, 3.0), (12.0, 1.5)
COST_REPEAT, COST_SQUEEZE = 1.0, 0.5
#: Readings of a lattice that are kept, and how much less likely (natural logarithm) than the best they may be.
BEST, MARGIN = 3, 1.5
#: Mean log probability of its letters from which a piece without letters counts as a word.
WORDLIKE = -3.7
#: Characters after which the part that all readings of a lattice share is set aside.
SETTLE = 64
WORD = regex.compile(r"[\p{L}\p{M}]+")
PLAIN = regex.compile(r"[\p{L}\p{M}]*\Z")
DOUBLE = regex.compile(r"(\p{L})\1")
REPEATED = regex.compile(r"(\p{L})\1+")
DECORATION = regex.compile(r"([^\p{L}\p{N}])\1\1+\Z|\A([^\p{L}\p{N}])\2\2+")
TRIM = "\"'“”‘’«»()[]{}.,;:?…*&%#~_=-/\\"
#: What may only be punctuation at the edge of a word; the rest of ``TRIM`` may also stand for a letter.
OUTSIDE, EDGES = "".join(c for c in TRIM if c not in LEET), {c for c in TRIM if c in LEET}
CACHE_WORDS = 80_000


def letter_code(points: np.ndarray) -> np.ndarray:
    """Number of a letter in the model: 1-26 for a-z, 27-64 for all others."""
    plain = (points >= 97) & (points <= 122)
    return np.where(plain, points - 96, 27 + points % (LETTERS - 27))


def count_letters(batches):
    """Arrow task: letter triples inside words, pre-aggregated."""
    totals = np.zeros(LETTERS ** 3, np.int64)
    for batch in pieces(batches, "text"):
        _, codes, distinct = words_of(pc.utf8_lower(texts_of(batch)), lower=False)
        plain = pc.match_substring_regex(distinct, r"^\p{L}+[.,;:!?]*$").to_numpy(zero_copy_only=False)
        words = pc.utf8_rtrim(distinct.filter(pa.array(plain)), ".,;:!?").to_pylist()
        uses = np.bincount(codes, minlength=len(distinct))[plain]
        points = np.frombuffer(("  " + "  ".join(words) + "  ").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        edge = points == 32
        points = np.where(edge, EDGE, letter_code(points))
        word = np.maximum((np.cumsum(edge)[2:] + 1) // 2 - 1, 0)  # the word that the third letter belongs to or ends
        triples = (points[:-2] * LETTERS + points[1:-1]) * LETTERS + points[2:]
        word = np.minimum(np.where(edge[2:], word - edge[1:-1], word), max(len(uses) - 1, 0))
        if len(uses):
            totals += np.bincount(triples, weights=uses[word], minlength=len(totals)).astype(np.int64)
    seen = np.flatnonzero(totals)
    yield pa.RecordBatch.from_pydict({"triple": pa.array(seen, pa.int64()), "uses": pa.array(totals[seen], pa.int64())})


def letter_model(docs: DataFrame) -> np.ndarray:
    """log P(letter | the two before it), from all documents: LETTERS cubed numbers, whatever the corpus."""
    ship(docs.sparkSession)
    counted = docs.select(text_of().alias("text")).mapInArrow(count_letters, "triple bigint, uses bigint")
    uses = np.zeros(LETTERS ** 3)
    for r in counted.groupBy("triple").agg(F.sum("uses").alias("uses")).collect():
        uses[r.triple] = r.uses
    uses = uses.reshape(LETTERS, LETTERS, LETTERS)
    pairs = uses.sum(axis=0)
    short = (pairs + 0.1) / (pairs.sum(axis=1, keepdims=True) + 0.1 * LETTERS)
    return np.log((uses + 2 * short[None]) / (uses.sum(axis=2, keepdims=True) + 2))


class Decoder:
    """Viterbi reading of character lattices under a letter model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.known: dict[tuple[str, bool], list[tuple[str, int, float]]] = {}

    def choices(self, text: str) -> list[list[tuple[str, int, float]]]:
        """What each character may stand for: a letter, a break (" ") or nothing (""), with its cost."""
        return list(self.each_choice(text))

    def each_choice(self, text: str):
        """``choices`` one by one, so that a long text has no list of them."""
        known, before = self.known, ""
        for c in text:
            key = (c, c == before)
            options = known.get(key)
            if options is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                options = known[key] = self.options(*key)
            yield options
            before = c

    @staticmethod
    def options(c: str, repeats: bool) -> list[tuple[str, int, float]]:
        if c.isalpha():
            code = int(letter_code(np.int64(ord(c))))
            return [(c, code, COST_REPEAT), ("", -1, COST_SQUEEZE)] if repeats else [(c, code, 0.0)]
        likes = LEET.get(c, "")
        options = [(x, ord(x) - 96, COST_LEET + (1.0 if c == "*" else 0.0)) for x in likes]
        plain = not likes or c in "|*"
        return [*options, (" ", EDGE, COST_BREAK[plain]), ("", -1, COST_DROP[plain])]

    def ranked(self, text: str, best: int = BEST) -> list[tuple[float, str]]:
        """The ``best`` likeliest readings of ``text`` (lower case, without white space), however long it is, best first."""
        model, settled = self.model, []
        # State: the last two letters written (edges after a break); value: the best scores and readings.
        states: dict[tuple[int, int], list[tuple[float, str]]] = {(EDGE, EDGE): [(0.0, "")]}
        for at, options in enumerate(self.each_choice(text), 1):
            fresh: dict[tuple[int, int], list[tuple[float, str]]] = {}
            for (a, b), held in states.items():
                row = model[a][b]
                for letter, code, cost in options:
                    if code < 0:
                        to, gain = (a, b), -cost
                    elif code == EDGE:
                        to, gain = (EDGE, EDGE), (row[EDGE] if b else 0.0) - cost
                    else:
                        to, gain = (b, code), row[code] - cost
                    moved = [(score + gain, read + letter) for score, read in held]
                    if to in fresh:
                        fresh[to] += moved
                    else:
                        fresh[to] = moved
            for to, held in fresh.items():
                if len(held) > 1:
                    fresh[to] = self.distinct(held, best)
            states = fresh
            if at % SETTLE == 0:
                # Every way on begins with what all readings share, so they stay short.
                shared = commonprefix([read for held in states.values() for _, read in held])
                if shared:
                    settled.append(shared)
                    states = {state: [(score, read[len(shared):]) for score, read in held] for state, held in states.items()}
        ended = [(score + (model[a][b][EDGE] if b else 0.0), read) for (a, b), held in states.items() for score, read in held]
        start = "".join(settled)
        return self.distinct([(score, " ".join((start + read).split())) for score, read in sorted(ended, reverse=True)[:4 * best]], best)

    @staticmethod
    def distinct(held: list[tuple[float, str]], best: int) -> list[tuple[float, str]]:
        """The best of different readings, best first."""
        out: list[tuple[float, str]] = []
        for entry in sorted(held, reverse=True):
            if all(entry[1] != read for _, read in out):
                out.append(entry)
                if len(out) == best:
                    break
        return out

    def restore(self, text: str) -> str:
        """The likeliest words behind ``text``."""
        return self.ranked(text, 1)[0][1]

    def words(self, text: str) -> list[str]:
        """The words of all likely readings of ``text``."""
        ranked = self.ranked(text)
        return [word for score, read in ranked if score >= ranked[0][0] - MARGIN for word in read.split()]

    def wordlike(self, word: str) -> bool:
        """Whether the letters of ``word`` follow each other as those of words do."""
        codes = [EDGE, EDGE, *letter_code(np.array([ord(c) for c in word], dtype=np.int64)).tolist(), EDGE]
        return sum(self.model[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)) >= WORDLIKE * (len(codes) - 2)

    def readings(self, word: str) -> list[str]:
        """Plain words that a piece between white space stands for: as it is, and as its lattice reads."""
        word = DECORATION.sub("", word)
        whole, word = word.strip(OUTSIDE), word.strip(TRIM).rstrip("!")
        plain = bool(PLAIN.match(word))
        if plain and whole.rstrip(TRIM + "!") == word and not DOUBLE.search(word):
            return [word] if word else []
        found = WORD.findall(word)
        if found:
            found += self.words(word) if not plain or DOUBLE.search(word) else []
        elif any(c in LEET for c in word):
            found += [w for w in self.words(word) if len(w) > 2 and self.wordlike(w)]
        if WORD.search(word) and whole != word:
            at = whole.find(word)
            before, after = whole[at - 1:at] if at else "", whole[at + len(word):at + len(word) + 1]
            guessed = [x + word for x in LEET.get(before, "")] + [word + x for x in LEET.get(after, "") if after != "!"]
            found += guessed if plain else [w for g in guessed for w in self.words(g)]
        return list(dict.fromkeys(found))


def features_of(word: str) -> list[str]:
    """A restored word, and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6, 7) if len(word) >= n)]


def spaced_runs(rows: np.ndarray, single: np.ndarray) -> list[tuple[int, int]]:
    """Runs of at least three single characters in one row: start and end among the words."""
    mark = np.concatenate([[0], single.astype(np.int8), [0]])
    runs = []
    for a, b in zip(np.flatnonzero(np.diff(mark) == 1).tolist(), np.flatnonzero(np.diff(mark) == -1).tolist(), strict=True):
        cuts = [a, *(a + 1 + np.flatnonzero(np.diff(rows[a:b]))).tolist(), b]
        runs += [(x, y) for x, y in zip(cuts, cuts[1:], strict=False) if y - x >= 3]
    return runs


class Wanted:
    """Numbered features, and quick exact tests for words that can't have any of them."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers
        self.sets = {}
        for n in (0, 4, 5, 6, 7):
            own = {f[1:]: k for f, k in numbers.items() if (f[0] == "=") == (n == 0) and (n == 0 or len(f) == n + 1)}
            self.sets[n] = (pa.array(list(own), pa.large_string()), list(own.values()))
        # A reading has the letters of its word but for repetitions, so without those it begins as a feature does.
        self.short = {REPEATED.sub(r"\1", f[1:]) for f in numbers}

    def of_plain(self, words: pa.Array):
        """Place and number of each feature of words that need no search."""
        for n, (values, numbers) in self.sets.items():
            part = words if n == 0 else pc.utf8_slice_codeunits(words, 0, n)
            hits = pc.index_in(part, value_set=values)
            at = np.flatnonzero(pc.is_valid(hits).to_numpy(zero_copy_only=False))
            for i, k in zip(at.tolist(), hits.take(pa.array(at)).to_pylist(), strict=True):
                yield i, numbers[k]

    def possible(self, word: str) -> bool:
        """Whether a reading of a piece may have a feature; only what is letters and punctuation can be told from."""
        bare = DECORATION.sub("", word).strip(TRIM).rstrip("!")
        if not PLAIN.match(bare) or not EDGES.isdisjoint(word):
            return True
        short = REPEATED.sub(r"\1", bare)
        return any(short[:n] in self.short for n in range(1, len(short) + 1))


def searched(distinct: pa.Array, bare: pa.Array) -> np.ndarray:
    """Which words may need a search: all but those of letters without a repetition inside plain punctuation."""
    letters = pc.match_substring_regex(bare, r"^[\p{L}\p{M}]+$")
    edges = pc.equal(pc.utf8_rtrim(pc.utf8_trim(distinct, OUTSIDE), TRIM + "!"), bare)
    out = ~pc.and_(letters, edges).to_numpy(zero_copy_only=False)
    bare = pa.concat_arrays([bare, pa.array([], bare.type)])
    _, offsets, data = bare.buffers()
    ends = np.frombuffer(offsets, np.int64)[1:len(bare) + 1]
    told = np.frombuffer(data or b"", np.uint8)
    # Letters take up to four bytes: the same bytes again, of one letter or of more, are looked at one by one.
    for size in (1, 2, 3, 4):
        same = told[size:] == told[:-size]
        run = same.copy()
        for k in range(1, size):
            run[:-k] &= same[k:]
        if size > 1 and len(told) > size:
            run &= told[:-size] >= 0xC0
        out[np.minimum(np.searchsorted(ends, np.flatnonzero(run), side="right"), max(len(out) - 1, 0))] = True
    return out


def row_features(batch: pa.RecordBatch, decoder: Decoder, store: dict, wanted: Wanted | None = None):
    """Distinct (row, feature) pairs of a piece of the table.

    ``wanted``: numbered features; without it features are returned as text.
    """
    rows, codes, distinct = words_of(pc.utf8_lower(texts_of(batch)), lower=False)
    distinct = distinct.cast(pa.large_string())
    features: dict[int, list] = {}
    slow = np.arange(len(distinct))
    if wanted is not None and len(distinct):
        bare = pc.utf8_rtrim(pc.utf8_trim(distinct, TRIM), "!")
        search = searched(distinct, bare)
        slow, fast = np.flatnonzero(search), np.flatnonzero(~search)
        for i, k in wanted.of_plain(bare.take(pa.array(fast))):
            features.setdefault(int(fast[i]), []).append(k)
    for code, word in zip(slow.tolist(), distinct.take(pa.array(slow)).to_pylist(), strict=True):
        known = store.get(word)
        if known is None:
            if len(store) >= CACHE_WORDS:
                store.clear()
            known = ()
            if wanted is None or wanted.possible(word):
                known = [f for plain in decoder.readings(word) for f in features_of(plain)]
                if wanted is not None:
                    known = [wanted.numbers[f] for f in known if f in wanted.numbers]
            store[word] = known = tuple(dict.fromkeys(known))
        if known:
            features[code] = list(known)
    found_rows: list = []
    found: list = []
    if len(codes):
        many = np.zeros(len(distinct), bool)
        many[list(features)] = True
        hit = many[codes]
        pairs = np.unique(rows[hit].astype(np.int64) * len(distinct) + codes[hit])
        for row, code in zip((pairs // len(distinct)).tolist(), (pairs % len(distinct)).tolist(), strict=True):
            found_rows += [row] * len(features[code])
            found += features[code]
        bare = pc.utf8_trim(distinct, TRIM + "!$")
        lone = pc.equal(pc.utf8_length(bare), 1).to_numpy(zero_copy_only=False)
        for a, b in spaced_runs(rows, lone[codes]):
            letters = bare.take(pa.array(codes[a:b])).to_pylist()
            joined = "".join(letters)
            words = {joined} if joined.isalpha() else set()
            words.update(decoder.words("_".join(letters)))  # the lattice decides where words end
            extra = [f for w in words for f in features_of(w)]
            extra = extra if wanted is None else [wanted.numbers[f] for f in extra if f in wanted.numbers]
            found_rows += [int(rows[a])] * len(extra)
            found += extra
    return found_rows, found


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` labelled training texts, one of each text: doc_id, toxic, hash of the text.

    Ids are taken in the order of a hash, so the choice doesn't depend on how rows
    are stored.  The result has at most ``sample`` narrow rows, so it is broadcast.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(fold("doc_id", 3) != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("spot", F.xxhash64("doc_id"))
    share = min(1.0, 1.2 * sample / max(known.count(), 1))  # hashes are even: most rows beyond the bound go before the sort
    limit = (1 << 63) - 1 if share == 1.0 else int(share * (1 << 64)) - (1 << 63)
    chosen = known.where(F.col("spot") <= F.lit(limit)).orderBy("spot", "doc_id").limit(sample).select("doc_id", "toxic")
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("key")).join(F.broadcast(chosen), "doc_id")
    return stage(texts.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "labelled")


def fit_weights(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, width: int, steps: int = 400) -> np.ndarray:
    """Logistic weights (the last is the bias) of a bounded sparse 0/1 matrix, with a light L2 penalty.

    Gradient steps are scaled by feature, so that rare features move as frequent ones do.
    """
    n, labels = max(len(labels), 1), labels.astype(np.float64)
    share = (labels.sum() + 0.5) / (n + 1)
    weights = np.zeros(width + 1)
    weights[-1] = math.log(share / (1 - share))
    if not 0 < labels.sum() < len(labels) or not width:
        return weights
    weight = np.where(labels > 0, TOXIC_WEIGHT, 1.0) / n
    mean, square, penalty = np.zeros(width + 1), np.zeros(width + 1), 0.002 / n
    for step in range(1, steps + 1):
        logits = np.bincount(rows, weights=weights[columns], minlength=len(labels)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - labels) * weight
        gradient = np.append(np.bincount(columns, weights=error[rows], minlength=width), error.sum())
        gradient[:-1] += penalty * weights[:-1]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient ** 2
        weights -= RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-9)
        weights[:-1] = np.maximum(weights[:-1], 0)  # a feature speaks for toxicity or not at all
    return weights


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Letter model, feature numbers and weights."""
    ship(docs.sparkSession)
    model = letter_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    chosen = labelled_sample(docs, labels, sample)
    texts = docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("key")).join(F.broadcast(chosen), ["doc_id", "key"])

    def evidence_of(batches):
        """Arrow task: texts and toxic texts of each feature, pre-aggregated."""
        decoder, store, counts = Decoder(shared.value), {}, {}
        for batch in pieces(batches, "text", 1 << 20):
            rows, found = row_features(batch, decoder, store)
            marks = batch.column("toxic").to_pylist()
            for row, feature in set(zip(rows, found, strict=True)):
                n, t = counts.get(feature, (0, 0))
                counts[feature] = (n + 1, t + marks[row])
            if len(counts) > CACHE_WORDS:
                yield counted(counts)
                counts = {}
        yield counted(counts)

    def counted(counts):
        return pa.RecordBatch.from_pydict({
            "feature": pa.array(list(counts), pa.string()), "n": pa.array([v[0] for v in counts.values()], pa.int64()),
            "t": pa.array([v[1] for v in counts.values()], pa.int64())})

    known = {r.key: r.toxic for r in chosen.collect()}  # at most ``sample`` rows
    clean, toxic = sum(v == 0 for v in known.values()), sum(v == 1 for v in known.values())
    ratio = max(clean, 1) / max(toxic, 1)
    # How much likelier the feature is in toxic texts, weighted by their number.
    evidence = F.col("t") * F.log((F.col("t") * F.lit(ratio) + 0.5) / (F.col("n") - F.col("t") + 0.5))
    strong = texts.mapInArrow(evidence_of, "feature string, n bigint, t bigint").groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("t") >= max(SUPPORT, toxic // 200))
    strong = strong.where((F.col("n") - F.col("t")) * 4 <= F.col("t")).orderBy(evidence.desc(), "feature").limit(FEATURES)
    number = {r.feature: i for i, r in enumerate(strong.select("feature").collect())}  # at most FEATURES
    picked = docs.sparkSession.sparkContext.broadcast(number)

    def matrix(batches):
        """Arrow task: the picked features of each labelled text."""
        decoder, store, wanted = Decoder(shared.value), {}, Wanted(picked.value)
        for batch in pieces(batches, "text", 1 << 20):
            rows, found = row_features(batch, decoder, store, wanted)
            keys = batch.column("key").to_pylist()
            pairs = sorted({(keys[row], f) for row, f in zip(rows, found, strict=True)})
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([k for k, _ in pairs], pa.int64()), "feature": pa.array([f for _, f in pairs], pa.int32())})

    # At most ``sample`` times FEATURES cells; repeated rows of one text give the same cells.
    cells = sorted({(r.key, r.feature) for r in texts.mapInArrow(matrix, "key bigint, feature int").collect()})
    order = sorted(known)
    at = {k: i for i, k in enumerate(order)}
    rows = np.array([at[k] for k, _ in cells], dtype=np.int64)
    columns = np.array([f for _, f in cells], dtype=np.int64)
    weights = fit_weights(rows, columns, np.array([known[k] for k in order], dtype=np.float64), len(number))
    return {"letters": model, "features": number, "weights": weights}


def score(docs: DataFrame, trained: dict) -> DataFrame:
    """``docs`` with ``score`` appended (replacing a column of that name)."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trained)
    plain = docs.drop("score")
    columns = plain.columns
    work = plain.withColumn("score_text", text_of())
    schema = plain.withColumn("score", F.lit(0.0)).schema

    def task(batches):
        decoder, wanted, weights = Decoder(shared.value["letters"]), Wanted(shared.value["features"]), shared.value["weights"]
        store: dict = {}
        for batch in pieces(batches, "score_text"):
            named = pa.RecordBatch.from_pydict({"text": batch.column("score_text")})
            rows, found = row_features(named, decoder, store, wanted)
            pairs = np.unique(np.array(rows, np.int64) * (len(weights) + 1) + np.array(found, np.int64))
            logits = np.bincount(pairs // (len(weights) + 1), weights=weights[pairs % (len(weights) + 1)], minlength=batch.num_rows)
            value = 1 / (1 + np.exp(-np.clip(logits[:batch.num_rows] + weights[-1], -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(value)], names=[*columns, "score"])

    return work.mapInArrow(task, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, sample))
    return scored.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with their columns."""
    trained = train(docs, labels, sample)
    kept = score(numbered_columns(docs, "text").withColumnRenamed("_text", "text"), trained).where(F.col("score") < THRESHOLD)
    return named_back(kept, docs)
