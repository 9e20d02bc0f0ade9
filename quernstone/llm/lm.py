"""Language-model scores from a log-frequency Bloom filter.

The filter holds n-grams of one, two and three words with quantised counts: an
n-gram of level ``1 + floor(log2(count))`` is entered once for every level up
to its own, so probing level after level until one is missing gives the level
back.  A count may come out too high by a false positive, never too low.

Building: each task counts its tokens' n-grams by hash and deals them out to
slices of the hash range; a slice's task adds the counts up and writes one file
to the shared folder: its part of the filter, and the exact counts of its single
words (for the base score).  The number of slices follows the corpus, so every
task holds a bounded part of it.

Scoring: every worker reads whole texts and maps the slices' files into memory,
read-only and shared by the workers of a machine, so none has a copy of its own;
pages that memory has no room for are read again.  A store that cannot be mapped
is read slice by slice, of which a worker keeps ``HELD_BYTES``.  A batch's
n-grams are sorted by slice first, so each slice is visited once a batch.

The probability of a word goes back from three words to one, each order's
counts being smoothed by the next lower order as so many further tokens
(Dirichlet's prior, ``prior`` of them):

    p1(w)     = (c(w) + 1) / (N + V + 1)
    p2(w|h)   = (c(h w) + prior * p1(w)) / (c(h) + prior)
    p3(w|g h) = (c(g h w) + prior * p2(w|h)) / (c(g h) + prior)

With exact counts each sums to one over the words and one unknown word; c are
the filter's counts here, at most that of the history.  N are the training
tokens, V their distinct words.  A text begins after an end token and ends with
one; its first word has no p3 of its own.

Words are told apart by 64-bit hashes: up to seven bytes one to one, longer ones
by xxh3.  Defined results: a null text counts as empty, and has its end token
alone; repeated rows each get their score and count for each in training;
without training texts N and V are 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, map_file, need, new_path, write_file, written

#: Of 1, 4, 16 and 64 the one under which held-out texts are likeliest.
PRIOR = 64.0
BITS_PER_ENTRY, PROBES = 8, 4
#: Tokens that one slice's task adds up, about.
SLICE_TOKENS = 2_000_000
#: Bytes of slices that a worker keeps where files cannot be mapped.
HELD_BYTES = 1 << 28
END = 0x5851F42D4C957F2D
#: N-grams travel and are told apart by the upper 56 bits of their hashes.
_KEPT = 0xFFFFFFFFFFFFFF00


@dataclass
class Model:
    path: str
    slices: int
    tokens: int
    words: int
    size: int
    prior: float = PRIOR

    def base_word(self) -> float:
        return float(self.tokens + self.words + 1)


def _pairs(history, word):
    import numpy as np

    from .hashing import mix

    return mix(history * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(0x632BE59BD9B4E019))


def _tokens(texts):
    """(first, word, two, three, owner) of all tokens of a batch, end tokens included.

    ``two`` and ``three`` are the n-grams that end with the token; the three of
    a text's first token stands for nothing.
    """
    import numpy as np

    from .hashing import words

    found, counts = words(texts, lower=True)
    ends = np.cumsum(counts + 1) - 1 if len(counts) else counts
    word = np.empty(len(found) + len(counts), np.uint64)
    last = np.zeros(len(word), bool)
    last[ends] = True
    word[last], word[~last] = np.uint64(END), found
    first = np.concatenate([[True], last[:-1]]) if len(word) else last
    two = _pairs(np.concatenate([[np.uint64(END)], word[:-1]]) if len(word) else word, word)
    three = _pairs(np.concatenate([[np.uint64(0)], two[:-1]]) if len(word) else word, word + np.uint64(1))
    return first, word, two, three, np.repeat(np.arange(len(counts)), counts + 1)


def _pack(hashes) -> bytes:
    """Seven bytes of each hash."""
    import numpy as np

    return np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack(raw: bytes):
    import numpy as np

    out = np.zeros((len(raw) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(raw, np.uint8).reshape(-1, 7)
    return out.view(">u8").ravel().astype(np.uint64)


def _slice_of(hashes, slices: int):
    import numpy as np

    return (hashes >> np.uint64(64 - (slices.bit_length() - 1))).astype(np.int64) if slices > 1 else np.zeros(len(hashes), np.int64)


def _place(hashes, level: int, probe: int, bits):
    """The bit that a probe of n-grams at one level looks at, in a filter of so many bits."""
    import numpy as np

    from .hashing import mix

    return mix(hashes + np.uint64((0xD1B54A32D192ED03 * level + 0x8CB92BA72F3D8DD7 * (probe + 1)) % (1 << 64))) % bits


def build_filter(hashes, counts, bits_per_entry: int = BITS_PER_ENTRY) -> bytes:
    """One slice of the filter: every n-gram at every level up to its own; whole words of 64 bits."""
    import numpy as np

    levels = np.frexp(counts.astype(np.float64))[1]
    bits = max(64, int(levels.sum()) * bits_per_entry)
    bits += -bits % 64
    flags = np.zeros(bits, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        there = hashes[levels >= level]
        for probe in range(PROBES):
            flags[_place(there, level, probe, np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _summed(hashes, times):
    """Distinct hashes in order, and the sums of their times."""
    import numpy as np

    order = np.argsort(hashes, kind="stable")
    hashes, times = hashes[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    return hashes[first], np.add.reduceat(times, first) if len(first) else times


def counts_of(levels):
    """The count that a level stands for: the middle of its range."""
    import numpy as np

    low = np.exp2(np.maximum(levels, 1) - 1.0)
    return np.where(levels > 0, (3.0 * low - 1.0) / 2.0, 0.0)


def train(df: DataFrame, text_col: str = "text", slice_tokens: int = SLICE_TOKENS, prior: float = PRIOR, bits_per_entry: int = BITS_PER_ENTRY) -> Model:
    """Count the n-grams of all texts of ``df`` and write the filter."""
    need(df, text_col)
    spark = df.sparkSession
    chars = df.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("n")).first()["n"]
    slices = 1 << max(0, (-(-chars // (4 * slice_tokens)) - 1).bit_length() if chars else 0)
    path = new_path(spark, "lm")
    parts = ["words", "times", "once", "often", "often_times"]

    def count(reader):
        import numpy as np
        import pyarrow as pa

        held: list = []

        def emit():
            words, times = np.unique(np.concatenate([x[0] for x in held]), return_counts=True)
            grams, often = np.unique(np.concatenate([x[1] for x in held]) & np.uint64(_KEPT), return_counts=True)
            rows, numbers = [], np.arange(slices + 1)
            of_words, of_grams = (np.searchsorted(_slice_of(x, slices), numbers) for x in (words, grams))
            for s in range(slices):
                w, g = slice(of_words[s], of_words[s + 1]), slice(of_grams[s], of_grams[s + 1])
                if w.stop > w.start or g.stop > g.start:
                    more = often[g] > 1
                    rows.append((s, words[w].tobytes(), times[w].astype("<u4").tobytes(), _pack(grams[g][~more]), _pack(grams[g][more]), often[g][more].astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["slice", *parts])

        n = 0
        for batch in batches(reader, "text", 1_000_000):
            first, word, two, three, _ = _tokens(batch.column("text"))
            if len(word):
                held.append((word, np.concatenate([two, three[~first]])))
                n += len(word)
            if n >= 2_000_000:
                yield emit()
                held, n = [], 0
        if held:
            yield emit()

    def add(reader):
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}
        for batch in reader:
            for r in batch.to_pylist():
                held.setdefault(r["slice"], []).append([r[x] for x in parts])
        for s in sorted(held):
            words, times, once, often, often_times = zip(*held.pop(s))
            words, times = _summed(np.frombuffer(b"".join(words), np.uint64), np.frombuffer(b"".join(times), "<u4").astype(np.int64))
            once, often = _unpack(b"".join(once)), _unpack(b"".join(often))
            grams, counts = _summed(np.concatenate([once, often]), np.concatenate([np.ones(len(once), np.int64), np.frombuffer(b"".join(often_times), "<u4").astype(np.int64)]))
            bits = build_filter(np.concatenate([words & np.uint64(_KEPT), grams]), np.concatenate([times, counts]), bits_per_entry)
            data = np.array([len(bits), len(words)], "<u8").tobytes() + bits + words.tobytes() + times.astype("<i8").tobytes()
            write_file(_slice_path(path, s), data)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (s, int(times.sum()), len(words), len(data))], ["slice", "tokens", "words", "bytes"])

    counted = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "slice bigint, " + ", ".join(f"{x} binary" for x in parts))
    made = written(counted.repartition(slices, "slice").mapInArrow(add, "slice bigint, tokens bigint, words bigint, bytes bigint"), "lm-slices")
    total = made.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tokens", "words", "bytes"))).first()
    # a retried task writes the same files again; slices without tokens have none
    return Model(path, slices, total["tokens"], total["words"], total["bytes"], prior)


def _slice_path(path: str, s: int) -> str:
    return f"{path}/slice-{s:06d}.lm"


class Slices:
    """A model's slices, opened when they are first asked for."""

    def __init__(self, model: Model, held_bytes: int = HELD_BYTES):
        self.model, self.held_bytes, self.read = model, held_bytes, 0
        self.open: OrderedDict[int, tuple] = OrderedDict()

    def _slice(self, s: int):
        """(bytes of the filter, words in order, their counts), or None where no token of the corpus falls."""
        import numpy as np

        if s in self.open:
            self.open.move_to_end(s)
            return self.open[s]
        try:
            data = map_file(_slice_path(self.model.path, s), np.uint8)
        except FileNotFoundError:
            self.open[s] = None
            return None
        mapped, data = isinstance(data, np.memmap), np.asarray(data)
        bits, words = data[:16].view("<u8").tolist()
        found = data[16 : 16 + bits], data[16 + bits : 16 + bits + 8 * words].view("<u8"), data[16 + bits + 8 * words :].view("<i8")
        self.open[s] = found
        if not mapped:
            self.read += len(data)
            while self.read > self.held_bytes and len(self.open) > 1:
                _, old = self.open.popitem(last=False)
                self.read -= sum(x.nbytes for x in old) + 16 if old else 0
        return found

    def _by_slice(self, hashes):
        """(range of the hashes, slice) for each slice that there is."""
        import numpy as np

        of = _slice_of(hashes, self.model.slices)
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else [0]
        for a, b in zip(cuts, cuts[1:]):
            if (found := self._slice(int(of[a]))) is not None:
                yield slice(int(a), int(b)), found

    def levels(self, hashes):
        """The level of each n-gram, 0 if it is not in the filter; ``hashes`` ascend."""
        import numpy as np

        hashes, out, held = hashes & np.uint64(_KEPT), np.zeros(len(hashes), np.int64), []
        for part, (raw, _, _) in self._by_slice(hashes):
            held.append((part, raw))
            # slices that were read, not mapped, are let go in time
            if self.read > self.held_bytes // 2:
                self._probe(hashes, held, out)
                held = []
        self._probe(hashes, held, out)
        return out

    def _probe(self, hashes, held: list, out) -> None:
        """Set the levels of the n-grams of some slices: all places at once, the bytes slice by slice."""
        import numpy as np

        if not held:
            return
        sizes = np.array([part.stop - part.start for part, _ in held])
        of = np.repeat(np.arange(len(held)), sizes)
        live = np.concatenate([np.arange(part.start, part.stop) for part, _ in held])
        bits, level = np.array([8 * len(raw) for _, raw in held], dtype=np.uint64), 1
        while len(live) and level <= 63:
            own, limit = hashes[live], bits[of]
            places = np.stack([_place(own, level, probe, limit) for probe in range(PROBES)])
            at, got = (places >> np.uint64(3)).astype(np.int64), np.empty(places.shape, np.uint8)
            cuts = np.searchsorted(of, np.arange(len(held) + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[k], cuts[k + 1])
                got[:, part] = held[k][1][at[:, part]]
            there = ((got >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
            live, of = live[there], of[there]
            out[live] = level
            level += 1

    def exact(self, hashes):
        """The exact training counts of words; ``hashes`` ascend."""
        import numpy as np

        out = np.zeros(len(hashes), np.int64)
        for part, (_, words, counts) in self._by_slice(hashes):
            if len(words):
                at = np.minimum(np.searchsorted(words, hashes[part]), len(words) - 1)
                out[part] = np.where(words[at] == hashes[part], counts[at], 0)
        return out


_held: dict[str, Slices] = {}


def slices_of(model: Model) -> Slices:
    """This process's open slices; tasks that follow one another in a worker share them."""
    if model.path not in _held:
        _held.clear()
        _held[model.path] = Slices(model)
    return _held[model.path]


def log_probability(model: Model, c_word, c_history, c_two, c_before, c_three):
    """log10 of a word's probability; ``c_before`` counts the two words before it, ``c_history`` the one."""
    import numpy as np

    p = (c_word + 1.0) / model.base_word()
    for joint, before in ((np.minimum(c_two, c_word), c_history), (np.minimum(c_three, c_two), c_before)):
        p = (np.minimum(joint, before) + model.prior * p) / (before + model.prior)
    return np.log10(p)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score of every text."""
    need(df, id_col, text_col)

    def run(reader):
        import numpy as np
        import pyarrow as pa

        slices = slices_of(model)
        for batch in batches(reader, "text", 3_000_000):
            n = len(batch)
            first, word, two, three, owner = _tokens(batch.column("text"))
            some, place = np.unique(word, return_inverse=True)
            exact, known = slices.exact(some)[place], counts_of(slices.levels(some))[place]
            pairs, two_place = np.unique(two, return_inverse=True)
            c_two = counts_of(slices.levels(pairs))[two_place]
            # words that follow a pair which the filter does not hold cannot make a three that it holds
            before = np.concatenate([[0.0], c_two[:-1]])
            before[first] = 0.0
            asked = np.flatnonzero((before > 0) & (c_two > 0))
            threes, three_place = np.unique(three[asked], return_inverse=True)
            c_three = np.zeros(len(word))
            c_three[asked] = counts_of(slices.levels(threes))[three_place]
            # the word before a text's first is the end token, which every text has
            end = known[np.flatnonzero(word == np.uint64(END))[:1]]
            history = np.concatenate([end, known[:-1]]) if len(word) else known
            history[first] = end
            base = np.bincount(owner, np.log10((exact + 1.0) / model.base_word()), n)
            own = np.bincount(owner, log_probability(model, known, history, c_two, before, c_three), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.bincount(owner, minlength=n).astype(np.int64)), pa.array(np.bincount(owner, exact > 0, n).astype(np.int64)), pa.array(base), pa.array(own)],
                ["id", "n_tokens", "n_known", "base_score", "score"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double").withColumnRenamed("id", id_col)


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
