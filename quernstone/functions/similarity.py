"""String similarities of token sets, over arrays of pairs.

Insertions and deletions are counted by the longest common subsequence, whose
bit-parallel recurrence runs over all pairs at once: bit i of a pair's state
says whether row i of its table does not rise, and one step per character of
the second string updates all states.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _codes(texts: list[str], most: int) -> np.ndarray:
    """Code points as a matrix, 0 behind a text's end."""
    out = np.zeros((len(texts), most), dtype=np.uint32)
    for k, x in enumerate(texts):
        if x:
            out[k, : len(x)] = np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32)
    return out


def _lcs_long(a: str, b: str) -> int:
    """For strings of any length, with one whole number as the state."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        u = state & masks.get(c, 0)
        state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs."""
    out = np.zeros(len(a), dtype=np.int64)
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    long = (size_a > 63) & (size_b > 63)
    for k in np.flatnonzero(long):
        out[k] = _lcs_long(a[k], b[k])
    short = np.flatnonzero(~long & (size_a > 0) & (size_b > 0))
    for at in range(0, len(short), 8192):
        part = short[at : at + 8192]
        # the shorter one gives the bits
        pairs = [(a[k], b[k]) if size_a[k] <= size_b[k] else (b[k], a[k]) for k in part]
        first, second = [x for x, _ in pairs], [y for _, y in pairs]
        rows, columns = _codes(first, max(map(len, first))), _codes(second, max(map(len, second)))
        letters, place = np.unique(np.concatenate([rows.ravel(), columns.ravel()]), return_inverse=True)
        rows_at, columns_at = place[: rows.size].reshape(rows.shape), place[rows.size :].reshape(columns.shape)
        masks = np.zeros((len(part), len(letters)), dtype=np.uint64)
        each = np.arange(len(part))
        for i in range(rows.shape[1]):
            here = rows[:, i] > 0
            masks[each[here], rows_at[here, i]] |= np.uint64(1 << i)
        sizes = np.fromiter(map(len, first), np.int64, len(part))
        full = ((np.uint64(1) << sizes.astype(np.uint64)) - np.uint64(1)).astype(np.uint64)
        state = full.copy()
        for j in range(columns.shape[1]):
            u = np.where(columns[:, j] > 0, state & masks[each, columns_at[:, j]], np.uint64(0))
            state = ((state + u) | (state - u)) & full
        out[part] = sizes - np.bitwise_count(state)
    return out


def token_set_ratios(queries: list[list[str]], texts: list[list[str]]) -> np.ndarray:
    """0 to 100 for pairs of sorted distinct words."""
    out = np.zeros(len(queries))
    open_, rest_a, rest_b, common = [], [], [], []
    for k, (q, t) in enumerate(zip(queries, texts)):
        if not q or not t:
            continue
        of_q, of_t = set(q), set(t)
        both = [x for x in q if x in of_t]
        a, b = [x for x in q if x not in of_t], [x for x in t if x not in of_q]
        if both and (not a or not b):
            out[k] = 100.0
            continue
        open_.append(k)
        rest_a.append(" ".join(a))
        rest_b.append(" ".join(b))
        common.append(len(" ".join(both)))
    if open_:
        la, lb = (np.fromiter(map(len, x), np.float64, len(x)) for x in (rest_a, rest_b))
        sect = np.array(common, dtype=np.float64)
        sep = (sect > 0).astype(np.float64)
        dist = la + lb - 2.0 * lcs_lengths(rest_a, rest_b)
        best = 100.0 - 100.0 * dist / (sect + sep + la + sect + sep + lb)
        with_a = 100.0 - 100.0 * (sep + la) / (sect + sect + sep + la)
        with_b = 100.0 - 100.0 * (sep + lb) / (sect + sect + sep + lb)
        out[open_] = np.where(sect > 0, np.maximum(best, np.maximum(with_a, with_b)), best)
    return out


class LetterBits:
    """Texts as bits, one array for each letter of them: the longest common subsequence of a query with all at once."""

    def __init__(self, texts: list[str]):
        self.texts, n = texts, len(texts)
        self.sizes = np.fromiter(map(len, texts), np.float64, n)
        self.long = np.flatnonzero(self.sizes > 64)
        self.full = np.array([0 if len(x) > 64 else (1 << len(x)) - 1 for x in texts], dtype=np.uint64)
        self.places: dict[str, np.ndarray] = {}
        for k, text in enumerate(texts):
            for i, letter in enumerate(text[:64] if len(text) <= 64 else ""):
                if letter not in self.places:
                    self.places[letter] = np.zeros(n, dtype=np.uint64)
                self.places[letter][k] |= np.uint64(1 << i)

    def ratios(self, query: str) -> np.ndarray:
        """``indel_ratios`` of the query with all texts."""
        state = np.full(len(self.texts), np.uint64(2**64 - 1))
        for letter in query:
            if letter in self.places:
                u = state & self.places[letter]
                state = (state + u) | (state - u)
        same = np.bitwise_count(~state & self.full).astype(np.float64)
        if len(self.long):
            same[self.long] = lcs_lengths([query] * len(self.long), [self.texts[k] for k in self.long])
        total = self.sizes + len(query)
        return np.where(total > 0, 100.0 - 100.0 * (total - 2.0 * same) / np.maximum(total, 1.0), 100.0)


    def partial(self, query: str, some: np.ndarray) -> np.ndarray:
        """``_partial_ratio`` of a query that is not empty with some of the texts, none of them empty or long."""
        out, n, full, sizes = np.zeros(len(some)), len(query), self.full[some], self.sizes[some].astype(np.int64)
        everything = np.uint64(2**64 - 1)
        texts = np.flatnonzero(sizes >= n)
        if len(texts):
            # windows of the texts: masks over their bits
            where = {x: self.places[x][some[texts]] for x in set(query) if x in self.places}
            for k in range(1 - n, int(sizes[texts].max())):
                mask = full[texts] & np.uint64(((1 << min(64, k + n)) - 1) ^ ((1 << max(0, k)) - 1))
                state = np.full(len(texts), everything)
                for letter in query:
                    if letter in where:
                        u = state & where[letter] & mask
                        state = (state + u) | (state - u)
                size, same = np.bitwise_count(mask).astype(np.float64), np.bitwise_count(~state & mask)
                out[texts] = np.maximum(out[texts], np.where(size > 0, 100.0 - 100.0 * (n + size - 2.0 * same) / (n + size), 0.0))
        texts = np.flatnonzero(sizes < n)
        if len(texts):
            # windows of the query: from each begin on, letter by letter
            where = {x: self.places[x][some[texts]] for x in set(query) if x in self.places}
            size = sizes[texts]
            for begin in range(n):
                state = np.full(len(texts), everything)
                for j in range(1, min(n - begin, int(size.max())) + 1):
                    letter = query[begin + j - 1]
                    if letter in where:
                        u = state & where[letter]
                        state = (state + u) | (state - u)
                    ends = size >= j if begin == 0 or begin + j == n else size == j
                    if ends.any():
                        same = np.bitwise_count(~state & full[texts])
                        out[texts] = np.maximum(out[texts], np.where(ends, 100.0 - 100.0 * (size + j - 2.0 * same) / (size + j), 0.0))
        return out


class RatioBlock:
    """Texts of one block for any scorer of ``SCORERS``, one query after the other."""

    def __init__(self, texts: list[str], method: str):
        self.texts, self.method = texts, method
        self.sets = TokenBlock(texts) if method != "token_sort" else None
        self.sorted = LetterBits([" ".join(sorted(x.split())) for x in texts]) if method != "token_set" else None
        self.plain = LetterBits(texts) if method in ("w_ratio", "best") else None
        self.distinct = LetterBits([" ".join(x) for x in self.sets.words]) if self.plain else None

    def best_of(self, queries: list[str], limit: int, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """As ``TokenBlock.best_of``, by the block's scorer."""
        return self.sets.best_of(queries, limit, sizes) if self.method == "token_set" else [self.best(x, limit, sizes) for x in queries]

    def best(self, query: str, limit: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``TokenBlock.best``, by the block's scorer."""
        if self.method == "token_set":
            return self.sets.best(query, limit, sizes)
        score = self.ratios(query)
        some = np.flatnonzero(score >= np.partition(score, -limit)[-limit]) if len(score) > limit else np.arange(len(score))
        return some, score[some]

    def ratios(self, query: str) -> np.ndarray:
        if self.method == "token_set":
            return self.sets.ratios(query)
        by_order = self.sorted.ratios(" ".join(sorted(query.split())))
        if self.method == "token_sort":
            return by_order
        by_set = self.sets.ratios(query)
        plain = self.plain.ratios(query)
        out = np.maximum(plain, 0.95 * np.maximum(by_set, by_order))
        size, n = self.plain.sizes, len(query)
        words = sorted(set(query.split()))
        if not words:
            out[:] = w_ratios([query] * len(self.texts), self.texts)
        else:
            one_by_one = (self.sets.n_words == 0) | (size > 64)
            share = np.maximum(size, n) / np.maximum(np.minimum(size, n), 1.0)
            some = np.flatnonzero(~one_by_one & (share >= 1.5))
            scale = np.where(share[some] <= 8.0, 0.9, 0.6)
            common = np.isin(self.sets.tokens, [self.sets.numbers[x] for x in words if x in self.sets.numbers]).any(axis=0)[some]
            rest = np.full(len(some), 100.0)
            rest[~common] = self.distinct.partial(" ".join(words), some[~common])
            by_part = np.maximum(self.sorted.partial(" ".join(sorted(query.split())), some), rest)
            out[some] = np.maximum(plain[some], scale * np.maximum(self.plain.partial(query, some), 0.95 * by_part))
            if one_by_one.any():
                k = np.flatnonzero(one_by_one)
                out[k] = w_ratios([query] * len(k), [self.texts[x] for x in k])
        return out if self.method == "w_ratio" else np.maximum(out, np.maximum(by_set, by_order))


class TokenBlock:
    """Texts of one block as bits, to be compared with one query after the other.

    A text is held as its sorted distinct words, each after a space; for each
    letter of the block one array says where in each text it stands, and one
    array for each place of a word which bits are its own.  The rest of a text
    against a query is the text without the words that both have: these words'
    bits are masked, which changes no state of the recurrence.  So all texts go
    through it at once, a step for each letter of the query, on whole arrays.
    Texts of more than 64 bits are compared one by one.

    Where only the best texts are asked for, bounds from the words and letters that
    both have come first, and the recurrence is left to texts that can be among them.
    """

    def __init__(self, texts: list[str]):
        self.words = [sorted(set(x.split())) for x in texts]
        n, most = len(texts), max((len(x) for x in self.words), default=0)
        self.numbers: dict[str, int] = {}
        self.tokens, self.sizes = np.full((most, n), -1, dtype=np.int32), np.zeros(n)
        self.n_words = np.array([len(x) for x in self.words], dtype=np.int64)
        self.own, self.space = np.zeros((most, n), dtype=np.uint64), np.zeros((most, n), dtype=np.uint64)
        self.long = np.array([sum(map(len, x)) + len(x) > 64 for x in self.words], dtype=bool)
        masks: dict[str, list[int]] = {}
        holders: dict[str, list[int]] = {}
        self.counts: dict[str, np.ndarray] = {}
        self.caps: dict[tuple[str, int], np.ndarray] = {}
        self.most_of = np.dtype(np.int16 if all(sum(map(len, x)) < 1 << 15 for x in self.words) else np.int64)
        for k, found in enumerate(self.words):
            at = 0
            for letter, count in Counter("".join(found)).items():
                if letter not in self.counts:
                    self.counts[letter] = np.zeros(n, dtype=self.most_of)
                self.counts[letter][k] = count
            for j, word in enumerate(found):
                holders.setdefault(word, []).append(k)
                self.tokens[j, k] = self.numbers.setdefault(word, len(self.numbers))
                if not self.long[k]:
                    self.own[j, k], self.space[j, k] = ((1 << (len(word) + 1)) - 1) << at, 1 << at
                    for i, letter in enumerate(f" {word}"):
                        if letter not in masks:
                            masks[letter] = [0] * n
                        masks[letter][k] |= 1 << (at + i)
                at += len(word) + 1
            self.sizes[k] = at - len(found)
        # the last row is of letters that no text has
        self.rows, self.table = {letter: k for k, letter in enumerate(masks)}, np.zeros((len(masks) + 1, n), dtype=np.uint64)
        for k, letter in enumerate(masks):
            self.table[k] = masks[letter]
        self.places = {letter: self.table[k] for letter, k in self.rows.items()}
        self.spaces = np.maximum(self.n_words - 1.0, 0.0)
        self.spelt = self.sizes + self.spaces
        self.holders = {word: np.array(x, dtype=np.int64) for word, x in holders.items()}

    def capped(self, letter: str, most: int) -> np.ndarray:
        """How often each text has a letter, ``most`` at most; kept for other queries, as far as a block's letters usually go."""
        found = self.caps.get((letter, most))
        if found is None:
            # a sum of letters of a text, so no larger than the text
            found = np.minimum(self.counts[letter], self.most_of.type(min(most, np.iinfo(self.most_of).max)))
            if len(self.caps) < 512:
                self.caps[letter, most] = found
        return found

    def bounds(self, query: str) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest token-set ratios that the texts can have, from the words and letters in common; equal where that says all.

        What is left of two texts without their common words shares at most the
        letters that the whole texts share, less those of the common words, and a
        space between each two words.  The formula is that of ``ratios``, so rounding keeps the order.
        """
        asked, n = sorted(set(query.split())), len(self.words)
        if not asked or not n:
            return np.zeros(n), np.zeros(n)
        common, sect_size, letters = np.zeros(n), np.zeros(n), np.zeros(n, dtype=self.most_of)
        for word in asked:
            there = self.holders.get(word)
            if there is not None:
                common[there] += 1.0
                sect_size[there] += float(len(word))
        for letter, count in Counter("".join(asked)).items():
            if letter in self.counts:
                letters += self.capped(letter, count)
        # texts without a common word, where the formula is short
        size = sum(map(len, asked)) + len(asked) - 1.0
        total = self.spelt + size
        low, high = np.zeros(n), 100.0 - 100.0 * (total - 2.0 * (letters + np.minimum(self.spaces, len(asked) - 1.0))) / np.maximum(total, 1.0)
        some = np.flatnonzero(common > 0)
        common, sect_size, n_words = common[some], sect_size[some], self.n_words[some]
        rest_a, rest_b = len(asked) - common, n_words - common
        sect = sect_size + (common - 1.0)
        la = sum(map(len, asked)) - sect_size + np.maximum(rest_a - 1.0, 0.0)
        lb = self.sizes[some] - sect_size + np.maximum(rest_b - 1.0, 0.0)
        most = letters[some] - sect_size + np.maximum(np.minimum(rest_a, rest_b) - 1.0, 0.0)
        least = np.maximum(100.0 - 100.0 * (1.0 + la) / (sect + sect + 1.0 + la), 100.0 - 100.0 * (1.0 + lb) / (sect + sect + 1.0 + lb))
        plain = 100.0 - 100.0 * (la + lb - 2.0 * most) / (sect + 1.0 + la + sect + 1.0 + lb)
        whole = (rest_a == 0) | (rest_b == 0)
        low[some], high[some] = np.where(whole, 100.0, least), np.where(whole, 100.0, np.maximum(plain, least))
        high[self.n_words == 0] = 0.0
        return low, high

    def best(self, query: str, limit: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and ratios of all texts that reach the ratio at which the best ones, each with its size, fill ``limit``; all texts, if they do not."""
        return self.best_of([query], limit, sizes)[0]

    def best_of(self, queries: list[str], limit: int, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``best`` of each query; what is unsure goes through the recurrence for all queries at once."""
        if len(self.words) <= limit:
            return [(np.arange(len(self.words)), self.ratios(x)) for x in queries]

        def reached(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            first = np.flatnonzero(low > 0)
            if len(first) < limit:
                first = np.arange(len(low))
            first = first[np.argpartition(-low[first], limit - 1)[:limit]]
            first = first[np.argsort(-low[first])]
            least = low[first[np.searchsorted(np.cumsum(sizes[first]), limit)]]
            return np.flatnonzero(high >= least)

        def settle(at: list[int], places: list[np.ndarray]) -> None:
            for k, some, score in zip(at, places, self.pairs([queries[k] for k in at], places)):
                low, high = limits[k]
                low[some] = high[some] = score

        limits = [self.bounds(x) for x in queries]
        found = [reached(*x) for x in limits]
        unsure = [some[high[some] > low[some]] for some, (low, high) in zip(found, limits)]
        # the likeliest first: they raise what the others have to reach
        many = [k for k, x in enumerate(unsure) if len(x) > 2 * limit]
        settle(many, [unsure[k][np.argpartition(-limits[k][1][unsure[k]], limit - 1)[:limit]] for k in many])
        for k in many:
            low, high = limits[k]
            found[k] = reached(low, high)
            unsure[k] = found[k][high[found[k]] > low[found[k]]]
        some = [k for k, x in enumerate(unsure) if len(x)]
        settle(some, [unsure[k] for k in some])
        return [(some, low[some]) for some, (low, _) in zip(found, limits)]

    def pairs(self, queries: list[str], places: list[np.ndarray]) -> list[np.ndarray]:
        """``ratios`` of each query with its places.  Pairs of several queries share the steps of the recurrence, a step for each letter of the longest."""
        out, at = [], 0
        while at < len(queries):
            end, room = at, 0
            # bounded arrays: a pair takes its text's words times the query's
            while end < len(queries) and (end == at or room + len(places[end]) <= 16384) and len(queries[end]) <= 128:
                room += len(places[end])
                end += 1
            if end > at and room <= 32768 and any(map(str.split, queries[at:end])):
                out.extend(self._pairs(queries[at:end], places[at:end]))
            else:
                end = max(end, at + 1)
                out.extend(self.ratios(x, some) for x, some in zip(queries[at:end], places[at:end]))
            at = end
        return out

    def _pairs(self, queries: list[str], places: list[np.ndarray]) -> list[np.ndarray]:
        asked = [sorted(set(x.split())) for x in queries]
        counts = [len(x) for x in places]
        of, some = np.repeat(np.arange(len(queries)), counts), np.concatenate(places)
        n, most = len(some), max(map(len, asked))
        numbers = np.full((len(asked), most), -2, dtype=np.int32)
        steps = max(sum(map(len, x)) + len(x) for x in asked)
        # of each step its letter, and its word; an odd row of masks is that of a space
        letters, masked = np.full((steps, len(asked)), len(self.rows), dtype=np.int64), np.zeros((steps, len(asked)), dtype=np.int64)
        for k, words in enumerate(asked):
            step = 0
            for j, word in enumerate(words):
                numbers[k, j] = self.numbers.get(word, -2)
                for i, letter in enumerate(f" {word}"):
                    letters[step, k], masked[step, k] = self.rows.get(letter, len(self.rows)), 2 * j + (i == 0)
                    step += 1
        nothing, n_words = np.uint64(0), np.fromiter(map(len, asked), np.int64, len(asked))[of]
        theirs = numbers[of].T
        hit = self.tokens[:, some][:, None, :] == theirs[None]
        of_text, there = hit.any(axis=1), hit.any(axis=0)
        bits = np.zeros(n, dtype=np.uint64)
        for own, gone in zip(self.own[:, some], of_text):
            bits |= np.where(gone, nothing, own)
        # the first word that is left has no space before it
        bits &= ~np.take_along_axis(self.space[:, some], np.argmin(of_text, axis=0)[None], axis=0)[0]
        masks, first = np.empty((2 * most, n), dtype=np.uint64), np.full(n, True)
        for j in range(most):
            masks[2 * j] = np.where(there[j], nothing, bits)
            masks[2 * j + 1] = np.where(first, nothing, masks[2 * j])
            first &= there[j]
        state, each = np.full(n, np.uint64(2**64 - 1)), np.arange(n)
        flat_table, flat_masks, width = self.table.ravel(), masks.ravel(), self.table.shape[1]
        for letter, mask in zip(letters * width, masked * n):
            u = flat_table.take(letter[of] + some)
            u &= flat_masks.take(mask[of] + each)
            u &= state
            rise = state + u
            state -= u
            state |= rise
        same = np.bitwise_count(~state & bits).astype(np.float64)
        lengths = np.array([[float(len(x)) for x in words] + [0.0] * (most - len(words)) for words in asked])
        common, sect_size = there.sum(axis=0), (there * lengths[of].T).sum(axis=0)
        rest_a, rest_b = n_words - common, self.n_words[some] - common
        sect = sect_size + np.maximum(common - 1, 0)
        la = lengths.sum(axis=1)[of] - sect_size + np.maximum(rest_a - 1, 0)
        lb = self.sizes[some] - sect_size + np.maximum(rest_b - 1, 0)
        out = self._of_parts(same, sect, la, lb)
        out[(common > 0) & ((rest_a == 0) | (rest_b == 0))] = 100.0
        out[(self.n_words[some] == 0) | (n_words == 0)] = 0.0
        long = np.flatnonzero(self.long[some])
        if len(long):
            out[long] = token_set_ratios([asked[of[k]] for k in long], [self.words[some[k]] for k in long])
        return np.split(out, np.cumsum(counts)[:-1])

    @staticmethod
    def _of_parts(same: np.ndarray, sect: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
        sep = (sect > 0).astype(np.float64)
        plain = 100.0 - 100.0 * (la + lb - 2.0 * same) / np.maximum(sect + sep + la + sect + sep + lb, 1.0)
        with_a = 100.0 - 100.0 * (sep + la) / np.maximum(sect + sect + sep + la, 1.0)
        with_b = 100.0 - 100.0 * (sep + lb) / np.maximum(sect + sect + sep + lb, 1.0)
        return np.where(sect > 0, np.maximum(plain, np.maximum(with_a, with_b)), plain)

    def ratios(self, query: str, some: np.ndarray | None = None) -> np.ndarray:
        """Token-set ratios of the query with all texts, or with some."""
        places = range(len(self.words)) if some is None else some
        tokens, owns, spaces, n_words, sizes = (x if some is None else x[..., some] for x in (self.tokens, self.own, self.space, self.n_words, self.sizes))
        asked, n = sorted(set(query.split())), len(places)
        if not asked or not n:
            return np.zeros(n)
        everything, nothing = np.uint64(2**64 - 1), np.uint64(0)
        common, sect_size, bits = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n, dtype=np.uint64)
        of_text, theirs = np.zeros(tokens.shape, dtype=bool), []
        for word in asked:
            number = self.numbers.get(word)
            if number is None:
                theirs.append(None)
                continue
            hit = tokens == number
            there = hit.any(axis=0)
            of_text |= hit
            common += there
            sect_size += there * float(len(word))
            theirs.append(there)
        for own, hit in zip(owns, of_text):
            bits |= np.where(hit, nothing, own)
        # the first word that is left has no space before it
        if len(spaces):
            bits &= ~np.take_along_axis(spaces, np.argmin(of_text, axis=0)[None], axis=0)[0]
        state, first = np.full(n, everything), np.full(n, True)
        u, rise = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
        for word, there in zip(asked, theirs):
            mask = bits if there is None else np.where(there, nothing, bits)
            for letter in f" {word}":
                where = self.places.get(letter)
                if where is None:
                    continue
                np.bitwise_and(state, where if some is None else where[some], out=u)
                np.bitwise_and(u, np.where(first, nothing, mask) if letter == " " else mask, out=u)
                np.add(state, u, out=rise)
                np.subtract(state, u, out=state)
                np.bitwise_or(state, rise, out=state)
            first &= there if there is not None else False
        same = np.bitwise_count(~state & bits).astype(np.float64)
        rest_a, rest_b = len(asked) - common, n_words - common
        sect = sect_size + np.maximum(common - 1, 0)
        la = sum(map(len, asked)) - sect_size + np.maximum(rest_a - 1, 0)
        lb = sizes - sect_size + np.maximum(rest_b - 1, 0)
        out = self._of_parts(same, sect, la, lb)
        out[(common > 0) & ((rest_a == 0) | (rest_b == 0))] = 100.0
        out[n_words == 0] = 0.0
        long = np.flatnonzero(self.long if some is None else self.long[some])
        if len(long):
            out[long] = token_set_ratios([asked] * len(long), [self.words[places[k]] for k in long])
        return out


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 100 from insertions and deletions; 100 for two empty strings."""
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], dtype=np.float64)
    same = lcs_lengths(a, b)
    return np.where(total > 0, 100.0 - 100.0 * (total - 2.0 * same) / np.maximum(total, 1.0), 100.0)


def _partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length, or less at the ends, of the longer."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n, m = len(short), len(long)
    windows = {long[max(0, k) : k + n] for k in range(1 - n, m)}
    return float(indel_ratios([short] * len(windows), list(windows)).max())


def w_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """A weighted mix: plain and token ratios for strings of like length, partial ones beyond."""
    plain = indel_ratios(a, b)
    sets_a, sets_b = [sorted(set(x.split())) for x in a], [sorted(set(x.split())) for x in b]
    token = np.maximum(token_set_ratios(sets_a, sets_b), indel_ratios([" ".join(sorted(x.split())) for x in a], [" ".join(sorted(x.split())) for x in b]))
    out = np.maximum(plain, 0.95 * token)
    for k, (x, y) in enumerate(zip(a, b)):
        if not x or not y:
            out[k] = 0.0
            continue
        share = max(len(x), len(y)) / min(len(x), len(y))
        if share >= 1.5:
            scale = 0.9 if share <= 8.0 else 0.6
            joined = " ".join(sorted(x.split())), " ".join(sorted(y.split()))
            rest = " ".join(w for w in sets_a[k] if w not in sets_b[k]), " ".join(w for w in sets_b[k] if w not in sets_a[k])
            sets = 100.0 if set(sets_a[k]) & set(sets_b[k]) else _partial_ratio(*rest)
            out[k] = max(plain[k], scale * _partial_ratio(x, y), 0.95 * scale * max(_partial_ratio(*joined), sets))
    return out


def _words(texts: pd.Series) -> list[list[str]]:
    return [sorted(set(x.split())) if x else [] for x in texts]


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(token_set_ratios(_words(a), _words(b)))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indel_ratios([" ".join(sorted((x or "").split())) for x in a], [" ".join(sorted((x or "").split())) for x in b]))


@F.pandas_udf(DoubleType())
def w_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(w_ratios([x or "" for x in a], [x or "" for x in b]))


def best_ratio(a: Column, b: Column) -> Column:
    return F.greatest(w_ratio(a, b), token_set_ratio(a, b), token_sort_ratio(a, b))


#: Scorers by name: functions of (lists of texts, lists of texts) to 0..100.
SCORERS: dict[str, Callable[[list[str], list[str]], np.ndarray]] = {
    "token_set": lambda a, b: token_set_ratios([sorted(set(x.split())) for x in a], [sorted(set(x.split())) for x in b]),
    "token_sort": lambda a, b: indel_ratios([" ".join(sorted(x.split())) for x in a], [" ".join(sorted(x.split())) for x in b]),
    "w_ratio": w_ratios,
}
SCORERS["best"] = lambda a, b: np.maximum(SCORERS["w_ratio"](a, b), np.maximum(SCORERS["token_set"](a, b), SCORERS["token_sort"](a, b)))
