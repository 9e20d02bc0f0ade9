"""Token ids from public tokenizer files, for whole batches of texts.

The ids are those of ``tokenizers.Tokenizer.encode(text,
add_special_tokens=False)``.  Natural text repeats its words, so the encoder
cuts a batch of texts into pieces and asks the library only for pieces that it
has not met, all of a batch at once.  Cuts lie only where the vocabulary's own
pre-tokenizer always cuts: around white space, if the vocabulary drops it, and
before each run of white space, if words carry it; a text for which the cuts
are not certain is one piece.  A new piece of Latin letters with marks at its end
goes to the library's model part by part, which is faster than its whole
tokenizer; whether a vocabulary's tokenizer takes such pieces apart in the same
way is tried on examples of all letters and marks when it is opened, and if it
does not, every piece goes to the whole tokenizer.

Pieces are told apart by their bytes: those of up to 15 bytes are two numbers,
found by a hash of these and then compared, longer ones are kept as they are.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from .hashing import _SPACE, SHORT, flat, mix, pair_keys

#: Pieces remembered by one worker; it starts anew beyond that.
CACHE_PIECES = 1_000_000
#: Longer pieces are not remembered.
LONGEST_PIECE = 256
#: Pieces of so many bytes at most are held as two numbers.
_PAIR = 2 * SHORT + 1


#: A piece that pre-tokenizers cut into its letters and its marks; not so with an apostrophe.
_SIMPLE = re.compile(r"""([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)""")


def _byte_characters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: visible ones stand for themselves, others for those from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in visible]
    return {x: chr(x) for x in visible} | {x: chr(256 + k) for k, x in enumerate(others)}


class BatchEncoder:
    """``encode(texts)`` gives the ids of an Arrow string array's texts, and how many each has.

    ``kind`` is ``"bytes"`` for byte-level vocabularies whose words carry the
    white space before them, ``"words"`` for vocabularies that drop white space
    and ``"whole"`` to hand every text to the library uncut.
    """

    def __init__(self, path: str, kind: str | None = None, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = kind or self._kind()
        self.cache_pieces = cache_pieces
        self.characters = _byte_characters()
        self.marks: dict[str, list[int]] = {}
        self.by_parts = self.kind != "whole" and self._takes_parts()
        self._forget()

    def _takes_parts(self) -> bool:
        """Whether simple pieces are the ids of their parts, for examples of all letters and marks."""
        letters = "".join(chr(x) for x in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if chr(x) not in "×÷")
        marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
        words = [letters[k : k + n] for n in (1, 2, 5, 9) for k in range(0, len(letters), n)] + ["don", "WeLl", "naïve", "Straße", "internationalisation"]
        ends = ["", *marks, *(a + b for a, b in zip(marks, marks[1:] + marks[:1])), "...", "\"),", "--", "://", "|>", "<|"]
        some = [b + w + e for k, w in enumerate(words) for b in (["", " ", "\n"] if self.kind == "bytes" else [""]) for e in (ends if k % 29 == 0 else ["", ends[k % len(ends)]])]
        return [self._parts(_SIMPLE.fullmatch(x)) for x in some] == [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _model(self, word: str) -> list[int]:
        """The ids of what the pre-tokenizer leaves in one piece."""
        if not word.isascii() or word[0] in " \n":
            word = word.encode().decode("latin-1").translate(self.characters)
        return [x.id for x in self.model.tokenize(word)]

    def _parts(self, simple) -> list[int]:
        """The ids of a simple piece."""
        before, letters, marks = simple.groups()
        if self.kind == "words":
            ids = self._model(letters.lower())
        elif before == "\n":
            ids = self._model("\n") + self._model(letters)
        else:
            ids = self._model(before + letters)
        if marks:
            if marks not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks = {}
                self.marks[marks] = self._model(marks)
            ids = ids + self.marks[marks]
        return ids

    def _forget(self) -> None:
        """Known pieces by number: where their ids begin in the store, and how many they are."""
        self.keys, self.low, self.high, self.number = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.long: dict[bytes, int] = {}
        self.begins, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.store, self.stored = np.empty(1 << 16, np.uint32), 0

    def _kind(self) -> str:
        if str(self.tokenizer.pre_tokenizer).startswith("ByteLevel") and self.tokenizer.normalizer is None:
            return "bytes"
        return "words" if str(self.tokenizer.model).find('end_of_word_suffix="</w>"') >= 0 else "whole"

    def _cut(self, data, offsets):
        """Begins and ends of the pieces, and the number of each text's pieces."""
        n = len(data)
        if self.kind == "whole":
            full = np.diff(offsets) > 0
            return offsets[:-1][full], offsets[1:][full], full.astype(np.int64)
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate([[False], solid[:-1]]) & ~edge[:-1]
        if self.kind == "words":
            after = np.concatenate([solid[1:], [False]]) & ~edge[1:]
            begins, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
            return begins, ends, np.diff(np.searchsorted(begins, offsets))
        cut = edge[:-1] | (~solid & before)
        # white space beyond ASCII, perhaps: such a text stays whole
        follow = data[1:]
        odd = ((data[:-1] == 0xC2) & ((follow == 0x85) | (follow == 0xA0))) | ((data[:-1] == 0xE1) & (follow == 0x9A)) | ((data[:-1] == 0xE2) & ((follow == 0x80) | (follow == 0x81))) | ((data[:-1] == 0xE3) & (follow == 0x80))
        for text in np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1).tolist():
            cut[offsets[text] + 1 : offsets[text + 1]] = False
        begins = np.flatnonzero(cut)
        return begins, np.concatenate([begins[1:], [n]]), np.diff(np.searchsorted(begins, offsets))

    def _learn(self, pieces: list[bytes]) -> int:
        """Ask the library for the ids of new pieces; returns the number of the first."""
        texts = [x.decode() for x in pieces]
        simple = [_SIMPLE.fullmatch(x) if self.by_parts else None for x in texts]
        others = iter(self.tokenizer.encode_batch_fast([x for x, m in zip(texts, simple) if not m], add_special_tokens=False))
        found = [self._parts(m) if m else next(others).ids for m in simple]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        end = self.stored + int(sizes.sum())
        if end > len(self.store):
            self.store = np.concatenate([self.store[: self.stored], np.empty(max(end, 2 * len(self.store)) - self.stored, np.uint32)])
        self.store[self.stored : end] = np.fromiter(chain.from_iterable(found), np.uint32, end - self.stored)
        first = len(self.begins)
        self.begins = np.concatenate([self.begins, self.stored + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.stored = end
        return first

    def _numbers(self, data, begins, ends):
        """The number of each piece; new ones are learned."""
        raw, sizes = data.tobytes(), ends - begins
        out, short = np.empty(len(begins), np.int64), np.flatnonzero(sizes <= _PAIR)
        low, high = pair_keys(data, begins[short], sizes[short])
        keys, first, place = np.unique(mix(low ^ mix(high)), return_index=True, return_inverse=True)
        one, two = low[first], high[first]
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(0, len(self.keys) - 1))
        known = self.keys[near] == keys if len(self.keys) else np.zeros(len(keys), bool)
        # pieces whose hash another piece has go with the long ones
        clash = known & ((self.low[near] != one) | (self.high[near] != two)) if len(self.keys) else known
        odd = (one[place] != low) | (two[place] != high) | clash[place]
        new = np.flatnonzero(~known)
        long = np.concatenate([np.flatnonzero(sizes > _PAIR), short[odd]])
        texts = [raw[a:b] for a, b in zip(begins[long].tolist(), ends[long].tolist())]
        numbers = [self.long.get(x, -1) for x in texts]
        unknown = list(dict.fromkeys(x for x, n in zip(texts, numbers) if n < 0))
        if len(new) or unknown:
            which = short[first[new]]
            number = self._learn([raw[a:b] for a, b in zip(begins[which].tolist(), ends[which].tolist())] + unknown)
            for name, values in (("keys", keys[new]), ("low", one[new]), ("high", two[new]), ("number", number + np.arange(len(new)))):
                setattr(self, name, np.insert(getattr(self, name), at[new], values))
            fresh = {x: number + len(new) + k for k, x in enumerate(unknown)}
            numbers = [fresh[x] if n < 0 else n for x, n in zip(texts, numbers)]
            self.long.update((x, n) for x, n in fresh.items() if len(x) <= LONGEST_PIECE)
        if len(keys):
            out[short] = self.number[np.searchsorted(self.keys, keys)][place]
        out[long] = numbers
        return out

    def encode(self, texts):
        if len(self.begins) > self.cache_pieces or self.stored > 16 * self.cache_pieces:
            self._forget()
        data, offsets = flat(texts)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        begins, ends, per_text = self._cut(data, offsets)
        number = self._numbers(data, begins, ends)
        sizes = self.sizes[number]
        total = np.cumsum(sizes)
        n = int(total[-1]) if len(total) else 0
        ids = self.store[np.repeat(self.begins[number] - (total - sizes), sizes) + np.arange(n)]
        ends_at = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(ends_at)


_encoders: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """This process's encoder for a file; tasks that follow one another in a worker share its memory."""
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]


def with_end(ids, counts, end_id: int):
    """The texts' ids one by one, each with the end id."""
    at = 0
    for n in counts.tolist():
        out = np.empty(n + 1, dtype="<u4")
        out[:n], out[n] = ids[at : at + n], end_id
        at += n
        yield out
