"""Token ids of whole texts with a given byte-level tokenizer file, for use inside Spark tasks.

Texts of natural language repeat their words. The tokenizer cuts a text into pieces first and encodes each piece alone;
a piece never holds a non-space character before a space, so a text can be cut before each space that has no other white
space beside it, and the ids of a text are those of its words in order. Pieces also end where a letter meets a digit or a mark, and on both sides of
a single line end, so that a word is found again whatever stands behind it. A batch's distinct words are found by Arrow's
dictionary encoding, a worker remembers words and pieces up to a bound and forgets rare ones first, and ids are gathered with numpy. New words of letters
alone are pieces already; only the others are cut one by one. A text with mixed white space is one word, encoded as it is. The results are those of the
tokenizer on the whole text.
"""

from __future__ import annotations

import ctypes
import os
from itertools import compress, repeat

import numpy as np
import pyarrow as pa

#: Words, and pieces of words, that a worker remembers before it forgets those that it met in one batch only, then the rarer
#: half; results don't depend on it.
MAX_WORDS, MAX_PIECES = 300_000, 300_000
#: Texts that are encoded at once: what a batch needs beside the known words is that of so many texts.
TEXTS = 500
#: Letters below this code point are classed alike by Python and by the tokenizer; other words go to the tokenizer whole.
PLAIN_BELOW = 0x250
#: Of each byte: an ASCII letter, another visible ASCII character, the lead of a letter of two bytes below U+0240.
LETTER, MARK, LEAD = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = MARK
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[0xC3:0xC9] = LEAD
_ENCODERS: dict[str, "Encoder"] = {}
#: Of the C library, where it has such a function.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 onwards."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


def give_back() -> None:
    """Return freed memory to the system. A worker is reused and waits while the JVM works; without this it holds on to about as much
    as the words it knows."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


class _Known:
    """Numbered keys with a list of ids each, and how often each was asked for."""

    def __init__(self):
        self.number: dict = {}
        self.ids, self.begin, self.uses = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def add(self, keys: list, ids: np.ndarray, lens: np.ndarray) -> None:
        n, base = len(self.number), int(self.begin[len(self.number)])
        end, upto = n + len(keys), base + len(ids)
        if end + 1 > len(self.begin):
            self.begin, self.uses = np.resize(self.begin, 2 * end + 1), np.resize(self.uses, 2 * end + 1)
        if upto > len(self.ids):
            self.ids = np.resize(self.ids, 2 * upto)
        self.ids[base:upto] = ids
        self.begin[n + 1:end + 1] = base + np.cumsum(lens, dtype=np.int64)
        self.uses[n:end] = 0
        self.number.update(zip(keys, range(n, end)))

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered lists one after another, and each one's length."""
        first = self.begin[which]
        lens = self.begin[which + 1] - first
        ends = np.cumsum(lens)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lens), lens)], lens

    def forget(self, most: int) -> "_Known":
        """What to go on with: the same, or less once more than `most` keys are known."""
        if len(self.number) <= most:
            return self
        uses = self.uses[:len(self.number)]
        kept = np.flatnonzero(uses >= max(2, np.partition(uses, -most // 2)[-most // 2] + 1))
        keys, rest = list(self.number), _Known()
        rest.add([keys[i] for i in kept.tolist()], *self.gather(kept))
        rest.uses[:len(kept)] = uses[kept] // 2
        return rest


class Encoder:
    """Encodes batches of texts; `get` shares one per worker and tokenizer file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.pieces_only = Tokenizer.from_file(path)
        self.pieces_only.encode_special_tokens = True
        self.pieces_only.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")  # pieces are given in byte letters, one a line
        self.letters = _byte_letters()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        vocabulary = self.pieces_only.get_vocab(with_added_tokens=False)
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte letter each
        self.id_bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.words, self.pieces = _Known(), _Known()

    @staticmethod
    def get(path: str) -> "Encoder":
        if path not in _ENCODERS:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def _cut(self, word: str) -> list[str]:
        body = word[1:] if word[:1] == " " else word
        if not word.isascii() and max(map(ord, body)) >= PLAIN_BELOW:
            return [word]  # the tokenizer cuts it
        if body.isalpha():
            return [word]
        if body[-1:] in ".,!?;:" and body[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pattern.findall(word)

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces without line ends, and each one's length; the bytes of the ids tell where a piece ends."""
        letters = b"\n".join(pieces).decode("latin-1").translate(self.letters | {10: "\n"})
        ids = np.array(self.pieces_only.encode_batch_fast([letters], add_special_tokens=False)[0].ids, np.int32)
        upto = np.cumsum(self.id_bytes[ids])
        ends = np.searchsorted(upto, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))) + 1
        return ids, np.diff(ends, prepend=0)

    def _learn_pieces(self, new: list[str]) -> None:
        plain = [p for p in new if "\n" not in p and (p.isascii() or max(map(ord, p)) < PLAIN_BELOW)]
        if plain:
            self.pieces.add(plain, *self._encode_pieces([p.encode() for p in plain]))
        if len(plain) < len(new):
            rest = [p for p in new if p not in self.pieces.number]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            self.pieces.add(rest, np.array([i for ids in got for i in ids], np.int32), np.array([len(x) for x in got]))

    def _learn_words(self, new: list[bytes]) -> None:
        """New words of letters alone, with a space before them or not, are single pieces; the others are cut first."""
        lens = np.fromiter(map(len, new), np.int64, len(new))
        data = np.frombuffer(b"".join(new), np.uint8)
        starts = np.cumsum(lens) - lens
        plain = self._letters(data) | (_KIND[data] == LEAD)  # a lead that no letter follows is found by the byte behind it
        first = plain[starts] | (data[starts] == 32) & (lens > 1)
        plain[starts] = first
        alone = np.logical_and.reduceat(plain, starts)
        if alone.any():
            words = list(compress(new, alone))
            self.words.add(words, *self._encode_pieces(words))
        if not alone.all():
            self._learn_mixed_words(list(compress(new, ~alone)))

    def _learn_mixed_words(self, new: list[bytes]) -> None:
        cut = [self._cut(w.decode()) for w in new]
        flat = [p for ps in cut for p in ps]
        self._learn_pieces(list(dict.fromkeys(p for p in flat if p not in self.pieces.number)))
        which = np.fromiter(map(self.pieces.number.__getitem__, flat), np.int64, len(flat))
        self.pieces.uses[:len(self.pieces.number)] += np.bincount(which, minlength=len(self.pieces.number)).astype(np.int32)
        ids, lens = self.pieces.gather(which)
        upto = np.concatenate([[0], np.cumsum(lens)])
        ends = upto[np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))]
        self.words.add(new, ids, np.diff(np.concatenate([[0], ends])))

    @staticmethod
    def _letters(data: np.ndarray) -> np.ndarray:
        """Whether a letter ends at a byte: of ASCII, or of two bytes below U+0240."""
        kind = _KIND[data]
        ends = kind == LETTER
        at = np.flatnonzero(kind[:-1] == LEAD) + 1
        low = data[at]
        ends[at] = ((low & 0xC0) == 0x80) & ~((data[at - 1] == 0xC3) & ((low == 0x97) | (low == 0xB7)))
        return ends

    @classmethod
    def _borders(cls, data: np.ndarray) -> np.ndarray:
        """Whether a piece begins at a byte that is no space: a mark or digit behind a letter, a single line end, what follows it."""
        begins = np.zeros(len(data), bool)
        begins[1:] = cls._letters(data)[:-1] & (_KIND[data[1:]] == MARK)
        ends = np.flatnonzero(data[1:-1] == 10) + 1
        ends = ends[(data[ends - 1] > 32) & (data[ends + 1] > 32)]
        begins[ends] = begins[ends + 1] = True
        return begins

    @staticmethod
    def _mixed(data: np.ndarray) -> np.ndarray:
        """Positions that show a text with white space beside a space, or with white space outside ASCII."""
        low = data <= 32
        beside = np.flatnonzero(low[1:] & low[:-1] & ((data[1:] == 32) | (data[:-1] == 32)))
        lead = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
        a, b, c = data[lead].astype(np.int64), data[np.minimum(lead + 1, len(data) - 1)], data[np.minimum(lead + 2, len(data) - 1)]
        wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        wide |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        return np.concatenate([beside, lead[wide]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text; a null text has none."""
        texts = pa.array(texts)
        parts = [self._encode_part(texts.slice(at, TEXTS)) for at in range(0, max(1, len(texts)), TEXTS)]
        give_back()
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))

    def _encode_part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        self.words, self.pieces = self.words.forget(MAX_WORDS), self.pieces.forget(MAX_PIECES)
        texts = texts.fill_null("").cast(pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        cut = (data == 32) | self._borders(data)
        for d in np.unique(np.searchsorted(offsets, self._mixed(data), "right") - 1):
            cut[offsets[d]:offsets[d + 1]] = False
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.append(np.flatnonzero(cut), len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        known = self.words.number
        number = np.fromiter(map(known.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(unknown := np.flatnonzero(number < 0)):
            new = distinct[unknown].tolist()
            self._learn_words(new)
            number[unknown] = np.fromiter(map(known.__getitem__, new), np.int64, len(new))
        self.words.uses[number] += 1
        flat, lens = self.words.gather(number[coded.indices.to_numpy()])
        upto = np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(starts[:-1], offsets, "left")]
        return flat, np.diff(upto)
