"""Token ids by the tokenizers library, with each distinct part of a text encoded once by a worker.

The byte-level vocabulary splits a text by a pattern before merging. Some places always part two matches of
that pattern, whatever stands around them: before a space that is followed by something other than white
space; before a line feed between two characters that are not white space; between a letter or digit and ASCII
punctuation (the apostrophe left out, as it opens contractions). So a text can be cut there, its parts encoded
one by one and the ids joined: the ids are those of the whole text. Where in doubt, no cut is made.

Parts recur, so each is looked up, by a hash of its bytes, in a table that the worker keeps; the bytes of every
part are then compared with those kept, so equal hashes of different parts do no harm. A long text is gone
through in stretches that end at a cut; only a stretch without any is as long as it happens to be.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from panelforge.llm.common import KEPT, bytes_of, span_hashes

VOCABULARY = "byte_bpe_50k.json"
#: Distinct parts that a worker keeps (about 60 bytes each); those met later are encoded anew for each stretch.
KNOWN_PARTS = 1_000_000
#: Parts that the library encodes in one string; more in one take it longer for each.
LEARNT = 100
#: Bytes whose parts are looked up at once.
STRETCH = 1 << 20

SPACE, FEED = 0x20, 0x0A
#: Bytes that are white space by themselves (a wide reading), and those that may begin a longer white character.
WHITE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
WHITE_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
#: ASCII punctuation and symbols but the apostrophe.
PUNCTUATION = np.array([0x21 <= i < 0x7F and not chr(i).isalnum() and i != 0x27 for i in range(256)])


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def white_bytes(b: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 text belongs to a character of white space, in a wide reading."""
    white = WHITE[b]
    lead = np.flatnonzero(WHITE_LEAD[b])
    if len(lead):
        around = np.append(b, np.zeros(2, np.uint8))
        x, y, z = b[lead], around[lead + 1], around[lead + 2]
        two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
        three = (x == 0xE1) & (((y == 0x9A) & (z == 0x80)) | ((y == 0xA0) & (z == 0x8E)))
        three |= (x == 0xE2) & (y == 0x80) & (((z >= 0x80) & (z <= 0x8D)) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
        three |= ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
        for k, found in ((0, two | three), (1, two | three), (2, three)):
            at = lead[found] + k
            white[at[at < len(b)]] = True
    return white


def part_starts(b: np.ndarray, bounds: np.ndarray, goes_on: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(where parts start, which bytes are white) in the texts between ``bounds`` of the bytes ``b``; ``goes_on``: the last text
    has more bytes, so no part starts where that could matter."""
    white = white_bytes(b)
    opens = np.zeros(len(b), bool)  # the same text goes on, and not with white space
    opens[:-1] = ~white[1:]
    opens[bounds[1:][np.diff(bounds) > 0] - 1] = False
    letter = ALNUM[b]
    latin = np.flatnonzero(b[:-1] == 0xC3)  # the letters of Latin-1, but for its two signs
    latin = latin[(b[latin + 1] != 0x97) & (b[latin + 1] != 0xB7)]
    letter[latin + 1] = True
    cut = (b == SPACE) & opens
    cut[1:] |= (b[1:] == FEED) & opens[1:] & ~white[:-1]
    cut[1:] |= PUNCTUATION[b[1:]] & letter[:-1]
    if goes_on:
        cut[-4:] = False
    cut[bounds[:-1][bounds[:-1] < len(b)]] = True
    return np.flatnonzero(cut), white


class Encoder:
    """Encodes texts as whole texts would be, special tokens as ordinary text, without added ones."""

    def __init__(self, path: str | None = None, known_parts: int = KNOWN_PARTS):
        self.known_parts = known_parts
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # a byte-level token has a character for each byte
            self.token_bytes[i] = len(token)
        # By number of a part, from 1: its hash, and where its bytes and its ids lie. ``slots`` finds a number by hash.
        self.hashes = np.zeros(1 << 14, np.uint64)
        self.at, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.bytes = np.zeros(1 << 16, np.uint8)
        self.flat = np.zeros(1 << 16, np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32)
        self.n, self.used_bytes, self.used = 1, 0, 0
        self.slots, self.bits = np.zeros(1 << 16, np.int32), 16

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the part with each hash, 0 if there is none."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slots[slot]
        open_ = np.flatnonzero((found > 0) & (self.hashes[found] != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            now = self.slots[slot[open_]]
            found[open_] = now
            open_ = open_[(now > 0) & (self.hashes[now] != hashes[open_])]
        return found

    def _place(self, numbers: np.ndarray) -> None:
        """Enters numbers, whose hashes differ, into the table, which is kept at most half full."""
        while self.n * 2 > len(self.slots):
            self.bits += 1
            self.slots, numbers = np.zeros(1 << self.bits, np.int32), np.arange(1, self.n)
        slot = (self.hashes[numbers] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(numbers):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = numbers[free]
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _encoded(self, b: np.ndarray, white: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of the parts, their ids in that order, how many each has). Parts that begin with a space or a line feed and
        hold no other white space open a match after one another, so the library may encode many in one string; the
        bytes that tokens stand for tell where a part ends."""
        more = np.append(0, np.cumsum(white))
        plain = ((b[starts] == SPACE) | (b[starts] == FEED)) & (sizes > 1) & (more[starts + sizes] - more[starts + 1] == 0)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        raw = b.tobytes()
        parts = [raw[s : s + n] for s, n in zip(starts[order].tolist(), sizes[order].tolist(), strict=True)]
        k = int(plain.sum())
        ids = self.direct([b"".join(parts[i : min(k, i + LEARNT)]).decode() for i in range(0, k, LEARNT)])
        ids = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int64)
        at = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(sizes[order][:k])) + 1
        others = self.direct([p.decode() for p in parts[k:]])
        lengths = np.concatenate([np.diff(at, prepend=0), np.array([len(x) for x in others], np.int64)])
        return order, np.concatenate([ids, *others]), lengths

    def _learn(self, b: np.ndarray, white: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        """Adds parts under the next numbers; the table of hashes does not know them yet."""
        order, ids, lengths = self._encoded(b, white, starts, sizes)
        need, total, filled = self.n + len(starts), self.used + len(ids), self.used_bytes + int(sizes.sum())
        while need > len(self.starts):
            for name in ("hashes", "at", "sizes", "starts", "lengths"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held, np.zeros_like(held)]))
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while filled > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.flat[self.used : total] = ids
        self.starts[self.n + order] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n + order] = lengths
        self.hashes[self.n : need], self.sizes[self.n : need] = hashes, sizes
        first = np.cumsum(sizes) - sizes
        self.at[self.n : need] = self.used_bytes + first
        self.bytes[self.used_bytes : filled] = b[np.repeat(starts - first, sizes) + np.arange(filled - self.used_bytes)]
        self.n, self.used, self.used_bytes = need, total, filled

    def _ids(self, b: np.ndarray, starts: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all parts, where each part's end among them); the parts cover ``b``."""
        sizes = np.diff(starts, append=len(b))
        if len(b) > 4 * STRETCH:  # a stretch without a cut: nothing to look up
            raw = b.tobytes()
            lists = self.direct([raw[s : s + n].decode() for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
            return np.concatenate(lists), np.cumsum([len(x) for x in lists])
        hashes = span_hashes(b, starts, starts + sizes)
        numbers = self._find(hashes).astype(np.int64)
        new = np.flatnonzero(numbers == 0)
        if len(new):
            distinct, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            numbers[new] = self.n + which
            before = self.n, self.used, self.used_bytes
            self._learn(b, white, starts[new[first]], sizes[new[first]], distinct)
            if self.n - 1 <= self.known_parts:
                self._place(np.arange(before[0], self.n))
                before = self.n, self.used, self.used_bytes
        else:
            before = self.n, self.used, self.used_bytes
        unlike = self.sizes[numbers] != sizes
        places = np.repeat(self.at[numbers] - starts, sizes) + np.arange(len(b))
        unlike |= np.add.reduceat(self.bytes[np.clip(places, 0, len(self.bytes) - 1)] != b, starts, dtype=np.int64) > 0
        if unlike.any():  # another part has the same hash
            numbers[unlike] = self.n + np.arange(unlike.sum())
            self._learn(b, white, starts[unlike], sizes[unlike], hashes[unlike])
        lengths = self.lengths[numbers].astype(np.int64)
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[numbers] - (ends - lengths), lengths) + np.arange(ends[-1])]
        self.n, self.used, self.used_bytes = before  # what the table does not know is not kept
        return ids.astype(np.uint32), ends

    def _long(self, b: np.ndarray) -> np.ndarray:
        """The ids of a text of any length, gone through in stretches that end at a cut."""
        out, at, size = [], 0, STRETCH
        while at < len(b):
            piece, goes_on = b[at : at + size], at + size < len(b)
            starts, white = part_starts(piece, np.array([0, len(piece)]), goes_on)
            if goes_on and len(starts) < 2:
                size *= 2
                continue
            if goes_on:
                piece, white, starts = piece[: starts[-1]], white[: starts[-1]], starts[:-1]
            out.append(self._ids(piece, starts, white)[0])
            at, size = at + len(piece), STRETCH
        return np.concatenate(out)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text; null is the empty text."""
        data, bounds = bytes_of(texts)
        out, i = [], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + STRETCH, side="right")) - 1)
            b, own = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            if len(b) > STRETCH:
                out.append(self._long(b))
            elif not len(b):
                out += [np.zeros(0, np.uint32)] * (j - i)
            else:
                starts, white = part_starts(b, own)
                ids, ends = self._ids(b, starts, white)
                out += np.split(ids, np.append(0, ends)[np.searchsorted(starts, own[1:-1])])
            i = j
        return out


_ENCODERS: dict[tuple, Encoder] = {}
KEPT["tokens"] = _ENCODERS.clear


def encoder(path: str | None = None, known_parts: int = KNOWN_PARTS) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    key = path or "", known_parts
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, known_parts)
    return _ENCODERS[key]
