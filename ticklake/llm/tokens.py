"""Tokenizer encoding with a bounded cache of words.

The public tokenizers used here cut a text at white space before they look at anything else, so the
ids of a text are the ids of its words one after the other. Words repeat: a look-up per word, done
for a whole block of texts at once in numpy, is several times faster than encoding every text anew.
Words not seen yet go to the library. A cached word is found by all its bytes (two numbers of eight bytes
and its length), never by a hash alone; words of more than 16 bytes are kept in a dictionary by their bytes.

The ids are those of the library's ``encode(text, add_special_tokens=False)``. A text that holds the
string of an added token (``<|endoftext|>``) goes to the library whole. Other texts are cut at a single
space whose next character is no white space: white space before that space stays with the word before
it, where the tokenizer sees the same run of white space, followed by the end instead of the space.
Bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import os
import re

import numpy as np
from tokenizers import Tokenizer

from ticklake.llm.textblocks import lanes, mix64

#: Slots of the word cache and how many may be filled; a full cache starts anew (about 30 MB a worker).
SLOTS, FILLED = 1 << 20, 700_000
#: Parts of words, and words of more than ``SHORT`` bytes, kept besides; ids and bytes that the latter may have in all.
PIECES, LONG_IDS = 50_000, 2_000_000
SHORT = 16
_U = np.uint64
#: Letters of one script, then marks: every splitter here cuts such a word in these two parts. The
#: letters are single code points that no normal form changes, the marks cannot open a contraction.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?$%&*#()\"-]*)")

#: Bytes a word may start with for the space before it to be a cut: no ASCII white space or separator,
#: and no first byte of another white space character (those words just stay joined to the one before).
_OPENS = np.ones(256, dtype=bool)
_OPENS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def _byte_chars() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()


class Encoder:
    """Encodes blocks of texts; keeps the words it has met."""

    def __init__(self, path: str, keeps_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        added = self.library.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added]
        #: Tokens looked for in normalised text cannot be found in the bytes: then every text goes to the library.
        self.all_whole = any(t.normalized for t in added)
        #: Whether a word's ids depend on the space in front of it (byte-level vocabularies).
        self.keeps_space = keeps_space
        self._clear()

    def _clear(self) -> None:
        self.low = np.zeros(SLOTS, dtype=np.uint64)  # bytes 0 to 7 of the word in a slot
        self.high = np.zeros(SLOTS, dtype=np.uint64)  # bytes 8 to 15
        self.tag = np.zeros(SLOTS, dtype=np.uint8)  # its length and place, 0: empty
        self.start = np.zeros(SLOTS, dtype=np.int32)
        self.length = np.zeros(SLOTS, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = self.filled = 0
        self.pieces: dict[str, list[int]] = {}
        self.long: dict[tuple[bytes, bool], np.ndarray] = {}
        self.long_ids = 0

    def _piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, straight from the merges."""
        found = self.pieces.get(piece)
        if found is None:
            mapped = piece.encode().decode("latin-1").translate(_BYTE_CHARS)
            found = [t.id for t in self.model.tokenize(mapped)]
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def encode_word(self, word: str, first: bool) -> list[int]:
        """Ids of one word. Plain words skip the library's normaliser and splitter."""
        lead = " " if self.keeps_space and not first else ""
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            return self.library.encode(lead + word, add_special_tokens=False).ids
        letters, marks = plain.groups()
        ids = self._piece(lead + letters if self.keeps_space else letters.lower())
        return ids + self._piece(marks) if marks else ids

    @staticmethod
    def _mixed(low: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return mix64(low ^ mix64(high + tag))

    def _home(self, low: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return (self._mixed(low, high, tag) & _U(SLOTS - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
        """Slot of each word, -1 if it is not there."""
        at = self._home(low, high, tag)
        out = np.full(len(low), -1, dtype=np.int64)
        open_ = np.arange(len(low))
        while len(open_):
            slot = at[open_]
            there = self.tag[slot]
            hit = (self.low[slot] == low[open_]) & (self.high[slot] == high[open_]) & (there == tag[open_])
            out[open_[hit]] = slot[hit]
            open_ = open_[~hit & (there != 0)]
            at[open_] = (at[open_] + 1) & (SLOTS - 1)
        return out

    def _add(self, low: np.ndarray, high: np.ndarray, tag: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        at = self._home(low, high, tag)
        open_ = np.arange(len(low))
        while len(open_):
            free = self.tag[at[open_]] == 0
            tried = open_[free]
            _, one = np.unique(at[tried], return_index=True)  # of several that meet in a free slot the first has it
            owner = tried[one]
            slot = at[owner]
            self.low[slot], self.high[slot], self.tag[slot] = low[owner], high[owner], tag[owner]
            self.start[slot], self.length[slot] = starts[owner], lengths[owner]
            open_ = np.setdiff1d(open_, owner, assume_unique=True)
            at[open_] = (at[open_] + 1) & (SLOTS - 1)
        self.filled += len(low)

    def _learn(self, raw, starts, ends, firsts, low, high, tag) -> None:
        lists = [
            self.encode_word(raw[a:b].tobytes().decode("utf-8", "replace"), f)
            for a, b, f in zip(starts.tolist(), ends.tolist(), firsts.tolist())
        ]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(lengths.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), dtype=np.uint32)])
        self.ids[self.used : self.used + total] = np.fromiter((i for x in lists for i in x), np.uint32, total)
        self._add(low, high, tag, self.used + np.cumsum(lengths) - lengths, lengths)
        self.used += total

    def _long_word(self, word: bytes, first: bool) -> np.ndarray:
        """Ids of a word of more than ``SHORT`` bytes."""
        key = (word, first and self.keeps_space)
        found = self.long.get(key)
        if found is None:
            found = np.array(self.encode_word(word.decode("utf-8", "replace"), first), dtype=np.uint32)
            self.long_ids += len(found) + len(word)
            if self.long_ids > LONG_IDS:
                self.long.clear()
                self.long_ids = len(found) + len(word)
            self.long[key] = found
        return found

    def _holds_added(self, raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """The texts with the string of an added token."""
        if self.all_whole:
            return np.arange(len(texts) - 1)
        low, high = int(texts[0]), int(texts[-1])
        data, found = raw[low:high].tobytes(), set()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                text = int(np.searchsorted(texts, low + at, side="right")) - 1
                if low + at + len(token) <= texts[text + 1]:  # else it runs over the end of a text
                    found.add(text)
                at = data.find(token, at + 1)
        return np.array(sorted(found), dtype=np.int64)

    def encode(self, raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's ids start and the end) of a block as ``textblocks.blocks`` gives it."""
        whole = self._holds_added(raw, texts)
        if not len(whole):
            return self._encode(raw, texts)
        lengths = np.diff(texts)
        other = np.ones(len(lengths), dtype=bool)
        other[whole] = False
        left = np.concatenate([[0], np.cumsum(np.where(other, lengths, 0))])
        ids, edges = self._encode(raw[texts[0] : texts[-1]][np.repeat(other, lengths)], left)
        lists = [self._plainly(raw, texts[i : i + 2])[0] for i in whole.tolist()]
        sizes = np.diff(edges)
        sizes[whole] = [len(x) for x in lists]
        ids = np.insert(ids, np.repeat(edges[whole], sizes[whole]), np.concatenate(lists))
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def _encode(self, raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        full = np.flatnonzero(texts[1:] > texts[:-1])
        first_at, last_at = texts[:-1][full], texts[1:][full]
        spaces = np.zeros(len(raw), dtype=bool)
        spaces[:-1] = (raw[:-1] == 32) & _OPENS[raw[1:]]
        spaces[last_at - 1] = False  # a space at the end of a text
        cuts = np.flatnonzero(spaces)
        starts = np.concatenate([first_at, cuts + 1])
        order = np.argsort(starts, kind="stable")
        starts, firsts = starts[order], order < len(first_at)
        ends = np.sort(np.concatenate([cuts, last_at]), kind="stable")
        size = ends - starts
        many = np.flatnonzero(size > SHORT)
        lists = [self._long_word(raw[starts[i] : ends[i]].tobytes(), bool(firsts[i])) for i in many.tolist()]
        few = np.flatnonzero(size <= SHORT) if len(many) else np.arange(len(size))
        start, length = self._short_words(raw, starts[few], ends[few], firsts[few])
        if start is None:
            return self._plainly(raw, texts)
        lengths = np.zeros(len(size), dtype=np.int64)
        lengths[few] = length
        if lists:
            lengths[many] = [len(x) for x in lists]
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.zeros(len(size), dtype=np.int64)
        at[few] = start
        if lists:  # their ids are read from behind the cache's own
            own = lengths[many]
            at[many] = self.used + np.cumsum(own) - own
        held = np.concatenate([self.ids[: self.used], *lists]) if lists else self.ids
        ids = held[np.repeat(at - total[:-1], lengths) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, texts, side="left")]

    def _short_words(self, raw, starts, ends, firsts) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Where the ids of each word of up to ``SHORT`` bytes start, and how many they are; None if too many are new."""
        size = ends - starts
        low = lanes(raw, starts, size)
        high = lanes(raw, starts + 8, size - 8)
        tag = (size + 1 + (32 * firsts if self.keeps_space else 0)).astype(np.uint8)
        slots = self._find(low, high, tag)
        while (slots < 0).any():
            missing = np.flatnonzero(slots < 0)
            new = missing[np.unique(self._mixed(low[missing], high[missing], tag[missing]), return_index=True)[1]]
            if self.filled + len(new) > FILLED:
                self._clear()
                new = np.unique(self._mixed(low, high, tag), return_index=True)[1]
            if len(new) > FILLED:  # a text with more words than the cache: word by word
                return None, None
            self._learn(raw, starts[new], ends[new], firsts[new], low[new], high[new], tag[new])
            slots = self._find(low, high, tag)  # words that share a number are learnt one a round
        return self.start[slots].astype(np.int64), self.length[slots].astype(np.int64)

    def _plainly(self, raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = [
            np.array(self.library.encode(raw[a:b].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=np.uint32)
            for a, b in zip(texts[:-1].tolist(), texts[1:].tolist())
        ]
        lengths = np.array([len(x) for x in lists], dtype=np.int64)
        return np.concatenate([np.empty(0, np.uint32), *lists]), np.concatenate([[0], np.cumsum(lengths)])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool) -> Encoder:
    """This worker's encoder for a vocabulary file; kept between tasks."""
    key = (path, keeps_space)
    if key not in _encoders:
        _encoders[key] = Encoder(path, keeps_space)
    return _encoders[key]
