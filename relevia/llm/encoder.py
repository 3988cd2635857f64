"""Whole texts as token ids, with pieces of text kept between batches.

The byte-level vocabulary splits a text before its merges, and a run of letters, or what
follows it up to the next blank, never shares a token with its neighbours. Such pieces are
encoded once per worker by the tokenizers library and then looked up by a 64-bit hash, a batch
at a time. A text in which the cut is not certain (blanks other than single spaces and line
ends between words, marks beyond ASCII that are no letters) is encoded whole by the library,
so results equal the library's on every text.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from relevia.llm.textkit import NON_BLANK, Hasher, byte_set, mix, slices, spans

#: Pieces kept per worker; when full, the table starts anew. About 70 bytes each.
KEPT_PIECES = 1 << 20
#: Words that one call of the library encodes.
TOGETHER = 64

LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: control bytes that some definitions of a blank hold and others do not, and all blanks but space and line end
_ODD = byte_set((0x00, 0x09), (0x0B, 0x1F), (0x7F, 0x7F))
#: first two bytes of blanks beyond ASCII (with some other marks)
_ODD_PAIRS = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))
_INNER, _AFTER_SPACE, _AFTER_LINE, _FIRST = (np.uint64(x) for x in (11, 23, 37, 53))


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary of 50 257 ids on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for i, b in enumerate(x for x in range(256) if x not in letters):
        letters[b] = chr(256 + i)
    return [letters[b] for b in range(256)]


class Encoder:
    """Encodes text columns; one per worker process, see ``shared``.

    With ``literal`` the name of a special token inside a text is encoded as the characters it has.
    """

    _shared: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, kept: int = KEPT_PIECES, literal: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.letters = _byte_letters()
        self.byte_letters = "".join(self.letters)
        self.opens = self._opens()
        self.line_end = self._whole("\n")
        self.hasher = Hasher(seed=7, fold_case=False)
        self.kept = kept
        self._clear()

    @classmethod
    def shared(cls, path: str, literal: bool = False) -> Encoder:
        if (path, literal) not in cls._shared:
            cls._shared[path, literal] = cls(path, literal=literal)
        return cls._shared[path, literal]

    def _opens(self) -> np.ndarray | None:
        """Which ids begin with a blank; None if a token may go on from a word of letters to the next, or words skip merges."""
        vocabulary, blank = self.tokenizer.get_vocab(with_added_tokens=False), self.letters[0x20]
        byte = {letter: b for b, letter in enumerate(self.letters)}
        text = lambda part: bytes(byte[letter] for letter in part).decode("utf-8", "replace")
        # what stands between two blanks would be a whole word
        crosses = (t for t in vocabulary if t.rfind(blank) > 0 and all(text(part).isalpha() for part in t.split(blank)[1:-1]))
        if getattr(self.tokenizer.model, "ignore_merges", False) or any(True for _ in crosses):
            return None
        opens = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        opens[[i for t, i in vocabulary.items() if t.startswith(blank)]] = True
        return opens

    def _clear(self) -> None:
        size = 1 << (2 * self.kept - 1).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, dtype=np.uint64)
        self.begin = np.zeros(size, dtype=np.int32)
        self.count = np.zeros(size, dtype=np.int32)  # -1: the text must be encoded whole
        self.pool = np.zeros(1 << 20, dtype=np.int32)
        self.used = 0
        self.pieces = 0

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, text: str, space: bool) -> list[int] | None:
        """Ids of one piece, None if it may share a token with its neighbours."""
        if text.isalpha():
            whole = text if text.isascii() else "".join(self.letters[b] for b in text.encode())
            return [t.id for t in self.tokenizer.model.tokenize(("Ġ" if space else "") + whole)]
        head = 0
        while head < len(text) and (text[head].isalpha() or not text[head].isascii()):
            head += 1
        if not text[:head].isascii() or not text[head:].isascii():
            return None
        return self._whole((" " if space else "") + text)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key, and whether it is filled."""
        slot = keys & self.mask
        found = self.keys[slot] == keys
        open_ = np.flatnonzero(~found & (self.keys[slot] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            there = self.keys[slot[open_]]
            found[open_] = there == keys[open_]
            open_ = open_[~found[open_] & (there != 0)]
        return slot, found

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, each behind a blank, and how many each has; a call of the library takes several.

        No token goes on from one to the next, so the merges in a row of words are those of each word alone.
        """
        ids: list[int] = []
        for first in range(0, len(words), TOGETHER):
            row = " " + " ".join(words[first : first + TOGETHER])
            ids += [t.id for t in self.tokenizer.model.tokenize(row.encode().decode("latin-1").translate(self.byte_letters))]
        flat = np.array(ids, dtype=np.int32)
        return flat, np.diff(np.flatnonzero(self.opens[flat]), append=len(flat)).astype(np.int32)

    def _learn(self, data: np.ndarray, keys, starts, ends, spaces) -> None:
        whole = data.tobytes()
        texts = [whole[start:end].decode("utf-8", "replace") for start, end in zip(starts.tolist(), ends.tolist())]
        together = np.zeros(len(texts), dtype=bool)
        if self.opens is not None:
            together = spaces & np.fromiter((text.isalpha() for text in texts), dtype=bool, count=len(texts))
            self._keep(keys[together], *self._words([texts[i] for i in np.flatnonzero(together).tolist()]))
        alone = np.flatnonzero(~together)
        found = [self._piece(texts[i], space) for i, space in zip(alone.tolist(), spaces[alone].tolist())]
        sizes = np.fromiter((-1 if ids is None else len(ids) for ids in found), dtype=np.int32, count=len(found))
        flat = np.fromiter(itertools.chain.from_iterable(ids or () for ids in found), dtype=np.int32)
        self._keep(keys[alone], flat, sizes)

    def _keep(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Enter the ids of pieces, one piece after the other, under their keys."""
        room = np.maximum(sizes, 0).astype(np.int64)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool) // 2, dtype=np.int32)))
        self.pool[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(room) - room
        self.used += len(flat)
        self.pieces += len(keys)
        # every key to the next free slot; of those that meet at one slot the first takes it
        slot, open_ = keys & self.mask, np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            free = free[np.unique(slot[free], return_index=True)[1]]
            at = slot[free]
            self.keys[at], self.begin[at], self.count[at] = keys[free], begin[free], sizes[free]
            open_ = open_[self.keys[slot[open_]] != keys[open_]]
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask

    def _slice(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's texts one after the other, and how many each has."""
        texts = len(starts) - 1
        first, last = spans(data, NON_BLANK)
        text_of = np.searchsorted(starts, first, side="right") - 1
        whole = np.zeros(texts, dtype=bool)
        odd = np.flatnonzero(_ODD[data])
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        for a, b in _ODD_PAIRS:
            odd = np.concatenate((odd, np.flatnonzero(pair == (a << 8 | b))))
        whole[np.searchsorted(starts, odd, side="right") - 1] = True
        # one blank between words, none at either end (the separator is the last byte of a text)
        begins = np.concatenate(([True], text_of[1:] != text_of[:-1])) if len(first) else np.zeros(0, bool)
        ends = np.concatenate((begins[1:], [True])) if len(first) else begins
        gap_before = np.where(begins, first - starts[text_of], first - np.concatenate(([0], last[:-1])) - 1)
        gap_after = np.where(ends, starts[text_of + 1] - 1 - last, 0)
        whole[text_of[(gap_before != 0) | (gap_after != 0)]] = True
        filled = np.zeros(texts, dtype=bool)
        filled[text_of] = True
        whole |= ~filled & (np.diff(starts) > 1)

        # a word is its leading letters and the rest
        marks = np.flatnonzero(~LETTERS[data])
        cut = np.minimum(marks[np.searchsorted(marks, first)], last) if len(first) else first
        before = np.where(begins, _FIRST, np.where(data[first - 1] == 32, _AFTER_SPACE, _AFTER_LINE))
        prefix = self.hasher.prefix(data)
        piece_start = np.stack((first, cut), axis=1).ravel()
        piece_end = np.stack((cut, last), axis=1).ravel()
        kind = np.stack((before, np.where(cut > first, _INNER, before)), axis=1).ravel()
        used = piece_end > piece_start
        lined = np.stack((before == _AFTER_LINE, np.zeros(len(first), bool)), axis=1).ravel()
        lined[1::2] = (cut == first) & (before == _AFTER_LINE)
        piece_start, piece_end, kind, lined = (x[used] for x in (piece_start, piece_end, kind, lined))
        piece_text = np.repeat(text_of, 2)[used]
        space = kind == _AFTER_SPACE
        # after a line end or at the start, a piece is encoded as it stands
        keys = mix(self.hasher.ranges(prefix, piece_start, piece_end) + np.where(space, _AFTER_SPACE, _INNER))
        keys[keys == 0] = 1

        slot, found = self._find(keys)
        if not found.all():
            missing, where = np.unique(keys[~found], return_index=True)
            where = np.flatnonzero(~found)[where]
            if self.pieces + len(missing) > self.kept:
                self._clear()
                missing, where = np.unique(keys, return_index=True)
                self.kept = max(self.kept, len(missing))
                self._clear()
            self._learn(data, missing, piece_start[where], piece_end[where], space[where])
            slot, found = self._find(keys)
        count = self.count[slot].astype(np.int64)
        whole[piece_text[count < 0]] = True

        # line ends are tokens of their own before their piece
        keep = ~whole[piece_text]
        begin, count, lined, piece_text = self.begin[slot][keep], count[keep], lined[keep], piece_text[keep]
        width = count + lined * len(self.line_end)
        per_text = np.bincount(piece_text, weights=width, minlength=texts).astype(np.int64)
        whole_ids = {}
        for i in np.flatnonzero(whole).tolist():
            whole_ids[i] = self._whole(data[starts[i] : starts[i + 1] - 1].tobytes().decode("utf-8", "replace"))
            per_text[i] = len(whole_ids[i])
        out_start = np.concatenate(([0], np.cumsum(per_text)))
        out = np.empty(out_start[-1], dtype=np.int32)
        # where each piece goes: its text's start plus what its text has before it
        ahead = np.cumsum(width) - width
        if len(piece_text):
            opens = np.concatenate(([True], piece_text[1:] != piece_text[:-1]))
            ahead -= np.repeat(ahead[opens], np.diff(np.concatenate((np.flatnonzero(opens), [len(ahead)]))))
        to = out_start[piece_text] + ahead
        for j, token in enumerate(self.line_end):
            out[to[lined] + j] = token
        to = to + lined * len(self.line_end)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(to, count) + step] = self.pool[np.repeat(begin, count) + step]
        for i, ids in whole_ids.items():
            out[out_start[i] : out_start[i + 1]] = ids
        return out, per_text

    def column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, ids per text) for a text column, slice by slice; nulls are empty."""
        for first, data, starts in slices(texts):
            ids, counts = self._slice(data, starts)
            yield first, ids, counts
