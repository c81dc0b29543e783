"""Token ids of a public tokenizer file, whole texts, with a bounded memo of words.

The ids come from the tokenizers library. Byte-level BPE never joins across a single blank
between two visible characters, so the ids of a text are those of its pieces cut there; the
library encodes each new piece once, and a memo holds the ids of pieces already seen.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import chain, compress, count, islice

import numpy as np

from .shared import memo

#: Pieces that a worker's memo holds before it forgets those seen once.
MEMO_PIECES = 600_000
#: A piece may be cut off only between characters of these ranges (visible, none a blank).
_SAFE = "!-~À-ȿ"
_EDGES = re.compile(rf"(?:[{_SAFE}](?:.*[{_SAFE}])?)\Z", re.S)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _may_cut(pieces: list[str]) -> np.ndarray:
    """Whether each piece (none has a blank) begins and ends with a safe character."""
    raw = np.frombuffer((" " + " ".join(pieces) + " ").encode(), np.uint8)
    blank = np.flatnonzero(raw == 32)
    first, last, before = raw[blank[:-1] + 1], raw[blank[1:] - 1], raw[blank[1:] - 2]
    begins = (first > 32) & (first < 127) | (first >= 0xC3) & (first <= 0xC8)
    ends = (last > 32) & (last < 127) | (last >= 128) & (before >= 0xC3) & (before <= 0xC8)
    return begins & ends


class Encoder:
    """Texts to ids (uint32 arrays). Texts that hold the string of an added token are encoded
    by the library alone, which gives that token's id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._forget()
        of_byte = {c: b for b, c in enumerate(_byte_letters())}
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of each id
        for token, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(token) if set(token) <= of_byte.keys() else len(token.encode())

    @classmethod
    def of(cls, path: str) -> "Encoder":
        kept = memo("bpe")
        if ("bpe", path) not in kept:
            kept["bpe", path] = cls(path)
        return kept["bpe", path]

    def _raw(self, pieces: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(pieces), 2000):
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces[i : i + 2000], add_special_tokens=False)]
        return out

    def _blank_led(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece after a blank, one after another, and how many each has. Runs of
        pieces are encoded as one text; the byte lengths of the ids tell where a piece ends."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), 1000):
            text = " " + " ".join(pieces[i : i + 1000])
            got = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
            cut = np.searchsorted(np.cumsum(self.size[got]), ends) + 1
            ids.append(got)
            counts.append(np.diff(cut, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _forget(self) -> None:
        self.seen: dict[str, int] = defaultdict()
        self.ids = np.zeros(0, np.uint32)  # of all pieces seen, one after another
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # count -1: not to be cut off
        self.hits = np.zeros(0, np.int64)

    def _trim(self) -> None:
        if len(self.seen) < MEMO_PIECES:
            return
        keep = np.flatnonzero(self.hits > 1)
        if 2 * len(keep) > MEMO_PIECES:
            keep = keep[np.argsort(-self.hits[keep], kind="stable")[: MEMO_PIECES // 2]]
            keep.sort()
        count = self.count[keep]
        size = np.maximum(count, 0)
        self.ids = self.ids[_runs(self.start[keep], size)]
        self.start, self.count, self.hits = np.cumsum(size) - size, count, self.hits[keep] // 2
        pieces = list(self.seen)
        self.seen = defaultdict(None, {pieces[i]: k for k, i in enumerate(keep.tolist())})

    def _learn(self, new: list[str]) -> None:
        good = _may_cut(new)
        ids, counts = self._blank_led(list(compress(new, good.tolist())))
        count = np.full(len(new), -1, np.int64)
        count[good] = counts
        size = np.maximum(count, 0)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Texts are taken in runs of some megabytes."""
        out: list[np.ndarray] = []
        run, chars = [], 0
        for t in texts:
            run.append(t)
            chars += len(t)
            if chars > 4_000_000:
                out += self._encode(run)
                run, chars = [], 0
        return out + self._encode(run)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        self._trim()
        seen = self.seen
        before = len(seen)
        alone = [bool(self.added and self.added.search(t)) for t in texts]
        cut = [[""] if a else t.split(" ") for a, t in zip(alone, texts)]
        seen.default_factory = count(before).__next__  # a new piece takes the next number
        length = np.array([len(c) - 1 for c in cut])
        at = np.fromiter(map(seen.__getitem__, chain.from_iterable(islice(c, 1, None) for c in cut)), np.int64, int(length.sum()))
        if len(seen) > before:
            self._learn(list(islice(seen, before, None)))
        self.hits += np.bincount(at, minlength=len(self.hits))
        size = self.count[at]
        ends = np.cumsum(length)
        odd = np.add.reduceat(np.concatenate([size < 0, [False]]).astype(np.int64), np.minimum(ends - length, len(size))) if len(size) else np.zeros(len(texts), np.int64)
        heads = self._raw([c[0] for c in cut])
        size = np.maximum(size, 0)
        tail = self.ids[_runs(self.start[at], size)]
        upto = np.concatenate([[0], np.cumsum(size)])
        out: list = []
        for i, c in enumerate(cut):
            if alone[i] or length[i] and (odd[i] or not _EDGES.match(c[0])):
                out.append(self._plain(texts[i]))
            else:
                out.append(np.concatenate([np.frombuffer(heads[i], dtype="<u4"), tail[upto[ends[i] - length[i]] : upto[ends[i]]]]))
        return out

    def _plain(self, text: str) -> np.ndarray:
        """For texts with runs of blanks, unusual characters beside a blank, or added tokens."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of so many as size says, for each run."""
    shift = start - (np.cumsum(size) - size)
    return np.repeat(shift, size) + np.arange(int(size.sum()))
