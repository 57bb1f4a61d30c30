"""Byte-level BPE ids of whole texts, with each distinct chunk of a batch encoded once."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: A word with the white space before it. The tokenizer's own pattern always breaks between a character that is not white
#: space and a following blank or newline, so such chunks are encoded independently of each other.
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space other than blank and newline (in any of the usual definitions): such texts are encoded in one piece.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
#: Chunks that a worker remembers; then it forgets those used once.
REMEMBERED = 1_500_000
#: Chunks of more ids are forgotten first, also when there are more than IDS_EACH times as many ids as chunks may be remembered: texts without blanks are one chunk.
LONGEST, IDS_EACH = 64, 8
#: New chunks that are handed to the tokenizer as one text.
JOINED = 512


class _Index(dict):
    """Chunk -> number, in order of first use. A key that starts with NUL or newline stands for its remaining or whole text, any other for a blank and itself."""

    def __init__(self, keys: list[str]) -> None:
        super().__init__(zip(keys, range(len(keys))))
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        #: How many bytes each id stands for: a byte-level vocabulary spells each byte as one character.
        self.n_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.size)], np.int64)
        self.index, self.ids = _Index([]), np.empty(0, self.dtype)
        self.starts, self.lengths, self.used = (np.empty(0, np.int64) for _ in range(3))

    def _forget(self) -> None:
        keep = np.flatnonzero((self.used > 1) & (self.lengths <= LONGEST))
        keep = keep[np.argsort(-self.used[keep], kind="stable")][: REMEMBERED // 2]
        keys = list(self.index)
        self.index = _Index([keys[k] for k in keep.tolist()])
        lengths = self.lengths[keep]
        ends = np.cumsum(lengths)
        self.ids = self.ids[np.repeat(self.starts[keep] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        self.starts, self.lengths, self.used = ends - lengths, lengths, self.used[keep] // 2

    def _alone(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after another, each encoded by itself, and how many each has."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), self.dtype, int(lengths.sum())), lengths

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of blank + word: many of these make one text, which the ids' bytes cut up again."""
        texts = [" " + " ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)]
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(got), self.dtype, sum(map(len, got)))
        ends = np.cumsum(self.n_bytes[flat])
        wanted = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        at = np.searchsorted(ends, wanted)
        if len(flat) == 0 or at[-1] != len(flat) - 1 or (ends[at] != wanted).any():  # an id reaches over two words, or doesn't spell its bytes
            return self._alone([" " + w for w in words])
        return flat, np.diff(at, prepend=-1)

    def _learn(self) -> None:
        new = self.index.new
        if not new:
            return
        lone = np.fromiter((not k or k[0] in "\0\n" for k in new), bool, len(new))
        lengths, starts = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        words = [k for k, x in zip(new, lone.tolist()) if not x]
        chunks = [k[1:] if k[:1] == "\0" else k if k else " " for k, x in zip(new, lone.tolist()) if x]
        parts = [self.ids]
        at = len(self.ids)
        for mask, encoded, texts in ((~lone, self._joined, words), (lone, self._alone, chunks)):
            if not texts:
                continue
            flat, n = encoded(texts)
            lengths[mask] = n
            starts[mask] = at + np.cumsum(n) - n
            parts.append(flat)
            at += len(flat)
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.ids = np.concatenate(parts)
        self.index.new = []

    def encode(self, texts: list[str], end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has. end: an id put after each text."""
        if len(self.index) > REMEMBERED or len(self.ids) > IDS_EACH * REMEMBERED:
            self._forget()
        number, seen, per_text, whole = self.index.__getitem__, [], np.empty(len(texts), np.int64), {}
        for k, text in enumerate(texts):
            if OTHER_SPACE.search(text) or "\0" in text:
                whole[k], per_text[k] = text, 0
                continue
            if "  " in text or "\n\n" in text or " \n" in text:
                keys = ["\0" + c for c in CHUNK.findall(text)]
            else:
                keys = text.replace("\n", " \n").split(" ")
                if keys[0] or len(keys) == 1:
                    keys[0] = "\0" + keys[0]
                else:  # the text starts with a blank or newline
                    del keys[0]
            seen.extend(map(number, keys))
            per_text[k] = len(keys)
        self._learn()
        seen = np.array(seen, np.int64)
        self.used += np.bincount(seen, minlength=len(self.used))
        lengths = self.lengths[seen]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum(per_text)
        counts = ends[last] - ends[last - per_text]
        flat = self.ids[np.repeat(self.starts[seen] - ends[:-1], lengths) + np.arange(ends[-1])]
        if not whole:
            if end is None:
                return flat, counts
            return np.insert(flat, np.cumsum(counts), self.dtype(end)), counts + 1
        tail, parts, at = np.array([] if end is None else [end], self.dtype), [], 0
        for k, n in enumerate(counts):
            if k in whole:
                own = np.array(self.tokenizer.encode(whole[k], add_special_tokens=False).ids, self.dtype)
            else:
                own, at = flat[at : at + n], at + n
            parts += [own, tail]
            counts[k] = len(own) + len(tail)
        return np.concatenate(parts), counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)


def crc32(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
