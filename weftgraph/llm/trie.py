"""Operator 6: language-model scores from a sharded n-gram trie in Elias-Fano coding.

The model is an interpolated n-gram model of `order` words with absolute discounting:
p(w | v) = max(c(v w) - D, 0) / c(v) + rest(v) * (c(w) + 1) / (N + V + 1), with the n-grams seen `least` times or more (once:
all of them), and rest(v) such that everything sums to 1; with three words p(w | u v) = max(c(u v w) - D, 0) / c(u v) +
rest(u v) * p(w | v), and so on. The first token's v is a mark that begins each text; nothing is before the mark.

Level 1 of the trie is the vocabulary: the words' 64-bit hashes in order and the running sums of their counts, both monotone
sequences in Elias-Fano coding, so a word's number is its place and its count is exact. Level 2 holds contexts,
pointers (monotone) to each context's successors, the successors, made monotone by adding up from context to
context and searched relative to the context's base, and discounted probabilities in 8 bits, rounded down; rest(v) is
computed from the rounded ones. Each further level holds, for every n-gram of the level above by its place there, a pointer
to its successors, those successors and their probabilities in the same coding, and its rest; it is in the shard of the n-gram's
first two words.

Both levels are cut into shards, whose number follows the number of tokens, by hash range and by context; a context with more
than a shard's share of the tokens is split by successor. Counts go to their shard as delta-coded blocks, a row
per task and shard. Levels 2 and 3 are counted in one pass: a bigram goes with each word that follows it (or none), and its count is
the sum over these. A shard is one file in the shared folder, written under a temporary name and renamed; scoring
tasks map the files into memory and look up the distinct words and n-grams of some documents at a time, shard by shard and in the
order of the files. A search goes to the stretch of values with the wanted high part and compares low bits there.
The driver sees one row per shard.

Defined results: null text is an empty text (one token, the end); null doc_ids are training rows; repeated rows count as often as
they come; without training rows every score is 0 or the uniform base; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import mmap
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, mix, shared_dir, small_batches, stored, word_hashes

SHARD_TOKENS = 2_000_000
HELD_BACK = 1_000_000  # tokens that a counting task gathers before it reports
GATHERED = 800_000  # tokens that a scoring task looks up at a time
LEAST, DISCOUNT = 1, 0.75
SAMPLE = 32  # values between two of those that a search starts from
STEPS = 255 / 12.0  # 8-bit steps in each power of ten of a probability, down to 1e-12
PROBABILITY = 10.0 ** (-np.arange(256) / STEPS)
END = np.uint64(1)  # hashes of words are above 1
U = np.uint64


# -- Elias-Fano sequences ---------------------------------------------------------------------------------------------


_ONES, _HIGHS = U(0x0101010101010101), U(0x8080808080808080)
_IN_BYTE = np.array([[([k for k in range(8) if b >> k & 1] + [0] * 8)[i] for i in range(8)] for b in range(256)], np.uint8).ravel()


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The position of the k-th (from 0) set bit of each 64-bit word."""
    pairs = word - ((word >> U(1)) & U(0x5555555555555555))
    nibbles = (pairs & U(0x3333333333333333)) + ((pairs >> U(2)) & U(0x3333333333333333))
    upto = ((nibbles + (nibbles >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _ONES  # of each byte: set bits up to its end
    k = k.astype(U)
    at = np.bitwise_count(((k * _ONES | _HIGHS) - upto) & _HIGHS).astype(U) << U(3)  # the byte: so many end at or below k
    left = k - (((upto << U(8)) >> at) & U(255))
    return (at + _IN_BYTE[((word >> at) & U(255)) << U(3) | left]).astype(np.int64)


def _trailing_zeros(x: np.ndarray) -> np.ndarray:
    """Of each 64-bit number, how many zeros are below its lowest set bit (64: none is set)."""
    return np.bitwise_count(~x & (x - U(1))).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence: low bits side by side, high parts as gaps in unary, with a rank directory per word and the word of each SAMPLE-th value (one) and gap (zero)."""

    def __init__(self, n: int, low_bits: int, top: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray, words: np.ndarray, gaps: np.ndarray) -> None:
        #: top: the high part of the last value.
        self.n, self.low_bits, self.top = n, low_bits, top
        self.low, self.high, self.ranks, self.words, self.gaps = low, high, ranks, words, gaps

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = values.astype(U)
        n, last = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (last // max(n, 1)).bit_length() - 1)
        bits = np.arange(n, dtype=np.int64) * low_bits
        low = np.zeros(n * low_bits // 64 + 2, U)
        if low_bits:
            part, shift = values & U((1 << low_bits) - 1), (bits & 63).astype(U)
            np.bitwise_or.at(low, bits >> 6, part << shift)
            over = (bits & 63) + low_bits > 64
            np.bitwise_or.at(low, (bits[over] >> 6) + 1, part[over] >> (U(64) - shift[over]))
        parts = (values >> U(low_bits)).astype(np.int64)
        ones = parts + np.arange(n)
        high = np.zeros((int(ones[-1]) if n else 0) // 64 + 2, U)
        np.bitwise_or.at(high, ones >> 6, U(1) << (ones & 63).astype(U))
        counts = np.bitwise_count(high).astype(np.uint32)
        ranks = np.append(np.cumsum(counts, dtype=np.uint32) - counts, np.uint32(n))
        gap = np.arange(0, (last >> low_bits) + 1, SAMPLE)
        gaps = (gap + np.searchsorted(parts, gap, "right")) >> 6
        return EliasFano(n, low_bits, last >> low_bits, low, high, ranks, (ones[::SAMPLE] >> 6).astype(np.uint32), gaps.astype(np.uint32))

    def _one(self, at: np.ndarray) -> np.ndarray:
        """The bits that stand for the values at these places."""
        word = self.words[at // SAMPLE].astype(np.int64)
        behind = np.flatnonzero(self.ranks[word + 1] <= at)
        for _ in range(4):  # a few words on, as a rule
            if not len(behind):
                break
            word[behind] += 1
            behind = behind[self.ranks[word[behind] + 1] <= at[behind]]
        if len(behind):
            word[behind] = np.searchsorted(self.ranks, at[behind].astype(np.uint32), "right") - 1
        return word * 64 + _select_in_word(self.high[word], at - self.ranks[word])

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The bits that end the gaps of these numbers, up to top."""
        word = self.gaps[k // SAMPLE].astype(np.int64)
        behind = np.flatnonzero((word + 1) * 64 - self.ranks[word + 1] <= k)
        for _ in range(4):
            if not len(behind):
                break
            word[behind] += 1
            behind = behind[(word[behind] + 1) * 64 - self.ranks[word[behind] + 1] <= k[behind]]
        if len(behind):
            word[behind] = np.searchsorted(np.arange(len(self.ranks)) * 64 - self.ranks, k[behind], "right") - 1
        return word * 64 + _select_in_word(~self.high[word], k - (word * 64 - self.ranks[word]))

    def _low(self, at: np.ndarray) -> np.ndarray:
        """The low bits of the values at these places."""
        bits = at * self.low_bits
        word, shift = bits >> 6, (bits & 63).astype(U)
        return (self.low[word] >> shift | self.low[word + 1] << (U(63) - shift) << U(1)) & U((1 << self.low_bits) - 1)

    def _value(self, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        value = (bit - at).astype(U)
        return value << U(self.low_bits) | self._low(at) if self.low_bits else value

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at these places."""
        return self._value(at, self._one(at))

    def get_two(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at these places and at the next ones."""
        bit = self._one(at)
        above = self.high[bit >> 6] >> (bit & 63).astype(U) >> U(1)
        after = bit + 1 + _trailing_zeros(above)
        far = np.flatnonzero(above == 0)
        if len(far):
            after[far] = self._one(at[far] + 1)
        return self._value(at, bit), self._value(at + 1, after)

    def _search(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first value not below the wanted one, and whether it is the wanted one: its high part names a stretch, which is searched by low bits."""
        wanted = np.minimum(value >> U(self.low_bits), U(self.top + 1)).astype(np.int64)
        bit = self._zero(np.maximum(wanted - 1, 0)) + 1
        bit[wanted == 0] = 0
        inside = bit & 63
        run = _trailing_zeros(~(self.high[bit >> 6] >> inside.astype(U)))
        far = np.flatnonzero((run + inside >= 64) & (wanted <= self.top))
        if len(far):
            run[far] = self._zero(wanted[far]) - bit[far]
        at = bit - wanted
        if not self.low_bits:
            return at, run > 0
        part = value & U((1 << self.low_bits) - 1)
        # most stretches are of one value: one look for all, then those with more
        own = self._low(np.minimum(at, self.n - 1))
        some = run > 0
        hit = some & (own == part)
        less = some & (own < part)
        here = np.flatnonzero(less & (run > 1))
        at += less
        low, high, part = at[here], at[here] + run[here] - 1, part[here]
        while len(here):
            mid = (low + high) >> 1
            own = self._low(mid)
            hit[here[own == part]] = True
            less = own < part
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
            at[here] = low
            open_ = low < high
            here, low, high, part = here[open_], low[open_], high[open_], part[open_]
        return at, hit

    def find(self, value: np.ndarray) -> np.ndarray:
        """Successor search: the place of the first value not below the wanted one."""
        return self._search(value)[0]

    def place(self, value: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where it is not in the sequence."""
        at, hit = self._search(value)
        return np.where(hit, at, -1)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.size": np.array([self.n, self.low_bits, self.top], np.int64), **{f"{name}.{x}": getattr(self, x) for x in ("low", "high", "ranks", "words", "gaps")}}

    @staticmethod
    def of(arrays: dict, name: str) -> EliasFano:
        """The sequence of that name in a file, which keeps it."""
        if name not in arrays:
            arrays[name] = EliasFano(*arrays[f"{name}.size"].tolist(), *(arrays[f"{name}.{x}"] for x in ("low", "high", "ranks", "words", "gaps")))
        return arrays[name]


# -- files ------------------------------------------------------------------------------------------------------------


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    at, table, parts = 0, {}, []
    for key, x in arrays.items():
        data = np.ascontiguousarray(x).tobytes()
        table[key] = (at, x.dtype.str, len(x))
        parts += [data, b"\0" * (-len(data) % 8)]
        at += len(data) + -len(data) % 8
    head = json.dumps(table).encode()
    head += b" " * (-(len(head) + 8) % 8)
    draft = f"{root}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(np.array([len(head)], "<i8").tobytes() + head)
        for p in parts:
            out.write(p)
    system.move(draft, f"{root}/{name}")


class _Files:
    """The files of a folder, mapped into memory, the last used ones kept open; read whole where the store has no local paths."""

    def __init__(self, folder: str, most: int = 256) -> None:
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.local = isinstance(self.system, fs.LocalFileSystem)
        self.most = most if self.local else 8
        self.opened: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()

    def __call__(self, name: str) -> dict[str, np.ndarray]:
        if name in self.opened:
            self.opened.move_to_end(name)
            return self.opened[name]
        path = f"{self.root}/{name}"
        if self.local:
            with open(path, "rb") as source:
                data = mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            with self.system.open_input_file(path) as source:
                data = source.read()
        head = int(np.frombuffer(data, "<i8", 1)[0])
        arrays = {k: np.frombuffer(data, kind, n, 8 + head + at) for k, (at, kind, n) in json.loads(bytes(data[8 : 8 + head])).items()}
        self.opened[name] = arrays
        if len(self.opened) > self.most:
            self.opened.popitem(last=False)
        return arrays


# -- words and counts -------------------------------------------------------------------------------------------------


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, each text's end included, and how many each text has."""
    words, sizes = word_hashes(texts)
    sizes = sizes + 1
    out = np.full(int(sizes.sum()), END, U)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = np.maximum(words, U(2))
    return out, sizes


def _packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Variable-length numbers, seven bits a byte, and where each one ends."""
    size, rest = np.ones(len(values), np.int64), values >> U(7)
    while rest.any():
        size += rest > 0
        rest = rest >> U(7)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = ends - size
    while len(at):
        more = np.flatnonzero(values > 127)
        out[at] = values & U(127)
        out[at[more]] |= 128
        at, values = at[more] + 1, values[more] >> U(7)
    return out.tobytes(), ends


def _unpacked(data: bytes, offset: int = 0) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=offset)
    ends = np.flatnonzero(raw < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    values = (raw[starts] & 127).astype(U)
    k, longer = 1, np.flatnonzero(ends > starts)
    while len(longer):
        values[longer] |= (raw[starts[longer] + k] & 127).astype(U) << U(7 * k)
        k += 1
        longer = longer[ends[longer] - starts[longer] >= k]
    return values


def _to_bytes(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as gaps, then counts."""
    return len(keys).to_bytes(8, "little") + _packed(np.concatenate([keys[:1], np.diff(keys), counts.astype(U)]))[0]


def _from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    values, n = _unpacked(data, 8), int.from_bytes(data[:8], "little")
    return np.cumsum(values[:n], dtype=U), values[n:].astype(np.int64)


def _merged(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all blocks in order, with the sums of their counts."""
    keys, counts = zip(*(_from_bytes(b) for b in blocks))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _blocks(keys: np.ndarray, shard: np.ndarray, by_range: bool = False) -> pa.RecordBatch:
    """The counts of some keys as a row per shard; by_range: larger keys are in later shards."""
    width = int(keys.max()).bit_length()
    if width + int(shard.max()).bit_length() <= 64:  # one number to sort by
        both = np.sort(shard.astype(U) << U(width % 64) | keys) if width < 64 else np.sort(keys)
        keys, shard = (both & U((1 << width) - 1), (both >> U(width % 64)).astype(np.int32)) if width < 64 else (both, np.zeros(len(both), np.int32))
    else:
        order = np.argsort(keys) if by_range else np.lexsort((keys, shard))
        keys, shard = keys[order], shard[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (shard[1:] != shard[:-1])]))
    counts = np.diff(np.append(first, len(keys)))
    keys, shard = keys[first], shard[first]
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    ends = np.append(cut[1:], len(shard))
    return pa.RecordBatch.from_arrays([pa.array(shard[cut], pa.int32()), pa.array([_to_bytes(keys[s:e], counts[s:e]) for s, e in zip(cut.tolist(), ends.tolist())], pa.binary())], ["shard", "block"])


def _gaps(keys: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Keys, in order from each head on, as differences; at the heads themselves."""
    out = np.diff(keys, prepend=keys[:1])
    out[heads] = keys[heads]
    return out


def _ungapped(gaps: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.cumsum(gaps, dtype=U)
    return sums - np.repeat(sums[heads] - gaps[heads], sizes)


def _gram_blocks(shard: np.ndarray, pairs: np.ndarray, pair: np.ndarray, word: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row per shard: its bigrams, how many words follow each (at least one: 0 for none), these words and counts. Bigrams are in order
    by shard and key; pair is the place of each row's bigram there, in order by pair and word."""
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    cut = np.flatnonzero(np.diff(shard, prepend=-1))
    parts = [_packed(x) for x in (_gaps(pairs, cut), np.diff(np.append(first, len(pair))).astype(U), _gaps(word, first), counts.astype(U))]
    edges = [np.append(cut, len(shard))] * 2 + [np.append(first[cut], len(pair))] * 2
    ends = [np.append(0, e)[x] for (_, e), x in zip(parts, edges)]
    sizes = np.stack([np.diff(e) for e in ends[:3]], 1).astype("<i8")
    blocks = [sizes[k].tobytes() + b"".join(data[e[k] : e[k + 1]] for (data, _), e in zip(parts, ends)) for k in range(len(cut))]
    return pa.RecordBatch.from_arrays([pa.array(shard[cut], pa.int32()), pa.array(blocks, pa.binary())], ["shard", "block"])


def _grams_merged(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct bigrams of all blocks in order, then the distinct rows (place of the bigram, word, count), in order."""
    pairs, follow, words, counts = [], [], [], []
    for b in blocks:
        ends = np.cumsum(np.frombuffer(b, "<i8", 3)) + 24
        keys, sizes, gaps, own = (_unpacked(x) for x in (b[24 : ends[0]], b[ends[0] : ends[1]], b[ends[1] : ends[2]], b[ends[2] :]))
        sizes = sizes.astype(np.int64)
        pairs.append(np.cumsum(keys, dtype=U))
        follow.append(sizes)
        words.append(_ungapped(gaps, np.cumsum(sizes) - sizes, sizes))
        counts.append(own)
    keys, back = np.unique(np.concatenate(pairs), return_inverse=True)
    word, count = np.concatenate(words), np.concatenate(counts).astype(np.int64)
    pair = np.repeat(back, np.concatenate(follow))
    width = word.max() + U(1)
    both = pair.astype(U) * width + word
    order = np.argsort(both)
    both = both[order]
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    both = both[first]
    return keys, (both // width).astype(np.int64), both % width, np.add.reduceat(count[order], first)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blocks of each shard, of rows in order of shard."""
    shard, blocks = None, []
    for b in batches:
        for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if s != shard and blocks:
                yield shard, blocks
                blocks = []
            shard = s
            blocks.append(x)
    if blocks:
        yield shard, blocks


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and how long they are."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return first, np.diff(np.append(first, len(x)))


class Trie:
    """A model in files: look-ups by mapped memory."""

    def __init__(self, folder: str, shards: int, offsets: np.ndarray, n_tokens: int, n_texts: int) -> None:
        #: offsets: how many words are in the vocabulary shards before each one, and in all.
        self.folder, self.shards, self.offsets, self.n_tokens, self.n_texts = folder, shards, offsets, n_tokens, n_texts
        self.order = 2
        self.split: dict[int, float] = {}  # rest(v) of contexts that are split over shards
        self.files: _Files | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"files": None}

    def _file(self, name: str) -> dict[str, np.ndarray]:
        if self.files is None:
            self.files = _Files(self.folder)
        return self.files(name)

    @property
    def n_words(self) -> int:
        return int(self.offsets[-1])

    def word_shard(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> U(32)) * U(self.shards) >> U(32)).astype(np.int32)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 for unknown) and count of each word, given in order of hash."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = self.word_shard(hashes)
        edges = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in range(self.shards):
            a, b = int(edges[s]), int(edges[s + 1])
            if a == b or self.offsets[s] == self.offsets[s + 1]:
                continue
            level = self._file(f"words-{s:06d}")
            words, sums = EliasFano.of(level, "words"), EliasFano.of(level, "sums")
            at = words.place(hashes[a:b])
            known = np.flatnonzero(at >= 0)
            before, upto = sums.get_two(at[known])
            number[a + known], count[a + known] = self.offsets[s] + at[known], (upto - before).astype(np.int64)
        return number, count

    def parts(self, context_counts: np.ndarray) -> np.ndarray:
        """Over how many shards a context of this count is split."""
        return np.maximum(1, np.minimum(self.shards, context_counts * self.shards // max(1, self.n_tokens)))

    def pair_shard(self, context: np.ndarray, word: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
        part = mix(word.astype(U)) % self.parts(context_counts).astype(U)
        return ((mix(context.astype(U) + U(7)) + part) % U(self.shards)).astype(np.int32)

    def pairs(self, shard: np.ndarray, context: np.ndarray, word: np.ndarray, context_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """p of the bigram (0 if not kept), rest of the context and the bigram's place in its shard (-1 if not kept), of bigrams in order by shard and context; context -1 is unknown, word n_words unknown."""
        p, rest, spot = np.zeros(len(context)), np.ones(len(context)), np.full(len(context), -1, np.int64)
        for s, a, b in self._stretches(shard):
            try:
                level = self._file(f"pairs-{s:06d}")
            except FileNotFoundError:  # no bigram of this shard is kept
                continue
            contexts, pointers = EliasFano.of(level, "contexts"), EliasFano.of(level, "pointers")
            first, sizes = _groups(context[a:b])
            place = contexts.place(context[a:b][first].astype(U))
            known = (place >= 0) & (context[a:b][first] >= 0)
            mine = a + np.flatnonzero(np.repeat(known, sizes))
            if len(mine):
                self._followers(level, pointers, place[known], sizes[known], word, mine, p, rest, spot)
        if self.split:
            many = np.flatnonzero((self.parts(context_counts) > 1) & (context >= 0))
            rest[many] = [self.split.get(v, 1.0) for v in context[many].tolist()]
        return p, rest, spot

    def longer(self, n: int, shard: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """p of the n-gram (0 if not kept), rest of its context, given by place on level n - 1 of the shard, and the n-gram's place (-1 if not kept), of n-grams in order by shard, equal contexts side by side."""
        p, rest, spot = np.zeros(len(context)), np.ones(len(context)), np.full(len(context), -1, np.int64)
        for s, a, b in self._stretches(shard):
            try:
                level = self._file(f"level{n}-{s:06d}")
            except FileNotFoundError:  # no n-gram of this shard is kept
                continue
            first, sizes = _groups(context[a:b])
            self._followers(level, EliasFano.of(level, "pointers"), context[a:b][first], sizes, word, np.arange(a, b), p, rest, spot)
        return p, rest, spot

    @staticmethod
    def _stretches(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
        first, sizes = _groups(shard) if len(shard) else (shard, shard)
        yield from zip(shard[first].tolist(), first.tolist(), (first + sizes).tolist())

    @staticmethod
    def _followers(level: dict, pointers: EliasFano, place: np.ndarray, sizes: np.ndarray, word: np.ndarray, mine: np.ndarray, p: np.ndarray, rest: np.ndarray, spot: np.ndarray) -> None:
        """Sets p, rest and spot of the rows mine, which are the words after each context (its place, how many rows)."""
        next_ = EliasFano.of(level, "next")
        rest[mine] = np.repeat(level["rest"][place], sizes)
        first, last = (x.astype(np.int64) for x in pointers.get_two(place))
        base = np.where(first > 0, next_.get(np.maximum(first - 1, 0)), U(0))
        found = next_.place(np.repeat(base + U(1), sizes) + word[mine].astype(U))
        hit = np.flatnonzero((found >= 0) & (found < np.repeat(last, sizes)))
        mine, found = mine[hit], found[hit]
        p[mine] = PROBABILITY[level["p"][found]]
        spot[mine] = found


def _pair_level(keys: np.ndarray, counts: np.ndarray, n_words: int, context_counts: np.ndarray, contexts: np.ndarray, least: int, discount: float) -> tuple[dict[str, np.ndarray] | None, np.ndarray]:
    """The arrays of a shard of level 2, from bigrams (context * (n_words + 1) + word) and the counts of its contexts; which bigrams are kept."""
    context, word = keys // U(n_words + 1), keys % U(n_words + 1)
    p = np.maximum(counts - discount, 1e-300) / context_counts[np.searchsorted(contexts, context)]
    step = np.minimum(255, np.ceil(-np.log10(p) * STEPS)).astype(np.uint8)
    kept = (counts >= least) & (step < 255)  # below the smallest step: as good as not kept
    context, word, step = context[kept], word[kept], step[kept]
    if not len(step):
        return None, kept
    first, sizes = _groups(context)
    # successors relative to their context: each context goes on from the last value of the one before
    last = word[np.append(first[1:], len(step)) - 1] + U(1)
    base = np.cumsum(last, dtype=U) - last
    return {
        **EliasFano.build(context[first]).arrays("contexts"),
        **EliasFano.build(np.append(first, len(step))).arrays("pointers"),
        **EliasFano.build(word + U(1) + np.repeat(base, sizes)).arrays("next"),
        "p": step,
        "rest": np.maximum(1e-9, 1 - np.add.reduceat(PROBABILITY[step], first)),
    }, kept


def _longer_level(context: np.ndarray, word: np.ndarray, counts: np.ndarray, n_contexts: int, least: int, discount: float) -> dict[str, np.ndarray] | None:
    """The arrays of a shard of a level below 2, from n-grams (the context's place, word). A context is counted by all its successors."""
    p = np.maximum(counts - discount, 1e-300) / np.bincount(context, counts, n_contexts)[context]
    step = np.minimum(255, np.ceil(-np.log10(p) * STEPS)).astype(np.uint8)
    kept = (counts >= least) & (step < 255)
    context, word, step = context[kept], word[kept], step[kept]
    if not len(step):
        return None
    first, sizes = _groups(context)
    last = word[np.append(first[1:], len(step)) - 1] + U(1)
    base = np.cumsum(last, dtype=U) - last
    return {
        **EliasFano.build(np.append(0, np.cumsum(np.bincount(context, minlength=n_contexts)))).arrays("pointers"),
        **EliasFano.build(word + U(1) + np.repeat(base, sizes)).arrays("next"),
        "p": step,
        "rest": np.maximum(1e-9, 1 - np.bincount(context, PROBABILITY[step], n_contexts)).astype(np.float32),
    }


def build(docs: DataFrame, folder: str, least: int = LEAST, discount: float = DISCOUNT, shard_tokens: int = SHARD_TOKENS, *, order: int = 2) -> Trie:
    """The trie of these documents (text) with n-grams of up to order words, in files under folder."""
    from pyarrow import fs

    if order < 2:
        raise ValueError("order is 2 or more")

    small_batches(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    rough = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-int(rough[1] // 6 + rough[0]) // shard_tokens))

    def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, sizes, n = [], [], 0
        for b in batches:
            t, s = _tokens(b.column(0))
            held.append(t)
            sizes.append(s)
            n += len(t)
            if n >= most:
                yield np.concatenate(held), np.concatenate(sizes)
                held, sizes, n = [], [], 0
        if held:
            yield np.concatenate(held), np.concatenate(sizes)

    empty = Trie(folder, shards, np.zeros(shards + 1, np.int64), 0, 0)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _ in gathered(batches, HELD_BACK):
            if len(tokens):
                yield _blocks(tokens, empty.word_shard(tokens), by_range=True)

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for shard, blocks in _by_shard(batches):
            words, counts = _merged(blocks)
            _save(folder, f"words-{shard:06d}", EliasFano.build(words).arrays("words") | EliasFano.build(np.append(0, np.cumsum(counts))).arrays("sums"))
            rows.append((shard, len(words), int(counts.sum())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["shard", "n_words", "n_tokens"])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(min(shards, 20_000), "shard").sortWithinPartitions("shard")

    counted = texts.mapInArrow(count_words, "shard int, block binary")
    got = stored(dealt(counted).mapInArrow(write_words, "shard long, n_words long, n_tokens long")).collect()  # a row per shard
    sizes = np.zeros(shards, np.int64)
    for r in got:
        sizes[r.shard] = r.n_words
    trie = Trie(folder, shards, np.concatenate([[0], np.cumsum(sizes)]), sum(r.n_tokens for r in got), int(rough[0]))
    if not got:
        return trie
    n_words = trie.n_words

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each bigram, with the word after it where there is one: its count is the sum over these
        for tokens, sizes in gathered(batches, HELD_BACK):
            g = Grams(trie, tokens, sizes)
            after = np.zeros(len(tokens), np.int64)
            if order > 2:
                after[:-1] = g.rank[1:] + 1
                after[np.cumsum(sizes) - 1] = 0
            width = U(len(g.number) + 1)
            both = np.sort(g.pair.astype(U) * width + after.astype(U))
            first, counts = _groups(both)
            both = both[first]
            pair, after = (both // width).astype(np.int64), (both % width).astype(np.int64)
            word = np.append(0, g.number + 1)[after]
            yield _gram_blocks(g.shard, g.context.astype(U) * U(n_words + 1) + g.word.astype(U), pair, word.astype(U), counts)

    def write_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for shard, blocks in _by_shard(batches):
            keys, pair, after, counts = _grams_merged(blocks)
            contexts = np.unique(keys // U(n_words + 1))
            own = trie_counts(trie, contexts.astype(np.int64))
            level, kept = _pair_level(keys, np.bincount(pair, counts).astype(np.int64), n_words, own, contexts, least, discount)
            if level is None:
                continue
            _save(folder, f"pairs-{shard:06d}", level)
            held = EliasFano.of(level, "contexts").get(np.arange(len(level["rest"]))).astype(np.int64)
            many = np.flatnonzero(trie.parts(own[np.searchsorted(contexts.astype(np.int64), held)]) > 1)
            rows += [(int(held[k]), 1 - float(level["rest"][k])) for k in many.tolist()]
            goes_on = np.flatnonzero(kept[pair] & (after > 0))
            if len(goes_on):
                place = np.cumsum(kept) - 1
                level = _longer_level(place[pair[goes_on]], after[goes_on] - U(1), counts[goes_on], int(kept.sum()), least, discount)
                if level is not None:
                    _save(folder, f"level3-{shard:06d}", level)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], ["context", "p"])

    split = stored(dealt(texts.mapInArrow(count_grams, "shard int, block binary")).mapInArrow(write_grams, "context long, p double"))
    # a split context has more than a shard's share of the tokens: fewer than one per shard
    trie.split = {r.context: max(1e-9, 1 - r.p) for r in split.groupBy("context").agg(F.sum("p").alias("p")).collect()}
    trie.order = min(order, 3)

    def count_longer(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, sizes in gathered(batches, GATHERED):
            g = Grams(trie, tokens, sizes)
            for gram, _, _, shard, spot in trie_levels(trie, g, n - 1):
                pass
            at = g.later[gram[g.later - 1] >= 0]
            context = gram[at - 1]
            kept = spot[context] >= 0
            at, context = at[kept], context[kept]
            if len(at):
                yield _blocks(spot[context].astype(U) * U(n_words + 1) + g.number[g.rank[at]].astype(U), shard[context])

    def write_longer(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blocks in _by_shard(batches):
            keys, counts = _merged(blocks)
            above = EliasFano.of(trie._file(f"level{n - 1}-{shard:06d}"), "next").n
            level = _longer_level((keys // U(n_words + 1)).astype(np.int64), keys % U(n_words + 1), counts, above, least, discount)
            if level is not None:
                _save(folder, f"level{n}-{shard:06d}", level)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["shard"])

    for n in range(4, order + 1):
        stored(dealt(texts.mapInArrow(partial(count_longer, n), "shard int, block binary")).mapInArrow(partial(write_longer, n), "shard long"))
        trie.order = n
    return trie


class Grams:
    """The tokens of some texts by their distinct words and bigrams, the latter in order by shard, context and word."""

    def __init__(self, trie: Trie, tokens: np.ndarray, sizes: np.ndarray) -> None:
        #: rank: of each token, its word's place in number (-1: unknown) and count.
        distinct, self.rank = np.unique(tokens, return_inverse=True)
        self.number, self.count = trie.words(distinct)
        first = np.cumsum(sizes) - sizes
        before = np.roll(self.rank, 1)
        before[first] = n = len(distinct)  # the text's beginning
        inside = np.ones(len(tokens), bool)
        inside[first] = False
        self.later = np.flatnonzero(inside)  # tokens with one before them in their text
        keys, pair = np.unique(before.astype(U) * U(n + 1) + self.rank.astype(U), return_inverse=True)
        context, word = (keys // U(n + 1)).astype(np.int64), (keys % U(n + 1)).astype(np.int64)
        asked = np.where(self.number >= 0, self.number, trie.n_words)  # unknown words stand for no successor
        self.context, self.word = np.append(self.number, trie.n_words)[context], asked[word]
        self.context_count = np.append(self.count, trie.n_texts)[context]
        shard = trie.pair_shard(self.context, self.word, self.context_count)
        order = np.argsort(shard.astype(np.int16) if trie.shards < 1 << 15 else shard, kind="stable")
        self.shard, self.context, self.word, self.context_count = shard[order], self.context[order], self.word[order], self.context_count[order]
        new = np.empty(len(order), np.int64)
        new[order] = np.arange(len(order))
        #: pair: of each token, the place of the bigram that ends there.
        self.pair = new[pair]
        self.asked = asked


def trie_levels(trie: Trie, g: Grams, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From level 2 on: of each token, which n-gram ends there (-1: none, for the text begins later), then of each n-gram, p, rest of its context, shard and place (-1 if not kept)."""
    gram, shard = g.pair, g.shard
    p, rest, spot = trie.pairs(shard, g.context, g.word, g.context_count)
    yield gram, p, rest, shard, spot
    width = U(len(g.number) + 1)
    for level in range(3, order + 1):
        at = g.later[gram[g.later - 1] >= 0]
        keys, back = np.unique(gram[at - 1].astype(U) * width + g.rank[at].astype(U), return_inverse=True)
        gram = np.full(len(gram), -1, np.int64)
        gram[at] = back
        above = (keys // width).astype(np.int64)
        context, word, shard = spot[above], g.asked[(keys % width).astype(np.int64)], shard[above]
        p, rest, spot = np.zeros(len(keys)), np.ones(len(keys)), np.full(len(keys), -1, np.int64)
        kept = np.flatnonzero(context >= 0)
        p[kept], rest[kept], spot[kept] = trie.longer(level, shard[kept], context[kept], word[kept])
        yield gram, p, rest, shard, spot


def trie_counts(trie: Trie, numbers: np.ndarray) -> np.ndarray:
    """The counts of words given by number, in order."""
    out = np.full(len(numbers), trie.n_texts, np.int64)
    shard = np.searchsorted(trie.offsets, numbers, "right") - 1
    for s in np.unique(shard[numbers < trie.n_words]).tolist():
        mine = np.flatnonzero((shard == s) & (numbers < trie.n_words))
        before, upto = EliasFano.of(trie._file(f"words-{s:06d}"), "sums").get_two(numbers[mine] - trie.offsets[s])
        out[mine] = (upto - before).astype(np.int64)
    return out


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every document."""
    small_batches(docs.sparkSession)
    total = float(trie.n_tokens + trie.n_words + 1)
    n_words = trie.n_words

    def scored(ids: pa.Array, tokens: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        if not n_words:  # nothing is known
            known, p = np.zeros(len(tokens), np.int64), np.full(len(tokens), 1 / total)
            base = np.log10(p)
        else:
            g = Grams(trie, tokens, sizes)
            own = (g.count + 1) / total
            known, base, p = (g.count > 0).astype(np.int64)[g.rank], np.log10(own)[g.rank], own[g.rank]
            for gram, own, rest, _, _ in trie_levels(trie, g, trie.order):
                at = np.flatnonzero(gram >= 0)
                p[at] = own[gram[at]] + rest[gram[at]] * p[at]
        first = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, first)
        columns = [ids, pa.array(sizes), pa.array(add(known)), pa.array(add(base)), pa.array(add(np.log10(p)))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, sizes, n = [], [], [], 0
        for b in batches:
            t, s = _tokens(b.column(1))
            ids.append(b.column(0))
            tokens.append(t)
            sizes.append(s)
            n += len(t)
            if n >= GATHERED:
                yield scored(pa.concat_arrays(ids), np.concatenate(tokens), np.concatenate(sizes))
                ids, tokens, sizes, n = [], [], [], 0
        if n:
            yield scored(pa.concat_arrays(ids), np.concatenate(tokens), np.concatenate(sizes))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def train_and_score(docs: DataFrame, parts: int = 7, held: int = 2, order: int = 2) -> DataFrame:
    """Scores of all documents by a model, of n-grams up to order words, of those whose crc32(doc_id) modulo parts isn't held."""
    out = fold(F.col("doc_id"), parts) == held
    folder = f"{shared_dir(docs.sparkSession)}/trie-{uuid.uuid4().hex}"
    trie = build(docs.filter(~out), folder, order=order)
    return score(docs, trie).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(trie.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
