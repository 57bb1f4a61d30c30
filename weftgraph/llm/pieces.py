"""Operator 9: SentencePiece (merge type) encoding by a prefix table, and decoding.

For each prefix of a chunk the table holds the last token of that prefix's encoding, which is unique: of the tokens that end
there (found by an Aho-Corasick automaton over the vocabulary), the one that may stand next to the last token of the
prefix before it. Two tokens may stand side by side if no merge across their border would have come before the merges
that formed them. The ids are then read backwards from the last prefix. This is linear in the text, and exact.

No token holds a blank after another character, so blanks begin chunks that are encoded independently; characters outside
of the vocabulary (line ends too) become byte tokens and stand alone. The chunks of a batch that a worker doesn't remember are
one text, whose places all go through the automaton side by side, as their tables are filled, prefix by prefix; what a chunk's ids decode to is
remembered with them.

Defined results: null text is an empty text (only the end id); rows are kept as they are, with repeated or null doc_ids; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLANK = "▁"
#: Characters of chunks that a worker remembers, in each of two generations; then the older one is forgotten.
REMEMBERED = 4_000_000
#: Longer chunks are encoded one by one.
LONG = 64
NORMAL, BYTE, CONTROL = 1, 6, 3
#: Marks of a prefix in the table of many chunks: its last character stands alone, it is empty, nothing found.
ALONE, START, NONE = -1, -2, -3


class Merges:
    """A merge-type vocabulary: the order of merges, each token's parts, and which tokens may stand side by side."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.text = [p for p, _, _ in pieces]
        self.normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.rank = [-score for _, score, _ in pieces]
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.alphabet = {c for p in self.normal for c in p}
        self.together: dict[tuple[int, int], bool] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.right: dict[int, list[tuple[int, float]]] = {}
        #: Tokens that merging can reach; only these go into the automaton.
        parts = {i: self._parts(p) for p, i in self.normal.items()}
        self.parts = {i: x for i, x in parts.items() if x is not None}

    def _parts(self, text: str) -> tuple[int, int] | tuple[()] | None:
        """The two tokens that the last merge joins; none for a character; None if merging doesn't give this token."""
        if len(text) == 1:
            return ()
        if any(c not in self.normal for c in text):
            return None
        symbols = [self.normal[c] for c in text]
        while len(symbols) > 1:
            best, at = math.inf, -1
            for k in range(len(symbols) - 1):
                joined = self.normal.get(self.text[symbols[k]] + self.text[symbols[k + 1]])
                if joined is not None and self.rank[joined] < best:
                    best, at = self.rank[joined], k
            if at < 0:
                return None
            if len(symbols) == 2:
                return symbols[0], symbols[1]
            symbols[at : at + 2] = [self.normal[self.text[symbols[at]] + self.text[symbols[at + 1]]]]
        return None

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stood at this edge while the token was formed, each with the rank of the merge that ended it."""
        known = (self.left, self.right)[side]
        if (got := known.get(token)) is None:
            got, until = [], math.inf
            while True:
                got.append((token, until))
                if not self.parts[token]:
                    break
                until, token = self.rank[token], self.parts[token][side]
            known[got[0][0]] = got
        return got

    def fit(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b leaves just these two."""
        if (known := self.together.get((a, b))) is None:
            if len(self.together) > 200_000:
                self.together.clear()
            known = self.together[a, b] = self.fits(a, b)
        return known

    def fits(self, a: int, b: int) -> bool:
        for x, x_until in self._edge(a, 1):
            for y, y_until in self._edge(b, 0):
                joined = self.normal.get(self.text[x] + self.text[y])
                if joined is not None and self.rank[joined] < x_until and self.rank[joined] <= y_until:
                    return False
        return True


class Fits:
    """Which pairs of tokens fit, remembered in a table of fixed size: a slot holds the last pair asked for there."""

    def __init__(self, merges: Merges, bits: int = 21) -> None:
        self.merges, self.shift = merges, np.uint64(64 - bits)
        self.pair, self.answer = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a * len(self.merges.text) + b
        slot = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        unknown = np.flatnonzero(self.pair[slot] != pair)
        if not len(unknown):
            return self.answer[slot]
        out = self.answer[slot]
        asked, first, back = np.unique(pair[unknown], return_index=True, return_inverse=True)
        first = unknown[first]
        got = np.fromiter(map(self.merges.fits, a[first].tolist(), b[first].tolist()), bool, len(asked))
        self.pair[slot[first]], self.answer[slot[first]] = asked, got  # of pairs that share a slot the last one stays in both
        out[unknown] = got[back]
        return out


class Goto:
    """The automaton's goto function as arrays, followed from all places of a text side by side."""

    def __init__(self, tokens: dict[int, str]) -> None:
        state, moves, self.token = {"": 0}, {}, [-1]
        for i, text in tokens.items():
            for k, c in enumerate(text):
                if (prefix := text[: k + 1]) not in state:
                    moves[state[text[:k]] << 21 | ord(c)] = state[prefix] = len(state)
                    self.token.append(-1)
            self.token[state[text]] = i
        self.token = np.array(self.token, np.int64)
        self.first = np.full(0x110000, -1, np.int32)
        for c, to in moves.items():
            if c < 0x110000:
                self.first[c] = to
        self.moves = np.array(sorted(moves), np.int64)
        self.to = np.array([moves[k] for k in self.moves.tolist()], np.int64)

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens end (the place behind the last character), and which; of tokens that end at one place shorter ones come first."""
        code = np.frombuffer((text + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
        state = self.first[code].astype(np.int64)
        at = np.flatnonzero(state > 0)
        state, ends, found = state[at], [], []
        while len(at):
            at += 1
            token = self.token[state]
            ends.append(at[token >= 0])
            found.append(token[token >= 0])
            move = state << 21 | code[at]
            to = np.minimum(np.searchsorted(self.moves, move), len(self.moves) - 1)
            on = np.flatnonzero(self.moves[to] == move)
            at, state = at[on], self.to[to[on]]
        return (np.concatenate(ends), np.concatenate(found)) if ends else (np.empty(0, np.int64), np.empty(0, np.int64))


class Encoder:
    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as source:
            model.ParseFromString(source.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.name != "identity" or not model.trainer_spec.byte_fallback:
            raise ValueError("a merge-type model with byte fallback and without normalisation is expected")
        self.merges = Merges([(p.piece, p.score, p.type) for p in model.pieces])
        if any(BLANK in p.lstrip(BLANK) for p in self.merges.normal):
            raise ValueError("a token holds a blank after another character")
        self.automaton = ahocorasick.Automaton()
        for i in self.merges.parts:
            self.automaton.add_word(self.merges.text[i], i)
        self.automaton.make_automaton()
        self.goto = Goto({i: self.merges.text[i] for i in self.merges.parts})
        if not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces or "\n" in self.merges.alphabet or "\0" in self.merges.alphabet:
            raise ValueError("a model that puts a blank before each text, keeps all others and has no token for line ends or NUL is expected")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        #: What a chunk may be: a line end with what follows up to a blank, or a word with its blanks.
        self.chunk = re.compile(f"\n[^{BLANK}\n]*|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
        self.fits = Fits(self.merges)
        self.length = np.array([len(p) for p in self.merges.text], np.int64)
        self.decimal = [str(i) for i in range(len(self.merges.text))]
        #: The bytes that each id decodes to.
        self.surface = [p.piece.replace(BLANK, " ").encode() for p in model.pieces]
        for p, i in ((p, i) for i, p in enumerate(model.pieces) if p.type in (BYTE, CONTROL)):
            self.surface[i] = bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b""
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.remembered = 0

    def ids(self, chunk: str) -> list[int]:
        """The encoding of a chunk by the prefix table."""
        merges, n = self.merges, len(chunk)
        last: list[int | None] = [None] * (n + 1)  # of each prefix: the last token; -1 for a character that stands alone
        done, fit, text = 0, merges.fit, merges.text
        for end, token in self.automaton.iter(chunk):
            while done < end:  # characters without any token
                done += 1
                if last[done] is None:
                    last[done] = -1
            end += 1
            if last[end] is not None:
                continue
            before = end - len(text[token])
            if before == 0 or last[before] == -1 or (last[before] is not None and fit(last[before], token)):
                last[end], done = token, end
        while done < n:
            done += 1
            if last[done] is None:
                last[done] = -1
        out: list[int] = []
        while n:
            token = last[n]
            if token == -1:
                out.extend(merges.byte[b] for b in reversed(chunk[n - 1].encode()))
                n -= 1
            else:
                out.append(token)
                n -= len(text[token])
        out.reverse()
        return out

    def many(self, chunks: list[str]) -> list[list[int]]:
        """The same of many chunks without NUL: all tables are filled side by side."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        # places are ends of prefixes: place p is before character p of the joined text
        end, token = self.goto.matches("\0".join(chunks))
        last = np.full(int(ends[-1]) + 1, NONE, np.int64)
        last[starts] = START
        single = np.zeros(len(last), bool)
        single[end[self.length[token] == 1]] = True
        inside = np.ones(len(last), bool)
        inside[starts] = False
        last[inside & ~single] = ALONE
        level = end - np.repeat(starts, size + 1)[end]
        order = np.argsort(level.astype(np.uint16), kind="stable")
        edges = np.searchsorted(level[order], np.arange(1, int(level.max(initial=0)) + 2))
        for a, b in zip(edges.tolist(), edges[1:].tolist()):  # all prefixes of one length
            mine = order[a:b]
            here, own = end[mine], token[mine]
            before = last[here - self.length[own]]
            good = before != NONE
            pairs = np.flatnonzero(before >= 0)
            good[pairs] = self.fits(before[pairs], own[pairs])
            last[here[good]] = own[good]
        # back from the last prefix of each chunk
        at, who, steps = ends.copy(), np.arange(len(chunks)), []
        while len(who := who[at[who] > starts[who]]):
            own = last[at[who]]
            steps.append((who, np.where(own >= 0, own, -at[who])))
            at[who] -= np.where(own >= 0, self.length[own], 1)
        if not steps:
            return [[] for _ in chunks]
        owner, ids = (np.concatenate(x)[::-1] for x in zip(*steps))
        place = np.argsort(owner, kind="stable")
        flat, cut = ids[place].tolist(), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(chunks)))]).tolist()
        out = [flat[a:b] for a, b in zip(cut, cut[1:])]
        for k in np.unique(owner[ids < 0]).tolist():
            out[k] = [i for x in out[k] for i in ([x] if x >= 0 else [self.merges.byte[b] for b in chunks[k][-x - 1 - int(starts[k])].encode()])]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for x in self.chunks([text])[0] for i in x[0].split()]

    def keys(self, text: str) -> list[str]:
        """The chunks of a text: one that begins with a line end as it is, any other without its first blank."""
        if not text:
            return []
        if "  " in text or BLANK in text or text[0] == " ":
            return [c if c[0] == "\n" else c[1:] for c in self.chunk.findall(BLANK + text.replace(" ", BLANK))]
        return text.replace("\n", " \n").split(" ")

    def chunks(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        """Of each text the decimal ids of its chunks, side by side, and what these decode to; the first blank is one too many."""
        keys = [self.keys(t) for t in texts]
        flat = list(chain.from_iterable(keys))
        known, older = self.known, self.older
        got = list(map(known.get, flat))
        missing = [k for k, x in enumerate(got) if x is None] if None in got else []
        new = []
        for key in {flat[k] for k in missing}:
            if (x := older.get(key)) is not None:
                known[key] = x
            else:
                new.append(key)
            self.remembered += len(key) + 1
        if new:
            # a line end stands alone, so what follows it is a chunk of its own
            parts = [k[1:] if k[:1] == "\n" else BLANK + k for k in new]
            short = [k for k, p in enumerate(parts) if len(p) <= LONG and "\0" not in p]
            ids: list[list[int] | None] = [None] * len(new)
            for k, x in zip(short, self.many([parts[k] for k in short]) if short else []):
                ids[k] = x
            line = self.merges.byte[10]
            for key, part, x in zip(new, parts, ids):
                x = self.ids(part) if x is None else x
                if key[:1] == "\n":
                    x = [line, *x]
                known[key] = " ".join([self.decimal[i] for i in x]), b"".join([self.surface[i] for i in x]).decode()
        for k in missing:
            got[k] = known[flat[k]]
        each = iter(got)
        out = [list(islice(each, len(k))) for k in keys]
        if self.remembered > REMEMBERED:
            self.known, self.older, self.remembered = {}, known, 0
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode(docs: DataFrame, model: str, end: int = 2, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids and decoded."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model)
        for b in batches:
            n, ids_sha, decoded_sha, kept, texts = [], [], [], [], []
            for chunks in tool.chunks([x or "" for x in b.column(1).to_pylist()]):
                decimal, plain = zip(*chunks) if chunks else ((), ())
                ids = " ".join([*decimal, str(end)])
                decoded = "".join(plain)[1:]
                n.append(ids.count(" ") + 1)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    kept.append(np.array(ids.split(), np.int32))
                    texts.append(decoded)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            if with_ids:
                columns += [pa.array(kept, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
