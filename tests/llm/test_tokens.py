"""Operators 7, 9 and 10 against the libraries, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from weftgraph.llm import huffman, packing, pieces, tokens
from weftgraph.llm.common import tokenizer_path

BPE, SP = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def strange(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab eé1,'s\n  \t!語thin▁\xa0") for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunks_give_the_librarys_ids(library):
    texts = ["", " ", "\n", "a  b", " lead", "trail ", "it's  we'll\n\n x", "<|endoftext|>", "a\x00b c", *strange(1500, 3)]
    ids, counts = tokens.Encoder(BPE).encode(texts, None)
    at = np.cumsum(counts) - counts
    assert [ids[a : a + n].tolist() for a, n in zip(at, counts)] == [library(t) for t in texts]


def test_forgetting_keeps_results(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    tool = tokens.Encoder(BPE)
    texts = strange(200, 4)
    for k in range(0, 200, 10):
        ids, counts = tool.encode(texts[k : k + 10], 0)
        assert ids.tolist() == [i for t in texts[k : k + 10] for i in [*library(t), 0]]


@pytest.mark.parametrize("counts", [[5], [0, 3, 0], [1, 1], [0, 0], [2**k for k in range(40)], list(range(1, 300))])
def test_code_is_a_length_limited_prefix_code(counts):
    lengths = huffman.code_lengths(np.array(counts))
    used = np.array(counts) > 0
    assert ((lengths > 0) == used).all() and lengths.max(initial=0) <= huffman.MAX_BITS
    assert sum(2.0 ** -float(n) for n in lengths[used]) <= 1
    codes = huffman.canonical(lengths)
    words = [f"{codes[i]:0{lengths[i]}b}" for i in np.flatnonzero(used)]
    assert not any(a != b and b.startswith(a) for a in words for b in words)


def expected(texts, library):
    out, start = [], 0
    for i, t in texts:
        ids = [*library(t), 0]
        out.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_token_files_come_back(spark, docs, texts, library):
    got = huffman.write_and_read(docs, BPE).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected(texts, library)
    assert [crc(r.ids) for r in got] == [r.ids_crc32 for r in got]


def test_token_files_of_odd_rows(odd, nothing, library):
    got = huffman.write_and_read(odd, BPE, with_ids=False).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or -1, len(library(t)) + 1, crc([*library(t), 0])) for i, t in rows)
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    assert huffman.write_and_read(nothing, BPE).count() == 0


def check_packing(rows, texts, library, window):
    pieces_of, placed = {}, {}
    for r in rows:
        pieces_of.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in placed.values():  # gapless from 0
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    total = sum(len(library(t)) + 1 for _, t in texts)
    assert sum(r.length for r in rows) == total
    assert len(placed) * window <= total * 1.05 + 2 * window
    return pieces_of


def test_packing_holds_every_id_once(docs, texts, library):
    rows = packing.pack(docs.coalesce(1), BPE, window=256).collect()
    found = check_packing(rows, texts, library, 256)
    for i, t in texts:
        ids = [*library(t), 0]
        own = sorted(found[i, len(ids)], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and all(crc(r.ids) == r.ids_crc32 for r in own)


def test_packing_odd_rows(odd, nothing, library):
    check_packing(packing.pack(odd, BPE).collect(), [(r.doc_id, r.text) for r in odd.collect()], library, 1024)
    assert packing.pack(nothing, BPE).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(5)
    lengths = [rng.randint(1, 99) for _ in range(400)]
    where, _, opened = packing.best_fit_decreasing(lengths, 100)
    rooms: list[int] = []
    for k in sorted(range(400), key=lambda k: (-lengths[k], k)):
        fits = [x for x in rooms if x >= lengths[k]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[k])
        else:
            rooms.append(100 - lengths[k])
    assert opened == len(rooms)
    fill = [sum(n for n, w in zip(lengths, where) if w == k) for k in range(opened)]
    assert sorted(100 - f for f in fill) == sorted(rooms)


def test_pieces_equal_the_library(odd, nothing, docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    tool = pieces.Encoder(SP)
    for t in [*strange(1500, 6), "aaaaaaaa", "<s>", "     x      y"]:
        assert tool.encode(t) == sp.encode(t), t

    def want(i, t):
        ids = [*sp.encode(t or ""), 2]
        return i or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    for df in (docs, odd):
        got = [(r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_decode(df, SP, with_ids=False).collect()]
        assert sorted(got) == sorted(want(r.doc_id, r.text) for r in df.collect())
    assert pieces.encode_decode(nothing, SP).count() == 0


def test_more_ids_than_16_bits_have_codes():
    rng = np.random.default_rng(8)
    counts = rng.integers(1, 50, 70_000)
    lengths = huffman.code_lengths(counts)
    assert lengths.max() == 17
    ids = rng.integers(0, 70_000, 5_000)
    data, first, inside = huffman.encode_bits(ids, huffman.canonical(lengths), lengths, np.array([5_000]))
    at = inside[:: huffman.CHECKPOINT]
    each = np.full(len(at), huffman.CHECKPOINT)
    each[-1] = 5_000 - huffman.CHECKPOINT * (len(at) - 1)
    assert (huffman.decode_bits(data, at, each, huffman.decode_table(lengths)) == ids).all()


def test_a_few_chunks_or_ids_are_remembered(library, monkeypatch):
    monkeypatch.setattr(tokens, "IDS_EACH", 0)
    tool = tokens.Encoder(BPE)
    for t in ["x" * 5_000, "a b c " + "y z" * 900, "x" * 5_000]:
        assert tool.encode([t], 0)[0].tolist() == [*library(t), 0]
