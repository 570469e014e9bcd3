from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stellate.llm import cutting_stock, packing, tokens
from stellate.llm.queries import vocabulary
from tests.llm import awkward


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_str(vocabulary())


def test_cached_encoding_equals_the_library(tokenizer):
    encoder = tokens.WordEncoder(vocabulary())
    odd = [
        "", " ", "don't we'll 'tis \"quoted\"", "Ünïcode ß ﬁ Ǆ İ Σας 漢字 😀 é é", "a1b22 3.14 x_y --- ...", "ΟΔΟΣ ὈΔΥΣΣΕΎΣ",
        "<|endoftext|> <|startoftext|>x", "tab\tnew\nline nbsp em\x85next", "AAA!!! (b) [c], d;e:f", "\x00\x01 \x1c\x1f",
        awkward.prose(500, 9), "word" * 300,
    ]
    texts = [*odd, *(r[1] or "" for r in awkward.document_rows())]
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    for text, ids in zip(texts, want, strict=True):
        assert encoder.encode(text) == ids, repr(text[:60])
    ids, counts = encoder.encode_all(pa.array([None, *texts, None]).slice(1, len(texts)))
    assert ids.tolist() == list(itertools.chain(*want)) and counts.tolist() == [len(x) for x in want]


def test_every_latin_letter_and_tail_equals_the_library(tokenizer):
    encoder = tokens.WordEncoder(vocabulary())
    letters = [chr(c) for c in range(256) if chr(c).isalpha()]
    chunks = [f"{a}{b}{c}" for a in letters for b in ("", "Q", "ÿ") for c in ("", ".", ",)", "'", "';", "-a", "2")]
    texts = [" ".join(chunks), *chunks, "".join(letters), "ªß. ÀÉ, µ", "Ā.", "aĀ", "Ω,", "...", "", " \n", "Σ. Σ a.b ,a"]
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    for kind in (pa.string(), pa.large_string()):
        ids, counts = encoder.encode_all(pa.array(texts, kind))
        assert ids.tolist() == list(itertools.chain(*want)) and counts.tolist() == [len(x) for x in want]


def test_words_that_come_again_are_tokenized_once(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_WORDS", 100)
    encoder, asked = tokens.WordEncoder(vocabulary()), Counter()
    plain, chunk = encoder._tokenize, encoder._chunk
    encoder._tokenize = lambda word: asked.update([word]) or plain(word)
    monkeypatch.setattr(encoder, "_chunk", lambda c: asked.update(["one by one"]) or chunk(c))
    spell = lambda n: "".join("abcdefghij"[int(d)] for d in str(n))
    for batch in range(20):
        text = " ".join([f"{spell(n)}, {spell(n).upper()} É{spell(n)}" for n in [*range(50), *range(1000 + 60 * batch, 1060 + 60 * batch)]])
        assert encoder.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder._words) + len(encoder._older) < 800
    assert set(asked.values()) == {1} and "one by one" not in asked


def check(rows: list[tuple], pieces: list, tokenizer, length: int) -> int:
    """Every document is covered once, sequences are gapless; returns the padding."""
    want = Counter()
    for doc, text, *_ in rows:
        want[doc, tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2])] += 1
    ids_of = defaultdict(list)
    for (doc, ids), n in want.items():
        ids_of[doc] += [ids] * n
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    assert set(by_doc) == set(ids_of)
    for doc, some in by_doc.items():
        # rows that share an id are told apart by their pieces' checksums
        cover = Counter((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in some)
        assert sum(p["length"] for p in some) == sum(map(len, ids_of[doc]))
        for ids in ids_of[doc]:
            at = 0
            while at < len(ids):
                fits = [
                    k for k in cover
                    if cover[k] and k[0] == at and k[3] == len(ids)
                    and k[2] == zlib.crc32(np.array(ids[at : at + k[1]], "<u4").tobytes())
                ]
                assert fits, (doc, at)
                cover[fits[0]] -= 1
                at += fits[0][1]
        assert not +cover
    padding = 0
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
    for some in by_sequence.values():
        some.sort(key=lambda p: p["offset"])
        size = 0
        for p in some:
            assert p["offset"] == size and p["length"] > 0
            size += p["length"]
        assert size <= length
        padding += length - size if size & (size - 1) else 0
    return padding


@pytest.mark.parametrize("length,width", [(4096, 64), (256, 16), (64, 1)])
def test_pieces_cover_awkward_documents(spark, tokenizer, length, width):
    rows = awkward.document_rows()
    pieces = packing.pack(awkward.documents(spark), vocabulary(), length=length, width=width).collect()
    assert check(rows, pieces, tokenizer, length) == 0


def test_many_documents_and_one_hot_length(spark, tokenizer):
    rows = [(i, awkward.words(30 + i % 90, i), None, None, None) for i in range(400)]
    rows += [(1000 + i, "the same words again and again", None, None, None) for i in range(200)]
    pieces = packing.pack(awkward.documents(spark, rows, clashes=False), vocabulary(), length=512, width=16).collect()
    assert check(rows, pieces, tokenizer, 512) == 0
    assert len(pieces) < 1.3 * len(rows)  # most documents stay whole


def test_empty_table(spark):
    assert packing.pack(awkward.empty(spark), vocabulary()).collect() == []


def test_blocks_of_the_stream_meet(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "_BLOCK", 100)
    monkeypatch.setattr(packing, "_GROUP_BITS", 2)
    rows = [(i, awkward.words(20 + i % 50, i), None, None, None) for i in range(60)]
    pieces = packing.pack(awkward.documents(spark, rows), vocabulary(), length=256, width=64).collect()
    assert check(rows, pieces, tokenizer, 256) == 0


def test_pricing_finds_the_best_pattern():
    rng = np.random.default_rng(4)
    for _ in range(20):
        duals = rng.random(5)
        best = max(
            sum(d * k for d, k in zip(duals, counts, strict=True))
            for counts in itertools.product(range(11), repeat=5)
            if sum((i + 1) * k for i, k in enumerate(counts)) <= 10
        )
        value, pattern = cutting_stock.price(duals, 10)
        assert value == pytest.approx(best) == pytest.approx(float(pattern @ duals))


def test_column_generation_meets_the_demand_at_the_bound():
    rng = np.random.default_rng(5)
    for _ in range(10):
        demand = rng.integers(0, 500, 32)
        patterns = cutting_stock.solve(demand, 32)
        made = sum(times * pattern for pattern, times in patterns)
        assert np.all(made >= demand - 1e-6)
        assert all(int(pattern @ np.arange(1, 33)) <= 32 for pattern, _ in patterns)
        size = float(demand @ np.arange(1, 33)) / 32
        big = demand[16:].sum()  # no two of these share a bin
        assert sum(t for _, t in patterns) <= max(size, big) * 1.1 + 1
    assert cutting_stock.solve(np.zeros(8, np.int64), 8) == []
