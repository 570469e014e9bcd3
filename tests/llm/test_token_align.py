"""Token alignment against a plain walk over byte ends, and sparse products against dense ones."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stellate.llm import token_align
from stellate.llm.token_align import Csr
from tests.llm import awkward

BYTE_BPE = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
PIECES = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()

TEXTS = [
    "the end of <|endoftext|> is <s> plain </s>", "a▁b", "  two  spaces ", "tab\there\nand\r\nlines", "é ß 漢字 😀 ﬁ",
    "x" * 3000, "日本語" * 400, "\x00\x01", "<0x41> A", "word " * 2000, "1234567890 3.14", "İstanbul",
]


def plain_tokens(text: str) -> tuple[list[int], list[int], list[int], list[int]]:
    """Ids and byte ends of both, by the libraries and by looking bytes up one by one."""
    left = Tokenizer.from_str(BYTE_BPE)
    left.encode_special_tokens = True
    letters = {}
    extra = 256
    for b in range(256):
        if chr(b).isprintable() and b not in (32, 160, 173):
            letters[chr(b)] = b
        else:
            letters[chr(extra)] = b
            extra += 1
    model = sentencepiece.SentencePieceProcessor(model_proto=PIECES)
    whole = (" " + text).encode()
    one = left.encode(" " + text, add_special_tokens=False)
    a = [bytes(letters[c] for c in t) for t in one.tokens]
    ids = model.encode(text)
    b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids]
    if not text or b"".join(a) != whole or b"".join(b) != whole:
        return [], [], [], []
    return one.ids, ids, np.cumsum([len(x) for x in a]).tolist(), np.cumsum([len(x) for x in b]).tolist()


def brute(texts: list[str | None]) -> list[tuple]:
    rows, times = [], Counter()
    for text in texts:
        a, b, ea, eb = plain_tokens(text or "")
        joined = sorted(set(ea) & set(eb))
        at_a, at_b = {e: i for i, e in enumerate(ea)}, {e: i for i, e in enumerate(eb)}
        pairs = [(a[at_a[e]], b[at_b[e]]) for e in joined]
        groups, x, y = [], 0, 0
        for e in joined:
            groups.append(",".join(map(str, a[x : at_a[e] + 1])) + "|" + ",".join(map(str, b[y : at_b[e] + 1])))
            x, y = at_a[e] + 1, at_b[e] + 1
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(joined), pairs, digest))
        times.update(pairs)
    best: dict[int, int] = defaultdict(int)
    for (_, right), n in times.items():
        best[right] = max(best[right], n)
    return [(na, nb, g, len(p), sum(times[q] == best[q[1]] for q in p), sum(times[q] for q in p), d) for na, nb, g, p, d in rows]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("limit", [token_align.BROADCAST_PAIRS, 0])
def test_equals_a_plain_walk(spark, limit):
    rows = awkward.document_rows() + [(300 + i, t, None, None, None) for i, t in enumerate(TEXTS)]
    got = token_align.align(awkward.documents(spark, rows), BYTE_BPE, PIECES, broadcast_pairs=limit)
    want = [(r[0], *x) for r, x in zip(rows, brute([r[1] for r in rows]), strict=True)]
    assert Counter(tuple(r) for r in got.select("doc_id", *COLUMNS).collect()) == Counter(want)


def test_empty_table_and_texts_without_tokens(spark):
    assert token_align.align(awkward.empty(spark), BYTE_BPE, PIECES).collect() == []
    only = awkward.documents(spark, [(1, None, None, None, None), (2, "", None, None, None), (None, "a▁b", None, None, None)])
    assert {tuple(r)[1:] for r in token_align.align(only, BYTE_BPE, PIECES).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_products_equal_dense_ones():
    rng = np.random.default_rng(3)

    def sparse(m: np.ndarray) -> Csr:
        r, c = np.nonzero(m)
        return Csr(np.concatenate([[0], np.cumsum((m != 0).sum(axis=1))]), c, m[r, c], m.shape[1])

    def dense(m: Csr) -> np.ndarray:
        out = np.zeros((m.height, m.width), np.int64)
        for i in range(m.height):
            out[i, m.indices[m.indptr[i] : m.indptr[i + 1]]] = m.data[m.indptr[i] : m.indptr[i + 1]]
        return out

    for _ in range(30):
        n, k, m = rng.integers(1, 9, 3)
        a, b = rng.integers(0, 3, (n, k)), rng.integers(0, 3, (k, m))
        product = sparse(a).times(sparse(b))
        assert (dense(product) == a @ b).all() and all((np.diff(product.indices[x:y]) > 0).all() for x, y in zip(product.indptr, product.indptr[1:], strict=False))
        assert (dense(sparse(a).transposed()) == a.T).all()


@pytest.mark.parametrize("at_once", [1 << 18, 3])
def test_links_of_bytes_and_groups(spark, at_once):
    rows = [(i, t, None, None, None) for i, t in enumerate(["a tokenization example", "", "漢字 tokens", None, "unbelievable"])]
    docs = awkward.documents(spark, rows)
    share_bytes, share_group = Counter(), Counter()
    for i, t, *_ in rows:
        a, b, ea, eb = plain_tokens(t or "")
        common = sorted(set(ea) & set(eb))
        for x, ex in enumerate(ea):
            for y, ey in enumerate(eb):
                n = min(ex, ey) - max(ea[x - 1] if x else 0, eb[y - 1] if y else 0)
                if n > 0:
                    share_bytes[i, x, y, a[x], b[y], n] += 1
                if np.searchsorted(common, ex) == np.searchsorted(common, ey):
                    share_group[i, x, y, a[x], b[y], 1] += 1
    for share, want in (("bytes", share_bytes), ("group", share_group)):
        assert Counter(tuple(r) for r in token_align.links(docs, BYTE_BPE, PIECES, share, pairs_at_once=at_once).collect()) == want
