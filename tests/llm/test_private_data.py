"""Personal data: the fixed forms against plain regular expressions, the discoveries against a plain bootstrap."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stellate.llm import private_data
from tests.llm import awkward

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])) % 10 == 0


def plain(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, form in PLAIN.items():
        for m in re.finditer(form, text or ""):
            digits = "".join(c for c in m.group() if c in "0123456789")
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PLAIN).index(kind), kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def in_points(text: str) -> list[tuple[str, int, int]]:
    raw = text.encode()
    return private_data._points(raw, private_data.base_spans(raw))


PIECES = ["a@b.co", "@", "+1 (017) 555-7713", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", ".", "-", " ", "é", "😀", "0", "12", "x_y", "+", "(", "\n", "user@host", "007", "%"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_fixed_forms_match_plain_expressions(parts):
    text = "".join(parts)
    assert in_points(text) == plain(text)


def test_long_runs_take_linear_time():
    start = time.perf_counter()
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "+1" * 500_000, "a@" * 500_000, "1 " * 1_000_000, "@" * 1_000_000):
        private_data.candidates(text.encode(), private_data.base_spans(text.encode()))
    assert time.perf_counter() - start < 60


def naive_bootstrap(texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """All spans per text, with dictionaries in place of tables."""
    graph, kinds, spots = defaultdict(set), defaultdict(set), []
    bases = []
    for text in texts:
        raw = text.encode()
        base = private_data.base_spans(raw)
        others = private_data.candidates(raw, base)
        for k, s, e in base:
            kinds[private_data.instance_of(raw[s:e])].add(k)
        for s, e in [(s, e) for _, s, e in base] + others:
            for p in private_data.patterns(raw, s, e):
                graph[p].add(private_data.instance_of(raw[s:e]))
        seen = {i for i, k in kinds.items() if k}
        bases.append(base)
        spots.append([(private_data.instance_of(raw[s:e]), s, e) for s, e in others])
    context = set().union(*graph.values()) if graph else set()
    new: dict[int, tuple[float, str]] = {}
    for _ in range(private_data.ROUNDS):
        worth = {}
        for p, members in graph.items():
            for kind in private_data.KINDS:
                seeds = sum(kind in kinds.get(i, ()) for i in members)
                mass = seeds + sum(new[i][0] for i in members if i in new and new[i][1] == kind)
                if seeds >= private_data.SUPPORT and mass / (len(members) + 1) >= private_data.WORTH:
                    worth[p, kind] = mass / (len(members) + 1)
        fresh = {}
        for i in context:
            for kind in private_data.KINDS:
                miss = 1.0
                for p, members in graph.items():
                    if i in members and (p, kind) in worth:
                        miss *= 1 - worth[p, kind]
                if i not in seen and 1 - miss >= private_data.BELIEF:
                    fresh[i] = max(fresh.get(i, (0.0, "")), (1 - miss, kind))
        if len(fresh) == len(new):
            new = fresh
            break
        new = fresh
    in_context = {i for i in seen if i in context}
    known = {i: min(kinds[i]) for i in in_context} | {i: k for i, (_, k) in new.items()}
    out = []
    for text, base, some in zip(texts, bases, spots, strict=True):
        spans = base + [(known[i], s, e) for i, s, e in some if i in known]
        spans.sort(key=lambda x: (x[1], private_data.KINDS.index(x[0]), x[2]))
        out.append(private_data._points(text.encode(), spans))
    return out


def corpus() -> list[str]:
    rng = random.Random(7)
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    out = []
    for i in range(40):
        noise = awkward.words(6, i)
        out.append(f"{noise}\nplease call me at +1 {number(3)} {number(3)}-{number(4)} tomorrow {noise}")
        out.append(f"é {noise} contact: {awkward.words(1, i)}@mail{i % 9}.example.com {noise}")
        out.append(f"{noise} order number {number(8)} was shipped {noise}")
    for i in range(6):
        out.append(f"{awkward.words(4, 900 + i)} call me at ({number(3)}) {number(3)}-{number(4)} tomorrow")  # no + before it
        out.append(f"ß contact: root{i}@localhost now")  # no dot behind the @
    known = "+1 017 555-7713"
    out += [f"call me at {known} tomorrow", "the number is 1-017-555-7713 here", "released in 20240101 and 12345678"]
    return out


def test_patterns_discover_what_has_no_fixed_form(spark):
    texts = corpus()
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    out, good, new = private_data.bootstrap(awkward.documents(spark, rows + rows[:50]))
    got = {r["doc_id"]: r["spans"] for r in out.collect()}
    want = naive_bootstrap(texts)
    assert got == {i: ",".join(f"{k}:{s}:{e}" for k, s, e in w) for i, w in enumerate(want)}
    found = [texts[i][s:e] for i, w in enumerate(want) for k, s, e in w if (k, s, e) not in plain(texts[i])]
    assert sum("(" in x for x in found) == 6 and sum(x.endswith("@localhost") for x in found) == 6 and "1-017-555-7713" in found
    assert len(found) == 13  # order numbers, dates and the like stay out
    assert {"me at _", "contact: _"} <= {r["pattern"] for r in good.collect()} and new.count() == 12


def test_awkward_rows(spark):
    rows = awkward.document_rows() + [(400 + i, t, None, None, None) for i, t in enumerate(corpus())]
    got = Counter(tuple(r) for r in private_data.identify(awkward.documents(spark, rows)).collect())
    want = Counter()
    for r, spans in zip(rows, naive_bootstrap([r[1] or "" for r in rows]), strict=True):
        base = plain(r[1])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        counts = [sum(x[0] == k for x in base) for k in PLAIN]
        want[(r[0], *counts, hashlib.sha256(joined.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in spans))] += 1
    assert got == want


@pytest.mark.parametrize("texts", [[], [None, ""], ["no one here"]])
def test_nothing_to_find(spark, texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = private_data.identify(awkward.documents(spark, rows) if rows else awkward.empty(spark)).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")] * len(texts)
