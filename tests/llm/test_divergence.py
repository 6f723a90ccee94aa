"""The divergence audit against plain Python integers."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lumibase.llm import divergence as D

SCHEMA = "doc_id bigint, lang string, source string, text string"


def plain(rows, least_docs=10, top=10):
    groups, counts, with_term = {}, {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")
        found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in found]
        groups.setdefault(lang, set()).add(source)
        counts.setdefault((lang, source), Counter()).update(found)
        with_term.setdefault(lang, Counter()).update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in with_term[lang].items() if n >= least_docs]

        def p(count, kept=kept):
            whole = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (whole + 2 * len(kept)) for t in kept}

        own = {s: p(counts[lang, s]) for s in sources}
        q = p(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources - {s}]
            better = [(f(own[s][t], q[t]), t) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", better)):
                for n, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or n <= top:
                        out.add((lang, s, part, item, value, n))
    return out


def rows_of(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "THE", "été", "Été", "İx", "x1y", "straße", "日本", "a", "b", "c", "-", "1 2", "\x7f", "d_e", "🙂"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "Ä", "z", None]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(n)]
    return rows + [("fr", "few", "un deux"), ("fr", "none", None), ("it", "alone", "x " * 20), ("en", "blank", "")] + [("en", "s1", "same text")] * 30


@pytest.mark.parametrize("chunk, broadcast", [(1 << 16, 200_000), (3, 0)])
def test_equals_plain(spark, monkeypatch, chunk, broadcast):
    monkeypatch.setattr(D, "BROADCAST_GROUPS", broadcast)
    rows = rows_of(chunk, 400)
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], SCHEMA).repartition(5)
    got = D.divergences(df).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain(rows)


def test_chunks_do_not_change_sums():
    """Runs of whole columns and of their parts give the same sums as term by term."""
    rng = random.Random(4)
    a, b = (np.array(sorted(rng.choices([0, 0, 0, 1, 5, 10**10], k=500), key=lambda x: rng.random() < 0.2)) for _ in range(2))
    p, q = D.shares(a, 10**12, 500), D.shares(b, 10**13, 500)
    assert p.tolist() == [1 + 10**9 * (int(x) + 2) // (10**12 + 1000) for x in a]

    def runs(x):
        ends = np.append(np.flatnonzero(x[1:] != x[:-1]) + 1, len(x))
        return ends, x[ends - 1]

    want = sum((int(x) - int(y)) ** 2 // (int(x) + int(y)) for x, y in zip(p, q, strict=True))
    assert D.run_sum(runs(p), runs(q)) == want == sum(D.run_sum(runs(p[n : n + 7]), runs(q[n : n + 7])) for n in range(0, 500, 7))


def test_odd_tables(spark):
    assert D.divergences(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("en", "a", "word " * 300_000)] * 10 + [(None, None, None)] * 12
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, source string, text string, term string, n int")
    assert {tuple(r) for r in D.divergences(df).collect()} == plain(rows) == set()
    hot = [("en", "hot", "alpha beta")] * 200 + [("en", f"s{n % 3}", f"alpha gamma{n % 4}") for n in range(100)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(hot)], SCHEMA)
    assert {tuple(r) for r in D.divergences(df).collect()} == plain(hot)
