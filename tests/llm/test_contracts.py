"""The contract columns of the queries against plain Python over whole tables, and plain versions of what is learned."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_llm import SF, by_id, docs, odd, plain_cosine_hash, plain_fingerprint, plain_likeness, plain_repeats, plain_simhash, plain_terms, roots, tiktoken_encoding

from lumibase.llm import media, quality, toxicity
from lumibase.llm import queries as Q

sha = lambda raw: hashlib.sha256(raw).hexdigest()
crc = zlib.crc32


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r.doc_id, r.text or "") for r in docs(spark).select("doc_id", "text").collect())


def test_bpe(spark, texts):
    e, rows = tiktoken_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken")), by_id(Q.op2_bpe(spark, SF).collect())
    assert len(rows) == len(texts)
    for i, t in texts:
        ids = e.encode_ordinary(t)
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t.encode()))


def test_simhash(spark, texts):
    rows = by_id(Q.op4_simhash(spark, SF).collect())
    prints = {i: plain_simhash(t) for i, t in texts}
    root = roots(sorted(set(prints.values())), 4)
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{p:016x}", least[root[p]]) for i, p in prints.items()}


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coder.encode_special_tokens = True
    pieces, sequences = {}, {}
    for r in Q.op6_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in texts:
        ids, at = [*coder.encode(t, add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            own = ids[at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(struct.pack(f"<{len(own)}I", *own)))
            at += r.length
        assert at == len(ids)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_suffix_array(spark, texts):
    kept = plain_repeats(texts)
    for r in Q.op7_suffix_array(spark, SF).collect():
        raw = dict(texts)[r.doc_id].encode()
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(raw), len(raw) - len(kept[r.doc_id]), sha(kept[r.doc_id]))
    seen, spans = set(), {}
    for i, t in texts:
        raw, covered = t.encode(), bytearray(len(t.encode()))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                covered[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        spans[i] = len([x for x in bytes(covered).split(b"\0") if x])
    assert {r.doc_id: r.n_spans for r in Q.op7_suffix_array(spark, SF).collect()} == spans


def test_imatch(spark, texts):
    rows, different = by_id(Q.op9_imatch(spark, SF).collect()), {t for _, t in texts}
    counts = Counter(term for t in different for term in plain_terms(t))
    band = {t for t, n in counts.items() if max(2, 0.01 * len(different)) <= n <= max(2, 0.2 * len(different))}
    as_text = lambda x: " ".join(f"{number:03x}{h}" for number, h in sorted(x.items()))
    for n, (i, t) in enumerate(texts):
        after = texts[(n + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, changed, other = (plain_fingerprint(x, band) for x in (t, edited, after))
        r = rows[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(edited.encode()), as_text(own), as_text(changed))
        assert abs(r.near_edited - plain_likeness(own, changed)) < 1e-12 and abs(r.near_next - plain_likeness(own, other)) < 1e-12


def test_media(spark, texts):
    stored = by_id(media.text_to_media(docs(spark)).collect())
    for r in Q.op10_media(spark, SF).collect():
        raw = dict(texts)[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        made = bytes(stored[r.doc_id].media)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), crc(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(made), sha(made))
        width, height = struct.unpack(">II", made[16:24])
        assert width * height == len(payload) and r.feature == plain_cosine_hash(np.frombuffer(payload, np.uint8).reshape(height, width))


@pytest.mark.parametrize("query, modulus, fold", [(Q.op1_quality, 5, 0), (Q.op5_toxicity, 4, 2)])
def test_classifiers(spark, texts, query, modulus, fold):
    rows = query(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (crc(str(r.doc_id).encode()) % modulus == fold) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_lasso_is_the_minimum():
    """At the minimum the slope of the loss is at most the penalty where a weight is zero, and equal to it elsewhere."""
    rng = np.random.default_rng(4)
    z = (rng.random((400, 30)) > 0.6).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 2 * z[:, 1] + z[:, 2] - 0.5)))).astype(float)
    for penalty in (0.002, 0.02):
        w, b = quality._lasso(z, y, penalty, steps=6000)
        error = 1 / (1 + np.exp(-(z @ w + b))) - y
        slope = z.T @ error / len(y)
        assert abs(error.mean()) < 1e-4 and np.all(np.abs(slope) <= penalty + 1e-4)
        assert np.allclose(slope[w != 0], -np.sign(w[w != 0]) * penalty, atol=1e-4) and 3 <= np.count_nonzero(w) < 30


def plain_tree(x, y, cuts, depth, path=()):
    """Each split is the one after which the squares about the means are least."""
    spread = lambda v: float(((v - v.mean()) ** 2).sum())
    options = [(spread(y[x[:, k] > t]) + spread(y[x[:, k] <= t]), k, float(t)) for k, ts in enumerate(cuts) for t in ts if min((x[:, k] > t).sum(), (x[:, k] <= t).sum()) >= 5] if depth else []
    if not options or spread(y) - min(options)[0] < 1e-6:
        return [(path, True)]
    least = min(o[0] for o in options)
    _, k, t = next(o for o in options if o[0] <= least + 1e-9)
    sides = [plain_tree(x[(x[:, k] > t) == above], y[(x[:, k] > t) == above], cuts, depth - 1, (*path, (k, above, t))) for above in (True, False)]
    return [*([(path, False)] if path else []), *sides[0], *sides[1]]


def test_trees_equal_the_least_squares():
    rng = np.random.default_rng(6)
    x = rng.random((160, 4))
    y = (x[:, 1] > 0.4) * 1.0 - (x[:, 2] > 0.7) * (x[:, 0] > 0.3) + 0.2 * rng.random(160)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 25))) for k in range(4)]
    assert list(quality._grow(x, cuts, y, 3)) == plain_tree(x, y, cuts, 3)


def test_rules_are_paths_of_boosted_trees():
    """Plain boosting: each leaf adds half a Newton step, and all paths of all trees are rules, weighed by the lasso."""
    rng = np.random.default_rng(7)
    x = rng.random((200, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.6)).astype(float)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 25))) for k in range(3)]
    holds = lambda path: np.array([all((row[k] > t) == above for k, above, t in path) for row in x])
    score, paths = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), []
    for _ in range(12):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        for path, leaf in plain_tree(x, y - p, cuts, 3):
            if path and path not in paths:
                paths.append(path)
            if path and leaf:
                rows = holds(path)
                step[rows] = 0.5 * (y - p)[rows].sum() / np.maximum(p * (1 - p), 1e-3)[rows].sum()
        score += step
    weights, intercept = quality._lasso(np.stack([holds(p) for p in paths], axis=1).astype(float), y, 0.0005)
    rules, b = quality.fit_rules(x, y)
    assert [r.conditions for r in rules] == [p for p, w in zip(paths, weights, strict=True) if w]
    assert np.allclose([r.weight for r in rules], [w for w in weights if w]) and abs(b - intercept) < 1e-9


def test_lexicon_equals_plain_counts(spark):
    rng = random.Random(5)
    other = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 9)))
    rows = [(1, f"{other()} you {rng.choice(['blarghs', 'zonkers', 'blarghing'])} {other()} {other()}") for _ in range(60)]
    rows += [(0, f"{other()} {rng.choice(['calm', 'quiet', 'blanket'])} {other()} you {other()}") for _ in range(150)] + rows[:5]
    words, stems = toxicity.learn_lexicon(spark.createDataFrame(rows, "_label int, text string"), "text")
    import xxhash

    # one text of each group that shares the least hash of three words
    least, grams = {}, {}
    signed = lambda s: (h := xxhash.xxh64_intdigest(s.encode(), 42)) - (1 << 64) * (h >> 63)
    for label, text in rows:
        own = text.split()
        key = label, min(signed(" ".join(own[n : n + 3])) for n in range(max(1, len(own) - 2)))
        least[key] = max(least.get(key, []), own)
    total = Counter(k[0] for k in least)
    for (label, _), own in least.items():
        for g in {("w", w) for w in own} | {("s", w[:n]) for w in own for n in toxicity.STEMS if len(w) > n}:
            grams.setdefault(g, [0, 0])[1 - label] += 1
    p, n = total[1], total[0]

    def measured(a, b):
        expected = (a + b) * p / (p + n)
        return 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0)) if a else 0.0, math.log((a + 0.5) / (p + 1)) - math.log((b + 0.5) / (n + 1))

    found = {("w", k): v for k, v in words.items()} | {("s", k): v for k, v in stems.items()}
    significant = {g: measured(*ab) for g, ab in grams.items() if ab[0] >= 3 and measured(*ab)[0] >= 18 and measured(*ab)[1] > math.log(8)}
    assert found and set(found) <= set(significant)
    assert all(abs(found[g] - significant[g][1]) < 1e-9 for g in found)
    assert {g for g, (strength, _) in significant.items() if strength >= 50} <= set(found)


def test_odd_rows_through_the_secret_and_divergence_columns(spark):
    from lumibase.llm import divergence, secretscan

    found = secretscan.scan(odd(spark), secretscan.train(odd(spark)))
    assert found.count() == odd(spark).count() and all(r.ids == "clash" for r in found.collect())
    assert divergence.divergences(odd(spark).withColumnRenamed("ids", "lang").withColumnRenamed("fp", "source")).where("part = 'term'").count() == 0
