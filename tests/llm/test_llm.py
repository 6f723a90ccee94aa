"""Operators for training text against brute force, round trips and held-out labels, with odd rows in every table."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumibase.llm import bpe, imatch, media, packing, quality, repeats, simhash, suffixes, toxicity, urlfilter, warc
from lumibase.llm import queries as Q
from lumibase.llm.components import components
from lumibase.llm.shared import materialize, shared_path
from oracle import compare

SF = "/root/testdata/sf0.001"
#: Null, empty, blank, repeated, long and clashing rows.
TEXTS = [None, "", " ", "\n\n", "a", "one two three", "one two three", "Ünï  code\t\n x", "word " * 3000, "x" * 5000, "don't we'll I'm", "１２ 34½", "a\x00b", "end "]


def odd(spark, repeated=True):
    rows = [(n, t, "clash", n) for n, t in enumerate(TEXTS)] + ([(None, "no id", "clash", 0), (5, TEXTS[5], "clash", 1)] if repeated else [])
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, fp bigint")


def none(spark):
    return odd(spark).limit(0)


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def by_id(rows):
    return {r.doc_id: r for r in rows}


# byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tiktoken_encoding(path):
    import tiktoken

    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_bpe_equals_the_library(ranks):
    e, own, rng = tiktoken_encoding(ranks[0]), bpe.Ranks(*ranks), random.Random(1)
    texts = ["".join(rng.choice("ab  \n\t'sl.,1é\u0301\u3000\x1c\x85\xa0ℒ🙂A<|endoftext|>") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [t or "" for t in TEXTS] + ["ab" * 3000]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == struct.pack(f"<{len(ids) // 4}I", *e.encode_ordinary(text)), text
        assert own.decode(ids) == text.encode()


def test_bpe_lower_rank_after_a_merge():
    """Ranks in which a merge brings up a pair of a lower rank."""
    own = object.__new__(bpe.Ranks)
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"abcab"]
    own.rank = {t: n for n, t in enumerate(tokens)}
    own.pairs = {own.rank[t[:n]] << 32 | own.rank[t[n:]]: r for t, r in own.rank.items() for n in range(1, len(t)) if t[:n] in own.rank and t[n:] in own.rank}
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=own.rank, special_tokens={})
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 12))) for _ in range(400)]
    for word, ids in zip(words, own.replay([w.encode() for w in words]), strict=True):
        if word.encode() not in own.rank:
            assert ids == e.encode_ordinary(word)


def test_bpe_odd_rows(spark, ranks):
    coded = bpe.decode(bpe.encode(odd(spark), *ranks, ids_col="coded"), *ranks, ids_col="coded")
    rows = coded.collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.ids == "clash" for r in rows)
    assert all(bytes(r.decoded).decode() == (TEXTS[r.doc_id] or "") for r in rows if r.doc_id is not None)
    assert bpe.encode(none(spark), *ranks).count() == 0
    clash = bpe.encode(odd(spark), *ranks)  # has a column ids itself
    assert clash.columns == ["doc_id", "fp", "ids"] and by_id(clash.collect())[4].ids == by_id(rows)[4].coded
    with pytest.raises(KeyError):
        bpe.Ranks(*ranks).decode(struct.pack("<I", 60000))


def test_bpe_long_text(ranks):
    e, own, rng = tiktoken_encoding(ranks[0]), bpe.Ranks(*ranks), random.Random(8)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(400_000)) + "x" * 3000
    ids = own.encode([text])[0]
    assert len(text) > 2_500_000 and ids == np.array(e.encode_ordinary(text), "<u4").tobytes() and own.decode(ids) == text.encode()


# packing


def check_packing(rows, want, capacity=2048):
    per_doc, per_sequence = {}, {}
    for r in rows:
        per_doc.setdefault(r.doc_id, []).append(r)
        per_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, ids in want.items():
        at = 0
        for r in sorted(per_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, bytes(r.ids)) == (at, len(ids), struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for pieces in per_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or at & (at - 1) == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    table = docs(spark)
    want = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 1] for r in table.collect()}
    check_packing(packing.harmonic_pack(table.repartition(3), path).collect(), want)
    rows = packing.harmonic_pack(odd(spark, repeated=False), path).collect()
    check_packing(rows, {n: [*t.encode(x or "", add_special_tokens=False).ids, 1] for n, x in enumerate(TEXTS)})
    assert sum(r.length for r in packing.harmonic_pack(odd(spark), path).collect()) == sum(r.length for r in rows) + len(t.encode("no id", add_special_tokens=False).ids) + len(t.encode(TEXTS[5], add_special_tokens=False).ids) + 2
    assert packing.harmonic_pack(none(spark), path).count() == 0


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, own, rng = Tokenizer.from_file(path), packing.WordIds(path), random.Random(3)
    texts = ["".join(rng.choice("ab  \n\t'sl.,1é\u0301\u3000\x1c\xa0🙂AΣİǅß!#") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["x<|endoftext|>y z"]
    for text, ids in zip(texts, own.of(texts), strict=True):
        assert ids == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


# SimHash


def plain_simhash(text):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    shingles = [" ".join(words[n : n + 4]) for n in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps, threshold):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(fps):
        for b in fps[:n]:
            if (a ^ b).bit_count() <= threshold:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {f: find(f) for f in fps}


def test_simhash_equals_brute_force(spark):
    table = docs(spark)
    texts = {r.doc_id: r.text for r in table.collect()}
    got = by_id(simhash.near_duplicates(table).collect())
    prints = {i: plain_simhash(t) for i, t in texts.items()}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == prints
    root = roots(sorted(set(prints.values())), 4)
    least = {}
    for i, f in prints.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert {i: r.component_id for i, r in got.items()} == {i: least[root[f]] for i, f in prints.items()}


def test_layouts_cover_and_grow():
    rng = np.random.default_rng(4)
    for threshold in range(6):
        for parts in (2, 3):
            laid = simhash.layout(threshold, parts)
            assert sum(p.reach + 1 for p in laid) == threshold + 1
            for p in laid:
                words = p.of(rng.integers(0, 1 << 64, 20, np.uint64))
                assert (np.bitwise_count(words ^ p.homes(words)) <= 1).all() and (p.homes(p.homes(words)) == p.homes(words)).all()
                assert len(np.unique(p.homes(np.arange(1 << 12, dtype=np.uint64)))) == 1 << (12 - p.checks) or p.coded > 12
    rows = lambda laid: sum(1 + len(p.visited(p.of(simhash._RANDOM_WORDS))[0]) / 256 for p in laid)
    assert 30 < rows(simhash.layout(4, 3)) < 36 and 180 < rows(simhash.layout(4, 2)) < 210
    assert simhash.cheapest_layout(4, 10**6) == simhash.layout(4, 3) and simhash.cheapest_layout(4, 10**10) == simhash.layout(4, 2)


@pytest.mark.parametrize("cell, parts", [(4096, None), (4096, 2), (40, 3), (40, 2)])
@pytest.mark.parametrize("threshold", [0, 2, 4, 5])
def test_anchors_lose_no_link(spark, cell, parts, threshold):
    rng = random.Random(threshold)
    fps = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << bit
    fps = sorted(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    found = {r.u: r.v for r in components(simhash.links(df, threshold, cell=cell, parts=parts)).collect()}
    groups = lambda of: sorted(sorted(g) for g in {k: [f for f in fps if of(f) == k] for k in map(of, fps)}.values())
    want = roots(fps, threshold)
    assert groups(lambda f: found.get(signed(f), signed(f))) == groups(want.__getitem__)


def test_a_large_group_hangs_in_trees(spark):
    """Some 2000 fingerprints within two bits of one: a single component, and no fingerprint in very many links."""
    fps = {0, *(1 << n for n in range(63)), *(1 << n | 1 << m for n in range(63) for m in range(n))}
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for cell in (4096, 300):
        found = materialize(simhash.links(df, 4, cell=cell), "links")
        members = components(found).collect()
        assert len(members) == len(fps) - 1 and {r.v for r in members} == {0}


def test_simhash_odd_rows(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(TEXTS) + 2
    empty = [r for r in rows if r.doc_id in (0, 1, 2, 3)]
    assert {r.fp for r in empty} == {0} and {r.component_id for r in empty} == {0}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(n, n + 1) for n in range(200)] + [(1000, n) for n in range(1001, 1400)] + [(7, 7), (None, 3)]
    found = {r.u: r.v for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {n: 0 for n in range(1, 201)} | {n: 1000 for n in range(1001, 1400)}


# suffix-array deduplication


def plain_repeats(rows, least=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        covered = np.zeros(len(raw), bool)
        for k in range(len(raw) - least + 1):
            if raw[k : k + least] in seen:
                covered[k : k + least] = True
            seen.add(raw[k : k + least])
        out[i] = bytes(np.frombuffer(raw, np.uint8)[~covered])
    return out


def plain_factors(symbols, most):
    """The longest previous factors by comparing every position with every earlier one."""
    out = []
    for i in range(len(symbols)):
        best = 0
        for j in range(i):
            k = 0
            while k < most and i + k < len(symbols) and symbols[j + k] == symbols[i + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_longest_previous_factors_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        kinds = rng.choice([1, 2, 5])
        symbols = np.array([rng.randint(0, kinds) for _ in range(rng.randint(0, 60))], np.int16)
        for most in (1, 7, 20, 100):
            assert suffixes.longest_previous_factors(symbols, most).tolist() == plain_factors(symbols.tolist(), most)
        order, _ = suffixes.suffix_order(symbols, 100)
        assert order.tolist() == sorted(range(len(symbols)), key=lambda n: symbols[n:].tolist())
        before, after = suffixes.nearest_smaller(order)
        for n, place in enumerate(order.tolist()):
            assert before[n] == max((k for k in range(n) if order[k] < place), default=-1)
            assert after[n] == min((k for k in range(n + 1, len(order)) if order[k] < place), default=-1)


def long_letters(rng, letters, most):
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))


@pytest.mark.parametrize("crowd", [1, None])
@pytest.mark.parametrize("least", [32, 100, 287, 700])
def test_repeats_equal_brute_force(spark, crowd, least):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdé fghij") for _ in range(3 * least))
    rows = [(n, t) for n, t in enumerate(TEXTS)]
    for n in range(100, 250):
        a, z = long_letters(rng, "klmnop qrst", 2 * least), long_letters(rng, "uvwxyz ß", 2 * least)
        rows.append((n, a + (passage if n % 3 else passage[: 3 * least // 2]) + z))
    rows += [(300, passage[: least - 1]), (301, passage[:least])]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), crowd=crowd, least=least)
    assert {r.doc_id: bytes(r.kept) for r in found.collect()} == plain_repeats(rows, least)


@pytest.mark.parametrize("crowd", [1, None])
def test_repeats_of_documents(spark, crowd):
    table = docs(spark).where("n_chars < 20000")
    found = repeats.remove_repeats(table.select("doc_id", "text"), crowd=crowd, least=100)
    assert {r.doc_id: bytes(r.kept) for r in found.collect()} == plain_repeats([(r.doc_id, r.text) for r in table.collect()])


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc ") for _ in range(n)) for n in (4200, 150, 99, 0)]
    texts.append(texts[0][1500:3700] + texts[1])
    first, count, anchors = {}, 0, {}
    for text, start, n, anchor, _ in zip(*suffixes.batch_runs([t.encode() for t in texts], 100), strict=True):
        for k in range(start, start + n):
            assert (text, k) not in first
            first[text, k] = anchor
            window = texts[text][k : k + 100]
            assert anchors.setdefault(window, anchor) == anchor
            count += 1
    assert count == sum(max(0, len(t) - 99) for t in texts)


def test_repeats_over_many_tasks(spark, monkeypatch):
    """As over a large corpus: more buckets and tasks than shuffle partitions."""
    monkeypatch.setattr(repeats, "TASK_BYTES", 4000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(repeats, "MOST_TASKS", 9)
    rng = random.Random(12)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(12)]
    rows = [(n, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for n in range(120)]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert {r.doc_id: bytes(r.kept) for r in found} == plain_repeats(rows)


def test_repeats_odd_rows(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(250))
    rows = [(None, base), (1, base), (1, base), (1, base[:120] + "zzz"), (2, "é" * 40 + base[10:200])]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), whole_characters=True).collect()
    kept = sorted((r.doc_id is not None, r.doc_id or 0, len(r.kept)) for r in found)
    assert kept[0][2] == 250 and len(found) == 5
    assert sorted(k for _, i, k in kept if i == 1) == [0, 0, 3]
    assert repeats.remove_repeats(none(spark)).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(none(spark), least=10)


@pytest.mark.parametrize("crowd", [1, None])
def test_repeated_rows_keep_the_first_occurrence(spark, crowd):
    rng = random.Random(9)
    a, b, c, d = ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(4))
    # document 3 shares 150 bytes with the repeated row, and document 4 no more than 40
    rows = [(1, a + b), (1, a + b), (3, c + b[:150]), (4, d + a[100:140] + d[::-1])]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), crowd=crowd).collect()
    want = plain_repeats(list(dict(rows).items()))
    assert sorted((r.doc_id, bytes(r.kept)) for r in found) == sorted((n, want[n]) for n, _ in rows)
    assert want[1] == (a + b).encode() and want[3] == c.encode() and len(want[4]) == 440


# media


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(1)
    for height in (1, 2, 17):
        samples = rng.integers(0, 256, (height, 64), dtype=np.uint8)
        assert (media.read_png(media.write_png(samples.tobytes())) == samples).all()
        lines, left = np.zeros((height, 65), np.uint8), np.roll(samples, 1, axis=1)
        left[:, 0] = 0
        above = np.vstack((np.zeros((1, 64), np.uint8), samples[:-1]))
        corner = np.roll(above, 1, axis=1)
        corner[:, 0] = 0
        a, b, c = (x.astype(int) for x in (left, above, corner))
        p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        paeth = np.where((p <= q) & (p <= r), a, np.where(q <= r, b, c))
        guesses = [0 * a, a, b, (a + b) // 2, paeth]
        for row in range(height):
            kind = int(rng.integers(0, 5))
            lines[row, 0], lines[row, 1:] = kind, (samples[row].astype(int) - guesses[kind][row]) % 256
        assert (media._unfilter(lines) == samples).all()


def test_png_checks():
    good = media.write_png(bytes(range(64)))
    for bad in (good[1:], good[:40] + bytes([good[40] ^ 1]) + good[41:], good[:-5], b""):
        with pytest.raises((ValueError, zlib.error)):
            media.read_png(bad)


def test_media_odd_rows(spark):
    rows = by_id(Q.media.media_features(media.text_to_media(odd(spark, repeated=False))).collect())
    for n, t in enumerate(TEXTS):
        raw = (t or "").encode()
        assert bytes(rows[n].payload) == raw + bytes(-len(raw) % 64 if raw else 64) and len(rows[n].feature) == 16
    assert (rows[5].media, rows[5].feature) == (rows[6].media, rows[6].feature)
    assert media.media_features(media.text_to_media(none(spark))).count() == 0


def test_cosine_hash_survives_noise():
    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:64, 0:64]
    picture = (128 + 60 * np.sin(x / 9) + 50 * np.cos(y / 13)).astype(np.uint8)
    noisy = np.clip(picture + rng.normal(0, 3, picture.shape), 0, 255).astype(np.uint8)
    far = rng.integers(0, 256, picture.shape, dtype=np.uint8)
    bits = lambda a, b: (int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).bit_count()
    assert bits(picture, noisy) < bits(picture, far)


def plain_cosine_hash(samples):
    """The hash by its definition: means over a grid, every frequency as a sum over all samples of the grid."""
    height, width = samples.shape
    part = lambda n, size: slice(n * size // 32, max((n + 1) * size // 32, n * size // 32 + 1))
    grid = [[float(samples[part(y, height), part(x, width)].mean()) for x in range(32)] for y in range(32)]
    low = []
    for v in range(8):
        for u in range(8):
            total = sum(grid[y][x] * math.cos(math.pi * v * (2 * y + 1) / 64) * math.cos(math.pi * u * (2 * x + 1) / 64) for y in range(32) for x in range(32))
            low.append(round(total * (0.25 if u else 32**-0.5) * (0.25 if v else 32**-0.5), 6))
    middle = sorted(low[1:])[31]
    bits = [n > 0 and x > middle for n, x in enumerate(low)]
    return f"{sum(b << (63 - n) for n, b in enumerate(bits)):016x}"


def test_cosine_hash_equals_plain_transform():
    rng = np.random.default_rng(7)
    for height in (1, 5, 32, 50, 129):
        samples = rng.integers(0, 256, (height, 64), dtype=np.uint8)
        assert media.cosine_hash(samples) == plain_cosine_hash(samples)


def test_png_is_read_by_another_decoder():
    """Chunk by chunk with the standard library alone, and row filters undone byte by byte."""
    raw = bytes(random.Random(2).choices(range(256), k=64 * 9)) + bytes(range(64)) * 8
    data = media.write_png(raw)
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(data[at + 4 : at + 8 + n])
        chunks.append((data[at + 4 : at + 8], data[at + 8 : at + 8 + n]))
        at += 12 + n
    assert [k for k, _ in chunks] == [b"IHDR", b"IDAT", b"IEND"] and chunks[0][1] == struct.pack(">IIBBBBB", 64, 17, 8, 0, 0, 0, 0)
    lines, out, above = zlib.decompress(chunks[1][1]), b"", bytes(64)
    for y in range(17):
        kind, line = lines[65 * y], lines[65 * y + 1 : 65 * y + 65]
        assert kind in (0, 2)
        above = bytes((b + a) % 256 for a, b in zip(above, line, strict=True)) if kind == 2 else line
        out += above
    assert out == raw


def test_media_ties_and_clashes(spark):
    rows = [(1, "same", b"x", "c"), (1, "same", b"y", "c"), (2, "same", None, None), (None, "same", b"z", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, media binary, feature string")
    stored = media.text_to_media(df)
    found = media.media_features(stored).collect()
    assert len(found) == 4 and len({(bytes(r.media), r.feature) for r in found}) == 1
    again = media.media_features(stored.withColumn("payload", F.lit("clash")).withColumn("feature", F.lit("clash")))
    assert again.columns == ["doc_id", "n_bytes", "media", "payload", "feature"] and "clash" not in {x for r in again.collect() for x in r}


# archive


def test_archive_ties_and_clashes(spark):
    rows = [(2, "u", "same", b"p", "x"), (2, "v", "same", b"q", "y"), (1, "w", "same", None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload binary, digest string")
    path = shared_path(spark, "warc-test")
    warc.write_archive(pages, path)
    found = warc.read_archive("bigint", path, spark).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found) == [(1, "revisit", 2), (2, "response", None), (2, "response", None)]
    assert {b"Content-Type: " in bytes(r.header) for r in found if r.record_type == "response"} == {True}


def test_archive(spark):
    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "http://c", "same"), (4, "http://d", None), (5, "http://e", ""), (None, "http://f", "same"), (3, "http://c", "same"), (7, "u", "ünï")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    path = shared_path(spark, "warc-test")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    records = warc.read_archive("bigint", path, spark).collect()
    assert len(records) == len(rows)
    for r in records:
        want = next(h or "" for i, _, h in rows if i == r.page_id).encode()
        assert bytes(r.payload) == want and r.payload_bytes == len(want) and r.payload_digest == base64.b32encode(hashlib.sha1(want).digest()).decode()
        block = want if r.record_type == "response" else b""
        assert bytes(r.record) == bytes(r.header) + block + b"\r\n\r\n"
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in records) == sorted(
        [("1", "revisit", 3), ("2", "revisit", 3), ("3", "response", None), ("3", "response", None), ("4", "revisit", 5), ("5", "response", None), ("None", "revisit", 3), ("7", "response", None)]
    )
    path = shared_path(spark, "warc-test")
    warc.write_archive(pages, path, least_bytes=1)
    assert {r.record_type for r in warc.read_archive("bigint", path, spark).where("page_id IN (4, 5)").collect()} == {"response"}
    path = shared_path(spark, "warc-test")
    warc.write_archive(pages.limit(0), path)
    assert warc.read_archive("bigint", path, spark).count() == 0


def test_archive_finds_damage(spark):
    path = shared_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id bigint, url string, html string"), path)
    stored = materialize(spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")), "damaged")
    stored.write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive("bigint", path, spark).collect()


# URL filter


def plain_verdict(url, rules):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", after).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_url_filter(spark, broadcast_rows):
    rng = random.Random(4)
    hosts, parts = ["a.com", "b.a.com", "com", "x.org", "A.Com", "example.net", ""], ["", "/", "/en/", "/en/7", "/de/8x", "?q#/", "/a/b/c", "/en"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'w.', 'W.q.'])}{rng.choice(hosts)}{rng.choice(parts)}{rng.choice(['', '1', '?x=/y', '#z'])}" for _ in range(400)] + [None, "", "no scheme", "a://b://c/en/", "http://"]
    rules = [*Q.URL_RULES, ("a.com", "/", "block"), ("b.a.com", "/en/", "allow"), ("org", "", "block")]
    pages = spark.createDataFrame([(n, u, "clash") for n, u in enumerate(urls)], "page_id int, url string, verdict string")
    found = urlfilter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), broadcast_rows=broadcast_rows).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found} == {n: plain_verdict(u, rules) for n, u in enumerate(urls)}


def test_url_filter_edges(spark):
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a/"), (1, "http://a/"), (None, None)], "page_id int, url string")
    assert [r.verdict for r in urlfilter.judge(pages, empty).collect()] == ["allow"] * 3
    assert urlfilter.judge(pages.limit(0), empty).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge(pages, spark.createDataFrame([("a", None, "block")], empty.schema))


def test_url_filter_long_host(spark):
    """Time and rows grow with the labels, not with their square."""
    rules = spark.createDataFrame(list(Q.URL_RULES), "host string, path string, verdict string")
    long = "a." * 100_000 + "net"
    pages = spark.createDataFrame([(1, f"http://{long}/de/7"), (2, f"http://{'x' * 300_000}.com/en/"), (3, "http://a.example.net/" + "de/8" * 50_000)], "page_id bigint, url string")
    rows = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    assert rows == {1: ("net/de/", "allow"), 2: ("com/en/", "block"), 3: ("example.net/de/8", "block")}


def test_bloom_filter_passes_few_others(spark):
    keys = spark.range(2000).selectExpr("CAST(id AS STRING) AS key")
    blocks = urlfilter.bloom_blocks(keys, "key", 2000)
    others = spark.range(20000).selectExpr("'x' || id AS key").union(keys.select("key"))
    n = urlfilter._blocks(2000)
    passed = others.withColumn("block", urlfilter._block_of(F.col("key"), n)).join(blocks, "block").where(urlfilter.may_hold(F.col("words"), F.col("key")))
    assert passed.where("key NOT LIKE 'x%'").count() == 2000 and passed.where("key LIKE 'x%'").count() < 200


# I-Match


def signed_xxhash(raw, seed=42):
    import xxhash

    h = xxhash.xxh64_intdigest(raw, seed)
    return h - (1 << 64) if h >> 63 else h


def plain_terms(text):
    import regex

    return {t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t}


def plain_fingerprint(text, band):
    """Subset number -> the start of the hash of its sorted terms."""
    subsets = {}
    for key, n in enumerate(imatch.SUBSETS):
        for t in plain_terms(text) & band:
            number = signed_xxhash(struct.pack("<i", key + 1), signed_xxhash(t.encode()) % (1 << 64)) % n + sum(imatch.SUBSETS[:key])
            subsets.setdefault(number, []).append(t.encode())
    return {n: f"{signed_xxhash(b' '.join(sorted(ts))) % (1 << 64):016x}"[: imatch.DIGITS] for n, ts in subsets.items()}


def plain_likeness(a, b):
    return 1.0 if a == b else sum(a.get(n) == h for n, h in b.items()) / len({*a, *b})


@pytest.mark.parametrize("most_held", [imatch.MOST_HELD, 0])
def test_imatch_equals_brute_force(spark, most_held):
    table = docs(spark)
    texts = sorted((r.doc_id, r.text) for r in table.collect())
    different = {t for _, t in texts}
    counts = {}
    for t in different:
        for term in plain_terms(t):
            counts[term] = counts.get(term, 0) + 1
    band = {t for t, n in counts.items() if max(2, 0.01 * len(different)) <= n <= max(2, 0.2 * len(different))}
    found = imatch.fingerprints_of_edits(table, most_held=most_held)
    near = lambda other: imatch.likeness(F.col("fingerprint"), F.col(other))
    rows = by_id(found.select("*", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next")).collect())
    prints = {i: plain_fingerprint(t, band) for i, t in texts}
    for n, (i, t) in enumerate(texts):
        after, half = texts[(n + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + after[1][:half]
        assert (rows[i].n_chars, rows[i].edited) == (len(t), edited)
        text = lambda x: " ".join(f"{number:03x}{h}" for number, h in sorted(x.items()))
        assert rows[i].fingerprint == text(prints[i]) and rows[i].edited_fingerprint == text(plain_fingerprint(edited, band))
        assert abs(rows[i].near_edited - plain_likeness(prints[i], plain_fingerprint(edited, band))) < 1e-12
        assert abs(rows[i].near_next - plain_likeness(prints[i], prints[after[0]])) < 1e-12
    assert np.mean([r.near_edited for r in rows.values()]) > max(0.25, 8 * np.mean([r.near_next for r in rows.values()]))


def test_imatch_counts_copies_of_a_text_once(spark):
    rng = random.Random(3)
    words = [f"word{n}" for n in range(400)]
    texts = [" ".join(rng.sample(words, 20)) for _ in range(120)]
    hot, other = texts[:2]
    rows = [*enumerate(texts), *((1000 + n, hot) for n in range(90)), *((2000 + n, other) for n in range(60)), (3000, ""), (3001, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = imatch.fingerprints_of_edits(df).withColumn("near_next", imatch.likeness(F.col("fingerprint"), F.col("next_fingerprint")))
    found = by_id(found.withColumn("near_edited", imatch.likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).collect())
    empty = found[3000].fingerprint
    assert empty == "" and found[3001].fingerprint == empty
    assert len({found[0].fingerprint, found[1].fingerprint, empty}) == 3 and found[1000].fingerprint == found[0].fingerprint
    # unrelated neighbours: the last of the one group, and the last of the other before the empty text
    assert found[1000].near_next == 1.0 and found[1089].near_next < 0.5 and found[2059].near_next == 0.0
    assert found[1089].near_edited > 0
    assert sorted(r.text for r in imatch.different_texts(df.fillna(""), "text").collect()) == sorted({"", *texts})


def test_imatch_over_many_blocks(spark):
    rows = [(n * n, f"t{n} word{n % 7}") for n in range(60)] + [(100, "a"), (100, "b")] + [(None, f"null{n}") for n in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"key": F.coalesce("doc_id", F.lit(-(1 << 63))), "hash": F.xxhash64("text")})
    order = [t for _, _, t in sorted((i if i is not None else -(1 << 63), signed_xxhash(t.encode()), t) for i, t in rows)]
    for size in (2, 7, 1000):
        found = imatch.with_next(df, ["key", "hash"], ["text"], rows_a_block=size).collect()
        assert sorted((r.text, r.next_text) for r in found) == sorted(zip(order, order[1:] + order[:1], strict=True))


def test_imatch_odd_rows(spark):
    rows = imatch.fingerprints_of_edits(odd(spark)).collect()
    assert len(rows) == len(TEXTS) + 2
    assert len({r.fingerprint for r in rows if r.doc_id in (0, 1, 2, 3)}) == 1
    assert imatch.fingerprints_of_edits(none(spark)).count() == 0


# classifiers


@pytest.mark.parametrize("query, label, least", [(Q.op1_quality, "quality", 0.97), (Q.op5_toxicity, "toxic", 0.97)])
def test_held_out_accuracy(spark, query, label, least):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in query(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % (5 if label == "quality" else 4) == (0 if label == "quality" else 2)) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) >= least
    rare = 0 if label == "quality" else 1
    assert np.mean([r.predicted == rare for r in rows if labels[r.doc_id] == rare]) >= 0.9
    assert np.mean([labels[r.doc_id] == rare for r in rows if r.predicted == rare]) >= 0.9


def plain_statistics(text):
    """The statistics by their names, character by character."""
    words = text.split()
    if not words:
        return [0.0] * len(quality.STATISTICS)
    raw = text.encode()
    marks = ".,;:!?'\"()-"
    share = lambda test: sum(b < 128 and test(chr(b)) for b in raw) / len(raw)
    lines = [x for x in text.split("\n") if x]
    return [
        len(set(words)) / len(words), max(words.count(w) for w in set(words)) / len(words), sum(words[n] == words[n - 1] for n in range(1, len(words))) / len(words),
        len(set(lines)) / len(lines), share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), share(lambda c: c in marks),
        share(lambda c: 32 < ord(c) < 127 and not c.isalnum() and c not in marks), sum(map(len, words)) / len(words), share(lambda c: c in " \t\n\r"),
        len(lines) / len(words), sum(not w[-1].isalnum() for w in words) / len(words),
    ]


def test_statistics_equal_plain_counts(spark):
    texts = [t or "" for t in TEXTS] + [r.text for r in docs(spark).where("n_chars < 4000").limit(40).collect()]
    for text in texts:
        assert np.allclose(quality.statistics(text), plain_statistics(text)), text


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    rules, intercept = quality.fit_rules(x, y)
    assert rules and len(rules) < 80
    total = intercept + sum(r.weight * r.holds(x) for r in rules)
    df = spark.createDataFrame([(n, *map(float, row)) for n, row in enumerate(x)], ["n", *("_stat_" + s for s in quality.STATISTICS)])
    got = [r.s for r in df.select("n", quality.compiled(rules, intercept).alias("s")).orderBy("n").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-total)))
    assert ((np.array(got) > 0.5) == (y > 0)).mean() > 0.97


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_classifiers_odd_rows(spark, classify):
    label = "quality" if classify is quality.classify else "toxic"
    schema = f"doc_id bigint, {label} int"
    for rows in ([], [(5, 1), (None, 1), (7, None), (999, 0)], [(n, n % 2) for n in range(12)]):
        scored = classify(odd(spark), spark.createDataFrame(rows, schema)).collect()
        assert len(scored) == len(TEXTS) + 2 and all(0 <= r.score <= 1 and r.ids == "clash" for r in scored)
        assert len({r.score for r in scored if r.doc_id in (5, 6)}) == 1
    assert classify(none(spark), spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_classifiers_keep_columns_of_any_name(spark, classify):
    label = "quality" if classify is quality.classify else "toxic"
    names = ["_stat_note", "_stat_upper", "_clause_note", "_clause_text", "row", "_label", "_text", "_id", "hash", "a b"]
    df = docs(spark).limit(30).select("doc_id", "text", *(F.concat(F.lit(n), "doc_id").alias(n) for n in names))
    labels = spark.createDataFrame([(n, n % 2) for n in range(200)], f"doc_id bigint, {label} int")
    rows = classify(df, labels).collect()
    assert len(rows) == 30 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_labelled_sample_is_bounded_in_rows(spark):
    """One labelled id that very many rows have is one row of the sample."""
    df = spark.range(50_000).select((F.col("id") % 3 * 0 + 7).alias("doc_id"), F.col("id").cast("string").alias("text")).union(spark.range(20).selectExpr("id + 100", "'x'"))
    labels = spark.createDataFrame([(7, 1), (7, 0), *((n, 0) for n in range(100, 120))], "doc_id bigint, quality int")
    for most in (10, 1000):
        rows = quality.labelled_sample(df, labels, "quality", id_col="doc_id", text_col="text", modulus=5, held_out=9, most=most).collect()
        assert len(rows) == min(most, 21) and sum(r["_label"] for r in rows) <= 1


def plain_clause(kinds, weights):
    """A clause's score, harm by harm, from the description of the five transducers."""
    t = toxicity
    met = next((n for n, k in enumerate(kinds) if k == t.TARGET), len(kinds))
    total = 0.0
    for n, kind in enumerate(kinds):
        if kind not in (t.INSULT, t.THREAT):
            continue
        value = weights[n]
        value *= 0.5 if t.NEGATION in kinds[max(0, n - 3) : n] else 1
        value *= 0.5 if t.REPORT in kinds[:n] else 1
        if kind == t.INSULT:
            value *= 1.25 if t.INSULT in kinds[max(0, n - 2) : n] else 1
            value *= 1.5 if met < n else 1
        else:
            value *= 1 if met < n else 0.25
        last = n < met < len(kinds) and kind not in kinds[n + 1 : met]
        if last and kind == t.INSULT and met - n <= 3:
            value += 0.5 * value
        if last and kind == t.THREAT and met - n <= 4:
            value += 3 * value
        total += value
    return total


def test_grammar_equals_plain_paths():
    g, rng = toxicity.Grammar({"moron": 4.0, "scum": 3.0}, {"lowei": 2.0}), random.Random(6)
    words = {toxicity.OTHER: ["a", "b"], toxicity.INSULT: ["moron", "scum", "loweixx"], toxicity.THREAT: ["kill"], toxicity.TARGET: ["you"], toxicity.NEGATION: ["not"], toxicity.REPORT: ["said"]}
    for _ in range(4000):
        kinds = [rng.choice(toxicity.CLASSES) for _ in range(rng.randint(0, 9))]
        clause = [rng.choice(words[k]) for k in kinds]
        weights = [{"moron": 4.0, "scum": 3.0, "loweixx": 2.0, "kill": toxicity.THREAT_WEIGHT}.get(w, 0.0) for w in clause]
        assert abs(g.clause(clause) - plain_clause(kinds, weights)) < 1e-9, clause


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"moron": 4.0, "scum": 4.0}, {"lowei": 3.0})
    score = lambda text: sum(g.clauses(text)[0])
    assert score("a loweixx here") == 3.0 and score("nothing here") == 0 and g.clauses("scumbag alowei")[0] == []
    assert score("you moron") == 6.0 and score("moron, you") == 4.0 and score("a moron like you") == 6.0
    assert score("not a moron") == 2.0 and score("she said moron") == 3.0 and score("not a b c d moron") == 4.0
    assert score("kill the process") == 1.0 and score("kill you") == 4.0 and score("I will kill all of you") == 4.0 and score("never kill you") == 2.0
    assert g.clauses("moron. scum, moron") == ([4.0, 4.0, 4.0], 3)
    machines = toxicity.insult(), toxicity.threat(), toxicity.target(), toxicity.negation(), toxicity.reported()
    whole = toxicity.compose(*machines)
    assert whole.states <= np.prod([m.states for m in machines]) and len(whole.moves) == whole.states * len(toxicity.CLASSES)


# the pipeline, and SQL


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    kept = docs(spark)
    for n, (_, stage) in enumerate(C.STAGES):
        found = stage(spark, kept, SF)
        if n < 4:
            assert tuple(found.columns) == C.COLUMNS
        now = materialize(found, "stage")
        assert now.select("doc_id").join(kept.select("doc_id"), "doc_id", "left_anti").isEmpty()
        kept = now
    assert kept.count() > 0


def test_pipeline_equals_plain_stages(spark):
    """Near copies and repeats of a small table, stage by stage against brute force."""
    import corpus_pipeline as C

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    base = [" ".join(word() for _ in range(120)) for _ in range(12)]
    texts = base + [base[0], base[1] + " " + word(), base[2][:300] + base[3][:200], None, ""]
    rows = [(n, t, "en", "s", len(t or "")) for n, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    one = {r.doc_id for r in C.one_of_near_copies(spark, table, SF).collect()}
    prints = {n: plain_simhash(t or "") for n, t in enumerate(texts)}
    root = roots(sorted(set(prints.values())), 4)
    assert one == {min(n for n in prints if root[prints[n]] == k) for k in set(root.values())}
    cut = {r.doc_id: r.text for r in C.without_repeats(spark, table, SF).collect()}
    assert cut == {i: b.decode() for i, b in plain_repeats([(n, t) for n, t in enumerate(texts)]).items()}


def pipeline_table(spark, repeated=True):
    rows = [(n, t, None if n % 3 else "en", None if n % 4 else "s", None if n % 5 else len(t or "")) for n, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None), (None, "no id", None, None, None), (5, TEXTS[5], "en", "s", 13), (5, TEXTS[5], "en", "s", 13)] if repeated else []
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("key", F.lit("clash"))


def test_pipeline_odd_rows(spark):
    """Null ids and texts, repeated rows and an empty table through all stages, each on what the one before has kept."""
    import corpus_pipeline as C

    for table in (pipeline_table(spark), pipeline_table(spark).limit(0)):
        empty = table.isEmpty()
        for n, (_, stage) in enumerate(C.STAGES):
            table = materialize(stage(spark, table, SF), "stage")
            assert n == 4 or tuple(table.columns) == C.COLUMNS
            assert table.isEmpty() if empty else n < 2 or table.count() > 0
    one = C.one_of_near_copies(spark, pipeline_table(spark), SF).collect()
    # of the blank ones (fingerprint zero) the first stays, of the repeated rows one, and the row without an id
    assert sorted(r.doc_id for r in one if r.doc_id is not None and r.doc_id < 4) == [0]
    assert [r.doc_id for r in one].count(5) == 1 and [r.doc_id for r in one].count(None) == 1
    kept = {(r.doc_id, r.text) for r in C.without_repeats(spark, pipeline_table(spark, repeated=False), SF).collect()}
    assert kept == {(i, b.decode()) for i, b in plain_repeats(list(enumerate(TEXTS))).items()}


def test_pipeline_classifiers_and_packing(spark):
    """The classifier stages keep just what their scores say, and the packing stage packs every token of what is left."""
    import corpus_pipeline as C
    from tokenizers import Tokenizer

    table, labels = docs(spark), spark.read.parquet(f"{SF}/labels.parquet")
    good = quality.classify(table, labels, label_col="quality", modulus=5, held_out=0)
    assert {r.doc_id for r in C.good_quality(spark, table, SF).collect()} == {r.doc_id for r in good.collect() if r.score >= C.GOOD}
    clean = toxicity.classify(table, labels, label_col="toxic", modulus=4, held_out=2)
    assert {r.doc_id for r in C.not_toxic(spark, table, SF).collect()} == {r.doc_id for r in clean.collect() if r.score < C.TOXIC}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = C.packed(spark, table, SF).collect()
    ids = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 1] for r in table.collect()}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(piece), r.doc_tokens, r.ids_crc32) == (r.length, len(ids[r.doc_id]), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, Q.queries()[name], Q.oracle_sql()[name]) == ""
