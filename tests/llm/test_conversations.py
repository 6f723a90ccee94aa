"""Conversation repair against an exhaustive search over edits, and the whole contract against plain Python."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from lumibase.llm import conversations as C
from lumibase.llm import queries as Q

SF = "/root/testdata/sf0.001"


def plain_audit(symbols):
    """The cheapest edits of symbols (b and d must go, upper case is truncated): (cost, audit), by search."""

    @lru_cache(None)
    def best(i, state, inserts):
        """From row i on in a state of the grammar: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a."""
        found = []
        if i == len(symbols):
            if state in (0, 3):
                found.append((0, ""))
        else:
            s = symbols[i]
            c, a = best(i + 1, state, 2)
            found.append((c + 4, "D" + a))
            if s not in "bd":
                extra, want, after = 3 * s.isupper(), "a" if state == 2 else "u", 3 if state == 2 else 2
                c, a = best(i + 1, after, 2)
                found.append((c + extra + (0 if s.lower() == want else 3), ("K" if s.lower() == want else "R") + a))
                if state == 0 and s.lower() == "s":
                    c, a = best(i + 1, 1, 2)
                    found.append((c + extra, "K" + a))
        if inserts:
            c, a = best(i, 3 if state == 2 else 2, inserts - 1)
            found.append((c + 3, "I" + a))
        return min(found, default=(10**9, ""))

    return best(0, 0, 2)


def test_alignments_equal_a_search():
    rng = random.Random(3)
    for n in range(700):
        symbols = "".join(rng.choice("uuuaaasobdUAS") for _ in range(rng.randint(1, 14)))
        end, cost, audit = C._choice(list(C.alignments(symbols, C.START, True)), C.ACCEPTED)
        assert (cost, audit) == plain_audit(symbols), symbols


def plain(rows):
    """The contract for rows (conv, turn, role, text) after damage."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, found in groups.items():
        content = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()[:16]
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), content(r)))
        seen, symbols, blank, duplicate, cut = set(), "", 0, 0, 0
        for _, role, text in found:
            words = text.strip(" \t\n\x0b\f\r")
            code = role[:1] if role[:1] and role[:1] in "sua" else "o"
            if not words:
                symbols, blank = symbols + "b", blank + 1
            elif (role, text) in seen:
                symbols, duplicate = symbols + "d", duplicate + 1
            elif words[-1] not in ".!?":
                symbols, cut = symbols + code.upper(), cut + 1
            else:
                symbols += code
            seen.add((role, text))
        cost, audit = plain_audit(symbols)
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        lines, left, state = [], iter(found), 0
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit == "D":
                continue
            state = 1 if edit == "K" and state == 0 and row[1][:1] == "s" else 3 if state == 2 else 2
            role = row[1] if edit == "K" else "user" if state == 2 else "assistant"
            lines.append(f"{role}:{row[2] if row else ''}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, blank, duplicate, cut, illegal, cost, audit, sha)
    return out


def repaired(rows_df):
    found = C.repairs(rows_df)
    shas = {r.conv_id: r.sha256 for r in C.digests(C.repaired_turns(rows_df, found)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, shas.get(r.conv_id, empty)) for r in C.audits(found).collect()}


SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ROLES = ["user", "assistant", "system", "user", "assistant", "umpire", "tool", None, "", "ä"]
WORDS = ["Yes.", "No", "Why?", "  ", "", "Go on!  \n", None, "a ", "Ende…", "Well.", "So.", "Then."]


@pytest.mark.parametrize("bits", [6, 2])
def test_repair_equals_brute_force(spark, monkeypatch, bits):
    """Also with blocks of four rows, so that most conversations lie in several."""
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(12)]), rng.choice(ROLES), rng.choice(WORDS)) for _ in range(500)]
    rows += [(100, n, ("user", "assistant")[n % 2], f"{n}.") for n in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert repaired(df) == plain(rows)


def test_long_conversation(spark):
    """One conversation with a third of the rows lies in many blocks and partitions."""
    rng = random.Random(9)
    rows = [(1, n // 2, rng.choice(["user", "assistant", "assistant", "user", "tool"]), rng.choice(["a.", "b", f"{n}.", f"{n}"])) for n in range(900)]
    rows += [(n, t, ("user", "assistant")[t % 2], f"{n} {t}.") for n in range(2, 400) for t in range(4)]
    assert repaired(spark.createDataFrame(rows, SCHEMA).repartition(8)) == plain(rows)


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repaired(none) == {} and C.repaired_turns(none, C.repairs(none)).count() == 0
    clash = [(None, None, None, None, 1, "x"), (7, 0, "user", "word " * 200_000 + ".", 2, "y"), (7, 0, "user", "word " * 200_000 + ".", 3, "z")]
    df = spark.createDataFrame(clash, SCHEMA + ", conv bigint, audit string")
    assert repaired(df) == plain([r[:4] for r in clash])
    turns = C.repaired_turns(df, C.repairs(df)).where("conv_id = 7").orderBy("place").collect()
    assert [(r.edit, r.role, len(r.text)) for r in turns] == [("K", "user", 1_000_001), ("I", "assistant", 0)]


def test_query_equals_plain(spark):
    raw = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = []
    for conv, turn, role, text in raw:
        conv_s, turn_s, role, text = " " if conv is None else conv, " " if turn is None else turn, " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            rows += [row] * (2 if kind == 3 else 1)
    want = dict.fromkeys((r[0] for r in raw), (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) | plain(rows)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in Q.op13_conversations(spark, SF).collect()}
    assert got == want
    assert Q.op13_conversations(spark, SF).select(F.countDistinct("audit")).first()[0] > 3
