"""Conversation repair: the algebra by enumeration, the operator against plain Python and SQL."""

import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import pytest

from assetlens.llm import repair

SF = "/root/testdata/sf0.01"
TARGET = re.compile(r"(s?(ua)+)?")


def cheapest(symbols):
    """Every sequence of edits with at most two insertions between rows, the cheapest valid one by (cost, audit)."""
    choices = []
    for x in symbols:
        extra = 1 if x in "SUAO" else 0
        edits = [(3, "D", "")]
        if x != "D":
            edits += [(2 + extra, "R", "u"), (2 + extra, "R", "a")]
            edits += [(extra, "K", x.lower())] if x.lower() in "sua" else []
        choices.append(edits)
    inserts = [()] + [tuple(c) for n in (1, 2) for c in itertools.product("ua", repeat=n)]
    best = None
    for rows in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, roles = 0, "", ""
            for gap, row in itertools.zip_longest(gaps, rows):
                cost, audit, roles = cost + 2 * len(gap), audit + "I" * len(gap), roles + "".join(gap)
                if row:
                    cost, audit, roles = cost + row[0], audit + row[1], roles + row[2]
            if TARGET.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def step(entry, cost, letter):
    return entry[0] + cost, entry[1] + letter


def plain_solve(symbols):
    """(cost, audit) row by row, without rules."""
    far = (1 << 40, "")
    at = {0: (0, ""), 1: far, 2: far, 3: far}
    for x in [*symbols, None]:
        for _ in range(2):
            for p, q in ((0, 2), (1, 2), (2, 3), (3, 2)):
                at[q] = min(at[q], step(at[p], 2, "I"))
        if x is None:
            return min(at[0], at[3])
        extra, new = int(x in "SUAO"), {q: step(at[q], 3, "D") for q in at}
        for role, p, q in (("s", 0, 1), ("u", 0, 2), ("u", 1, 2), ("u", 3, 2), ("a", 2, 3)):
            if x != "D" and role in "ua":
                new[q] = min(new[q], step(at[p], 2 + extra, "R"))
            if x.lower() == role and x != "D":
                new[q] = min(new[q], step(at[p], extra, "K"))
        at = new
    return None


def test_plain_equals_enumeration():
    for n in range(4):
        for symbols in itertools.product("suaoSUAD" if n < 3 else "suUaD", repeat=n):
            assert plain_solve(symbols) == cheapest(symbols), symbols


def test_rules_change_nothing():
    rng = random.Random(4)
    grammar = repair.Grammar()
    for _ in range(24):
        known = list(repair.TERMINALS) + [r[0] for r in grammar.rules]
        grammar.add(rng.choice(known), rng.choice(known))
    for a, b in (("u", "a"), ("D", "u"), ("a", "u")):
        grammar.add(a, b)
    for _ in range(1500):
        symbols = "".join(rng.choice("uuaaasoSUAOD") for _ in range(rng.randrange(60)))
        cuts = sorted(rng.randrange(len(symbols) + 1) for _ in range(2))
        parts = [symbols[i:j] for i, j in zip([0, *cuts], [*cuts, len(symbols)], strict=True)]
        cost, audits = grammar.solve(tuple(map(grammar.compressed, parts)))
        assert (cost, "".join(audits)) == plain_solve(symbols)
        for part, audit in zip(parts, audits, strict=True):
            assert len(audit.replace("I", "")) == len(part)
            blocks = list(repair._row_blocks(audit)) if part else []
            assert len(blocks) == len(part) and (not part or "".join(blocks) == audit)


def plain(rows, harm=True):
    """Result rows of (conv_id, turn, role, text) rows, straight from the definition; rows of one turn must be equal."""
    out, kept = {}, {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20 if harm else 9
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, group in kept.items():
        group.sort(key=lambda r: r[:2])
        seen, symbols, counts = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, _, role, text in group:
            body = text.strip(" \t\n\v\f\r")
            fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "D" if fault in ("b", "d") and fault else initial.upper() if fault else initial
        cost, audit = plain_solve(symbols)
        lines, i = [], 0
        for letter in audit:
            parity = len(lines) - (1 if lines and lines[0][0][:1] == "s" else 0)
            turn_role = "user" if parity % 2 == 0 else "assistant"
            if letter == "I":
                lines.append((turn_role, "", "I"))
                continue
            if letter != "D":
                lines.append((group[i][2] if letter == "K" else turn_role, group[i][3], letter))
            i += 1
        known = [t for ok, t, _, _ in group if ok]
        initials = [r[2][:1] for r in group]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        said = "\n".join(f"{r}:{t}" for r, t, _ in lines)
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, symbol string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = repair.op11_repair(spark, str(tmp_path)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


ROLES = ["user", "assistant", "system", "tool", "", None, "anyone", "sue"]
TEXTS = ["Yes.", "No!", "so", "", " \n\t", None, "Why?  \n", "x" * 30_000 + ".", "é…", "Yes. ", "a\nb.", "\x1f"]


@pytest.mark.parametrize("bits", [10, 1])
def test_odd_conversations(spark, tmp_path, monkeypatch, bits):
    """Nulls, repeated rows, blank and long texts, odd roles, clashing columns; also with a chunk for every two rows."""
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    rng = random.Random(bits)
    rows = []
    for conv in [None, *range(-3, 40)]:
        turns = rng.sample(range(-5, 30), rng.randrange(1, 12)) + [None] * rng.randrange(2)
        rows += [(conv, t, rng.choice(ROLES[:3] * 3 + ROLES), rng.choice(TEXTS)) for t in turns]
    rows += [r for r in rows if rng.random() < 0.1] * 2  # whole rows repeated
    assert run(spark, tmp_path, rows) == plain(rows)


def test_one_conversation_with_most_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_BITS", 5)
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"Text {t if t % 9 else 0}.") for t in range(1500)]
    rows += [(i, 0, "user", "Hello.") for i in range(8, 200)]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_extreme_turns_and_lost_conversation(spark, tmp_path):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Hello."), (-1, -(2**63), "user", "a."), (-1, 2**63 - 1, "assistant", "b.")]
    got = run(spark, tmp_path, rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[-1][1:] == plain(rows)[-1][1:]


def test_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}


def test_query_equals_sql_and_plain_rules(spark):
    got = repair.op11_repair(spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{os.path.join(SF, 'conversations.parquet')}'")
    want = con.sql(repair.ORACLES["op11_repair"]).project(", ".join(got.columns)).fetchall()
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want)
    given = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert {r[0]: r[1:] for r in rows} == plain(given)


def test_repaired_lines(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hi."), (1, 2, "user", " "), (1, 3, "user", "Go on.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies int")
    _, solutions, lines = repair.repair(df)
    assert solutions.first().audit == "KIKDKI"
    assert [tuple(r)[1:] for r in lines.orderBy("line").collect()] == [
        (0, "system", "Be brief.", "K"), (1, "user", "", "I"), (2, "assistant", "Hi.", "K"), (3, "user", "Go on.", "K"), (4, "assistant", "", "I"),
    ]
