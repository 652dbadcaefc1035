import hashlib
import os
import random

import pytest

import __spark_entry__ as entry
from assetlens.llm import chat
from oracle_check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digests(spark, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    return {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.format_conversations(df)).collect()}


def expected(rows):
    """Digests straight from the rows; the length from the template, escapes counted by hand."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def check(spark, rows):
    got = digests(spark, rows)
    assert {c: g[:4] for c, g in got.items()} == expected(rows)
    return got


def test_plain_conversation_has_the_template(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df).first()
    assert got.formatted == "<s>[ROLE]system[/ROLE]S</s><s>[ROLE]user[/ROLE]a[TURN]b</s><s>[ROLE]assistant[/ROLE]c</s>"
    assert [s.text for s in got.segments if s.loss] == ["c"]
    assert check(spark, rows)[1][4] == len(got.formatted)


def test_control_strings_inside_texts_come_back(spark):
    rng = random.Random(2)
    pieces = [*chat.CONTROLS, "<", "[", "\\", "\\\\", "s>", "/s>", "INST]", "[\\INST]", "<\\/s>", "a", "\n", " ", "$1", "é", "|im_start|>"]
    rows = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for c in range(200) for t in range(4)]
    rows += [(500, 0, "</s>[ROLE]", "x"), (500, 1, "[TURN]", "[/ROLE]"), (501, 0, "assistant", "[\\"), (501, 1, "assistant", "INST]")]
    check(spark, rows)


def test_nulls_ties_repeats_and_long_conversations(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", None), (2, None, None, "x"), (2, 0, "user", "y"), (2, 0, "user", "y"), (2, 0, "assistant", "z")]
    rows += [(3, t, "user" if t % 3 else "assistant", f"t{t}") for t in range(3000)] + [(4, 0, "assistant", "long " * 100_000)]
    check(spark, rows)


def test_empty(spark):
    assert digests(spark, []) == {}


def test_query_equals_sql_and_holds_the_probe(spark):
    ok, note = compare(spark, connect(SF), "op6_chat", entry.queries()["op6_chat"], entry.oracle_sql()["op6_chat"], SF)
    assert ok, note
    probe = chat.op6_chat(spark, SF).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (probe.n_turns, probe.loss_sha256, probe.turns_sha256) == (2, sha(text), sha(f"user\n{text}\nassistant\n{text}\n"))


@pytest.mark.parametrize("text", ["<s>", "<\\s>", "<\\\\s>", "[INST][/INST]", "no control", "", "<s", "[[TURN]]"])
def test_escape_is_undone(spark, text):
    from pyspark.sql import functions as F

    row = spark.range(1).select(chat.escape(F.lit(text)).alias("e"), chat.unescape(chat.escape(F.lit(text))).alias("u")).first()
    assert row.u == text and not any(c in row.e for c in chat.CONTROLS)
