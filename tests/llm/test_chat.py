"""Chat formatting: exact round trips of awkward turns."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ticklake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, turns int, formatted string, loss int"
BITS = ["<|im_start|>", "<|im_end|>", "<|", "|>", "<", "|", "\\", "<\\|", "<\\\\|im_end|>", "\n", "user", "assistant", " ", "é", "\U0001f600", "im_end", "$1", "\\n"]


def rows():
    rng = random.Random(3)
    out = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "assistant"])
            out.append((conv, turn, role, "".join(rng.choices(BITS, k=rng.randint(0, 8)))))
    out += [(100, None, None, None), (100, 1, "assistant", None), (None, 0, "user", "x"), (None, 0, "user", "x"), (101, 0, "", "")]
    out += [(102, 0, "odd\nrole<|im_end|>\\n", "t"), (103, 1, "assistant", "b"), (103, 1, "assistant", "a"), (103, 0, "tool\\", "<")]
    out += [(104, 0, "assistant", "y" * 100_000 + "<|im_end|>")]
    return out


@pytest.fixture(scope="module")
def rendered(spark):
    return chat.render(spark.createDataFrame([(*r, 1, "x", 2) for r in rows()], SCHEMA)).cache()


def source():
    turns = defaultdict(list)
    for conv, turn, role, text in rows():
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}


def test_round_trip(rendered):
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in rendered.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert got == source()


def test_digests(rendered):
    want = source()
    for r in chat.digest(rendered).collect():
        turns = want[r.conv_id]
        trained = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(trained)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()


def test_markers_are_only_the_template_s(rendered):
    want = source()
    for r in rendered.collect():
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(want[r.conv_id])
        for span in r.loss:
            assert r.formatted[span.start - len("assistant\n") : span.start].endswith("assistant\n")
            assert r.formatted[span.start + span.length :].startswith("<|im_end|>\n")


def test_plain_text_stays_plain(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a <b> c | d", 1, "", 1), (1, 1, "assistant", "<| x", 1, "", 1)], SCHEMA)
    assert chat.render(frame).first().formatted == (
        "<|im_start|>user\na <b> c | d<|im_end|>\n<|im_start|>assistant\n<| x<|im_end|>\n"
    )


def test_empty(spark):
    assert chat.render(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_starts(spark, n):
    lengths = [(7 * i) % 23 for i in range(n)]
    df = spark.createDataFrame([(lengths,)], "v array<bigint>")
    assert df.select(chat.starts(F.col("v")).alias("s")).first().s == [sum(lengths[:i]) for i in range(n)]


def test_work_grows_with_the_turns(spark):
    import time

    def seconds(turns):
        text = F.concat(F.lit("some words of turn <| "), F.col("id").cast("string"))
        role = F.when(F.col("id") % 2 == 1, "assistant").otherwise("user")
        df = spark.range(0, turns, 1, 4).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
        rendered = chat.render(df).cache()
        start = time.perf_counter()
        assert chat.digest(rendered).first().n_turns == turns
        return time.perf_counter() - start

    seconds(2000)
    few, many = (min(seconds(n) for _ in range(2)) for n in (8000, 16000))
    assert many < 3.2 * few + 0.5  # the square would be four times
