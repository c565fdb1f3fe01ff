"""Chat windows, whitening and conversation repair against plain versions."""

import hashlib
import itertools
import random

import brute_turns as brute
import numpy as np
import pytest

from logwarden.llm import chat, queries, repair, whitening

ROWS = "turn int, conv_id long, text string, role string, digest int, conv string, `a.b` double, place long"
ENDS = ["", ".", "!", "? ", "\n", " \t."]


def conversations():
    """Nulls, empty and long texts, ties, repeated rows, odd roles, marks in texts, one large conversation."""
    rng = random.Random(5)
    word = lambda n: " ".join(rng.choice(["so", "é", "überall", "12345", "</turn>", "<turn>", "\\", "\\l", "<", "?", "ok\n"]) for _ in range(n))
    rows = [(1, 0, None, None), (1, None, "user", "x"), (None, 1, "user", "Hi."), (None, 2, "assistant", None), (None, None, None, ""),
            (2, 0, "system", "Be."), (2, 1, "user", "A."), (2, 2, "assistant", "B"), (3, 5, "tool\n<turn>", word(5)), (3, 5, "tool", word(5)),
            (4, 1, "user", "Same."), (4, 1, "user", "Same."), (4, 1, "user", "Same."), (5, 0, "assistant", " \x85 "), (6, -9, "User", "U."),
            (7, 0, "", "."), (8, 3, "system", word(70)), (8, 4, "user", word(200)), (8, 5, "assistant", "a." * 400), (9, 0, "user", "</turn"), (9, 1, "assistant", "turn>\\")]
    for conv in range(20, 60):
        for turn in range(rng.randrange(12)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "sys", "tool"])
            rows.append((conv, turn + rng.randrange(2), role, word(rng.randrange(9)) + rng.choice(ENDS)))
    for turn in range(700):
        role = "system" if turn == 0 else rng.choice(["user", "assistant"]) if turn % 9 == 0 else ["user", "assistant"][turn % 2]
        rows.append((90, turn // 3 if turn % 50 == 0 else turn, role, rng.choice(["Yes.", "No"]) if turn % 4 == 0 else word(rng.randrange(30)) + rng.choice(ENDS)))
    return rows + [(91, 3, "user", "again.")] * 300


@pytest.fixture
def given(spark):
    def make(rows):
        return spark.createDataFrame([(t, c, x, r, 1, "mine", 0.5, 7) for c, t, r, x in rows], ROWS).repartition(3)
    return make


@pytest.mark.parametrize("budget, history, block", [(2048, 256, 1 << 16), (120, 30, 400), (60, 0, 90), (200, 80, 81)])
def test_chat_windows(given, budget, history, block):
    rows = conversations()
    parts = chat.format_parts(given(rows), budget=budget, history=history, block=block)
    assert len(parts) == (1 if block == 1 << 16 else 2)
    found = [r for part in parts for r in chat.read_back(part).collect()]
    expected = brute.chat(rows, budget, history, block)
    assert len(found) == len(expected)
    for r in found:
        assert (r["n_turns"], r["turns"], r["loss"], r["formatted_chars"]) == expected[r["conv_id"]], r["conv_id"]


def test_chat_windows_keep_the_budget(given):
    rows = [r for r in conversations() if r[0] == 90]
    windows = chat.format_windows(given(rows), budget=120, history=30, block=400).orderBy("start").collect()
    assert len(windows) > 50 and max(w["tokens"] for w in windows) <= 120
    for w in windows[1:]:
        assert w["repeated"] >= 1 and w["text"].startswith("<turn>system\n")
        assert all(w["text"][a:b + 7] == w["text"][a:b] + "</turn>" for a, b in w["loss"])
    assert sum(len(w["loss"]) for w in windows) == sum(r[2] == "assistant" for r in rows)


def test_repair_of_all_short_rows(given):
    """Every sequence of a few rows, by codes, against whole audits."""
    machine = repair.Machine()
    names = {repair.OK: None, repair.BLANK: "blank", repair.DUPLICATE: "duplicate", repair.CUT_OFF: "truncated"}
    for n in range(5):
        for codes in itertools.product([4 * i + f for i in range(4) for f in ((0, 1, 3) if n < 4 else (0, 3))], repeat=n):
            assert machine.repair(list(codes)) == brute.cheapest([("suax"[c // 4], names[c % 4]) for c in codes])


@pytest.mark.parametrize("short", [repair.SHORT, 3000, 1])
def test_repair(given, short):
    rows = conversations()
    expected = brute.repair(rows)
    found = repair.repair(repair.damage(given(rows)), short).collect()
    assert len(found) == len(expected)
    for r in found:
        assert tuple(r)[1:] == expected[r["conv_id"]], r["conv_id"]


def test_empty_tables(spark, given):
    none = given([(1, 1, "user", "x")]).filter("conv_id = 2")
    assert chat.format_windows(none).count() == 0 and chat.read_back(chat.format_windows(none)).count() == 0
    assert repair.repair(repair.damage(none)).count() == 0
    vectors = whitening.finite(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert whitening.fit(vectors) is None


def vectors(n, width=9, seed=3):
    rng = np.random.default_rng(seed)
    values = (rng.normal(size=(n, 4)) @ rng.normal(size=(4, width)) + rng.normal(size=(n, width))).astype(np.float32) + 5
    rows = [(k, v.tolist()) for k, v in enumerate(values)]
    return rows + rows[:3] + [(None, rows[0][1]), (7, rows[5][1]), (50, None), (51, []), (52, [1.0]), (53, [None] * width),
                              (54, [float("nan")] + [0.0] * (width - 1)), (55, [float("inf")] * width)]


@pytest.mark.parametrize("components", [32, 4])
def test_whitening(spark, components):
    rows = vectors(800)
    table = spark.createDataFrame([(v, i, "x") for i, v in rows], "embedding array<float>, vec_id long, whitened string").repartition(5)
    valid = whitening.finite(table)
    found = whitening.fit(valid, components)
    got = whitening.whiten(valid, found).collect()
    ids, n, deviation, expected, explained = brute.whitening(rows, components)
    assert found.n == n == len(got) and np.allclose(found.share, explained, rtol=1e-9)
    order = sorted(range(n), key=lambda k: (ids[k] is not None, ids[k] or 0, deviation[k]))
    got = sorted(got, key=lambda r: (r["vec_id"] is not None, r["vec_id"] or 0, r["deviation"]))
    assert [(r["vec_id"], r["deviation"]) for r in got] == [(ids[k], deviation[k]) for k in order]
    mine, theirs = np.array([r["whitened"] for r in got]), expected[order]
    assert np.allclose(mine * np.sign((mine * theirs).sum(0)), theirs, atol=1e-8)
    assert whitening.identity_error(whitening.whiten(valid, found), found) < 1e-9


def test_covariance_is_exact(spark):
    """Entries far from zero with small differences, which floating sums of products would lose."""
    rows = [(k, [2.0 ** 30 + (k % 7) / 64, 2.0 ** 30 + (k % 5) / 64, -3.0]) for k in range(700)]
    valid = whitening.finite(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = whitening.fit(valid)
    x = np.array([[k % 7, k % 5] for k in range(700)], float)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(found.values[:2], values, rtol=1e-12) and np.isnan(found.axes[:, 2]).all()
    rows = whitening.whiten(valid, found).collect()
    assert all(np.isnan(r["whitened"][2]) for r in rows) and whitening.identity_error(whitening.whiten(valid, found), found) < 1e-9


def test_queries(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    expected = brute.chat(rows + odd, chat.BUDGET, chat.HISTORY, chat.BLOCK)
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {tuple(r) for r in queries.QUERIES["op11_chat_windows"](spark, folder).collect()} == {
        (c, n, hexed(t), len(x), hexed(x), chars) for c, (n, t, x, chars) in expected.items()}
    fixed = {r["conv_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_conversation_repair"](spark, folder).collect()}
    assert fixed == brute.repair(rows)
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    white = queries.QUERIES["op12_whitening"](spark, folder).collect()
    assert len(white) == 32 * table.count() and max(r["identity_error"] for r in white) < 1e-4
    assert abs(sum({r["component"]: r["explained"] for r in white}.values())) <= 1
