import random

from evidentia.llm.preference import CLOSE, OP8_SQL, OPEN, SEP, format_preferences, op8_preference_formatting, with_pairs
from tests.compare import compare, connection

SCHEMA = "pair_id long, rejected boolean, turn int, role string, text string"


def rendered(turns):
    return "".join(f"{OPEN}{r}{SEP}{t}{CLOSE}" for r, t in turns)


def brute(rows):
    pairs = {}
    for p, rejected, turn, role, text in rows:
        if p is not None and rejected is not None:
            pairs.setdefault(p, ([], []))[rejected].append((turn, role or "", text or ""))
    out = {}
    for p, sides in pairs.items():
        c, r = ([x[1:] for x in sorted(s, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))] for s in sides)
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        losses = []
        for side in (c[n:], r[n:]):
            at, spans = 0, []
            for role, text in side:
                start = at + len(OPEN + role + SEP)
                at = start + len(text + CLOSE)
                if role == "assistant":
                    spans.append(f"{start}:{at}")
            losses.append(";".join(spans))
        out[p] = (n, rendered(c[:n]), rendered(c[n:]), rendered(r[n:]), *losses)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for p in range(40):
        base = [(("user", "assistant")[i % 2], rng.choice("abcö🙂") * rng.randrange(4)) for i in range(rng.randrange(6))]
        for rejected in (False, True):
            for i, (role, text) in enumerate(base):
                rows.append((p, rejected, i, role, text if rng.random() < 0.8 else text + "x"))
    rows += [(100, False, 0, "user", "only one side"), (101, True, None, None, None), (102, False, 1, "assistant", "b"), (102, False, 1, "assistant", "b"),
             (102, True, 1, "assistant", "b"), (103, False, 0, "user", "y" * 100_000), (None, True, 0, "user", "z"), (104, None, 0, "user", "z")]
    got = format_preferences(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["pair_id"]: tuple(r)[1:] for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_query_equals_its_sql(spark, sf):
    rows, difference = compare(spark, connection(sf), op8_preference_formatting, OP8_SQL, sf)
    assert rows > 0 and not difference


def test_given_pairs_and_empty_tables(spark):
    turns = spark.createDataFrame([(7, 0, "user", "q", 1), (8, 0, "user", "q", 2), (9, 0, "user", "r", 3)], "conv_id long, turn int, role string, text string, pair_id int")
    pairs = spark.createDataFrame([(1, 7, 8), (2, 7, 9)], "pair_id long, chosen_id long, rejected_id long")
    got = {r["pair_id"]: r["common_turns"] for r in format_preferences(with_pairs(turns, pairs)).collect()}
    assert got == {1: 1, 2: 0}
    assert format_preferences(spark.createDataFrame([], SCHEMA)).count() == 0
