import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T, values as V
from evidentia.operators import chunking as C, citation, evaluation as E, generation as G, ledger as L, operations as O, pipeline as P, retrieval as R

SPAN = "struct<page:int,x0:double,y0:double,x1:double,y1:double>"
BOX = (0, 0.1, 0.1, 0.9, 0.2)


def packed(words, budget, overlap):
    """Chunks as lists of block numbers, by a plain loop."""
    out, now, size = [], [], 0
    for i, w in enumerate(words):
        if now and size + w > budget:
            out.append(now)
            keep, kept = [], 0
            for j in reversed(now):
                if kept + words[j] > overlap:
                    break
                keep.insert(0, j)
                kept += words[j]
            now, size = (keep, kept) if kept + w <= budget else ([], 0)
        now = [*now, i]
        size += w
    return [*out, now] if now else out


def test_packing_equals_a_plain_loop(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for d in range(12):
        sizes = [rng.choice((1, 3, 10, 30, 60, 90)) for _ in range(rng.choice((0, 1, 5, 60)))]
        rows += [(str(d), i, " ".join(f"w{i}x{k}" for k in range(n)), BOX) for i, n in enumerate(sizes)]
        if sizes:
            want[str(d)] = packed(sizes, 100, 40)
    blocks = spark.createDataFrame(rows, f"document_id string, ord int, text string, span {SPAN}").repartition(5)
    got = {}
    for r in C.pack(blocks, 160, 64).orderBy("document_id", "ord").collect():
        got.setdefault(r["document_id"], []).append(list(range(r["first_block"], r["last_block"] + 1)))
        assert len(r["spans"]) == r["last_block"] - r["first_block"] + 1 and r["chunk_id"].startswith(f"{r['document_id']}:{r['ord']:05d}:")
        assert r["token_count"] == int(len(r["text"].split()) * 1.6)
    assert got == want


def test_oversized_blocks_keep_their_span(spark):
    blocks = spark.createDataFrame([("d", 0, " ".join(str(i) for i in range(250)), BOX)], f"document_id string, ord int, text string, span {SPAN}")
    got = C.pack(blocks, 160, 0).orderBy("ord").collect()
    assert [len(r["text"].split()) for r in got] == [100, 100, 50] and all(tuple(r["spans"][0]) == BOX for r in got)
    for bad in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            C.budgets(*bad)


CHUNKS = [("a", "d1", 0, "Umsatz und Gewinn stiegen"), ("b", "d1", 1, "Der Umsatz sank 5.996,4"), ("c", "d2", 2, "Umsatz Umsatz"), ("e", "d2", 3, "anderes"), ("f", "d2", 4, "")]


def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, document_id string, position long, text string")


def test_bm25_scope_keeps_corpus_statistics(spark):
    held = R.index(chunks(spark))
    q = spark.createDataFrame([(1, "d2", "umsatz 5.996,4"), (2, "d1", "umsatz umsatz"), (3, "d1", "fehlt"), (4, "d1", "")], "query_id long, document_id string, text string")
    free = {(r["query_id"], r["chunk_id"]): r["score"] for r in R.bm25(q, held, 10).collect()}
    scoped = R.bm25(q, held, 10, scoped=True).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in scoped} == {(1, "c"), (2, "a"), (2, "b")}
    assert all(free[r["query_id"], r["chunk_id"]] == r["score"] for r in scoped)
    one = {r["chunk_id"]: r["score"] for r in R.bm25(q.where("query_id = 2").withColumn("text", F.lit("umsatz")), held, 10).collect()}
    assert all(free[2, c] == pytest.approx(2 * s, abs=1e-7) for c, s in one.items())
    assert [r["rank"] for r in R.bm25(q, held, 2).where("query_id = 1").orderBy("rank").collect()] == [1, 2]


def test_dense_keeps_negative_scores_and_ties_by_position(spark):
    v = spark.createDataFrame([("a", "d", 0, [1.0, 0.0]), ("b", "d", 1, [2.0, 0.0]), ("c", "e", 2, [-1.0, 0.0]), ("z", "e", 3, [0.0, 0.0])], "chunk_id string, document_id string, position long, embedding array<float>")
    q = spark.createDataFrame([(1, "e", [1.0, 0.0])], "query_id long, document_id string, embedding array<float>")
    assert [(r["chunk_id"], r["score"]) for r in R.dense(q, v).orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0), ("z", 0.0), ("c", -1.0)]
    assert [r["chunk_id"] for r in R.dense(q, v, scoped=True).orderBy("rank").collect()] == ["z", "c"]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 60, "w")], "query_id long, rank int, chunk_id string")
    b = spark.createDataFrame([(1, 1, "y"), (1, 2, "x"), (1, 3, "z")], "query_id long, rank int, chunk_id string")
    got = R.fuse([a, b]).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("x", pytest.approx(1 / 61 + 1 / 62)), ("y", pytest.approx(1 / 61 + 1 / 62)), ("z", pytest.approx(1 / 63))]
    with pytest.raises(ValueError):
        R.fuse([])


def test_best_sentence_first_of_equals(spark):
    q = spark.createDataFrame([(1, "gesamter umsatz heuer"), (2, "ab")], "query_id long, text string")
    h = spark.createDataFrame([(1, 1, "c1", "Kurz umsatz. Der gesamte Umsatz stieg deutlich. Auch der Umsatz sank danach."), (1, 2, "c2", "Gesamter Umsatz heuer war sehr gut."), (1, 4, "c4", "Gesamter Umsatz heuer, genau so gefragt."), (2, 1, "c1", "Irgendein Satz mit genug Zeichen.")],
                              "query_id long, rank int, chunk_id string, text string")
    got = R.best_sentences(q, h).collect()
    assert [(r["query_id"], r["chunk_id"], r["support"]) for r in got] == [(1, "c2", 1.0)]


FACTS = "document_id string, fact_id string, seq int, concept string, period string, value decimal(38,10), displayed string, unit string, span " + SPAN


def facts(spark, rows):
    return spark.createDataFrame([(d, f"f{i:06d}", i, c, p, Decimal(v), v, "EUR", BOX) for i, (d, c, p, v) in enumerate(rows)], FACTS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "document_id string, concept string, text string")


def corpus(spark):
    f = facts(spark, [("d1", "c:rev", "2022-01-01/2022-12-31", "1204000"), ("d1", "c:rev", "2021-01-01/2021-12-31", "1150000"), ("d1", "c:eq", "instant:2022-12-31", "5"), ("d1", "c:eq", "instant:2022-12-31", "6"),
                      ("d1", "c:inv", "instant:2022-12-31", "7"), ("d1", "c:cash", "instant:2022-12-31", "7"), ("d2", "c:rev", "2022-01-01/2022-12-31", "9")])
    own = labels(spark, [("d1", "c:rev", "Umsatzerlöse"), ("d1", "c:eq", "Eigenkapital"), ("d1", "c:inv", "Vorräte"), ("d1", "c:cash", "Vorräte"), ("d3", "c:rev", "Erlöse aus Umsatz")])
    text = spark.createDataFrame([("p1", "d1", 0, "Der Vorstand berichtet über die neue Strategie im Ausland. Mehr steht hier nicht."), ("p2", "d2", 1, "Nichts von Belang steht hier.")], "chunk_id string, document_id string, position long, text string")
    return P.build(text, f, own)


QUESTIONS = [
    (1, "d1", "Wie hoch war Umsatzerlöse im Geschäftsjahr 2022?", "answered", "ledger", "1204000.0000000000"),
    (2, "d1", "Wie hoch war Umsatzerlöse im Geschäftsjahr 2009?", "abstained", "passage", None),
    (3, "d1", "Wie hoch war Eigenkapital zum 31.12.2022?", "abstained", "ledger", None),
    (4, "d1", "Wie hoch war Umsatzerlöse?", "abstained", "passage", None),
    (5, "d1", "Wie hoch war Erwerb von fremden Vorräte zum 31.12.2022?", "abstained", "passage", None),
    (6, "d1", "Was berichtet der Vorstand über die neue Strategie?", "answered", "passage", None),
    (7, "d9", "Wie hoch war Umsatzerlöse im Geschäftsjahr 2022?", "abstained", "none", None),
    (8, "d2", "Wie hoch war Umsatzerlöse im Geschäftsjahr 2022?", "answered", "ledger", "9.0000000000"),
    (9, "d1", "Wie hoch war Vorräte zum 31.12.2022?", "answered", "ledger", "7.0000000000"),
    (10, "d1", "?!", "abstained", "passage", None),
]


def test_answers_of_the_whole_pipeline(spark):
    c = corpus(spark)
    q = spark.createDataFrame([r[:3] for r in QUESTIONS], "query_id long, document_id string, text string")
    got = {r["query_id"]: r for r in P.answer(q, c).collect()}
    assert len(got) == len(QUESTIONS)
    for i, _, _, status, route, value in QUESTIONS:
        assert (got[i]["status"], got[i]["route"], got[i]["value"]) == (status, route, value), got[i]
    assert got[1]["text"] == "1.204.000,00 EUR" and got[1]["confidence"] == 1.0 and got[3]["confidence"] == 0.0
    assert got[3]["reason"].startswith("2 values are tagged for") and got[4]["reason"] == L.NO_PERIOD and got[5]["reason"].startswith("it asks about more than") and got[10]["reason"] == L.NO_WORDS
    assert got[6]["chunk_id"] == "p1" and got[6]["text"].startswith("Der Vorstand")
    assert {(r["document_id"], r["tagged_facts"], r["chunks"]) for r in P.summaries(c).collect()} == {("d1", 6, 1), ("d2", 1, 1)}
    with pytest.raises(ValueError):
        P.answer(q, c, top_k=51)
    with pytest.raises(Exception, match="1 to 1000"):
        P.answer(q.withColumn("text", F.repeat(F.lit("x"), 1001)), c).collect()


def test_empty_corpus_answers_nothing(spark):
    empty = P.build(chunks(spark).limit(0), facts(spark, [("d", "c", "p", "1")]).limit(0), labels(spark, [("d", "c", "t")]).limit(0))
    q = spark.createDataFrame([(1, "d1", "Umsatz?")], "query_id long, document_id string, text string")
    assert [r["route"] for r in P.answer(q, empty).collect()] == ["none"]


def test_resolve_takes_the_closest(spark):
    f = facts(spark, [("d", "a", "p", "345244000"), ("d", "b", "p", "343793000"), ("d", "z", "p", "0"), ("d", "n", "p", "-343800000"), ("e", "b", "p", "343800000")])
    m = spark.createDataFrame([("d", 1, Decimal("343.8"), [1_000_000]), ("d", 2, Decimal("343.8"), list(T.ALL_SCALES)), ("d", 3, Decimal("1.1"), [1_000_000]), ("d", 4, Decimal("-343.8"), [1_000_000]), ("d", 5, Decimal("999.9"), [1])],
                              "document_id string, mention_id int, value decimal(38,10), scales array<bigint>")
    assert {r["mention_id"]: r["fact_id"] for r in L.resolve(m, f).collect()} == {1: "f000001", 2: "f000001", 4: "f000003"}


def test_resolve_crosses_powers_of_ten(spark):
    f = facts(spark, [("d", "a", "p", "1000"), ("d", "b", "p", "998")])
    m = spark.createDataFrame([("d", 1, Decimal("999.4"), [1]), ("d", 2, Decimal("1002"), [1])], "document_id string, mention_id int, value decimal(38,10), scales array<bigint>")
    assert {r["mention_id"]: r["fact_id"] for r in L.resolve(m, f).collect()} == {1: "f000000", 2: "f000000"}


def test_prose_pairs(spark):
    f = facts(spark, [("d", "c:rev", "p", "236600000"), ("d", "c:x", "p", "5000")])
    blocks = spark.createDataFrame([
        ("d", 3, 0, "Die Gesellschaft steigerte den Umsatz im abgelaufenen Geschäftsjahr deutlich auf 236,61 Mio. EUR. Danach folgte ein langer weiterer Satz ohne jede Zahl darin."),
        ("d", 3, 1, "Gesamt 197.315 737.935 4.230.415"), ("d", 3, 2, "Ein Satz, der die getaggte Zahl 5000 wörtlich wiederholt und sonst sehr viele gute lange Wörter enthält."),
    ], "document_id string, page int, ord int, text string")
    got = L.prose_pairs(blocks, f, labels(spark, [("d", "c:rev", "Umsatz der Gesellschaft")])).collect()
    assert [(r["fact_id"], r["mention"], r["page"], r["names_concept"]) for r in got] == [("f000000", "236,61", 3, True)]
    assert got[0]["sentence"].endswith("deutlich auf 236,61 Mio.")


def test_linkbase_labels(spark):
    loc = spark.createDataFrame([("f", 1, "l1", "x.xsd#ifrs-full_Rev_enue"), ("f", 2, "l2", "x.xsd#nounderscore"), ("f", 3, "l3", "x#a_B")], "file string, seq int, key string, href string")
    label = spark.createDataFrame([("f", 1, "t1", "de", L.ROLES[2], "Summe"), ("f", 2, "t2", "DE", L.ROLES[0], " Umsatz "), ("f", 3, "t3", "en", L.ROLES[0], "Revenue"), ("f", 4, "t4", "de", "?", "Anders")],
                                  "file string, seq int, key string, lang string, role string, text string")
    arc = spark.createDataFrame([("f", 1, "l1", "t1"), ("f", 2, "l1", "t2"), ("f", 3, "l1", "t3"), ("f", 4, "l3", "t4"), ("f", 5, "l2", "t4"), ("f", 6, "no", "t4")], "file string, seq int, from_key string, to_key string")
    assert {(r["concept"], r["text"]) for r in L.linkbase_labels(loc, arc, label).collect()} == {("ifrs-full:Rev_enue", "Umsatz"), ("a:B", "Anders")}


def test_citation_narrowing_and_header(spark):
    rows = [("Umsatz", 0.0, 0.5), ("2022/23", 0.4, 0.1), ("2021/22", 0.7, 0.1), ("1.204", 0.4, 0.5), ("1.150", 0.7, 0.5), ("Aufwand", 0.0, 0.6), ("870", 0.4, 0.6)]
    words = spark.createDataFrame([("d", 0, i, t, (0, x, y, x + 0.2, y + 0.02)) for i, (t, x, y) in enumerate(rows)], f"document_id string, page int, seq long, text string, span {SPAN}")
    region = spark.createDataFrame([("c", "d", (0, 0.0, 0.0, 1.0, 1.0))], f"chunk_id string, document_id string, span {SPAN}")
    q = spark.createDataFrame([(1, "c", "Umsatz gesamt", ""), (2, "c", "Umsatz gesamt", "im Jahr 2021/22"), (3, "c", "nix da", ""), (4, "c", "Umsatz", "1999")], "query_id long, chunk_id string, text string, period_hint string")
    inside = citation.words_inside(words, region)
    assert inside.count() == len(rows)
    got = {}
    for r in citation.narrow(q, inside, max_spans=5).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["text"])
    assert got == {1: ["1.204", "1.150"], 2: ["1.204", "1.150"], 4: ["1.204", "1.150"]} or got == {1: ["1.204", "1.150"], 2: ["1.150"], 4: ["1.204", "1.150"]}


def test_review(spark):
    p = spark.createDataFrame([("f1", "5", 1, "s", False), ("f1", "5", 2, "s", False), ("f2", "6", 1, "t", True)], "fact_id string, mention string, page int, sentence string, confirmed boolean")
    d = spark.createDataFrame([("f1", "5", 1, "s", "y"), ("f2", "6", 1, "t", "n")], "fact_id string, mention string, page int, sentence string, decision string")
    assert {(r["fact_id"], r["page"]): r["confirmed"] for r in L.apply_review(p, d).collect()} == {("f1", 1): True, ("f1", 2): False, ("f2", 1): True}
    w = spark.createDataFrame([("own", ["a"], "c"), ("", ["b", "a"], "c"), (None, None, "c"), ("", [], "c")], "o string, p array<string>, c string")
    assert [r[0] for r in w.select(L.display_wording(F.col("o"), F.col("p"), F.col("c"))).collect()] == ["own", "a  (another filing's wording for c)", "c", "c"]


def test_calibration(spark):
    rows = [(1.0, True), (0.95, False), (0.1, False), (0.3, True), (0.30000000000000004, True)]
    b = E.calibration_bins(spark.createDataFrame(rows, "confidence double, correct boolean"))
    assert {(r["lower"], r["count"]) for r in b.collect()} == {(0.9, 2), (0.1, 1), (0.3, 2)}
    c = E.calibration(b).first()
    assert c["samples"] == 5 and c["overconfidence"] == pytest.approx((2 * (0.975 - 0.5) + 0.1) / 5, abs=1e-4) and c["max_calibration_error"] == 0.7
    assert E.calibration(b.limit(0)).first()["samples"] == 0


def test_bootstrap_forms_agree_in_kind(spark):
    rng = random.Random(9)
    rows = [(i, float(rng.random() < 0.3), float(rng.random() < 0.6)) for i in range(120)]
    df = spark.createDataFrame(rows, "query_id long, baseline double, candidate double")
    a, b = E.paired_bootstrap(df, 400).first(), E.paired_bootstrap_exact(df, 400).first()
    for c in ("baseline", "candidate", "delta", "n", "discordant"):
        assert a[c] == pytest.approx(b[c])
    assert a["low"] < a["delta"] < a["high"] and abs(a["low"] - b["low"]) < 0.08 and abs(a["high"] - b["high"]) < 0.08 and a["significant"] == b["significant"]
    same = E.paired_bootstrap(df.withColumn("candidate", F.col("baseline")), 50).first()
    assert (same["low"], same["high"], same["discordant"], same["significant"]) == (0.0, 0.0, 0, False)
    assert E.paired_bootstrap(df.limit(0), 50).count() == 0 and E.paired_bootstrap_exact(df.limit(0), 50).count() == 0


def test_report_of_nothing_is_zero(spark):
    none = spark.createDataFrame([], "expectation string, note string, answered boolean, route string, has_value boolean, exact_value boolean")
    assert set(E.report(none).first()) == {0}


def test_exact_sample_is_python_s(spark):
    df = spark.createDataFrame([("d", f"k{i:02d}") for i in range(30)], "document_id string, key string")
    got = sorted(r["key"] for r in E.sample_exact(df, "key", "document_id", 5).collect())
    assert got == sorted(random.Random(E.SEED).sample([f"k{i:02d}" for i in range(30)], 5))


def limited(events, limit, window):
    held, out = {}, {}
    for caller, ts, event in sorted(events, key=lambda e: (e[1], e[2])):
        hits = held[caller] = [t for t in held.get(caller, []) if ts - t <= window]
        if len(hits) >= limit:
            out[event] = (False, None, int(window - (ts - hits[0])) + 1)
        else:
            hits.append(ts)
            out[event] = (True, limit - len(hits), None)
    return out


def test_rate_limit_equals_a_plain_loop(spark):
    rng = random.Random(10)
    events = [(rng.choice("abc"), float(rng.randrange(0, 4000)) / 4, i) for i in range(300)]
    df = spark.createDataFrame(events, "caller string, ts double, event_id long")
    got = {r["event_id"]: (r["accepted"], r["remaining"], r["retry_after"]) for r in O.rate_limit(df, 3, 20.0).collect()}
    assert got == limited(events, 3, 20.0) and any(not v[0] for v in got.values())
    assert O.rate_limit(df, 0, 20.0).where("accepted").count() == 300


def test_snapshot_and_replay(spark):
    d = spark.createDataFrame([("c", "b", "h2"), ("c", "a", "h1")], "corpus string, document_id string, content_hash string")
    one = O.snapshots(d, O.settings_fingerprint(600, 20, "bm25"), "corpus").first()
    assert one["snapshot_id"] == O.snapshots(d.orderBy("document_id"), O.settings_fingerprint(600, 20, "bm25"), "corpus").first()["snapshot_id"] and one["documents"] == {"a": "h1", "b": "h2"}
    assert one["snapshot_id"] != O.snapshots(d, O.settings_fingerprint(200, 20, "bm25"), "corpus").first()["snapshot_id"]
    stored = spark.createDataFrame([("a", "h1", "v1"), ("b", "old", "v1")], "document_id string, content_hash string, builder_version string")
    assert [r["document_id"] for r in O.to_build(d, stored, "v1").collect()] == ["b"] and O.to_build(d, stored, "v2").count() == 2 and O.to_build(d, stored, "v1", force=True).count() == 2


def test_comparable_leaves_out_quotes(spark):
    cites = "array<struct<document_id:string,page:int,spans:array<int>,quote:string,exact:boolean>>"
    rows = [(("answered", "ledger", "t", "1", None, "p", 1.0, [("d", 1, [1], q, True)]),) for q in ("x", "y")]
    df = spark.createDataFrame(rows, f"a struct<status:string,route:string,text:string,value:string,unit:string,period:string,confidence:double,citations:{cites}>")
    got = [r[0] for r in df.select(O.comparable(F.col("a"))).collect()]
    assert got[0] == got[1] and list(json.loads(got[0])) == sorted(O.COMPARED) and json.loads(got[0])["unit"] is None


def test_generator_with_a_client(spark):
    q = spark.createDataFrame([(1, "Frage eins"), (2, "Frage zwei"), (3, "Frage drei")], "query_id long, text string")
    h = spark.createDataFrame([(1, 1, "c1", "Der Umsatz stieg kräftig"), (2, 1, "c2", "egal")], "query_id long, rank int, chunk_id string, text string")

    def complete(system, user):
        if "zwei" in user:
            raise RuntimeError("down")
        return 'so: {"answer": "Umsatz stieg kaum", "passage": 1}'

    got = {r["query_id"]: (r["text"], r["chunk_id"], round(r["support"], 3)) for r in G.generate(q, h, complete).collect()}
    assert got == {1: ("Umsatz stieg kaum", "c1", 0.667), 2: ("", None, 0.0), 3: ("", None, 0.0)}
    texts = spark.createDataFrame([("a", "zwei wörter")], "chunk_id string, text string")
    assert G.embed(texts, lambda ts: [[float(len(t))] for t in ts], prefix="p: ").first()["embedding"] == [14.0]
    with pytest.raises(Exception, match="window"):
        G.embed(texts, lambda ts: [[0.0] for _ in ts], window=2, count=lambda t: len(t.split())).collect()


def test_values_per_key_and_first_fact(spark):
    f = facts(spark, [("d", "c", "p", "1"), ("d", "c", "p", "1.0"), ("d", "c", "q", "1"), ("d", "c", "q", "2"), ("d", "", "q", "2")])
    assert {(r["period"], r["n_values"], r["n_facts"]) for r in L.values_per_key(f).collect()} == {("p", 1, 2), ("q", 2, 2)}
    assert {r["fact_id"] for r in L.first_facts(f).collect()} == {"f000000", "f000002"}
    assert V.DECIMAL == "decimal(38,10)"


def test_unions_headers_and_overlaps(spark):
    span = "span struct<page:int,x0:double,y0:double,x1:double,y1:double>"
    rows = spark.createDataFrame([("a", 1, (0, 0.1, 0.1, 0.2, 0.2)), ("a", 2, (0, 0.15, 0.3, 0.4, 0.5)), ("b", 3, (1, 0.0, 0.0, 0.1, 0.1))], f"k string, seq int, {span}")
    got = {r["k"]: (tuple(r["span"]), r["n"]) for r in citation.union_spans(rows, ["k"]).collect()}
    assert got == {"a": ((0, 0.1, 0.1, 0.4, 0.5), 2), "b": ((1, 0.0, 0.0, 0.1, 0.1), 1)}
    with pytest.raises(Exception, match="several pages"):
        citation.union_spans(rows.withColumn("k", F.lit("x")), ["k"]).collect()
    words = spark.createDataFrame([("d", " 12,5 ", (0, 0.1, 0.1, 0.2, 0.2)), ("d", "13", (0, 0.5, 0.5, 0.6, 0.6))], f"document_id string, text string, {span}")
    facts = spark.createDataFrame([("d", "f1", "12,5", (0, 0.1, 0.1, 0.2, 0.2)), ("d", "f2", "99", (0, 0.0, 0.0, 1.0, 1.0))], f"document_id string, fact_id string, displayed string, {span}")
    found = L.found_places(facts, words)
    assert [r["fact_id"] for r in found.collect()] == ["f1"]
    assert {r["fact_id"]: r["best"] for r in L.best_overlaps(facts, found, ["document_id", "fact_id"]).collect()} == {"f1": 1.0, "f2": 0.0}


def test_deltas_to_the_rung_before(spark):
    rows = spark.createDataFrame([(1, "s", 0.5), (2, "s", 0.75), (3, "s", 0.5), (1, "t", 1.0)], "rung int, stratum string, mrr double")
    assert {(r["stratum"], r["rung"]): r["d_mrr"] for r in E.deltas(rows, ["mrr"]).collect()} == {("s", 1): None, ("s", 2): 0.25, ("s", 3): -0.25, ("t", 1): None}
