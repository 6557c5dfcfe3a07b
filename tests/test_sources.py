import io
import json
import zipfile
from decimal import Decimal

from pyspark.sql import functions as F

from evidentia.operators import ledger as L
from evidentia.sources import filings, pages, stores
from evidentia.streaming import jobs

REPORT = """<?xml version="1.0"?><!DOCTYPE html SYSTEM "http://nowhere.invalid/x.dtd">
<html xmlns:ix="i" xmlns:xbrli="x"><head><title>T&nbsp;1</title></head><body>
<xbrli:context id="c1"><xbrli:period><xbrli:startDate>2022-01-01</xbrli:startDate><xbrli:endDate>2022-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="c2"><xbrli:period><xbrli:instant>2022-12-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:unit id="u"><xbrli:divide><xbrli:measure>iso4217:EUR</xbrli:measure><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:divide></xbrli:unit>
<table><tr><td>Umsatz<br>netto<td><ix:nonFraction name="c:Rev" contextRef="c1" unitRef="u" scale="3">1.<b>204</b></ix:nonFraction> tail</td></tr>
<tr><td>(<ix:nonFraction name="c:Cost" contextRef="c2" sign="-" scale="3" format="ixt:num-comma-decimal">870,5</ix:nonFraction>)</td></tr>
<tr><td><ix:nonFraction name="c:Dash" contextRef="c9">-</ix:nonFraction><p>unclosed</tr>
<tr><td><ix:nonFraction name="c:Last" contextRef="c9">7</ix:nonFraction></td></tr></table></body></html>"""


def test_report_scan(spark):
    df = spark.createDataFrame([("d", REPORT.encode()), ("bad", b"\xff\xfe<<<"), ("none", None)], "document_id string, content binary")
    got = {r["fact_id"]: r for r in filings.facts(df).collect()}
    assert set(got) == {"f000000", "f000001", "f000003"}
    a, b, c = (got[k] for k in sorted(got))
    assert (a["concept"], a["displayed"], a["value"], a["unit"], a["period"]) == ("c:Rev", "1.204", Decimal("1204000"), "EUR/shares", "2022-01-01/2022-12-31")
    assert (b["value"], b["sign"], b["period"]) == (Decimal("-870500"), -1, "instant:2022-12-31")
    assert (c["unit"], c["period"], c["value"]) == ("", "", Decimal("7"))


def test_stamp_changes_nothing_else():
    out = filings.stamp(REPORT)
    assert out.count(filings.PROBE + "/f00000") == 4 and filings.STYLE + "</head>" in out and "</ix:nonFraction></a> tail" in out
    plain = out.replace(filings.STYLE, "")
    for i in range(4):
        plain = plain.replace(f'<a href="{filings.PROBE}/f{i:06d}">', "")
    assert plain.replace("</a>", "") == REPORT


def archive(**files):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return raw.getvalue()


def test_packages(spark):
    rows = [("zip", archive(small_dot_html="x", rep__big_dot_XHTML="y" * 50, lab_dot_xml="<a/>", skip_dot_exe="z")), ("bare", b"<html/>"), ("empty", archive(a_dot_txt="q")), ("broken", b"PKnope")]
    got = {}
    for r in filings.unpack(spark.createDataFrame(rows, "filing_id string, content binary")).collect():
        got.setdefault(r["filing_id"], []).append((r["name"], r["is_report"], None if r["content"] is None else bytes(r["content"])))
    assert sorted(got["zip"]) == [("lab.xml", False, b"<a/>"), ("report.xhtml", True, b"y" * 50)]
    assert got["bare"] == [("report.xhtml", True, b"<html/>")] and "empty" not in got and got["broken"] == [(None, False, None)]


def test_listing(spark):
    page = json.dumps({"data": [{"id": "1", "attributes": {"package_url": "/p.zip", "report_url": "/r"}}, {"id": "2", "attributes": {"package_url": "", "report_url": "https://x/r"}}, {"id": "3", "attributes": {}}]})
    found = filings.candidates(spark.createDataFrame([(page,), ("not json",)], "value string"), "https://b")
    assert {(r["filing_id"], r["url"]) for r in found.collect()} == {("1", "https://b/p.zip"), ("2", "https://x/r"), ("3", None)}
    held = spark.createDataFrame([("1",)], "filing_id string")
    assert [r["filing_id"] for r in filings.to_fetch(found, held, 5).collect()] == ["2"] and filings.to_fetch(found, held, 1).count() == 0


LINKBASE = f"""<link:linkbase xmlns:link="l" xmlns:xlink="x"><link:loc xlink:href="a.xsd#ifrs-full_Revenue" xlink:label="loc1"/>
<link:label xlink:label="t1" xml:lang="de" xlink:role="{L.ROLES[0]}">Umsatz &amp; mehr</link:label><link:label xlink:label="t2" xml:lang="en" xlink:role="{L.ROLES[0]}">Revenue</link:label>
<link:labelArc xlink:from="loc1" xlink:to="t1"/><link:labelArc xlink:from="loc1" xlink:to="t2"/></link:linkbase>"""


def test_linkbase_scan_and_merge(spark):
    files = spark.createDataFrame([("b_lab.xml", LINKBASE.replace("Umsatz", "Spät").encode()), ("a_lab.xml", LINKBASE.encode()), ("x.xml", b"junk")], "file string, content binary")
    every = L.linkbase_labels(*filings.linkbases(files))
    assert {(r["file"], r["text"]) for r in every.collect()} == {("a_lab.xml", "Umsatz & mehr"), ("b_lab.xml", "Spät & mehr")}
    assert [tuple(r) for r in L.merge_labels(every).collect()] == [("ifrs-full:Revenue", "Umsatz & mehr")]
    assert L.linkbase_labels(*filings.linkbases(files), language="en").count() == 2


def test_pages_with_a_reader(spark):
    def reader(raw):
        if raw == b"bad":
            raise ValueError("broken")
        yield 0, "block", " Text ", 10.0, 20.0, 50.0, 40.0, 100.0, 200.0
        yield 1, "word", "1.204", 0.0, 0.0, 50.0, 20.0, 100.0, 200.0
        yield 1, "link", filings.PROBE + "/f000007", 0.0, 0.0, 50.0, 20.0, 100.0, 200.0

    p = pages.read_pages(spark.createDataFrame([("d", b"ok"), ("e", b"bad")], "document_id string, content binary"), reader)
    assert [(r["text"], tuple(r["span"])) for r in pages.blocks(p).collect()] == [("Text", (0, 0.1, 0.1, 0.5, 0.2))]
    assert [r["fact_id"] for r in pages.located(p).collect()] == ["f000007"] and [r["page"] for r in pages.words(p).collect()] == [1]
    assert [tuple(r) for r in pages.page_count(p).collect()] == [("d", 2)] and "broken" in p.where("document_id = 'e'").first()["error"]


def test_stores(spark, tmp_path):
    fact = ("f1", 0, "c", "1,5", Decimal("1.5"), 0, 1, "EUR", "ctx", "p", (0, 0.0, 0.0, 1.0, 1.0))
    one = spark.createDataFrame([("d1", "h", "v", 1.0, {"c": "Label"}, [fact], [])], stores.LEDGER)
    stores.write_ledgers(one, f"{tmp_path}/ledgers")
    back = stores.read_ledgers(spark, f"{tmp_path}/ledgers")
    assert stores.ledger_facts(back).first()["value"] == Decimal("1.5") and [tuple(r) for r in stores.ledger_labels(back).collect()] == [("d1", "c", "Label")]
    assert stores.empty_corpus(spark).count() == 0
    log = f"{tmp_path}/audit"
    assert stores.read_audit(spark, log).count() == 0
    record = spark.createDataFrame([("r1", "t", "q", "d1", "s", "v", "1", None)], stores.AUDIT)
    stores.append_audit(record, log)
    stores.append_audit(record.withColumn("record_id", F.lit("r2")), log)
    assert stores.read_audit(spark, log).count() == 2 and stores.find_record(stores.read_audit(spark, log), "r2").count() == 1
    pairs = spark.createDataFrame([("d", 0, "s, \"x\"", "5", 1, "f", "c", Decimal("5"), False), ("d", 1, "t", "6", 1, "g", "c", Decimal("6"), True)],
                                  "document_id string, seq int, sentence string, mention string, page int, fact_id string, concept string, value decimal(38,10), names_concept boolean")
    assert stores.write_review_csv(pairs, f"{tmp_path}/review") and not stores.write_review_csv(pairs.limit(0), f"{tmp_path}/none")
    got = stores.read_decisions(spark, f"{tmp_path}/review").collect()
    assert {(r["fact_id"], r["page"]) for r in got} == {("f", 1), ("g", 1)}


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a" if i % 3 else "b", float(i), i) for i in range(60)]
    df = spark.createDataFrame(rows, "caller string, ts double, event_id long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    from evidentia.operators import operations as O

    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = {(r["caller"], r["event_id"], r["accepted"], r["remaining"]) for r in jobs.run_limited(stream, 2, 5.0).collect()}
    assert got == {(r["caller"], r["event_id"], r["accepted"], r["remaining"]) for r in O.rate_limit(df, 2, 5.0).collect()}
    as_answers = lambda d: d.select(F.col("caller").alias("route"), F.lit("answered").alias("status"), F.col("ts").alias("latency_ms"))
    assert sorted(map(tuple, jobs.run_counters(as_answers(stream)).collect())) == sorted(map(tuple, O.counters(as_answers(df)).collect()))


def test_broken_archives_are_rows_with_an_error(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("r.xhtml", "<html>" + "a b c " * 500 + "</html>")
    raw = bytearray(held.getvalue())
    raw[60:90] = bytes(30)  # the deflate stream
    rows = spark.createDataFrame([("a", bytes(raw)), ("b", held.getvalue()), ("c", b"PK\x03\x04 no zip")], "filing_id string, content binary")
    got = {r["filing_id"]: r for r in filings.unpack(rows).collect()}
    assert got["a"]["error"] and got["c"]["error"] and got["b"]["error"] is None and got["b"]["is_report"]


def test_stamp_of_end_tags_with_white_space():
    got = filings.stamp('<html><body><ix:nonFraction name="a">1</ix:nonFraction >.</body></html>')
    assert '<ix:nonFraction name="a">1</ix:nonFraction ></a>.' in got


def test_declared_encodings(spark):
    text = '<?xml version="1.0" encoding="{}"?><html><ix:nonFraction name="n:Umsätze" contextRef="c">12</ix:nonFraction></html>'
    rows = [(n, text.format(n).encode(n)) for n in ("iso-8859-1", "utf-8", "utf-16")] + [("none", text.format("no-such").encode())]
    got = {r["document_id"]: r["concept"] for r in filings.facts(spark.createDataFrame(rows, "document_id string, content binary")).collect()}
    assert got == {n: "n:Umsätze" for n in ("iso-8859-1", "utf-8", "utf-16", "none")}
