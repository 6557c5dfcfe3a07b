"""Filings: listing, packages, Inline XBRL reports, label linkbases. Files are read by Spark; each is one row, parsed in its task.

Reports and linkbases are untrusted: they are scanned by a tolerant tag scanner that fetches nothing and never fails on bad markup.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidentia.functions import values as V

# File kinds of a package and its size limit.
REPORTS, KEPT = (".xhtml", ".html"), (".css", ".png", ".jpg", ".jpeg", ".svg", ".woff2", ".xml", ".xsd")
MAX_BYTES = 40 * 1024 * 1024
MAX_UNPACKED = 20 * MAX_BYTES
#: Where the anchors that mark facts lead: nowhere.
PROBE = "https://facts.evidentia.invalid"
DECLARED = re.compile(rb"""<\?xml[^>]*encoding\s*=\s*["']([A-Za-z0-9._-]+)|<meta[^>]*charset\s*=\s*["']?([A-Za-z0-9._-]+)""", re.I)
STYLE = f'<style type="text/css">a[href^="{PROBE}/"] {{ all: unset !important; }}</style>'


def resolve_url(url: Column, base: str) -> Column:
    """Null for empty, else the address, behind base where it isn't absolute."""
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit(None).cast("string")).when(url.startswith("http"), url).otherwise(F.concat(F.lit(base), url))


def candidates(pages: DataFrame, base: str) -> DataFrame:
    """filing_id, url, from pages(value): replies of a listing service, {"data": [{"id", "attributes": {"package_url", "report_url"}}]}. The package comes before the report."""
    kind = "struct<data:array<struct<id:string,attributes:struct<package_url:string,report_url:string>>>>"
    each = pages.select(F.explode(F.from_json("value", kind)["data"]).alias("d"))
    return each.select("d.id", F.coalesce(resolve_url(F.col("d.attributes.package_url"), base), resolve_url(F.col("d.attributes.report_url"), base)).alias("url")).withColumnRenamed("id", "filing_id")


def to_fetch(found: DataFrame, held: DataFrame, count: int) -> DataFrame:
    """What is still to be fetched until count filings are held: found(filing_id, url[, size]) without held(filing_id) or sizes over MAX_BYTES."""
    rest = found.where("url IS NOT NULL").join(held.select("filing_id"), "filing_id", "left_anti")
    if "size" in found.columns:
        rest = rest.where(F.coalesce("size", F.lit(0)) <= MAX_BYTES)
    return rest.orderBy("filing_id").limit(max(0, count - held.count()))


def unpack(archives: DataFrame) -> DataFrame:
    """filing_id, name, is_report, content, error of archives(filing_id, content). What is no zip is the report itself; of a zip the largest page is.

    An archive that can't be read, or that would unpack to more than MAX_UNPACKED bytes, is a row with its error.
    """
    kind = archives.schema["filing_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for filing, raw in zip(x["filing_id"], x["content"], strict=True):
                rows = []
                try:
                    if raw[:2] != b"PK":
                        rows.append((filing, "report.xhtml", True, bytes(raw), None))
                    else:
                        with zipfile.ZipFile(io.BytesIO(raw)) as z:
                            files = [i for i in z.infolist() if not i.is_dir()]
                            if sum(i.file_size for i in files) > MAX_UNPACKED:
                                raise zipfile.BadZipFile(f"unpacks to more than {MAX_UNPACKED} bytes")
                            pages = [i for i in files if i.filename.lower().endswith(REPORTS)]
                            if pages:
                                main = max(pages, key=lambda i: i.file_size)
                                rows.append((filing, "report.xhtml", True, z.read(main), None))
                                rows += [(filing, i.filename.rpartition("/")[2], False, z.read(i), None) for i in files if i is not main and i.filename.lower().endswith(KEPT)]
                except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError) as e:
                    rows = [(filing, None, False, None, str(e))]
                if rows:
                    yield pd.DataFrame(rows, columns=["filing_id", "name", "is_report", "content", "error"])

    return archives.select("filing_id", "content").mapInPandas(run, f"filing_id {kind}, name string, is_report boolean, content binary, error string")


def decoded(raw: bytes) -> str:
    """Text of a report or linkbase by its byte order mark, else the encoding that its head declares, else UTF-8; what can't be read is replaced."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    said = DECLARED.search(raw[:1024])
    try:
        return raw.decode((said.group(1) or said.group(2)).decode("ascii") if said else "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def _local(tag: str) -> str:
    return tag.rpartition(":")[2]


class _Scan(HTMLParser):
    """Facts, contexts and units of a report; names are compared without prefix and case."""

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=True)
        self.facts: list[dict] = []
        self.contexts: dict[str, dict[str, str]] = {}
        self.units: dict[str, list[str]] = {}
        self.marks: list[tuple[int, str]] = []
        self._text = text
        self._open: list[int] = []
        self._context = self._unit = self._field = None
        self._lines = [0]
        for i, c in enumerate(text):
            if c == "\n":
                self._lines.append(i + 1)
        self.head: int | None = None
        self.feed(text)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self._lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        name, a = _local(tag), {k: v or "" for k, v in attrs}
        if name == "nonfraction":
            self._open.append(len(self.facts))
            self.facts.append(a | {"text": ""})
            self.marks.append((self._at(), f'<a href="{PROBE}/f{len(self.facts) - 1:06d}">'))
        elif name == "context":
            self._context = a.get("id")
            self.contexts.setdefault(self._context, {})
        elif name == "unit":
            self._unit = a.get("id")
        elif name in ("instant", "startdate", "enddate", "measure"):
            self._field = (name, "")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if _local(tag) == "nonfraction":
            self._open.pop()
            self.marks.append((self._at() + len(self.get_starttag_text()), "</a>"))
        else:
            self.handle_endtag(tag)

    def handle_data(self, data):
        for i in self._open:
            self.facts[i]["text"] += data
        if self._field:
            self._field = (self._field[0], self._field[1] + data)

    def handle_endtag(self, tag):
        name = _local(tag)
        if name == "nonfraction" and self._open:
            self._open.pop()
            self.marks.append((self._text.find(">", self._at()) + 1 or len(self._text), "</a>"))
        elif name == "head" and self.head is None:
            self.head = self._at()
        elif name == "context":
            self._context = None
        elif name == "unit":
            self._unit = None
        elif self._field and name == self._field[0]:
            field, text = self._field[0], self._field[1].strip()
            if field == "measure":
                if self._unit and text:
                    self.units.setdefault(self._unit, []).append(text.rpartition(":")[2])
            elif self._context and text:
                self.contexts[self._context].setdefault(field, text)
            self._field = None

    def period(self, ref: str) -> str:
        c = self.contexts.get(ref, {})
        return f"instant:{c['instant']}" if "instant" in c else f"{c['startdate']}/{c['enddate']}" if "startdate" in c and "enddate" in c else ""


def stamp(report: str) -> str:
    """The report with every fact wrapped in an anchor that a renderer keeps, and a style that leaves the layout alone; all else stays to the letter."""
    scan = _Scan(report)
    marks = sorted(enumerate(scan.marks + ([(scan.head, STYLE)] if scan.head is not None else [])), key=lambda x: (x[1][0], x[0]))
    out, at = [], 0
    for _, (place, mark) in marks:
        out += [report[at:place], mark]
        at = place
    return "".join([*out, report[at:]])


def facts(reports: DataFrame) -> DataFrame:
    """document_id, fact_id, seq, concept, displayed, value, scale, sign, unit, context, period of reports(document_id, content binary).

    fact_id numbers all tagged elements of a report; those without a usable number are left out.
    """
    kind = reports.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for doc, raw in zip(x["document_id"], x["content"], strict=True):
                scan = _Scan(decoded(bytes(raw or b"")))
                rows = []
                for i, f in enumerate(scan.facts):
                    scale = f.get("scale", "")
                    rows.append((doc, f"f{i:06d}", i, f.get("name", ""), f["text"].strip(), f.get("format", ""), int(scale) if scale.lstrip("+-").isdigit() else 0, -1 if f.get("sign") == "-" else 1,
                                 "/".join(scan.units.get(f.get("unitref", ""), [])), f.get("contextref", ""), scan.period(f.get("contextref", ""))))
                if rows:
                    yield pd.DataFrame(rows, columns=["document_id", "fact_id", "seq", "concept", "displayed", "format", "scale", "sign", "unit", "context", "period"])

    raw = reports.select("document_id", "content").mapInPandas(run, f"document_id {kind}, fact_id string, seq int, concept string, displayed string, format string, scale int, sign int, unit string, context string, period string")
    base = V.normalise_number(F.col("displayed"), F.col("format"))
    valued = raw.withColumn("base", base).where("base IS NOT NULL")
    return valued.withColumn("value", V.fact_value(F.col("base"), F.col("scale"), F.col("sign"))).drop("base", "format")


class _Linkbase(HTMLParser):
    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=True)
        self.loc: list[tuple] = []
        self.arc: list[tuple] = []
        self.label: list[list] = []
        self._in = False
        self._n = 0
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = {_local(k): v or "" for k, v in attrs}
        name = _local(tag)
        self._n += 1
        if name == "loc":
            self.loc.append((self._n, a.get("label", ""), a.get("href", "")))
        elif name == "labelarc":
            self.arc.append((self._n, a.get("from", ""), a.get("to", "")))
        elif name == "label":
            self.label.append([self._n, a.get("label", ""), a.get("lang", ""), a.get("role", ""), ""])
            self._in = True

    def handle_data(self, data):
        if self._in:
            self.label[-1][4] += data

    def handle_endtag(self, tag):
        if _local(tag) == "label":
            self._in = False


def linkbases(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """loc, arc and label tables, as ledger.linkbase_labels takes them, of files(file, content binary)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for file, raw in zip(x["file"], x["content"], strict=True):
                p = _Linkbase(decoded(bytes(raw or b"")))
                rows = [(file, n, "loc", k, h, "", "", "") for n, k, h in p.loc] + [(file, n, "arc", a, b, "", "", "") for n, a, b in p.arc] + [(file, n, "label", k, "", lang, role, t.strip()) for n, k, lang, role, t in p.label]
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "seq", "what", "key", "other", "lang", "role", "text"])

    rows = files.select("file", "content").mapInPandas(run, "file string, seq int, what string, key string, other string, lang string, role string, text string")
    return (rows.where("what = 'loc' AND key <> ''").select("file", "seq", "key", F.col("other").alias("href")), rows.where("what = 'arc'").select("file", "seq", F.col("key").alias("from_key"), F.col("other").alias("to_key")),
            rows.where("what = 'label' AND key <> ''").select("file", "seq", "key", "lang", "role", "text"))


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, content of files, by Spark's reader of any store."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")
