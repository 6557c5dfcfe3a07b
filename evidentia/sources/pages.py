"""Page content of PDF files: blocks, words, links and text searches. The reading library is optional and passed in.

A reader is a callable from a file's bytes to rows; ``mupdf_reader`` makes one where PyMuPDF is installed. Without a
reader, chunking.line_blocks turns plain text into blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evidentia.functions import values as V
from evidentia.sources.filings import PROBE

#: page, kind (block, word, link), text (a link's address), x0, y0, x1, y1, width, height of the page
Row = tuple[int, str, str, float, float, float, float, float, float]


def mupdf_reader(content: bytes) -> Iterator[Row]:
    """All blocks, words and links of a PDF, page by page, in reading order."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as document:
        for number, page in enumerate(document):
            size = page.rect.width, page.rect.height
            for b in page.get_text("blocks", sort=True):
                yield (number, "block", b[4], *b[:4], *size)
            for w in page.get_text("words"):
                yield (number, "word", w[4], *w[:4], *size)
            for link in page.get_links():
                yield (number, "link", link.get("uri") or "", *tuple(link["from"]), *size)


def read_pages(files: DataFrame, reader: Callable[[bytes], Iterator[Row]] = mupdf_reader) -> DataFrame:
    """document_id, seq, kind, text, span, error of files(document_id, content). A file that can't be read gives one row with its error."""
    kind = files.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["document_id", "seq", "page", "kind", "text", "x0", "y0", "x1", "y1", "width", "height", "error"]
        for x in batches:
            for doc, raw in zip(x["document_id"], x["content"], strict=True):
                try:
                    rows = [(doc, i, *r, None) for i, r in enumerate(reader(bytes(raw)))]
                except Exception as e:  # noqa: BLE001  one bad file must not fail the others
                    rows = [(doc, 0, None, "error", "", None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pd.DataFrame(rows, columns=columns).astype({"page": "Int32"})

    raw = files.select("document_id", "content").mapInPandas(run, f"document_id {kind}, seq int, page int, kind string, text string, x0 double, y0 double, x1 double, y1 double, width double, height double, error string")
    box = F.when(F.col("error").isNull(), V.from_rect(*[F.col(c) for c in ("page", "x0", "y0", "x1", "y1", "width", "height")]))
    return raw.select("document_id", "seq", "kind", "text", box.alias("span"), "error")


def blocks(pages: DataFrame) -> DataFrame:
    """document_id, ord, text, span of the blocks with text."""
    return pages.where("kind = 'block' AND trim(text) <> ''").select("document_id", F.col("seq").alias("ord"), F.trim("text").alias("text"), "span")


def words(pages: DataFrame) -> DataFrame:
    return pages.where("kind = 'word'").select("document_id", F.col("span.page").alias("page"), F.col("seq").cast("long").alias("seq"), "text", "span")


def page_count(pages: DataFrame) -> DataFrame:
    return pages.where("error IS NULL").groupBy("document_id").agg((F.max("span.page") + 1).alias("pages"))


def located(pages: DataFrame) -> DataFrame:
    """document_id, fact_id, seq, span: where the anchors of filings.stamp came to lie."""
    links = pages.where(F.col("kind") == "link").where(F.col("text").startswith(f"{PROBE}/"))
    return links.select("document_id", F.substring("text", len(PROBE) + 2, 1 << 20).alias("fact_id"), "seq", "span")
