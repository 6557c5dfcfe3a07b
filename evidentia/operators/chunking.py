"""Blocks of text and their packing into chunks.

Packing is an ordered fold over one document's blocks, so the blocks of a document meet in one
row; documents are spread over all tasks. A block is struct<ord int, text string, words int, span>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidentia.functions import text as T, values as V

LINES_PER_PAGE = 40


def line_blocks(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """document_id, ord, text, span: every nonblank line as a block, LINES_PER_PAGE to a page, in reading order."""
    lines = documents.select(F.col(id_column).alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text")).where(F.length(F.trim("text")) > 0)
    top = (F.col("ord") % LINES_PER_PAGE) / F.lit(float(LINES_PER_PAGE))
    box = V.span(F.floor(F.col("ord") / LINES_PER_PAGE), F.lit(0.1), top, F.lit(0.9), top + 1.0 / LINES_PER_PAGE)
    return lines.select("document_id", "ord", "text", box.alias("span"))


def budgets(target_tokens: int, overlap_tokens: int) -> tuple[int, int]:
    """Words of a chunk and of its overlap."""
    if target_tokens <= 0 or not 0 <= overlap_tokens < target_tokens:
        raise ValueError("target_tokens must be positive, and overlap_tokens from 0 to less than it")
    return max(1, int(target_tokens / T.TOKENS_PER_WORD)), int(overlap_tokens / T.TOKENS_PER_WORD)


def split_oversized(text: Column, words: int) -> Column:
    """array<string>: the text itself, or windows of so many words if it has more."""
    all_words = F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))
    starts = F.sequence(F.lit(0), F.size(all_words) - 1, F.lit(words))
    return F.when(F.size(all_words) > words, F.transform(starts, lambda i: F.array_join(F.slice(all_words, i + 1, F.lit(words)), " "))).otherwise(F.array(text))


def pieces(blocks: DataFrame, words: int) -> DataFrame:
    """blocks with oversized ones split; every piece keeps its block's ord and span."""
    cut = blocks.select("document_id", "ord", "span", F.posexplode(split_oversized(F.col("text"), words)).alias("piece", "text"))
    return cut.withColumn("words", T.word_count(F.col("text")).cast("int"))


def pack(blocks: DataFrame, target_tokens: int = 600, overlap_tokens: int = 80) -> DataFrame:
    """chunk_id, document_id, ord, text, spans, token_count, first_block, last_block of blocks(document_id, ord, text, span).

    Whole blocks are packed in order while they fit the budget of words. A new chunk starts with as many whole trailing blocks of
    the last as fit the overlap, unless they would break the budget.
    """
    budget, overlap = budgets(target_tokens, overlap_tokens)
    each = pieces(blocks, budget)
    kind = "array<struct<ord:int,piece:int,words:int,text:string,span:struct<page:int,x0:double,y0:double,x1:double,y1:double>>>"
    docs = each.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", "piece", "words", "text", "span"))).alias("b"))
    # the fold works on positions alone; texts are sliced out of the array afterwards
    words = F.transform("b", lambda x: x["words"])
    zero = F.struct(F.array().cast("array<struct<a:int,z:int>>").alias("done"), F.lit(1).alias("a"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(s: Column, w: Column) -> Column:
        full = (s["i"] >= s["a"]) & (s["n"] + w > budget)
        behind = F.reverse(F.slice(F.col("_w"), s["a"], s["i"] - s["a"] + 1))
        kept = F.aggregate(behind, F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"), F.lit(True).alias("on")), lambda c, v: F.when(
            c["on"] & (c["n"] + v <= overlap), F.struct((c["k"] + 1).alias("k"), (c["n"] + v).alias("n"), F.lit(True).alias("on"))).otherwise(
            F.struct(c["k"].alias("k"), c["n"].alias("n"), F.lit(False).alias("on"))))
        keep = kept["n"] + w <= budget
        i = s["i"] + 1
        closed = F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["i"].alias("z"))))
        new = F.struct(closed.alias("done"), F.when(keep, i - kept["k"]).otherwise(i).alias("a"), (F.when(keep, kept["n"]).otherwise(0) + w).alias("n"), i.alias("i"))
        return F.when(full, new).otherwise(F.struct(s["done"].alias("done"), s["a"].alias("a"), (s["n"] + w).alias("n"), i.alias("i")))

    def finish(s: Column) -> Column:
        return F.when(s["i"] >= s["a"], F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["i"].alias("z"))))).otherwise(s["done"])

    ranges = docs.withColumn("_w", words).withColumn("r", F.aggregate("_w", zero, step, finish))
    cut = ranges.select("document_id", F.posexplode(F.transform("r", lambda r: F.slice(F.col("b"), r["a"], r["z"] - r["a"] + 1))).alias("ord", "g")).withColumn("g", F.col("g").cast(kind))
    text = F.array_join(F.transform("g", lambda x: x["text"]), "\n")
    out = cut.withColumn("text", text)
    return out.select(V.chunk_id(F.col("document_id"), F.col("ord"), F.col("text")).alias("chunk_id"), "document_id", "ord", "text", F.transform("g", lambda x: x["span"]).alias("spans"),
                      T.token_estimate(T.word_count(F.col("text"))).alias("token_count"), F.col("g")[0]["ord"].alias("first_block"), F.element_at("g", -1)["ord"].alias("last_block"))


def pages(spans: Column) -> Column:
    """Distinct pages of a chunk's spans, ascending."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["page"])))
