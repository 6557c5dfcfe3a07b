"""Text functions as column expressions; nulls count as empty text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What a token, a word, a figure and a sentence end are, and limits.
TOKEN = r"[\p{L}\p{N}]+(?:[.,][\p{L}\p{N}]+)*"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
LONG_WORD = r"[\p{L}\p{Nl}\p{No}]{3,}"
SENTENCE_END = r"(?<=[.!?])\s+"
FIGURE_UNIT = r"-?\p{Nd}[\p{Nd}.,]*(?U:\s)*(?:%|Mio\.?|Mrd\.?|Tsd\.?|TEUR|EUR|€)?"
FIGURE = r"-?\p{Nd}[\p{Nd}.,]*"
NUMERIC_WORD = r"^-?\(?\p{Nd}[\p{Nd}.,]*\)?$"
TOKENS_PER_WORD = 1.6
PROSE_CHARS, PROSE_WORDS, PROSE_DIGITS, SPECIFIC_DIGITS, NUMERIC_DIGITS = 60, 8, 0.2, 4, 2
LABEL_SHARE = 0.7

# Question words that name no figure.
FRAMING = (
    "wie hoch war waren ist sind der die das des dem den ein eine einer von vom und oder als aus auf bei mit fur für zum zur per sich wurde "
    "wurden betrug betrugen hohe höhe wert geschaftsjahr geschäftsjahr jahr jahre zeitraum stichtag bis what was the for and how much value"
).split()

# Words of a sentence about a figure that a table row doesn't have.
NARRATIVE = (
    "die der das und von mit auf sich sowie durch für ist sind war waren wird werden wurde wurden hat haben betrug betragen beträgt stieg "
    "stiegen sank sanken lag lagen belief beliefen erhöhte erhöhten reduzierte reduzierten gegenüber infolge aufgrund somit damit konnte "
    "konnten enthalten ergibt resultiert entspricht"
).split()

# Scale words after and before a figure.
SCALES_AFTER = ((r"(?iU)^[\s.]*(?:Mrd|Milliarden)\b", 1_000_000_000), (r"(?iU)^[\s.]*(?:Mio|Millionen)\b", 1_000_000), (r"(?iU)^[\s.]*(?:Tsd|Tausend)\b", 1_000))
SCALES_BEFORE = (
    (r"(?iU)\bMrd\.?\s*(?:EUR|€)?\s*$", 1_000_000_000),
    (r"(?iU)\bMio\.?\s*(?:EUR|€)?\s*$", 1_000_000),
    (r"(?iU)\b(?:TEUR|Tsd)\.?\s*(?:EUR|€)?\s*$", 1_000),
)
ALL_SCALES = (1, 1_000, 1_000_000, 1_000_000_000)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and digits, with points and commas kept inside."""
    return F.transform(F.regexp_extract_all(_text(text), F.lit(TOKEN), F.lit(0)), F.lower)


def word_count(text: Column) -> Column:
    """Runs without white space (Unicode)."""
    return F.regexp_count(_text(text), F.lit(r"(?U)\S+"))


def token_estimate(words: Column) -> Column:
    return F.floor(words.cast("double") * F.lit(TOKENS_PER_WORD)).cast("int")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(_text(text), r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    return F.split(_text(text), SENTENCE_END)


def sentence_at(text: Column, position: Column) -> Column:
    """The trimmed sentence that holds a position from 0; separators count as one character. Past the end: the whole text."""
    start = F.struct(F.lit(0).alias("from"), F.lit(None).cast("string").alias("hit"))

    def step(s: Column, piece: Column) -> Column:
        end = s["from"] + F.length(piece)
        inside = s["hit"].isNull() & position.between(s["from"], end)
        return F.struct((end + 1).alias("from"), F.when(inside, piece).otherwise(s["hit"]).alias("hit"))

    return F.trim(F.coalesce(F.aggregate(sentences(text), start, step)["hit"], _text(text)))


def strip_figures(sentence: Column) -> Column:
    """The sentence without figures and their units, as a query."""
    return F.regexp_replace(collapse(F.regexp_replace(_text(sentence), FIGURE_UNIT, " ")), r"^[ ,.;:]+|[ ,.;:]+$", "")


def humanise(concept: Column) -> Column:
    """ns:CamelCase as lower-case words."""
    return collapse(F.lower(F.regexp_replace(F.substring_index(_text(concept), ":", -1), r"(?<!^)(?=[A-Z])", " ")))


def long_tokens(text: Column, more_than: int) -> Column:
    """Tokens of more characters than that, repeats kept."""
    return F.filter(tokenize(text), lambda t: F.length(t) > more_than)


def content_terms(question: Column) -> Column:
    """Distinct tokens that name something: over two characters, no question frame, no leading digit."""
    framing = words_array(FRAMING)
    return F.array_distinct(F.filter(tokenize(question), lambda t: (F.length(t) > 2) & ~F.array_contains(framing, t) & ~t.rlike(r"^\p{Nd}")))


def support(terms: Column, text: Column) -> Column:
    """Share of distinct terms among the tokens of text; 0 without terms."""
    distinct = F.array_distinct(terms)
    return F.when(F.size(distinct) > 0, F.size(F.array_intersect(distinct, tokenize(text))) / F.size(distinct)).otherwise(F.lit(0.0))


def grounding(answer: Column, passage: Column) -> Column:
    return support(long_tokens(answer, 3), passage)


def names_concept(sentence: Column, label: Column) -> Column:
    """LABEL_SHARE of the label's terms of four characters on, repeats counted, are among the sentence's tokens."""
    terms, said = long_tokens(label, 3), tokenize(sentence)
    return F.coalesce(F.size(F.filter(terms, lambda t: F.array_contains(said, t))) / F.nullif(F.size(terms), F.lit(0)) >= LABEL_SHARE, F.lit(False))


def is_prose(text: Column) -> Column:
    t = _text(text)
    digits = F.regexp_count(t, F.lit(r"\p{Nd}"))
    return (F.length(t) >= PROSE_CHARS) & (F.regexp_count(t, F.lit(LONG_WORD)) >= PROSE_WORDS) & (digits < PROSE_DIGITS * F.length(t))


def is_specific(mention: Column) -> Column:
    return F.regexp_count(_text(mention), F.lit(r"\p{Nd}")) >= SPECIFIC_DIGITS


def looks_numeric(word: Column) -> Column:
    w = F.regexp_replace(_text(word), r"(?U)^\s+|\s+$", "")
    return w.rlike(NUMERIC_WORD) & (F.regexp_count(w, F.lit(r"\p{Nd}")) >= NUMERIC_DIGITS)


def stems(text: Column) -> Column:
    """Distinct lower-case beginnings, six characters, of words longer than three."""
    words = F.filter(F.regexp_extract_all(_text(text), F.lit(LETTERS), F.lit(0)), lambda w: F.length(w) > 3)
    return F.array_distinct(F.transform(words, lambda w: F.left(F.lower(w), F.lit(6))))


def narrative_score(sentence: Column, label: Column) -> Column:
    """Label overlap x sparsity of figures x narrative words; 0 for an empty label or under six words."""
    words = F.regexp_extract_all(_text(sentence), F.lit(LETTERS), F.lit(0))
    numbers = F.regexp_count(_text(sentence), F.lit(FIGURE))
    own = stems(label)
    overlap = F.size(F.array_intersect(own, stems(sentence))) / F.size(own)
    sparse = F.greatest(F.lit(0.0), 1 - 3 * numbers / (numbers + F.size(words)))
    told = F.size(F.array_intersect(F.transform(words, F.lower), words_array(NARRATIVE))) / 3
    return F.when((F.size(own) == 0) | (F.size(words) < 6), 0.0).otherwise(overlap * sparse * F.least(F.lit(1.0), told))


def scales_for(before: Column, after: Column) -> Column:
    """array<bigint>: the one scale that the words behind or before a figure state, else all four."""
    out = F.array(*[F.lit(s).cast("long") for s in ALL_SCALES])
    for pattern, scale in reversed(SCALES_AFTER + SCALES_BEFORE):
        side = after if pattern.startswith("(?iU)^") else before
        out = F.when(_text(side).rlike(pattern), F.array(F.lit(scale).cast("long"))).otherwise(out)
    return out


def prompt(question: Column, passages: Column) -> Column:
    """Numbered fenced passages (array<string>), then the question."""
    fenced = F.transform(passages, lambda p, i: F.concat(F.lit("<passage number=\""), (i + 1).cast("string"), F.lit("\">\n"), p, F.lit("\n</passage>")))
    return F.concat(F.array_join(fenced, "\n\n"), F.lit("\n\nQuestion: "), question)


def parse_reply(reply: Column) -> Column:
    """struct<answer string, passage int> of a model's reply with a JSON object in it.

    Not JSON, no object, or an answer that is no string: ('', 0). A passage that is a boolean, null or no number: 0.
    """
    v = F.try_parse_json(F.nullif(F.regexp_extract(_text(reply), r"(?s)\{.*\}", 0), F.lit("")))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    answer = F.when(kind("$.answer") == "STRING", F.trim(F.try_variant_get(v, "$.answer", "string")))
    numeric = kind("$.passage").rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT|SMALLINT|TINYINT)$")
    raw = F.try_variant_get(v, "$.passage", "string")
    passage = F.when(numeric, raw.try_cast("double").cast("int")).when((kind("$.passage") == "STRING") & F.trim(raw).rlike(r"^[+-]?\d+$"), F.trim(raw).try_cast("int"))
    return F.struct(F.coalesce(answer, F.lit("")).alias("answer"), F.when(answer.isNull(), 0).otherwise(F.coalesce(passage, F.lit(0))).alias("passage"))
