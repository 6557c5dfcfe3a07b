"""SentencePiece encoding and decoding by a max-plus parallel scan.

The encoding of a text is its segmentation into vocabulary pieces with the largest summed score.
A text no longer than CHUNK is encoded in one go, and so is one of up to WHOLE chunks that falls
into words (see below), which need no states. Any longer one is cut into chunks of CHUNK
characters. At a chunk's border the only state is how many of the next chunk's first
characters the piece across the border has taken: 0 to the longest piece less one. Each chunk
yields the matrix of best scores from entry state to exit state. Matrices combine by the
associative (max, +) product: of BLOCK neighbours to a block, as a tree of pairs, and a document's
blocks give the states at their borders, from which follow those at the chunks' borders in each block.
With its entry and exit state known, every chunk is traced back by itself. Chunks and blocks are rows,
so a giant document is the work of many tasks.

Spaces become space marks, and one more stands before the text. Characters outside the
vocabulary, and space marks in the text itself, are spelt by byte pieces, so decoding gives
back every text exactly. Where no piece holds a space mark behind another character, a cut at a
space mark loses nothing; words are then segmented once per task and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.llm.common import staged, table
from evidentia.llm.lattice import BYTES, MODEL_FILE, SPACE, Batch, best, best_flat, slices, vocabulary

#: Characters of a chunk, chunks whose matrices are combined in one task; words and their segmentations that a task remembers.
CHUNK, BLOCK, MEMORY = 16_384, 64, 200_000
#: Texts of so many chunks are encoded in one go as well, if they are cut into words none of which is longer than a text without chunks may be.
WHOLE = 16
#: Stands in the marked text for a space mark that the original holds: it is spelt by bytes.
LITERAL = "￿"
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def marked(text: str) -> str:
    """The text with one space mark before it and in place of each space; literal space marks and LITERALs become LITERAL escapes."""
    return SPACE + text.replace(LITERAL, LITERAL + "1").replace(SPACE, LITERAL + "0").replace(" ", SPACE)


class Encoder:
    """Best segmentations under one vocabulary and score table."""

    def __init__(self, model: bytes, scores: np.ndarray | None = None) -> None:
        self.vocab = vocabulary(model)
        self.scores = self.vocab.rank_scores() if scores is None else scores
        self.states = self.vocab.longest
        # words, and words after a space mark without it: their ids as bytes of 32 bits each, and the bytes these decode to
        self._known: dict[str, tuple[bytes, bytes]] = {}
        self._after: dict[str, tuple[bytes, bytes]] = {}
        self.literal = {"0": self.vocab.byte_ids[list(SPACE.encode())].tolist(), "1": self.vocab.byte_ids[list(LITERAL.encode())].tolist()}
        self._bytes = [p.replace(SPACE, " ").encode() for p in self.vocab.pieces]
        for b, i in enumerate(self.vocab.byte_ids):
            self._bytes[i] = bytes([b])
        self._flat = np.frombuffer(b"".join(self._bytes), np.uint8)
        self._sizes = np.array(list(map(len, self._bytes)), np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes

    def words(self, text: str) -> list[str]:
        """Parts of a marked text between which no piece can lie."""
        return _WORD.findall(text) if self.vocab.words_split else [text]

    def learn(self, words: set[str], after: bool = False) -> None:
        """Segment words that aren't remembered yet, all at once; after: they follow a space mark that they come without."""
        held = self._after if after else self._known
        new = list(words - held.keys())
        if len(held) + len(new) > MEMORY:
            held.clear()
            new = list(words)
        plain = [w for w in new if LITERAL not in w]
        for rows, ids, ends in best_flat(self.vocab, self.scores, [SPACE + w for w in plain] if after else plain):
            raw, raw_ends = self._spelt_all(ids, ends)
            ids_, start, raw_start = ids.tobytes(), 0, 0
            for r, end, raw_end in zip(rows.tolist(), (4 * ends).tolist(), raw_ends.tolist(), strict=True):
                held[plain[r]] = ids_[start:end], raw[raw_start:raw_end]
                start, raw_start = end, raw_end
        for w in new if len(plain) < len(new) else ():
            if LITERAL in w:
                ids = self._escaped(SPACE + w if after else w)
                held[w] = np.array(ids, np.int32).tobytes(), self._spelt(ids)

    def _spelt_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that ids decode to, and where they end for ids that end at ends."""
        size = self._sizes[ids]
        stop = np.cumsum(size)
        at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(self._starts[ids] - stop + size, size)
        return self._flat[at].tobytes(), np.concatenate([[0], stop])[ends]

    def _spelt(self, ids: list[int] | tuple[int, ...]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))

    def _escaped(self, word: str) -> list[int]:
        out: list[int] = []
        for i, part in enumerate(word.split(LITERAL)):
            if i:
                out.extend(self.literal[part[0]])
                part = part[1:]
            if part:
                out.extend(best(self.vocab, self.scores, [part])[0])
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of marked texts."""
        cut = [self.words(t) for t in texts]
        self.learn({w for c in cut for w in c})
        return [np.frombuffer(b"".join(self._known[w][0] for w in c), np.int32) for c in cut]

    def both(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        """Ids of unmarked texts, and the UTF-8 that these ids decode to. A word is segmented, and its ids decoded, once."""
        cut = [(True, t.split(" ")) if self.vocab.words_split and SPACE not in t and LITERAL not in t else (False, [""]) for t in texts]
        cut = [(after, c) if "" not in c else (False, self.words(marked(t))) for (after, c), t in zip(cut, texts, strict=True)]
        for kind in (True, False):
            self.learn(set().union(*(c for after, c in cut if after is kind)), kind)
        out = []
        for after, c in cut:
            got = list(map((self._after if after else self._known).__getitem__, c))
            raw = b"".join(map(itemgetter(1), got))
            out.append((np.frombuffer(b"".join(map(itemgetter(0), got)), np.int32), raw[1:] if raw.startswith(b" ") else raw))
        return out

    def score(self, ids: np.ndarray | list[int]) -> float:
        return float(self.scores[np.asarray(ids, np.int64)].sum()) if len(ids) else 0.0

    def _weights(self, text: str) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        batch = Batch(self.vocab, [text], len(text))
        return batch.weights(self.vocab, self.scores)[0], batch.ids[0], {int(a): b for a, b in zip(batch.spelt[1], batch.spelt[2], strict=True)}

    def matrix(self, chunk: str, ahead: str) -> np.ndarray:
        """(entry, exit) best scores through a chunk; ahead: the first characters of the text behind it (longest piece less one at most).

        Entry state i: its first i characters are taken. Exit state j: its last piece takes j characters of what follows.
        A state that would skip the whole chunk is left to the scan: chunks are longer than any piece.
        """
        w, _, _ = self._weights(chunk + ahead)
        n, s = len(chunk), self.states
        reach = np.full((s, n + s), -np.inf)  # entry state, position
        reach[np.arange(s), np.arange(s)] = 0.0
        for i in range(n):
            live = np.flatnonzero(np.isfinite(w[i]))
            if len(live):
                reach[:, i + 1 + live] = np.maximum(reach[:, i + 1 + live], reach[:, i, None] + w[i, live])
        return reach[:, n : n + s]

    def trace(self, chunk: str, ahead: str, enter: int, leave: int) -> list[int]:
        """Ids of the best way through a chunk between two states."""
        w, ids, raw = self._weights(chunk + ahead)
        n = len(chunk)
        reach = np.full(n + self.states, -np.inf)
        reach[enter] = 0.0
        last = np.zeros(n + self.states, np.int64)
        for i in range(enter, n):
            if not np.isfinite(reach[i]):
                continue
            for k in np.flatnonzero(np.isfinite(w[i])):
                got, j = reach[i] + w[i, k], i + 1 + k
                if got > reach[j]:
                    reach[j], last[j] = got, k + 1
        out, at = [], n + leave
        while at > enter:
            start = at - int(last[at])
            piece = int(ids[start, last[at] - 1])
            out.extend(self.vocab.byte_ids[raw[start]][::-1].tolist() if piece == BYTES else [piece])
            at = start
        return out[::-1]

    def decoded_bytes(self, ids: np.ndarray | list[int]) -> bytes:
        """UTF-8 of the text of ids, without the one space mark before the text."""
        raw = self._spelt(np.asarray(ids, np.int64).tolist())
        return raw[1:] if raw.startswith(b" ") else raw

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return self.decoded_bytes(ids).decode("utf-8", "surrogatepass")


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of matrices in order, as a tree of pairs."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def states(matrices: list[np.ndarray], enter: int = 0, leave: int = 0) -> tuple[list[int], float]:
    """The state at each border along the best way through chunks in order, from one state to another, and its score.

    Suffix products give, from any border state, the best rest; the states then follow from the left.
    """
    rest = [np.where(np.arange(matrices[0].shape[0]) == leave, 0.0, -np.inf)]
    for m in reversed(matrices):
        rest.append((m + rest[-1][None, :]).max(axis=1))
    rest.reverse()
    at, out = enter, [enter]
    for m, r in zip(matrices, rest[1:], strict=True):
        at = int((m[at] + r).argmax())
        out.append(at)
    return out, float(rest[0][enter])


def cut_points(text: str, size: int) -> list[int]:
    """Borders of chunks of about size characters; none falls inside a LITERAL escape, none leaves a short end."""
    out = [0]
    while len(text) - out[-1] > size + size // 2:
        at = out[-1] + size
        out.append(at + 1 if text[at - 1] == LITERAL else at)
    return [*out, len(text)]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, model_file: str = MODEL_FILE) -> DataFrame:
    """key, n_chars, ids array<int>, score, decoded_sha256: the best segmentation of every text, and the hash of what it decodes to.

    Null and empty texts have the ids of a lone space mark. Of equally good segmentations of a word that with the longest
    last piece is taken. Repeated rows give repeated rows. Other columns are ignored.
    """
    if chunk < 64:
        raise ValueError("chunk must be at least 64")
    spark = docs.sparkSession
    with open(model_file, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    limit = chunk + chunk // 2
    n = F.length("text")
    one_go = n <= limit
    if vocabulary(model.value).words_split:  # runs of spaces are part of a word; each run is looked at from its start alone
        one_go |= (n <= WHOLE * chunk) & ~F.col("text").rlike(f"(?<![^ ])[^ ]{{{limit}}}|(?<! ) {{{limit}}}")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for x in batches:
            texts = x.column(1).to_pylist()
            for part in slices(texts):
                yield _arrow(encoder, x.column(0).slice(part.start, part.stop - part.start), [len(t) for t in texts[part]], encoder.both(texts[part]))

    out = f"key {kind}, n_chars long, ids array<int>, score double, decoded_sha256 string"
    short = rows.where(one_go).mapInArrow(whole, out)
    long = rows.where(~one_go)
    if long.isEmpty():
        return short.withColumnRenamed("key", key)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        span = vocabulary(model.value).longest - 1
        for x in batches:
            for k, uid, t in zip(x["key"], x["uid"], x["text"], strict=True):
                m = marked(t)
                at = cut_points(m, chunk)
                yield pd.DataFrame({"uid": uid, "key": k, "n_chars": len(t), "pos": np.arange(len(at) - 1), "chunk": [m[a:b] for a, b in zip(at, at[1:])],
                                    "ahead": [m[b : b + span].split(LITERAL)[0] for b in at[1:]]})

    pieces = long.withColumn("uid", F.monotonically_increasing_id()).mapInPandas(cut, f"uid long, key {kind}, n_chars long, pos int, chunk string, ahead string")
    pieces = staged(pieces.repartition(F.col("uid"), F.col("pos")), "chunks")  # chunks of one document are dealt over all tasks

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(model.value)
        for x in batches:
            for part in slices(x["chunk"].tolist()):
                y = x.iloc[part]
                encoder.learn({w for c in y["chunk"] for w in encoder.words(c)[1:-1]})
                yield pd.DataFrame({"uid": y["uid"], "pos": y["pos"], "m": [shortcut(encoder, c, a)[0].ravel() for c, a in zip(y["chunk"], y["ahead"], strict=True)]})

    matrices = staged(pieces.mapInPandas(transfer, "uid long, pos int, m array<double>"), "matrices")
    square = lambda ms: [np.asarray(m).reshape(int(len(m) ** 0.5), -1) for m in ms]

    def block(x: pd.DataFrame) -> pd.DataFrame:
        """The product of BLOCK neighbouring chunks."""
        x = x.sort_values("pos")
        return pd.DataFrame({"uid": x["uid"].iloc[:1], "block": x["pos"].iloc[:1] // BLOCK, "m": [product(square(x["m"])).ravel()]})

    def across(x: pd.DataFrame) -> pd.DataFrame:
        """The states at the borders of a document's blocks. The longest string that Spark can hold has 2,048 blocks, 4 MB of matrices."""
        x = x.sort_values("block")
        at, score = states(square(x["m"]))
        return pd.DataFrame({"uid": x["uid"], "block": x["block"], "enter": at[:-1], "leave": at[1:], "score": score})

    def within(x: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        """The states at the borders of a block's chunks, between the block's own."""
        x = x.sort_values("pos")
        at, _ = states(square(x["m"]), int(ends["enter"].iloc[0]), int(ends["leave"].iloc[0]))
        return pd.DataFrame({"uid": x["uid"], "pos": x["pos"], "enter": at[:-1], "leave": at[1:], "score": ends["score"].iloc[0]})

    placed = matrices.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("int"))
    blocks = placed.groupBy("uid", "block").applyInPandas(block, "uid long, block int, m array<double>")
    borders = blocks.groupBy("uid").applyInPandas(across, "uid long, block int, enter int, leave int, score double")
    ways = placed.groupBy("uid", "block").cogroup(borders.groupBy("uid", "block")).applyInPandas(within, "uid long, pos int, enter int, leave int, score double")

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(model.value)
        for x in batches:
            for part in slices(x["chunk"].tolist()):
                y = x.iloc[part]
                encoder.learn({w for c in y["chunk"] for w in encoder.words(c)[1:-1]})
                ids = [shortcut(encoder, c, a, (e, o))[1] for c, a, e, o in zip(y["chunk"], y["ahead"], y["enter"], y["leave"], strict=True)]
                yield pd.DataFrame({"uid": y["uid"], "key": y["key"], "n_chars": y["n_chars"], "pos": y["pos"], "ids": ids, "score": y["score"]})

    traced = pieces.join(ways, ["uid", "pos"]).mapInPandas(back, f"uid long, key {kind}, n_chars long, pos int, ids array<int>, score double")
    joined = traced.groupBy("uid").agg(F.max("key").alias("key"), F.max("n_chars").alias("n_chars"),
                                       F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda s: s["ids"])).alias("ids"), F.max("score").alias("score"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(model.value)
        for x in batches:
            x["decoded_sha256"] = [hashlib.sha256(encoder.decoded_bytes(i)).hexdigest() for i in x["ids"]]
            yield x

    return short.unionByName(joined.select("key", "n_chars", "ids", "score").mapInPandas(digest, out)).withColumnRenamed("key", key)


def shortcut(encoder: Encoder, chunk: str, ahead: str, way: tuple[int, int] | None = None) -> tuple[np.ndarray | None, list[int] | None]:
    """A chunk's transfer matrix, or its ids between two states.

    Where words can be cut apart, every way through the chunk passes the starts of its words, so only the first and the
    last word depend on the states; what lies between is segmented word by word. The space mark that may follow the
    chunk decides nothing: it is a start of a word too. Without such cuts the whole chunk is swept.
    """
    starts = [m.start() for m in _WORD.finditer(chunk)] if encoder.vocab.words_split else []
    inner = [s for s in starts if s >= encoder.states and chunk[s] == SPACE and chunk[s - 1] != SPACE]
    if len(inner) < 2:
        return shortcut_part(encoder, chunk, ahead, way)
    a, b = inner[0], inner[-1]
    head, middle, tail = chunk[:a], chunk[a:b], chunk[b:]
    if way is None:
        first = shortcut_part(encoder, head, "", None)[0][:, 0]
        last = shortcut_part(encoder, tail, ahead, None)[0][0]
        return first[:, None] + encoder.score(encoder.encode_all([middle])[0]) + last[None, :], None
    return None, shortcut_part(encoder, head, "", (way[0], 0))[1] + encoder.encode_all([middle])[0].tolist() + shortcut_part(encoder, tail, ahead, (0, way[1]))[1]


def shortcut_part(encoder: Encoder, text: str, ahead: str, way: tuple[int, int] | None) -> tuple[np.ndarray | None, list[int] | None]:
    if LITERAL in text:
        return escaped_way(encoder, text, ahead, way)
    return (encoder.matrix(text, ahead), None) if way is None else (None, encoder.trace(text, ahead, *way))


def escaped_way(encoder: Encoder, text: str, ahead: str, way: tuple[int, int] | None) -> tuple[np.ndarray | None, list[int] | None]:
    """As matrix or trace for a text with LITERAL escapes, at which every way stops: the parts between them are swept one by one."""
    parts = text.split(LITERAL)
    lone = [parts[0], *[p[1:] for p in parts[1:]]]
    fixed = [encoder.literal[p[0]] for p in parts[1:]]
    n = len(lone)
    if way is None:
        total = None
        for i, part in enumerate(lone):
            m = encoder.matrix(part, ahead if i == n - 1 else "")
            if i:
                m = m[:1] + encoder.score(fixed[i - 1])
            if i < n - 1:
                m = m[:, :1]
            total = m if total is None else total + m
        return total, None
    out: list[int] = []
    for i, part in enumerate(lone):
        if i:
            out += fixed[i - 1]
        out += encoder.trace(part, ahead if i == n - 1 else "", way[0] if i == 0 else 0, way[1] if i == n - 1 else 0)
    return None, out


def decode(encoded: DataFrame, key: str = "doc_id", model_file: str = MODEL_FILE) -> DataFrame:
    """key and text of encoded(key, ids); null ids give a null text."""
    with open(model_file, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(model.value)
        for x in batches:
            x["text"] = [None if i is None else encoder.decode(i) for i in x["ids"]]
            yield x[["key", "text"]]

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), "ids").mapInPandas(run, f"key {kind}, text string").withColumnRenamed("key", key)


def _arrow(encoder: Encoder, keys: pa.Array, n_chars: list[int], got: list[tuple[np.ndarray, bytes]]) -> pa.RecordBatch:
    ids = [i for i, _ in got]
    ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
    digests = [hashlib.sha256(raw).hexdigest() for _, raw in got]
    return pa.RecordBatch.from_arrays([keys, pa.array(n_chars, pa.int64()), lists, pa.array([encoder.score(i) for i in ids], pa.float64()), pa.array(digests, pa.string())],
                                      names=["key", "n_chars", "ids", "score", "decoded_sha256"])


def encoded_and_decoded(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids, score, decoded_sha256 of docs(doc_id, text): the encoding, and the hash of the text that it decodes to."""
    return encode(docs, model_file=model_file).select("doc_id", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "score", "decoded_sha256")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoding of every whole text, and the hash of the text decoded from it."""
    return encoded_and_decoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
