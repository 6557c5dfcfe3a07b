"""Segmentation lattices over an existing subword vocabulary, many words at a time.

A word of T characters has an edge from i to i + l wherever the characters i..i+l spell a
piece. Characters that no piece spells get one edge of their UTF-8 byte pieces. The edges of
a whole batch of words lie in one array (words, positions, lengths), on which forward
recursions run in one semiring or another: (log-sum, +) for likelihoods, (max, +) for the
best segmentation.

The vocabulary file at hand was made by merges: its scores are merge ranks, not
log-probabilities. ``Vocabulary.rank_scores`` turns ranks into log-probabilities by the
Zipf-Mandelbrot law, the larger the rank the rarer the piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NONE, BYTES = -1, -2
#: Cells (words x positions x lengths) of a batch, and word lengths that share a batch.
CELLS, WIDTHS = 1 << 21, (4, 8, 12, 16, 24, 32, 64)
ZIPF_SHIFT = 2.7
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of a SentencePiece model file, given as its bytes, with a hashed trie for array look-ups."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        self.pieces: list[str] = [sp.id_to_piece(i) for i in range(self.size)]
        self.special = [i for i in range(self.size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)]
        self.byte_ids = np.zeros(256, np.int64)
        plain: list[int] = []
        held = set(self.special)
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif i not in held:
                plain.append(i)
        self.plain = np.array(plain, np.int64)
        self.ranks = np.array([-sp.get_score(i) for i in range(self.size)])
        self.longest = max(len(self.pieces[i]) for i in plain)
        #: No piece has a space mark after another character: words can then be cut at space marks.
        self.words_split = all(SPACE not in self.pieces[i].lstrip(SPACE) for i in plain)
        chars = sorted({c for i in plain for c in self.pieces[i]})
        self.code = {c: n + 1 for n, c in enumerate(chars)}
        self._width = len(chars) + 1
        self._points = np.array([ord(c) for c in chars], np.int64)
        self._build()

    def _build(self) -> None:
        child: dict[int, int] = {}
        ends = [NONE]
        for i in self.plain:
            node = 0
            for c in self.pieces[i]:
                key = node * self._width + self.code[c]
                node = child.get(key, -1)
                if node < 0:
                    child[key] = node = len(ends)
                    ends.append(NONE)
            ends[node] = int(i)
        self._ends = np.array(ends, np.int64)
        bits = max(4, math.ceil(math.log2(len(child) * 3)))
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._nodes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        for key, node in child.items():
            at = ((key * int(_MIX)) & (2**64 - 1)) >> (64 - bits)
            while self._keys[at] >= 0:
                at = (at + 1) & self._mask
            self._keys[at], self._nodes[at] = key, node

    def _step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Child nodes, -1 where there is none."""
        key = node * self._width + code
        at = ((key.astype(np.uint64) * _MIX) >> self._shift).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            got = self._keys[at[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self._nodes[at[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
            at[todo] = (at[todo] + 1) & self._mask
        return out

    def rank_scores(self) -> np.ndarray:
        """Log-probability of every piece by the Zipf-Mandelbrot law of its rank; byte pieces share the rarest rank, specials -inf."""
        out = np.full(self.size, -np.inf)
        order = self.plain[np.argsort(self.ranks[self.plain], kind="stable")]
        out[order] = -np.log(np.arange(len(order)) + ZIPF_SHIFT)
        out[self.byte_ids] = -math.log(len(order) + ZIPF_SHIFT)
        live = np.isfinite(out)
        out[live] -= np.log(np.exp(out[live]).sum())
        return out

    def codes(self, text: str) -> np.ndarray:
        """Alphabet index of each character, 0 for one that no piece holds."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self._points, points), len(self._points) - 1)
        return np.where(self._points[at] == points, at + 1, 0)

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """(words, positions, lengths): id of the piece that starts there with length 1, 2, ..; else NONE.

        codes (words, positions) holds 0 behind a word's end, and for characters outside the alphabet.
        """
        n, t = codes.shape
        most = max(1, min(self.longest, t))
        out = np.full((n, t, most), NONE, np.int32)
        row, at = np.nonzero(codes)
        node = np.zeros(len(row), np.int64)
        start = at.copy()
        for length in range(most):
            node = self._step(node, codes[row, at])
            live = node >= 0
            row, at, start, node = row[live], at[live], start[live], node[live]
            if not len(row):
                break
            out[row, start, length] = self._ends[node]
            at = at + 1
            live = at < t
            live[live] = codes[row[live], at[live]] > 0
            row, at, start, node = row[live], at[live], start[live], node[live]
        return out


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary of a model file; a Python worker builds it once."""
    return Vocabulary(model)


def slices(texts: Sequence[str], most: int = 1_000_000) -> Iterator[slice]:
    """Slices of about most characters, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


class Batch:
    """Words of like length with their edges: ids (n, t, l), lengths (n,), and the characters spelt by bytes."""

    def __init__(self, vocab: Vocabulary, words: Sequence[str], width: int) -> None:
        self.lengths = np.array([len(w) for w in words], np.int64)
        flat = vocab.codes("".join(words))
        mask = np.arange(width) < self.lengths[:, None]
        codes = np.zeros(mask.shape, np.int64)
        codes[mask] = flat
        self.ids = vocab.edges(codes)
        row, at = np.nonzero(mask & (self.ids[:, :, 0] == NONE))
        self.ids[row, at, 0] = BYTES
        ends = np.cumsum(self.lengths) - self.lengths
        joined = "".join(words)
        self.spelt = (row, at, [np.frombuffer(joined[ends[r] + a].encode("utf-8", "surrogatepass"), np.uint8) for r, a in zip(row, at, strict=True)])

    def weights(self, vocab: Vocabulary, scores: np.ndarray, words_last: bool = False) -> np.ndarray:
        """Log-weight of every edge, -inf where there is none; words_last: (t, l, n)."""
        ids = np.ascontiguousarray(self.ids.transpose(1, 2, 0)) if words_last else self.ids
        out = np.append(scores, [-np.inf, -np.inf])[ids]  # BYTES and NONE index the two from the end
        row, at, raw = self.spelt
        if len(row):
            out[(at, 0, row) if words_last else (row, at, 0)] = [scores[vocab.byte_ids[b]].sum() for b in raw]
        return out


def batches(vocab: Vocabulary, words: Sequence[str]) -> Iterator[tuple[np.ndarray, Batch]]:
    """Indices and batches of all words; words longer than the widest class are batched by their own length."""
    if not len(words):
        return
    lengths = np.array([len(w) for w in words], np.int64)
    classes = np.searchsorted(WIDTHS, lengths)
    for k in np.unique(classes):
        rows = np.flatnonzero(classes == k)
        if k < len(WIDTHS):
            step = max(1, CELLS // (WIDTHS[k] * min(WIDTHS[k], vocab.longest)))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                yield part, Batch(vocab, [words[j] for j in part], WIDTHS[k])
        else:
            for j in rows:
                yield np.array([j]), Batch(vocab, [words[j]], int(lengths[j]))


def forward(weights: np.ndarray) -> np.ndarray:
    """(n, t + 1) log of the summed weight of all segmentations of each prefix."""
    n, t, most = weights.shape
    alpha = np.full((n, t + 1), -np.inf)
    alpha[:, 0] = 0.0
    with np.errstate(divide="ignore"):
        for j in range(1, t + 1):
            m = min(j, most)
            back = np.arange(1, m + 1)
            terms = alpha[:, j - back] + weights[:, j - back, back - 1]
            top = terms.max(axis=1)
            safe = np.where(np.isfinite(top), top, 0.0)
            alpha[:, j] = safe + np.log(np.exp(terms - safe[:, None]).sum(axis=1))
    return alpha


def likelihoods(vocab: Vocabulary, scores: np.ndarray, words: Sequence[str]) -> np.ndarray:
    """Natural log of each word's marginal probability over all segmentations."""
    out = np.zeros(len(words))
    for rows, batch in batches(vocab, words):
        out[rows] = forward(batch.weights(vocab, scores))[np.arange(len(rows)), batch.lengths]
    return out


def best(vocab: Vocabulary, scores: np.ndarray, words: Sequence[str]) -> list[tuple[int, ...]]:
    """Ids of each word's segmentation of largest summed score; of equal ones that with the longest last piece, and so on backwards."""
    out: list[tuple[int, ...]] = [()] * len(words)
    for rows, ids, ends in best_flat(vocab, scores, words):
        flat, start = ids.tolist(), 0
        for r, end in zip(rows.tolist(), ends.tolist(), strict=True):
            out[r] = tuple(flat[start:end])
            start = end
    return out


def best_flat(vocab: Vocabulary, scores: np.ndarray, words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of some words, the ids (int32) of their best segmentations one behind the other, and where each word's ids end."""
    for rows, batch in batches(vocab, words):
        w = batch.weights(vocab, scores, words_last=True)
        t, most, n = w.shape
        alpha = np.full((t + 1, n), -np.inf)
        alpha[0] = 0.0
        last = np.zeros((t + 1, n), np.int64)
        for j in range(1, t + 1):
            m = min(j, most)
            top, length = alpha[j], last[j]
            for k in range(m, 0, -1):  # of equal ones the longest stays
                got = alpha[j - k] + w[j - k, k - 1]
                better = got > top
                np.copyto(top, got, where=better)
                np.copyto(length, k, where=better)
        at = batch.lengths.copy()
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(at > 0)
        while len(live):
            length = last[at[live], live]
            at[live] -= length
            steps.append((live, at[live], batch.ids[live, at[live], length - 1]))
            live = live[at[live] > 0]
        if not steps:
            yield rows, np.zeros(0, np.int32), np.zeros(n, np.int64)
            continue
        who, start, ids = (np.concatenate(x[::-1]) for x in zip(*steps, strict=True))
        order = np.argsort(who, kind="stable")
        who, start, ids = who[order], start[order], ids[order]
        size = np.ones(len(ids), np.int64)
        spelt = np.flatnonzero(ids == BYTES)
        if len(spelt):
            raw = {(int(a), int(b)): r for a, b, r in zip(*batch.spelt, strict=True)}
            parts = [vocab.byte_ids[raw[int(who[i]), int(start[i])]] for i in spelt]
            size[spelt] = [len(x) for x in parts]
            ids = np.repeat(ids, size)
            ids[np.repeat(np.isin(np.arange(len(size)), spelt), size)] = np.concatenate(parts)
        yield rows, ids.astype(np.int32), np.cumsum(np.bincount(who, size, n).astype(np.int64))
