"""Language-model scoring by online logistic context mixing.

A text is coded token by token, each as a few bits and a choice. The first bit says whether the token is the one that followed
the last two words when the text had them before, or the last one; the second, whether the text had it at all before; the
third, whether training had it. Which word it is, is told by bits too: of one that the text had, the bits of its number by first
appearance; of one that training had, those bits of its bytes at which training words with the same beginning part; of an unknown
one, all bits of its bytes and of a closing byte. Bits that only one word could have aren't coded.

The first three bits are coded in the order of the text. Several predictors give each one's odds: what training counted in
hashed contexts (the length of the matching context and how often it just held; the outcomes of the last tokens and the last
word's length; the place in the text), and what this text did so far. They meet in the logistic domain under weights that
a gate picks (the bit, and the matching context), and a table refines the mixed prediction. Weights, table and counts start as
training left them, and are adapted after each bit; every `SEGMENT` tokens they start anew, so that long texts are coded in parallel.
So are the bits of a number (`Recall`): tokens and distinct words of the text so far on either side, the side last taken, and what
the segment did at this height, under weights of each height.

For a spelled bit, five predictors look up how often 0 and 1 followed their contexts in the training words: the last one, two,
three or five bytes, and the whole word so far, under weights by how many of the longer contexts are known and the bit's
place; these are adapted batch after batch over training words, each predicted as if it hadn't been counted, and then
stay, since a word is scored once for the corpus. Words that training had have weights of their own (`Forks`), which start at the
whole word so far, that is at plain frequency.

Words are counted over the whole corpus: chunks of documents are stored as their distinct words and the sequence of them;
each chunk sends its distinct words with their counts to buckets by hash, and a bucket merges equal words of all chunks.
Each bucket sends its distinct pairs of a context and the byte after it, with their counts, to shards by hash; a shard merges
equal pairs of all buckets and answers each with the counts on the pair's way through its bits. Contexts are told apart by
56 bits and none is dropped, so what the shards hold grows with the corpus. With these counts buckets learn the weights, then
score their words once, and send counts and scores back to the chunks that asked, in their order. What moves grows with
the distinct words of chunks and the distinct pairs of buckets; only the weights and some counts of fixed size are broadcast.
Pairs of words are not counted over the corpus: there are nearly as many as tokens.

Defined cases: a null text is the empty one, whose only token is the end; a null id counts as training; rows are kept as
they are; without training rows counts are 0, the base score is that of log10(0.5 / 0.5) a token, and no pair has a count;
the end is a token that no text had before; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import LOWER, NOT_SPACE, buffers, distinct, gather_spans, mix, pieces, ranked, span_hashes, words
from .exchange import buckets_of
from .shared import stored, table, text_of

U = np.uint64
#: Predictors, by context: one, two, three and five bytes, and the word so far.
ORDERS = 5
CLOSE, END = 0x20, 0x0A
#: Bytes of text in a chunk; about as much as that gives the words of a bucket.
CHUNK = 6 << 20
#: Words in a batch of online learning, and batches after which weights have settled.
BATCH, SETTLED = 4096, 12
#: Bytes whose bits are summed up at a time; so many stay in a core's cache.
BLOCK = 4096
LEVELS, BINS = 4, 33
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _squeeze(*arrays: np.ndarray) -> bytes:
    raw = [a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw))


def _spread(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}q", raw), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


# -- the model ---------------------------------------------------------------------------------------------------------


class Spelled:
    """Words as bits: for each byte its word and the predictors' contexts, as hashes whose last byte is free."""

    def __init__(self, data: np.ndarray, at: np.ndarray, close: int = CLOSE):
        n = np.diff(at)
        flat = np.full(len(data) + len(n), close, np.uint8)
        self.word = np.repeat(np.arange(len(n)), n + 1)
        where = np.arange(len(data)) + np.repeat(np.arange(len(n)), n)
        flat[where] = data
        self.flat = flat
        begin = (at[:-1] + np.arange(len(n)))[self.word]
        i = np.arange(len(flat))
        place = i - begin
        last = [np.zeros(len(flat), U) for _ in range(5)]
        for k, x in enumerate(last, 1):
            x[k:] = flat[:-k] * (place[k:] >= k)
        two = last[0] | last[1] << U(8)
        three = two | last[2] << U(16)
        five = three | last[3] << U(24) | last[4] << U(32)
        so_far = span_hashes(flat, begin, i)
        self.contexts = [mix(x + U((o + 1) * 0x2545F4914F6CDD1D)) & ~U(255) for o, x in enumerate((last[0], two, three, five, so_far))]

    def pairs(self) -> np.ndarray:
        """Each predictor's contexts, with the byte that follows in the free place."""
        return np.stack(self.contexts) | self.flat.astype(U)

    def bits(self) -> np.ndarray:
        """The bits of each byte, the first to last."""
        return np.unpackbits(self.flat[:, None], axis=1)


def odds(pairs: np.ndarray, found: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs, by their byte's bits: the odds of a 1 that its context gives, in the logistic domain, and whether the context is
    known. found: what `on_path` says. own: the counts hold this very word once; it is left out."""
    bits, x, known = np.unpackbits((pairs & U(255)).astype(np.uint8)[:, None], axis=1), np.empty((len(pairs), 8), np.float32), np.empty((len(pairs), 8), bool)
    for i in range(0, len(pairs), BLOCK):
        j = min(i + BLOCK, len(pairs))
        here = found[:, i:j].astype(np.int64)
        same, other = here[1:], here[:-1] - here[1:]
        if own:
            same = np.maximum(same - 1, 0)
        sure = np.log((same + 0.4) / (other + 0.4)).T
        x[i:j] = np.where(bits[i:j], sure, -sure)
        known[i:j] = (same + other >= 2).T
    return x, known


def on_path(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of sorted, distinct pairs: by number of bits, 0 to 8, how often the same context was followed by a byte with the same
    first bits."""
    out = np.empty((9, len(pairs)), np.int64)
    for j in range(9):
        group = pairs >> U(8 - j)
        at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        out[j] = np.repeat(np.add.reduceat(counts, at) if len(at) else counts, np.diff(np.append(at, len(pairs))))
    return out


def merged_pairs(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, distinct pairs and their counts together."""
    order, pairs = ranked(pairs, 8)
    counts = counts[order]
    at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[at], np.add.reduceat(counts, at) if len(at) else counts


class Tables:
    """Sorted, distinct pairs and their counts, as many as there are."""

    def __init__(self) -> None:
        self.pairs, self.counts = np.zeros(0, U), np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        self.pairs, self.counts = merged_pairs(np.concatenate([self.pairs, pairs]), np.concatenate([self.counts, counts]))

    def looked_up(self, spelled: Spelled) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, what is on their paths, and which one each predictor has at each byte."""
        pairs, of = np.unique(spelled.pairs(), return_inverse=True)
        all_pairs, counts = merged_pairs(np.concatenate([self.pairs, pairs]), np.concatenate([self.counts, np.zeros(len(pairs), np.int64)]))
        return pairs, on_path(all_pairs, counts)[:, np.searchsorted(all_pairs, pairs)], of.reshape(ORDERS, -1)

    def paths(self, spelled: Spelled) -> np.ndarray:
        asked = spelled.pairs()
        pairs, counts = merged_pairs(np.concatenate([self.pairs, asked.reshape(-1)]), np.concatenate([self.counts, np.zeros(asked.size, np.int64)]))
        return on_path(pairs, counts)[:, np.searchsorted(pairs, asked)]


class Answers:
    """What the shards said of a bucket's sorted, distinct pairs."""

    def __init__(self, pairs: np.ndarray, found: np.ndarray):
        self.pairs, self.found = pairs, np.ascontiguousarray(found.T)  # a pair's numbers side by side

    def looked_up(self, spelled: Spelled) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs, of = np.unique(spelled.pairs(), return_inverse=True)
        return pairs, np.ascontiguousarray(self.found[np.searchsorted(self.pairs, pairs)].T), of.reshape(ORDERS, -1)

    def paths(self, spelled: Spelled) -> np.ndarray:
        asked, of = np.unique(spelled.pairs(), return_inverse=True)
        found = self.found[np.searchsorted(self.pairs, asked)].T  # sorted ones are found faster
        return np.ascontiguousarray(found)[:, of.reshape(ORDERS, -1)]


def empty_tables() -> Tables:
    return Tables()


def count_bits(tables: Tables, spelled: Spelled, counts: np.ndarray) -> None:
    """Adds words, as often as they were counted, to the tables."""
    tables.add(*merged_pairs(spelled.pairs().reshape(-1), np.tile(counts[spelled.word].astype(np.int64), ORDERS)))


def _level(known: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many of the longer contexts are known, by bytes' bits. of: which pair each predictor has at each byte."""
    known = known.view(np.int64).ravel()  # the eight bits of a byte at once
    return sum(known.take(k) for k in of[2:]).view(np.int8).reshape(-1, 8)


class Mixer:
    """weights: by gate; refine: counts of 0 and 1 by level and bin of the mixed prediction."""

    def __init__(self, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.weights = np.full((LEVELS * 8, ORDERS), 0.3) if weights is None else weights
        mid = 1 / (1 + np.exp(-np.linspace(-8, 8, BINS)))
        self.refine = np.tile(np.stack([1 - mid, mid], axis=1), (LEVELS, 1, 1)) if refine is None else refine

    def predict(self, x: list[np.ndarray], level: np.ndarray, place: np.ndarray = np.arange(8)) -> np.ndarray:
        """Of bytes' bits: the refined prediction. x: odds by predictor; level: known contexts of the longer ones; place: of each bit in its byte."""
        gate, p, low, part = self.mixed(x, level, place)
        r = (self.refine[..., 1] / self.refine.sum(axis=-1)).ravel()
        low += level * np.int64(BINS)
        q = r.take(low) * (1 - part) + r.take(low + 1) * part
        return np.clip((p + q) / 2, 1e-7, 1 - 1e-7)

    def mixed(self, x: list[np.ndarray], level: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of bytes' bits: the gate, the mixed prediction, and the lower one of the cells of the refining table beside it and its distance from that."""
        gate = level * np.int64(8)
        gate += place
        s = np.zeros(gate.shape, np.float32)
        for weights, y in zip(self.weights.T.astype(np.float32), x):
            own = weights.take(gate)
            own *= y
            s += own
        s = np.clip(s, -16, 16).astype(np.float64)
        p = np.exp(-s)
        p += 1
        np.divide(1, p, out=p)
        s += 8
        s *= (BINS - 1) / 16
        s = np.clip(s, 0, BINS - 1.001, out=s)
        low = s.astype(np.int64)
        s -= low
        return gate, p, low, s

    def learn(self, looked_up: tuple, spelled: Spelled, counts: np.ndarray, rate: float = 0.15) -> None:
        """One batch, each word weighing as often as it was counted."""
        pairs, found, of = looked_up
        self.adapt(*odds(pairs, found, True), of, spelled.bits(), counts[spelled.word].astype(np.float64), rate)

    def adapt(self, x: np.ndarray, known: np.ndarray, of: np.ndarray, bit: np.ndarray, weight: np.ndarray, rate: float = 0.15) -> None:
        """x, known: `odds` of pairs; of: which pair each predictor has at each byte; weight: of each byte."""
        total = []
        for i in range(0, len(bit), BLOCK):
            own, j = of[:, i : i + BLOCK], i + BLOCK
            total.append(self.sums([x.take(k, axis=0) for k in own], _level(known, own), np.arange(8), bit[i:j], np.repeat(weight[i:j], 8).reshape(-1, 8)))
        self.follow(total, rate)

    def step(self, x: list[np.ndarray], level: np.ndarray, place: np.ndarray, bit: np.ndarray, weight: np.ndarray, rate: float = 0.15) -> None:
        """x: odds by predictor; weight: of each bit."""
        self.follow([self.sums([y[i : i + 8 * BLOCK] for y in x], *(y[i : i + 8 * BLOCK] for y in (level, place, bit, weight))) for i in range(0, len(bit), 8 * BLOCK)], rate)

    def sums(self, x: list[np.ndarray], level: np.ndarray, place: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of bits: the slope and the bend of their cost, by weight, and what they add to the refining table."""
        gate, p, low, part = self.mixed(x, level, place)
        up, down = np.empty_like(self.weights), np.empty_like(self.weights)
        err, flat = bit - p, gate.ravel()
        err *= weight
        np.subtract(p, p * p, out=p)
        p *= weight
        for o in range(ORDERS):
            own = err * x[o]
            up[:, o] = np.bincount(flat, weights=own.ravel(), minlength=len(up))
            np.multiply(p, x[o], out=own)
            own *= x[o]
            down[:, o] = np.bincount(flat, weights=own.ravel(), minlength=len(up))
        low += part > 0.5
        low += level * np.int64(BINS)
        low *= 2
        low += bit
        return up, down, np.bincount(low.ravel(), weights=weight.ravel(), minlength=self.refine.size).reshape(self.refine.shape)

    def follow(self, sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float) -> None:
        """A step by the `sums` of a batch."""
        for _, _, refine in sums:
            self.refine += refine
        self.weights += rate * sum(up for up, _, _ in sums) / sum((down for _, down, _ in sums), np.ones_like(self.weights))

    def score(self, looked_up: tuple, spelled: Spelled, n_words: int) -> np.ndarray:
        """log10 of each word's probability."""
        pairs, found, of = looked_up
        return np.bincount(spelled.word, weights=self.logs(*odds(pairs, found, False), of, spelled.bits()), minlength=n_words)

    def logs(self, x: np.ndarray, known: np.ndarray, of: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log10 of each byte's probability."""
        q = self.predict([x.take(k, axis=0) for k in of], _level(known, of))
        return np.log10(np.where(bit, q, 1 - q)).sum(axis=1)


class Forks:
    """The bits of known words at which training words with the same beginning part. Whoever knows that a word is one of training's
    needs no others, so their probabilities sum to 1 over training's words."""

    def __init__(self, words_: Spelled, of: np.ndarray, parts: np.ndarray, x: np.ndarray, known: np.ndarray, places: np.ndarray):
        """of, x, known: of `looked_up` and `odds`; parts: of `parting`; places: the words' bytes."""
        of = of[:, places]
        bit = np.flatnonzero(parts.take(of[-1], axis=0))
        byte, self.place = bit >> 3, bit & 7
        self.word, self.bit = words_.word[places].take(byte), np.unpackbits(words_.flat[places]).take(bit).view(bool)
        self.x, self.level = [x.take(k, axis=0).ravel().take(bit) for k in of], _level(known, of).ravel().take(bit)

    @staticmethod
    def parting(found: np.ndarray) -> np.ndarray:
        """Of pairs, by their byte's bits: whether the context is followed by bytes with the other bit, too."""
        return np.stack([found[j + 1] != found[j] for j in range(8)], axis=1)

    def logs(self, mixer: Mixer, n_words: int) -> np.ndarray:
        """log10 of the probability of each word, which has its bits here, among training's."""
        q = mixer.predict(self.x, self.level, self.place)
        return np.bincount(self.word, weights=np.log10(np.where(self.bit, q, 1 - q)), minlength=n_words)


def chooser() -> Mixer:
    """At first the whole word so far decides, which amounts to the words' frequencies."""
    return Mixer(np.tile([0.0, 0.0, 0.0, 0.0, 1.0], (LEVELS * 8, 1)))


# -- bits of the running text ------------------------------------------------------------------------------------------

#: Tokens after which adaptation starts anew; slots of a table of hashed contexts; contexts of a bit besides what the text did.
SEGMENT, SLOTS, SEEN = 512, 256, 3
#: Bits of a token: it follows as before; the text had it; training had it.
FOLLOWS, AGAIN, KNOWN = range(3)
RATE, REFINED, CELLS = 0.02, 0.02, 17
_MIDDLES = np.linspace(-8, 8, CELLS)


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places by key, equal ones as they stand, and the sorted keys. key: 0 or more."""
    shift = max(1, len(key) - 1).bit_length()
    if int(key.max(initial=0)).bit_length() + shift < 64:  # one number holds a key and its place, which sorts several times faster
        packed = key.astype(np.int64) << shift
        packed |= np.arange(len(key))
        packed.sort()
        return (packed & ((1 << shift) - 1)).astype(np.int32), packed >> shift
    order = np.argsort(key, kind="stable").astype(np.int32)
    return order, key[order]


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places by key, equal ones as they stand, and which of them have another key than the one before."""
    order, there = _sorted(key)
    new = np.ones(len(key), bool)
    new[1:] = there[1:] != there[:-1]
    return order, new


def _last(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each place the last one before it with the same key (-1: none), of `_grouped`."""
    last, found = np.empty(len(order), np.int32), np.full(len(order), -1, np.int32)
    found[1:] = np.where(new[1:], -1, order[:-1])
    last[order] = found
    return last


class Course:
    """What the bits FOLLOWS and AGAIN of each token are, whether they are coded, and their contexts. A text's last token is its end."""

    def __init__(self, of: np.ndarray, first: np.ndarray, sizes: np.ndarray):
        """of: the distinct word of each token; first: tokens before each text; sizes: bytes of the distinct words."""
        n, m = len(first) - 1, int(of.max(initial=0)) + 2
        counts = np.diff(first) + 1
        self.first = np.concatenate([[0], np.cumsum(counts)])
        total = int(self.first[-1])
        self.text = np.repeat(np.arange(n, dtype=np.int32), counts)
        self.end = self.first[1:] - 1
        self.word = word = np.full(total, m - 1, np.int32)
        inside = np.ones(total, bool)
        inside[self.end] = False
        word[inside] = of
        del inside
        self.place = (np.arange(total) - self.first[:-1][self.text]).astype(np.int32)
        order, fresh = _grouped(self.text * np.int64(m) + word)
        heads = np.flatnonzero(fresh)
        sizes_ = np.diff(np.append(heads, total))
        had, one, same = (np.empty(total, np.int32) for _ in range(3))
        had[order] = np.arange(total) - np.repeat(heads, sizes_)
        one[order], same[order] = np.repeat(order[heads], sizes_), np.repeat(np.arange(len(heads)), sizes_)
        del order, fresh, heads, sizes_
        self.had = had
        # distinct words of the text before each token, and the word's number among them
        new = np.cumsum(had == 0, dtype=np.int32)
        self.types = new - (had == 0) - (new[self.first[:-1]] - 1)[self.text]
        self.number = self.types[one]
        del had, one, new
        # the tokens that followed the last word, and the last two, when the text had them before
        after_one, after_two = self._after(1, same), self._after(2, same, word)
        del same
        self.level = np.where(after_two >= 0, 2, np.where(after_one >= 0, 1, 0)).astype(np.int8)
        guess = np.where(after_two >= 0, word[after_two], np.where(after_one >= 0, word[after_one], -1))
        self.bits = np.stack([guess == word, self.had > 0])
        del guess, after_one, after_two
        self.coded = np.stack([self.level > 0, ~self.bits[0] & (self.place > 0)])
        # contexts, hashed into tables of each bit
        outcome = np.where(self.bits[0], 2, np.where(self.bits[1], 1, 0)).astype(np.int8)
        back = lambda k: np.where(self.place >= k, np.roll(outcome, k), 3).astype(np.int16)
        size = np.append(np.minimum(sizes, 7), 7).astype(np.int16)
        length = np.where(self.place > 0, np.roll(size[np.minimum(word, len(size) - 1)], 1), 0).astype(np.int16)
        bucket = np.minimum(np.log2(self.place + 1).astype(np.int16), 15)
        slots = (mix(np.arange(SEEN * 1000).astype(U)) >> U(56)).astype(np.uint8)
        raw = (self.level * np.int16(64) + back(1) * 16 + back(2) * 4 + back(3), (self.level * np.int16(8) + length) * 4 + back(1), (bucket * np.int16(3) + self.level) * 4 + back(1))
        self.contexts = np.stack([slots[c + 1000 * k] for k, c in enumerate(raw)])

    def _after(self, k: int, same: np.ndarray, word: np.ndarray | None = None) -> np.ndarray:
        """For each place the last one before it in the text that came after the same k words; -1: none. same: which of the texts' words each is."""
        at = np.flatnonzero(self.place >= k).astype(np.int32)
        key = same[at - 1] if word is None else same[at - 1] * np.int64(int(word.max(initial=0)) + 1) + word[at - 2]
        last, out = _last(*_grouped(key)), np.full(len(self.place), -1, np.int32)
        out[at] = np.where(last >= 0, at[last], -1)
        return out

    def counts(self, held: np.ndarray) -> np.ndarray:
        """How often each bit was 0 and 1 in each context, of the texts that aren't held out."""
        own = ~held[self.text]
        out = np.zeros((2, SEEN, SLOTS, 2), np.int64)
        for f in (FOLLOWS, AGAIN):
            pick = own & self.coded[f]
            for k in range(SEEN):
                out[f, k] = np.bincount(self.contexts[k][pick].astype(np.int64) * 2 + self.bits[f][pick], minlength=2 * SLOTS).reshape(SLOTS, 2)
        return out


def _steps(cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bits in order of their cells: the order in which the first bit of each cell comes before all second ones, and so on, those of cells
    with more bits first; where each such step begins; and the rank of each cell. So the bits of a step belong to the first cells by
    rank, and what a cell has learned lies in the same place in all of them."""
    n = np.bincount(cell, minlength=cells)
    ranks, rank = np.argsort(-n, kind="stable"), np.empty(cells, np.int32)
    rank[ranks] = np.arange(cells, dtype=np.int32)
    most = int(n.max(initial=0))
    cuts = np.concatenate([[0], np.cumsum(np.searchsorted(-n[ranks], -np.arange(most), "left"))])
    own = rank[cell]
    to = cuts[np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)]
    to += own
    order = np.empty(len(cell), np.int32)
    order[to] = np.arange(len(cell), dtype=np.int32)
    return order, cuts, rank


class Flow:
    """Weights and refinement of the bits of running text; `logs` adapts copies of them along each segment."""

    def __init__(self, counts: np.ndarray, unknown: float):
        """counts: of `Course.counts`, all of training; unknown: the share of training tokens that only they have."""
        c = counts.astype(np.float64)
        self.odds = np.log((c[..., 1] + 0.4) / (c[..., 0] + 0.4)).astype(np.float32)
        share = min(max(unknown, 1e-7), 1 - 1e-7)
        self.known = np.float32(np.log((1 - share) / share))
        self.weights = np.array([0.4, 0.3, 0.2, 0.1], np.float32)

    def logs(self, course: Course, known: np.ndarray) -> np.ndarray:
        """log10 of the bits of each token. known: whether training had it."""
        bits = np.concatenate([course.bits, known[None]])
        coded = np.concatenate([course.coded, (~course.bits[0] & ~course.bits[1])[None]])
        parts = -(-np.diff(course.first) // SEGMENT)
        lane = ((np.cumsum(parts) - parts)[course.text] + course.place // SEGMENT).astype(np.int32)
        f, on = np.nonzero(coded)
        lanes, f, on = int(parts.sum()), f.astype(np.int8), on.astype(np.int32)
        # each bit of each segment has weights of its own; all go on side by side
        cell = f * np.int32(lanes) + lane[on]
        order, cuts, rank = _steps(cell, 3 * lanes)
        gate = (rank.take(cell) * np.int32(3) + course.level.take(on)).take(order)
        bit, f, on = bits[f, on].take(order), f.take(order), on.take(order)
        del order, lane, coded, cell
        table = np.full((3, SEEN, SLOTS), self.known, np.float32)
        table[:KNOWN] = self.odds
        table, slot = table.ravel(), np.empty((len(on), SEEN), np.int16)
        for k in range(SEEN):
            slot[:, k] = course.contexts[k].take(on) + (f * np.int16(SEEN) + np.int16(k)) * np.int16(SLOTS)
        del f, rank
        w = np.tile(self.weights, (9 * lanes, 1))  # bit, lane, gate; input
        rows = w.view(np.complex128).ravel()  # four numbers as one are stored faster
        refine = np.tile((1 / (1 + np.exp(-_MIDDLES))).astype(np.float32), 3 * lanes)
        ones, zeros = (np.full(3 * lanes, 0.4, np.float32) for _ in range(2))
        refined = np.arange(3 * lanes, dtype=np.int32) * np.int32(CELLS)
        out, one = np.empty(len(on), np.float32), np.float32(1)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            n, g, z = b - a, gate[a:b], bit[a:b]
            y, x = z.astype(np.float32), np.empty((n, 4), np.float32)
            x[:, :SEEN] = table.take(slot[a:b])
            x[:, 3] = np.log(ones[:n] / zeros[:n])
            weights = w.take(g, axis=0)
            s = np.clip(np.einsum("ij,ij->i", weights, x), -8, 8)
            p = one / (one + np.exp(-s))
            part = (s + np.float32(8)) * np.float32((CELLS - 1) / 16)
            low = np.minimum(part.astype(np.int32), CELLS - 2)
            part -= low.astype(np.float32)
            low += refined[:n]
            left, right = refine.take(low), refine.take(low + 1)
            q = np.clip((p + left * (one - part) + right * part) * np.float32(0.5), np.float32(1e-5), np.float32(1 - 1e-5))
            out[a:b] = np.where(z, q, one - q)
            x *= (np.float32(RATE) * (y - p))[:, None]
            x += weights
            rows[g] = x.view(np.complex128).ravel()
            part *= np.float32(REFINED)
            refine[low] = left + (np.float32(REFINED) - part) * (y - left)
            refine[low + 1] = right + part * (y - right)
            ones[:n] += y
            zeros[:n] += one - y
        return np.bincount(on, weights=np.log10(out.astype(np.float64)), minlength=len(course.word))


class Recall:
    """Bits that tell which of its words a text repeats: those of the word's number, by first appearance, from the highest, at which
    earlier tokens of the text part. So the probabilities of all words that the text had sum to 1, whatever comes later."""

    #: Predictors: tokens of either side so far; distinct words of either side; the side last taken; what the segment did at this height.
    WEIGHTS = (1.1, 0.0, 0.2, 0.1)

    #: Tokens of texts that are taken at a time; a longer text is taken whole.
    TOKENS = 1 << 18

    def __init__(self, course: Course, begin: int = 0, stop: int | None = None):
        """begin, stop: of the texts."""
        self.first = course.first[begin : (len(course.first) - 1 if stop is None else stop) + 1]
        ends = self.first[1:] - 1
        types, base = course.types[ends], begin
        heights = np.frexp(np.maximum(types - 1, 0).astype(float))[1]  # bits of the highest number
        texts = np.argsort(-heights, kind="stable")  # those with more words first, so that each round is of the first ones
        begin, end = self.first[:-1][texts], ends[texts]
        token = gather_spans(np.arange(len(course.word), dtype=np.int32), begin, end)
        begins, size = np.zeros(len(token) + 1, bool), np.concatenate([[0], np.cumsum(end - begin)])
        begins[size] = True
        until = size[np.searchsorted(-heights[texts], -np.arange(1, heights.max(initial=0) + 1), "right")]
        what = course.number[token] << 1 | (course.bits[AGAIN] & ~course.bits[FOLLOWS])[token]  # and whether it is to be told
        rows = [[np.zeros(0, np.int32)] for _ in range(6)]
        # a group is the tokens of a text with the same high bits, in their order; each round parts all groups by the next bit
        for h, n in reversed(list(enumerate(until.tolist()))):
            v, i = what[:n], np.arange(n, dtype=np.int32)
            side = v >> (h + 1) & 1
            heads = np.flatnonzero(begins[:n]).astype(np.int32)
            sizes = np.diff(np.append(heads, n))
            before = np.cumsum(side, dtype=np.int32) - side
            ones = before - np.repeat(before[heads], sizes)
            zeros = i - np.repeat(heads, sizes) - ones
            pick = np.flatnonzero((v & 1).astype(bool) & (ones > 0) & (zeros > 0))
            for kept, x in zip(rows, (token[pick], np.full(len(pick), h, np.int32), ones[pick], zeros[pick], side[pick - 1], side[pick])):
                kept.append(x)
            if h == 0:
                break
            split = heads + sizes.astype(np.int32) - np.add.reduceat(side, heads)
            to = np.where(side == 1, np.repeat(split, sizes) + ones, i - ones)
            for x in (token, what):
                moved = np.empty(n, np.int32)
                moved[to] = x[:n]
                x[:n] = moved
            begins[split] = True
        self.token, self.height, self.ones, self.zeros, self.last, self.side = (np.concatenate(x) for x in rows)
        self.course, self.base = course, base

    @classmethod
    def all_logs(cls, course: Course) -> np.ndarray:
        """`logs` of all texts."""
        out, i, n = np.zeros(len(course.word)), 0, len(course.first) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(course.first, course.first[i] + cls.TOKENS, "right")) - 1)
            out[course.first[i] : course.first[j]] = cls(course, i, j).logs()
            i = j
        return out

    def logs(self) -> np.ndarray:
        """log10 of the choice of each of the texts' tokens among the words that the text had; 0 for others. Weights are adapted after each bit, and start anew
        every `SEGMENT` tokens."""
        course, token, h = self.course, self.token, self.height
        right = np.minimum(course.types.take(token) - ((course.number.take(token) >> (h + 1) << 1 | 1) << h), 1 << h)
        most = int(max(self.ones.max(initial=0), self.zeros.max(initial=0), right.max(initial=0), (1 << h).max(initial=0)))
        log = np.log(np.arange(most + 1) + 0.4).astype(np.float32)
        x = [log.take(self.ones) - log.take(self.zeros), log.take(right) - log.take(1 << h), (2 * self.last - 1).astype(np.float32)]
        begin, end, n_heights = self.first[0], self.first[-1], int(h.max(initial=0)) + 1
        parts = -(-np.diff(self.first) // SEGMENT)
        place = course.place[begin:end]
        key = ((np.cumsum(parts) - parts)[course.text[begin:end] - self.base] + place // SEGMENT) * (n_heights * SEGMENT) + place % SEGMENT
        cells = int(parts.sum()) * n_heights
        order, cell = _sorted(key.take(token - begin) + h * np.int64(SEGMENT))  # a token has one bit at a height
        by_step, cuts, _ = _steps(cell // SEGMENT, cells)
        order = order.take(by_step)
        del cell, place, by_step, key, right, h
        bit, token, x = (self.side == 1).take(order), token.take(order), [v.take(order) for v in x]
        del order
        w = [np.full(cells, v, np.float32) for v in self.WEIGHTS]
        ones, zeros = (np.full(cells, 0.4, np.float32) for _ in range(2))
        out, one = np.empty(len(token), np.float32), np.float32(1)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            n, z = b - a, bit[a:b]
            y, inputs = z.astype(np.float32), [*(v[a:b] for v in x), np.log(ones[:n] / zeros[:n])]
            s = sum(u[:n] * v for u, v in zip(w, inputs))
            p = one / (one + np.exp(-np.clip(s, -8, 8)))
            out[a:b] = np.where(z, p, one - p)
            p -= y
            p *= np.float32(RATE)
            for u, v in zip(w, inputs):
                u[:n] -= p * v
            ones[:n] += y
            zeros[:n] += one - y
        return np.bincount(token - begin, weights=np.log10(out.astype(np.float64)), minlength=int(end - begin))


def text_scores(course: Course, flow: Flow, counts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """log10 of each text's probability. counts, chosen: of the distinct words, and of the end in the last place; chosen: log10 of the choice
    among training's words, or of the spelling of a word that training hasn't."""
    known, choice = counts[np.minimum(course.word, len(counts) - 1)] > 0, chosen[np.minimum(course.word, len(chosen) - 1)]
    token = flow.logs(course, known) + np.where(course.bits[FOLLOWS] | course.bits[AGAIN], 0, choice) + Recall.all_logs(course)
    return np.bincount(course.text, weights=token, minlength=len(course.first) - 1)


# -- chunks and buckets ------------------------------------------------------------------------------------------------


def packs(docs: DataFrame, id_column: str, text_column: str, chunk_bytes: int, n_buckets: int) -> DataFrame:
    """Documents in stored chunks, which keep their numbers however often they are read: `words`, the distinct words by hash, lower-cased,
    with their training counts; `tokens`, ids, bytes, the sequence of words, and which of them are in which bucket; `course`, counts
    of the running text's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, limit=chunk_bytes):
                data, at = buffers(part.column(1))
                data = LOWER[data] if len(data) else data
                ids = part.column(0)
                null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                held = np.array([not x and held_out(i) for x, i in zip(null.tolist(), ids.tolist())], bool)
                a, b, first = words(data, at, NOT_SPACE)
                keys, one, of = distinct(span_hashes(data, a, b))
                count = np.bincount(of[np.repeat(~held, np.diff(first))], minlength=len(keys)).astype(np.int64)
                s, e = a[one], b[one]
                cuts = np.array([(bucket, i) for bucket, i, _ in _cuts(keys, n_buckets)], np.int32).reshape(-1, 2)
                row = [_squeeze(keys, e - s, count, gather_spans(data, s, e)), _squeeze(null, ids, np.diff(at), held, first, of.astype("<u4"), (e - s).astype("<u4"), cuts)]
                del data, a, b, keys, one, count
                row.append(Course(of, first, e - s).counts(held).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], ["chunk", "words", "tokens", "course"])
                number += 1

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_of(docs, text_column).alias("text"))
    return stored(rows.mapInArrow(run, "chunk long, words binary, tokens binary, course binary"), "lm_chunks")


def _cuts(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, int]]:
    of = buckets_of(keys, n_buckets)
    at = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.zeros(0, np.int64)
    return zip(of[at].tolist(), at.tolist(), [*at[1:].tolist(), len(of)])


def coursed(chunks: DataFrame) -> np.ndarray:
    """The sum of the chunks' counts: a row a slot, whatever the number of chunks."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * SEEN * SLOTS * 2, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                out += np.frombuffer(blob.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["slot", "n"])

    out = np.zeros(2 * SEEN * SLOTS * 2, np.int64)
    for slot, n in chunks.select("course").mapInArrow(total, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        out[slot] = n
    return out.reshape(2, SEEN, SLOTS, 2)


def counted(chunks: DataFrame, n_buckets: int) -> DataFrame:
    """A row for each bucket of words: the merged words with their training counts, and which of them each chunk has."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, sizes, count, text = _spread(blob.as_py(), "<u8", "<i8", "<i8", "u1")
                begin = np.concatenate([[0], np.cumsum(sizes)])
                cuts = list(_cuts(keys, n_buckets))
                blobs = [_squeeze(keys[i:j], sizes[i:j], count[i:j], text[begin[i] : begin[j]]) for _, i, j in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts], pa.int32()), pa.array([chunk] * len(cuts), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "blob"])

    def merge(group: pa.Table) -> pa.Table:
        chunks_ = group.column("chunk").to_numpy()
        parts = [_spread(b, "<u8", "<i8", "<i8", "u1") for b in group.column("blob").to_pylist()]
        keys, sizes, counts, data = (np.concatenate(x) for x in zip(*parts))
        merged, one, of = distinct(keys)
        total = np.bincount(of, weights=counts, minlength=len(merged)).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        cut = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        text = gather_spans(data, begin[one], begin[one] + sizes[one])
        blob = _squeeze(sizes[one], total, text, chunks_, cut, of.astype("<u4"))
        known = total > 0
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "n_known": pa.array([int(known.sum())], pa.int64()), "n_once": pa.array([int((total == 1).sum())], pa.int64()), "n_tokens": pa.array([int(total.sum())], pa.int64()), "blob": pa.array([blob], pa.binary())})

    sent = chunks.select("chunk", "words").mapInArrow(send, "bucket int, chunk long, blob binary")
    return stored(sent.groupBy("bucket").applyInArrow(merge, "bucket int, n_known long, n_once long, n_tokens long, blob binary"), "lm_words")


def _merged(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes, counts, text, chunks_, cut, of = _spread(blob, "<i8", "<i8", "u1", "<i8", "<i8", "<u4")
    return np.concatenate([[0], np.cumsum(sizes)]), counts, text, chunks_, cut, of


class Bucket:
    """The words of a bucket spelled, their distinct pairs, and which one each predictor has at each byte."""

    def __init__(self, at: np.ndarray, text: np.ndarray):
        self.spelled = Spelled(text, at)
        parts = [distinct(x, 8)[::2] for x in self.spelled.pairs()]  # a predictor at a time, which stays in cache
        self.pairs, _, of = distinct(np.concatenate([x for x, _ in parts]), 8)
        cuts = np.cumsum([0, *(len(x) for x, _ in parts)])
        self.of, self.begin = np.stack([of[a:b][x] for (_, x), a, b in zip(parts, cuts, cuts[1:])]), at + np.arange(len(at))

    def counts(self, counts: np.ndarray) -> np.ndarray:
        """Of the pairs; 0 where only held-out texts have them."""
        return np.bincount(self.of.ravel(), weights=np.tile(counts[self.spelled.word].astype(np.float64), ORDERS), minlength=len(self.pairs)).astype(np.int64)

    def batches(self, pick: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words, and the places of their bytes."""
        places = np.arange(len(self.spelled.flat))
        for i in range(0, len(pick), step):
            k = pick[i : i + step]
            yield k, gather_spans(places, self.begin[k], self.begin[k + 1])


def _shards(pairs: np.ndarray, n_shards: int) -> Iterator[tuple[int, int, int]]:
    of = buckets_of(pairs, n_shards)
    at = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.zeros(0, np.int64)
    return zip(of[at].tolist(), at.tolist(), [*at[1:].tolist(), len(of)])


def _end() -> Spelled:
    return Spelled(np.zeros(0, np.uint8), np.zeros(2, np.int64), END)


def informed(lexicon: DataFrame, n_shards: int, n_ends: int) -> tuple[DataFrame, Answers]:
    """The buckets with what the shards say of their pairs; and the same of the end of a text, which no bucket has."""
    spark, schema = lexicon.sparkSession, "shard int, bucket int, blob binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                at, counts, text, *_ = _merged(blob.as_py())
                words_ = Bucket(at, text)
                pairs, n = words_.pairs, words_.counts(counts)
                for shard, i, j in _shards(pairs, n_shards):
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([bucket], pa.int32()), pa.array([_squeeze(pairs[i:j], n[i:j])], pa.binary())], ["shard", "bucket", "blob"])

    def answer(group: pa.Table) -> pa.Table:
        parts = [_spread(b, "<u8", "<i8") for b in group.column("blob").to_pylist()]
        pairs, n = merged_pairs(*(np.concatenate(x) for x in zip(*parts)))
        found = on_path(pairs, n)
        found = found.astype("<u4" if found.max(initial=0) < 1 << 32 else "<i8")
        blobs = [struct.pack("<b", found.itemsize) + _squeeze(found[:, np.searchsorted(pairs, own)]) for own, _ in parts]
        return pa.table({"shard": group.column("shard"), "bucket": group.column("bucket"), "blob": pa.array(blobs, pa.binary())})

    ends, n = merged_pairs(_end().pairs().reshape(-1), np.full(ORDERS, n_ends, np.int64))
    own = [(shard, -1, _squeeze(ends[i:j], n[i:j])) for shard, i, j in _shards(ends, n_shards)]
    sent = lexicon.select("bucket", "blob").mapInArrow(send, schema).union(spark.createDataFrame(own, schema))
    answers = stored(sent.groupBy("shard").applyInArrow(answer, schema), "lm_answers")

    def joined(group: pa.Table, told: pa.Table) -> pa.Table:
        say = [b for _, b in sorted(zip(told.column("shard").to_pylist(), told.column("blob").to_pylist()))]
        return pa.table({"bucket": group.column("bucket"), "blob": group.column("blob"), "answers": pa.array([say], pa.list_(pa.binary()))})

    both = lexicon.select("bucket", "blob").groupBy("bucket").cogroup(answers.where("bucket >= 0").groupBy("bucket"))
    rows = stored(both.applyInArrow(joined, "bucket int, blob binary, answers array<binary>"), "lm_informed")
    return rows, Answers(ends, _found(r.blob for r in answers.where("bucket < 0").orderBy("shard").collect()))  # five pairs


def _found(blobs: Iterator[bytes]) -> np.ndarray:
    parts = [_spread(bytes(b[1:]), "<u4" if b[0] == 4 else "<i8")[0].reshape(9, -1) for b in blobs]
    return np.concatenate(parts, axis=1) if parts else np.zeros((9, 0), np.uint32)


def _answers(at: np.ndarray, counts: np.ndarray, text: np.ndarray, blobs: list[bytes]) -> Answers:
    return Answers(Bucket(at, text).pairs, _found(blobs))


def learned(rows: DataFrame) -> tuple[Mixer, Mixer]:
    """Weights of spellings and of choices, adapted over all training words, bucket by bucket, and averaged by the tokens that each saw;
    refinements added up. A choice is learned from words that training has without their one, too. Sums are of whole numbers, so
    they don't depend on which task has which bucket; they are a row a weight."""
    starts = (Mixer(), chooser())
    n = starts[0].weights.size
    size = 1 + n + starts[0].refine.size

    def adapt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (2 * size)
        for batch in batches:
            for blob, say in zip(batch.column(0), batch.column(1)):
                at, counts, text, *_ = _merged(blob.as_py())
                words_, mixers, found = Bucket(at, text), (Mixer(), chooser()), _found(say.as_py())
                x, known = odds(words_.pairs, found, True)
                bits, parts = words_.spelled.bits(), Forks.parting(found)
                del found
                for part, (mixer, start, least) in enumerate(zip(mixers, starts, (1, 2))):
                    pick, seen = np.flatnonzero(counts >= least), 0
                    for round_ in range(min(SETTLED, max(1, SETTLED * BATCH // max(1, len(pick))))):  # weights settle over some batches; words of few are gone over again
                        for k, places in words_.batches(pick, BATCH):
                            if part:
                                forks = Forks(words_.spelled, words_.of, parts, x, known, places)
                                mixer.step(forks.x, forks.level, forks.place, forks.bit, counts[forks.word].astype(np.float64))
                            else:
                                mixer.adapt(x, known, words_.of[:, places], bits[places], counts[words_.spelled.word[places]].astype(np.float64))
                            seen += int(counts[k].sum()) if round_ == 0 else 0
                        if not seen:
                            break
                    own = [seen, *(int(v) * seen for v in np.rint(mixer.weights * 2**20).ravel()), *np.rint(mixer.refine - start.refine).ravel().astype(np.int64).tolist()]
                    total[part * size : (part + 1) * size] = [x_ + y for x_, y in zip(total[part * size :], own)]
                del words_, x, known, bits, parts  # else they are there beside those of the next bucket
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total))), pa.array([str(v) for v in total])], ["slot", "n"])

    sums = rows.select("blob", "answers").mapInArrow(adapt, "slot long, n string").groupBy("slot").agg(F.sum(F.col("n").cast("decimal(38,0)"))).collect()
    total, out = {slot: int(v) for slot, v in sums}, []
    for part, start in enumerate(starts):
        own = [total.get(part * size + j, 0) for j in range(size)]
        if own[0]:
            start = Mixer(np.array([v / own[0] / 2**20 for v in own[1 : n + 1]]).reshape(start.weights.shape), start.refine + np.array(own[n + 1 :], float).reshape(start.refine.shape))
        out.append(start)
    return tuple(out)


def scored(docs: DataFrame, chunk_bytes: int = CHUNK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """RESULT: one row a document. score: log10 of the model's probability of the text; bits_per_byte: the same in bits, by
    bytes of text (null for an empty one)."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    n_buckets = max(1, n_bytes // chunk_bytes)
    n_ends = docs.where(F.coalesce(F.crc32(F.col(id_column).cast("string")) % 5, F.lit(0)) != 1).count()
    chunks = packs(docs, id_column, text_column, chunk_bytes, n_buckets)
    lexicon = counted(chunks, n_buckets)
    n_known, n_once, n_tokens = lexicon.agg(F.sum("n_known"), F.sum("n_once"), F.sum("n_tokens")).first()
    total, distinct = (n_tokens or 0) + n_ends, (n_known or 0) + (n_ends > 0)
    rows, ends = informed(lexicon, n_buckets, n_ends)
    mixers = learned(rows)
    spelled, end = ends.looked_up(_end()), _end()
    end_score = float(Forks(end, spelled[2], Forks.parting(spelled[1]), *odds(*spelled[:2], False), np.arange(1)).logs(mixers[1], 1)[0] if n_ends else mixers[0].score(spelled, end, 1)[0])
    model = spark.sparkContext.broadcast(mixers)
    flow = spark.sparkContext.broadcast(Flow(coursed(chunks), (n_once or 0) / max(total, 1)))

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob, say in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                at, counts, text, chunks_, cut, of = _merged(blob.as_py())
                words_ = Bucket(at, text)
                found = _found(say.as_py())
                x, known = odds(words_.pairs, found, False)
                parts = Forks.parting(found)
                del found
                bits, score, (spelling, choice) = words_.spelled.bits(), np.zeros(len(counts), np.float32), model.value
                for k, places in words_.batches(np.flatnonzero(counts), BATCH):
                    score[k] = Forks(words_.spelled, words_.of, parts, x, known, places).logs(choice, len(counts))[k]
                for k, places in words_.batches(np.flatnonzero(counts == 0), BATCH):
                    logs = spelling.logs(x, known, words_.of[:, places], bits[places])
                    score[k] = np.bincount(words_.spelled.word[places], weights=logs, minlength=len(counts))[k]
                del words_, x, known, bits, parts
                blobs = [_squeeze(counts[of[i:j]].astype("<u4" if total < 1 << 32 else "<i8"), score[of[i:j]]) for i, j in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(chunks_, pa.int64()), pa.array([bucket] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "bucket", "blob"])

    def finish(group: pa.Table, told: pa.Table) -> pa.Table:
        null, ids, sizes, held, first, of, lengths, cuts = _spread(group.column("tokens")[0].as_py(), "?", "<i8", "<i8", "?", "<i8", "<u4", "<u4", "<i4")
        of, cuts, n_words = of.astype(np.int64), cuts.reshape(-1, 2).tolist(), len(lengths)
        say = dict(zip(told.column("bucket").to_pylist(), told.column("blob").to_pylist()))
        count, score = np.zeros(n_words + 1), np.full(n_words + 1, end_score)
        for (bucket, i), j in zip(cuts, [*(i for _, i in cuts[1:]), n_words]):
            count[i:j], score[i:j] = _spread(say[bucket], "<u4" if total < 1 << 32 else "<i8", "<f4")
        count[-1] = n_ends
        n = np.diff(first)
        text = np.repeat(np.arange(len(n)), n)
        base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
        add = lambda x: np.bincount(text, weights=x[of], minlength=len(n))
        course = Course(of, first, lengths.astype(np.int64))
        course.word[course.end] = n_words
        whole = text_scores(course, flow.value, count, score)
        bits = np.where(sizes > 0, -whole * np.log2(10) / np.maximum(sizes, 1), np.nan)
        return pa.table({
            "doc_id": pa.array([None if x else i for x, i in zip(null.tolist(), ids.tolist())], pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(n + 1, pa.int64()), "n_known": pa.array(add(count > 0).astype(np.int64) + (n_ends > 0), pa.int64()),
            "train_tokens": pa.array(np.full(len(n), total), pa.int64()), "base_score": pa.array(add(base) + base[-1]), "score": pa.array(whole), "bits_per_byte": pa.array(bits, from_pandas=True),
        })

    replies = rows.mapInArrow(reply, "chunk long, bucket int, blob binary")
    return chunks.select("chunk", "tokens").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, RESULT)


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
