"""Token-id files written by an adaptive context-mixing range coder.

A file is a row of sections, each ended by a line feed: ``CMX1``, the length of what
follows, the place of the section (range partition, number in it), its documents (id,
number of ids) and its blocks. A block holds up to ``BLOCK`` ids, starts from the empty
model, carries a crc32 of its ids, and can be read alone.

Orders 1 and 2 guess the id that last followed the one id before, or the two before, with
a confidence. Whether order 2's guess is right, and if not, order 1's, is predicted from
both confidences: what each has been worth in the block so far is mixed in the logistic
domain, with weights learned from the mix's errors. The rest of the interval goes to order
0: counts of the block so far and an escape, behind which ids not met yet lie by rank, as
a tokenizer's frequent pieces have small ids. The model is renewed between segments of 32
to 512 ids. The shares narrow the interval of a range coder with a 48-bit window. All
blocks of a row advance in step, so that numpy works on ``LANES`` blocks at once.

Spark orders the documents (range partitions by id, sorted within), writes the sections
with its own text sink, which passes bytes through and commits on any file system, and
reads the files back as binary rows.

Null texts encode as empty: the end id alone. Rows repeated with one id are each
written, equal ids in the order of a hash of the text; null ids come first. An empty
table gives no files and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmosaic.llm.common import utf8_values, work_path
from cellmosaic.operators.joins import join_dim
from cellmosaic.session import durable

MAGIC = b"CMX1"
BLOCK = 8_192
LANES = 512
LEAST_BLOCK, LEAST_LANES = 1_024, 64
END_ID = 1
PARTITION_BYTES = 20 << 20  # text bytes of a range partition
CACHE_WORDS = 200_000
VOCABULARY = 49_408

_SLOTS = 8_192
_SURE = 16
_TOP_BITS, _PRIOR_BITS = 28, 24
_TOP = 1 << _TOP_BITS
_LOW = 1 << 32
_SEGMENT = 512
_TRUST = 12  # questions that the first belief in a confidence is worth
_STRETCH = np.array([round(256 * math.log((2 * i + 1) / (8_191 - 2 * i))) for i in range(4_096)], np.int64)
_FAR = 4 * 2_400  # no mix of two predictions lies farther out
_SQUASH = np.array([round(65_536 / (1 + math.exp(-max(-4_096, i - _FAR) / 256))) for i in range(2 * _FAR)],
                   np.int64).clip(64, 65_536 - 1_024)


def _segments(length: int) -> list[tuple[int, int]]:
    """The model is renewed after an eighth of what it has seen: 32 ids at least, ``_SEGMENT`` at most."""
    cuts = [0]
    while cuts[-1] < length:
        cuts.append(min(length, cuts[-1] + min(max(32, cuts[-1] // 8), _SEGMENT)))
    return list(zip(cuts, cuts[1:]))


def _contexts(last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = (last * 40503 >> 3) & (_SLOTS - 1)
    two = ((last * 0x9E3779B1 + before * 0x85EBCA77) >> 13) & (_SLOTS - 1)
    return one, two


class _Question:
    """A yes-or-no question that two predictions answer, mixed in the logistic domain.

    A prediction is how often the answer was yes in a state (confidences of the orders);
    the weights of the two follow the mix's errors. Both are learned per block and renewed
    between segments, in whole numbers, so that encoder and decoder agree on any machine.
    """

    STATES = 2 * _SURE

    def __init__(self, n: int):
        first = (np.arange(self.STATES) % _SURE * 4 + 4) * 65_536 // (5 * _SURE)
        self.first = np.tile(first, n)
        self.asked = np.zeros((2, n * self.STATES), np.int64)
        self.yes = np.zeros((2, n * self.STATES), np.int64)
        self.weights = np.full((2, n), 40_000, np.int64)
        self.renew()

    def renew(self) -> None:
        held = ((self.yes << 16) + _TRUST * self.first) // (self.asked + _TRUST)
        self.inputs = _STRETCH[held.clip(0, 65_535) >> 4]
        self.terms = (self.inputs * np.repeat(self.weights, self.STATES, axis=1)) >> 16

    def share(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The share of yes, of 65,536; the states are given with the block's offset."""
        return _SQUASH[self.terms[0][one] + self.terms[1][two] + _FAR]

    def learn(self, states, asked: np.ndarray, yes: np.ndarray) -> None:
        """Answers of a segment (blocks x ids)."""
        error = ((yes.astype(np.int64) << 16) - self.share(*states)) * asked
        for k, state in enumerate(states):
            pull = (self.inputs[k][state] * error).sum(axis=1) >> 18
            self.weights[k] = (self.weights[k] + pull.clip(-8_192, 8_192)).clip(0, 1 << 17)
            bins = self.yes.shape[1]
            self.asked[k] += np.bincount(state[asked], minlength=bins)
            self.yes[k] += np.bincount(state[yes & asked], minlength=bins)
        self.renew()


class _Model:
    """What a row of blocks has learned up to the last renewal.

    Order 0 is one sorted array for all blocks: ``keys`` are block and id, ``starts`` the
    counts of all keys before. A block's counts sum to ``seen``, so it starts at its number
    times ``seen``. Ids not met yet go by rank (``prior``): frequent pieces have small ids.
    """

    def __init__(self, n: int, vocabulary: int):
        self.n, self.v, self.seen = n, vocabulary, 0
        prior = np.concatenate([[0], np.cumsum((1 << 30) // (np.arange(vocabulary, dtype=np.int64) + 512))])
        self.prior = prior * (1 << _PRIOR_BITS) // prior[-1]
        self.keys = self.counts = self.starts = np.zeros(0, np.int64)
        self.new = np.ones(n, np.int64)  # weight of ids not met yet
        self.second, self.first = _Question(n), _Question(n)

    def shares(self, lanes: np.ndarray, guesses, sures):
        """Shares of the guesses of orders 1 and 2; states and masks that ``learn`` takes."""
        base, same, held2 = lanes * _Question.STATES, guesses[0] == guesses[1], sures[1] > 0
        held1 = (sures[0] > 0) & ~(same & held2)
        two = base + sures[1], base + sures[0] + _SURE * same
        one = base + sures[0] + _SURE * held2, base + sures[1]
        w2 = (self.second.share(*two) * held2) << (_TOP_BITS - 16)
        w1 = ((_TOP - w2) >> 16) * (self.first.share(*one) * held1)
        return w1, w2, (one, two, held1, held2)

    def spans(self, lanes: np.ndarray, ids: np.ndarray, rest: np.ndarray):
        """Start and size of ids in order 0's share, and which of them are new."""
        below, own = np.full(ids.shape, self.seen), self.new[lanes] + np.zeros_like(ids)
        total, unmet = self.seen + own, np.ones(ids.shape, bool)
        if self.seen:
            key = lanes * self.v + ids
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            unmet = self.keys[at] != key
            below = np.where(unmet, below, self.starts[at] - lanes * self.seen)
            own = np.where(unmet, own, self.counts[at])
        start = below * rest // total
        return start, (below + own) * rest // total - start, unmet

    def find(self, lanes: np.ndarray, value: np.ndarray, rest: np.ndarray):
        """The ids whose spans hold the values (0 for new ones), and the spans."""
        new = self.new[lanes]
        total = new + self.seen
        inside = ((value + 1) * total - 1) // rest
        unmet = inside >= self.seen
        ids, below, own = np.zeros_like(value), np.full_like(value, self.seen), new
        if self.seen:
            at = np.searchsorted(self.starts, lanes * self.seen + np.minimum(inside, self.seen - 1), "right") - 1
            ids = np.where(unmet, 0, self.keys[at] - lanes * self.v)
            below = np.where(unmet, below, self.starts[at] - lanes * self.seen)
            own = np.where(unmet, own, self.counts[at])
        start = below * rest // total
        return ids, start, (below + own) * rest // total - start, unmet

    def learn(self, ids: np.ndarray, guesses, sures) -> None:
        """Take in the ids of a segment (blocks x ids) and renew the model."""
        lanes = np.arange(self.n)[:, None]
        _, _, (one, two, held1, held2) = self.shares(lanes, guesses, sures)
        is2 = held2 & (ids == guesses[1])
        self.second.learn(two, held2, is2)
        self.first.learn(one, held1 & ~is2, held1 & (ids == guesses[0]))
        keys, counts = np.unique(lanes * self.v + ids, return_counts=True)
        at = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), bool)
        if len(self.keys):
            fresh = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        self.counts[at[~fresh]] += counts[~fresh]
        self.keys = np.insert(self.keys, at[fresh], keys[fresh])
        self.counts = np.insert(self.counts, at[fresh], counts[fresh])
        self.starts = np.cumsum(self.counts) - self.counts
        self.seen += ids.shape[1]
        self.new = np.bincount(self.keys // self.v, minlength=self.n) + 1


def _histories(ids: np.ndarray):
    """Guesses and confidences of orders 1 and 2 for every id of known blocks.

    A guess is the id that last followed the same context slot in the block; its
    confidence is 0 for a fresh slot, else one more than the right guesses in a row there,
    ``_SURE`` - 1 at most.
    """
    n, length = ids.shape
    guesses = [np.zeros((n, length), ids.dtype) for _ in range(2)]
    sures = [np.zeros((n, length), np.uint8) for _ in range(2)]
    at = np.arange(length)
    for lane in range(n):
        past = np.concatenate([[0, 0], ids[lane].astype(np.int64)])[:length + 1]
        for k, slots in enumerate(_contexts(past[1:], past[:-1])):
            slots = slots.astype(np.uint16)
            order = np.argsort(slots, kind="stable")
            followed, slot = ids[lane][order], slots[order]
            fresh = np.ones(length, bool)
            fresh[1:] = slot[1:] != slot[:-1]
            guess = np.zeros_like(followed)
            guess[1:] = followed[:-1]
            missed = np.maximum.accumulate(np.where((guess == followed) & ~fresh, -1, at))
            sure = np.zeros(length, np.int64)
            sure[1:] = at[1:] - missed[:-1]
            guesses[k][lane][order] = np.where(fresh, 0, guess)
            sures[k][lane][order] = np.where(fresh, 0, np.minimum(sure, _SURE - 1))
    return guesses, sures


def encode_blocks(ids: np.ndarray, vocabulary: int = VOCABULARY) -> list[bytes]:
    """``ids`` is blocks x ids (whole numbers below ``vocabulary``); the coded bytes of each block."""
    n, length = ids.shape
    model = _Model(n, vocabulary)
    guesses, sures = _histories(ids)
    low, size = np.zeros(n, np.int64), np.full(n, 1 << 48, np.int64)
    out = np.zeros((n, 4 * length + 4), np.uint32)  # pages that no word reaches take no memory
    flat, place = out.reshape(-1), np.arange(n, dtype=np.int64) * out.shape[1]
    begin = place.copy()

    def narrow(at, start, span, bits):
        unit = size[at] >> bits
        lo, wide, to = low[at] + unit * start, unit * span, place[at]
        for _ in range(2):
            thin = wide < _LOW
            flat[to] = lo >> 32  # a place that is not passed is written again
            to = to + thin
            lo = np.where(thin, (lo & (_LOW - 1)) << 16, lo)
            wide = np.where(thin, wide << 16, wide)
        low[at], size[at], place[at] = lo, wide, to

    lanes = np.arange(n, dtype=np.int64)[:, None]
    everywhere = slice(None)
    for lo, hi in _segments(length):
        now = ids[:, lo:hi].astype(np.int64)
        g, c = ([x[:, lo:hi].astype(np.int64) for x in y] for y in (guesses, sures))
        w1, w2, (_, _, held1, held2) = model.shares(lanes, g, c)
        start, span, unmet = model.spans(lanes, now, _TOP - w1 - w2)
        is2, is1 = held2 & (now == g[1]), held1 & (now == g[0])
        start = np.where(is2, 0, np.where(is1, w2, start + w1 + w2)).T.copy()
        span = np.where(is2, w2, np.where(is1, w1, span)).T.copy()
        unmet = (unmet & ~is2 & ~is1).T.copy()
        first = model.prior[now].T.copy()
        wide = model.prior[now + 1].T - first
        for t in range(hi - lo):
            narrow(everywhere, start[t], span[t], _TOP_BITS)
            new = np.flatnonzero(unmet[t])
            if len(new):
                narrow(new, first[t][new], wide[t][new], _PRIOR_BITS)
        model.learn(now, g, c)
    for shift in (32, 16, 0):
        flat[place] = low >> shift if shift == 32 else (low >> shift) & 0xFFFF
        place += 1
    used = place - begin
    return [_carried(out[i, :used[i]]) for i in range(n)]


def _carried(words: np.ndarray) -> bytes:
    """16-bit words, big end first, with the carries added."""
    plain = int.from_bytes((words & 0xFFFF).astype(">u2").tobytes(), "big")
    carry = int.from_bytes((words[1:] >> 16).astype(">u2").tobytes(), "big")
    return (plain + (carry << 16)).to_bytes(2 * len(words), "big")


def decode_blocks(blocks: list[bytes], length: int, vocabulary: int = VOCABULARY) -> np.ndarray:
    """blocks x ids; every block is read to ``length`` ids."""
    n = len(blocks)
    model = _Model(n, vocabulary)
    sizes = np.array([len(b) // 2 for b in blocks], np.int64)
    words = np.frombuffer(b"".join(blocks) + bytes(16), ">u2").astype(np.int64)
    place = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    code = (words[place] << 32) | (words[place + 1] << 16) | words[place + 2]
    place += 3
    size, end = np.full(n, 1 << 48, np.int64), len(words) - 1

    def narrow(at, start, span, unit):
        here, wide, to = code[at] - unit * start, unit * span, place[at]
        for _ in range(2):
            thin = wide < _LOW
            here = np.where(thin, (here << 16) | words[np.minimum(to, end)], here)
            wide = np.where(thin, wide << 16, wide)
            to = to + thin
        code[at], size[at], place[at] = here, wide, to

    lanes = np.arange(n, dtype=np.int64)
    everywhere = slice(None)
    # guess and confidence of a slot in one number
    tables = [np.zeros(n * _SLOTS, np.uint32) for _ in range(2)]
    last, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ids = np.zeros((n, length), np.uint16 if vocabulary <= 1 << 16 else np.uint32)
    for lo, hi in _segments(length):
        past = np.empty((5, hi - lo, n), np.int64)
        for t in range(hi - lo):
            slots = [lanes * _SLOTS + x for x in _contexts(last, before)]
            held = [table[x].astype(np.int64) for table, x in zip(tables, slots)]
            g, c = [x >> 4 for x in held], [x & 15 for x in held]
            w1, w2, _ = model.shares(lanes, g, c)
            unit, both = size >> _TOP_BITS, w1 + w2
            value = np.minimum(code // unit, _TOP - 1)
            is2 = value < w2
            now = np.where(is2, g[1], g[0])
            start, span = np.where(is2, 0, w2), np.where(is2, w2, w1)
            miss = np.flatnonzero(value >= both)
            held = both[miss]
            now[miss], first, span[miss], unmet = model.find(miss, value[miss] - held, _TOP - held)
            start[miss] = first + held
            narrow(everywhere, start, span, unit)
            new = miss[unmet]
            if len(new):
                unit = size[new] >> _PRIOR_BITS
                value = np.minimum(code[new] // unit, (1 << _PRIOR_BITS) - 1)
                found = np.minimum(np.searchsorted(model.prior, value, "right") - 1, vocabulary - 1)
                narrow(new, model.prior[found], model.prior[found + 1] - model.prior[found], unit)
                now[new] = found
            for k in range(2):
                right = (now == g[k]) & (c[k] > 0)
                tables[k][slots[k]] = (now << 4) | np.where(right, np.minimum(c[k] + 1, _SURE - 1), 1)
            past[:, t] = now, *g, *c
            before, last = last, now
        now, g1, g2, c1, c2 = past.transpose(0, 2, 1)
        ids[:, lo:hi] = now
        model.learn(now, (g1, g2), (c1, c2))
    return ids


def pack_section(part: int, number: int, doc_ids: list[int | None], counts: list[int], ids: np.ndarray,
                 vocabulary: int) -> bytes:
    """One section from the documents' ids laid end to end."""
    docs = struct.pack("<iiq", part, number, len(doc_ids))
    docs += np.array([i is None for i in doc_ids], np.uint8).tobytes()
    docs += np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array(counts, "<u4").tobytes()
    # a short section has shorter blocks, so that its steps still serve some of them at once
    length = max(1, min(BLOCK, len(ids), max(LEAST_BLOCK, len(ids) // LEAST_LANES)))
    n = -(-len(ids) // length)
    rows = np.zeros(n * length, ids.dtype)
    rows[:len(ids)] = ids
    coded = []
    for lane in range(0, n, LANES):
        coded += encode_blocks(rows.reshape(n, length)[lane:lane + LANES], vocabulary)
    sums = [zlib.crc32(ids[i * length:(i + 1) * length].astype("<u4").tobytes()) for i in range(n)]
    table = struct.pack("<qqi", len(ids), n, length)
    table += np.array([len(b) for b in coded], "<u4").tobytes() + np.array(sums, "<u4").tobytes()
    body = docs + table + b"".join(coded)
    return MAGIC + struct.pack("<q", len(body)) + body


def unpack_sections(data: bytes, vocabulary: int):
    """(part, number, doc ids, counts, ids) of each section; a wrong checksum is an error."""
    at = 0
    while at < len(data):
        if data[at:at + 4] != MAGIC:
            raise ValueError("not a section")
        end = at + 12 + struct.unpack_from("<q", data, at + 4)[0]
        part, number, m = struct.unpack_from("<iiq", data, at + 12)
        at += 28
        nulls = np.frombuffer(data, np.uint8, m, at)
        doc_ids = np.frombuffer(data, "<i8", m, at + m)
        counts = np.frombuffer(data, "<u4", m, at + 9 * m)
        at += 13 * m
        total, n, length = struct.unpack_from("<qqi", data, at)
        sizes = np.frombuffer(data, "<u4", n, at + 20)
        sums = np.frombuffer(data, "<u4", n, at + 20 + 4 * n)
        at += 20 + 8 * n
        ends = at + np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        ids = np.empty(total, np.uint32)
        for lane in range(0, n, LANES):
            some = range(lane, min(n, lane + LANES))
            rows = decode_blocks([data[ends[i]:ends[i + 1]] for i in some], length, vocabulary)
            for i, row in zip(some, rows):
                row = row[:total - i * length].astype("<u4")
                if zlib.crc32(row.tobytes()) != sums[i]:
                    raise ValueError(f"block {i} of section {part}.{number}: wrong checksum")
                ids[i * length:i * length + len(row)] = row
        yield part, number, [None if x else int(d) for x, d in zip(nulls, doc_ids)], counts, ids
        at = end + 1


class _Encoder:
    """Ids of whole texts through the tokenizers library, one call per new word.

    The tokenizer drops white space and lowers case before it splits, so a text's ids are
    those of its words one after the other. It splits letters from signs: a new word of
    letters and a run of signs behind them goes to the library's model in these two
    pieces, any other word goes through the whole library; so does one with a number sign
    (² ³ ¹ ¼ ½ ¾), which Python counts as a word character and the tokenizer as a number.
    Texts with the beginning of a special token go whole.
    """

    _PIECES = re.compile("([^\\W\\d_²³¹¼½¾]*)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}
        # the byte alphabet: printable bytes stand for themselves, the others follow 255
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            spelled = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            found = np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], np.uint16).tobytes()
            self.pieces[piece] = found
        return found

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if max(word) < "\u0250":  # Latin letters alone: composed, one lower case each
            low = word.lower()
            match = self._PIECES.fullmatch(low)
            if match:
                return self._piece(match[1]) + self._piece(match[2])
        return self._whole(word)

    def ids(self, text: bytes | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint16)
        if b"<|" in text:
            return np.frombuffer(self._whole(text.decode()), np.uint16)
        words = text.lower().split()
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint16)
        except KeyError:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
                self.pieces = {"": b""}
            for word in words:
                if word not in self.known:
                    self.known[word] = self._word(word)
            return np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint16)


def _encoder(path: str) -> _Encoder:
    """The process's encoder: one Python worker runs many tasks, and a new encoder knows no word.

    It hangs on the interpreter, as functions sent by value bring new globals for each task.
    """
    kept = sys.__dict__.setdefault("_cellmosaic_encoders", {})
    if path not in kept:
        kept[path] = _Encoder(path)
    return kept[path]


def _sections(path: str, end_id: int, vocabulary: int):
    def run(batches):
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        doc_ids, counts, parts, held, number = [], [], [], 0, 0

        def section():
            ids = np.concatenate(parts)
            parts.clear()
            data = pack_section(part, number, doc_ids, counts, ids, vocabulary)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["section"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8_values(batch.column("text"))):
                ids = encoder.ids(text)
                doc_ids.append(doc_id)
                counts.append(len(ids) + 1)
                parts += [ids, np.array([end_id], np.uint16)]
                held += len(ids) + 1
                if held >= BLOCK * LANES:
                    yield section()
                    doc_ids, counts, parts, held, number = [], [], [], 0, number + 1
        if doc_ids:
            yield section()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
              vocabulary: int = VOCABULARY) -> None:
    """Encode every text and write the files below ``path``, ascending by doc_id."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(max(1, -(-size // PARTITION_BYTES)), *order).sortWithinPartitions(*order)
    coded = rows.mapInArrow(_sections(tokenizer, end_id, vocabulary), "section binary")
    coded.select(F.col("section").cast("string")).write.text(path)


def _documents(vocabulary: int):
    def run(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                for part, number, doc_ids, counts, ids in unpack_sections(data, vocabulary):
                    ends = np.cumsum(counts, dtype=np.int64)
                    sums = [zlib.crc32(ids[e - c:e].tobytes()) for e, c in zip(ends.tolist(), counts.tolist())]
                    n = len(doc_ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)),
                         pa.array(doc_ids, pa.int64()), pa.array(ends - counts),
                         pa.array(counts.astype(np.int64)), pa.array(sums, pa.int64())],
                        ["part", "number", "doc_id", "within", "n_tokens", "ids_crc32"])

    return run


def read_index(spark: SparkSession, path: str, vocabulary: int = VOCABULARY) -> DataFrame:
    """Decode all files: doc_id, start, n_tokens, ids_crc32 per document."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    rows = durable(files.mapInArrow(
        _documents(vocabulary),
        "part int, number int, doc_id long, within long, n_tokens long, ids_crc32 long"))
    sections = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    sections = sections.select("part", "number", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    out = join_dim(rows, sections, ["part", "number"], ["doc_id"])
    return out.select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the id files into the shared folder and return their index."""
    spark = docs.sparkSession
    path = work_path(spark, "ids")
    write_ids(docs, path, tokenizer)
    return read_index(spark, path)
