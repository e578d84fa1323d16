"""Token ids in Re-Pair compressed blocks with random access.

Rows are range-partitioned and sorted by doc_id.  Each task encodes its texts, appends the end id and packs
runs of whole documents into blocks.  In a block, rounds of Re-Pair replace the most frequent neighbouring id
pairs by new symbols (a whole group of pairs in each round, occurrences from left to right without overlap), until no pair is
frequent.  A block stores the
rules, the expansion length of every rule and the remaining symbols; a running sum of the lengths finds the
symbols that cover any range of ids, and only those are expanded.

Files are written by Spark to the shared folder and hold (part, block, doc_ids, lengths, payload) rows, so a lost
task is simply written again.  Places of blocks are two short running sums (parts, blocks of a part).
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tremorlake.llm.text import column_bytes, hashes, slices, table, written

MODEL = "byte_bpe_50k.json"
END = 2
BLOCK_IDS = 1 << 20
PART_BYTES = 24 << 20
PAIRS = 8192  # new symbols of a round at most; rounds go on until no pair is frequent
SHORT = 64  # expansions up to this length are laid out when a block is opened
LEAST = 8  # occurrences from which a pair is worth a rule
SLICE = 3 << 20
TOGETHER = 10_000  # new pieces that the library gets at once
MAGIC = 0x52455041495231


# -- Re-Pair -----------------------------------------------------------------


def _frequent(seq: np.ndarray, at: np.ndarray | None, most: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, which): places of the most frequent pairs and the number of the pair there, looking at ``at`` (None: everywhere).

    Pairs are counted in hashed bins; a bin stands for the pair that is last in it, unless ``exact`` tells pairs apart.
    """
    key = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:] if at is None else (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1]
    shift = 64 - max(8, min(20, len(key).bit_length()))
    bin_of = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.int32)
    bins = 1 << (64 - shift)
    size = np.bincount(bin_of, minlength=bins)
    full = size[size >= LEAST]
    if not len(full):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(full, -most)[-most] if len(full) > most else LEAST
    near = np.flatnonzero((size >= least)[bin_of])
    if exact:
        _, bin_of = np.unique(key[near], return_inverse=True)
        bins = int(bin_of.max()) + 1
    else:
        key, bin_of = key[near], bin_of[near]
        stands = np.zeros(bins, np.uint64)
        stands[bin_of] = key
        mine = stands[bin_of] == key
        near, bin_of = near[mine], bin_of[mine]
    n = np.bincount(bin_of, minlength=bins)
    good = np.flatnonzero(n >= LEAST)
    good = good[np.argsort(-n[good], kind="stable")[:most]]
    number = np.full(bins, -1, np.int32)
    number[good] = np.arange(len(good))
    which = number[bin_of]
    near, which = near[which >= 0], which[which >= 0]
    return near if at is None else at[near], which


def compress(ids: np.ndarray, base: int, most: int = PAIRS) -> bytes:
    """A block of ids below ``base``, pairs replaced until none occurs ``LEAST`` times.

    After a round only pairs with one of its new symbols can have become frequent, so the next looks at those alone; when they
    give nothing, all pairs are looked at again, exactly, until that gives nothing either. Symbols stop at the number where
    each would need twice the bytes: beyond it no pair pays.
    """
    seq = ids.astype(np.uint32)
    rules = []
    symbols, at, exact = base, None, False
    limit = 1 << 16 if base < 1 << 16 else 1 << 32
    while len(seq) > 1 and symbols < limit:
        everywhere = at is None
        at, which = _frequent(seq, at, min(most, limit - symbols), exact and everywhere)
        if not len(at):
            if everywhere and exact:
                break
            at, exact = None, True
            continue
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # in a run of neighbouring places every second one is free
        offset = at - np.repeat(at[run], np.diff(np.append(run, len(at))))
        at, which = at[offset % 2 == 0], which[offset % 2 == 0]
        first = np.full(int(which.max()) + 1, -1)
        first[which[::-1]] = np.arange(len(which))[::-1]
        used = np.flatnonzero(first >= 0)
        renumber = np.cumsum(first >= 0) - 1
        first = at[first[used]]
        rules.append(np.stack([seq[first], seq[first + 1]], axis=1))
        seq[at] = symbols + renumber[which]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        symbols += len(used)
        made = at - np.arange(len(at))  # places of the new symbols, now that the ones after them are gone
        touched = np.zeros(len(seq), bool)
        touched[made], touched[np.maximum(made - 1, 0)] = True, True
        at = np.flatnonzero(touched[:-1])
    table_ = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    length = np.ones(symbols, np.uint32)
    for at, r in _levels(rules, base):
        length[at : at + len(r)] = length[r[:, 0]] + length[r[:, 1]]
    wide = np.uint16 if symbols <= 1 << 16 else np.uint32
    head = np.array([MAGIC, base, len(table_), len(seq), np.dtype(wide).itemsize, len(rules), *map(len, rules)], np.int64)
    return b"".join(x.tobytes() for x in (head, table_.astype(wide), length[base:], seq.astype(wide)))


def _levels(rules: list[np.ndarray], base: int):
    at = base
    for r in rules:
        yield at, r
        at += len(r)


class Block:
    """Reads a compressed block; ``ids`` and ``range`` expand all or a part of it."""

    def __init__(self, payload: bytes):
        magic, self.base, n, m, wide, rounds = np.frombuffer(payload, np.int64, 6)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        sizes = np.frombuffer(payload, np.int64, rounds, 48)
        kind, at = np.dtype(f"u{wide}"), 48 + 8 * int(rounds)
        rules = np.frombuffer(payload, kind, 2 * n, at).reshape(-1, 2).astype(np.int64)
        at += int(2 * n * wide)
        self.length = np.concatenate([np.ones(self.base, np.int64), np.frombuffer(payload, np.uint32, n, at).astype(np.int64)])
        self.seq = np.frombuffer(payload, kind, m, at + 4 * int(n)).astype(np.int64)
        # short expansions, one after the other; a round's rules only use earlier symbols
        self.rules, short = rules, np.where(self.length <= SHORT, self.length, 0)
        self.start = np.cumsum(short) - short
        self.flat = np.zeros(int(short.sum()), np.uint32)
        self.flat[: self.base] = np.arange(self.base)
        edge = 0
        for size in sizes:
            made = np.flatnonzero(short[self.base + edge : self.base + edge + size]) + self.base + edge
            r = rules[made - self.base]
            for side, shift in ((r[:, 0], 0), (r[:, 1], self.length[r[:, 0]])):
                to = self._spread(self.start[made] + shift, self.length[side])
                self.flat[to] = self.flat[self._spread(self.start[side], self.length[side])]
            edge += int(size)
        self.ends = np.cumsum(self.length[self.seq])

    @staticmethod
    def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        while True:  # symbols of long expansions fall into their two parts, so memory follows the result
            long = self.length[seq] > SHORT
            if not long.any():
                break
            parts = np.empty(len(seq) + int(long.sum()), np.int64)
            at = np.arange(len(seq)) + np.cumsum(long) - long
            split = self.rules[seq[long] - self.base]
            parts[at], parts[at[long]], parts[at[long] + 1] = seq, split[:, 0], split[:, 1]
            seq = parts
        return self.flat[self._spread(self.start[seq], self.length[seq])]

    def ids(self) -> np.ndarray:
        return self._expand(self.seq)

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, expanding only the symbols that cover them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = np.searchsorted(self.ends, [start, stop - 1], side="right")
        before = int(self.ends[first - 1]) if first else 0
        return self._expand(self.seq[first : last + 1])[start - before : stop - before]


# -- encoding ----------------------------------------------------------------

_LETTER, _DIGIT, _OTHER, _SPACE, _LINE, _ODD = range(6)


def _kinds() -> np.ndarray:
    k = np.full(256, _OTHER, np.uint8)
    for a, b, kind in ((65, 91, _LETTER), (97, 123, _LETTER), (128, 0xC0, _LETTER), (0xC3, 0xCA, _LETTER), (48, 58, _DIGIT), (0, 32, _ODD), (0xC0, 0xC3, _ODD), (0xCA, 256, _ODD)):
        k[a:b] = kind
    k[32], k[10], k[39], k[127] = _SPACE, _LINE, _ODD, _ODD
    return k


_encoders: dict[str, "Encoder"] = {}  # one for each Python worker, kept from task to task


class Encoder:
    """The tokenizers library, asked once for each different piece of text.

    A byte-level model first cuts a text into letter, digit and other runs, each with the space before it, and
    encodes each alone.  Texts of Latin letters with single spaces and line ends are cut here by those
    rules; any other text is one piece and goes to the library whole.
    """

    KINDS = _kinds()

    @classmethod
    def of_worker(cls, path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def __init__(self, path: str, most: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes of the pieces, sorted, and their numbers
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """True where a piece starts."""
        kind = self.KINDS[data]
        gap = (kind == _SPACE) | (kind == _LINE)
        odd = kind == _ODD
        odd[1:] |= gap[1:] & gap[:-1]
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs among the letters
        odd[1:] |= (data[:-1] == 60) & (data[1:] == 124)  # how special tokens begin
        cut = gap.copy()
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
        row = np.flatnonzero(np.diff(offsets))
        whole = row[np.add.reduceat(odd, offsets[row]) > 0] if len(row) else row
        for r in whole:
            cut[offsets[r] : offsets[r + 1]] = False
        cut[offsets[row]] = True
        return cut

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows without end ids, number of ids of each row)."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        first = np.flatnonzero(self._cuts(data, offsets))
        last = np.append(first[1:], len(data))
        back, piece = pd.factorize(hashes(data, first, last))
        at = np.empty(len(piece), np.int64)
        at[back[::-1]] = np.arange(len(back))[::-1]  # first place of each piece
        if len(self.place) > self.most or len(self.flat) > 8 * self.most:
            self._forget()
        near = np.searchsorted(self.known, piece)
        where = np.full(len(piece), -1)
        if len(self.known):
            slot = np.minimum(near, len(self.known) - 1)
            where = np.where(self.known[slot] == piece, self.place[slot], -1)
        fresh = np.flatnonzero(where < 0)
        if len(fresh):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(first[at[fresh]].tolist(), last[at[fresh]].tolist())]
            ids, sizes = [], []
            for i in range(0, len(texts), TOGETHER):
                got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + TOGETHER], add_special_tokens=False)]
                sizes += map(len, got)
                ids.append(np.fromiter(chain.from_iterable(got), np.uint32))
            size = np.array(sizes, np.int64)
            where[fresh] = np.arange(len(self.start), len(self.start) + len(fresh))
            self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
            self.length = np.append(self.length, size)
            self.flat = np.concatenate([self.flat, *ids])
            order = fresh[np.argsort(piece[fresh])]
            self.known, self.place = np.insert(self.known, near[order], piece[order]), np.insert(self.place, near[order], where[order])
        where = where[back]
        length = self.length[where]
        total = np.concatenate([[0], np.cumsum(length)])
        rows = np.searchsorted(first, offsets)
        return self.flat[Block._spread(self.start[where], length)], np.diff(total[rows])


# -- Spark -------------------------------------------------------------------


def write_blocks(docs: DataFrame, model: str, end: int = END, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode (doc_id, text) rows and write them as blocks in ascending doc_id order; returns the files' rows.

    A null text is empty and has the end id alone; a null doc_id comes first; rows with one doc_id come in the
    order of their text's hash.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.repartitionByRange(max(1, -(-size // PART_BYTES)), *order).sortWithinPartitions(*order)
    schema = "part int, block int, doc_ids array<long>, lengths array<long>, n_ids long, payload binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        encoder, held, docs_, size = None, [], [], 0

        def flush():
            ids = np.concatenate([x for x, _, _ in held])
            lengths = np.concatenate([n for _, n, _ in held])
            names = pa.chunked_array([d for _, _, d in held], pa.int64()).to_pylist()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([names], pa.list_(pa.int64())),
                 pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([compress(ids, encoder.base)], pa.binary())],
                names=["part", "block", "doc_ids", "lengths", "n_ids", "payload"],
            )

        for batch in batches:
            for piece in slices(batch, most=SLICE):
                encoder = encoder or Encoder.of_worker(model)
                ids, n = encoder.encode(*column_bytes(piece.column("text")))
                ids = np.insert(ids, np.cumsum(n), end)
                held.append((ids, n + 1, piece.column("doc_id")))
                size += len(ids)
                if size >= block_ids:
                    yield flush()
                    held, size, block = [], 0, block + 1
        if held:
            yield flush()

    return written(ranged.mapInArrow(pack, schema), "token-ids")


def read_blocks(blocks: DataFrame) -> DataFrame:
    """One row per document from the blocks: doc_id, start, n_tokens, ids_crc32."""
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per part
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("within"))
    starts = starts.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("within")).alias("start"))
    placed = blocks.join(starts, ["part", "block"]).select("doc_ids", "lengths", "start", "payload")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths = batch.column("doc_ids")[i].values, batch.column("lengths")[i].values.to_numpy()
                raw = Block(batch.column("payload")[i].as_buffer().to_pybytes()).ids().astype("<u4").tobytes()
                stop = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((stop - lengths).tolist(), stop.tolist())]
                start = batch.column("start")[i].as_py() + stop - lengths
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return placed.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_blocks(write_blocks(docs, public_tokenizers.path(MODEL)))


QUERIES = {"op9_token_store": op9_token_store}
ORACLE: dict[str, str] = {}
