"""Token counts with a compiled finite-state transducer.

A BPE model whose merges follow piece scores has a simple local form: a sequence of
pieces is the encoding of its text exactly if every two neighbours are the encoding of
theirs, and every prefix of the sequence encodes its own text.  So after each character
the last piece of the encoding so far is known from the last pieces at the earlier
places that a piece may still start from.  Those places (a vocabulary-trie node, the
last piece before it, its token count relative to the newest place) are the state of a
deterministic transducer; a transition is annotated with the change of the token count.

States are made when they are first met and kept in one table of (next state, count
change), which starts anew beyond a bounded number of cells, as in other lazy automata;
that
changes no result.  Texts are cut into chunks, all chunks of a slice advance
together.  A space after another character leads every state to one and the same state,
so a chunk's state map is: a head that depends on the entry state, then a constant.
Tails run first; then heads run from their predecessor's exit state, and chunks without
such a space are composed in order of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorlake.llm.text import column_bytes, slices, table

CHUNK = 512
MAX_CELLS = 40_000_000
#: A cell holds the next state and, in its low bits, the change of the count.
SHIFT = 7
SPREAD = 1 << SHIFT
LIMIT = 4096
MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_START = None  # nothing stands before the first piece
_ALONE = ""  # a character that no piece has; it is written as bytes


class Transducer:
    """Counts the pieces of texts as the model's own encoder does."""

    def __init__(self, path: str, max_cells: int = MAX_CELLS):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.score = {
            sp.id_to_piece(i): sp.get_score(i)
            for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        }
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece has a space inside")
        self.trie: list[dict[str, int]] = [{}]
        self.piece: list[str | None] = [None]
        for p in self.score:
            at = 0
            for c in p:
                if c not in self.trie[at]:
                    self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    self.piece.append(None)
                at = self.trie[at][c]
            self.piece[at] = p
        self.code = np.zeros(0x110000, np.int32)  # classes 0 to 3: unknown, of 1 to 4 bytes
        self.code[0x80:], self.code[0x800:], self.code[0x10000:] = 1, 2, 3
        for p in self.score:
            if len(p) == 1:
                self.code[ord(p)] = -1  # gets a class when it is first met
        self.chars: list[str | None] = [None] * 4 + [SPACE]
        self.space = self.code[0x20] = self.code[ord(SPACE)] = 4
        self.fits: dict[tuple, bool] = {}
        self.max_cells = max_cells
        self._reset(64)

    def _reset(self, width: int) -> None:
        self.width = width
        self.states: dict[tuple, int] = {}
        self.entries: list[tuple] = []
        self.cells = np.zeros(self.max_cells, np.int32)  # 0 where not made yet; memory is taken as it is touched
        self.begin = self._state(((0, _START, 0),))
        self.sync = self._step(self.begin, self.space)[0]

    def _state(self, key: tuple) -> int:
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.entries)
            self.entries.append(key)
            if len(self.entries) * self.width > len(self.cells):  # only within one slice
                self.cells = np.concatenate([self.cells, np.zeros_like(self.cells)])
        return at

    def _pair(self, a: str | None, b: str) -> bool:
        """Whether two pieces are the encoding of their joint text."""
        if not a or (b[0] == SPACE and a[-1] != SPACE):
            return True
        key = (a, b)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            found = self.fits[key] = self._merge(a + b) == [a, b]
        return found

    def _merge(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def _step(self, state: int, code: int) -> tuple[int, int]:
        """Make the transition of a state on a class of characters."""
        entries, char = self.entries[state], self.chars[code]
        if char is None:
            to, change = self._state(((0, _ALONE, 0),)), code + 1
        else:
            kept, last, change = [], None, 0
            for node, before, count in entries:
                child = self.trie[node].get(char)
                if child is None:
                    continue
                if char == SPACE and node == 0 and before and before[-1] != SPACE:
                    before = _START  # no piece reaches over the start of a word
                kept.append((child, before, count))
                piece = self.piece[child]
                if piece is not None and last is None and self._pair(before, piece):
                    last, change = piece, count + 1
            to = self._state((*((n, b, c - change) for n, b, c in kept), (0, last, 0)))
        self.cells[state * self.width + code] = to * SPREAD + change + SPREAD // 2
        return to, change

    def _walk(self, codes, first, length, state):
        """All lanes together: exit states and counts."""
        order = np.argsort(-length, kind="stable")
        first, length, state = first[order], length[order], state[order].astype(np.int64)
        count = np.zeros(len(order), np.int64)
        ends = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        for step, n in enumerate(ends):
            s, c = state[:n], codes[first[:n] + step]
            flat = s * self.width + c
            cell = self.cells[flat]
            if cell.min() == 0:
                for key in np.unique(flat[cell == 0]):
                    self._step(int(key) // self.width, int(key) % self.width)
                cell = self.cells[flat]
            count[:n] += (cell & (SPREAD - 1)) - SPREAD // 2
            state[:n] = cell >> SHIFT
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of the rows of a slice."""
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        out = np.zeros(len(size), np.int64)
        if not len(full):
            return out
        letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = letters[offsets[full]]
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        text = self.code[points]
        if text.min() < 0:
            for point in np.unique(points[text < 0]):
                self.code[point] = len(self.chars)
                self.chars.append(chr(point))
            text = self.code[points]
        codes = np.insert(text, at, self.space)  # the encoder puts a space before every text
        if len(self.chars) > self.width or len(self.entries) * self.width > self.max_cells:
            self._reset(max(self.width, -(-len(self.chars) // 16) * 16))
        at = at + np.arange(len(full))
        end = np.append(at[1:], len(codes))
        lane = -(-(end - at) // CHUNK)
        row = np.repeat(np.arange(len(full)), lane)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lane) - lane, lane)
        first = at[row] + nth * CHUNK
        stop = np.minimum(first + CHUNK, end[row])
        # the first place of each chunk where a word starts, or its end
        word = codes == self.space
        word[1:] &= codes[:-1] != self.space
        word[at] = True
        places = np.flatnonzero(word)
        meet = np.append(places, len(codes))[np.searchsorted(places, first)]
        has = meet < stop
        meet = np.where(has, meet, stop)
        exit_state = np.full(len(row), -1, np.int64)
        tail = np.flatnonzero(has)
        exit_state[tail], count = self._walk(codes, meet[tail] + 1, stop[tail] - meet[tail] - 1, np.full(len(tail), self.sync))
        np.add.at(out, full[row[tail]], count + 1)
        todo = np.flatnonzero(meet > first)
        while len(todo):
            ready = todo[exit_state[todo - 1] >= 0]  # never a text's first chunk: it starts with a space
            done, count = self._walk(codes, first[ready], meet[ready] - first[ready], exit_state[ready - 1])
            np.add.at(out, full[row[ready]], count)
            exit_state[ready] = np.where(has[ready], exit_state[ready], done)
            waiting = np.ones(len(row), bool)
            waiting[ready] = False
            todo = todo[waiting[todo]]
        return out


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row, for its whole text.

    A null or empty text has no bytes and no tokens.  Other columns pass unchanged; columns
    that already have one of the three names are replaced.  ``model`` is a file that
    every executor can open.  Rows are neither shuffled nor gathered.
    """
    added = ("n_bytes", "n_tokens", "over_limit")
    docs = docs.drop(*added)
    schema = docs.select("*", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens"), F.lit(False).alias("over_limit")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for batch in batches:
            for part in slices(batch, text):
                machine = machine or Transducer(model)
                data, offsets = column_bytes(part.column(text))
                n = machine.counts(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                    names=[*part.schema.names, *added],
                )

    return docs.mapInArrow(count, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(MODEL)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLE: dict[str, str] = {}
