"""SentencePiece encoding and decoding with seeded merge-dropout.

The vocabulary of a BPE model file gives the merges: two neighbouring symbols may merge if their concatenation is a
piece, better-scored pieces first and, of the same piece, the leftmost. An agenda holds the candidates. Each candidate
that comes up is skipped with probability ``dropout``, decided by a hash keyed by seed, document, unit and the
candidate's number, so that a text is segmented alike whenever and wherever it is encoded, and in another way under
another seed.

No piece joins a character with a white-space mark after it, nor (as the vocabulary shows when it is loaded) characters
of some classes with each other. The agenda of a text falls apart there into those of short units, which don't touch
each other. The agendas of all units of a batch are worked off side by side, one candidate of each at a time, on
columns of numpy; units of more than ``WIDE`` characters have a heap of their own.

Encoding is lossless: characters outside the vocabulary become byte pieces, as does the white-space mark itself where a
text holds it. Without dropout, the ids are those of the sentencepiece library.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tamis.llm.common import ROW, packed, small_batches, unpacked

MARK = "▁"
#: Characters up to which a unit is worked off side by side with others.
WIDE = 32
#: Characters of texts, and units, that are worked on in one go.
SLICE_CHARS, SLICE_UNITS = 1 << 19, 1 << 16
#: Rows of an Arrow batch that are encoded and returned at once.
SLICE_ROWS = 1024
_GOLDEN, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_M64 = (1 << 64) - 1
_NONE = np.int64(1 << 62)
_SHIFT = np.int64(21)  # symbols are under 2^21: pieces, then code points outside the vocabulary
_SPACE, _ALONE, _MARKS, _REST = 0, 1, 2, 3


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


class PieceCodec:
    """Encoder and decoder of one model file, dropout and seed."""

    def __init__(self, model_file: str, dropout: float, seed: int) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.n, self.seed, self.limit = n, seed, round(dropout * 65536)  # a draw is 16 bits of a hash
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(byte_id) != 256:
            raise ValueError("the model has no byte pieces, so it can't be lossless")
        self.byte_id = np.array([byte_id[b] for b in range(256)], np.int32)
        own = [i for i in range(n) if i not in special and not sp.is_unused(i)]
        self.piece_id = {sp.id_to_piece(i): i for i in own}
        self.raw = {i: sp.id_to_piece(i).replace(MARK, " ").encode() for i in own} | {i: bytes([b]) for b, i in byte_id.items()}
        rank = {i: at for at, i in enumerate(sorted(own, key=lambda i: (-sp.get_score(i), i)))}
        self._tabulate(rank)
        self._classify()

    def _tabulate(self, rank: dict[int, int]) -> None:
        """Open addressing from two symbols to rank and merged piece in one number."""
        found = {}
        for p, i in self.piece_id.items():
            for j in range(1, len(p)):
                a, b = self.piece_id.get(p[:j]), self.piece_id.get(p[j:])
                # a single character outside the vocabulary has no piece, so it takes no part in merges
                if a is not None and b is not None:
                    found[a << 21 | b] = rank[i] << 21 | i
        self.size = 1 << max(10, (4 * len(found)).bit_length())
        self.shift = np.uint64(64 - self.size.bit_length() + 1)
        self.keys, self.values = np.full(self.size, -1, np.int64), np.full(self.size, _NONE, np.int64)
        for k, v in found.items():
            at = (k * _GOLDEN & _M64) >> int(self.shift)
            while self.keys[at] != -1:
                at = (at + 1) % self.size
            self.keys[at], self.values[at] = k, v
        self.merges = found
        # code point -> symbol
        top = max(ord(p) for p in self.piece_id if len(p) == 1)
        self.symbol = np.arange(top + 1, dtype=np.int32) + self.n
        for p, i in self.piece_id.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(MARK)] = self.n + ord(MARK)  # a mark in a text is not a space
        self.symbol[32] = self.piece_id[MARK]

    def _classify(self) -> None:
        """Classes of characters that no piece joins: marks and digits, the rest; a line feed is alone if no piece has it."""
        pairs = {(a, b) for p in self.piece_id for a, b in zip(p, p[1:])}
        self.falls_apart = not any(b == MARK and a != MARK for a, b in pairs)
        marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789")
        while more := {x for a, b in pairs for x, y in ((a, b), (b, a)) if y in marks and x not in marks and x != MARK}:
            marks |= more
        if any(c.isascii() and c.isalpha() for c in marks):
            marks = set()
        self.kind = np.full(len(self.symbol), _REST, np.int8)
        self.kind[[ord(c) for c in marks if ord(c) < len(self.kind)]] = _MARKS
        self.kind[32] = _SPACE
        if not any("\n" in p for p in self.piece_id):
            self.kind[10] = _ALONE

    # -- merging

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and merged piece of each two symbols, or _NONE."""
        k = (a.astype(np.int64) << _SHIFT) | b
        at = ((k.view(np.uint64) * np.uint64(_GOLDEN)) >> self.shift).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == k, self.values[at], _NONE)
        on = np.flatnonzero((there != k) & (there != -1))
        while on.size:
            at[on] = (at[on] + 1) % self.size
            there = self.keys[at[on]]
            hit = there == k[on]
            out[on[hit]] = self.values[at[on[hit]]]
            on = on[~hit & (there != -1)]
        return out

    def _draws(self, h: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Whether candidate i of the units with hash h is skipped."""
        x = _mixed(h + (i // 4 + 1).astype(np.uint64) * np.uint64(_GOLDEN))
        return ((x >> (i % 4 * 16).astype(np.uint64)) & np.uint64(0xFFFF)) < np.uint64(self.limit)

    def _agendas(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of short units after their merges (units by columns), and how many are left of each."""
        width, n = int(lengths.max()), len(lengths)
        s = np.full((width + 1, n), -1, np.int32)
        for j in range(width):
            has = lengths > j
            s[j, has] = symbols[starts[has] + j]
        out, left = s, lengths.copy()
        v = np.full((width + 1, n), _NONE, np.int64)  # row j: the pair of symbols j and j + 1
        for j in range(width - 1):
            has = np.flatnonzero(lengths > j + 1)
            v[j, has] = self._look_up(s[j, has], s[j + 1, has])
        s = s.copy()
        unit, came, size, h = np.arange(n), np.zeros(n, np.int64), lengths.copy(), hashes
        while unit.size:
            best = v.min(0)
            open_ = best != _NONE
            if open_.sum() < 0.8 * unit.size:
                ended = unit[~open_]
                out[: len(s), ended], left[ended] = s[:, ~open_], size[~open_]
                top = int(size[open_].max(initial=0)) + 1
                s, v = s[:top, open_], v[:top, open_]
                unit, came, size, h, best = unit[open_], came[open_], size[open_], h[open_], best[open_]
                if not unit.size:
                    break
                open_ = np.ones(unit.size, bool)
            at = (v == best).argmax(0)
            if self.limit:
                skip = self._draws(h, came)
                gone = np.flatnonzero(skip & open_)
                v[at[gone], gone] = _NONE
                open_ &= ~skip
                came += 1
            at = np.where(open_, at, len(s))
            m = np.flatnonzero(open_)
            for j in range(int(at.min(initial=len(s))) + 1, len(s) - 1):
                over = at < j
                np.copyto(s[j], s[j + 1], where=over)
                np.copyto(v[j], v[j + 1], where=over)
            s[-1], v[-1] = -1, _NONE
            i, piece = at[m], (best[m] & ((1 << 21) - 1)).astype(np.int32)
            s[i, m] = piece
            size[m] -= 1
            after = s[i + 1, m]
            v[i, m] = np.where(after >= 0, self._look_up(piece, np.maximum(after, 0)), _NONE)
            w = i > 0
            v[i[w] - 1, m[w]] = self._look_up(s[i[w] - 1, m[w]], piece[w])
        return out, left

    def _agenda(self, symbols: list, h: int) -> list[int]:
        """The same for one unit of any length: a heap of candidates over linked symbols."""
        merges, n, came = self.merges, len(symbols), 0
        symbols, before, after = list(symbols), list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        agenda = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := merges.get(symbols[i] << 21 | symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            r, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has merged since
            came += 1
            if self.limit and self._draws(np.array([h], np.uint64), np.array([came - 1]))[0]:
                continue
            symbols[i], symbols[j] = r & ((1 << 21) - 1), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := merges.get(symbols[i] << 21 | symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, symbols[i], symbols[k]))
            if (p := before[i]) >= 0 and (r := merges.get(symbols[p] << 21 | symbols[i])) is not None:
                heapq.heappush(agenda, (r, p, symbols[p], symbols[i]))
        return [x for x in symbols if x >= 0]

    # -- texts

    def key(self, doc_id, text: str) -> int:
        """64 bits for a document: its id, or the text where it has none."""
        name = text.encode("utf-8", "surrogatepass") if doc_id is None else str(doc_id).encode()
        return xxhash.xxh3_64_intdigest(name, seed=self.seed)

    def encode(self, texts: Sequence[str], keys: Sequence[int]) -> list[np.ndarray]:
        """int32 ids of each whole text; a key is 64 bits for a document."""
        out, batch, size = [], 0, 0
        for i, t in enumerate(texts):
            if size + len(t) > SLICE_CHARS and i > batch:
                out += self._encode(texts[batch:i], keys[batch:i])
                batch, size = i, 0
            size += len(t)
        return out + self._encode(texts[batch:], keys[batch:])

    def _encode(self, texts: Sequence[str], keys: Sequence[int]) -> list[np.ndarray]:
        chars = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        if not chars.size:
            return [np.zeros(0, np.int32) for _ in texts]
        lengths = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        firsts = np.cumsum(lengths) - lengths
        known = chars < len(self.symbol)
        symbols = np.where(known, self.symbol[np.where(known, chars, 0)], chars + self.n)
        kind = np.where(known, self.kind[np.where(known, chars, 0)], _REST)
        new = np.ones(len(chars), bool)
        if self.falls_apart:
            a, b = kind[:-1], kind[1:]
            new[1:] = ((a != _SPACE) & ((a != b) | (b == _ALONE))) | (b == _ALONE)
        else:
            new[1:] = False
        new[firsts[lengths > 0]] = True
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(chars)))
        doc = np.searchsorted(firsts + lengths, starts, side="right")
        first_unit = np.searchsorted(starts, firsts)
        place = (np.arange(len(starts)) - first_unit[doc]).astype(np.uint64)
        hashes = _mixed(place * np.uint64(_GOLDEN) + np.array(keys, np.uint64)[doc])
        left = np.zeros(len(starts), np.int64)
        # the symbols that remain stand where their unit stood
        flat = np.full(len(chars), -1, np.int32)
        order = np.argsort(np.minimum(sizes, WIDE + 1), kind="stable")
        order = order[sizes[order] <= WIDE]
        for lo in range(0, len(order), SLICE_UNITS):
            u = order[lo : lo + SLICE_UNITS]
            for group in np.split(u, np.searchsorted(sizes[u], [2, 4, 6, 8, 12, 16], side="right")):
                if group.size:
                    merged, left[group] = self._agendas(symbols, starts[group], sizes[group], hashes[group])
                    for j in range(len(merged) - 1):
                        has = left[group] > j
                        flat[starts[group[has]] + j] = merged[j, has]
        for u in np.flatnonzero(sizes > WIDE):
            got = self._agenda(symbols[starts[u] : starts[u] + sizes[u]].tolist(), int(hashes[u]))
            left[u] = len(got)
            flat[starts[u] : starts[u] + len(got)] = got
        kept = np.flatnonzero(flat >= 0)
        ids = flat[kept]
        owner = np.searchsorted(firsts + lengths, kept, side="right")
        ids, owner = self._to_bytes(ids, owner)
        return np.split(ids, np.searchsorted(owner, np.arange(1, len(texts))))

    def _to_bytes(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points outside the vocabulary as the byte pieces of their UTF-8."""
        odd = ids >= self.n
        if not odd.any():
            return ids, owner
        c = np.where(odd, ids - self.n, 0)
        size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        first = np.cumsum(size) - size
        out = np.repeat(ids, size)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        for j in range(4):
            at = np.flatnonzero(odd & (size > j))
            low = c[at] >> (6 * (size[at] - 1 - j))
            byte = np.where(j == 0, np.where(size[at] == 1, c[at], lead[size[at]] | low), 0x80 | (low & 0x3F))
            out[first[at] + j] = self.byte_id[byte]
        return out, np.repeat(owner, size)

    def decode(self, ids) -> str:
        """The text of some ids: pieces with marks as spaces, byte pieces as bytes, without the leading space."""
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


_CODECS: dict[tuple, PieceCodec] = {}


def codec(model_file: str, dropout: float, seed: int) -> PieceCodec:
    """The worker's codec: loaded once in a process."""
    at = (model_file, dropout, seed)
    if at not in _CODECS:
        _CODECS[at] = PieceCodec(model_file, dropout, seed)
    return _CODECS[at]


def encode(docs: DataFrame, model_file: str, *, dropout: float = 0.1, seed: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, ids, n_tokens`` and the columns of ``keep`` for each row: its whole text in pieces.

    Null and empty texts have no ids. Rows with the same id and text are segmented alike; rows without an id draw by
    their text. Other columns are ignored, whatever their names; a kept column with the name of a result is returned as
    ``kept_<name>``. An empty table gives an empty result. Memory grows with the longest text only. ``model_file`` is a
    path that every executor has.
    """
    keep, used = [c for c in keep if c != "doc_id"], ("doc_id", "text")
    small_batches(docs.sparkSession)
    d = packed(docs, used, keep)
    own = [c for c in ("doc_id", "text", ROW) if c != "text" or "text" in keep]
    schema = StructType([*(d.schema[c] for c in own), StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec_ = codec(model_file, dropout, seed)
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(lo, SLICE_ROWS)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = codec_.encode(texts, [codec_.key(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), texts)])
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate([np.zeros(0, np.int32), *ids])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), lists, pa.array(sizes)], [*own, "ids", "n_tokens"])

    result = ("doc_id", "ids", "n_tokens", "text")
    return d.mapInArrow(run, schema).select("doc_id", "ids", "n_tokens", *unpacked(keep, used, result))


def decode(encoded: DataFrame, model_file: str, *, ids: str = "ids", into: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids. Null ids give an empty text."""

    @F.pandas_udf("string")
    def back(column):
        own = codec(model_file, 0.0, 0)
        return column.map(lambda x: "" if x is None else own.decode(x.tolist()))

    return encoded.withColumn(into, back(F.col(ids)))
