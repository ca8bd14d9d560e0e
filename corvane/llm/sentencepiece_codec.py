"""SentencePiece BPE encoding with seeded merge-dropout, and decoding that gives the text back.

Encoding is that of a merge-type model: the symbols of a text are its
characters, an agenda holds each pair of neighbours whose joint piece the
vocabulary has, and the best one (highest score, then leftmost) is merged until
none is left. With dropout, a candidate merge is skipped for good when a keyed
hash of it falls below the rate. The key is the seed, the document, the chunk's
place in it, the chunk and the candidate's span, so segmentations differ between
seeds, documents and places, and a rerun gives the same ones.

No piece holds a space mark after another character, so chunks of space marks
and what follows them are merged alone, and all chunks of a batch at once: each
round merges the best candidate of every chunk that has one. Equal chunks of
which the same candidates are dropped are merged once.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import give_back, texts

SPACE = "▁"
#: Stands for a literal space mark of a text until it is spelt in bytes. No text holds a lone surrogate.
LITERAL = "\ud800"
DROPOUT, SEED = 0.1, 7
#: Chunks beyond this many symbols go through the agenda one by one, in n log n steps.
LONG_CHUNK = 256
BATCH = 512
#: Chunks that are merged together.
PART = 10_000
#: Chunks beyond this many symbols or candidates, or of fewer places in a batch, are merged at each place by themselves.
PATTERN_SYMBOLS, PATTERN_BITS, PATTERN_PLACES = 24, 64, 16
#: Places whose dropped candidates are found together; chunks whose candidates are kept.
PLACES, MAX_CACHED_CHUNKS = 50_000, 50_000
NONE = np.int64(1) << np.int64(62)
CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Codec:
    """A BPE vocabulary: pieces, their scores and the pairs that merge."""

    def __init__(self, model: bytes, seed: int = SEED, dropout: float = DROPOUT):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.seed, self.dropout = seed, dropout
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        odd = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.piece_id = {p: i for i, p in enumerate(names) if not odd[i]}
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if odd[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.empty(n, np.int64)
        rank[np.lexsort((np.arange(n), -scores))] = np.arange(n)
        # Equal scores share a rank, so that the leftmost goes first.
        order = np.argsort(rank)
        same = np.concatenate(([0], np.cumsum(np.diff(scores[order]) != 0)))
        rank[order] = same
        self.rank = rank
        pairs = {}
        for p, i in self.piece_id.items():
            for cut in range(1, len(p)):
                a, b = self.piece_id.get(p[:cut]), self.piece_id.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        #: Code point to first symbol, see symbols.
        self.symbol_of = -1 - np.arange(0x110000, dtype=np.int64)
        for p, i in self.piece_id.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        self.size = n
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # A table by the key's low bits finds nearly every key at its first place.
        self.bits = max(4, int(2 * len(pairs)).bit_length() + 1)
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self._fill()
        #: Chunk to what candidates gives for it.
        self.known: dict[str, tuple[np.ndarray, int]] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self) -> None:
        """Keys go to their slot or, one after another, to the next free one; probes counts the steps of the furthest."""
        left, at, self.probes = np.arange(len(self.keys)), self._slot(self.keys), 0
        while len(left):
            at = at & ((1 << self.bits) - 1)
            free = self.slots[at] < 0
            first = np.unique(at[free], return_index=True)
            winners = np.flatnonzero(free)[first[1]]
            self.slots[at[winners]] = left[winners]
            rest = np.ones(len(left), bool)
            rest[winners] = False
            left, at = left[rest], at[rest] + 1
            self.probes += 1

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged piece of each pair, -1 where there is none."""
        keys = left * self.size + right
        out = np.full(len(keys), -1, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._slot(keys[todo])
        for _ in range(self.probes):
            k = self.slots[at & ((1 << self.bits) - 1)]
            hit = (k >= 0) & (self.keys[k] == keys[todo])
            out[todo[hit]] = self.merged[k[hit]]
            on = (k >= 0) & ~hit
            if not on.any():
                break
            todo, at = todo[on], at[on] + 1
        return out

    def symbols(self, chunk: str) -> list[int]:
        """First symbols: ids of characters; those the vocabulary lacks as -1 - code point, which merge with nothing."""
        get = self.piece_id.get
        return [get(c, -1 - ord(c)) for c in chunk]

    def spelt(self, symbol: int) -> list[int]:
        """Ids of a symbol: itself, or the bytes of a character that the vocabulary lacks."""
        if symbol >= 0:
            return [symbol]
        c = chr(-1 - symbol)
        return [int(self.byte_ids[b]) for b in (SPACE if c == LITERAL else c).encode()]

    def chunk_keys(self, chunks: list[str]) -> np.ndarray:
        """A hash of each chunk under the seed."""
        return np.frombuffer(b"".join([xxhash.xxh64_digest(c.encode("utf-8", "surrogatepass"), self.seed & 0xFFFFFFFF) for c in chunks]), ">u8").astype(np.uint64)

    def skipped(self, key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a candidate merge of [start, middle) and [middle, end) of a chunk is dropped."""
        u = lambda x: np.asarray(x).astype(np.uint64)
        h = mix(np.asarray(key, np.uint64) ^ mix(u(start) << np.uint64(42) ^ u(middle) << np.uint64(21) ^ u(end)))
        return (h >> np.uint64(11)).astype(np.float64) / 2.0**53 < self.dropout

    def segment_by_agenda(self, chunk: str, key: int) -> list[int]:
        """One chunk's ids, by a heap of candidates."""
        symbols = self.symbols(chunk)
        n = len(symbols)
        before, after, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(places: list[int]) -> None:
            places = [i for i in places if i >= 0 and after[i] < n]
            pairs = [(i, self.pairs.get(symbols[i] * self.size + symbols[after[i]], -1)) for i in places if symbols[i] >= 0 and symbols[after[i]] >= 0]
            pairs = [(i, m) for i, m in pairs if m >= 0]
            if pairs:
                at = np.array([i for i, _ in pairs])
                drop = self.skipped(np.uint64(key), at, np.array([after[i] for i, _ in pairs]), np.array([end[after[i]] for i, _ in pairs])) if self.dropout else [False] * len(pairs)
                for (i, m), d in zip(pairs, drop, strict=True):
                    if not d:
                        heapq.heappush(agenda, (int(self.rank[m]), i, after[i], end[after[i]], m))

        offer(list(range(n)))
        while agenda:
            _, i, j, stop, m = heapq.heappop(agenda)
            # A candidate one of whose symbols was merged meanwhile is void.
            if symbols[i] is None or after[i] != j or end[j] != stop:
                continue
            symbols[i], symbols[j], end[i], after[i] = m, None, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer([before[i], i])
        return [x for s in symbols if s is not None for x in self.spelt(s)]

    def segment(self, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk under its key, in a row, and where each chunk's end."""
        lengths = np.array(list(map(len, chunks)), np.int64)
        long = np.flatnonzero(lengths > LONG_CHUNK)
        short = np.flatnonzero(lengths <= LONG_CHUNK)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (chunk, id), ids of a chunk in order
        for at in range(0, len(short), PART):
            part = short[at : at + PART]
            owner, symbols = self._rounds([chunks[i] for i in part.tolist()], lengths[part], keys[part])
            parts.append((part[owner], symbols))
        for i in long.tolist():
            ids = np.array(self.segment_by_agenda(chunks[i], int(keys[i])), np.int64)
            parts.append((np.full(len(ids), i), ids))
        owner, ids = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            # Characters that the vocabulary lacks are spelt in bytes.
            spelt = [self.spelt(x) for x in ids[odd].tolist()]
            times = np.ones(len(ids), np.int64)
            times[odd] = list(map(len, spelt))
            owner, rest = np.repeat(owner, times), np.repeat(ids, times)
            rest[rest < 0] = [x for c in spelt for x in c]
            ids = rest
        if len(long):
            order = np.argsort(owner, kind="stable")
            owner, ids = owner[order], ids[order]
        return ids.astype(np.int32), np.searchsorted(owner, np.arange(len(chunks)), side="right")

    def _candidates(self, sym: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(priority, piece) of merging the symbols at left with their right neighbours; NONE where they don't merge."""
        right = left + 1
        inside = np.flatnonzero(right < len(sym))
        inside = inside[owner[left[inside]] == owner[right[inside]]]
        l, r = left[inside], right[inside]
        piece = np.full(len(left), -1, np.int64)
        got = self.lookup(sym[l], sym[r])
        if self.dropout:
            some = np.flatnonzero(got >= 0)
            drop = self.skipped(key[owner[l[some]]], start[l[some]], start[r[some]], end[r[some]])
            got[some[drop]] = -1
        piece[inside] = got
        # Score first, then the place in the chunk.
        return np.where(piece >= 0, self.rank[piece] << np.int64(20) | start[left], NONE), piece

    def _rounds(self, chunks: list[str], lengths: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunk, symbol) of all chunks, merged a candidate of each at a time, in order."""
        sym = self.symbol_of[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4")]
        owner = np.repeat(np.arange(len(chunks)), lengths)
        start = np.arange(len(sym)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        end = start + 1
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        priority, piece = self._candidates(sym, owner, start, end, key, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(priority, first)
            count = np.diff(np.concatenate((first, [len(sym)])))
            live = np.repeat(best < NONE, count)
            if not live.all():
                # Chunks without a candidate are finished.
                done.append((owner[~live], start[~live], sym[~live]))
                sym, owner, start, end, priority, piece = (x[live] for x in (sym, owner, start, end, priority, piece))
                best, count = best[best < NONE], count[best < NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(priority == np.repeat(best, count))
            sym[at], end[at] = piece[at], end[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            sym, owner, start, end, priority, piece = (x[keep] for x in (sym, owner, start, end, priority, piece))
            near = np.zeros(len(sym), bool)
            near[new] = near[new[new > 0] - 1] = True
            touched = np.flatnonzero(near)
            priority[touched], piece[touched] = self._candidates(sym, owner, start, end, key, touched)
        owners, starts, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owners << np.int64(20) | starts)
        return owners[order], symbols[order]

    def candidates(self, chunk: str) -> tuple[np.ndarray, int]:
        """The scrambled spans of all merges that some dropout can come to, and as bits those that are met where none is dropped.

        A chunk with too many of them has none here and -1 as bits.
        """
        n, get = len(chunk), self.piece_id.get
        if n > PATTERN_SYMBOLS:
            return np.empty(0, np.uint64), -1
        reached = {(i, i + 1) for i in range(n) if chunk[i] in self.piece_id}
        number: dict[tuple[int, int, int], int] = {}
        for size in range(2, n + 1):
            for i in range(n - size + 1):
                j = i + size
                if chunk[i:j] in self.piece_id:
                    for k in range(i + 1, j):
                        if (i, k) in reached and (k, j) in reached:
                            number[i, k, j] = len(number)
                            reached.add((i, j))
        if len(number) > PATTERN_BITS:
            return np.empty(0, np.uint64), -1
        met, cuts = 0, list(range(n + 1))
        while found := [(int(self.rank[get(chunk[i:j])]), at, number[i, k, j]) for at, (i, k, j) in enumerate(zip(cuts, cuts[1:], cuts[2:], strict=False)) if (i, k, j) in number]:
            for _, _, bit in found:
                met |= 1 << bit
            del cuts[min(found)[1] + 1]
        return mix(np.array([i << 42 | k << 21 | j for i, k, j in number], np.uint64)), met

    def patterns(self, chunks: list[str], use: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """For each place, the number of its chunk in use and its key, a number that stands for what is dropped; equal ones of a chunk have equal segmentations."""
        if len(self.known) > MAX_CACHED_CHUNKS:
            self.known.clear()
        seldom = (np.empty(0, np.uint64), -1)
        often = np.bincount(use, minlength=len(chunks)) >= PATTERN_PLACES
        for i in np.flatnonzero(often).tolist():
            if chunks[i] not in self.known:
                self.known[chunks[i]] = self.candidates(chunks[i])
        spans, met = zip(*(self.known[c] if o else seldom for c, o in zip(chunks, often.tolist(), strict=True)), strict=True)
        size = np.array(list(map(len, spans)), np.int64)
        first, span = np.cumsum(size) - size, np.concatenate(spans)
        single = np.array([m < 0 for m in met])
        met = np.array([max(m, 0) for m in met], np.uint64)
        out = np.zeros(len(use), np.uint64)
        for at in range(0, len(use), PLACES):
            u, key = use[at : at + PLACES], keys[at : at + PLACES]
            some = np.flatnonzero(size[u] > 0)
            n = size[u[some]]
            begin = np.cumsum(n) - n
            bit = np.arange(n.sum()) - np.repeat(begin, n)
            h = mix(np.repeat(key[some], n) ^ span[np.repeat(first[u[some]], n) + bit])
            drop = ((h >> np.uint64(11)).astype(np.float64) / 2.0**53 < self.dropout).astype(np.uint64) << bit.astype(np.uint64)
            if len(some):
                found = np.bitwise_or.reduceat(drop, begin)
                # Where nothing that is met is dropped, the rest is never come to.
                out[at + some] = np.where(found & met[u[some]], found, 0)
        alone = np.flatnonzero(single[use])
        out[alone] = keys[alone]
        return out

    def encode_all(self, names: list[bytes], batch: list[str]) -> list[np.ndarray]:
        """Ids of each text; names tell documents apart, so that each varies on its own."""
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        uses = [np.array(list(map(number.__getitem__, self._split(t))), np.int64) for t in batch]
        counts = np.array(list(map(len, uses)), np.int64)
        use = np.concatenate(uses) if uses else np.empty(0, np.int64)
        chunks = list(number)
        base = self.chunk_keys(chunks)
        if self.dropout and len(use):
            own = np.frombuffer(b"".join([xxhash.xxh64_digest(n, self.seed & 0xFFFFFFFF) for n in names]), ">u8").astype(np.uint64)
            place = np.arange(len(use), dtype=np.uint64) - np.repeat(np.cumsum(counts) - counts, counts).astype(np.uint64)
            keys = mix(base[use] ^ mix(place ^ np.repeat(own, counts)))
            pattern = self.patterns(chunks, use, keys)
            order = np.lexsort((pattern, use))
            fresh = np.concatenate(([True], (np.diff(use[order]) != 0) | (pattern[order][1:] != pattern[order][:-1])))
            # Of equal ones the first place stands for all.
            there = order[fresh]
            of_place = np.empty(len(use), np.int64)
            of_place[order] = np.cumsum(fresh) - 1
            flat, ends = self.segment([chunks[i] for i in use[there].tolist()], keys[there])
            use = of_place
        else:
            flat, ends = self.segment(chunks, base)
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        n = (ends - begins)[use]
        stop = np.cumsum(n)
        ids = flat[np.repeat(ends[use] - stop, n) + np.arange(stop[-1])] if len(use) else flat[:0]
        bounds = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(counts)))]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _split(self, text: str) -> list[str]:
        """Chunks of a text with a space put before it, spaces as marks; literal marks are chunks of their own."""
        if not text:
            return []
        if SPACE not in text:
            return CHUNKS.findall(SPACE + text.replace(" ", SPACE))
        marked = [p.replace(" ", SPACE) for p in (" " + text).split(SPACE)]
        out: list[str] = []
        for i, p in enumerate(marked):
            if i:
                out.append(LITERAL)
            out += CHUNKS.findall(p)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text: pieces' bytes in a row, without the space put before it."""
        raw = self.raw
        return b"".join([raw[i] for i in ids.tolist()])[1:].decode()


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, dropout: float = DROPOUT, with_ids: bool = True) -> DataFrame:
    """One row (doc_id, n_chars, n_pieces, ids_crc32, decoded_equal and, if asked for, ids) for each row of docs, in one pass without a shuffle.

    Each text is encoded, its ids are decoded and the outcome is compared with
    it. A null text is empty and has no pieces. Rows that repeat an id are
    segmented alike where their texts agree; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(shared.value, seed, dropout)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                names = [str(i).encode() for i in b.column(0).to_pylist()]
                batch = list(texts(b.column(1)))
                found = own.encode_all(names, batch)
                columns = [
                    b.column(0),
                    pa.array([len(t) for t in batch], pa.int64()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([zlib.crc32(f.astype("<u4").tobytes()) for f in found], pa.int64()),
                    pa.array([own.decode(f) == t for f, t in zip(found, batch, strict=True)], pa.bool_()),
                ]
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int32), pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "n_pieces", "ids_crc32", "decoded_equal", *["ids"] * with_ids])
        give_back()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {id_type}, n_chars long, n_pieces long, ids_crc32 long, decoded_equal boolean" + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(shared.value, dropout=0)
        for b in batches:
            out = [own.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"doc_id {id_type}, text string")
