"""The context-mixing model of one process: coded decisions of texts, their counts, and online scoring.

A byte is coded as the decisions of a Huffman code chosen by the two bytes before it where those are frequent, by
the byte before it elsewhere: some 2.9 decisions a byte of prose. Each decision is predicted by hashed contexts of the running text, white space included:

    order 3, 5         the last bytes (the code itself depends on the last ones)
    unit               the unit so far (a unit is a run of bytes up to and with white space), and the code if two bytes chose it
    short + 2          the last unit of at most SHORT bytes (most often a function word) and the last two bytes

A context and a decision's node give a slot with the counts of zeros and ones; there are as many slots as the training
bytes need, without a bound. Of a text's byte, a context's slot and the row of the byte's code make a pair, from which
all slots of its decisions follow, so a part of the texts needs the values of its own pairs only. Stretched predictions are
mixed by logistic weights, chosen by how much the order 5 and unit contexts have seen. Within a text the weights
go on learning, a block of BLOCK bytes at a time, and a map from the mixed prediction to the text's own
frequencies refines it; both start anew with each text, so a text's score depends on the model and on itself alone.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa

from lineform.llm.shingles import _power

#: Contexts in order, and by how many powers of two their tables are smaller than the largest.
CONTEXTS = ("3", "5", "unit", "short+2")
LESS_BITS = {"3": 1, "unit": 1}
#: The weights that each text starts with, for all gates.
START = {"3": 0.4, "5": 0.36, "unit": 0.12, "short+2": 0.4}
GATED = ("5", "unit")
K = len(CONTEXTS)
LEAST_BITS = 16
SHORT = 4
LEVELS = 6  # 8 at most
GATES = LEVELS * LEVELS
BINS = 24
BLOCK = 512
#: Bytes of text that are coded at a time; longer texts are cut into pieces, with BEFORE bytes in view.
PIECE = 1 << 17
BEFORE = 256
#: Groups of pieces that are counted at once, pairs that are held before they are summed, and texts of which a block is coded at once.
AT_ONCE = 16
HELD_PAIRS = 1 << 22
RUNS = 64
CODE = 20
ROW_BITS = 20
#: Nodes of a code, which a slot's low bits are mixed with, and slots that are summed at once.
NODE_BITS = 8
SPAN_BITS = 20
#: Two bytes choose a code of their own if training texts have them this often; the most frequent ones, as many as MOST_CODES.
LEAST_SEEN = 1 << 12
MOST_CODES = 512
END = 0xFF
PRIOR = 0.2
FINE = 512
RATE = 0.002
STEP = 0.1  # a block moves a weight by this at most
MAP_PRIOR = 24.0

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32, END]] = True
_U = np.uint32


def bits_for(n_bytes: int) -> int:
    """Bits of the largest tables' slot numbers for a training text of n_bytes: tables grow with it."""
    return max(LEAST_BITS, (n_bytes // 4).bit_length())


def _mixed(h: np.ndarray) -> np.ndarray:
    """h itself, its bits mixed."""
    h ^= h >> _U(15)
    h *= _U(0x2C1B3C6D)
    h ^= h >> _U(12)
    h *= _U(0x297A2D39)
    h ^= h >> _U(15)
    return h


class Code:
    """For each byte before, and for some two bytes before, a Huffman code of the next byte; nodes are numbered from the root."""

    def __init__(self, pairs: np.ndarray, after: dict[int, np.ndarray] | None = None):
        """pairs: counts of bytes by the byte before; after: such counts by two bytes before, the first one times 256 and the second."""
        after = after or {}
        counts = np.concatenate([pairs, *(n[None] for n in after.values())]).astype(np.float64)
        #: Of two bytes, the row of their code and byte 0.
        self.chosen = np.tile(np.arange(256, dtype=np.int64) << 8, 256)
        self.chosen[list(after)] = np.arange(256, len(counts)) << 8
        self.size = np.zeros(len(counts) * 256, np.int64)
        both = np.zeros((len(counts) * 256, CODE), np.uint16)
        for i, c in enumerate(counts):
            c = np.maximum(c, (c.sum() + 1) / 2**13)  # bounds a code's length
            heap = [(x, i) for i, x in enumerate(c.tolist())]
            heapq.heapify(heap)
            inner: list[tuple[int, int]] = []
            while len(heap) > 1:
                (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
                heapq.heappush(heap, (a + b, 256 + len(inner)))
                inner.append((x, y))
            front, n = [(heap[0][1], ())], 0
            while front:
                below = []
                for at, path in front:
                    if at < 256:
                        self.size[i * 256 + at] = len(path)
                        both[i * 256 + at, : len(path)] = path
                    else:
                        below += [(kid, (*path, n << 1 | bit)) for bit, kid in enumerate(inner[at - 256])]
                        n += 1
                front = below
        self.both = both.ravel()

    @property
    def bit(self) -> np.ndarray:
        return (self.both & 1).reshape(-1, CODE)

    def decisions(self, row: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of codes' rows, all their decisions: 2 * node + bit."""
        ends = np.cumsum(sizes)
        where = np.repeat(row * CODE - (ends - sizes), sizes)
        where += np.arange(len(where))
        return self.both.take(where)


class Pieces:
    """Bytes of pieces of texts and what their contexts hold: (bytes in view before, bytes to code) each, padded to BEFORE bytes' worth of nothing. Bytes come block by block, pieces in order, or as they stand."""

    def __init__(self, pieces: list[tuple[bytes, bytes]], code: Code, bits: int, blocks: bool = True):
        heads = [b"\xff" * 6 + before for before, _ in pieces]
        data = np.frombuffer(b"".join(x for head, (_, own) in zip(heads, pieces, strict=True) for x in (head, own)), np.uint8)
        own = np.fromiter((len(p) for _, p in pieces), np.int64, len(pieces))
        head = np.fromiter(map(len, heads), np.int64, len(pieces))
        first = np.cumsum(own + head) - own  # of a piece's bytes to code
        # runs: a piece's parts of a block, blocks in order, or whole pieces
        n = -(-own // BLOCK) if blocks else np.ones(len(own), np.int64)
        piece = np.repeat(np.arange(len(own)), n)
        start = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(start, kind="stable")
        piece, self.block = piece.take(order), start.take(order)
        start = self.block * BLOCK
        size = np.minimum(own.take(piece) - start, BLOCK) if blocks else own
        self.runs = np.cumsum(size) - size
        at = np.arange(int(own.sum()))
        self.piece = np.repeat(piece, size)
        self.place = at + np.repeat(start - self.runs, size)
        at += np.repeat(first.take(piece) + start - self.runs, size)
        self.code, self.bits = code, bits
        chosen = np.zeros(len(data), np.int64)
        chosen[2:] = code.chosen.take(data[:-2].astype(np.uint16) << 8 | data[1:-1])
        self.hashes = [h.take(at) for h in self._contexts(data, chosen)]
        chosen |= data
        self.row = chosen.take(at)
        self.sizes = code.size.take(self.row)

    @property
    def bit(self) -> np.ndarray:
        """The bit of every decision."""
        return (self.code.decisions(self.row, self.sizes) & 1).astype(np.uint8)

    def _contexts(self, data: np.ndarray, chosen: np.ndarray) -> list[np.ndarray]:
        """Hashes of what each context holds at each byte of data; chosen: the bytes' codes, which the unit so far doesn't fix."""
        n = len(data)
        b = np.concatenate([np.zeros(5, np.uint32), data], dtype=np.uint32)
        back = [b[5 - k : 5 - k + n] for k in range(1, 6)]
        two = back[0] | back[1] << _U(8)
        three = two | back[2] << _U(16)
        white = _WHITE.take(data)
        starts = np.concatenate([np.ones(min(n, 1), bool), white[:-1]])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", n), dtype=np.uint64)])
        begin = np.flatnonzero(starts)
        end = np.append(begin[1:], n)
        down = _power("down", n + 1)[begin]
        fold = lambda h: ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
        prefix = fold((sums[:-1] - np.repeat(sums[begin], end - begin)) * np.repeat(down, end - begin)) + _U(1)
        whole = fold((sums[end] - sums[begin]) * down)
        short = (end - begin <= SHORT) & (end - begin > 1)
        last = np.maximum.accumulate(np.where(short, np.arange(len(begin)), -1))
        last = np.concatenate([[-1], last[:-1]])
        # a short unit counts only within its own piece: pieces begin with END bytes, a unit each
        fresh = np.maximum.accumulate(np.where((end - begin == 1) & (data[begin] == END), np.arange(len(begin)), -1)) if len(begin) else last
        said = np.repeat(np.where(last > fresh, whole[last], _U(0)) * _U(0x85EBCA77), end - begin)
        golden = _U(0x9E3779B1)
        made = {
            "3": three * golden + _U(3),
            "5": ((three | back[3] << _U(24)) * golden) ^ (back[4] * _U(0xC2B2AE3D) + _U(5)),
            "unit": prefix ^ np.where(chosen < 1 << 16, 0, chosen).astype(np.uint32) * golden,
            "short+2": (two * golden + _U(7)) ^ said,
        }
        found = [_mixed(made[k]) for k in CONTEXTS]
        if self.bits > 32:  # what the other half tells apart
            other = lambda h: ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype(np.uint32)
            more = {
                "3": three,
                "5": back[4] * golden + back[3] * _U(0x85EBCA77) ^ three,
                "unit": other((sums[:-1] - np.repeat(sums[begin], end - begin)) * np.repeat(down, end - begin)),
                "short+2": np.repeat(np.where(last > fresh, other((sums[end] - sums[begin]) * down)[last], _U(0)), end - begin) ^ two,
            }
            found = [h | _mixed(more[k]).astype(np.uint64) << np.uint64(32) for k, h in zip(CONTEXTS, found, strict=True)]
        return found

    def pairs(self, k: int) -> np.ndarray:
        """Of every byte, its slot in the table of context k and its code's row, as one number."""
        found = self.hashes[k].astype(np.int64)
        found &= (1 << table_bits(self.bits)[k]) - 1
        found <<= ROW_BITS
        found |= self.row
        return found

    def slots(self, k: int) -> np.ndarray:
        """Of every decision, its slot in the table of context k."""
        return slots_of(self.hashes[k], self.sizes, self.code.decisions(self.row, self.sizes), table_bits(self.bits)[k])


def slots_of(hashes: np.ndarray, sizes: np.ndarray, decisions: np.ndarray, bits: int) -> np.ndarray:
    found = np.repeat(hashes.astype(np.int64), sizes)
    found &= (1 << bits) - 1
    found ^= decisions >> 1  # a context's first nodes lie in one line of the cache
    return found


def table_bits(bits: int) -> list[int]:
    return [bits - LESS_BITS.get(c, 0) for c in CONTEXTS]


def offsets(bits: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([1 << b for b in table_bits(bits)])])


def pieces_of(text: bytes):
    """(bytes in view before, bytes to code) of a text with its END, PIECE bytes each."""
    data = text.replace(b"\xff", b"\xfe") + b"\xff"
    for at in range(0, len(data), PIECE):
        yield data[max(0, at - BEFORE) : at], data[at : at + PIECE]


def groups_of(texts: list[bytes]):
    """Lists of (text number, before, own) of about PIECE bytes; a text's pieces come in order, one in a list."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for j, (before, own) in enumerate(pieces_of(text)):
            if held and (j or held[-1][1] or size + len(own) > PIECE):
                yield held
                held, size = [], 0
            held.append((i, before, own))
            size += len(own)
    if held:
        yield held


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of x, and which of them each one is."""
    found = pa.array(x).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def pair_counts(texts: list[bytes], code: Code, bits: int):
    """Again and again, for each context: pairs of texts' bytes, sorted, and how often they occur."""
    groups = groups_of(texts)
    while some := list(itertools.islice(groups, AT_ONCE)):
        every = [[own.pairs(k) for k in range(K)] for own in (Pieces([(b, o) for _, b, o in group], code, bits, blocks=False) for group in some)]
        found = []
        for own in zip(*every, strict=True):
            pairs = np.concatenate(own)
            pairs.sort()
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            found.append((pairs.take(first), np.diff(first, append=len(pairs))))
        yield found


def decided(pairs: np.ndarray, code: Code, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs: how many decisions each has, and of all of these twice the slot, and the bit added."""
    row = pairs & ((1 << ROW_BITS) - 1)
    sizes = code.size.take(row)
    made = code.decisions(row, sizes)
    at = slots_of(pairs >> ROW_BITS, sizes, made, bits)
    at *= 2
    at += made & 1
    return sizes, at


def count_into(tables: np.ndarray, texts: list[bytes], code: Code, bits: int) -> None:
    """Adds the decisions of texts to tables: slot i has its zeros at 2 i and its ones at 2 i + 1. Bytes that share a context's slot and code are counted together, their decisions once."""
    base = offsets(bits)
    for found in pair_counts(texts, code, bits):
        for k, (pairs, n) in enumerate(found):
            sizes, at = decided(pairs, code, table_bits(bits)[k])
            np.add.at(tables[2 * base[k] : 2 * base[k + 1]], at, np.repeat(n.astype(tables.dtype), sizes))


class Asked:
    """The pairs of a part's texts, and how often its training texts have them; others are asked for only."""

    def __init__(self, code: Code, bits: int):
        self.code, self.bits = code, bits
        self.held: list[list] = [[(np.zeros(0, np.int64),) * 2] for _ in range(K)]
        self.new = 0

    def add(self, texts: list[bytes], train: bool) -> None:
        for found in pair_counts(texts, self.code, self.bits):
            for own, (pairs, n) in zip(self.held, found, strict=True):
                own.append((pairs, n if train else np.zeros_like(n)))
                self.new += len(pairs)
            if self.new > HELD_PAIRS:
                self._sum()

    def _sum(self) -> None:
        for own in self.held:
            pairs = np.concatenate([x for x, _ in own])
            order = np.argsort(pairs, kind="stable")  # of sorted runs
            pairs = pairs.take(order)
            first = np.flatnonzero(np.concatenate([np.ones(min(len(pairs), 1), bool), pairs[1:] != pairs[:-1]]))
            if len(first):
                own[:] = [(pairs.take(first), np.add.reduceat(np.concatenate([n for _, n in own]).take(order), first))]
        self.new = 0

    def found(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each context, pairs, sorted, and their counts."""
        self._sum()
        return [own[0] for own in self.held]


def slice_bits(bits: int) -> int:
    """Of a table with slot numbers of so many bits, how many of the first ones choose a slice: a slice has all nodes of its contexts."""
    return min(bits - NODE_BITS, max(8, bits - 26))


def values_of(pairs: np.ndarray, n: np.ndarray, code: Code, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a context's pairs, sorted, and how often each occurs among all training texts: how many decisions each has, and the values of all of these. All pairs of a slot's neighbours have to be there."""
    cuts = np.arange(int(pairs[0]) >> ROW_BITS + SPAN_BITS, (int(pairs[-1]) >> ROW_BITS + SPAN_BITS) + 2) << ROW_BITS + SPAN_BITS
    every, out = [], []
    for (lo, hi), low in zip(itertools.pairwise(np.searchsorted(pairs, cuts).tolist()), (cuts >> ROW_BITS).tolist(), strict=False):
        if hi == lo:
            continue
        sizes, at = decided(pairs[lo:hi], code, bits)
        at -= 2 * low
        counts = np.bincount(at, np.repeat(n[lo:hi], sizes), 2 << min(bits, SPAN_BITS)).reshape(-1, 2)
        at >>= 1
        here = np.zeros(len(counts), bool)
        here[at] = True
        here = np.flatnonzero(here)
        values = np.empty(len(counts), np.int16)
        values[here] = packed(counts.take(here, 0))
        every.append(sizes)
        out.append(values.take(at))
    return np.concatenate(every), np.concatenate(out)


def values_by_part(pairs: list[np.ndarray], n: list[np.ndarray], code: Code, bits: int):
    """values_of for parts that have some pairs each, in the order of each part's."""
    every = np.concatenate(pairs)
    order = np.argsort(every, kind="stable")  # of sorted runs
    every = every.take(order)
    new = np.concatenate([[True], every[1:] != every[:-1]])
    first = np.flatnonzero(new)
    sizes, values = values_of(every.take(first), np.add.reduceat(np.concatenate(n).take(order), first), code, bits)
    which = np.empty(len(every), np.int64)
    which[order] = np.cumsum(new) - 1
    starts = np.cumsum(sizes) - sizes
    ends = np.cumsum(list(map(len, pairs)))
    for own in np.split(which, ends[:-1]):
        size = sizes.take(own)
        at = np.repeat(starts.take(own) - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        yield values.take(at)


def packed(counts: np.ndarray) -> np.ndarray:
    """Of slots' zeros and ones: the stretched prediction in FINE parts, and in the last three bits the level of how much was seen."""
    pair = counts.reshape(-1, 2).astype(np.float32)
    stretch = np.rint(np.clip(np.log((pair[:, 1] + PRIOR) / (pair[:, 0] + PRIOR)), -7.9, 7.9) * FINE).astype(np.int16)
    level = np.minimum(np.log2(pair.sum(1) + 1), LEVELS - 1).astype(np.int16)
    return stretch << 3 | level


def squash(mixed: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(mixed, -10, 10)))


MIDDLE = squash((np.arange(BINS) + 0.5) * (20 / BINS) - 10)


class Model:
    def __init__(self, code: Code, table: np.ndarray, bits: int):
        """table: the contexts' tables one after the other, each of a multiple of 256 slots."""
        self.code, self.bits, self.table = code, bits, table
        self.base = offsets(bits)[:-1].tolist()

    def _found(self, own: Pieces) -> tuple[np.ndarray, list[np.ndarray]]:
        """Values, and by context where those of each byte's decisions start."""
        values, starts, n = [], [], 0
        for k, bits in enumerate(table_bits(self.bits)):
            pairs, which = _distinct(own.pairs(k))
            sizes, at = decided(pairs, self.code, bits)
            values.append(self.table[self.base[k] :].take(at >> 1))
            starts.append((np.cumsum(sizes) - sizes + n).take(which))
            n += len(at)
        return np.concatenate(values), starts

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 of the probability of each text and its end; texts of similar length are coded together."""
        out = np.zeros(len(texts))
        state = None
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for group in groups_of([texts[i] for i in order]):
            if not group[0][1]:
                state = self._fresh(len(group))
            np.add.at(out, [order[i] for i, _, _ in group], self._coded(group, state))
        return out

    def _fresh(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.tile(np.array(list(START.values()), np.float32) / FINE, (n * GATES, 1)), np.zeros((n, BINS, 2))

    def _coded(self, group, state) -> np.ndarray:
        """Costs of pieces, largest first; learns their texts' weights and maps block by block, RUNS texts at a time, so that what is at hand stays small."""
        own = Pieces([(b, o) for _, b, o in group], self.code, self.bits)
        ends = np.cumsum(own.sizes)
        # of a byte: where its values start; above them, in the first numbers, its text, its code's row and the decisions before
        values, starts = self._found(own)
        of_byte = np.stack(starts, 1)
        of_byte[:, 0] |= own.piece << 32
        of_byte[:, 1] |= own.row * CODE << 32
        of_byte[:, 2] |= (ends - own.sizes) << 32
        of_byte = of_byte.view(f"V{8 * K}").ravel()
        cuts = own.runs[(np.arange(len(own.runs)) - np.searchsorted(own.block, own.block)) % RUNS == 0].tolist()
        before = [int(ends[at] - own.sizes[at]) for at in cuts]
        out = np.zeros(len(group))
        weights = state[0].reshape(-1, GATES, K)
        for (lo, hi), done in zip(itertools.pairwise([*cuts, len(own.place)]), before, strict=True):
            first, end = int(own.piece[lo]), int(own.piece[hi - 1]) + 1
            of_decision = np.repeat(of_byte[lo:hi], own.sizes[lo:hi]).view(np.int64).reshape(-1, K)
            nth = np.arange(done, done + len(of_decision))  # of a byte's decisions
            nth -= of_decision[:, 2] >> 32
            made = self.code.both.take((of_decision[:, 1] >> 32) + nth)
            who = (of_decision[:, 0] >> 32) - first
            of_decision &= 0xFFFFFFFF
            found = [values.take(of_decision[:, k] + nth) for k in range(K)]
            out[first:end] += self._block(made, who, found, weights[first:end], state[1][first:end])
        return out

    def _block(self, made: np.ndarray, who: np.ndarray, v: list[np.ndarray], weights: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Costs of a block's decisions, by text; v: their values by context. Moves weights and maps."""
        n = len(seen)
        gate = np.zeros(len(made), np.int16)
        for c in GATED:
            gate *= LEVELS
            gate += v[CONTEXTS.index(c)] & 7
        gate += who.astype(np.int16) * np.int16(GATES)
        at = gate.astype(np.int64)
        bit = made & 1
        b = bit.astype(np.float32)
        x = np.empty((K, len(at)), np.float32)
        for k in range(K):
            v[k] >>= 3
            x[k] = v[k]
        chosen = weights.reshape(-1).view(np.complex128).take(at).view(np.float32).reshape(-1, K)  # rows of four numbers
        mixed = chosen[:, 0] * x[0]
        for k in range(1, K):
            mixed += chosen[:, k] * x[k]
        np.clip(mixed, -10, 10, out=mixed)
        p = np.exp(-mixed)
        p += 1
        np.divide(1, p, out=p)
        mixed += 10
        mixed *= np.float32(BINS / 20)
        np.minimum(mixed, BINS - 1, out=mixed)
        spot = mixed.astype(np.int64)
        who *= BINS
        spot += who
        held = seen.sum(2)
        shift = 0.5 * (seen[:, :, 1] - held * MIDDLE) / (held + MAP_PRIOR)  # towards the text's own frequencies
        error = b - p
        p += shift.astype(np.float32).ravel().take(spot)
        np.clip(p, 1e-5, 1 - 1e-5, out=p)
        p -= 1 - b
        np.abs(p, out=p)
        np.log(p, out=p)
        cost = np.add.reduceat(p, np.searchsorted(who, np.arange(n) * BINS)).astype(np.float64) / math.log(10)
        error *= np.float32(RATE / FINE**2)
        x *= error
        slope = np.stack([np.bincount(at, own, n * GATES) for own in x], 1)
        weights.reshape(-1, K)[:] += np.clip(slope, -STEP / FINE, STEP / FINE)
        spot *= 2
        spot += bit
        seen += np.bincount(spot, minlength=n * BINS * 2).reshape(n, BINS, 2)
        return cost


class Places:
    """Where each of some distinct numbers has its things: buckets by their mixed bits, with one number or two each."""

    def __init__(self, keys: np.ndarray, places: np.ndarray):
        self.low = np.uint64(64 - max(1, len(keys).bit_length()))
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        self.both = np.empty((len(keys), 2), np.int64)  # a key and its place lie in one line of the cache
        self.both[:, 0] = keys.take(order)
        self.both[:, 1] = places.take(order)
        self.both = self.both.view(np.complex128).ravel()
        del order
        n = np.bincount(bucket, minlength=1 << 64 - int(self.low)).astype(np.int32)
        self.most = int(n.max())
        self.starts = np.cumsum(n, dtype=np.int32) - n

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.low).view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self.starts.take(self._bucket(keys))
        both = self.both.take(at, mode="clip").view(np.int64).reshape(-1, 2)  # clipped: the last bucket may be empty
        found = both[:, 1].copy()
        rest = np.flatnonzero(both[:, 0] != keys)
        at, keys = at.take(rest), keys.take(rest)
        for _ in range(self.most):
            if not len(rest):
                return found
            at += 1
            both = self.both.take(at, mode="clip").view(np.int64).reshape(-1, 2)
            found[rest] = both[:, 1]
            wrong = np.flatnonzero(both[:, 0] != keys)
            rest, at, keys = rest.take(wrong), at.take(wrong), keys.take(wrong)
        raise KeyError("a pair that wasn't asked for")


class PartModel(Model):
    """The model as far as the texts of a part need it."""

    def __init__(self, code: Code, bits: int, answers: list[tuple[np.ndarray, np.ndarray]]):
        """answers: for each context, the part's distinct pairs and the values of all their decisions, one pair after the other."""
        self.code, self.bits = code, bits
        self.values = np.concatenate([values for _, values in answers])
        self.places, n = [], 0
        for pairs, values in answers:
            sizes = code.size.take(pairs & ((1 << ROW_BITS) - 1))
            self.places.append(Places(pairs, np.cumsum(sizes) - sizes + n))
            n += len(values)

    def _found(self, own: Pieces) -> tuple[np.ndarray, list[np.ndarray]]:
        return self.values, [places.of(own.pairs(k)) for k, places in enumerate(self.places)]
