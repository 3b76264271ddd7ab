"""The motif scan: translation, matrix scores, arbitration of overlaps and the signature filter, in one Arrow stage.

A matrix whose columns all score a letter with one of two values a fixed step apart, as the built-in ones do, counts
matches: bits of eight places lie in a byte, and adders made of bitwise operations count them, over all proteins of a
batch together. Scores of other matrices are sums over position triples: a table gives three positions' scores of four or
eight motifs at once, so windows of width w cost w / 12 or w / 24 gathers a motif. Only windows over the first threshold
leave numpy; arbitration, whose outcome depends on order, walks over those few.

Nothing is shuffled, and a batch is handled in slices of about SLICE bases, so memory doesn't grow with the fragments.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from locusforge import rules
from locusforge.schemas import MOTIF
from locusforge.sources.config import Motifs

SLICE = 1 << 19
LETTERS = 27  # A-Z, and the stop codon
BLOCK = 1 << 14  # places scored at once, so that they stay in a core's cache
ROW = 1 << 15  # bytes of a plane of bits, each of eight places

_BASE = np.full(256, 4, np.int64)
for _i, _b in enumerate(b"ACGT"):
    _BASE[_b] = _i
_AMINO = np.array([26 if c == "*" else ord(c) - 65 for c in rules.CODONS] + [ord("X") - 65])
_SHOWN = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ*", np.uint8)


def translated(bases: np.ndarray, frame: int) -> np.ndarray:
    """Amino-acid numbers of the whole codons from `frame` on; bases are 0-3, or 4 for others."""
    n = max(0, (len(bases) - frame) // 3)
    c = bases[frame : frame + 3 * n].reshape(-1, 3)
    known = (c < 4).all(axis=1)
    return _AMINO[np.where(known, c @ np.array([16, 4, 1]), 64)]


def shown(protein: np.ndarray) -> str:
    return _SHOWN[protein].tobytes().decode()


def strand_bases(fragment: bytes, strand: str) -> np.ndarray:
    bases = _BASE[np.frombuffer(fragment, np.uint8)]
    return bases if strand == "+" else np.where(bases < 4, 3 - bases, 4)[::-1]


_BASE5 = _BASE.astype(np.uint8)
_OTHER5 = np.array([3, 2, 1, 0, 4], np.uint8)
#: Amino acid of each codon over five bases, the fifth being any other.
_AMINO5 = np.array([_AMINO[16 * a + 4 * b + c] if max(a, b, c) < 4 else _AMINO[64] for a in range(5) for b in range(5) for c in range(5)], np.uint8)
# as tables of bytes.translate, which costs less than an index of numpy
_FORWARD, _BACK = _BASE5.tobytes(), _OTHER5[_BASE5].tobytes()
_CODON = _AMINO5.tobytes() + bytes(256 - len(_AMINO5))


def six(fragment: bytes) -> Iterator[tuple[str, int, np.ndarray]]:
    """The frames share one look-up a strand: each is every third of its codons."""
    for strand, bases in (("+", fragment.translate(_FORWARD)), ("-", fragment[::-1].translate(_BACK))):
        b = np.frombuffer(bases, np.uint8)
        codons = np.frombuffer((b[:-2] * np.uint8(25) + b[1:-1] * np.uint8(5) + b[2:]).tobytes().translate(_CODON), np.uint8)
        for frame in range(3):
            yield strand, frame, codons[frame::3]


def planes(text: np.ndarray, row: int, reach: int) -> list[np.ndarray]:
    """For each letter the bytes of row + reach places: bit j of byte t tells whether place j * row + t holds it. So a step along the text is a step along the bytes."""
    n = row + reach
    bits = [np.zeros(-(-n // 8), "<u8") for _ in range(5)]
    ones, held = np.uint64(0x0101010101010101), np.zeros(8 * len(bits[0]), np.uint8)
    for j in range(8):
        held[:n] = text[j * row : j * row + n]
        words = held.view("<u8")
        for b, plane in enumerate(bits):
            plane |= (words >> np.uint64(b) & ones) << np.uint64(j)
    out = [~bits[4], bits[4]]
    for plane in bits[3::-1]:
        off = ~plane
        out = [x & y for x in out for y in (off, plane)]
    return [x.view(np.uint8) for x in out[:LETTERS]]


def count(inputs: list[np.ndarray]) -> list[np.ndarray]:
    """Planes of the bits of the number of ones in the inputs, the least first: full adders, level by level."""
    out = []
    while inputs:
        carries, total = [], inputs[0]
        for a, b in zip(inputs[1::2], inputs[2::2], strict=False):
            half, carry = total ^ a, total & a
            total = half ^ b
            half &= b
            carry |= half
            carries.append(carry)
        if len(inputs) % 2 == 0:
            carries.append(total & inputs[-1])
            total = total ^ inputs[-1]
        out.append(total)
        inputs = carries
    return out


def at_least(counts: list[np.ndarray], n: int) -> np.ndarray:
    """The plane of the places whose count is n or more."""
    over, same = np.zeros_like(counts[0]), np.full_like(counts[0], 255)
    for k in range(len(counts) - 1, -1, -1):
        if n >> k & 1:
            same &= counts[k]
        else:
            over |= same & counts[k]
            same &= ~counts[k]
    return over | same


class Scanner:
    def __init__(self, motifs: Motifs):
        self.motifs = motifs
        self.reach = motifs.max_width
        self.first = {i: motifs.threshold(i, rules.CANDIDATE_P) for i in motifs.order}
        if motifs.order:
            self.pack()
        self.tables = {}
        for i in motifs.order:
            m = motifs.pwm[i]
            full = np.zeros((LETTERS, -(-m.shape[1] // 3) * 3), np.int32)
            full[:26, : m.shape[1]] = m
            self.tables[i] = [(full[:, None, None, k] + full[None, :, None, k + 1] + full[None, None, :, k + 2]).ravel() for k in range(0, full.shape[1], 3)]

    def scores(self, motif_id: int, triples: np.ndarray, n: int) -> np.ndarray:
        """Score of the window at each of the first n places; triples must reach past n by the width."""
        total = np.zeros(n, np.int32)
        for k, table in enumerate(self.tables[motif_id]):
            total += table[triples[3 * k : 3 * k + n]]
        return total

    def pack(self) -> None:
        """Letters that all matrices score alike share a number, and motifs of similar width share a table, each with a lane of 8 or 16 bits in its entries.

        A lane counts from the least score in units of the scores' greatest common divisor and stays under half of its
        numbers: lifted by what its threshold lacks to half, its highest bit is set where the threshold is reached.
        """
        motifs = self.motifs
        self.full = full = {i: np.zeros((LETTERS, motifs.width(i)), np.int64) for i in motifs.order}
        for i in motifs.order:
            full[i][:26] = motifs.pwm[i]
        low = {i: m.min(axis=0) for i, m in full.items()}
        rows = np.concatenate([full[i] for i in motifs.order], axis=1)
        _, first, code = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        self.code, self.kinds = code.reshape(-1).astype(np.int64), len(first)
        unit = {i: max(1, int(np.gcd.reduce((full[i] - low[i]).ravel()))) for i in motifs.order}
        top = {i: int((full[i].max(axis=0) - low[i]).sum()) // unit[i] for i in motifs.order}
        # letters that score a step more than the column's others, for columns that have such
        step = {i: (full[i] - low[i]) // unit[i] for i in motifs.order}
        self.counted = {i: ([(j, tuple(np.flatnonzero(c).tolist())) for j, c in enumerate(step[i].T) if c.any()], int(low[i].sum()), unit[i]) for i in motifs.order if step[i].max(initial=0) <= 1}
        fits = {i: next((b for b in (8, 16) if top[i] < 1 << b - 1), 0) for i in motifs.order if i not in self.counted}
        self.packs, self.alone = [], [i for i in fits if not fits[i]]
        for bits in (8, 16):
            some = sorted((i for i in fits if fits[i] == bits), key=motifs.width)
            for g in range(0, len(some), 64 // bits):
                group, tables = some[g : g + 64 // bits], []
                for k in range(0, max(map(motifs.width, group)), 3):
                    table = np.zeros(self.kinds**3, "<u8")
                    for lane, i in enumerate(group):
                        c = [(full[i][first, j] - low[i][j]) // unit[i] if j < motifs.width(i) else np.zeros(self.kinds, np.int64) for j in range(k, k + 3)]
                        table += (c[0][:, None, None] + c[1][None, :, None] + c[2][None, None, :]).ravel().astype("<u8") << np.uint64(bits * lane)
                    tables.append(table)
                self.packs.append((tables, (bits, [(lane, i, int(low[i].sum()), unit[i]) for lane, i in enumerate(group)])))

    def counts_over(self, text: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """over() of the counted matrices."""
        row = -(-n // (64 * -(-n // (8 * ROW)))) * 8
        padded = np.concatenate([text, np.zeros(8 * row + self.reach, np.uint8)])
        for begin in range(0, n, 8 * row):
            letters = planes(padded[begin:], row, self.reach)
            for i, (columns, low, unit) in self.counted.items():
                least = -(-max(0, int(self.first[i]) - low) // unit)
                if least > len(columns):
                    continue
                inputs = [(letters[a[0]] if len(a) == 1 else np.bitwise_or.reduce([letters[x] for x in a]))[j : j + row] for j, a in columns]
                reached = at_least(count(inputs), least) if least else np.full(row, 255, np.uint8)
                some = np.flatnonzero(reached.view("<u8"))  # words first: they are few
                if not len(some):
                    continue
                at, t, j = np.nonzero(np.unpackbits(reached.reshape(-1, 8, 1)[some], axis=2, bitorder="little"))
                places = np.sort(begin + j * row + 8 * some[at] + t)
                places = places[places < n]
                along = np.arange(self.full[i].shape[1])
                yield i, places, self.full[i][padded[places[:, None] + along], along].sum(axis=1)

    def over(self, text: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(motif, places, scores) of windows over the first threshold at the first n places."""
        if self.counted:
            yield from self.counts_over(text, n)
        if not self.packs and not self.alone:
            return
        code = self.code[text]
        packs = []
        for tables, (bits, lanes) in self.packs:
            half = 1 << bits - 1
            least = [-(-max(0, int(self.first[i]) - low) // unit) for _, i, low, unit in lanes]
            lifts = [half - x if x <= half else 0 for x in least]  # beyond half: never reached
            packs.append((tables, bits, np.uint64(sum(x << bits * k for k, x in enumerate(lifts))), np.uint64(sum(half << bits * k for k in range(len(lanes)))), [(*x, up) for x, up in zip(lanes, lifts, strict=True)]))
        for begin in range(0, n, BLOCK):
            m = min(BLOCK, n - begin)
            c = code[begin : begin + m + 3 * self.reach + 3]
            triples = (c[:-2] * self.kinds + c[1:-1]) * self.kinds + c[2:]
            part = np.empty(m, "<u8")
            for tables, bits, lift, high, lanes in packs:
                total = tables[0].take(triples[:m], mode="clip")
                total += lift
                for k, table in enumerate(tables[1:], 1):
                    table.take(triples[3 * k : 3 * k + m], out=part, mode="clip")
                    total += part
                reached = np.flatnonzero(np.bitwise_and(total, high, out=part))
                if not len(reached):
                    continue
                apart = total[reached].view(f"<u{bits // 8}").reshape(len(reached), -1)
                for lane, i, low, unit, up in lanes:
                    own = np.flatnonzero(apart[:, lane] >= 1 << bits - 1)
                    if len(own):
                        yield i, reached[own] + begin, (apart[own, lane].astype(np.int64) - up) * unit + low
        if self.alone:
            wide = text.astype(np.int64)
            triples = wide[:-2] * LETTERS**2 + wide[1:-1] * LETTERS + wide[2:]
            for i in self.alone:
                total = self.scores(i, triples, n)
                places = np.flatnonzero(total >= self.first[i])
                yield i, places, total[places]

    def candidates(self, proteins: list[np.ndarray]) -> list[list[tuple[int, int, float]]]:
        """Of each protein the (motif, place, p-value) of windows over the first threshold, in scan order."""
        found: list[list[tuple[int, int, float]]] = [[] for _ in proteins]
        n = sum(map(len, proteins))
        if not n or not self.motifs.order:
            return found
        text = np.zeros(n + 3 * self.reach + 3, np.uint8)
        text[:n] = np.concatenate(proteins)
        ends = np.cumsum([len(p) for p in proteins])
        begins = ends - [len(p) for p in proteins]
        turn = {i: k for k, i in enumerate(self.motifs.order)}
        for motif_id, places, scores in sorted(self.over(text, n), key=lambda x: turn[x[0]]):
            width = self.motifs.width(motif_id)
            owner = np.searchsorted(ends, places, side="right")
            for q, o, score in zip(places.tolist(), owner.tolist(), scores.tolist(), strict=True):
                if q + width <= ends[o] and len(proteins[o]) >= self.reach:
                    found[o].append((motif_id, q - int(begins[o]), self.motifs.pvalue(motif_id, score)))
        return found

    def arbitrate(self, candidates: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """(place, motif, p-value) of the windows that hold against all they overlap, by place.

        A newcomer stands if nothing overlaps it, or if it is less likely by chance than all that overlap it together;
        then these go.
        """
        standing: dict[int, tuple[int, float]] = {}
        places: list[int] = []  # of those standing, ascending: only places within the greatest width can overlap
        for motif_id, at, p in candidates:
            stop = at + self.motifs.width(motif_id)
            first, here, last = bisect_left(places, at - self.reach), bisect_left(places, at), bisect_left(places, stop)
            after = places[here:last]
            before = [k for k in places[first:here] if k + self.motifs.width(standing[k][0]) > at]
            joint = 1.0
            for k in after + before:
                joint *= standing[k][1]
            if (after or before) and p >= joint:
                continue
            for k in after + before:
                del standing[k]
                del places[bisect_left(places, k)]
            standing[at] = (motif_id, p)
            insort(places, at)
        return [(k, *standing[k]) for k in places]

    def accepted(self, proteins: list[np.ndarray]) -> Iterator[list[tuple[int, int, float]]]:
        for c in self.candidates(proteins):
            yield [h for h in self.arbitrate(c) if h[2] < rules.ACCEPT_P]


def has_signature(ids: list[int]) -> bool:
    """Any signature as a contiguous part of the ordered ids."""
    return any(tuple(ids[i : i + len(s)]) == s for s in rules.SIGNATURES for i in range(len(ids) - len(s) + 1))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    begin = size = 0
    for i, n in enumerate(batch.column("frag_len").to_pylist()):
        if size and size + n > SLICE:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < len(batch):
        yield batch.slice(begin)


def scan_fragments(fragments: DataFrame, motifs: Motifs, signature: bool = True) -> DataFrame:
    """fragments -> motifs with DNA coordinates. With signature, a frame without any signature gives nothing."""
    kinds = [("motif_id", pa.int32()), ("protein_sequence_id", pa.string()), ("position", pa.int64()), ("protein_sequence", pa.string()), ("pvalue", pa.float64()), ("score", pa.float64()), ("contig_id", pa.string()), ("dna_start", pa.int64()), ("dna_end", pa.int64()), ("strand", pa.string()), ("frame", pa.int32()), ("frag_offset", pa.int64())]
    layout = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(motifs)
        for batch in batches:
            for part in _slices(batch):
                names, proteins = [], []
                for contig, offset, frag in zip(*(part.column(c).to_pylist() for c in ("contig_id", "frag_offset", "frag")), strict=True):
                    for strand, frame, protein in six(frag.encode()):
                        names.append((contig, offset, len(frag), strand, frame))
                        proteins.append(protein)
                rows = []
                for (contig, offset, length, strand, frame), protein, hits in zip(names, proteins, scanner.accepted(proteins), strict=True):
                    if not hits or signature and not has_signature([m for _, m, _ in hits]):
                        continue
                    for q, motif_id, p in hits:
                        width = motifs.width(motif_id)
                        along = frame + 3 * q
                        start = offset + along if strand == "+" else offset + length - along - 3 * width
                        rows.append((motif_id, f"{contig}_{offset}_frame{strand}{frame}", q + 1, _SHOWN[protein[q : q + width]].tobytes().decode(), p, 0.0, contig, start, start + 3 * width, strand, frame, offset))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), layout, strict=True)], schema=layout)

    return fragments.select("contig_id", "frag_offset", "frag_len", "frag").mapInArrow(run, MOTIF)
