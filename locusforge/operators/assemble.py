"""Assembly of loci from a contig's motifs.

Seeds are found by windows. Merging and elongation depend on what was merged and used before, so they run as a Python
fold, but not on whole contigs: only motifs in reach of a seed go to Python, and those of seeds whose reaches overlap
form an island (near_islands). Small contigs whose motifs are dear to make twice are cut where neighbours are further
apart than any distance of the rules (far_islands); there a (motif, start) on both strands - the rules compare these two
alone - makes the whole contig one island.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusforge import rules
from locusforge.functions import loci as fn
from locusforge.operators.motifs import KEYS, TURN, by, dealt, keyed, mark_seeds, seed_rows, with_turns
from locusforge.schemas import LOCUS_MOTIF

#: Bases of a tile in which motifs meet the spans of islands.
SPAN = 1 << 16


@dataclass(frozen=True)
class AssembleParams:
    within: int = 500
    elongate: int = 2500
    between: int = 10_000
    keep_duplicates: bool = True  # overlapping seeds share motifs, and both copies are reported


class Island:
    """Motifs in order: ids, starts, reverse flags, stop flags. A locus is a list of their numbers, in that order."""

    def __init__(self, ids: list[int], starts: list[int], reverse: list[bool], stops: list[bool]):
        self.ids, self.starts, self.reverse, self.stops = ids, starts, reverse, stops
        self.rank = [rules.RANK.get(i, 0) for i in ids]
        self.key = list(zip(ids, starts, strict=True))
        self.first = {k: i for i, k in reversed(list(enumerate(self.key)))}

    def place(self, i: int) -> tuple[bool, int]:
        return self.reverse[i], -self.starts[i] if self.reverse[i] else self.starts[i]

    def ordered(self, locus: list[int]) -> list[int]:
        return sorted(locus, key=self.place)

    def locus_place(self, locus: list[int]) -> tuple:
        return *self.place(locus[0]), -len(locus)

    def distance(self, i: int, j: int) -> int:
        return abs(self.starts[i] - self.starts[j])

    def compatible(self, a: list[int], b: list[int], between: int) -> bool:
        """Same strand, near at one pair of ends, and ranks that rise through the union (equal only for repeats)."""
        if self.reverse[a[0]] != self.reverse[b[0]] or all(self.distance(x, y) > between for x in (a[0], a[-1]) for y in (b[0], b[-1])):
            return False
        union = self.ordered(list({self.key[i]: i for i in reversed(a + b)}.values())[::-1])
        return all(self.rank[y] > self.rank[x] or self.ids[y] in rules.LRR for x, y in zip(union, union[1:], strict=False))

    def merged(self, seeds: list[list[int]], between: int) -> list[list[int]]:
        out: list[list[int]] = []
        for seed in sorted(seeds, key=self.locus_place):
            if out and self.compatible(out[-1], seed, between):
                out[-1] = self.ordered(out[-1] + seed)
            else:
                out.append(seed)
        return out

    def elongated(self, loci: list[list[int]], reach: int) -> list[list[int]]:
        used: set[tuple[int, int]] = set()
        out = []

        def may_join(i: int) -> bool:
            return self.key[i] not in used and (not self.stops[i] or rules.CATEGORY[self.ids[i]] == "NBARC")

        for locus in loci:
            if any(self.key[i] in used for i in locus):
                continue
            anchor = self.first[self.key[locus[0]]]
            for i in range(anchor - 1, -1, -1):
                head = locus[0]
                if self.distance(head, i) > reach:
                    break
                if self.rank[i] < self.rank[head] and may_join(i):
                    locus = self.ordered([*locus, i])
            tail = next((i for i in range(anchor, len(self.ids)) if self.key[i] == self.key[locus[-1]]), len(self.ids))
            for i in range(tail + 1, len(self.ids)):
                end = locus[-1]
                if self.distance(end, i) > reach:
                    break
                if (self.rank[i] > self.rank[end] or self.rank[i] == self.rank[end] and self.ids[i] in rules.LRR) and may_join(i):
                    locus = self.ordered([*locus, i])
            used.update(self.key[i] for i in locus)
            out.append(locus)
        return out

    def assemble(self, seeds: list[list[int]], params: AssembleParams) -> list[list[int]]:
        loci = self.elongated(self.merged(seeds, params.between), params.elongate)
        return [self.ordered(x) for x in sorted(loci, key=self.locus_place)]


def far_islands(motifs: DataFrame, params: AssembleParams) -> DataFrame:
    """Adds island: contigs cut where neighbours are far apart. For contigs small enough for one task; the motifs are made only once."""
    w = by("contig_id")
    far = max(params.within, params.elongate, params.between)
    gap = F.abs(F.col("dna_start") - F.lag("dna_start").over(w)) > far
    both = Window.partitionBy("contig_id", "motif_id", "dna_start")
    # the first sort serves the windows over contigs, the next one all windows in order
    rows = keyed(motifs).withColumn("__both", (F.min("strand").over(both) != F.max("strand").over(both)).cast("int"))
    rows = rows.withColumn("__whole", F.max("__both").over(Window.partitionBy("contig_id")))
    rows = mark_seeds(rows, w, params.within, whole=True).withColumn("__cut", F.coalesce(gap, F.lit(False)).cast("int"))
    rows = rows.withColumn("island", F.when(F.col("__whole") == 1, 0).otherwise(F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("bigint"))
    seeded = F.max("seed_length").over(Window.partitionBy("contig_id", "island"))
    return rows.withColumn("__seeded", seeded).filter("__seeded > 0").drop("__minus", "__along")


def _united(table: DataFrame, pad: int) -> DataFrame:
    """Spans (contig_id, lo, hi, seeds) that overlap become one, which is widened by pad; only those with seeds stay."""
    w = Window.partitionBy("contig_id").orderBy("lo", "hi")
    cut = F.coalesce(F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    rows = table.withColumn("__cut", cut.cast("int")).withColumn("n", F.sum("__cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy("contig_id", "n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("seeds").alias("seeds")).filter("seeds > 0")
    return spans.select("contig_id", (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"), "seeds")


def reaches(motifs: DataFrame, params: AssembleParams, table: DataFrame | None) -> DataFrame:
    """(contig_id, lo, hi): disjoint spans, on both strands alike, outside which no locus takes, tests or blocks a motif.

    A locus grows by steps of at most `elongate`, to ranks that fall on the left and rise on the right, so its seed's
    ranks bound the steps; only repeats may go on at one rank, as far as repeats without a stop follow each other. The
    last step is the one past the repeats. Seeds merge within `between`. As spans hold both strands of their places, equal
    (motif, start) on two strands, which block or lead each other, lie in one span.
    """
    step, lrr = params.elongate, max(rules.RANK[i] for i in rules.LRR)
    steps = F.greatest(rules.lookup(rules.RANK, F.col("motif_id")) - 1, lrr - rules.lookup(rules.RANK, F.col("last_id")), F.lit(1))
    by = F.greatest(steps * step, F.lit(params.between))
    seeds = seed_rows(motifs, params.within, table).filter("seed_length > 0").select("contig_id", (F.col("reach_lo") - by).alias("lo"), (F.col("reach_hi") + by).alias("hi"), F.lit(1).alias("seeds"))
    # repeats that share a bin of one step follow each other
    repeats = motifs.filter(F.col("motif_id").isin(*rules.LRR) & ~F.coalesce(F.contains("protein_sequence", F.lit("*")), F.lit(False)))
    repeats = repeats.groupBy("contig_id", F.floor(F.col("dna_start") / max(step, 1))).agg(F.min("dna_start").alias("lo"), (F.max("dna_start") + step).alias("hi")).select("contig_id", "lo", "hi", F.lit(0).alias("seeds"))
    return _united(_united(seeds.unionByName(repeats), step), 0)


def near_islands(motifs: DataFrame, params: AssembleParams, table: DataFrame | None) -> DataFrame:
    """Adds fore, back and island, and keeps the motifs in reach of a seed."""
    spans = reaches(motifs, params, table).select(F.col("contig_id").alias("__contig"), "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / SPAN), F.floor(F.col("hi") / SPAN))).alias("__tile"))
    rows = with_turns(motifs, table).withColumn("__at", F.floor(F.col("dna_start") / SPAN))
    here = (F.col("contig_id") == F.col("__contig")) & (F.col("__at") == F.col("__tile")) & F.col("dna_start").between(F.col("lo"), F.col("hi"))
    return rows.join(spans, here).withColumn("island", F.col("lo"))


_PIECE = f"contig_id string, first_at bigint, piece int, motifs array<{LOCUS_MOTIF}>"
_KINDS = {"motif_id": pa.int32(), "protein_sequence": pa.string(), "pvalue": pa.float64(), "dna_start": pa.int64(), "dna_end": pa.int64(), "strand": pa.string()}


def fold_island(rows: list[tuple], params: AssembleParams, whole: bool = False) -> Iterator[list[int]]:
    """Loci of an island's (motif, start, reverse, stop, fore, back), in order. Between strands that don't meet at the contig's turn stands a motif that nothing can pass. `whole`: the island is a run of the contig's order, so its strands meet only there."""
    turn = next((i for i, r in enumerate(rows) if r[2]), len(rows))
    met = whole or turn in (0, len(rows)) or (rows[turn - 1][1], rows[turn][1]) == (rows[0][4], rows[0][5])
    shown = [r[:4] for r in rows]
    if not met:
        shown.insert(turn, (0, 1 << 62, False, True))
    for locus in fold_contig([(m, s, "-" if back else "+", stop) for m, s, back, stop in shown], params):
        if not params.keep_duplicates:
            locus = list(dict.fromkeys(locus))
        yield locus if met else [i - (i > turn) for i in locus]


def fold_sorted(params: AssembleParams, whole: bool = False):
    """Sorted rows -> loci, an island at a time: a task holds one island and a batch."""

    turns = () if whole else ("fore", "back")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        out: list[tuple] = []

        def close() -> None:
            if held:
                for n, locus in enumerate(fold_island([(r[0], r[3], r[5] == "-", "*" in (r[1] or ""), *r[6:]) for r in held], params, whole)):
                    out.append((key[0], locus[0], n, [dict(zip(_KINDS, held[i], strict=False)) for i in locus]))

        def flush() -> pa.RecordBatch:
            item = pa.list_(pa.struct(list(_KINDS.items())))
            columns = zip(*out, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), item), strict=True)], ["contig_id", "first_at", "piece", "motifs"])
            out.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_KINDS, *turns)]
            for where, row in zip(zip(batch.column("contig_id").to_pylist(), batch.column("island").to_pylist(), strict=True), zip(*columns, strict=True), strict=True):
                if where != key:
                    close()
                    held, key = [], where
                    if len(out) >= 1000:
                        yield flush()
                held.append(row)
        close()
        if out:
            yield flush()

    return run


def assemble(motifs: DataFrame, params: AssembleParams = AssembleParams(), table: DataFrame | None = None, whole: bool = False) -> DataFrame:  # noqa: B008
    """motifs -> loci(name, contig_id, locus_no, strand, start_pos, end_pos, domains, motif_list, is_complete, has_stop, motifs).

    The motifs are read several times, by tiles, unless `whole`: then once, a contig's in one task. `table`: their turns, if known.
    """
    whole = whole or max(params.within, 2 * params.elongate) > TURN
    rows = far_islands(motifs, params) if whole else near_islands(motifs, params, table)
    turns = () if whole else ("fore", "back")
    slim = keyed(rows).select("contig_id", "island", *dict.fromkeys((*_KINDS, *turns, *KEYS)))
    where = ("contig_id", "island")
    placed = dealt(slim.repartition(*where), *where).sortWithinPartitions("contig_id", "island", *KEYS)
    return name_loci(placed.select("contig_id", "island", *_KINDS, *turns).mapInArrow(fold_sorted(params, whole), _PIECE))


def name_loci(loci: DataFrame) -> DataFrame:
    """Numbers the loci of each contig: forward first and ascending, reverse descending, more motifs first."""
    m = F.col("motifs")
    start, end = fn.span(m)
    first = m[0]
    w = Window.partitionBy("contig_id").orderBy(first["strand"] == "-", F.when(first["strand"] == "-", -first["dna_start"]).otherwise(first["dna_start"]), -F.size("motifs"), "first_at", "piece")
    out = dealt(loci, "contig_id", few=True).withColumn("locus_no", F.row_number().over(w).cast("bigint"))
    return out.select(
        F.concat("contig_id", F.lit("_nlr"), F.col("locus_no").cast("string")).alias("name"), "contig_id", "locus_no", first["strand"].alias("strand"), start.alias("start_pos"), end.alias("end_pos"),
        fn.domain_string(m).alias("domains"), fn.motif_list(m).alias("motif_list"), fn.is_complete(m).alias("is_complete"), fn.has_stop(m).alias("has_stop"), "motifs",
    )


def fold_contig(motifs: list[tuple[int, int, str, bool]], params: AssembleParams = AssembleParams()) -> Iterator[list[int]]:  # noqa: B008
    """The same fold over one contig's (motif, start, strand, stop) in order, without Spark: loci as lists of numbers."""
    island = Island([m[0] for m in motifs], [m[1] for m in motifs], [m[2] == "-" for m in motifs], [m[3] for m in motifs])
    seeds = []
    for i in range(len(motifs)):
        for n in (2, 3):
            if tuple(island.ids[i : i + n]) in rules.SEEDS and len(island.ids[i : i + n]) == n and all(island.distance(k, k + 1) <= params.within for k in range(i, i + n - 1)):
                seeds.append(list(range(i, i + n)))
                break
    yield from island.assemble(seeds, params)
