"""Order, dedup, signatures and seeds of motif tables: windows only."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusforge import rules

#: Bases of a tile, the unit in which long contigs are dealt over tasks (short enough for a window's rows to stay in its array, of 4,096 rows); strands that end further apart than TURN never meet in a rule.
TILE, TURN = 1 << 18, 50_000
#: Bytes of the greatest input that one task of a sort gets, about.
SHARE = 1 << 22


def order_columns() -> list[Column]:
    """The order of a contig's motifs: forward first and ascending, reverse descending; then the fragment; then the frame and motif, so that the order is total."""
    along = F.when(F.col("strand") == "-", -F.col("dna_start")).otherwise(F.col("dna_start"))
    return [F.col("strand") == "-", along, F.col("frag_offset"), F.col("frame"), F.col("motif_id"), F.col("protein_sequence"), F.col("pvalue")]


KEYS = ("__minus", "__along", "frag_offset", "frame", "motif_id", "protein_sequence", "pvalue")


def keyed(motifs: DataFrame) -> DataFrame:
    """Adds the keys of the order that are no columns: windows share a sort only if its keys are columns."""
    minus, along = order_columns()[:2]
    return motifs.withColumns({"__minus": minus, "__along": along})


def by(*parts: str) -> Window:
    """Windows over keyed rows."""
    return Window.partitionBy(*parts).orderBy(*KEYS)


def dealt(rows: DataFrame, *keys: str, few: bool = False) -> DataFrame:
    """Rows dealt by keys over tasks that grow in number with the input, so that a task's memory doesn't grow.

    Also where the session's shuffle partitions are enough: adaptive execution puts those together, up to 64 MB of packed
    rows a task or what the session says. `few`: only where they are too few, for rows that are few against the input.
    """
    leaves = rows._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    n = max((x // SHARE for x in sizes if x < 1 << 50), default=0)  # greater: unknown
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n <= (parts if few else 1):
        return rows
    return rows.repartition(max(n, min(parts, spark.sparkContext.defaultParallelism)), *keys)


def rank_motifs(motifs: DataFrame) -> DataFrame:
    """Numbers of a tile's motifs, and the motifs of the tiles before it: no task holds a contig."""
    # keys without nulls, so that the join and the window are dealt alike; nulls come first, as in the order
    side = F.coalesce((F.col("strand") == "-").cast("int"), F.lit(-1)) + F.when(F.col("contig_id").isNull(), 3).otherwise(0)
    key = ["__contig", "__side", "__tile"]
    rows = keyed(motifs).withColumns({"__contig": F.coalesce("contig_id", F.lit("")), "__side": side, "__tile": F.coalesce(F.floor(F.col("__along") / TILE), F.lit(-(2**62)))})
    w = Window.partitionBy("__contig", F.col("__side") > 2).orderBy("__side", "__tile").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).select(*key, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    # a hashed join: a merge would sort the motifs once more
    ranked = dealt(rows, *key).join(before.hint("shuffle_hash"), key).withColumn("__place", F.row_number().over(by(*key)))
    return ranked.withColumn("motif_rank", (F.col("__place") + F.col("__before")).cast("bigint")).drop(*key, "__before", "__place", "__minus", "__along")


def _ends() -> tuple[Column, Column, Column]:
    """The greatest start on each strand, and whether a reverse motif without a start stands between them."""
    back = F.coalesce(F.col("strand") == "-", F.lit(False))
    return F.max(F.when(~back, F.col("dna_start"))), F.max(F.when(back, F.col("dna_start"))), F.max(back & F.col("dna_start").isNull())


def turns(motifs: DataFrame) -> DataFrame:
    """(contig_id, fore, back) of contigs whose last forward and first reverse motif lie near: only there do rules look across the strands."""
    fore, back, none = _ends()
    ends = motifs.groupBy("contig_id").agg(fore.alias("fore"), back.alias("back"), none.alias("none"))
    return ends.filter(f"NOT none AND abs(fore - back) <= {TURN}").drop("none")


def with_turns(motifs: DataFrame, table: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Adds fore and back. `whole`: by windows over contigs, for tables whose rows are dear to make twice and whose contigs are small."""
    if whole:
        w = Window.partitionBy("contig_id")
        fore, back, none = (c.over(w) for c in _ends())
        return motifs.withColumns({"fore": fore, "back": F.when(~none, back)})
    t = (turns(motifs) if table is None else table).withColumnRenamed("contig_id", "__contig")
    return motifs.join(F.broadcast(t), F.col("contig_id").eqNullSafe(F.col("__contig")), "left").drop("__contig")


def dedup_adjacent(motifs: DataFrame, table: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Of a run of r neighbours with equal motif and start, the 1st, 3rd, 5th ... stay: ceil(r / 2).

    A run lies within one start of one strand, but for the turn of a contig, if its last forward and its first reverse
    motif start together; so windows are over tiles, not over contigs.
    """
    rows = keyed(motifs if whole else with_turns(motifs, table))
    parts = ["contig_id"]
    if not whole:
        rows, parts = rows.withColumn("__tile", F.floor(F.col("dna_start") / TILE)), ["contig_id", "__tile"]
    rows = dealt(rows, *parts)
    w = by(*parts)
    runs = rows.withColumns({"__at": F.row_number().over(w), "__id": F.lag("motif_id").over(w), "__start": F.lag("dna_start").over(w)} | ({} if whole else {"__was": F.lag("__minus").over(w)}))
    same = (F.col("__id") == F.col("motif_id")) & (F.col("__start") == F.col("dna_start"))
    if not whole:  # in a whole contig the strands' neighbours are those at its turn
        at_turn = F.coalesce((F.col("dna_start") == F.col("fore")) & (F.col("dna_start") == F.col("back")), F.lit(False))
        same &= at_turn | F.col("__was").eqNullSafe(F.col("__minus"))
    runs = runs.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(F.col("__at")))
    runs = runs.withColumn("__run", F.max("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.filter("(__at - __run) % 2 = 0").select(*motifs.columns)


def deduped(motifs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """dedup_adjacent, and the turns of its result: found from the motifs near the raw turns alone, as dedup drops nothing else there."""
    raw = turns(motifs)
    near = with_turns(motifs, raw).filter(f"dna_start >= least(fore, back) - {TURN}").drop("fore", "back")
    return dedup_adjacent(motifs, raw), turns(dedup_adjacent(near, raw))


def dedup_exact(motifs: DataFrame) -> DataFrame:
    """The first motif of each (contig, motif, start, end)."""
    w = Window.partitionBy("contig_id", "motif_id", "dna_start", "dna_end").orderBy(*order_columns())
    return motifs.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def _spelled(words: tuple) -> Column:
    """Whether motif_id, __m1 and __m2 spell one of the words."""
    ids = [F.col("motif_id"), F.col("__m1"), F.col("__m2")]
    tests = [reduce(and_, [c == x for x, c in zip(word, ids, strict=False)]) for word in words]
    return F.coalesce(reduce(or_, tests), F.lit(False))


def signature_filter(hits: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The hits of groups whose ordered motif ids hold a signature contiguously."""
    w = Window.partitionBy(*group).orderBy(*order)
    ahead = hits.withColumns({"__m1": F.lead("motif_id", 1).over(w), "__m2": F.lead("motif_id", 2).over(w)})
    rows = ahead.withColumn("__hit", _spelled(rules.SIGNATURES).cast("int")).withColumn("__any", F.max("__hit").over(Window.partitionBy(*group)))
    return rows.filter("__any = 1").drop("__hit", "__any", "__m1", "__m2")


def mark_seeds(rows: DataFrame, w: Window, within: int, whole: bool = False) -> DataFrame:
    """Adds seed_length (and reach_lo, reach_hi: the seed's least and greatest start), given keyed rows, fore and back; the strands meet only at the turn. `whole`: w is over contigs, where only they are neighbours, and rows have no fore and back."""
    start, back = F.col("dna_start"), F.col("__back")
    lead = {f"__{name}{n}": F.lead(c, n).over(w) for name, c in (("m", "motif_id"), ("s", "dna_start"), ("b", "__back"))[: 2 if whole else 3] for n in (1, 2)}
    s1, s2, b1, b2 = (F.col(f"__{x}") for x in ("s1", "s2", "b1", "b2"))
    met = lambda s, t, b, c: F.lit(True) if whole else (b == c) | (s == F.col("fore")) & (t == F.col("back"))
    gap1 = (F.abs(s1 - start) <= within) & met(start, s1, back, b1)
    gap2 = (F.abs(s2 - s1) <= within) & met(s1, s2, b1, b2)
    pair = _spelled(tuple(s for s in rules.SEEDS if len(s) == 2)) & gap1
    triple = _spelled(tuple(s for s in rules.SEEDS if len(s) == 3)) & gap1 & gap2
    length = F.when(F.coalesce(pair, F.lit(False)), 2).when(F.coalesce(triple, F.lit(False)), 3).otherwise(0)
    third = F.when(F.col("seed_length") == 3, s2)
    last = F.when(F.col("seed_length") == 3, F.col("__m2")).when(F.col("seed_length") == 2, F.col("__m1"))
    # each lead once: a lead in each test of a word is a window function of its own
    out = rows.withColumn("__back", F.coalesce("__minus", F.lit(False))).withColumns(lead).withColumn("seed_length", length)
    return out.withColumns({"reach_lo": F.least("dna_start", s1, third), "reach_hi": F.greatest("dna_start", s1, third), "last_id": last}).drop("__back", *lead)


def seed_rows(motifs: DataFrame, within: int = 500, table: DataFrame | None = None) -> DataFrame:
    """with_seeds, and the seeds' ends. Motifs are dealt by tiles of a contig, each with those near its edges, so that the next two motifs that matter are at hand."""
    if within > TURN:
        return mark_seeds(keyed(with_turns(motifs, whole=True)), by("contig_id"), within).drop("fore", "back", "__minus", "__along")
    size, halo = max(TILE, 8 * within), 2 * within
    tile = lambda off: F.floor((F.col("dna_start") + off) / size)
    rows = keyed(with_turns(motifs, table)).withColumn("__own", tile(0)).withColumn("__tile", F.explode(F.array_distinct(F.array(tile(0), tile(-halo), tile(halo)))))
    out = mark_seeds(dealt(rows, "contig_id", "__tile"), by("contig_id", "__tile"), within)
    return out.filter("__tile <=> __own").drop("__tile", "__own", "fore", "back", "__minus", "__along")


def with_seeds(motifs: DataFrame, within: int = 500, table: DataFrame | None = None) -> DataFrame:
    """Adds seed_length: 2 or 3 where a seed begins, else 0. A walk right by steps of at most `within` stops at the first seed it spells, so a pair wins over a triple. `table`: the motifs' turns, if known."""
    return seed_rows(motifs, within, table).drop("reach_lo", "reach_hi", "last_id")
