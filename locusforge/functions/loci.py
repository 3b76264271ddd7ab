"""Functions of a locus, that is of an array of motif structs, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusforge import rules


def is_complete(motifs: Column) -> Column:
    """Holds a P-loop and any leucine-rich repeat motif."""
    return F.exists(motifs, lambda m: m["motif_id"] == rules.P_LOOP) & F.exists(motifs, lambda m: m["motif_id"].isin(*rules.LRR))


def has_stop(motifs: Column) -> Column:
    return F.exists(motifs, lambda m: F.contains(m["protein_sequence"], F.lit("*")))


def domain_string(motifs: Column) -> Column:
    """Categories joined by `-`, equal neighbours once; NA and LINKER are left out but do part equal neighbours."""
    kinds = F.transform(motifs, lambda m: F.coalesce(rules.lookup(rules.CATEGORY, m["motif_id"]), F.lit("NA")))
    # one pass: the accumulator is the last category and the parts so far
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("parts"))
    step = lambda a, k: F.struct(k.alias("last"), F.when(k.isin("NA", "LINKER") | (k == a["last"]), a["parts"]).otherwise(F.concat(a["parts"], F.array(k))).alias("parts"))
    return F.aggregate(kinds, start, step, lambda a: F.array_join(a["parts"], "-"))


def motif_list(motifs: Column) -> Column:
    return F.array_join(F.transform(motifs, lambda m: F.concat(F.lit("motif_"), m["motif_id"].cast("string"))), ",")


def span(motifs: Column) -> tuple[Column, Column]:
    """(start, end) over the first and the last motif only."""
    a, b = F.element_at(motifs, 1), F.element_at(motifs, -1)
    ends = [a["dna_start"], a["dna_end"], b["dna_start"], b["dna_end"]]
    return F.least(*ends), F.greatest(*ends)


def bed_colour(motifs: Column) -> Column:
    """Red with a stop codon, else green if complete, else orange."""
    return F.when(has_stop(motifs), "255,0,0").when(is_complete(motifs), "0,255,0").otherwise("255,128,0")


def blocks(motifs: Column, strand: Column, start: Column) -> tuple[Column, Column]:
    """(sizes, starts) of the BED blocks, in reverse order on the reverse strand."""
    ordered = F.when(strand == "-", F.reverse(motifs)).otherwise(motifs)
    return F.array_join(F.transform(ordered, lambda m: (m["dna_end"] - m["dna_start"]).cast("string")), ","), F.array_join(F.transform(ordered, lambda m: (m["dna_start"] - start).cast("string")), ",")


def alignment(motifs: Column) -> Column:
    """The NB-ARC row: from the first P-loop on, each expected motif or as many dashes as its consensus has letters; `*` and X become `_`; null without a P-loop."""
    at = F.array_position(F.transform(motifs, lambda m: m["motif_id"]), rules.P_LOOP).cast("int")
    expected = F.array(*[F.struct(F.lit(i).alias("id"), F.lit("-" * len(rules.CONSENSUS[i])).alias("gap")) for i in rules.NBARC_ORDER[1:]])

    def step(a: Column, x: Column) -> Column:
        here = F.get(motifs, a["idx"])
        hit = F.coalesce(here["motif_id"] == x["id"], F.lit(False))
        return F.struct(F.when(hit, a["idx"] + 1).otherwise(a["idx"]).alias("idx"), F.concat(a["sq"], F.when(hit, here["protein_sequence"]).otherwise(x["gap"])).alias("sq"))

    start = F.struct(at.alias("idx"), F.get(motifs, at - 1)["protein_sequence"].alias("sq"))
    return F.when(at > 0, F.aggregate(expected, start, step, lambda a: F.translate(a["sq"], "*X", "__")))


def format_double(d: Column) -> Column:
    """The JVM's decimal text (since version 19 the shortest that reads back equal): plain for 1e-3 <= |d| < 1e7 (`5`, not `5.0`), else `8.77E-12` and `1E-6`; zero is `0.0`."""
    text = d.cast("string")
    plain = F.regexp_replace(text, r"\.0$", "")
    science = F.regexp_replace(text, r"\.0E", "E")
    return F.when(d == 0, "0.0").when(F.isnan(d), "NaN").when(F.abs(d) == float("inf"), F.when(d < 0, "-Infinity").otherwise("Infinity")).when((F.abs(d) >= 1e-3) & (F.abs(d) < 1e7), plain).otherwise(science)
