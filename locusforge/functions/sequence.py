"""Sequence functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusforge.rules import codon_table


def text_to_dna(text: Column) -> Column:
    """A fixed mapping of any text to bases: its ASCII letters in order, A -> A, B -> C, C -> G, D -> T, E -> A and so on."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")


def reverse_complement(s: Column) -> Column:
    """ATGC and atgc are complemented, other characters kept."""
    return F.translate(F.reverse(s), "ATGCatgc", "TACGtacg")


def translate_codon(codon: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in codon_table().items() for x in kv])
    return F.coalesce(F.element_at(table, codon), F.lit("X"))


def translate_dna(dna: Column) -> Column:
    """Amino acids of the whole codons; a codon with another base than A, C, G, T is X. One pass over the string."""
    return F.array_join(F.transform(F.regexp_extract_all(dna, F.lit(r"[\s\S]{3}"), F.lit(0)), translate_codon), "")


def six_frames(dna: Column) -> Column:
    """array<struct<strand, frame, protein>> in the order +0 +1 +2 -0 -1 -2."""
    other = reverse_complement(dna)
    one = lambda s, strand, f: F.struct(F.lit(strand).alias("strand"), F.lit(f).alias("frame"), translate_dna(F.substring(s, f + 1, 2_147_483_647)).alias("protein"))
    return F.array(*[one(dna, "+", f) for f in range(3)], *[one(other, "-", f) for f in range(3)])


def dna_share(s: Column) -> Column:
    """Share of ACGTN, in either case, among the first 500 characters; 0 for an empty string."""
    head = F.substring(s, 1, 500)
    return F.when(F.length(head) > 0, F.length(F.regexp_replace(head, "[^ACGTNacgtn]", "")) / F.length(head)).otherwise(0.0)


def is_dna(s: Column) -> Column:
    return dna_share(s) > 0.5


def fasta_record(name: Column, description: Column, sequence: Column) -> Column:
    """One record with the sequence on a single line."""
    head = F.when(F.coalesce(description, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" "), description))
    return F.concat(F.lit(">"), head, F.lit("\n"), sequence, F.lit("\n"))


def wrapped(sequence: Column, width: int = 100) -> Column:
    """Lines of at most `width` characters, each with its newline."""
    return F.regexp_replace(sequence, f"(.{{1,{width}}})", "$1\n")


def fragment_of(protein_id: Column) -> tuple[Column, Column]:
    """(contig id, offset) from `{contig}_{offset}_frame...`: split at the last underscore; a bad number is 0."""
    name = F.regexp_replace(protein_id, r"_frame[+-]?\d*$", "")
    offset = F.regexp_extract(name, r"_(\d+)$", 1)
    return F.regexp_replace(name, r"_[^_]*$", ""), F.when(offset == "", F.lit(0)).otherwise(offset.try_cast("bigint")).cast("bigint")


def frame_of(protein_id: Column) -> tuple[Column, Column]:
    """(strand, frame) after the last `_frame`; + and 0 by default."""
    tail = F.regexp_extract(protein_id, r"_frame([+-]\d)$", 1)
    return F.when(F.substring(tail, 1, 1) == "-", "-").otherwise("+"), F.coalesce(F.substring(tail, 2, 1).try_cast("int"), F.lit(0))
