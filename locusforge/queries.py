"""One query for each operator, over the driver's tables, with the DuckDB SQL that gives the same rows.

`documents` become contigs by a fixed mapping of letters to bases; `lineitem` rows become motif hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge import rules
from locusforge.functions import loci as fn
from locusforge.functions import sequence as seq
from locusforge.operators import assemble as asm
from locusforge.operators import fragments, motifs, scan
from locusforge.plans import outputs, report
from locusforge.plans.annotate import Params, annotate_contigs
from locusforge.schemas import CONTIG
from locusforge.sources import config
from locusforge.sources.motif_table import parse_motifs

CHOP_LENGTH, CHOP_OVERLAP, BUCKET, FLANK = 300, 150, 2000, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- data ---------------------------------------------------------------------------------------------------------


_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_TO_BASES, _NO_LETTERS = bytes.maketrans(_LETTERS, b"ACGT" * 6 + b"AC" + b"ACGT" * 6 + b"AC"), bytes(set(range(256)) - set(_LETTERS))
_OTHER_STRAND = bytes.maketrans(b"ACGT", b"TGCA")


def contigs(spark: SparkSession, sf_dir: str, tail: str = "") -> DataFrame:
    """Documents as contigs, by the mapping of sequence.text_to_dna in one pass over the bytes (Spark's translate looks up each character in a map of strings). With a tail it is added, and every second contig reverse-complemented."""
    end = tail.encode()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, out = batch.column("contig_idx"), []
            for i, text in zip(ids.to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                s = None if text is None else text.encode().translate(_TO_BASES, _NO_LETTERS) + end
                out.append(s.translate(_OTHER_STRAND)[::-1] if end and s is not None and i is not None and i % 2 == 1 else s)
            yield pa.record_batch([ids, batch.column("contig_id"), pa.array([""] * len(ids), pa.string()), pa.array(out, pa.binary()).cast(pa.string())], ["contig_idx", "contig_id", "description", "sequence"])

    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("contig_idx"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("contig_id"), "text").mapInArrow(run, CONTIG)


def back_translated(protein: str) -> str:
    codon: dict[str, str] = {}
    for c, a in rules.codon_table().items():
        codon.setdefault(a, c)
    return "".join(codon[a] for a in protein)


def cassette() -> str:
    """A locus that the built-in configuration finds: all NB-ARC motifs and two repeats."""
    return back_translated("GG".join(config.consensus(i) for i in (*rules.NBARC_ORDER, 9, 11)))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs with a cassette at the end; every second one reverse-complemented."""
    return contigs(spark, sf_dir, cassette())


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    start = F.col("l_orderkey") * 97 + F.col("l_linenumber") * 13
    p = F.when(F.col("l_linenumber") % 4 == 0, 0.0).when(F.col("l_linenumber") % 4 == 1, 1e-6).when(F.col("l_linenumber") % 4 == 2, 0.5).otherwise(8.779e-12)
    rows = x.select(
        (F.col("l_partkey") % 20 + 1).cast("int").alias("motif_id"), F.col("l_partkey").alias("position"), F.when(F.col("l_quantity") % 10 == 0, "A*C").otherwise("ACDX").alias("protein_sequence"), p.alias("pvalue"), F.lit(0.0).alias("score"),
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 7).cast("string")).alias("contig_id"), start.cast("bigint").alias("dna_start"), (start + 60).cast("bigint").alias("dna_end"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
        (F.col("l_linenumber") % 3).cast("int").alias("frame"), (F.floor(F.col("l_orderkey") / 100) * 100).cast("bigint").alias("frag_offset"),
    )
    return rows.withColumn("protein_sequence_id", F.concat("contig_id", F.lit("_"), F.col("frag_offset").cast("string"), F.lit("_frame"), "strand", F.col("frame").cast("string")))


def pseudo_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of each 2 kb window of a contig as a locus, numbered along the contig."""
    key = motifs.order_columns()
    rows = hits(spark, sf_dir).withColumn("bucket", F.floor(F.col("dna_start") / BUCKET).cast("bigint"))
    item = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)], F.struct("motif_id", "protein_sequence", "pvalue", "dna_start", "dna_end", "strand").alias("m"))
    built = rows.groupBy("contig_id", "bucket").agg(F.array_sort(F.collect_list(item)).alias("x")).withColumn("motifs", F.transform("x", lambda x: x["m"]))
    m = F.col("motifs")
    start, end = fn.span(m)
    name = F.concat("contig_id", F.lit("_nlr"), F.col("bucket").cast("string"))
    return built.select(
        name.alias("name"), "contig_id", F.col("bucket").alias("locus_no"), m[0]["strand"].alias("strand"), start.alias("start_pos"), end.alias("end_pos"), fn.domain_string(m).alias("domains"), fn.motif_list(m).alias("motif_list"),
        fn.is_complete(m).alias("is_complete"), fn.has_stop(m).alias("has_stop"), "motifs",
    )


# --- queries ------------------------------------------------------------------------------------------------------


def q_fasta_stats(spark, sf_dir):
    s = F.col("sequence")
    return contigs(spark, sf_dir).select("contig_id", F.length(s).cast("bigint").alias("bases"), (F.length(s) == 0).alias("is_empty"), F.round(seq.dna_share(s), 6).alias("dna_share"), seq.is_dna(s).alias("is_dna"))


def q_fasta_record(spark, sf_dir):
    return contigs(spark, sf_dir).select("contig_id", seq.fasta_record(F.col("contig_id"), F.concat(F.lit("n="), F.length("sequence").cast("string")), F.col("sequence")).alias("record"))


def q_chop_fragments(spark, sf_dir):
    return fragments.chop(contigs(spark, sf_dir), CHOP_LENGTH, CHOP_OVERLAP)


def q_chop_default(spark, sf_dir):
    return fragments.chop(contigs(spark, sf_dir)).select("contig_id", "frag_offset", F.col("frag_len").cast("bigint").alias("frag_len"), F.md5("frag").alias("frag_md5"))


def q_reverse_complement(spark, sf_dir):
    return contigs(spark, sf_dir).select("contig_id", seq.reverse_complement(F.col("sequence")).alias("revcomp"))


def q_translate_frames(spark, sf_dir):
    frags = contigs(spark, sf_dir).select("contig_id", F.lit(0).cast("bigint").alias("frag_offset"), F.length("sequence").alias("frag_len"), F.col("sequence").alias("frag"))
    return fragments.translate_frames(frags).select("contig_id", "strand", "frame", "protein")


def q_pwm_window_scores(spark, sf_dir):
    """How many windows of motif 4 have each score, by frame, over all contigs."""
    own = config.synthetic()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        scanner = scan.Scanner(own)
        width = own.width(4)
        for batch in batches:
            counts: dict[tuple, int] = {}
            for frag in batch.column("sequence").to_pylist():
                for strand, frame, protein in scan.six(frag.encode()):
                    n = len(protein) - width + 1
                    if n > 0:
                        text = np.append(protein, np.zeros(3 * width, np.int64))
                        triples = text[:-2] * 729 + text[1:-1] * 27 + text[2:]
                        for score, k in zip(*np.unique(scanner.scores(4, triples, n), return_counts=True), strict=True):
                            key = (strand, frame, int(score))
                            counts[key] = counts.get(key, 0) + int(k)
            rows = [(*k, v) for k, v in counts.items()]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64())))], ["strand", "frame", "score", "n"])

    return contigs(spark, sf_dir).select("sequence").mapInArrow(run, "strand string, frame int, score int, n long").groupBy("strand", "frame", "score").agg(F.sum("n").alias("n"))


def q_motif_scan(spark, sf_dir):
    return scan.scan_fragments(fragments.chop(planted(spark, sf_dir)), config.synthetic(), signature=False)


def q_signature_scan(spark, sf_dir):
    return scan.scan_fragments(fragments.chop(planted(spark, sf_dir)), config.synthetic())


def q_annotate_loci(spark, sf_dir):
    return annotate_contigs(planted(spark, sf_dir), params=Params()).loci.drop("motifs")


def q_signature_filter(spark, sf_dir):
    kept = motifs.signature_filter(hits(spark, sf_dir), ["contig_id", "strand", "frag_offset"], motifs.order_columns())
    return kept.select("contig_id", "strand", "frag_offset", "motif_id", "dna_start")


def q_map_coordinates(spark, sf_dir):
    x = hits(spark, sf_dir).withColumn("position", F.col("position") % 6000 + 1)
    a, b = fragments.dna_span(F.col("strand"), F.col("frame"), F.col("frag_offset"), F.lit(20_000), F.col("position"), F.lit(21))
    return x.select("strand", "frame", "frag_offset", "position", a.alias("mapped_start"), b.alias("mapped_end"))


def q_motif_sort_rank(spark, sf_dir):
    return motifs.rank_motifs(hits(spark, sf_dir)).select("contig_id", "motif_rank", "strand", "dna_start", "motif_id")


def q_dedup_adjacent(spark, sf_dir):
    return motifs.dedup_adjacent(hits(spark, sf_dir)).select("contig_id", "strand", "dna_start", "motif_id")


def q_dedup_exact(spark, sf_dir):
    return motifs.dedup_exact(hits(spark, sf_dir)).select("contig_id", "motif_id", "dna_start", "dna_end", "strand")


def q_find_seeds(spark, sf_dir):
    kept, table = motifs.deduped(hits(spark, sf_dir))
    return motifs.with_seeds(kept, table=table).filter("seed_length > 0").select("contig_id", "strand", "dna_start", "motif_id", "seed_length")


def q_assemble_loci(spark, sf_dir):
    kept, table = motifs.deduped(hits(spark, sf_dir))
    return asm.assemble(kept, table=table).drop("motifs")


def q_locus_domains(spark, sf_dir):
    return pseudo_loci(spark, sf_dir).select("name", "domains")


def q_locus_motif_list(spark, sf_dir):
    return pseudo_loci(spark, sf_dir).select("name", "motif_list")


def q_locus_span(spark, sf_dir):
    return pseudo_loci(spark, sf_dir).select("name", "strand", "start_pos", "end_pos")


def q_locus_flags(spark, sf_dir):
    return pseudo_loci(spark, sf_dir).select("name", "is_complete", "has_stop")


def q_report_rows(spark, sf_dir):
    return outputs.report_lines(pseudo_loci(spark, sf_dir)).select("line")


def q_gff_rows(spark, sf_dir):
    return outputs.gff_lines(pseudo_loci(spark, sf_dir)).select("line")


def q_bed12_rows(spark, sf_dir):
    return outputs.bed_lines(pseudo_loci(spark, sf_dir)).select("line")


def q_motif_bed_rows(spark, sf_dir):
    return outputs.motif_bed_lines(hits(spark, sf_dir), annotate_stop=True).select("line")


def q_motif_tsv_rows(spark, sf_dir):
    return outputs.motif_tsv_lines(hits(spark, sf_dir)).select("line")


def q_motif_import(spark, sf_dir):
    lines = outputs.motif_tsv_lines(hits(spark, sf_dir)).select(F.col("line").alias("value"))
    return parse_motifs(lines).select("motif_id", "protein_sequence_id", "position", "pvalue", "contig_id", "dna_start", "dna_end", "strand", "frame", "frag_offset")


def q_nbarc_alignment(spark, sf_dir):
    return outputs.alignment_lines(annotate_contigs(planted(spark, sf_dir)).loci).select("line")


def q_extract_loci(spark, sf_dir):
    c = contigs(spark, sf_dir)
    n = F.length("sequence").cast("bigint")
    strand = F.when(F.col("contig_idx") % 3 == 0, "-").otherwise("+")
    loci = c.filter("length(sequence) > 0").select(F.concat("contig_id", F.lit("_nlr1")).alias("name"), "contig_id", F.lit(1).cast("bigint").alias("locus_no"), strand.alias("strand"), F.lit("motif_1").alias("motif_list"), F.floor(n / 4).alias("start_pos"), F.floor(n / 2).alias("end_pos"))
    return outputs.locus_sequences(loci, c, FLANK).select("name", "header", "sequence")


def q_stats_global(spark, sf_dir):
    return report.global_counts(hits(spark, sf_dir), pseudo_loci(spark, sf_dir))


def q_stats_contig(spark, sf_dir):
    return report.contig_counts(hits(spark, sf_dir), pseudo_loci(spark, sf_dir).filter("contig_id <> 'chr3'"))


def q_stats_motif(spark, sf_dir):
    return report.motif_counts(hits(spark, sf_dir))


def q_stats_lines(spark, sf_dir):
    return report.stats_lines(hits(spark, sf_dir), pseudo_loci(spark, sf_dir))


def q_motif_rules(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("motif_id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(rules.motif_rules(spark)), "motif_id").select("motif_id", "n", "rank", "category", "rgb")


def _config(spark, which):
    return config.split_lines(spark.createDataFrame([(config.as_text(config.synthetic())[which],)], "value string"))


def q_config_widths(spark, sf_dir):
    return config.motif_meta(_config(spark, 0)).select("motif_id", "width")


def q_config_pwm(spark, sf_dir):
    return config.pwm_table(_config(spark, 0))


def q_config_thresholds(spark, sf_dir):
    return config.score_thresholds(config.cdf_table(_config(spark, 1)), rules.CANDIDATE_P)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

# --- SQL ----------------------------------------------------------------------------------------------------------

_DNA = "translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')"
_CONTIGS = f"contigs AS (SELECT doc_id AS contig_idx, 'doc' || CAST(doc_id AS VARCHAR) AS contig_id, {_DNA} AS sequence FROM documents)"
_HITS = """hits AS (SELECT *, contig_id || '_' || CAST(frag_offset AS VARCHAR) || '_frame' || strand || CAST(frame AS VARCHAR) AS protein_sequence_id FROM (
SELECT CAST(l_partkey % 20 + 1 AS INTEGER) AS motif_id, l_partkey AS position, CASE WHEN l_quantity % 10 = 0 THEN 'A*C' ELSE 'ACDX' END AS protein_sequence,
 CASE l_linenumber % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1e-6 WHEN 2 THEN 0.5 ELSE 8.779e-12 END AS pvalue,
 CASE l_linenumber % 4 WHEN 0 THEN '0.0' WHEN 1 THEN '1E-6' WHEN 2 THEN '0.5' ELSE '8.779E-12' END AS ptext, 'chr' || CAST(l_suppkey % 7 AS VARCHAR) AS contig_id,
 CAST(l_orderkey * 97 + l_linenumber * 13 AS BIGINT) AS dna_start, CAST(l_orderkey * 97 + l_linenumber * 13 + 60 AS BIGINT) AS dna_end,
 CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, CAST(l_linenumber % 3 AS INTEGER) AS frame, CAST(l_orderkey // 100 * 100 AS BIGINT) AS frag_offset FROM lineitem))"""
_ORDER = "strand = '-', CASE WHEN strand = '-' THEN -dna_start ELSE dna_start END, frag_offset, frame, motif_id, protein_sequence, pvalue"
_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {rules.RANK[i]}, '{rules.CATEGORY[i]}', '{rules.COLOUR[i]}')" for i in rules.RANK) + ") AS t(motif_id, rank, category, rgb))"
_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY {_ORDER}) AS rn FROM hits)"
_DEDUP = f"""{_RANKED}, marked AS (SELECT *, CASE WHEN lag(motif_id) OVER w = motif_id AND lag(dna_start) OVER w = dna_start THEN 0 ELSE 1 END AS fresh FROM ranked WINDOW w AS (PARTITION BY contig_id ORDER BY rn)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY contig_id ORDER BY rn) AS run FROM marked),
deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contig_id, run ORDER BY rn) AS k FROM runs) WHERE k % 2 = 1)"""
_LOCI = f"""numbered AS (SELECT h.*, category, dna_start // {BUCKET} AS bucket, row_number() OVER (PARTITION BY contig_id, dna_start // {BUCKET} ORDER BY {_ORDER}) AS i, count(*) OVER (PARTITION BY contig_id, dna_start // {BUCKET}) AS n FROM hits h JOIN rules USING (motif_id)),
spans AS (SELECT *, lag(category) OVER (PARTITION BY contig_id, bucket ORDER BY i) AS was FROM numbered),
loci AS (SELECT contig_id || '_nlr' || CAST(bucket AS VARCHAR) AS name, contig_id, bucket AS locus_no, max(strand) FILTER (WHERE i = 1) AS strand,
 min(dna_start) FILTER (WHERE i IN (1, n)) AS start_pos, max(dna_end) FILTER (WHERE i IN (1, n)) AS end_pos,
 coalesce(string_agg(category, '-' ORDER BY i) FILTER (WHERE category NOT IN ('NA', 'LINKER') AND (was IS NULL OR was <> category)), '') AS domains,
 string_agg('motif_' || CAST(motif_id AS VARCHAR), ',' ORDER BY i) AS motif_list, bool_or(motif_id = 1) AND bool_or(motif_id IN (9, 11, 19)) AS is_complete, bool_or(contains(protein_sequence, '*')) AS has_stop,
 count(*) AS n, list(dna_end - dna_start ORDER BY i) AS sizes, list(dna_start ORDER BY i) AS starts FROM spans GROUP BY contig_id, bucket)"""


def _spells(words: tuple) -> str:
    tests = []
    for w in words:
        parts = [f"motif_id = {w[0]}", f"id1 = {w[1]}"] + ([f"id2 = {w[2]}"] if len(w) == 3 else [])
        tests.append("(" + " AND ".join(parts) + ")")
    return "coalesce(" + " OR ".join(tests) + ", FALSE)"


def _seed_sql() -> str:
    pair, triple = _spells(tuple(s for s in rules.SEEDS if len(s) == 2)), _spells(tuple(s for s in rules.SEEDS if len(s) == 3))
    return f"""WITH {_HITS}, {_DEDUP}, led AS (SELECT *, lead(motif_id, 1) OVER w AS id1, lead(motif_id, 2) OVER w AS id2, lead(dna_start, 1) OVER w AS s1, lead(dna_start, 2) OVER w AS s2 FROM deduped WINDOW w AS (PARTITION BY contig_id ORDER BY {_ORDER}))
SELECT * FROM (SELECT contig_id, strand, dna_start, motif_id, CASE WHEN {pair} AND abs(s1 - dna_start) <= 500 THEN 2 WHEN {triple} AND abs(s1 - dna_start) <= 500 AND abs(s2 - s1) <= 500 THEN 3 ELSE 0 END AS seed_length FROM led) WHERE seed_length > 0"""


def _frames_sql() -> str:
    codons = ", ".join(f"('{c}', '{a}')" for c, a in rules.codon_table().items())
    return f"""codons AS (SELECT * FROM (VALUES {codons}) AS t(codon, aa)),
strands AS (SELECT contig_id, '+' AS strand, sequence AS dna FROM contigs UNION ALL SELECT contig_id, '-', translate(reverse(sequence), 'ATGCatgc', 'TACGtacg') FROM contigs),
framed AS (SELECT contig_id, strand, CAST(f AS INTEGER) AS frame, regexp_extract_all(substr(dna, f + 1), '...') AS triplets FROM strands, (SELECT unnest(range(3)) AS f)),
cut AS (SELECT contig_id, strand, frame, unnest(triplets) AS codon, generate_subscripts(triplets, 1) AS i FROM framed),
acids AS (SELECT contig_id, strand, frame, i, aa FROM cut JOIN codons USING (codon))"""


_c = config.synthetic()
_widths = ", ".join(f"({i}, {_c.width(i)})" for i in _c.order)
_letters = ", ".join(f"({i}, {p}, '{ch}', 10)" for i in _c.order for p, ch in enumerate(config.consensus(i)))
_thresholds = ", ".join(f"({i}, {_c.threshold(i, rules.CANDIDATE_P)})" for i in _c.order)
_tail = "contig_id || chr(9) || dna_start || chr(9) || dna_end || chr(9)"

ORACLES: dict[str, str] = {
    "fasta_stats": f"WITH {_CONTIGS} SELECT contig_id, length(sequence) AS bases, length(sequence) = 0 AS is_empty, CASE WHEN length(sequence) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dna_share, length(sequence) > 0 AS is_dna FROM contigs",
    "fasta_record": f"WITH {_CONTIGS} SELECT contig_id, '>' || contig_id || ' n=' || length(sequence) || chr(10) || sequence || chr(10) AS record FROM contigs",
    "chop_fragments": f"WITH {_CONTIGS}, k AS (SELECT *, unnest(range(0, 1 + CASE WHEN length(sequence) > {CHOP_LENGTH} THEN CAST(ceil((length(sequence) - {CHOP_LENGTH}) / {CHOP_LENGTH - CHOP_OVERLAP}.0) AS BIGINT) ELSE 0 END)) AS k FROM contigs WHERE length(sequence) > 0) SELECT contig_id, k * {CHOP_LENGTH - CHOP_OVERLAP} AS frag_offset, CAST(length(substr(sequence, k * {CHOP_LENGTH - CHOP_OVERLAP} + 1, {CHOP_LENGTH})) AS INTEGER) AS frag_len, substr(sequence, k * {CHOP_LENGTH - CHOP_OVERLAP} + 1, {CHOP_LENGTH}) AS frag FROM k",
    "chop_default": f"WITH {_CONTIGS}, k AS (SELECT *, unnest(range(0, 1 + CASE WHEN length(sequence) > 20000 THEN CAST(ceil((length(sequence) - 20000) / 15000.0) AS BIGINT) ELSE 0 END)) AS k FROM contigs WHERE length(sequence) > 0) SELECT contig_id, k * 15000 AS frag_offset, length(substr(sequence, k * 15000 + 1, 20000)) AS frag_len, md5(substr(sequence, k * 15000 + 1, 20000)) AS frag_md5 FROM k",
    "reverse_complement": f"WITH {_CONTIGS} SELECT contig_id, translate(reverse(sequence), 'ATGCatgc', 'TACGtacg') AS revcomp FROM contigs",
    "translate_frames": f"WITH {_CONTIGS}, {_frames_sql()}, words AS (SELECT contig_id, strand, frame, string_agg(aa, '' ORDER BY i) AS protein FROM acids GROUP BY ALL) SELECT contig_id, strand, frame, coalesce(protein, '') AS protein FROM framed LEFT JOIN words USING (contig_id, strand, frame)",
    "pwm_window_scores": f"WITH {_CONTIGS}, {_frames_sql()}, windows AS (SELECT strand, frame, lead(aa, 14) OVER w AS last, {' + '.join(f"CASE WHEN lead(aa, {j}) OVER w = '{c}' THEN 10 ELSE 0 END" for j, c in enumerate(rules.CONSENSUS[4]))} AS score FROM acids WINDOW w AS (PARTITION BY contig_id, strand, frame ORDER BY i)) SELECT strand, frame, CAST(score AS INTEGER) AS score, count(*) AS n FROM windows WHERE last IS NOT NULL GROUP BY ALL",
    "signature_filter": f"WITH {_HITS}, led AS (SELECT *, lead(motif_id, 1) OVER w AS id1, lead(motif_id, 2) OVER w AS id2 FROM hits WINDOW w AS (PARTITION BY contig_id, strand, frag_offset ORDER BY {_ORDER})), kept AS (SELECT *, bool_or({_spells(rules.SIGNATURES)}) OVER (PARTITION BY contig_id, strand, frag_offset) AS ok FROM led) SELECT contig_id, strand, frag_offset, motif_id, dna_start FROM kept WHERE ok",
    "map_coordinates": f"WITH {_HITS}, m AS (SELECT strand, frame, frag_offset, position % 6000 + 1 AS position FROM hits), a AS (SELECT *, CASE WHEN strand = '-' THEN frag_offset + 20000 - frame - 3 * (position - 1) - 63 ELSE frag_offset + frame + 3 * (position - 1) END AS mapped_start FROM m) SELECT strand, frame, frag_offset, position, mapped_start, mapped_start + 63 AS mapped_end FROM a",
    "motif_sort_rank": f"WITH {_HITS}, {_RANKED} SELECT contig_id, rn AS motif_rank, strand, dna_start, motif_id FROM ranked",
    "dedup_adjacent": f"WITH {_HITS}, {_DEDUP} SELECT contig_id, strand, dna_start, motif_id FROM deduped",
    "dedup_exact": f"WITH {_HITS} SELECT contig_id, motif_id, dna_start, dna_end, strand FROM (SELECT *, row_number() OVER (PARTITION BY contig_id, motif_id, dna_start, dna_end ORDER BY {_ORDER}) AS n FROM hits) WHERE n = 1",
    "find_seeds": _seed_sql(),
    "locus_domains": f"WITH {_HITS}, {_RULES}, {_LOCI} SELECT name, domains FROM loci",
    "locus_motif_list": f"WITH {_HITS}, {_RULES}, {_LOCI} SELECT name, motif_list FROM loci",
    "locus_span": f"WITH {_HITS}, {_RULES}, {_LOCI} SELECT name, strand, start_pos, end_pos FROM loci",
    "locus_flags": f"WITH {_HITS}, {_RULES}, {_LOCI} SELECT name, is_complete, has_stop FROM loci",
    "report_rows": f"WITH {_HITS}, {_RULES}, {_LOCI} SELECT concat_ws(chr(9), contig_id, name, domains, start_pos, end_pos, strand, motif_list) AS line FROM loci",
    "gff_rows": f"WITH {_HITS}, {_RULES}, {_LOCI} SELECT concat_ws(chr(9), contig_id, '{outputs.LABEL}', 'NBSLRR', start_pos + 1, end_pos, '.', strand, '.', 'name=' || name || ';nlrClass=' || domains) AS line FROM loci",
    "bed12_rows": f"WITH {_HITS}, {_RULES}, {_LOCI} SELECT concat_ws(chr(9), contig_id, start_pos, end_pos, name, 0, strand, start_pos, end_pos, CASE WHEN has_stop THEN '255,0,0' WHEN is_complete THEN '0,255,0' ELSE '255,128,0' END, n, array_to_string(CASE WHEN strand = '-' THEN list_reverse(sizes) ELSE sizes END, ','), array_to_string(list_transform(CASE WHEN strand = '-' THEN list_reverse(starts) ELSE starts END, lambda x: x - start_pos), ',')) AS line FROM loci",
    "motif_bed_rows": f"WITH {_HITS}, {_RULES} SELECT concat_ws(chr(9), contig_id, dna_start, dna_end, 'motif_' || motif_id, ptext, strand, dna_start, dna_end, rgb) AS line FROM hits JOIN rules USING (motif_id) UNION ALL SELECT concat_ws(chr(9), contig_id, dna_start, dna_end, 'STOP', 0, strand, dna_start, dna_end, '0,0,0') FROM hits WHERE contains(protein_sequence, '*')",
    "motif_tsv_rows": f"WITH {_HITS} SELECT concat_ws(chr(9), 'motif_' || motif_id, protein_sequence_id, position, protein_sequence, ptext, '0.0', contig_id, dna_start, dna_end, strand, frame) AS line FROM hits",
    "motif_import": f"WITH {_HITS} SELECT motif_id, protein_sequence_id, position, pvalue, contig_id, dna_start, dna_end, strand, frame, frag_offset FROM hits",
    "extract_loci": f"WITH {_CONTIGS}, l AS (SELECT *, greatest(length(sequence) // 4 - {FLANK}, 0) AS s, least(length(sequence) // 2 + {FLANK}, length(sequence)) AS e, CASE WHEN contig_idx % 3 = 0 THEN '-' ELSE '+' END AS strand FROM contigs WHERE length(sequence) > 0), x AS (SELECT *, substr(sequence, s + 1, e - s) AS piece FROM l WHERE s < e) SELECT contig_id || '_nlr1' AS name, '>' || contig_id || '_nlr1 ' || contig_id || ' ' || s || '-' || e || ' strand:' || strand || ' motif_1' AS header, CASE WHEN strand = '-' THEN translate(reverse(piece), 'ATGC', 'TACG') ELSE piece END AS sequence FROM x",
    "stats_global": f"WITH {_HITS}, {_RULES}, {_LOCI} SELECT (SELECT count(DISTINCT contig_id) FROM hits) AS sequences, (SELECT count(*) FROM hits) AS motifs, count(*) AS loci, count(*) FILTER (WHERE is_complete) AS complete FROM loci",
    "stats_contig": f"WITH {_HITS}, {_RULES}, {_LOCI}, a AS (SELECT contig_id, count(*) AS motifs FROM hits GROUP BY 1), b AS (SELECT contig_id, count(*) AS loci, count(*) FILTER (WHERE is_complete) AS complete FROM loci WHERE contig_id <> 'chr3' GROUP BY 1) SELECT contig_id, motifs, coalesce(loci, 0) AS loci, coalesce(complete, 0) AS complete FROM a LEFT JOIN b USING (contig_id)",
    "stats_motif": f"WITH {_HITS} SELECT motif_id, count(*) AS n FROM hits GROUP BY 1",
    "stats_lines": f"WITH {_HITS}, {_RULES}, {_LOCI}, a AS (SELECT contig_id, count(*) AS motifs FROM hits GROUP BY 1), b AS (SELECT contig_id, count(*) AS loci, count(*) FILTER (WHERE is_complete) AS complete FROM loci GROUP BY 1), c AS (SELECT contig_id, motifs, coalesce(loci, 0) AS loci, coalesce(complete, 0) AS complete FROM a LEFT JOIN b USING (contig_id)) SELECT concat_ws(chr(9), 'global', 'sequence_count', count(*)) AS line FROM c UNION ALL SELECT concat_ws(chr(9), 'global', 'motif_total', CAST(sum(motifs) AS BIGINT)) FROM c UNION ALL SELECT concat_ws(chr(9), 'global', 'nlr_total', CAST(sum(loci) AS BIGINT)) FROM c UNION ALL SELECT concat_ws(chr(9), 'global', 'nlr_complete', CAST(sum(complete) AS BIGINT)) FROM c UNION ALL SELECT concat_ws(chr(9), 'chromosome', contig_id, motifs, loci, complete) FROM c UNION ALL SELECT concat_ws(chr(9), 'motif', 'motif_' || motif_id, count(*)) FROM hits GROUP BY motif_id",
    "motif_rules": f"WITH {_HITS}, {_RULES} SELECT motif_id, count(*) AS n, rank, category, rgb FROM hits JOIN rules USING (motif_id) GROUP BY ALL",
    "config_widths": f"SELECT * FROM (VALUES {_widths}) AS t(motif_id, width)",
    "config_pwm": f"SELECT * FROM (VALUES {_letters}) AS t(motif_id, pos, aa, score)",
    "config_thresholds": f"SELECT * FROM (VALUES {_thresholds}) AS t(motif_id, threshold)",
}
