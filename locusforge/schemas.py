"""Explicit schemas of the tables between stages."""

CONTIG = "contig_idx bigint, contig_id string, description string, sequence string"
FRAGMENT = "contig_id string, frag_offset bigint, frag_len int, frag string"
PROTEIN = "contig_id string, frag_offset bigint, frag_len int, strand string, frame int, protein string"
#: protein_sequence_id names fragment and frame; position is 1-based; dna_start and dna_end are 0-based, half open.
MOTIF = "motif_id int, protein_sequence_id string, position bigint, protein_sequence string, pvalue double, score double, contig_id string, dna_start bigint, dna_end bigint, strand string, frame int, frag_offset bigint"
LOCUS_MOTIF = "struct<motif_id:int,protein_sequence:string,pvalue:double,dna_start:bigint,dna_end:bigint,strand:string>"
