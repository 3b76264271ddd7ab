"""Position weight matrices and p-value tables: text formats, dimension tables and the arrays of the scan.

`motif_<N>@<position>@<amino acid> <score>` and `motif_<N>@<score> <p>`; other lines are ignored, a bad number counts as 0
and the last line for a cell wins. Ids over 20 have no rules and are refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusforge import rules


@dataclass(frozen=True)
class Motifs:
    """What the scan needs, small enough to go with every task: scan order, widths, matrices (26 letters by position) and right-tail p-values."""

    order: tuple[int, ...]
    pwm: dict[int, np.ndarray]
    cdf: dict[int, np.ndarray]

    @property
    def max_width(self) -> int:
        return max((m.shape[1] for m in self.pwm.values()), default=0)

    def width(self, motif_id: int) -> int:
        return self.pwm[motif_id].shape[1]

    def threshold(self, motif_id: int, p: float) -> int:
        """First score with a p-value under p; the table's length if there is none."""
        under = np.flatnonzero(self.cdf[motif_id] < p)
        return int(under[0]) if len(under) else len(self.cdf[motif_id])

    def pvalue(self, motif_id: int, score: int) -> float:
        table = self.cdf[motif_id]
        return float(table[max(score, 0)]) if score < len(table) else 0.0


def lines(spark: SparkSession, path: str) -> DataFrame:
    return split_lines(spark.read.text(path, wholetext=True))


def split_lines(text: DataFrame) -> DataFrame:
    """One row (value) with the whole text -> (line_no, parts, value): the words of each line, the first cut at `@`."""
    rows = text.select(F.posexplode(F.split("value", "\r?\n", -1)).alias("line_no", "line"))
    words = F.filter(F.split("line", r"\s+", -1), lambda w: w != "")
    return rows.select("line_no", F.split(F.get(words, F.lit(0)), "@", -1).alias("parts"), F.get(words, F.lit(1)).alias("value"))


def _motif_id(parts: Column) -> Column:
    n = F.regexp_extract(F.get(parts, F.lit(0)), r"^motif_\+?(\d+)$", 1).try_cast("int")
    return F.when(n <= 255, n)


def _count(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike(r"^\+?\d+$"), text.try_cast("bigint")), F.lit(0)).cast("int")


def motif_meta(config: DataFrame) -> DataFrame:
    """(motif_id, width, scan_order): width is the greatest position plus 1, order that of first appearance."""
    rows = config.filter(F.size("parts") >= 2).select(_motif_id(F.col("parts")).alias("motif_id"), _count(F.get("parts", F.lit(1))).alias("pos"), "line_no").filter("motif_id IS NOT NULL")
    return rows.groupBy("motif_id").agg((F.max("pos") + 1).alias("width"), F.min("line_no").alias("scan_order"))


def pwm_table(config: DataFrame) -> DataFrame:
    """(motif_id, pos, aa, score)."""
    aa = F.when(F.get("parts", F.lit(2)) == "", "A").otherwise(F.substring(F.get("parts", F.lit(2)), 1, 1))
    rows = config.filter((F.size("parts") >= 3) & F.col("value").isNotNull()).select(_motif_id(F.col("parts")).alias("motif_id"), _count(F.get("parts", F.lit(1))).alias("pos"), aa.alias("aa"), F.coalesce(F.when(F.col("value").rlike(r"^[+-]?\d+$"), F.col("value").try_cast("int")), F.lit(0)).alias("score"), "line_no")
    return rows.filter("motif_id IS NOT NULL AND aa RLIKE '^[A-Z]$'").groupBy("motif_id", "pos", "aa").agg(F.max_by("score", "line_no").alias("score"))


def cdf_table(config: DataFrame) -> DataFrame:
    """(motif_id, score, pvalue) for every score from 0 to the greatest; gaps are 0."""
    rows = config.filter(F.size("parts") >= 2).select(_motif_id(F.col("parts")).alias("motif_id"), _count(F.get("parts", F.lit(1))).alias("score"), F.col("value"), "line_no").filter("motif_id IS NOT NULL")
    dense = rows.groupBy("motif_id").agg(F.max("score").alias("most")).select("motif_id", F.explode(F.sequence(F.lit(0), "most")).alias("score"))
    given = rows.filter("value IS NOT NULL").groupBy("motif_id", "score").agg(F.max_by(F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)), "line_no").alias("pvalue"))
    return dense.join(given, ["motif_id", "score"], "left").select("motif_id", "score", F.coalesce("pvalue", F.lit(0.0)).alias("pvalue"))


def score_thresholds(cdf: DataFrame, p: float) -> DataFrame:
    """(motif_id, threshold)."""
    return cdf.groupBy("motif_id").agg(F.coalesce(F.min(F.when(F.col("pvalue") < p, F.col("score"))), F.max("score") + 1).alias("threshold"))


def load(spark: SparkSession, pwm_path: str | None = None, cdf_path: str | None = None) -> Motifs:
    """Each file replaces its half of the built-in synthetic configuration. The tables are at most 20 motifs wide, so they come to the driver."""
    own = synthetic()
    order, pwm, cdf = own.order, own.pwm, own.cdf
    if pwm_path:
        config = lines(spark, pwm_path)
        meta = motif_meta(config).orderBy("scan_order").collect()
        order = tuple(r.motif_id for r in meta)
        pwm = {r.motif_id: np.zeros((26, r.width), np.int64) for r in meta}
        for r in pwm_table(config).collect():
            if r.pos < pwm[r.motif_id].shape[1]:
                pwm[r.motif_id][ord(r.aa) - 65, r.pos] = r.score
    if cdf_path:
        cdf = {}
        for r in cdf_table(lines(spark, cdf_path)).groupBy("motif_id").agg(F.array_sort(F.collect_list(F.struct("score", "pvalue"))).alias("t")).collect():
            cdf[r.motif_id] = np.array([x.pvalue for x in r.t])
    bad = [i for i in (*order, *cdf) if i not in rules.RANK]
    if bad:
        raise ValueError(f"motif ids without rules: {sorted(set(bad))}")
    # a motif without p-values has the one-entry table 0.0, so every score of 0 or more counts
    return Motifs(order, pwm, {i: cdf.get(i, np.zeros(1)) for i in order})


def load_dir(spark: SparkSession, folder: str) -> Motifs:
    """Reads mot.txt and store.txt of a folder."""
    return load(spark, f"{folder}/mot.txt", f"{folder}/store.txt")


@cache
def synthetic() -> Motifs:
    """The built-in configuration: SYNTHETIC. Meaningful annotation needs real matrices.

    10 points for each letter of the consensus, else 0. Motifs without a published consensus get one drawn from a fixed
    seed, of width 20 (motif 14: 50). P-values are exact for letters drawn evenly from 20 amino acids.
    """
    letters = "ACDEFGHIKLMNPQRSTVWY"
    r = np.random.default_rng(20)
    pwm, cdf = {}, {}
    for i in sorted(rules.RANK):
        word = rules.CONSENSUS.get(i) or "".join(letters[k] for k in r.integers(0, 20, 50 if i == 14 else 20))
        pwm[i] = np.zeros((26, len(word)), np.int64)
        pwm[i][[ord(c) - 65 for c in word], np.arange(len(word))] = 10
        hits = np.ones(1)
        for _ in word:
            hits = np.convolve(hits, [0.95, 0.05])
        tail = np.cumsum(hits[::-1])[::-1]
        cdf[i] = np.array([tail[-(-s // 10)] for s in range(10 * len(word) + 1)])
    return Motifs(tuple(sorted(rules.RANK)), pwm, cdf)


def consensus(motif_id: int) -> str:
    """The synthetic configuration's best word of a motif."""
    return "".join(chr(65 + k) for k in synthetic().pwm[motif_id].argmax(axis=0))


def as_text(motifs: Motifs) -> tuple[str, str]:
    """The two file formats, for export and tests."""
    pwm = [f"motif_{i}@{p}@{chr(65 + a)} {motifs.pwm[i][a, p]}" for i in motifs.order for p in range(motifs.width(i)) for a in range(26) if motifs.pwm[i][a, p]]
    cdf = [f"motif_{i}@{s} {float(p)!r}" for i in motifs.order for s, p in enumerate(motifs.cdf[i])]
    return "\n".join(pwm) + "\n", "\n".join(cdf) + "\n"
