"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window of 10 words holds 6 grams of 5 words; its fingerprint is the least gram hash. Equal windows have equal
fingerprints, so a join on fingerprints finds every shared span of 10 words or more; a document posts a fingerprint
only where it changes from one window to the next. A hit is then extended: the words around it are compared with the
words of the benchmark window, so hash collisions do no harm. An item of under 10 words is a single window whose
fingerprint is the hash of all its words, looked up among the document's runs of that many words.

Words are hashed once, grams are hashes of word hashes. A Bloom filter of the benchmark's grams (a constant of the plan,
at most MOST_LONGS 64-bit numbers) is asked first: a document without any gram of the benchmark has no window of
it, and a fingerprint that is no gram of it joins nothing. The filter has no false negatives; beyond its size it only
lets more fingerprints pass to the join. One pass over the texts writes each row's word count and posted fingerprints
to the shared folder.

Defined cases: a null or wordless text has no words, no hits; a null or wordless item never occurs, an item with a null
id is left out; repeated items or windows count once per item_id; rows sharing a doc_id are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, PROBES, UPPER, bloom, few, materialize, scratch

WINDOW, GRAM = 10, 5
GRAMS = WINDOW - GRAM + 1
#: Broadcast the benchmark's windows up to this many rows of at most 15 words and this many bytes; beyond, shuffle join.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: The Bloom filter has a 64-bit number for each gram, this many at most.
MOST_LONGS = 1 << 17


def _let(name: str, value: str, body: str) -> str:
    """Evaluate value once and bind it: the optimiser would repeat a column inside a lambda for every element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def words_sql(text: str) -> str:
    """A-Z lower-cased, then words; in a text of ASCII alone lower() does just that, many times faster."""
    low = f"CASE WHEN octet_length({text}) = char_length({text}) THEN lower({text}) ELSE translate({text}, '{UPPER}', '{LOWER}') END"
    return rf"array_remove(split({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', -1), '')"


def _hash_words(n: int, first: str = "") -> str:
    """SQL: hash of the n word hashes of h from x = h[i] on."""
    return f"xxhash64({first}{', '.join(['x', *(f'h[i + {k}]' for k in range(1, n))])})"


_GRAMS = f"CASE WHEN size(h) >= {GRAM} THEN transform(slice(h, 1, size(h) - {GRAM - 1}), (x, i) -> {_hash_words(GRAM)}) ELSE array() END"
_LEAST = f"CASE WHEN size(g) >= {GRAMS} THEN transform(slice(g, 1, size(g) - {GRAMS - 1}), (x, i) -> least({', '.join(['x', *(f'g[i + {k}]' for k in range(1, GRAMS))])})) ELSE array() END"


def _runs(m: int) -> str:
    """SQL: (at, fp) of every run of m words, for items of m < WINDOW words."""
    return f"CASE WHEN size(h) >= {m} THEN transform(slice(h, 1, size(h) - {m - 1}), (x, i) -> named_struct('at', i + 1, 'fp', {_hash_words(m, f'{m}, ')})) ELSE array() END"


def _hashed(text: str, body: str) -> str:
    return _let("w", words_sql(text), _let("h", "transform(w, x -> xxhash64(x))", body))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(m, fp, win, marks, items): distinct windows of m words with their gram hashes and the items that hold them."""
    whole = f"transform(f, (x, i) -> named_struct('m', {WINDOW}, 'fp', x, 'win', slice(w, i + 1, {WINDOW}), 'marks', slice(g, i + 1, {GRAMS})))"
    short = " ".join(f"WHEN {m} THEN transform({_runs(m)}, r -> named_struct('m', {m}, 'fp', r.fp, 'win', w, 'marks', array(r.fp)))" for m in range(1, WINDOW))
    win = _hashed(text_col, _let("g", _GRAMS, _let("f", _LEAST, f"CASE WHEN size(w) >= {WINDOW} THEN {whole} ELSE CASE size(w) {short} END END")))
    rows = benchmark.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.expr(f"explode({win})").alias("x"))
    return rows.groupBy("x.m", "x.fp", "x.win", "x.marks").agg(F.collect_set("item").alias("items"))


def _bloom(bench: DataFrame) -> tuple[str, int]:
    """(a Bloom filter of the benchmark's grams as a constant in SQL, how many numbers it has)."""
    values = bloom(bench.select(F.explode("marks").alias("g")).distinct(), "g", 1, MOST_LONGS)
    return f"cast(split('{','.join(map(str, values.tolist()))}', ',') AS array<bigint>)", len(values)


def _held(x: str, longs: int) -> str:
    tests = [f"(shiftright(b[cast(shiftrightunsigned({x}, {s + 6}) & {longs - 1} AS int)], cast(shiftright({x}, {s}) & 63 AS int)) & 1) = 1" for s in PROBES]
    return " AND ".join(tests)


def _fingerprints(short: list[int], bloom: tuple[str, int], text_col: str) -> str:
    """SQL: (n, post) of one document: its words, and (at, m, fp, ctx) of its fingerprints; ctx: the words that every window under the fingerprint lies in."""
    held = lambda x: _held(x, bloom[1])
    changed = f"i = 0 OR f[i] <> f[i - 1] OR (i >= {GRAMS} AND f[i] = f[i - {GRAMS}])"
    posted = f"transform(filter(CASE WHEN size(f) > 0 THEN sequence(0, size(f) - 1) ELSE array() END, i -> {held('f[i]')} AND ({changed})), i -> named_struct('at', i + 1, 'm', {WINDOW}, 'fp', f[i], 'ctx', slice(w, i + 1, {2 * WINDOW - GRAM})))"
    empty = f"filter(array(named_struct('at', 1, 'm', {WINDOW}, 'fp', 0L, 'ctx', w)), x -> false)"
    parts = [_let("g", _GRAMS, f"CASE WHEN exists(g, x -> {held('x')}) THEN {_let('f', _LEAST, posted)} ELSE {empty} END")]
    parts += [f"transform(filter({_runs(m)}, r -> {held('r.fp')}), r -> named_struct('at', r.at, 'm', {m}, 'fp', r.fp, 'ctx', slice(w, r.at, {m})))" for m in short]
    post = f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]
    return _let("b", bloom[0], _hashed(f"coalesce({text_col}, '')", f"named_struct('n', cast(size(w) AS bigint), 'post', {post})"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, n_words, n_hit, items (sorted array of item ids as text), th (hash of the text)."""
    bench = materialize(benchmark_windows(benchmark), "windows")
    size = bench.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.concat_ws(" ", "win")) + F.length(F.concat_ws(",", "items"))).alias("chars"), F.collect_set(F.when(F.col("m") < WINDOW, F.col("m"))).alias("short")).first()
    small = size["n"] <= BROADCAST_ROWS and (size["chars"] or 0) * 4 <= BROADCAST_BYTES
    seen = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.expr(_fingerprints(sorted(size["short"]), _bloom(bench), text_col)).alias("x"))
    seen = materialize(seen.select("id", "th", "x.n", "x.post"), "postings")
    posted = seen.filter(F.size("post") > 0).select("id", "th", F.explode("post").alias("x")).select("id", "th", "x.*")
    bench = bench.drop("marks")
    hits = posted.join(F.broadcast(bench) if small else bench, ["m", "fp"]).select(
        "id", "th", "m", "items", F.expr("transform(filter(sequence(0, size(ctx) - m), o -> slice(ctx, o + 1, m) = win), o -> at + o)").alias("starts")
    ).filter(F.size("starts") > 0)
    spans = F.expr("transform(starts, s -> named_struct('s', cast(s AS bigint), 'e', cast(s + m AS bigint)))")
    found = hits.groupBy("id", "th").agg(F.collect_set("items").alias("items"), F.collect_set(spans).alias("spans"))
    union = "aggregate(array_sort(array_distinct(flatten(spans))), named_struct('e', 0L, 'n', 0L), (a, x) -> named_struct('e', greatest(a.e, x.e), 'n', a.n + greatest(0L, x.e - greatest(a.e, x.s))), a -> a.n)"
    found = found.select(F.col("id").alias("id2"), F.col("th").alias("th2"), F.expr(union).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    out = seen.select("id", "th", F.col("n").alias("n_words")).join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")
    return out.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "th")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    with scratch() as tables:
        c = contamination(docs, benchmark).select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
        return tables.keep(materialize(c, "contamination"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark window."""
    with scratch() as tables:
        bad = contamination(docs, benchmark, id_col, text_col).filter("n_hit > 0").select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct()
        bad = few(tables.keep(materialize(bad, "contaminated")))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left_anti")


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bx AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS s FROM bx),
ms AS (SELECT DISTINCT m FROM win),
dx AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM dw, ms WHERE len(w) >= m),
hit AS (SELECT doc_id, item_id, dx.m, i FROM dx JOIN win ON dx.m = win.m AND win.s = array_to_string(dx.w[i:i + dx.m - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
