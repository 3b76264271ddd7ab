"""Every operator on small tables with known results, and on awkward ones."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from locusforge.llm import bpe, components, decontaminate, language_id, line_dedup, near_dedup, neighbours, quality, queries, repeats, sstable, toxicity
from tests.llm.conftest import DOC

SMALL = "/root/testdata/sf0.001"
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = [None, "", " ", "\n\n", "one", "ONE", "it's a <|endoftext|> é中 ½", "x " * 30_000, "same text " * 20, "same text " * 20, "\x00\x1c"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def prose(r, n):
    return " ".join(r.choice("abcdefghijkl") + str(r.randrange(4000)) for _ in range(n))


def near_truth(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "new" + str(r.randrange(10**6))
    return " ".join(w)


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)] + [(500, 500), (7, 7)] + [(1000 + r.randrange(80), 1000 + r.randrange(80)) for _ in range(60)]
    got = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    sets = {}
    for a, b in edges:
        if a != b:
            merged = sets.get(a, {a}) | sets.get(b, {b})
            for x in merged:
                sets[x] = merged
    groups = defaultdict(set)
    for row in got:
        groups[row.comp].add(row.node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, {frozenset(s) for s in sets.values()}))
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_near_dedup_against_brute_force(spark, docs, rows, monkeypatch):
    r = random.Random(6)
    texts = [prose(r, r.randrange(1, 120)) for _ in range(60)]
    base = prose(r, 90)
    texts += [edited(r, base, r.randrange(0, 6)) for _ in range(150)]  # a large group of near copies
    shared = prose(r, 40)
    texts += [shared + " " + prose(r, 60) for _ in range(40)] + [texts[3]] * 30 + ["a b", "A  b", "a b c", "", None, " "]
    texts += [edited(r, texts[i], 1) for i in range(60)]
    pairs = list(enumerate(texts))
    r.shuffle(pairs)
    truth = near_truth(pairs)
    got = rows(near_dedup.digest(docs(pairs)))
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == truth
    assert all(x.kept == (i == x.component_id) for i, x in got.items())
    monkeypatch.setattr(near_dedup, "REGION", 4)  # regions are cut at every depth: candidates thin out, links stay true
    got = rows(near_dedup.digest(docs(pairs)))
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == truth


def test_near_dedup_awkward(spark, docs, rows):
    table = docs([*enumerate(AWKWARD), (None, "same text " * 20), (8, "same text " * 20)], extra=True)
    got = near_dedup.digest(table).collect()
    assert len(got) == len(AWKWARD) + 2
    by = {x.doc_id: x for x in got}
    assert by[9].component_id == 8 and by[5].component_id == 4 and by[0].n_shingles == 0 and by[None].kept and by[None].component_id is None
    assert near_dedup.drop_near_duplicates(table).columns == table.columns
    assert near_dedup.digest(table.limit(0)).count() == 0


def test_rows_that_share_an_id(spark, docs):
    a, b, c = (prose(random.Random(i), 40) for i in range(3))
    kept = near_dedup.drop_near_duplicates(docs([(1, a), (2, a), (2, b), (3, c), (3, c)])).collect()
    assert sorted((x.doc_id, x.text) for x in kept) == sorted([(1, a), (2, b), (3, c), (3, c)])
    passage = prose(random.Random(9), 70)
    table = docs([(1, "x y. " + passage + " z"), (2, b), (2, "q " + passage + " " + b), (3, c), (3, c)])
    cut = repeats.remove_repeats(table).collect()
    assert len(cut) == 5 and {x.text for x in cut if x.doc_id in (1, 3)} == {"x y. " + passage + " z", c}
    texts = [x.text for x in cut if x.doc_id == 2]
    assert b in texts and sum(t.endswith(b) and len(t) < len(b) + 30 * len(passage) // 70 for t in texts) == 2


def test_glued_passages(spark, docs, rows):
    """Passages of 51 to 60 words in hosts with and without sentences, against the longest shared span by brute force; and spans too short to be a passage."""
    r = random.Random(21)
    sentences = lambda n: " ".join(prose(r, r.randrange(5, 20)).capitalize() + "." for _ in range(n))
    texts = []
    for k in range(60):
        if k % 3 < 2:
            passage = prose(r, r.randrange(51, 61)) if k % 2 else " ".join(prose(r, 17) + "." for _ in range(3)) + " " + prose(r, 3)
        else:
            passage = prose(r, r.randrange(26, 46))
        texts += [prose(r, r.randrange(30)) + " " + passage + " " + sentences(3), sentences(2) + " " + prose(r, 20) + " " + passage + " " + prose(r, 9)]
    got = rows(repeats.digest(docs(texts)))
    assert {i for i, x in got.items() if x.n_repeated} == {i for i in range(len(texts)) if i // 2 % 3 < 2}
    assert all(got[i].component_id == i // 2 * 2 and (i % 2 == 0 or got[i].repeats_of == [i - 1]) for i in range(len(texts)) if got[i].n_repeated)


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def leak_truth(texts, items):
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(item))
    out = {}
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for m in {len(k) for k in windows}:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in windows:
                    hit.update(range(j, j + m))
                    found |= windows[tuple(w[j : j + m])]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))))
    return out


@pytest.mark.parametrize("limit", [100_000, 0])  # broadcast, and the shuffle join beyond it
def test_decontamination(spark, docs, rows, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    r = random.Random(2)
    items = [(i, prose(r, n)) for i, n in enumerate([30, 25, 10, 11, 9, 3, 1, 60])] + [(20, ""), (21, None), (22, "!!"), (23, "ha " * 15), (24, None)]
    items += [(30, items[0][1]), (31, items[5][1].upper())]
    texts = [None, "", "!!", "ha " * 40, "a ha " * 20, prose(r, 50)]
    for _ in range(80):
        own = words(r.choice(items)[1] or "")
        a = r.randrange(len(own) + 1)
        texts.append(" ".join([*words(prose(r, r.randrange(30))), *own[a : a + r.randrange(40)], *words(prose(r, r.randrange(30)))]).title())
    texts += [t for _, t in items]
    pairs = list(enumerate(texts))
    bench = spark.createDataFrame([*items, (None, items[7][1] + " q")], "item_id bigint, text string")
    got = rows(decontaminate.digest(docs(pairs), bench))
    assert {i: (x.n_words, x.n_hit, x.n_items, x.items_sha256) for i, x in got.items()} == leak_truth(pairs, items)
    assert all(x.contaminated == (x.n_hit > 0) for x in got.values())
    table = docs([*pairs, (None, items[0][1]), (0, items[0][1])], extra=True)
    clean = decontaminate.drop_contaminated(table, bench)
    assert clean.columns == table.columns and clean.count() == sum(not x.contaminated for x in got.values())
    assert decontaminate.digest(table.limit(0), bench).count() == 0
    assert decontaminate.digest(docs(texts), bench.limit(0)).filter("contaminated").count() == 0


def test_line_dedup(spark, docs, rows):
    texts = ["first line here\nshared line one\nx", " SHARED line ONE \nshort\nshort", "shared line one\nshared line one\nown line text", None, "", "\n", "shared line on", "été été été\n\r\nété été été "]
    got = rows(line_dedup.digest(docs(texts)))
    kept = ["first line here\nshared line one\nx", "short\nshort", "own line text", "", "", "\n", "shared line on", "été été été\n\r\nété été été "]
    assert {i: (x.n_lines, x.n_dropped, x.kept_sha256) for i, x in got.items()} == {i: (len((t or "").split("\n")), len((t or "").split("\n")) - (len(k.split("\n")) if k or not t else 0), sha(k)) for i, (t, k) in enumerate(zip(texts, kept, strict=True))}
    table = docs([*enumerate(AWKWARD), (None, "same text " * 20), (8, "same text " * 20)], extra=True)
    assert line_dedup.line_dedup(table).count() == len(AWKWARD) + 2
    assert line_dedup.digest(table.limit(0)).count() == 0


def test_hot_lines(spark, docs, rows, monkeypatch):
    """Lines over the bound go by broadcast, the rest by the join: the same rows either way; rows that share an id are cut by their own text."""
    monkeypatch.setattr(line_dedup, "HOT_LINES", 5)
    common = "a very common line"
    texts = [f"{common}\nown line number {i}\nshared by pairs {i // 2}\n{common.upper()}" for i in range(40)]
    got = rows(line_dedup.line_dedup(docs([*enumerate(texts), (7, "rare line of seven\nown line number 3")])), "text")
    assert sum(t.lower().count(common) for t in got) == 2 and sum("shared by pairs" in t for t in got) == 20
    assert got["rare line of seven"].n_dropped == 1 and len(got) == 41


def test_paragraph_dedup(spark, docs, rows):
    r = random.Random(9)
    passage = ". ".join(prose(r, 14).capitalize() for _ in range(4)) + "."
    flat = prose(r, 160)  # a passage without sentence ends
    long = " ".join(prose(r, 30).split())
    near = edited(random.Random(1), long + ". " + prose(r, 30), 0)
    own = [". ".join(prose(r, 12).capitalize() for _ in range(5)) + "." for _ in range(12)]
    texts = [own[0] + " " + passage + " " + own[1], own[2], own[3] + " " + passage, "z " + flat + " q", flat, own[4] + "\n" + near, own[5] + "\n" + near.replace(long.split()[0], "changed", 1), own[6], own[7], None, ""]
    got = rows(repeats.digest(docs(texts)))
    assert {i for i, x in got.items() if x.n_repeated} == {0, 2, 3, 4, 5, 6}
    assert {i for i, x in got.items() if not x.kept} == {2, 4, 6}
    assert got[2].component_id == 0 and got[2].repeats_of == [0] and got[4].component_id == 3 and got[6].component_id == 5 and got[7].component_id == 7
    cut = rows(repeats.remove_repeats(docs(texts)))
    assert cut[2].text.strip() == own[3] and cut[1].text == texts[1] and cut[0].text == texts[0] and cut[9].text is None
    table = docs([*enumerate(AWKWARD), (None, passage), (8, "same text " * 20)], extra=True)
    assert repeats.digest(table).count() == len(AWKWARD) + 2 and repeats.digest(table.limit(0)).count() == 0


def test_neighbours(spark, rows):
    r = np.random.default_rng(3)
    v = r.normal(size=(700, 16))
    v[10] = v[20] = 3 * v[30]
    table = [(i, [float(x) for x in row], 1) for i, row in enumerate(v)] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1050, [1.0] * 15, 0), (1004, [None] * 16, 0), (50, [float(x) for x in v[50]], 1), (1100, [1e-300] * 16, 0)]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS v", "3 AS score")
    got = defaultdict(list)
    for x in neighbours.digest(df).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    assert set(got) == {*range(0, 700, 50), 1100} and all([g[0] for g in x] == [1, 2, 3, 4, 5] for x in got.values())
    ids, all_v = np.append(np.arange(700), 1100), np.vstack([v, np.ones(16)])
    u = all_v / np.linalg.norm(all_v, axis=1, keepdims=True)
    found = 0
    for q, got_q in got.items():
        s = u @ u[list(ids).index(q)]
        best = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        found += len({g[1] for g in got_q} & set(best))
        assert all(abs(g[2] - s[list(ids).index(g[1])]) < 1e-12 for g in got_q)
    assert found >= 0.9 * 5 * len(got)
    odd = spark.createDataFrame([(50, [1.0, 2.0]), (100, [float(x) for x in v[100]])], "vec_id bigint, embedding array<double>")
    assert {x.query_id for x in neighbours.search(df, odd, 3).collect()} == {100}  # a query of another length takes no part
    few = neighbours.digest(df.filter("vec_id < 3")).collect()
    assert [(x.query_id, x["rank"]) for x in few] == [(0, 1), (0, 2)]
    assert neighbours.digest(df.limit(0)).count() == 0 and neighbours.digest(df.filter("vec_id = 50")).count() == 0


def test_neighbours_recall_on_many_blocks(spark, monkeypatch):
    """Uniform vectors, the hardest case, a third of them one and the same: recall against brute force at 0.9."""
    monkeypatch.setattr(neighbours, "BLOCK", 4000)
    monkeypatch.setattr(neighbours, "GROUP", 2)
    r = np.random.default_rng(5)
    v = r.normal(size=(24_000, 64))
    v[::3] = v[0]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for x in neighbours.search(df, df.filter("vec_id % 100 = 1"), 5).collect():
        got[x.query_id].append(x.vec_id)
    found = 0
    for q in range(1, 24_000, 100):
        s = u @ u[q]
        s[q] = -2
        found += len({*got[q]} & {*np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5].tolist()})
    assert found >= 0.9 * 5 * 240


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts with a bad word or marks in some, in two languages."""
    r = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        lang = "aa" if i % 2 else "bb"
        w = ["".join(r.choice("aeiou" if lang == "aa" else "bcdfg") + r.choice("xyz") for _ in range(3)) for _ in range(r.randrange(8, 60))]
        toxic, good = int(i % 5 == 1), int(i % 4 != 2)
        if toxic:
            w[r.randrange(len(w))] = "nastyword"
        rows.append((i, "### ".join(w) if not good else " ".join(w), lang, "s", 1))
        labels.append((i, good, toxic))
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("op,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(labelled, docs, rows, op, label):
    table, labels = labelled
    truth = {r.doc_id: r[label] for r in labels.collect()}
    got = rows(op.digest(table, labels))
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, x in got.items() if x.held_out} == set(held)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= op.ACCEPT) for x in got.values())
    # held-out labels have no say
    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))
    assert {i: x.score for i, x in rows(op.digest(table, flipped)).items()} == {i: x.score for i, x in got.items()}
    model = op.fit(table, labels)
    awkward = docs([*AWKWARD, "nastyword"], extra=True)
    name = op.score_quality if op is quality else op.score_toxicity
    assert name(awkward, model).count() == len(AWKWARD) + 1
    assert rows(op.digest(docs(AWKWARD), labels.limit(0)))[0].score == 0.5
    assert op.digest(table.limit(0), labels).count() == 0


def test_quality_is_a_function_of_the_text():
    """Against a direct convolution; and a score doesn't depend on what stands beside the text."""
    net, r = quality.Net(), np.random.default_rng(1)
    blobs = [bytes(r.integers(1, 256, n, np.uint8)) for n in (0, 1, 7, 8, 504, 505, 510, 511, 512, 513, 1024, 1030, 40_000)]
    for blob, logit in zip(blobs, net.logits(blobs), strict=True):
        total, chunks = 0.0, max(1, -(-len(blob) // quality.CHUNK))
        padded = blob + bytes(chunks * quality.CHUNK + quality.WIDTH - len(blob))
        for c in range(chunks):
            windows = np.stack([net.vectors[list(padded[i : i + quality.WIDTH])].ravel() for i in range(c * quality.CHUNK, (c + 1) * quality.CHUNK)])
            pooled = np.maximum((windows.astype(float) @ net.kernel.astype(float)).max(0) + net.shift, 0)
            total += np.maximum(pooled @ net.inner + net.inner_shift, 0) @ net.weights + net.base[0]
        assert abs(total / chunks - logit) < 1e-4
    alone = [float(net.logits([b])[0]) for b in blobs]
    for _ in range(5):
        order = r.permutation(len(blobs) * 2) % len(blobs)
        assert net.logits([blobs[i] for i in order]).tolist() == [alone[i] for i in order]


def test_toxicity_by_plain_python(labelled):
    """The learned score from n-grams cut by Python, one by one."""
    table, labels = labelled
    model = toxicity.fit(table, labels)
    weights = dict(zip(model.at.tolist(), model.weights.tolist(), strict=True))
    texts = ["", "x", "a nastyword. here", "Été à l'école NASTYWORD", "中文 字 ok", *(r.text for r in table.limit(20).collect())]
    for text in texts:
        low = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in text)
        low = " " + re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", low).strip(" ") + " " if re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "", low) else " "
        found = set()
        for n in toxicity.SIZES:
            for i in range(len(low) - n + 1):
                h = 0
                for c in low[i : i + n]:
                    h = (h * toxicity._ROLL + ord(c)) % 2**64
                h = int(toxicity.ta.mix(np.array([(h + n * toxicity._SPREAD) % 2**64], np.uint64))[0])
                found.add(h >> 64 - toxicity.BITS)
        assert abs(model.base + sum(weights.get(s, 0.0) for s in found) - model.logits([text.encode()])[0]) < 1e-9


def test_language_by_plain_compression(labelled, docs, rows):
    """Every score from sizes that the library gives for a text's pieces, dictionary by dictionary."""
    import zstandard

    table, _ = labelled
    model = language_id.fit(table)
    assert all(0 < len(d) <= language_id.SAMPLE_BYTES for d in model.dictionaries.values())
    texts = ["axexix oxuyax", "bxcydz fxg", "x", "Mixed axe bxc" * 900, *(r.text for r in table.limit(10).collect())]
    got = rows(language_id.identify(docs(texts), model))
    for i, text in enumerate(texts):
        data = language_id.plain(text)
        sizes = {}
        for name, d in model.dictionaries.items():
            pack = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sizes[name] = sum(len(pack.compress(data[k : k + language_id.PIECE])) for k in range(0, len(data), language_id.PIECE))
        first, second = sorted(sizes, key=lambda n: (sizes[n], n))[:2]
        assert got[i].lang_near == first and got[i].score == 1 - sizes[first] / sizes[second] and got[i].rejected == (got[i].score < language_id.MARGIN)


def test_quality_sees_the_end_of_a_text(labelled, docs, rows):
    table, labels = labelled
    model = quality.fit(table, labels)
    clean = " ".join(["aeiouz"] * 2000)
    got = rows(quality.score_quality(docs([clean, clean + "### " + "### ".join(["aeiouz"] * 4000)]), model))
    assert got[1].score < got[0].score


def test_language_id(labelled, docs, rows):
    table, _ = labelled
    got = rows(language_id.digest(table))
    assert {i for i, x in got.items() if x.held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([x.lang_pred == ("aa" if i % 2 else "bb") for i, x in got.items() if x.held_out]) > 0.93  # a third of the texts are cut up by marks
    model = language_id.fit(table)
    out = rows(language_id.identify(docs([*AWKWARD, "123 !!", "axexix oxuyax"], extra=True), model))
    assert [out[i].lang_near for i in (0, 1, 2, 3, len(AWKWARD))] == ["und"] * 5
    assert rows(language_id.digest(docs(AWKWARD).withColumn("lang", F.lit(None).cast("string"))))[4].lang_pred == "und"
    assert language_id.digest(table.limit(0)).count() == 0


def test_sorted_string_table(spark, docs, rows, tmp_path):
    library = Tokenizer.from_file(BYTE_BPE)
    r = random.Random(1)
    pairs = [*enumerate(AWKWARD), *((100 + i, prose(r, r.randrange(50))) for i in range(300)), (-5, "minus"), (None, "no key"), (8, "other")]
    r.shuffle(pairs)
    got = sstable.digest(docs(pairs, extra=True), BYTE_BPE).collect()
    want, at = [], 0
    enc = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    keyed = sorted([(i, t) for i, t in pairs if i is not None], key=lambda x: x[0])
    assert len(got) == len(keyed) and sorted(x.doc_id for x in got) == [i for i, _ in keyed]
    order = sorted(got, key=lambda x: x.start)
    assert [x.doc_id for x in order] == [i for i, _ in keyed]
    for x in order:
        assert x.start == at
        at += x.n_tokens
        want = [enc(t) for i, t in keyed if i == x.doc_id]
        assert (x.n_tokens, x.ids_crc32) in [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want]
    path = str(tmp_path / "shards")
    sstable.write(docs(pairs), sstable.load(BYTE_BPE), path)
    assert {x.doc_id: x.ids for x in sstable.lookup(spark, path, [-5, 6, 424242]).collect()} == {-5: enc("minus"), 6: enc(AWKWARD[6])}
    assert sstable.digest(docs(["a"]).limit(0), BYTE_BPE).count() == 0


def test_shards_are_split(docs, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 512)
    monkeypatch.setattr(sstable, "SHARD_BLOCKS", 3)
    r = random.Random(2)
    got = sorted(sstable.digest(docs([prose(r, 60) for _ in range(200)]), BYTE_BPE).collect(), key=lambda x: x.doc_id)
    assert [x.start for x in got] == [0, *np.cumsum([x.n_tokens for x in got])[:-1].tolist()]


def test_bpe(docs, rows):
    library = Tokenizer.from_file(WORD_BPE)
    got = rows(bpe.digest(docs(AWKWARD, extra=True), WORD_BPE))
    for i, t in enumerate(AWKWARD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    full = rows(bpe.encode(docs(AWKWARD), bpe.load(WORD_BPE)))
    assert full[6].ids == library.encode(AWKWARD[6], add_special_tokens=False).ids
    assert bpe.digest(docs(["a"]).limit(0), WORD_BPE).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, ((*(r[c] for c in names),) for r in df.collect()))) == sorted(map(repr, map(tuple, cur.fetchall())))


def docs_with_extras(spark, rows):
    pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], DOC)
    return df.selectExpr("*", "1 AS score", "2 AS ids", "'z' AS line", "3 AS component_id", "4 AS th")


def test_pipeline(spark):
    """Each stage against what brute force makes of its predecessor."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, held = table, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL)
        docs = docs.cache()
        held[name] = before, docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == table.columns
    as_pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    a, b = held["quality classifier"]
    assert {r.doc_id for r in b.collect()} == {r.doc_id for r in quality.digest(a, spark.read.parquet(f"{SMALL}/labels.parquet")).filter("score >= 0.3").collect()}
    a, b = held["line dedup"]
    assert a.count() == b.count() and {r.doc_id: sha(r.text) for r in b.collect()} == {r.doc_id: r.kept_sha256 for r in line_dedup.digest(a).collect()}
    assert all(r.n_chars == len(r.text) for r in b.collect())
    a, b = held["MinHash near-dedup"]
    assert {i for i, _ in as_pairs(b)} == {i for i, (_, c) in near_truth(as_pairs(a)).items() if i == c}
    a, b = held["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert {i for i, _ in as_pairs(b)} == {i for i, x in leak_truth(as_pairs(a), items).items() if not x[1]}
    r = random.Random(3)
    leak, near = items[0][1], prose(r, 60)
    awkward = docs_with_extras(spark, [None, "", " \n", leak, near, edited(r, near, 1), "x " * 20_000, (4, near), (4, "other text"), (None, near), (None, None)])
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, awkward, SMALL)
        assert stage(spark, awkward.limit(0), SMALL).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == awkward.columns
        after.collect()
    ids = lambda name: [r.doc_id for r in dict(corpus_pipeline.STAGES)[name](spark, awkward, SMALL).collect()]
    assert sorted(ids("MinHash near-dedup"), key=str) == sorted([0, 1, 2, 3, 4, 4, 4, 6, None, None], key=str)
    assert 3 not in ids("benchmark decontamination") and len(ids("line dedup")) == 11 and len(ids("BPE encoding and decoding")) == 11
    last = held["BPE encoding and decoding"][1]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, last.collect()))
