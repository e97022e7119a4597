"""Each operator against brute force, on fixtures with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns of clashing names."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivulet.llm import chat, common, embedding_dedup, licenses, lm_score, mixing, neardup, packing, quality, sharding, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIR = "/root/testdata/sf0.001"


def prose(rng, n, vocab=400):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % vocab)


def odd_texts(seed=0, n=60):
    rng = np.random.default_rng(seed)
    base = [prose(rng, int(rng.integers(60, 200)), 5000) for _ in range(n)]
    out = list(base)
    for t in base[:10]:
        out.append(t)  # exact copies
        w = t.split()
        w[len(w) // 2] = "changed"
        out.append("  " + "\n".join([" ".join(w[:20]), " ".join(w[20:])]))
    out += [None, "", " \n\t ", "one", "one", "a b c", "x " * 3000, prose(rng, 9000, 3000), "tie\ntie\n tie \n\n", "<|endoftext|> <|im_end|> É İx\x1cy\x85z"]
    return out


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s0", "s0"][i % 4], len(t or ""), i, i, "x", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, key long, component_id string, score double")


@pytest.mark.parametrize("few", [200_000, 3])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (12, 9)]
    out = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in out.collect()} == {2: 1, 3: 1, 4: 1, 5: 1, 9: 8, 12: 8}
    path = common.connected_components(spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b"))
    assert {r.component for r in path.collect()} == {0}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 24))
    x[300:340] = x[:40] + 0.05 * rng.standard_normal((40, 24))  # near
    x[340:380] = x[7]  # copies
    x[380:] = 3 * x[380:] / 7
    x[399] = 2 * x[3]
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)]
    rows += [(500, None, 1, 2), (501, [0.0] * 24, 1, 2), (502, [float("nan")] + [1.0] * 23, 1, 2), (503, [None] + [1.0] * 23, 1, 2), (504, [1.0], 1, 2), (505, [float("inf")] + [1.0] * 23, 1, 2), (506, [], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int, rep int")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df.unionByName(df.where("vec_id = 340"))).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    comp = np.arange(len(x))
    for _ in range(len(x)):
        low = np.array([comp[n].min() for n in near])
        if (low == comp).all():
            break
        comp = low
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, comp[i], comp[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(500, 507))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
    assert embedding_dedup.near_vectors(df.where("vec_id = 1")).count() == 1


def test_embedding_recall_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    a, n = rng.standard_normal((2, 600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    b = 0.951 * a + math.sqrt(1 - 0.951**2) * n
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_vectors(df).where("n_links = 0").count() <= 0.004 * 1200


def test_embeddings_of_several_lengths(spark):
    """Vectors link within their length, however rare it is; rows without an id link with nothing."""
    rng = np.random.default_rng(3)
    x = [rng.standard_normal(d) for d in (3,) * 200 + (8,) * 2500 + (1,) * 5]
    x += [1.001 * x[i] for i in range(0, 2700, 90)] + [np.array([1.0, 0.0]), np.array([2.0, 0.0]), np.array([1.0, 0.01])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist())] * 3, "vec_id long, embedding array<double>")
    got = embedding_dedup.near_vectors(df).collect()
    want = Counter()
    for d in (1, 2, 3, 8):
        ids = [i for i, v in enumerate(x) if len(v) == d]
        u = np.array([x[i] / np.linalg.norm(x[i]) for i in ids])
        want.update(dict(zip(ids, ((u @ u.T >= 0.95).sum(axis=1) - 1).tolist(), strict=True)))
    links = {r.vec_id: r.n_links for r in got if r.vec_id is not None}
    assert all(links[i] == n for i, n in want.items() if len(x[i]) != 8) and all(links[i] <= n for i, n in want.items())
    assert sum(links.values()) >= 0.998 * sum(want.values())  # those of eight go through the index
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)] * 3


def scan_by_all_windows(m, text):
    """(licence, dice) in order, by the Dice of every window of the words with every template."""
    words = licenses.normalise(licenses._HOLDER.sub("", text))
    windows = []
    for i, grams in enumerate(m.grams):
        own = Counter(dict(zip(grams, m.caps[i].tolist(), strict=True)))
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                part = words[a:b]
                if all(any(part[k : k + len(n)] == n for k in range(len(part))) for n in m.names[i]):
                    d = licenses.dice(licenses.bigrams(part), own)
                    if d >= m.t - 1e-12:
                        windows.append((i, sum((licenses.bigrams(part) & own).values()), round(d, 9), a, b))
    found, todo = [], [(0, len(words))]
    while todo:
        lo, hi = todo.pop()
        best = {}
        for i, n, d, a, b in windows:  # of each template the highest Dice, then the earliest and shortest
            if lo <= a and b <= hi and (i not in best or (-d, a, b) < best[i][0]):
                best[i] = ((-d, a, b), n)
        if best:
            i = min(best, key=lambda i: (-best[i][1], best[i][0][0], m.license[i], i))
            _, a, b = best[i][0]
            found.append((a, m.license[i], -best[i][0][0]))
            todo += [(lo, a), (b, hi)]
    return [x[1:] for x in sorted(found)]


def test_license_windows_against_all_windows():
    """Damaged, wrapped and embedded notices and texts, by every window of every text."""
    rng = np.random.default_rng(4)
    known = [t for t in licenses.notices() if t.license in ("MIT", "GPL-2.0", "GPL-3.0", "CC-BY-NC-4.0")][::5] + [licenses.Template("Short", "one two three one two four five one two six seven")]
    m = licenses.Matcher(known, licenses.THRESHOLD)
    matched = 0
    for _ in range(50):
        words = []
        for _ in range(int(rng.integers(1, 4))):
            own = known[int(rng.integers(0, len(known)))].text.split()[:40]
            for _ in range(int(rng.integers(0, 4))):
                own.insert(int(rng.integers(0, len(own))), "other") if rng.random() < 0.5 else own.pop(int(rng.integers(0, len(own))))
            words += ["pad"] * int(rng.integers(0, 4)) + own
        text = "".join(w + ("\n// " if rng.random() < 0.2 else " ") for w in words)
        got = [(x[0], round(x[1], 9)) for x in m.scan(text)]
        matched += len(got)
        assert got == scan_by_all_windows(m, text)
    assert matched > 30


def test_licenses(spark, docs, texts):
    whole = {t.license: t.text for t in licenses.templates() if not t.names}
    mit, bsd2, bsd3 = whole["MIT"], whole["BSD-2-Clause"], whole["BSD-3-Clause"].replace("<year> <owner>", "2020 A. Person")
    wrap = lambda t, n: "\n".join(" * " + " ".join(w) for w in [t.split()[i : i + n] for i in range(0, len(t.split()), n)])
    gpl = next(t.text for t in licenses.notices() if t.license == "GPL-3.0" and t.text.startswith("This program"))
    code = "\nint main(void) {\n  return call(other, things) + many(more, words);\n}\n" * 4
    odd = {
        1: "Prose first.\nReleased under the MIT License.\nmore",
        2: "© Someone\n\n" + mit.upper().replace("PUBLISH, ", "") + "\n\nand then other words\n  licensed under CC BY-NC  4.0 \n\n",
        3: wrap(bsd3, 9), 4: wrap(bsd2, 7),
        5: "This work is licensed under the GNU General Public License, version 3.\nSPDX-License-Identifier: BSD-3-Clause",
        6: None, 7: "", 8: "\n\n", 9: "license " * 500,
        10: wrap(gpl, 10) + code,  # no blank line between the notice and the code
        11: " ".join(["word"] * 30) + " which is released under the MIT License by its author, " + " ".join(["word"] * 30),
        12: "This work is licensed under the Someone Else License.\nSPDX-License-Identifier: Unknown",
        13: whole["GPL-3.0"] + "\n\n" + whole["Apache-2.0"], 14: whole["LGPL-2.1"], 15: whole["MPL-2.0"] + code, 16: wrap(whole["Unlicense"], 11),
        17: "Licensed under the Apache License, Version 2.0.\nlicence free prose about a license of the poet",
        18: "Released under the\nMIT License, and licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    }
    df = spark.createDataFrame(list(odd.items()), "doc_id long, text string").withColumn("matches", F.lit("x"))
    got = {r.doc_id: [m.license for m in r.matches] for r in licenses.scan_licenses(df.unionByName(df)).collect()}
    assert got == {
        1: ["MIT"], 2: ["MIT", "CC-BY-NC-4.0"], 3: ["BSD-3-Clause"], 4: ["BSD-2-Clause"], 5: ["GPL-3.0", "BSD-3-Clause"], 6: [], 7: [], 8: [], 9: [],
        10: ["GPL-3.0"], 11: ["MIT"], 12: [], 13: ["GPL-3.0", "Apache-2.0"], 14: ["LGPL-2.1"], 15: ["MPL-2.0"], 16: ["Unlicense"], 17: ["Apache-2.0"], 18: ["MIT", "CC-BY-SA-4.0"],
    }
    lines = {r.doc_id: [(m.first_line, m.last_line) for m in r.matches] for r in licenses.scan_licenses(df).collect()}
    assert lines[1] == [(1, 1)] and lines[5] == [(0, 0), (1, 1)] and lines[10] == [(0, 4)] and lines[18][0] == (0, 1)
    assert all(not r.matches for r in licenses.scan_licenses(docs).collect()) and licenses.scan_licenses(docs.limit(0)).count() == 0


def test_token_counts(spark, docs, texts, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = f"file://{tmp_path}/cache"
    for part in (docs.where("doc_id < 30"), docs, docs):  # cold, partly warm, warm
        got = {r.doc_id: r for r in tokens.count_tokens(part, path, cache).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    stored = spark.read.option("recursiveFileLookup", "true").parquet(cache)
    assert stored.count() == len({t or "" for t in texts}) == stored.select("digest").distinct().count()
    word = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.tokenizer_digest(path) != tokens.tokenizer_digest(word)
    assert tokens.count_tokens(docs, word, cache).count() == len(texts)  # another vocabulary shares no entry
    assert tokens.count_tokens(docs.limit(0), path, cache).count() == 0


def shingle_components(texts, limit=0.8):
    sets = {i: neardup.shingles((t or "").encode().split()) for i, t in texts.items()}
    where = defaultdict(set)
    for i, s in sets.items():
        for e in s.tolist():
            where[e].add(i)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in {(i, j) for v in where.values() for i in v for j in v if i < j}:
        if neardup.similarity(sets[i], sets[j]) >= limit:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_near_duplicates(spark, docs, texts):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    want = shingle_components(dict(enumerate(texts)))
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    twice = docs.where("doc_id < 3")
    assert neardup.near_duplicates(twice.unionByName(twice)).count() == 6
    unnamed = neardup.near_duplicates(docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))).where("doc_id IS NULL").collect()
    assert len(unnamed) == len(texts) // 2 and all(r.kept and r.component_id is None for r in unnamed)


def test_several_texts_under_one_id(spark):
    """Of the texts of an id that of the smallest digest of its words is compared; blank ones never stand for it."""
    rng = np.random.default_rng(2)
    a, b, c = (" ".join(f"v{int(x)}" for x in rng.integers(0, 10**6, 120)) for _ in range(3))
    near = lambda t: t.replace(t.split()[60], "other")
    low, high = sorted((a, b), key=lambda t: hashlib.md5(t.encode()).digest())
    rows = [(1, high), (1, low), (1, " "), (1, None), (2, near(low)), (3, near(high)), (4, c), (5, c + " \n"), (6, None), (6, ""), (7, high)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows[::-1], "doc_id long, text string")):
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
        assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 1}


def test_a_large_family_of_near_copies(spark):
    """Copies with more and more edits: most pairs are under the threshold, chains join them."""
    rng = np.random.default_rng(5)
    base = [f"v{int(x)}" for x in rng.integers(0, 10**6, 120)]
    texts = {}
    for i in range(150):
        w = list(base)
        for p in rng.choice(120, size=i % 12, replace=False):
            w[p] = f"n{i}x{p}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == shingle_components(texts)


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    est, true = [], []
    for _ in range(40):
        ids = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        b = rng.integers(1, 4, 300) * 0.7  # real weights
        a = b.copy()
        a[:40], b[40:60] = 0, b[40:60] * 2
        on = a > 0
        x, y = neardup.dart_minhash([(ids[on], a[on]), (ids, b)])
        est.append(np.mean(x == y))
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(est) - np.mean(true)) < 4 * math.sqrt(0.15 / (40 * neardup.COORDS))


def test_chats(spark):
    bad = ["a\nb", "\\n", "\\\\n\n", "<|im_end|>", "<\\|im_start|>x", "<", "<\\", "|", "<\\\\|", "\n<|", "", "\\", "<\\n|", "<|\n|", "assistant", "é𝒳"]
    rows = [(i * 100 + j, t, bad[(i * 3 + t) % len(bad)], bad[(i + t * j) % len(bad)]) for i in range(len(bad)) for j in range(len(bad)) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("n", F.lit("x"))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    want = defaultdict(list)
    for c, _, r, x in rows:
        want[c].append((r, x))
    for c, turns in want.items():
        assert [(x.role, x.text) for x in got[c].turns] == turns
    nulls = spark.createDataFrame([(None, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_chats(nulls).collect()}
    assert [t.text for t in out[1].turns] == ["", "b", "b"] and len(out[None].turns) == 1
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_templates(spark):
    """Other marks work; marks that escaping would not protect are refused."""
    for bad in (("[INST]", "<|e|>"), ("<|s|>", "</s>"), ("<|s\n|>", "<|e|>"), ("<|a|>", "<|a|>b")):
        with pytest.raises(ValueError):
            chat.Template(*bad)
    t = chat.Template("<|turn|>", "<|over|>", "model")
    rows = [(1, 0, "user", "<|over|> <|turn|>model\nx"), (1, 1, "model", "<|im_end|>"), (2, 0, "model", "plain")]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t).collect()}
    assert [(x.role, x.text) for x in out[1].turns] == [r[2:] for r in rows[:2]] and out[2].formatted == "<|turn|>model\nplain<|over|>\n"


def test_chat_mask_reads_back_assistant_text(spark):
    turns = [(1, 0, "user", "<|im_end|>"), (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 2, "assistant", "é<\\|"), (2, 0, "assistant", "plain")]
    out = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    loss = {r[0]: r[1] for r in out.select("conv_id", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert loss == {1: "<|im_end|><|im_start|>assistant oké<\\|", 2: "plain"}


def test_shards(spark, docs, texts):
    for n in (24, 3, 1):
        rows = sharding.assign_shards(docs, n).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
        by = defaultdict(list)
        for r in rows:
            t = (texts[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "bytes", None)
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values())
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_shard_sizes_with_a_hot_group(spark):
    rng = np.random.default_rng(4)
    texts = [prose(rng, 30) + str(i) for i in range(4000)] + ["the same text " * 10] * 2000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.assign_shards(df, 24).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r["size"]
    mean = sum(size.values()) / 24
    assert len(size) == 24 and max(abs(s - mean) for s in size.values()) < 0.05 * mean
    copies = sharding.assign_shards(spark.createDataFrame([(i, f"t{i // 4}" * 40) for i in range(4000)], "doc_id long, text string"), 8)
    assert copies.groupBy(F.expr("doc_id div 4")).agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_groups_that_fit_a_shard_stay_whole(spark):
    """Groups of up to nine tenths of a shard, rows without ids, repeated rows; only a group larger than a shard is split."""
    rng = np.random.default_rng(6)
    unit = [prose(rng, 8) + f" {i}" for i in range(3000)]
    groups = ["a" * 90] * 800 + ["b" * 90] * 500 + ["c" * 90] * 300 + ["d" * 90] * 4000
    rows = [(i, t) for i, t in enumerate(unit + groups)] + [(None, "e" * 90)] * 4000 + [(7, "f" * 90)] * 40
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("x")), 12).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32(t.encode())) for i, t in rows)
    shards, size, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        shards[r.text_crc32].add(r.shard)
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert {c for c, s in shards.items() if len(s) > 1} == {zlib.crc32(x * 90) for x in (b"d", b"e")}
    assert len(size) == 12 and max(size.values()) - min(size.values()) < 0.1 * sum(size.values()) / 12
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_write_shards(spark, docs, texts, tmp_path):
    sharding.write_shards(docs, sharding.assign_shards(docs, 3), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert {(r.doc_id, r.text, r.shard) for r in back} == {(r.doc_id, texts[r.doc_id], r.shard) for r in sharding.assign_shards(docs, 3).collect()}


def text_stats(t):
    w = WORD.findall(t or "")
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_statistics(spark, docs, texts):
    labels = spark.createDataFrame([(1, None, 0), (2, 1, 0), (2, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    for i, t in enumerate(texts):
        q = out[i]["__q"]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == text_stats(t)
        assert out[i]["__kept"] == (not q.base_failed)  # too few labels to certify a cutoff
    assert quality.filter_quality(docs, labels).columns == docs.columns
    assert quality.judge(docs.limit(0), labels).count() == 0 and quality.judge(docs, labels.limit(0)).count() == len(texts)


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.02), (40, 2000, 0.02), (0, 20000, 0.05), (7, 7, 0.3)]
    for k, n, p in cases:
        got = math.exp(spark.createDataFrame([(k, n)], "k long, n long").select(quality.binomial_tail(F.col("k"), F.col("n"), p)).first()[0])
        assert math.isclose(got, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-8, abs_tol=1e-300)


def test_cutoffs_are_certified(spark):
    """Every setting along the fixed paths against exact bounds; the choice among the certified ones."""
    rng = np.random.default_rng(8)
    a, b = quality.Rule("a", "x", (0.1, 0.3, 0.6)), quality.Rule("b", "y", (1.0, 2.0))
    rows = [("en", True, float(v), 0.0) for v in rng.random(900) * 0.35] + [("en", False, float(v), 0.0) for v in 0.2 + rng.random(100)] + [("en", False, 0.0, 3.0)] * 9
    rows += [("de", True, 0.0, 0.0)] * 400 + [("de", True, 0.0, 3.0)] * 60 + [("de", False, 0.5, 0.0)] * 30
    rows += [("fr", True, 0.0, 0.0)] * 20 + [("fr", False, 9.0, 9.0)] * 20
    risk = quality.Risk(alpha=0.05, delta=0.05, rules=(a, b))
    got = {r.stratum: r.cutoffs for r in quality.cutoffs(spark.createDataFrame(rows, "stratum string, good boolean, x double, y double"), risk).collect()}
    want = {}
    for lang in ("en", "de"):  # 20 labels certify nothing, so two strata share delta
        mine = [r for r in rows if r[0] == lang]
        n, best = sum(r[1] for r in mine), []
        for p, (share, path) in enumerate(risk.paths()):
            for i, s in enumerate(path):
                hit = [r for r in mine if r[2] > s.get("a", 9e9) or r[3] > s.get("b", 9e9)]
                k = sum(r[1] for r in hit)
                if sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(0.05) + (n - j) * math.log(0.95)) for j in range(k + 1)) > share * 0.05 / 2:
                    break
                if len(hit) > k:
                    best.append((len(hit) - 2 * k, -k, -p, -i, s))
        want[lang] = max(best)[-1]
    assert got == want == {"en": {"a": 0.3, "b": 1.0}, "de": {"a": 0.3}} or got == want


def test_copies_and_odd_labels_are_no_trials(spark):
    """A text held by many rows and ids is one trial; labels other than 0 and 1 are none."""
    rng = np.random.default_rng(1)
    words = lambda: " ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, 80))
    good, junk = [words() for _ in range(330)], [words() + " " + " ".join(f"#{k}" for k in range(60)) for _ in range(20)]
    docs = [(i, t, "en") for i, t in enumerate(good + junk)]
    labels = [(i, int(i < 330)) for i in range(350)]
    judged = lambda d, x: {(r.doc_id, r["__kept"]) for r in quality.judge(spark.createDataFrame(d, "doc_id long, text string, lang string"), spark.createDataFrame(x, "doc_id long, quality int")).collect()}
    assert judged(docs, labels) == {(i, i < 330) for i in range(350)}
    few = docs[:100] + docs[330:]  # too few, however often they are repeated
    copies = few * 4 + [(1000 + i, t, x) for i, t, x in few]
    assert judged(copies, labels + [(1000 + i, q) for i, q in labels]) == {(i, True) for i, _, _ in copies}
    assert judged(docs, [(i, 2 if q else None) for i, q in labels] + [(i, -1) for i, _ in labels]) == {(i, True) for i in range(350)}


def con_with(tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    return con


def test_mixing_against_sql(spark, docs):
    got = {r.doc_id: r for r in mixing.plan_mix(docs).collect()}
    con = con_with({"documents": pa.Table.from_pandas(docs.select("doc_id", "text", "source").toPandas())})
    cur = con.execute(mixing.ORACLE)
    cols = [c[0] for c in cur.description]
    rows = cur.fetchall()
    assert len(rows) == len(got)
    for row in rows:
        r = got[row[0]]
        assert [r[c] for c in cols] == list(row)
        assert r.taken <= 2 * r["size"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {i: r.taken for i, r in got.items() if r.taken} == dict(words)
    assert mixing.plan_mix(docs.limit(0)).count() == 0


def brute_mix(rows, seed="mix-1", block=64):
    """(doc_id, text) of the mix of (doc_id, source, text) rows with distinct ids: seats one by one, blocks word by word."""
    parts = {i: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t or "") for i, _, t in rows}
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(parts[i]) for i, x, _ in rows if x == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, stopped = 1.5 * sum(size.values()), set()
    while True:
        rest = [s for s in names if s not in stopped]
        level = (total - sum(2.0 * size[s] for s in stopped)) / max(1, sum(weight[s] for s in rest))
        more = {s for s in rest if level * weight[s] >= 2.0 * size[s]}
        if not more:
            break
        stopped |= more
    target = {s: 2.0 * size[s] if s in stopped else level * weight[s] for s in names}
    seats = dict.fromkeys(names, 0)
    for _ in range(int(total / block + 0.5)):
        seats[max((s for s in names if target[s] > 0), key=lambda s: (target[s] / (2 * seats[s] + 1), -names.index(s)))] += 1
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    out = []
    for s in names:
        mine = sorted((md5(f"{seed}|{i}|{md5(t or '')}"), i, t) for i, x, t in rows if x == s)
        blocks = max(1, -(-size[s] // block))
        shift = int(md5(f"{seed}/{s or ''}")[:15], 16) % blocks
        quota, place = min(seats[s], 2 * blocks), 0
        for _, i, t in mine:
            n = len(parts[i])
            for k in range(2):
                took = [(t_ + shift) % blocks for t_ in range(k * blocks, min(quota, (k + 1) * blocks))]
                # the run up to the end of the source, and what wraps round to its start
                for run in ({b for b in took if b >= shift}, {b for b in took if b < shift}):
                    words = [j for j in range(n) if (place + j) // block in run]
                    if words:
                        out.append((i, t if len(words) == n else "".join(parts[i][words[0] : words[-1] + 1])))
            place += n
    return out


def test_mixing_spreads_copies_of_one_row(spark, monkeypatch):
    """Rows without ids and rows repeated very often: all are there, none is taken more than twice, reruns agree."""
    monkeypatch.setattr(mixing, "HOT", 50)
    rows = [(None, f"text {i} of a row without an id", "s") for i in range(300)] + [(7, "the same row " * 5, "s")] * 400 + [(8, "other", None)] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(map(repr, mixing.plan_mix(d).collect())) for d in (df.repartition(3), df.repartition(5)))
    assert a == b and len(a) == len(rows)
    plan = mixing.plan_mix(df).collect()
    assert all(r.taken <= 2 * r["size"] for r in plan) and abs(sum(r.taken for r in plan) - 1.5 * sum(r["size"] for r in plan)) <= 128


def test_apportionment(spark):
    rng = np.random.default_rng(6)
    t = [float(x) for x in rng.integers(0, 10_000, 9)] + [0.0]
    houses = [0, 1, 4, 17, 100, 1234]
    got = {(r.srank, r.house): r.seats for r in mixing.apportion(spark.createDataFrame(list(enumerate(t)), "srank int, target double"), houses).collect()}
    for h in houses:
        seats = [0] * len(t)
        for _ in range(h):
            best = max(range(len(t)), key=lambda i: (t[i] / (2 * seats[i] + 1), -i))
            seats[best] += 1
        assert [got[i, h] for i in range(len(t))] == seats


def test_lm_scores(spark, docs, texts):
    got = {r.doc_id: r for r in lm_score.score(docs, head=50).collect()}
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    toks = {i: WORD.findall((t or "").translate(upper)) + ["\n"] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score <= 0
    assert lm_score.score(docs.limit(0)).count() == 0
    none = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    assert {r.train_tokens for r in lm_score.score(none).collect()} == {0}


def lm_model(toks, train):
    """Scores by exact counts at their levels: sums of quantised counts, no filter."""
    values = lm_score.count_of()
    q = lambda k: values[lm_score.level_of(np.array([k]))[0]] if k else 0.0
    after = lambda t: [(tuple([None, None, None, *t][j : j + 3]), w) for j, w in enumerate(t)]
    c, runs = Counter(), defaultdict(Counter)
    for i in train:
        c.update(toks[i])
        for x, w in after(toks[i]):
            runs[x][w] += 1
    whole = sum(map(q, c.values())) + len(c) + 1
    p1 = lambda w: (q(c[w]) + 1) / whole
    sums = {x: sum(map(q, words.values())) for x, words in runs.items()}

    def p(x, w):
        return (q(runs[x][w] if x in runs else 0) + lm_score.MU * p1(w)) / (sums.get(x, 0.0) + lm_score.MU)

    return {i: sum(math.log10(p(x, w)) for x, w in after(t)) for i, t in toks.items()}, p, c, p1


def test_lm_scores_against_exact_counts(spark):
    """The filter's scores against a model without one: whole, in many parts, with a small head, with
    hot contexts resolved first. Its probabilities after a context add up to 1."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40_000)]
    texts = [" ".join(words[i : i + 400] * int(rng.integers(1, 4))) for i in range(0, 40_000, 400)] * 2
    texts += ["the same line again and again in every text " + prose(rng, 20) for _ in range(300)] + [None, "", "one", "two words", "a b c", "a b c d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    toks = {i: [*(t or "").split(), "\n"] for i, t in enumerate(texts)}
    want, p, c, p1 = lm_model(toks, [i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2])
    assert math.isclose(sum(p(("the", "same", "line"), w) for w in c) + p(("the", "same", "line"), "unseen"), 1, rel_tol=1e-9)
    assert math.isclose(sum(p((None, None, None), w) for w in c) + p((None, None, None), "unseen"), 1, rel_tol=1e-9)
    assert math.isclose(sum(p(("no", "such", "words"), w) for w in c) + p1("unseen"), 1, rel_tol=1e-9)
    for kw in ({}, {"max_bits": 1 << 17}, {"head": 50}, {"hot": 200}, {"hot": 200, "head": 50}):
        got = {r.doc_id: r.score for r in lm_score.score(df, **kw).collect()}
        assert all(abs(got[i] - want[i]) <= 0.01 * abs(want[i]) + 4 for i in want), kw
        assert abs(sum(got.values()) - sum(want.values())) <= 0.005 * abs(sum(want.values()))


def test_repeated_documents_score_apart(spark):
    """A text that occurs twice in training scores higher a token than one that occurs once; rows of one id are scored each."""
    rng = np.random.default_rng(8)
    base = [prose(rng, 150, 3000) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*base, *base[:20]])] + [(0, base[0])]
    out = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    each = defaultdict(list)
    for r in out:
        each[r.doc_id].append(r.score / r.n_tokens)
    assert len(each[0]) == 2 and each[0][0] == each[0][1]
    twice = [each[i][0] for i in range(1, 20) if not {i, i + 60} & held]
    once = [each[i][0] for i in range(20, 60) if i not in held]
    assert min(twice) > max(once)


def test_lm_beats_the_base_on_held_out_text(spark):
    out = lm_score.op9_lm_score(spark, DIR).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert out[1] > out[0]


def test_bloom_filter_levels():
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    counts = rng.zipf(1.5, 4000).clip(1, 10**6)
    levels = lm_score.level_of(counts)
    seg_bits = 4096
    bits = np.zeros(seg_bits * lm_score.SEGMENTS, np.uint8)
    for k, top in zip(keys, levels, strict=True):
        at = lm_score.probes(np.repeat(k, top), np.arange(1, top + 1), seg_bits) + (k & np.uint64(lm_score.SEGMENTS - 1)) * np.uint64(seg_bits)
        bits[at.astype(np.int64)] = 1
    packed = np.packbits(bits, bitorder="little")
    got = lm_score.lookup(packed, seg_bits, keys)
    assert (got >= levels).all() and (got > levels).mean() < 0.03  # never too low; sometimes a false positive
    assert (lm_score.lookup(packed, seg_bits, rng.integers(0, 1 << 63, 4000).astype(np.uint64)) > 0).mean() < 0.03
    values = lm_score.count_of()
    assert values[1] == 1 and values[2] == 2 and values[0] == 0 and (np.abs(values[levels] - counts) <= 0.3 * counts).all()


def test_small_filter_parts_lose_no_score(spark, docs):
    """A bound on a part makes more parts, it does not take rare words or bigrams out."""
    a, b = ({r.doc_id: r.score for r in lm_score.score(docs, **kw).collect()} for kw in ({}, {"max_bits": 1 << 14}))
    assert abs(sum(a.values()) - sum(b.values())) <= 0.01 * abs(sum(a.values()))


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, keep_ids=True)
    got = rows.collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in mine for x in struct.unpack(f"<{r.length}I", r.ids)] == ids
        for r in mine:
            part = ids[r.start : r.start + r.length]
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    for g in seqs.values():
        at = 0
        for r in sorted(g, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    whole = packing.sequences(rows).collect()
    assert len(whole) == len(seqs) and all(len(r.ids) == 4 * 2048 for r in whole)
    assert packing.pack_documents(docs.limit(0), path).count() == 0
    twice = docs.where("doc_id = 1")
    assert packing.pack_documents(twice.unionByName(twice), path).agg(F.sum("length")).first()[0] == 2 * pieces[1][0].doc_tokens


def test_encoder_is_the_library(texts):
    enc = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    odd = ["".join(chr(c) for c in rng.integers(1, 0x250, 40)) for _ in range(400)]
    odd += ["It's I'M we'll don't '' 'S''s", "½²x 12a\x85b\xa0c", "ΟΔΟΣ Σας", "é x", "x" * 300]
    assert all(enc.encode(t) == enc.whole(t) for t in [*odd, *filter(None, texts)])


def test_first_fit_decreasing():
    rng = np.random.default_rng(9)
    sizes = sorted((int(x) for x in rng.integers(1, 101, 500)), reverse=True)
    tree, bins = packing.Tournament(len(sizes), 100), []
    for s in sizes:
        at, room = tree.put(s)
        want = next((i for i, b in enumerate(bins) if b >= s), len(bins))
        if want == len(bins):
            bins.append(100)
        assert (at, room) == (want, bins[want])
        bins[want] -= s


def test_stages_with_clashing_names_and_repeated_rows(spark, texts):
    names = "cutoffs good stratum row span cut size key bucket src shard id rep band component_id kept words __row __id __text __stratum __source __gone grp".split()
    rows = [(i if i % 9 else None, t, None, "s", len(t or ""), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows + rows[:20], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    passed = quality.filter_quality(docs, labels)
    want = [r for r in rows + rows[:20] if not text_stats(r[1])[-1]]
    assert passed.schema == docs.schema and sorted(map(repr, map(tuple, passed.collect()))) == sorted(map(repr, want))
    one = neardup.drop_near_duplicates(docs)
    assert one.columns == docs.columns
    found = {i: root for i, root in shingle_components({r[0]: r[1] for r in rows if r[0] is not None}).items()}
    got = one.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(i for i, root in found.items() if i == root)
    assert sum(r.doc_id is None for r in got) == sum(r[0] is None for r in rows + rows[:20])
    assert {tuple(r) for r in got} <= set(rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    sizes = {(r[0], r[5]): len(WORD.findall(r[1] or "")) for r in rows}
    taken = Counter()
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        taken[r.doc_id, r[5]] += len(WORD.findall(r.text))
    per = Counter((r[0], r[5]) for r in rows + rows[:20])
    assert all(n <= 2 * sizes[k] * per[k] for k, n in taken.items())
    target = 1.5 * sum(sizes[k] * n for k, n in per.items())
    assert abs(sum(taken.values()) - target) <= 128
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_one_row_of_a_repeated_id_stays(spark):
    a, b, c = (prose(np.random.default_rng(i), 80, 10**6) for i in range(3))
    rows = [(1, None, "x"), (1, b, "x"), (1, a, "z"), (1, a, "y"), (2, c, "u"), (2, c, "u"), (3, None, "n"), (3, None, "m")]
    got = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, v string")).collect()
    assert sorted(tuple(r) for r in got if r.doc_id != 3) == sorted([(1, min(a, b), "x" if b < a else "y"), (2, c, "u")])
    assert [tuple(r) for r in got if r.doc_id == 3] == [(3, None, "m")]


@pytest.mark.parametrize("copies", [64, 1])
def test_packing_does_not_depend_on_files(spark, docs, monkeypatch, copies):
    """Another split of the rows into files gives the same sequences, repeated rows included."""
    monkeypatch.setattr(packing, "COPIES", copies)
    path = public_tokenizers.path("word_bpe_49k.json")
    twice = docs.unionByName(docs.where("doc_id % 3 = 0")).withColumn("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")))
    a, b = (packing.pack_documents(d, path) for d in (twice.repartition(1), twice.repartition(7, "source")))
    rows = lambda x: sorted(map(repr, x.collect()))
    assert rows(a) == rows(b)


def test_other_vocabularies_go_to_the_library(texts):
    """Only a vocabulary whose own steps are the known ones is taken word by word."""
    from tokenizers import Tokenizer

    known, other = (packing.encoder(public_tokenizers.path(f"{x}.json")) for x in ("word_bpe_49k", "byte_bpe_50k"))
    assert known.known and not other.known
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in [*filter(None, texts[-9:]), "a <|startoftext|> b <|endoftext|>"]:
        assert [x[0] for x in struct.iter_unpack("<I", other.encode(t))] == tk.encode(t, add_special_tokens=False).ids
        assert known.encode(t) == known.whole(t)


def test_packing_spreads_rows_without_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = common.stage(packing.token_pieces(spark.range(300).selectExpr("CAST(NULL AS LONG) AS doc_id", "'the same words' AS text"), path), "same")
    packed = packing.pack(pieces, group_pieces=30)
    assert packed.count() == 300 and packed.selectExpr("sequence_id >> 32 AS g").groupBy("g").count().agg(F.max("count")).first()[0] < 100


def test_pipeline(spark):
    """run() against all four stages by brute force: the same pieces, and sequences as first-fit decreasing packs each group."""
    from tokenizers import Tokenizer

    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    before = common.written()
    out = pipeline.run(spark, sf).toPandas()
    left = common.written() - before  # nothing but the last stage and what it reads
    assert {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in left} <= {"pipeline-source_mix", "pieces", "pieces-again"}
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    passed = {x[0] for x in con.execute(f"SELECT doc_id FROM ({quality.oracle()}) WHERE kept").fetchall()}
    docs = {r[0]: r[1:] for r in con.execute("SELECT doc_id, source, text FROM documents").fetchall()}
    assert any(not text_stats(t)[-1] for i, (_, t) in docs.items() if i not in passed)  # certified cutoffs reject some
    alone = {i for i, root in shingle_components({i: docs[i][1] for i in sorted(passed)}).items() if i == root}
    mixed = brute_mix([(i, *docs[i]) for i in sorted(alone)])
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in mixed:
        ids = [*tk.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 2048):
            part = struct.pack(f"<{len(ids[k : k + 2048])}I", *ids[k : k + 2048])
            want[i, k, len(part) // 4, zlib.crc32(part), len(ids), part] += 1
    got = Counter((int(r.doc_id), int(r.start), int(r.length), int(r.ids_crc32), int(r.doc_tokens), bytes(r.ids)) for r in out.itertuples())
    assert got == want
    for g, rows in out.groupby(out.sequence_id // 2**32):
        room, packed = [], Counter()
        for n in sorted(rows.length, reverse=True):
            at = next((k for k, x in enumerate(room) if x >= n), len(room))
            if at == len(room):
                room.append(2048)
            packed[at, 2048 - room[at], n] += 1
            room[at] -= n
        assert packed == Counter((int(r.sequence_id) - (int(g) << 32), int(r.offset), int(r.length)) for r in rows.itertuples())
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_duplicates", "source_mix", "packing"]


def test_registered_sql(spark):
    from rivulet.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, DIR)
        cols = sorted(df.columns)
        cur = con.execute(sql)
        at = [[x[0] for x in cur.description].index(c) for c in cols]
        norm = lambda v: round(v, 6) if isinstance(v, float) else v
        assert sorted(repr([norm(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([norm(r[i]) for i in at]) for r in cur.fetchall()), name


def test_turn_digest_is_plain_sha256(spark):
    r = chat.op5_chat_format(spark, DIR).where("conv_id = -1").first()
    probe = "<|im_end|><|im_start|>assistant ok"
    assert r.turns_sha256 == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(probe), hashlib.sha256(probe.encode()).hexdigest())
