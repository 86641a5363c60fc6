"""The ten operators and the pipeline: brute force, round trips, held-out accuracy, and awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import decontamination, embedding_dups, jaccard_join, pieces, quality, sharding, token_counts, token_files, toxicity, url_templates
from quire.llm.common import shared_path
from quire.llm.graph import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, Text2 string"
LONG = "word " * 30_000
#: Nulls, empties, a very long text, ties, repeated rows, special strings.
ROWS = [
    (1, "The cat sat on the mat and looked at the dog.", "en", "x"), (1, "The cat sat on the mat and looked at the dog.", "en", "x"), (2, None, None, None), (3, "", "en", ""),
    (None, "no id here, but words all the same", "en", None), (5, LONG, None, "y"), (6, "a<|endoftext|>b  c\n\n 'll x'll ▁ é가😀", "de", None), (7, " \n\t ", "fr", None), (8, "\u00a0 odd  space　here ", None, None),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return lambda name: Tokenizer.from_file(public_tokenizers.path(name))


# 1
def test_token_files(spark, library):
    folder = shared_path(spark, "t")
    shards = token_files.write_tokens(frame(spark), folder, "word_bpe_49k.json", length=64)
    got = token_files.read_documents(shards, folder).orderBy("start").collect()
    tok = library("word_bpe_49k.json")
    want = sorted(((-1 if i is None else i), zlib.crc32((t or "").encode()), t or "") for i, t, *_ in ROWS)
    assert len(got) == len(ROWS)
    start = 0
    for r, (i, _, t) in zip(got, want, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert (-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shard = shards.orderBy("start").first()["shard"]
    file = token_files.Shard(folder, shard)
    ids, mask = file.sequence(len(file) - 1)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata
    empty = token_files.write_tokens(frame(spark, []), shared_path(spark, "t"), "word_bpe_49k.json")
    assert token_files.read_documents(empty, folder).count() == 0


# 2
def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id").quality
    scorer = quality.fit(docs)
    got = quality.score(docs, scorer).select("doc_id", "quality").toPandas().set_index("doc_id").quality
    both = labels.index.intersection(got.index)
    right = ((got[both] >= quality.KEEP) == (labels[both] == 1)).mean()
    assert right >= 0.97
    awkward = quality.score(frame(spark), scorer)
    assert awkward.count() == len(ROWS) and awkward.where("text is null or trim(text) = ''").where("quality < 0.5").count() == 0
    assert quality.score(frame(spark, []), quality.fit(frame(spark, []))).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.85
    rate = np.linspace(0.3, 0.9, len(quality.LABELLERS))
    v = np.where(good[:, None], rng.random((len(good), len(rate))) < 0.98, rng.random((len(good), len(rate))) > rate).astype(np.int8)
    pattern, count = np.unique(quality.patterns(v), return_counts=True)
    found = quality.em(pattern, count.astype(float))
    assert abs(found["prior"] - 0.85) < 0.02
    for (_, a, b), want in zip(found["accuracy"], rate, strict=True):
        assert abs(a - 0.98) < 0.02 and abs(b - want) < 0.06


# 3
def test_prefix_counts(spark, library):
    tok, rng = library("byte_bpe_50k.json"), random.Random(2)
    texts = [t for _, t, *_ in ROWS if t != LONG] + ["".join(rng.choice("abethion  \n'sédrl.,!1 2\xa0") for _ in range(40)) for _ in range(60)] + ["<|endoftext|><|endoftext|> <|endof", "'re 'r 'S", "a\n b\n\n c \n"]
    counts, chars = token_counts.counter("byte_bpe_50k.json")(pa.array(texts, pa.string()))
    at = 0
    for t, n in zip(texts, chars.tolist(), strict=True):
        t = t or ""
        assert n == len(t)
        assert counts[at : at + n].tolist() == [len(tok.encode(t[:k], add_special_tokens=False).ids) for k in range(1, n + 1)]
        at += n
    got = token_counts.prefix_counts(frame(spark), limit=5).collect()
    for r, (i, t, *_) in zip(got, ROWS, strict=True):
        t = t or ""
        assert (r.doc_id, r.n_bytes, r.n_tokens) == (i, len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) and len(r.prefix_counts) == len(t)
        assert all(c <= 5 for c in r.prefix_counts[: r.fit_chars]) and (r.fit_chars == len(t) or r.prefix_counts[r.fit_chars] > 5)


# 4
def test_pieces_are_the_librarys_without_dropout(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r, (_, t, *_) in zip(pieces.encode(frame(spark), dropout=0.0).collect(), ROWS, strict=True):
        assert r.lossless and ("▁" in (t or "") or r.ids == model.encode(t or ""))


def test_dropout(spark):
    one, same, other = (pieces.encode(frame(spark), seed=s).collect() for s in (1, 1, 2))
    assert [r.ids for r in one] == [r.ids for r in same] != [r.ids for r in other]
    assert all(r.lossless for r in one + other) and "Text2" in one[0].asDict()
    of = pieces.Pieces("piece_bpe_32k.model", 0.3, 5)
    units = [" Hello", " internationalisation", "a\nb", " ", "   x", " é가😀"]
    flat, lengths = of._units([u.encode() + b"\2" for u in units])
    alone = [of.unit(u, zlib.crc32(u.encode() + b"\2", 5)) for u in units]
    assert flat.tolist() == [i for x in alone for i in x] and lengths.tolist() == list(map(len, alone))


def test_every_occurrence_has_its_own_draws():
    import pyarrow as pa

    of = pieces.Pieces("piece_bpe_32k.model", 0.1, 5)
    units = [b" internationalisation", b" Hello", " é가😀".encode(), b" " + b"long" * 12]
    codes, keys = np.arange(2000) % 4, np.random.default_rng(2).integers(0, 2**31, 2000)
    flat, lengths = of.draws(units, codes, keys)
    alone = [of.unit(units[c].decode(), int(k)) for c, k in zip(codes, keys, strict=True)]
    assert flat.tolist() == [i for x in alone for i in x] and lengths.tolist() == list(map(len, alone))
    ids, counts = of.encode(pa.array(["internationalisation"] * 2000), pa.array(range(2000)))
    ends = np.cumsum(counts)
    assert len({tuple(ids[z - n : z].tolist()) for z, n in zip(ends, counts, strict=True)}) > 8


# 5
def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.op5_toxicity(spark, "/root/testdata/sf0.1").toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() >= 0.96 and held[held.toxic == 1].predicted.mean() >= 0.85
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    awkward = toxicity.score(frame(spark), toxicity.fit(docs, labels.limit(0)))
    assert awkward.count() == len(ROWS) and awkward.where("toxicity > 0.01").count() == 0


# 6
def test_shards(spark):
    rows = ROWS + [(i, str(i), None, None) for i in range(100, 1100)]
    got = sharding.shard_documents(frame(spark, rows)).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    moved = got[got.shard != got.grown_shard]
    assert set(moved.grown_shard) == {16} and 0.03 < len(moved) / len(got) < 0.1
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_jump_is_the_published_one():
    def plain(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(3).integers(0, 2**63, 500).astype(np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(keys, n).tolist() == [plain(int(k), n) for k in keys]


def test_shards_sql(spark):
    import oracle

    assert oracle.differences(sharding.op6_shards(spark, SF), oracle.views(SF), sharding.ORACLE_SQL) == ""


# 7
def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in centre[i % 6] + rng.normal(scale=0.12, size=16)], i % 2) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(20)] + [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 1), (403, [1.0, None], 1), (404, rows[0][1], None), (405, [1.0] * 8, 0), (406, [1.0] * 8, 0), (407, [], 0)]
    got, told = embedding_dups.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = {r.vec_id: r for r in got.collect()}
    links = {i: set() for i, *_ in rows}
    ok = [(i, np.array(v, float) / np.linalg.norm(v), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for a, (i, x, k) in enumerate(ok):
        for j, y, m in ok[:a]:
            if k == m and len(x) == len(y) and x @ y >= 0.93:
                links[i].add(j)
                links[j].add(i)
    low = {}
    for i in sorted(links):
        if i not in low:
            todo = [i]
            while todo:
                n = todo.pop()
                if n not in low:
                    low[n] = i
                    todo += links[n]
    found = sum(r.n_links for r in got.values())
    assert found >= 0.9 * sum(map(len, links.values())) and all(t["recall"] is None or t["recall"] >= 0.9 for t in told)
    assert all(got[i].n_links <= len(links[i]) for i in links)
    assert {i: got[i].component_id for i in links} == low
    assert embedding_dups.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int"))[0].count() == 0


def test_near_vectors_without_clusters(spark, monkeypatch):
    """Few links among vectors without clusters, which the sample doesn't show, in many cells: all of them are found."""
    monkeypatch.setattr(embedding_dups, "QUERIES", 2)
    monkeypatch.setattr(embedding_dups, "VISIT", 0, raising=False)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=(400, 64))
    away -= (away * x[:400]).sum(axis=1, keepdims=True) * x[:400]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = np.linspace(0.931, 0.94, 400)[:, None]
    x[2000:2400] = c * x[:400] + np.sqrt(1 - c**2) * away
    label = np.arange(4000) % 2
    got = embedding_dups.near_vectors(spark.createDataFrame([(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), label, strict=True))], "vec_id long, embedding array<double>, label int"))[0].toPandas().set_index("vec_id")
    want = ((x @ x.T >= 0.93) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    assert want.sum() == 800 and got.n_links.sort_index().tolist() == want.tolist()
    assert [got.component_id[2000 + i] for i in range(400)] == list(range(400))


# 8
def brute_links(rows):
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    low = list(range(len(rows)))
    for _ in rows:
        low = [min([low[i], *(low[j] for j in near[i])]) for i in range(len(rows))]
    return [len(n) for n in near], low


def test_jaccard_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 10)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", 1500)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "new" + str(rng.random())
        rows.append((i, " ".join(w), None, None))
    rows += [(60 + i, " ".join(rng.choice(vocabulary) for _ in range(80)), None, None) for i in range(40)] + [(100 + i, rows[3][1].upper(), None, None) for i in range(5)]
    rows += [(200, None, None, None), (201, "", None, None), (202, "", None, None), (203, "two words", None, None), (204, "Two, words!", None, None)]
    got = {r.doc_id: r for r in jaccard_join.jaccard_links(frame(spark, rows)).collect()}
    n, low = brute_links(rows)
    assert [got[r[0]].n_links for r in rows] == n
    assert [got[r[0]].class_id for r in rows] == [rows[k][0] for k in low]
    assert jaccard_join.jaccard_links(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    low = {n: n for e in edges for n in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == k for n, k in low.items() if n in got) and all(low[n] == n for n in low if n not in got)


# 9
def test_url_rules(spark):
    rows = [
        (1, "http://a.net/x"), (2, "https://Example.NET/en/1?q"), (3, "https://xexample.net/en/1"), (4, "http://b.example.com/de/9#t"), (5, "http://example.com/de"), (6, "http://w.org/fr/"), (7, "no scheme.net/"),
        (8, None), (9, ""), (10, "http://net"), (11, "http://c.org/en/1"), (11, "http://c.org/en/1"), (12, "x://y?net/"), (13, "http://a.net:80/p"),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("example.net", "/en/1", "example.net/en/", "allow"), 3: ("xexample.net", "/en/1", "net/", "block"), 4: ("b.example.com", "/de/9", "example.com/de/", "block"),
        5: ("example.com", "/de", None, "allow"), 6: ("w.org", "/fr/", "org/fr/", "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("net", "", None, "allow"),
        11: ("c.org", "/en/1", None, "allow"), 12: ("y", "", None, "allow"), 13: ("a.net:80", "/p", None, "allow"),
    }


def test_url_templates_learn(spark):
    rows = [(i, f"http://h.io/bad/{i}/x") for i in range(60)] + [(100 + i, f"http://h.io/good/{i}/x") for i in range(60)]
    rules = [("h.io", f"/bad/{d}", "block") for d in range(1, 5)] + [("h.io", "/good/1", "allow")]
    got = url_templates.judged(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    verdict = {r.page_id: r.verdict for r in got}
    assert {r.template for r in got if r.rule is None} == {"/bad/*/x", "/good/*/x"}
    assert all(verdict[i] == "block" for i in range(60)) and all(verdict[100 + i] == "allow" for i in range(60))


def test_url_templates_sql(spark):
    import oracle

    assert oracle.differences(url_templates.op9_url_templates(spark, SF), oracle.views(SF), url_templates.ORACLE_SQL) == ""


# 10
def brute_hits(docs, items):
    out = []
    for i, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for k, x in items:
            v = words(x)
            size = min(10, len(v))
            for s in range(len(v) - size + 1) if v else ():
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == v[s : s + size]:
                        hit |= set(range(p, p + size))
                        found.add(k)
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [10**6, 60])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    rng = random.Random(7)
    w = [rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(400)]
    items = [(k, " ".join(w[k * 17 : k * 17 + n])) for k, n in enumerate((25, 12, 10, 9, 3, 1, 14))] + [(7, "never in any document at all"), (8, None), (9, "!!"), (10, " ".join(w[:25]))]
    docs = [(i, ", ".join(w[i * 20 : i * 20 + 40]).title(), None, None) for i in range(10)] + ROWS[:4] + [(50, "ab " * 30, None, None), (51, w[4 * 17], None, None)]
    folder = shared_path(spark, "b")
    blocks = decontamination.index_items(spark.createDataFrame(items, "item_id long, text string"), frame(spark, docs), folder)
    found = decontamination.contamination(frame(spark, docs), folder, blocks)
    assert blocks > 1 or block > 60
    got = sorted(map(tuple, decontamination.digest(found).collect()))
    assert got == sorted(brute_hits(docs, items))
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in found.collect())


def test_decontamination_sql(spark):
    import oracle

    assert oracle.differences(decontamination.op10_decontamination(spark, SF), oracle.views(SF), decontamination.ORACLE_SQL) == ""


# the pipeline
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(SF + "/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == before.columns
        sizes.append(docs.count())
        if k == 2:
            rows = [tuple(r) for r in before.select("doc_id", "text").orderBy("doc_id").collect()]
            _, low = brute_links(rows)
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted({rows[i][0] for i in low})
        if k == 3:
            items = [tuple(r) for r in spark.read.parquet(SF + "/benchmark.parquet").select("item_id", "text").collect()]
            clean = {r[0] for r in brute_hits([tuple(r) for r in before.select("doc_id", "text").collect()], items) if not r[-1]}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == clean
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert docs.where("not lossless").count() == 0
