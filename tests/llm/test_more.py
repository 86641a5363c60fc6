"""Awkward rows, bounded memories, and what the methods do, beside the tests of each operator."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_llm import LONG, ROWS, brute_hits, brute_links, frame

from quire.llm import common, decontamination, embedding_dups, jaccard_join, pieces, quality, sharding, token_counts, token_files, toxicity, url_templates
from quire.llm.common import Memo, Numbers, numbered, shared_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    parts = ["a", "B", "é", "É", "ß", "Ñ", "÷", "×", "ÿ", "'s", "'LL", "'", "s", "1", "23", "!", "<|", "<|endoftext|>", "|>", " ", "  ", "\n", "\x1c", "\x00", "\x85", "\xa0", "　", "中", "́", "İ", "Σ", "ﬁ", "😀", "​", "_", "-", "ª", ".com", "th", "ing"]
    odd = ["".join(rng.choice(parts) for _ in range(50)) for _ in range(1500)]
    return pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist() + odd


def held_by_memo(memo):
    return memo.held + sum(x.nbytes for x in memo._older[1:]) + sum(map(len, memo._older[0])) + Memo.EACH * len(memo._older[0])


def test_memo_is_a_function_within_its_bytes():
    made = []

    def make(words):
        made.append(len(words))
        return np.concatenate([np.frombuffer(w, np.uint8) for w in words]), np.array([len(w) for w in words])

    memo, rng, most = Memo(make, np.uint8, most=200_000), random.Random(1), 0
    common_words = [f"often{i}".encode() for i in range(20)]
    for step in range(200):
        words = common_words + [f"{step}-{i}".encode() * rng.randrange(1, 4) for i in range(50)] + ([b"x" * 90_000 + str(step).encode()] if step % 7 == 0 else [])
        at = memo.places(words)
        assert [memo.flat[memo.start[k] : memo.start[k] + memo.length[k]].tobytes() for k in at] == words
        most = max(most, held_by_memo(memo))
    # the bound, two steps' own with the arrays' spare room
    assert most < 200_000 + 2 * 3 * 190_000, most
    # what is in use stays
    assert sum(made) < 200 * 55 + 20 + 40


def test_numbers():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000)).astype(np.uint64)
    table = Numbers(keys)
    assert table(keys).tolist() == list(range(len(keys))) and (table(keys ^ np.uint64(1)) == [np.flatnonzero(keys == k)[0] if k in keys else -1 for k in keys ^ np.uint64(1)]).all()


def test_words_are_the_librarys(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids, counts = token_files.encoder("word_bpe_49k.json")(pa.array(texts))
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == library.encode(texts[0], add_special_tokens=False).ids
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_librarys(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts, chars = token_counts.counter("byte_bpe_50k.json")(pa.array(texts))
    last = counts[np.cumsum(chars) - 1]
    assert last.tolist() == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_pieces_are_the_librarys(texts):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of = pieces.Pieces("piece_bpe_32k.model", 0.0, 1)
    ids, counts = of.encode(pa.array(texts), pa.array(range(len(texts))))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == model.encode(texts)
    drops = pieces.Pieces("piece_bpe_32k.model", 0.1, 1)
    ids, counts = drops.encode(pa.array(texts), pa.array(range(len(texts))))
    assert [x.decode() for x in drops.decode(ids, counts).to_pylist()] == texts
    # a candidate in ten is skipped
    flat = drops.memo.flat[: drops.memo.used]
    keys = np.random.default_rng(1).integers(0, 2**31, 100_000)
    assert abs(drops.skipped(keys, flat[:100_000].astype(np.int64) & 15, flat[:100_000].astype(np.int64) & 0xFFFF).mean() - 0.1) < 0.01


def test_memory_without_spaces():
    """Documents that are one long word each aren't kept: a worker holds some of them at a time."""
    rng = np.random.default_rng(2)
    of, counts = token_files.Encoder("word_bpe_49k.json"), token_counts.PrefixCounter("byte_bpe_50k.json")
    for memo in (of.memo, counts.memo):
        memo.most = 400_000
    for step in range(12):
        docs = pa.array(["".join(map(chr, rng.integers(0x4E00, 0x9000, 4000))) + " " + str(step) for _ in range(5)])
        of(docs)
        counts(docs)
        assert held_by_memo(of.memo) < 3_000_000 and held_by_memo(counts.memo) < 3_000_000


def test_budgets_from_the_stored_table(spark):
    table = token_counts.prefix_counts(frame(spark), packed=True)
    plain = token_counts.prefix_counts(frame(spark)).collect()
    for r, p in zip(table.collect(), plain, strict=True):
        assert token_counts.restored(r.prefix_counts).tolist() == p.prefix_counts
    for r, p in zip(token_counts.cut(table, [1, 5, 10**6]).collect(), plain, strict=True):
        c = p.prefix_counts
        for budget in (1, 5, 10**6):
            n = next((i for i, x in enumerate(c) if x > budget), len(c))
            assert (r[f"chars_{budget}"], r[f"tokens_{budget}"]) == (n, c[n - 1] if n else 0)
        assert r.n_tokens == p.n_tokens
    assert [r.tokens for r in token_counts.counted(table, 7).collect()] == [p.prefix_counts[:7][-1] if p.prefix_counts else 0 for p in plain]
    far = np.array([300, 2, 500, 1])
    assert [token_counts.restored(x).tolist() for x in token_counts.deltas(far, np.array([0, 0, 2, 4]))] == [[], [300, 2], [500, 1]]


def test_gradient_and_correction():
    rng = np.random.default_rng(5)
    # the first feature is in all positives and nowhere else
    lists = [rng.choice(np.arange(1, 12), rng.integers(0, 6), replace=False).astype(np.int32) for _ in range(40)]
    rows = toxicity.Rows([np.append(x, np.int32(0)) if i < 15 else x for i, x in enumerate(lists)])
    pos, unl, value = rows.part(np.arange(15)), rows.part(np.arange(15, 40)), rng.uniform(0.2, 1, 12)
    seen = set()
    for bias, mark, prior in ((0.0, 0.0, 0.1), (2.0, -1.0, 0.1), (-6.0, 12.0, 0.9), (1.0, 2.0, 0.99)):
        w = np.append(rng.normal(size=12), bias)
        w[0] = mark
        base, grad, negative = toxicity.risk(w, pos, unl, value, prior)
        seen.add(negative)

        def total(x):
            if negative:  # the step climbs the correction
                return -(toxicity.loss(x, unl, value, -1)[0] - prior * toxicity.loss(x, pos, value, -1)[0])
            return toxicity.risk(x, pos, unl, value, prior)[0]

        for k in range(13):
            step = np.eye(13)[k] * 1e-6
            assert abs((total(w + step) - total(w - step)) / 2e-6 - grad[k]) < 1e-6
        assert base >= 0
    assert seen == {True, False}


def test_training_does_the_work(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = labels.toPandas().drop_duplicates("doc_id").set_index("doc_id").toxic
    right = {}
    for epochs in (0, 60):
        got = toxicity.score(docs, toxicity.fit(docs, labels, epochs=epochs)).select("doc_id", "toxicity").toPandas().set_index("doc_id").toxicity
        held = [i for i in truth.index.intersection(got.index) if zlib.crc32(str(i).encode()) % 5 == 0]
        toxic, clean = got[[i for i in held if truth[i] == 1]], got[[i for i in held if truth[i] == 0]]
        right[epochs] = ((toxic >= 0.5).mean() + (clean < 0.5).mean()) / 2
    assert right[60] >= 0.9 and right[60] >= right[0] + 0.2


def test_quality_learns_beyond_labellers():
    """Texts whose labels come from a word alone: only hashed features of the text can tell."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) + (" zzyzx" * 3 if i % 2 else "") for i in range(900)]
    of = lambda part: quality.Spelling(common.Words(pa.array(part))).rows()
    y = np.array([1.0 - i % 2 for i in range(900)])
    w = quality.train(of(texts[:600]), y[:600], np.ones(600))
    z = quality.Spelling(common.Words(pa.array(texts[600:]))).sums(w) + w[-1]
    assert ((z > 0) == (y[600:] == 1)).mean() > 0.95
    assert np.allclose(of(texts[600:]) @ w[:-1] + w[-1], z, atol=1e-3)


def test_vectors_of_any_length(spark):
    rows = [(1, [1e200, 2e200], "a"), (2, [2e200, 4e200], "a"), (3, [1e-250, 2e-250], "a"), (4, [-1.0, 0.5], "a"), (5, [0.0, -0.0], "a"), (6, [float("inf"), 1.0], "a"), (7, [5e-324, 1e-323], "a")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dups.near_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label string, VEC_ID2 int"))[0].collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (3, 1)}


def test_vectors_against_brute_force(spark):
    frame_ = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = frame_.toPandas().drop_duplicates("vec_id").set_index("vec_id").sort_index()
    ok = x.embedding.map(lambda v: v is not None and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float))) & x.label.notna()
    v = np.stack(x.embedding[ok].map(lambda v: np.asarray(v, float) / np.linalg.norm(np.asarray(v, float))))
    label = x.label[ok].astype(str).to_numpy()
    want = ((v @ v.T >= 0.93) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    got = embedding_dups.near_vectors(frame_)[0].toPandas().drop_duplicates("vec_id").set_index("vec_id").n_links
    assert got[x.index[ok]].tolist() == want.tolist() and (got[x.index[~ok]] == 0).all()


def test_items_of_any_id(spark):
    docs = [(i, t, None, None) for i, t in enumerate(["one two three four five six seven eight nine ten eleven", "x y", "nothing of it", None])]
    items = [(None, "one two three four five six seven eight nine ten"), ("b-2", "x y"), ("a", "X, Y!"), (None, "x y"), ("10", None)]
    folder = shared_path(spark, "b")
    found = decontamination.contamination(frame(spark, docs), folder, decontamination.index_items(spark.createDataFrame(items, "item_id string, text string"), frame(spark, docs), folder))
    got = [(r.n_hit, r.item_ids) for r in found.orderBy("doc_id").collect()]
    assert got == [(10, [None]), (2, ["a", "b-2", None]), (0, []), (0, [])]
    assert [(r.n_items, r.contaminated) for r in decontamination.digest(found).orderBy("doc_id").collect()] == [(1, True), (3, True), (0, False), (0, False)]


def test_open_urls_lean_on_their_like(spark):
    rows = [(i, f"http://h.example.com/de/{i}.html") for i in range(60)] + [(100 + i, f"http://h.example.com/en/{i}.html") for i in range(60)]
    rows += [(200 + i, f"http://h.org/fr/{i}") for i in range(60)] + [(300 + i, f"http://h.org/en/{i}") for i in range(60)] + [(400 + i, f"http://few.example.com/de/{i}") for i in range(2)] + [(500 + i, f"http://few.example.com/en/{i}") for i in range(9)]
    rows += [(600 + i, f"http://h.example.com/shop/item/{i}/buy/now") for i in range(60)]
    got = {r.page_id: r for r in url_templates.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[100 + i].verdict == "block" and got[100 + i].purity > 0.9 for i in range(60))  # as /de/ of the same host
    assert all(got[300 + i].verdict == "allow" for i in range(60)) and all(got[500 + i].verdict == "allow" for i in range(9))  # too few labels
    # another structure isn't merged; it leans on its host alone
    assert all(got[600 + i].purity < 0.8 and got[600 + i].verdict == "allow" for i in range(60))


def test_rows_have_numbers(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "t"))
    table = numbered(spark.read.parquet(str(tmp_path / "t")), "n")
    first, again = ({r.id: r.n for r in t.collect()} for t in (table, table.where("id % 2 = 0")))
    assert len(set(first.values())) == 1000 and all(first[i] == n for i, n in again.items())
    assert numbered(spark.range(10).union(spark.range(10)), "n").select("n").distinct().count() == 20


CLASH = "doc_id long, text string, ids string, n_tokens int, ids_crc32 int, lossless int, Quality double, quality_2 int, Toxicity int, quire_ids int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 8) for i, t, *_ in rows], CLASH)


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages_take_any_rows(spark, rows):
    import corpus_pipeline

    docs = clashing(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        assert name == "pieces" or docs.columns == before.columns
        docs.write.parquet(path := shared_path(spark, "stage"))
        docs = spark.read.parquet(path)
        assert docs.count() <= len(rows)
    assert docs.where("not quire_lossless").count() == 0 and "quire_ids_2" in docs.columns


def test_rows_without_ids_are_judged(spark):
    import corpus_pipeline

    passage = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    plain = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, passage, None, None), (None, plain, None, None), (None, plain, None, None), (7, plain, None, None), (7, plain, None, None), (7, "quite another text with the same id as others have", None, None), (3, plain.title(), None, None), (None, None, None, None), (9, "", None, None)]
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.clean(spark, frame(spark, rows), SF).collect()), key=str)
    assert len(kept) == len(rows) - 1 and (None, passage) not in kept
    left = [(r.doc_id, r.text) for r in corpus_pipeline.distinct(spark, frame(spark, rows), SF).collect()]
    assert sorted(left, key=str) == sorted([(None, passage), (3, plain.title()), (7, rows[5][1]), (None, None), (9, "")], key=str)


def test_operators_take_any_rows(spark):
    docs, none = clashing(spark, ROWS), clashing(spark, [])
    for d, n in ((docs, len(ROWS)), (none, 0)):
        assert token_counts.prefix_counts(d).count() == n and sharding.shard_documents(d).count() == n and jaccard_join.jaccard_links(d).count() == n
        assert pieces.encode(d).count() == n
        folder = shared_path(spark, "b")
        assert decontamination.contamination(d, folder, decontamination.index_items(d.select(d.doc_id.alias("item_id"), "text"), d, folder)).count() == n
    assert url_templates.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert url_templates.judged(spark.createDataFrame([(1, "http://a.org/" + "x/" * 20_000, 1, "n")], "page_id long, url string, host int, template string")).count() == 1
    tied = toxicity.score(frame(spark, [(1, "a b", None, None)] * 3), toxicity.Model(np.zeros(0, np.uint32), np.zeros(0), 0.0))
    assert {r.toxicity for r in tied.collect()} == {0.5}


def test_hot_groups_are_whole(spark, monkeypatch):
    """A third of all rows near-copies of one text, in blocks, against brute force."""
    monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", 900)
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(100)]
    rows = [(i, " ".join(base[:k] + [f"n{i}"] + base[k:]), None, None) for i in range(50) for k in [rng.randrange(100)]] + [(100 + i, " ".join(f"w{rng.randrange(500)}" for _ in range(40)), None, None) for i in range(100)]
    got = {r.doc_id: r for r in jaccard_join.jaccard_links(frame(spark, rows)).collect()}
    n, low = brute_links(rows)
    assert [(got[r[0]].n_links, got[r[0]].class_id) for r in rows] == [(k, rows[j][0]) for k, j in zip(n, low, strict=True)]


def test_decontamination_of_blocks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 40)
    items = [(i, " ".join(f"x{i}y{j}" for j in range(14))) for i in range(12)]
    docs = [(i, "word " * 5 + items[i][1], None, None) for i in range(12)] + [(50, LONG + items[3][1], None, None)]
    folder = shared_path(spark, "b")
    blocks = decontamination.index_items(spark.createDataFrame(items, "item_id long, text string"), frame(spark, docs), folder)
    assert blocks > decontamination.HELD
    found = decontamination.digest(decontamination.contamination(frame(spark, docs), folder, blocks, spans=False))
    assert {tuple(r) for r in found.where("doc_id < 50").collect()} == set(brute_hits(docs[:12], items)) and found.where("doc_id = 50").first()["n_hit"] == 14


@pytest.mark.parametrize("module", [embedding_dups, jaccard_join, sharding])
def test_sql(spark, module):
    import oracle

    query = {embedding_dups: embedding_dups.op7_embedding_dups, jaccard_join: jaccard_join.op8_jaccard_join, sharding: sharding.op6_shards}[module]
    assert oracle.differences(query(spark, "/root/testdata/sf0.001"), oracle.views("/root/testdata/sf0.001"), module.ORACLE_SQL) == ""


def test_hot_keys_of_shards(spark):
    """A third of all rows without a doc_id, a third with one and the same: slots are ranks all the same."""
    rng = random.Random(9)
    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else rng.randrange(10**6), f"t{rng.randrange(400)}", None, None) for i in range(3000)]
    got = sharding.shard_documents(frame(spark, rows).repartition(9)).toPandas()
    for _, g in got.groupby("shard"):
        order = sorted((-1 if d != d or d is None else d, c, s) for d, c, s in zip(g.doc_id, g.text_crc32, g["size"], strict=True))
        by_slot = g.sort_values("slot")
        assert by_slot.slot.tolist() == list(range(len(g)))
        assert [(-1 if d != d or d is None else d, c, s) for d, c, s in zip(by_slot.doc_id, by_slot.text_crc32, by_slot["size"], strict=True)] == order


def test_url_plans_stay_small(spark, tmp_path, monkeypatch):
    """No plan holds another twice: the driver's memory goes with the size of plans."""
    rows = [(i, f"http://h{i % 3}.example.com/{'de' if i % 2 else 'fr'}/{i % 5}/{i}/x") for i in range(200)]
    joins, keep = [], url_templates.stored

    def counted(df, name):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return keep(df, name)

    monkeypatch.setattr(url_templates, "stored", counted)
    assert url_templates.judged(spark.createDataFrame(rows, "page_id long, url string")).count() == 200
    assert max(joins) <= 4
