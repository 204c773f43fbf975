"""Long texts, clashing names, plain versions of the models and of the stages, recall on the tables."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidentia.llm import flac, hostrules, neardup, pairwise, repeats, segments, tokens, toxicity, warc

from .test_operators import CLASH, ROWS, VOCAB, clash, docs, key, plain_groups, plain_repeats, prose, rows, words  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(77)
    return " ".join(r.choice(VOCAB) + r.choice(["", "", ",", "\n", "é"]) for _ in range(600_000))  # longer than any operator's chunk


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    return spark.createDataFrame([(1, long_text, "en", "s"), (2, "short text", "en", "s"), (3, None, None, None)], "doc_id long, text string, lang string, source string")


def test_long_text_through_the_media(long_docs, long_text):
    assert len(long_text) > max(flac.CHUNK_BYTES, tokens.CHUNK_BYTES, segments.CHUNK_BYTES, toxicity.CHUNK_BYTES, neardup.CHUNK_BYTES)
    got = {r.doc_id: r for r in flac.media_features(flac.write_media(long_docs)).collect()}
    raw = flac._padded(long_text.encode())
    assert got[1].payload_sha256 == hashlib.sha256(raw).hexdigest() and got[1].tail_crc32 == zlib.crc32(raw[-64:]) and got[3].n_bytes == 0


def test_long_text_through_the_tokens(long_docs, long_text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokens.tokenizer_path()).encode(long_text, add_special_tokens=False).ids
    crc = zlib.crc32(np.array([*ids, 0], "<u4").tobytes())
    got = {r.doc_id: r for r in tokens.read_boundaries(tokens.write_ids(long_docs)).collect()}
    assert got[1].ids_crc32 == crc and got[1].n_tokens == len(ids) + 1 and got[2].start == got[1].start + got[1].n_tokens
    packed = tokens.pack_documents(long_docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id: r.n for r in packed} == {r.doc_id: r.m for r in packed} and {r.doc_id: r.n for r in packed}[1] == len(ids) + 1


def test_long_text_through_the_rest(spark, long_docs, long_text):
    n = len(words(long_text))
    assert {r.doc_id: r.n_words for r in hostrules.judge(long_docs).collect()} == {1: n, 2: 2, 3: 0}
    near = {r.doc_id: r.n_shingles for r in neardup.near_duplicates(long_docs).collect()}
    w = words(long_text)
    assert near == {1: len({tuple(w[i : i + 5]) for i in range(n - 4)}), 2: 1, 3: 0}
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    for rate in (pairwise.rank_quality, toxicity.rate_toxicity):
        assert rate(long_docs, labels).count() == 3
    pages = long_docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    read = {r.page_id: r for r in warc.read_archives(spark, warc.write_archives(pages)).collect()}
    assert read[1].payload_bytes == len(long_text.encode()) and read[3].payload_bytes == 0
    pieces = segments.load(segments.model_path())
    best = segments.segment(long_docs).filter("rank = 1 AND doc_id = 1").first()
    assert segments.decode(best.ids, pieces) == long_text


def test_long_text_is_cut_in_pieces(spark):
    r = random.Random(5)
    base = "".join(r.choice("abcdefghij klmno") for _ in range(repeats.CHUNK_BYTES + 3000))
    near = repeats.CHUNK_BYTES
    items = [(1, base[near - 400 : near + 500] + base[5000:5200]), (2, base), (3, base[100:190] + "x" + base[near - 60 : near + 60])]
    df = spark.createDataFrame(items, "doc_id long, text string")
    assert rows(repeats.remove_repeats(df)) == plain_repeats([(d, t.encode()) for d, t in items])


def test_operators_bear_clashing_names(spark, clash):  # noqa: F811
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(14)], "doc_id long, quality int, toxic int")
    stages = [hostrules.keep_good(clash), toxicity.keep_ordinary(clash, labels), neardup.keep_first(clash), repeats.remove_repeats(clash, with_text=True)]
    for df in stages:
        assert df.columns == clash.columns and all(r[c] == 1 for r in df.collect() for c in CLASH)
    for n in (hostrules.judge(clash), pairwise.rank_quality(clash, labels), toxicity.rate_toxicity(clash, labels), segments.segment(clash, 1), tokens.read_boundaries(tokens.write_ids(clash)), repeats.remove_repeats(clash), neardup.near_duplicates(clash)):
        assert n.count() == len(ROWS)
    assert tokens.pack_documents(clash).select("doc_id").distinct().count() == len({d for d, *_ in ROWS})
    pages = clash.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.lit("u")).withColumn("page", F.lit(1)).withColumn("first_page", F.lit(1))
    assert warc.read_archives(spark, warc.write_archives(pages)).count() == len(ROWS)


def test_stages_keep_what_their_operators_keep(spark):
    texts = [prose(i, 70) for i in range(12)]
    texts += [texts[0], texts[1] + " more", " ".join("$$$" for _ in range(80)), "too short", None]
    df = spark.createDataFrame([(i, t, "en", f"h{i % 2}", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda x: sorted(r.doc_id for r in x.collect())
    assert ids(hostrules.keep_good(df)) == ids(hostrules.judge(df).filter("kept"))
    assert ids(neardup.keep_first(df)) == ids(neardup.near_duplicates(df, 80).filter("kept"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    assert ids(toxicity.keep_ordinary(df, labels)) == ids(toxicity.rate_toxicity(df, labels).filter("predicted = 0"))


def test_near_dedup_loses_no_text_of_a_shared_id(spark):
    a, b = prose(61), prose(62)
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (None, a)], "doc_id long, text string")
    assert rows(neardup.keep_first(df)) == [(1, a), (5, b)]


def test_texts_of_one_id_all_link_in_any_order(spark):
    a, b = prose(61), prose(62)
    items = [(5, a), (5, b), (7, a + " more"), (8, b + " more")]
    for order in (items, items[::-1], items[1:] + items[:1], items[2:] + items[:2]):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        assert {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, 80).collect()} == {(5, 5, True), (7, 5, False), (8, 5, False)}
        assert rows(neardup.keep_first(df)) == [(5, a), (5, b)] or rows(neardup.keep_first(df)) == [(5, b), (5, a)]


def test_near_duplicates_with_shared_ids_are_the_plain_ones(spark):
    """Rows of one doc_id with different texts, near-copies among them, and rows that stand twice."""
    r = random.Random(4)
    base = [prose(200 + g, 40).split(" ") for g in range(5)]
    items = []
    for _ in range(90):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        items.append((r.randrange(45) + 1, " ".join(w + [f"t{r.randrange(3)}"])))
    items += r.sample(items, 9)
    items += [(100 + i, " ".join(prose(300 + i, 30).split(" "))) for i in range(5)] + [(100, "")]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.lower().split(" ") for _, t in items)]
    label = {i: i for i, _ in items}
    moved = True
    while moved:
        moved = False
        for (i, _), x in zip(items, sets):
            for (j, _), y in zip(items, sets):
                if x and label[j] < label[i] and 100 * len(x & y) >= 85 * len(x | y):
                    label[i], moved = label[j], True
    assert len({label[i] for i in label if i < 100}) > 1
    for seed in (1, 2):
        r.shuffle(items)
        df = spark.createDataFrame(items, "doc_id long, text string").repartition(seed * 3)
        assert sorted((x.doc_id, x.component_id) for x in neardup.near_duplicates(df).collect()) == sorted((i, label[i]) for i, _ in items)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_near_duplicates_recall(spark):
    """Queries: the rows whose id is divisible by 20, against all rows."""
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    sets = {}
    for r in table:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets[r["doc_id"]] = {hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))} if w else set()
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    links = [(q, d) for q in sets if q % 20 == 0 for d in sets if d != q and sets[q] and 100 * len(sets[q] & sets[d]) >= 85 * len(sets[q] | sets[d])]
    assert links and sum(found[q] == found[d] for q, d in links) / len(links) == 1.0


def plain_difference(word, counts, shared):
    """Sum over a word's bytes of the two classes' Kneser-Ney log-likelihoods, with dictionaries of byte strings."""
    order, edge = toxicity.ORDER, bytes([toxicity._EDGE])

    def lower(g):
        if not g:
            return 1 / 256
        own = {k: n for k, n in shared.items() if len(k) == len(g) and k[:-1] == g[:-1]}
        if g not in own:
            return 1 / 256
        total = sum(own.values())
        return max(own[g] - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * len(own) / total * lower(g[1:])

    padded, out = edge * (order - 1) + word + edge, 0.0
    for j in range(order - 1, len(padded)):
        g = padded[j - order + 1 : j + 1]
        context = [k for k in set(counts[0]) | set(counts[1]) if k[:-1] == g[:-1]]
        known = g in counts[0] or g in counts[1]
        logs = []
        for c in (0, 1):
            total = sum(counts[c].get(k, 0) for k in context)
            rest = sum(min(counts[c].get(k, 0), toxicity.CLASS_DISCOUNT) for k in context) / total if total else 1.0
            own = max(counts[c].get(g, 0) - toxicity.CLASS_DISCOUNT, 0) / total if total else 0.0
            logs.append(np.log(own + rest * lower(g[1:])) if known else np.log(rest))
        out += logs[1] - logs[0] if context else 0.0
    return out


def test_models_are_kneser_ney():
    r = random.Random(2)
    vocab = ["".join(r.choice("abc") for _ in range(r.randint(1, 6))).encode() for _ in range(40)]
    counts = [{}, {}]
    edge = bytes([toxicity._EDGE])
    for w in vocab[:30]:
        padded = edge * 5 + w + edge
        for j in range(5, len(padded)):
            g = padded[j - 5 : j + 1]
            c = counts[r.randrange(2)]
            c[g] = c.get(g, 0) + r.randint(1, 9)
    every = sorted(set(counts[0]) | set(counts[1]))
    longer = {(edge * 5 + w + edge)[j - 5 : j + 1] for w in vocab for j in range(5, len(w) + 6)}
    shared = {}
    for k in range(1, 6):
        for x in {g[5 - k :] for g in longer}:
            if x[1:-1] in {g[6 - k : 5] for g in every}:
                shared[x[1:]] = shared.get(x[1:], 0) + 1
    pack = lambda g: int.from_bytes(g, "big")
    keys = sorted((len(k) << 48 | pack(k), n) for k, n in shared.items())
    m = toxicity.Models(np.array([pack(g) for g in every], np.int64), np.array([counts[0].get(g, 0) for g in every]), np.array([counts[1].get(g, 0) for g in every]), np.array([k for k, _ in keys], np.uint64), np.array([n for _, n in keys], np.int64))
    for w in vocab:
        got = m.words(np.frombuffer(w + b" ", np.uint8), np.array([0]), np.array([len(w)]))[0]
        assert got == pytest.approx(plain_difference(w, counts, shared), abs=1e-4)


def test_ranking_minimises_the_pairwise_loss():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, len(pairwise.NAMES)))
    y = (x[:, 0] + 0.5 * x[:, 1] + r.normal(size=300) * 0.3 > 0).astype(int)
    rank = pairwise.Ranking(x, y, {0: int((y == 0).sum()), 1: int((y == 1).sum())}, 2000)
    z = rank._wide(x)
    rng = np.random.default_rng(7)
    i, j = rng.choice(np.flatnonzero(y == 1), 2000), rng.choice(np.flatnonzero(y == 0), 2000)

    def loss(w):  # Bradley-Terry: a good one is preferred with probability 1 / (1 + exp(-difference))
        return np.log1p(np.exp(-((z[i] - z[j]) @ w))).mean() + 0.5 * 1e-3 * (w @ w)

    best = loss(rank.w)
    assert all(loss(rank.w + d) > best for d in r.normal(size=(20, len(rank.w))) * 0.01)
    plain = np.array([sum(a * b for a, b in zip(row, rank.w)) for row in z])
    scores = rank.score(x)
    assert np.array_equal(np.argsort(scores, kind="stable")[-50:], np.argsort(plain, kind="stable")[-50:])
    assert np.array_equal(scores >= pairwise.THRESHOLD, plain >= rank.cut - 1e-12)


def test_quality_is_learnt_from_all_pairs(spark):
    """Weights and cut are those of a plain fit on every pair, whatever the partitions."""
    r = np.random.default_rng(5)
    x = r.normal(size=(150, len(pairwise.NAMES)))
    y = (x[:, 0] + 0.5 * x[:, 1] + r.normal(size=150) * 0.5 > 0.7).astype(int)
    df = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "label int, x array<double>")
    model, other = pairwise.Whole(df.repartition(5), 0.5), pairwise.Whole(df.coalesce(1), 0.5)
    assert model.w.tolist() == other.w.tolist() and (model.cut, model.slope, model.quantile) == (other.cut, other.slope, other.quantile)
    assert np.allclose(model.mean, x.mean(0), atol=1e-6) and np.allclose(model.std, x.std(0), atol=1e-5)
    z = model._wide(x)
    d = (z[y == 1][:, None] - z[y == 0]).reshape(-1, z.shape[1])
    plain = pairwise.logistic(np.concatenate((d, -d)), np.repeat([1.0, 0.0], len(d)), ridge=1e-3, intercept=False)[:-1]
    assert np.abs(model.w - plain).max() < 2e-3 * np.abs(plain).max()
    s = (z * model.w).sum(1)
    wrong = lambda cut: int(((s >= cut) != (y == 1)).sum())
    assert wrong(model.cut) == min(wrong(c) for c in [*s, np.inf]) and model.quantile == (s < model.cut).mean()


def test_quality_sums_are_a_row_for_each_task_and_key(spark, monkeypatch):
    """A step's rows are no more than the training rows, or the rows of a matrix for each task; not one for each number."""
    r = np.random.default_rng(11)
    x = r.normal(size=(150, len(pairwise.NAMES)))
    y = (x[:, 0] + r.normal(size=150) * 0.5 > 0.3).astype(int)
    df = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "label int, x array<double>").repartition(7).cache()
    monkeypatch.setattr(pairwise, "STEPS", 3)
    rows, group = [], type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *by: rows.append(self.count()) or group(self, *by))
    model = pairwise.Whole(df, 0.5)
    assert model.ok and len(rows) > 5 and max(rows) <= 7 * 2 * len(pairwise.NAMES)


def test_quality_leaves_no_training_row_out(spark, monkeypatch):
    """5200 rows of label 1, more than the bounded sample had, beside 40 of label 0."""
    seen = []

    class Seen(pairwise.Whole):
        def __init__(self, train, base):
            seen.append({x["label"]: x["count"] for x in train.groupBy("label").count().collect()})
            self.ok, self.base = False, base

    monkeypatch.setattr(pairwise, "Whole", Seen)
    df = spark.range(5240).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), (F.col("id") >= 40).cast("int").alias("quality"))
    assert pairwise.rank_quality(df.select("doc_id", "text"), df.select("doc_id", "quality")).count() == 5240
    kept = [i for i in range(5240) if zlib.crc32(str(i).encode()) % 5]
    assert seen == [{0: sum(i < 40 for i in kept), 1: sum(i >= 40 for i in kept)}]
    assert seen[0][1] > 4000
