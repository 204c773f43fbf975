"""Token alignment and collocations against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import align, phrases
from evidentia.llm.tokens import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "row_id a b a_ends b_ends cuts marks ga gb links pair count best most m salt words phrase f id k l r n rank score first rest inside block shard cells counts bits".split()


def tokens_of(text):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    back = {}
    code, extra = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)], 0
    for x in range(256):
        if x in code:
            back[chr(x)] = x
        else:
            back[chr(256 + extra)], extra = x, extra + 1
    x = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (x, y) if b"".join(p for _, p in x) == whole == b"".join(p for _, p in y) else ([], [])


def plain_alignment(texts):
    each = []
    for text in texts:
        x, y = tokens_of(text) if text else ([], [])
        ends = []
        for side in (x, y):
            at, out = 0, []
            for i, p in side:
                at += len(p)
                out.append((at, i))
            ends.append(out)
        a_at, b_at = dict(ends[0]), dict(ends[1])
        cuts = sorted(set(a_at) & set(b_at))
        groups = [tuple([i for e, i in side if lo < e <= hi] for side in ends) for lo, hi in zip([0, *cuts], cuts)]
        each.append((len(x), len(y), groups, [(a_at[c], b_at[c]) for c in cuts]))
    count = Counter(p for *_, links in each for p in links)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    for n_a, n_b, groups, links in each:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""


ODD = [None, "", " ", "  lead", "trail ", "a  b", "tab\tand\nlines\n\n", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "ﬁne É", "naïve café, Straße! 123,456", "日本語 と english", "é" * 300, "x" * 5000, "🙂🙃 　 wide", "a b", "́ mark", "it's we're I'll", "-- == ::", "1 2 3 4", "word " * 400]


def some_texts(n=150):
    r = random.Random(3)
    words = ["".join(r.choice("abcdeghinorstüé.,'") for _ in range(r.randint(1, 9))) for _ in range(200)]
    return ODD + [r.choice([" ", " ", "  ", "\n"]).join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(n)] + ["word one two"] * 5


def test_alignment_is_the_plain_one(spark):
    texts = some_texts()
    rows = [(i, x, "en", "s", 0) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC).repartition(3).select("*", *[F.lit(1).alias(c) for c in CLASH])
    got = {r[0]: tuple(r)[1:] for r in align.rated_links(df).collect()}
    assert got == dict(enumerate(plain_alignment(texts)))


def test_alignment_without_broadcast(spark, monkeypatch):
    texts = some_texts(30)
    df = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(texts)], DOC)
    want = sorted(map(tuple, align.rated_links(df).collect()))
    monkeypatch.setattr(align, "PAIR_ROWS", 3)
    assert sorted(map(tuple, align.rated_links(df).collect())) == want


def test_alignment_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "three"), (None, "one two"), (None, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in align.rated_links(df).select(F.coalesce("doc_id", F.lit(-1)), "n_links", "count_sum").collect())
    assert got == [(-1, 0, 0), (-1, 2, 6), (1, 1, 1), (1, 2, 6), (1, 2, 6)]
    assert align.rated_links(df.limit(0)).collect() == []


def plain_collocations(rows, least, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        many = {p: c for p, c in own.items() if c >= least and len(p) > 1}
        inside = set()
        for p, c in many.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and c >= many[p[i:j]]:
                        inside.add(p[i:j])
        best = []
        for p, a in many.items():
            if p not in inside:
                s, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), a, own[p[:k]], own[p[k:]], n[lang], s))
        for rank, b in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, b[2].decode(), *b[3:]))
    return sorted(out)


PHRASE_ROWS = (
    [("the quick Brown fox jumps. THE quick brown fox", "en"), ("a a a a a a b a a a", "en"), ("the\tquick  brown, fox", None), ("x" * 40 + " " + "é ü é ü " * 5, "de"), (None, "en"), ("", "fr"), (" ,.; ", "fr"), ("a b c d e f " * 9, "und"), ("  one two one two", "en"), ("a\nb\rc\x0bd", "en")] * 3
    + [(" ".join(random.Random(i).choice("a b c the of in on A, x. Of".split(" ")) for _ in range(60)), ("en", "de", None)[i % 3]) for i in range(60)]
)


@pytest.mark.parametrize("least", [2, 7, 300])
def test_collocations_are_the_plain_ones(spark, monkeypatch, least):
    monkeypatch.setattr(phrases, "CELLS", 1 << 16)
    monkeypatch.setattr(phrases, "CELLS_MOST", 1 << 16)
    monkeypatch.setattr(phrases, "AUTOMATON_CHARS", 900)
    df = spark.createDataFrame([(i, x, y, "s", 0) for i, (x, y) in enumerate(PHRASE_ROWS)], DOC).repartition(5).select("*", *[F.lit(1).alias(c) for c in CLASH])
    assert sorted(map(tuple, phrases.collocations(df, least).collect())) == plain_collocations(PHRASE_ROWS, least)


def test_collocations_top_and_empty(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CELLS", 1 << 16)
    df = spark.createDataFrame([(i, x, y, "s", 0) for i, (x, y) in enumerate(PHRASE_ROWS)], DOC)
    assert sorted(map(tuple, phrases.collocations(df, 5, longest=3, top=4).collect())) == plain_collocations(PHRASE_ROWS, 5, 3, 4)
    assert phrases.collocations(df.limit(0)).collect() == []
    assert phrases.collocations(df.withColumn("text", F.lit(None).cast("string"))).collect() == []


def test_hashes_tell_phrases_apart():
    texts = [x.encode() for x, _ in PHRASE_ROWS if x]
    w = phrases.Words(texts, ["en"] * len(texts))
    for k, (first, hashes) in enumerate(w.orders([np.full(8, 255, np.uint8)] * 4), 1):
        assert len(set(hashes.tolist())) == len({w.phrase(i, k) for i in first.tolist()})


def test_counts_of_many_candidates_take_one_pass(spark, monkeypatch):
    """Candidates of many times the characters a task holds: the texts are read once for each order and once to count."""
    monkeypatch.setattr(phrases, "CELLS", 1 << 16)
    monkeypatch.setattr(phrases, "CELLS_MOST", 1 << 16)
    monkeypatch.setattr(phrases, "AUTOMATON_CHARS", 200)
    passes = []
    read = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: (passes.append(schema), read(self, f, schema))[1])
    df = spark.createDataFrame([(i, x, y, "s", 0) for i, (x, y) in enumerate(PHRASE_ROWS)], DOC)
    counts, _ = phrases.phrase_counts(df, 2)
    assert sum("block" not in x for x in passes) == 1
    assert sum(len(r.phrase) for r in counts.collect()) > 5 * 200


def test_rows_of_the_counting_pass_do_not_grow_with_the_partitions(spark, monkeypatch):
    """Texts in 40 partitions: each phrase is named by TASKS tasks a core at most, and the counts are the plain ones."""
    monkeypatch.setattr(phrases, "CELLS", 1 << 16)
    monkeypatch.setattr(phrases, "CELLS_MOST", 1 << 16)
    passes = []
    read = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: (passes.append((read(self, f, schema), schema)), passes[-1][0])[1])
    df = spark.createDataFrame([(i, "one two one two", "en", "s", 0) for i in range(400)], DOC).repartition(40)
    counts, total = phrases.phrase_counts(df, 2)
    assert {(r.phrase, r.f) for r in counts.collect()} == {("one", 800), ("two", 800), ("one two", 800), ("two one", 400), ("one two one", 400), ("two one two", 400), ("one two one two", 400)}
    assert [tuple(r) for r in total.collect()] == [("en", 1600)]
    named = next(x for x, schema in passes if "block" not in schema).filter("phrase IS NOT NULL").count()
    assert named <= 7 * phrases.TASKS * spark.sparkContext.defaultParallelism


def test_groups_of_some_texts_at_once():
    """Texts without tokens lie between the others; a group ends where both sides' tokens do."""
    ids = [np.array([5, 6, 7, 65535]), np.array([1, 2, 3, 40])]
    ends = [np.array([2, 5, 7, 24]), np.array([5, 6, 7, 24])]
    count, links, digests = align._groups(align.Written(), ids, ends, np.array([9, 12, 30, 33]))
    want = [hashlib.sha256(x).hexdigest() for x in (b"5,6|1;7|2,3", b"65535|40")]
    assert count.tolist() == [2, 0, 1, 0] and digests == [want[0], "", want[1], ""]
    assert links.tolist() == [6 << 16 | 1, 7 << 16 | 3, 65535 << 16 | 40]
