import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.llm import flac, hostrules, neardup, pairwise, repeats, segments, tokens, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text, every):
    return " ".join("zz" + w if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


TEXTS = [prose(1), prose(1), edited(prose(1), 100), edited(prose(1), 40), prose(2), None, "", "one two", " lead  double  ", "é" * 70, "ab" * 200, prose(3) + "\n" + prose(2, 60) + "\n" + prose(2, 60), prose(4, 3000), prose(1)]
ROWS = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", "s0", 9), (None, prose(9), None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


CLASH = "key bands pid group _group kept n x label score _f _failed _t _w _n _b _k _p _s _q _l _row bad host _host text_md5 gone_id gone_md5 digest first ends ids part block start length offset held_out payload_digest lead rep band media bucket kind id body".split()


@pytest.fixture(scope="module")
def clash(docs):
    """The rows with columns whose names clash with those that operators make."""
    return docs.select("*", *[F.lit(1).alias(c) for c in CLASH])


def key(r):
    return tuple((v is not None, v) for v in r)


def rows(df):
    return sorted(map(tuple, df.collect()), key=key)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- WARC


def test_warc_round_trip(spark):
    big = "<p>" + "ü x\r\n\r\n" * 9000
    pages = [(1, "http://a", big), (2, None, big), (3, "u\r\nX: y", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (2, None, big), (None, "u", big), (7, "u", "z" * 16384)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = warc.write_archives(df, segment_bytes=1000)
    got = rows(warc.read_archives(spark, path))
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        last = max(q for q, _, g in pages if g == h and q is not None)
        revisit = len(raw) >= 1000 and sum(g == h for _, _, g in pages) > 1 and p != last
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    assert got == sorted(want, key=key)
    assert rows(warc.read_archives(spark, warc.write_archives(df.limit(0)))) == []


def test_chunked_framing():
    for n in (0, 1, 4096, 9999):
        raw = bytes(range(256)) * 40
        assert warc.dechunked(warc.chunked(raw[:n])) == raw[:n]
    for bad in (b"", b"5\r\nabc", b"zz\r\n\r\n", b"3\r\nabcXX0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_missing_segment_stops_the_job():
    import pyarrow as pa

    kinds = pa.schema(list(zip([x.split()[0] for x in warc._READ.split(", ")], warc._KINDS)))
    part = {"page_id": 1, "record_type": "response", "origin": "o", "segment": 2, "total": 5, "block": b"x"}
    with pytest.raises(ValueError, match="SEGMENTS"):
        warc._reassemble(pa.Table.from_pylist([part], schema=kinds))


# ---- host rules


def plain_rules(t):
    w = words(t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover)


def test_rules(spark):
    texts = ["a b c a b c", "a a a a", "a b", "", None, "x\nx\n \ny", "# b <é>", "a b c d a b c d e a b c " * 30, prose(1), "p q r " * 40]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in hostrules.judge(df).collect():
        n, chars, symbols, dup, rep = plain_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), r
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.kept and r.base_failed)


def test_host_is_closed_by_its_shrunk_rate(spark):
    flags = [("bad", True)] * 95 + [("bad", False)] * 5 + [("good", False)] * 98 + [("good", True)] * 2 + [("tiny", True)] + [(f"h{i}", i % 7 == 0) for i in range(40)] + [(None, False)] * 9
    got = {r.source: r for r in hostrules.host_verdicts(spark.createDataFrame(flags, "source string, failed boolean")).collect()}
    assert got["bad"].closed and not got["good"].closed and got["tiny"].shrunk_rate < 1


def test_rules_keep_columns(clash, empty):
    kept = hostrules.keep_good(clash)
    assert kept.columns == clash.columns and 0 < kept.count() < clash.count()
    assert hostrules.judge(empty).count() == 0 and hostrules.keep_good(empty).count() == 0


# ---- FLAC


def test_flac_round_trip():
    r = np.random.default_rng(1)
    payloads = [flac._padded(x) for x in (b"", b"a", b"hello " * 99, bytes(r.integers(0, 256, 5000, dtype=np.uint8)), bytes(64), b"abcdef" * 5000, "é漢字".encode() * 300, bytes(range(256)) * 40)]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    assert flac.decode([streams[2]]) == [payloads[2]] and flac.encode([payloads[2]])[0] == streams[2]
    start, offset = flac.seek(streams[5], 1000)
    assert start == 768 and streams[5][offset : offset + 2] == b"\xff\xf8"
    for at in (len(streams[3]) // 2, len(streams[3]) - 40):
        broken = bytearray(streams[3])
        broken[at] ^= 4
        with pytest.raises(ValueError, match="FLAC"):
            flac.decode([bytes(broken)])


def flac_stream(frames, total, channels, depth, md5=bytes(16), rate=8000):
    """A hand-made stream; frames: (size code, channel mode, sample size code, extra header bytes, [bit strings of the subframes])."""
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + ((rate << 44) | (channels - 1 << 41) | (depth - 1 << 36) | total).to_bytes(8, "big") + md5
    out = b"fLaC\x80" + len(info).to_bytes(3, "big") + info
    for number, (size_code, mode, depth_code, extra, subframes) in enumerate(frames):
        head = bytes([0xFF, 0xF8, size_code << 4, mode << 4 | depth_code << 1]) + bytes([number]) + extra
        head += bytes([_bitwise_crc(head, 0x07, 8)])
        body = "".join(subframes)
        body += "0" * (-len(body) % 8)
        frame = head + int(body, 2).to_bytes(len(body) // 8, "big")
        out += frame + _bitwise_crc(frame, 0x8005, 16).to_bytes(2, "big")
    return out


def _bitwise_crc(raw, poly, bits):
    x = 0
    for b in raw:
        x ^= b << (bits - 8)
        for _ in range(8):
            x = (x << 1 ^ poly if x >> (bits - 1) else x << 1) & ((1 << bits) - 1)
    return x


def field(x, n):
    return format(x & ((1 << n) - 1), f"0{n}b") if n else ""


def rice(values, k):
    u = [2 * x if x >= 0 else -2 * x - 1 for x in values]
    return "".join("0" * (x >> k) + "1" + field(x, k) for x in u)


def test_flac_decodes_all_kinds_of_frames():
    r = random.Random(4)
    x = [r.randint(-100, 100) for _ in range(16)]
    shape = lambda kind, wasted="0": "0" + field(kind, 6) + wasted
    plain = "".join(field(v, 8) for v in x)
    d = list(x)
    for _ in range(4):
        d = [d[0], *[b - a for a, b in zip(d, d[1:])]]
    fixed4 = shape(12) + "".join(field(v, 8) for v in x[:4]) + "00" + field(1, 4) + field(3, 4) + rice(d[4:8], 3) + field(15, 4) + field(12, 5) + "".join(field(v, 12) for v in d[8:])
    w, shift = [300, -150, 20, 7, -3, 1, 2, -9], 9
    res = [x[i] - (sum(w[j] * x[i - 1 - j] for j in range(8)) >> shift) for i in range(8, 16)]
    lpc8 = shape(39) + "".join(field(v, 8) for v in x[:8]) + field(11, 4) + field(shift, 5) + "".join(field(v, 12) for v in w) + "01" + field(0, 4) + field(2, 5) + rice(res, 2)
    size = (6, bytes([15]))
    frames = [(size[0], 0, 1, size[1], [s]) for s in (shape(1) + plain, fixed4, lpc8, shape(0) + field(-7, 8), shape(1, "1") + "001" + "".join(field(v >> 3, 5) for v in x))]
    samples, rate, depth = flac.decode_stream(flac_stream(frames, 80, 1, 8))
    assert samples[:, 0].tolist() == x * 3 + [-7] * 16 + [v >> 3 << 3 for v in x] and (rate, depth) == (8000, 8)
    y = [r.randint(-30000, 30000) for _ in range(16)]
    z = [r.randint(-30000, 30000) for _ in range(16)]
    verbatim = lambda v, n: shape(1) + "".join(field(q, n) for q in v)
    side = [a - b for a, b in zip(y, z)]
    stereo = [(6, 1, 4, size[1], [verbatim(y, 16), verbatim(z, 16)]), (6, 8, 4, size[1], [verbatim(y, 16), verbatim(side, 17)]), (6, 9, 4, size[1], [verbatim(side, 17), verbatim(z, 16)]), (6, 10, 4, size[1], [verbatim([(a + b) >> 1 for a, b in zip(y, z)], 16), verbatim(side, 17)])]
    pcm = np.array(list(zip(y, z)) * 4)
    good = flac_stream(stereo, 64, 2, 16, hashlib.md5(pcm.astype("<i2").tobytes()).digest())
    assert np.array_equal(flac.decode_stream(good)[0], pcm)
    for at in (60, len(good) - 1):
        broken = bytearray(good)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="FLAC"):
            flac.decode_stream(bytes(broken))
    # a foreign stream of bytes is a payload, too
    payload = bytes(range(97, 113))
    pcm8 = payload.translate(flac.TO_PCM)
    assert flac.decode([flac_stream([(6, 0, 1, bytes([15]), [shape(1) + "".join(field(v, 8) for v in pcm8)])], 16, 1, 8, hashlib.md5(pcm8).digest())]) == [payload]


def test_flac_own_streams_are_flac(monkeypatch):
    payloads = [flac._padded(prose(i, 200).encode()) for i in range(3)] + [bytes(64)]
    streams = flac.encode(payloads)
    for s, x in zip(streams, payloads):
        assert flac.decode_stream(s)[0][:, 0].astype(np.int8).tobytes() == x.translate(flac.TO_PCM)
    assert flac.tails(streams) == [x[-64:] for x in payloads]
    monkeypatch.setattr(flac, "CHUNK_BYTES", 600)  # below each text's length: coded in runs
    assert flac.encode(payloads) == streams and flac.decode(streams) == payloads and flac.tails(streams) == [x[-64:] for x in payloads]


def test_flac_query(docs, clash, empty):
    got = rows(flac.media_features(flac.write_media(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"))
    want = []
    for d, t, *_ in ROWS:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want, key=key)
    assert flac.write_media(clash).count() == len(ROWS) and flac.media_features(flac.write_media(empty)).count() == 0
    blocks = flac.read_blocks(flac.write_media(docs.filter("doc_id = 12"))).orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks).rstrip(b"\0").decode() == TEXTS[12]


# ---- repeats


def plain_repeats(items, n=50):
    order = lambda i: repeats.NO_ID if i is None else i
    least = {}
    for i, b in items:
        for s in range(len(b) - n + 1):
            w = b[s : s + n]
            least[w] = min(least.get(w, order(i)), order(i))
    out = []
    for i, b in items:
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if least[b[s : s + n]] < order(i):
                gone[s : s + n] = b"\1" * n
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("group_bytes", [2000, 10**9])
def test_repeats(docs, empty, monkeypatch, group_bytes):
    monkeypatch.setattr(repeats, "GROUP_BYTES", group_bytes)
    assert rows(repeats.remove_repeats(docs)) == plain_repeats([(d, (t or "").encode()) for d, t, *_ in ROWS])
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_random(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abc \0") for _ in range(60)) for _ in range(6)]
    items = [(i, "".join(r.choice(base)[r.randint(0, 9) :] if r.random() < 0.7 else r.choice("xy") * r.randint(1, 70) for _ in range(r.randint(1, 9)))) for i in range(60)]
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(4)
    assert rows(repeats.remove_repeats(df)) == plain_repeats([(i, t.encode()) for i, t in items])


def test_repeats_tell_rows_of_one_id_apart(spark, monkeypatch):
    a, b, c = prose(41), prose(42), prose(43)
    items = [(1, a), (5, a), (5, b), (6, b + a), (None, c), (None, a), (7, c), (5, a), (5, None)]
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    for chunk in (10**6, 130):  # the second is below every text's length
        monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
        assert rows(repeats.remove_repeats(df)) == plain_repeats([(d, (t or "").encode()) for d, t in items])


def test_long_texts_are_handled_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 700)
    base = prose(50, 900)
    items = [(1, base), (2, "x" + base[1:4000] + prose(51, 90) + base[200:]), (3, prose(52, 500) + base[650:760] + base[1380:1450])]
    df = spark.createDataFrame(items, "doc_id long, text string")
    assert rows(repeats.remove_repeats(df)) == plain_repeats([(d, t.encode()) for d, t in items])


def test_maximal_groups_are_maximal_and_whole(spark):
    r = random.Random(9)
    shared = ["".join(r.choice("abcd") for _ in range(n)) for n in (55, 62, 70)]
    items = [(i, r.choice("xyz") * r.randint(1, 3) + r.choice(shared)[r.randint(0, 4) :] + r.choice("uvw") + r.choice(shared)) for i in range(25)]
    texts = dict(items)
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    groups = {}
    for g in repeats.repeat_groups(df).collect():
        groups.setdefault(g.repeat, set()).add((g.doc_id, g.start, g.n_bytes))
    copies = {i for i, t in items if any(t == u and j < i for j, u in items)}
    covered = {i: bytearray(len(t)) for i, t in items}
    for own in groups.values():
        (n,) = {n for _, _, n in own}
        (what,) = {texts[d][s : s + n] for d, s, n in own}
        assert n >= 50
        # all occurrences of the string in texts that are no copies
        assert {(d, s) for d, s, _ in own} == {(d, s) for d, t in items if d not in copies for s in range(len(t)) if t.startswith(what, s)}
        for d, s, n in own:
            covered[d][s : s + n] = b"\1" * n
    windows = {}
    for d, t in items:
        for s in range(len(t) - 49) if d not in copies else ():
            windows.setdefault(t[s : s + 50], []).append((d, s))
    for places in windows.values():
        if len({d for d, _ in places}) > 1:
            assert all(all(covered[d][s : s + 50]) for d, s in places)


def test_repeats_text(clash):
    out = repeats.remove_repeats(clash, with_text=True)
    assert out.columns == clash.columns and out.count() == clash.count()
    assert {r.text for r in out.filter("doc_id IN (1, 13)").collect()} == {""}


# ---- near duplicates


def plain_groups(items, percent, width=5):
    sets = {}
    for i, t in items:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent, monkeypatch):
    monkeypatch.setattr(neardup, "STAR", 3)
    monkeypatch.setattr(neardup, "BLOCK_A", 2)
    monkeypatch.setattr(neardup, "BLOCK_B", 4)
    if percent == 80:
        for name, value in (("STAR_BYTES", 1500), ("BLOCK_A_SHINGLES", 150), ("BLOCK_B_SHINGLES", 300)):
            monkeypatch.setattr(neardup, name, value)
    r = random.Random(8)
    items = []
    for g in range(6):
        base = prose(100 + g, r.choice((4, 6, 30, 150))).split(" ")
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            items.append((len(items), " ".join(w)))
    items += [(len(items) + i, t) for i, t in enumerate((None, "", "A b", "a B", "  "))]
    want = plain_groups(items, percent)
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(df, percent).collect()}
    assert got == want


def test_near_duplicates_edges(docs, clash, empty):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[1] == by[2] == by[13] == 0 and by[5] == 5 and by[6] == 6
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_first(clash)
    assert kept.columns == clash.columns and {0, 4, 5, 6} <= {r.doc_id for r in kept.collect()}.difference({1, 2, 13})


def test_sketch_is_filled_and_estimates():
    a = np.unique(np.random.default_rng(0).integers(0, 2**63, 400, dtype=np.uint64))
    for n in (1, 2, 30, 400):
        s = neardup.sketch(a[:n], 240)
        assert (s < 2**64 - 1).all() and np.array_equal(s, neardup.sketch(a[:n][::-1], 240))
    near = np.mean(neardup.sketch(a[:360], 2400) == neardup.sketch(a[40:], 2400))
    assert abs(near - 0.8) < 0.05


# ---- tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def test_encoder_is_exact(tokenizer):
    texts = [t or "" for t in TEXTS] + ["a  b", " ", "a b ", "\n a\n\n b", " \n z", "it's  ok", "a\t b", "a,b. c,", "<|endoftext|> hi", "x  y", "1,000. 2."]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    enc = tokens.Encoder(tokens.tokenizer_path(), cache_pieces=50)
    for _ in range(2):
        assert enc.encode([t.encode() for t in texts]) == want


def test_encoder_is_exact_beside_other_white_space(tokenizer):
    texts = ["a \u00a0 \u00a0 b", "a\u00a0 \u00a0 \u00a0c d", "x \u2003 y \u3000 z", "p \n \n q", "p \u0085 q", "e\u00a0", "\u00a0e f", "\u00a0 e", "é à «b»", "r\u00a0s t\u00a0", "\u00a0r s"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    enc = tokens.Encoder(tokens.tokenizer_path())
    assert enc.encode([t.encode() for t in texts]) == want
    assert [tokens.Encoder(tokens.tokenizer_path()).encode([t.encode()])[0] for t in texts] == want
    assert enc._spaced([t.encode() for t in texts]) == {0, 1, 2, 3, 4, 7}


def test_queries_leave_the_tokenizer_as_loaded(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path())
    texts = ["a <|endoftext|> b", "a<|endoftext|>", "a <|endoftext| b", "x y"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0] and [np.frombuffer(x, "<u4").tolist() for x in tokens.encoder(tokens.tokenizer_path()).encode([t.encode() for t in texts])] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids_crc32 for r in tokens.read_boundaries(tokens.write_ids(df)).collect()}
    assert got == {i: crc([*ids, 0]) for i, ids in enumerate(want)}


def test_elias_fano():
    for values in ([], [0], [5], [0, 0, 7, 7, 10**9], sorted(rng.choices(range(10**6), k=777))):
        e = tokens.EliasFano.from_bytes(tokens.EliasFano.encode(np.array(values, np.int64)).to_bytes())
        assert [e.select(i) for i in range(len(values))] == values
        at = np.array(sorted(set(range(0, len(values), 3))), np.int64)
        assert e.select_many(at).tolist() == [values[i] for i in at] and len(e.samples) == -(-len(values) // 64)


def ids_of(tokenizer, t, end):
    return [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_id_files(docs, empty, tokenizer):
    got = tokens.read_boundaries(tokens.write_ids(docs, block_ids=500)).collect()
    assert sorted((key((r.doc_id,)), r.n_tokens, r.ids_crc32) for r in got) == sorted((key((d,)), len(x := ids_of(tokenizer, t, 0)), crc(x)) for d, t, *_ in ROWS)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda x: (x is not None, x or 0))
    assert tokens.read_boundaries(tokens.write_ids(empty)).count() == 0


def test_packing(clash, empty, tokenizer):
    got = tokens.pack_documents(clash, group_pieces=4, with_ids=True).collect()
    whole, seqs = {}, {}
    for r in got:
        assert crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == 4 * r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in got) == sum(len(ids_of(tokenizer, t, 1)) for _, t, *_ in ROWS)
    d12 = np.frombuffer(b"".join(x for _, x in sorted(whole[(12, len(ids_of(tokenizer, TEXTS[12], 1)))])), "<u4").tolist()
    assert d12 == ids_of(tokenizer, TEXTS[12], 1)
    assert tokens.pack_documents(empty).count() == 0


def test_first_fit_decreasing_is_first_fit():
    sizes = np.array([rng.randint(1, 100) for _ in range(300)])
    bins, offsets = tokens.first_fit_decreasing(sizes, 100)
    room = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, x in enumerate(room) if x >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        assert bins[i] == b and offsets[i] == 100 - room[b]
        room[b] -= sizes[i]


# ---- classifiers


def _labelled(spark):
    items = []
    for i in range(600):
        t = prose(1000 + i, 60)
        bad, toxic = i % 3 == 0, i % 4 == 0
        if toxic:
            t += " " + rng.choice(("vexugra", "vexumo", "vexulin"))
        if bad:
            t = " ".join(w + rng.choice(("###", "$$$")) for w in t.split(" "))
        items.append((i, t, int(not bad), int(toxic)))
    df = spark.createDataFrame(items, "doc_id long, text string, quality int, toxic int").repartition(3)
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic"), {i: (q, x) for i, _, q, x in items}


def test_classifiers(spark, clash, empty):
    docs, labels, truth = _labelled(spark)
    for k, rate in ((0, pairwise.rank_quality), (1, toxicity.rate_toxicity)):
        got = rate(docs, labels).collect()
        held = [r for r in got if r.held_out]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
        assert np.mean([r.predicted == truth[r.doc_id][k] for r in held]) > 0.9
        assert sorted(map(tuple, rate(docs.repartition(7), labels).collect())) == sorted(map(tuple, got))
        assert rate(clash, labels).count() == len(ROWS) and rate(empty, labels).count() == 0
        assert rate(docs, labels.limit(0)).count() == 600
    kept = toxicity.keep_ordinary(clash, labels)
    assert kept.columns == clash.columns


def test_shared_backoff_cancels():
    g = np.array([0x616161616161, 0x626262626262], np.int64)
    m = toxicity.Models(g, np.array([50, 0]), np.array([0, 50]), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    data = np.frombuffer(b"zzz ", np.uint8)
    assert m.words(data, np.array([0]), np.array([3])).tolist() == [0.0]


def test_shared_counts_cover_all_documents(spark):
    texts = ["the thin three", "THEN a théa; then", None, "", "zz thezz the", "the thin three"] + [prose(i, 40) for i in range(30)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOC).repartition(5)
    words = {w.lower() for t in texts for w in re.findall("[A-Za-zé]+", t or "")}
    padded = [b"\x01" * 6 + w.encode() + b"\x01" for w in words]
    grams = sorted({w[j - 5 : j + 1] for w in padded for j in range(6, len(w))})
    picked = np.array([int.from_bytes(g, "big") for g in grams[::7]], np.uint64)
    want = {}
    for k in range(1, 6):
        contexts = {g[6 - k : 5] for g in grams[::7]}
        for longer in {g[5 - k :] for g in grams}:
            if longer[1:-1] in contexts:
                key = k << 48 | int.from_bytes(longer[1:], "big")
                want[key] = want.get(key, 0) + 1
    keys, n = toxicity.shared_counts(docs, picked)
    assert dict(zip(keys.tolist(), n.tolist())) == want
    assert len(toxicity.shared_counts(docs.limit(0), picked)[0]) == 0


# ---- n-best pieces


def test_n_best_is_exact():
    p = segments.load(segments.model_path())
    for w in ("▁the", "▁théa", "▁Xq", "ing", "▁ab.", "aaaaaaa", "▁ababab"):
        w = w.encode()
        paths = {0: [(0, ())]}
        for j, row in enumerate(p.edges(w)):
            if j:
                paths[j] = [(c + d, q + (k,)) for i, k, d in row for c, q in paths[i]]
        want = sorted(paths[len(w)], key=lambda x: (x[0], x[1][::-1]))[:5]
        assert segments.n_best(w, p, 5) == [(c, list(q)) for c, q in want]
        m = np.frombuffer(w, np.uint8)[None, :]
        total, loss, _ = segments.best(np.ascontiguousarray(m), np.array([len(w)]), p)
        assert (total[0], loss[0]) == (want[0][0], want[1][0] - want[0][0])
        assert segments.decode(segments.n_best(w, p, 1)[0][1], p) == w.decode().replace("▁", " ").removeprefix(" ")


def test_segment(docs, clash, empty):
    got = segments.segment(clash).collect()
    assert {r.doc_id for r in got} == {d for d, *_ in ROWS} and segments.segment(empty).count() == 0
    by = sorted((r.rank, r.cost) for r in got if r.doc_id == 4)
    assert [x for x, _ in by] == [1, 2, 3] and by[0][1] <= by[1][1] <= by[2][1]
    short = {r.rank: r for r in got if r.doc_id == 7}
    assert short[1].n_words == 2 and short[2].cost > short[1].cost


def plain_n_best(text, p, n):
    """Best (cost, ids from the last) of the whole text's lattice, list by list."""
    raw = b" " + text.encode() if text else b""
    spelled = {b.replace(segments.MARK, b" "): i for b, i in p.ids.items()}
    rows = [[(0, ())]]
    for j in range(1, len(raw) + 1):
        edges = [(i, spelled[raw[i:j]], p.costs[raw[i:j].replace(b" ", segments.MARK)]) for i in range(max(0, j - 48), j) if raw[i:j] in spelled]
        if raw[j - 1] != 32:
            edges.append((j - 1, int(p.byte_ids[raw[j - 1]]), segments.BYTE_COST))
        rows.append(sorted((c + d, (k, *ids)) for i, k, d in edges for c, ids in rows[i])[:n])
    return rows[-1]


def segmented(spark, texts, n=3):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {}
    for r in segments.segment(df, n).collect():
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        out[r.doc_id, r.rank] = r.cost, r.ids
    return out


def test_segment_gives_whole_ids(spark):
    p = segments.load(segments.model_path())
    texts = ["one two three four five", "the cat and the cat and the cat", prose(11, 90), "a a a a a", "zq zq b b"]
    got = segmented(spark, texts)
    for i, t in enumerate(texts):
        want = plain_n_best(t, p, 3)
        assert [got[i, k] for k in (1, 2, 3)] == [(c, list(ids[::-1])) for c, ids in want]
        assert all(segments.decode(got[i, k][1], p) == t for k in (1, 2, 3))


def test_segment_does_not_cut_long_words(spark, monkeypatch):
    p = segments.load(segments.model_path())
    texts = ["数据处理系统需要在有限的内存中计算所有文档的最佳分词结果并且不能丢失任何内容。" * 3, "https://www.example.com/articles/2024/international/index.html?utm_source=newsletter&utm_medium=email&id=12345", "abcdefgh" * 40]
    for few in (1, 64):
        monkeypatch.setattr(segments, "FEW", few)
        segments._memory.clear()
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
        batches = df.toArrow().cast(pa.schema([("doc_id", pa.int64()), ("text", pa.string())])).to_batches()
        got = [r for b in segments._segment(segments.model_path(), 3)(batches) for r in b.to_pylist()]
        for i, t in enumerate(texts):
            assert [(r["cost"], tuple(r["ids"][::-1])) for r in got if r["doc_id"] == i] == plain_n_best(t, p, 3)


def test_segment_keeps_white_space(spark):
    p = segments.load(segments.model_path())
    texts = ["a b\nc", " a  b\tc\r\n\r\n", " ", "\n", "x" + " " * 40 + "y  ", "a▁b ▁ c", "if x:\r\n    y = 1;\r\n", "", "é\u00a0 \u00a0漢字"]
    got = segmented(spark, texts)
    for i, t in enumerate(texts):
        want = plain_n_best(t, p, 3)
        assert [(c, tuple(ids[::-1])) for (d, _), (c, ids) in sorted(got.items()) if d == i] == want
        assert all(segments.decode(ids, p) == t for (d, _), (_, ids) in got.items() if d == i)
    assert len({got[i, 1][1][0] for i in (0, 1)}) == 2 and got[0, 1][1] != segmented(spark, ["a b c"])[0, 1][1]


# ---- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels, _ = _labelled(spark)
    docs.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert len(corpus_pipeline.STAGES) == 5 and json.dumps([n for n, _ in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(out.columns)
    ids = {r.doc_id for r in out.collect()}
    assert 150 < len(ids) < 400 and all(i % 3 for i in ids)
