"""The other operators against brute force and exact round trips, with nulls, ties, repeats, empty tables and extra columns."""

import base64
import hashlib
import random
import time
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repograph.llm import jpeg, packing, pii, quality, secrets, setjoin, spm, vafile, warc

DOCS = "doc_id long, text string, source string, lang string, n_chars long, key long, node long"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, texts, ids=None, sources=None):
    """A documents table with columns whose names the operators use inside."""
    rows = [(ids[i] if ids else i, t, sources[i] if sources else f"s{i % 3}", "en", None, 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# -- 1 ---------------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 8).round(2)]) for i in range(300)]
    vectors += [(400, None), (450, [float("nan")] * 8), (500, [None] * 8), (550, [1.0, 2.0]), (551, [1.0, 0.5]), (None, [0.1] * 8), (150, vectors[7][1]), (301, vectors[7][1]), (302, vectors[7][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, score string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vafile.topk(df, F.col("vec_id") % 50 == 0, 5, bits=3).collect()}
    ints = [(i, np.floor(256 * np.asarray(v, np.float32).astype(np.float64)).astype(int)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q in sorted({i for i, _ in ints if i % 50 == 0}):
        own = min(tuple(v) for i, v in ints if i == q)
        best = sorted((-int(np.dot(own, v)), i) for i, v in ints if i != q and len(v) == len(own))[:5]
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    assert got == want


def plain_topk(vectors, k=5):
    ints = [(i, np.floor(256 * np.asarray(v, np.float32).astype(np.float64)).astype(int)) for i, v in vectors]
    return sorted((q, r + 1, i, -s) for q, v in ints if q % 50 == 0 for r, (s, i) in enumerate(sorted((-int(np.dot(v, w)), i) for i, w in ints if i != q)[:k]))


def test_topk_with_a_hot_group_of_copies_wide_values_and_many_query_blocks(spark):
    """A third of the rows are one vector; some components need 32 bits; ties cross tasks and query blocks."""
    rng = np.random.default_rng(5)
    hot = [float(x) for x in rng.normal(0, 0.3, 8)]
    vectors = [(i, hot if i % 3 == 0 else [float(x) for x in rng.normal(0, 500 if i % 7 == 0 else 0.3, 8)]) for i in range(900)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    for block in (4096, 4):
        got = sorted(tuple(r) for r in vafile.topk(df, F.col("vec_id") % 50 == 0, 5, query_block=block).collect())
        assert got == plain_topk(vectors)


def test_rows_that_the_file_keeps_of_equal_vectors():
    ids = np.array([9, 1, 1, 1, 7, 5, 3, 2, 4])
    same = np.ones((9, 4), np.int64)
    kept = vafile.needed(ids, same, 2)
    assert sorted(ids[kept]) == [1, 1, 2, 3]
    assert list(vafile.needed(ids, np.arange(36).reshape(9, 4), 1)) == list(range(9))
    assert len(vafile.needed(ids, np.empty((9, 0), np.int64), 1)) == 2


def test_topk_of_empty_tables_and_of_no_queries(spark):
    schema = "vec_id long, embedding array<float>, size int, ids string"
    for rows in ([], [(1, [0.5], 1, "a"), (2, [0.25], 1, "b")], [(50, None, 1, "a")]):
        assert vafile.topk(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0, 5).count() == 0
    few = vafile.topk(spark.createDataFrame([(50, [0.5], 1, "a"), (2, [], 1, "b"), (100, [], 1, "b"), (3, [0.25], 1, "c")], schema), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(map(tuple, few)) == [(50, 1, 3, 128 * 64), (100, 1, 2, 0)]


def test_topk_by_several_query_blocks_and_empty(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, vafile.topk(df, F.col("vec_id") % 50 == 0, 3).collect()))
    assert one == sorted(map(tuple, vafile.topk(df, F.col("vec_id") % 50 == 0, 3, query_block=2).collect()))
    assert vafile.topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# -- 2 ---------------------------------------------------------------------------------------

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


def base_pii(text):
    found = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(n) <= 19 and luhn(n), "phone": lambda: 9 <= len(n) <= 15}[kind]()
            found += [f"{kind}:{m.start()}:{m.end()}"] * ok
    return found


def test_pii_base_equals_brute_force(spark):
    rng = random.Random(3)
    bits = ["a@b.co", "_x@y.z", "a@b.co_x@y.z-", "1.2.3.4", "999.1.2.3.4", "1.2.3.4.5", "4111 1111 1111 1111", "4736962573099581-", "+1 (017) 555-7713", "+49 30 1234567", "+1+2 333 44 55 66", " ", "é", "😀", "\n", "..", "@", "-", "12", "0", "(415) 555-2671", "tel: "]
    texts = [None, "", "1.2.3.4 " * 3000, *["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(500)]]
    for r in pii.find(docs(spark, texts)).collect():
        base = base_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in base) for k in PII)
        assert set(base) <= set(r.spans.split(","))


def test_pii_empty(spark):
    assert pii.find(docs(spark, [])).count() == 0


def test_em_tells_reliable_labelers():
    counts = {(1, 1, 0, 0): 40, (-1, -1, 0, 0): 40, (1, -1, 1, 0): 5, (0, 0, 0, 0): 10}
    p = pii.em(counts)
    assert p[1, 1, 0, 0] > 0.9 > 0.1 > p[-1, -1, 0, 0]


# -- 4 ---------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    texts = [None, "", "a", "é" * 100, "x" * 64, "x" * 65, "\x00\xff" * 5000, "same", "same"]
    rows = {i: r for i, r in enumerate(sorted(jpeg.features(jpeg.to_media(docs(spark, texts))).collect(), key=lambda r: r.doc_id))}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (rows[i].n_bytes, rows[i].payload_bytes) == (len(data), len(payload))
        assert rows[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and rows[i].tail_crc32 == zlib.crc32(payload[-64:])
        media = jpeg.encode_payload(payload)
        assert rows[i].media_sha256 == hashlib.sha256(media).hexdigest() and rows[i].media_bytes == len(media)
    assert rows[7][1:] == rows[8][1:]
    assert jpeg.features(jpeg.to_media(docs(spark, []))).count() == 0


def plain_blocks(data):
    """The blocks of a one-component JPEG with restarts, read bit by bit."""
    tables, at, restart, total = {}, 2, 0, 0
    while data[at + 1] != 0xDA:
        body = data[at + 4 : at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")]
        if data[at + 1] == 0xC4:
            tables[body[0] >> 4] = {(n, code): s for s, code, n in jpeg.canonical(list(body[1:17]), list(body[17:]))}
        elif data[at + 1] == 0xDD:
            restart = int.from_bytes(body, "big")
        elif data[at + 1] == 0xC0:
            total = (int.from_bytes(body[1:3], "big") // 8) * (int.from_bytes(body[3:5], "big") // 8)
        at += len(body) + 4
    scan = data[at + 10 : -2]
    found = []
    for i, part in enumerate(re.split(rb"\xff[\xd0-\xd7]", scan)):
        bits = iter("".join(f"{x:08b}" for x in part.replace(b"\xff\x00", b"\xff")))

        def symbol(table):
            code = n = 0
            while (n, code) not in table:
                code, n = code * 2 + int(next(bits)), n + 1
            return table[n, code]

        def value(size):
            got = int("".join(next(bits) for _ in range(size)) or "0", 2)
            return got if not size or got >> (size - 1) else got - (1 << size) + 1

        before = 0
        for _ in range(min(restart, total - i * restart)):
            block, k = [0] * 64, 1
            before += value(symbol(tables[0]))
            block[0] = before
            while k < 64:
                got = symbol(tables[1])
                if got == 0:
                    break
                k += got >> 4
                block[k] = value(got & 15)
                k += 1
            found.append(block)
    return found


def mixed_payload(rng, blocks):
    """Bytes with zero runs of every length, bytes of ones and text."""
    out = b"".join(rng.choice([bytes(rng.randrange(70)), rng.randbytes(rng.randrange(1, 9)), b"plain words 12", b"\xff" * 5, b"\x80\x01"]) for _ in range(12 * blocks))
    return out[: 64 * blocks].ljust(64 * blocks, b"\0")


def test_jpeg_agrees_with_a_plain_decoder():
    rng = random.Random(2)
    payloads = [mixed_payload(rng, n) for n in (1, 2, 7, 8, 9, 30, 100)] + [bytes(64 * 3), b"\xff" * 64, rng.randbytes(64 * 20)]
    files = jpeg.encode_many(payloads)
    assert files == [jpeg.encode_payload(p) for p in payloads]
    for payload, data, image in zip(payloads, files, jpeg.decode_many(files)):
        assert plain_blocks(data) == image.components[0].blocks.tolist()
        assert jpeg.stored_payload(image) == payload


def test_intervals_side_by_side_agree_with_one_by_one(monkeypatch):
    payload = mixed_payload(random.Random(3), 3000)
    data = jpeg.encode_payload(payload)
    fast = jpeg.decode(data).components[0].blocks
    monkeypatch.setattr(jpeg, "SLICE_BYTES", 5000)
    sliced = jpeg.decode(data).components[0].blocks
    monkeypatch.setattr(jpeg, "LANES", 1 << 40)
    slow = jpeg.decode(data).components[0].blocks
    assert (fast == slow).all() and (sliced == slow).all()


def test_damaged_jpegs_raise():
    data = jpeg.encode_payload(random.Random(4).randbytes(64 * 200))
    at = data.index(b"\xff\xd3")
    for bad in (b"x" + data[1:], data[:at] + data[at + 2 :], data[: data.index(b"\xff\xda") + 40] + b"\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.decode(bad)


def test_media_of_a_very_long_text(spark):
    text = "Wörter und 漢字 0123\n" * 1_000_000
    row = jpeg.features(jpeg.to_media(docs(spark, [text, "short"], ids=[1, 2]))).where("doc_id = 1").first()
    data = text.encode()
    payload = data + bytes(-len(data) % 64)
    assert (row.n_bytes, row.payload_bytes, row.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())


def bits_to_scan(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def test_decoder_with_runs_subsampling_and_restarts():
    """Three components (2x2, 1x1, 1x1), a restart after each MCU, zero runs and end-of-block codes."""
    counts = [0, 4, 0, 0, *[0] * 12]
    dc, ac = [0, 3, 5, 7], [0x00, 0x02, 0xF0, 0x11]
    code = {s: format(i, "02b") for i, s in enumerate(dc)}, {s: format(i, "02b") for i, s in enumerate(ac)}

    def value(v, size):
        return format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    luma = code[0][5] + value(17, 5) + code[1][0x02] + value(-3, 2) + code[1][0xF0] + code[1][0x11] + "1" + code[1][0x00]
    flat = code[0][0] + code[1][0x00]
    mcu = luma + flat * 3 + code[0][3] + value(-5, 3) + code[1][0x00] + flat
    scan = bits_to_scan(mcu) + b"\xff\xd0" + bits_to_scan(mcu)
    head = b"\xff\xd8" + jpeg.segment(0xDB, bytes([0, *[2] * 64])) + jpeg.segment(0xC0, bytes([8, 0, 16, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += b"".join(jpeg.segment(0xC4, bytes([k << 4, *counts, *s])) for k, s in ((0, dc), (1, ac))) + jpeg.segment(0xDD, b"\x00\x01")
    data = head + jpeg.segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    image = jpeg.decode(data)
    y = image.components[0].blocks
    assert (y[0][0], y[0][1], y[0][18 + 1]) == (17, -3, 1) and image.components[1].blocks[1][0] == -5
    assert jpeg.thumbnail(image).shape == (2, 4) and jpeg.thumbnail(image)[0][0] == 128 + (17 * 2 + 4) // 8
    for other in jpeg.decode_many([data] * 20):  # so many that they are decoded side by side
        assert all((a.blocks == b.blocks).all() for a, b in zip(image.components, other.components))


# -- 5 ---------------------------------------------------------------------------------------


def plain_shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


def plain_components(texts, width, num, den):
    sets = [plain_shingles(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def near_texts(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = [None, "", " \n\t", "One two", "one TWO", "one", passage, passage.upper()]
    seeds = [rng.choices(vocabulary, k=rng.choice([5, 12, 40, 90, 300])) for _ in range(12)]
    while len(texts) < n:
        words = list(rng.choice(seeds))
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            words += passage.split()
        texts.append(" ".join(words))
    return texts


def test_join_equals_brute_force(spark):
    texts = near_texts(1)
    for width, num, den in ((3, 90, 100), (5, 80, 100)):
        got = sorted(map(tuple, setjoin.join(docs(spark, texts), setjoin.Rule(width, num, den)).collect()))
        assert got == plain_components(texts, width, num, den)


def test_join_by_tiles_alone(spark, monkeypatch):
    """With heaps and stars from two rows on and tiny tiles, the tiles find every other link."""
    monkeypatch.setattr(setjoin, "TILE", 4)
    monkeypatch.setattr(setjoin, "SMALL", 1)
    monkeypatch.setattr(setjoin, "HEAP", 1)
    texts = near_texts(2, 90)
    got = sorted(map(tuple, setjoin.join(docs(spark, texts), setjoin.Rule(3, 80, 100)).collect()))
    assert got == plain_components(texts, 3, 80, 100)


def test_join_null_ids_and_empty(spark):
    got = setjoin.join(docs(spark, ["a b c d", "a b c d", "a b c d", "x"], ids=[7, None, 9, 3])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(7, 2, 7), (None, 2, None), (9, 2, 7), (3, 1, 3)}
    assert setjoin.join(docs(spark, [])).count() == 0


def test_join_rows_of_one_id_link_each_by_its_own_text(spark):
    """Two texts under one id: each row has the links of its text."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = setjoin.join(docs(spark, [one, two, two + " end", one + " end", one], ids=[5, 5, 8, 9, 3])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 5), (8, 5), (9, 3)]


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (30, 40), (300, 2000), (2000, 2100)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for shared in (0, n // 2, n):
            b = np.unique(np.r_[a[:shared], rng.integers(0, 1 << 63, m - shared if m > shared else 0, dtype=np.uint64)])
            assert setjoin.overlap_bound(setjoin.bitmap(a), setjoin.bitmap(b), len(a) + len(b)) >= setjoin.overlap(a, b)


def test_parts_meet_for_every_allowed_difference():
    rng = np.random.default_rng(1)
    for rule in (setjoin.Rule(3, 90, 100), setjoin.Rule(5, 80, 100)):
        for n in (1, 2, 9, 10, 11, 19, 30, 100, 450):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for extra in range(n // 3 + 1):
                b = np.unique(np.r_[a, rng.integers(0, 1 << 63, extra, dtype=np.uint64)])
                if rule.den * len(a) >= rule.num * len(b):
                    assert set(setjoin.part_keys(a, rule)) & set(setjoin.part_keys(b, rule)), (rule, n, extra)


# -- 6 ---------------------------------------------------------------------------------------


def check_packing(spark, texts, sources, sequence, window):
    library = Tokenizer.from_file(BPE)
    rows = packing.pack(docs(spark, texts, sources=sources).repartition(3), BPE, sequence, window).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    full = []
    for k in range(len(by_sequence)):
        at = 0
        for r in sorted(by_sequence[k], key=lambda r: r.offset):
            assert r.offset == at
            at += r["length"]
        full.append(at)
    assert all(x == sequence for x in full[:-1]) and 0 < full[-1] <= sequence
    return rows


def test_packing_places_every_token_once(spark):
    rng = random.Random(5)
    texts = [None, "", *["word " * rng.randint(1, 80) for _ in range(60)], "<|endoftext|> x"]
    sources = [rng.choice(["a", "a", "a", "b", None]) for _ in texts]
    rows = check_packing(spark, texts, sources, 64, 4)
    share = defaultdict(lambda: defaultdict(int))
    for r in rows:
        share[r.sequence_id // 4][sources[r.doc_id]] += r["length"]
    whole = defaultdict(int)
    for w in share.values():
        for s, n in w.items():
            whole[s] += n
    for k, w in share.items():
        if sum(w.values()) == 256:
            for s, n in whole.items():
                assert abs(w[s] - 256 * n / sum(whole.values())) <= 2


def one_by_one(totals, weights):
    """Which queue each token comes from: the live queue that is owed most, served one token at a time, phase by phase."""
    rest, order = list(totals), []
    while any(rest):
        live = [w if r else 0 for w, r in zip(weights, rest)]
        live, given = (live, [0] * len(rest)) if any(live) else (list(rest), [0] * len(rest))
        while True:
            q = min((q for q in range(len(rest)) if live[q]), key=lambda q: (Fraction(2 * given[q] + 1, 2 * live[q]), q), default=None)
            if q is None or not rest[q]:
                break
            given[q] += 1
            rest[q] -= 1
            order.append(q)
    return order


def test_packing_to_targets_equals_one_token_at_a_time():
    rng = random.Random(3)
    for _ in range(30):
        totals = [rng.randint(0, 60) for _ in range(rng.randint(1, 5))]
        weights = [rng.choice([0, 1, 2, 7]) for _ in totals]
        order = one_by_one(totals, weights)
        layout = packing.Layout(totals, 4, 2, weights)
        for i in range(len(order) // 8 + 2):
            assert layout.before(i) == [order[: 8 * i].count(q) for q in range(len(totals))]
        spots = sorted(spot + k for q, n in enumerate(totals) if n for _, length, spot in layout.pieces(q, 0, n) for k in range(length))
        assert spots == list(range(len(order)))


def test_packing_to_targets(spark):
    texts, sources = ["word " * 30 for _ in range(90)], [["a", "b", None][i % 3] for i in range(90)]
    rows = packing.pack(docs(spark, texts, sources=sources), BPE, 64, 2, targets={"a": 3, None: 1}).collect()
    spots = sorted((r.sequence_id * 64 + r.offset, r["length"], sources[r.doc_id]) for r in rows)
    assert [s for s, _, _ in spots] == [sum(n for _, n, _ in spots[:i]) for i in range(len(spots))]
    first = [(n, q) for s, n, q in spots if s < 128]
    assert sum(n for n, q in first if q == "a") == 96 and not [q for _, q in first if q == "b"]


def test_many_sources_keep_their_shares(monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 4)
    totals = {f"={i}": 40 + 10 * (i % 5) for i in range(30)}
    mixture = packing.Mixture(totals, 16, 20)
    spots = sorted((place, n, q) for q, t in totals.items() for _, n, place in mixture.pieces(q, 0, t))
    assert [s for s, _, _ in spots] == [sum(n for _, n, _ in spots[:i]) for i in range(len(spots))]
    for window in range(sum(totals.values()) // 320):
        for q, t in totals.items():
            held = sum(min(s + n, 320 * window + 320) - max(s, 320 * window) for s, n, x in spots if x == q and s < 320 * window + 320 and s + n > 320 * window)
            assert abs(held - t * 320 / sum(totals.values())) <= 3


def test_packing_empty(spark):
    assert packing.pack(docs(spark, []), BPE).count() == 0


def test_served_equals_one_token_at_a_time():
    totals = [7, 1, 22, 13]
    keys = sorted((Fraction(2 * j + 1, 2 * t), q) for q, t in enumerate(totals) for j in range(t))
    given = [0] * len(totals)
    for taken in range(sum(totals) + 1):
        assert packing.served(taken, totals) == given
        if taken < len(keys):
            given[keys[taken][1]] += 1


# -- 7 ---------------------------------------------------------------------------------------


def test_quality_learns_and_keeps_labels_out(spark):
    rng = random.Random(8)
    words = ["the", "house", "runs", "green", "over", "small", "river", "and"]
    good = [" ".join(rng.choices(words, k=40)) + "." for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(words, k=40)) for _ in range(60)]
    texts = good + bad + [None, ""]
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)] + [(None, 1, 0), (3, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.classify(docs(spark, texts), labels).collect()}
    held = [i for i in range(180) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in range(180) if rows[i].held_out] == held
    assert all(rows[i].predicted == int(i < 120) for i in held) and all(0 <= r.score <= 1 for r in rows.values())
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.classify(docs(spark, texts), flipped).collect()} == {i: r.score for i, r in rows.items()}


def plain_margin(rows, labels):
    """Weights of all indicators and bias of the classifier by definition: dictionaries of counts, projected gradient on the dual."""
    total, counts = [0, 0], [defaultdict(int), defaultdict(int)]
    for row, label in zip(rows, labels):
        for f in row:
            counts[label][f] += 1
            total[label] += 1
    ratio = lambda f: np.log((counts[1][f] + 1) / (total[1] + quality_size)) - np.log((counts[0][f] + 1) / (total[0] + quality_size))
    used = sorted({f for row in rows for f in row})
    place = {f: i for i, f in enumerate(used)}
    x = np.zeros((len(rows), len(used) + 1))
    for i, row in enumerate(rows):
        for f in row:
            x[i, place[f]] = ratio(f) / np.sqrt(max(1, len(row)))
        x[i, -1] = 1
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    gram = (x @ x.T) * np.outer(y, y)
    alpha, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(40_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, cost)
    w = x.T @ (alpha * y)
    return {f: w[place[f]] * ratio(f) for f in used}, w[-1], alpha.sum() - alpha @ gram @ alpha / 2


quality_size = 1 << quality.BITS


def test_quality_model_equals_a_plain_one():
    """The trained margins are those of the dual's optimum, found by another solver; words overlap, so some costs bind."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    texts, labels = [], []
    for i in range(60):
        labels.append(int(i % 3 > 0))
        texts.append(" ".join(rng.choices(words[: 22 if labels[-1] else 30] + ["Z!"] * (not labels[-1]), k=rng.randint(1, 12))))
    rows = [quality.features(t, quality.BITS) for t in texts]
    weights, bias, best = plain_margin([r.tolist() for r in rows], labels)
    model = quality.train(rows, np.array(labels))
    want = [sum(weights[f] for f in r.tolist()) / np.sqrt(max(1, len(r))) + bias for r in rows]
    assert np.allclose([model.margin(r) for r in rows], want, atol=2e-2)
    assert any((2 * y - 1) * m < 1 - 1e-3 for y, m in zip(labels, want))
    # The dual's value at the solver's own result is the primal's: no gap.
    ratios = quality.log_count_ratios(rows, np.array(labels), quality_size)
    values = [ratios[r] / np.sqrt(max(1, len(r))) for r in rows]
    signs = np.where(np.array(labels) == 1, 1.0, -1.0)
    cost = np.where(signs > 0, len(labels) / (2 * sum(labels)), len(labels) / (2 * (len(labels) - sum(labels))))
    w, b = quality.dual_coordinate_descent(rows, values, signs, quality_size, cost, rounds=3000, tolerance=1e-9)
    primal = (w @ w + b * b) / 2 + sum(c * max(0.0, 1 - y * (w[r] @ v + b)) for c, y, r, v in zip(cost, signs, rows, values))
    assert abs(primal - best) < 1e-3 * max(1, abs(best))


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.classify(docs(spark, ["a", None]), none).collect()] == [0.5, 0.5]
    assert quality.classify(docs(spark, []), none).count() == 0


# -- 8 ---------------------------------------------------------------------------------------


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(2)
    bits = [" ", "  ", "\n", "the", "The", "ing", "日本", "😀", "é", "zzzzq", "0", "    ", "▁", "\x00", "aaaaaaa", "th", "er"]
    texts = [None, "", " ", "x" * 500, "ab" * 400, *["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(400)]]
    df = docs(spark, texts)
    encoded = spm.encode(df, PIECES).cache()
    for r in encoded.collect():
        assert r.ids == library.encode(texts[r.doc_id] or "")
    for r in spm.decode(encoded, PIECES).collect():
        assert r.text == (texts[r.doc_id] or "").replace("▁", " ")
    assert all(r.round_trip for r in spm.digest(df, PIECES).collect()) and spm.digest(docs(spark, []), PIECES).count() == 0


def test_streaming_commits_in_a_bounded_window():
    m = spm.Model(PIECES)
    text = "▁" + "".join(random.Random(1).choices("abcdefghijklmnoprstu", k=3000))
    first = next(iter(m.stream(iter(text[:200]))))
    assert text.startswith(first) and list(m.stream(text)) == m.merged(text)


def test_streaming_of_a_word_of_megabytes():
    """The window stays small whatever the length: what is taken in beyond the ids given out is bounded."""
    import sentencepiece

    m = spm.Model(PIECES)
    rng, taken, given, most = random.Random(4), 0, 0, 0
    word = "▁" + "".join(rng.choices("abcdefghijklmnoprstu日é😀", k=1_500_000))

    def chunks():
        nonlocal taken
        for i in range(0, len(word), 100):
            taken += 100
            yield word[i : i + 100]

    for piece in m.stream(chunks()):
        most = max(most, taken - given)
        given += len(piece)
    assert given == len(word) and most < 100 + 8 * m.longest
    assert m.encode(word[1:]) == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(word[1:])


def test_unigram_pass_finds_the_best_sum():
    """Of all ways to cut a text into pieces the pass finds one of the largest sum."""
    m = spm.Model(PIECES)
    rng = random.Random(6)
    m.normal = {p: i for i, p in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bb"])}
    m.pieces, m.scores, m.bpe = list(m.normal), [-rng.random() * len(p) ** 0.5 for p in m.normal], False
    m.longest, m.least = 3, -10.0
    m.endings = {p[i:]: -1 for p in m.normal for i in range(len(p))} | m.normal

    def best(text):
        sums = [0.0]
        for n in range(1, len(text) + 1):
            sums.append(max(sums[b] + (m.scores[m.normal[text[b:n]]] if text[b:n] in m.normal else -10.0) for b in range(max(0, n - 3), n) if text[b:n] in m.normal or n - b == 1))
        return sums[-1]

    for _ in range(100):
        text = "".join(rng.choices("abcx", k=rng.randint(1, 60)))
        pieces = list(m.stream([text]))
        assert "".join(pieces) == text
        assert abs(sum(m.scores[m.normal[p]] if p in m.normal else -10.0 for p in pieces) - best(text)) < 1e-9


# -- 9 ---------------------------------------------------------------------------------------


def base_secrets(text):
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return [f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], order.index(s[0])))]


def test_secrets_equal_brute_force(spark):
    rng = random.Random(6)
    bits = ["token", "TOKEN", "ſecret", "api_key", "apikey", " ", "=", ": ", '"', "'", "AKIA" + "B2" * 8, "AKIAAKIA", "deadbeef" * 3, "abc", "0f" * 11, "é", "Zk3v9Qw1LmX8tB2yRcN7", "thequickbrownfoxjumps", "\n"]
    texts = [None, "", *["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(600)]]
    for r in secrets.scan(docs(spark, texts)).collect():
        base = base_secrets(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(","))
    assert secrets.scan(docs(spark, [])).count() == 0


def test_markov_tells_random_from_ordinary():
    model = secrets.default_model()
    fresh = secrets.labelled_samples(500, seed=99)
    hit = [secrets.looks_random(t, model, 0.6, 15.0) for t, label in fresh if label]
    assert sum(hit) / len(hit) > 0.95 and not any(secrets.looks_random(t, model, 0.6, 15.0) for t, label in fresh if not label)


def test_redaction_leaves_no_secret(spark):
    text = "a token = deadbeefdeadbeefdeadbeef and Zk3v9Qw1LmX8tB2yRcN7 end"
    rows = secrets.redact(docs(spark, [text, None, "clean"])).orderBy("doc_id").collect()
    assert rows[0].text == "a [SECRET] and [SECRET] end" and rows[0].n_chars == len(rows[0].text)
    assert rows[1].text is None and rows[2].text == "clean"


# -- 10 --------------------------------------------------------------------------------------


def test_warc_round_trip_at_any_split(spark):
    rng = random.Random(7)
    html = [None, "", "<p>x</p>", "<p>x</p>", "é" * 5000, *["".join(rng.choices("abc<>é ", k=rng.randint(0, 4000))) for _ in range(60)]]
    pages = spark.createDataFrame([(i, None if i % 3 else f"http://h/{i}\r\nx", h, "clash") for i, h in enumerate(html)] + [(3, "u", "<p>x</p>", "again")], "page_id long, url string, html string, payload string").repartition(2)
    wanted = []
    rows = [*enumerate(html), (3, html[3])]
    for i, h in rows:
        first = max(j for j, x in rows if (x or "") == (h or ""))
        data = (h or "").encode()
        wanted.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    for split in (97, 1000, 1 << 20):
        got = warc.archive(pages, split_bytes=split).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_ignores_chance_magic():
    import io

    record = warc.record(1, "u", b"payload", warc.digest32(b"payload"), None, False)
    data = warc.MAGIC + b"junk" + record + warc.MAGIC * 3 + record
    assert [warc.parse(r)[1] for r in warc.members(io.BytesIO(data), 0, len(data))] == [b"payload"] * 2


def test_words_that_a_polynomial_hash_confuses(spark):
    """Thue-Morse words collide under any polynomial hash modulo 2**64; they share nothing."""
    word = lambda bits, letters: "".join(letters[bin(i).count("1") & 1] for i in range(1 << bits))
    texts = [word(bits, letters) for bits in (5, 6, 10, 11) for letters in ("ab", "ba")]
    assert len({tuple(setjoin.shingles(t, 3)) for t in texts}) == len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in setjoin.join(df).collect()} == {(i, i) for i in range(len(texts))}
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 90))) for _ in range(5000)}
    assert len(setjoin.shingles(" ".join(words), 1)) == len(words)


def test_labelled_rows_that_repeat_an_id(spark):
    """However often an id repeats, at most ``sample`` rows of features come to the driver."""
    docs = spark.createDataFrame([(7, f"good words number {i % 50}") for i in range(3000)] + [(i, f"text {i}") for i in range(20, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0)] + [(i, i % 2) for i in range(20, 60)], "doc_id long, quality int")
    seen = []
    train, quality.train = quality.train, lambda rows, *more: seen.append(len(rows)) or train(rows, *more)
    try:
        quality.fit(docs, labels, sample=10)
    finally:
        quality.train = train
    assert seen and max(seen) <= 10


def test_queries_that_repeat_an_id(spark):
    """Copies of a query's id are one query, the least vector, before anything comes to the driver."""
    rows = [(50, [0.25 * (i % 7), 0.5]) for i in range(600)] + [(50, [float("nan"), 1.0]), (50, [1.0, 2.0, 3.0])] + [(i, [i / 100, 0.1]) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [r for r in vafile.topk(df, F.col("vec_id") % 50 == 0, k=3, query_block=100).collect() if r.query_id == 50]
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 1), (2, 2), (3, 3)]  # [0, 0.5]: all score alike


def test_many_sources_cost_no_more(spark):
    """The layout of 2000 sources is found in about the time of 20, and a source's tokens stay in order."""
    took = {}
    for n in (20, 2000):
        totals = {f"={i}": 2_000_000 // n for i in range(n)}
        began = time.perf_counter()
        mixture = packing.Mixture(totals, 1024, max(64, n))
        pieces = [p for i in range(0, n, n // 20) for p in mixture.pieces(f"={i}", 0, 1000)]
        took[n] = time.perf_counter() - began
        assert sum(p[1] for p in pieces) == 20_000 and len(pieces) <= 60
    assert took[2000] < 2 * took[20] + 1.0
