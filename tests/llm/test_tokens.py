import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from evisite.llm import packing, tokenfile
from evisite.llm.tokens import Encoder

ODD = ["", None, "a  b", " lead", "trail ", "a\tb c", "don't we'll I'M", "naïve café", "Ωμέγα ΣΑΣ σας", "日本語 text", "x\x1cy z", "a\n\nb \n c\r\nd"]
ODD += ["<|endoftext|> a", "x<|endoftext|><|EndOfText|> y<|startoftext|>", "a <|endof text|> b", "<|endoftext|>", "É<|endoftext|>  \t日", "é combined", "\xa0nb\xa0 sp", "!!\x1c!! a", "a   b    c", "''s 'ssss 'S", "ǅ İ ß ẞ", "\x85 a\x85b", "1²3½", "  ", "\n", "a\x00 b\x00c", "word " * 9000]


def test_slices():
    rows = ["é" * k + " word, Ü" for k in range(50)]
    e = Encoder(public_tokenizers.path("word_bpe_49k.json"), True)
    flat, counts = e.encode(pa.array(rows).slice(20, 20))
    assert flat.tolist() == [i for r in rows[20:40] for i in plain("word_bpe_49k.json", r)]
    assert len(counts) == 20


def plain(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,lower", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_library(name, lower):
    e = Encoder(public_tokenizers.path(name), lower, keep=5)
    for _ in range(2):
        flat, counts = e.encode(pa.array(ODD))
        ends = np.cumsum(counts)
        for text, a, b in zip(ODD, ends - counts, ends):
            assert flat[a:b].tolist() == plain(name, text), text


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(0, 900, n)).astype(np.uint32)
    index, payload = tokenfile.pack_blocks(ids)
    assert (tokenfile.unpack_blocks(index, payload, n, -(-n // 256)) == ids).all()


def test_token_files(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (None, "no id")]
    rows = rows[::-1]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("start", __import__("pyspark").sql.functions.lit("x"))
    got = tokenfile.read_files(tokenfile.write_files(docs, public_tokenizers.path("word_bpe_49k.json"))).collect()
    want = []
    for i, t in rows:
        ids = np.array(plain("word_bpe_49k.json", t) + [1], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    got = sorted(got, key=lambda r: r.start)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    assert tokenfile.read_files(tokenfile.write_files(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"))).count() == 0


def check_pieces(rows, texts, length):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for d, pieces in by_doc.items():
        ids, at = np.array(plain("byte_bpe_50k.json", texts[d]) + [1], "<u4"), 0
        for p in sorted(pieces, key=lambda r: r.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    fills = []
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length
        fills.append(at)
    return fills


def test_packing(spark):
    rng = np.random.default_rng(1)
    texts = dict(enumerate(ODD)) | {100 + k: " ".join(["word", "thing"] * int(rng.integers(0, 90))) for k in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    fills = check_pieces(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=64).collect(), texts, 64)
    assert sum(f < 64 for f in fills) <= 1
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing_edges(spark):
    """Repeated rows and null ids are packed as rows of their own; extra columns with the names of results are ignored."""
    long = "".join(f"w{k} " for k in range(30_000))
    rows = [(1, "same text"), (1, "same text"), (None, "no id"), (None, None), (2, long), (3, "x<|endoftext|>y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as start", "1 as length", "2 as sequence_id").coalesce(1)
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=2048).collect()
    want = sorted((str(i), len(plain("byte_bpe_50k.json", t)) + 1) for i, t in rows)
    assert sorted((str(r.doc_id), r.doc_tokens) for r in got if r.start == 0) == want
    assert sum(r.length for r in got) == sum(n for _, n in want)
    ids = np.array(plain("byte_bpe_50k.json", long) + [1], "<u4")
    for r in got:
        if r.doc_id == 2:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    fills = {}
    for r in got:
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(f)] == [sum(n for _, n in sorted(f)[:k]) for k in range(len(f))] for f in fills.values())


def test_very_long_text_in_token_files(spark):
    long = "".join(f"w{k} " for k in range(60_000))
    docs = spark.createDataFrame([(2, long), (1, "short")], "doc_id long, text string")
    got = tokenfile.read_files(tokenfile.write_files(docs, public_tokenizers.path("word_bpe_49k.json"))).collect()
    ids = np.array(plain("word_bpe_49k.json", long) + [1], "<u4")
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got if r.doc_id == 2] == [(2, len(ids), zlib.crc32(ids.tobytes()))]


def test_one_block_through_its_start():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50_000, 3000).astype(np.uint32)
    body = tokenfile.write_segment([7], np.array([3000]), ids)
    assert all((tokenfile.read_block(body, k) == ids[256 * k : 256 * k + 256]).all() for k in range(12))


def test_sum_of_squares_choice():
    rng = np.random.default_rng(2)
    p = packing.Packer(20)
    for k in range(400):
        size = int(rng.integers(1, 20))
        before = p.counts.copy()

        def cost(h):
            c = before.copy()
            if h:
                c[h] -= 1
            if h + size < 20:
                c[h + size] += 1
            return int((c**2).sum())

        options = {h: cost(h) for h in [0, *[h for h in range(1, 21 - size) if before[h]]]}
        assert options[p.level_for(size)] == min(options.values())
        p.add(k, np.zeros(size, np.uint32))


def test_whole_packing_equals_a_plain_packer():
    """Every placement of the whole stream, by the sum of squares over plain lists of fills; the merge at the end only fills gaps."""
    rng, capacity = np.random.default_rng(4), 24
    p, fills, where = packing.Packer(capacity), {}, {}
    next_id = 0
    for doc in range(500):
        size = int(rng.integers(1, 40))
        total, at = size, 0
        while total - at >= capacity:
            where.setdefault(doc, []).append((at, capacity, next_id, 0))
            next_id, at = next_id + 1, at + capacity
        rest = total - at
        if rest:
            count = [0] * (capacity + 1)
            for fill, _ in fills.values():
                count[fill] += 1

            def after(h):
                c = count.copy()
                if h:
                    c[h] -= 1
                c[h + rest] += 1
                return sum(x * x for x in c[:capacity])

            best = min([0, *[h for h in range(1, capacity + 1 - rest) if count[h]]], key=lambda h: (after(h), -h))
            if best:
                seq = max((order, s) for s, (fill, order) in fills.items() if fill == best)[1]  # of equal fills the last that came to it
            else:
                seq, next_id = next_id, next_id + 1
            where.setdefault(doc, []).append((at, rest, seq, best))
            fills[seq] = (best + rest, doc)
            if best + rest == capacity:
                del fills[seq]
        p.add(doc, np.arange(size, dtype=np.uint32))
    closed = {(r[0], r[1], r[2], r[5], r[6]) for r in p.rows}
    want = {(doc, a, n, s, o) for doc, pieces in where.items() for a, n, s, o in pieces if s not in fills}
    assert closed == want and len(fills) == sum(map(len, p.open.values())) > 1
    p.finish()
    used = {}
    for r in p.rows:
        used[r[5]] = used.get(r[5], 0) + r[2]
    assert sum(n < capacity for n in used.values()) <= 1 and sum(used.values()) == sum(n for v in where.values() for _, n, _, _ in v)


def test_encoder_holds_each_chunk_once_and_one_tokenizer():
    """Chunks of one piece are not held as pieces too, few texts go to the library at once, and its second tokenizer waits for a text that needs it."""
    letters = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    texts = [" ".join(f"{letters(k)} w{letters(k)}x, it's" for k in range(n, n + 700)) for n in (0, 500)]
    enc, most = Encoder(public_tokenizers.path("byte_bpe_50k.json"), False), []
    library = enc.piece

    class Watched:
        def encode_batch_fast(self, some, **options):
            most.append(len(some))
            return library.encode_batch_fast(some, **options)

    enc.piece = Watched()
    flat, counts = enc.encode(pa.array(texts))
    assert max(most) <= 1000 and sum(most) > 1000
    assert "whole" not in vars(enc) and len(enc.pieces) < 10 < len(enc.chunks)
    assert flat.tolist() == [i for t in texts for i in enc.whole.encode(t, add_special_tokens=False).ids] and counts.sum() == len(flat)
