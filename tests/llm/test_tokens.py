import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskloom.llm import bpe, lexicon, packing, repair
from riskloom.llm.common import tokenizer
from riskloom.llm.tokens import Encoder

ALPHABET = ["a", "B", "the", "'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", "é", "é", "É", "́", "ß", "½", "²", "1", "23", "😀",
            "…", ".", ",", "<|endoftext|>", "<", "|", "中文", "\xa0", "\x85", "\x1c", "İ", "ﬁ", "Σ", "-", "_", "=", "̸", "क़", "'S"]


def fuzz(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_exact(name):
    texts = fuzz(3000) + ["", "x" * 5000, " " * 300]
    enc = Encoder(tokenizer(name))
    for part in (texts, [t for t in texts if "<|" not in t]):
        ids, off = enc.encode(part)
        for t, a, b in zip(part, off[:-1], off[1:]):
            assert ids[a:b].tolist() == enc.tok.encode(t, add_special_tokens=False).ids, t


def test_lexicon_is_minimal_and_exact(tmp_path):
    rng = random.Random(1)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))): [rng.randint(0, 9) for _ in range(rng.randint(1, 3))] for _ in range(600)}
    path = str(tmp_path / "lexicon.bin")
    lexicon.compile_lexicon(words, path)
    lex = lexicon.Lexicon(path)
    asked = [w.decode() for w in words] + ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 8))) for _ in range(500)]
    assert lex.lookup(asked) == [words.get(x.encode()) for x in asked]
    # no two states accept the same endings
    right = {}
    edges = defaultdict(list)
    for k, t in zip(lex.keys.tolist(), lex.to.tolist()):
        edges[k // 256].append((k % 256, t))

    def tail(s):
        if s not in right:
            right[s] = (int(lex.ends[s]), tuple((c, tail(t)) for c, t in sorted(edges[s])))
        return right[s]

    assert len({tail(s) for s in range(len(lex.ends))}) == len(lex.ends)
    lexicon.compile_lexicon({}, path)
    assert lexicon.Lexicon(path).lookup(["a", ""]) == [None, None]


def test_bpe_round_trip(docs_of):
    texts = [None, "", *fuzz(200, 5), "word " * 4000]
    rows = [*enumerate(texts), (1, "")]
    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    out = bpe.round_trip(docs_of(rows), tokenizer("byte_bpe_50k.json"), size=50).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(docs_of([]), tokenizer("byte_bpe_50k.json")).count() == 0
    back = bpe.decode(bpe.encode(docs_of(rows[:50]), tokenizer("byte_bpe_50k.json"), size=50), tokenizer("byte_bpe_50k.json")).collect()
    assert all(r["text"] == (texts[r["doc_id"]] or "") for r in back)


def test_plan_places_every_piece_once():
    rng = random.Random(5)
    for trial in range(200):
        cap = rng.choice([10, 30, 100])
        hist = Counter(rng.randint(1, cap) for _ in range(rng.randint(0, 300)))
        if trial % 3 == 0:
            hist = Counter({k: v * rng.randint(1, 50) for k, v in hist.items()})
        seqs, per = defaultdict(list), Counter()
        for s in packing.plan(dict(hist), cap):
            for j in range(s.count):
                seqs[s.sequence + j // s.each].append((s.offset + j % s.each * s.length, s.length))
                per[s.length] += 1
        assert per == hist
        for v in seqs.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= cap
            assert sum(3 * n > cap for _, n in v) <= 2
        bound = max(math.ceil(sum(k * n for k, n in hist.items()) / cap), sum(n for k, n in hist.items() if 2 * k > cap))
        assert len(seqs) <= bound * 1.2 + 1


def test_packing_documents(docs_of):
    rng = random.Random(2)
    texts = [None, "", *(" ".join(rng.choice(["the", "of", "thing", "zq"]) for _ in range(rng.randint(0, 400))) for _ in range(150)), "cat " * 10_000]
    rows = [*enumerate(texts), (0, None), (2, texts[2])]
    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    out = packing.pack_documents(docs_of(rows), tokenizer("word_bpe_49k.json")).collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    want = Counter()
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[d, k, s, len(ids[s:s + 4096]), zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes())] += 1
    assert got == want
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(docs_of([]), tokenizer("word_bpe_49k.json")).count() == 0


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n, v in ((0, 5), (1, 5), (2, 5), (5000, 4), (20_000, 30), (3000, 1)):
        ids = rng.integers(0, v, n).astype(np.uint32)
        rules, lengths, symbols = repair.compress(ids, 50, min_count=3)
        assert (repair.expand(symbols, rules, 50) == ids).all()
        assert n < 5000 or len(symbols) < n
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2))
            assert (repair.decode_range(symbols, rules, lengths, 50, a, b) == ids[a:b]).all()


def test_token_files(docs_of, scratch, spark):
    texts = [None, "", *fuzz(300, 9), "again and again " * 3000]
    rows = [(3 * i - 100, t) for i, t in enumerate(texts)]
    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    repair.write(docs_of(rows + [rows[5]]).repartition(7), tokenizer("byte_bpe_50k.json"), f"{scratch}/ids", shard_ids=2000)
    out = repair.read(spark, f"{scratch}/ids").orderBy("start").collect()
    at = 0
    for r, (d, t) in zip(out, sorted(rows + [rows[5]], key=lambda x: x[0])):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(out) == len(rows) + 1
    assert repair.write_and_read(docs_of([]), tokenizer("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_code_point_before_an_ending_and_inside_a_word(name):
    """The library's own classes of characters: every code point of the planes in use."""
    enc = Encoder(tokenizer(name))
    points = [c for c in [*range(0x33480), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    for form in ("{}'s", "a{}b 1{}"):
        for at in range(0, len(points), 20_000):
            texts = [form.format(*[chr(c)] * 2) for c in points[at:at + 20_000]]
            ids, off = enc.encode(texts)
            want = [e.ids for e in enc.tok.encode_batch_fast(texts, add_special_tokens=False)]
            got = [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
            assert got == want, [t for t, g, w in zip(texts, got, want) if g != w][:5]


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(7)
    words = [rng.integers(0, 400, rng.integers(2, 9)) for _ in range(300)]
    cases = [np.concatenate([words[i] for i in rng.zipf(1.3, 20_000) % 300]), np.zeros(1000, int), np.tile([1, 2], 700), rng.integers(0, 3, 5000)]
    for ids in cases:
        ids = ids.astype(np.uint32)
        rules, lengths, left = repair.compress(ids.copy(), 400, pairs=64)
        assert (repair.expand(left, rules, 400) == ids).all()
        assert lengths.tolist() == [len(repair.expand(np.array([400 + r], np.uint32), rules, 400)) for r in range(len(rules))]
        pairs = Counter((a, b) for a, b in zip(left[:-1].tolist(), left[1:].tolist()) if a != b)
        assert not pairs or max(pairs.values()) < repair.MIN_COUNT
