import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash

from riskloom.llm import simhash, suffixes, vectors
from riskloom.llm.components import components


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(ids, near):
    """id -> smallest id reachable, by brute force."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if near(i, j):
                root[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return {x: low[find(i)] for i, x in enumerate(ids)}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(-50, 150), rng.randint(-50, 150)) for _ in range(110)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    ids = sorted({x for p in pairs for x in p})
    links = {frozenset(p) for p in pairs}
    want = joined(ids, lambda i, j: frozenset((ids[i], ids[j])) in links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in ids} == want


def test_pigeonhole_links_match_brute_force(spark):
    rng = np.random.default_rng(0)
    fps = set()
    for b in rng.integers(0, 2**63, 4, dtype=np.uint64):
        for _ in range(60):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    ids = [simhash.signed(x) for x in fps]
    df = spark.createDataFrame([(i,) for i in ids], "fp long")
    for distance, parts, bucket in ((4, 2, 4096), (4, 2, 8), (4, 3, 4096), (3, 2, 6)):  # small buckets take the ball way
        want = joined(ids, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= distance)
        got = {r["node"]: r["root"] for r in components(simhash.links(df, distance, parts, bucket)).collect()}
        assert {i: got.get(i, i) for i in ids} == want


def test_thresholds_cover_the_distance():
    ones = np.full(64, 500.0)
    for parts in (1, 2, 3, 5):
        groups = simhash.group_bits(1000, ones, np.full((64, 64), 250.0) + np.eye(64) * 250, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(simhash.allocate([simhash.costs(1000, ones, g, 4) for g in groups], 4)) == 4 - parts + 1


def test_near_duplicates(docs_of):
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(120)) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, "é É"), (5, "x " * 3000)]
    rows += [(10 + i, b) for i, b in enumerate(base)] + [(100 + i, b.upper()) for i, b in enumerate(base)] + [(200 + i, b + " tail") for i, b in enumerate(base)]
    rows += [(10, base[0])]
    out = simhash.near_duplicates(docs_of(rows)).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    ids = sorted(texts)
    fp = {i: fingerprint(texts[i]) for i in ids}
    want = joined(ids, lambda i, j: (fp[ids[i]] ^ fp[ids[j]]).bit_count() <= 4)
    for r in out:
        assert r["fingerprint"] == f"{fp[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]
    kept = simhash.keep_one(docs_of(rows)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_keep_one_of_each_component_with_and_without_ids(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(300))
    other = " ".join(f"v{i}" for i in range(300))
    third = " ".join(f"u{i}" for i in range(300))
    rows = [(1, long), (None, long + " "), (None, long), (None, other), (None, other + " "), (None, other), (5, third), (5, third + " "), (7, third + "  "),
            (5, third), (2, None), (3, ""), (None, None)]
    kept = [(r["doc_id"], (r["text"] or "").strip()) for r in simhash.keep_one(docs_of(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, long), (None, other), (5, third), (2, "")], key=str)


def cut(rows, width=50):
    low = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            low[b[i:i + width]] = min(low.get(b[i:i + width], 1 << 63), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if low[b[i:i + width]] < d:
                gone[i:i + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_dedup_matches_brute_force(docs_of):
    rng = random.Random(2)
    base = ["".join(rng.choice("ab") for _ in range(400)) for _ in range(3)]
    base += ["é" * 100 + "".join(rng.choice("xyzé") for _ in range(300)), "ab" * 200, "a" * 300]
    rows = []
    for i in range(100):
        text = ""
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(base)
            s = rng.randint(0, len(b) - 1)
            text += b[s:s + rng.randint(1, 160)] + "".join(rng.choice("qwerty ") for _ in range(rng.randint(0, 30)))
        rows.append((i * 3 if i % 2 else -i, text))
    rows += [(1000, None), (1001, ""), (1002, "x" * 49), (1003, "z" * 50), (1004, "z" * 51)]
    want = cut(rows)
    out = suffixes.digest(docs_of(rows + [rows[7]])).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        assert tuple(r)[1:] == want[r["doc_id"]]
    left = suffixes.remove(docs_of(rows))
    assert left.columns == docs_of([]).columns and left.count() == len(rows)
    assert suffixes.digest(docs_of([])).count() == 0


def test_suffix_dedup_of_rows_without_or_with_repeated_ids(docs_of):
    """Rows of one id, or without one, aren't smaller than each other, whatever their hashes."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared, other = words(12), words(15)
    by_crc = {}
    while True:  # two texts whose CRCs agree in 24 bits
        text = f"{words(3)} {len(by_crc)}"
        key = zlib.crc32((text + shared).encode()) & 0xFFFFFF
        if by_crc.setdefault(key, text) != text:
            twins = [by_crc[key] + shared, text + shared]
            break
    rows = [(1, other), (7, twins[0]), (7, twins[1]), (7, twins[0]), (None, words(5) + shared), (None, other + words(4)),
            (None, words(30)), (None, words(30)), (None, None), (9, words(40))]
    low = {}
    for d, t in rows:
        for i in range(len(t or "") - 49):
            low[t[i:i + 50]] = min(low.get(t[i:i + 50], 1 << 63), 1 << 62 if d is None else d)
    want = []
    for d, t in rows:
        gone = set()
        for i in range(len(t or "") - 49):
            if low[t[i:i + 50]] < (1 << 62 if d is None else d):
                gone.update(range(i, i + 50))
        kept = "".join(c for i, c in enumerate(t or "") if i not in gone)
        want.append((d or 0, len(t or ""), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffixes.digest(docs_of(rows)).collect()]
    assert sorted(got) == sorted(want)
    assert sum(w[2] > 0 for w in want) == 2


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(8):
        centre = rng.standard_normal(16)
        for _ in range(25):
            rows.append((len(rows), (centre + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist(), c % 3))
    rows += [(500 + i, rows[0][1], rows[0][2]) for i in range(30)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    want = joined(ids, lambda i, j: near[i, j])
    odd = [(900, [0.0] * 16, 1), (901, None, 1), (902, rows[0][1], None), (903, [None] + rows[0][1][1:], 0), (904, [float("nan")] * 16, 1),
           (905, [], 1), (906, rows[0][1][:8], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    links = {i: int(n) for i, n in zip(ids, near.sum(axis=1))}
    for block in (1024, 16):
        out = vectors.near_duplicates(df, block=block, bits=6).collect()
        assert len(out) == len(rows) + len(odd)
        for r in out:
            assert r["n_links"] == links.get(r["vec_id"], 0)
            assert r["component_id"] == want.get(r["vec_id"], r["vec_id"])
            assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_bits_and_tables_grow_with_the_vectors():
    assert vectors.sizes_for(0, 0.98) == vectors.sizes_for(250_000, 0.98) == (12, 18)
    for n in (10**6, 10**8, 10**10):
        bits, tables = vectors.sizes_for(n, 0.98)
        agree = (1 - np.arccos(0.98) / np.pi) ** bits
        assert n / 2**bits <= 64 and (1 - agree) ** tables <= 2e-5


def test_recall_with_more_bits(spark):
    """All links of brute force with the bits and tables of a hundred million vectors."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([b + rng.normal(size=(12, 16)) * s for b, s in zip(base, np.linspace(0.02, 0.3, 40))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    bits, tables = vectors.sizes_for(10**8, 0.98)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(df, bits=bits, tables=tables).collect()}
    assert got == {i: int(n) for i, n in enumerate(near.sum(axis=1))}


def test_op4_windows_whose_documents_share_less_than_47_bytes_are_not_ranked():
    S, rng = suffixes, random.Random(5)
    some = lambda n, of=b"abcdefghijklm": bytes(rng.choices(of, k=n))

    def ranked(shared: int) -> int:
        core, segs = some(shared), []
        for raw in (some(80, b"ABCDEFGHIJ") + core + some(80, b"ABCDEFGHIJ"), some(80, b"0123456789") + core + some(80, b"0123456789")):
            _, start, count, low, _ = S.runs([raw])
            for s, c, m in zip(start.tolist(), count.tolist(), low.tolist()):
                sides, off = S._sides([raw[s:s + c + S.WIDTH - 1]])
                segs.append((m, c, off, {(x["n"], x["k"]) for x in sides.to_pylist()[0]}))
        n = 0
        for i, (m, c, off, sides) in enumerate(segs):
            both = sides & set().union(*(t for j, (k, _, _, t) in enumerate(segs) if j != i and k == m))
            n += len(S._windows(np.array([c]), off, np.array([sum(1 << k for k, _ in both)]))[0])
        return n

    assert sum(ranked(46) for _ in range(40)) == 0
    assert sum(ranked(60) for _ in range(10)) >= 10 * 2 * 11  # every window of the shared bytes, in both


def test_op4_minima_are_those_of_the_runs():
    texts = ["x" * 49, "", None, "ab" * 100, *("".join(chr(97 + (i * i + 7 * j * j + i * j) % 26) for i in range(300 * j)) for j in range(1, 5))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = {m for b in suffixes._minima([batch]) for m in b.column(0).to_pylist()}
    assert got == set(suffixes.runs([(t or "").encode() for t in texts])[3].tolist()) and got
    assert not any(b.num_rows for b in suffixes._minima([batch.slice(0, 3)]))


def test_op4_sampled_suffixes_tell_windows_apart():
    """One row of 48 bytes for each sampled suffix; with the characters beside it, it is equal exactly for equal windows."""
    S, rng = suffixes, random.Random(8)
    core = bytes(rng.choices(b"abcdefghijklm", k=60))
    raws = [core[:k] + bytes(rng.choices(b"xyz", k=1)) + core[k + 1:] for k in (3, 3, 28, 51)] + [core]
    off = [int(S._sides([r])[1][0]) for r in raws]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(range(5)), pa.array(raws, pa.binary()), pa.array(off, pa.int32()),
                                        pa.array([(1 << len(S.PARTS)) - 1] * 5, pa.int32())], ["sid", "doc", "raw", "off", "parts"])
    keys, seen = {}, set()
    for out in S._sampled([batch]):
        for row in out.to_pylist():
            i, words = row["at"] & 63, tuple(row[w] for w in S.WORDS)
            assert (row["sid"], i) not in seen and (i - off[row["sid"]]) % 3
            seen.add((row["sid"], i))
            keys |= {(row["sid"], i - k): (k, (row["at"] >> 6 + 17 * k) & 131071, words) for k in (0, 1) if (row["at"] >> 6 + 17 * k) & 131071}
    windows = {(s, i): r[i:i + S.WIDTH] for s, r in enumerate(raws) for i in range(len(r) - S.WIDTH + 1)}
    assert keys.keys() == windows.keys()
    for a in windows:
        for b in windows:
            if (a[1] - off[a[0]]) % 3 == (b[1] - off[b[0]]) % 3:
                assert (keys[a] == keys[b]) == (windows[a] == windows[b])


def test_op4_runs_are_grouped_without_sorting(docs_of, monkeypatch):
    """The smallest document of every run is found by hashing, not by sorting all runs."""
    plans, table = [], suffixes.Scratch.table

    def kept(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df)

    monkeypatch.setattr(suffixes.Scratch, "table", kept)
    shared = "the quick brown fox jumps over the lazy dog and runs away from it"
    suffixes.digest(docs_of([(1, "a " + shared), (2, "b " + shared), (3, shared + " c")])).count()
    assert len([p for p in plans if "min_by" in p and "SortAggregate" not in p]) == 1
