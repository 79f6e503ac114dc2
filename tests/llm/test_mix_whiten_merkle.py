import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import merkle, mixing, queries, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos long, tree string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with documents and embeddings made of the given rows."""

    def make(docs=(), vectors=()):
        out = str(tmp_path_factory.mktemp("tables"))
        spark.createDataFrame(list(docs), DOCS).repartition(3).write.parquet(f"{out}/documents.parquet")
        spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>, label int, x string").repartition(3).write.parquet(f"{out}/embeddings.parquet")
        return out

    return make


# ---- Merkle manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_merkle(rows):
    def leaf(r, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])

    def climb(digests):
        paths, at = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            runs = [digests[i:i + 8] for i in range(0, len(digests), 8)]
            for p, a in zip(paths, at):
                run, k = runs[a // 8], a % 8
                p.append(("".join(run[:k]), "".join(run[k + 1:])))
            digests, at = [H(*x) for x in runs], [a // 8 for a in at]
        return digests[0], paths

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for g in langs:
        by[g].sort(key=lambda x: x[:3])
        subs[g] = climb([x[2] for x in by[g]])
    root, over = climb([subs[g][0] for g in langs]) if langs else (None, [])
    out = Counter()
    for g, above in zip(langs, over):
        for (_, _, own, r), path in zip(by[g], subs[g][1]):
            low = r[1] and re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
            acc = leaf(r, low) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else own
            for a, b in path + above:
                acc = H(a, acc, b)
            out[r[0], own, subs[g][0], root, H(*[x for p in path + above for x in p]), acc, acc == root] += 1
    return out


def docs_rows():
    rng = np.random.default_rng(5)
    words = ["Alpha", "beta", "ÄÖ", "déjà", "X", "漢字", "\n", ""]
    rows = []
    for i in range(700):
        lang = rng.choice(["en", "en", "en", "fr", "é", "E"])
        rows.append((i * 7 % 1009, " ".join(rng.choice(words, 5)), str(lang), f"s{i % 3}", i, 1, "t"))
    rows += [(5000 + i, "One text", None, None, None, None, None) for i in range(9)]
    rows += [(None, "No id", "en", "s", 3, 1, "t"), (None, None, "en", "s", None, 1, "t"), (3, "Again", "fr", "s", 2, 1, "t"), (3, "Again", "fr", "s", 2, 1, "t"),
             (77, None, "lone", "s", 1, 1, "t"), (78, "", "", "s", 1, 1, "t")]
    rows += [(9, "The same Row", "hot", "s", 1, 1, "t")] * 70
    return rows


def test_merkle_equals_brute_force(spark, folder):
    rows = docs_rows()
    got = Counter(tuple(r) for r in queries.op13(spark, folder(rows)).collect())
    assert got == brute_merkle(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_merkle_sizes(spark, folder, n):
    rows = [(i, f"T{i}", "en", "s", i, 1, "t") for i in range(n)]
    assert Counter(tuple(r) for r in queries.op13(spark, folder(rows)).collect()) == brute_merkle(rows)


def test_merkle_many_rounds(spark):
    """Slices of 4 leaves: rounds within rounds, with groups that end in different ones."""
    rows = [(i, f"T{i}", g, "s", i, 1, "t") for g, n in (("a", 100), ("b", 17), ("c", 4), ("d", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, DOCS)
    leaf = merkle.leaf_digest(*[F.col(c) for c in queries.MERKLE_COLUMNS])
    got = merkle.manifest(df, F.col("lang"), F.col("doc_id"), leaf, carry={"lang": F.col("lang")}, fan=2, depth=2)
    by = defaultdict(list)
    for r in got.withColumn("again", merkle.fold(F.col("leaf"), F.col("proof"))).collect():
        assert r["again"] == r["root"]
        by[r["lang"]].append(r)
    for rs in by.values():
        digests = [r["leaf"] for r in sorted(rs, key=lambda r: r["key"])]
        while len(digests) > 1:
            digests = [H(*digests[i:i + 2]) for i in range(0, len(digests), 2)]
        assert {r["subroot"] for r in rs} == set(digests)


def test_merkle_sql(spark, folder):
    path = folder([r for r in docs_rows() if r[5]])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = Counter(con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['op13_merkle']})").fetchall())
    assert Counter(tuple(r) for r in queries.op13(spark, path).select(*names).collect()) == want


# ---- mixing

def test_count_words():
    texts = ["a b", None, "", "  ", "x", "\tone\x0btwo\x1cthree ", "é ü", " nbsp same", "end\n"]
    want = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert mixing.count_words(pa.array(texts)).tolist() == want
    assert mixing.count_words(pa.array(texts).slice(3, 4)).tolist() == want[3:7]
    assert mixing.count_words(pa.array([], pa.string())).tolist() == []


def test_nearest_sum_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(150):
        k = rng.integers(1, 5)
        sizes = np.sort(rng.choice(np.arange(1, 30), k, replace=False))
        counts = rng.integers(0, 4, k)
        total = int((sizes * counts).sum())
        budget = Fraction(int(rng.integers(0, max(1, 7 * total))), 7)
        if budget >= total:
            continue
        taken = mixing.fit(sizes, counts, budget, 1 << 16)
        assert (taken >= 0).all() and (taken <= counts).all()
        best = min(abs(sum(a * b for a, b in zip(sizes.tolist(), c)) - budget) for c in itertools.product(*[range(c + 1) for c in counts.tolist()]))
        assert abs(int((taken * sizes).sum()) - budget) == best


def test_large_budgets_are_met_to_the_word():
    rng = np.random.default_rng(4)
    sizes = np.unique(rng.integers(1, 4000, 900))
    counts = rng.integers(1, 5000, len(sizes))
    for share in (0.011, 0.4, 0.93):
        budget = Fraction(int(share * int((sizes * counts).sum())))
        taken = mixing.fit(sizes, counts, budget, 1 << 12)
        assert int((taken * sizes).sum()) == budget and (taken <= counts).all()
        assert np.abs(taken / counts - share)[counts > 100].max() < 0.1  # in proportion


def brute_targets(words, weights=(5, 2, 1), most=3):
    names = sorted(words, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), Fraction(sum(words.values()))
    while open_:
        each = rest / sum(w[s] for s in open_)
        over = [s for s in open_ if each * w[s] > most * words[s]]
        if not over:
            return target | {s: each * w[s] for s in open_}
        for s in over:
            target[s] = Fraction(most * words[s])
            rest -= target[s]
            open_.discard(s)
    return target


def check_mix(rows, got, near):
    words = defaultdict(int)
    for r in rows:
        words[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(words)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == words[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]))
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= near, (s, t, float(want[s]))


def test_mix(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(0, 40)), "en", str(rng.choice(["hot", "hot", "hot", "b", "ä", "Z", "tiny"], p=[.3, .2, .2, .1, .1, .09, .01])), 1, 1, "t")
            for i in range(900)]
    rows += [(None, "a b c", "en", None, 1, 1, "t"), (7, None, "en", None, 1, 1, "t"), (7, "", "en", "none", 1, 1, "t"), (8, "one", "en", "none ", 1, 1, "t")]
    rows += [(1, "the same row here", "en", "hot", 1, 1, "t")] * 300
    df = spark.createDataFrame(rows, DOCS)
    a = mixing.mix(df).collect()
    check_mix(rows, a, near=1)
    assert Counter(a) == Counter(mixing.mix(df.repartition(5)).collect())


def test_mix_of_few_and_of_none(spark, folder):
    assert queries.op11(spark, folder()).collect() == []
    for rows in ([(1, None, "en", None, 1, 1, "t")], [(1, "", "en", "a", 1, 1, "t"), (2, " ", "en", "b", 1, 1, "t")],
                 [(1, "a b", "en", "a", 1, 1, "t"), (2, "c", "en", None, 1, 1, "t")]):
        check_mix(rows, mixing.mix(spark.createDataFrame(rows, DOCS)).collect(), near=1)


# ---- whitening

def brute_whitening(vectors, keep=4):
    fine = [(i, np.floor(np.array(v, float) * 256).astype(np.int64)) for i, v in vectors
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.unique([v for _, v in fine], axis=0)
    n, sums = len(x), [sum(c) for c in x.T.tolist()]
    c = x - x.mean(axis=0)
    values, vecs = np.linalg.eigh(c.T @ c / n)
    return fine, n, sums, values[::-1], vecs[:, ::-1]


def check_whitening(rows, vectors):
    fine, n, sums, values, vecs = brute_whitening(vectors)
    k = min(4, int((values > values.sum() * 1e-12).sum()))
    assert len(rows) == k * len(fine)
    by = defaultdict(list)
    for r in rows:
        by[r["vec_id"], r["component"]].append(r)
    signs = {}
    for i, v in fine:
        for j in range(k):
            r = by[i, j + 1][0]
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v.tolist(), sums))
            assert r["explained"] == pytest.approx(values[j] / values.sum(), rel=1e-9)
            assert r["identity_error"] < 1e-9
            want = float((v - np.array(sums) / n) @ vecs[:, j] / np.sqrt(values[j]))
            if abs(want) > 0.1:
                assert signs.setdefault(j, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
            assert abs(r["whitened"]) == pytest.approx(abs(want), abs=1e-6)


def test_whitening_equals_brute_force(spark, folder):
    rng = np.random.default_rng(8)
    base = (rng.normal(size=(400, 12)) * np.linspace(0.2, 2, 12)).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    vectors += [(1000 + i, base[3].tolist()) for i in range(200)]
    odd = [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [-0.0] * 12)]
    vectors += odd
    rows = queries.op12(spark, folder((), [(i, v, 1, "x") for i, v in vectors])).collect()
    check_whitening(rows, vectors)


def test_whitening_of_few_vectors(spark, folder):
    run = lambda vs: queries.op12(spark, folder((), [(i, v, None, "x") for i, v in enumerate(vs)])).collect()
    assert run([]) == [] and run([None, [None]]) == [] and run([[1.0, 2.0]] * 5) == [] and run([[]]) == []
    two = [[0.0, 1.0, 0.0], [1.0, 0.5, 0.0], [1.0, 0.5, 0.0]]
    check_whitening(run(two), list(enumerate(two)))
    # a shorter vector counts as zero beyond its end
    ragged = [[1.0, 2.0], [1.0], [0.5, -3.0], []]
    check_whitening(run(ragged), [(i, v + [0.0] * (2 - len(v))) for i, v in enumerate(ragged)])


def test_secular_updates_and_joins():
    rng = np.random.default_rng(1)
    for dim, n in ((1, 9), (3, 3), (7, 200), (20, 90)):
        x = np.floor(rng.normal(size=(n, dim)) * 40)
        x[::4] = x[0]
        x[:, 0] = 3  # constant: its eigenvalue stays zero
        parts = [whitening.Spectrum(dim) for _ in range(3)]
        for i, v in enumerate(x):
            parts[i % 2].add(v)
        for p in parts[1:]:
            parts[0].join(p)
        s, c = parts[0], x - x.mean(axis=0)
        scale = max(1.0, np.linalg.norm(c) ** 2)
        assert s.n == n and np.allclose(s.mean, x.mean(axis=0))
        assert np.abs(s.basis * s.values @ s.basis.T - c.T @ c).max() < 1e-12 * scale
        assert np.abs(s.basis.T @ s.basis - np.eye(dim)).max() < 1e-11


def test_huge_entries():
    w = whitening.Whitener(10**12, [5, -7], np.eye(2), np.ones(2), 2.0)
    x = np.array([[10**6, 2], [0, 0]])
    assert w.deviation(x) == [None, 74]
