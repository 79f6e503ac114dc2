import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from riskloom.llm import pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    w = WORD.findall(text or "")
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n, cov = Counter(tri), set()
    for i, t in enumerate(tri):
        if n[t] > 1:
            cov |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cov)


def test_stats_match_brute_force(docs_of):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "é # b|c", "x y z x y z x", "l\nl\n l\n\nl"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["".join(rng.choice("ab #é\n\t\x0b") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["w " * 20_000]
    out = quality.text_stats(docs_of(list(enumerate(texts)))).collect()
    for r in out:
        assert tuple(r["stats"][k] for k in quality.BASE) == stats(texts[r["doc_id"]])


def test_rules_separate_and_filter(spark, docs_of):
    good = [(i, " ".join(f"w{(i * 7 + k) % 997}x{k}" for k in range(60))) for i in range(300)]
    bad = [(1000 + i, " ".join(f"v{i}y{k}###" for k in range(60))) for i in range(120)]
    docs = docs_of(good + bad)
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in good] + [(d, 0, 0) for d, _ in bad] + [(None, 1, 0), (5, None, 0)],
                                   "doc_id long, quality int, toxic int")
    rules = quality.learn_rules(docs, labels)
    assert rules
    out = quality.quality(docs, labels)
    assert {r["doc_id"] for r in out.where("kept").collect()} == {d for d, _ in good}
    # without labels nothing is learned and only the base rules hold
    none = quality.quality(docs.union(docs_of([(1, None), (None, "short")])), labels.limit(0))
    assert none.where("NOT kept").count() == 2
    assert quality.quality(docs.limit(0), labels).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "card":
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and luhn % 10 == 0
    return True


def base(text):
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m[0]))


def test_base_spans_match_brute_force(docs_of):
    rng = random.Random(1)
    texts = [None, "", "a@b", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1 001.2.3.04", "10.0.0.1 0.0.0.0 000.00.0.256 255.255.255.0", "é😀 a.b@c.de 😀 9.9.9.9", "x" * 30_000 + "@y.z",
             "1" * 20_000, "1." * 20_000, "+" + "(" * 5_000, "4041894974608795 4041894974608795", "+1 (724) 555-7058"]
    texts += ["".join(rng.choice("ab01 .@+-()%_2\n") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    rows = [*enumerate(texts), (0, None)]
    found = pii.find(docs_of(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(x) for x in r["base"]] == base(texts[r["doc_id"]])


def test_context_discovers_and_redacts(docs_of):
    rows = [(i, f"hello there contact email: user{i}@x.org bye") for i in range(20)]
    rows += [(100, "contact email: zed77711_x bye"), (101, "the number zed77711_x again"), (102, "code 12345678 is clean"), (None, "")]
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs_of(rows)).collect()}
    assert out[3] == "hello there contact email: [EMAIL] bye"
    assert out[100] == "contact email: [EMAIL] bye"
    assert out[101] == "the number [EMAIL] again"
    assert out[102] == "code 12345678 is clean"
    assert pii.redact(docs_of([])).count() == 0


def test_rare_context_is_scored_among_many(docs_of):
    # 2,100 contexts with six seeds each stand before the confident one in every order of (seeds, context)
    rows = [(i, " ".join(f"a{i} b{i} u{i}x{j}@x.org" for j in range(6))) for i in range(2_100)]
    rows += [(10_000 + i, f"hello there zz email: user{i}@x.org bye") for i in range(5)] + [(20_000, "zz email: zed77711_x bye")]
    out = {r["doc_id"]: r["n"] for r in pii.find(docs_of(rows)).where("doc_id >= 10000").select("doc_id", F.size("added").alias("n")).collect()}
    assert out == {20_000: 1} | {10_000 + i: 0 for i in range(5)}


def test_context_is_whole_words(docs_of):
    rows = [(i, f"{'long' * 40} w{i} send mail <user{i}@x.org> or so") for i in range(6)] + [(50, "send mail <zed77711> or so")]
    rows += [(100 + i, f"my number\ttel:+1 555 010 10{i:02} now") for i in range(6)] + [(150, "my number zed88811 now")]
    rows += [(200 + i, f"{'x' * 150} {'y' * 150} 10.1.1.1{i}") for i in range(6)] + [(250, f"{'x' * 150} {'y' * 150} zed99911")]
    # many seeds in one word are one place of the context: 5 places of 11
    rows += [(300 + i, f"ask for a{i}@x.org,b{i}@x.org,c{i}@x.org") for i in range(5)] + [(350 + i, f"ask for zed6661{i}") for i in range(6)]
    out = {r["doc_id"]: [tuple(x) for x in r["added"]] for r in pii.find(docs_of(rows)).collect() if r["doc_id"] % 100 >= 50}
    assert out == {50: [(10, 0, 20)], 150: [(10, 3, 18)], 250: [(302, 1, 310)]} | {350 + i: [] for i in range(6)}


def test_discovered_instances_raise_other_contexts(docs_of):
    # seeds -> "mail to" -> n*x -> "write at" -> p*x -> "call by" -> q*x -> "reach via" -> z*x, a round each
    rows = [(i, f"mail to user{i}@x.org") for i in range(5)]
    chain = ["mail to", "write at", "call by", "reach via", "talk on"]
    for k in range(4):
        rows += [(100 * (k + 1) + 10 * j + i, f"{chain[k + j]} id{k}0{i}{i}x") for j in (0, 1) for i in range(5)]
    out = {r["doc_id"]: r["n"] for r in pii.find(docs_of(rows)).select("doc_id", F.size("added").alias("n")).collect()}
    assert all(n == (d >= 100) for d, n in out.items())


def test_digest_of_spans(docs_of):
    r = pii.find(docs_of([(1, "q a@b.co 9.9.9.9")])).select(F.sha2(pii.joined("base"), 256).alias("h"), pii.joined("base").alias("s")).first()
    assert r["s"] == "email:2:8,ip:9:16"
    assert r["h"] == hashlib.sha256(r["s"].encode()).hexdigest()


def test_query_counts_by_kind(docs_of, scratch):
    texts = [None, "", "q a@b.co 9.9.9.9", "9.9.9.9 a@b.co c@d.co e@f.co", "+1 724 555 70588 4041894974608795 a@b.co", "x 9.9.9.9 8.8.8.8 7.7.7.7"]
    docs_of(list(enumerate(texts))).write.parquet(f"{scratch}/documents.parquet")
    from riskloom.llm.queries import QUERIES
    got = {r["doc_id"]: tuple(r[f"n_{k}"] for k in pii.KINDS) for r in QUERIES["op9_pii"](docs_of([]).sparkSession, scratch).collect()}
    assert got == {i: tuple(sum(k == j for _, k, _ in base(t)) for j in range(4)) for i, t in enumerate(texts)}


def test_many_spans_in_one_text(docs_of):
    rng = random.Random(3)
    kinds = [lambda i: f"user{i}@x.org", lambda i: f"10.{i // 256}.{i % 256}.4", lambda i: f"x{i}y77", lambda i: f"+1 555 01{i:05}", lambda i: f"a{i}@b.co,c{i}@d.co"]
    log = "é ".join(rng.choice(kinds)(i) for i in range(20_000))
    rows = [(1, log), (2, ""), (3, None)]
    got = {r["doc_id"]: [tuple(x) for x in r["base"]] for r in pii.find(docs_of(rows)).collect()}
    assert got == {1: base(log), 2: [], 3: []}
    want, at = "", 0
    for s, k, e in base(log):
        if s >= at:
            want += log[at:s] + f"[{pii.KINDS[k].upper()}]"
        at = max(at, e)
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs_of(rows)).collect()}
    assert out == {1: want + log[at:], 2: "", 3: None}
