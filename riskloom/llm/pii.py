"""Personal data: base patterns and bootstrapped contextual extraction, in Spark SQL only.

``extract`` finds the base spans of every whole text together with the
identifier-shaped words that no base pattern explains, each with its lexical
pattern (the two whole words before the word in which it starts).  ``bootstrap`` works on the pattern-instance
graph: the base spans are the seed entities; a pattern's confidence is the
share of all its occurrences in the corpus that are followed by an accepted
instance; an instance that follows a pattern of high confidence is accepted
with the pattern's kind, which in turn raises other patterns.  When nothing
new is accepted every occurrence of an accepted instance is a discovered span.

Defined results: a null or empty text has no spans; repeated rows get the same
spans each; with no seeds or no confident pattern nothing is added; offsets are
code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import cut_lineage, fresh, once, text_or_empty

# Fixed values of the contract, written for a matcher without backtracking: a
# run of the first class is only entered at its start or where the last match ended.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# a text without this has no valid span of the kind
GUARDS = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9][\x20().0-9-]{8}",
}
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?"  # a part has a digit, maybe zeros alone
# a word with a digit or an at sign
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*"
CELLS = 1 << 24  # of pair hashes, a bit each
CELL = f"(xxhash64(ctx) & {CELLS - 1}L)"


def _valid(kind: str, m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"{m} RLIKE '^{OCTET}([.]{OCTET}){{3}}$'"
    if kind == "phone":
        return f"length({digits}) BETWEEN 10 AND 15"
    luhn = ("aggregate(split(reverse({d}), ''), struct(0 AS n, 0 AS s), (a, c) -> struct(a.n + 1 AS n, a.s + "
            "CASE WHEN c = '' THEN 0 WHEN a.n % 2 = 0 THEN int(c) WHEN int(c) > 4 THEN 2 * int(c) - 9 ELSE 2 * int(c) END AS s), "
            "a -> a.s % 10 = 0)").format(d=digits)
    return f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END"


BLOCK = 256  # items in a block of a walk


def _walk(n: str, zero: dict[str, str], body: str, item: str) -> str:
    """Array of the ``item`` structs that ``body`` puts in ``out`` on a walk over k = 0 .. n - 1
    with the state ``b``.  Items are gathered in blocks, so that no step copies all before it."""
    last = f"least(i + {BLOCK - 1}, {n} - 1)"
    block = (f"aggregate(sequence(i, {last}), struct({', '.join(f'a.{f} AS {f}' for f in zero)}, cast(array() AS array<{item}>) AS out), "
             f"(b, k) -> {body})")
    return (f"CASE WHEN {n} > 0 THEN aggregate(sequence(0, {n} - 1, {BLOCK}), "
            f"struct({', '.join(f'{x} AS {f}' for f, x in zero.items())}, cast(array() AS array<array<{item}>>) AS out), "
            f"(a, i) -> aggregate(array({block}), a, (s, r) -> struct({', '.join(f'r.{f} AS {f}' for f in zero)}, concat(s.out, array(r.out)) AS out)), "
            f"a -> flatten(a.out)) ELSE cast(array() AS array<{item}>) END")


def _pieces(t: str, pattern: str, guard: str, valid: str) -> Column:
    """Array of (p, m, v): what stands before each match, the match, and whether it is valid;
    the last one, without a match, is what stands behind them.  Null if ``guard`` finds nothing."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    g = guard.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"CASE WHEN {t} RLIKE '{g}' THEN zip_with(split({t}, '{p}', -1), regexp_extract_all({t}, '{p}', 0), "
                  f"(p, m) -> struct(p AS p, m AS m, coalesce({valid}, false) AS v)) END")


def _located(z: str) -> Column:
    """Array of (s, e, m, ctx, f) for each valid match of the pieces ``z``, whose lengths give
    the offsets.  ``c`` are the last two whole words and what stands of the next one; ``ctx``
    the two, in lower case, and ``f`` tells the first valid match that starts in its word
    (``w`` is the last such word's start)."""
    words = "slice(concat(array('', ''), split(concat(array_join({c}, ' '), {x}), '[\\\\x20\\\\x09-\\\\x0D]+')), -3, 3)"
    p, m, v = (f"{z}[k].{f}" for f in "pmv")
    at, word = f"(s.at + length({p}))", f"s.at + length({p}) - length(c[2])"
    made = f"struct({at} AS s, {at} + length({m}) AS e, {m} AS m, lower(concat(c[0], ' ', c[1])) AS ctx, {word} != s.w AS f)"
    body = (f"aggregate(array({words.format(c='b.c', x=p)}), b, (s, c) -> struct({at} + length({m}) AS at, "
            f"CASE WHEN {v} THEN {word} ELSE s.w END AS w, {words.format(c='c', x=m)} AS c, "
            f"CASE WHEN {v} THEN array_append(s.out, {made}) ELSE s.out END AS out))")
    return F.expr(_walk(f"(size({z}) - 1)", {"at": "0", "w": "-1", "c": "array('', '', '')"}, body,
                        "struct<s:int,e:int,m:string,ctx:string,f:boolean>"))


def extract(docs: DataFrame, text: str = "text", out: str = "found") -> DataFrame:
    """``docs`` with one more struct: ``base`` spans (s, k, e, m, ctx, f) and ``words``
    (s, e, m, ctx), the identifier-shaped words outside of them; ``k`` numbers KINDS."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    t, words, base, every, *ks = fresh(docs, "t_", "words_", "base_", "every_", *[f"{k}_" for k in KINDS])
    step = docs.select(*keep, once(text_or_empty(text)).alias(t))
    step = step.select(*keep, *[once(_pieces(t, PATTERNS[k], GUARDS[k], _valid(k, "m"))).alias(c) for k, c in zip(KINDS, ks)],
                       once(_pieces(t, TOKEN, "[0-9@]", "length(m) BETWEEN 5 AND 200 AND m RLIKE '[0-9].*[0-9].*[0-9]|[^@]@[^@]'")).alias(words))
    step = step.select(*keep, *[once(_located(c)).alias(c) for c in [*ks, words]])
    spans = "concat(" + ", ".join(
        f"transform({c}, x -> struct(x.s AS s, {i} AS k, x.e AS e, x.m AS m, x.ctx AS ctx, x.f AS f))" for i, c in enumerate(ks)) + ")"
    step = step.select(*keep, words, once(F.expr(f"sort_array({spans})")).alias(base))
    # base spans and words in order (words, which don't overlap each other, as the last kind)
    step = step.select(*keep, words, base, once(F.expr(
        f"CASE WHEN size({base}) > 0 AND size({words}) > 0 THEN sort_array(concat({base}, transform({words}, x -> "
        f"struct(x.s AS s, {len(KINDS)} AS k, x.e AS e, x.m AS m, x.ctx AS ctx, x.f AS f)))) END")).alias(every))
    # a word stays if no span before it reaches into it and what comes next starts behind it
    x = f"{every}[k]"
    free = (f"struct(CASE WHEN {x}.k < {len(KINDS)} THEN greatest(b.at, {x}.e) ELSE b.at END AS at, CASE WHEN {x}.k = {len(KINDS)} AND {x}.s >= b.at "
            f"AND coalesce(get({every}, k + 1).s >= {x}.e, true) THEN array_append(b.out, struct({x}.s AS s, {x}.e AS e, {x}.m AS m, {x}.ctx AS ctx)) ELSE b.out END AS out)")
    item = "struct<s:int,e:int,m:string,ctx:string>"
    left = (f"CASE WHEN size({base}) = 0 THEN transform({words}, x -> struct(x.s AS s, x.e AS e, x.m AS m, x.ctx AS ctx)) "
            f"ELSE {_walk(f'size({every})', {'at': '0'}, free, item)} END")
    return step.select(*keep, once(F.struct(F.col(base).alias("base"), F.expr(left).alias("words"))).alias(out))


@dataclass(frozen=True)
class Bootstrap:
    min_instances: int = 5       # distinct accepted instances behind a confident pattern
    min_confidence: float = 0.5  # share of a pattern's occurrences that they are


def bootstrap(docs: DataFrame, found: DataFrame, conf: Bootstrap = Bootstrap()) -> DataFrame:
    """Accepted instances ``(m, k)`` from ``found`` (columns base, words) and the texts of ``docs``."""
    seeds = found.select(F.explode("found.base").alias("x")).select("x.ctx", "x.m", "x.k", F.lit(True).alias("seed"), "x.f")
    words = found.select(F.explode("found.words").alias("x")).select(
        "x.ctx", "x.m", F.lit(None).cast("int").alias("k"), F.lit(False).alias("seed"), F.lit(True).alias("f"))
    # n: places of the pattern; several seeds of a kind in one word stand at one place
    edges = cut_lineage(seeds.union(words).where("ctx != ' '").groupBy("ctx", "m", "k", "seed").agg(F.count_if("f").alias("n")))
    accepted = cut_lineage(seeds.groupBy("m").agg(F.min("k").alias("k")))
    # a pattern with fewer distinct instances, accepted or not, can't become confident
    candidates = cut_lineage(edges.groupBy("ctx").agg(F.countDistinct("m").alias("d")).where(F.col("d") >= conf.min_instances).select("ctx"))
    w = F.filter(F.split(F.lower(text_or_empty()), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    pairs = docs.select(once(F.concat(F.array(F.lit("")), w)).alias("w")).select(once(F.expr(
        "CASE WHEN size(w) >= 2 THEN transform(sequence(0, size(w) - 2), i -> concat_ws(' ', w[i], w[i + 1])) END")).alias("p"))
    pairs = pairs.crossJoin(F.broadcast(_bits(candidates))).select(F.explode("p").alias("ctx"), "bits").where(
        F.expr(f"shiftright(bits[int(shiftright({CELL}, 6))], int({CELL} & 63)) & 1 = 1"))
    total = cut_lineage(pairs.groupBy("ctx").agg(F.count("*").alias("total")).join(candidates, "ctx"))
    scored = edges.join(total, "ctx")
    at, before = _state(accepted), None
    while at != before:
        known = accepted.withColumnRenamed("k", "ak")
        confident = (scored.join(known, "m").groupBy("ctx", F.col("ak").alias("k"))
                     .agg(F.countDistinct("m").alias("d"), F.sum("n").alias("hits"), F.first("total").alias("total"))
                     .where((F.col("d") >= conf.min_instances) & (F.col("hits") >= conf.min_confidence * F.col("total"))))
        new = scored.where(~F.col("seed")).drop("k").join(confident.select("ctx", "k"), "ctx").groupBy("m").agg(F.min("k").alias("k"))
        accepted = cut_lineage(accepted.union(new.select("m", "k")).groupBy("m").agg(F.min("k").alias("k")))
        at, before = _state(accepted), at
    return accepted.join(seeds.select("m").distinct(), "m", "left_anti")


def _bits(candidates: DataFrame) -> DataFrame:
    """One row: a bit for each cell of hashes, set where a candidate falls.  It only spares
    the shuffle of pairs that are no candidate; the join with ``candidates`` decides."""
    used = candidates.selectExpr(f"shiftright({CELL}, 6) AS i", f"shiftleft(1L, int({CELL} & 63)) AS b")
    every = candidates.sparkSession.range(CELLS // 64).selectExpr("id AS i", "0L AS b")
    return used.union(every).groupBy("i").agg(F.bit_or("b").alias("b")).agg(
        F.expr("transform(sort_array(collect_list(struct(i, b))), x -> x.b)").alias("bits"))


def _state(accepted: DataFrame) -> tuple[int, int]:
    """Instances are only added and kinds only lowered, so equal figures mean that nothing changed."""
    r = accepted.agg(F.count("*").alias("n"), F.sum("k").alias("k")).first()
    return r["n"], r["k"] or 0


def find(docs: DataFrame, conf: Bootstrap = Bootstrap()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_hash, ``base`` and ``added``
    arrays of (s, k, e).  Only the small found parts are kept and joined, never the texts."""
    docs = docs.select("doc_id", "text")
    found = extract(docs).select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), "found",
                                 F.monotonically_increasing_id().alias("rid"))
    found = cut_lineage(found)
    accepted = bootstrap(docs, found, conf)
    added = (found.select("rid", F.explode("found.words").alias("x")).select("rid", "x.s", "x.e", "x.m").join(accepted, "m")
             .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("s", "k", "e"))).alias("added")))
    none = F.expr("cast(array() AS array<struct<s:int,k:int,e:int>>)")
    return found.join(added, "rid", "left").select(
        "doc_id", "text_hash", F.expr("transform(found.base, x -> struct(x.s AS s, x.k AS k, x.e AS e))").alias("base"),
        F.coalesce("added", none).alias("added"))


def joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform(sort_array({spans}), x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')")


def redact(docs: DataFrame, conf: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets."""
    i, h, sp, cut = fresh(docs, "id", "hash", "spans", "cut")
    spans = find(docs, conf).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.array_sort(F.concat("base", "added")).alias(sp))
    spans = spans.where(F.size(sp) > 0).groupBy(i, h).agg(F.first(sp).alias(sp))
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    # the text before each span that starts behind all earlier ones, cut from the text a block at a time
    x = f"`{sp}`[k]"
    body = (f"struct(greatest(b.at, {x}.e) AS at, CASE WHEN {x}.s >= b.at THEN array_append(b.out, struct(b.at AS lo, {x}.s AS hi, {x}.k AS k)) ELSE b.out END AS out)")
    pieces = _walk(f"size(`{sp}`)", {"at": "0"}, body, "struct<lo:int,hi:int,k:int>")
    last = f"least(i + {BLOCK - 1}, size({cut}) - 1)"
    made = (f"concat(array_join(flatten(transform(sequence(0, size({cut}) - 1, {BLOCK}), i -> transform(array("
            f"substring(text, {cut}[i].lo + 1, {cut}[{last}].hi - {cut}[i].lo)), t -> transform(sequence(i, {last}), k -> "
            f"concat(substring(t, {cut}[k].lo - {cut}[i].lo + 1, {cut}[k].hi - {cut}[k].lo), array({names})[{cut}[k].k])))[0])), ''), "
            f"substring(text, array_max(`{sp}`.e) + 1, length(text)))")
    both = docs.join(spans, docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(text_or_empty()) == F.col(h)), "left")
    both = both.withColumn(cut, once(F.expr(pieces)))
    return both.withColumn("text", F.when(F.col(sp).isNotNull(), F.expr(made)).otherwise(F.col("text"))).select(docs.columns)
