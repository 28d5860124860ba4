"""Each operator against a plain version on a small fixture with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordflow.llm import decontam, exact_dedup, langid, line_dedup, ngram_join, packing, quality, sharding, suffix_dedup, toxicity
from recordflow.llm import components as components_module
from recordflow.llm.components import components
from recordflow.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string, `__head` string"


def _words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho".split()) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [_words(rng, rng.randint(5, 120)) for _ in range(25)]
    shared = _words(rng, 90)
    out = base + base[:4] + [b.upper() for b in base[4:6]]
    out += [f"{_words(rng, 20)} {shared} {_words(rng, 15)}" for _ in range(6)]
    for b in base[:8]:
        w = b.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [None, "", " ", "one", "ONE", "two words", "!?", "é à", "\n\n", "x\ny\nx", "ab " * 4000, "a" * 3000, _words(rng, 6000)]
    return list(enumerate(out)) + [(3, out[3]), (None, "no id"), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i is None or i % 5 == 0 else "en", None, 1, "s", "k", "h") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _lower(t):
    return (t or "").encode().lower()


def test_exact_dedup(docs, texts, nothing):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[_lower(t)].append(i)
    got = exact_dedup.groups(docs).collect()
    assert len(got) == len(texts)
    by_sha = collections.defaultdict(list)
    for r in got:
        by_sha[r.text_sha256].append(r)
    for t, ids in groups.items():
        rows = by_sha[hashlib.sha256(t).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in rows)
        assert {(r.keep_id, r.group_size) for r in rows} == {(best, len(ids))}
        assert [r.doc_id for r in rows if r.kept] == [best]
    kept = exact_dedup.dedup(docs).collect()
    assert len(kept) == len(groups) and exact_dedup.dedup(docs).columns == docs.columns
    small = {r.text_sha256: r.keep_id for r in exact_dedup.groups(docs, keep="smallest").collect()}
    assert all(small[hashlib.sha256(t).hexdigest()] == min((i for i in ids if i is not None), default=None) for t, ids in groups.items())
    assert exact_dedup.groups(nothing).count() == 0 and exact_dedup.dedup(nothing).count() == 0


def test_exact_dedup_runs_that_cross_ranges(spark):
    df = spark.range(400).selectExpr("id as doc_id", "if(id % 3 = 0, 'Same', concat('t', id)) as text").repartition(8)
    got = exact_dedup.groups(df).where("group_size > 1").collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(399, 134)} and sum(r.kept for r in got) == 1


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_ngram_join(docs, texts, nothing, k, num):
    sets = collections.defaultdict(list)
    for i, t in texts:
        w = _lower(t).split()
        sets[i].append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}
    linked = lambda a, b: any(100 * len(x & y) >= num * len(x | y) and x and y for x in sets[a] for y in sets[b])
    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    got = ngram_join.classes(docs, k, num, 100).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.component_id == comp.get(r.id) and r.n_shingles in {len(s) for s in sets[r.id]}
    kept = ngram_join.dedup(docs, k, num, 100)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in ids if comp[i] == i} | {None}
    assert ngram_join.classes(nothing).count() == 0


@pytest.mark.parametrize("block", [1000, 7])
def test_ngram_join_of_a_chain(spark, monkeypatch, block):
    """Neighbours link and the ends don't: one component, also when the family is dealt out in blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    w = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(w[3 * i : 300 + 3 * i])) for i in range(30)]
    got = ngram_join.classes(spark.createDataFrame(texts, "doc_id bigint, text string"), 3, 90, 100).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("block", [1000, 7])
def test_ngram_join_counts_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    w = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(w[3 * i : 300 + 3 * i])) for i in range(30)]
    texts += [(100 + i, texts[i % 5][1].upper()) for i in range(12)] + [(200, "alone"), (201, None), (202, ""), (None, texts[0][1])]
    sets = {i: {tuple(x[j : j + 3]) for j in range(len(x) - 2)} for i, t in texts if i is not None for x in [(t or "").lower().split()]}
    links = {i: sum(100 * len(a & b) >= 90 * len(a | b) for j, b in sets.items() if j != i and a and b) for i, a in sets.items()}
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = ngram_join.classes(df, 3, 90, 100, count=True).collect()
    assert len(got) == len(texts) and max(links.values()) > 10
    assert {r.id: r.n_links for r in got} == links | {None: 0}
    assert {r.component_id for r in got if r.id is not None and r.id < 200} == {0}


def test_rtree_finds_all_near_points():
    rng = np.random.default_rng(2)
    t = ngram_join.Threshold(80, 100)
    points = rng.poisson(4, (700, ngram_join.GROUPS)).astype("<u2")
    points[350:] = np.maximum(0, points[:350].astype(int) + rng.integers(-1, 2, points[:350].shape) * (rng.random(points[:350].shape) < 0.2))
    tree = ngram_join.RTree(points)
    for i in range(0, 700, 7):
        want = np.flatnonzero(t.linked(np.minimum(points, points[i]).sum(1, dtype=int), points.sum(1, dtype=int) + int(points[i].sum())))
        assert sorted(tree.near(points[i], t)) == want.tolist()


def test_points_of_long_texts():
    """Groups of more than 65,535 shingles: the counts still bound what two sets share."""
    s = np.arange(70_000, dtype=np.uint64) * np.uint64(ngram_join.GROUPS)
    sets = [s, s[:-1000]]
    points = np.stack([ngram_join.point(x) for x in sets])
    assert points.sum(1).tolist() == [70_000, 69_000]
    both = np.arange(2)
    assert ngram_join.spanning_links(points, sets, both, both, both, ngram_join.Threshold(90, 100)) == [(0, 1)]
    few = np.arange(3 * ngram_join.GROUPS, dtype=np.uint64)
    again = ngram_join.unpacked([ngram_join.packed(ngram_join.point(x)) for x in (sets[0], few)])
    assert again.sum(1).tolist() == [70_000, len(few)] and len(ngram_join.packed(ngram_join.point(few))) == ngram_join.GROUPS


@pytest.mark.parametrize("small", [200_000, 40, 0])
def test_components(spark, monkeypatch, small):
    """By one task from some number of edges on, at once or after some rounds, or by rounds alone; what isn't found raises."""
    monkeypatch.setattr(components_module, "SMALL", small)
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in components(chain).collect()} == {0}
    if not small:
        with pytest.raises(RuntimeError, match="rounds"):
            components(chain, rounds=2)
    assert components(chain.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (5, 5), (None, 3), (4, None)], "a bigint, b bigint")
    assert sorted(map(tuple, components(odd).collect())) == [(1, 1), (2, 1)]


@pytest.mark.parametrize("block", [1000, 5])
@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_ngram_join_of_a_borderline_group(spark, monkeypatch, block, k, num):
    """Copies of one text with many odd words, its base among them or not, and a passage that other texts share."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(12)
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(120)]
        texts += [" ".join(base)] * (g % 2)
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"odd{rng.randint(0, 9)}"
            texts.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{_words(rng, 20)} {passage} {_words(rng, 25)}" for _ in range(30)]
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in map(str.split, texts)]
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = [low if c == high else c for c in comp]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.id: r.component_id for r in ngram_join.classes(df, k, num, 100).collect()}
    assert got == dict(enumerate(comp)) and 30 < len(set(comp)) < len(texts) - 20


def test_suffix_dedup(docs, texts, nothing):
    length = 120
    seen = collections.Counter()
    for _, t in texts:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    want = []
    for d, t in texts:
        b = (t or "").encode()
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        want.append((d, len(b), int(hit.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~hit])).hexdigest()))
    got = [tuple(r)[:5] for r in suffix_dedup.repeats(docs, length).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert suffix_dedup.repeats(nothing).count() == 0


@pytest.mark.parametrize("many,chunk", [(4000, 1 << 20), (3, 700)])
def test_passages_in_words(docs, texts, nothing, monkeypatch, many, chunk):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    n, seen = 12, collections.Counter()
    split = [(d, (t or "").encode().split()) for d, t in texts]
    for _, w in split:
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    want = []
    for d, w in split:
        hit = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                hit[i : i + n] = True
        want.append(str((d, int(hit.sum()))))
    got = suffix_dedup.repeats(docs, 120, words=n).collect()
    assert sorted(str((r.doc_id, r.n_passage_words)) for r in got) == sorted(want)
    plain = sorted(str(tuple(r)[:6]) for r in suffix_dedup.repeats(docs, 120).collect())
    assert sorted(str(tuple(r)[:6]) for r in got) == plain  # the removal is the same
    assert suffix_dedup.repeats(nothing, words=n).count() == 0


def test_suffix_dedup_of_crowded_buckets_and_long_texts(docs, spark, monkeypatch):
    plain = sorted(map(str, suffix_dedup.repeats(docs, 120).collect()))
    monkeypatch.setattr(suffix_dedup, "MANY", 3)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1500)
    assert sorted(map(str, suffix_dedup.repeats(docs, 120).collect())) == plain


def test_refine():
    rng = random.Random(1)
    parts = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(20)]
    n = 9
    seen = collections.Counter(p[i : i + n] for p in parts for i in range(len(p) - n + 1))
    for p, found in zip(parts, suffix_dedup.refine(parts, n), strict=True):
        assert found.tolist() == [seen[p[i : i + n]] > 1 for i in range(len(p) - n + 1)]


def test_sharding(docs, texts, nothing):
    got = sharding.shard(docs, 4).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert 0 <= s < 4 and slots == list(range(len(slots)))
    assert sharding.shard(nothing).count() == 0


def test_sharding_divides_only_what_is_too_large(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 2 = 0, 'the same text', concat(id % 500, repeat('x', 5))) as text")
    got = sharding.shard(df, 16).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 0.02 * sizes.mean()
    assert (got[got.doc_id % 2 == 1].merge(df.toPandas(), on="doc_id").groupby("text").shard.nunique() == 1).all()


def test_best_fit_decreasing():
    assert sharding.best_fit_decreasing([4, 8, 1, 4, 2, 1], 10) == [1, 0, 1, 1, 0, 1]
    rng = random.Random(3)
    sizes = [rng.randint(1, 50) for _ in range(300)]
    rooms, want = [], [0] * 300
    for i in sorted(range(300), key=lambda i: (-sizes[i], i)):
        fits = [(r, j) for j, r in enumerate(rooms) if r >= sizes[i]]
        if not fits:
            rooms.append(100)
            fits = [(100, len(rooms) - 1)]
        j = min(fits)[1]
        rooms[j] -= sizes[i]
        want[i] = j
    assert sharding.best_fit_decreasing(sizes, 100) == want


def test_line_dedup(docs, texts, nothing, spark):
    rows = []
    rng = random.Random(8)
    lines = [_words(rng, rng.randint(1, 30)) for _ in range(60)]
    for i in range(40):
        some = [rng.choice(lines) for _ in range(5)]
        w = some[0].split()
        w[rng.randrange(len(w))] = "odd"
        rows.append((i, "\n".join([*some, " ".join(w), "", some[1].upper()])))
    rows += [(100, None), (101, ""), (102, "only")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for num in (80, 90):
        want, before = {}, []
        for i, t in rows:
            for j, line in enumerate((t or "").split("\n")):
                s = set(line.lower().split())
                want[i, j] = bool(s) and any(100 * len(s & o) >= num * len(s | o) for o in before)
                if s:
                    before.append(s)
        assert {(r[0], r[1]): r[2] for r in line_dedup.decide(df, num).collect()} == want
    assert {r.doc_id for r in line_dedup.dedup(df).collect()} == {r[0] for r in rows}
    assert line_dedup.by_document(docs).count() == len({i for i, _ in texts})
    assert line_dedup.dedup(docs).count() == len(texts) and line_dedup.dedup(docs).columns == docs.columns
    assert line_dedup.decide(nothing).count() == 0


def test_line_dedup_of_near_copies(spark):
    """Lines with odd tokens beside the line that most texts have: its hub is not the first, and some link with other copies alone."""
    rng = random.Random(15)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(160):
        w = list(base) if i > 8 and i % 3 == 0 else [x if rng.random() > 0.05 else f"odd{rng.randint(0, 5)}" for x in base]
        w += [f"end{rng.randint(0, 1)}"] * rng.randint(0, 1)
        rows.append((i % 120 if i % 40 else None, "\t".join(w) + "\n" + _words(rng, 12), "kept", 5))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `__gone` string, `__gone_id` int").repartition(3)
    # rows without identifier come first; rows that share one are ties line by line
    lines = [((-1 if d is None else d, j), frozenset(x.lower().split())) for d, t, *_ in rows for j, x in enumerate(t.split("\n"))]
    for num in (80, 90):
        own = {}
        for at, s in lines:
            own[s] = min(own.get(s, at), at)
        gone = {s: any(own[o] < own[s] and 100 * len(s & o) >= num * len(s | o) for o in own) for s in own}
        want = collections.Counter((at[0], at[1], gone[s] or at > own[s]) for at, s in lines)
        got = collections.Counter((-1 if r.doc_id is None else r.doc_id, r.line_no, r.removed) for r in line_dedup.decide(df, num).collect())
        assert got == want and any(gone.values())
    kept = line_dedup.dedup(df)
    assert kept.columns == df.columns and {r["__gone"] for r in kept.collect()} == {"kept"} and kept.count() == len(rows)


def test_line_dedup_in_any_order_of_tokens(spark, monkeypatch):
    """Rarity is counted in a sample, which may not change a result; numbers and parities are those of the distinct tokens."""
    rng = random.Random(21)
    some = [f"{_words(rng, 25)} same" for _ in range(40)]
    rows = [(i, "\n".join([" ".join(rng.sample(w := rng.choice(some).split(), len(w))) + rng.choice(["", " odd", f" end{i}"]), "same"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ranks = line_dedup.rarity(df, "doc_id", "text")
    held = [r >> 56 for r in df.limit(1).select(ranks).first()[0]]
    assert len(held) == line_dedup.CELLS and max(held) in range(10, 25)  # of all 800 the word "same" has 29

    before, want = [], {}
    for i, t in rows:
        for j, line in enumerate(t.split("\n")):
            s = set(line.split())
            want[i, j] = any(100 * len(s & o) >= 90 * len(s | o) for o in before)
            before.append(s)
    for order in (ranks, line_dedup._constant([0] * line_dedup.CELLS), line_dedup._constant([(126 - r) << 56 for r in held])):
        monkeypatch.setattr(line_dedup, "rarity", lambda *_, order=order: order)
        assert {(r[0], r[1]): r[2] for r in line_dedup.decide(df).collect()} == want
    of = line_dedup.lines(df).select(line_dedup._hashes(F.col("line")).alias("hashes")).select("*", line_dedup._numbers(F.col("hashes"), ranks).alias("numbers"))
    assert not of.schema["numbers"].dataType.containsNull  # else they are sorted as objects
    for r in of.select("*", line_dedup._parity(F.col("numbers")).alias("bits")).limit(50).collect():
        odd = {i for i in range(64) if sum(x % 64 == i for x in r.numbers) % 2}
        assert r.numbers == sorted(set(r.numbers)) and len(r.numbers) == len(r.hashes) and {i for i in range(64) if r.bits >> i & 1} == odd


def test_line_dedup_counts_rarity_in_every_document(spark):
    rows = [(i, f"Common common\nword{i}" + " three" * (i % 3 == 0)) for i in range(64)]
    ranks = line_dedup.rarity(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    tokens = [w for _, t in rows for w in t.lower().split()]
    cells = spark.createDataFrame([(w,) for w in tokens], "w string").select(line_dedup._cell(F.xxhash64("w")))
    n = collections.Counter(r[0] for r in cells.collect())
    held = spark.range(1).select(ranks).first()[0]
    assert {c: r >> 56 for c, r in enumerate(held) if r} == {c: round(2 * math.log2(k + 1)) for c, k in n.items()}


def test_langid(docs, texts, nothing, spark):
    rng = random.Random(4)
    stems = {"aa": "kalo mira tuso".split(), "bb": "grent holk strad".split()}
    rows = [(i, " ".join(rng.choice(stems[lang]) + rng.choice(["", "n", "t"]) for _ in range(8)), lang) for i in range(200) for lang in ("aa", "bb")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df)
    test = spark.createDataFrame([(1, "KALO, unmirat"), (2, "xstradx!"), (3, "12 !?"), (4, None)], "doc_id int, text string")
    found, (lang, score) = langid.predict(test, model)
    got = {r.doc_id: (r[lang], r[score]) for r in found.collect()}
    assert got[1][0] == "aa" and got[2][0] == "bb" and got[3] == got[4] == ("und", 0.0) and 0.5 <= got[2][1] <= 1
    found, _ = langid.predict(docs, langid.fit(docs))
    assert found.count() == len(texts)
    found, (lang, _) = langid.predict(docs, langid.fit(nothing))
    assert {r[lang] for r in found.collect()} == {"und"}
    assert langid.predict(nothing, model)[0].count() == 0


def _labelled(spark, make, n=400):
    rows = [(i, *make(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    return df.drop("label"), df.select("doc_id", "label")


def test_toxicity_learns_an_interaction(spark, docs, texts, nothing):
    rng = random.Random(6)

    def make(i):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        return " ".join([_words(rng, 10), "nasty" if a else "fine", "group" if b else "thing"]), int(a and b)

    text, labels = _labelled(spark, make, 1500)
    machine = toxicity.fit(text, labels, "label")
    test = spark.createDataFrame([(1, "a Nasty group"), (2, "nasty thing"), (3, "fine group"), (4, None)], "doc_id int, text string")
    scored, name = toxicity.score(test, machine)
    assert {r.doc_id for r in scored.collect() if r[name] >= 0.5} == {1}
    scored, name = toxicity.score(docs, machine)
    assert name not in docs.columns and scored.count() == len(texts) and all(0 <= r[name] <= 1 for r in scored.collect())
    none, name = toxicity.score(docs, toxicity.fit(text, labels.where("label = 7"), "label"))
    assert max(r[name] for r in none.collect()) < 0.5
    assert toxicity.score(nothing, machine)[0].count() == 0


@pytest.mark.parametrize("toxic,clean,held", [(350, 1200, 4), (350, 2950, 4), (350, 9000, 4), (4000, 4000, 10)])
def test_toxicity_keeps_terms_of_few_toxic_rows(toxic, clean, held):
    """More labelled rows take no weight from an insult that only toxic rows hold."""
    rng = np.random.default_rng(9)
    rare, common = toxicity.word_slots(b"rareinsult"), toxicity.word_slots(b"nastyword")

    def row(i, label):
        own = rng.integers(0, 300, 8).tolist() + (list(rare) if label and i < held else []) + (list(common) if label and i >= held else [])
        return label, np.unique(np.array(own, "<i4")).tobytes()

    machine = toxicity.learn([row(i, 1) for i in range(toxic)] + [row(i, 0) for i in range(clean)])
    weights = dict(zip(machine.slots.tolist(), machine.weights.tolist(), strict=True))
    assert all(weights.get(s, 0) > 0 for s in rare)


def test_quality(spark, docs, texts, nothing):
    rng = random.Random(7)

    def make(i):
        if i % 3 == 0:
            return " ".join(w.upper() + "!!" for w in _words(rng, 30).split()), 0
        return _words(rng, 30) + ".", 1

    text, labels = _labelled(spark, make)
    model = quality.fit(text, labels, "label")
    test = spark.createDataFrame([(1, "Some words. And more words here."), (2, "SOME!! WORDS!! HERE!!"), (3, None), (4, "")], "doc_id int, text string")
    scored, name = quality.score(test, model)
    got = {r.doc_id: r[name] for r in scored.collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4]
    assert quality.score(docs, model)[0].count() == len(texts)
    assert quality.score(nothing, quality.fit(text, labels.where("label = 7"), "label"))[0].count() == 0


def test_quality_pairs():
    """Neither statistic tells the labels apart alone."""
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.learn(x, y)
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.95 and any({i, j} == {0, 1} for i, j, _ in model.pairs)


def test_packing_round_trip(docs, texts, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = sorted(tuple(tok.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in texts)
    got = packing.pack(docs, tokenizer_path(), 64, with_ids=True).collect()
    by_seq = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_seq[r.sequence_id].append(r)
    stream = []
    for s in range(len(by_seq)):
        at = 0
        for r in sorted(by_seq[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            stream += np.frombuffer(r.ids, "<u4").tolist()
        assert at == 64 or s == len(by_seq) - 1
    ends = [i for i, x in enumerate(stream) if x == 0]
    docs_back = [tuple(stream[a + 1 : b + 1]) for a, b in zip([-1, *ends[:-1]], ends, strict=True)]
    assert sorted(docs_back) == want or 0 in {x for w in want for x in w[:-1]}
    assert packing.pack(nothing, tokenizer_path()).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    enc = packing.Encoder(tokenizer_path(), most=500)
    rng = random.Random(9)
    bits = ["a", "B", " ", "  ", "\n", "\t", "é", "'s", "1", "<|endoftext|>", "\x85", "\x1c", "日本", "😀", "!!", "\0", "̀", "'ll ", "ñ", " "]
    for _ in range(5):
        some = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1000)]
        assert [x.tolist() for x in enc.batch(some)] == [e.ids for e in enc.tok.encode_batch(some, add_special_tokens=False)]


def test_encoder_cuts_at_line_feeds():
    """Lines share their chunks with other lines, and a batch's new plain chunks are one call."""
    enc = packing.Encoder(tokenizer_path(), most=300)
    calls, quick = [], enc.quick
    enc.quick = lambda text: calls.append(text) or quick(text)
    rng = random.Random(10)
    bits = ["ab", "é.", "'s", "\n", "\n", "\n", " ", "\r", "\t", "\x1c", "\u2003", "\x85", "12", "!!", "<|endoftext|>", "日本", "\0"]
    for few in (5, 8, len(bits), 7):
        some = ["".join(rng.choice(bits[:few]) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
        calls.clear()
        assert [x.tolist() for x in enc.batch(some)] == [e.ids for e in enc.tok.encode_batch(some, add_special_tokens=False)]
        assert len(calls) == 1
    enc.batch(["one.\ntwo three\nfour\n"])
    assert {"one.", "\n", "two", " three", "four"} <= set(enc.index) and "one.\ntwo" not in enc.index


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    all_words = [t for _, t in texts if t]
    items = [(1, " ".join(all_words[0].split()[:20])), (2, "two words"), (3, None), (4, ""), (5, "ONE"), (6, "never to be seen anywhere " * 4), (1, "two"), (None, "alpha1 beta2")]
    items.append((7, " ".join(all_words[-2].split()[100:160])))
    return spark.createDataFrame(items, "item_id bigint, text string"), items


def _hits(texts, items, n=13):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)):
            if w:
                wins[tuple(w[k : k + n])].add(i)
    for d, t in texts:
        w, items_hit = words(t), set()
        hit = np.zeros(len(w), bool)
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if (g := tuple(w[k : k + m])) in wins:
                    hit[k : k + m] = True
                    items_hit |= wins[g]
        ids = sorted(str(i) for i in items_hit if i is not None)
        yield str((d, len(w), int(hit.sum()), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit.sum() and 20 * hit.sum() >= len(w))))


@pytest.mark.parametrize("limit", [32_000_000, 0])
def test_decontamination(docs, texts, benchmark, nothing, limit):
    df, items = benchmark
    got, names = decontam.mark(docs, df, broadcast_bytes=limit)
    assert got.columns == [*docs.columns, *names]
    assert sorted(str(tuple(r)) for r in got.select("doc_id", *names).collect()) == sorted(_hits(texts, items))
    assert decontam.mark(nothing, df, broadcast_bytes=limit)[0].count() == 0
    assert decontam.mark(docs, df.limit(0), broadcast_bytes=limit)[0].where(names[1] + " > 0").count() == 0


def test_langid_looks_many_tokens_up_at_once():
    """Each token's row is what its words' known n-grams give one by one."""
    rng = np.random.default_rng(5)
    tables = {0: {"kalo": rng.normal(size=2), "ü": rng.normal(size=2)}} | {k: {g: rng.normal(size=2) for w in ("kalomi", "grent") for g in langid.ngrams_of(w, k)} for k in (5, 3, 1)}
    model = langid.Model(["aa", "bb"], tables)

    def vector(word):
        if word in tables[0]:
            return tables[0][word]
        for k in langid.ORDERS:
            known = [tables[k][g] for g in langid.ngrams_of(word, k) if g in tables.get(k, {})]
            if known:
                return np.mean(known, 0)
        return np.zeros(2)

    tokens = ["kalo", "kalom", "grenta", "xgrex", "zzz", "kalo\u2014\u00dc", "\u2014", "ttkat"]
    got = langid.Places(model).vectors([t.encode() for t in tokens])
    for t, row in zip(tokens, got, strict=True):
        words = langid.words_of(t.encode())
        want = sum((vector(w) for w in words), np.zeros(2))
        assert np.allclose(row[:2], want, rtol=1e-12, atol=1e-12) and row[2] == len(words)  # sums may differ in their last bit
    assert langid.Places(langid.Model([], {})).vectors([b"word"]).shape == (1, 1) and not langid.Places(model).vectors([]).size


def test_suffix_dedup_cuts_ranges_once(spark, monkeypatch):
    rng = random.Random(31)
    shared = _words(rng, 40)
    df = spark.createDataFrame([(i, f"{_words(rng, 5)} {shared} {_words(rng, 5)}") for i in range(12)], "doc_id bigint, text string")
    want = sorted(map(repr, suffix_dedup.repeats(df, length=60).collect()))
    names, write = [], suffix_dedup.table
    monkeypatch.setattr(suffix_dedup, "MANY", 2)
    monkeypatch.setattr(suffix_dedup, "table", lambda d, name: names.append(name) or write(d, name))
    assert sorted(map(repr, suffix_dedup.repeats(df, length=60).collect())) == want and names == ["ranges", "cut", "repeats"]
