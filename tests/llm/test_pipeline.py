"""Every stage of the pipeline on its own input, against a plain version."""

import collections
import random
import re

import numpy as np
import pytest

import corpus_pipeline as P
from recordflow.llm.queries import tokenizer_path


def _text(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    top = tmp_path_factory.mktemp("sf")
    items = [(i, _text(rng, 30)) for i in range(5)] + [(9, None)]
    docs, labels = [], []
    for i in range(300):
        t = _text(rng, rng.randint(20, 60))
        toxic = i % 6 == 0
        if toxic:
            t += " nastyword awfulword"
        if i % 4 != 3:
            labels.append((i, 1, int(toxic)))
        if i % 25 == 7:
            t = f"{t} {items[i % 5][1]}"
        docs.append((i, t, "en", "s", len(t)))
    for k in range(1, 40, 3):
        i, t = len(docs), docs[k][1]
        docs.append((i, t.upper(), "en", "s", len(t)))
        w = t.split()
        w[-1] = "last"
        docs.append((i + 1, " ".join(w), None, None, None))
    docs += [(len(docs), None, "en", "s", 0), (len(docs) + 1, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, columns = {}, docs.columns
    for name, stage in P.STAGES:
        got = stage(spark, docs, sf_dir)
        assert name == "packing" or got.columns == columns
        rows[name] = (docs.collect(), got.collect())
        got.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))

    before, after = rows["toxicity"]
    toxic = {r.doc_id for r in before if r.text and "nastyword" in r.text.lower()}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == toxic

    before, after = rows["exact_dedup"]
    best: dict = {}
    for r in before:
        best[(r.text or "").lower()] = max(best.get((r.text or "").lower(), -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values()) and len(before) > len(after)

    before, after = rows["ngram_join"]
    sets = {}
    for r in before:
        w = (r.text or "").lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} - {()})
    comp = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    assert {r.doc_id for r in after} == {i for i in comp if comp[i] == i} and len(before) > len(after)

    before, after = rows["decontam"]
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    wins = {tuple(w[k : k + 13]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if (w := words(r.text)) for k in range(max(1, len(w) - 12))}
    keep = set()
    for r in before:
        w = words(r.text)
        hit = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in wins:
                hit[k : k + 13] = True
        if not (hit.sum() and 20 * hit.sum() >= len(w)):
            keep.add(r.doc_id)
    assert {r.doc_id for r in after} == keep and len(before) > len(after)

    _round_trip(*rows["packing"])


def _round_trip(before, after):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    parts = collections.defaultdict(list)
    for r in after:
        parts[r.doc_id].append(r)
    for r in before:
        ids = b"".join(x.ids for x in sorted(parts.pop(r.doc_id), key=lambda x: x.start))
        assert np.frombuffer(ids, "<u4").tolist() == [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
    assert not parts


def test_run_gives_the_last_stage(spark, sf_dir):
    got = P.run(spark, sf_dir).collect()
    assert got and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got[0].asDict())


def test_empty_documents(spark, sf_dir, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_frames_outlive_the_pipeline(spark, sf_dir):
    """Tables belong to their run: no other run's results go with them."""
    from recordflow.llm import sharding

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = sharding.shard(docs, 4)
    first, second = P.run(spark, sf_dir), P.run(spark, sf_dir)
    assert before.count() == docs.count()
    assert sorted(map(str, first.drop("ids").collect())) == sorted(map(str, second.drop("ids").collect()))


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, repeated rows, rows without identifier, a very long text and columns named like helpers."""
    rng = random.Random(3)
    t = [_text(rng, 40) for _ in range(4)]
    rows = [(1, t[0]), (1, t[0]), (2, t[0].upper()), (3, None), (4, None), (5, ""), (None, t[1]), (None, t[1]), (None, None), (6, " ".join(t[2].split()[:-1])), (7, t[2]), (8, _text(rng, 20_000)), (9, t[3] + " nastyword awfulword")]
    rows = [(None if i is None else 1000 + i, x) for i, x in rows]
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    odd = [(*r, None, None, None) for r in given] + [(i, x, None, None, None, 1.5, "k", 7) for i, x in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, `__score` double, kept string, `__gone` int"
    docs = spark.createDataFrame(odd, schema).where("text is not null or doc_id is null or doc_id > 999").repartition(3)
    docs = docs.where("doc_id is null or doc_id > 999 or text <> ''")
    seen = {}
    for name, stage in P.STAGES:
        got = stage(spark, docs, sf_dir)
        seen[name] = sorted(str(r.doc_id and r.doc_id - 1000) for r in got.where("doc_id is null or doc_id > 999").select("doc_id").distinct().collect())
        assert name == "packing" or got.columns == docs.columns
        if name in ("toxicity", "exact_dedup"):
            docs = spark.createDataFrame(got.collect(), schema)
            assert got.where("doc_id is null").count() == (3 if name == "toxicity" else 1)
    assert seen["toxicity"] == sorted({str(i and i - 1000) for i, _ in rows if i != 1009})
    assert seen["exact_dedup"] == sorted(["2", "5", "6", "7", "8", "None"])  # 5: null is empty; None: of two equal rows one
    assert seen["ngram_join"] == sorted(["2", "5", "6", "8", "None"])
    assert seen["decontam"] == seen["exact_dedup"] and seen["packing"] == seen["exact_dedup"]
    none = docs.limit(0)
    assert all(stage(spark, none, sf_dir).count() == 0 for _, stage in P.STAGES)
