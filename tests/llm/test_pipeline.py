"""The pipeline's stages against brute force, and the registered queries."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline as cp
from vaneflow.llm import common, quality

R = np.random.default_rng(3)
WORDS = [f"v{i}{'a' * (i % 5)}" for i in range(2000)]


def some(n):
    return " ".join(R.choice(WORDS, n))


def changed(text, at):
    w = text.split()
    w[at] = "other"
    return " ".join(w)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    leak, big = some(14), 2**60 + 1
    base, second = some(150), some(160)
    rows = [(i, some(60)) for i in range(60)] + [(100 + i, " ".join(w.upper() + "!!" for w in some(60).split())) for i in range(40)]
    rows += [(200, "Same Text " + some(30)), (202, base), (203, changed(base, 10)), (204, some(30) + " " + leak + " " + some(20)), (205, None), (206, some(30000)), (207, "twice " * 3), (207, "twice " * 3)]
    rows.append((201, rows[100][1].lower()))
    # no ids, ids beyond 2**53 beside them, and two texts under one id
    rows += [(None, "no id but a copy " + some(20)), (None, "second without an id " + some(20)), (big, changed(second, 3)), (big + 2, second), (None, changed(second, 90))]
    rows.append((300, rows[-5][1]))
    rows += [(None, "same text twice without id"), (None, "Same text twice without id"), (301, some(40) + " " + leak), (301, "clean text under an id " + some(40)), (302, changed(base, 70)), (302, "its own " + some(50))]
    rows += [(400, ""), (401, "..."), (402, "!!!")]
    spark.createDataFrame([(i, t, "en", "s", 1, "x", 2.0, 5, "n") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, score double, text_hash int, class_node string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i is not None and i < 140], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    return Counter((max((i for i in g if i is not None), default=None), t) for t, g in groups.items())


def brute_near(rows):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None for w in (words(t) for _, t in rows)]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    classes = defaultdict(list)
    for k, g in enumerate(group):
        classes[g].append(rows[k])
    return classes.values()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    leak = words(spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text)
    for k, (name, stage) in enumerate(cp.STAGES):
        docs = cp.keep(stage(spark, docs, sf_dir), "test-stage")
        if k == 4:
            break
        assert docs.columns == first
        left = [(r.doc_id, r.text) for r in docs.collect()]
        assert not Counter(left) - Counter(rows), name
        if name == "quality":
            ids = {i for i, _ in left}
            assert not ids & set(range(100, 140)) and set(range(60)) <= ids
            score = quality.score_column(quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")), cp.F.col("text"))
            want = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(score >= 0.3).select("doc_id", "text").collect()
            assert Counter(left) == Counter((r.doc_id, r.text) for r in want)
        elif name == "exact_dedup":
            assert Counter((i, lower(t)) for i, t in left) == brute_exact(rows)
        elif name == "jaccard_join":
            for members in brute_near(rows):
                stay = [r for r in left if r in members]
                least = min((i for i, _ in members if i is not None), default=None)
                assert len(stay) == 1 and stay[0][0] == least, members
            assert len(left) == len(list(brute_near(rows)))
        else:
            grams = lambda w: {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
            hit = lambda t: bool(grams(words(t)) & grams(leak))
            assert Counter(left) == Counter(r for r in rows if not hit(r[1]))
            assert any(hit(t) for _, t in rows)
        rows = left
    encoded = docs.collect()
    assert {r.doc_id for r in encoded} == {i for i, _ in rows} and all(r.round_trip for r in encoded)
    assert all(hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() == r.ids_sha256 for r in encoded)


def test_run_is_registered(spark, sf_dir):
    before = common.mark()
    assert __spark_entry__.queries()["pipeline"](spark, sf_dir).count() > 100
    assert common.mark() == before + 1  # the result's own table
    names = ("exact_dedup", "chat_formatting", "sentencepiece", "suffix_dedup", "decontamination", "warc", "sharding", "secrets", "quality", "jaccard_join")
    assert sorted(n for n in __spark_entry__.queries() if n.startswith("op")) == sorted(f"op{i}_{n}" for i, n in enumerate(names, 1))


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
