"""The corpus pipeline against its stages written out by hand, on a small fixture."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from tidemark.llm import nearcopies, tokens

from test_operators import DOCS, brute_components, brute_fingerprint, brute_substrings, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """160 documents: a fifth toxic, exact and near copies of long ones, a passage that several share."""
    rng = random.Random(5)
    passage, rows, labels = prose(rng, 60), [], []
    for i in range(160):
        toxic = i % 5 == 0
        text = ". ".join(prose(rng, 15) for _ in range(rng.randint(2, 6)))
        if toxic:
            text += ". " + prose(rng, 4) + " " + rng.choice(["vilezz", "grawk"]) + " " + prose(rng, 4)
        if i % 9 == 1:
            text += " " + passage
        rows.append((i, text, "en", rng.choice("aab"), len(text)))
        labels.append((i, 1, int(toxic)))
    long_ = prose(rng, 1500)
    words = long_.split()
    rows += [(200, long_, "en", "a", 1), (201, long_, "de", "b", 1), (202, " ".join([*words[:700], "changed", *words[701:]]), "en", "a", 1), (203, None, None, None, None), (204, "", "en", "b", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), rows, labels


def test_stages(spark, folder, tmp_path):
    path, rows, labels = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append([tuple(r) for r in docs.collect()])
    clean, single, cut, mixed, packed = kept
    toxic = {i for i, _, t in labels if t}
    assert not toxic & {r[0] for r in clean} and len(clean) == len(rows) - len(toxic)
    # one of each group of near-equal fingerprints, the smallest id; empty texts are a group
    fp = {r[0]: brute_fingerprint(r[1]) for r in clean}
    comp, low = brute_components(fp.values()), {}
    for i in sorted(fp):
        low.setdefault(comp[fp[i]], i)
    assert Counter(single) == Counter(r for r in clean if low[comp[fp[r[0]]]] == r[0])
    assert {200, 203} <= {r[0] for r in single} and not {201, 204} & {r[0] for r in single}
    want = {r[0]: w[2] for r, w in zip(single, brute_substrings([r[1] for r in single], 35), strict=True)}
    assert {r[0]: r[1] for r in cut} == want and all(r[4] == len(r[1]) for r in cut) and len(cut) == len(single)
    times = Counter(r[0] for r in mixed)
    assert max(times.values()) <= 3 and {r for r in mixed} <= {r for r in cut}
    sizes, taken = Counter(), Counter()
    for r in cut:
        sizes[r[3]] += len(r[1].split())
        taken[r[3]] += len(r[1].split()) * times[r[0]]
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.02)
    encode = tokens.encoder(tokens.default_vocabulary()).ids
    lengths = {r[0]: len(np.frombuffer(encode([r[1]])[0], "<u4")) + 1 for r in cut}
    assert sum(r[3] for r in packed) == sum(n * lengths[i] for i, n in times.items())
    bins = Counter()
    for r in packed:
        bins[r[5]] += r[3]
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1


def test_run(spark, folder):
    path, *_ = folder
    assert corpus_pipeline.run(spark, path).columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]


def test_one_row_of_a_group_stays(spark, folder):
    """Repeated rows and rows without id are members of their groups like any others."""
    path, *_ = folder
    rng = random.Random(11)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a, "en", "a", 1)] * 5 + [(2, a, "en", "a", 1), (None, a, "en", "a", 1), (None, b, "en", "a", 1), (None, b, "en", "b", 1), (3, c, "en", "a", 1), (4, d, "en", "a", 1), (4, d, "en", "b", 1), (None, None, None, None, None), (None, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = corpus_pipeline.keep_one_of_near_copies(spark, docs, path)
    assert out.dtypes == docs.dtypes
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows) and Counter((r[0], r[1] or "") for r in got) == Counter([(1, a), (None, b), (3, c), (4, d), (None, "")])


@pytest.mark.parametrize("small", [16, 2])
def test_near_copies_of_five_word_shingles(spark, small):
    """Planted copies with 0.8 to 0.95 of their five-word shingles in common, and pairs well below, by brute force."""
    rng = random.Random(12)
    rows, near, far = [], [], []
    for i in range(60):
        words = prose(rng, 300).split()
        rows.append((2 * i, " ".join(words)))
        for at in rng.sample(range(10, 290, 7), 1 + i % 5 if i % 6 else 14):
            words[at] = "changed"
        rows.append((2 * i + 1, " ".join(words)))
    sets = {n: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for n, w in ((n, t.split()) for n, t in rows)}
    for i in range(60):
        a, b = sets[2 * i], sets[2 * i + 1]
        (near if len(a & b) / len(a | b) >= 0.8 else far).append((2 * i, 2 * i + 1))
    assert len(near) > 40 and len(far) >= 10
    got = nearcopies.links(spark.createDataFrame(rows, "node long, text string"), small=small).collect()
    assert {tuple(r) for r in got} == set(near)


def test_families_are_searched_in_parts(spark, monkeypatch):
    """Copies of copies, so that most pairs are not similar: connected exactly as all pairs connect them, wherever the family is cut."""
    monkeypatch.setattr(nearcopies, "PART", 20)
    rng = random.Random(14)
    texts = [prose(rng, 120).split()]
    for _ in range(119):
        words = list(rng.choice(texts))
        for at in rng.sample(range(len(words)), rng.choice([1, 2, 3, 6])):
            words[at] = prose(rng, 1)
        texts.append(words)
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in texts]
    root = list(range(120))
    for a in range(120):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    edges = nearcopies.links(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "node long, text string")).collect()
    got = list(range(120))
    for a, b in edges:
        assert len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        got = [min(got[a], got[b]) if r in (got[a], got[b]) else r for r in got]
    assert got == root and 1 < len(set(root)) < 100 and len(edges) < 120 * 12


EXTRA = ("size", "target", "rate", "score", "n_words", "factors", "copies", "found", "row", "component", "near_id", "pipeline_rest", "a.b")


def test_columns_of_any_name_come_through(spark, folder):
    """Columns named like those that operators use, ids that come again and null ids: each stage returns what it kept, as it was."""
    path, *_ = folder
    rng = random.Random(15)
    rows = [(rng.choice([1, 2, 3, None]), prose(rng, 80), "en", rng.choice(["a", "b", None]), 1) for _ in range(60)] + [(None, None, None, None, None)] * 3
    docs = spark.createDataFrame([(*r, *(f"{c} {i}" for c in EXTRA)) for i, r in enumerate(rows)], DOCS + "".join(f", `{c}` string" for c in EXTRA))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter(tuple(r[5:]) for r in docs.collect())
        out = corpus_pipeline.staged(stage(spark, docs, path), f"test-{name}")
        assert out.dtypes == docs.dtypes
        after = Counter(tuple(r[5:]) for r in out.collect())
        assert set(after) <= set(before) and (name == "mixing" or after == before or name == "near_dedup" and len(before) - len(after) == 2)
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert packed.count() >= docs.count() > 0 and packed.filter("length * 4 <> length(ids)").count() == 0


def test_no_documents(spark, folder, tmp_path):
    path, *_ = folder
    for name in ("documents", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_go(spark, folder):
    path, *_ = folder
    rng = random.Random(13)
    words = prose(rng, 112).split()
    copy = [*words[:50], "changed", *words[51:]]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "a", 1), (2, " ".join(copy), "en", "a", 1), (3, prose(rng, 112), "en", "a", 1)], DOCS)
    assert sorted(r[0] for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, path).collect()) == [1, 3]
