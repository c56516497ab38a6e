"""Each training-data operator against brute force, an exact round trip or held-out accuracy, with nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import attribution, boosting, mixing, packing, perplexity, quality, queries, sharding, simhash, substrings, textstats, tokens, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SYLLABLES = [a + b for a in "bdfgklmnprst" for b in "aeiou"]


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with copies, shared passages, nulls, empty texts, one very long text and repeated rows."""
    rng = random.Random(seed)
    passage = prose(rng, 50)
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice([1, 5, 30, 80, 200]))
        if i % 7 == 0:
            text = f"{text} {passage}\n{prose(rng, 10)}"
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None]), len(text)))
    rows += [(n, None, "en", "a", None), (n + 1, "", None, None, 0), (n + 2, " \t\n", "en", "b", 3), (n + 3, prose(rng, 5000), "en", "a", 1), (n + 4, rows[3][1], "de", "b", 1)]
    near = rows[4][1].split()
    return rows + [(n + 5, rows[7][1], "en", "a", 1), rows[8], rows[8], (None, rows[9][1], "en", "a", 1)] + [(n + 6, " ".join(near + near), "en", "c", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1, 10: tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = ["", " ", "a\xa0 b", "x  y\n\n z ", "\t\ttabs", "don't  stop\r\n<|endoftext|> 12 3456", "é à　 k", "\x1c a\x1d  b", None, "\0a b", "a\0 \0b c\nd", "\n", "\nx", "x\n", "a\nb c", "日本語 текст 🙂🙂 a🙂", " lead", "trail "]


def test_ids_are_those_of_the_library(library):
    e = tokens.Encoder(tokens.default_vocabulary())
    rng = random.Random(7)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "word", "é", "日", "12", "'s", "\t", "."]
    mixed = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(300)]
    for _ in range(2):  # the second time from memory
        texts = [*ODD, *mixed, *(r[1] for r in corpus())]
        assert [np.frombuffer(b, "<u4").tolist() for b in e.ids(texts)] == [library(t) for t in texts]
    assert 50256 in np.frombuffer(e.ids(["hello <|endoftext|> world"])[0], "<u4")


@pytest.mark.parametrize("n, want", [(0, []), (5, [(0, 5)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (24, [(0, 8), (8, 8), (16, 8)])])
def test_cut(n, want):
    assert packing.cut(n, 8) == want


def test_pieces_round_trip(docs, library):
    got = defaultdict(list)
    for r in packing.token_pieces(docs, 64).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], bytes(r["ids"])))
    for i, text, *_ in corpus():
        pieces = sorted(got[i])
        if Counter(p[0] for p in pieces)[0] == 1:
            assert b"".join(p[3] for p in pieces) == np.array([*library(text), 0], "<u4").tobytes()
            assert all(p[2] == 64 for p in pieces[1:])


def least_bins(lengths, capacity):
    """What no packing can go below: all tokens, or the items above a third, of which two share a bin at most (longest with shortest)."""
    large = sorted(n for n in lengths if 3 * n > capacity)
    bins = 0
    while large:
        bins += 1
        if large.pop() + (large[0] if large else capacity) <= capacity:
            large.pop(0)
    return max(bins, -(-sum(lengths) // capacity))


@pytest.mark.parametrize("seed", range(5))
def test_packing(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 100), rng.randint(30, 60), 37, 100]) for _ in range(600)]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "doc_id long, length long, offset string").repartition(3)
    bins = defaultdict(list)
    rows = packing.pack(df, 100).collect()
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(r["doc_id"] for r in rows) == list(range(600))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(own)) and sum(own[-1]) <= 100
    assert len(bins) <= least_bins(lengths, 100) * 1.02 + 1
    assert packing.pack(df.limit(0), 100).count() == 0


def test_sequences_hold_the_ids(docs, library):
    """Every sequence, put together, is the ids of its parts, and the parts of a document are its ids."""
    packed = packing.pack_documents(docs, 64)
    assert packed.columns == packing.pack(packing.token_pieces(docs, 64), 64).columns
    got = defaultdict(dict)
    for r in packing.sequences(packed).collect():
        assert r["length"] <= 64 and len(r["ids"]) == 4 * r["length"]
        assert [p["offset"] for p in r["parts"]] == [sum(q["length"] for q in r["parts"][:k]) for k in range(len(r["parts"]))]
        for p in r["parts"]:
            got[p["doc_id"]].setdefault(p["piece"], bytes(r["ids"])[4 * p["offset"] : 4 * (p["offset"] + p["length"])])
    for i, text, *_ in corpus():
        assert b"".join(got[i][k] for k in sorted(got[i])) == np.array([*library(text), 0], "<u4").tobytes()


def test_ids_of_any_size_go_along(spark):
    """Ids that need more than 16 bits, and columns called ids that hold something else."""
    rows = [(i, np.arange(i, i + 3, dtype="<u4").tobytes() if i % 2 else np.array([70_000, i, 0], "<u4").tobytes(), 3) for i in range(50)]
    for part in (rows, rows[1::2], [(i, b"x" * 5 if i % 3 else None, 3) for i in range(20)], [(i, b"xyzxyz", 3) for i in range(20)], "apart"):
        if part == "apart":  # a task whose ids fit, and one whose ids don't
            part, df = rows, spark.createDataFrame(rows[1::2], "doc_id long, ids binary, length long").coalesce(1).union(spark.createDataFrame(rows[::2], "doc_id long, ids binary, length long").coalesce(1))
        else:
            df = spark.createDataFrame(part, "doc_id long, ids binary, length long").repartition(2)
        got = {r["doc_id"]: r["ids"] for r in packing.pack(df, 8).collect()}
        assert got == {i: b and bytearray(b) for i, b, _ in part}


def brute_pairs(sizes, capacity):
    """The fewest bins for items above a third, by trying all matchings of small inputs."""
    if not sizes:
        return 0
    first, rest = sizes[0], sizes[1:]
    best = 1 + brute_pairs(rest, capacity)
    for i, x in enumerate(rest):
        if first + x <= capacity:
            best = min(best, 1 + brute_pairs(rest[:i] + rest[i + 1 :], capacity))
    return best


def test_large_items_are_matched_best():
    rng = random.Random(0)
    for _ in range(60):
        sizes = [rng.randint(34, 100) for _ in range(rng.randint(1, 8))]
        plan = packing.plan(Counter(sizes), 100)
        spans = [(first, first + -(-count // each)) for (n, rank, first, each, _), count in zip(plan.tolist(), counts_of(plan, sizes), strict=True)]
        assert max(b for _, b in spans) == brute_pairs(tuple(sizes), 100)


def counts_of(plan, sizes):
    have = Counter(sizes)
    rows = plan.tolist()
    return [(rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == r[0] else have[r[0]]) - r[1] for i, r in enumerate(rows)]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_section_tokens(spark, library, rule):
    texts = [t for t in ODD if t is None or "\0" not in t] + ["one\n\n\n\ntwo\n  three\n", "a" * 3000 + "\n" * 40]
    rows = attribution.section_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), rule).collect()
    table = tokens.encoder(tokens.default_vocabulary()).byte_length
    for i, text in enumerate(texts):
        own = sorted((r["section"], r["start"], r["n_chars"], r["n_tokens"], r["n_crossing"]) for r in rows if r["doc_id"] == i)
        lines = re.findall(r"[^\n]*\n|[^\n]+\Z", text or "") or [""]
        assert [r[0] for r in own] == list(range(len(lines))) and [r[2] for r in own] == [len(x) for x in lines]
        assert [r[1] for r in own] == [sum(map(len, lines[:k])) for k in range(len(lines))]
        count, at = [0] * len(lines), 0
        ends = np.cumsum([len(x.encode()) for x in lines])
        for n in table[library(text)].tolist():
            bytes_in = Counter(int(np.searchsorted(ends, b, "right")) for b in range(at, at + n))
            where = {"first": min(bytes_in), "last": max(bytes_in), "most": min(bytes_in, key=lambda k: (-bytes_in[k], k))}[rule]
            count[where] += 1
            at += n
        assert [r[3] for r in own] == count and sum(count) == len(library(text))


def test_given_sections(spark, library):
    """Sections that a column gives cut tokens wherever it likes; empty ones, and empty texts, have none."""
    rng = random.Random(3)
    texts = [prose(rng, 30), "é日本 🙂 text", "", None, "abcdef ghij"]
    starts = [sorted(rng.sample(range(1, len(texts[0])), 9)), [2, 2, 4], [0, 5], None, [9, 3, None, 99]]
    df = spark.createDataFrame([(i, t, s, "clash") for i, (t, s) in enumerate(zip(texts, starts, strict=True))], "doc_id long, text string, cuts array<int>, section string")
    rows = attribution.section_tokens(df, "most", starts=F.col("cuts")).collect()
    table = tokens.encoder(tokens.default_vocabulary()).byte_length
    for i, (text, cuts) in enumerate(zip(texts, starts, strict=True)):
        text = text or ""
        at = sorted(min(c, len(text)) for c in cuts or [] if c is not None)
        at = at if at and at[0] == 0 else [0, *at]
        own = sorted((r["section"], r["start"], r["n_chars"], r["n_tokens"]) for r in rows if r["doc_id"] == i)
        ends = [*at[1:], len(text)]
        assert [r[:3] for r in own] == [(k, a, b - a) for k, (a, b) in enumerate(zip(at, ends, strict=True))]
        where = [max(k for k, a in enumerate(at) if a <= j) for j, c in enumerate(text) for _ in c.encode()]
        count, place = [0] * len(at), 0
        for n in table[library(text)].tolist():
            seen = Counter(where[place : place + n])
            count[min(seen, key=lambda k: (-seen[k], k))] += 1
            place += n
        assert [r[3] for r in own] == count and sum(count) == len(library(text))


def test_fields(spark, library):
    df = spark.createDataFrame([(1, "A title", None, "the body\n", "x"), (2, None, None, None, "x")], "doc_id long, title string, summary string, text string, field string")
    got = {(r["doc_id"], r["field"]): (r["start"], r["n_chars"], r["n_tokens"]) for r in attribution.field_tokens(df, ["title", "summary", "text"]).collect()}
    assert [got[1, f][:2] for f in ("title", "summary", "text")] == [(0, 8), (8, 1), (9, 9)]
    assert sum(v[2] for k, v in got.items() if k[0] == 1) == len(library("A title\n\nthe body\n"))
    assert sum(v[2] for k, v in got.items() if k[0] == 2) == len(library("\n\n"))
    with pytest.raises(ValueError):
        attribution.field_tokens(df, [])


def test_section_rule_is_checked(docs):
    with pytest.raises(ValueError):
        attribution.section_tokens(docs, "other")


# 2: substrings


def brute_substrings(texts, window):
    words = [WORD.findall((t or "").encode()) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.mark.parametrize("window, anchor", [(35, 8), (10, 4), (5, 5)])
def test_substrings(docs, window, anchor):
    rows = docs.withColumn("found", F.lit("clash"))
    got = substrings.without_duplicates(rows, window, anchor).collect()
    want = brute_substrings([r[1] for r in corpus()], window)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in got) == sorted((str(r[0]), *w) for r, w in zip(corpus(), want, strict=True))
    by_id = {r[0]: WORD.findall((r[1] or "").encode()) for r in corpus() if r[0] is not None}
    for r in got:  # each factor stands in its reference
        for f in r["factors"]:
            if r["doc_id"] is not None and f["ref_doc"] in by_id:
                assert by_id[r["doc_id"]][f["start"] : f["start"] + f["length"]] == by_id[f["ref_doc"]][f["ref_start"] : f["ref_start"] + f["length"]]
    assert any(len(r["factors"]) for r in got)


def test_periodic_text_repeats_itself(spark):
    texts = ["a b c " * 40, "x " * 35, "x " * 34, "q " * 70 + prose(random.Random(3), 60)]
    got = substrings.without_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["text"]) for r in got] == brute_substrings(texts, 35)


def brute_parse(texts, window):
    """The greedy parse of each text, word by word: the reference holds every window where it comes first; what comes first is held against the last place."""
    words = [WORD.findall((t or "").encode()) for t in texts]
    places = defaultdict(list)
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            places[tuple(w[i : i + window])].append((d, i))
    out = []
    for d, w in enumerate(words):
        own, i, last = [], 0, len(w) - window
        ref = lambda j: places[tuple(words[d][j : j + window])][-1 if places[tuple(words[d][j : j + window])][0] == (d, j) else 0]  # noqa: B023, E731
        many = lambda j: j <= last and len(places[tuple(words[d][j : j + window])]) > 1  # noqa: B023, E731
        while i <= last:
            if not many(i):
                i += 1
                continue
            begin, (doc, at) = i, ref(i)
            while many(i + 1) and ref(i + 1) == (doc, at + i + 1 - begin):
                i += 1
            own.append((begin, i - begin + window, doc, at))
            i += 1
        out.append(own)
    return out


@pytest.mark.parametrize("window, anchor", [(35, 8), (6, 3)])
def test_factors_are_the_greedy_parse(spark, window, anchor):
    rng = random.Random(window)
    shared = [prose(rng, rng.randint(window, 4 * window)) for _ in range(4)]
    texts = []
    for i in range(40):
        words = " ".join([prose(rng, rng.randint(0, 30)), *rng.choices(shared, k=rng.randint(0, 3)), prose(rng, 5)]).split()
        if len(words) > 20 and i % 3 == 0:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[5], " ".join(texts[6].split()[10:]), "a b c d " * 30, None, ""]
    got = {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in substrings.without_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), window, anchor).collect()}
    want = brute_parse(texts, window)
    assert [got[i] for i in range(len(texts))] == want and sum(map(len, want)) > 40
    words = [WORD.findall((t or "").encode()) for t in texts]
    for d, own in enumerate(want):
        for start, n, doc, at in own:
            assert (doc, at) != (d, start) and words[d][start : start + n] == words[doc][at : at + n]


def thue_morse(n):
    """Two strings whose polynomial hashes modulo 2**64 agree for any base."""
    a = b"a"
    for _ in range(n):
        a += a.translate(bytes.maketrans(b"ab", b"ba"))
    return a.decode(), a.translate(bytes.maketrans(b"ab", b"ba")).decode()


def test_words_that_hash_badly_stay(spark):
    a, b = thue_morse(12)
    around = prose(random.Random(2), 34).split()
    texts = [" ".join([*around[:17], w, *around[17:]]) for w in (a, b)]
    got = substrings.without_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_rows_that_come_again_are_parsed_once(spark, monkeypatch):
    """What is gathered for a text does not grow with the number of rows that are equal to it."""
    text = prose(random.Random(4), 300)
    docs = spark.createDataFrame([(1, text)] * 300 + [(None, text)] * 300 + [(2, "other " + text)], "doc_id long, text string")
    keyed = substrings._keyed(docs)
    found = substrings._parsed(keyed.select("sub_doc", "sub_text", "text"), 35, 8).selectExpr("size(found) as n").collect()
    assert len(found) == 3 and max(r["n"] for r in found) <= 300
    got = substrings.without_duplicates(docs).select("n_words", "n_removed", "text").collect()
    assert Counter(map(tuple, got)) == Counter([(300, 300, "")] * 600 + [(301, 300, "other")])


def test_substrings_of_nothing(none):
    assert substrings.without_duplicates(none).count() == 0


# 3: mixing


def brute_targets(sizes, most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight, target, open_ = {s: 1 + i % 3 for i, s in enumerate(names)}, {}, set(names)
    while open_:
        left = sum(sizes.values()) - sum(target.values())
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > most * sizes[s] + 1e-9]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        open_ -= set(over)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([1, 10, 500, 10000]) for s in [*"abcdefgé", "B", None][: rng.randint(2, 10)]}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, s, rng.randint(0, 400)) for i, s in enumerate(rng.choices(["a", "b", "c", "d", None], [60, 20, 10, 5, 5], k=1500))]
    df = spark.createDataFrame(rows, "doc_id long, source string, words long").withColumn("copies", F.lit("clash"))
    mixed = mixing.mix(df, size=F.col("words"))
    out = mixed.collect()
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(df, size=F.col("words")).collect()}
    assert len(out) == 1500 and {r["doc_id"]: r["copies"] for r in out} == again
    sizes, taken, rate = Counter(), Counter(), Counter()
    for r in out:
        sizes[r["source"]] += r["words"]
        taken[r["source"]] += r["copies"] * r["words"]
        rate[r["source"]] += r["rate"] * r["words"]
        assert 0 <= r["copies"] <= 3
    target = brute_targets(dict(sizes))
    for s in sizes:
        assert taken[s] == pytest.approx(target[s], rel=0.01) and rate[s] == pytest.approx(target[s], rel=1e-3)
    assert mixing.repeated(mixed).count() == sum(again.values())


def brute_param(sizes, target, most=3.0):
    """The dual's solution for one source, by bisection over sizes in plain arithmetic."""
    mean = np.mean(sizes)
    tokens = lambda x: sum(z * min(most, np.exp(min(50.0, x * z / mean))) for z in sizes)
    low, high = -100.0, 100.0 * max(1.0, mean)
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if tokens(middle) < target else (low, middle)
    return low


def test_dual(spark):
    rng = random.Random(5)
    sizes = {"a": [rng.randint(1, 300) for _ in range(300)], "b": [rng.randint(1, 50) for _ in range(40)], "c": [rng.choice([10, 900]) for _ in range(60)], None: [7] * 20}
    rows = [(s, z) for s, own in sizes.items() for z in own]
    counted = spark.createDataFrame(rows, "source string, size long").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = mixing.source_targets(counted)
    for r in mixing.solve(counted, targets).collect():
        if r["target"] < 3 * r["source_size"] * (1 - 1e-9):
            own = sizes[r["source"]]
            want = sum(z * min(3.0, np.exp(brute_param(own, r["target"]) * z / np.mean(own))) for z in own)
            assert sum(z * min(3.0, np.exp(r["param"] * z / np.mean(own))) for z in own) == pytest.approx(want, rel=1e-3)


def test_mix_of_rows_without_own_ids(spark):
    """Null ids, ids that come again and equal rows are rounded row by row."""
    rows = [(None, "a", 10)] * 600 + [(7, "b", 10)] * 500 + [(i, "c", 10) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, words long")
    out = mixing.mix(df, size=F.col("words")).collect()
    assert len(out) == 1400
    for s in "abc":
        own = [r for r in out if r["source"] == s]
        assert sum(r["copies"] * 10 for r in own) == pytest.approx(own[0]["target"], rel=0.01)


def test_many_sources(spark):
    """Sources whose order is found in ranges, more of them than partitions."""
    rng = random.Random(6)
    sizes = {f"s{i:04}": rng.randint(1, 1000) for i in range(500)} | {None: 77}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(5)
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_of_texts_and_of_nothing(docs, none):
    out = mixing.mix(docs.withColumn("target", F.lit("clash"))).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in corpus())
    assert mixing.mix(none).count() == 0


# 4: top-k


@pytest.mark.parametrize("seed", range(4))
def test_top_k(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(200, 6)) * rng.exponential(size=(200, 1))
    x[50:120] = x[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (350, [1.0, None]), (400, [1.0, float("nan")]), (450, [float("inf")]), (None, [1.0] * 6)]
    vectors = topk.quantised(spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, score string"))
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5, block_bytes=(32 << 20, 100, 48, 8)[seed]).collect()
    q = np.floor(x * 256)
    want = []
    for i in range(0, 200, 50):
        order = sorted((j for j in range(200) if j != i), key=lambda j: (-int(q[i] @ q[j]), j))[:5]
        want += [(i, k, j, int(q[i] @ q[j])) for k, j in enumerate(order, 1)]
    assert sorted(map(tuple, got)) == want


def test_short_candidates_are_not_read(spark):
    """Queries whose floors only long candidates can reach meet no others."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 8))
    x[:600] *= 1000
    rows = [(i, np.floor(v * 256).tolist()) for i, v in enumerate(x)]
    seen = []
    held = topk._found

    def found(held_, block, *rest):
        seen.append((len(block), float(block["reach"].min())))
        return held(held_, block, *rest)

    topk._found = found
    try:
        got = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<double>"), F.col("vec_id") < 40, 5).collect()
    finally:
        topk._found = held
    assert len(got) == 200 and seen[0][0] == 40 and seen[0][1] > np.sqrt((np.floor(x[600:] * 256) ** 2).sum(1)).max()
    q = np.floor(x * 256)
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got if r["rank"] == 1} == {(i, 1): max((j for j in range(3000) if j != i), key=lambda j: (int(q[i] @ q[j]), -j)) for i in range(40)}


def test_top_k_of_few(spark):
    two = topk.quantised(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 128)]
    assert topk.top_k(two.limit(0), F.col("vec_id") == 0).count() == 0


# 5: sharding


@pytest.mark.parametrize("n", [0, 5, 16, 1003])
def test_shards(spark, n):
    df = spark.createDataFrame([(i if i % 3 else 7, "x") for i in range(n)], "doc_id long, slot string").repartition(3)
    out = sharding.sharded(df, 16, bucket_bytes=50).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i if i % 3 else 7 for i in range(n))
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert n < 16 or max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_of_whole_records(spark, tmp_path, docs, none):
    """Nulls, empty and very long texts, equal rows and nested columns come through as they are; buckets follow bytes."""
    rows = [*corpus(), (500, "y" * 3_000_000, "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("more", F.struct(F.array(F.lit(1)), F.lit(None).cast("int")))
    sharding.write_shards(df, str(tmp_path / "whole"), 4, bucket_bytes=10_000)
    out = spark.read.parquet(str(tmp_path / "whole")).collect()
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in out) == Counter(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == [0, 1, 2, 3] and all(sorted(x) == list(range(len(x))) for x in slots.values())
    sharding.write_shards(none, str(tmp_path / "none"), 4)
    assert sharding.sharded(none.withColumn("place", F.lit(1)), 4).count() == 0
    assert sharding._scattered(df, 1, 10_000)[2] > 250


def test_shards_are_shuffled_and_written(spark, tmp_path):
    df = spark.range(2000).toDF("doc_id").withColumn("text", F.concat(F.lit("t"), "doc_id"))
    first = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.sharded(df, 4, bucket_bytes=100).collect()}
    assert first == {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.sharded(df, 4, bucket_bytes=100).collect()}
    order = [i for i, _ in sorted(first.items(), key=lambda kv: kv[1])]
    assert abs(np.corrcoef(order, range(2000))[0, 1]) < 0.1
    sharding.write_shards(df, str(tmp_path / "out"), 4, bucket_bytes=100)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["doc_id"]: (r["shard"], r["slot"], r["text"]) for r in got.collect()} == {i: (*s, f"t{i}") for i, s in first.items()}


# 6: rules and perplexity


def brute_stats(text):
    data = (text or "").encode()
    words = WORD.findall(data)
    lines = [x for x in data.split(b"\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics():
    rng = random.Random(9)
    line = prose(rng, 12)
    texts = [r[1] for r in corpus()] + ["a #b\n\na #b\n \n \nx|y", f"{line} {line}\n{line}\n{line}", "é " * 40, "ein zwei " * 9, None]
    for chunk in (texts, texts[:1], [None], []):
        s = textstats.TextStats(pa.array(chunk, pa.string()))
        got = list(zip(*(np.asarray(x).tolist() for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)), strict=True))
        assert got == [brute_stats(t) for t in chunk]
        assert np.isfinite(s.features()).all() and len(s.features()) == len(chunk)


def brute_kn(counts):
    """Interpolated modified Kneser-Ney probabilities by their definition, from a Counter of 4-tuples."""
    levels = {4: dict(counts)}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def discount(n, c):
        have = Counter(levels[n].values())
        n1, n2, n3, n4 = (have[k] for k in (1, 2, 3, 4))
        k = min(c, 3)
        if min(n1, n2, n3) == 0:
            return (0.5, 0.75, 0.9)[k - 1]
        y = n1 / (n1 + 2 * n2)
        return min(max(k - (k + 1) * y * (n2, n3, n4)[k - 1] / (n1, n2, n3)[k - 1], 0.05), k - 0.05)

    def p(g):
        if not g:
            return 1 / perplexity.CLASSES
        own = {x: c for x, c in levels[len(g)].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        c = own.get(g, 0)
        return (c - discount(len(g), c) if c else 0) / total + sum(discount(len(g), x) for x in own.values()) / total * p(g[1:])

    return p


def test_kneser_ney():
    rng = random.Random(0)
    seq = [rng.choice([1, 1, 1, 2, 2, 3, 4, 5]) for _ in range(600)]
    counts = Counter(tuple(seq[i : i + 4]) for i in range(len(seq) - 3))
    pack = lambda g: int(sum(x * perplexity.CLASSES ** (3 - i) for i, x in enumerate(g)))
    model = perplexity.KneserNey(np.array([pack(g) for g in counts]), np.array(list(counts.values())))
    p = brute_kn(counts)
    for g in [*list(counts)[:30], (9, 9, 9, 1), (1, 2, 3, 9), (1, 9, 2, 2), (5, 5, 5, 5)]:
        assert model.log_probability(np.array([pack(g)]))[0] == pytest.approx(np.log(p(g)))
    context = np.array([pack((1, 2, 1, x)) for x in range(perplexity.CLASSES)])
    assert np.exp(model.log_probability(context)).sum() == pytest.approx(1, abs=1e-5)


def test_counts_and_bands(spark, docs, none):
    got = {(r["lang"], r["gram"]): r["c"] for r in perplexity.gram_counts(docs.repartition(3)).collect()}
    want = Counter()
    for _, text, lang, *_ in corpus():
        grams, _ = perplexity._grams(pa.array([text]))
        want.update((lang, int(g)) for g in grams)
    assert got == want and sum(got.values()) == sum(len(r[1] or "") for r in corpus())
    rng = random.Random(4)
    rows = [(i, prose(rng, 120), "en", "a", 1) for i in range(150)]
    rows += [(900, "".join(rng.choices("QXZ#%$|9", k=800)).replace("9", " "), "en", "a", 1), (901, prose(rng, 10) + (" ba" * 100), "en", "a", 1), (902, None, None, "a", 1), (903, prose(rng, 30), "xx", "a", 1)]
    out = {r["doc_id"]: r for r in perplexity.judged(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(out[i]["kept"] for i in range(150)) >= 148
    assert not out[900]["kept"] and not out[900]["base_failed"] and out[901]["base_failed"] and not out[901]["kept"] and out[902]["base_failed"] and out[903]["kept"]
    assert out[902]["perplexity"] is None
    assert perplexity.judged(none).count() == 0


def test_letters_of_any_script(spark):
    """Texts in other scripts are strings of their own letters: shuffled ones are noise, wherever the model is cut."""
    rng = random.Random(6)
    wide = lambda t: "".join(chr(0x430 + ord(c) - 97) if c.isalpha() else c for c in t)
    rows = [(i, wide(prose(rng, 120)), "ru", "a", 1) for i in range(150)]
    noise = [wide(prose(rng, 120)).split() for _ in range(4)]
    for words in noise:
        letters = list("".join(words))
        rng.shuffle(letters)
        rows.append((900 + len(rows), " ".join("".join(letters.pop() for _ in w) for w in words), "ru", "a", 1))
    rows += [rows[0], rows[0], (None, rows[1][1], "ru", "a", 1), (990, "", "ru", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    key = lambda r: (r["doc_id"] is None, r["doc_id"])
    out = sorted(perplexity.judged(docs).collect(), key=key)
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    assert sum(r["kept"] for r in out if r["doc_id"] is not None and r["doc_id"] < 150) >= 148
    assert not any(r["kept"] for r in out if r["doc_id"] is not None and r["doc_id"] >= 900)
    counts = perplexity.gram_counts(docs)
    n = counts.count()
    assert n > 1000
    cut = sorted(perplexity.judged(docs, load=n // 3).collect(), key=key)
    assert [(*r[:-3], r["kept"]) for r in cut] == [(*r[:-3], r["kept"]) for r in out]
    assert [r["perplexity"] or 0 for r in cut] == pytest.approx([r["perplexity"] or 0 for r in out])


def test_model_in_spark(spark, docs):
    counts = perplexity.gram_counts(docs)
    got = perplexity.log_probabilities(counts, held_out=False).collect()
    held = {}
    for r in counts.collect():
        held.setdefault(r["lang"], []).append((r["gram"], r["c"]))
    models = {lang: perplexity.KneserNey(*map(np.array, zip(*x, strict=True))) for lang, x in held.items()}
    assert len(got) == sum(map(len, held.values()))
    for lang, model in models.items():
        own = [r for r in got if r["lang"] == lang]
        assert [r["log_p"] for r in own] == pytest.approx(model.log_probability(np.array([r["gram"] for r in own])), abs=1e-5)
    # characters beyond the first plane differ
    assert perplexity._grams(pa.array(["\U0001f642"]))[0].tolist() != perplexity._grams(pa.array(["\U0001f643"]))[0].tolist()


def brute_percentile(values):
    """The value that half of them do not exceed."""
    own = sorted(values)
    return own[-(-len(own) // 2) - 1]


def test_judged_by_brute_force(spark):
    """``kept`` and perplexity from n-grams of tuples, their Kneser-Ney probabilities by definition, and medians over lists."""
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randint(15, 40)), "ab"[i % 2], "a", 1) for i in range(60)]
    rows += [(100 + i, "".join(rng.choices("qxzv ", k=150)), "ab"[i % 2], "a", 1) for i in range(4)] + [(110, None, "a", "a", 1), (111, "", "b", "a", 1), (112, prose(rng, 25), None, "a", 1)]
    got = {r["doc_id"]: r for r in perplexity.judged(spark.createDataFrame(rows, DOCS), band=2.0).collect()}
    grams = lambda t: [tuple(("\n" * 3 + t)[j : j + 4]) for j in range(len(t))]
    mean, words = {}, {r[0]: brute_stats(r[1]) for r in rows}
    for lang in ("a", "b", None):
        counts = Counter(g for r in rows if r[2] == lang for g in grams(r[1] or ""))
        levels = {4: counts} | {}
        for n in (3, 2, 1):
            levels[n] = Counter(g[1:] for g in levels[n + 1])
        discounts, contexts = {}, {}
        for n, own in levels.items():
            have = Counter(own.values())
            n1, n2, n3, n4 = (have[k] for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 else 0
            discounts[n] = (0.5, 0.75, 0.9) if min(n1, n2, n3) == 0 else tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
            contexts[n] = defaultdict(list)
            for g, c in own.items():
                contexts[n][g[:-1]].append(c)

        def p(g):
            if not g:
                return 1 / perplexity.CLASSES
            own = contexts[len(g)][g[:-1]]  # noqa: B023
            less = discounts[len(g)]  # noqa: B023
            total, c = sum(own), levels[len(g)][g]  # noqa: B023
            back = sum(less[min(x, 3) - 1] for x in own) / total * p(g[1:])
            return (c - less[min(c, 3) - 1]) / total + back if c > 1 else back if total > 1 else p(g[1:])

        for r in rows:
            if r[2] == lang and r[1]:
                mean[r[0]] = float(np.mean([np.log(np.float32(p(g))) for g in grams(r[1])]))
    judged_ = {i: m for i, m in mean.items() if words[i][0] >= 20}
    of = {r[0]: r[2] for r in rows}
    middle = {x: brute_percentile([m for i, m in judged_.items() if of[i] == x]) for x in {of[i] for i in judged_}}
    off = {i: abs(m - middle[of[i]]) / np.sqrt(1 + perplexity.SHORT / len(rows[[r[0] for r in rows].index(i)][1])) for i, m in judged_.items()}
    spread = {x: brute_percentile([o for i, o in off.items() if sum(of[j] == x for j in judged_) < perplexity.LEAST_DOCS or of[i] == x]) for x in middle}
    for i, r in got.items():
        n, *_, again = words[i]
        failed = n < 20 or 100 * again > 30 * n
        assert r["base_failed"] == failed and (r["perplexity"] is None) == (i not in mean)
        if i in mean:
            assert np.log(r["perplexity"]) == pytest.approx(-mean[i], abs=1e-4)
        assert r["kept"] == (not failed and off[i] <= 2.0 * max(spread[of[i]], 0.005))
    assert sum(r["kept"] for r in got.values()) > 20 and sum(not r["kept"] and not r["base_failed"] for r in got.values()) > 3


def test_every_language_is_judged_by_itself(spark):
    """More languages than were once given a model of their own, each with its upper and lower band; a tiny one too."""
    rng = random.Random(8)
    # in language k the letters are moved by k, so no language's prose looks like another's
    moved = lambda t, k: "".join(chr(0x4E00 + 40 * k + ord(c) - 97) if c.isalpha() else c for c in t)
    rows = [(100 * k + i, moved(prose(rng, 60), k), f"l{k:02}", "a", 1) for k in range(56) for i in range(24 if k else 60)]
    rows += [(9000 + k, moved("".join(rng.choices("qxzvwyhjc ", k=400)), k), f"l{k:02}", "a", 1) for k in (0, 30, 55)]
    rows += [(9500 + i, prose(rng, 60), "tiny", "a", 1) for i in range(7)] + [(9600, "".join(rng.choices("QXZVWYHJC ", k=400)), "tiny", "a", 1)]
    out = {r["doc_id"]: r for r in perplexity.judged(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: r["lang"] for i, r in out.items()} == {r[0]: r[2] for r in rows}
    assert not any(out[i]["base_failed"] for i in out if i >= 9000)
    assert [i for i in (9000, 9030, 9055, 9600) if out[i]["kept"]] == []
    assert sum(r["kept"] for i, r in out.items() if i < 9000 or 9500 <= i < 9507) >= 0.98 * len(rows)


# 7: quality


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    p = boosting.Boosted().fit(x[:2000], y[:2000]).predict(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.97
    assert boosting.Boosted(trees=3).fit(x[:50], np.ones(50)).predict(x[:4]) == pytest.approx([0.999] * 4)
    assert len(boosting.Boosted(trees=3).fit(x[:0], y[:0]).predict(x[:4])) == 4

    def walk(m, row):
        score = m.base
        for t in range(m.trees):
            i = 0
            for _ in range(m.depth):
                i = 2 * i + 1 + int(row[m.feature[t, i]] > m.threshold[t, i])
            score += m.value[t, i - len(m.feature[t])]
        return 1 / (1 + np.exp(-score))

    m = boosting.Boosted(trees=10).fit(x, y)
    assert m.predict(x[:20]) == pytest.approx([walk(m, r) for r in x[:20]])


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.2, rng.random() < 0.25
        sentences = [prose(rng, 12) for _ in range(rng.randint(2, 8))]
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(["vilezz", "vilezzon", "vilezzim", "grawk"])
        text = ". ".join(sentences) + "."
        rows.append((i, " ".join(w + "%%" for w in text.split()) if bad else text, "en", "a", 1))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return rows, labels


def test_quality(spark):
    rows, labels = labelled(random.Random(1), 400)
    df = spark.createDataFrame([*rows, (1000, None, None, None, None), (1001, "", None, None, 0), rows[0]], DOCS)
    lab = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality(df, lab, F.col("doc_id") % 2 == 0).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 403 and all(0 <= s <= 1 for s in score.values())
    assert np.mean([(score[i] >= 0.5) == q for i, q, _ in labels if i % 2]) > 0.98
    assert quality.quality(df, lab.limit(0)).count() == 403


# 8: toxicity


def test_toxicity(spark):
    rows, labels = labelled(random.Random(2), 500)
    df = spark.createDataFrame([*rows, (1000, None, None, None, None), (1001, " .", None, None, 0), rows[0]], DOCS)
    lab = spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, lab, F.col("doc_id") % 2 == 0).collect()}
    held = [(got[i]["score"] >= 0.3, bool(t)) for i, _, t in labels if i % 2]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert got[1000]["score"] == got[1001]["score"] == 0 and got[1000]["worst"] is None
    for i, text, *_ in rows:  # the sentence found is the one with the word
        if labels[i][2] and got[i]["score"] >= 0.5:
            own = [s for s in toxicity.sentences(text.encode()) if s.split()]
            assert b"vilezz" in own[got[i]["worst"]] or b"grawk" in own[got[i]["worst"]]
    only = toxicity.toxicity(df, lab.filter("toxic = 0"))
    assert only.filter("score >= 0.01").count() == 0


def test_noisy_or():
    m = toxicity.NoisyOr({b"bad ": 5.0, b"badl": 3.0}, -4.0)
    logits = m.sentence_logits(b"A bad one. Fine! badly")
    assert logits == [1.0, -4.0, -1.0]
    p = 1 / (1 + np.exp(-np.array(logits)))
    assert m.score(logits) == pytest.approx(1 - np.prod(1 - p)) and m.score([]) == 0


# 9: SimHash


def brute_fingerprint(text):
    words = [w.decode() for w in WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    nodes = sorted(set(fps))
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def test_fingerprints(docs):
    got = Counter((r["doc_id"], r["fp"] % 2**64) for r in simhash.fingerprints(docs.repartition(2)).collect())
    assert got == Counter((r[0], brute_fingerprint(r[1])) for r in corpus())


@pytest.mark.parametrize("tree", [4, 2048])
def test_links_connect_what_is_near(spark, tree):
    rng = random.Random(tree)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    fps |= {0, 2**64 - 1, 7, 2**63}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = simhash.links(nodes, 3, tree)
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for x, r in brute_components(fps).items():
        want[r].add(x)
    for x in fps:
        got[root.get(signed(x), signed(x))].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    with pytest.raises(ValueError):
        simhash.links(nodes, 4)


def test_a_hot_shard_is_split(spark):
    """Fingerprints that agree on two blocks and on much more: no group of the search grows with them."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(26, 64), rng.randint(0, 12))) for _ in range(6000)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), 3, 256)
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    value = np.array(sorted(fps), np.uint64)
    label = np.arange(len(value))
    for a in range(0, len(value), 500):
        i, j = np.nonzero(np.bitwise_count(value[a : a + 500, None] ^ value[None, :]) <= 3)
        label = simhash._join(label, i + a, j)
    want, got = defaultdict(set), defaultdict(set)
    for x, r in zip(value.tolist(), label.tolist(), strict=True):
        want[r].add(x)
        got[root.get(signed(x), signed(x))].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chains(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, n)}


def test_near_duplicates(spark, docs, none):
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    fp = [(r[0], brute_fingerprint(r[1])) for r in corpus()]
    comp, low = brute_components([f for _, f in fp]), {}
    for i, f in fp:
        if i is not None:
            low[comp[f]] = min(low.get(comp[f], i), i)
    assert got == Counter((i, low[comp[f]]) for i, f in fp)
    assert simhash.near_duplicates(none).count() == 0


# the queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """All tables that the queries read, with an extra column or two of names that operators use, and the same without rows."""
    path, rng = tmp_path_factory.mktemp("tables"), np.random.default_rng(1)
    rows, labels = labelled(random.Random(3), 200)
    docs = spark.createDataFrame([*corpus(), *((r[0] + 1000, *r[1:]) for r in rows)], DOCS)
    docs = docs.select("*", *(F.lit("clash").alias(c) for c in ("size", "score", "n_words", "piece", "section", "fp", "copies", "found", "kept", "x", "shard", "bucket", "row")))
    given = spark.createDataFrame([(i + 1000, q, t, "clash") for i, q, t in labels], "doc_id long, quality int, toxic int, text string")
    vectors = spark.createDataFrame([(i, x.tolist(), "clash") for i, x in enumerate(rng.normal(size=(160, 5)))] + [(7, None, "clash"), (None, [1.0] * 5, "clash")], "vec_id long, embedding array<double>, v string")
    for name, df in (("documents", docs), ("labels", given), ("embeddings", vectors)):
        df.repartition(2).write.parquet(str(path / "full" / f"{name}.parquet"))
        df.limit(0).write.parquet(str(path / "none" / f"{name}.parquet"))
    return path


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, folder, name):
    """Each query over tables with clashing names gives the columns of its contract and whole results, over empty tables none."""
    contract = {
        "op1_pack": "doc_id piece start length ids_crc32 sequence_id offset",
        "op2_substrings": "doc_id n_words n_removed kept_sha256",
        "op3_mix": "doc_id size source_size target taken",
        "op4_topk": "query_id rank vec_id score",
        "op5_shards": "doc_id size text_crc32 law shard slot grown_shard",
        "op6_perplexity": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op7_quality": "doc_id held_out score predicted",
        "op8_toxicity": "doc_id held_out score predicted",
        "op9_simhash": "doc_id fingerprint component_id",
        "op10_tokens": "doc_id section start n_chars n_tokens n_crossing",
    }[name].split()
    df = queries.queries()[name](spark, str(folder / "full"))
    assert df.columns[: len(contract)] == contract
    n = df.count()
    ids = {r["doc_id"] for r in spark.read.parquet(str(folder / "full" / "documents.parquet")).select("doc_id").collect()}
    if name == "op4_topk":
        assert n == 4 * 5
    elif name in ("op1_pack", "op10_tokens"):
        assert {r["doc_id"] for r in df.select("doc_id").collect()} == ids
    else:
        assert n == len(corpus()) + 200 and {r["doc_id"] for r in df.select("doc_id").collect()} == ids
    empty = queries.queries()[name](spark, str(folder / "none"))
    assert empty.columns == df.columns and empty.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/full/{t}.parquet/*.parquet'")
    df = queries.queries()[name](spark, str(folder / "full"))
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert Counter(map(str, ((tuple(r[c] for c in cols)) for r in df.collect()))) == Counter(map(str, want))


def test_pack_query(spark, folder, library):
    """Pieces and crc32 by the library, and sequences without gaps or overlaps, near the fewest there can be."""
    rows = queries.op1_pack(spark, str(folder / "full")).collect()
    want = Counter()
    for r in spark.read.parquet(str(folder / "full" / "documents.parquet")).select("doc_id", "text").collect():
        ids = [*library(r["text"]), 0]
        want.update((r["doc_id"], k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(own)) and sum(own[-1]) <= 2048
    assert len(bins) <= least_bins([r["length"] for r in rows], 2048) + 1


def test_samples_are_bounded(spark):
    """A labelled id that comes often is one document of the sample, and labels that come again one label."""
    rows, labels = labelled(random.Random(4), 60)
    df = spark.createDataFrame([*rows, *[rows[0]] * 3000, *[(1, None, "en", "a", 1)] * 5], DOCS)
    lab = spark.createDataFrame([*labels, *[labels[0]] * 50], "doc_id long, quality int, toxic int")
    met = quality.one_of_each(df, quality.sample_of(lab, "toxic", F.lit(True), 1000), "text").collect()
    assert sorted(r["doc_id"] for r in met) == list(range(60)) and len(quality.sample_of(lab, "toxic", F.lit(True), 7).collect()) == 7
    assert toxicity.toxicity(df, lab).count() == 3065 and quality.quality(df, lab).count() == 3065


def test_query_digests(spark, tmp_path):
    spark.createDataFrame(corpus(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    cut = {r["doc_id"]: r for r in queries.op2_substrings(spark, str(tmp_path)).collect()}
    for r, (n, gone, kept) in zip(corpus(), brute_substrings([r[1] for r in corpus()], 35), strict=True):
        assert tuple(cut[r[0]])[1:] == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    shards = queries.op5_shards(spark, str(tmp_path)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in shards) == want
    assert queries.op9_simhash(spark, str(tmp_path)).filter("length(fingerprint) = 16 and fingerprint = lower(fingerprint)").count() == len(corpus())
    mix = queries.op3_mix(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in mix) == Counter((r[0], len(WORD.findall((r[1] or "").encode()))) for r in corpus())
    assert all(r["taken"] <= 3 * r["size"] for r in mix)
    assert Counter(map(str, queries.op3_mix(spark, str(tmp_path)).collect())) == Counter(map(str, mix))
