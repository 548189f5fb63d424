"""Phrase collocations, hard negatives and substring dedup against brute force, with edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bloom, collocations, counting, hard_negatives, hashing, queries, recompression

from ..compare import assert_same

FOLDER = "/root/testdata/sf0.001"
EDGE = [None, "", "   ", "\n", ".", "a", "A b\tc", "x" * 5000]


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_slot_hard_negatives"])
def test_same_as_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, FOLDER), queries.ORACLES[name], FOLDER)


def phrases(rows, least=10, top=2000):
    out, count, total = [], defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in count.items():
        mine = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and n >= least and p in (q[:2], q[1:]) and 100 * n >= 50 * a for q, n in f.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            mine.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def test_op11_brute_force(spark):
    rnd = random.Random(4)
    words = ["New", "york", "city", "é", "e", "of", "the", "x\x01", "x", "und"]
    rows = [(" ".join(rnd.choice(words) + rnd.choice(["", "", "", ".", ",\n", "\t"]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [("new york city " * 30, "en")] * 3 + [(t, "fr") for t in EDGE]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("word", F.lit("clash")).withColumn("key", F.lit(1))
    for least, top in ((10, 2000), (3, 7)):
        got = collocations.collocations(docs, least=least, top=top).collect()
        assert sorted(map(tuple, got)) == phrases(rows, least, top)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_op11_scores_are_exact(spark):
    rows = [(10**14 + 7, 3 * 10**14 + 1, 2 * 10**14 + 3), (10, 10, 10), (3037000500, 9223372036, 9223372037)]
    got = spark.createDataFrame(rows, "a long, x long, y long").select("a", "x", "y", collocations.exact_score("x", "y").alias("s")).collect()
    assert all(r.s == 1000000 * r.a * r.a // (r.x * r.y) for r in got)


def negatives(rows, every, positives=5, k=3):
    valid = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, lab, v in valid:
        if i % every or (i, lab, tuple(v)) in seen:
            continue
        seen.add((i, lab, tuple(v)))
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=False))  # noqa: B023, E731
        others = sorted(((-score(w), j, m) for j, m, w in valid if j != i), key=lambda t: t[:2])
        for s, j, m in [o for o in others if o[2] == lab][:positives]:
            fit = [o for o in others if o[2] != lab and 50 * -s <= 100 * -o[0] <= 95 * -s][:k]
            out += [(i, j, r, o[1], -s, -o[0]) for r, o in enumerate(fit, 1)]
    return sorted(out)


def embedded(n, seed, wide=1.0):
    rnd = random.Random(seed)
    rows = [(i, [wide * rnd.choice([-0.5, 0, 0.25, 0.5, 0.75, 1.0]) for _ in range(6)], rnd.randrange(3)) for i in range(n)]
    rows += [(None, [1.0] * 6, 1), (n, None, 1), (n + 1, [1.0, None], 1), (n + 2, [float("nan")] * 6, 1), (n + 3, [float("inf")] * 6, 0), (n + 4, [1.0] * 6, None), (n + 5, [], 2), (n + 6, [0.5, 0.5], 0)]
    return rows + rows[7:9] + [rows[0], (0, [1.0] * 6, 1), (2**60 + 1, [0.75] * 6, 1), (2**60 + 3, [0.75] * 6, 1), (2**60 + 3, [0.5] * 6, 0)]


@pytest.mark.parametrize(("block", "shard", "wide"), [(4096, 32768, 1.0), (3, 17, 1.0), (5, 40, 2.0**20)])
def test_op12_brute_force(spark, block, shard, wide):
    rows = embedded(150, 5, wide)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("slot", F.lit("clash")).withColumn("id", F.lit(3))
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 7 == 0, block=block, shard=shard).collect()
    assert sorted(map(tuple, got)) == negatives(rows, 7)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 7 == 0).count() == 0


def test_op12_best_of_ties():
    score = np.array([[5, 5, 5, 1, 9], [1 << 61, 3, 1 << 61, 1 << 61, 0]])
    for s in (score[:1], score):
        i, c = hard_negatives.best(s, np.ones(s.shape, dtype=bool), 2)
        assert sorted(c[i == 0]) == [0, 4]
    i, c = hard_negatives.best(score, np.ones(score.shape, dtype=bool), 2)
    assert sorted(c[i == 1]) == [0, 2]


def without_repeats(rows, length):
    least = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            least[k] = min(least.get(k, 2**63), 2**63 - 1 if i is None else i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - length + 1):
            if least[tuple(w[p : p + length])] < (2**63 - 1 if i is None else i):
                gone.update(range(p, p + length))
        out.append((str(i), len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "few"), [(3, True), (8, True), (8, False), (50, True)])
def test_op13_brute_force(spark, monkeypatch, length, few):
    if not few:
        monkeypatch.setattr(recompression, "BROADCAST_RANGES", -1)
        monkeypatch.setattr(bloom, "MOST_SEGMENTS", 0)
    rnd = random.Random(length)
    passage = [f"w{rnd.randrange(9)}" for _ in range(90)]
    rows = []
    for i in range(60):
        vocab = rnd.choice([1, 2, 400])
        w = [f"v{rnd.randrange(vocab)}" for _ in range(rnd.randrange(70))]
        at = rnd.randrange(60)
        w += passage[at : at + rnd.randrange(90)] + [f"v{rnd.randrange(vocab)}" for _ in range(rnd.randrange(30))]
        rows.append((i, "\t".join(w)))
    rows += [(100 + i, t) for i, t in enumerate(EDGE)]
    rows += [(None, rows[3][1]), (None, " ".join(passage)), (2**60 + 1, " ".join(passage[:60])), (2**60 + 3, " ".join(passage[:60]) + " more"), (5, rows[8][1]), (5, rows[5][1]), (5, rows[5][1]), (2, "p q r " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("id", F.lit("clash")).withColumn("ord", F.lit(0))
    got = recompression.remove_repeated_words(docs, length=length).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == without_repeats(rows, length)
    assert recompression.remove_repeated_words(docs.limit(0)).count() == 0


def test_op13_equal_windows_have_equal_anchors():
    rnd = random.Random(3)
    for _ in range(60):
        length, vocab = rnd.choice([3, 10, 50]), rnd.choice([1, 2, 5, 1000])
        base = [f"w{rnd.randrange(vocab)}" for _ in range(120)]
        docs = []
        for _ in range(6):
            at = rnd.randrange(100)
            docs.append(" ".join([f"w{rnd.randrange(vocab)}" for _ in range(rnd.randrange(40))] + base[at : at + rnd.randrange(100)] + [f"w{rnd.randrange(vocab)}" for _ in range(rnd.randrange(40))]))
        words, bounds = hashing.word_hashes(docs, lower=False)
        every = [w for d in docs for w in d.split()]
        seen = {}
        for i, name, place in zip(*recompression.anchors(words, bounds, length), strict=True):
            assert 0 <= place - i < length
            assert seen.setdefault(tuple(every[i : i + length]), (name, place - i)) == (name, place - i)


def test_bloom_has_all_keys(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 200_000)
    known = bloom.bloom_of(spark.createDataFrame(keys[:, None].tolist(), "h long"), "h")
    assert known.has(keys.view(np.uint64)).all()
    assert known.has(np.random.default_rng(2).integers(0, 2**64 - 1, 100_000, dtype=np.uint64)).mean() < 0.01
    assert not bloom.bloom_of(spark.createDataFrame([], "h long"), "h").has(keys.view(np.uint64)).any()


def test_frequent_marks(spark):
    keys = np.random.default_rng(1).integers(0, 50, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    runs = spark.createDataFrame(__import__("pandas").concat([counting.packed(k, 6) for k in np.split(keys, 5)]), counting.PACKED)
    want = {m: n for m, n in Counter(counting.marks(keys, 6).tolist()).items() if n >= 100}
    assert {r.mark: r.n for r in counting.frequent(runs, 100).collect()} == want
