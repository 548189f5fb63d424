"""The training-data operators against brute force, round trips and edge cases."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat_repair, common, decontaminate, jaccard_join, language_id, line_dedup, line_labels, queries, suffix_dedup, token_output, warc

from ..compare import assert_same

FOLDER = "/root/testdata/sf0.001"
EDGE = [None, "", "   ", "\n", "a", "A b\tc", "x" * 5000, "same text of five words here", "same text of five words here"]


def texts(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    doc = lambda n: [rnd.choice(vocab) for _ in range(n)]
    out, base, hot = [], doc(90), " ".join(doc(40))
    for _ in range(50):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        out.append(" ".join(w))
    out += [" ".join(doc(rnd.randint(1, 40))) + " " + hot + " " + " ".join(doc(rnd.randint(1, 90))) for _ in range(50)]
    return out + EDGE + [hot, hot]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(7)).withColumn("key", F.lit("clash"))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("short_list", [4, 32])
def test_op7_components(docs, rows, short_list):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, short_list=short_list).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("length", "gram"), [(30, 6), (60, 16)])
def test_op10_repeats(spark, rows, length, gram):
    rows = [*rows[:60], (900, "ab" * 100), (901, "é" * 70), (902, "é" * 70)]
    raw = {i: (t or "").encode() for i, t in rows}
    count = Counter(r[p : p + length] for r in raw.values() for p in range(len(r) - length + 1))
    want = {}
    for i, r in raw.items():
        gone = [0] * len(r)
        for p in range(len(r) - length + 1):
            if count[r[p : p + length]] > 1:
                gone[p : p + length] = [1] * length
        want[i] = (len(r), sum(gone), sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1])), bytes(b for b, g in zip(r, gone, strict=True) if not g))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, length=length, gram=gram).collect()}
    assert got == want


@pytest.mark.parametrize("head_anchors", [1, 3, 20])
def test_op10_common_heads_are_dealt_out(spark, monkeypatch, head_anchors):
    """All anchors of one head met in one task: a phrase said over and over, or a passage of very many documents."""
    length, gram, rnd = 30, 6, random.Random(8)
    word = lambda n: "".join(rnd.choice("abcé") for _ in range(n))
    passage, tails = word(45), [word(k) for k in (1, 5, 20)]
    rows = [word(rnd.randint(0, 25)) + passage[rnd.choice((0, 0, 0, 4, 12)) :] + rnd.choice(tails) + word(rnd.randint(0, 25)) for _ in range(60)]
    rows += [word(3) + "is onhe. " * rnd.randint(4, 40) + word(5) for _ in range(20)] + ["q" * 200, "zy" * 20, "zx" * 14 + "z", rows[0]]
    raw = [t.encode() for t in rows]
    count = Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    want = {}
    for i, r in enumerate(raw):
        gone = {k for p in range(len(r) - length + 1) if count[r[p : p + length]] > 1 for k in range(p, p + length)}
        want[i] = (len(gone), bytes(b for k, b in enumerate(r) if k not in gone))
    most, dealt = [], suffix_dedup._deal

    def watched(scratch, anchors, *rest):
        out = dealt(scratch, anchors, *rest)
        most.append(max([r["count"] for r in out[0].groupBy("h").count().collect()], default=0))
        return out

    monkeypatch.setattr(suffix_dedup, "_deal", watched)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, length=length, gram=gram, head_anchors=head_anchors).collect()}
    assert got == want
    assert most and max(most) <= head_anchors


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, FOLDER), queries.ORACLES[name], FOLDER)


def test_op1_edges(docs):
    out = line_dedup.drop_template_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("text is null").count() == 1
    logs = docs.sparkSession.createDataFrame([(i, f"unique words of text {'q' * i}\nuser {i} logged in at {i}:30 today") for i in range(12)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in line_dedup.drop_template_lines(logs, similarity=40).collect()}
    assert "logged in" in left[0] and not any("logged in" in left[i] for i in range(1, 12))


def test_line_dedup_keeps_no_table_but_its_marks(spark, docs):
    """Op1 left every line that it had looked at in the shared folder (it took 3.6 times the input of disk)."""
    from pathlib import Path

    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    tables = lambda: {x for x in folder.glob("gridloom-lines-*/*") if list(x.glob("part-*"))}
    before = tables()
    line_dedup.drop_template_lines(docs)
    assert [x.name.partition("-")[2] for x in tables() - before] == ["gone"]


def test_line_dedup_masks_whole_lines_as_tokens(spark):
    """A line is masked by one pattern; it has to give what each token by itself gives."""
    words = ["a", "7", "<*>", "ab1c", "1", "x-9", "é٣", "日本", "b" * 3000, "c" * 3000 + "5", "a\\", "$1"]
    rnd = random.Random(4)
    rows = [rnd.choices(words, k=rnd.randint(1, 9)) for _ in range(200)]
    got = spark.createDataFrame([(r,) for r in rows], "raw array<string>").select("raw", line_dedup.masked_line(F.col("raw")).alias("line"))
    assert all(r.line == " ".join("<*>" if re.search("[0-9]", t) else t for t in r.raw) for r in got.collect())


@pytest.mark.parametrize("by", ["query", "pipeline"])
def test_repeated_passages_and_templates_go_at_every_size(spark, by):
    import corpus_pipeline

    drop = line_dedup.drop_template_lines if by == "query" else lambda docs: corpus_pipeline.drop_lines(spark, docs, FOLDER)
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("aeinrstl") for _ in range(8))
    passages = {k: " ".join(word() for _ in range(50)) for k in (2, 3, 9)}
    planted = [(100 * k + i, f"{word()} {word()}\n{p}\n{word()}") for k, p in passages.items() for i in range(k)]
    planted += [(5000 + i, " ".join(word() for _ in range(30)) + "\n" + " ".join(str(rnd.randint(0, 99)) for _ in range(25))) for i in range(30)]
    for n in (60, 400, 1000):
        pages = [(10000 + i, f"{word()}\nRead more about events in city{'abcdefghijklmnopqrst'[i % 20]} during month{'abcdefghijklmnopqrst'[i // 3 % 20]} on our news page") for i in range(n)]
        docs = spark.createDataFrame([(i, t, len(t)) for i, t in planted + pages], "doc_id long, text string, n_chars int")
        left = {r.doc_id: r.text for r in drop(docs).collect()}
        assert [i for i, t in left.items() if "Read more" in t] == [10000] and len(left) == len(planted) + n
        for k, p in passages.items():
            assert [i for i, t in left.items() if p in t] == [100 * k]
        assert all(left[i] == t for i, t in planted if i >= 5000)


def test_op2_base_columns_and_viterbi(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for r in line_labels.quality_rules(docs, labels).collect():
        text = dict(rows)[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        mark = [0] * len(w)
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                mark[i] = mark[i + 1] = mark[i + 2] = 1
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(mark))
        lines = text.split("\n")
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text)) and r.n_dup_lines == sum(x in lines[:i] and bool(re.search(r"[^\x20\x09-\x0d]", x)) for i, x in enumerate(lines))
        assert r.base_failed == (len(w) < 50 or 100 * sum(mark) > 50 * len(w)) and r.kept == (not r.base_failed)
    rng = np.random.default_rng(0)
    for _ in range(20):
        score, step = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
        best = max(itertools.product((0, 1), repeat=6), key=lambda y: sum(score[i, y[i]] for i in range(6)) + sum(step[a, b] for a, b in itertools.pairwise(y)))
        assert tuple(line_labels.viterbi(score, step)) == best


def test_op2_fitted_field_marks_lines_within_documents(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("aeinrstl") for _ in range(rnd.randint(3, 8)))
    good = lambda: " ".join(word() for _ in range(12)).capitalize() + "."
    junk = lambda: " | ".join(word().upper() + "$$$" for _ in range(12))
    rows = [(i, "\n".join(good() for _ in range(8)), 1) for i in range(40)] + [(100 + i, "\n".join([good() for _ in range(2)] + [junk() for _ in range(6)]), 0) for i in range(40)]
    planted = [(200 + i, "\n".join([good() for _ in range(5)] + [junk() for _ in range(3)] + [good() for _ in range(4)]), None) for i in range(10)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + planted] + [(None, good()), (999, "dup\ndup\n\n\n#*|")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    known = docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", "quality")
    weights, step = line_labels.fit(known)
    out = {r.doc_id: r for r in line_labels.quality_rules(docs, labels).collect()}
    assert (out[999].n_symbols, out[999].n_dup_lines) == (3, 1)
    for i, text, _ in planted + rows[38:42]:
        x, _ = line_labels.line_features(text)
        score = x @ weights.T
        best = max(itertools.product((0, 1), repeat=len(x)), key=lambda y: sum(score[k, y[k]] for k in range(len(x))) + sum(step[a, b] for a, b in itertools.pairwise(y)))
        assert tuple(out[i].labels) == best
    assert all(0 < out[i].content_share < 1 and list(out[i].labels) == [0] * 5 + [1] * 3 + [0] * 4 and out[i].kept for i, _, _ in planted)
    assert all(out[i].kept == (i < 100) for i, _, _ in rows) and all(0 < out[i].content_share < 0.5 for i in range(100, 140))


def cheapest(roles):
    legal = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}

    def paths(q, label):
        for k in range(3):
            for way in itertools.product((1, 2, 3), repeat=k):
                at = q
                for s in way:
                    if s not in legal[at]:
                        break
                    at = s
                else:
                    if label in legal[at]:
                        yield 3 * k

    best = float("inf")
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        cost, q = 0, 0
        for r, x in zip(roles, labels, strict=True):
            ways = [*paths(q, x), *([1] if q == x else [])]
            cost, q = cost + 2 * (r != x) + min(ways, default=float("inf")), x
        best = min(best, cost + {1: 6, 2: 3, 3: 0}[q])
    return best


@pytest.mark.parametrize("piece", [2, 512])
def test_op3_cost_and_legality(spark, piece):
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", " User", "tool", None]), f"{c}.{t}") for c in range(25) for t in range(rnd.randint(1, 5))]
    out = chat_repair.repair_roles(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), piece).toPandas()
    assert len(out) == len(rows)
    for conv, group in out.groupby("conv_id"):
        assert group["cost"].iloc[0] == cheapest([chat_repair.role_of(r) for c, _, r, _ in rows if c == conv])
        shown = re.findall(r"<\|(system|user|assistant)\|>", "".join(group.sort_values("turn")["rendered"]))
        shown = shown[1:] if shown[0] == "system" else shown
        assert shown == ["user", "assistant"] * (len(shown) // 2)


def test_op4_round_trip(spark):
    pages = [(1, "http://a", "x" * 10), (2, None, "x" * 10), (5, "http://c\nd", None), (4, "http://e", ""), (None, "http://f", "x" * 10), (3, "u", "é")]
    got = sorted(map(tuple, warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string"), roll_bytes=300).collect()), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = {1: (10, "x" * 10, "revisit", 2), 2: (10, "x" * 10, "response", None), 5: (0, "", "response", None), 4: (0, "", "revisit", 5), None: (10, "x" * 10, "revisit", 2), 3: (2, "é", "response", None)}
    assert len(got) == len(pages)
    for r in got:
        n, text, kind, refers = want[r[0]]
        assert r[1:5] == (n, digest(text), kind, refers)


def test_op4_damage_is_found(spark, tmp_path):
    scratch = common.Scratch(spark, "warc")
    manifest = warc.write_warc(spark.createDataFrame([(i, "u", f"{i} page " * 50) for i in range(20)], "page_id long, url string, html string"), str(tmp_path), scratch, shard_bytes=4000)
    assert warc.read_warc(manifest, str(tmp_path)).count() == 20 and manifest.count() > 1
    path = next(tmp_path.glob("*.gz"))
    data = bytearray(path.read_bytes())
    path.write_bytes(data[:-300])
    with pytest.raises(Exception, match="manifest|EOF|digest"):
        warc.read_warc(manifest, str(tmp_path)).collect()
    path.write_bytes(data)
    again = warc.write_warc(spark.createDataFrame([(i, "u", f"{i} page " * 50) for i in range(20)], "page_id long, url string, html string"), str(tmp_path), scratch, shard_bytes=4000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.collect()))


def test_op5_round_trip_and_random_access(spark, docs, rows):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(queries.word_bpe()), 0
    got = {r.doc_id: r for r in token_output.round_trip(docs, queries.word_bpe()).collect()}
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 6, rng.integers(1, 400)).astype(np.int32) for _ in range(20)] + [np.zeros(50, dtype=np.int32), np.array([1], dtype=np.int32)]
    file = token_output.TokenFile(token_output.pack(np.arange(len(arrays)), arrays, 50))
    assert len(file.left) > 0 and (file.all_tokens() == np.concatenate(arrays)).all()
    damaged = bytearray(token_output.pack(np.arange(len(arrays)), arrays, 50))
    damaged[-20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_output.TokenFile(bytes(damaged))
    for i, a in enumerate(arrays):
        assert (file.tokens(i) == a).all() and (file.slice(i, 3, 11) == a[3:11]).all()


@pytest.mark.parametrize("seed", range(6))
def test_op5_grammar_leaves_no_frequent_pair(seed):
    rng = np.random.default_rng(seed)
    passage = rng.integers(0, 20, 300)
    arrays = [rng.integers(0, [2, 6, 20][seed % 3], rng.integers(1, 300)) for _ in range(40)] + [np.concatenate((passage, rng.integers(0, 20, 5))) for _ in range(12)] + [np.full(200, 3)]
    cuts = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
    symbols, first, left, right = token_output.re_pair(np.concatenate(arrays), cuts[:-1], 20, least=4)
    counts, last = Counter(), {}
    for a, b in itertools.pairwise(first.tolist()):
        for k in range(a, b - 1):
            pair = (int(symbols[k]), int(symbols[k + 1]))
            if pair[0] != pair[1] or last.get(pair) != k - 1:
                counts[pair], last[pair] = counts[pair] + 1, k
    assert max(counts.values()) < 4 and max(token_output.lengths(left, right, 20)) > 100
    assert (token_output.Grammar(left, right, token_output.lengths(left, right, 20), 20).expand(symbols) == np.concatenate(arrays)).all()


def test_op5_ids_are_those_of_the_library():
    rnd, encoder = random.Random(8), token_output.LibraryIds(queries.word_bpe())
    cases = ["It's a 12.5% test, <b>x</b>", "", None, "Élan ß ŉ ǅ ª º ² ½ µ", "a\x1cb", "İstanbul", "<|startoftext|>hi", "日本 語", "x" * 3000, "don't 'S 'top ''s"]
    cases += ["".join(chr(rnd.randrange(1, 0x250)) for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    for a in range(0, len(cases), 100):
        for text, ids in zip(cases[a : a + 100], encoder.encode_texts(cases[a : a + 100], 1), strict=True):
            assert ids.tolist() == [*encoder.library.encode(text or "", add_special_tokens=False).ids, 1]


def test_op6_partial_items(spark):
    rnd = random.Random(2)
    items = [(k, " ".join(f"v{rnd.randint(0, 10**6)}" for _ in range(n))) for k, n in enumerate([5, 6, 9, 17, 40, 120, 3])]
    rows = []
    for k, t in items:
        w = t.split()
        for edit in range(4):
            x = list(w)
            for e in range(edit):
                x[(len(x) // (e + 2)) % len(x)] = f"edit{e}"
            rows.append((10 * k + edit, " ".join([f"n{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 700))] + x + ["tail"] * 3)))
    want = set()
    for d, text in rows:
        for k, t in items:
            need = shingles(t) if len(t.split()) >= 5 else frozenset()
            if need and 100 * len(need & shingles(text)) >= 75 * len(need):
                want.add((d, k))
    docs, bench = spark.createDataFrame([*rows, (None, None), (999, "")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, bench).collect()}
    assert got == want and want
    assert decontaminate.contained_items(docs, bench.limit(0)).count() == 0


def test_op6_any_layout(spark):
    rnd = random.Random(4)
    word = lambda: f"v{rnd.randint(0, 10**6)}"
    items, rows = [], []
    for k in range(80):
        w = [word() for _ in range(rnd.randint(15, 48))]
        half = len(w) // 2
        layouts = [w[: half + 1] + w[half:], w[: half + 2] + w[half:], w[: half + 3] + w[half - 3 :], w[half:] + w[:half], w[half:] + [word()] + w[: half + 3]]
        items.append((k, " ".join(w)))
        rows += [(10 * k + i, " ".join([word() for _ in range(20)] + x + [word() for _ in range(20)])) for i, x in enumerate(layouts)]
    want = {(d, k) for d, text in rows for k, t in [items[d // 10]] if 100 * len(shingles(t) & shingles(text)) >= 75 * len(shingles(t))}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, bench).collect()}
    assert got == want and len(want) > 200


def test_op8_against_the_library(rows):
    from tokenizers import Tokenizer

    library, own, rnd = Tokenizer.from_file(queries.word_bpe()), bpe.load(queries.word_bpe()), random.Random(3)
    cases = [t or "" for _, t in rows] + ["<|startoftext|>hi<|endoftext|> there", "It's ΣΑΣ é a\x1cb　c", "日本語🙂", "ab" * 900]
    cases += ["".join(rnd.choice("abcdefgh '’.,!?\n\t0123ÉéüßΣσ日🙂́<|>sS") for _ in range(rnd.randint(0, 50))) for _ in range(300)]
    for text in cases:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_op9_held_out_accuracy(spark):
    docs = common.table(spark, FOLDER, "documents")
    out = language_id.predict_languages(docs)
    assert out.filter("held_out and lang = lang_pred").count() >= 0.95 * out.filter("held_out").count()
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.predict_languages(odd).collect()] == [("und", 0.0)] * 3


@pytest.mark.parametrize("op", ["jaccard", "suffix", "lines", "rules", "bpe", "tokens", "language"])
def test_empty_tables(spark, op):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    run = {
        "jaccard": lambda: jaccard_join.jaccard_components(docs), "suffix": lambda: suffix_dedup.remove_repeats(docs), "lines": lambda: line_dedup.drop_template_lines(docs),
        "rules": lambda: line_labels.quality_rules(docs, labels), "bpe": lambda: bpe.encode_documents(docs, queries.word_bpe()), "tokens": lambda: token_output.round_trip(docs, queries.word_bpe()), "language": lambda: language_id.predict_languages(docs),
    }[op]
    assert run().count() == 0


def test_pipeline_stages_keep_clean_documents(spark):
    import corpus_pipeline

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("aeinrstl") for _ in range(rnd.randint(2, 8)))
    clean = [(i, " ".join(word() for _ in range(80)), "en", "s", 1) for i in range(20)]
    docs = spark.createDataFrame([*clean, (100, clean[3][1], "en", "s", 1), (101, clean[3][1] + " tail", "en", "s", 1), (102, "12345", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER)
        assert docs.columns == before.columns or "ids_sha256" in docs.columns
    assert {r.doc_id for r in docs.collect()} == set(range(20))


def test_pipeline_stages_by_brute_force_with_odd_rows(spark):
    """Null and repeated ids, null and empty texts, ties, and extra columns with the names that operators use."""
    import corpus_pipeline

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("aeinrstlou") for _ in range(rnd.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, items = text(90), [(k, text(30)) for k in range(3)]
    rows = [(i, text(60)) for i in range(25)] + [(None, text(60)), (None, base), (None, None), (30, base), (31, base + " tail"), (32, base), (33, ""), (34, "123 45"), (40, text(50)), (40, text(50)), (40, base), (41, text(20)), (41, text(20) + " " + items[0][1])]
    rows += [(50 + k, text(40) + " " + t + " " + text(10)) for k, t in items] + [(None, text(10) + " " + items[1][1]), (60, text(70)), (60, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.25, True, "x", 7, 8) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, held_out boolean, lang_pred string, id int, key int").repartition(3)
    key = lambda r: (r.doc_id, r.text)

    def run(stage, docs):
        out = stage(spark, docs, FOLDER).collect()
        assert not out or (out[0].score, out[0].held_out, out[0].lang_pred, out[0].id, out[0].key) == (0.25, True, "x", 7, 8)
        return Counter(map(key, out))

    told = run(corpus_pipeline.keep_known_languages, docs)
    assert told == Counter((i, t) for i, t in rows if re.search("[a-z]", t or ""))
    # one of each group: by id, then null and repeated ids; equal rows once
    ids = Counter(i for i, _ in rows)
    order = sorted(set(rows), key=lambda r: (r[0] is None or ids[r[0]] > 1, r[0] or 0, r[1] or ""))
    groups = []
    for r in order:
        s = shingles(r[1])
        near = [g for g in groups if s and any(100 * len(s & shingles(t)) >= 75 * len(s | shingles(t)) for _, t in g if t)]
        groups = [g for g in groups if g not in near] + [[x for g in near for x in g] + [r]]
    kept = run(corpus_pipeline.keep_one_of_each_group, docs)
    assert sum(kept.values()) == len(groups) and max(kept.values()) == 1
    for g in groups:
        left = [r for r in g if kept[r]]
        plain = [r for r in g if r[0] is not None and ids[r[0]] == 1]
        assert len(left) == 1 and (not plain or left[0] == min(plain))
    bench = common.table(spark, FOLDER, "benchmark")
    held = corpus_pipeline.table
    corpus_pipeline.table = lambda *_: spark.createDataFrame([(k, t) for k, t in items], bench.select("item_id", "text").schema)
    try:
        clean = run(corpus_pipeline.drop_contaminated, docs)
    finally:
        corpus_pipeline.table = held
    assert clean == Counter((i, t) for i, t in rows if not any(100 * len(shingles(x) & shingles(t)) >= 75 * len(shingles(x)) for _, x in items))
    assert sum(run(corpus_pipeline.drop_lines, docs).values()) == sum(bool((t or "").strip()) for _, t in rows)


def test_pipeline_stages_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
