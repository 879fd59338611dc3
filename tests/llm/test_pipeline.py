"""The pipeline's stages against plain versions that share no code with the operators, and odd input."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from touchline.llm import quality, token_index

SF = "/root/testdata/sf0.001"
WORD, ITEM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Names that the operators use for columns of their own, among others.
CLASH = ("_id", "_size", "_words", "_part", "_taken", "_mark", "_kept", "_kept_id", "_kept_mark", "size", "key", "tie", "bin", "part", "doc", "row", "taken", "target", "label", "score", "mark", "class", "epochs", "copy", "start", "source_size", "extra", "id", "bytes", "text_hash")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_features(text):
    """(kind, what) of each feature of a text."""
    t = lower(text)
    w = WORD.findall(t)
    pairs = [("pair", p) for p in itertools.pairwise(w)]
    grams = [(n, t[k : k + n]) for n in (3, 5) for k in range(len(t) - n + 1)]
    return [("word", x) for x in w] + pairs + grams + [("text", "")]


def plain_near_copies(rows):
    """Positions that stay: of each class of 5-word shingle sets at 0.75, the row of least id (null if all are)."""
    sets = []
    for r in rows:
        w = WORD.findall(lower(r["text"]))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return [members for members in groups.values()]


def plain_contaminated(text, bench):
    w, hit = ITEM.findall(lower(text)), set()
    at = defaultdict(list)
    for n in {min(13, len(v)) for v in bench}:
        for p in range(len(w) - n + 1):
            at[tuple(w[p : p + n])].append(p)
    for v in bench:
        n = min(13, len(v))
        for k in range(len(v) - n + 1):
            for p in at.get(tuple(v[k : k + n]), ()):
                hit.update(range(p, p + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def plain_mix(rows):
    """Counter of (doc_id, text) that the mix emits."""
    size = lambda r: len(WORD.findall(r["text"] or ""))
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append(r)
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(map(size, sources[s])) for s in names}
    target, left, open_ = {}, sum(total.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        stop = {s for s in open_ if level * weight[s] >= 3 * total[s]}
        if not stop:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in stop:
            target[s] = 3 * total[s]
            left -= target[s]
        open_ -= stop
    out = Counter()
    for s in names:
        budget = math.floor(target[s] + 0.5)
        key = lambda r: (hashlib.md5(f"mix-1:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), size(r))
        while total[s] and budget > 0:
            for r in sorted(sources[s], key=key):
                n = min(budget, size(r))
                if n:
                    out[r["doc_id"], r["text"] if n == size(r) else " ".join(WORD.findall(r["text"])[:n])] += 1
                    budget -= n
    return out


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def key(r):
    return repr((r["doc_id"], r["text"], r["source"]))


def test_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram jaccard join", "benchmark decontamination", "source mixing", "token-id output"]


def test_quality_stage_equals_plain_scores(spark):
    docs, labels = tables(spark)
    model = quality.fit(docs, labels, usable=~quality.held_out("id")).astype(float)
    s, place, want = quality.Settings(), {}, []
    rows = [r.asDict() for r in docs.collect()]
    for r in rows:
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        ids, _ = quality.features(data, np.array([0, len(data)]), s)
        plain = plain_features(r["text"])
        assert len(ids) == len(plain)
        for feature, i in zip(plain, ids.tolist(), strict=True):
            assert place.setdefault(feature, i) == i  # one table row for each feature, in all texts
        total = sum(model[place[f]] for f in plain) / len(plain) + model[-1]
        if not 1 / (1 + math.exp(-total)) < 0.3:
            want.append(key(r))
    assert len(set(place.values())) > 0.6 * min(len(place), 1 << s.table_bits)
    got = corpus_pipeline.reject_low_quality(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(key(r.asDict()) for r in got.collect()) == sorted(want)


def test_one_step_of_gradient_descent_equals_a_plain_one():
    r = np.random.default_rng(1)
    vectors, layer, bias = r.normal(size=(20, 3)), r.normal(size=(3, 2)), r.normal(size=2)
    part = [(1, np.array([2, 5, 7]), np.array([0.5, 0.25, 0.25])), (0, np.array([5]), np.array([1.0]))]
    v, l, b = vectors.copy(), layer.copy(), bias.copy()  # noqa: E741
    new_v, new_l, new_b = v.copy(), l.copy(), b.copy()
    for y, ids, shares in part:
        h = sum(w * v[i] for i, w in zip(ids, shares, strict=True))
        z = [math.exp(sum(h[k] * l[k][c] for k in range(3)) + b[c]) for c in (0, 1)]
        miss = [z[c] / sum(z) - (c == y) for c in (0, 1)]
        for c in (0, 1):
            new_b[c] -= 0.1 * miss[c] / 2
            for k in range(3):
                new_l[k][c] -= 0.1 * quality.LAYER_STEP * h[k] * miss[c] / 2
                for i, w in zip(ids, shares, strict=True):
                    new_v[i][k] -= 0.1 * quality.VECTOR_STEP * w * l[k][c] * miss[c]
    quality.descend(vectors, layer, bias, part, 0.1)
    assert np.allclose(vectors, new_v) and np.allclose(layer, new_l) and np.allclose(bias, new_b)


def test_the_training_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(i, ("good" if i % 2 else "bad") + " x" * 500) for i in range(60)] + [(99, "bad " * 9000)] + [(7, "good again")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(60), 99]], "doc_id long, quality int")
    seen = []
    train = quality.train
    try:
        quality.train = lambda samples, s: seen.append(len(samples)) or train(samples, s)
        for bound in (4000, 25):
            quality.fit(docs, labels, s=quality.Settings(max_train_rows=bound))
        quality.fit(docs, labels.filter("doc_id > 1000"))
    finally:
        quality.train = train
    assert seen == [62, 25]  # 62: all, equal rows once; without labelled documents nothing trains


def test_near_copy_stage_equals_brute_force(spark):
    docs, _ = tables(spark)
    rows = [r.asDict() for r in docs.collect()]
    want = [key(min((rows[i] for i in members), key=lambda r: r["doc_id"])) for members in plain_near_copies(rows)]
    assert len(want) < len(rows)
    assert sorted(key(r.asDict()) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == sorted(want)


def test_contamination_stage_equals_brute_force(spark):
    docs, _ = tables(spark)
    bench = [v for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (v := ITEM.findall(lower(r.text)))]
    rows = [r.asDict() for r in docs.collect()]
    want = [key(r) for r in rows if not plain_contaminated(r["text"], bench)]
    assert len(want) < len(rows)
    assert sorted(key(r.asDict()) for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()) == sorted(want)


def test_mix_stage_equals_a_plain_mix(spark):
    docs, _ = tables(spark)
    got = corpus_pipeline.mix_to_weights(spark, docs, SF)
    assert got.columns == docs.columns and got.schema == docs.schema
    assert Counter((r.doc_id, r.text) for r in got.collect()) == plain_mix([r.asDict() for r in docs.collect()])


def test_run_ends_in_the_ids_of_the_plain_stages(spark):
    from tokenizers import Tokenizer

    docs, labels = tables(spark)
    good = [r.asDict() for r in quality.drop_rejected(docs, labels).collect()]
    rows = [min((good[i] for i in members), key=lambda r: r["doc_id"]) for members in plain_near_copies(good)]
    bench = [v for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (v := ITEM.findall(lower(r.text)))]
    mixed = plain_mix([r for r in rows if not plain_contaminated(r["text"], bench)])
    plain, want, start, copies = Tokenizer.from_file(token_index.tokenizer_file()), [], 0, Counter()
    for i, text in sorted(mixed.elements()):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, copies[i], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        copies[i] += 1
    assert [tuple(r) for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()] == want


def odd_documents(spark):
    """Null and repeated ids, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    texts = ["The plain words of a good text go on and on. " * 3, "", None, " \n", "one", "é" * 10, "word " * 40000, "the same words for all of them here"]
    rows = [(i % 5 if i % 3 else None, texts[i % len(texts)], "en", "s" if i % 2 else None, 7) for i in range(30)]
    rows += [(8, "tied a b c d e f g", "en", "s", 1), (8, "tied a b c d e f h", "en", "s", 1), (9, "own words that no other row has", "en", "s", 1)]
    own = [tuple(f"{c}-{k}" for c in CLASH) for k in range(len(rows))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([a + b for a, b in zip(rows, own, strict=True)], schema)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:4]])
def test_stages_take_odd_rows_and_carry_their_columns(spark, stage):
    docs = odd_documents(spark)
    rows = [r.asDict() for r in docs.collect()]
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    given = {r["_id"]: r for r in rows}  # a column that tells the rows apart
    out = [r.asDict() for r in got.collect()]
    for r in out:
        was = given[r["_id"]]
        assert {k: v for k, v in r.items() if k not in ("text", "n_chars")} == {k: v for k, v in was.items() if k not in ("text", "n_chars")}
    names = Counter(r["_id"] for r in out)
    if stage is corpus_pipeline.mix_to_weights:
        assert Counter((r["doc_id"], r["text"]) for r in out) == plain_mix(rows)
    else:
        assert max(names.values()) == 1 and all(r["text"] == given[r["_id"]]["text"] for r in out)
    if stage is corpus_pipeline.drop_near_copies:
        for members in plain_near_copies(rows):
            worded = [i for i in members if WORD.search(rows[i]["text"] or "")]
            assert sum(rows[i]["_id"] in names for i in worded) == bool(worded)
        assert len({(r["doc_id"], r["text"]) for r in rows if not WORD.search(r["text"] or "")}) == sum(not WORD.search(r["text"] or "") for r in out)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.columns == docs.columns and empty.count() == 0


def test_the_last_stage_takes_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [r.asDict() for r in corpus_pipeline.write_token_ids(spark, docs, SF).orderBy("start").collect()]
    assert len(rows) == docs.count() and rows[0]["doc_id"] is None
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in itertools.pairwise(rows))
    assert corpus_pipeline.write_token_ids(spark, docs.limit(0), SF).count() == 0


def test_run_takes_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
