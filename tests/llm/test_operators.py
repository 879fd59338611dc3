"""Small fixtures for the training-data operators: brute force, round trips, odd input."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import chat, decontaminate, html_text, language_model, lattice, mixing, ngram_join, quality, text_hash, token_index, warc
from touchline.llm.signature_tree import Forest, Similar, join

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mark string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def corpus(seed=1, n=60):
    """Prose with exact and near copies, odd texts, null ids and repeated rows."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["É", "ñandú", "日本", "A.B,"]
    out = []
    for i in range(n):
        out.append((i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 6, 40, 120])))))
    base = out[7][1].split() + ["w%d" % k for k in range(80)]
    for i in range(n, n + 25):
        copy = list(base)
        for _ in range(r.randrange(4)):
            copy[r.randrange(len(copy))] = "x%d" % i
        out.append((i, " ".join(copy).upper() if i % 3 == 0 else "\n".join(copy)))
    out += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "one two"), (205, "one two"), (None, "one two"), (206, "z " * 30000)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s%d" % ((i or 0) % 4) if i != 203 else None, len(t or ""), "x") for i, t in rows], DOCS)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# --- n-gram join


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("cell", [2048, 8])
def test_ngram_join_equals_brute_force(spark, cell):
    rows = corpus()
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * common >= 75 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    want = [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]
    same([tuple(r) for r in ngram_join.ngram_components(table(spark, rows), cell=cell).collect()], want)


def test_ngram_join_of_an_empty_table(spark):
    assert ngram_join.ngram_components(table(spark, [])).count() == 0


def test_near_copies_keep_one_row_of_each_class(spark):
    kept = ngram_join.drop_near_copies(table(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (3, ""), (4, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "mark"]


def test_many_null_ids_fetch_each_text_once(spark):
    base = ["w%d" % k for k in range(40)]
    rows = [(None, " ".join([*base[:20], "x%d" % i, *base[20:]])) for i in range(150)] + [(None, " ".join(base))] * 150 + [(1, " ".join(base))]
    docs = table(spark, rows)
    described = ngram_join.describe(docs).filter("seen is null")
    placed = described.dropDuplicates(["mark"]).selectExpr("1L as hub", "0 as part", "mark", "false as spread", "doc_id", "text_hash")
    assert ngram_join._with_text(placed, ngram_join._texts(docs)).count() <= 150 + 151  # not the square
    got = ngram_join.ngram_components(docs).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {1}


def test_signature_tree_loses_no_link():
    r = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = r.integers(1, 1 << 62, int(r.integers(1, 200)), dtype=np.uint64)
        sets += [np.unique(np.where(r.random(len(base)) < cut, r.integers(1, 1 << 62, len(base), dtype=np.uint64), base)) for cut in (0, 0.03, 0.1, 0.2)]
    similar, tree, plain = Similar(), Forest(len(sets)), Forest(len(sets))
    join(sets, similar, tree)
    for i, j in itertools.combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            plain.union(i, j)
    assert [tree.root(i) for i in range(len(sets))] == [plain.root(i) for i in range(len(sets))]


def test_words_are_hashed_alike_wherever_they_stand():
    import pyarrow as pa

    texts = ["Ab cd", "cd\tAB", None, "", "ab", "x" * 3000 + " é", " "]
    found = []
    for limit in (1, 1 << 20):
        rows = []
        for _, data, offsets in text_hash.slices(pa.array(texts), limit):
            h, at, _, _ = text_hash.words(data, offsets)
            rows += [h[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        found.append(rows)
    assert found[0] == found[1]
    a = found[0]
    assert a[0] == a[1][::-1] and a[4] == a[0][:1] and a[2] == a[3] == a[6] == [] and len(a[5]) == 2


# --- html


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First  para<b>graph</b>.<p>Short.<!-- no --><div class="ad">Buy</div>
<script>var a = "</p>";</script><form>Mail <input></form><ul><li>One<li>Two &lt;3</ul><section id="comments"><p>Nice!</p></section></article>
<aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_article_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph.\nShort.\nOne\nTwo <3"


def test_pages_without_an_article_use_density_and_neighbours():
    long = "The men of the team were in the field and that is what they had to do for all of us. " * 4
    page = f"<body><div><a href=1>one</a> <a href=2>two</a></div><h2>Head</h2><p>{long}</p><p>Short end.</p><p>{'zxc qwe ' * 30}</p><div><a>x</a></div></body>"
    assert html_text.main_text(page).split("\n") == ["Head", long.strip(), "Short end."]
    assert html_text.main_text("<p>Lone words</p>") == "Lone words"


def test_articles_are_evidence_for_the_two_passes():
    long = "The men of the team were in the field and that is what they had to do for all of us. " * 4
    teasers = "<article><a href=1>One more story</a></article><article><a href=2>Another story</a></article>"
    assert html_text.main_text(f"<body><div><p>{long}</p></div>{teasers}</body>") == long.strip()
    assert html_text.main_text(f"<article><p>{long}</p><p>In it.</p></article><div>Out of it.</div>").split("\n") == [long.strip(), "In it."]
    for wrapper in ("class='layout has-sidebar'", "id='page-with-menu'"):
        page = f"<body><div {wrapper}><p>Links</p><article><p>{long}</p><div class=ad>Buy</div></article></div></body>"
        assert html_text.main_text(page) == long.strip()
    assert html_text.main_text(f"<p>{long}</p><div id=comments><article><p>{long}</p></article></div>") == long.strip()
    foreign = "сегодня команда выиграла матч " * 10
    assert html_text.main_text(f"<div><a href=1>меню сайта</a></div><p>{foreign}</p>") == foreign.strip()


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (2, None, "", 1), (3, "v", "<article>x <!-- open", 1), (4, "w", "<", 1), (None, "x", "<article><p>a" + "<div>" * 3000, 1)], "page_id long, url string, html string, text int")
    same([tuple(r) for r in html_text.extract(pages).collect()], [(1, "u", "", 0), (2, None, "", 0), (2, None, "", 0), (3, "v", "x", 1), (4, "w", "<", 1), (None, "x", "a", 1)])
    assert html_text.extract(pages.limit(0)).count() == 0


# --- chat


def test_preferences_share_the_longest_prefix_of_turns(spark):
    turns = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "a", 0), (1, 2, "user", None, 0), (1, 3, "assistant", "bb", 0), (1, 4, "user", "late", 0), (2, 0, None, "q", 0), (None, 0, "user", "lost", 0), (3, 0, "assistant", "", 0)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, prompt int")
    got = {r.pair_id: r for r in chat.format_preferences(chat.reply_pairs(chat.gather_turns(df))).collect()}
    assert set(got) == {1, 3}
    one = got[1]
    assert one.n_prefix == 3 and one.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\na<|end|>\n<|user|>\n<|end|>\n"
    assert one.chosen == "<|assistant|>\nbb<|end|>\n" and one.rejected == "<|assistant|>\na<|end|>\n"
    a, b = map(int, one.chosen_mask.split(":"))
    assert one.chosen[a:b] == "bb<|end|>\n" and one.rejected_mask == "14:23"
    assert got[3].n_prefix == 0 and got[3].chosen == got[3].rejected == "<|assistant|>\n<|end|>\n"
    assert chat.format_preferences(chat.reply_pairs(chat.gather_turns(df.limit(0)))).count() == 0


def test_preferences_of_unequal_length(spark):
    kind = "pair_id long, chosen array<struct<role string, text string>>, rejected array<struct<role string, text string>>"
    rows = [(1, [("user", "a"), ("assistant", "b")], [("user", "a")]), (2, [("user", "a")], [("user", "z"), ("assistant", "b")]), (3, [], [])]
    got = {r.pair_id: (r.n_prefix, r.chosen_mask, r.rejected) for r in chat.format_preferences(spark.createDataFrame(rows, kind)).collect()}
    equal = spark.createDataFrame([(4, [("assistant", "same")], [("assistant", "same")]), (5, [("assistant", "x" * 200000)], [("assistant", "y")])], kind)
    kept = chat.format_preferences(equal, keep_equal=False).collect()
    assert [r.pair_id for r in kept] == [5] and kept[0].chosen_mask == "14:200022" and chat.format_preferences(equal).count() == 2
    assert got == {1: (1, "14:23", ""), 2: (0, "", "<|user|>\nz<|end|>\n<|assistant|>\nb<|end|>\n"), 3: (0, "", "")}


# --- token ids


def test_token_ids_equal_whole_text_encoding(spark):
    from tokenizers import Tokenizer

    rows = corpus() + [(300, "a  b "), (301, " lead"), (302, "don't\n\n stop <|endoftext|> x"), (303, "tab\t sp")]
    plain = Tokenizer.from_file(token_index.tokenizer_file())
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    want, start, seen = [], 0, Counter()
    for i, t in ordered:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, seen[i], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        seen[i] += 1
    got = token_index.token_ids(table(spark, rows).repartition(3), token_index.tokenizer_file())
    same([tuple(r) for r in got.select("doc_id", "copy", "start", "n_tokens", "ids_crc32").collect()], want)
    assert token_index.token_ids(table(spark, []), token_index.tokenizer_file()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1023, 5000])
def test_perfect_hash_is_minimal_and_rejects_strangers(tmp_path, n):
    h = token_index.key_hash(np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64))
    rows = np.zeros(n, token_index._ENTRY)
    rows["mark"], rows["start"] = text_hash.mix(h + np.uint64(1)), np.arange(n)
    if n:
        token_index.write_index(str(tmp_path), 0, h, rows)
        index = token_index.Index(str(tmp_path), 0)
        found, ok = index.find(h)
        assert ok.all() and (found["start"] == np.arange(n)).all() and len(index.table) == n
        assert not index.find(token_index.key_hash(np.arange(n, 2 * n + 99), np.zeros(n + 99, bool), np.zeros(n + 99, np.int64)))[1].any()


# --- vectors


def test_lattice_decoding_is_nearest():
    points = lattice.shortest()
    assert points.shape == (240, 8) and np.allclose((points**2).sum(axis=1), 2) and len(np.unique(points, axis=0)) == 240
    x = np.random.default_rng(2).normal(size=(500, 8)) * 2
    home = lattice.decode(x)
    assert (((x - home) ** 2).sum(axis=1) <= ((x[:, None] - home[:, None] - points) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()


@pytest.mark.parametrize("nodes", [1, 512, 8192, 10**6, 10**7, 10**8, 10**9, 10**10])
def test_lattice_tables_keep_the_miss_bound_at_every_size(nodes):
    scale, points, tables = lattice.plan(nodes)
    missed = 1 - lattice.meetings(scale, points, 0.93, lattice.PROBES, 20000, seed=77) / 20000
    assert missed**tables <= 1.5 * lattice.MISS  # for the error of this simulation
    assert nodes * lattice.unrelated_chance(scale) ** points <= lattice.OCCUPIED  # cells stay sparse
    assert tables * (1 + lattice.PROBES) < 60 * max(1, nodes) ** 0.15  # and a node's rows few


def test_probed_cells_are_the_nearest_ones():
    x = np.random.default_rng(8).normal(size=(2, 50, 8)) * 1.5
    home, asked = lattice.cells(x, 4)
    points = lattice.shortest()
    options = []  # every cell that changes each point to itself or a neighbour, with its squared distance
    for part in x:
        own = np.concatenate([lattice.decode(part)[:, None], lattice.decode(part)[:, None] + points], axis=1)
        options.append((((part[:, None] - own) ** 2).sum(axis=2), own))
    for i in range(50):
        cost = options[0][0][i][:, None] + options[1][0][i][None]
        best = np.argsort(cost, axis=None)[:5]
        names = {int(home[i]): 0, **{int(c): k + 1 for k, c in enumerate(asked[i])}}
        assert len(names) == 5
        for k, flat in enumerate(best):
            a, b = divmod(int(flat), 241)
            there = np.stack([options[0][1][i, a], options[1][1][i, b]])[:, None]
            assert names[int(lattice.cells(there, 4)[0][0])] == k


@pytest.mark.parametrize("planned", [None, 10**9])
def test_planted_pairs_at_the_threshold_are_found(spark, monkeypatch, planned):
    if planned:
        full = lattice.plan(planned)
        monkeypatch.setattr(lattice, "plan", lambda *_: full)
    r = np.random.default_rng(12)
    x = r.normal(size=(1200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.normal(size=(400, 64))
    y -= (y * x[:400]).sum(axis=1, keepdims=True) * x[:400]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    pairs = 0.932 * x[:400] + math.sqrt(1 - 0.932**2) * y
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, pairs]))]
    got = {v.vec_id: v for v in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found = sum(got[1200 + i].component_id == i and got[1200 + i].n_links == 1 for i in range(400))
    assert found >= 396 and sum(v.n_links for v in got.values()) == 2 * found


@pytest.mark.parametrize("cell,chunk", [(1024, 2048), (6, 5)])
def test_near_vectors_equal_brute_force(spark, cell, chunk):
    r = np.random.default_rng(6)
    x = r.normal(size=(60, 16))
    x = np.concatenate([x, x[:20] + 0.1 * r.normal(size=(20, 16)), np.repeat(x[:1], 15, axis=0) + 0.05 * r.normal(size=(15, 16)), x[:10]])
    rows = [(i, [float(np.float32(c)) for c in v], i % 2 if i < 60 else (i - 60) % 2) for i, v in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, rows[0][1], None), (905, [], 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i, j in itertools.combinations(range(n), 2):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        if la is None or la != lb or not a or not b or len(a) != len(b) or None in a or None in b or not np.isfinite(a + b).all() or not any(a) or not any(b):
            continue
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        near[i, j] = near[j, i] = a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.93
    component = [row[0] for row in rows]
    for _ in range(n):
        component = [min([component[i], *(component[j] for j in np.flatnonzero(near[i]))]) for i in range(n)]
    want = [(row[0], int(near[i].sum()), component[i], component[i] == row[0]) for i, row in enumerate(rows)]
    same([tuple(x) for x in lattice.near_vectors(df, cell=cell, chunk=chunk).collect()], want)
    if cell == 1024:
        assert lattice.near_vectors(df.limit(0)).count() == 0


# --- warc


def test_warc_round_trip(spark):
    pages = [(1, "http://a/\nb", "<p>é</p>", 1), (2, "http://b/", "<p>é</p>", 1), (2, "http://b/", "<p>é</p>", 1), (3, None, None, 1), (4, "u", "", 1), (None, "n", "<p>é</p>", 1), (5, "big", "x" * 300000, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, offset int")
    largest = {}
    for i, _, h, _ in pages:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    index = warc.write_archives(df)
    records = warc.read_records(index).collect()
    want = []
    for i, url, h, _ in pages:
        data, top = (h or "").encode(), largest[h or ""]
        kind = "response" if i == top else "revisit"
        want.append((i, " ".join((url or "").split()), kind, None if i == top else top, base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data), data if i == top else None))
    same([(*tuple(r)[:-1], None if r.payload is None else bytes(r.payload)) for r in records], want)
    some = warc.read_records(index.filter("page_id in (1, 5)")).collect()
    assert sorted(r.page_id for r in some) == [1, 5]
    small = warc.read_records(warc.write_archives(df, min_bytes=100)).collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.read_records(warc.write_archives(df.limit(0))).count() == 0


def test_archives_are_read_in_as_many_tasks_as_bytes_ask_for(spark, monkeypatch):
    r = random.Random(5)
    df = spark.createDataFrame([(i, "u", "".join(map(chr, r.choices(range(33, 1000), k=2000)))) for i in range(300)], "page_id long, url string, html string")
    index = warc.write_archives(df)
    monkeypatch.setattr(warc, "TASK", 20000)
    records = warc.read_records(index)
    tasks = index.agg(F.sum("length")).first()[0] // 20000
    assert tasks > 8 and records.rdd.getNumPartitions() >= tasks and records.count() == 300
    most = max(records.groupBy(F.spark_partition_id()).count().collect(), key=lambda x: x[1])[1]
    assert most < 100


def test_a_second_attempt_writes_the_same_bytes_to_another_file(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i % 3}", "p" * (i % 7)) for i in range(200)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}"
    first, second = warc.write_archives(df, folder), warc.write_archives(df.orderBy(F.rand(3)), folder)
    assert not {r.file for r in first.collect()} & {r.file for r in second.collect()}
    contents = lambda index: sorted(open(r.file.removeprefix("file://"), "rb").read() for r in index.select("file").distinct().collect())
    assert contents(first) == contents(second)
    assert sorted(map(tuple, warc.read_records(first).collect())) == sorted(map(tuple, warc.read_records(second).collect()))
    assert not list(tmp_path.glob("*.tmp"))


def test_byte_ranges_are_joined():
    assert warc.ranges(np.array([0, 10, 30, 100]), np.array([10, 10, 5, 5]), gap=10, most=40) == [(0, 3), (3, 4)]


def test_near_copies_of_null_and_repeated_ids_go_by_their_texts(spark):
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (None, "G h i j k l"), (1, "m n o p q r"), (1, "s t u v w x"), (2, "s t u v w x"), (3, ""), (3, " "), (3, " "), (None, None), (None, "")]
    kept = ngram_join.drop_near_copies(table(spark, rows))
    same([(r.doc_id, r.text and r.text.lower()) for r in kept.collect()], [rows[0], rows[1], rows[3], rows[4], rows[6], rows[7], rows[9], rows[10]])
    two = ngram_join.drop_near_copies(table(spark, [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j k")])).collect()  # one class, one id
    assert len(two) == 1


def test_ids_that_do_not_fit_are_refused():
    with pytest.raises(ValueError, match="fit"):
        token_index.Encoder(token_index.tokenizer_file(), 1)


# --- quality


def test_quality_learns_and_scores_odd_texts(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        rows.append((i, " ".join(r.choice(["calm", "clear", "field", "river"] if good else ["BUY", "now!!", "click", "$$$"]) for _ in range(20))))
        labels.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (901, ""), (None, "calm river")]
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, known).collect()
    assert len(got) == len(rows)
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3)
        assert x.held_out == (zlib.crc32(("" if x.doc_id is None else str(x.doc_id)).encode()) % 5 == 0)
        if x.doc_id is not None and x.doc_id < 400 and x.held_out:
            assert x.predicted == int(x.doc_id % 3 > 0)
    assert quality.classify(docs, known.limit(0)).agg(F.min("score"), F.max("score")).first()[:] == (0.5, 0.5)
    assert quality.classify(docs.limit(0), known).count() == 0


def test_training_reads_texts_of_any_length_and_counts_labels_with_a_document(spark):
    good, bad = "calm clear field river " * 5, "BUY now!! click $$$ " * 5
    rows = [(i, good if i % 2 else bad * (40_000 if i == 8 else 1)) for i in range(60)] + [(5, good)] * 3 + [(5, bad)]
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(5000)], "doc_id long, quality int, toxic int")
    read = []

    class Spy(quality.Samples):
        def __getitem__(self, i):
            read.append((i, super().__getitem__(i)))
            return read[-1][1]

    settings = quality.Settings(max_train_rows=61, epochs=1)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "Samples", Spy)
        quality.fit(table(spark, rows), known, s=settings)
    assert len(read) == 61  # labels without a document take no place, and the text of 800 kB is read, too
    assert sum(label for _, (label, _, _) in read) == 31
    assert all(abs(shares.sum() - 1) < 1e-4 for _, (_, _, shares) in read)


def test_rejected_documents_take_no_others_of_their_id_along(spark):
    good, bad = "calm clear field river " * 5, "BUY now!! click $$$ " * 5
    rows = [(i, good if i % 2 else bad) for i in range(200)]
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    odd = [(None, good), (None, bad), (500, bad), (500, good)]
    got = quality.drop_rejected(table(spark, rows + odd), known)
    assert sorted([r.doc_id for r in got.collect()], key=repr) == sorted([*range(1, 200, 2), None, 500], key=repr)
    assert {r.text for r in got.collect()} == {good}


# --- benchmark


def test_contaminated_documents_take_no_others_of_their_id_along(spark):
    item = " ".join("w%d" % i for i in range(13))
    rows = [(None, item), (None, "clean"), (1, "clean too"), (1, item), (2, None)]
    got = decontaminate.drop_contaminated(table(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    same([(r.doc_id, r.text) for r in got.collect()], [rows[1], rows[2], rows[4]])


@pytest.mark.parametrize(("most", "segment"), [(decontaminate.AUTOMATON, decontaminate.SEGMENT), (40, 5)])
def test_hits_equal_brute_force(spark, monkeypatch, most, segment):
    monkeypatch.setattr(decontaminate.segments_of, "__defaults__", (13, segment))
    r = random.Random(8)
    item = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    bench = [(i, " ".join(r.choice(["a", "b", "Ça", "9x", "t-u"]) for _ in range(r.choice([0, 1, 4, 13, 14, 30])))) for i in range(25)] + [(99, None), (3, "repeat of three"), (None, "9x a 9x zz"), (None, "zz zz a")]
    docs = [(i, "; ".join(r.choice(["a", "b", "ÇA", "9X", "zz"]) for _ in range(40)) + " " + (bench[i % 25][1] or "").upper()) for i in range(40)] + [(70, None), (71, ""), (None, "a b"), (72, "zz zz a " + (bench[2][1] or "a")), (73, "zz " * 20000 + "a"), (72, "zz zz a")]
    want = []
    for d, text in docs:
        w, hit, items = item.findall(lower(text)), set(), set()
        for i, t in bench:
            v = item.findall(lower(t))
            n = min(13, len(v))
            for k in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit.update(range(p, p + n))
                        items.add(i)
        ids = ",".join(sorted(str(i) for i in items if i is not None))
        want.append((d, len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    frame = table(spark, docs)
    marks = spark.createDataFrame(bench, "item_id long, text string")
    assert len(decontaminate.write_blocks(marks, most=most)) == 1 or most == 40
    found = decontaminate.judge(decontaminate.find_benchmark(frame, marks, most=most))
    same([tuple(x) for x in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()], want)
    texts = dict(docs)
    for x in found.filter("n_hit > 0 and doc_id < 70").collect():
        for a, b, lo, hi in x.spans:
            assert item.findall(lower(texts[x.doc_id][lo:hi])) == item.findall(lower(texts[x.doc_id]))[a:b]
    assert decontaminate.judge(decontaminate.find_benchmark(frame, marks.limit(0))).filter("contaminated or n_hit > 0").count() == 0
    kept = decontaminate.drop_contaminated(frame, marks, most=most)
    assert kept.columns == frame.columns
    same([(x.doc_id, x.text) for x in kept.collect()], [d for d, x in zip(docs, want, strict=True) if not x[-1]])


@pytest.mark.parametrize(("item", "document"), [("a", "a"), ("a", "a b"), ("a b c", "a b c"), ("a " * 40 + "b", "a")])
def test_work_on_repeated_words_follows_the_document(item, document):
    def took(n):
        machine = decontaminate.Automaton([(1, (item.split() * n)[:n])])
        began = time.perf_counter()
        machine.scan((document.split() * n)[: 2 * n])
        return time.perf_counter() - began

    took(500)
    assert took(32_000) < 20 * max(took(4000), 0.005)


def test_segments_hold_each_window_once():
    words = ["w%d" % i for i in range(100)]
    found = [tuple(s[k : k + 4]) for s in decontaminate.segments_of(words, 4, 7) for k in range(len(s) - 3)]
    assert found == [tuple(words[k : k + 4]) for k in range(97)]
    assert decontaminate.segments_of(words[:2], 4, 7) == [words[:2]] and decontaminate.segments_of([], 4, 7) == []


@pytest.mark.parametrize("window", [1, 2, 3, 4, 13])
def test_anchors_find_every_window(window):
    r = random.Random(window)
    items = [(i, [r.choice("ab") for _ in range(r.randrange(1, 30))]) for i in range(6)]
    machine = decontaminate.Automaton(items, window)
    for _ in range(30):
        words, hit, found = [r.choice("ab") for _ in range(60)], set(), set()
        for i, own in items:
            n = min(window, len(own))
            for k, p in itertools.product(range(len(own) - n + 1), range(len(words) - n + 1)):
                if own[k : k + n] == words[p : p + n]:
                    hit.update(range(p, p + n))
                    found.add(i)
        runs, ids = machine.scan(words)
        assert {p for a, b in runs for p in range(a, b)} == hit and ids == found


# --- language model


def plain_scores(rows):
    """(held out, tokens, known, training tokens, base score, score, score left out) of each text, by counting and looping."""
    texts = [(language_model.fold_of(i), [*words(t), None]) for i, t in rows]

    def count(folds):
        c = [Counter(), Counter(), Counter()]
        for fold, tokens in texts:
            if fold in folds:
                padded = ["<s>", "<s>", *tokens]
                for k in range(2, len(padded)):
                    for n in range(3):
                        c[n][tuple(padded[k - n : k + 1])] += 1
        starts = sum(fold in folds for fold, _ in texts)
        return c, starts, sum(c[0].values()), len(c[0])

    def without(counts, tokens):
        """The counts less those of one text."""
        c, starts, n, _ = counts
        padded, less = ["<s>", "<s>", *tokens], [Counter(), Counter(), Counter()]
        for k, m in itertools.product(range(2, len(padded)), range(3)):
            less[m][tuple(padded[k - m : k + 1])] += 1
        left = [x - y for x, y in zip(c, less, strict=True)]  # Counters keep what is above 0
        return left, starts - 1, n - len(tokens), len(left[0])

    def parts(tokens, counts):
        """(unigram, pair, triple, bucket of the pair's context, bucket of the triple's) of each token."""
        c, starts, n, v = counts
        padded = ["<s>", "<s>", *tokens]
        for k in range(2, len(padded)):
            one, two = padded[k - 1 : k], padded[k - 2 : k]
            before = starts if k == 2 else c[0][tuple(one)]
            before2 = starts if k == 2 else c[1][tuple(two)]
            pair = c[1][tuple(padded[k - 1 : k + 1])] / before if before else 0
            triple = c[2][tuple(padded[k - 2 : k + 1])] / before2 if before2 else 0
            yield (c[0][(padded[k],)] + 1) / (n + v + 1), pair, triple, bucket(before), bucket(before2)

    def bucket(x):
        return x if x < 4 else min(17, 2 + int(math.log2(x)))

    def rounded(ratio):
        """The ratio as its half-octave bin's middle."""
        return 2 ** ((min(max(math.floor(math.log2(ratio) * 2), -127), 127) + 0.5) / 2) if ratio else 0

    main, full = count({0, 1, 4, 5, 6}), count({0, 1, 3, 4, 5, 6})
    held = [(low, high, rounded(p / u), rounded(t / u)) for fold, tokens in texts if fold == 3 for u, p, t, low, high in parts(tokens, main)]
    a, b = [0.0] + [0.5] * 17, [0.0] + [0.5] * 17
    for _ in range(60):
        got_a, all_a, got_b, all_b = ([0.0] * 18 for _ in range(4))
        for low, high, p, t in held:
            x, y, z = a[high] * t, (1 - a[high]) * b[low] * p, (1 - a[high]) * (1 - b[low])
            got_a[high] += x / (x + y + z)
            all_a[high] += 1
            got_b[low] += y / (x + y + z)
            all_b[low] += (y + z) / (x + y + z)
        for weights, got, whole in ((a, got_a, all_a), (b, got_b, all_b)):
            mean = sum(got[1:]) / sum(whole[1:]) if sum(whole[1:]) else 0.5
            for k in range(1, 18):
                weights[k] = min(max(got[k] / whole[k] if whole[k] else mean, 1e-6), 1 - 1e-6)
    train = full[0][0]
    for fold, tokens in texts:
        base = sum(math.log10((train[(x,)] + 1) / (full[2] + full[3] + 1)) for x in tokens)
        scores = []
        for counts in (full, full if fold == 2 else without(full, tokens)):
            scores.append(round(sum(math.log10(a[high] * t + (1 - a[high]) * (b[low] * p + (1 - b[low]) * u)) for u, p, t, low, high in parts(tokens, counts)), 5))
        yield fold == 2, len(tokens), sum(train[(x,)] > 0 for x in tokens), full[2], round(base, 5), *scores


@pytest.mark.parametrize("seed", [2, 3])
def test_language_model_equals_a_plain_version(spark, monkeypatch, seed):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(language_model, "RANGE_BYTES", 3000)
    r = random.Random(seed)
    rows = corpus(seed, 60) + [(1000 + i, " ".join(r.choice("abcdefg") for _ in range(30))) for i in range(60)]
    want, got = {}, {}
    for (i, _), x in zip(rows, plain_scores(rows), strict=True):
        want.setdefault(i, []).append(x)
    for x in language_model.score_documents(table(spark, rows).repartition(3)).collect():
        got.setdefault(x.doc_id, []).append((x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 5), round(x.score, 5), round(x.score_left_out, 5)))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}


def test_a_block_with_other_rows_is_refused(spark, tmp_path, monkeypatch):
    rows = table(spark, corpus(5, 20)).select("doc_id", "text").coalesce(1)
    folder = f"file://{tmp_path}/totals"
    totals = language_model.store_totals(language_model.range_totals(language_model.block_keys(rows, 3)), folder)
    other = rows.withColumn("text", F.regexp_replace("text", "w1", "v1"))  # as many keys
    with pytest.raises(Exception, match="other rows"):
        language_model.score(other, folder, *totals[:2], language_model.maximise(*(np.zeros(0),) * 1, *(np.zeros(0, int),) * 2, *(np.zeros(0),) * 2)).collect()


def test_language_model_of_an_empty_table(spark):
    assert language_model.score_documents(table(spark, [])).count() == 0


def test_maximisation_finds_the_weights_that_made_the_data():
    r = np.random.default_rng(4)
    high, low = r.integers(1, 4, 20000), r.integers(1, 4, 20000)
    true_a, true_b = np.array([0, 0.2, 0.5, 0.8]), np.array([0, 0.3, 0.6, 0.9])
    # each estimate gives one kind of token all its mass, so the parts can be told apart
    kind = np.where(r.random(20000) < true_a[high], 2, np.where(r.random(20000) < true_b[low], 1, 0))
    a, b = language_model.maximise(np.ones(20000), high, low, np.where(kind == 2, 1e6, 0.0), np.where(kind == 1, 1e6, 0.0))
    assert np.abs(a[1:4] - true_a[1:]).max() < 0.03 and np.abs(b[1:4] - true_b[1:]).max() < 0.03


def test_packed_numbers_come_back():
    r = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 5000):
        keys = np.unique(r.integers(0, 1 << 56, n, dtype=np.uint64))
        assert (language_model.unpack_keys(language_model.pack_keys(keys), len(keys)) == keys).all()
        for top in (2, 300, 1 << 20, 1 << 40):
            x = r.integers(0, top, n)
            assert (language_model.unpack(language_model.pack(x), n) == x).all()


# --- mixing


def test_targets_stop_and_reshare(spark):
    sizes = {"a": 10, "b": 400, "c": 100, None: 90}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weight, target, open_ = {"a": 5, "b": 2, "c": 1, None: 5}, {}, set(sizes)
    while True:
        left = 600 - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        stop = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not stop:
            break
        target |= {s: 3 * sizes[s] for s in stop}
        open_ -= stop
    target |= {s: level * weight[s] for s in open_}
    assert got == pytest.approx(target)


def test_mix_takes_each_sources_exact_budget(spark):
    docs = table(spark, corpus(5, 200))
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r.taken for r in own) == math.floor(own[0].target + 0.5)
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()), key=repr)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_emitted_mix_has_the_taken_words(spark):
    docs = table(spark, [(i, f"w{i} " * (i % 7 + 1)) for i in range(90)])
    mixed = mixing.mix_sources(docs)
    out = mixing.emit_mix(docs)
    assert out.columns == docs.columns
    got, want = Counter(), Counter({r.doc_id: r.taken for r in mixed.collect() if r.taken})
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert got == want
