"""Decontamination, quality rules, line dedup, near-dedup, packing, records, classifier: brute force and edge cases."""

from __future__ import annotations

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ambercol.llm import decontaminate, line_dedup, near_dedup, packing, quality_model, quality_rules, queries, records, tokens
from ambercol.llm.common import written
from ambercol.llm.components import components

from .conftest import SPACE_WORD, TEXT_WORD, lower

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    said, found = con.sql(queries.SQL[name]), queries.QUERIES[name](spark, DATA)
    columns = sorted(said.columns)
    assert columns == sorted(found.columns)
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(said.select(*columns).fetchall())


def hits(text, items, n=10):
    words = TEXT_WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for item, body in items:
        w = TEXT_WORD.findall(lower(body or ""))
        k = min(n, len(w))
        for at in range(len(w) - k + 1) if w else ():
            for p in range(len(words) - k + 1):
                if words[p : p + k] == w[at : at + k]:
                    hit |= set(range(p, p + k))
                    found.add(item)
    return len(words), len(hit), sorted(map(str, found))


def test_decontamination_with_short_items_and_overlaps(spark):
    items = [(1, "alpha Beta gamma"), (2, "one two three four five six seven eight nine ten eleven"), (3, ""), (4, None), (5, "BETA gamma delta"), (10, "alpha beta gamma"), (6, "É é ß")]
    texts = ["Alpha, beta gamma delta! one two three four five six seven eight nine ten eleven twelve", "zero one two three four five six seven eight nine TEN", "é é ß", "É é ß x", "", None, "alpha beta", "alpha beta gamma " * 30]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, "other alpha beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for parts in (100_000_000, 2500):
        got = decontaminate.contamination(docs, bench, most_broadcast=parts).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            text = "other alpha beta gamma" if r.doc_id == 0 and r.n_words == 4 else texts[r.doc_id]
            assert (r.n_words, r.n_hit, list(r["items"])) == hits(text, items)
    left = {r.doc_id: r.text for r in decontaminate.remove_spans(docs.filter("doc_id in (1, 4, 7)"), bench).collect()}
    assert left == {1: "zero", 4: "", 7: ""}
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_decontamination_removes_all_that_is_hit(spark, small):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    kept = {r.doc_id for r in decontaminate.remove_documents(small, bench).collect()}
    for r in small.collect():
        assert (r.doc_id in kept) == (hits(r.text, items)[1] == 0)


def test_windows_of_every_length_are_found_wherever_they_begin(spark):
    r = random.Random(3)
    items = [(k, " ".join(f"I{k}x{j}" for j in range(k))) for k in range(1, 14)]
    texts = []
    for k, body in items:
        for at in range(12):
            w = body.split()
            texts.append(" ".join([*("f" + str(r.randrange(10**6)) for _ in range(at)), *w[: 1 + r.randrange(len(w))], "stop", *w, *(["end"] * r.randrange(2))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chosen in (items, items[9:]):
        for x in decontaminate.contamination(docs, spark.createDataFrame(chosen, "item_id long, text string")).collect():
            assert (x.n_words, x.n_hit, list(x["items"])) == hits(texts[x.doc_id], chosen)


def repeats(words, n=8):
    seen: dict = {}
    for p in range(len(words) - n + 1):
        seen.setdefault(tuple(words[p : p + n]), []).append(p)
    return len({q for ps in seen.values() if len(ps) > 1 for p in ps for q in range(p, p + n)})


def test_quality_signals(spark):
    r = random.Random(2)
    texts = ["", None, "a b c", "x " * 40, "\n".join(["same line here"] * 4), "é#日*😀 $%", " ".join(r.choice("ab") for _ in range(200)), "\t\n", "A\nA\n \nB\nA"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for row in quality_rules.quality(docs).collect():
        text = texts[row.doc_id] or ""
        words = SPACE_WORD.findall(text)
        lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats(words))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_depleted_documents_are_rejected_and_copies_are_not(spark):
    menu, r = "menu of this host with some words and more of them to make it long enough", random.Random(1)
    own = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
    rows = [(i, f"{menu}\n{own()}", "a") for i in range(60)] + [(100, "\n".join([menu + "!", menu]) + "\nend", "a"), (101, "\n".join([menu] * 1 + ["one two three four five"]), "b")]
    copy = own()
    rows += [(200 + i, copy, "a") for i in range(40)]
    kept = {x.doc_id: x.kept for x in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(kept[i] for i in range(60)) and all(kept[200 + i] for i in range(40)) and kept[101]
    lone = spark.createDataFrame([*rows, (300, f"{menu}\nand nothing else but this", "a")], "doc_id long, text string, source string")
    assert not {x.doc_id: x.kept for x in quality_rules.quality(lone, depleted=0.5).collect()}[300]
    assert quality_rules.keep_good(lone).filter("doc_id < 60").count() == 60


def test_frequent_lines_are_taken_out_of_kept_documents(spark):
    menu, r = "Menu of  this host", random.Random(6)
    own = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
    rows = [(i, f"{menu}\n{own()}\n\n menu of this HOST \nend {i}", "a" if i % 2 else None) for i in range(60)]
    rows += [(100, f"{menu}\n{own()}", "b"), (101, f"{menu}\ntoo short", "a"), (102, None, "a")]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, source string").withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    got = quality_rules.cleaned(docs)
    assert got.columns == docs.columns and got.count() == 62
    texts = {i: t for i, t, _ in rows}
    for x in got.collect():
        lines = texts[x.doc_id].split("\n")
        assert x.text == ("\n".join(lines) if x.doc_id == 100 else "\n".join([lines[1], "", lines[4]])) and x.n_chars == len(x.text)


def test_line_spread_near_the_threshold_is_counted(spark):
    rows = []
    for line, sites in (("on nine sites", 9), ("on ten sites", 10), ("On  Thirty sites", 30)):
        rows += [(len(rows) + k, f"{line}\nbody {line} {k} of its own\n", f"s{k}") for k in range(sites)]
    rows += [(500 + k, "the first of a copied text\nand its second line", f"s{k}") for k in range(30)]
    docs = spark.createDataFrame([*rows, (900, None, "s1"), (901, "", None)], "doc_id long, text string, source string")
    found = line_dedup.boilerplate(docs).collect()
    assert sorted((r.n_sites, r.exact) for r in found) == [(10, True), (30, False)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[9].n_removed == 1 and got[9].text.startswith("body on ten") and got[9].text.endswith("\n")
    assert got[0].n_removed == 0 and got[500].n_removed == 0 and got[900].text is None and got[901].n_lines == 0
    stage = line_dedup.without_boilerplate(docs.withColumn("n_chars", F.char_length("text").cast("long")))
    assert stage.columns == [*docs.columns, "n_chars"] and stage.count() == docs.count()
    assert stage.filter("n_chars != char_length(text)").count() == 0


def test_footers_blocks_and_banners_that_spread_over_sites_go_and_copies_stay(spark):
    r = random.Random(8)
    own = lambda n=60: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    block = ["first of a block", "second of a block", "third of a block"]
    rows = [(i, "\n".join(["A banner", own(), *block, own(), "a  Footer"]), f"s{i % 12}") for i in range(36)]
    # many exact copies of one of the texts, on all sites, neither save its lines nor lose those of their own
    rows += [(100 + i, rows[0][1], f"s{i % 12}") for i in range(2000)]
    rows += [(3000 + i, "\n".join([own(), "a line of one site"]), "s3") for i in range(36)]
    rows += [(4000, None, "s1"), (4001, "", None), (4002, "A banner\n\n", None), (4002, "A banner\n\n", None)]
    article = [own(20) for _ in range(40)]
    copies = [(5000 + i, "\n".join([*article[:i], own(5), *article[i:]]), f"s{i % 12}") for i in range(36)]
    bad = {"A banner", "a  Footer", *block}
    want = {i: None if x is None else "\n".join(y for y in x.split("\n") if y not in bad) for i, x, _ in rows + copies}
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(x.text == want[x.doc_id] for x in got)
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string, source string").selectExpr("*", "1 AS gone", "2 AS t", "3 AS __id", "4 AS line")
    stage = line_dedup.without_boilerplate(docs)
    assert stage.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in stage.collect()), key=str) == sorted(((i, want[i]) for i, _, _ in rows + copies), key=str)


def brute(rows, k, percent=80):
    sets = {}
    for i, text in rows:
        w = SPACE_WORD.findall(lower(text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_are_those_of_brute_force(spark, small, k):
    want = brute([(r.doc_id, r.text) for r in small.collect()], k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(small, k).collect()}
    assert got == want


def test_chains_copies_and_common_passages(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**5)}"
    base, rows = [word() for _ in range(120)], []
    chain = base
    for i in range(25):  # each a few words from the one before
        chain = [word() if j // 5 == i else w for j, w in enumerate(chain)]
        rows.append((1000 - i, " ".join(chain)))
    rows += [(2000 + i, " ".join(base)) for i in range(10)]
    for i in range(60):  # near copies of one text, some on either side of the threshold
        rows.append((3000 + i, " ".join(word() if r.random() < 0.012 * (i % 5) else w for w in base)))
    passage = [word() for _ in range(70)]
    rows += [(4000 + i, " ".join(passage + [word() for _ in range(40)])) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(docs, 4).collect()}
    assert got == brute(rows, 4)
    assert sorted(x.doc_id for x in near_dedup.keep_one(docs, 4).collect()) == sorted({c for _, c in got.values()})


def test_groups_of_every_shape_are_those_of_brute_force(spark):
    r = random.Random(11)
    word = lambda: f"w{r.randrange(10**5)}"
    rows, n = [], 0

    def add(words):
        nonlocal n
        n += 1
        rows.append((r.randrange(10**6) * 1000 + n, " ".join(words)))

    def changed(words, rate):
        out = []
        for w in words:
            kind = r.random() if r.random() < rate else 1
            out += [] if kind < 0.3 else [word(), w] if kind < 0.5 else [word()] if kind < 1 else [w]
        return out

    base = [word() for _ in range(90)]
    for _ in range(150):  # copies with words changed, dropped and put in, most of them near the threshold
        add(changed(base, r.choice([0.005, 0.02, 0.03, 0.035, 0.05])))
    for _ in range(8):  # families under the threshold from the base, each with members of its own
        family = changed(base, 0.06)
        for _ in range(r.randint(1, 6)):
            add(changed(family, 0.015))
    for size in (30, 45, 58, 70, 90, 140):  # parts and extensions of the base: other sizes
        part = (base + [word() for _ in range(60)])[:size]
        for _ in range(5):
            add(changed(part, 0.01))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(docs, 4).collect()}
    want = brute(rows, 4)
    assert got == want and len({c for _, c in want.values()}) > 40


def test_pairs_of_exactly_the_threshold_are_linked(spark):
    r = random.Random(12)
    rows = []
    for i in range(200):  # 80 shingles, all of them in a set of 100: 0.8; or in one of 101
        words = [f"w{r.randrange(10**7)}" for _ in range(83)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, *(f"x{r.randrange(10**7)}" for _ in range(20 if i % 2 else 21))]))]
    want = brute(rows, 4)
    assert {want[2 * i + 1][1] == 2 * i for i in range(1, 200, 2)} == {True} and {want[2 * i + 1][1] == 2 * i for i in range(0, 200, 2)} == {False}
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == want


def test_one_of_each_group_is_kept_and_no_row_without_an_id_is_lost(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, text), (None, text), (None, None), (3, text), (3, text), (5, text), (5, "another text of the same id with words enough"), (7, ""), (7, ""), (8, None), (9, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS __id", "'y' AS id", "'z' AS hash")
    got = near_dedup.keep_one(docs)
    assert got.columns == docs.columns
    left = sorted(((x.doc_id, x.text) for x in got.collect()), key=str)
    assert left == sorted([(None, text), (None, text), (None, None), (3, text), (5, rows[6][1]), (7, ""), (7, ""), (8, None), (9, rows[10][1])], key=str)
    assert all(x.component_id is None for x in near_dedup.near_duplicates(docs).filter("doc_id is null").collect())


def test_sketches_estimate_similarity():
    r = np.random.default_rng(3)
    for size in (1, 3, 40, 900):  # few and many per bin
        both = r.integers(0, 2**63, size, np.uint64)
        extra = r.integers(0, 2**63, size, np.uint64)
        a, b = np.unique(np.concatenate([both, extra[: size // 2]])), np.unique(np.concatenate([both, extra[size // 2 :]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = (near_dedup.sketch(a) == near_dedup.sketch(b)).mean()
        assert abs(same - true) < 5 * (true * (1 - true) / near_dedup.BINS) ** 0.5 + 1e-9
        assert (near_dedup.sketch(a) != ~np.uint64(0)).all()


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 200)] + [(7, 500 + i) for i in range(50)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 201)}, **{500 + i: 7 for i in range(50)}}


def encoded(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.TOKENIZER)
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_encode_like_whole_texts(small):
    r, e = random.Random(9), tokens.Encoder(queries.TOKENIZER, remembered=200)
    parts = ["a", "bc", "é", ",", ".", "\n", " ", " ", "'s", "1", "%", "\t", "ß", "日", "😀", "\x1c", "\xa0", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 16))) for _ in range(3000)] + [x.text for x in small.limit(60).collect()]
    assert e.encode(texts) == e._whole(texts) == e.encode(texts)


def check_packing(pieces, ids, capacity):
    by_doc: dict = {}
    by_sequence: dict = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert crc(ids[p.doc_id][p.start : p.start + p.length]) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[i])
    assert set(by_doc) == set(ids)
    sizes = []
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert max(sizes) <= capacity and sum(s < capacity for s in sizes) <= 1


@pytest.mark.parametrize("capacity,windows,fan", [(1024, 32, 32), (64, 3, 2), (7, 1, 2)])
def test_packing(spark, small, capacity, windows, fan):
    docs = small.limit(120).repartition(9).unionByName(spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0)], small.schema))
    docs = written(docs, "docs")
    ids = encoded([(r.doc_id, r.text) for r in docs.collect()])
    pieces = packing.pack(docs, queries.TOKENIZER, capacity, windows, fan).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packing(pieces, ids, capacity)


def test_records_round_trip(spark, small):
    got = sorted(records.record_digests(small, queries.TOKENIZER).collect(), key=lambda r: r.doc_id)
    ids = encoded([(r.doc_id, r.text) for r in small.collect()])
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), crc(ids[r.doc_id]))
        at += r.n_tokens
    assert len(got) == small.count()


def test_records_are_read_by_index_and_damage_is_seen(spark, small, tmp_path):
    path = f"file://{tmp_path}/records"
    records.write_records(small.limit(50), path, queries.TOKENIZER)
    index = records.read_index(spark, path)
    wanted = index.filter("doc_id % 3 = 0")
    ids = encoded([(r.doc_id, r.text) for r in small.limit(50).collect()])
    for r in records.read_records(spark, path, wanted.select("shard", "offset")).collect():
        assert r.doc_id % 3 == 0 and np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id]
    shard = next(p for p in (tmp_path / "records/shards").iterdir() if p.name.startswith("part-") and p.stat().st_size)
    data = bytearray(shard.read_bytes())
    data[14] ^= 1
    with pytest.raises(ValueError, match="bad payload"):
        list(records.unframe(memoryview(data), at, n) for at, n in records.headers(memoryview(data)))
    data[2] ^= 1
    with pytest.raises(ValueError, match="bad length"):
        list(records.headers(memoryview(data)))


def test_records_with_null_and_repeated_ids_and_added_tokens(spark):
    rows = [(5, "a <|endoftext|> b"), (None, "no id"), (None, None), (-3, "<|endoftext|><|endoftext|>"), (5, "other"), (5, "other"), (4, "")]
    got = records.record_digests(spark.createDataFrame(rows, "doc_id long, text string"), queries.TOKENIZER).collect()
    want = [(i, encoded([(0, x)])[0]) for i, x in rows]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((i, len(x), crc(x)) for i, x in want), key=str)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, -3, 4, 5, 5, 5]
    assert len(encoded([(0, "a <|endoftext|> b")])[0]) == 5


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0
    models = quality_model.train(docs, labels.filter(seen), most_rows=3000)
    got = quality_model.classify(docs, labels, models=models).select("doc_id", F.col("quality").alias("p"), "toxicity")
    r = labels.filter(~seen).join(got, "doc_id").agg(F.avg(((F.col("p") >= 0.5) == (F.col("quality") == 1)).cast("int")), F.avg(((F.col("toxicity") >= 0.5) == (F.col("toxic") == 1)).cast("int"))).first()
    assert r[0] > 0.98 and r[1] > 0.96


def posterior(rows, models):
    """Posteriors by plain NumPy from (id, text, site, path): id, quality, toxicity, site_quality, path_quality."""
    logit = lambda p: np.log(p / (1 - p))
    out = {i: [] for i, *_ in rows}
    site, path = np.array([repr(r[2]) for r in rows]), np.array([repr((r[2], r[3])) for r in rows])

    def strength(p, n, parent):
        n, p, parent = map(np.array, (n, p, parent))
        if len(n) < 2:
            return 100.0
        excess = max((n * (p - parent) ** 2).sum() - (parent * (1 - parent)).sum(), 0) / n.sum()
        return np.clip((n * parent * (1 - parent)).sum() / n.sum() / excess - 1 if excess > 0 else 1e4, 1, 1e4)

    for head in quality_model.HEADS:
        odds = np.array([models[head].log_odds(*quality_model.features(r[1] or "")) for r in rows])
        p = 1 / (1 + np.exp(-odds))
        rate = min(max(p.mean(), 1e-4), 1 - 1e-4)
        sites, paths = sorted(set(site)), sorted(set(path))
        k = strength([p[site == s].mean() for s in sites], [(site == s).sum() for s in sites], [rate] * len(sites))
        of_site = {s: (p[site == s].sum() + k * rate) / ((site == s).sum() + k) for s in sites}
        above = {q: of_site[site[path == q][0]] for q in paths}
        j = strength([p[path == q].mean() for q in paths], [(path == q).sum() for q in paths], [above[q] for q in paths])
        for r, x, o, s, q in zip(rows, p, odds, site, path):
            n, total = (path == q).sum(), p[path == q].sum()
            own = np.clip((total - x + j * above[q]) / (n - 1 + j), 1e-4, 1 - 1e-4)
            out[r[0]] += [1 / (1 + np.exp(-(o + logit(own) - logit(models[head].rate))))]
            if head == "quality":
                rates = of_site[s], (total + j * above[q]) / (n + j)
                out[r[0]] += rates
    return {i: (x[0], x[3], x[1], x[2]) for i, x in out.items()}


def test_posteriors_are_those_of_plain_numpy(spark, small):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    models = quality_model.train(small, labels)
    odd = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "", "", "", 0), (10**6 + 2, "some words", None, "", 0), (10**6 + 3, "# $ %", "xx", None, 0), (10**6 + 4, "# $ %", "xx", "lone", 0)], small.schema)
    docs = small.unionByName(odd)
    want = posterior([(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()], models)
    got = {r.doc_id: r for r in quality_model.classify(docs, labels, models=models).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert (r.quality, r.toxicity, r.site_quality, r.path_quality) == pytest.approx(want[i], rel=1e-5, abs=1e-7)
        assert r.kept == (r.quality >= 0.5 and r.toxicity < 0.5)


def test_one_text_of_a_repeated_labelled_id_is_learnt(spark, small):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    one = labels.limit(1).join(small, "doc_id").select(*small.columns)
    many = small.unionByName(one.join(spark.range(50).select(F.col("id").alias("n")), how="cross").drop("n"))
    a, b = quality_model.train(small, labels), quality_model.train(many, labels)
    assert all(np.array_equal(a[h].weights, b[h].weights) for h in quality_model.HEADS)


def test_sparse_sites_are_drawn_to_the_global_rate(spark, small):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    lone = spark.createDataFrame([(10**6, "short # $ % & | < >", "xx", "lone", 3)], small.schema)
    rows = quality_model.classify(small.unionByName(lone), labels).collect()
    rates = {r.doc_id: (r.site_quality, r.path_quality) for r in rows}
    others = np.mean([a for i, (a, _) in rates.items() if i != 10**6])
    assert abs(rates[10**6][0] - others) < 0.3


def test_edge_rows(spark, edge, small):
    bench, labels = spark.read.parquet(f"{DATA}/benchmark.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    n, none = edge.count(), edge.limit(0)
    for f in (lambda d: decontaminate.contamination_digests(d, bench), quality_rules.quality, line_dedup.line_digests, near_dedup.near_digests, lambda d: quality_model.classify(d, labels)):
        assert f(edge).count() == n
        assert f(none).count() == 0
    assert decontaminate.contamination_digests(edge, bench.limit(0)).filter("contaminated").count() == 0
    total = sum(len(encoded([(0, r.text)])[0]) for r in edge.collect())
    assert sum(r.n_tokens for r in records.record_digests(edge, queries.TOKENIZER).collect()) == total
    assert records.record_digests(none, queries.TOKENIZER).count() == 0
    assert packing.pack(edge, queries.TOKENIZER).agg(F.sum("length")).first()[0] == total
    assert packing.pack(none, queries.TOKENIZER).count() == 0
    near = {r.doc_id: r for r in near_dedup.near_digests(edge).collect()}
    assert near[11].component_id == 10 and near[9].component_id == 8 and near[1].n_shingles == 0 and near[5].component_id == 5
    for stage in (quality_rules.keep_good, line_dedup.without_boilerplate, near_dedup.keep_one, lambda d: decontaminate.remove_documents(d, bench)):
        assert stage(edge).columns == edge.columns
        assert stage(none).count() == 0
