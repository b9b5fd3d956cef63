"""Operators on small hand-made tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import random

import numpy as np
import plain
import pytest

from rdspark.llm import cnn, decontaminate, gam, jaccard, mixing, pii, queries, secrets, substrings, tokens, topk

DOCS = "doc_id long, text string, source string, lang string, n_chars long"
#: Columns whose names the operators use inside.
EXTRA = "row_key string, key string, size string, class string, score string, bin string, n string, s string, label string, shard string, ranges string, kept string"


def prose(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 8))) for _ in range(n)]


def corpus() -> list[tuple]:
    base, other, shared = prose(120, 1), prose(90, 2), prose(40, 3)
    changed = list(base)
    changed[50] = "Changed"
    texts = [" ".join(base), " ".join(base), " ".join(changed), " ".join(base[:60] + other), "  ", "", None, "one", "one two three", "ONE Two three",
             " ".join(other[:30] + shared + other[30:]), " ".join(prose(50, 4) + shared + prose(50, 5)), "\t".join(shared) + "\n" + " ".join(shared),
             "a " * 3000, " ".join(prose(20_000, 6)), "é ü ñ   x y 日本 語", "x" * 200_000, "+1 (017) 555-7713 4111 1111 1111 1111 me@mail.example.com. 10.0.0.1"]
    rows = [(k * 3, t, None if k % 4 == 0 else f"s{k % 3}", "en", len(t) if t is not None else None) for k, t in enumerate(texts)]
    r = random.Random(9)
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, and columns that clash."""
    rows = [(r[0], *r[1:]) for r in corpus()[:8]] + [(None, "no id here at all", None, None, None)] * 2 + [corpus()[0]] * 2
    clash = tuple("x" for _ in EXTRA.split(","))
    return spark.createDataFrame([(*r, *clash) for r in rows], f"{DOCS}, {EXTRA}")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is None, x) for x in r))


def digest(df):
    """What the op1 query returns, from the operator's spans."""
    out = []
    for r in df.collect():
        base = [s for s in r["spans"] if s["kind"] in queries.BASE_KINDS]
        import hashlib
        text = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base)
        out.append((r["doc_id"], *[sum(s["kind"] == k for s in base) for k in queries.BASE_KINDS], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0]))


HARD = ["a@b.c_d@e.f", "a@b", "x.y@z-1.co.uk..", "1.2.3.4.5.6.7.8", "256.1.1.1 and 0001.2.3.255", "99999999999999999999.1.1.1", "4111-1111 1111-1111", "4111  1111 1111 1111",
        "+12 345", "++1 234 567 890 1)", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "é🙂 me@x.yz 🙂 10.1.2.3", "4" * 60, "@@a@b.c@d.e", "a" * 5000 + "@b.c", "1 " * 4000,
        "a@b" + ".c" * 20000, "+1" + " " * 20000, "12345678901234567890123 4111111111111111"]


def test_personal_data_equals_plain(spark, docs):
    assert digest(pii.personal_data(docs)) == [(d, *plain.personal_data(t)) for d, t, *_ in sorted(corpus())]
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    assert digest(pii.personal_data(hard)) == [(k, *plain.personal_data(t)) for k, t in enumerate(HARD)]


def test_personal_data_of_added_kinds(spark):
    rows = [(1, "my iban GB82 WEST 1234 5698 7654 32 thanks"), (2, "iban GB82 WEST 1234 5698 7654 33"), (3, "call me, phone 555-123-4567"), (4, "item 555-123-4567 of many")]
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["kind"], s["value"]) for s in found[1]] == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert found[2] == [] and [s["kind"] for s in found[3]] == ["local"] and found[4] == []
    assert found[1][0]["score"] > 0.8


def test_personal_data_defined_results(odd, empty):
    found = pii.personal_data(odd).collect()
    assert len(found) == odd.count() and pii.personal_data(empty).count() == 0


def test_components_equal_plain(docs):
    got = rows_of(jaccard.similar_documents(docs), "doc_id", "n_shingles", "component_id")
    assert got == sorted(plain.jaccard_components([(d, t) for d, t, *_ in corpus()]))


@pytest.mark.parametrize("seed", range(3))
def test_components_of_edited_copies(spark, seed):
    """Groups of near copies around the threshold, small and larger sets."""
    r, rows = random.Random(seed), []
    for group in range(12):
        base = prose(r.choice([5, 6, 9, 14, 30, 80, 300]), 100 * seed + group)
        for _ in range(r.choice([1, 2, 8, 25])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                words[r.randrange(len(words))] = r.choice("pqvwx") * 3
            rows.append((len(rows), " ".join(words[r.choice([0, 0, 1, 3]):])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(jaccard.similar_documents(df), "doc_id", "n_shingles", "component_id") == sorted(plain.jaccard_components(rows))


def test_no_linked_pair_misses_a_key():
    """Pigeonhole: any two sets that link share a key, with or without common shingles left out."""
    r = np.random.default_rng(4)
    for n in [1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 17, 31, 33, 64, 100, 127, 128, 129, 500]:
        for _ in range(20):
            universe = r.integers(1, 1 << 63, 2 * n + 4, dtype=np.uint64)
            a = np.sort(universe[:n])
            drop = r.integers(0, n // 9 + 1)
            b = np.sort(np.concatenate([a[drop:] if drop else a, universe[n:n + r.integers(0, n // 9 + 1)]]))
            common = len(np.intersect1d(a, b))
            if 100 * common < 80 * (len(a) + len(b) - common):
                continue
            for share in (0, 0.5, 0.9, 1):
                heavy = np.sort(a[r.random(len(a)) < share])
                assert np.intersect1d(jaccard.keys_of(a, heavy, 80), jaccard.keys_of(b, heavy, 80)).size


def test_components_defined_results(odd, empty):
    got = jaccard.similar_documents(odd)
    assert got.count() == odd.count() and jaccard.similar_documents(empty).count() == 0
    assert [r["component_id"] for r in got.where("doc_id is null").collect()] == [None, None]
    kept = jaccard.kept_documents(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1 and jaccard.kept_documents(empty).count() == 0


def test_kept_documents_are_one_of_each_group(docs):
    want = [d for d, n, c in plain.jaccard_components([(d, t) for d, t, *_ in corpus()]) if d == c]
    assert sorted(r["doc_id"] for r in jaccard.kept_documents(docs).collect()) == sorted(want)


def test_substrings_equal_plain(docs):
    got = rows_of(substrings.without_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(plain.without_repeats([(d, t) for d, t, *_ in corpus()]))


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_spliced_texts(spark, seed):
    r = random.Random(seed)
    parts = [prose(r.randint(15, 60), 50 * seed + k) for k in range(12)]
    rows = [(k, " ".join(w for _ in range(r.randint(1, 8)) for w in r.choice(parts)[r.choice([0, 0, 3]):])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(substrings.without_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(plain.without_repeats(rows))


def test_substrings_defined_results(odd, empty):
    assert substrings.without_repeats(odd).count() == odd.count() and substrings.without_repeats(empty).count() == 0


def test_tokens_equal_plain(spark, docs):
    path = queries.tokenizer_path()
    got = rows_of(tokens.encoded_documents(docs, path, sequence=64), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == plain.tokens([(d, t) for d, t, *_ in sorted(corpus())], path)


def test_tokens_of_odd_chunks(spark):
    texts = ["The, THE. the", "<|endoftext|> a <|startoftext|>", "don't we'll I'M it's", "☃ snow ☃☃", "É. é É", "é x́.", "İstanbul ΣΑΣ", "12 3.4 a1b", "a\x1cb\x1dc", " lead  two   three ",
             "​ zero", "🙂🙂 ok", "", "." * 50, "ǅ ß ẞ"]
    rows = list(enumerate(texts))
    path = queries.tokenizer_path()
    got = rows_of(tokens.encoded_documents(spark.createDataFrame(rows, "doc_id long, text string"), path), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == plain.tokens(rows, path)


def test_token_files_give_sequences_without_copies(spark, docs):
    from rdspark.sources.storage import scratch_path
    path = scratch_path(spark, "files")
    manifest = tokens.write_tokens(docs, path, queries.tokenizer_path(), sequence=16).collect()
    assert sum(r["n_docs"] for r in manifest) == docs.count()
    import pyarrow as pa
    for r in manifest:
        source = pa.memory_map(f"{path}/{r['ids_file']}")
        n = sum(pa.ipc.open_file(source).get_batch(k).num_rows for k in range(pa.ipc.open_file(source).num_record_batches))
        total = 0
        for k in (*range(0, n, max(1, n // 7)), n - 1):
            ids, mask = tokens.sequence_at(source, k)
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata
            total += int(mask.sum()) if k == n - 1 else 0
        assert (r["n_tokens"] - total) % 16 == 0 and 0 < total <= 16


def test_tokens_defined_results(odd, empty):
    path = queries.tokenizer_path()
    assert tokens.encoded_documents(odd, path).count() == odd.count() and tokens.encoded_documents(empty, path).count() == 0


def test_mixing_targets_and_parts(spark):
    r = random.Random(3)
    rows = [(k, " ".join(["w"] * r.randint(0, 60)), r.choice(["b", "a", None, "Z", "c"]) if k % 3 else "a") for k in range(600)]
    got = [x.asDict() for x in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    source = {k: s for k, _, s in rows}
    sizes: dict = {}
    for x in got:
        sizes[source[x["doc_id"]]] = sizes.get(source[x["doc_id"]], 0) + x["size"]
    want = plain.mix_targets(list(sizes.items()))
    for s, size in sizes.items():
        own = [x for x in got if source[x["doc_id"]] == s]
        assert all(abs(x["target"] - want[s]) < 1e-6 and x["source_size"] == size and x["taken"] <= 2 * x["size"] for x in own)
        assert abs(sum(x["taken"] for x in own) - want[s]) < 1


@pytest.mark.parametrize("sizes", [[("a", 0)], [("a", 10)], [("a", 5), ("b", 100), (None, 1)], [("a", 0), ("b", 7)], [(f"s{k}", 10 ** (k % 5)) for k in range(9)]])
def test_mixing_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    assert got == pytest.approx(plain.mix_targets(sizes))


def test_mixing_bins_do_not_change_the_result(spark, docs):
    rows = mixing.sized(docs, "mix")
    goals = mixing.targets(rows.groupBy("source").sum("size").withColumnRenamed("sum(size)", "source_size"))
    one = [rows_of(mixing.taken(rows, goals, bins), "doc_id", "taken") for bins in (1, 7, 5000)]
    assert one[0] == one[1] == one[2]


def test_mixing_defined_results(odd, empty):
    assert mixing.mix_sources(odd).count() == odd.count() and mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mixed_documents(empty).count() == 0


def test_mixed_documents_follow_the_plan(docs):
    plan = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    times: dict = {}
    for r in mixing.mixed_documents(docs).collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert all(abs(times.get(d, 0) - r["taken"] / r["size"]) <= 0.5 for d, r in plan.items() if r["size"])


def test_top_k_equals_plain(spark):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(300, 24)), 1)      # many ties
    x[10] = x[11] = x[12]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [1.0, None]), (1003, [float("nan")] * 24), (1004, [float("inf")] * 24), (None, [1.0] * 24), (1020, [1.0] * 3), (1040, [2.0] * 3)]
    df = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<double>").repartition(3)
    from pyspark.sql import functions as F
    got = rows_of(topk.top_k(df, F.col("vec_id") % 20 == 0), "query_id", "rank", "vec_id", "score")
    ints = [(k, [int(np.floor(64 * v)) for v in row]) for k, row in rows] + [(1020, [64] * 3), (1040, [128] * 3)]
    assert got == sorted(plain.top_k(ints, 20, 20))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1000.0])
def test_block_search_is_exact(scale):
    r = np.random.default_rng(1)
    x = np.rint(r.normal(size=(500, 64)) * scale).astype(np.int64)
    for a, ids, s in topk.block_top(np.arange(20), x[:20], np.arange(500), x, 20):
        all_ = x @ x[a]
        order = [i for i in np.lexsort((np.arange(500), -all_)) if i != a][:20]
        assert ids.tolist() == order and s.tolist() == all_[order].tolist()


def test_decontamination_finds_copies_and_paraphrases(spark):
    items = [(k, " ".join(prose(n, 200 + k))) for k, n in enumerate([15, 18, 25, 33, 41, 58, 120, 5])] + [(8, None), (9, ""), (None, "no id")]
    rows = [(k, " ".join(prose(150, 300 + k))) for k in range(60)] + [(200, None), (201, "")]
    want = set()
    for k, (item, text) in enumerate(items[:8]):
        words = text.split()
        rows.append((100 + k, " ".join(prose(70, 400 + k) + words + prose(70, 500 + k))))
        want.add((100 + k, item))
        if len(words) >= 15:
            changed = [w if i % 6 else "zz" for i, w in enumerate(words)]
            rows.append((120 + k, " ".join(prose(33, 600 + k) + changed + prose(10, 700 + k))))
            want.add((120 + k, item))
            rows.append((140 + k, text.upper().replace(" ", ", ")))
            want.add((140 + k, item))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got - {(107, 7)} == want - {(107, 7)}      # item 7 has five words
    clean = decontaminate.clean_documents(df, bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in got}


def test_decontamination_defined_results(spark, odd, empty):
    bench = spark.createDataFrame([(1, corpus()[0][1] or "x"), (2, None)], "item_id long, text string")
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.clean_documents(odd, bench).columns == odd.columns


def test_common_length():
    r = random.Random(1)
    for _ in range(50):
        a, b = [r.randrange(6) for _ in range(r.randrange(1, 30))], [r.randrange(6) for _ in range(r.randrange(0, 40))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_length(a, b) == t[-1][-1]


def test_pooling_in_stretches_equals_whole():
    model = cnn.Model(cnn.Settings(buckets=64, stretch=16))
    whole = cnn.Model(cnn.Settings(buckets=64))
    ids = np.random.default_rng(1).integers(0, 64, 500).astype(np.int32)
    before = np.array([0, 0, 1, 3, 40, 41, 300, 498, 500])
    assert np.allclose(model.pooled(ids, before), whole.pooled(ids, before))
    for k in range(len(before) - 1):
        one = ids[before[k]:before[k + 1]]
        assert np.allclose(whole.pooled(one, np.array([0, len(one)])), whole.pooled(ids, before)[k:k + 1])


def labelled(spark, n=1000):
    r, rows, labels = random.Random(8), [], []
    for k in range(n):
        words, bad = prose(r.randint(5, 80), 1000 + k), k % 5 == 0
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["idiot", "MORON!", "clown."]))
            words = [w + "$$$" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, column", [(cnn, "toxic"), (gam, "quality")])
def test_classifiers_learn_and_handle_odd_rows(spark, odd, empty, module, column):
    from pyspark.sql import functions as F
    docs, labels = labelled(spark)
    model = module.fit(docs, labels, column, F.col("doc_id") % 4 != 0)
    held = module.score(docs, model, "doc_id").join(labels, "doc_id").where("doc_id % 4 = 0").collect()
    right = sum((r["score"] >= 0.5) == bool(r[column]) for r in held)
    assert right >= 0.95 * len(held)
    got = module.score(odd, model, *odd.columns[:5]).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got) and module.score(empty, model, "doc_id").count() == 0
    one = module.fit(docs, labels.where(f"{column} = 1").union(spark.createDataFrame([(None, 0, 0), (3, None, None), (4, 7, 7)], labels.schema)), column)
    assert one.constant == 1.0
    assert module.fit(docs, labels.limit(0), column).constant == 0.5


def test_secrets_are_found_and_false_ones_removed(spark, odd, empty):
    r, rows = random.Random(5), []
    for k in range(300):
        value = "".join(r.choice("0123456789abcdef") for _ in range(40))
        rows.append((k, f"some words token = \"{value}\" more words" if k % 2 else f"build {value} of the tree 2024-01-01-readme-{k:06d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.findings(docs)
    forest = secrets.train(secrets.labelled_by_rule(found.where("doc_id < 200")))
    got = secrets.scored(found, forest).where("doc_id >= 200").collect()
    text = dict(rows)
    assert all(text[x["doc_id"]][x["start"]:x["end"]] == x["value"] for x in got)
    assert all((x["score"] >= 0.5) == bool(x["doc_id"] % 2 and len(x["value"]) == 40) for x in got)
    assert secrets.findings(empty).count() == 0 and secrets.findings(odd).count() >= 0
    assert secrets.train(secrets.labelled_by_rule(secrets.findings(empty))) == 0.5


@pytest.mark.parametrize("seed", range(3))
def test_components_of_graphs(spark, seed):
    from rdspark.llm.components import components
    r = random.Random(seed)
    edges = [(r.randrange(60) - 30, r.randrange(60) - 30) for _ in range(r.choice([0, 25, 50]))] + [(k, k + 1) for k in range(100, 140)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: v for x, v in root.items() if x in {y for e in edges if e[0] != e[1] for y in e}}
