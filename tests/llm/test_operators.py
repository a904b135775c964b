import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandbook.llm import mixing, near_duplicates, neighbours, personal_data, piece_codec, pieces, quality_rules, queries, shards, shingle_sets, token_counts, url_filters, warc_derivatives
from strandbook.llm.common import Scratch

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   \n\t ", "one", "one two three", "a b c d", "x" * 5000, "été naïve 漢字 😀", "a@b.c-d@e.f_g@h.i", "dup line\ndup line\n\ndup line", "+1 (234) 555-1234 and 4111 1111 1111 1111 1.2.3.4 1.2.3.400", "1 2 3 " * 300, "w " * 3000, "▁ mark", "\0 zero"]


def odd_docs(spark):
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "a b c d", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_base_measures_equal_brute_force(spark, docs, texts):
    for df, known in ((docs, texts), (odd_docs(spark).filter("doc_id is not null"), dict(enumerate(ODD)))):
        for r in quality_rules.with_measures(df).collect():
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute.quality(known[r["doc_id"]])


def test_rules_find_a_planted_threshold(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        share = rng.random() * 0.2
        rows.append(tuple([100, 5.0, share, *[rng.random()] * 5, share < 0.1]))
    labelled = spark.createDataFrame(rows, ", ".join(f"{f} double" if f != "n_words" else "n_words long" for f in quality_rules.FEATURES) + ", good boolean")
    rules = quality_rules.learn_rules(labelled)
    assert rules and rules[0].tests[0].feature == "symbol_share" and abs(rules[0].tests[0].value - 0.1) < 0.02
    assert quality_rules.learn_rules(labelled.limit(0)) == []


def test_keep_works_on_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 0), (2, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.keep(odd_docs(spark), labels).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert quality_rules.keep(odd_docs(spark).limit(0), labels).count() == 0


def test_jaccard_components_equal_brute_force(spark, texts):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = list(texts.items())
    for i in range(150):  # near copies around the threshold, and exact ones
        words = list(base)
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        rows.append((100_000 + i, " ".join(words)))
    rows += [(200_000 + i, t) for i, t in enumerate(ODD)]
    found = near_duplicates.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100)
    want = brute.jaccard_components(rows, 4, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == want


def test_keep_one_on_odd_rows(spark):
    kept = near_duplicates.keep_one(odd_docs(spark))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.filter("doc_id = 5").count() == 1 and kept.filter("doc_id is null").count() == 2
    assert near_duplicates.keep_one(odd_docs(spark).limit(0)).count() == 0


def test_signatures_meet_for_all_pairs_above_the_threshold():
    rng = np.random.default_rng(5)
    bands = shingle_sets.Bands(85, 100)
    for _ in range(300):
        n = int(rng.integers(7, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = a.copy()
        cut = int(rng.integers(0, max(1, n // 6)))
        b = np.unique(np.r_[b[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 12)))).astype(np.uint64)])
        if shingle_sets.reaches(a, b, 85, 100) and len(a) + len(b) != 2 * len(np.intersect1d(a, b)):
            assert set(shingle_sets.signatures(a, bands).tolist()) & set(shingle_sets.signatures(b, bands).tolist())
            assert shingle_sets.may_reach(len(a), shingle_sets.fine_parity(a), len(b), shingle_sets.fine_parity(b), 85, 100)


def test_base_spans_equal_brute_force(spark, docs, texts):
    for df, known in ((docs, texts), (odd_docs(spark).filter("doc_id is not null"), dict(enumerate(ODD)))):
        for r in personal_data.find(df).collect():
            assert r["base_sha256"] == brute.pii_digest(known[r["doc_id"]]), r["doc_id"]


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"note {i} badge user{i}@mail.example.com end") for i in range(40)]
    rows = [(i, f"some words badge 10.0.{i}.7 until tomorrow") for i in range(40)] + [(100, "some words badge QX-48-819-Z until tomorrow")] + [(200 + i, f"plain number {1000 + i} here") for i in range(20)]
    found = {r["doc_id"]: r["spans"] for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == "other:17:28" and found[3] == "ip:17:25" and found[205] == ""


def test_keys_teach_their_contexts(spark):
    rows = [(i, f'some text token = "{i:08x}abcdef0123456789abcdef0123456789" and more') for i in range(8)]
    rows += [(100, "some text token = k-48-819-Q and more"), (101, "other text 48-819-QZ here"), (102, "a" * 40 + " " + "7" * 40)]
    found = {r["doc_id"]: r["spans"] for r in personal_data.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[3] == "other:18:60" and found[100] == "other:18:28" and found[101] == found[102] == ""


CLASH = ["__key", "__found", "__copies", "__copy", "__arrival", "__words"]


def test_columns_of_clashing_names_stay(spark):
    plain = odd_docs(spark)
    docs = plain.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASH))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for kept in (quality_rules.keep(docs, labels), near_duplicates.keep_one(docs), personal_data.redact(docs), mixing.mixed(docs), piece_codec.encode(docs)):
        assert kept.columns[: len(docs.columns)] == docs.columns
        assert kept.filter(" or ".join(f"{c} <> concat('{c}', doc_id)" for c in CLASH)).count() == 0
    store = shards.ShardStore(spark, Scratch(spark).root)
    store.append(docs, by=F.col("lang"))
    assert store.read(docs.schema).filter("__arrival = concat('__arrival', doc_id)").count() == docs.filter("doc_id is not null").count()


def test_empty_tables_give_no_rows(spark):
    none = odd_docs(spark).limit(0)
    assert piece_codec.round_trip(none).count() == token_counts.count_tokens(none).count() == personal_data.find(none).count() == personal_data.redact(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.judge(pages).count() == warc_derivatives.derive(warc_derivatives.responses_of(pages)).count() == 0


def test_redaction(spark):
    got = {r["doc_id"]: r["text"] for r in personal_data.redact(odd_docs(spark)).collect() if r["doc_id"] is not None}
    assert got[10] == "[PHONE] and 4111 1111 1111 1111 [IP] 1.2.3.400" and got[0] is None and got[3] == "one"


def test_mix_meets_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.orderBy(F.desc("doc_id"))).collect()
    assert {(r["doc_id"], r["copies"]) for r in rows} == {(r["doc_id"], r["copies"]) for r in again}
    taken, target, largest = {}, {}, {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(odd_docs(spark)).columns == odd_docs(spark).columns


def test_targets_are_capped_and_reshared():
    assert mixing.targets_for([("a", 10), ("b", 100), (None, 100)]) == {"a": 30.0, "b": 120.0, None: 60.0}


def test_newton_solves_feature_constraints(spark):
    rows = [("s", 10, float(i % 5)) for i in range(200)]
    sized = spark.createDataFrame(rows, "source string, size long, x double")
    targets = spark.createDataFrame([("s", 1000.0)], "source string, target double")
    m = mixing.solve_rates(sized, targets, ("x",), {"x": 3.0}).first()
    rates = [math.exp(m["m0"] + m["m1"] * x) for _, _, x in rows]
    assert abs(sum(10 * r for r in rates) - 1000) < 1e-3 and abs(sum(10 * r * x for r, (_, _, x) in zip(rates, rows)) - 3000) < 1e-2


def test_pieces_equal_the_library(spark, docs, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    every = spark.createDataFrame([(d, t) for d, t in [*texts.items(), *((10**6 + i, t) for i, t in enumerate(ODD))]], "doc_id long, text string")
    known = {r["doc_id"]: r["text"] for r in every.collect()}
    for r in piece_codec.encode(every).collect():
        assert r["piece_ids"] == model.encode(known[r["doc_id"]] or "")
    assert piece_codec.round_trip(every).filter("not round_trip").count() == 0
    for r in token_counts.count_tokens(every).collect():
        text = known[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(model.encode(text)))


def test_best_score_segmentation_equals_brute_force():
    vocabulary = pieces.Vocabulary(piece_codec.model_path())
    vocabulary.by_merges = False
    coder = pieces.BestScore(vocabulary)
    words = ("▁the", "▁then", "▁retit", "▁漢字x", "▁hello", "▁", "😀😀", "▁" + "anothertime" * 4)
    together = coder.solve(list(words))
    for word in words:
        best = {0: 0.0}
        for end in range(1, len(word) + 1):
            options = [best[s] + vocabulary.scores[word[s:end]] for s in range(end) if word[s:end] in vocabulary.scores]
            if word[end - 1] not in vocabulary.ids:
                options.append(best[end - 1] + vocabulary.unknown)
            best[end] = max(options)
        unknown = sum(c not in vocabulary.ids for c in word) * vocabulary.unknown
        for ids in (together[word], coder.segment(word)):
            spelled = sum(vocabulary.scores.get(vocabulary.pieces[i], 0) for i in np.frombuffer(ids, np.int32))
            assert spelled + unknown == best[len(word)]


def test_neighbours_stay_apart_as_merging_says():
    vocabulary = pieces.Vocabulary(piece_codec.model_path())
    told, merger, rng = pieces.Neighbours(vocabulary), pieces.MergeCount(vocabulary), random.Random(4)
    known = list(vocabulary.ids.values())
    few = [i for i in known if len(vocabulary.pieces[i]) < 4]
    for left, right in [(rng.choice(few), rng.choice(few)) for _ in range(20000)] + [(rng.choice(known), rng.choice(known)) for _ in range(20000)]:
        want = [vocabulary.pieces[left], vocabulary.pieces[right]]
        assert told.apart(left, right) == (merger.merge("".join(want)) == want), want


def test_odd_texts_are_encoded_as_the_library_does():
    import sentencepiece

    path, rng = piece_codec.model_path(), random.Random(2)
    coder, model = pieces.BestScore(pieces.Vocabulary(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    counter = pieces.MergeCount(coder.vocabulary)
    texts = ["".join(rng.choice("aabbetthe  ▁▁ \n\t<s>0x41éß漢字😀\x00'\"0123") for _ in range(rng.randrange(150))) for _ in range(500)]
    texts += ["".join(rng.choice("etaoinshrd漢😀") for _ in range(rng.randrange(60, 400))) for _ in range(50)]
    texts += ["e" * 200_000, "▁" * 300, "", None, "<s></s><unk><0x41>", "\u200b\ufeff x"]
    for text, ids in zip(texts, coder.encode_all(texts)):
        want = model.encode(text or "")
        assert np.frombuffer(ids, np.int32).tolist() == want and counter.count(text) == len(want)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(piece_codec.model_path(), "rb") as f:
        spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Vocabulary(str(tmp_path / "other.model"))


def test_neighbours_recall(spark):
    vectors = spark.read.parquet(f"{DIR}/embeddings.parquet")
    odd = spark.createDataFrame([(10_000, None, 0), (10_001, [0.0] * 64, 0), (10_002, [float("nan")] * 64, 0), (None, [1.0] * 64, 0)], "vec_id long, embedding array<float>, label int")
    found = neighbours.nearest_neighbours(vectors.unionByName(odd)).collect()
    data = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in vectors.collect()}
    hits = total = 0
    for q in (i for i in data if i % 50 == 0):
        score = {i: v @ data[q] / np.linalg.norm(v) / np.linalg.norm(data[q]) for i, v in data.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        got = {r["vec_id"]: r["score"] for r in found if r["query_id"] == q}
        assert all(abs(score[i] - s) < 1e-12 for i, s in got.items()) and len(got) == 5
        hits, total = hits + len(set(best) & set(got)), total + 5
    assert hits >= 0.9 * total
    assert neighbours.nearest_neighbours(vectors.limit(0)).count() == 0


def test_url_rules(spark):
    urls = ["http://Sub.EXAMPLE.org/es/x", "http://example.org/en/12?a", "http://example.org", "http://a.org/x", "http://a.com/x.org/", "http://b.com/de/", "http://b.com/fr/1#x", "no url", None, "http://spam-farm.net/x", "http://notorg/", "http://x.com/DE/"]
    got = [(r["rule"], r["verdict"]) for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    assert got == [("example.org/es/", "block"), ("example.org/en/1", "block"), (None, "allow"), ("org/", "allow"), (None, "allow"), ("com/de/", "block"), ("com/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow")]


def test_shift_and_spans_words():
    globs = ["*" + "abcdefghij" * 9 + "*z", "x*y"]
    automaton = url_filters.ShiftAnd(globs)
    fits = automaton.run([b"__" + b"abcdefghij" * 9 + b"..z.", b"x123y", b"x123", b""])
    assert fits.tolist() == [[True, False], [False, True], [False, False], [False, False]]


def test_compaction_keeps_every_row(spark, docs):
    store = shards.ShardStore(spark, Scratch(spark).root, target=1 << 20, base=1 << 10)
    for part in range(6):
        store.append(docs.filter(F.col("doc_id") % 6 == part))
    before = store.version()
    files = store.manifest().count()
    assert store.append(docs.limit(0)) == before == 6
    assert store.compact(docs.schema) > before and store.manifest().count() < files
    assert sorted(store.read(docs.schema).collect()) == sorted(docs.collect())
    with pytest.raises(Exception):
        store._commit(store.manifest(), before)  # a version can be made once only


def test_warc_records_are_linked(spark):
    html = '<html lang="fr"><title>A &amp; B</title><script>x</script><!-- c --><p>One<br>two &lt;3</p><a href="/x">l</a></html>'
    responses = warc_derivatives.responses_of(spark.createDataFrame([(1, "http://a/", html), (2, None, None)], "page_id long, url string, html string"))
    rows = {(r["page_id"], r["type"]): r for r in warc_derivatives.derive(responses).collect()}
    source = {r["page_id"]: r for r in responses.collect()}
    text = rows[1, "conversion"]
    assert text["block"] == "A & B\nOne\ntwo <3\nl" and text["refers_to"] == source[1]["record_id"] and text["n_bytes"] == len(text["block"].encode())
    import base64
    import hashlib

    assert text["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(text["block"].encode()).digest()).decode()
    assert f"WARC-Refers-To: {source[1]['record_id']}\r\n" in text["record"] and text["source_headers"] == source[1]["http_headers"]
    assert "language: fr\r\noutlinks: 1" in rows[1, "metadata"]["block"] and rows[2, "conversion"]["block"] == ""


def test_references_are_resolved_once(spark):
    text = "&#39; &#x41;&eacute;&amp;lt; &amp;eacute; &#38;lt; &nbsp;&unknown; a&b &#55296; &#0; &lt;b&gt; &Alpha"
    got = spark.createDataFrame([(text,), ("no reference",), (None,)], "t string").select(warc_derivatives.resolved(F.col("t"))).collect()
    assert [r[0] for r in got] == ["' Aé&lt; &eacute; &lt;  &unknown; a&b � � <b> &Alpha", "no reference", None]


def test_pages_of_every_kind_give_linked_records(spark):
    import hashlib

    pages = spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(-1, "u", "<p>" + "x " * 500_000), (-2, None, "<script>" * 3000), (-2, None, "<script>" * 3000)], pages.schema)
    responses = warc_derivatives.responses_of(pages.unionByName(odd))
    sources = {r["record_id"]: r for r in responses.collect()}
    records = warc_derivatives.derive(responses).collect()
    assert len(records) == 2 * responses.count()
    for r in records:
        source, block = sources[r["refers_to"]], r["block"].encode()
        assert r["target_uri"] == source["target_uri"] and r["n_bytes"] == len(block)
        assert r["record"].encode().endswith(b"\r\n\r\n" + block + b"\r\n\r\n") and f"Content-Length: {len(block)}\r\n" in r["record"]
        import base64

        digest = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r["block_digest"] == digest(block) and r["payload_digest"] == digest(source["body"].encode())


def test_registered_names():
    assert [f"op{n}" for n in range(1, 11)] == sorted((q.split("_")[0] for q in queries.QUERIES), key=lambda x: int(x[2:]))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    from compare import connect, differences

    assert differences(queries.QUERIES[name](spark, DIR), connect(DIR), queries.ORACLES[name]) is None
