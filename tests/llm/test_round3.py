"""Filter audit, conversation repair and language identification against plain Python."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strandbook.llm import conversation_repair, filter_audit, language_id
from strandbook.llm import queries_11_13 as queries
from strandbook.llm.common import Scratch

DIR = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


# ---- filter audit ------------------------------------------------------------------------------------------------


def audit_by_hand(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    failing = []
    for doc_id, text, source in docs:
        t = text or ""
        w = words(t)
        repeated = doc_id is not None and any(d is not None and d < doc_id and (x or "") == t for d, x, _ in docs)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": repeated}
        failing.append((source or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out = set()
    for part in {p for p, *_ in failing}:
        rows = [r for r in failing if r[0] == part]
        removed = {}
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order):
                removed[order, step] = [r for r in rows if letter in r[1] and not r[1] & set(order[:step])]
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order):
                gone = removed[order, step]
                shapley = sum(len(removed[o, o.index(letter)]) for o in itertools.permutations("ABCDE"))
                kept = sum(not r[1] & set(order[: step + 1]) for r in rows)
                redundant = sum(letter in r[1] and bool(r[1] & set(order[:step])) for r in rows)
                out.add((part, "".join(order), step + 1, kept, len(gone), redundant, sum(r[1] == {letter} for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone), shapley))
    return out


def test_audit_equals_sql(spark):
    from compare import connect, differences

    assert differences(queries.op11_filter_audit(spark, DIR), connect(DIR), queries.ORACLES["op11_filter_audit"]) is None


@pytest.mark.parametrize("heap", [0, 1 << 30])
def test_later_smaller_ids_retract_earlier_masks(spark, tmp_path, monkeypatch, heap):
    monkeypatch.setattr(filter_audit, "HEAP_STATE_BYTES", heap)  # 0: the state on disk
    long = " ".join(f"word{i}" for i in range(60))
    docs = [(9, long, "a"), (7, long, "b"), (7, long, "b"), (3, long, None), (12, long, "a"), (None, long, "a"), (None, long, "c"), (None, None, None), (5, None, "a"), (4, "", "a"), (2, "SHOUT # " * 40, "a"), (1, "w " * 9000, "b"), (8, "été " * 20, "c")]
    path = str(tmp_path / "docs")
    for n, row in enumerate(docs):  # one file each, in an order in which smaller ids come later
        spark.createDataFrame([(*row, n)], "doc_id long, text string, source string, mask int").coalesce(1).write.mode("append").parquet(path)
    labels = [(3, 1, 0), (7, 0, 1), (9, None, 1), (9, 1, None), (2, 0, 1), (None, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labels[2:4] = [(9, 1, 1)]
    got = {tuple(r) for r in filter_audit.report(filter_audit.count(spark, path, told, Scratch(spark), micro_batches=20)).collect()}
    assert got == audit_by_hand(docs, labels)


def test_audit_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(path)
    assert filter_audit.audit(spark, path, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_state_is_retracted_in_any_order(spark):
    """The state function alone, over random batches, ends at the counters of a single batch."""

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    import pandas as pd

    rng = random.Random(3)
    rows = [(bytes([rng.randrange(3)]) * 16, 1, rng.choice("ab"), rng.random() < 0.5, False, rng.randrange(12)) for _ in range(200)]

    def counters(batches):
        state, total = State(), {}
        for batch in batches:
            summed = [r for b in filter_audit._summed([_Batch(batch)]) for r in zip(*(c.to_pylist() for c in b.columns))]
            for frame in filter_audit._changes(None, [pd.DataFrame(summed, columns=filter_audit.SUMMED_NAMES)], state):
                for *key, n in frame.itertuples(index=False, name=None):
                    total[tuple(key)] = total.get(tuple(key), 0) + n
        return {k: v for k, v in total.items() if v}

    class _Batch:
        def __init__(self, rows):
            import pyarrow as pa

            self.columns = [pa.array(c) for c in zip(*((d, k, m, p, q, t) for k, m, p, q, t, d in rows))]

    whole = counters([rows])
    for size in (1, 7, 50):
        rng.shuffle(rows)
        assert counters([rows[i : i + size] for i in range(0, len(rows), size)]) == whole


# ---- conversation repair -----------------------------------------------------------------------------------------


def damage_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def faults_by_hand(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repair_by_hand(rows):
    """Cheapest edits and least string by uniform-cost search over whole histories."""
    faults = faults_by_hand(rows)
    heap = [(0, "", 0, "", ())]
    while True:
        cost, letters, i, initials, kept = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, letters, kept
        if len(letters) - i > 3 or not re.fullmatch("s?(ua)*u?", initials):
            continue
        if i < len(rows):
            role, text = rows[i]
            extra = 3 * (faults[i] == "truncated")
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, initials, kept))
            if faults[i] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + extra, letters + "K", i + 1, initials + (role[:1] or "-"), (*kept, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + extra, letters + "R", i + 1, initials + new[0], (*kept, (new, text))))
        for new in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, letters + "I", i, initials + new[0], (*kept, (new, ""))))


def digest(kept):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def audit_of(rows, given=None):
    held, seen = conversation_repair.Audit(1, given), set()
    for n, (role, text) in enumerate(rows):
        bare = text.strip(BLANKS)
        held.take(n, role, text, 1, not bare, bool(bare) and bare[-1] not in ".!?", (role, text) in seen)
        seen.add((role, text))
    return held


def test_cheapest_edits_equal_search():
    rng = random.Random(5)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""] if rng.random() < 0.6 else ["user", "assistant"]), rng.choice(["a.", "b", "", "c!", "d?", "e.", "f."])) for _ in range(rng.randint(0, 6))]
        cost, letters, kept = repair_by_hand(rows)
        assert audit_of(rows).row()[6:] == (cost, letters, digest(kept)), rows


def test_settled_edits_leave_memory():
    held = audit_of([("user" if i % 2 == 0 else "assistant", f"x{i}.") for i in range(5000)])
    assert 5000 - len(held.letters) < 4  # all but the last edits are given out
    nodes, stack = 0, [held.repairer.root]
    while stack:
        node = stack.pop()
        nodes, stack = nodes + 1, stack + node.kids
    assert nodes < 10
    # Where every turn has to be given a role, the first edit depends on the last: all of it stays unresolved, ties included.
    for n in (2000, 2001):
        held = audit_of([("tool", f"x{i}.") for i in range(n)])
        assert not held.letters
        assert held.row()[6:8] == ((3 * n, "R" * n) if n % 2 == 0 else (3 * n + 1, "D" + "R" * (n - 1)))


def conversations_by_hand(rows):
    """Contract rows of damaged conversations: {conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)}."""
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    out = {}
    after = damage_by_hand(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=order)
        pairs = [r[2:] for r in mine]
        turns = {r[1] for r in mine if r[1] is not None}
        faults = faults_by_hand(pairs)
        cost, letters, kept = repair_by_hand(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, digest(kept))
    return out


def test_conversations_equal_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, DIR).collect()}
    assert got == conversations_by_hand(rows)


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, 3, "user", "hello."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 9, "user", "a."), (1, 7, "assistant", "b"), (1, 7, "assistant", "c."), (2, 1, "", "\t\n"), (3, 5, "user", "x" * 200_000 + ".")]
    rows += [(4, n, "user", "again and again.") for n in range(6)] + [(n, 0, "user", "gone?") for n in range(100, 160)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, salt string, copies int")
    damaged = conversation_repair.damaged(df)
    want = conversations_by_hand(rows)
    assert {r[0]: tuple(r)[1:] for r in conversation_repair.audit(damaged).collect()} == want
    assert any(w == (0, 0, 0, 0, 0, 0, "", digest(())) for w in want.values())  # a conversation that lost all its rows
    edits = {}
    for r in conversation_repair.repair(damaged).orderBy("place").collect():
        edits.setdefault(r.conv_id, []).append(r)
    for conv, told in want.items():
        assert "".join(r.edit for r in edits.get(conv, [])) == told[6]
        assert digest([(r.role, r.text) for r in edits.get(conv, []) if r.edit != "D"]) == told[7]
    assert conversation_repair.audit(conversation_repair.damaged(df.limit(0))).count() == 0


# ---- language identification -------------------------------------------------------------------------------------


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = queries.op13_language_id(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id] for r in tested) >= 0.99 * len(tested) > 200


def test_labels_of_held_out_documents_teach_nothing(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    told = lambda d: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language_id.identify(d).collect())
    assert told(docs) == told(other)


def bayes_by_hand(rows, text):
    """Log scores by language, gram by gram."""
    import math

    counts, docs = {}, {}
    for lang, t in rows:
        docs[lang] = docs.get(lang, 0) + 1
        for part in language_id.grams(t):
            for g in part.tolist():
                counts.setdefault(lang, {})[g] = counts.setdefault(lang, {}).get(g, 0) + 1
    scores = {}
    for lang in docs:
        total = sum(counts[lang].values()) + language_id.SMOOTHING * language_id.BUCKETS
        scores[lang] = math.log(docs[lang] / len(rows)) + sum(math.log((counts[lang].get(g, 0) + language_id.SMOOTHING) / total) for part in language_id.grams(text) for g in part.tolist())
    return scores


@pytest.mark.parametrize("block", [1, 2, 32])
def test_scores_equal_plain_bayes(spark, monkeypatch, block):
    import math

    monkeypatch.setattr(language_id, "LANGS_A_BLOCK", block)
    rng = random.Random(2)
    word = {"aa": "abcab", "bb": "bcdbc", "cc": "cdecd", "dd": "abcde"}
    texts = lambda n: [(x, " ".join("".join(rng.choice(word[x]) for _ in range(4)) for _ in range(9))) for x in word for _ in range(n)]
    train, test = texts(6), [t for _, t in texts(4)] + ["ab"]
    counts = language_id.learn(spark.createDataFrame(train, "lang string, text string"), Scratch(spark))
    rows = language_id.predict(spark.createDataFrame([(t,) for t in test], "text string"), counts).collect()
    for r in rows:
        scores = bayes_by_hand(train, r.text)
        best = max(sorted(scores), key=scores.get)
        assert r.lang_pred == best
        assert math.isclose(r.score, 1 / sum(math.exp(s - scores[best]) for s in scores.values()), rel_tol=1e-9)


def test_odd_texts_have_a_defined_language(spark):
    rows = [(1, "the cat and the dog", "en"), (4, "le chat et le chien", "fr"), (None, "the the the", "xx"), (2, None, "en"), (3, "", "fr"), (5, "12 + 3.\n", "en"), (6, "THE CAT", None), (7, "le chat " * 60_000, "fr"), (8, "漢字", None), (8, "漢字", None)]
    docs = spark.createDataFrame([(*r, "kept", 7) for r in rows], "doc_id long, text string, lang string, best string, score int")
    got = {(r.doc_id, r.text): r for r in language_id.identify(docs).collect()}
    assert len(got) == len(rows) - 1 and all(r.best == "kept" for r in got.values())
    for doc_id, text, _ in rows:
        r = got[doc_id, text]
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr")
    assert got[None, "the the the"].held_out is False
    assert {r.lang_pred for r in language_id.identify(docs.filter("lang is null")).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_chunks_do_not_show(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("aBé漢 .1") for _ in range(997))
    whole = sorted(g for part in language_id.grams(text) for g in part.tolist())
    for size in (1, 2, 13, 996, 997):
        monkeypatch.setattr(language_id, "CHUNK", size)
        assert sorted(g for part in language_id.grams(text) for g in part.tolist()) == whole
