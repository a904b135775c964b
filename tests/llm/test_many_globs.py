"""The automaton with thousands of globs, held against the standard library's matcher, one glob and URL at a time."""

import fnmatch
import random
import re

from strandbook.llm import url_filters


def test_three_thousand_globs_and_a_long_url():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcde/.") for _ in range(rng.randint(1, n)))
    globs = ["*" + "*".join(word(4) for _ in range(rng.randint(1, 3))) for _ in range(3000)]
    urls = [f".{word(8)}\0/{word(30)}" for _ in range(60)] + ["", "." + "a" * 20_000 + "\0/e"]
    automaton = url_filters.ShiftAnd(globs, [True] * len(globs))
    fits = automaton.run([u.encode() for u in urls])
    for i, glob in enumerate(globs):
        pattern = re.compile(fnmatch.translate(glob + "*"))
        assert fits[:60, i].tolist() == [bool(pattern.match(u)) for u in urls[:60]], glob
    assert not fits[60].any() and 0 < fits[:60].sum() < fits[:60].size
    assert all(fits[61, i] for i, g in enumerate(globs) if set(g) <= {"*", "a"})


def test_rules_come_from_any_list(spark):
    rows = [(i, f"http://h{i}.site{i % 7}.net/p{i % 11}/x") for i in range(500)]
    rules = tuple(("block" if i % 2 else "allow", f"h{i}.site{i % 7}.net/p{i % 11}") for i in range(0, 500, 3))
    got = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules, globs=(("block", "*/p10/*"),)).collect()
    assert len(got) == 500
    for r in got:
        i = r["page_id"]
        want = ("block" if i % 2 else "allow") if i % 3 == 0 else "block" if i % 11 == 10 else "allow"
        assert r["verdict"] == want and (r["rule"] is not None) == (i % 3 == 0)
