"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And automaton: one bit per literal place, one mask per
byte for places that read it and one for places that a wildcard lets stay. A step shifts the state words
(with carries between words) and masks them, so that all rules advance at once over each canonical URL.
A batch of URLs is stepped together, one array operation per place and word.

Canonical form: ``.host`` with A-Z lower-cased, a zero byte, and the path up to ``?`` or ``#``. In rules,
``*`` stands for any run without the zero byte; in the extra globs for any run, so that they search host and path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import widened

# The rules of the filter list, in order, and the globs that judge what no rule fits.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
GLOBS = tuple(("block", glob) for glob in (
    "*spam*", "*cheap-pills*", "*casino*", "*.xxx", "*porn*", "*viagra*", "*poker*bonus*", "*payday*loan*", "*replica*watch*", "*keygen*", "*warez*", "*crack*serial*",
    "*/ads/*", "*/adserver/*", "*/banners/*", "*/popup*", "*/tracker/*pixel*", "*/pixel.gif*", "*/wp-login*", "*/phpmyadmin*", "*/cgi-bin/*search*", "*/calendar/*/*/*", "*/login/*return*", "*/print/*/print/*",
))
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Glob:
    """A glob over the canonical form, with what it says; it fits a URL that has a prefix of this form."""

    glob: str
    verdict: str
    rule: str | None
    rank: tuple
    across: bool = False  # whether * passes from the host to the path


def compiled_rules(rules=RULES, globs=GLOBS) -> list[Glob]:
    """Globs in rising precedence: extra globs first, then rules, the longest last (ties: the longer host, then text)."""
    out = [Glob(g, v, None, (0, 0, 0, g), True) for v, g in globs]
    for verdict, rule in rules:
        host, slash, rest = rule.partition("/")
        out.append(Glob(f"*.{host.translate(str.maketrans(UPPER, LOWER))}\0{slash}{rest}", verdict, rule, (1, len(rule), len(host), rule)))
    return sorted(out, key=lambda g: g.rank)


class ShiftAnd:
    """The packed automaton of several globs; ``across`` says of each whether its * passes the zero byte (none by default)."""

    def __init__(self, globs: list[str], across: list[bool] | None = None):
        places: list[tuple[int, int]] = []  # (byte to read to get here or -1, least byte that lets stay)
        self.finals, starts = [], []
        for glob, least in zip(globs, [0 if a else 1 for a in across or [False] * len(globs)]):
            starts.append(len(places))
            places.append((-1, 256))
            for byte in glob.encode("utf-8"):
                if byte == ord("*"):
                    places[-1] = (places[-1][0], least)
                else:
                    places.append((byte, 256))
            self.finals.append(len(places) - 1)
        self.words = max(1, -(-len(places) // 64))
        self.read = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        bit = lambda p: np.uint64(1 << p % 64)
        for p in starts:
            self.begin[p // 64] |= bit(p)
        for p, (byte, stays) in enumerate(places):
            if byte >= 0:
                self.read[byte, p // 64] |= bit(p)
            self.stay[stays:, p // 64] |= bit(p)
        for p in self.finals:  # once reached, a final place is kept to the end
            self.stay[:, p // 64] |= bit(p)

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Which globs fit: one row per text, one column per glob."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order])
        state = np.tile(self.begin, (len(texts), 1))
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        first = ends - sizes
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step))  # texts longer than step come first
            byte, now = flat[first[:live] + step], state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.read[byte]) | (now & self.stay[byte])
        fits = np.zeros((len(texts), len(self.finals)), bool)
        for i, p in enumerate(self.finals):
            fits[order, i] = (state[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1) == 1
        return fits


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end. Else empty."""
    parts = r"(?s)^.*?://([^/?#]*+)([^?#]*+)"
    u = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(u, parts, 1), UPPER, LOWER), F.regexp_extract(u, parts, 2)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, globs=GLOBS, default: str = DEFAULT) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (the longest that fits, else null), verdict.

    A rule ``host/path`` fits its host and all subdomains if the path starts with the rule's. Where none
    fits, the globs decide by host and path, then the default. Null URLs and those without :// have empty host and path and
    fit no rule. Zero bytes in URLs read as U+FFFD. Repeated rows are judged alike; other columns are not read.
    """
    table = compiled_rules(rules, globs)

    def run(batches):
        automaton = ShiftAnd([g.glob for g in table], [g.across for g in table])
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                texts = [f".{h}".replace("\0", "�").encode() + b"\0" + p.replace("\0", "�").encode() for h, p in zip(part.column("host").to_pylist(), part.column("path").to_pylist())]
                fits = automaton.run(texts)
                rule, verdict = [None] * len(texts), [default] * len(texts)
                for i, g in enumerate(table):
                    for row in np.flatnonzero(fits[:, i]):
                        rule[row], verdict[row] = g.rule, g.verdict
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*part.schema.names, "rule", "verdict"])

    host, path = host_and_path(F.col(url_col))
    plain = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    return plain.mapInArrow(run, widened(plain, rule=T.StringType(), verdict=T.StringType()))
