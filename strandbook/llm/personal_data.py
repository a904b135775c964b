"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the matches of four fixed patterns, and key-like tokens (32 hexadecimal digits or more). Every
identifier-like token (three digits or more, or an @ between other characters) is an instance; the word before
it, the two words before it and the word after it are its lexical patterns. Spark scores the graph of patterns
and instances in rounds: a pattern is worth the share of its instances that are believed, an instance is
believed as far as its patterns are reliable (noisy or). Seeds are believed from the start. Tokens that no base
match covers and reliable patterns surround, keys among them, are added as spans of kind ``other``; a key alone is no
span. Base spans stay. Work is n log n in the matches of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SPACE, Scratch, row_key, unused

# The fixed patterns in possessive form: each scan is linear, and where a match may start is said by a
# look-behind, so that leftmost matches are the same as those of the plain forms.
LOCAL = r"A-Za-z0-9._%+\-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20\-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
KINDS = tuple(PATTERNS)
OTHER = "other"
#: A token with three digits or more, or with an @ between other characters: an instance that contexts may speak for.
INSTANCE = (
    rf"(?<![^{SPACE}])(?:[^0-9{SPACE}]*+[0-9][^0-9{SPACE}]*+[0-9][^0-9{SPACE}]*+[0-9][^{SPACE}]*+"
    rf"|@*+[^@{SPACE}]++@++[^@{SPACE}][^{SPACE}]*+)"
)

#: Quotes, brackets and marks around a token: two tokens that differ in them only are one; a span covers them.
AROUND = "\"'()[]{}<>.,;:!?#%$&*|="
#: A token that is a seed by its form, though no span by it: hexadecimal digits, both figures and letters.
KEY = r"^(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}+$"

ROUNDS = 3
LEAST_SUPPORT = 5  # different believed instances that a pattern needs
LEAST_RELIABILITY = 0.8  # share of a pattern's instances that are believed
LEAST_BELIEF = 0.9  # belief from which an unseen token counts


SPAN = "struct<kind:int,start:int,end:int>"


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op) -> Column:
    """An array's running totals under an associative op, by doubling steps: n log n, where an aggregate that appends takes n squared."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, values, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, op(x, F.get(acc, i - d))).otherwise(x)))


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their places: array of (match, before, two, after, start, end), code points, end exclusive.

    The text is split at the matches, and places are running sums of the pieces' lengths; before and after
    are the neighbouring words, two the two words before (empty where there is but one up to the match before).
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Only the beginnings of words are tried, so that long words are read once.
    last = lambda piece: F.regexp_extract(piece, f"(?<![^{SPACE}])([^{SPACE}]++)[{SPACE}]*+$", 1)
    pair = lambda piece: F.regexp_extract(piece, f"(?<![^{SPACE}])([^{SPACE}]++[{SPACE}]++[^{SPACE}]++)[{SPACE}]*+$", 1)
    first = lambda piece: F.regexp_extract(piece, f"^[{SPACE}]*+([^{SPACE}]++)", 1)
    told = F.zip_with(
        F.arrays_zip(F.transform(pieces, F.length).alias("n"), F.transform(pieces, last).alias("before"), F.transform(pieces, pair).alias("two"), F.slice(F.transform(pieces, first), 2, F.size(pieces)).alias("after")),
        found,
        lambda p, m: F.struct(p["n"].alias("gap"), m.alias("match"), p["before"].alias("before"), p["two"].alias("two"), p["after"].alias("after")),
    )
    told = F.filter(told, lambda x: x["match"].isNotNull())

    def placed(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda x: x["gap"] + F.length(x["match"])), lambda x, y: x + y)
        return F.zip_with(rows, ends, lambda x, end: F.struct(x["match"], x["before"], x["two"], x["after"], (end - F.length(x["match"])).alias("start"), end.alias("end")))

    return bound(told, placed)


def overlapped(spans: Column, base: Column) -> Column:
    """For each of the spans (start, end), whether one of base overlaps it: the farthest end of those that start before its end, by one sorted sweep."""
    event = lambda at, kind, end, i: F.struct(at.alias("at"), F.lit(kind).alias("kind"), end.alias("end"), i.alias("i"))
    # Of equal places the span's end comes first, since ends are exclusive.
    events = F.array_sort(F.concat(F.transform(base, lambda s: event(s["start"], 1, s["end"], F.lit(-1))), F.transform(spans, lambda s, i: event(s["end"], 0, F.lit(-1), i))))
    swept = bound(events, lambda e: F.zip_with(e, running(F.transform(e, lambda x: x["end"]), F.greatest), lambda x, far: F.struct(x["i"].alias("i"), far.alias("far"))))
    flags = F.array_sort(F.filter(swept, lambda x: x["i"] >= 0))
    return F.zip_with(spans, flags, lambda s, x: x["far"] > s["start"])


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) > 3) | (F.right(p, F.lit(3)).cast("int") > 255))
    digits = F.regexp_replace(match, "[^0-9]++", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20\-]?[0-9]", "phone": r"\+[0-9]"}


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by kind as listed, then by start. The patterns run only where a gate lets them."""
    none = F.array().cast(f"array<{SPAN}>")
    found = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = F.transform(
            F.filter(located(text, pattern), lambda x: _valid(kind, x["match"])),  # noqa: B023
            lambda x: F.struct(F.lit(number).alias("kind"), x["start"].alias("start"), x["end"].alias("end")),  # noqa: B023
        )
        found.append(F.when(text.rlike(GATES[kind]), spans).otherwise(none))
    return F.concat(*found)


def instances(text: Column, base: Column) -> Column:
    """Identifier-like tokens with their contexts, whether a base span overlaps them, and whether they look like a key."""
    none = F.array().cast("array<struct<token:string,before:string,two:string,after:string,start:int,end:int,covered:boolean,key:boolean>>")

    def stripped(x: Column) -> Column:
        bare = F.rtrim(F.ltrim(x["match"], F.lit(AROUND)), F.lit(AROUND))
        return F.struct(F.lower(bare).alias("token"), F.lower(x["before"]).alias("before"), F.lower(x["two"]).alias("two"), F.lower(x["after"]).alias("after"), x["start"], x["end"], bare.rlike(KEY).alias("key"))

    marked = bound(
        F.filter(F.transform(located(text, INSTANCE), stripped), lambda x: x["token"] != ""),
        lambda found: F.zip_with(found, overlapped(found, base), lambda x, covered: F.struct(x["token"], x["before"], x["two"], x["after"], x["start"], x["end"], covered.alias("covered"), x["key"])),
    )
    return F.when(text.rlike("[0-9@]"), marked).otherwise(none)


def learned_spans(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(row_key, extra: sorted array of spans) for rows of (row_key, seen: array of instances), by bootstrapping.

    A row with no instance that a reliable pattern surrounds is left out. No instances: no rows.
    """
    seen = scratch.keep(found.select("row_key", F.explode("seen").alias("x")).select("row_key", "x.*").distinct().withColumn("seed", F.col("covered") | F.col("key")), "instances")
    contexts = F.array(F.concat(F.lit("<"), "before"), F.concat(F.lit("<<"), F.regexp_replace("two", f"[{SPACE}]++", " ")), F.concat(F.lit(">"), "after"))
    sides = F.explode(F.filter(contexts, lambda p: ~p.isin("<", "<<", ">"))).alias("pattern")
    edges = scratch.keep(seen.select("token", "seed", sides).groupBy("pattern", "token").agg(F.max("seed").alias("seed")), "edges")
    seeds = edges.groupBy("token").agg(F.max("seed").alias("seed"))
    beliefs = seeds.select("token", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("belief"), "seed")
    for turn in range(ROUNDS):
        scored = edges.select("pattern", "token").join(beliefs, "token").groupBy("pattern").agg(F.avg("belief").alias("reliability"), F.count_if(F.col("belief") >= LEAST_BELIEF).alias("support"))
        reliable = scratch.keep(scored.filter((F.col("support") >= LEAST_SUPPORT) & (F.col("reliability") >= LEAST_RELIABILITY)), f"reliable-{turn}")
        doubt = edges.select("pattern", "token").join(reliable, "pattern").groupBy("token").agg(F.sum(F.log(1 - F.least("reliability", F.lit(0.999)))).alias("doubt"))
        beliefs = scratch.keep(seeds.join(doubt, "token", "left").select("token", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp(F.coalesce("doubt", F.lit(0.0)))).alias("belief"), "seed"), f"beliefs-{turn}")
    open_ends = seen.filter("not covered").select("row_key", "start", "end", sides).join(reliable, "pattern")
    spoken = open_ends.groupBy("row_key", "start", "end").agg(F.sum(F.log(1 - F.least("reliability", F.lit(0.999)))).alias("doubt")).filter(1 - F.exp("doubt") >= LEAST_BELIEF)
    extra = F.array_sort(F.collect_set(F.struct(F.lit(len(KINDS)).alias("kind"), "start", "end"))).alias("extra")
    return scratch.keep(spoken.groupBy("row_key").agg(extra), "extra")


def _written(spans: Column) -> Column:
    names = F.lit([*KINDS, OTHER])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, row_key, n_email, n_ip, n_card, n_phone, base_sha256, spans, found (array of spans).

    Null texts count as empty: no spans, the digest of an empty string. Repeated rows get equal results.
    Whole texts are searched; places are code points, ends exclusive. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    based = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    based = scratch.keep(based.select("doc_id", "row_key", "base", instances(F.col("text"), F.col("base")).alias("seen")), "based")
    extra = learned_spans(based.filter(F.size("seen") > 0), scratch)
    scratch.drop_all("based", "extra")
    out = based.drop("seen").join(extra, "row_key", "left").withColumn("found", F.concat("base", F.coalesce("extra", F.array().cast(f"array<{SPAN}>"))))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]  # noqa: B023
    return out.select("doc_id", "row_key", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"), "found")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    All other columns stay as they are. Rows without spans keep their texts; null texts stay null.
    """
    key, spans = unused("__key", docs), unused("__found", docs)
    found = find(docs, id_col, text_col).filter(F.size("found") > 0).select(F.col("row_key").alias(key), F.col("found").alias(spans)).dropDuplicates([key])
    text, names = F.col(text_col), F.lit([k.upper() for k in (*KINDS, OTHER)])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def rewritten(x: Column) -> Column:
        """x: the text in blocks, the spans in order, and how far they reach up to each."""
        part = lambda low, high: _cut(x["blocks"], low, high)
        reach = F.concat(F.array(F.lit(0)), x["ends"])
        pieces = F.zip_with(x["spans"], F.slice(reach, 1, F.size(x["spans"])), lambda s, at: F.when(s["start"] >= at, F.concat(part(at, s["start"]), F.lit("["), F.get(names, s["kind"]), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), part(F.element_at(reach, -1), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    held = bound(ordered, lambda o: F.struct(blocks.alias("blocks"), o.alias("spans"), running(F.transform(o, lambda s: s["end"]), F.greatest).alias("ends")))
    cut = bound(held, rewritten)
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(_sized(found, spans), key, "left")
    return joined.withColumn(text_col, F.when(F.col(spans).isNotNull(), cut).otherwise(text)).select(*(F.col(f"`{c}`") for c in docs.columns))


BLOCK = 1024  # code points


def _cut(blocks: Column, low: Column, high: Column) -> Column:
    """The code points from low up to high of a text in BLOCKs: only the blocks that hold them are read."""
    first, last = F.floor(low / BLOCK).cast("int"), F.floor((high - 1) / BLOCK).cast("int")
    held = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(high <= low, "").otherwise(F.substring(held, low - first * BLOCK + 1, high - low))


def _sized(found: DataFrame, spans: str) -> DataFrame:
    """found with a broadcast hint if its keys and spans, measured, are small enough."""
    size = found.agg(F.sum(32 + 12 * F.size(spans)).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(found) if size <= BROADCAST_BYTES else found
