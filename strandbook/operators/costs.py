"""Cost events: which operation a log prices, what it costs, and 256-bit sums.

A 256-bit amount is three limbs of 30 decimal digits, each a decimal(38, 0), so that sums add limb by limb
and carry once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BASE = 10**30
TOP = 2**256 - 1
LIMBS = ("l0", "l1", "l2")


def align(logs: DataFrame, group: str = "transaction_hash", index: str = "index") -> DataFrame:
    """logs with op_index: their 0-based number among all storage logs of the transaction."""
    return logs.withColumn("op_index", F.row_number().over(W.partitionBy(group).orderBy(index)) - 1)


def unprocessed(logs: DataFrame, queue: DataFrame, transactions: DataFrame, pending: DataFrame, cleanups: DataFrame) -> DataFrame:
    """Aligned logs that are queued, of successful transactions without operations or cleanups still to do."""
    ready = transactions.filter("status = 1").select("transaction_hash")
    for waiting in (pending, cleanups):
        ready = ready.join(waiting.select("transaction_hash").distinct(), "transaction_hash", "left_anti")
    aligned = align(logs.join(ready, "transaction_hash", "left_semi"))
    return aligned.join(queue.select("transaction_hash", "block_hash", "index"), ["transaction_hash", "block_hash", "index"], "left_semi")


def _digits(word: Column, start: int, length: int) -> Column:
    """length bytes of a 32-byte word from start (1-based) as a decimal below 2 ** (8 * length), for up to 7 bytes."""
    return F.conv(F.hex(F.substring(word, start, length)), 16, 10).cast("decimal(38,0)")


def _whole(a: Column, b: Column) -> Column:
    """a // b of non-negative decimals; dividing only multiples of b keeps rounding out."""
    return ((a - a % b).cast("decimal(38,0)") / b).cast("decimal(38,0)")


def limbs_of_word(word: Column) -> Column:
    """A big-endian 32-byte word as limbs: four-byte digits are folded in one after another."""
    zero = F.lit(0).cast("decimal(38,0)")
    start = F.struct(*(zero.alias(n) for n in LIMBS))
    digits = F.array(*(_digits(word, 1 + 4 * i, 4) for i in range(8)))

    def fold(acc, d):
        # 2**32 * limb stays below 38 digits only in halves: split each limb at 15 digits.
        out, carry = [], d.cast("decimal(38,0)")
        half, factor = F.lit(10**15).cast("decimal(38,0)"), F.lit(2**32).cast("decimal(38,0)")
        for n in LIMBS:
            limb = acc[n].cast("decimal(38,0)")
            low = (limb % half).cast("decimal(38,0)") * factor + carry
            low = low.cast("decimal(38,0)")
            high = (_whole(limb, half) * factor).cast("decimal(38,0)") + _whole(low, half)
            high = high.cast("decimal(38,0)")
            out.append(((high % half) * half + low % half).cast("decimal(38,0)").alias(n))
            carry = _whole(high, half)
        return F.struct(*out)

    return F.aggregate(digits, start, fold)


def add_limbs(columns: Column) -> list[Column]:
    """Sums of the limbs of a struct column, not yet carried: aggregate expressions named like the limbs."""
    return [F.sum(columns[n]).cast("decimal(38,0)").alias(n) for n in LIMBS]


def carry(l0: Column, l1: Column, l2: Column) -> Column:
    """Limbs after carrying, saturated at 2**256 - 1."""
    base = F.lit(str(BASE)).cast("decimal(38,0)")
    over0 = _whole(l0, base)
    m1 = (l1 + over0).cast("decimal(38,0)")
    over1 = _whole(m1, base)
    m2 = (l2 + over1).cast("decimal(38,0)")
    limbs = [(l0 % base).cast("decimal(38,0)"), (m1 % base).cast("decimal(38,0)"), m2]
    return as_text(*limbs)


def as_text(l0: Column, l1: Column, l2: Column) -> Column:
    """90 digits with leading zeros, at most 2**256 - 1: text order is number order."""
    pad = lambda c: F.lpad(c.cast("string"), 30, "0")
    return F.least(F.concat(pad(l2), pad(l1), pad(l0)), F.lit(str(TOP).zfill(90)))


def plain(text90: Column) -> Column:
    """The usual decimal text."""
    bare = F.ltrim(text90, F.lit("0"))
    return F.when(bare == "", "0").otherwise(bare)


DIGITS = 8  # of base 2**32 in a word
NINE = 10**9


def digits_of_word(word: Column) -> list[Column]:
    """The eight digits of base 2**32 of a big-endian 32-byte word, the least first, as decimal(28, 0): sums of them are exact for 10**18 rows."""
    return [F.conv(F.hex(F.substring(word, 29 - 4 * i, 4)), 16, 10).cast("decimal(28,0)") for i in range(DIGITS)]


def text_of_digits(digits: list[Column]) -> Column:
    """The decimal text of summed digits, saturated at 2**256 - 1: one carry, then to base 10**9 in bigints (10**9 * 2**32 fits one)."""
    base = 2**32

    def carry(acc, digit):
        here = (digit + acc["over"]).cast("decimal(38,0)")
        return F.struct(F.concat(acc["out"], F.array((here % base).cast("bigint"))).alias("out"), _floor(here, base).alias("over"))

    def _floor(a, b):
        return F.call_function("div", a, F.lit(b).cast("decimal(38,0)"))

    def shifted(acc, digit):
        def step(s, nine):
            here = nine * base + s["over"]
            return F.struct(F.concat(s["out"], F.array(here % NINE)).alias("out"), F.call_function("div", here, F.lit(NINE).cast("bigint")).alias("over"))

        return F.aggregate(acc, F.struct(none.alias("out"), digit.alias("over")), step, lambda s: s["out"])

    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")

    def finish(acc):
        nines = F.aggregate(F.reverse(acc["out"]), F.array_repeat(zero, 9), shifted)
        text = F.array_join(F.transform(F.reverse(nines), lambda n: F.lpad(n.cast("string"), 9, "0")), "")
        # A pattern names the text once, where plain() would work it out twice.
        long = F.regexp_replace(text, "^0+(?=.)", "")
        digit = lambda i: acc["out"][i]
        # Sums below 2**125, as nearly all are, fit one decimal.
        small = (digit(3) < 2**29) & (digit(4) == 0) & (digit(5) == 0) & (digit(6) == 0) & (digit(7) == 0)
        short = digit(0).cast("decimal(38,0)")
        for i in (1, 2, 3):
            short = short + (digit(i).cast("decimal(38,0)") * F.lit(str(base**i)).cast("decimal(38,0)")).cast("decimal(38,0)")
        return F.when(acc["over"] > 0, str(TOP)).when(small, short.cast("decimal(38,0)").cast("string")).otherwise(long)

    return F.aggregate(F.array(*digits), F.struct(none.alias("out"), zero.alias("over")), carry, finish)


def event_cost(topic: Column, data: Column, created: bytes, updated: bytes, extended: bytes) -> Column:
    """Cost word of a log: the second word of created events, the third of the others; null (quarantine) for anything else."""
    return F.when((topic == F.lit(created)) & (F.octet_length(data) >= 64), F.substring(data, 33, 32)).when(topic.isin(updated, extended) & (F.octet_length(data) >= 96), F.substring(data, 65, 32))


def apply_costs(ops: DataFrame, costs: DataFrame) -> DataFrame:
    """Operations with costs (tx_hash, op_index, cost) set where there is one; of several for an operation, the largest."""
    told = costs.groupBy("tx_hash", "op_index").agg(F.max("cost").alias("__cost"))
    return ops.join(told, ["tx_hash", "op_index"], "left").withColumn("cost", F.coalesce("__cost", "cost")).drop("__cost")


def repriced(ops: DataFrame, costs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operations with their costs, entity keys to fold again, blocks whose statistics are dirty).

    Only operations whose cost changes ask for work: a cost told twice, or told for no operation, affects nothing.
    """
    told = costs.filter("cost is not null").groupBy("tx_hash", "op_index").agg(F.max("cost").alias("__cost"))
    changed = ops.join(told, ["tx_hash", "op_index"]).filter(~F.col("cost").eqNullSafe(F.col("__cost")))
    return apply_costs(ops, costs), changed.select("entity_key").distinct(), changed.select("block_number").distinct()
