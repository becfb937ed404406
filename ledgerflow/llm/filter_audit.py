"""Filter interaction audit: what each filter of a corpus removes in every order of the filters, and its fair share.

Method: inclusion and exclusion.  Joint failures of every set of filters are counted once, as sums of flag products;
Moebius inversion over the sets gives the survivors of any set, and with them what each step of each order removes, what
is redundant and what a filter alone catches.  Shapley shares come from the Harsanyi dividends, which are the joint
counts with a sign, dealt equally to the filters of their set.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytekernels import lean, text_buffer

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
WEIGHTS = ("all", "good", "toxic")


@dataclass(frozen=True)
class AuditRules:
    """Thresholds of the filters: A too few words, B repeated words, C capitals, D symbols, E a copy of an earlier text."""

    least_words: int = 100
    distinct_percent: int = 80
    capital_percent: int = 10
    symbols: bytes = b"#$%&*|"


_CAPITALS = bytes(range(65, 91))


def text_failures(text: bytes, rules: AuditRules = AuditRules()) -> int:
    """Bits of the filters that look at one text alone (A, B, C, D)."""
    words = text.split()  # of bytes: at runs of space and TAB..CR
    n, points = len(words), len(text.decode("utf-8", "replace"))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    symbols = len(text.translate(None, rules.symbols)) < len(text)
    found = (n < rules.least_words, 100 * len(set(words)) < rules.distinct_percent * n, 100 * capitals > rules.capital_percent * points, symbols)
    return sum(x << k for k, x in enumerate(found))


def document_failures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", rules: AuditRules = AuditRules()) -> DataFrame:
    """doc, part, digest (of the text), bits: A to D of every row."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            blob, edges = data.tobytes(), offsets.tolist()
            texts = [blob[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array(np.array([text_failures(t, rules) for t in texts], np.int32))], ["doc", "part", "digest", "bits"])

    return docs.mapInArrow(lean(run), "doc long, part string, digest binary, bits int")


def _label_flags(labels: DataFrame, id_col: str) -> DataFrame:
    has = lambda c: F.coalesce(F.max((F.col(f"`{c}`") == 1).cast("int")), F.lit(0))
    return labels.groupBy(F.col(f"`{id_col}`").cast("long").alias("doc")).agg(has("quality").alias("good"), has("toxic").alias("toxic")).where("doc is not null")


def failure_patterns(failures: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, bits (A to E), good, toxic, n: documents by what they fail.

    Copies are counted before they meet: rows of one text, part and label become one, so a text of very many documents
    is as many rows as it has parts.
    """
    own = failures.join(_label_flags(labels, id_col), "doc", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    kind = ("digest", "part", "good", "toxic", "bits")
    ids = own.groupBy(*kind, "doc").agg(F.count("*").alias("n"))
    alike = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("doc").alias("least"), F.coalesce(F.min_by("n", "doc"), F.lit(0)).alias("at_least"), F.sum(F.when(F.col("doc").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.min("least").over(Window.partitionBy("digest"))
    alike = alike.withColumn("firsts", F.col("no_id") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0))
    copy = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("bits").alias("b"), F.col("firsts").alias("n")), F.struct(F.col("bits").bitwiseOR(F.lit(copy)).alias("b"), (F.col("n") - F.col("firsts")).alias("n"))))
    rows = alike.select("part", "good", "toxic", both.alias("x"))
    return rows.where("x.n > 0").groupBy("part", F.col("x.b").alias("bits"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def joint_failures(patterns: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """part and, for each weight, an array: at place S the documents that fail all filters of the set S (bits)."""
    flag = [F.shiftright("bits", k).bitwiseAND(F.lit(1)) for k in range(n_filters)]
    product = lambda s: reduce(lambda a, b: a * b, [flag[k] for k in range(n_filters) if s >> k & 1], F.lit(1))
    weight = {"all": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    return patterns.groupBy("part").agg(*(F.array(*(F.sum(w * product(s)) for s in range(1 << n_filters))).alias(f"joint_{name}") for name, w in weight.items()))


def _sets(n_filters: int) -> Column:
    return F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))


def survivors(joint: Column, n_filters: int = len(FILTERS)) -> Column:
    """The Moebius inversion: at place P the documents that fail no filter of P."""
    sign = lambda t: 1 - 2 * (F.bit_count(t) % 2)
    inside = lambda t, p: t.bitwiseAND(F.bitwise_not(p)) == 0
    return F.transform(_sets(n_filters), lambda p: F.aggregate(_sets(n_filters), F.lit(0).cast("long"), lambda a, t: a + F.when(inside(t, p), sign(t) * F.get(joint, t)).otherwise(F.lit(0).cast("long"))))


def shapley(joint: Column, bit: Column, n_filters: int = len(FILTERS)) -> Column:
    """n_filters! times the Shapley share of a filter: each set's dividend, dealt equally to the filters in it."""
    whole = F.lit(factorial(n_filters))
    dividend = lambda t: (2 * (F.bit_count(t) % 2) - 1) * F.get(joint, t)
    mine = lambda t: t.bitwiseAND(bit) != 0
    return F.aggregate(_sets(n_filters), F.lit(0).cast("long"), lambda a, t: a + F.when(mine(t), (dividend(t) * whole / F.bit_count(t)).cast("long")).otherwise(F.lit(0).cast("long")))


def order_steps(joint: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step: what is kept, removed, redundant and alone, and the share."""
    n = len(filters)
    rows = joint.withColumns({f"left_{w}": survivors(F.col(f"joint_{w}"), n) for w in WEIGHTS})
    rows = rows.withColumn("filter_order", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(filters)))))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = lambda k: F.instr(F.lit(filters), F.substring("filter_order", k, F.lit(1))) - 1
    rows = rows.withColumn("bit", F.element_at(F.array(*(F.lit(1 << k) for k in range(n))), place(F.col("step")) + 1))
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda a, k: a + F.when(k < F.col("step"), F.element_at(F.array(*(F.lit(1 << x) for x in range(n))), place(k) + 1)).otherwise(F.lit(0)))
    rows = rows.withColumn("before", before).withColumn("after", F.col("before") + F.col("bit"))
    lost = lambda w: F.get(f"left_{w}", "before") - F.get(f"left_{w}", "after")
    others = F.lit((1 << n) - 1) - F.col("bit")
    return rows.select(
        "part", "filter_order", "step", F.get("left_all", "after").alias("kept"), lost("all").alias("removed"), (F.get("joint_all", "bit") - lost("all")).alias("redundant"),
        (F.get("left_all", others) - F.get("left_all", F.lit((1 << n) - 1))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley(F.col("joint_all"), F.col("bit"), n).alias("shapley"),
    )


def filter_audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", rules: AuditRules = AuditRules()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (long counts).

    A null text is empty (it fails A alone, as it has no words); a null part is ''.  A text is a copy if a smaller id has
    the same one anywhere in the table; rows of one id (repeated rows, ties) are never smaller than each other, and a row
    without an id is neither a copy nor an original, and has no labels.  Several labels of an id count if one of them has
    the value.  Texts of any length are judged whole; an empty table gives no rows.  Other columns, whatever their names,
    aren't looked at.
    """
    return order_steps(joint_failures(failure_patterns(document_failures(df, id_col, text_col, part_col, rules), labels, id_col)))
