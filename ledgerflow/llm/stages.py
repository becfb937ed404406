"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> rows; all but the last return the columns of docs.

Stages compute under private names, so a column of docs may have any name and passes unchanged; text and n_chars follow
what a stage does to the text.  An empty table stays empty, a text is taken whole whatever its length, and repeated rows
are judged alike in every stage; what nulls, ties and repeated rows mean beside that is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, ngram_join, packing, quality_rules, substring_dedup
from .queries import vocabulary
from .store import tidy

#: A document goes if no language explains this share of its text.
MIN_SHARE = 0.5


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under private names, and the private name of each column."""
    names = {c: f"__stage_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(_quoted(c).alias(n) for c, n in names.items())), names


def _shown(rows: DataFrame, names: dict[str, str], docs: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
    """rows under the names and types of docs; columns in `new` by name, n_chars after a new text."""
    new = dict(new or {})
    if "text" in new and "n_chars" in names:
        new["n_chars"] = F.length(new["text"])
    return rows.select(*(new.get(c, F.col(n)).cast(docs.schema[c].dataType).alias(c) for c, n in names.items()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without the lines that fail.  A null or empty text goes."""
    tidy(spark)
    rows, names = _hidden(docs)
    judged = quality_rules.quality_rules(rows, names["text"]).where("kept")
    return _shown(judged, names, docs, {"text": F.col("clean_text")})


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; learned from those of them that aren't held out and have a lang.  A text that is null
    or has no letter goes, and every document where no row has a lang; of equally likely languages the first by name is taken."""
    tidy(spark)
    rows, names = _hidden(docs)
    fitted = language_id.fit_languages(rows.where(~language_id.held_out(F.col(names["doc_id"]))), names["text"], names["lang"])
    judged = language_id.with_languages(rows, fitted, names["text"])
    return _shown(judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SHARE)), names, docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that with the least doc_id, then the least hash of its text (one of them, if rows repeat);
    a row without an id stays only if its group has none with an id.  Rows of one id need not be of one group.  Of rows
    with the empty set, which link with nothing, all but equal ones stay."""
    rows, names = _hidden(docs)
    doc, text = F.col(names["doc_id"]).cast("long"), F.col(names["text"]).cast("string")
    groups = ngram_join.ngram_components(rows, names["doc_id"], names["text"], ngram_join.JoinRules(words=5, percent=80), labels=True)
    group = F.coalesce(F.col("label"), F.xxhash64("doc_id", "tkey"))
    first = groups.groupBy(group.alias("g"), F.col("label").isNull().alias("none")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "tkey")).alias("r"))
    key = ["__x", "__d", "__k"]  # no nulls in it, so that the rows that meet also lie together for dropDuplicates
    kept = first.select(F.col("r.x").alias("__x"), F.coalesce("r.doc_id", F.lit(0)).alias("__d"), F.col("r.tkey").alias("__k"))
    keyed = rows.select("*", doc.isNull().alias("__x"), F.coalesce(doc, F.lit(0)).alias("__d"), F.xxhash64(text).alias("__k"))
    return _shown(keyed.join(kept, key, "left_semi").dropDuplicates(key), names, docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word windows of those with smaller ids.  Every row stays, a null text as an empty one;
    rows without an id, and rows with one id among themselves, lose nothing to each other."""
    tidy(spark)
    rows, names = _hidden(docs)
    others = tuple(n for c, n in names.items() if c not in ("doc_id", "text", "n_chars"))
    out = substring_dedup.substring_dedup(rows, names["doc_id"], names["text"], carry=others)
    return _shown(out, names, docs, {"doc_id": F.col("doc_id"), "text": F.col("kept_text")})


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of documents and their places in sequences.  A null text is empty: its end id is a piece."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("ngram_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]
