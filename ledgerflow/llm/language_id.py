"""Language identification as multilingual mixture inference.

Each language is a distribution over hashed byte trigrams.  For a document, expectation-maximisation estimates the
proportions of the languages that best explain its trigrams; the set of languages grows greedily while the penalised
likelihood (Bayesian information criterion) improves.  The model is a (cells x languages) table: 32 kB a language, so
several thousand languages fit a worker; its size doesn't follow the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytekernels import ASCII_LOWER, lean, slices, text_buffer

UNKNOWN = "und"


@dataclass(frozen=True)
class MixtureRules:
    """penalty: what a further language must gain in log-likelihood, as a multiple of ln(trigrams) / 2."""

    cells: int = 4096
    rounds: int = 12
    smoothing: float = 0.5
    penalty: float = 4.0
    rows_at_once: int = 64


def _cells(data: np.ndarray, cells: int) -> np.ndarray:
    """The cell of the trigram at each byte but the last two; runs of anything but letters count as one space."""
    low = ASCII_LOWER[data].astype(np.uint32)
    low[low < 97] = 32
    low[(low > 122) & (low < 128)] = 32
    h = (low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(12)) % np.uint32(cells)


def trigram_counts(data: np.ndarray, offsets: np.ndarray, rules: MixtureRules) -> np.ndarray:
    """(documents x cells) counts; a trigram of three spaces doesn't count."""
    n = len(offsets) - 1
    out = np.zeros((n, rules.cells))
    if len(data) < 3:
        return out
    cell = _cells(data, rules.cells)
    low = ASCII_LOWER[data]
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    use = letter[:-2] | letter[1:-1] | letter[2:]
    ends = offsets[1:-1]
    for back in (1, 2):
        at = ends - back
        use[at[(at >= 0) & (at < len(use))]] = False  # trigrams that reach into the next document
    doc = np.repeat(np.arange(n), np.diff(offsets))[: len(cell)]
    return np.bincount(doc[use] * rules.cells + cell[use], minlength=n * rules.cells).reshape(n, rules.cells).astype(float)


def fit_languages(df: DataFrame, text_col: str, lang_col: str, rules: MixtureRules = MixtureRules()) -> tuple[list[str], np.ndarray]:
    """(languages, cells x languages probabilities) from every row with a text and a language.

    Each task sums its rows to at most cells counts a language, so what is shuffled and returned depends on the number
    of tasks and languages, not of rows, and no key gathers rows: partial sums are added per (language, cell).
    """
    schema = "lang string, cell int, n double"

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, offsets = text_buffer(batch.column(1))
            for a, b, part, places in slices(data, offsets):
                for at in range(a, b, rules.rows_at_once):
                    end = min(b, at + rules.rows_at_once)
                    lo, hi = places[at - a], places[end - a]
                    counts = trigram_counts(part[lo:hi], places[at - a : end - a + 1] - lo, rules)
                    for lang in set(langs[at:end]):
                        sums[lang] = sums.get(lang, 0) + counts[langs[at:end] == lang].sum(0)
        for lang, total in sums.items():
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell, pa.int32()), pa.array(total[cell])], ["lang", "cell", "n"])

    rows = df.select(F.col(f"`{lang_col}`").cast("string").alias("l"), F.col(f"`{text_col}`").alias("t")).where("l is not null and t is not null")
    found = rows.mapInArrow(lean(partial), schema).groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = found.toPandas()  # at most cells rows a language
    languages = sorted(set(table["lang"]))
    counts = np.zeros((rules.cells, max(1, len(languages))))
    place = {x: i for i, x in enumerate(languages)}
    counts[table["cell"].to_numpy(int), [place[x] for x in table["lang"]]] = table["n"].to_numpy(float)
    counts += rules.smoothing
    return languages, counts / counts.sum(0)


def _mix(counts: np.ndarray, model: np.ndarray, chosen: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of each document for its chosen languages (documents x languages mask)."""
    theta = chosen / np.maximum(chosen.sum(1, keepdims=True), 1)
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    for _ in range(rounds):
        theta = theta * ((counts / np.maximum(theta @ model.T, 1e-300)) @ model) / total
    return theta, (counts * np.log(np.maximum(theta @ model.T, 1e-300))).sum(1)


def infer_mixture(counts: np.ndarray, model: np.ndarray, rules: MixtureRules) -> np.ndarray:
    """(documents x languages) proportions; zero for languages outside the chosen set."""
    n, k = len(counts), model.shape[1]
    single = counts @ np.log(model)
    best = single.argmax(1)
    chosen = np.zeros((n, k))
    chosen[np.arange(n), best] = 1
    theta, have = chosen.copy(), single.max(1)
    price = rules.penalty * np.log(np.maximum(counts.sum(1), 2)) / 2
    full, _ = _mix(counts, model, np.ones((n, k)), rules.rounds)  # proportions of all languages name the next candidate
    live = np.arange(n)
    for _ in range(k - 1):
        order = np.where(chosen[live] > 0, -1, full[live])
        add = order.argmax(1)
        live, add = live[order.max(1) > 0.01], add[order.max(1) > 0.01]
        if not len(live):
            break
        trial = chosen[live].copy()
        trial[np.arange(len(live)), add] = 1
        t, score = _mix(counts[live], model, trial, rules.rounds)
        won = score - have[live] > price[live]
        live = live[won]
        chosen[live], theta[live], have[live] = trial[won], t[won], score[won]
    return theta


def with_languages(df: DataFrame, fitted: tuple[list[str], np.ndarray], text_col: str = "text", rules: MixtureRules = MixtureRules()) -> DataFrame:
    """All columns of df, and lang_pred, score (share of that language), n_languages, mixture (language=share, comma
    separated).

    'und' with score 0 where the text is null or has no letter, or nothing was learned; of equal shares the first language
    by name is taken.  One row per row of df, nulls and repeated rows included, so an empty table gives an empty one;
    texts of any length count whole; columns of df with one of these names are replaced.
    """
    languages, model = fitted
    made = ["lang_pred", "score", "n_languages", "mixture"]
    keep = [c for c in df.columns if c not in made]
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(*(F.col(f"`{c}`") for c in keep), text.alias("__l_t"), F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False)).alias("__l_a"))

    def judge(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(keep)))
            known = batch.column(len(keep) + 1).to_numpy(zero_copy_only=False)
            shares = np.zeros((batch.num_rows, model.shape[1]))
            if languages:
                for a, b, part, places in slices(data, offsets):
                    for at in range(a, b, rules.rows_at_once):
                        end = min(b, at + rules.rows_at_once)
                        lo, hi = places[at - a], places[end - a]
                        shares[at:end] = infer_mixture(trigram_counts(part[lo:hi], places[at - a : end - a + 1] - lo, rules), model, rules)
            best, top = shares.argmax(1), np.clip(shares.max(1), 0, 1)
            good = known & bool(languages)
            names = [languages[b] if g else UNKNOWN for b, g in zip(best, good, strict=True)]
            said = [",".join(f"{languages[j]}={s[j]:.3f}" for j in np.argsort(-s, kind="stable") if s[j] > 0) if g else "" for s, g in zip(shares, good, strict=True)]
            own = [batch.column(k) for k in range(len(keep))]
            new = [pa.array(names, pa.string()), pa.array(np.where(good, top, 0.0)), pa.array(np.where(good, (shares > 0).sum(1), 0).astype(np.int32)), pa.array(said, pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *new], [*keep, *made])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double, n_languages int, mixture string"])
    return rows.mapInArrow(lean(judge), schema)


def identify_languages(df: DataFrame, fitted: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", rules: MixtureRules = MixtureRules()) -> DataFrame:
    """doc_id and the columns of with_languages()."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("__l_text"))
    return with_languages(rows, fitted, "__l_text", rules).drop("__l_text")


def held_out(id_col: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 3, is 1.  A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
