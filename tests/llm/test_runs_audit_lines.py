"""Periodic runs, filter audit and line dedup against plain versions, on nulls, empty and very long texts, ties, repeated
rows, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from ledgerflow.llm import filter_audit, line_dedup, periodic_runs, queries

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, start long, digest int, g string, doc long, `a.b` string"


def fixture_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdEé") for _ in range(rng.randint(1, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    common, near = line(8), "  Ünter uns GESAGT\t"
    out = [None, "", "\n", " \n\t\x0b\n", "one", "a b " * 40, "x y z\n" * 30 + "end", "# " * 9, "ABC DEF " * 60, "$ 5 & more", "Ünter uns gesagt", "ü" * 9, "É" * 10, "ü" * 10]
    out += [line(rng.randint(1, 150)) for _ in range(25)]
    for k in range(20):
        out.append("\n".join([line(12), common.upper() if k % 3 else common + " ", near, line(3), common][: 2 + k % 4]))
    for _ in range(30):  # repeats inside
        w = [word() for _ in range(rng.randint(12, 90))]
        a, p = rng.randrange(len(w)), rng.randint(1, 9)
        out.append(" ".join(w[i] if i < a else w[a + (i - a) % min(p, len(w) - a)] for i in range(len(w))))
    out += ["p q " * k + line(20) + " r s t" * 7 + " p" * (10 + k) for k in range(3, 9)]  # several runs
    out += [out[20], out[20], out[30]]
    out.append("\n".join(line(9) for _ in range(3000)))
    out.append("long text of words that come again and again " * 30_000)  # over a slice
    rows = [(i * 7 % 501, t) for i, t in enumerate(out)]
    return [*rows, (rows[30][0], rows[30][1]), (rows[31][0], rows[50][1]), (None, common), (None, out[20]), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return fixture_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    lang = lambda k: (None, "", "de", "en")[k % 4]
    return spark.createDataFrame([(i, t, lang(k), 1, 2, "g", k, f"row{k}") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(5).cache()


def result(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def sha(data):
    return hashlib.sha256(data).hexdigest()


# ---- runs ----------------------------------------------------------------------------------------------------------


def plain_runs(w, least=12):
    """(start, length, smallest period) of every run, period by period."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > start and i + p - start >= max(least, 2 * p):
                out.setdefault((start, i + p - start), p)
            i += i == start
    return sorted((s, n, p) for (s, n), p in out.items())


def run_row(text, periods=None):
    w = WORDS.findall((text or "").encode())
    runs = plain_runs(w) if periods is None else periods
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *head, sha("".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2]))).encode()), sha(kept))


RUN_COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs(docs, rows):
    long_ = max((t for _, t in rows if t), key=len)
    n = len(long_.split())
    want = [(i, *run_row(t, [(0, n, 9)] if t == long_ else [] if t and len(t) > 100_000 else None)) for i, t in rows]
    out = periodic_runs.periodic_runs(docs, carry=("a.b",))
    assert out.columns[-1] == "a.b" and out.select("`a.b`").distinct().count() == len(rows)
    assert result(out, "doc_id", *RUN_COLUMNS) == sorted(want, key=repr)
    for r in out.collect():
        assert len(r.runs) == r.n_runs and sha(r.collapsed_text.encode()) == r.collapsed_sha256
    assert sum(w[1] > 1 for w in want) > 2
    assert periodic_runs.periodic_runs(docs.where("doc_id = -1")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_small_alphabets(seed):
    rng = random.Random(seed)
    for _ in range(80):
        texts = [[rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.choice((0, 1, 11, 12, 13, 40, 120)))] for _ in range(rng.randint(1, 6))]
        who, *cols = periodic_runs.find_runs([np.array(x, np.int64) for x in texts])
        got = [[tuple(int(c[k]) for c in cols) for k in np.flatnonzero(who == i)] for i in range(len(texts))]
        assert got == [plain_runs(x) for x in texts]


def test_extensions():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 200):
        x = rng.integers(0, 2, n)
        i, j = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i != j], j[i != j]
        if len(i):
            want = [next((k for k in range(n) if max(a, b) + k >= n or x[a + k] != x[b + k]), n) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
            assert periodic_runs.Extensions(x)(i, j).tolist() == want


def test_planted_repeats(docs, rows):
    def planted(i, t):
        w = WORDS.findall((t or "").encode())
        h = zlib.crc32(str(i).encode())
        if i is None or h % 10 or not w:
            return t
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n)).decode()

    want = sorted(((i, planted(i, t)) for i, t in rows), key=repr)
    assert sum(a != b for a, b in zip(want, sorted(rows, key=repr), strict=True)) > 3
    out = periodic_runs.with_planted_repeats(docs)
    assert out.columns == docs.columns and result(out, "doc_id", "text") == want


def test_run_query(spark, sf_dir):
    """The query on a whole small table."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 1500)
    texts = {r.doc_id: r.text for r in periodic_runs.with_planted_repeats(docs).collect()}
    got = {r.doc_id: tuple(r[c] for c in RUN_COLUMNS) for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(got[i] == run_row(t) for i, t in texts.items()) and any(got[i][0] for i in texts)


# ---- audit ---------------------------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    first, out, docs = {}, {}, []
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang in rows:
        t = t or ""
        w = WORDS.findall(t.encode())
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        own = [x for x in labels if x[0] == i and i is not None]
        docs.append((lang or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    for order in map("".join, permutations("ABCDE")):
        for part, fails, good, toxic in docs:
            gone = next((k for k, f in enumerate(order, 1) if f in fails), 9)
            for k, f in enumerate(order, 1):
                row = out.setdefault((part, order, k), [0] * 6)
                row[0] += gone > k
                row[1] += gone == k
                row[2] += f in fails and gone < k
                row[3] += fails == {f}
                row[4] += gone == k and good
                row[5] += gone == k and toxic
    share = {}
    for (part, order, k), row in out.items():
        share[part, order[k - 1]] = share.get((part, order[k - 1]), 0) + row[1]
    return sorted(((*key, *row, share[key[0], key[1][key[2] - 1]]) for key, row in out.items()), key=repr)


def test_audit(spark, docs, rows):
    labels = [(rows[k][0], k % 2, int(k % 3 == 0)) for k in range(0, len(rows), 2)] + [(rows[4][0], None, 1), (rows[4][0], 0, None), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.filter_audit(docs, table)
    cols = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert result(out, *cols) == plain_audit([(i, t, (None, "", "de", "en")[k % 4]) for k, (i, t) in enumerate(rows)], labels)
    assert result(filter_audit.filter_audit(docs, table.where("doc_id = -1")), "part", "step", "good_lost")[0][2] == 0
    assert filter_audit.filter_audit(docs.where("doc_id = -1"), table).count() == 0


# ---- lines ---------------------------------------------------------------------------------------------------------


def plain_lines(rows):
    key = lambda x: x.strip(b" \t\n\x0b\x0c\r").lower()
    first = {}
    for i, t in rows:
        for x in (t or "").encode().split(b"\n"):
            if i is not None and len(key(x).decode()) >= 10:
                first[key(x)] = min(i, first.get(key(x), i))
    out = []
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if i is None or i <= first.get(key(x), i)]
        out.append((i, len(lines), len(lines) - len(kept), sha(b"\n".join(kept))))
    return sorted(out, key=repr)


def test_lines(docs, rows):
    want = plain_lines(rows)
    assert sum(w[2] > 0 for w in want) > 15
    out = line_dedup.line_dedup(docs, carry=("a.b", "g"))
    assert out.columns[-2:] == ["a.b", "g"] and result(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert all(sha(r.kept_text.encode()) == r.kept_sha256 for r in out.collect())
    empty = docs.where("doc_id = -1")
    assert line_dedup.line_dedup(empty).count() == 0
    assert result(line_dedup.line_dedup(docs.where("doc_id is null")), "n_dropped") == [(0,)] * 3


def test_lines_of_very_many_tasks(spark, monkeypatch):
    """Hot lines are dealt by document, and their smallest document still stays alone."""
    monkeypatch.setattr(line_dedup.sketch, "HOT", 4)
    rows = [(k, f"A line that all have\nline number {k // 2}\nA line that all have") for k in range(200, 0, -1)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(16))
    assert result(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == plain_lines(rows)


def test_broken_media(spark):
    """Null, cut and foreign files have a reason; the files beside them are decoded as by themselves."""
    from ledgerflow.llm import media_columns

    texts = [(1, "A text."), (2, "another one " * 40), (3, None), (4, "x" * 300)]
    good = media_columns.encode_media(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    rows = [(r.doc_id, r.n_bytes, bytes(r.media)) for r in good]
    rows += [(5, 0, None), (None, 3, rows[1][2][:-200]), (7, 3, rows[1][2][:40]), (8, 3, b""), (9, 3, b"RIFF????AVI LIST" * 9), (10, 3, rows[1][2].replace(b"\xff\xc3", b"\xff\xc0"))]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {r.doc_id: r for r in media_columns.decode_media(df).collect()}
    alone = {r.doc_id: r for r in media_columns.decode_media(df.where("doc_id < 5")).collect()}
    assert all(got[k] == alone[k] and got[k].error is None and got[k].payload_bytes for k in (1, 2, 3, 4))
    for k in (5, None, 7, 8, 9, 10):
        assert got[k].error and got[k].payload_sha256 is None and got[k].feature is None and got[k].clips is None
    assert got[5].error == "no file" and got[5].media_bytes is None and got[8].media_bytes == 0
    assert media_columns.decode_media(df.where("doc_id = 99")).count() == 0
