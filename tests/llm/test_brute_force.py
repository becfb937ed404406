"""Operators against plain versions of their definitions, on a small table with nulls, empty and long texts, ties,
repeated rows and clashing columns."""

import bisect
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import language_id, media_columns, ngram_join, packing, quality_rules, sentencepieces, substring_dedup, suffix_dedup, token_index, url_filter
from ledgerflow.llm.queries import vocabulary

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, h long, at int, kept string, node long, label string"


def fixture_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    passage, base = text(60), text(120).split(" ")
    out = [text(rng.randint(1, 200)) for _ in range(30)]
    out += [f"{text(20)}\n{passage}\t{text(10)}" for _ in range(12)]
    for k in range(25):  # near copies
        words = list(base)
        for _ in range(k % 6):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append(" ".join(words))
    out += ["Same text here " * 9] * 4 + ["same text here " * 9, "one", "One", "two words", "", " \n ", "x" * 3000, "The " * 900, "😀 日本語 \u00a0 ﬁ ▁x  y\r\n\x0bz", "don't we'll 'sx a'B1c2 (x)y!z\n\nNew\n line\n", "<|endoftext|> a", "a<|endoftext|>b\n<|endoftext|><|startoftext|> c <|endof text|>", "x <|startoftext|>", "<|endoftext|>", "#$% & | |\n| a | b | c |\n"]
    out.append(text(6000))
    rows = [(i * 3 % 211, t) for i, t in enumerate(out)]
    return [*rows, (None, passage), (None, out[3]), (500, None), (501, None)]


@pytest.fixture(scope="module")
def rows():
    return fixture_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k", 3, "l") for i, t in rows], COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


def result(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ids_of(name, rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for _, x in rows]


def test_token_index(spark, docs, rows, empty):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    ids = ids_of("word_bpe_49k.json", ordered, 1)
    start = np.cumsum([0, *map(len, ids)])
    manifest = token_index.write_token_shards(docs, vocabulary("word_bpe_49k.json"), 1, shards=4)
    want = sorted(((r[0], int(s), len(x), crc(x)) for r, s, x in zip(ordered, start[:-1], ids, strict=True)), key=repr)
    assert result(token_index.read_token_shards(manifest), "doc_id", "start", "n_tokens", "ids_crc32") == want
    asked = spark.createDataFrame([(3,), (10_000,), (9,)], "doc_id long")
    by = {r[0]: x for r, x in zip(ordered, ids, strict=True)}
    assert {r.doc_id: r.ids for r in token_index.lookup(spark, manifest, asked).collect()} == {3: by[3], 9: by[9]}
    assert token_index.read_token_shards(token_index.write_token_shards(empty, vocabulary("word_bpe_49k.json"), 1)).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 20_000))
    nulls = np.zeros(len(keys), bool)
    h = token_index.PerfectHash.build(keys, nulls)
    assert sorted(h.slots(keys, nulls).tolist()) == list(range(len(keys)))


def jaccard_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").encode().translate(bytes(ngram_join.ASCII_LOWER)))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (i, least.get(g)) if x is not None), default=None)
    return sorted(((i, len(s), least[g] if s else i) for (i, _), s, g in zip(rows, sets, group, strict=True)), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(docs, rows, n, percent):
    out = ngram_join.ngram_components(docs, rules=ngram_join.JoinRules(words=n, percent=percent))
    assert result(out, "doc_id", "n_shingles", "component_id") == jaccard_components(rows, n, percent)


def jaccard_links(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").encode().translate(bytes(ngram_join.ASCII_LOWER)))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    links = lambda x, y: bool(x and y) and 100 * len(x & y) >= percent * len(x | y)
    return sorted(((i, len(x), sum(links(x, y) for k, y in enumerate(sets) if k != at)) for at, ((i, _), x) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 1024), (5, 80, 4)])
def test_ngram_links(spark, docs, rows, empty, n, percent, block):
    """Every link of a group is counted, however many blocks it has; repeated rows are copies."""
    rules = ngram_join.JoinRules(words=n, percent=percent, block_rows=block)
    more = docs.unionByName(docs.where("doc_id between 100 and 140"))
    twice = rows + [r for r in rows if r[0] is not None and 100 <= r[0] <= 140]
    want = jaccard_links(twice, n, percent)
    assert max(r[2] for r in want) > 4
    assert result(ngram_join.ngram_components(more, rules=rules, links=True), "doc_id", "n_shingles", "n_links") == want
    assert ngram_join.ngram_components(empty, rules=rules, links=True).count() == 0


def test_ngram_join_of_nothing(empty, docs):
    assert ngram_join.ngram_components(empty).count() == 0
    assert ngram_join.ngram_components(docs.where("text is null")).count() == 2


def test_signatures_agree_for_every_link():
    """Sets of all sizes with as many changes as a link allows share a signature."""
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        for n in (*range(1, 40), 99, 100, 101, 250, 1200):
            x = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
            drop = int(n * (100 - percent) / (100 + percent))
            keep = rng.permutation(n)[: n - drop]
            y = np.sort(np.concatenate([x[keep], rng.integers(0, 2**64, drop, dtype=np.uint64)]))
            inter = len(np.intersect1d(x, y))
            if 100 * inter < percent * (2 * n - inter):
                continue
            key, doc, inst = ngram_join.signatures(np.concatenate([x, y]), np.repeat([0, 1], n), 2, percent)
            extra, seen = ngram_join.size_ranges(percent)[3], rng.permutation(len(key))  # any frequencies
            seen = dict(zip(key[::-1].tolist(), seen.tolist(), strict=True))
            left = [set(), set()]
            for d in (0, 1):
                for i in set(inst[doc == d].tolist()):
                    own = sorted(key[(doc == d) & (inst == i)].tolist(), key=lambda k: (-seen[k], -k))
                    left[d] |= set(own[extra[i] :])
            assert left[0] & left[1], (percent, n)


def test_quality_rules(docs, rows, empty):
    out = quality_rules.quality_rules(docs)
    want = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)} if len(grams) < 1500 else set(range(len(w))) if len(set(grams)) == 1 else set()
        if len(grams) >= 1500 and len(set(grams)) > 1:
            seen: dict = {}
            for k, g in enumerate(grams):
                seen.setdefault(g, []).append(k)
            hit = {k + d for v in seen.values() if len(v) > 1 for k in v for d in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in quality_rules.SYMBOLS), len(lines) - len(set(lines)), len(hit), failed))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert result(out, *names) == sorted(want, key=repr)
    assert out.where("base_failed and kept").count() == 0
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_lines(spark):
    good = "A clean line of plain words that ends well. " * 8
    df = spark.createDataFrame([(good,), (good + "\n" + "Home | About | Help | More\n" * 30,), ("# % words $$ and ## signs ** " * 20,)], "text string")
    assert [r.kept for r in quality_rules.quality_rules(df).collect()][1:] == [False, False]
    line = spark.createDataFrame([("All is well.", False), ("no end", True), ("a | b | c | d.", True), ("We use cookies.", True), ("BUY NOW!! BUY!! NOW!!", True)], "l string, bad boolean")
    assert all(r[0] == r[1] for r in line.select(quality_rules.failing_line(F.col("l")), "bad").collect())


def test_packing(docs, rows, empty):
    out = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 0, keep_ids=True)
    got = out.collect()
    want = sorted((r[0], len(x)) for r, x in zip(rows, ids_of("byte_bpe_50k.json", rows, 0), strict=True) if r[0] is not None)
    total, seqs = {}, {}
    for r in got:
        assert r.length <= 2048 and (r.piece == 0 or r.length == 2048) and crc(r.ids) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert sorted(total.items()) == want
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty, vocabulary("byte_bpe_50k.json"), 0).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_configurations(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(257, np.int64)
    lengths = rng.integers(1, 257, 40) if seed else np.arange(1, 257)
    counts[lengths] = rng.integers(1, 400, len(lengths))
    plan = packing.solve_configurations(counts, packing.PackRules(capacity=256))
    back = np.zeros_like(counts)
    for key, times in plan:
        assert sum(m * a for m, a in key) <= 256
        for m, a in key:
            back[m] += a * times
    assert (back == counts).all()
    assert sum(t for _, t in plan) <= best_fit_decreasing(counts, 256)


def best_fit_decreasing(counts, capacity):
    free, used = [], 0
    for length in range(capacity, 0, -1):
        for _ in range(counts[length]):
            at = bisect.bisect_left(free, length)
            room = free.pop(at) if at < len(free) else capacity
            used += room == capacity
            if room > length:
                bisect.insort(free, room - length)
    return used


def test_substring_dedup(docs, rows, empty):
    words = [WORDS.findall((t or "").encode()) for _, t in rows]
    first: dict = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - 12 if i is not None else 0):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    assert result(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (2, text), (2, text), (2, "other " + text)], "doc_id long, text string")
    assert result(substring_dedup.substring_dedup(df), "doc_id", "n_removed") == [(1, 0), (2, 20), (2, 20), (2, 20)]
    assert result(suffix_dedup.suffix_dedup(df), "doc_id", "n_removed")[0] == (1, 0)


def test_suffix_dedup(docs, rows, empty):
    raw = [(t or "").encode() for _, t in rows]
    first: dict = {}
    for (i, _), b in zip(rows, raw, strict=True):
        for k in range(len(b) - 49 if i is not None else 0):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    want = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    out = suffix_dedup.suffix_dedup(docs)
    assert result(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.spans) == r.n_spans for r in out.collect())
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_url_filter(spark):
    urls = ["https://www.Cheap-Pills.example.com/en/1?x", "http://a.example.net/en/x", "http://a.example.net/fr", "https://example.com/de/", "https://notexample.com/de/a", "http://x.org/fr/1#a", "http://x.org/FR/1", "ftp://h?q/net/", "//net/", "", None, "http://net", "http://net/", "http://b.net:80/", "http://é.example.net/ü?", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    weights, bias = url_filter.fit()
    for r in url_filter.url_filter(df).collect():
        host, path = url_filter.split_url(urls[r.page_id])
        fits = [(d + p, v) for d, p, v in url_filter.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        g = url_filter.grams(host, path, url_filter.UrlModel())
        score = 1 / (1 + np.exp(-(bias + sum(weights[k] for k in g) / max(1, len(g)))))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or ("block" if score > 0.5 else "allow")), urls[r.page_id]
        assert abs(r.block_score - score) < 1e-9
    right = [(("block" if label else "allow") == r.verdict) for (_, label), r in zip(url_filter.LABELLED, url_filter.url_filter(spark.createDataFrame(list(url_filter.LABELLED), "url string, label int").coalesce(1), rules=()).collect(), strict=True)]
    assert all(right)
    assert url_filter.url_filter(df.where("page_id < 0")).count() == 0


def test_media(docs, rows, empty):
    out = media_columns.decode_media(media_columns.encode_media(docs))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        full = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        want.append((i, len(b), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert result(out, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    assert media_columns.clip_rows(out).where("end <= first or to_s <= from_s").count() == 0
    assert media_columns.decode_media(media_columns.encode_media(empty)).count() == 0


def test_shots():
    frames = np.concatenate([np.full((10, 8, 64), 20, np.uint8), np.full((6, 8, 64), 200, np.uint8)])
    assert [(a, b) for a, b, _, _ in media_columns.shots(frames, 25.0)] == [(0, 10), (10, 16)]


def test_languages(spark, sf_dir, docs, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = language_id.held_out(F.col("doc_id"))
    fitted = language_id.fit_languages(table.where(~held), "text", "lang")
    judged = language_id.with_languages(table.where(held), fitted)
    assert judged.where("lang_pred = lang").count() >= 0.95 * judged.count()
    odd = {r.text: r for r in language_id.with_languages(docs, fitted).collect()}
    assert (odd[None].lang_pred, odd[""].lang_pred, odd["#$% & | |\n| a | b | c |\n"].lang_pred != "und") == ("und", "und", True)
    assert language_id.identify_languages(empty, fitted).count() == 0
    nothing = language_id.fit_languages(empty.withColumn("lang", F.lit(None).cast("string")), "text", "lang")
    assert {r.lang_pred for r in language_id.identify_languages(docs, nothing).collect()} == {"und"}


def test_two_languages():
    rules = language_id.MixtureRules()
    rng = np.random.default_rng(1)
    model = rng.dirichlet(np.full(rules.cells, 0.05), 3).T + 1e-9
    model /= model.sum(0)
    one = rng.multinomial(400, model[:, 0])
    both = one + rng.multinomial(400, model[:, 2])
    shares = language_id.infer_mixture(np.array([one, both], float), model, rules)
    assert (shares > 0).tolist() == [[True, False, False], [True, False, True]]
    assert abs(shares[1, 0] - 0.5) < 0.1


def test_sentencepieces(docs, rows, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = sorted(((i, len(x := model.encode(t or "")), crc(x), True) for i, t in rows), key=repr)
    assert result(sentencepieces.encode_decode(docs, vocabulary("piece_bpe_32k.model")), "doc_id", "n_pieces", "ids_crc32", "round_trip") == want
    assert sentencepieces.encode_decode(empty, vocabulary("piece_bpe_32k.model")).count() == 0
