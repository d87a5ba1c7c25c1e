"""Operators that judge each text alone, against brute force: rules, secrets, tokens, recipes, packing."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import common, exact_dedup, features, packing, quality_classifier, quality_rules, secrets, token_counts
from docloom.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t ", "a", "é" * 3, "x " * 60, "one two three " * 40, "A\x1cb\xa0c d", "<|endoftext|> x<|endoftext|>", "a\r\n\r\nb  c\td", "日本語 テスト 😀", "w" * 5000]


def noise(n, seed=1):
    rnd = random.Random(seed)
    letters = " ab'st\n1,!é😀#&|$  THEq0" + "".join(map(chr, range(0x20, 0x180)))
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(80))) for _ in range(n)]


def test_word_hashes():
    texts = [t or "" for t in ODD] + noise(200)
    raw, offsets = common.text_buffer(pa.array(ODD + noise(200)))
    names, seen = {}, {}
    for a, b in common.slices(offsets, 100):
        hashes, at = common.word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for i in range(a, b):
            words = WORD.findall(texts[i])
            own = hashes[at[i - a] : at[i - a + 1]].tolist()
            assert len(words) == len(own)
            for w, h in zip(words, own):
                assert names.setdefault(w, h) == h and seen.setdefault(h, w) == w


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_window_hashes(size):
    words = np.random.default_rng(1).integers(0, 3, 200).astype(np.uint64) * np.uint64(2**61 + 5) + np.uint64(1)
    hashes = common.window_hashes(words, size)
    assert len(hashes) == 200 - size + 1
    keys = [tuple(words[i : i + size].tolist()) for i in range(len(hashes))]
    assert len(set(keys)) == len(set(hashes.tolist())) == len(set(zip(keys, hashes.tolist())))


def rules(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_quality_rules(spark, docs):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("aeiounstrlm") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    clean = [" ".join(rnd.choice(vocabulary) for _ in range(120)) for i in range(40)]
    junk = [" ".join(rnd.choice(vocabulary).upper() + "$$$" for k in range(80)) for i in range(10)]
    texts = [*ODD, *noise(30), *clean, *junk]
    df = docs(list(enumerate(texts))).unionByName(docs([(None, "x y z " * 30)]))
    trusted = spark.createDataFrame([(len(ODD) + 30 + i,) for i in range(25)] + [(None,)], "doc_id long")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(df, trusted).collect()}
    assert len(rows) == len(texts) + 1
    for i, t in enumerate(texts):
        want = rules(t or "")
        assert {k: rows[i][k] for k in want} == want, t
        assert rows[i].base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
    start = len(ODD) + 30
    scores = [(round(rows[start + i].llr, 3), rows[start + i].kept, rows[start + i].base_failed) for i in range(50)]
    assert all(rows[start + i].kept for i in range(40)), scores
    assert not any(rows[start + 40 + i].kept for i in range(10)), scores
    kept = quality_rules.quality_filter(df, trusted)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in rows.items() if r.kept)
    # the score by hand, for one text
    raw, own = Counter(), Counter()
    for i, t in enumerate([*texts, "x y z " * 30]):
        grams = features.gram_buckets(np.frombuffer((t or "").encode(), np.uint8), quality_rules.BITS).tolist()
        raw.update(grams)
        own.update(grams if start <= i < start + 25 else [])
    bins = 1 << quality_rules.BITS
    grams = features.gram_buckets(np.frombuffer(texts[start].encode(), np.uint8), quality_rules.BITS).tolist()
    llr = np.mean([np.log((own[g] + 1) / (sum(own.values()) + bins)) - np.log((raw[g] + 1) / (sum(raw.values()) + bins)) for g in grams])
    assert abs(rows[start].llr - llr) < 1e-6


def test_quality_rules_without_trust_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long")
    assert quality_rules.quality_rules(docs([]), none).count() == 0
    r = quality_rules.quality_rules(docs([(1, " ".join(f"w{k}" for k in range(60)))]), none).head()
    assert r.kept and not r.base_failed


def spans(text):
    out = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets(docs):
    body = "aB3" * 10
    good = "ghp_" + body + secrets.base62(zlib.crc32(body.encode()), 6)
    bad = "ghp_" + body + "000000"
    rnd = random.Random(3)
    parts = ["password", "PassWd=", "toKen : ", "api_key", "apikey'", "secret", "=", ":", "\"", "abc", "123456", "AKIA", "ABCDEFGHIJ12345678", "deadbeef" * 3, "0123456789abcdef", " ", "\n", "é", "İ", "ſecret=abcdefg", "K", "tokentoken=secret=abcdefgh"]
    texts = [*ODD, good, bad, "passwd=passwd=abcdef", "AKIA" * 9, "-----BEGIN RSA PRIVATE KEY-----", *("".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(400))]
    rows = {r.doc_id: r for r in secrets.digest(secrets.secret_spans(docs(list(enumerate(texts))))).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = spans(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert rows[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), t
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(s[0] == k for s in want) for k in secrets.KINDS[:3])
        assert [s for s in rows[i].spans.split(",") if s.split(":")[0] in secrets.KINDS[:3]] == [s for s in listed.split(",") if s] or not listed
    assert rows[len(ODD)].spans == f"checked_token:0:{len(good)}" and rows[len(ODD) + 1].spans == ""
    assert rows[len(ODD) + 4].spans.startswith("private_key:0:")


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    texts = [*ODD, *noise(600), "\n \n  a", " lead", "trail ", "áé​"]
    library = Tokenizer.from_file(path)
    rows = {r.doc_id: r for r in token_counts.token_counts(docs(list(enumerate(texts))), path).collect()}
    for i, t in enumerate(texts):
        want = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), want, want > 512), t


def test_merging_by_hand():
    ranks = {(1, 2): (0, 10), (10, 3): (2, 11), (2, 3): (1, 12)}
    assert token_counts.merged([1, 2, 3], ranks) == 1 and token_counts.merged([2, 3, 3], ranks) == 2 and token_counts.merged([], ranks) == 0


def test_exact_dedup(docs):
    long = " ".join(f"Word{i}" for i in range(4000))
    texts = ["Same", "same", "SAME", "sÄme", "säme", None, "", long, long.upper(), long + "x", long[:9000] + "y" + long[9001:]]
    rows = [*enumerate(texts), (2, "SAME"), (None, "same")]
    got = exact_dedup.exact_groups(docs(rows)).collect()
    lower = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    want = []
    for i, t in rows:
        group = [j for j, u in rows if lower(u) == lower(t)]
        keep = max(j for j in group if j is not None)
        want.append((i, keep, len(group), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    kept = exact_dedup.exact_dedup(docs(rows)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 4, 6, 8, 9, 10]
    rows += [(None, "alone"), (None, "ALONE"), (None, None), (20, "x"), (20, "X"), (20, "y"), (21, "y"), (4, "z")]
    kept = exact_dedup.exact_dedup(docs(rows)).collect()
    assert Counter((r.doc_id, lower(r.text)) for r in kept) == Counter([(2, "same"), (3, "sÄme"), (4, "säme"), (4, "z"), (6, ""), (None, "alone"), (20, "x"), (21, "y"), *((i, lower(texts[i])) for i in (8, 9, 10))])
    assert exact_dedup.exact_dedup(docs([])).count() == 0
    assert exact_dedup.exact_groups(docs([])).count() == 0


def test_recipes_verify_identifiers(spark):
    """Two chunks with one identifier and different checks must not be taken for the same."""
    rows = [(1, "a", [(5, 1, 3)]), (2, "b", [(5, 2, 3)]), (3, "a", [(5, 1, 3)]), (4, "c", [(6, 1, 1), (7, 1, 1)])]
    df = spark.createDataFrame(rows, "doc_id long, text_sha256 string, chunks array<struct<id:bigint,check:bigint,size:int>>")
    got = {r.doc_id: tuple(r.recipe) for r in exact_dedup.verified_recipes(df).collect()}
    assert got[1] == got[3] != got[2] and got[4] == (6, 7)


def test_chunks_are_content_defined():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 200_000, dtype=np.uint8)
    ends = exact_dedup.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= exact_dedup.MOST and (sizes[:-1] >= exact_dedup.LEAST).all()
    moved = exact_dedup.cuts(np.concatenate([data[:50_000], data[:10], data[50_000:]]))
    assert len({e - 10 for e in moved} & set(ends)) > 0.8 * sum(e > 60_000 for e in ends)
    assert exact_dedup.cuts(data[:0]) == []


def test_packing(docs):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    texts = [*ODD, *noise(300), "word " * 5000, "<|startoftext|>a", "Ärger Ñandú ŞŸ", "'s 'st don't 12"]
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs([*enumerate(texts), (0, ""), (None, "a b")]), path, capacity=64).collect()
    bins, by_doc = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert -(-total // 64) <= len(bins) <= -(-total // 64) + 1
    for i, t in enumerate(texts[1:], 1):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces] == [(k, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert len(by_doc[0]) == 2
    assert packing.pack_documents(docs([]), path).count() == 0


def test_fullest_combination_is_the_fullest():
    rnd = random.Random(5)
    for _ in range(200):
        counts = {rnd.randrange(1, 30): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 7))}
        lengths = sorted(counts, reverse=True)
        picked = packing.fullest(lengths, counts, 30)
        assert all(k <= counts[n] for n, k in picked.items()) and lengths[0] in picked
        sums = {lengths[0]}
        for n in lengths:
            sums = {s + n * k for s in sums for k in range(counts[n] + 1 - (n == lengths[0])) if s + n * k <= 30}
        assert sum(n * k for n, k in picked.items()) == max(sums)


def test_quality_classifier(spark, docs):
    rnd = random.Random(2)
    words = ["river", "green", "people", "walk", "house", "small", "sunday", "garden"]
    rows = [(i, " ".join(rnd.choice(words) + ("$$$" if i % 4 == 0 else "") for _ in range(rnd.randrange(20, 90)))) for i in range(240)]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(240)] + [(None, 1), (3, None)], "doc_id long, quality int")
    df = docs(rows + [(900, None), (901, "")])
    held = quality_classifier.held_out()
    train = labels.where(~held)
    got = {r.doc_id: r for r in quality_classifier.quality_scores(df, train).select("doc_id", held.alias("held_out"), "score", "predicted").collect()}
    test = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in test) for i in range(240)) and len(got) == 242
    assert np.mean([got[i].predicted == (i % 4 != 0) for i in test]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    again = {r.doc_id: r.score for r in quality_classifier.quality_scores(df, train).collect()}
    assert again == {i: r.score for i, r in got.items()}
    assert {r.score for r in quality_classifier.quality_scores(df, labels.limit(0)).collect()} == {0.5}


def test_quality_classifier_by_hand(spark, docs, monkeypatch):
    """Features, weights, threshold and scores, worked out one by one."""
    for name, value in (("PAIRS", 240), ("ROUNDS", 3), ("BATCH", 16)):
        monkeypatch.setattr(quality_classifier, name, value)
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["river", "green", "walk", "house"] if i % 3 else ["$$", "buy", "now", "!!"]) for _ in range(rnd.randrange(5, 40)))) for i in range(60)] + [(60, ""), (61, None)]
    truth = {i: int(i % 3 > 0) for i in range(0, 50)}
    labels = spark.createDataFrame([*truth.items()], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.quality_scores(docs(rows), labels).collect()}

    def vector(text):
        raw = (text or "").encode()
        counts = [0] * (1 << quality_classifier.BITS)
        for k in range(len(raw) - 3):
            v = int.from_bytes(raw[k : k + 4], "little")
            counts[((v ^ v >> 15) * 2246822507 % 2**32) >> (32 - quality_classifier.BITS)] += 1
        dense = features.shape(*common.text_buffer(pa.array([text or ""])))[0]
        return np.array([math.sqrt(np.float64(c) / max(1, sum(counts))) for c in counts] + [*dense]).astype(np.float32)

    x = np.array([vector(t) for _, t in rows])
    y = np.array([truth[i] for i in range(50)])
    good, bad = [i for i in range(50) if y[i]], [i for i in range(50) if not y[i]]
    rng, w, m, v, t = np.random.default_rng(7), np.zeros(x.shape[1]), 0.0, 0.0, 0
    for r in range(3):
        a, b = rng.choice(good, 80), rng.choice(bad, 80)
        for k in range(0, 80, 16):
            g = quality_classifier.DECAY * w
            pairs = [x[i] - x[j] for i, j in zip(a[k : k + 16], b[k : k + 16])]
            g = g - sum(d / (1 + math.exp(d @ w)) for d in pairs) / len(pairs)  # the gradient of log(1 + exp(-w d))
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - quality_classifier.RATE * (1 - r / 3) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    strength = x[:50] @ w
    ranked = sorted(strength)
    middle = (ranked[len(bad) - 1] + ranked[len(bad)]) / 2  # as many of the labelled rows lie below as are of the worse class
    want = {i: 1 / (1 + math.exp(-(x[k] @ w - middle) / strength.std() * 4)) for k, (i, _) in enumerate(rows)}
    assert max(abs(got[i] - want[i]) for i in want) < 2e-3 and {i: s >= 0.5 for i, s in got.items()} == {i: s >= 0.5 for i, s in want.items()}
    assert all((got[i] >= 0.5) == bool(truth[i]) for i in truth)


def test_fitted_rows_are_bounded_by_key(spark, docs):
    rows = [(1, f"good {k}") for k in range(50)] + [(2, "bad"), (3, "worse"), (None, "x")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (9, 1)], "doc_id long, quality int")
    x, y = quality_classifier.training_rows(docs(rows), labels, "text", "doc_id", "quality", 1)
    assert len(x) == len(y) <= 2
    x, y = quality_classifier.training_rows(docs(rows), labels, "text", "doc_id", "quality", 10)
    assert sorted(y.tolist()) == [0, 0, 1]
    assert quality_classifier.quality_scores(docs([]), labels).count() == 0
