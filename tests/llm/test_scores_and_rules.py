"""Language-model scores, quality rules, language, mixing."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import documents, words
from unbrev.llm import context_mixing, language, mixing, ngram_ratio
from unbrev.llm.common import crc_remainder


def crc(i, m):
    return None if i is None else zlib.crc32(str(i).encode()) % m


def by_id(row):
    return (row[0] is None, row[0] or 0, *map(str, row[1:]))


# -- language-model scores ---------------------------------------------------------


def test_base_scores_equal_brute_force(odd_docs, monkeypatch):
    monkeypatch.setattr(context_mixing, "FLUSH_BYTES", 4000)
    monkeypatch.setattr(context_mixing, "BUCKET_BYTES", 6000)
    got = context_mixing.score_texts(odd_docs, crc_remainder(F.col("doc_id"), 5) == 1).collect()
    rows = documents()
    train = [words(t) for i, t, *_ in rows if crc(i, 5) != 1]
    counts = Counter(w for ws in train for w in ws)
    total, kinds = sum(counts.values()) + len(train), len(counts) + 1
    want = []
    for i, t, *_ in rows:
        ws = words(t)
        c = [counts[w] for w in ws] + [len(train)]
        base = sum(math.log10((x + 0.5) / (total + 0.5 * (kinds + 1))) for x in c)
        want.append((i, crc(i, 5) == 1, len(c), sum(x > 0 for x in c), total, round(base, 6)))
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(found, key=by_id) == sorted(want, key=by_id)
    assert all(r.score < 0 for r in got)


def test_model_is_a_probability(spark):
    """After any context the bytes' probabilities sum to 1, and texts like those learnt
    from cost less than others."""
    docs = spark.createDataFrame([(i, "the cat sat on the mat. " * 200) for i in range(8)], "id int, text string")
    model = context_mixing.fit(docs)
    last = np.array([ord("t")], np.uint64) << np.uint64(8)
    codes = last | np.arange(256, dtype=np.uint64)
    at = context_mixing.Places(codes, np.zeros(256, np.uint64))
    assert abs((10 ** model.bit_costs(at)).sum() - 1) < 1e-9
    rows = [(1, 0, "the cat sat on the mat. " * 5), (2, 0, "zq xv jk wq zz yx qj vk. " * 5)]
    texts = spark.createDataFrame(rows, "doc_id bigint, tag bigint, text string")
    scores = {r.doc_id: r.score for r in context_mixing.model_scores(texts, model).collect()}
    assert scores[1] > 0.5 * scores[2]


def test_every_context_keeps_its_own_counts(spark, monkeypatch):
    """Counts equal brute force for more contexts than 2 ** 20 slots keep apart, however
    tasks hand them on."""
    monkeypatch.setattr(context_mixing, "COUNTED_BYTES", 50_000)
    monkeypatch.setattr(context_mixing, "HELD_ENTRIES", 100_000)
    monkeypatch.setattr(context_mixing, "ASK_BYTES", 30_000)
    draw = np.random.default_rng(3)
    texts = ["".join(map(chr, draw.integers(97, 123, 20_000))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = context_mixing.fit(docs)
    want = Counter()
    for text in texts:
        line = b"\0" * 5 + text.encode() + b"\xff"
        want.update((line[i - k : i], k, line[i]) for i in range(5, len(line)) for k in context_mixing.ORDERS)
    seen = texts[0].encode()
    at, _ = context_mixing.places(np.frombuffer(seen, np.uint8), np.array([0, len(seen)]))
    table = model.table(at)
    line = b"\0" * 5 + seen + b"\xff"
    for k, keys in zip(context_mixing.ORDERS, context_mixing._keys(at)):
        own = np.searchsorted(table.keys, keys)
        assert (table.keys[own] == keys).all()
        assert table.times[own].tolist() == [want[line[i - k : i], k, line[i]] for i in range(5, len(line))]
    assert sum(n for n in map(len, texts)) + len(texts) == sum(
        int(np.frombuffer(r.data, np.int64).sum()) for r in model.counts.collect()
    ) / context_mixing.TABLES
    # Contexts that were never seen have no counts of others.
    fresh = np.frombuffer(("QZ" * 5000).encode(), np.uint8)
    at, _ = context_mixing.places(fresh, np.array([0, len(fresh)]))
    assert not any(model.table(at).stretched(keys)[6:-1].any() for keys in context_mixing._keys(at))
    # Asking the buckets gives what the whole table gives.
    rows = docs.filter("doc_id < 4").withColumn("tag", F.lit(0).cast("bigint"))
    for r in context_mixing.model_scores(rows, model).collect():
        data = np.frombuffer(texts[r.doc_id].encode(), np.uint8)
        at, _ = context_mixing.places(data, np.array([0, len(data)]))
        assert abs(model.bit_costs(at).sum() - r.score) < 1e-6


def test_counts_travel_small_and_whole(spark, monkeypatch):
    """A bucket's counts are one row, in less than half of their 16 bytes an entry, and come
    back as they were."""
    draw = np.random.default_rng(5)
    keys = np.unique(draw.integers(0, 1 << 40, 20_000).astype(np.uint64) << np.uint64(23) | draw.integers(97, 123, 20_000).astype(np.uint64))
    for own in (keys, keys[:1], keys[:0]):
        table = context_mixing.Table(own, draw.geometric(0.5, len(own)) * (1 + 10**9 * (np.arange(len(own)) == 7)))
        row = table.sealed()
        back = context_mixing.Table.opened(*map(pa.scalar, row))
        assert (back.keys == own).all() and back.times.tolist() == table.times.tolist()
        assert len(own) < 2 or sum(map(len, row)) < 8 * len(own)
    monkeypatch.setattr(context_mixing, "COUNTED_BYTES", 500)
    texts = [(i, "the cat sat on the mat. " * 5) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    model = context_mixing.fit(docs)
    buckets = [r.bucket for r in model.sealed.collect()]
    assert len(buckets) == len(set(buckets)) > 1


def test_bits_after_few_and_many_bytes(monkeypatch):
    """Going through a context's bytes gives what searching its entries gives."""
    draw = np.random.default_rng(6)
    own = np.unique(draw.integers(0, 30, 400).astype(np.uint64) << np.uint64(8) | draw.integers(0, 256, 400).astype(np.uint64))
    table = context_mixing.Table(own, draw.integers(1, 9, len(own)))
    keys = np.arange(32 << 8).astype(np.uint64)
    few = table.stretched(keys)
    monkeypatch.setattr(context_mixing, "FEW", 256)
    assert np.allclose(table.stretched(keys), few, atol=1e-6)
    low, high = (np.searchsorted(own, k) for k in (keys & ~np.uint64(255), (keys | np.uint64(255)) + np.uint64(1)))
    assert np.allclose(table._mixed_bits(keys, low, high), few, atol=1e-6)


def test_no_texts_to_score(no_docs):
    assert context_mixing.score_texts(no_docs, F.lit(False)).count() == 0


# -- quality rules -------------------------------------------------------------------


def test_quality_counts_equal_brute_force(odd_docs, spark):
    trusted = spark.createDataFrame([(1,), (2,), (2,), (None,), (10_000,)], "doc_id bigint")
    got = ngram_ratio.judge_quality(odd_docs, trusted).collect()
    want = []
    for i, t, *_ in documents():
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        places = defaultdict(list)
        for k in range(len(ws) - 4):
            places[tuple(ws[k : k + 5])].append(k)
        repeated = {x for at in places.values() if len(at) > 1 for k in at for x in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(ws) < 10 or 100 * len(repeated) > 20 * len(ws)
        counts = (len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"))
        want.append((i, *counts, len(lines) - len(set(lines)), len(repeated), failed))
    found = [tuple(r)[:7] for r in got]
    assert sorted(found, key=by_id) == sorted(want, key=by_id)
    assert all(not (r.base_failed and r.kept) for r in got)


def test_ratio_equals_brute_force(spark):
    good = [(i, "alpha beta gamma delta " * 6) for i in range(5)]
    bad = [(i + 5, "qq ww ee rr tt yy " * 6) for i in range(3)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    trusted = spark.createDataFrame([(i,) for i in range(4)], "doc_id bigint")
    (ratios,) = ngram_ratio.log_ratios(docs, trusted).first()
    numbers = docs.select("doc_id", ngram_ratio.features(ngram_ratio.word_hashes(F.col("text"))).alias("f"))
    sets = {r.doc_id: r.f for r in numbers.collect()}
    raw = Counter(x for f in sets.values() for x in f)
    target = Counter(x for i in range(4) for x in sets[i])
    n_raw, n_target, size = sum(raw.values()), sum(target.values()), ngram_ratio.BUCKETS
    for x in range(size):
        want = math.log((target[x] + 1) / (n_target + size)) - math.log((raw[x] + 1) / (n_raw + size))
        assert abs(ratios[x] - want) < 1e-12
    scores = {r.doc_id: r.score for r in ngram_ratio.judge_quality(docs, trusted).collect()}
    for i, f in sets.items():
        assert abs(scores[i] - sum(ratios[x] for x in f) / len(f)) < 1e-9
    assert min(scores[i] for i in range(5)) > max(scores[i] for i in range(5, 8))
    none = ngram_ratio.judge_quality(docs, trusted.limit(0)).select("score").distinct().collect()
    assert [tuple(r) for r in none] == [(0.0,)]


def test_no_documents_to_judge(no_docs):
    assert ngram_ratio.judge_quality(no_docs, no_docs.select("doc_id")).count() == 0


# -- language ------------------------------------------------------------------------

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(word, ids, p):
    """Probability and expected piece counts, by trying every way to cut the word."""
    total, uses = 0.0, Counter()

    def go(i, q, used):
        nonlocal total
        if i == len(word):
            total += q
            for x in used:
                uses[x] += q
            return
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in ids:
                go(j, q * p[ids[word[i:j]]], [*used, ids[word[i:j]]])
            elif j == i + 1:
                go(j, q * p[-1], [*used, len(p) - 1])

    go(0, 1.0, [])
    return total, {x: n / total for x, n in uses.items()}


def test_forward_sums_all_segmentations():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            ids.setdefault(model.id_to_piece(i), len(ids))
    vocabulary = language.Vocabulary.load(PIECES)
    p = np.random.default_rng(0).random(vocabulary.size)
    p /= p.sum()
    strings = ["▁the", "▁information", "▁straße", "▁中x", "▁a", "ꙮ"]
    cut = language.Segmentations(strings, vocabulary)
    total, used = cut.forward(p[cut.piece])[cut.last], cut.uses(p[cut.piece])
    for k, word in enumerate(strings):
        want, uses = all_segmentations(word, ids, p)
        assert abs(total[k] / want - 1) < 1e-9
        own = defaultdict(float)
        for arc in np.flatnonzero(cut.owner == k):
            own[int(cut.piece[arc])] += used[arc]
        assert all(abs(own[x] - n) < 1e-9 for x, n in uses.items())


def log_of_all_segmentations(word, ids, p):
    """Log probability and expected piece counts, exactly: in whole numbers over a power of two."""
    p = [Fraction(float(x)) for x in p]
    longest = max(map(len, ids))

    def arcs(i):
        for j in range(i + 1, min(len(word), i + longest) + 1):
            if word[i:j] in ids:
                yield j, ids[word[i:j]]
            elif j == i + 1:
                yield j, len(p) - 1

    every = [list(arcs(i)) for i in range(len(word))]
    before, after = [Fraction(0)] * (len(word) + 1), [Fraction(0)] * (len(word) + 1)
    before[0] = after[-1] = Fraction(1)
    for i, own in enumerate(every):
        for j, x in own:
            before[j] += before[i] * p[x]
    for i in range(len(word) - 1, -1, -1):
        after[i] = sum(p[x] * after[j] for j, x in every[i])
    total = after[0]
    uses = Counter()
    for i, own in enumerate(every):
        for j, x in own:
            uses[x] += float(before[i] * p[x] * after[j] / total)
    return math.log(total.numerator) - math.log(total.denominator), uses


def test_long_words_are_taken_whole():
    """Words of 200 letters, pieces as rare as 1e-11: no cut is left out, nothing underflows."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            ids.setdefault(model.id_to_piece(i), len(ids))
    vocabulary = language.Vocabulary.load(PIECES)
    rare = np.full(vocabulary.size, 1e-11)
    common = np.random.default_rng(1).random(vocabulary.size) / vocabulary.size
    pieces = np.array([rare, common])
    long = ["information" * 18 + "xy", "ꙮ" * 200, "straßenbahn" * 5, "the"]
    got = language.word_scores(long, vocabulary, pieces)
    assert np.isfinite(got).all()
    for k, word in enumerate(long):
        for lang, p in enumerate(pieces):
            want, uses = log_of_all_segmentations("▁" + word, ids, p)
            assert abs(got[k, lang] - want) < 1e-8 * abs(want)
            found = language.piece_uses([word], np.array([lang]), np.array([3.0]), vocabulary, pieces)
            assert np.isfinite(found).all() and not found[1 - lang].any()
            assert all(abs(found[lang, x] - 3 * n) < 1e-8 for x, n in uses.items())
            assert abs(found[lang].sum() - 3 * sum(uses.values())) < 1e-6


def test_unseen_letters_leave_a_score(spark):
    """A long run of unseen letters does not make the other words of a text void."""
    pieces = np.full((2, language.Vocabulary.load(PIECES).size), 1e-11)
    pieces[0] *= 2
    model = language.Model(["aa", "bb"], np.log([0.5, 0.5]), pieces, PIECES)
    docs = spark.createDataFrame([(1, "ꙮ" * 60)], "doc_id bigint, text string")
    row = language.predict(docs, model).first()
    assert (row.lang_pred, row.lang_score) == ("aa", 1.0)
    pieces[:] = 1e-11
    row = language.predict(docs, model).first()
    assert (row.lang_pred, row.lang_score) == ("aa", 0.5)


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 400")
    held = F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit(language.training_rows(docs, held), PIECES)
    out = language.predict(docs, model).filter(held).select("lang", "lang_pred", "lang_score").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.lang_score <= 1 for r in out)


def test_odd_texts_get_a_language_or_und(odd_docs, no_docs):
    model = language.fit(odd_docs.select("lang", "text"), PIECES)
    assert model.languages == ["en", "fr"]
    out = language.predict(odd_docs.withColumn("lang_pred", F.lit("old")), model)
    assert out.columns == [*odd_docs.columns, "lang_pred", "lang_score"]
    for r in out.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("en", "fr")) == letters and (letters or r.lang_score == 0.0)
    empty = language.fit(no_docs.select("lang", "text"), PIECES)
    assert {r.lang_pred for r in language.predict(odd_docs, empty).collect()} == {"und"}
    assert language.predict(no_docs, model).count() == 0


# -- mixing ----------------------------------------------------------------------------


def brute_topic(text):
    votes = Counter()
    for w in words(text):
        for name, letters in mixing.TOPICS.items():
            votes[name] += w[0] in letters
    best = max(votes.values(), default=0)
    return next((n for n in mixing.TOPICS if votes[n] == best), "") if best else "none"


def test_marginals_reach_their_targets(odd_docs):
    out = mixing.mix(odd_docs, rounds=40, fraction=0.3).collect()
    assert len(out) == len(documents())
    for r in out:
        assert r._topic == brute_topic(r.text) and r._tokens == len(words(r.text))
    total = sum(r._tokens for r in out)
    for name, power in mixing.TARGETS.items():
        have, want = Counter(), Counter()
        for r in out:
            have[r[f"_{name}"]] += r._tokens * r.weight
            want[r[f"_{name}"]] += r._tokens
        shares = {k: (v / total) ** power if v else 0.0 for k, v in want.items()}
        for k, share in shares.items():
            assert have[k] / total == pytest.approx(share / sum(shares.values()), abs=0.02)
    expected = sum(r._tokens * r.probability for r in out)
    assert expected == pytest.approx(0.3 * total, rel=0.01)
    assert all(r.kept is not None and 0 <= r.probability <= 1 for r in out)


def test_nothing_to_mix(no_docs):
    assert mixing.mix(no_docs).count() == 0
