"""Importance resampling against a plain computation, and quickselect by itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tablescope.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, key string, row int, rank string, score int, n_features int"


def features(text, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) for g in grams]


def brute(docs, target, longest, buckets, num, den, min_words):
    s, t = Counter(), Counter()
    held = []
    for doc_id, text in docs:
        n, f = features(text, longest)
        f = [x % buckets for x in f]
        s.update(f)
        held.append((doc_id, n, f))
    for text in target:
        t.update(x % buckets for x in features(text, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, n, f in held:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = len(able) * num // den
    out = [(r[0], r[2], r[3], r[4], i + 1 if i < drawn else None) for i, r in enumerate(able)]
    return sorted(out + [(r[0], r[2], r[3], r[4], None) for r in rows if r[1] < min_words], key=str)


def test_draw_equals_the_plain_computation(spark):
    rng = random.Random(2)
    vocab = ["alpha", "Beta", "ΓΔ", "x1", "éß", "zeta9", "İ", "o"]
    docs = [(i, rng.choice([" ", "-", "_\t"]).join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(150)]
    docs += [docs[3], docs[3], docs[3], (None, "alpha " * 30), (None, "alpha " * 30), (200, None), (201, ""), (202, "long " * 50_000), (203, "!?")]
    target = ["alpha beta beta", None, "", "x1 x1 ΓΔ"]
    frame = spark.createDataFrame([(*d, "k", 1, "r", 2, 3) for d in docs], SCHEMA).repartition(5)
    aims = spark.createDataFrame([(x,) for x in target], "text string")
    for longest, num, den, least in ((1, 10, 100, 20), (3, 1, 1, 1), (2, 0, 1, 5), (1, 77, 100, 0)):
        got = resample.importance_resample(frame, aims, longest=longest, buckets=97, num=num, den=den, min_words=least)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, longest, 97, num, den, least)


def test_third_of_rows_are_one_document(spark):
    docs = [(5, "same words here " * 10)] * 100 + [(i, f"w{i % 7} " * 25) for i in range(10, 210)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = resample.importance_resample(frame, frame.limit(0), num=60)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, [], 1, 10_000, 60, 100, 20)


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert resample.importance_resample(nothing, nothing).collect() == []


def test_quickselect_finds_every_rank(spark):
    keys = [f"{(i * 7919) % 1000:04d}" for i in range(300)]
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    for k in (1, 2, 17, 150, 299, 300):
        assert resample.kth_key(frame, "key", k, pivots=7) == sorted(keys)[k - 1]
    assert resample.kth_key(frame, "key", 0) is None and resample.kth_key(frame, "key", 301) is None
    signed = spark.createDataFrame([(v,) for v in (-(1 << 63), -5, -1, 0, 3, (1 << 63) - 1)], "v long")
    assert [r.v for r in signed.orderBy(resample.sortable(F.col("v"))).collect()] == sorted(r.v for r in signed.collect())
