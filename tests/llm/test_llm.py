"""The training-data operators: edge cases, brute force, SQL oracles."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle_check import TABLES, _digest
from tablescope.session import ensure_checkpoint_dir
from tablescope.llm import decontam, guesscost, jaccard, linededup, mix, postings, pst, quality, queries, repair, urltrie

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, part int, region int, start int, label int"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(25)]
    out = []
    for b in base:
        words = b.split()
        out.append(b)
        for _ in range(rng.randint(0, 5)):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
    return out + ["", None, " \t\n", "one", "one", "one two", "x" * 5000, "long " * 3000, "é À ß ☃ a\u00a0b"]


@pytest.fixture(scope="module")
def odd(spark, texts):
    """Null ids, texts and sources, empty and long texts, repeated rows, clashing columns."""
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", 0, 1, "x", 1, 1, 1, 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here at all", "en", "s1", 0, 1, "x", 1, 1, 1, 1), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_oracles(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    rel = con.execute(queries.ORACLE_SQL[name])
    assert _digest(got.columns, [tuple(r) for r in got.collect()])[0] == _digest(
        [d[0] for d in rel.description], rel.fetchall())[0]


# -- token shards

def whole_ids(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.tokenizer_file())
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, n) for n in (0, 1, 700, 3, 0, 2000)] + [np.full(900, 7), np.tile([1, 2, 3], 400)]
    docs = [np.append(d, 1) for d in docs]
    n = np.array([len(d) for d in docs])
    shard = repair.Shard(repair.compress(np.concatenate(docs), n, 49408))
    assert len(shard.rules) and len(shard.symbols) < 2800  # the 2,704 random ids stay
    assert (shard.all_ids() == np.concatenate(docs)).all()
    for i, d in enumerate(docs):
        assert (shard.document(i) == d).all()
        for a, b in ((0, 1), (len(d) // 3, len(d) // 2 + 1), (0, len(d))):
            assert (shard.tokens(i, a, b) == d[a:b]).all()
    assert all(shard.rule_length[i] == shard.length[a] + shard.length[b] for i, (a, b) in enumerate(shard.rules))


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    passages = [(rng.integers(0, 40000, 5000), 12), (rng.integers(0, 40000, 900), 3)]
    docs = [np.concatenate([p, [40000 + i]]) for p, times in passages for i in range(times)]
    docs.append(np.tile([5, 6, 7, 8], 5000))
    n = np.array([len(d) for d in docs])
    payload = repair.compress(np.concatenate(docs), n, 49408)
    shard = repair.Shard(payload)
    assert (shard.all_ids() == np.concatenate(docs)).all()
    assert np.diff(np.concatenate([[0], shard.symbol_ends])).max() <= 8 and shard.rule_length.max() >= 4096
    ends = set((shard.symbol_ends - 1).tolist())
    pairs = Counter(tuple(shard.symbols[i:i + 2].tolist()) for i in range(len(shard.symbols) - 1) if i not in ends)
    assert max(pairs.values(), default=0) < 3


def test_token_documents_match_the_tokenizer(spark, odd):
    got = repair.read_token_documents(repair.write_token_shards(odd, queries.tokenizer_file(), shard_tokens=500)).collect()
    want = sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32(np.array(whole_ids(r.text), "<u4").tobytes()),
                   len(whole_ids(r.text))) for r in odd.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


def test_pieces_are_learnt_once_and_encoded_like_the_library():
    encoder = repair.WordEncoder(queries.tokenizer_file())
    encoder.encode(["Foo foo. FOO, (foo) foo.Bar"])
    assert set(encoder.index) == {b"foo", b".", b",", b"(foo)", b".bar"}
    odd = ["<|endoftext|> Foo. bar|x <|STARTOFTEXT|> <| A. B, end|>", "H\u0331. T\u0308, \u00e9. \u00c9! \u00d7. a\u00d7. \u00f7, \ufb01. \u0130. a.b,c|d",
           "don't, it's. I'LL we've.'s x.'s o'S", "\u03a3\u03b1\u03c2. \u03a3\u0391\u03a3, \u6771. a\u0301. b.\u0301 c,\u0338 \u00e9,", "", " ", "4.0. %a %b# $x a$ b& c*"]
    ids, counts = encoder.encode(odd)
    want = [e.ids for e in encoder.tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_repair_counts_rare_pairs_only_once(monkeypatch):
    """Positions of rare pairs are not sorted again, and the grammar is that of counting all pairs each round."""
    rng = np.random.default_rng(4)
    n_tokens = np.full(40, 250)
    ids = (rng.zipf(1.3, 10_000) % 900).astype(np.uint16)
    sorted_pairs = []
    real = np.sort
    monkeypatch.setattr(repair.np, "sort", lambda x: (sorted_pairs.append(len(x)), real(x))[1])
    payload = repair.compress(ids, n_tokens, 1000)
    monkeypatch.undo()
    shard = repair.Shard(payload)
    assert (shard.all_ids() == ids).all()
    assert sorted_pairs[1] < 0.7 * sorted_pairs[0]
    ends = set((shard.symbol_ends - 1).tolist())
    left = Counter((int(a), int(b)) for i, (a, b) in enumerate(zip(shard.symbols[:-1], shard.symbols[1:])) if i not in ends)
    assert max(left.values()) < 3


def test_special_token_text_is_encoded_like_the_library(spark):
    text = "a <|endoftext|>b it's 12 don't\u2003x <|start oftext|> e\u0301 \u0301x Σας"
    encoder = repair.WordEncoder(queries.tokenizer_file())
    ids, n = encoder.encode([text, "", "again"])
    assert [*ids[:n[0]].tolist(), 1] == whole_ids(text) and n[1] == 0


# -- secrets

def brute_spans(text):
    out = [("assign", *m.span()) for m in re.finditer(
        r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return guesscost.joined(out)


def test_secrets_base_and_guesses(spark, odd):
    extra = ["PassWord = 'hunter2x' token:abc token: token: abcdefg", "AKIA" + "A1" * 8 + " AKIAB", "ff" * 12 + "g" + "0" * 23,
             "é api_key=Zx81kQpLw0Tr☃ pwd => q7!Rt$9zLp2", "passw\u017frd: abcdefgh", "key: no", "password: passwordpassword"]
    docs = odd.select("doc_id", "text", "start").unionAll(spark.createDataFrame([(900 + i, t, 1) for i, t in enumerate(extra)], "doc_id long, text string, start int"))
    ranks = guesscost.ranked_words(queries.tokenizer_file())
    rows = guesscost.find_secrets(docs, queries.tokenizer_file()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        base = brute_spans(r.text or "")
        assert r.secrets.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.secrets.spans.split(","))
    by_id = {r.doc_id: r.secrets for r in rows}
    assert by_id[903].n_guess == 2 and "guess" in by_id[903].spans and by_id[906].n_guess == 0
    assert guesscost.find_secrets(odd.limit(0), queries.tokenizer_file()).count() == 0
    cost = lambda v: guesscost.guess_cost(v, ranks)[0]
    assert cost("") == 0 and cost("password") < 6 < cost("k8#Qz!w2")
    assert cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 5 and cost("1999-12-31") < 6
    assert cost("a" * 20000) < 8


def test_a_letter_with_a_longer_lower_case_keeps_positions(spark):
    ranks = guesscost.ranked_words(queries.tokenizer_file())
    for v in ("\u0130stanbul1234", "\u0130\u0130qwerty", "x\u0130password"):
        cost, cuts = guesscost.guess_cost(v, ranks)
        assert cuts[0][1] == 0 and cuts[-1][2] == len(v) and all(a[2] == b[1] for a, b in zip(cuts, cuts[1:]))
    assert guesscost.guess_cost("x\u0130password", ranks)[1][-1] == ("word", 2, 10)
    docs = spark.createDataFrame([(1, "password: \u0130stanbul1234")], "doc_id long, text string")
    assert guesscost.find_secrets(docs, queries.tokenizer_file()).count() == 1


KEY_GRID = {k: (r, c) for r, keys in enumerate(["`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]) for c, k in enumerate(keys)}


def segment_costs(part, ranks):
    """All the ways in which one piece of a value may be guessed at one go."""
    size = lambda ch: 100 if ord(ch) > 127 else 10 if ch.isdigit() else 26 if ch.isalpha() else 33
    low, n = part.lower(), len(part)
    out = [] if n > 1 else [("brute", math.log10(size(part)))]
    swapped = "".join({"@": "a", "4": "a", "3": "e", "1": "i", "0": "o", "5": "s", "$": "s", "7": "t"}.get(c, c) for c in low)
    word = low if low in ranks else swapped if swapped in ranks else None
    if n >= 3 and word:
        caps, cost = sum(c.isupper() for c in part), math.log10(ranks[word])
        cost += math.log10(2) * sum(a != b for a, b in zip(low, word))
        if caps:
            cost += math.log10(2) if caps == n or (caps == 1 and part[0].isupper()) else math.log10(math.comb(n, caps) + 1)
        out.append(("word", cost))
    if re.fullmatch(r"(19|20)\d\d", part, re.A):
        out.append(("date", math.log10(119)))
    m = re.fullmatch(r"(19|20)\d\d(?P<s>[-/._]?)(\d\d)(?P=s)(\d\d)", part, re.A) or re.fullmatch(r"(\d\d)(?P<s>[-/._]?)(\d\d)(?P=s)(19|20)\d\d", part, re.A)
    if m:
        day, month = (int(m[4]), int(m[3])) if part[:2] in ("19", "20") and m.re.pattern.startswith("(19") else (int(m[1]), int(m[3]))
        if 1 <= day <= 31 and 1 <= month <= 12:
            out.append(("date", math.log10(119 * 365)))
    for period in range(1, 5):
        if n >= max(3, 2 * period) and all(part[i] == part[i + period] for i in range(n - period)):
            out.append(("repeat", sum(math.log10(size(c)) for c in part[:period]) + math.log10(n / period)))
    if n >= 4 and all(c in KEY_GRID for c in low):
        steps = [(KEY_GRID[b][0] - KEY_GRID[a][0], KEY_GRID[b][1] - KEY_GRID[a][1]) for a, b in zip(low, low[1:])]
        if all(s != (0, 0) and max(abs(s[0]), abs(s[1])) <= 1 for s in steps):
            out.append(("walk", math.log10(47 * n) + math.log10(4) * sum(a != b for a, b in zip(steps, steps[1:]))))
    return out


def test_guess_cost_against_every_segmentation():
    rng = random.Random(12)
    ranks = {"pass": 3, "word": 9, "password": 1, "sun": 20, "east": 31, "qwe": 200, "seas": 44}
    pieces = ["pass", "p4ss", "WORD", "Sun", "e4st", "qwerty", "asdf", "zxcv", "poiu", "1qaz", "aaaa", "abab", "1999", "19991231", "x", "9", "$", "é", "reds"]
    for _ in range(150):
        value = "".join(rng.choices(pieces, k=rng.randint(1, 3)))[:11]
        best = math.inf
        for cuts in range(1 << (len(value) - 1)):
            ends = [i + 1 for i in range(len(value) - 1) if cuts >> i & 1] + [len(value)]
            spans = list(zip([0, *ends[:-1]], ends))
            options = [segment_costs(value[a:b], ranks) for a, b in spans]
            if not all(options):
                continue
            # A row of brute-forced characters is one segment.
            states = {"": 0.0}
            for ways in options:
                new = {}
                for kind, cost in ways:
                    total = min(c + cost + (0 if kind == last == "brute" else math.log10(2)) for last, c in states.items())
                    new[kind] = min(new.get(kind, math.inf), total)
                states = new
            best = min(best, *states.values())
        cost, spans = guesscost.guess_cost(value, ranks)
        assert abs(cost - best) < 1e-9, (value, cost, best, spans)
        assert "".join(value[a:b] for _, a, b in spans) == value
    assert guesscost.guess_cost("qwertyuiopasdfgh", ranks)[0] < 9 and guesscost.guess_cost("qwertyuiop[]", ranks)[0] < 5
    assert guesscost.guess_cost("a" * 300 + "east", ranks)[1][0] in (("repeat", 0, 300), ("repeat", 0, 301))


def test_guess_cost_is_the_least_over_all_cuts():
    ranks = {"pass": 3, "word": 9, "password": 1, "dog": 40}
    rng = random.Random(3)
    for _ in range(60):
        v = "".join(rng.choices(["pass", "word", "dog", "x", "7", "1999", "aaa", "qwer"], k=rng.randint(1, 4)))
        cost, cuts = guesscost.guess_cost(v, ranks)
        assert cuts[0][1] == 0 and cuts[-1][2] == len(v) and all(a[2] == b[1] for a, b in zip(cuts, cuts[1:]))
        for i in range(1, len(v)):  # no cut in two is cheaper than the whole
            assert cost <= guesscost.guess_cost(v[:i], ranks)[0] + guesscost.guess_cost(v[i:], ranks)[0] + 2 * math.log10(2) + 1e-9


# -- Jaccard join

def brute_components(rows, k, num, den):
    sets, parent = [], {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
        parent[i] = i

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            both = len(a & b)
            if a and b and den * both >= num * (len(a) + len(b) - both):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100), (1, 75, 100)])
def test_jaccard_components_match_brute_force(spark, odd, k, num, den):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    got = jaccard.jaccard_components(odd, k, num, den).collect()
    assert sorted(tuple(r) for r in got if r.id is not None) == brute_components(rows, k, num, den)
    assert [r.component for r in got if r.id is None] == [None, None]


def test_jaccard_recursion_in_a_crowded_family(spark):
    """Many sets that agree on a class without being linked, and chains of linked ones."""
    rng = random.Random(2)
    core = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        w = list(core)
        for j in rng.sample(range(40), rng.randint(0, 9)):
            w[j] = f"v{rng.randint(0, 30)}"
        rows.append((i, " ".join(w)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85, 100).collect()
    assert sorted(tuple(r) for r in got) == brute_components(rows, 1, 85, 100)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for num, den in ((85, 100), (80, 100), (75, 100)):
        classes, linked = jaccard.Classes(num, den), 0
        for _ in range(600):
            n = int(rng.integers(1, 90))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            most = (den - num) * n // den
            drop, add = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if den * both < num * (len(a) + len(b) - both):
                continue
            linked += 1
            kept = []
            order = {}  # any order of the signatures that both sets follow
            for s in (a, b):
                signs, cuts = classes.signatures(s)
                for x in signs.tolist():
                    order.setdefault(x, rng.random())
                stay = dict(zip(cuts[::3], cuts[2::3]))
                by = defaultdict(list)
                for x in signs.tolist():
                    by[x & 1023].append(x)
                assert {t: len(x) for t, x in by.items()} == dict(zip(cuts[::3], cuts[1::3]))
                kept.append({x for t, xs in by.items() for x in sorted(xs, key=order.get)[:stay[t]]})
            assert kept[0] & kept[1]
        assert linked > 200


def test_jaccard_regions_larger_than_their_pivots(spark):
    """Voronoi cells and regions whose pivots are all sets outside the largest component, in few jobs."""
    rng = random.Random(8)
    core = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        w = list(core)
        for j in rng.sample(range(40), rng.choice((1, 2, 8, 9))):
            w[j] = f"v{rng.randint(0, 40)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 1, 85, 100)
    assert 1 < len({c for _, _, c in want}) < 150
    for small, centres in ((2, 1), (2, 3), (32, 2)):
        got = jaccard.jaccard_components(docs, 1, 85, 100, small_region=small, centres=centres).collect()
        assert sorted(tuple(r) for r in got) == want


def test_distinct_rows_of_shared_regions():
    """Copies of a row are one, in and across batches; a region of one id goes."""
    rows = [(1, 5), (1, 5), (2, 3), (2, 3), (2, 4), (3, 1), (4, 1), (4, 1), (4, 2), (4, 2), (4, 9)]
    for size in (1, 2, 3, 20):
        batches = [pa.RecordBatch.from_pylist([{"region": r, "id": i} for r, i in rows[low:low + size]]) for low in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in jaccard._crowded(iter(batches)) for r in b.to_pylist()]
        assert got == [(2, 3), (2, 4), (4, 1), (4, 2), (4, 9)]


def test_jaccard_empty(nothing):
    assert jaccard.jaccard_components(nothing).count() == 0


# -- suffix tree

def test_scores(spark, odd):
    rows = pst.score_texts(odd, F.col("doc_id") % 5 == 1, chunk_words=200).collect()
    docs = odd.collect()
    assert len(rows) == len(docs)
    train, ends = Counter(), 0
    for r in docs:
        if r.doc_id is not None and r.doc_id % 5 != 1:
            train.update((r.text or "").encode().lower().split())
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + 1
    want = sorted((-1 if r.doc_id is None else r.doc_id, len(w) + 1, sum(x in train for x in w) + 1,
                   round(sum(math.log10((c + .5) / (n + .5 * (v + 1))) for c in [*(train[x] for x in w), ends]), 6))
                  for r in docs for w in [(r.text or "").encode().lower().split()])
    assert sorted((-1 if r.id is None else r.id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n} and all(r.score < 0 for r in rows)
    one = lambda rs: {(r.id, r.n_tokens): r.score for r in rs}
    again = one(pst.score_texts(odd.repartition(3), F.col("doc_id") % 5 == 1).collect())
    assert all(abs(s - again[k]) < 1e-6 for k, s in one(rows).items())


def plain_tree(streams, n_symbols, min_count, min_divergence, weight, depth=3):
    """log10 probability of symbol ``s[i]`` under the longest suffix that is a state, all in one dictionary."""
    counts = defaultdict(Counter)
    for s in streams:
        for i in range(1, len(s)):
            for d in range(min(i, depth) + 1):
                counts[tuple(s[i - d:i])][s[i]] += 1
    total = sum(counts[()].values())
    tree = {(): [(counts[()][x] + 0.5) / (total + 0.5 * n_symbols) for x in range(n_symbols)]}
    suffix = lambda c: next(tree[c[j:]] for j in range(len(c) + 1) if c[j:] in tree)
    for context in sorted(counts, key=len):
        t, q = sum(counts[context].values()), suffix(context)
        if context and t >= min_count and sum(c / t * math.log(c / t / q[x]) for x, c in counts[context].items()) >= min_divergence:
            tree[context] = [(counts[context][x] + weight * q[x]) / (t + weight) for x in range(n_symbols)]
    return lambda s, i: math.log10(suffix(tuple(s[max(0, i - depth):i]))[s[i]])


@pytest.mark.parametrize("bucket_grams", [7, 1 << 20])
def test_a_sequence_of_third_order_scores_as_under_a_plain_tree(spark, bucket_grams):
    rng = np.random.default_rng(4)
    streams = []
    for _ in range(40):
        seq = rng.integers(2, 6, 99)
        seq[2::3] = (seq[0::3] + seq[1::3]) % 4 + 2
        streams.append([0, *seq.tolist(), 0])
    docs = spark.createDataFrame([(i, " ".join("abcd"[x - 2] for x in s[1:-1])) for i, s in enumerate(streams)], "doc_id long, text string")
    symbol = {w: i for i, w in enumerate("abcd", 2)}
    assert all([symbol[w] for w in t.split()] == streams[i][1:-1] for i, t in docs.collect())
    logs = plain_tree(streams, 6, 5, 0.05, 2.0)
    got = pst.score_texts(docs, F.lit(False), chunk_words=500, min_count=5, min_divergence=0.05, weight=2.0, bucket_grams=bucket_grams)
    for r in got.collect():
        s = streams[r.id]
        assert abs(r.score - sum(logs(s, i) for i in range(1, len(s)))) < 1e-6
        assert r.score / (len(s) - 1) > -0.6


def test_words_and_contexts_seen_often_enough_are_kept_in_any_share(spark):
    rng = random.Random(2)
    common = [" ".join(rng.choices("abcdefghij", k=100)) for _ in range(1400)]
    texts = [t + " zig zag" if i < 55 else t + " zog" if i < 110 else t for i, t in enumerate(common)]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(2001, "a zig zag", True), (2002, "a zig zog", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    score = {r.id: r.score for r in pst.score_texts(docs, F.col("held")).where("held_out").collect()}
    assert score[2001] > score[2002] + 1


def test_scoring_leaves_only_the_tables_that_the_result_reads(spark):
    docs = spark.createDataFrame([(i, "a b c d e " * 40) for i in range(30)], "doc_id long, text string")
    folder = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "tablescope-scratch")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    scored = pst.score_texts(docs, F.col("doc_id") % 5 == 1, chunk_words=500, bucket_grams=1000)
    left = Counter(name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before)
    assert left == {"ready": 1, "level": 3}
    assert scored.count() == 30


def test_scores_match_a_tree_built_at_once(spark):
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(9)] + ["r%d" % i for i in range(60)]
    texts = [" ".join(rng.choices(vocab, [60 - 5 * i for i in range(9)] + [1] * 60, k=rng.randint(0, 40))) for _ in range(90)]
    texts += ["w1 w2 w3 w4 w5"] * 12
    rows = [(i, t, i % 4 == 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    got = {r.id: r.score for r in pst.score_texts(docs, F.col("held"), chunk_words=200, min_count=6).collect()}
    words = Counter(w for _, t, held in rows if not held for w in t.split())
    symbol = {w: i for i, w in enumerate((w for w in sorted(words) if words[w] >= 6), 2)}
    rare, unseen = sum(c for w, c in words.items() if w not in symbol), max(1, sum(c == 1 for c in words.values()))
    stream = lambda t: [0] + [symbol.get(w, 1) for w in t.split()] + [0]
    logs = plain_tree([stream(t) for _, t, held in rows if not held], len(symbol) + 2, 6, 0.01, 8.0)
    for i, t, _ in rows:
        s = stream(t)
        want = sum(logs(s, j) for j in range(1, len(s)))
        want += sum(math.log10(max(words[w], 0 if words[w] else unseen) / (rare + unseen)) for w in t.split() if w not in symbol)
        assert abs(got[i] - want) < 1e-6


def test_scores_beat_the_base_on_held_out_texts(spark):
    got = queries.op4_suffix_tree(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_scores_empty(spark, nothing, odd):
    assert pst.score_texts(nothing, F.lit(False)).count() == 0
    alone = pst.score_texts(odd, F.lit(True)).collect()
    assert {r.train_tokens for r in alone} == {0} and all(abs(r.base_score) < 1e-9 for r in alone)


# -- nearest neighbours

def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (600, 16)) * rng.uniform(0.5, 2, (600, 1))
    x[50:250] = x[50]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(None, [1.0] * 16, 1), (700, None, 1), (720, [0.0] * 16, 1), (740, [float("nan")] * 16, 1), (760, [], 1),
             (780, [1.0, None] * 8, 1), (800, [2.0, 1.0], 1), rows[20]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids int")
    got = postings.nearest_neighbours(df, F.col("vec_id") % 20 == 0, list_rows=20, block_rows=8).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(600), -np.round(s, 9))) if i != q][:20]
        assert len(by[q]) == 20 and q not in dict(by[q])
        assert all(abs(score - s[i]) < 1e-9 for i, score in by[q])
        hits += len(set(order) & set(dict(by[q])))
        total += 20
        if 50 <= q < 250:
            assert [i for i, _ in by[q]] == order or s[order[0]] > s[50] + 1e-9
    assert set(by) == set(range(0, 600, 20)) and hits / total >= 0.9


def test_few_vectors_come_back_whole(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(7)], "vec_id long, embedding array<double>")
    assert postings.nearest_neighbours(df, F.col("vec_id") == 0).count() == 6
    assert postings.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [120, 500, 2000, 10_000])
def test_recall_at_every_size(spark, n):
    """The query's own parameters on vectors without any clusters, the hardest kind."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = defaultdict(set)
    for r in postings.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].add(r.vec_id)
    asked = range(0, n, 20)
    assert all(len(found[q]) == 20 and q not in found[q] for q in asked)
    best = {q: set([i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20]) for q in asked}
    assert sum(len(best[q] & found[q]) for q in asked) >= 0.9 * 20 * len(asked)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_the_given_vectors(spark, sf):
    df = table(spark, "embeddings", f"/root/testdata/{sf}")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = defaultdict(set)
    for r in queries.op5_posting_lists(spark, f"/root/testdata/{sf}").collect():
        found[r.query_id].add(r.vec_id)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        best = [j for j in np.lexsort((ids, -np.cumsum(x * x[i], axis=1)[:, -1])) if j != i][:20]
        hits, total = hits + len({ids[j] for j in best} & found[ids[i]]), total + len(best)
    assert hits >= 0.9 * total


# -- URL rules

def test_urls_match_brute_force(spark):
    rng = random.Random(8)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "xa.com", "net", "A.Com", "", "a.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/english/", "/en/x/y?q#z", "//", "?a/b"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "a.com/en/", "x://y://a.com/en/", "s\n://a.com/en/\nq"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in ("com", "a.com", "b.a.com", "net") for p in ("/", "/en", "/en/", "/en/x") if rng.random() < 0.7]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    given = spark.createDataFrame([*rules, rules[0], (None, "/", "allow")], "host string, path string, verdict string")
    for per in (200_000, 3):
        for r in urltrie.judge_urls(df, given, default="none", rules_per_trie=per).collect():
            m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
            host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
            fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
            assert (r.host, r.path) == (host, path)
            assert (r.verdict, r.rule) == (max(fits)[1:] if fits else ("none", None)), r
    assert urltrie.judge_urls(df.limit(0), given).count() == 0
    assert {r.verdict for r in urltrie.judge_urls(df, given.limit(0)).collect()} == {"allow"}


# -- mixing

def test_mix(spark, odd, nothing):
    got = mix.mix_sources(odd, mix.word_count(F.col("text")))
    rows = got.collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix.mix_sources(odd.repartition(7), mix.word_count(F.col("text"))).collect()), key=str)
    assert len(rows) == odd.count()
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        per[r.source][0] += r.size
        per[r.source][1] += r.taken
        per[r.source][2] = r.target
        assert r.source_size >= r.size
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weights = dict(zip(names, [5, 2, 1] * len(names)))
    total, target = 1.5 * sum(p[0] for p in per.values()), {}
    free = list(names)
    while True:  # cap and reshare until none is above
        rest = total - sum(target.values())
        share = {s: rest * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * per[s][0]]
        if not over:
            target |= share
            break
        target |= {s: 2.0 * per[s][0] for s in over}
        free = [s for s in free if s not in over]
        if not free:
            break
    for s, (size, taken, t) in per.items():
        assert abs(t - target[s]) < 1e-6 and taken == math.floor(t + 1e-9)
    assert mix.mix_sources(nothing, mix.word_count(F.col("text"))).count() == 0


# -- quality

def test_quality(spark, odd, nothing):
    got = queries.op8_fourier_quality(spark, "/root/testdata/sf0.01")
    labels = table(spark, "labels", "/root/testdata/sf0.01").select("doc_id", "quality")
    held = got.where("held_out").join(labels, "doc_id")
    right, n = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 50 and right > 0.95
    fit = lambda docs: quality.fit_quality(quality.with_statistics(docs), "y")
    model = fit(odd.withColumn("y", (F.col("doc_id") % 2).cast("int")))
    scored = quality.score_quality(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    for bad in (nothing.withColumn("y", F.lit(1)), odd.withColumn("y", F.lit(1)), odd.withColumn("y", F.lit(None))):
        blank = fit(bad)
        assert quality.score_quality(nothing, blank).count() == 0
        assert len({round(r.score, 2) for r in quality.score_quality(odd, blank).collect()}) == 1


def pooled(y):
    """Non-decreasing least-squares fit by pooling adjacent violators."""
    blocks = []
    for v in y:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (a, m), (b, n) = blocks[-2:]
            blocks[-2:] = [[(a * m + b * n) / (m + n), m + n]]
    return np.array([v for v, n in blocks for _ in range(n)])


def test_quality_model_equals_plain_least_squares(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01").select("doc_id", "text")
    rows = (docs.join(table(spark, "labels", "/root/testdata/sf0.01"), "doc_id").where(F.col("quality").isNotNull())
            .select("doc_id", "text", "quality", (F.pmod(F.xxhash64(F.xxhash64("doc_id", F.lit(7))), F.lit(3)) == 0).alias("steps")))
    frame = rows.toPandas()
    model = quality.fit_quality(quality.with_statistics(rows, "text"), "quality")
    x, y, steps = np.array([quality.statistics(t) for t in frame["text"]]), frame["quality"].to_numpy(float), frame["steps"].to_numpy()
    scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    z = np.clip((x - x.mean(axis=0)) / scale, -6, 6)
    rng = np.random.default_rng(7)
    omega, phase = rng.normal(0, 1 / 6, (x.shape[1], 256)), rng.uniform(0, 2 * math.pi, 256)
    a = np.hstack([np.sqrt(2 / 256) * np.cos(z @ omega + phase), z, np.ones((len(z), 1))])
    # Ridge as least squares over added rows, not by normal equations.
    penalty = np.sqrt(1e-3 * (~steps).sum() * np.array([1.0] * 256 + [0.01] * x.shape[1] + [1e-9]))
    w = np.linalg.lstsq(np.vstack([a[~steps], np.diag(penalty)]), np.r_[y[~steps], np.zeros(len(penalty))], rcond=None)[0]
    raw = a @ w
    assert np.abs(model.raw(x) - raw).max() < 1e-5
    order = np.argsort(raw[steps])
    level = np.interp(raw, raw[steps][order], pooled(y[steps][order]))
    want = np.clip(0.998 * level + 0.002 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)
    clash = rows.withColumns({"_stats": F.lit(3), "score": F.lit("x")})
    got = quality.score_quality(clash, model).toPandas().set_index("doc_id").loc[frame["doc_id"]]
    assert (got["_stats"] == 3).all() and np.mean(np.abs(got["score"].to_numpy() - want) < 1e-3) > 0.995


# -- lines

def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda l: re.sub("[A-Z]", lambda x: x[0].lower(), l.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    lost = lambda i, l: i is not None and len(holders[key(l)]) >= min_docs and i != max(holders[key(l)])
    return sorted(((i if i is not None else -1, [l for l in (t or "").split("\n") if not lost(i, l)]) for i, t in rows), key=str)


def test_lines(spark, odd, nothing):
    rng = random.Random(9)
    common = ["x" * 40, "A common LINE that is long enough to be counted ☃", "y" * 39, "  " + "z" * 41 + "\t"]
    rows = []
    for i in range(40):
        lines = [rng.choice(common + ["short", "", f"a line of its own that is long enough {i}"]) for _ in range(rng.randint(1, 150 if i % 10 == 0 else 6))]
        rows.append((None if i == 7 else i, "\n".join(lines).replace("common", rng.choice(["common", "COMMON"]))))
    rows += [rows[5], rows[5], (4, "\n".join(common)), (50, None), (51, ""), (52, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("keep", "id", "h1", "pos")})
    got = sorted(((r.id if r.id is not None else -1, list(r.kept)) for r in linededup.dedup_lines(df).collect()), key=str)
    assert got == brute_lines(rows)
    bits = linededup.line_keep_bitmaps(df).collect()
    assert bits and all(len(r.keep) and all(w != -1 for w in r.keep.values()) for r in bits)
    assert linededup.dedup_lines(nothing).count() == 0
    assert linededup.dedup_lines(odd).count() == odd.count()


# -- decontamination

def least_edits(passage, text):
    """Fewest edits of the passage to any span of the text (full dynamic programme)."""
    best = [0] * (len(text) + 1)
    for i, p in enumerate(passage, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(best[j - 1] + (p != t), best[j] + 1, row[j - 1] + 1))
        best = row
    return min(best)


def test_leaks_match_brute_force(spark, odd, nothing):
    rng = random.Random(12)
    letters = "abcdefghijklmnop  "
    items = [(i, "".join(rng.choices(letters, k=rng.randint(40, 90))).strip() + "xyzzy") for i in range(6)]
    items += [(6, None), (7, "short"), (8, items[0][1])]
    docs = []
    for d in range(40):
        text = "".join(rng.choices(letters, k=rng.randint(0, 200)))
        if d % 2:
            p = list(items[rng.randrange(6)][1])
            for _ in range(rng.randint(0, 11)):
                at = rng.randrange(len(p))
                p[at:at + 1] = rng.choice([[], ["z"], [p[at], "q"]])
            p = "".join(p)
            text = text[:50] + (p.upper() if d % 3 else p.replace(" ", "\n")) + text[50:]
        docs.append((d, text))
    df = spark.createDataFrame([*docs, (None, items[1][1]), (99, None)], "doc_id long, text string").withColumn("start", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaked_passages(df, bench).collect()
    flat = lambda t: re.sub("[A-Z]", lambda x: x[0].lower(), re.sub(r"[\t\n\x0b\x0c\r]", " ", t))
    want = {(d, i) for d, t in docs for i, p in items if p and len(p) >= 32
            and least_edits(flat(p), flat(t)) <= min(int(0.1 * len(p)), (len(p) - 8) // 8)}
    assert {(r.id, r.item_id) for r in got if r.id is not None} == want and len(want) > 8
    assert [r.item_id for r in got if r.id is None] == [1]
    texts = dict(docs)
    for r in got:
        if r.id is not None:
            assert r.edits == least_edits(flat(dict(items)[r.item_id]), flat(texts[r.id])[r.start:r.end])
    assert {tuple(r) for r in decontam.leaked_passages(df, bench, block_chars=150).collect()} == {tuple(r) for r in got}
    assert decontam.leaked_passages(nothing, bench).count() == 0
    assert decontam.leaked_passages(df, bench.limit(0)).count() == 0
    assert decontam.leaked_passages(odd, bench).count() == 0


def test_benchmark_items_may_have_null_ids(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs now",
             "how vexingly quick daft zebras jump at night"]
    big = (1 << 60) + 1
    bench = spark.createDataFrame(list(zip([None, big, None], texts)), "item_id long, text string")
    docs = spark.createDataFrame([(1, " - ".join(texts)), (2, texts[2])], "doc_id long, text string")
    got = decontam.leaked_passages(docs, bench).collect()
    assert sorted((r.id, r.item_id or 0, r.edits) for r in got) == [(1, 0, 0), (1, 0, 0), (1, big, 0), (2, 0, 0)]


# -- pipeline

def test_pipeline_stages(spark, odd, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, "documents", sf)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
        if name != "tokens":
            assert docs.columns == before.columns
    assert kept[0] > kept[1] > kept[2] and kept[3] == kept[4]
    good = table(spark, "labels", sf)
    first = spark.read.parquet(str(tmp_path / "quality")).join(good, "doc_id").agg(F.avg("quality")).first()[0]
    assert first > 0.99
    a, b = (spark.read.parquet(str(tmp_path / n)) for n in ("quality", "near_duplicates"))
    want = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in a.collect()], 5, 80, 100)}
    assert {r.doc_id for r in b.collect()} == want
    leaks = {r.id for r in decontam.leaked_passages(b, table(spark, "benchmark", sf)).collect()}
    c = spark.read.parquet(str(tmp_path / "decontaminate"))
    assert {r.doc_id for r in c.collect()} == want - leaks
    times = Counter(r.doc_id for r in spark.read.parquet(str(tmp_path / "mix")).collect())
    for r in mix.mix_sources(c, mix.word_count(F.col("text"))).collect():
        assert times[r.id] == (math.ceil(r.taken / r.size) if r.size else 1)


def test_pipeline_stages_take_odd_rows(spark, odd, nothing):
    odd = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (odd, nothing.select(odd.columns)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= 2 * docs.count()
            if name == "near_duplicates":
                assert out.where("doc_id is null").count() == docs.where("doc_id is null").count()


def test_pipeline_stages_by_rows_not_ids(spark):
    """Null and shared ids, and columns named like the stages' own."""
    passage = table(spark, "benchmark").where(F.length("text") > 100).first().text
    rng = random.Random(3)
    clean = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(3)]
    rows = [(None, f"x {passage} y"), (1, f"see {passage}"), (1, clean[0]), (2, clean[1]), (3, clean[1]), (2, clean[2]), (None, clean[2]), (2, clean[2]), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 7, 8, 9) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, _key int, _size int, _n int")
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    out = corpus_pipeline.decontaminate_stage(spark, docs, SF)
    assert out.columns == docs.columns and key(out) == sorted([r for r in rows if r[1] is None or passage not in r[1]], key=str)
    out = corpus_pipeline.near_duplicate_stage(spark, out, SF)
    assert out.columns == docs.columns and key(out) == sorted([(1, clean[0]), (2, clean[1]), (2, clean[2]), (4, None)], key=str)
    out = corpus_pipeline.mix_stage(spark, out, SF)
    assert out.columns == docs.columns and {r._size for r in out.collect()} == {8}


def test_lines_that_cross_ranges(spark):
    """A line of most documents and many rarer ones, over ranges that cut their keys."""
    hot, texts = "the same long line stands in nearly every one of these documents", {}
    for i in range(240):
        lines = [f"line number {j} is shared by the documents whose ids it divides evenly" for j in range(2, 60) if i % j == 0]
        twice = ["a line that stands twice in each of only four documents"] * 2 if i % 60 == 0 else []
        texts[i] = "\n".join(([hot] * (1 + i % 3) if i % 7 else []) + lines + twice + [f"own {i}"])
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    holders = {}
    for i, t in texts.items():
        for line in t.split("\n"):
            holders.setdefault(line, set()).add(i)
    want = {i: [x for x in t.split("\n") if len(x) < 40 or len(holders[x]) < 5 or max(holders[x]) == i] for i, t in texts.items()}
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        got = {r.id: list(r.kept) for r in linededup.dedup_lines(docs).collect()}
    finally:
        spark.conf.unset(setting)
    assert got == want
