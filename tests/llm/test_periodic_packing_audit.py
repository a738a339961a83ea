"""Periodic runs, packing and the filter audit against brute force, with nulls, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigilframe.llm import filter_audit, packing, periodic, queries

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path(queries.WORD_VOCABULARY)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = {"runs": "r", "collapsed": 1, "piece": "p", "sequence_id": 7, "digest": "d", "fails": 3, "part": "x", "bits": 0, "__vf": 1}


def clash(df):
    for c, v in CLASH.items():
        df = df.withColumn(c, F.lit(v))
    return df


# --- 11


def runs_by_loop(words, least=12):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, 2 * q) and not any(all(words[k] == words[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_by_lags(ids, least=12):
    """The same over arrays, for long texts: a stretch has a shorter period iff a divisor of the lag has it."""
    out, n = [], len(ids)
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + q).tolist()):
            if e - s >= max(least, 2 * q) and not any(q % d == 0 and (ids[s : e - d] == ids[s + d : e]).all() for d in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def word_lists(draw):
    n, letters = draw(st.integers(0, 110)), draw(st.sampled_from([1, 2, 3, 40]))
    words = draw(st.lists(st.integers(0, letters - 1), min_size=n, max_size=n))
    for _ in range(draw(st.integers(0, 3)) if n > 3 else 0):
        a = draw(st.integers(0, n - 1))
        p, end, base = draw(st.integers(1, max(1, (n - a) // 2))), draw(st.integers(a, n)), list(words)
        for i in range(a, end):
            words[i] = base[a + (i - a) % p]
    return words


@settings(max_examples=400, deadline=None)
@given(word_lists(), st.sampled_from([20, 100, 1 << 17]), st.sampled_from([2, 5, 12, 30]))
def test_runs_against_a_loop(words, windows, least):
    before, periodic.WINDOWS = periodic.WINDOWS, windows
    try:
        found = periodic.find_runs(periodic.word_ids([b"%d" % w for w in words]), least)
    finally:
        periodic.WINDOWS = before
    assert found == runs_by_loop(words, least)


def test_long_texts_of_one_word_and_of_one_line():
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    line = np.random.default_rng(1).permutation(700)
    assert periodic.find_runs(np.tile(line, 300)[:-13]) == [(0, 300 * 700 - 13, 700)]
    noise = np.random.default_rng(2).integers(0, 3, 2500)
    assert periodic.find_runs(noise) == runs_by_lags(noise)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected_periods(doc_id, text):
    words = planted(doc_id, text)
    index = {}
    runs = runs_by_lags(np.array([index.setdefault(w, len(index)) for w in words], np.int64)) if words else []
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (
        len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
        hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


def test_periodic_query_on_the_whole_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_periodic_runs(spark, SF).collect()
    assert len(got) == len(rows) and any(r.n_runs for r in got)
    for r in got:
        assert tuple(r)[1:] == expected_periods(r.doc_id, rows[r.doc_id]), r.doc_id


def test_periodic_edges(spark, tmp_path):
    unit = "a  b\tc\n"
    rows = [(1, None), (2, ""), (3, " \n"), (4, unit * 4), (5, unit * 3 + "a b"), (5, unit * 4), (None, "x " * 30), (7, "é è ß " * 9), (8, "one")]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], DOCS)
    out = periodic.periodic_runs(clash(docs))
    assert out.columns[-2:] == ["runs", "collapsed"] and "piece" in out.columns
    got = {(r.doc_id, r.text): ([tuple(x) for x in r.runs], r.collapsed) for r in out.collect()}
    assert got[1, None] == got[2, ""] == got[3, " \n"] == ([], "")
    assert got[4, unit * 4] == ([(0, 12, 3)], "a b c")
    assert got[5, unit * 3 + "a b"] == ([], "a b c a b c a b c a b")
    assert got[None, "x " * 30] == ([(0, 30, 1)], "x")
    assert got[7, "é è ß " * 9] == ([(0, 18, 2)], "é è ß")
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op11_periodic_runs(spark, str(tmp_path)).where("doc_id is not null").collect():
        assert tuple(r)[1:] in [expected_periods(i, t) for i, t in rows if i == r.doc_id]


# --- 12

ODD = [
    "", "  ", "́a  ́b é", "ΑΣ ΣΑΣ  ΟΔΟΣ", "a\x1cb \x1d c", "x y z　q", "<|endoftext|> hi <|startoftext|>there", "don't DON'T 'S 's a.'s",
    "İstanbul ß ŒẞǅΣ İ", " " + "ab" * 5000 + " cd " + "9" * 300, "\U0001f642 가각", "ﬁx a\u0000b", "foo<|endoftext|> x.<|endoftext|>. Foo., --- É. ≠ a≠ K. K̸.",
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé'.,<|≯́İΣ 9\n\x1c #st"), max_size=30), max_size=4))
def test_word_tokens_are_the_tokenizers(texts):
    whole = Tokenizer.from_file(VOCABULARY)
    flat, ends = packing.word_tokens(VOCABULARY).encode([t.encode() for t in ODD + texts])
    for t, a, b in zip(ODD + texts, ends, ends[1:]):
        assert flat[a:b].tolist() == whole.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.sampled_from([30, 31]))
def test_bounds_and_best_fit_against_the_optimum(lengths, capacity):
    lengths = np.array(lengths, np.int64)
    bins, offsets = packing.best_fit(lengths, capacity)
    for b in set(bins.tolist()):
        parts = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist()))
        assert parts[0][0] == 0 and all(o + n == o2 for (o, n), (o2, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= capacity

    def optimum(left, rooms):
        if not left:
            return len(rooms)
        best = optimum(left[1:], [*rooms, capacity - left[0]])
        for i in range(len(rooms)):
            if rooms[i] >= left[0] and rooms[i] not in rooms[:i]:
                best = min(best, optimum(left[1:], rooms[:i] + [rooms[i] - left[0]] + rooms[i + 1 :]))
        return best

    least = optimum(sorted(lengths.tolist(), reverse=True)[:7], [])
    bound = packing.lower_bound(np.bincount(sorted(lengths.tolist(), reverse=True)[:7], minlength=capacity + 1), capacity)
    assert bound <= least <= len(set(packing.best_fit(np.sort(lengths)[::-1][:7], capacity)[0].tolist()))


def test_weights_of_a_full_sequence_never_exceed_one():
    rnd = random.Random(4)
    for capacity in (24, 100, 2048):
        weights, denominators = packing.dual_feasible(capacity)
        for _ in range(200):
            left, parts = capacity, []
            while left:
                parts.append(rnd.choice([rnd.randint(1, left), min(left, capacity // rnd.randint(2, 9)), min(left, capacity // 2 + 1)]))
                left -= parts[-1]
            assert (weights[:, parts].sum(1) <= denominators).all()


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("low, high", [(1, 100), (20, 60), (34, 100), (51, 99)])
def test_packing_in_small_partitions_comes_near_the_whole(spark, low, high):
    items = spark.range(3000).select(F.col("id").alias("doc_id"), (F.lit(low) + F.pmod(F.xxhash64("id"), F.lit(high - low + 1))).alias("length"))
    rows = packing.pack(items, 100, rows=100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    lengths = np.array([r.length for r in rows])
    bound, together = packing.lower_bound(np.bincount(lengths, minlength=101), 100), packing.best_fit(lengths, 100)[0].max() + 1
    print(low, high, bound, check_packing(rows, 100), together)
    assert bound <= check_packing(rows, 100) <= together * 1.005 + 1


def test_packing_edges(spark):
    items = spark.createDataFrame([(1, 5), (1, 5), (1, 5), (None, 10), (3, None), (4, 0), (5, 10), (6, 1)], "doc_id long, length int")
    rows = packing.pack(clash(items), 10).collect()
    assert len(rows) == 8 and {r.doc_id for r in rows if r.sequence_id is None and r.offset is None} == {3, 4}
    assert check_packing([r for r in rows if r.sequence_id is not None], 10) == 4
    assert {r["part"] for r in rows} == {"x"}
    assert packing.pack(items.limit(0), 10).count() == 0
    with pytest.raises(Exception, match="above 10"):
        packing.pack(spark.createDataFrame([(1, 11)], "doc_id long, length int"), 10).count()


def expected_pieces(whole, doc_id, text, capacity=2048):
    ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    return [(doc_id, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]


def test_packing_query_on_the_whole_table(spark):
    whole = Tokenizer.from_file(VOCABULARY)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = queries.op12_packing(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(x for d in docs for x in expected_pieces(whole, d.doc_id, d.text))
    bound = packing.lower_bound(np.bincount([r.length for r in rows], minlength=2049), 2048)
    assert bound <= check_packing(rows, 2048) <= bound * 1.01 + 1


def test_pieces_edges(spark, tmp_path):
    whole = Tokenizer.from_file(VOCABULARY)
    texts = [(1, None), (1, ""), (None, "a b"), (3, "word " * 2047), (4, "word " * 2048), (5, "word " * 9000)]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in texts], DOCS)
    clash(docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op12_packing(spark, str(tmp_path)).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted((x for i, t in texts for x in expected_pieces(whole, i, t)), key=key)
    check_packing(rows, 2048)
    assert packing.pieces(docs.limit(0), VOCABULARY).count() == 0


# --- 13


def expected_audit(docs, labels):
    """Each order applied to each document."""
    least = {}
    for d in docs:
        if d["doc_id"] is not None:
            least[d["text"] or ""] = min(least.get(d["text"] or "", d["doc_id"]), d["doc_id"])
    marks = {k: {x["doc_id"] for x in labels if x[k] == 1} - {None} for k in ("quality", "toxic")}
    out, shapley = {}, {}
    for d in docs:
        text, part = d["text"] or "", d["lang"] or ""
        words = WORD.findall(text)
        failed = {
            f for f, bad in zip("ABCDE", (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                re.search(r"[#$%&*|]", text) is not None, d["doc_id"] is not None and d["doc_id"] > least[text],
            )) if bad
        }
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                c = out.setdefault((part, order, step), [0] * 6)
                now = not gone and f in failed
                c[1] += now
                c[2] += gone and f in failed
                c[3] += failed == {f}
                c[4] += now and d["doc_id"] in marks["quality"]
                c[5] += now and d["doc_id"] in marks["toxic"]
                shapley[part, f] = shapley.get((part, f), 0) + now
                gone |= f in failed
                c[0] += not gone
    return sorted((*k, *c, shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items())


def test_audit_query_on_the_whole_table(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [r.asDict() for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_filter_audit(spark, SF).collect()) == expected_audit(docs, labels)


def test_audit_edges(spark):
    rnd = random.Random(5)
    texts = [None, "", "A b#", "é" * 40 + " A", "x " * 300, " ".join(map(str, range(250))), " ".join(map(str, range(250))) + " AB%", "Ünï&"]
    docs = [{"doc_id": rnd.choice([None, *range(40)]), "text": rnd.choice(texts), "lang": rnd.choice([None, "", "en", *(f"l{k}" for k in range(90))])} for _ in range(400)]
    labels = [{"doc_id": rnd.choice([None, *range(60)]), "quality": rnd.choice([0, 1, None]), "toxic": rnd.choice([0, 1, None])} for _ in range(60)]
    frame = clash(spark.createDataFrame([(d["doc_id"], d["text"], d["lang"]) for d in docs], "doc_id long, text string, lang string").repartition(5))
    marks = clash(spark.createDataFrame([tuple(x.values()) for x in labels], "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in filter_audit.audit(frame, marks).collect()) == expected_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0
    assert filter_audit.audit(frame, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
