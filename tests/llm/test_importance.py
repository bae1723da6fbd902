"""Importance resampling against a brute-force version, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfield.llm import importance, queries
from starfield.llm.words import NOT_ALNUM, Words, utf8

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, n_max):
    w = words(text)
    return [" ".join(w[k : k + n]) for n in range(1, n_max + 1) for k in range(len(w) - n + 1)]


def brute(docs, target, n_max=1, size=10_000, percent=10, least=20):
    bucket = lambda text: [zlib.crc32(g.encode()) % size for g in grams(text, n_max)]
    rows = [(i, len(words(t)), bucket(t)) for i, t in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for text in target for b in bucket(text))
    n_s, n_t, out = sum(s.values()), sum(t.values()), []
    for i, n, found in rows:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + size) / ((s[b] + 1) * (n_t + size)))) for b in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [(r[0], *r[2:], k + 1 if k < percent * len(able) // 100 else None) for k, r in enumerate(able)]
    return sorted(drawn + [(r[0], *r[2:], None) for r in out if r[1] < least], key=repr)


@pytest.mark.parametrize("n_max", [1, 2, 3])
def test_equals_brute_force(spark, sf_dir, n_max):
    docs, target = queries.documents(spark, sf_dir), queries.benchmark(spark, sf_dir)
    want = brute(docs.select("doc_id", "text").collect(), [r.text for r in target.select("text").collect()], n_max)
    assert sorted(map(tuple, importance.resampled(docs, target, n_max=n_max).collect()), key=repr) == want
    assert any(r[-1] for r in want)


def test_query_equals_brute_force(spark, sf_dir):
    docs, target = queries.documents(spark, sf_dir), queries.benchmark(spark, sf_dir)
    want = brute(docs.select("doc_id", "text").collect(), [r.text for r in target.select("text").collect()])
    assert sorted(map(tuple, queries.op11_importance(spark, sf_dir).collect()), key=repr) == want


def test_odd_rows(spark):
    text = " ".join(f"W{k % 9}" for k in range(25))
    rows = [(None, text), (1, None), (2, ""), (3, " ,. "), (4, text), (4, text), (5, text + " é日本 x"), (6, "w1 " * 50_000), *((k, text) for k in range(10, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("buckets", "weight", "score", "rank", "_late", "n_words", "v"):
        docs = docs.withColumn(c, F.lit("extra"))
    target = spark.createDataFrame([("w1 w2", "a"), (None, "b"), ("W1!", "c")], "text string, item_id string")
    for n_max in (1, 2):
        got = sorted(map(tuple, importance.resampled(docs, target, n_max=n_max, percent=50).collect()), key=repr)
        assert got == brute(rows, ["w1 w2", None, "W1!"], n_max, percent=50)
    assert importance.resampled(docs.limit(0), target).collect() == []
    assert len(importance.resampled(docs, target.limit(0)).collect()) == len(rows)


def test_many_partitions_rank_as_one(spark):
    docs = spark.createDataFrame([(k, " ".join(f"t{(k * j) % 13}" for j in range(22))) for k in range(300)], "doc_id long, text string")
    target = spark.createDataFrame([("t1 t2 t3",)], "text string")
    got = importance.resampled(docs.repartition(11), target).filter("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 31)) and [r.score for r in got] == sorted((r.score for r in got), reverse=True)


def test_suffix_arrays():
    rng = np.random.default_rng(5)
    for _ in range(50):
        texts = [" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 9))) for _ in range(4)]
        w = Words(*utf8(importance.pa.array(texts)), NOT_ALNUM)
        ids, known = importance.word_numbers(w)
        last = np.repeat(w.first[1:], w.counts) - 1
        order, prefix = importance.suffixes(ids, last, 3)
        whole = [tuple(ids[k : min(last[k] + 1, k + 3)]) for k in order]
        assert whole == sorted(whole) and sorted(order) == list(range(len(ids)))
        for k in range(1, len(whole)):
            common = 0
            while common < min(len(whole[k]), len(whole[k - 1])) and whole[k][common] == whole[k - 1][common]:
                common += 1
            assert prefix[k] == common
        assert [known[i].decode() for i in ids] == " ".join(texts).split()
