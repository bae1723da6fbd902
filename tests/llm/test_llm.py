"""The corpus operators against brute-force versions, on the smallest tables and on odd rows: nulls in any column,
empty and very long texts, ties and repeated rows, empty tables, clashing extra columns."""

import gc
import gzip
import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starfield.llm import chat, classifier, contamination, licenses, packing, quality_rules, queries, sharding, simhash, substrings, warc
from starfield.llm.words import WHITE, Words, blocks, gram_hashes, utf8
from tests.oracle import both

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["fp", "node", "component", "anchor", "span", "low", "text_id", "term", "doc", "part", "before", "ids", "row", "size", "_text", "_place", "y", "first", "at", "shard"]


def lowered(text):
    return (text or "").encode().translate(LOWER).decode()


def table(spark, rows):
    """Documents from (doc_id, text), with extra columns whose names operators use themselves."""
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENT)
    for k, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(f"extra {k}"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
    rows = [(None, passage), (3, None), (4, ""), (5, " \n\t "), (6, "x"), (7, "Ünder THE mit-license! ÀB"), (8, passage), (9, "a " + passage + " b"), (9, "a " + passage + " b"), (10, long), (11, long + " end"), (12, "one two"), (13, "same " * 120), (14, "same " * 120), (2, passage), (15, "y" * 100_000)]
    return rows, table(spark, rows)


def rows_of(spark, sf_dir, name="documents"):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*("doc_id text" if name == "documents" else "item_id text").split()).collect()]


# Words


def test_words_equal_the_pattern():
    texts = ["a b", None, "", " x\ny ", "é è z", "end", "start again", "\x0b\x0c", "q" * 70_000 + " r"]
    data, offsets = utf8(pa.array(texts))
    words = Words(data, offsets)
    got = [[bytes(data[a:b]).decode() for a, b in zip(words.starts[x:y], words.ends[x:y], strict=True)] for x, y in zip(words.first, words.first[1:], strict=False)]
    assert got == [WORD.findall(t or "") for t in texts]
    again = Words(*utf8(pa.array(["zz " + "q" * 70_000, "again start"])), WHITE)
    assert again.hashes()[1] == words.hashes()[-2] and set(again.hashes()[2:]) == set(words.hashes()[-4:-2])
    assert list(words.starts_of_grams(2)) == [0, 2, 4, 7, 9] or all(words.document()[k] == words.document()[k + 1] for k in words.starts_of_grams(2))


def test_gram_hashes_depend_on_order_and_content():
    h = np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint64)
    g = gram_hashes(h, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 5 and len(gram_hashes(h, 9)) == 0


@pytest.mark.parametrize("size", [64, 128, 256, 512, 1024, 2048, 4096])
def test_words_of_thue_and_morse_differ(size):
    """A word and its complement, which polynomials modulo powers of two confuse."""
    one = "".join("ab"[k.bit_count() & 1] for k in range(size))
    other = one.translate(str.maketrans("ab", "ba"))
    words = Words(*utf8(pa.array([f"{one} {other} {one}"])))
    for salt in (0, 7):
        h = words.hashes(salt)
        assert h[0] == h[2] != h[1]
    assert words.hashes(0)[0] != words.hashes(7)[0]


def test_blocks_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": ["a" * 3_000_000, None, "b" * 5_000_000, "", "c"]})
    assert [r.num_rows for r, _, _ in blocks([batch])] == [2, 1, 2]


# 1 Chat


def test_op1_equals_sql(spark, sf_dir):
    ours, theirs = both(queries.op1_chat_collapse(spark, sf_dir), queries.ORACLES["op1_chat_collapse"], sf_dir)
    assert ours == theirs


def brute_chats(rows):
    convs = defaultdict(set)
    for conv, turn, role, text in rows:
        convs[conv].add((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    seqs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    first = {}
    for c in sorted(seqs, key=lambda c: (c is not None, c or 0)):
        first.setdefault(tuple(seqs[c]), c)
    return {c for s, c in first.items() if not any(len(o) > len(s) and list(o[: len(s)]) == list(s) for o in first)}


def test_op1_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (4, None, None, None), (None, 0, "user", "hi"), (None, 1, "bot", ""), (5, 0, "user", "hi"), (5, 0, "user", "hi"), (6, 7, "user", None), (7, 7, "user", ""), (8, 0, "z", "tie"), (8, 0, "a", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("x")).withColumn("h1", F.lit(1))
    assert {r["conv_id"] for r in chat.maximal(df).collect()} == brute_chats(rows)
    out = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    assert out[1]["copies"] == 2 and out[1]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyo<|im_end|>\n"
    assert out[8]["text"].startswith("<|im_start|>a") and out[4]["n_turns"] == 1
    assert chat.formatted(df.limit(0)).count() == 0


def test_op1_long_conversation(spark):
    long = [(1, k, "user", f"t{k}") for k in range(700)]
    df = spark.createDataFrame(long + [(2, k, "user", f"t{k}") for k in range(300)] + [(3, k, "user", f"t{k}" if k != 290 else "other") for k in range(300)], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"] for r in chat.maximal(df).collect()} == {1, 3}
    parts = chat.formatted(df.filter("conv_id = 1"), part=256).orderBy("part").collect()
    assert "".join(p["text"] for p in parts).count("<|im_start|>") == 700 and len(parts) == 3


@pytest.mark.parametrize("turn", [None, 5])
def test_op1_one_turn_number(spark, turn):
    texts = [f"t{k:04}" for k in range(900)]
    rows = [(1, turn, "user", t) for t in texts] + [(None, turn, "user", t) for t in texts[:600]] + [(3, turn, "user", t) for t in texts[:599] + ["u"]] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert {(r["conv_id"], r["n"]) for r in chat.maximal(df).collect()} == {(1, 900), (3, 600)}
    parts = chat.formatted(df, part=100).filter("conv_id = 1").orderBy("part").collect()
    assert "".join(p["text"] for p in parts) == "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for t in texts) and len(parts) == 9


# 2 Decontamination


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lowered(t))
        for k in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = ALNUM.findall(lowered(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= own
                    hit |= set(range(k, k + n))
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_op2_equals_brute_force(spark, sf_dir):
    found = queries.op2_positional_index(spark, sf_dir).collect()
    assert sorted((tuple(r)[:6] for r in found), key=repr) == brute_contamination(rows_of(spark, sf_dir), rows_of(spark, sf_dir, "benchmark"))
    assert all(r["n_near"] >= r["n_items"] for r in found)


def test_op2_odd_rows(spark, odd):
    rows, df = odd
    items = [(1, " ".join(f"p{k}" for k in range(10, 40))), (2, "X"), (None, "one TWO"), (3, None), (4, ""), (5, "same " * 14), (5, "same " * 14), (6, "ünder THE"), (7, "the the the the the the the the the the the the the the")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1)).withColumn("doc_id", F.lit(2))
    for slop in (0, 2):
        assert sorted((tuple(r)[:6] for r in contamination.contamination(df, bench, slop=slop).collect()), key=repr) == brute_contamination(rows, items)
    assert contamination.contamination(df.limit(0), bench).count() == 0
    clean = contamination.contamination(df, bench.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r["contaminated"] for r in clean)


def brute_near(docs, items, slop, n=13):
    """Pairs of documents and items with a window all of whose words stand within ``slop`` of their places, counted from
    an occurrence of one of its rarest words."""
    counts = Counter(w for _, t in docs for w in ALNUM.findall(lowered(t)))
    out = set()
    for d, t in docs:
        at = defaultdict(list)
        for k, w in enumerate(ALNUM.findall(lowered(t))):
            at[w].append(k)
        for i, text in items:
            words = ALNUM.findall(lowered(text))
            n_ = min(n, len(words))
            for s in range(len(words) - n_ + 1 if words else 0):
                _, p, w = min((counts[words[s + k]], s + k, str(k)) for k in range(n_))
                for k in range(n_):  # ties are broken by place
                    assert (counts[words[s + k]], s + k) >= (counts[words[p]], p)
                if any(all(any(abs(x - (o - p + q)) <= slop for x in at[words[q]]) for q in range(s, s + n_)) for o in at[words[p]]):
                    out.add((d, i))
    return out


def test_op2_proximity(spark):
    r = np.random.default_rng(2)
    items = [(k, " ".join(f"w{x}" for x in r.integers(0, 40, int(r.integers(3, 22))))) for k in range(12)]
    items.append((50, items[0][1] + " more words"))
    docs = []
    for d in range(60):
        words = items[d % 12][1].split()
        for _ in range(int(r.integers(0, 4))):
            words.insert(int(r.integers(0, len(words) + 1)), f"x{d}")
        docs.append((d, " ".join(words)))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for slop in (0, 1, 2):
        near = brute_near(docs, items, slop)
        found = {(x["doc_id"], x["item_id"]) for x in contamination.proximity_matches(*frames, slop=slop).collect()}
        assert found == near
        counts = Counter(d for d, _ in near)
        assert all(x["n_near"] == counts[x["doc_id"]] for x in contamination.contamination(*frames, slop=slop).collect())


def test_op2_items_that_share_windows(spark):
    """Many items with one passage: each is found, and the passage is aligned once."""
    passage = " ".join(f"p{k}" for k in range(30))
    items = [(k, f"a{k} " * 5 + passage + f" b{k}" * (k % 4)) for k in range(40)]
    docs = [(1, "x " + passage + " y"), (2, items[7][1]), (3, "nothing")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(x)[:6] for x in contamination.contamination(*frames).collect()), key=repr) == brute_contamination(docs, items)
    matches = contamination.phrase_matches(*frames, slop=0)[1].filter("exact AND doc.doc_id = 1")
    assert matches.count() == 1


# 3 Substring dedup


def brute_repeats(docs, n=50):
    holders = {}
    for d, t in docs:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1 if d is not None else 0):
            key = tuple(w[k : k + n])
            holders[key] = min(holders.get(key, d), d)
    out = []
    for d, t in docs:
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - n + 1 if d is not None else 0):
            if holders[tuple(w[k : k + n])] < d:
                gone |= set(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def check_spans(found, rows, n=50):
    """Every repeat is that of its source, word by word; repeats cover what goes; none of one source and diagonal meet."""
    words = defaultdict(list)
    for d, t in rows:
        words[d].append(WORD.findall(t or ""))
    for r in found:
        covered = set()
        for x in r["repeats"]:
            assert x["past"] - x["low"] >= n and x["source"] < r["doc_id"]
            covered |= set(range(x["low"], x["past"]))
            size = x["past"] - x["low"]
            same = any(a[x["low"] : x["past"]] == b[x["source_low"] : x["source_low"] + size] for a in words[r["doc_id"]] for b in words[x["source"]])
            assert same or any(len(set(a[x["low"] : x["past"]])) < n for a in words[r["doc_id"]])  # texts that repeat themselves
        assert len(covered) == r["n_removed"]
        ends = defaultdict(list)
        for x in r["repeats"]:
            ends[x["source"], x["source_low"] - x["low"]].append((x["low"], x["past"]))
        assert all(a[1] < b[0] for own in ends.values() for a, b in zip(sorted(own), sorted(own)[1:], strict=False))


def test_op3_equals_brute_force(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    found = queries.op3_seed_extend(spark, sf_dir).collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == brute_repeats(rows)
    check_spans(found, rows)


def test_op3_odd_rows(spark, odd):
    rows, df = odd
    assert sorted((tuple(r)[:4] for r in substrings.substring_report(df).collect()), key=repr) == brute_repeats(rows)
    assert substrings.substring_report(df.limit(0)).count() == 0
    left = substrings.without_repeats(df)
    assert left.columns == df.columns
    texts = {(r["doc_id"], r["text"]) for r in left.collect()}
    assert (9, "a b") in texts and (11, "end") in texts and not any(d in (8, 14) for d, _ in texts) and (3, None) in texts and (4, "") in texts


def test_op3_many_equal_rows(spark):
    passage = " ".join(f"v{x % 97}" for x in range(400))
    rows = [(1, "a b " + passage)] + [(2, passage + " c")] * 600 + [(3, "d " + passage)]
    found = substrings.substring_report(table(spark, rows)).collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == brute_repeats(rows)
    once = {r["doc_id"]: r["n"] for r in substrings.repeated(table(spark, rows[:2] + rows[-1:]))[1].select("doc_id", F.size("repeats").alias("n")).collect()}
    many = {r["doc_id"]: r["n"] for r in substrings.repeated(table(spark, rows))[1].select("doc_id", F.size("repeats").alias("n")).collect()}
    assert many == once and set(once) == {2, 3}


def test_op3_random_repeats(spark):
    r = np.random.default_rng(3)
    pool = [[f"v{x}" for x in r.integers(0, 400, 90)] for _ in range(6)]
    rows = []
    for d in range(40):
        words = []
        for _ in range(4):
            p = pool[r.integers(0, 6)]
            a = r.integers(0, 40)
            words += p[a : a + r.integers(20, 90)] + [f"u{x}" for x in r.integers(0, 9, r.integers(0, 4))]
        rows.append((int(r.integers(0, 1000)), " ".join(words)))
    rows = list({d: (d, t) for d, t in rows}.values())
    found = substrings.substring_report(table(spark, rows)).collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == brute_repeats(rows)
    check_spans(found, rows)


def test_op3_texts_that_repeat_themselves(spark):
    r = np.random.default_rng(4)
    rows = []
    for d in range(60):
        period = int(r.integers(1, 8))
        words = [f"p{x}" for x in range(int(r.integers(0, 3)), 40)][:period] * int(r.integers(8, 120))
        head, tail = ([f"n{x}" for x in r.integers(0, 50, int(r.integers(0, 30)))] for _ in range(2))
        rows.append((d, " ".join(head + words[: int(r.integers(30, 400))] + tail)))
    assert sorted((tuple(r)[:4] for r in substrings.substring_report(table(spark, rows)).collect()), key=repr) == brute_repeats(rows)
    assert len(substrings.occurrences(table(spark, [(1, "a " * 5000)])).collect()) == 1


# 4 Packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_pieces(pieces, rows):
    tokenizer = Tokenizer.from_file(PATH)
    wanted = Counter((d, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])) for d, t in rows)
    at = defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == p["length"] and zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]
        at[p["sequence_id"]].append(p)
    stream = []
    for s in sorted(at):
        place = 0
        for p in sorted(at[s], key=lambda p: p["offset"]):
            assert p["offset"] == place
            place += p["length"]
            stream.append(p)
        assert place == 1024 or s == max(at) and place <= 1024
    found, ids = Counter(), []
    for p in stream:
        assert p["start"] == len(ids)
        ids += p["ids"]
        if len(ids) == p["doc_tokens"]:
            found[p["doc_id"], tuple(ids)] += 1
            ids = []
    assert not ids and found == wanted


def test_op4_round_trip(spark, sf_dir, odd):
    check_pieces(packing.packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH, with_ids=True).collect(), rows_of(spark, sf_dir))
    rows, df = odd
    pieces = packing.packed(df.repartition(3), PATH, with_ids=True)
    check_pieces(pieces.collect(), rows)
    assert all(len(r["ids"]) == 1024 for r in packing.sequences(pieces).collect())
    assert packing.packed(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("text", ["  a  b ", "a  <|endoftext|>  b", "x  <y", "x y  z  \n q", "a<|endoftext|> b <|endoftext|>", "\n\n x", "it's 're  don't\t tab", " 　x  y", "a \x1c b", "é è  ê", "日本 語 emoji 🙂 🙂 end "])
def test_op4_chunks_encode_as_whole_texts(text):
    e = packing.encoder(PATH)
    ids, n = e.encode(*utf8(pa.array([text, None, text + text])))
    own = lambda t: e.tokenizer.encode(t, add_special_tokens=False).ids
    assert ids.tolist() == own(text) + own(text + text) and n.tolist() == [len(own(text)), 0, len(own(text + text))]


def test_op4_encodes_each_distinct_word_once(monkeypatch):
    given, own = [], packing.word_ids
    monkeypatch.setattr(packing, "word_ids", lambda words, path: given.extend(words.to_pylist()) or own(words, path))
    ids, n = packing.encoder(PATH).encode(*utf8(pa.array(["a end. end, end", None, "a end."] * 1000)))
    assert sorted(given) == [b" end", b",", b".", b"a"]
    assert len(ids) == n.sum() and n[:3].tolist() == [6, 0, 3]


def test_op4_keeps_no_words_between_blocks():
    """Workers live on between tasks: what each kept added up."""
    e = packing.encoder(PATH)
    e.encode(*utf8(pa.array(["a b"])))
    many = utf8(pa.array([" ".join(f"w{k}q" for k in range(30_000))]))
    tracemalloc.start()
    e.encode(*many)
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 200_000


# 5 SimHash


def brute_fingerprint(text):
    w = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    own = sorted(set(prints))
    root = {f: f for f in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(own):
        for b in own[:k]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in own}


def check_classes(found, rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(prints)
    least = {}
    for (d, _), f in zip(rows, prints, strict=True):
        if d is not None:
            least[root[f]] = min(least.get(root[f], d), d)
    assert Counter(found) == Counter((d, f"{f:016x}", least.get(root[f])) for (d, _), f in zip(rows, prints, strict=True))


def test_op5_equals_brute_force(spark, sf_dir, odd):
    check_classes([tuple(r) for r in queries.op5_simhash_pivots(spark, sf_dir).collect()], rows_of(spark, sf_dir))
    rows, df = odd
    check_classes([tuple(r) for r in simhash.near_duplicates(df).collect()], rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [64, 2])
def test_op5_links_of_crowds(spark, crowd):
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 2**63, 6)]
    prints = {b ^ (1 << int(r.integers(0, 64))) ^ (1 << int(r.integers(0, 64))) ^ (1 << int(r.integers(0, 64))) for b in base for _ in range(40)}
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    from starfield.operators.components import components

    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowd=crowd)
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    want = brute_components(list(prints))
    mine, theirs = defaultdict(set), defaultdict(set)
    for f, s in zip(prints, signed, strict=True):
        mine[got.get(s, s)].add(f)
        theirs[want[f]].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_op5_pivots_discard_pairs(spark):
    """Cells and coordinates leave out pairs that blocks alone would make, and none that is near."""
    r = np.random.default_rng(7)
    low = int(r.integers(0, 1 << 32))
    prints = sorted({low | int(x) << 32 for x in r.integers(0, 1 << 31, 50)} | {low | 1 << 40, low | 1 << 41, low | 3 << 40})
    distinct = spark.createDataFrame([(f,) for f in prints], "fp long")
    few, crowded = simhash.blocked(distinct)
    every = {(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :]}
    made = {(p["a"], p["b"]) for p in simhash.pairs(few).collect()}
    left = {(p["a"], p["b"]) for p in simhash.survivors(simhash.pairs(few)).collect()}
    near = {(a, b) for a, b in every if (a ^ b).bit_count() <= 2}
    assert crowded.count() == 0 and near <= left < made < every and len(left) < len(every) // 20
    assert {(p["a"], p["b"]) for p in simhash.links(distinct).collect()} == near


# 6 Quality rules


def brute_rules(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_op6_base_equals_brute_force(spark, sf_dir, odd):
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = queries.op6_crf_lines(spark, sf_dir).collect()
    assert sorted((r["doc_id"], *(r[c] for c in base)) for r in found) == sorted((d, *brute_rules(t)) for d, t in rows_of(spark, sf_dir))
    rows, df = odd
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd_found = quality_rules.quality_rules(df, labels).collect()
    assert Counter((r["doc_id"], *(r[c] for c in base)) for r in odd_found) == Counter((d, *brute_rules(t)) for d, t in rows)
    assert not any(r["kept"] and r["base_failed"] for r in [*found, *odd_found])
    assert quality_rules.quality_rules(df.limit(0), labels).count() == 0


def test_op6_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    verdict = {r["doc_id"]: r for r in queries.op6_crf_lines(spark, sf).collect()}
    good = [r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()]
    kept = [verdict[d]["kept"] for d in good if not verdict[d]["base_failed"]]
    assert np.mean(kept) > 0.97
    several = [r for r in verdict.values() if r["n_lines"] > 1]
    mixed = [0 < r["n_content_lines"] < r["n_lines"] for r in several]
    assert 0.05 < np.mean(mixed) < 0.95


def test_op6_marks_lines_not_documents(spark):
    """Boilerplate that many documents hold is found among content, and content among boilerplate."""
    r = np.random.default_rng(5)
    sentence = lambda: " ".join(f"w{x}" for x in r.integers(0, 3000, 14)) + "."
    junk = lambda: " ".join(f"J{x}!!" for x in r.integers(0, 3000, 9))
    rows, labels, lines = [], [], {}
    for d in range(300):
        own = [("Home About Contact", 0)] + [(sentence(), 1) for _ in range(int(r.integers(3, 6)))] if d % 2 else [(junk(), 0) for _ in range(3)] + [(sentence(), 1)] + [(junk(), 0) for _ in range(2)]
        rows.append((d, "\n".join(t for t, _ in own)))
        labels.append((d, d % 2, 0))
        lines[d] = sum(y for _, y in own), len(own)
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    field = quality_rules.trained(docs, known)
    assert len(field.common) == 1
    found = {r["doc_id"]: r for r in quality_rules.judged(docs, field).collect()}
    right = [(found[d]["n_content_lines"], found[d]["n_lines"]) == lines[d] for d in lines]
    assert np.mean(right) > 0.95
    assert all(found[d]["kept"] == bool(d % 2) for d in lines if found[d]["n_content_lines"] == lines[d][0] and not found[d]["base_failed"])


def test_op6_verdict_equals_brute_force(spark, odd):
    """All labellings of every document's lines, scored one by one, give the verdict."""
    r = np.random.default_rng(6)
    rows = [(d, "\n".join(" ".join(r.choice(["word", "WORD!!", "a", "3", "#$"], int(r.integers(1, 9)))) for _ in range(int(r.integers(1, 8))))) for d in range(60)]
    field = quality_rules.Field(r.standard_normal(len(quality_rules.FEATURES)) * 2, r.standard_normal((2, 2)), np.zeros(0, np.uint64))
    for d, text in rows:
        data, offsets = utf8(pa.array([text]))
        words = Words(data, offsets)
        lines = quality_rules.Lines(data, offsets, words, words.hashes(), field.common)
        score, n = lines.x @ field.weights, len(lines.x)
        best = max(range(1 << n), key=lambda p: sum(score[k] * (p >> k & 1) for k in range(n)) + sum(field.moves[p >> k & 1, p >> (k + 1) & 1] for k in range(n - 1)))
        inside = sum(len(WORD.findall(line)) for k, line in enumerate(filter(WORD.search, text.split("\n"))) if best >> k & 1)
        (found,) = quality_rules.judged(spark.createDataFrame([(d, text)], "doc_id long, text string"), field).collect() if d < 6 else (None,)
        if found is not None:
            assert found["content_words"] == inside and found["kept"] == (not brute_rules(text)[5] and 2 * inside >= len(WORD.findall(text)))


def test_op6_copies_are_not_common(spark):
    """However many copies hold a line, it is not boilerplate for that."""
    rows = [(d, "first of all.\nthe second line goes on.\nand a third one.") for d in range(200)] + [(300 + d, f"shared line\nown{d} words{d} in{d} document{d}") for d in range(40)]
    common = quality_rules.common_lines(table(spark, rows).repartition(3))
    words = Words(*utf8(pa.array(["shared line"])), quality_rules._NEWLINE)
    assert common.tolist() == words.hashes().tolist()


def test_op6_viterbi_equals_all_paths():
    r = np.random.default_rng(0)
    counts = np.array([4, 1, 0, 6])
    score, moves = r.standard_normal(counts.sum()), r.standard_normal((2, 2))
    got, at = quality_rules.viterbi(score, counts, moves), 0
    for n in counts:
        best = max(range(1 << n), key=lambda p: sum(score[at + k] * (p >> k & 1) for k in range(n)) + sum(moves[p >> k & 1, p >> (k + 1) & 1] for k in range(n - 1)))
        assert [int(x) for x in got[at : at + n]] == [best >> k & 1 for k in range(n)]
        at += n


# 7 Sharding


def test_op7_law(spark, sf_dir, odd):
    for df, rows in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), rows_of(spark, sf_dir)), (odd[1], odd[0])):
        found = sharding.sharded(df).collect()
        want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
        slots = defaultdict(list)
        for r in found:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots.get(k, [])) for k in range(40)]
        assert set(slots) <= set(range(40)) and max(sizes) - min(sizes) <= 1
    places = lambda df: {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.sharded(df).collect()}
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert places(df) == places(df.repartition(5))
    assert sharding.sharded(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 100, 1000])
def test_op7_permutes(spark, n):
    got = [r["p"] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (n < 50 or got != sorted(got))


# 8 Licenses


def brute_licenses(text):
    w = ALNUM.findall(lowered(text))
    places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    return len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


def test_op8_base_equals_brute_force(spark, sf_dir, odd):
    extra = [(100, "CC-BY NC. cc by nc cc BY nc"), (101, "Under the MIT-License, apache license version 2"), (102, "under the mit licenses")]
    for df, rows in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), rows_of(spark, sf_dir)), (odd[1], odd[0]), (table(spark, extra), extra)):
        found = licenses.scanned(df).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found) == Counter((d, *brute_licenses(t)) for d, t in rows)
        assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)
    assert licenses.scanned(odd[1].limit(0)).count() == 0


def test_op8_edits(spark):
    rows = [(1, "Text. Licensd under the Apache Licence, Version 2.0. End"), (2, "licensed under the GNU General Public License, version 3"), (3, "nothing licensed here"), (4, "x" * 500_000 + " relaesed under the MIT license.")]
    found = {r["doc_id"]: r for r in licenses.scanned(table(spark, rows)).collect()}
    assert found[1]["labels"] == "apache-2" and found[1]["n_base"] == 0 and 0 < found[1]["score"] < 1
    assert (found[1]["matches"][0]["first_word"], found[1]["matches"][0]["last_word"], found[1]["matches"][0]["edits"]) == (1, 8, 2)
    assert found[2]["labels"] == "gpl-3" and found[3]["labels"] == "" and found[3]["score"] == 0
    assert found[4]["labels"] == "mit"


def test_op8_many_notices_in_one_text(spark):
    """A notice over and over costs its length, and each place is found."""
    n = 20_000
    (row,) = licenses.scanned(table(spark, [(1, "so it is released under the mit license and " * n)])).collect()
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (9 * n, n, 4, 9 * (n - 1) + 4)
    assert [(m["first_word"], m["last_word"], m["edits"]) for m in row["matches"]] == [(9 * k + 3, 9 * k + 7, 0) for k in range(n)]


def test_op8_seeds_leave_no_match_out():
    for notice in licenses.NOTICES:
        k = licenses.edits_allowed(notice)
        parts = licenses.seeds(notice, k)
        assert len(parts) == k + 1 and "".join(p for _, p in parts) == notice and all(notice[a : a + len(p)] == p for a, p in parts)


# 9 WARC

PAGE = "page_id long, url string, html string"


def test_op9_equals_sql(spark, sf_dir):
    ours, theirs = both(queries.op9_warc_salvage(spark, sf_dir), queries.ORACLES["op9_warc_salvage"], sf_dir)
    assert ours == theirs


def test_op9_odd_rows(spark):
    big = "é" * 60
    rows = [(3, "http://a b\r\nX: y", big), (1, None, big), (1, None, big), (7, "u", None), (8, "u", ""), (9, "u", "small"), (10, "u", "small"), (None, "u", big), (11, "u", "z" * 2_000_000), (12, "u", "\x00\r\n\r\nWARC/1.0\r\n" * 9)]
    df = spark.createDataFrame(rows, PAGE).withColumn("refers_to", F.lit("x")).withColumn("payload_digest", F.lit(0))
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    want = Counter()
    for p, _, html in rows:
        data = (html or "").encode()
        again = html == big and p != 1
        want[p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None] += 1
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


def archive():
    records = [warc.record(k, "u", f"payload {k}".encode() * 20, hashlib.sha256(f"payload {k}".encode() * 20).hexdigest(), None, "response") for k in range(6)]
    return records, [warc.member(r) for r in records]


def ids(found):
    return [x[3]["warc-record-id"] for x in found if x[0] == "record"]


def test_op9_salvages_damaged_members():
    records, members = archive()
    whole = b"".join(members)
    assert len(ids(warc.salvaged(whole))) == 6
    starts = np.cumsum([0, *map(len, members)])
    broken = bytearray(whole)
    broken[starts[2] + 40] ^= 0xFF
    found = list(warc.salvaged(bytes(broken)))
    assert ids(found) == [f"<urn:page:{k}>" for k in (0, 1, 3, 4, 5)]
    assert [(x[1], x[2]) for x in found if x[0] == "gap"] == [(starts[2], starts[3])]
    cut = list(warc.salvaged(whole[: starts[5] + 30]))
    assert len(ids(cut)) == 5 and cut[-1][:3] == ("gap", starts[5], starts[5] + 30)
    junk = list(warc.salvaged(b"junk" + whole + b"\x1f\x8b\x08 tail"))
    assert len(ids(junk)) == 6 and sum(x[0] == "gap" for x in junk) == 2
    assert list(warc.salvaged(b"")) == []


def test_op9_salvages_plain_archives(spark, tmp_path):
    records, _ = archive()
    spoiled = bytearray(b"".join(records))
    at = len(records[0]) + records[1].index(b"payload 1") + 3
    spoiled[at : at + 2] = b"??"
    (tmp_path / "a.warc").write_bytes(bytes(spoiled))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert Counter(r["kind"] for r in rows) == {"record": 11, "gap": 1}
    gap = next(r for r in rows if r["kind"] == "gap")
    assert (gap["begin"], gap["end"], gap["reason"]) == (len(records[0]), len(records[0]) + len(records[1]), "wrong payload digest")


@pytest.mark.parametrize("level", [0, 1])
def test_op9_salvages_within_members(level):
    records, _ = archive()
    every = [f"<urn:page:{k}>" for k in range(6)]
    spoiled = bytearray(b"".join(records))
    spoiled[len(records[0]) + records[1].index(b"payload 1") + 3] ^= 0xFF
    one = warc.member(bytes(spoiled), level)
    tail = warc.member(records[0], level)
    rest = every[:1] + every[2:]
    found = list(warc.salvaged(one + tail))
    assert ids(found) == rest + every[:1] and [x[1:] for x in found if x[0] == "gap"] == [(0, len(one), "wrong payload digest")]

    wrong = bytearray(warc.member(b"".join(records), level))
    wrong[-6] ^= 0xFF  # the checksum
    found = list(warc.salvaged(bytes(wrong) + tail))
    assert ids(found) == every + every[:1]
    assert [(x[1], x[2]) for x in found if x[0] == "gap"] == [(0, len(wrong))]


def test_op9_salvages_members_cut_off():
    noise = np.random.default_rng(1).bytes(400_000).hex().encode()
    payloads = [noise[k * 100_000 : (k + 1) * 100_000] for k in range(8)]
    records = [warc.record(k, "u", p, hashlib.sha256(p).hexdigest(), None, "response") for k, p in enumerate(payloads)]
    tail = warc.member(warc.record(9, "u", b"", hashlib.sha256(b"").hexdigest(), None, "response"))
    for level in (0, 1, 6):
        data = warc.member(b"".join(records), level)
        cut = data[: len(data) * 6 // 10]
        for more in (b"", tail):
            found = list(warc.salvaged(cut + more))
            assert ids(found) == [f"<urn:page:{k}>" for k in (0, 1, 2, 3, *([9] if more else []))]
            assert [x[1] for x in found if x[0] == "gap"] == [0]
        broken = bytearray(data)
        broken[len(data) // 2 : len(data) // 2 + 40] = bytes(40)
        kept = ids(warc.salvaged(bytes(broken) + tail))
        assert kept[:3] == [f"<urn:page:{k}>" for k in range(3)] and kept[-1] == "<urn:page:9>" and len(set(kept)) == len(kept)


def test_op9_very_long_urls(spark):
    rows = [(1, "http://a/" + "x" * 70_000, "one" * 50), (2, "http://a/" + "é " * 200_000, "two" * 50), (3, "u", "three")]
    df = spark.createDataFrame(rows, PAGE)
    assert sorted(r["page_id"] for r in warc.round_trip(df).collect()) == [1, 2, 3]
    read = warc.read_archives(warc.write_warc(warc.with_revisits(df)), whole=True).collect()
    assert {r["kind"] for r in read} == {"record"} and sorted(len(r["uri"]) for r in read) == [1, 70_009, 800_009]


def test_op9_torn_members_are_gaps(spark):
    rows = [(k, f"http://a/{k}", f"page {k % 7} " * 40) for k in range(50)]
    pages = warc.with_revisits(spark.createDataFrame(rows, PAGE).coalesce(2))
    read = warc.read_archives(warc.write_warc(pages, torn=10), whole=True).collect()
    assert sorted(r["record_id"] for r in read if r["kind"] == "record") == sorted(f"<urn:page:{k}>" for k in range(50))
    gaps = [r for r in read if r["kind"] == "gap"]
    assert len(gaps) >= 4 and all(r["end"] - r["begin"] == 30 for r in gaps)


def test_joined_hot_keys(spark):
    from starfield.llm.skew import joined

    left = spark.createDataFrame([(k, None if k % 11 == 0 else "hot" if k % 2 else f"k{k % 50}") for k in range(600)], "id long, key string")
    right = left.filter("key <> 'k4'").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).cache()
    want = {r["key"]: r["first"] for r in right.collect()}
    for parts in (3, 4096):
        got = joined(left, right, "key", "n", ["id"], parts).collect()
        assert sorted((r["id"], r["key"], r["first"]) for r in got) == sorted((r["id"], r["key"], want.get(r["key"])) for r in left.collect())


def test_op9_missing_records_are_an_error(spark, tmp_path):
    _, members = archive()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members[:3]) + members[3][:-20] + b"".join(members[4:]))
    manifest = spark.createDataFrame([(f"{tmp_path}/a.warc.gz", 6, 0, 0)], warc.MANIFEST)
    assert Counter(r["kind"] for r in warc.read_archives(manifest).collect()) == {"record": 5, "gap": 1}
    with pytest.raises(Exception, match="5 records read of 6 written"):
        warc.read_archives(manifest, whole=True).collect()


# 10 Classifier


def test_op10_held_out_accuracy(spark, monkeypatch):
    sf = "/root/testdata/sf0.1"
    labels = queries.labels(spark, sf)
    viewed = classifier.features(queries.documents(spark, sf))
    right, taught, exchange = [], [], classifier.exchanged

    def told(others, weights, slopes):
        bounds = exchange(others, weights, slopes)
        taught.append({k for k, bound in bounds.items() if bound is not None})
        return bounds

    monkeypatch.setattr(classifier, "exchanged", told)
    for rounds in (0, classifier.ROUNDS):
        model = classifier.trained(viewed, labels.filter("doc_id % 3 <> 0"), rounds=rounds)
        held = classifier.scored(viewed, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
        clean = [r["kept"] for r in held if r["quality"] == 1 and r["toxic"] == 0]
        bad = [r["kept"] for r in held if r["quality"] == 0]
        good, other = (np.array([r["score"] for r in held if (r["quality"] == 1 and r["toxic"] == 0) == x]) for x in (True, False))
        right.append(np.mean(good[:, None] > other))  # how often a clean document is above another one
        assert np.mean(clean) > 0.98 and np.mean(bad) < 0.3
    assert taught == [{"text", "meta"}] * classifier.ROUNDS  # both views are taught in every round
    assert right[1] >= right[0]


def test_op10_odd_rows(spark, odd):
    rows, df = odd
    labels = spark.createDataFrame([(8, 1, 0), (8, 1, None), (13, 0, None), (14, 0, 0), (None, 1, 0), (10, None, None), (12, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        found = classifier.classified(df, known).collect()
        assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in rows) and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["kept"] for r in found)
    assert classifier.classified(df.limit(0), labels).count() == 0
    model = classifier.trained(classifier.features(df), labels.limit(0))
    assert classifier.accepted(df, model).count() == len(rows)


def brute_co_training(docs, labels, rounds):
    """Dense matrices, all documents in one place."""
    x, known, names = {"text": [], "meta": []}, [], []
    for r in docs:
        viewed = classifier._viewed(pa.RecordBatch.from_pylist([r], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])), *utf8(pa.array([r["text"]])))
        text, meta = np.zeros(classifier.TEXT_SIZE), np.zeros(classifier.META_SIZE)
        text[: len(classifier.SHAPE)] = viewed.shape[0]
        text[len(classifier.SHAPE) + viewed.buckets.astype(int)] = 1
        for c in viewed.meta[0]:
            meta[c] += 1
        x["text"].append(text)
        x["meta"].append(meta)
        known.append(labels.get(r["doc_id"], np.nan))
        names.append(str(r["doc_id"]))
    x, known = {k: np.array(v) for k, v in x.items()}, np.array(known)
    order = np.array(sorted(np.flatnonzero(~np.isnan(known)), key=lambda k: names[k]))
    own, y, others = {k: v[order] for k, v in x.items()}, known[order], {k: v[np.isnan(known)] for k, v in x.items()}
    rare = (own["text"] > 0).sum(0) < classifier.LEAST_DOCUMENTS
    rare[: len(classifier.SHAPE)] = False
    own["text"][:, rare] = 0
    held = np.arange(len(y)) % 4 == 0
    weight = (~held).astype(float)
    for side in (0, 1):
        weight[~held & (y == side)] *= 0.5 * (~held).sum() / (~held & (y == side)).sum()
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(k, start, steps, at=None, gradient=0, curvature=0):
        w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
        for t in range(1, steps + 1):
            g = own[k].T @ (weight * (y - sigmoid(own[k] @ w))) / weight.sum() - classifier.RIDGE * w
            if at is not None:
                g -= gradient + curvature * (w - at)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w += 0.1 * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        return w

    w = {k: fit(k, np.zeros(n), classifier.STEPS) for k, n in classifier.SIZES.items()}
    taught = Counter()
    for _ in range(rounds):
        p, bounds, slopes = {k: sigmoid(others[k] @ w[k]) for k in w}, {}, {}
        for k in w:  # the least of a loss of one variable, by halving where its slope changes sign
            z, c = own[k][held] @ w[k], np.where(y[held] == 1, 0.5 / y[held].mean(), 0.5 / (1 - y[held].mean()))
            a, b = 0.0, 8.0
            for _ in range(80):
                t = (a + b) / 2
                a, b = (t, b) if (c * (y[held] - sigmoid(t * z))) @ z - (t - 1) > 0 else (a, t)
            slopes[k] = a
        for k, teacher in (("text", "meta"), ("meta", "text")):
            odds = others[teacher] @ w[teacher]
            ordered, n = np.sort(np.floor(np.clip(odds, -classifier.SCORES, classifier.SCORES) * classifier.BINS)), int(np.ceil(classifier.SUREST * len(odds)))
            binned = np.floor(np.clip(odds, -classifier.SCORES, classifier.SCORES) * classifier.BINS)
            sides = [np.flatnonzero((binned <= ordered[n - 1]) & (odds < 0)), np.flatnonzero((binned >= ordered[-n]) & (odds > 0))]
            if all(len(s) for s in sides):
                taught[k] += 1
                sure = [np.abs(2 * sigmoid(slopes[teacher] * odds[s]) - 1) for s in sides]
                g = sum(others[k][s].T @ (c * (p[k][s] - side)) / len(s) for side, (s, c) in enumerate(zip(sides, sure))) * classifier.GIVEN / 2
                h = sum(np.abs(others[k][s]).T @ (c * p[k][s] * (1 - p[k][s]) * np.abs(others[k][s]).sum(1)) / len(s) for s, c in zip(sides, sure)) * classifier.GIVEN / 2
                bounds[k] = (w[k], g * ~rare if k == "text" else g, h)
        w = {k: fit(k, w[k], classifier.MORE_STEPS, *bounds[k]) if k in bounds else w[k] for k in w}
    return w, taught


def test_op10_equals_brute_force(spark):
    r = np.random.default_rng(8)
    docs, labels = [], {}
    for d in range(200):
        good = int(r.integers(0, 2))
        words = [f"{'good' if good == (r.random() < 0.9) else 'bad'}{x}" for x in r.integers(0, 12, 30)]
        docs.append({"doc_id": d, "text": " ".join(words), "lang": "en", "source": ("clean" if good else "junk") + str(r.integers(0, 3)), "n_chars": 100})
        if d % 3 == 0:
            labels[d] = float(good)
    df = spark.createDataFrame(docs, DOCUMENT).repartition(5)
    known = spark.createDataFrame([(d, int(y), 0) for d, y in labels.items()], "doc_id long, quality int, toxic int")
    for rounds in (0, 2):
        want, taught = brute_co_training(docs, labels, rounds)
        assert not rounds or taught == {"text": 2, "meta": 2}
        model = classifier.trained(classifier.features(df), known, rounds=rounds)
        assert np.allclose(model.text, want["text"], atol=1e-6) and np.allclose(model.meta, want["meta"], atol=1e-6)


# Pipeline


def test_pipeline_equals_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ask = lambda name, df: stages[name](spark, df, sf_dir)
    good = ask("quality classifier", docs)
    assert good.columns == docs.columns
    verdict = {r["doc_id"]: r["kept"] for r in classifier.classified(docs, queries.labels(spark, sf_dir)).collect()}
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    assert set(texts) == {d for d, k in verdict.items() if k}

    one = ask("simhash near-dedup", docs)
    rows = rows_of(spark, sf_dir)
    prints = [brute_fingerprint(t) for _, t in rows]
    root, least = brute_components(prints), {}
    for (d, _), f in zip(rows, prints, strict=True):
        least[root[f]] = min(least.get(root[f], d), d)
    assert {r["doc_id"] for r in one.collect()} == set(least.values()) and one.columns == docs.columns

    cut = ask("substring dedup", docs)
    want = {d: (n - r, h) for d, n, r, h in brute_repeats(rows)}
    got = {r["doc_id"]: WORD.findall(r["text"] or "") for r in cut.collect()}
    assert all((len(w), hashlib.sha256(" ".join(w).encode()).hexdigest()) == want[d] for d, w in got.items())
    assert set(want) - set(got) == {d for (d, (n, _)), (_, t) in zip(sorted(want.items()), sorted(rows), strict=True) if not n and t}

    clean = ask("benchmark decontamination", docs)
    bad = {r[0] for r in brute_contamination(rows, rows_of(spark, sf_dir, "benchmark")) if r[5]}
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - bad
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def brute_stage(name, rows, items, accepted=None):
    """A stage on (doc_id, text) rows: the rows that it leaves."""
    if name == "simhash near-dedup":
        prints = [brute_fingerprint(t) for _, t in rows]
        root, best = brute_components(prints), {}
        text_id = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42) if t is not None else 42
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for (d, t), f in zip(rows, prints, strict=True):
            key = (d is None, d or 0, signed(f), signed(text_id(t)))
            if root[f] not in best or key < best[root[f]][0]:
                best[root[f]] = key, (d, t)
        return [row for _, row in best.values()]
    if name == "substring dedup":
        out = []
        holders = {}
        for d, t in rows:
            w = WORD.findall(t or "")
            for k in range(len(w) - 49 if d is not None else 0):
                holders[tuple(w[k : k + 50])] = min(holders.get(tuple(w[k : k + 50]), d), d)
        for d, t in rows:
            w, gone = WORD.findall(t or ""), set()
            for k in range(len(w) - 49 if d is not None else 0):
                if holders[tuple(w[k : k + 50])] < d:
                    gone |= set(range(k, k + 50))
            spans = [m.span() for m in WORD.finditer(t or "")]
            runs, left = [], []
            for k in range(len(w)):
                if k not in gone:
                    if runs and runs[-1][1] == k - 1:
                        runs[-1][1] = k
                    else:
                        runs.append([k, k])
            left = " ".join(t[spans[a][0] : spans[b][1]] for a, b in runs)
            if not gone or left:
                out.append((d, left if gone else t))
        return out
    verdicts = defaultdict(list)
    for row in rows:
        verdicts[row].append(brute_contamination([row], items)[0][5])
    return [row for row in rows if not verdicts[row][0]]


def test_pipeline_chain_equals_brute_force(spark, odd, sf_dir):
    """Every stage on what the one before left, on odd rows with shared and missing ids; then the tokens of the product."""
    import corpus_pipeline

    items = rows_of(spark, sf_dir, "benchmark")
    spoiled = max(items, key=lambda x: len(x[1] or ""))[1]
    rows = [*odd[0], (None, "clean one without an id"), (None, spoiled), (3, spoiled), (3, "another text under three"), (40, "shared id first text"), (40, "quite another text with this id"), (41, "shared id first text")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCUMENT)
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, sf_dir)
    left = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert not Counter(left) - Counter(rows)
    left = rows
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in left], DOCUMENT)
        found = [(r["doc_id"], r["text"]) for r in stage(spark, df, sf_dir).collect()]
        left = brute_stage(name, left, items)
        assert Counter(found) == Counter(left), name
    assert (None, "clean one without an id") in left and (3, "another text under three") in left and (40, "quite another text with this id") in left
    assert spoiled not in {t for _, t in left}
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in left], DOCUMENT)
    check_pieces(stages["packing"](spark, df, sf_dir).collect(), left)


def test_pipeline_stages_take_odd_rows(spark, odd, sf_dir):
    import corpus_pipeline

    docs = odd[1].select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, sf_dir)
            assert (out.count() > 0) == (df is docs), name
