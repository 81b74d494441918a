"""Every operator against brute force, on texts with nulls, blanks, long runs, copies and clashing columns."""

import hashlib
import io
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronofold.llm import bpe, chat, exact, graph, langid, media, packing, phrases, quality, recurrence, simhash, similar, suffix
from chronofold.llm.shared import Scratch, mark, release, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, u long, _low string, _text string, h string, doc string, th int, spans string, _row int"


def _texts():
    rng = random.Random(3)
    words = ["the", "of", "été", "ß", "Über", "año", "x1", "ZEBRA", "in", "tion", "漢字", "😀", "a.b", "!!"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    passage = prose(60)
    base = prose(120)
    out = [None, "", " \t\n", "a", "one two", "one  two", "one\ttwo ", "A B c", prose(50), prose(51)]
    out += [base, base, base.upper(), base + " tail", "head " + base]
    out += [prose(30) + " " + passage + " " + prose(20), prose(5) + "\n" + passage + " " + prose(70), passage]
    out += ["ab" * 900, "x" * 3000, ("line of text\n") * 80, prose(9000), passage + " " + passage]
    out += ["é" * 300, "<|endoftext|> and <|im_end|>", " nbsp ", "\x0b\x0c sep \x1c x"]
    return out


@pytest.fixture(scope="module")
def rows():
    out = []
    for k, t in enumerate(_texts()):
        lang = [None, "en", "fr"][k % 3]
        out.append((k * 7 % 31, t, lang, [None, "s1"][k % 2], None if t is None else len(t), 5, 6, "low", "own", "h", "d", 1, "s", 9))
    out.append(out[10])  # a repeated row
    out.append((None, "a row without an id", "en", "s", 3, *out[0][5:]))
    out.append((11, "an id twice, other text", "en", "s", 3, *out[0][5:]))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_scratch_tables_go(spark, docs, monkeypatch):
    """What a query leaves goes by ``release``; an unset folder is an error on a cluster."""
    release()
    folder = shared_dir(spark)
    for query in (lambda s: simhash.near_groups(docs, s), lambda s: phrases.remove_repeated_words(docs, s), lambda s: packing.pack_documents(docs, s)):
        begin = mark()
        query(Scratch(spark, "gone")).collect()
        assert any(x.startswith("gone-") for x in os.listdir(folder))
        release(begin)
        assert not any(x.startswith("gone-") for x in os.listdir(folder))
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: None)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(spark)


def _brute_groups(rows, norm):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1] or "")].append(r[0])
    return groups


def _norm(t):
    import re

    return re.sub("[\\x20\\x09-\\x0D]+", " ", t)


def test_exact_groups(spark, docs, rows, empty):
    groups = _brute_groups(rows, _norm)
    low = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expect = Counter((r[0], low[t], len(groups[t]), r[0] == low[t], hashlib.sha256(t.encode()).hexdigest()) for r in rows for t in [_norm(r[1] or "")])
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert _rows(exact.exact_groups(docs, Scratch(spark, "t")), *names) == expect
    weak = exact.exact_groups(docs, Scratch(spark, "t"), digest=lambda c: F.substring(F.sha2(c, 256), 1, 1))  # digests collide
    assert _rows(weak, *names[:4]) == Counter(x[:4] for x in expect.elements())
    assert exact.exact_groups(empty, Scratch(spark, "t")).count() == 0
    kept = exact.exact_dedup(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert Counter(_norm(r["text"] or "") for r in kept.collect()) == Counter(set(groups))
    assert exact.exact_dedup(empty, Scratch(spark, "t")).count() == 0


def _brute_print(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def _components(prints, budget=2):
    nodes = sorted(set(prints.values()))
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                parent[find(b)] = find(a)
    return {n: find(n) for n in nodes}


def test_simhash_groups(spark, docs, rows, empty):
    prints = {k: _brute_print(r[1]) for k, r in enumerate(rows)}
    root = _components(prints)
    low = {}
    for k, r in enumerate(rows):
        c = root[prints[k]]
        if r[0] is not None:
            low[c] = min(low.get(c, r[0]), r[0])
    expect = Counter((r[0], f"{prints[k]:016x}", low.get(root[prints[k]])) for k, r in enumerate(rows))
    assert _rows(simhash.near_groups(docs, Scratch(spark, "t")), "doc_id", "fingerprint", "component_id") == expect
    assert simhash.near_groups(empty, Scratch(spark, "t")).count() == 0
    kept = simhash.near_dedup(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns and set(low.values()) <= {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize(("bucket", "budget"), [(32, 2), (2, 2), (1, 2), (32, 0), (1, 1), (1, 3), (32, 3), (1, 4), (1, 5), (32, 6)])
def test_simhash_links_lose_nothing(spark, bucket, budget):
    rng = random.Random(bucket)
    nodes = set()
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(10):
            y = x
            for _ in range(rng.randrange(2 * budget + 1)):
                y ^= 1 << rng.randrange(64)
            nodes.add(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = spark.createDataFrame([(signed(x),) for x in nodes], "fp long")
    links = [(r["u"], r["v"]) for r in simhash.links(prints, Scratch(spark, "t"), budget, bucket).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= budget for a, b in links)
    root = _components(dict(enumerate(nodes)), budget)
    from chronofold.llm.graph import components

    edges = spark.createDataFrame(links, "u long, v long")
    found = {r["node"]: r["root"] for r in components(edges, Scratch(spark, "t")).collect()}
    group = defaultdict(set)
    for x in nodes:
        group[root[x]].add(signed(x))
    for members in group.values():
        assert {found.get(x, x) for x in members} == {min(members)}


def test_too_wide_a_budget(spark):
    with pytest.raises(ValueError, match="budget"):
        simhash.links(spark.createDataFrame([], "fp long"), Scratch(spark, "t"), simhash.WIDEST + 1)


def test_near_dedup_keeps_one_row_of_each_group(spark, docs, rows):
    """Also where keys repeat with different texts or are null; of rows with the least key the one of the least hash."""
    prints = {k: _brute_print(r[1]) for k, r in enumerate(rows)}
    root = _components(prints)
    hashes = spark.createDataFrame(rows, SCHEMA).select(F.xxhash64(*docs.columns).alias("h")).collect()
    best = {}
    for k, r in enumerate(rows):
        rank = (r[0] is None, r[0] or 0, hashes[k][0])
        best[root[prints[k]]] = min(best.get(root[prints[k]], (rank, r[:2])), (rank, r[:2]), key=lambda x: x[0])
    kept = simhash.near_dedup(docs, Scratch(spark, "t"))
    assert _rows(kept, "doc_id", "text") == Counter(r for _, r in best.values())
    same = spark.createDataFrame([(5, "Hello world"), (5, "hello world"), (3, "other"), (5, "OTHER"), (None, "x y"), (None, "X Y")], "doc_id long, text string")
    assert sorted(r["text"].lower() for r in simhash.near_dedup(same, Scratch(spark, "t")).collect()) == ["hello world", "other", "x y"]


def _similar(texts):
    """Component of each text by comparing all sets of 5-word shingles; A-Z in lower case, the six ASCII spaces part words."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and (a or not sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def _near_copies():
    """Chains of edited texts, one large group of copies of a text, and a line that most texts have."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    line = " ".join(word() for _ in range(9))
    out = [None, "", " ", "a", "A", "one two three", "one  TWO three"]
    for k in range(30):
        text = [word() for _ in range(rng.choice([6, 12, 30, 60, 200]))]
        for _ in range(60 if k == 0 else rng.randrange(1, 8)):
            text = [*text]
            for _ in range(rng.randrange(1 + len(text) // 25)):
                text[rng.randrange(len(text))] = word()
            out.append(" ".join(text) + (f"\n{line}" if rng.random() < 0.6 else ""))
    return out


@pytest.mark.parametrize(("bucket", "sample"), [(32, 20_000), (4, 20_000), (1, 20_000), (1, 10)])
def test_similar_groups(spark, monkeypatch, bucket, sample):
    monkeypatch.setattr(similar, "SAMPLE", sample)
    texts = _near_copies()
    expect = dict(enumerate(_similar(texts)))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(table, Scratch(spark, "t"), bucket=bucket).collect()}
    assert found == expect and len(set(expect.values())) < 0.7 * len(expect)


def test_similar_dedup(spark, docs, rows, empty):
    group = _similar([r[1] for r in rows])
    least = {g: min((r[0] is None, r[0] or 0) for r, x in zip(rows, group, strict=True) if x == g) for g in set(group)}
    kept = similar.similar_dedup(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == Counter(least.values())
    assert similar.similar_dedup(empty, Scratch(spark, "t")).count() == 0


def test_pipeline_leaves_no_near_copies(spark):
    import corpus_pipeline

    texts = _near_copies()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, table, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(_similar(texts)))


def test_crowded_near_copies_make_few_pairs(spark, monkeypatch):
    """Copies with edits of their own: what the last comparison confirms doesn't grow with the square of their number."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for n in range(160):
        text = [*base]
        for k in rng.sample(range(5, 145), 1 + n % 6):
            text[k] = f"own{n}-{k}"
        texts.append(" ".join(text))
    # An edit of a far copy links to that copy only.
    texts += [texts[n].replace("w149", "other") for n in range(5, 160, 12)]
    met = {}
    confirmed = similar._confirmed

    def count(pairs, nodes, own, scratch, name, size):
        met[name] = pairs.distinct().count()
        return confirmed(pairs, nodes, own, scratch, name, size)

    monkeypatch.setattr(similar, "_confirmed", count)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(table, Scratch(spark, "t")).collect()}
    assert found == dict(enumerate(_similar(texts)))
    assert 30 < len(set(found.values())) < len(texts)
    assert met[f"turn{similar.TURNS}"] < 2 * len(texts)


def test_shingles_of_all_documents_are_counted(spark):
    texts = [*_near_copies(), *["one line that all have at the end"] * 40]
    counts = Counter(int(x) % similar.COUNTERS for t in texts for x in similar.shingles(t))
    expect = np.zeros(similar.COUNTERS)
    expect[list(counts)] = list(counts.values())
    table = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(3)
    for batch_docs in (7, 20_000):
        assert (similar._ranks(table, 5, batch_docs) == np.rint(8 * np.log2(expect + 1))).all()
    assert not similar._ranks(table.where("false"), 5, 10).any()


def test_families_by_their_centre(spark):
    """Links and candidates connect what is similar, in families of any mixture, whatever the component of the centre."""
    rng = random.Random(6)
    for _ in range(4):
        sets, base = [], [rng.sample(range(1, 1 << 40), rng.choice([4, 20, 60])) for _ in range(3)]
        for _ in range(70):
            own = [*rng.choice(base)]
            for _ in range(rng.randrange(1 + len(own) // 6)):
                own[rng.randrange(len(own))] = rng.choice([rng.randrange(1, 1 << 40), rng.choice(rng.choice(base))])
            sets.append(frozenset(own[: rng.randrange(len(own) - len(own) // 8, len(own) + 1)]))
        sets = sorted(set(sets), key=sorted)
        root = [rng.choice([0, 0, k]) for k in range(len(sets))]
        rows = spark.createDataFrame([(0, k, root[k], len(x)) for k, x in enumerate(sets)], "family long, node long, root long, size int")
        values = spark.createDataFrame([(k, np.array(sorted(x), np.uint64).tobytes()) for k, x in enumerate(sets)], "node long, value binary")
        stars, pairs = similar._by_centre(rows, values, Scratch(spark, "t"))
        alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
        stars, pairs = ({(r["u"], r["v"]) for r in x.collect()} for x in (stars, pairs))
        assert all(alike(*x) for x in stars)
        reach = list(range(len(sets)))
        joined = [(k, r) for k, r in enumerate(root)] + [*stars] + [x for x in pairs if alike(*x)]
        for _ in reach:
            for a, b in joined:
                reach[a] = reach[b] = min(reach[a], reach[b])
        assert all(reach[a] == reach[b] for a in range(len(sets)) for b in range(a) if alike(a, b))


def test_components_of_a_long_chain(spark):
    from chronofold.llm.graph import components

    chain = [(k, k + 1) for k in range(60)] + [(100, 100), (200, 201)]
    found = components(spark.createDataFrame(chain, "u long, v long"), Scratch(spark, "t"))
    got = {r["node"]: r["root"] for r in found.collect()}
    assert got == {k: 0 for k in range(61)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def _brute_cover(seqs, w):
    met = Counter(s[i : i + w] for s in seqs for i in range(len(s) - w + 1))
    out = []
    for s in seqs:
        mark = [False] * len(s)
        for i in range(len(s) - w + 1):
            if met[s[i : i + w]] > 1:
                mark[i : i + w] = [True] * w
        out.append(mark)
    return out


_PERIODIC = ["ab" * 120, "a" * 5000, "a" * 700 + "b" + "a" * 700, "".join(f"{k} " for k in range(1000, 1700)) * 3, "word " * 400, "x y z " * 300 + "end " + "y z x " * 90]


def _bytes_expected(rows, window):
    seqs = [(r[1] or "").encode() for r in rows]
    expect = Counter()
    for r, s, m in zip(rows, seqs, _brute_cover(seqs, window), strict=True):
        spans = sum(1 for i, x in enumerate(m) if x and (i == 0 or not m[i - 1]))
        expect[(r[0], len(s), sum(m), spans, bytes(b for b, x in zip(s, m, strict=True) if not x))] += 1
    return expect


def _bytes_found(table, scratch, **how):
    found = suffix.remove_repeated_bytes(table, scratch, **how).collect()
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found)


def _words_expected(rows, window):
    seqs = [tuple((r[1] or "").encode().split()) for r in rows]
    marks = _brute_cover(seqs, window)
    return Counter((r[0], len(s), sum(m), b" ".join(x for x, y in zip(s, m, strict=True) if not y).decode()) for r, s, m in zip(rows, seqs, marks, strict=True))


@pytest.mark.parametrize(("window", "anchor", "cell"), [(200, 32, 512), (40, 16, 64), (33, 32, 50), (200, 32, 7)])
def test_repeated_bytes(spark, docs, rows, empty, window, anchor, cell, monkeypatch):
    monkeypatch.setattr(suffix, "CELL", cell)
    assert _bytes_found(docs, Scratch(spark, "t"), window=window, anchor=anchor) == _bytes_expected(rows, window)
    assert suffix.remove_repeated_bytes(empty, Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("longest", [2048, 100])
def test_repeats_in_periodic_text(spark, longest, monkeypatch):
    """Each periodic text by itself, and all together; few runs stand for many windows."""
    monkeypatch.setattr(recurrence, "LONGEST", longest)
    for texts in (_PERIODIC[:1], _PERIODIC[2:3], _PERIODIC):
        rows = list(enumerate(texts))
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        assert _bytes_found(table, Scratch(spark, "t")) == _bytes_expected(rows, 200)
        found = phrases.remove_repeated_words(table, Scratch(spark, "t"))
        assert _rows(found, "doc_id", "n_words", "n_removed", "kept") == _words_expected(rows, 35)
    block = recurrence.Block(np.frombuffer(b"a" * 100_000, np.uint8), np.array([0, 100_000]), "bytes")
    assert len(recurrence.runs(block.values, block.first, 200, 32)[1]) <= 100_000 // longest + 1


def _near_misses(n, seed, words=False):
    """Many texts around one common passage: copies of it, cut and edited at every distance."""
    rng = random.Random(seed)
    core = [f"c{k}" for k in range(60)]
    out = []
    for _ in range(n):
        a, b = rng.randrange(20), rng.randrange(30, 60)
        part = core[a:b]
        if rng.random() < 0.5:
            part[rng.randrange(len(part))] = f"edit{rng.randrange(40)}"
        left, right = ([f"{x}{rng.randrange(6)}" for _ in range(rng.randrange(4))] for x in "lr")
        out.append(" ".join(left + part + right))
    return list(enumerate(out))


def test_many_surroundings_of_one_anchor(spark):
    rows = _near_misses(1500, 1)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = phrases.remove_repeated_words(table, Scratch(spark, "t"), window=25)
    assert _rows(found, "doc_id", "n_words", "n_removed", "kept") == _words_expected(rows, 25)
    assert _bytes_found(table, Scratch(spark, "t"), window=100) == _bytes_expected(rows, 100)


def test_judges_decide(spark, docs, monkeypatch):
    """Nothing goes by hashes alone: without the judges' finds nothing is removed."""
    blind = lambda batch, units: [np.zeros(1, bool) for _ in batch.own]
    monkeypatch.setattr(suffix, "judge", blind)
    monkeypatch.setattr(phrases, "judge", blind)
    assert suffix.remove_repeated_bytes(docs, Scratch(spark, "t")).where("n_removed > 0").isEmpty()
    assert phrases.remove_repeated_words(docs, Scratch(spark, "t")).where("n_removed > 0").isEmpty()


def test_clashing_hashes(spark, docs, rows, monkeypatch):
    """Hashes of a few bits make cells meet for nothing, and remove nothing for it."""
    expect = _bytes_expected(rows, 200)
    found = _bytes_found(docs, Scratch(spark, "t"))
    assert found == expect
    weak = recurrence.find_runs
    monkeypatch.setattr(recurrence, "find_runs", lambda d, u: weak(d, u).withColumn("s", F.pmod("s", F.lit(4))))
    for r in suffix.remove_repeated_bytes(docs, Scratch(spark, "t")).collect():
        whole = [x for x in expect if x[0] == r["doc_id"] and x[1] == r["n_bytes"]]
        assert r["n_removed"] <= max(x[2] for x in whole)


def test_strip_repeated_bytes(spark, docs, rows, empty):
    marks = _brute_cover([(r[1] or "").encode() for r in rows], 200)
    expect = Counter()
    for r, m in zip(rows, marks, strict=True):
        text = None if r[1] is None else bytes(b for b, x in zip(r[1].encode(), m, strict=True) if not x).decode("utf-8", "ignore")
        expect[(r[0], text, len(text) if any(m) else r[4], r[7])] += 1
    found = suffix.strip_repeated_bytes(docs, Scratch(spark, "t"))
    assert found.columns == docs.columns
    assert _rows(found, "doc_id", "text", "n_chars", "_low") == expect
    assert suffix.strip_repeated_bytes(empty, Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize(("window", "anchor", "cell"), [(35, 8, 128), (5, 4, 16), (35, 8, 3)])
def test_repeated_words(spark, docs, rows, empty, window, anchor, cell, monkeypatch):
    monkeypatch.setattr(phrases, "CELL", cell)
    found = phrases.remove_repeated_words(docs, Scratch(spark, "t"), window=window, anchor=anchor)
    assert _rows(found, "doc_id", "n_words", "n_removed", "kept") == _words_expected(rows, window)
    assert phrases.remove_repeated_words(empty, Scratch(spark, "t")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=6), st.integers(3, 12))
def test_interval_expansion(texts, window):
    met = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    found = suffix.recurring_windows(texts, window)
    for t, mask in zip(texts, found, strict=True):
        assert mask.tolist() == [met[t[i : i + window]] > 1 for i in range(len(t) - window + 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=80).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=4), st.integers(3, 12), st.randoms())
def test_pieces_of_one_text(texts, window, rng):
    """Cells and partners cut anywhere from the same texts: no place counts for itself."""
    units = recurrence.Units("bytes", window, 2, 64, (1,))
    met = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    pieces = [(k, 0, a, t[a : a + 20 + window - 1]) for k, t in enumerate(texts) for a in range(0, max(1, len(t) - window + 1), 20)]
    partners = []
    for _ in pieces:
        n = rng.randrange(1, 9)  # windows of a cut, which may reach into the next
        partners.append([(k, 0, a, t[a : a + n + window - 1 + rng.randrange(5)]) for k, t in enumerate(texts) for a in range(0, len(t) - window + 1, n)])
    for (k, _, a, text), mask in zip(pieces, suffix.judge(recurrence.Batch(pieces, partners, set()), units), strict=True):
        assert mask.tolist() == [met[text[i : i + window]] > 1 for i in range(len(text) - window + 1)], (k, a)


def _batch_of(texts):
    """Every text meets all; the first windows are 0."""
    own = [(k, 0, 0, x) for k, x in enumerate(texts)]
    return recurrence.Batch(own, [own] * len(own), set())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"bb", b"c"]), min_size=4, max_size=30), min_size=1, max_size=5), st.integers(1, 3))
def test_phrase_automata(lists, shard):
    texts = [b" ".join(x) for x in lists]
    units = recurrence.Units("words", 4, 2, 128, (1,))
    found = phrases.judge(_batch_of(texts), units, shard)
    seqs = [tuple(t.split()) for t in texts]
    met = Counter(s[i : i + 4] for s in seqs for i in range(len(s) - 3))
    for s, mask in zip(seqs, found, strict=True):
        assert mask.tolist() == [met[s[i : i + 4]] > 1 for i in range(len(s) - 3)]


def test_automata_tell_any_number_of_words_apart():
    """More different words in one batch than there are code points."""
    words = [b"w%d" % k for k in range(1_250_000)]
    tail = words[-40:]
    texts = [(0, 0, 0, b" ".join(words)), (1, 0, 0, b" ".join([b"x", *tail, b"y"]))]
    batch = recurrence.Batch(texts, [[texts[1]], [texts[1]]], set())
    units = recurrence.Units("words", 35, 8, 128, (1,))
    first, second = phrases.judge(batch, units)
    assert np.flatnonzero(first).tolist() == list(range(len(words) - 40, len(words) - 34)) and not second.any()


def test_runs_see_every_window():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 4, 5000).astype(np.uint64)
    first = np.array([0, 3, 3, 900, 2500, 5000])
    _, at, size, _ = recurrence.runs(recurrence._mixed(values + np.uint64(1)), first, 50, 8)
    covered = sorted(i for a, n in zip(at, size, strict=True) for i in range(a, a + n))
    assert covered == [i for a, b in zip(first, first[1:], strict=False) for i in range(a, b - 49)]


@pytest.mark.parametrize("leaf", [bpe.LEAF, 40])
def test_encode_and_decode(docs, rows, empty, leaf):
    ref = Tokenizer.from_file(bpe.VOCABULARY)
    ids = lambda t: ref.encode(t or "", add_special_tokens=False).ids
    expect = Counter((r[0], np.array(ids(r[1]), "<u4").tobytes(), ref.decode(ids(r[1]), skip_special_tokens=False)) for r in rows)
    got = Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in bpe.decode(bpe.encode(docs, leaf=leaf)).collect())
    assert got == expect
    assert bpe.encode(empty).count() == 0


_PIECES = st.one_of(st.text("ab ", max_size=30), st.text(max_size=12), st.sampled_from(["<|endoftext|>", "<|endof", "'s", " " * 9, "\n\n ", "x" * 50, "123 4"]))


@settings(max_examples=200, deadline=None)
@given(st.lists(_PIECES, max_size=8).map("".join), st.integers(1, 40))
def test_tree_concatenation(text, leaf):
    c = bpe.codec()
    ref = c.encode(text)
    assert bpe.concatenate([(x, c.encode(x)) for x in bpe.leaves(text, leaf)], c) == ref


def _script(alphabet, gap, stop, n=60_000):
    rng = random.Random(len(alphabet))
    out = []
    while sum(map(len, out)) < n:
        out.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 9))) + (stop if rng.random() < 0.1 else "") + gap)
    return "".join(out)


@pytest.mark.parametrize("text", [
    _script("abcdefghij", " ", "."), _script("абвгдежзик", " ", "."), _script([chr(k) for k in range(0x4E00, 0x4F00)], "", "。"),
    _script("0123456789", ",", "."), _script("कखगचिीु", " ", "।"), " " * 40_000 + "x", "?!" * 20_000,
], ids=["latin", "cyrillic", "chinese", "digits", "devanagari", "spaces", "marks"])
def test_joins_encode_little_again(text):
    """Joins agree with the tokenizers library in every script, and encode under 5 % of the text again."""
    c = bpe.codec()
    parts = [(x, c.encode(x)) for x in bpe.leaves(text, 2048)]
    c.again = 0
    found = bpe.concatenate(parts, c)
    assert len(parts) >= 16 and found == Tokenizer.from_file(bpe.VOCABULARY).encode(text, add_special_tokens=False).ids
    assert c.again < 0.05 * len(text.encode())


_MIXED = st.lists(st.sampled_from([*"ab 12.!éя漢。'\n\t", "  ", "'s", "'ll", "😀", "\u0301", "\x1c", "\xa0", "²", "क", "ि", "<|endoftext|>", "<|end"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(_MIXED, st.integers(1, 12), st.integers(1, 8))
def test_joins_in_any_script(text, leaf, window):
    c = bpe.codec()
    parts = [(x, c.encode(x)) for x in bpe.leaves(text, leaf)]
    whole, ids = parts[0]
    for x, more in parts[1:]:
        whole, ids = whole + x, bpe.join((whole, ids), (x, more), c, window)
    assert ids == c.encode(text)


def test_packing(spark, docs, rows, empty):
    ref = Tokenizer.from_file(bpe.VOCABULARY)
    for capacity, block in ((2048, 8192), (64, 40)):
        found = packing.pack_documents(docs, Scratch(spark, "t"), capacity, search=packing.Search(block=block)).collect()
        total = sum(r["length"] for r in found)
        sequences = defaultdict(list)
        for r in found:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(sequences) <= -(-total // capacity) + 2
        expect = Counter()
        for r in rows:
            ids = [*ref.encode(r[1] or "", add_special_tokens=False).ids, 0]
            edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                expect[(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expect
    assert packing.pack_documents(empty, Scratch(spark, "t")).count() == 0


def _cut_bins(bins, rng, capacity=2048):
    """Sizes cut from exactly full bins, three of at least a quarter each: best fit is poor at these."""
    sizes = []
    for _ in range(bins):
        a = int(rng.integers(780, 980))
        b = int(rng.integers(512, (capacity - a) // 2 + 1))
        sizes += [a, b, capacity - a - b]
    return rng.permutation(sizes).tolist()


@pytest.mark.parametrize("bins", [60, 250])
def test_genetic_search_beats_best_fit(bins):
    """Islands with migration find the optimum or one sequence more, best-fit decreasing a sixth more."""
    sizes = _cut_bins(bins, np.random.default_rng(bins))
    how = packing.Search()
    plain = len(packing.pack(sizes, packing._down(sizes, range(len(sizes))), 2048).items)
    found = [packing.evolve(sizes, 2048, how, k, 0, []) for k in range(how.islands)]
    for epoch in range(1, how.epochs):
        found = [packing.evolve(sizes, 2048, how, k, epoch, [found[k], found[k - 1]]) for k in range(how.islands)]
    for grouping in found:
        assert len(grouping) == len(sizes) and np.bincount(grouping, weights=sizes).max() <= 2048
    assert min(len(set(x)) for x in found) <= bins + 1 < 1.1 * bins < plain


def test_genetic_search_in_the_query(spark):
    """Also through blocks, islands in tasks and migration."""
    sizes = _cut_bins(400, np.random.default_rng(5))
    parts = spark.createDataFrame(list(enumerate(sizes)), "pid long, length long")
    found = packing.pack_pieces(parts, Scratch(spark, "t"), 2048, packing.Search(block=512)).collect()
    lengths = defaultdict(int)
    for r in found:
        lengths[r["sequence_id"]] += sizes[r["pid"]]
    assert sorted(r["pid"] for r in found) == list(range(len(sizes))) and max(lengths.values()) <= 2048
    plain = len(packing.pack(sizes, packing._down(sizes, range(len(sizes))), 2048).items)
    assert len(lengths) <= 404 < plain


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(0, 5))
def test_genetic_search_keeps_every_piece(sizes, seed):
    how = packing.Search(generations=6, seed=seed)
    first = packing.evolve(sizes, 100, how, 0, 0, [])
    second = packing.evolve(sizes, 100, how, 1, 1, [first, first])
    for grouping in (first, second):
        assert len(grouping) == len(sizes) and np.bincount(grouping, weights=sizes).max() <= 100
    assert len(set(second)) <= len(set(first)) <= len(packing.pack(sizes, packing._down(sizes, range(len(sizes))), 100).items)


def test_media(docs, rows, empty):
    found = media.media_features(media.text_media(docs)).collect()
    expect = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
        expect[(r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == expect
    assert media.media_features(media.text_media(empty)).count() == 0


def _plain_file(text):
    """The file, its tile and its hash of a text, pixel by pixel."""
    b = (text or "").encode()
    p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
    kind = ("pgm", "ppm", "bmp")[zlib.crc32(p) % 3]
    if kind == "pgm":
        high, data = len(p) // 24, b"P5\n24 %d\n255\n" % (len(p) // 24) + p
        grey = [[float(p[24 * y + x]) for x in range(24)] for y in range(high)]
    else:
        high = len(p) // 72
        grey = [[sum(p[72 * y + 3 * x + k] for k in range(3)) / 3 for x in range(24)] for y in range(high)]
        data = b"P6\n24 %d\n255\n" % high + p
        if kind == "bmp":
            rows = b"".join(bytes(p[72 * y + 3 * x + k] for x in range(24) for k in (2, 1, 0)) for y in reversed(range(high)))
            n = lambda v, size=4: v.to_bytes(size, "little")
            data = b"BM" + n(54 + len(rows)) + n(0) + n(54) + n(40) + n(24) + n(high) + n(1, 2) + n(24, 2) + n(0) + n(len(rows)) + n(2835) * 2 + n(0) * 2 + rows
    total, weight = np.zeros((8, 9)), np.zeros((8, 9))
    for y in range(high):
        for x in range(24):
            for i in range(int(y * 8 / high), min(8, int(np.ceil((y + 1) * 8 / high)))):
                for j in range(int(x * 9 / 24), min(9, int(np.ceil((x + 1) * 9 / 24)))):
                    dy = min((y + 1) * 8 / high, i + 1) - max(y * 8 / high, i)
                    dx = min((x + 1) * 9 / 24, j + 1) - max(x * 9 / 24, j)
                    if dy > 0 and dx > 0:
                        total[i, j] += dy * dx * grey[y][x]
                        weight[i, j] += dy * dx
    return data, total / weight


def test_media_files_and_hashes(docs, rows):
    """The stored form byte for byte, and the tile and hash from plain area means."""
    expect = Counter()
    tiles = {}
    for r in rows:
        data, tile = _plain_file(r[1])
        tiles[hashlib.sha256(data).hexdigest()] = tile = np.rint(tile.round(6)).astype(int)  # halves to even
        bits = "".join(str(int(tile[i, j] < tile[i, j + 1])) for i in range(8) for j in range(8))
        expect[(r[0], len(data), hashlib.sha256(data).hexdigest(), f"{int(bits, 2):016x}")] += 1
    found = media.media_features(media.text_media(docs)).collect()
    assert Counter((r["doc_id"], r["media_bytes"], r["media_sha256"], r["feature"]) for r in found) == expect
    for r in found:
        assert (np.load(io.BytesIO(r["tile_npy"])) == tiles[r["media_sha256"]]).all() and r["media_error"] is None


_BROKEN = [b"", b"P5", b"P5\n3 3\n255\n12", b"P2 2 1 255 7 x", b"BM", b"BM" + bytes(60), b"P6\n# no end", b"P5 -1 2 255 ", b"P5\n0 3\n255\n", b"\xff\x00", media.encode_bmp(np.zeros((3, 5), np.uint8))[:-1], b"P2 1 1 9 10"]


def test_broken_files(spark):
    """A file that can't be read gives a reason, not a failed job; clashing columns are replaced."""
    good = media.encode_netpbm(np.zeros((2, 2), np.uint8))
    rows = [(k, b, "clash") for k, b in enumerate([*_BROKEN, None, good])]
    found = media.media_features(spark.createDataFrame(rows, "id int, media binary, feature string")).collect()
    for r in found:
        b = rows[r["id"]][1]
        if b is None or b == good:
            assert r["media_error"] is None and (r["feature"] is None) == (b is None)
        else:
            assert r["media_error"] and r["feature"] is None and r["payload_sha256"] is None
            assert (r["media_bytes"], r["media_sha256"]) == (len(b), hashlib.sha256(b).hexdigest())


@pytest.mark.parametrize("shape", [(3, 5), (4, 7, 3), (1, 1), (8, 24, 3)])
def test_media_round_trip(shape):
    samples = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    assert (media.decode_media(media.encode_netpbm(samples)) == samples).all()
    assert (media.decode_media(media.encode_bmp(samples)) == samples).all()
    plain = b"P2 # note\n2 1 255\n7 9\n"
    assert media.decode_media(plain).tolist() == [[7, 9]]


def test_area_resize():
    grey = np.arange(48.0).reshape(6, 8)
    assert np.allclose(media.area_resize(grey, 3, 4), grey.reshape(3, 2, 4, 2).mean((1, 3)))
    wide = np.kron(grey, np.ones((5, 9)))  # any target's cells are whole in a grid that both divide
    assert np.allclose(media.area_resize(grey, 5, 9), wide.reshape(5, 6, 9, 8).mean((1, 3)))
    tile = np.load(__import__("io").BytesIO(media.npy_tile(grey.astype(np.uint8))))
    assert (tile == grey).all()


def test_language(spark, docs, rows, empty):
    learned = {r[2] for r in rows if r[2]}
    for r in langid.language_id(docs).collect():
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["lang_pred"] in learned | {"und"} and 0 <= r["score"] <= 1
    got = {r["doc_id"]: r["lang_pred"] for r in langid.language_id(docs.where("text is null or trim(text) = ''")).collect()}
    assert set(got.values()) == {"und"}
    assert langid.language_id(empty).count() == 0
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = langid.language_id(table).where("held_out").join(table, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()


def _plain_profile(text, space, table, code):
    """Letters one by one: a gap is one 0, n-grams bind by position and are added up."""
    seq = []
    for ch in text or "":
        k = code(ch)
        if k or not seq or seq[-1]:
            seq.append(k)
    total = np.zeros(space.dims)
    for k in range(len(seq) - space.gram + 1):
        bound = np.ones(space.dims)
        for j in range(space.gram):
            bound *= np.roll(table[seq[k + j]].astype(float), space.gram - 1 - j)
        total += bound
    return total, any(seq)


@pytest.mark.parametrize("part", [langid.PART, 64])
def test_language_equals_plain_python(spark, docs, rows, part, monkeypatch):
    """Every prediction and score, also where texts go through in parts."""
    monkeypatch.setattr(langid, "PART", part)
    space = langid.Space(dims=96)
    p = langid.Profiler(space)
    code = lambda ch: 0 if not ch.isalpha() else ord(ch.lower()[0]) - 96 if "a" <= ch.lower()[0] <= "z" else 27 + ord(ch.lower()[0]) % (space.letters - 27)
    unit = lambda v: v / (np.sqrt((v**2).sum()) or 1)
    vectors = [_plain_profile(r[1], space, p.table, code) for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    names = sorted({r[2] for r, h, (_, some) in zip(rows, held, vectors, strict=True) if r[2] and not h and some})
    centre = [unit(sum(np.rint(unit(v) * 1e6) for r, h, (v, some) in zip(rows, held, vectors, strict=True) if r[2] == n and not h and some)) for n in names]
    expect = Counter()
    for r, h, (v, some) in zip(rows, held, vectors, strict=True):
        cosine = [round(float(unit(v) @ c), 9) for c in centre]
        best = max(range(len(names)), key=lambda k: (cosine[k], -k))
        expect[(r[0], h, names[best] if some else "und", round(min(1.0, max(0.0, cosine[best])), 6) if some else 0.0)] += 1
    found = langid.language_id(docs, space).collect()
    assert Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in found) == expect


def test_profiles_equal_plain_binding():
    space = langid.Space(dims=64)
    p = langid.Profiler(space)
    import pyarrow as pa

    text = "Ab é-c  d"
    _, vectors, some = next(p.vectors(pa.array([text, None, "..."])))
    code = [1, 2, 0, p.codes[ord("é")], 0, 3, 0, 4]
    expect = np.zeros(64)
    for a, b, c in zip(code, code[1:], code[2:], strict=False):
        expect += np.roll(p.table[a].astype(int), 2) * np.roll(p.table[b], 1) * p.table[c]
    assert (vectors[0] == expect).all() and some.tolist() == [True, False, False]


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_components_by_blocks(spark, block, monkeypatch):
    """The same components whatever the block; a graph of one block takes no steps."""
    rng = np.random.default_rng(5)
    path = rng.permutation(np.arange(-40, 40))
    edges = [(int(a), int(b)) for a, b in zip(path, path[1:], strict=False)][::-1] + [(100 + k, 100) for k in range(30)] + [(int(a), int(b)) for a, b in rng.integers(200, 300, (60, 2))]
    low = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in low:
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    rounds = []
    monkeypatch.setattr(graph, "_large_star", lambda e, f=graph._large_star: (rounds.append(1), f(e))[1])
    found = graph.components(spark.createDataFrame(edges + edges[:9], "u long, v long").repartition(3), Scratch(spark, "blocks"), block=block)
    assert sorted(map(tuple, found.collect())) == sorted(low.items())
    assert bool(rounds) == (block < len(edges))
    none = graph.components(spark.createDataFrame([(3, 3)], "u long, v long"), Scratch(spark, "blocks"), block=block)
    assert none.count() == 0


def test_quality(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit = labels.where("doc_id % 2 = 0")
    model = quality.train(table, fit)
    judged = quality.score(table, model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    assert judged.where("keep = (quality = 1)").count() >= 0.97 * judged.count()
    good = judged.where("quality = 1")
    assert good.where("keep").count() >= 0.99 * good.count()
    kept = quality.filter_quality(table, model)
    assert kept.columns == table.columns
    assert kept.count() == quality.score(table, model).where("keep").count()
    assert quality.filter_quality(docs, model).columns == docs.columns
    assert quality.score(docs, model).count() == docs.count()
    none = quality.train(docs, labels.where("false"))
    assert quality.score(docs, none).where("keep").count() == docs.count()
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_quality_labels_of_a_part(spark):
    """Labels of documents that are not there take no place in the sample."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    last = labels.orderBy(F.xxhash64("doc_id").desc()).limit(150)
    part = table.join(last.select("doc_id"), "doc_id", "left_semi")
    model = quality.train(part, labels, quality.CoTraining(labelled=100))
    judged = quality.score(part, model).join(last, "doc_id")
    assert judged.where("quality = 0").count() > 0
    assert judged.where("keep = (quality = 1)").count() >= 0.9 * judged.count()


def test_quality_fits_on_all_labels(spark):
    """More labels than the driver holds: weights, calibration, prior and bound come from all of them."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    how = dict(dims=256, rounds=1, passes=40)
    whole, part = (quality.train(table, labels, quality.CoTraining(labelled=n, **how)) for n in (6000, 60))
    assert part.prior == whole.prior
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in table.collect() if r["doc_id"] in known]
    views = [np.array(x) for x in zip(*[_plain_views(r["text"], r["source"], r["lang"], 256) for r in rows], strict=True)]
    y = np.array([known[r["doc_id"]] for r in rows])
    fold = np.array([quality.in_fold(r["doc_id"]) for r in rows])
    good = part.score([v[fold & (y > 0)] for v in views])
    assert (good >= part.bound).mean() >= 0.995
    for k, x in enumerate(views):
        # Over all rows of the fold, and over all rows that are fitted on.
        z = part.sides[k].logit(x[fold])
        p = np.clip(1 / (1 + np.exp(-z)), 1e-6, 1 - 1e-6)
        assert abs(part.sides[k].loss + np.where(y[fold] > 0, np.log(p), np.log(1 - p)).mean()) < 1e-2
        weight = quality._balanced(y[~fold], np.ones((~fold).sum()))
        loss = [weight @ np.logaddexp(0, np.where(y[~fold] > 0, -1, 1) * (x[~fold] @ m.sides[k].weights[:-1] + m.sides[k].weights[-1])) for m in (part, whole)]
        assert loss[0] <= 1.05 * loss[1] + 1e-3
    wrong = [((m.score(views) >= 0.5) != (y > 0)).sum() for m in (part, whole)]
    assert wrong[0] <= wrong[1] + 0.01 * len(y)


def _plain_views(text, source, lang, dims):
    """Both views of one text, counted in plain Python."""
    b = (text or "").encode()
    low = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in b)
    counts = Counter((int.from_bytes(low[i : i + 3], "big") * 2654435761 % 2**32 >> 8) % dims for i in range(len(low) - 2))
    damped = np.array([np.log1p(counts[k]) for k in range(dims)])
    words, lines = low.split(), b.split(b"\n") if b else []
    pairs = list(zip(words, words[1:], strict=False))
    share = [4 * len(set(x)) / max(1, len(x)) for x in (words, lines, pairs)]
    content = [*damped / (np.sqrt((damped**2).sum()) or 1), *share, min(4, 0.4 * np.log1p(len(words)))]
    meta = np.zeros(quality.METADATA)
    meta[zlib.crc32((source or "").encode()) % 16] = 0.3
    meta[16 + zlib.crc32((lang or "").encode()) % 8] = 0.3
    meta[24 + min(19, len(b).bit_length())] = 1
    if b:
        kind = lambda c: 0 if c >= 128 or 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in b" \t\r\v\f" else 4 if c == 10 else 5 if c in b".,;:'\"?-" else 6
        met = Counter(map(kind, b))
        meta[44:51] = [np.sqrt(met[k] / len(b)) for k in range(7)]
        meta[51:] = [np.log1p(len(b) / (met[4] + 1)) / 8, len(b) / (met[3] + met[4] + 1) / 16, 1]
    return [np.array(x).astype(np.float16).astype(np.float64) for x in (content, meta)]


def test_quality_equals_plain_python(spark):
    """The whole result: views, rounds of pseudo-labels from all unlabelled rows, calibration and scores."""
    d = "/root/testdata/sf0.001"
    how = quality.CoTraining(dims=128, steps=60, sure=0.8)
    table, labels = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    docs = sorted(table.collect(), key=lambda r: r["doc_id"])
    views = [np.array(x) for x in zip(*[_plain_views(r["text"], r["source"], r["lang"], 128) for r in docs], strict=True)]
    rounds = []

    def exchange(sides):
        """Means by language of the rows that the other view is sure of, row by row."""
        groups = defaultdict(list)
        for k, r in enumerate(docs):
            if r["doc_id"] in known:
                continue
            for giver in (0, 1):
                side = sides[giver]
                z = side.slope * (views[giver][k] @ side.weights[:-1] + side.weights[-1]) + side.intercept
                p = 1 / (1 + np.exp(-z))
                if p >= 0.8 or p <= 0.2:
                    groups[1 - giver, int(p >= 0.8), zlib.crc32((r["lang"] or "").encode()) % 8].append(views[1 - giver][k])
        rounds.append(sum(map(len, groups.values())))
        out = []
        for taker in (0, 1):
            mine = sorted(g for g in groups if g[0] == taker)
            out.append((np.array([np.mean(groups[g], 0) for g in mine]), np.array([float(g[1]) for g in mine]), np.array([float(len(groups[g])) for g in mine])))
        return out

    at = [k for k, r in enumerate(docs) if r["doc_id"] in known]
    y = np.array([known[docs[k]["doc_id"]] for k in at])
    fold = np.array([zlib.crc32(f"fold {docs[k]['doc_id']}".encode()) % 4 == 0 for k in at])
    model = quality.co_train([v[at] for v in views], y, fold, exchange, how)
    expect = {}
    for k, r in enumerate(docs):
        z = sum(s.slope * (v[k] @ s.weights[:-1] + s.weights[-1]) + s.intercept for s, v in zip(model.sides, views, strict=True)) - model.prior
        expect[r["doc_id"]] = 1 / (1 + np.exp(-z))
    assert rounds and rounds[0] > 20
    found = quality.score(table, quality.train(table, labels, how), how).collect()
    assert {r["doc_id"] for r in found} == set(expect)
    for r in found:
        assert abs(r["quality_score"] - expect[r["doc_id"]]) < 1e-4
        if abs(expect[r["doc_id"]] - model.bound) > 1e-3:
            assert r["keep"] == (expect[r["doc_id"]] >= model.bound)


def test_quality_moves_no_texts(spark):
    """However many labels there are: only views of labelled rows are shuffled, and pseudo-labels are of the unlabelled ones."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice([*"abcdefghijklmnopqrst \n"], 20_000)) if k % 2 else "".join(rng.choice([*"ABC 123."], 20_000)) for k in range(400)]
    rows = [(k, x, "web", "de" if k % 3 else None) for k, x in enumerate(texts)] + [(7, texts[7], "web", "de"), (None, texts[0], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id int, quality int")
    store, before = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def written():
        store.listenerBus().waitUntilEmpty()
        return store.statusStore().executorSummary("driver").totalShuffleWrite()

    docs = docs.localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        begin = written()
        model = quality.train(docs, labels, quality.CoTraining(dims=64, steps=60, rounds=1))
        assert written() - begin < 0.2 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    how = quality.CoTraining(dims=64, steps=60, rounds=1)
    parts = [[np.concatenate(x) for x in zip(*(v for b in docs.where(w).select("text", "source", "lang").toArrow().combine_chunks().to_batches() for _, v in quality.views(b, 64)), strict=True)] for w in ("doc_id >= 60 or doc_id is null", "doc_id < 60")]
    lang = docs.where("doc_id >= 60 or doc_id is null").toArrow()["lang"].to_pylist()
    fitted = [(np.concatenate(x).astype(np.float16).tobytes(), int(s)) for *x, s in zip(*parts[1], quality.strata(docs.where("doc_id < 60").toArrow()["lang"].to_pylist()), strict=True)]
    found = quality._exchange(quality._source(docs, "doc_id"), spark.createDataFrame(fitted, "x binary, stratum int"), model.sides, how)
    expect = [[(parts[0][t][at].astype(np.float64).mean(0), label, len(at)) for taker, label, _, at in quality.given_away(parts[0], model.sides, lang, how) if taker == t] for t in (0, 1)]
    assert len(fitted) == 61 and any(expect)
    for (x, y, n), own in zip(found, expect, strict=True):
        assert sorted(zip(y, n, strict=True)) == sorted((float(label), float(k)) for _, label, k in own)
        assert np.allclose(sorted(x.sum(1)), sorted(v.sum() for v, _, _ in own), atol=1e-4)


def test_exchange_helps():
    """With few labels the exchange makes fewer errors on the whole, and no calibration loss rises."""
    import dataclasses

    import pyarrow.parquet as pq

    how = quality.CoTraining(dims=256, steps=100)
    d = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text", "source", "lang"])
    known = dict(zip(*pq.read_table(f"{d}/labels.parquet", columns=["doc_id", "quality"]).to_pydict().values(), strict=True))
    ids, lang = docs["doc_id"].to_pylist(), docs["lang"].to_pylist()
    parts = [x for b in docs.to_batches() for _, x in quality.views(b, how.dims)]
    views = [np.concatenate(x) for x in zip(*parts, strict=True)]
    y = np.array([known.get(k, -1) for k in ids])
    labelled = np.flatnonzero(y >= 0)
    errors = np.zeros(2, int)
    for seed in range(10):
        order = np.random.default_rng(seed).permutation(labelled)
        fit, rest = np.sort(order[: 40 + 16 * seed]), order[40 + 16 * seed :]
        free = np.ones(len(y), bool)
        free[fit] = False

        def exchange(sides, free=free):
            both, own = [v[free] for v in views], [x for x, f in zip(lang, free, strict=True) if f]
            out = [([], [], []), ([], [], [])]
            for taker, label, _, at in quality.given_away(both, sides, own, how):
                for store, x in zip(out[taker], (both[taker][at].mean(0), float(label), float(len(at))), strict=True):
                    store.append(x)
            return [tuple(map(np.array, x)) for x in out]

        fold = np.array([quality.in_fold(k) for k in fit])
        for k, rounds in enumerate((0, 3)):
            model = quality.co_train([v[fit] for v in views], y[fit], fold, exchange, dataclasses.replace(how, rounds=rounds))
            errors[k] += ((model.score([v[rest] for v in views]) >= 0.5) != (y[rest] > 0)).sum()
    assert errors[1] <= errors[0]


_ANY = st.lists(st.sampled_from([*"ab<|\\>\n", "<|im_end|>", "<|im_start|>", "é", "😀"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(_ANY, _ANY), min_size=1, max_size=4))
def test_template_is_reversible(turns):
    formatted = "".join("".join(chat.render(r, t)) for r, t in turns)
    assert chat.parse(formatted) == turns


@pytest.mark.parametrize(("limit", "part_bytes"), [(1 << 16, 1 << 20), (30, 1 << 20), (1 << 16, 25), (30, 1)])
def test_chat(spark, limit, part_bytes):
    rng = random.Random(4)
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (None, 0, None, None), (7, None, "assistant", ""), (7, 1, "user", "x"), (7, 1, "user", "x")]
    for c in range(40):
        for t in range(rng.randrange(1, 5)):
            rows.append((100 + c, t, ["user", "assistant"][t % 2], rng.choice(["hello", "<|endoftext|>", "\\<\\|", "yes é", ""])))
    rows += [(None, t, ["user", "assistant"][t % 2], f"a long conversation {t % 7} é") for t in range(300)]
    table = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, path string, part int, conversation int")
    samples = chat.format_conversations(table, max_tokens=limit, part_bytes=part_bytes)
    found = chat.read_back(samples).collect()
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append(((t is not None, t or 0), r or "", x or ""))
    assert len(found) == len(convs)
    for r in found:
        turns = [(a, b) for _, a, b in sorted(convs[r["conv_id"]])]
        loss = "".join(b for a, b in turns if a == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for s in samples.collect():
        assert len(s["ids"]) == len(s["positions"])
        seen = set()
        for k, n in enumerate(s["nodes"]):
            own = (n["parent"], tuple(s["ids"][n["start"] : n["stop"]]))
            assert own not in seen  # shared turns come once in a sample
            seen.add(own)
            spans = [range(a["start"], a["stop"]) for a in n["attend"]]
            assert [s["positions"][i] for r in spans for i in r] == list(range(sum(map(len, spans))))
            assert n["parent"] < k
    if part_bytes > 1000:
        return
    split = Counter(e["conversation"] for s in samples.collect() for e in s["ends"])
    assert split[None] > 100  # the long conversation is never gathered
    assert chat.read_back(chat.format_conversations(table.where("false"))).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert len({r["doc_id"] for r in rows}) == len(rows) <= n
        n = len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).select("doc_id").distinct().count() == n
