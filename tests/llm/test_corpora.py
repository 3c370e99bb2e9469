"""Operators that compare rows: each against a brute-force version on small tables."""

import collections
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from plotfield.llm import common, decontaminate, line_dedup, ngram_quality, order_minhash, paragraph_dedup, suffix_repeats


def prose(pick, n, words=400):
    return " ".join(f"w{pick.randrange(words)}" + (". " if pick.random() < 0.1 else "") for _ in range(n))


def edited(pick, text, rate):
    return " ".join(f"z{pick.randrange(1000)}" if pick.random() < rate else w for w in text.split(" "))


@pytest.fixture(scope="module")
def corpus():
    pick = random.Random(11)
    docs = [prose(pick, pick.randrange(5, 250)) for _ in range(60)]
    docs += [docs[k] for k in (0, 1, 1, 2)]
    docs += [edited(pick, docs[k], 0.01) for k in range(3, 20)] + [edited(pick, docs[k], 0.08) for k in range(20, 30)]
    passage = prose(pick, 70)
    docs += [prose(pick, 30) + " " + passage + " " + prose(pick, 30), prose(pick, 10) + "\n" + passage, passage]
    docs += ["", " ", None, "one two", "one two", "!!!", "!!!", "na " * 300, "é" * 400]
    return list(enumerate(docs))


@pytest.fixture
def frame(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)


def test_components(spark):
    pick = random.Random(2)
    links = [(pick.randrange(200), pick.randrange(200)) for _ in range(120)] + [(300 + k, 301 + k) for k in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_small_side(spark):
    rows = spark.range(10)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(common.small_side(rows, 10)) and not hinted(common.small_side(rows, 9))


def test_shared_folder_is_the_session_s(spark):
    assert common.shared_folder(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())


# -- suffix repeats -------------------------------------------------------------------------------------------------

def covered(texts, length):
    data = {i: (t or "").encode() for i, t in texts}
    counts = collections.Counter(b[p:p + length] for b in data.values() for p in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if counts[b[p:p + length]] > 1:
                gone[p:p + length] = True
        out[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("shard", [suffix_repeats.SHARD, 3])
def test_repeats_are_removed_exactly(frame, corpus, monkeypatch, shard):
    monkeypatch.setattr(suffix_repeats.maximal_repeats, "__defaults__", ("doc_id", "text", suffix_repeats.LENGTH, suffix_repeats.ANCHOR, shard))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_repeats.remove_repeats(frame).collect()}
    assert got == covered(corpus, suffix_repeats.LENGTH)


def test_groups_are_maximal_and_whole(spark):
    pick = random.Random(5)
    core = "".join(pick.choice("abcd") for _ in range(60))
    texts = [(1, "x" + core + "y"), (2, "p" + core + "q"), (3, "p" + core[:50] + "k"), (4, "".join(pick.choice("efgh") for _ in range(90)))]
    got = suffix_repeats.maximal_repeats(spark.createDataFrame(texts, "doc_id long, text string"), length=40, anchor=16).collect()
    groups = collections.defaultdict(set)
    for r in got:
        groups[bytes(r.repeat)].add((r.doc_id, r.start, r.bytes))
    data = dict(texts)
    for members in groups.values():
        strings = {data[d][s:s + n] for d, s, n in members}
        assert len(members) > 1 and len(strings) == 1
        one = strings.pop()
        everywhere = {(d, m.start(), len(one)) for d, t in texts for m in re.finditer(f"(?={re.escape(one)})", t)}
        assert members == everywhere
    assert {d for m in groups.values() for d, _, _ in m} == {1, 2, 3}


def test_intervals_by_definition():
    pick = random.Random(1)
    for _ in range(50):
        lcp = [0, *[pick.randrange(1, 5) for _ in range(8)]]
        want = set()
        for a in range(9):
            for b in range(a + 1, 9):
                low = min(lcp[a + 1:b + 1])
                if (a == 0 or lcp[a] < low) and (b == 8 or lcp[b + 1] < low):
                    want.add((low, a, b))
        assert set(suffix_repeats.intervals(lcp)) == want


# -- near duplicates ------------------------------------------------------------------------------------------------

def shingles(text):
    words = [w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode())]
    return [tuple(words[k:k + 5]) for k in range(len(words) - 4)]


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_in_a_band():
    pick = random.Random(4)
    for _ in range(300):
        a = np.array([pick.randrange(6) for _ in range(pick.randrange(0, 30))], np.int32)
        b = np.array([x for x in a if pick.random() < 0.9] + [pick.randrange(6) for _ in range(pick.randrange(0, 4))], np.int32)
        true = common_length(a.tolist(), b.tolist())
        for least in (0, true - 1, true, true + 1):
            found = order_minhash.common_subsequence(a, b, max(least, 0))
            assert found == true if max(least, 0) <= true else found == -1


def plain_words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def test_near_duplicate_classes(frame, corpus):
    seqs = {i: plain_words(t) if len(plain_words(t)) >= 5 else [] for i, t in corpus}
    root = {i: i for i in seqs}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, s in corpus:
        for j, t in corpus:
            if i < j and (s == t and re.search(r"\w", s or "") or seqs[i] and seqs[j] and
                          (m := common_length(seqs[i], seqs[j])) >= 0.8 * (len(seqs[i]) + len(seqs[j]) - m)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(frame).collect()}
    assert got == {i: find(i) for i in seqs}
    kept = {r.doc_id for r in order_minhash.keep_one(frame).collect()}
    assert kept == {i for i in seqs if find(i) == i}


def test_order_matters_to_a_sketch():
    words = np.arange(40, dtype=np.uint64) * np.uint64(2654435761)
    both = np.concatenate([words, words[::-1]])
    values = order_minhash.order_minhash(both, np.array([0, 40, 80]))
    assert (values[0] == values[1]).mean() < 0.5
    same = order_minhash.order_minhash(np.concatenate([words, words]), np.array([0, 40, 80]))
    assert (same[0] == same[1]).all()


def true_classes(seqs):
    """Components of all pairs by brute force, as the smallest member of each."""
    root = {k: k for k in seqs}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(seqs, 2):
        total = len(seqs[a]) + len(seqs[b])
        if find(a) != find(b) and order_minhash.common_subsequence(seqs[a], seqs[b], int(np.ceil(total * 0.8 / 1.8 - 1e-9))) >= 0:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in seqs}


def numbered(rows):
    names: dict = {}
    return {k: np.array([names.setdefault(x, len(names)) for x in plain_words(t)]) for k, t in rows}


@pytest.mark.parametrize("rate, recall", [(0.02, 1.0), (0.05, 0.95)])
def test_group_of_many_near_copies(spark, rate, recall):
    """Copies of a text that is not among them, at 0.05 with most pairs near the threshold: nearly all members are joined, no other is."""
    pick = random.Random(9)
    base = prose(pick, 200)
    rows = [(k, edited(pick, base, rate)) for k in range(150)] + [(1000 + k, prose(pick, 200)) for k in range(20)]
    want = true_classes(numbered(rows))
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    joined = [k for k in want if want[k] != k]
    assert len(joined) > 140 and sum(got[k] == want[k] for k in joined) >= recall * len(joined)
    assert all(got[k] in (k, want[k]) or want[got[k]] == want[k] for k in want)


def test_exact_option(spark):
    """With it no link of documents that share a sketch is lost to the choice of candidates."""
    pick = random.Random(9)
    base = prose(pick, 200)
    rows = [(k, edited(pick, base, 0.05)) for k in range(60)]
    want = true_classes(numbered(rows))
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), exact=True).collect()}
    assert sum(got[k] == want[k] for k in want) >= len(want) - 1


def linked_rows():
    """Groups of near copies of texts that are not among them, most pairs near the threshold."""
    pick = random.Random(31)
    bases = [prose(pick, 120) for _ in range(6)]
    return [(100 * g + k, edited(pick, base, 0.075)) for g, base in enumerate(bases) for k in range(60)]


def sketch_classes(spark, rows):
    """Components of all pairs that share a sketch and are similar, by brute force."""
    sketches = order_minhash.document_sketches(spark.createDataFrame(rows, "doc long, text string")).collect()
    held, seqs = collections.defaultdict(set), numbered(rows)
    for r in sketches:
        held[r.doc].add((r.band, r.value))
    root = {k: k for k, _ in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(root, 2):
        total = len(seqs[a]) + len(seqs[b])
        if held[a] & held[b] and order_minhash.common_subsequence(seqs[a], seqs[b], int(np.ceil(total * 0.8 / 1.8 - 1e-9))) >= 0:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in root}


def test_no_link_of_a_bucket_is_lost(spark):
    """Every similar pair that shares a sketch is linked, also where the two are never near each other in an order of their bucket."""
    rows = linked_rows()
    want = sketch_classes(spark, rows)
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 100 < sum(want[k] != k for k in want) and got == want


def test_pipeline_keeps_one_of_each_class(spark):
    """The stage drops every document that a link of a bucket joins to a smaller one."""
    rows = linked_rows()
    want = sketch_classes(spark, rows)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == {k for k in want if want[k] == k}


@pytest.mark.parametrize("size", [3, 10, 100])
def test_cells_hold_all_pairs_of_classes(spark, size):
    classes = [0] * 25 + [30] * 4 + list(range(40, 52))
    members = [(0, value, d, root) for value in (7, 8) for d, root in enumerate(classes[: 41 if value == 7 else 27])]
    got = collections.defaultdict(list)
    for r in order_minhash.cells(spark.createDataFrame(members, "band int, value long, doc long, root long"), size).collect():
        got[r.value, r.i, r.j].append(r)
    met = collections.Counter((cell[0], *sorted((x.doc, y.doc))) for cell, held in got.items() for x, y in itertools.combinations(held, 2)
                              if x.root != y.root and (cell[1] == cell[2] or x.chunk != y.chunk))
    assert met == {(v, a, b): 1 for (_, v, a, ra), (_, w, b, rb) in itertools.combinations(members, 2) if v == w and ra != rb}


@pytest.mark.parametrize("members", [40, 140])
def test_chain_of_links_in_one_bucket(spark, members):
    """Only neighbours are alike, so no centre is like more than two. A second round has pairs, and no link is lost."""
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.where("b - a = 1")

    buckets = spark.createDataFrame([(band, 7, d, 7) for band in range(3) for d in range(members)], "band int, value long, doc long, sketch long")
    roots = order_minhash.components(order_minhash.bucket_links(buckets, verify, 3, 3)).collect()
    assert len(asked) > 2 and all(asked)
    assert {r.node for r in roots} == set(range(members)) and {r.root for r in roots} == {0}


def test_chain_of_successive_edits(spark):
    pick = random.Random(21)
    words = prose(pick, 120).split()
    rows = []
    for k in range(40):
        rows.append((k, " ".join(words)))
        words[(3 * k) % 118] = f"z{k}"
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


# -- paragraphs -----------------------------------------------------------------------------------------------------

def test_repeated_passages_stay_once(frame, corpus):
    left = {r.doc_id: r.text for r in paragraph_dedup.paragraph_dedup(frame).collect()}
    assert set(left) == {i for i, _ in corpus}
    by_words = lambda t: [tuple(t.split()[k:k + 40]) for k in range(len(t.split()) - 39)]
    before = collections.Counter(w for _, t in corpus for w in set(by_words(t or "")))
    after = collections.Counter(w for t in left.values() for w in set(by_words(t or "")))
    repeated = {w for w, n in before.items() if n > 1}
    assert repeated and sum(after[w] > 1 for w in repeated) < 0.05 * len(repeated)
    for i, t in corpus[30:60]:
        assert left[i] == t  # nothing else is like these


def test_paragraphs_are_cut_alike_anywhere():
    pick = random.Random(3)
    passage = ". ".join(prose(pick, 15) for _ in range(12)) + "."
    texts = [passage, prose(pick, 9) + " " + passage]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(texts)], names=["doc", "text"])
    _, _, _, row, _, p, *_ = paragraph_dedup._paragraphs(batch)
    a, b = set(p[row == 0].tolist()), set(p[row == 1].tolist())
    assert len(a & b) >= len(a) - 1


def test_planted_passages_go_whole(spark):
    """Of a passage in several texts one stays and of the words around it nearly all are left, whatever its form. Inline passages without sentence
    ends need some length. Lone short lines, odd texts and one word repeated stay."""
    pick = random.Random(4)
    cases, texts = {}, {}
    for size, shape in itertools.product([60, 110, 200], ["sentences", "inline", "short lines", "one changed"]):
        words = prose(pick, size + 60 * (shape == "inline"), 3000).replace(".", "").split()
        if shape in ("sentences", "one changed"):
            words = [w + "." if k % 11 == 10 else w for k, w in enumerate(words)]
        if shape == "short lines":
            words = [w + "\n" if k % 7 == 6 else w for k, w in enumerate(words)]
        for k in range(4):
            inner = list(words)
            if shape == "one changed" and k == 2:
                inner[size // 2] = "changed"
            own = prose(pick, 70, 3000), prose(pick, 80, 3000)
            doc = len(texts)
            texts[doc] = f"{own[0]} {' '.join(inner)} {own[1]}"
            cases[doc] = (size, shape, k, words, " ".join(own).split())
    line = prose(pick, 20, 3000)
    odd = [f"{prose(pick, 60, 3000)}\n{line}\n{prose(pick, 60, 3000)}" for _ in range(6)] + [None, "", " ", "one", "word " * 3000, line]
    texts |= dict(enumerate(odd, len(texts)))
    got = {r.doc_id: (r.text, r.n_removed) for r in paragraph_dedup.paragraph_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert set(got) == set(texts)
    runs = lambda x: {tuple(x[k:k + 3]) for k in range(len(x) - 2)}
    wrong = []
    for doc, t in texts.items():
        size, shape, k, words, own = cases.get(doc, (0, "odd", 0, [], []))
        text, n = got[doc]
        if not k:
            if (text, n) != (t, 0):
                wrong.append((size, shape, k, n))
            continue
        left = len(runs(plain_words(" ".join(words))) & runs(plain_words(text)))
        # A paragraph at an end of the passage may take some words of the text around it along, if it is similar enough.
        if not n or left or not len(own) - 10 <= len(text.split()) <= len(own) + 4:
            wrong.append((size, shape, k, n, left, len(own), len(text.split())))
    assert not wrong


def test_short_paragraphs_with_changed_words_meet(spark):
    """Pairs of short paragraphs, one of 20 words changed, all of them similar by edit distance: at least 0.9 of them share a band."""
    pick = random.Random(5)
    rows = []
    for k in range(200):
        words = prose(pick, 20).split()
        rows.append((2 * k, " ".join(words)))
        words[pick.randrange(20)] = "zzz"
        rows.append((2 * k + 1, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc long, text string").repartition(1)
    values = {}
    for r in paragraph_dedup.bands(frame).collect():
        values.setdefault(r.of // 2, []).append(set(r["values"]))
    whole = [v for v in values.values() if len(v) == 2]
    assert len(whole) > 50 and sum(bool(v[0] & v[1]) for v in whole) >= 0.9 * len(whole)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a):
        new = [k + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance():
    pick = random.Random(7)
    for _ in range(200):
        a = "".join(pick.choice("abé ") for _ in range(pick.randrange(0, 40)))
        b = "".join(c for c in a if pick.random() < 0.9) + "".join(pick.choice("abé ") for _ in range(pick.randrange(0, 5)))
        assert paragraph_dedup.edit_distance(a, b) == levenshtein(a, b)


def test_edit_distances_of_many_pairs():
    pick = random.Random(19)
    pairs = []
    for size in [*range(0, 140, 7), 63, 64, 65, 127, 128, 129]:
        a = "".join(pick.choice("abé \U0001f600") for _ in range(size))
        pairs += [(a, "".join(c for c in a if pick.random() < 0.9) + "b" * pick.randrange(0, 9)), ("".join(pick.choice("abc") for _ in range(pick.randrange(0, 90))), a)]
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    assert paragraph_dedup.edit_distances([codes(a) for a, _ in pairs], [codes(b) for _, b in pairs]).tolist() == [levenshtein(a, b) for a, b in pairs]


def test_pairs_of_a_cell_are_verified_together():
    """The verdicts of many pairs are those of the rule, one pair at a time, and take a part of that time."""
    import time
    import pyarrow as pa
    pick = random.Random(20)
    texts = [prose(pick, 20, 60) for _ in range(20)]
    texts += [edited(pick, t, 0.15) for t in texts for _ in range(3)]
    among = paragraph_dedup.Paragraphs(pa.table({"shingles": pa.array([[hash(x) for x in shingles(t)] for t in texts], pa.list_(pa.int64())), "short": texts}), 0.8)
    x, y = np.array(list(itertools.combinations(range(len(texts)), 2))).T
    start = time.process_time()
    got = among.similar(x, y)
    middle = time.process_time()
    far = [paragraph_dedup.edit_distance(texts[a], texts[b]) for a, b in zip(x.tolist(), y.tolist())]
    end = time.process_time()
    sets = [set(shingles(t)) for t in texts]
    want = [len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or 1 - d / max(len(texts[a]), len(texts[b])) >= 0.8 for a, b, d in zip(x.tolist(), y.tolist(), far)]
    assert got.tolist() == want and 20 < sum(want) < len(want) / 2
    assert middle - start < (end - middle) / 2


def test_paragraph_bounds_rule_out_no_similar_pair():
    import pyarrow as pa
    pick = random.Random(8)
    texts = [prose(pick, 16, 60) for _ in range(12)]
    texts += [edited(pick, t, 0.1) for t in texts for _ in range(3)]
    sets = [[hash(x) for x in shingles(t)] for t in texts]
    among = paragraph_dedup.Paragraphs(pa.table({"shingles": pa.array(sets, pa.list_(pa.int64())), "short": [None if k % 5 == 4 else t for k, t in enumerate(texts)]}), 0.8)
    x, y = np.array(list(itertools.combinations(range(len(texts)), 2))).T
    keep, _ = among.possible(x, y)
    alike = np.array([among.alike(a, b) for a, b in zip(x.tolist(), y.tolist())])
    assert alike.sum() > 20 and keep[alike].all() and keep.sum() < len(keep) / 2


def test_unlike_paragraphs_of_a_large_cell_are_ruled_out_together():
    """In a cell of many rows only a small part of the pairs is looked at one by one, and no similar pair is left out, of one chunk or of two."""
    import pyarrow as pa
    pick = random.Random(23)
    texts = [prose(pick, pick.randrange(10, 33), 400) for _ in range(200)]
    texts += [edited(pick, t, 0.08) for t in texts[:60]] + ["word " * 20, "word " * 23, "", "x"]
    sets = [[hash(x) for x in shingles(t)] for t in texts]
    among = paragraph_dedup.Paragraphs(pa.table({"shingles": pa.array(sets, pa.list_(pa.int64())), "short": [None if k % 9 == 4 else t for k, t in enumerate(texts)]}), 0.8)
    rows, n = np.arange(len(texts)), len(texts)
    for begin in (rows + 1, np.where(rows < 130, 130, n)):
        x, y = (np.concatenate(z) for z in zip(*(among.meeting(rows[k: k + 90], begin[k: k + 90], np.full(len(rows[k: k + 90]), n)) for k in range(0, n, 90))))
        met = set(zip(x.tolist(), y.tolist()))
        assert len(met) == len(x)
        every = [(a, b) for a in rows.tolist() for b in range(begin[a], n)]
        u, v = np.array(every).T
        alike = {e for e, good in zip(every, among.similar(u, v)) if good}
        assert len(alike) > 20 and alike <= met <= set(every)
        tail = sum(1 for a, b in every if n - a < among.LARGE)
        assert len(met) - tail < 0.2 * (len(every) - tail)


def test_pairs_with_too_many_edits_are_given_up():
    pick = random.Random(24)
    texts = [np.array([pick.randrange(30) for _ in range(pick.randrange(0, 180))], np.uint8) for _ in range(40)]
    texts += [np.array([c for c in t if pick.random() < 0.95], np.uint8) for t in texts]
    pairs = [(a, b) for a in texts for b in texts]
    far = paragraph_dedup.edit_distances([a for a, _ in pairs], [b for _, b in pairs])
    most = np.array([pick.randrange(0, 60) for _ in pairs])
    got = paragraph_dedup.edit_distances([a for a, _ in pairs], [b for _, b in pairs], most)
    near = far <= most
    assert 40 < near.sum() < len(pairs) / 2 and (got[near] == far[near]).all() and (got[~near] > most[~near]).all()


def test_short_paragraphs_are_spelt_from_their_bytes(spark):
    """The shingles made from a short paragraph's bytes are those of its words in the text, also outside of ASCII; a long one's are sent."""
    pick = random.Random(25)
    rows = [(k, ". ".join(prose(pick, 15).replace("a", "\u00c4") for _ in range(8))) for k in range(6)] + [(7, "word " * 200)]
    found = paragraph_dedup.paragraphs(spark.createDataFrame(rows, "doc long, text string")).collect()
    frame = spark.createDataFrame([(d, t, [r["at"] for r in found if r.doc == d]) for d, t in rows], "doc long, text string, ats array<int>")
    got = {r.p: (set(r.shingles), r.short) for r in paragraph_dedup.whole_sets(paragraph_dedup.shingle_sets(frame)).collect()}
    for r in found:
        piece = dict(rows)[r.doc].encode()[r["first"]: r["last"]]
        words, _, _, at = common.word_hashes(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]))
        own, _ = common.shingle_hashes(words, at)
        assert got[r.p] == (set(own.view(np.int64).tolist()), piece.decode().lower() if len(words) <= 32 else None)
    assert {t is None for _, t in got.values()} == {True, False}


def test_no_similar_paragraph_of_a_bucket_is_lost(spark):
    """All similar paragraphs that share a band are of one component, also where the two are never near each other in an order of their bucket."""
    pick = random.Random(17)
    bases = [prose(pick, 22, 3000).replace(".", "").split() for _ in range(4)]
    rows = [(100 * g + k, " ".join(f"z{pick.randrange(1000)}" if pick.random() < 0.14 else w for w in base)) for g, base in enumerate(bases) for k in range(90)]
    frame = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    found = paragraph_dedup.bands(frame).collect()
    pieces = {(r.doc, r["at"]): dict(rows)[r.doc].encode()[r["first"]: r["last"]].decode().lower() for r in paragraph_dedup.paragraphs(frame).collect()}
    held = {(r.of, r["at"]): (r.p, set(r["values"])) for r in found}

    def find(x):
        return x if root[x] == x else find(root[x])

    root = {k: k for k in held}
    for a, b in itertools.combinations(sorted(held), 2):
        s, t = set(shingles(pieces[a])), set(shingles(pieces[b]))
        far = max(len(pieces[a]), len(pieces[b]))
        if held[a][1] & held[b][1] and find(a) != find(b) and (len(s & t) >= 0.8 * len(s | t) or 1 - levenshtein(pieces[a], pieces[b]) / far >= 0.8):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {(r.doc, r["at"]): (r.kdoc, r.kat) for r in paragraph_dedup.repeated_paragraphs(frame).collect()}
    assert len(got) > 100 and got == {k: find(k) for k in root if find(k) != k}


# -- lines and benchmarks -------------------------------------------------------------------------------------------

def test_lines_against_sql(spark):
    pick = random.Random(8)
    lines = [f"line {k} of the site" for k in range(40)]
    rows = [(i, f"s{pick.randrange(14)}" if i % 9 else None, "\n".join([" " * (i % 3) + pick.choice(lines), f"own {i}", "", pick.choice(lines[:3])]) if i % 17 else None) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(frame).collect()}
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, source varchar, text varchar)")
    db.executemany("insert into documents values (?, ?, ?)", rows)
    want = {r[0]: r[1:] for r in db.execute(f"select doc_id, text, n_removed from ({line_dedup.SQL})").fetchall()}
    assert sum(n for _, n in got.values()) > 50
    assert {i: v for i, v in got.items() if v[0] is not None} == want
    assert all(got[i] == (None, 0) for i, _, t in rows if t is None)


def test_benchmark_items_in_long_documents(spark):
    pick = random.Random(6)
    items = [(k, prose(pick, n)) for k, n in enumerate([4, 5, 6, 12, 30, 70, 150])] + [(90, None), (91, "")]
    docs = [(i, prose(pick, 400)) for i in range(20)]
    docs += [(100 + k, prose(pick, 300) + " " + t.upper() + ", " + prose(pick, 300)) for k, t in items if t]
    docs += [(200 + k, prose(pick, 50) + " " + " ".join(t.split()[: len(t.split()) // 2]) + " " + prose(pick, 50)) for k, t in items if t]
    docs += [(500, None), (501, ""), (None, items[4][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(100 + k, k) for k in range(1, 7)}
    kept = {r.doc_id for r in decontaminate.decontaminate(d, b).collect()}
    assert kept == {i for i, _ in docs} - {100 + k for k in range(1, 7)}
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["lines", "benchmark"])
def test_native_plans(spark, name):
    docs = spark.createDataFrame([(1, "s", "a b c d e f g")], "doc_id long, source string, text string")
    made = line_dedup.line_dedup(docs) if name == "lines" else decontaminate.contaminated(docs, docs.withColumnRenamed("doc_id", "item_id"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


# -- language model -------------------------------------------------------------------------------------------------

def kneser_ney(texts):
    """Interpolated modified Kneser-Ney by its definition, over symbol tuples."""
    n = ngram_quality.ORDER
    split = lambda key, size: tuple(key >> 6 * k & 63 for k in reversed(range(size)))
    counts = {n: collections.Counter(split(int(k), n) for k in ngram_quality.encoded(texts)[0])}
    for size in range(n - 1, 0, -1):
        counts[size] = collections.Counter(g[1:] for g in counts[size + 1])
    rates = {}
    for size in counts:
        m = collections.Counter(counts[size].values())
        rates[size] = []
        for k in (1, 2, 3):
            if m[k] and m[1]:
                y = m[1] / (m[1] + 2 * m[2])
                rates[size].append(max(0.1, min(k - 0.05, k - (k + 1) * y * m[k + 1] / m[k])))
            else:
                rates[size].append(min(1, k / 2))
    totals = {size: collections.defaultdict(lambda: [0, 0.0]) for size in counts}
    for size in counts:
        for g, c in counts[size].items():
            totals[size][g[:-1]][0] += c
            totals[size][g[:-1]][1] += rates[size][min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / ngram_quality.SYMBOLS
        size, low = len(g), p(g[1:])
        if g[:-1] not in totals[size]:
            return low
        total, lost = totals[size][g[:-1]]
        c = counts[size].get(g, 0)
        return ((c - rates[size][min(c, 3) - 1]) / total if c else 0) + lost / total * low

    return lambda text: [p(split(int(k), n)) for k in ngram_quality.encoded([text])[0]]


@pytest.mark.parametrize("rows", [ngram_quality.MODEL_ROWS, 300])
def test_perplexity_by_definition(spark, monkeypatch, rows):
    monkeypatch.setattr(ngram_quality, "MODEL_ROWS", rows)
    pick = random.Random(12)
    known = ["".join(pick.choice("abcde f.") for _ in range(80)) for _ in range(12)]
    asked = [*known[:3], "abc #fe!!", "", "été 12"]
    model = ngram_quality.train(spark.createDataFrame([("x", t) for t in known], "lang string, text string"))
    docs = spark.createDataFrame([(i, "x", t) for i, t in enumerate(asked)], "doc long, lang string, text string")
    got = {r.doc: (r.total, r.n) for r in ngram_quality.log_probabilities(spark, docs, model).collect()}
    score = kneser_ney(known)
    for i, t in enumerate(asked):
        assert got[i][1] == len(t) and got[i][0] == pytest.approx(float(np.log(score(t)).sum()) if t else 0, rel=1e-4, abs=1e-4)


def test_alphabet_is_open():
    """Every character has units of its own, none of them the beginning of another's."""
    sizes, units = ngram_quality.alphabet()
    spelt = units.astype(np.uint64) << (6 * (5 - sizes)).astype(np.uint64)
    order = np.argsort(spelt)
    ends = spelt + (np.uint64(1) << (6 * (5 - sizes)).astype(np.uint64))
    assert len(sizes) == 0x110000 and (ends[order][:-1] <= spelt[order][1:]).all()
    assert all((units >> np.uint32(6 * k) & np.uint32(63))[sizes > k].all() for k in range(5))


def test_model_of_other_scripts(spark):
    """Letter case, digits and letters of other scripts are told apart, and the model grows with the texts."""
    pick = random.Random(14)
    names = {"el": "νερό πέτρα ποτάμι και ουρανός", "ja": "水 石 川 空 山", "en": "Iron 1984 rust 2077 Gold"}
    fine = lambda lang: " ".join(pick.choice(names[lang].split()) for _ in range(80))
    known = [(lang, fine(lang)) for lang in names for _ in range(20)]
    asked = []
    for lang in names:
        text = fine(lang)
        other = {"el": lambda t: "".join(pick.sample(t, len(t))), "ja": lambda t: t.replace("水", "火").replace("山", "森"),
                 "en": lambda t: t.swapcase().replace("1984", "7520")}[lang](text)
        asked += [(lang + " fine", lang, text), (lang + " other", lang, other)]
    model = ngram_quality.train(spark.createDataFrame(known, "lang string, text string"))
    got = {r.doc: r.total / r.n for r in ngram_quality.log_probabilities(spark, spark.createDataFrame(asked, "doc string, lang string, text string"), model).collect()}
    assert all(got[lang + " other"] < got[lang + " fine"] - 0.5 for lang in names), got
    more = ngram_quality.train(spark.createDataFrame([("en", prose(pick, 400, 5000)) for _ in range(8)], "lang string, text string")).count()
    less = ngram_quality.train(spark.createDataFrame([("en", prose(pick, 400, 5000)) for _ in range(2)], "lang string, text string")).count()
    assert more > 1.5 * less


def test_quality_by_perplexity(spark):
    pick = random.Random(13)
    fine = lambda: " ".join(pick.choice(["the", "river", "of", "stone", "and", "water", "runs"]) for _ in range(60))
    junk = lambda: "".join(pick.choice("#$%&xzq|!") for _ in range(200))
    rows = [(i, "en", fine()) for i in range(60)] + [(100 + i, "en", junk()) for i in range(10)] + [(200, None, fine()), (201, "en", None), (202, "xx", "text"), (None, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100, 0, 0), (55, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ngram_quality.classified(docs, labels).collect()}
    assert len(got) == 73
    assert all(got[i].kept for i in range(60)) and not any(got[100 + i].kept for i in range(10))
    assert [(got[i].perplexity, got[i].kept) for i in (201, 202)] == [(None, False)] * 2 and got[200].lang == ""
    assert not any(r.kept for r in ngram_quality.classified(docs, labels.limit(0)).collect())


def test_paragraphs_do_not_depend_on_the_texts_beside_them():
    """A text is cut alike alone, between others and in a slice of another size."""
    pick = random.Random(31)
    texts = [prose(pick, pick.randrange(0, 60), 500).encode() for _ in range(300)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    _, starts, _, bounds, row = paragraph_dedup.paragraph_marks(data, offsets)
    for k, text in enumerate(texts):
        _, own, _, cuts, _ = paragraph_dedup.paragraph_marks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert (starts[bounds[:-1][row == k]] - offsets[k]).tolist() == own[cuts[:-1]].tolist()


def test_unlike_texts_are_given_up_early():
    """Pairs that are far apart take a part of the time of their full distances: a bound along the diagonal gives them up."""
    import time
    pick = random.Random(32)
    texts = [np.array([pick.randrange(25) for _ in range(pick.randrange(560, 620))], np.uint8) for _ in range(300)]
    a, b = texts[::2] * 8, texts[1::2] * 8
    most = np.full(len(a), 60)

    def took(limit):
        start = time.process_time()
        return paragraph_dedup.edit_distances(a, b, limit), time.process_time() - start

    (far, whole), (got, least) = took(None), took(most)
    assert (far > most).all() and (got > most).all() and (got <= far).all()
    assert min(least, took(most)[1]) < whole / 2


def test_components_of_long_chains_take_few_rounds(spark, monkeypatch):
    """Chains whose numbers rise, fall, or come by chance: the written tables grow with the logarithm of their length."""
    pick = random.Random(33)
    order = pick.sample(range(2000, 3000), 1000)
    links = [(k, k + 1) for k in range(500)] + [(1500 - k, 1499 - k) for k in range(500)] + list(zip(order[:-1], order[1:])) + [(5000, 5000), (None, 7)]
    written, settle = [], common.settle
    monkeypatch.setattr(common, "settle", lambda df: written.append(1) or settle(df))
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(501), 0), **dict.fromkeys(range(1000, 1501), 1000), **dict.fromkeys(order, 2000), 5000: 5000}
    assert len(written) < 60


def test_lower_case_of_all_texts_at_once():
    import pyarrow as pa
    for texts in (["Ab", None, "", "ÉÄß Ǆ"], ["Kelvin K", "Ⱥx", "a𐐀"], ["ΑΣ", "İx"], ["xİ"]):
        raw = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
        assert paragraph_dedup.lowered(raw).to_pylist() == [None if t is None else t.lower() for t in texts]
        assert paragraph_dedup.lowered(raw.slice(1)).to_pylist() == [None if t is None else t.lower() for t in texts[1:]]
