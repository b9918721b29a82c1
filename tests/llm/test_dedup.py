import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from keyloom.llm import registry
from keyloom.llm.bloom import size_for
from keyloom.llm.exact_dedup import Patricia, drop_exact_duplicates, duplicate_groups
from keyloom.llm.line_dedup import dedup_lines
from keyloom.llm.minhash import Circulant, connected, near_duplicates, shingle_sets
from keyloom.llm.substring_dedup import remove_repeated_passages
from tests.llm.helpers import SF, odd_documents, same_as_sql


@pytest.mark.parametrize("name", ["op3_line_dedup", "op4_exact_dedup", "op5_substring_dedup"])
def test_query_matches_sql(spark, name):
    same_as_sql(registry.queries()[name](spark, SF), registry.oracle_sql()[name])


def test_patricia_finds_equal_strings_only():
    rnd = random.Random(1)
    trie, seen = Patricia(), {}
    for _ in range(5000):
        s = bytes(rnd.choices(b"ab", k=rnd.randrange(12)))
        node = trie.node(s)
        assert seen.setdefault(s, node) is node
    assert len({id(n) for n in seen.values()}) == len(seen)


def brute_words(text):
    return [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]


def test_exact_dedup_cases(spark, monkeypatch):
    rows = [(1, "Ab"), (5, "aB"), (None, "ab"), (5, "ab"), (2, None), (3, ""), (None, "solo"), (7, "É"), (8, "é"), (9, "x" * 100_000), (10, "X" * 100_000)]
    df = odd_documents(spark, rows)
    for limit in (1, 1 << 20):
        monkeypatch.setattr("keyloom.llm.exact_dedup._OWNER_BYTES", limit)
        got = duplicate_groups(df, keep="largest").collect()
        assert len(got) == len(rows)
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got if r.doc_id is not None) == [(1, 5, 4), (2, 3, 2), (3, 3, 2), (5, 5, 4), (5, 5, 4), (7, 7, 1), (8, 8, 1), (9, 10, 2), (10, 10, 2)]
        assert sum(r.kept for r in got) == 6 and sum(r.kept for r in got if r.doc_id == 5) == 1
    assert {r.keep_id for r in duplicate_groups(df).collect()} == {1, 2, None, 7, 8, 9}
    kept = drop_exact_duplicates(df, keep="largest")
    assert kept.columns == df.columns and sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == [(0, 4), (3, 0), (5, 2), (7, 1), (8, 1), (10, 100_000)]
    assert {(r.kept, r.id, r.row) for r in kept.collect()} == {(None, "x", "y")}
    assert duplicate_groups(df.limit(0)).count() == 0 and drop_exact_duplicates(df.limit(0)).count() == 0


def brute_lines(rows, least=40, docs=5):
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append(d)
    keep = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(k) >= least and len(v) >= docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keep.get(key(x)) is None or keep[key(x)] == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_cases(spark):
    long, other = "a line of Some forty characters or more, éé", "z" * 39 + "é"
    rows = [(i, f"head {i}\n {long} \n\nx") for i in range(6)] + [(6, long.upper().replace("É", "é")), (6, long), (None, long + "\n" + long), (8, None), (9, ""), (10, "\n\n")]
    rows += [(20 + i, other) for i in range(4)] + [(30, other + "\r\n" + "b" * 50_000)] + [(None, "only null holders of this line, it has forty or more")] * 5
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    for bits in (None, 64 * 8):  # a filter that is full only suspects more
        got = [tuple(r) for r in dedup_lines(odd_documents(spark, rows), bits=bits).collect()]
        assert sorted(got, key=key) == sorted(brute_lines(rows), key=key)
    assert dedup_lines(odd_documents(spark, rows).limit(0)).count() == 0


def brute_spans(rows, k):
    count = defaultdict(int)
    words = [brute_words(t) for _, t in rows]
    for w in words:
        for i in range(len(w) - k + 1):
            count[tuple(w[i : i + k])] += 1
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - k + 1) if count[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((d, " ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone)))
    return out


@pytest.mark.parametrize("window", [1, 2, 5, 35])
def test_substring_dedup_cases(spark, window, monkeypatch):
    monkeypatch.setattr("keyloom.llm.substring_dedup._WORDS_HELD", 300)
    rnd = random.Random(window)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "W1"]
    shared = [" ".join(rnd.choices(vocabulary, k=n)) for n in (window, window + 1, window - 1 or 1, 80)]
    rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(60))) + rnd.choice([" ", "\n"]) + rnd.choice([*shared, "", ""]) + "\t" + " ".join(rnd.choices(vocabulary, k=rnd.randrange(60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x " * 3000), (103, "a b c " * 40), (None, shared[3]), (7, rows[7][1]), (7, rows[7][1]), (None, None)]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [tuple(r) for r in remove_repeated_passages(odd_documents(spark, rows), window=window).collect()]
    assert sorted(got, key=key) == sorted(brute_spans(rows, window), key=key)
    assert remove_repeated_passages(odd_documents(spark, rows).limit(0), window=window).count() == 0


def brute_components(rows, threshold=75, k=5):
    sets = []
    for _, t in rows:
        w = brute_words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = [*range(len(rows))]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= threshold * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    low = {r: min((x for x in v if x is not None), default=None) for r, v in least.items()}
    return [(d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows)]


def test_minhash_cases(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(12):
        base = rnd.choices(vocabulary, k=rnd.randrange(1, 160))
        chain = list(base)
        for _ in range(rnd.randrange(1, 9)):
            if rnd.random() < 0.5:  # a chain, whose ends need not be linked themselves
                chain[rnd.randrange(len(chain))] = rnd.choice(vocabulary)
                words = chain
            else:
                words = [rnd.choice(vocabulary) if rnd.random() < 0.02 else w for w in base]
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "One two"), (n + 4, "one\tTWO"), (None, "one two"), (None, "alone in the world is this row"), (3, rows[3][1].upper()), (3, rows[3][1]), (n + 5, "x " * 30_000), (n + 6, "X " * 30_000)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    got = [tuple(r) for r in near_duplicates(odd_documents(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)
    assert near_duplicates(odd_documents(spark, rows).limit(0)).count() == 0


def test_minhash_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in registry.op6_minhash(spark, SF).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(5)
    maker = Circulant(512, 4)
    base = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    for common in (150, 300, 450):
        other = np.concatenate([base[:common], rng.integers(0, 1 << 63, 600 - common).astype(np.uint64)])
        a, b = maker.signatures([base, other])
        assert abs((a == b).mean() - common / (1200 - common)) < 0.08
    pi = maker.shifted[:, 0]
    one = np.array([12345], dtype=np.uint64)
    assert sorted(set(pi.tolist()))[:3] == [0, 1, 2] and len(shingle_sets([b""])[0]) == 0 and maker.signatures([one]).shape == (1, 512)


def test_connected_components(spark):
    pairs = [(b"%03d" % a, b"%03d" % b) for a, b in [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (12, 11), (20, 20), (7, 30), (30, 6), *[(50, i) for i in range(51, 90)]]]
    got = {r.node: r.label for r in connected(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in pairs], "a binary, b binary")).collect()}
    assert {bytes(k): bytes(v) for k, v in got.items()} == {b"%03d" % i: b"001" for i in (2, 3, 4, 5)} | {b"011": b"010", b"012": b"010", b"030": b"006", b"007": b"006"} | {b"%03d" % i: b"050" for i in range(51, 90)}


def test_filter_sizes_are_bounded():
    assert size_for(0) == 1 << 20 and size_for(1 << 40) == 1 << 29 and hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_links_of_a_block_match_all_pairs(monkeypatch):
    from keyloom.llm.minhash import _links

    monkeypatch.setattr("keyloom.llm.minhash._CELLS", 1000)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(25, 40), replace=False), rng.integers(0, 1 << 63, rng.integers(0, 4)).astype(np.uint64)])) for _ in range(60)]
    labels, names = [b"%d" % (i % 7) for i in range(60)], [b"n%02d" % i for i in range(60)]
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    want = {frozenset((labels[i], labels[j])) for i in range(60) for j in range(i) if labels[i] != labels[j] and near(sets[i], sets[j])}
    got = [(names.index(a), names.index(b)) for batch in _links(names, labels, sets, 75) for a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
    assert all(near(sets[i], sets[j]) for i, j in got) and {frozenset((labels[i], labels[j])) for i, j in got} == want and len(got) == len(want) > 0


def test_longest_matches_and_greedy_factors():
    from keyloom.llm.substring_dedup import factors, longest_elsewhere

    rnd = random.Random(8)
    for most in (1, 5, 20):
        phrases = [[rnd.randrange(4) if rnd.random() < 0.7 else 100 + rnd.randrange(10**6) for _ in range(rnd.randrange(1, most + 1))] for _ in range(40)]
        n = np.array([len(p) for p in phrases])
        flat = [x for p in phrases for x in p]
        ends = np.repeat(np.cumsum(n), n).tolist()
        letter = np.unique(np.array(flat), return_inverse=True)[1]

        def common(i, j, flat=flat, ends=ends):
            k = 0
            while i + k < ends[i] and j + k < ends[j] and flat[i + k] == flat[j + k]:
                k += 1
            return k

        want = [max((common(i, j) for j in range(len(flat)) if j != i), default=0) for i in range(len(flat))]
        got = longest_elsewhere(letter, n)
        assert got.tolist() == want
        row, place, length = factors(got, n, np.arange(len(n)) % 3 > 0)
        covered = {(r, p + i) for r, p, k in zip(row.tolist(), place.tolist(), length.tolist(), strict=True) for i in range(k)}
        first = (np.cumsum(n) - n).tolist()
        assert covered == {(r, p) for r, m in enumerate(n.tolist()) if r % 3 for p in range(m) if want[first[r] + p]}


def test_passages_that_straddle_factors_and_a_crowded_anchor(spark, monkeypatch):
    """Documents with one 30-word boilerplate each share an anchor and no window; windows that begin in one source and end in
    another are found."""
    monkeypatch.setattr("keyloom.llm.bloom._MANY", 2)
    monkeypatch.setattr("keyloom.llm.bloom._CROWD", 20)
    rnd = random.Random(12)
    some = lambda k: [f"w{rnd.randrange(10**7)}" for _ in range(k)]
    plate, a, b = some(30), some(60), some(60)
    rows = [(i, " ".join(some(40) + plate + some(40))) for i in range(300)]
    rows += [(1000, " ".join(some(50) + a[20:] + b[:40] + some(50))), (1001, " ".join(a + some(10))), (1002, " ".join(some(10) + b)), (1003, " ".join(some(3) + a[40:] + b[:20] + some(3)))]
    got = [tuple(r) for r in remove_repeated_passages(odd_documents(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_spans(rows, 35)) and sum(r[3] for r in got) > 100


def test_crowds_deal_letters_apart(spark):
    """Only hashes of very many rows are told as crowds."""
    from keyloom.llm.bloom import repeated_hashes

    docs = spark.range(5000).selectExpr("id", "cast(cast(id % 7 as string) as binary) AS text")
    hashes = lambda batch: np.array([7 if int(x) % 2 else 1000 + int(x) for x in batch.column(0).to_pylist()], dtype=np.uint64)
    has, crowded = repeated_hashes(docs, hashes, 1 << 20, crowd=True)
    assert crowded(np.array([7, 1002], dtype=np.uint64)).tolist() == [True, False] and has(np.array([7, 1002, 3], dtype=np.uint64)).tolist() == [True, False, False]


def test_minhash_large_bucket(spark, monkeypatch):
    """A family of short texts that meet in the same buckets without all being linked, in blocks of few sets."""
    monkeypatch.setattr("keyloom.llm.minhash._SETS", 16)
    rnd = random.Random(21)
    base = [f"w{i}" for i in range(24)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randrange(0, 4)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(6)}"
        rows.append((i, " ".join(words)))
    got = [tuple(r) for r in near_duplicates(odd_documents(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_components(rows))
