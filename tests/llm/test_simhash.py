import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwell.llm import simhash as op
from tarnwell.llm.graph import connected_components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB É\t\n ", max_size=60))
def test_fingerprint(text):
    assert op.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 22, 4000)
    near = words ^ (1 << rng.integers(0, 22, 4000)) ^ (1 << rng.integers(0, 22, 4000))
    for row_a, key_a, row_b, key_b in [(*op.fuzzy_keys(words, 22), *op.fuzzy_keys(near, 22))]:
        a, b = set(zip(row_a.tolist(), key_a.tolist())), set(zip(row_b.tolist(), key_b.tolist()))
        assert len({r for r, _ in a & b}) == 4000
        assert np.bincount(row_a).max() <= 6


def components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def partition(labels):
    groups = {}
    for i, x in enumerate(labels):
        groups.setdefault(x, set()).add(i)
    return {frozenset(g) for g in groups.values()}


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = list(base)
    for i in range(400):
        x = fps[int(rng.integers(len(fps)))]
        for _ in range(int(rng.integers(1, 4))):
            x ^= 1 << int(rng.integers(64))
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    for small in (32, 3, 1):  # pairs alone, both ways, and the exact way for crowded buckets alone
        label = {r.node: r.component for r in connected_components(op.links(df, small)).collect()}
        assert partition([label.get(x, x) for x in signed]) == partition(components(fps)), small


def test_near_duplicates(spark):
    words = " ".join(f"w{i}" for i in range(400))
    rows = [(5, words, 1), (3, words, 1), (9, words.upper(), 2), (1, "something else entirely here", 3), (7, None, 4), (8, " \n", 4), (None, words, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op.near_duplicates(df).collect()}
    assert got[5][1] == got[3][1] == got[9][1] == got[None][1] == 3
    assert got[7] == ("0" * 16, 7) and got[8] == ("0" * 16, 7) and got[1][1] == 1
    assert sorted(r.doc_id for r in op.drop_near_copies(df).collect()) == [1, 3, 7]


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_empty_table(spark):
    assert op.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_one_row_of_each_component_whatever_the_ids(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    left = lambda rows: sorted(((r.doc_id, r.text) for r in op.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    # A null id beside a component's least id does not take the other null ids along.
    assert left([(1, a), (None, a), (None, b)]) == sorted([(1, a), (None, b)], key=str)
    # A repeated id over different texts: each component keeps a row.
    assert left([(1, a), (5, a), (5, b), (7, b), (5, c)]) == sorted([(1, a), (5, b), (5, c)], key=str)
    # Components of null ids alone, and repeated rows, keep one.
    assert left([(None, a), (None, a), (2, b), (2, b)]) == sorted([(None, a), (2, b)], key=str)


def test_crowded_buckets_are_refined_by_golay_keys(spark):
    """Fingerprints of one first segment: few parts stay crowded, and links are those of all pairs."""
    rng = np.random.default_rng(8)
    fps = [int(x) << 22 | 5 for x in rng.integers(0, 1 << 41, 300)]
    fps += [x ^ 1 << int(rng.integers(22, 64)) for x in fps[:100]]
    signed = np.array(fps, np.uint64).view(np.int64)
    bucket = np.repeat(op.buckets(signed[:1])[1][:1], len(signed))
    rows, parts = op.refined(bucket, signed)
    assert set(rows.tolist()) == set(range(len(signed))) and np.unique(parts, return_counts=True)[1].max() <= op.SMALL
    df = spark.createDataFrame([(int(x),) for x in signed], "fp bigint")
    label = {r.node: r.component for r in connected_components(op.links(df, 8)).collect()}
    assert partition([label.get(int(x), int(x)) for x in signed]) == partition(components([int(x) & (1 << 64) - 1 for x in signed]))


def test_clashing_names_in_the_pipeline_stage(spark):
    words = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, words, 1, 1), (2, words, 2, 2), (3, "other", 3, 3)], "doc_id bigint, text string, near_id int, near_sha int")
    got = op.drop_near_copies(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_very_long_text(spark):
    text = "ab cd ef " * 300_000
    got = op.near_duplicates(spark.createDataFrame([(1, text), (2, text + "x")], "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {1}
