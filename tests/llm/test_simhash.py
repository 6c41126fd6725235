import numpy as np
import pytest
import xxhash

from metertide.llm.components import components, forest
from metertide.llm.simhash import (
    Pigeonhole,
    allocate,
    fingerprint,
    group_correlated,
    keys_of,
    link_by_rare_shingles,
    link_fingerprints,
    near_duplicates,
    plan_pigeonhole,
    shingle_hashes,
    similar_within,
    similarity_limit,
    verify_similarity,
    without_near_duplicates,
)
from tests.llm import samples


def plain_fingerprint(text, words=3):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    count = max(1, len(parts) - words + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), 42) for i in range(count)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, limit=3):
    """Component by row, for rows of (doc_id, fingerprint)."""
    reach = {i: {i} for i in range(len(prints))}
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= limit or prints[i][0] == prints[j][0]:
                reach[i].add(j)
                reach[j].add(i)
    result = []
    for i in range(len(prints)):
        seen, todo = {i}, [i]
        while todo:
            new = reach[todo.pop()] - seen
            seen |= new
            todo += new
        result.append(min(prints[j][0] for j in seen))
    return result


@pytest.mark.parametrize("text", ["", "one", "one two", "a b c d e a b c", "Ü É ß ÀB cd " * 9])
def test_fingerprint_of_a_text(text):
    assert fingerprint(shingle_hashes(text, 3))[0] == plain_fingerprint(text)


def test_components_of_all_documents(spark):
    rows = samples.rows(150)
    found = near_duplicates(samples.documents(spark, 150), 3, 64, 3).collect()
    assert len(found) == len(rows)
    named = [r for r in rows if r[0] is not None]
    prints = [(r[0], plain_fingerprint(r[1])) for r in named]
    expected = dict(zip((p[0] for p in prints), plain_components(prints), strict=True))
    assert len(set(expected.values())) < len(set(expected))
    for row in found:
        if row["doc_id"] is None:
            assert row["component"] is None
        else:
            assert row["component"] == expected[row["doc_id"]]
    assert {(r["doc_id"], r["w0"] % 2**64) for r in found if r["doc_id"] is not None} == set(prints)


def near_rows(count, bits, seed):
    """Dense clusters of near fingerprints among random ones."""
    rng = np.random.default_rng(seed)
    words = bits // 64
    base = rng.integers(0, 2**63, (count, words), dtype=np.int64)
    for i in range(count // 3):
        base[i] = base[0] if i % 2 else base[1]
        for _ in range(rng.integers(0, 6)):
            word = rng.integers(words)
            base[i, word] ^= np.int64(1) << np.int64(rng.integers(63))
    return np.unique(base, axis=0)


@pytest.mark.parametrize(("bits", "limit", "key_rows"), [(64, 3, 1 << 18), (64, 3, 40), (128, 9, 50), (64, 6, 30)])
def test_links_connect_what_all_links_connect(spark, bits, limit, key_rows):
    table = near_rows(600, bits, limit)
    names = [f"w{i}" for i in range(bits // 64)]
    rows = [(i, *map(int, row)) for i, row in enumerate(table)]
    df = spark.createDataFrame(rows, "rep long, " + ", ".join(f"{n} long" for n in names))
    links = link_fingerprints(df, bits, limit, key_rows).collect()
    words = table.view(np.uint64)
    near = [
        (i, j)
        for i in range(len(words))
        for j in np.flatnonzero(np.bitwise_count(words[:i] ^ words[i]).sum(axis=1) <= limit).tolist()
    ]
    assert near

    def grouped(pairs):
        a, b = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        return {frozenset([x, y]) for x, y in zip(*(z.tolist() for z in forest(a, b)), strict=True)}

    assert grouped(near) == grouped([tuple(x) for x in links])


def test_partitions_catch_every_pair_within_the_limit():
    rng = np.random.default_rng(2)
    ones = rng.integers(0, 2, (400, 64), dtype=np.uint8)
    both = ones.astype(float).T @ ones
    for limit in (0, 1, 3, 7):
        plan = plan_pigeonhole(400, both, limit)
        assert sorted(b for p in plan.partitions for b in p) == list(range(64))
        assert sum(t + 1 for t in plan.thresholds) > limit
        other = ones.copy()
        for row in other:
            row[rng.choice(64, limit, replace=False)] ^= 1
        a, b = keys_of(ones, plan), keys_of(other, plan)
        assert a.shape[1] == plan.rows()
        assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_thresholds_are_the_cheapest():
    from itertools import product

    rng = np.random.default_rng(4)
    costs = [[0.0, *np.sort(rng.random(4)).tolist()] for _ in range(4)]
    cost, chosen = allocate(costs, 3)
    every = [
        sum(c[g] for c, g in zip(costs, given, strict=True))
        for given in product(range(5), repeat=4)
        if sum(given) > 3
    ]
    assert cost == pytest.approx(min(every))
    assert sum(t + 1 for t in chosen) > 3


def test_more_rows_make_the_keys_longer():
    both = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    few, many = (plan_pigeonhole(n, both * n, 3) for n in (10**4, 10**9))
    assert len(many.partitions) < len(few.partitions)
    assert isinstance(many, Pigeonhole)


def test_correlated_bits_share_a_partition():
    correlation = np.eye(8)
    for a, b in ((0, 5), (1, 6)):
        correlation[a, b] = correlation[b, a] = 0.9
    parts = group_correlated(correlation, 4)
    assert [0, 5] in parts and [1, 6] in parts


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert {r["node"]: r["component"] for r in found} == expected
    assert len(found) == len(expected)


def test_one_document_of_each_group_stays(spark):
    docs = samples.documents(spark)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    by_text = {}
    for row in samples.rows():
        if row[0] is not None:
            by_text.setdefault(row[1] or "", []).append(row[0])
    assert None in ids  # no id, so no group
    for copies in by_text.values():
        assert not (set(copies) - {min(copies)}) & set(ids)
    assert 1004 in ids and 1005 not in ids


def test_near_copies_go_and_others_stay(spark):
    import random

    rng = random.Random(8)
    plain = [samples.prose(rng, "en", 150) for _ in range(60)]
    copies = []
    for text in plain[:30]:
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        copies.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(plain + copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {r["doc_id"] for r in without_near_duplicates(docs).collect()}
    assert set(range(60)) <= ids
    assert len(ids - set(range(60))) <= 1


def random_sets(seed, count=80):
    rng = np.random.default_rng(seed)
    result = []
    for i in range(count):
        if i % 3 and result:
            base = result[rng.integers(len(result))]
            kept = base[rng.random(len(base)) > rng.choice([0.02, 0.1, 0.25])]
            result.append(np.union1d(kept, rng.integers(0, 2**60, rng.integers(0, 6)).astype(np.uint64)))
        else:
            result.append(np.unique(rng.integers(0, 2**60, rng.integers(0, 60)).astype(np.uint64)))
    return result


def similar_groups(sets, similarity):
    links = [
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets[:i])
        if len(np.intersect1d(a, b)) >= similarity * len(np.union1d(a, b))
    ]
    a, b = (np.array(x, dtype=np.int64) for x in zip(*links, strict=True))
    return {tuple(x) for x in zip(*(z.tolist() for z in forest(a, b)), strict=True)}


@pytest.mark.parametrize("seed", range(4))
def test_sets_are_connected_as_by_all_pairs(seed):
    sets = random_sets(seed)
    a, b = (np.concatenate(x) for x in zip(*similar_within(sets, 0.8), strict=True))
    found = {tuple(x) for x in zip(*(z.tolist() for z in forest(a, b)), strict=True)}
    assert found == similar_groups(sets, 0.8)


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_components_are_verified_by_whole_texts(spark, block_rows):
    texts = [t for t in samples.texts(90) if t]
    sets = [np.unique(shingle_hashes(t, 5)) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(i, 0 if i < 70 else i // 2) for i in range(len(texts))]
    classes = spark.createDataFrame(rows, "rep long, component long")
    links = verify_similarity(docs, classes, 5, 0.8, block_rows).collect()
    a, b = (np.array(x, dtype=np.int64) for x in zip(*links, strict=True))
    found = {tuple(x) for x in zip(*(z.tolist() for z in forest(a, b)), strict=True)}
    own = similar_groups(sets[:70], 0.8)
    for i in range(70, len(texts) - 1, 2):
        if len(np.intersect1d(sets[i], sets[i + 1])) >= 0.8 * len(np.union1d(sets[i], sets[i + 1])):
            own.add((i + 1, i))
    assert found == own


def test_similarity_as_bits():
    assert similarity_limit(1.0, 64) == 0
    assert similarity_limit(0.8, 128, slack=0) == 19
    assert similarity_limit(0.8, 128) > 19


def test_empty_table(spark):
    empty = samples.empty(spark)
    assert near_duplicates(empty).count() == 0
    assert without_near_duplicates(empty).count() == 0


def similar_texts(seed=5):
    """Texts of 8 to 300 words, and copies at about the similarity 0.8, by an added word or changes."""
    import random

    rng = random.Random(seed)
    texts = []
    for i in range(120):
        words = [f"w{rng.randrange(10**9)}" for _ in range([8, 9, 10, 40, 120, 300][i % 6])]
        texts.append(" ".join(words))
        if i % 6 < 3:
            texts.append(" ".join([*words, "more"]))
        else:
            for place in range(0, len(words), 46):
                words[place + rng.randrange(min(40, len(words) - place))] = "changed"
            texts.append(" ".join(words))
    return texts


def test_all_pairs_of_the_similarity_are_linked(spark):
    texts = similar_texts()
    texts += ["one common line that many texts have in them " * 2 + t for t in texts[:20]]
    sets = [np.unique(shingle_hashes(t, 5)) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ids = {r["doc_id"] for r in without_near_duplicates(docs).collect()}
    expected = set(range(len(texts))) - {a for a, _ in similar_groups(sets, 0.8)}
    assert ids == expected
    assert 100 < len(expected) < len(texts) - 40


@pytest.mark.parametrize("key_rows", [1 << 14, 8])
def test_rare_shingles_connect_all_similar_sets(spark, key_rows):
    texts = similar_texts(6) + similar_texts(7)[:30] * 3
    sets = [np.unique(shingle_hashes(t, 5)) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "rep long, text string").repartition(3)
    links = link_by_rare_shingles(rows, 5, 0.8, key_rows).collect()
    a, b = (np.array(x, dtype=np.int64) for x in zip(*links, strict=True))
    first = dict(zip(*(z.tolist() for z in forest(a, b)), strict=True))
    assert all(first.get(i, i) == first.get(j, j) for i, j in similar_groups(sets, 0.8))
