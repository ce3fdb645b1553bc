import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import exact_dedup, minhash, queries, simhash
from gridloom.llm.common import spread_lookup


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_exact_equals_sql(spark, sf):
    duckdb.sql("SET TimeZone='UTC'")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = "doc_id, keep_id, group_size, kept, text_sha256"
    want = duckdb.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL['op5_exact_dedup']}) ORDER BY doc_id").fetchall()
    got = queries.op5_exact_dedup(spark, sf).select(*columns.split(", ")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want and sum(r.kept for r in got) < len(got)


@pytest.mark.parametrize("max_bits", [1 << 28, 1 << 15])
def test_exact_odd_rows(odd, empty, max_bits):
    rows = exact_dedup.decide(odd, max_bits=max_bits).collect()
    assert len(rows) == odd.count()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in groups.values())
    same = groups[hashlib.sha256(re.sub(r"[ \t\n\v\f\r]", "", "Some plain text of a few words, and then some more of it.").encode()).hexdigest()]
    assert sorted(r.doc_id for r in same) == [3, 5, 5] and {r.keep_id for r in same} == {3}  # the longest stays
    blank = groups[hashlib.sha256(b"").hexdigest()]
    assert sorted(r.doc_id for r in blank) == [7, 8, 9] and {r.keep_id for r in blank} == {8}
    kept = exact_dedup.deduplicate(odd, max_bits=max_bits)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.keep_id) for g in groups.values() for r in g[:1])
    assert exact_dedup.decide(empty).count() == exact_dedup.deduplicate(empty).count() == 0


def test_exact_saturated_filter_is_still_exact(spark):
    """More rows than the filter has bits: all of them shuffle, and the result is the same."""
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('text ', id % 50000) AS text")
    rows = exact_dedup.decide(docs, max_bits=1 << 15).selectExpr("sum(cast(kept AS int)) AS kept", "max(group_size) AS most").head()
    assert (rows.kept, rows.most) == (50_000, 2)


def test_exact_runs_no_python(odd):
    plan = exact_dedup.decide(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 4 else [" ".join(words[k : k + 4]) for k in range(len(words) - 3)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_all_pairs(spark, documents, texts):
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = components_of(ids, links)
    rows = simhash.components(documents).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and len(links) > 5
    assert {r.doc_id: r.fp % 2**64 for r in rows} == prints
    assert sorted(r.doc_id for r in simhash.deduplicate(documents).collect()) == sorted(set(want.values()))


def test_simhash_random_and_dense_groups(spark):
    """Chains and dense groups around some centres, against all pairs."""
    rng = np.random.default_rng(6)
    prints = list(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    for k in range(12):
        centre = prints[k]
        for _ in range(60 if k == 0 else 8):
            flips = rng.permutation(64)[: rng.integers(1, 6)]
            new = centre
            for f in flips:
                new ^= np.uint64(1) << np.uint64(f)
            prints.append(new)
            if k % 2:
                centre = new
    prints = np.unique(np.array(prints))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp bigint").repartition(4)
    links = [(int(a), int(b)) for k, a in enumerate(prints) for b in prints[k + 1 :][np.bitwise_count(prints[k + 1 :] ^ a) <= 4]]
    want = components_of([int(p) for p in prints], links)
    got = {r.fp % 2**64: r.root for r in simhash.connected(simhash.near_links(df)).collect()}
    assert got.keys() == {n for pair in links for n in pair}
    assert len({(want[n], r) for n, r in got.items()}) == len({want[n] for n in got}) == len(set(got.values()))
    with pytest.raises(ValueError):
        simhash.near_links(df, 5)


def test_a_hot_cell_is_dealt_over_tiles(spark):
    """Fingerprints that all share cells; tiles hold about two blocks and all links are found."""
    rng = np.random.default_rng(6)
    pairs = rng.integers(0, 2, (6000, 16), dtype=np.uint64)
    half = ((pairs + np.uint64(1)) << (np.uint64(2) * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)  # one bit of each two
    fps = (half << np.uint64(32)) | rng.integers(0, 1 << 32, 6000, dtype=np.uint64)
    near = fps[:800] ^ (np.uint64(1) << rng.integers(0, 32, 800, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 32, 800, dtype=np.uint64))
    fps = np.unique(np.concatenate([fps, near]))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    sizes = [r["count"] for r in simhash.dealt_cells(df, 1000).groupBy("cell").count().collect()]
    assert max(sizes) < 2600 and max(r["count"] for r in simhash.dealt_cells(df).groupBy("cell").count().collect()) > 6000
    want = {frozenset(p) for p in ((int(a), int(b)) for k, a in enumerate(fps) for b in fps[k + 1 :][np.bitwise_count(fps[k + 1 :] ^ a) <= 4])}
    parent = {int(f): int(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in map(sorted, want):
        parent[root(b)] = root(a)
    got = {r.fp % 2**64: r.root for r in simhash.connected(simhash.near_links(df, block=1000)).collect()}
    groups = {}
    for f in got:
        groups.setdefault(got[f], set()).add(f)
    plain = {}
    for f in {x for p in want for x in p}:
        plain.setdefault(root(f), set()).add(f)
    assert len(want) >= 700 and sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_cells_hold_every_near_pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for k in rng.permutation(64)[:4]:
            b[i] ^= np.uint64(1) << np.uint64(k)
    cells = []
    for fps in (a, b):
        held = defaultdict(set)
        for c, f in zip(*(x.tolist() for x in simhash.grid_cells(fps))):
            held[f].add(c)
        cells.append(held)
    assert all(cells[0][x] & cells[1][y] for x, y in zip(a.tolist(), b.tolist()))


def test_simhash_odd_rows(odd, empty):
    rows = simhash.components(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (7, 8, 9)} == {7} and {r.fp for r in rows if r.doc_id in (7, 8, 9)} == {0}
    assert {r.component_id for r in rows if r.doc_id in (3, 5)} == {3} and {r.component_id for r in rows if r.doc_id in (11, 12)} == {11}
    assert simhash.deduplicate(odd).columns == odd.columns
    assert simhash.components(empty).count() == simhash.deduplicate(empty).count() == 0


def test_spread_lookup_keeps_all_rows(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k")
    table = spark.createDataFrame([(7, "a"), (8, "b")], "k bigint, v string")
    assert spread_lookup(rows, "k", table).count() == 1667 + 1 + 0 + (1 if 7 % 3 else 0)
    assert spread_lookup(rows, "k", table, how="left").count() == 5000


def test_minhash_edited_texts(spark, documents, texts):
    ids = sorted(texts)
    rows = {r.doc_id: r for r in minhash.fingerprints_beside_next(documents).collect()}
    assert sorted(rows) == ids
    wide, narrow = [], []
    for doc, following in zip(ids, [*ids[1:], ids[0]]):
        text, other, r = texts[doc], texts[following], rows[doc]
        half = len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        shingles = [set(minhash.shingle_hashes(t).tolist()) for t in (text, changed, other)]
        assert r.fingerprint == minhash.as_text(minhash.signature(minhash.shingle_hashes(text)))
        assert r.edited_fingerprint == minhash.as_text(minhash.signature(minhash.shingle_hashes(changed)))
        wide.append(r.near_edited - len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]))
        narrow.append(r.near_next - len(shingles[0] & shingles[2]) / len(shingles[0] | shingles[2]))
    assert np.abs(wide).max() < 0.2 and abs(np.mean(wide)) < 0.02 and np.abs(narrow).max() < 0.2


def test_minhash_odd_rows(spark, odd, empty):
    rows = minhash.fingerprints_beside_next(odd).collect()
    assert len(rows) == odd.count()
    assert len({r.fingerprint for r in rows if r.doc_id in (7, 8, 9)}) == 1
    assert len({r.fingerprint for r in rows if r.doc_id == 5}) == 1
    assert minhash.fingerprints_beside_next(empty).count() == 0
    one = odd.filter("doc_id = 4")
    r = minhash.fingerprints_beside_next(one).head()
    assert r.near_next == 1.0


@pytest.mark.parametrize("block", [1000, 2])
def test_minhash_links(spark, block):
    """All links between different texts, against all pairs; copies are one class."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(200)]
    made = {1: base, 3: base, 4: [f"v{k}" for k in range(200)], 5: base[:100] + [f"u{k}" for k in range(100)]}
    for doc in range(10, 22):  # near copies of one text, with a few words changed at the end
        made[doc] = base[: 200 - int(rng.integers(1, 12))] + [f"x{doc}"]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in made.items()] + [(6, None), (None, "a b")], "doc_id bigint, text string")
    got = {(r.a, r.b): r.jaccard for r in minhash.near_duplicates(docs, block=block).collect()}
    sets = {k: {tuple(t[j : j + 5]) for j in range(len(t) - 4)} for k, t in made.items() if k != 3}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {p: j for p, j in want.items() if j >= 0.8}
    assert got.keys() == want.keys() and len(want) > 60
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)


def jaccard_components(rows, threshold=0.8):
    """Groups of places in rows (doc_id, text) by all pairs of 5-word shingle sets."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[j : j + 5]) for j in range(max(len(words) - 4, 1))})
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    return components_of(range(len(rows)), links), links


def survivors(rows):
    """The text of each group's row with the least doc_id, nulls last."""
    groups = defaultdict(list)
    for k, top in jaccard_components(rows)[0].items():
        groups[top].append((rows[k][0] is None, rows[k][0] or 0, k))
    return sorted((str(rows[k][0]), " ".join((rows[k][1] or "").split()).lower()) for _, _, k in map(min, groups.values()))


def kept_by_stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return sorted((str(r.doc_id), " ".join((r.text or "").split()).lower()) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())


def test_near_stage_equals_all_pairs_by_jaccard(spark, texts):
    """Texts of which one or two of a hundred words were changed; before, most copies stayed."""
    rng, rows = np.random.default_rng(9), sorted(texts.items())
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(100, 1000))]
        for step in range(3):
            rows.append((10_000 + 10 * k + step, " ".join(words)))
            for j in rng.permutation(len(words))[: max(1, len(words) * (1 + k % 2) // 100)]:
                words[j] = f"x{rng.integers(0, 5000)}"
    assert len(jaccard_components(rows)[1]) > 80
    assert kept_by_stage(spark, rows) == survivors(rows)


def test_near_stage_rows_of_one_doc_id(spark):
    """Rows with one doc_id, or with none, are rows of their own."""
    near, alone = [f"a{k}" for k in range(200)], [f"b{k}" for k in range(200)]
    text = " ".join
    rows = [(1, text(near)), (2, text([*near[:-1], "z"])), (2, text(alone)), (3, text(["q", *alone[1:]])), (3, text(["r", *alone[1:]])), (None, text(["y", *near[1:]])), (None, text([f"c{k}" for k in range(200)])), (None, text([f"c{k}" for k in range(199)]))]
    assert kept_by_stage(spark, rows) == survivors(rows) and len(survivors(rows)) == 3


@pytest.mark.parametrize("block", [1000, 7])
def test_class_links_of_a_dense_group(spark, block):
    """A dense group and chains in a few keys, whole and dealt over parts."""
    rng, sets = np.random.default_rng(4), []
    for k in range(6):
        own = np.unique(rng.integers(0, 1 << 32, 200, dtype=np.uint32))
        for _ in range(40 if k == 0 else 8):
            new = own.copy()
            new[rng.permutation(len(new))[: rng.integers(1, 22)]] = rng.integers(0, 1 << 32, 1, dtype=np.uint32)
            sets.append(np.unique(new))
            own = sets[-1] if k % 2 else own
    rows = [(k, s.tobytes(), [0, k % 3]) for k, s in enumerate(sets)]
    classes = spark.createDataFrame(rows, "id bigint, hashes binary, bands array<bigint>").repartition(3)
    plain = [set(s.tolist()) for s in sets]
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(plain[a] & plain[b]) / len(plain[a] | plain[b]) >= 0.8]
    got = [(r.a, r.b) for r in minhash.class_links(classes, 0.8, block).collect()]
    assert {tuple(sorted(p)) for p in got} <= set(links)
    assert components_of(range(len(sets)), got) == components_of(range(len(sets)), links) and len(links) > 200


def test_ranges_are_looked_up_in_two_levels(spark):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 17, 100):
        cuts = sorted(set(rng.integers(-50, 50, n).tolist()))
        rows = spark.range(-60, 61).select("id", minhash._cuts_up_to(F.col("id"), cuts).alias("n")).collect()
        assert all(r.n == sum(c <= r.id for c in cuts) for r in rows)


def test_columns_of_the_caller_keep_their_names(spark):
    """Columns named as an operator's own ones, in any case, come back as they were."""
    names = ["doc_id", "__near_row", "text", "row", "id", "tile", "root", "best", "__dedup_row", "__dedup_sha", "fp", "__salt", "class", "ROOT2", "__of_caller_1"]
    rows = [tuple(f"c{k}-{j}" if c not in ("doc_id", "text") else k if c == "doc_id" else ("some words that repeat in all of these texts here " * 4 + str(k % 2)) for j, c in enumerate(names)) for k in range(5)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'bigint' if c == 'doc_id' else 'string'}" for c in names))
    for operator in (minhash.deduplicate, exact_dedup.deduplicate, simhash.deduplicate):
        kept = operator(docs)
        assert kept.columns == names and 1 <= kept.count() <= 2
        assert set(map(tuple, kept.collect())) <= set(rows)


def test_links_of_sets_join_as_all_pairs_do():
    """Families of near sets, unlike ones, and sets of one and no value."""
    rng = np.random.default_rng(13)
    for _ in range(30):
        base = [rng.choice(1000, 40, replace=False) for _ in range(4)]
        sets = [np.unique(np.concatenate([b[rng.random(40) < 0.95], rng.choice(1000, 2)])).astype(np.uint32) for b in base for _ in range(6)]
        sets += [np.array([1], np.uint32), np.array([1], np.uint32), np.array([2], np.uint32)]
        rng.shuffle(sets)
        near = [(a, b) for a in range(len(sets)) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
        found = minhash.set_links(sets, 0.8)
        assert {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in near}

        def groups(links):
            root = list(range(len(sets)))
            for a, b in links:
                ra, rb = root[a], root[b]
                root = [ra if r == rb else r for r in root]
            return [root.index(r) for r in root]

        assert groups(found) == groups(near)


def test_many_unlike_sets_are_quick():
    import time

    rng, began = np.random.default_rng(14), time.time()
    assert minhash.set_links([np.unique(rng.integers(0, 1 << 32, 1000, dtype=np.uint32)) for _ in range(2000)], 0.8) == []
    assert time.time() - began < 5
