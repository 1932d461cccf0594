import numpy as np
import xxhash

from shopsignal.llm import simhash
from shopsignal.llm.queries import op5_simhash

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    ids, fps = [r[0] for r in rows], [r[1] for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for c, d in zip(comp, ids):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return {(d, f"{f:016x}", least.get(c)) for d, f, c in zip(ids, fps, comp)}


def test_query_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in rows])
    assert {tuple(r) for r in op5_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_edge_rows(spark):
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(70_000))
    rows = [(1, "a b c d e f"), (2, None), (3, ""), (None, " \n\t"), (4, "one"), (4, "one"), (5, "ONE"), (6, long), (7, long), (None, "lonely words here")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, root int")
    got = {(r.doc_id, f"{r.fingerprint % 2 ** 64:016x}", r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == slow_components([(d, slow_fingerprint(t)) for d, t in rows])
    kept = simhash.first_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "6", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def _link(spark, fps, radius=3, parts=None):
    signed = [(int(f) - (1 << 64) if int(f) >> 63 else int(f),) for f in fps]
    edges = simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"), radius, parts)
    return {frozenset((r.a, r.b)) for r in edges.collect()}, simhash.connected(edges).collect()


def test_links_random_and_dense(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2 ** 63, 3, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in rng.integers(0, 64, int(rng.integers(0, 5)))) for c in centre.repeat(120)]
    fps = sorted({*near, *map(int, rng.integers(0, 2 ** 63, 300, dtype=np.uint64))})
    want = {}
    for i, f in enumerate(fps):
        want.setdefault(i, i)
        for j in range(i):
            if (f ^ fps[j]).bit_count() <= 3:
                a, b = want[i], want[j]
                want = {k: (b if v == a else v) for k, v in want.items()}
    groups = {}
    for i, c in want.items():
        groups.setdefault(c, set()).add(fps[i])
    for hot, parts in ((20_000, 4), (20_000, 3), (7, 4), (20_000, 2)):
        monkeypatch.setattr(simhash, "HOT", hot)
        _, comps = _link(spark, fps, 3, parts)
        got = {}
        for r in comps:
            got.setdefault(r.root, set()).add(r.node % 2 ** 64)
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_thresholds_add_up():
    rng = np.random.default_rng(1)
    costs = [np.cumsum(rng.random((50, 4)), axis=1) for _ in range(4)]
    out = simhash.allocate(costs, 0)
    assert (out.sum(1) == 0).all() and (out >= -1).all()
    import itertools
    for i in range(50):
        least = min(sum(c[i, t + 1] for c, t in zip(costs, ts)) for ts in itertools.product(range(-1, 3), repeat=4) if sum(ts) == 0)
        assert abs(sum(c[i, t + 1] for c, t in zip(costs, out[i])) - least) < 1e-9
