import numpy as np
import xxhash

from pageframe.llm import components, simhash
from pageframe.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, node int"


def brute(rows):
    """rows: (doc_id, text). Fingerprints and classes by all pairs."""
    prints = []
    for _, text in rows:
        words = [w for w in (text or "").encode().lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        value = 0
        for bit in range(64):
            ones = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
            value |= (2 * ones > len(shingles)) << bit
        prints.append(value)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    ids = {x: min(rows[i][0] for i in range(len(rows)) if label[i] == x) for x in label}
    return {rows[i][0]: (f"{prints[i]:016x}", ids[label[i]]) for i in range(len(rows))}


def test_classes_match_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "ÉCLAIR", "x y"]
    base = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    rows = [(i + 5, t) for i, t in enumerate(base)]
    for i in range(60):
        parts = base[i % 12].split(" ")
        parts[rng.integers(len(parts))] = "changed"
        rows.append((100 + i, "\n".join(parts)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "one two"), (905, "y " * 30000), (906, rows[0][1].upper())]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA)
    found = simhash.near_duplicate_classes(docs)
    got = {r.doc_id: (r.f, r.component_id) for r in found.select("doc_id", simhash.hex_digits(found.fp).alias("f"), "component_id").collect()}
    assert got == brute(rows)


def test_hot_keys_are_cut_into_blocks(spark):
    rng = np.random.default_rng(2)
    start = int(rng.integers(1 << 62))
    near = {start}
    while len(near) < 400:
        x = list(near)[int(rng.integers(len(near)))]
        near.add(x ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    far = [int(x) for x in rng.integers(1 << 62, size=200)]
    prints = [simhash.signed(x) for x in [*near, *far]]
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate(prints)], "fp long, node long")
    got = {r.node: r.component for r in connected_components(simhash.near_links(nodes, block=50)).collect()}
    label = list(range(len(prints)))
    values = np.array(prints, np.int64).view(np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label] if a != b else label
    assert got == {i: x for i, x in enumerate(label) if x != i}


def test_keys_are_counted_by_bucket_and_links_made_in_one_python_step(spark, monkeypatch):
    plans = {}

    def seen(real):
        return lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and real(df, name)

    monkeypatch.setattr(simhash, "written", seen(simhash.written))
    monkeypatch.setattr(components, "written", seen(components.written))
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(500, 60).astype(str))) for i in range(20)], "doc_id long, text string")
    assert simhash.text_classes(docs).count() == 20
    assert "pmod(xxhash64(" in plans["crowded"] and "keys=[kind#" not in plans["crowded"]
    assert "BroadcastExchange" in plans["many"] or "SortMergeJoin" in plans["many"]
    assert plans["links"].count("MapInArrow") == 1


def test_pigeonring_patterns_find_every_close_pair():
    rng = np.random.default_rng(3)
    for segments in (5, 6, 7, 8):
        patterns = simhash.key_patterns(segments, 4)
        for _ in range(300):
            diff = 0
            for place in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                diff |= 1 << int(place)
            hits = [s for s, mask in patterns if not diff & mask]
            assert any(simhash.within_chain(np.array([diff], np.uint64), np.array([s]), segments, 4)[0] for s in hits)


def test_empty_table_and_missing_ids(spark):
    assert simhash.near_duplicate_classes(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(None, "a b", "", 0), (3, "a b", "", 0), (None, "c", "", 0), (3, "q r s t u", "", 0)], SCHEMA)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicate_classes(docs).collect())
    assert got == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 400)] + [(900, 900), (None, 4), (700, 650)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 401)}, 700: 650}


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_copies():
    """Texts with appended, cut and scattered edits of similarity 0.8 to 0.95, on both sides of 0.8."""
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.zipf(1.3, n) % 5000]
    rows = []
    for i in range(60):
        base = words(int(rng.integers(40, 300)))
        n, kind = len(base), i % 3
        for share in (0.05, 0.1, 0.15, 0.2, 0.3):
            if kind == 0:
                copy = base + words(int(share * n))
            elif kind == 1:
                copy = base[: n - int(share * n)]
            else:
                copy = list(base)
                for place in rng.choice(n, max(1, int(share * n / 10)), replace=False):
                    copy[int(place)] = "edited"
            rows.append(copy)
        rows.append(base)
    header = words(200)
    rows += [header + words(int(rng.integers(5, 90))) for _ in range(40)]
    return [(i, " ".join(w)) for i, w in enumerate(rows)] + [(1000, None), (1001, " "), (1002, "one two"), (1003, "One  two")]


def test_near_copies_match_brute_force(spark):
    rows = near_copies()
    sets = [shingle_set(t) for _, t in rows]
    label, linked = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                linked += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert linked > 300
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA)
    for block in (1024, 3):
        got = {r.doc_id: r.component_id for r in simhash.near_copy_classes(docs, block=block).collect()}
        assert got == {rows[i][0]: rows[x][0] for i, x in enumerate(label)}


def test_near_copies_of_odd_rows(spark):
    assert simhash.near_copy_classes(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(None, "a b", "", 0), (3, "a b", "", 0), (None, "c", "", 0), (3, "q r s t u", "", 0)], SCHEMA)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_copy_classes(docs).collect())
    assert got == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]


def test_text_classes_match_all_pairs_of_fingerprints(spark):
    rows = near_copies()
    prints = np.array([simhash._word_prints(t, 3, 5) for _, t in rows], np.int64).view(np.uint64)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        apart = np.bitwise_count(prints[:i] ^ prints[i])
        for j in np.flatnonzero((apart[:, :3].min(axis=1, initial=64) <= 4) & (apart[:, 3] <= 12)):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label] if a != b else label
    assert len(set(label)) < len(rows) - 200
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], SCHEMA)
    found = simhash.text_classes(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == {rows[i][0]: rows[x][0] for i, x in enumerate(label)}
    assert simhash.text_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_near_dedup_of_the_pipeline_goes_by_fingerprints(spark, monkeypatch):
    import corpus_pipeline

    called = []
    real = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda *a, **k: called.append(a) or real(*a, **k))
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (2, text + " more", "en", "s", 0), (2, "else", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == [(1, text), (2, "else")] and called
