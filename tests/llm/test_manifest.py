import hashlib

from pyspark.sql import functions as F

from pageframe.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, g int, idx string, path int"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n = row
    fields = [doc_id, source, lang, None if n is None else n + more, text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree(hashes, arity):
    """Root, and for each leaf its list of (slot, siblings) from the lowest level on."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for p, i in zip(paths, at):
            run = runs[i // arity]
            p.append((i % arity, run[: i % arity] + run[i % arity + 1 :]))
        at, level = [i // arity for i in at], [H(*r) for r in runs]
    return level[0], paths


def brute(rows, arity, bad):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for name in names:
        own = sorted(langs[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[name] = (own, *tree([leaf(r) for r in own], arity))
    root, tops = tree([made[n][1] for n in names], arity)
    out = []
    for name, top in zip(names, tops):
        own, subroot, paths = made[name]
        for r, path in zip(own, paths):
            h = leaf(r, 1 if bad(r[0]) else 0)
            for slot, others in path + top:
                h = H(*others[:slot], h, *others[slot:])
            out.append((r[0], leaf(r), subroot, root, H(*[x for _, s in path + top for x in s]), h, h == root))
    return sorted(out, key=str)


def rows(n):
    got = [(i * 3, f"text {i} é" * (i % 4), ["en", "de", "fr"][0 if i % 4 else i % 3], f"s{i % 5}", i % 50) for i in range(n)]
    return got + [(7, None, None, None, None), (8, "", "solo", "s", 0), (None, "a" * 70000, "en", None, 3), (4, "x", "", "s", 1), (5, "x", "é", "s", 1), (9, "twice", "en", "s", 2), (9, "twice", "en", "s", 2), (9, "other", "en", "s", 2)]


def test_matches_brute_force(spark):
    for n, arity in ((0, 2), (37, 2), (61, 3), (61, 5)):
        data = rows(n)
        docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in data], SCHEMA).repartition(5)
        got = manifest.manifest(docs, arity, (F.col("doc_id") % 2 == 0) & F.col("doc_id").isNotNull())
        assert sorted(map(tuple, got.collect()), key=str) == brute(data, arity, lambda i: i is not None and i % 2 == 0)


def test_one_row_no_row_and_no_suspect(spark):
    one = [(1, "t", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in one], SCHEMA)
    assert list(map(tuple, manifest.manifest(docs).collect())) == brute(one, 2, lambda i: False)
    assert manifest.manifest(docs.where("false")).collect() == []
