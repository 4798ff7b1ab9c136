"""Copies, near copies, shards, archives and the pipeline."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwright.llm import exact_dedup, jaccard, shards, warc
from loomwright.llm.components import components

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_dedup(docs):
    texts = ["a", "b", "a", None, "", "A", "x" * 100_000, "x" * 100_000, "a"]
    df = docs(*texts)
    df = df.unionByName(df.filter("doc_id = 1")).unionByName(df.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    got = exact_dedup.exact_dedup(df, "doc_id", "text").collect()
    by = {r.doc_id: r for r in got if r.doc_id != 1}
    assert len(got) == 11
    for i, (keep, n) in {0: (8, 3), 2: (8, 3), 8: (8, 3), 3: (4, 2), 4: (4, 2), 5: (5, 2), 6: (7, 2), 7: (7, 2)}.items():
        assert (by[i].keep_id, by[i].group_size, by[i].kept) == (keep, n, i == keep)
        assert by[i].text_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest()
    assert (by[None].keep_id, by[None].kept) == (5, False)
    assert sorted([(r.keep_id, r.group_size, r.kept) for r in got if r.doc_id == 1], reverse=True) == [(1, 2, True), (1, 2, False)]  # of repeated rows one stays
    assert exact_dedup.exact_dedup(df.filter(F.lit(False)), "doc_id", "text").count() == 0
    lower = exact_dedup.exact_dedup(df.filter("doc_id is not null"), "doc_id", "text", normalise=F.lower("text"))
    assert {r.doc_id: r.group_size for r in lower.collect()}[5] == 4


def brute(texts, words=5):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(SMALL))
        sets.append(frozenset([tuple(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [tuple(w)] if w else []))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies(seed, n=120, passage=0):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefg", k=rnd.randint(1, 3)))
    common = [word() for _ in range(passage)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(rnd.choice([1, 3, 5, 6, 8, 12, 20, 40, 90, 200]))]
        at = rnd.randint(0, len(base))
        base = base[:at] + common + base[at:] if rnd.random() < 0.7 else base
        out.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 3, 6])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 8])):
                w[rnd.randrange(len(w))] = word()
            out.append((" ".join(w)).upper() if rnd.random() < 0.2 else "\n".join(w))
    return out


@pytest.mark.parametrize("seed, passage", [(1, 0), (2, 0), (3, 30), (4, 60), (5, 12)])
def test_links_against_brute_force(docs, monkeypatch, seed, passage):
    monkeypatch.setattr(jaccard, "LEAST", 4 if passage else 64)  # so that a small table has common shingles
    texts = [*near_copies(seed, passage=passage), None, "", " \n ", "one", "one", "One two", "w " * 9000, "w " * 9001]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_sets(docs(*texts), "doc_id", "text").collect()}
    assert got == brute(texts)


def test_numbers_of_links_against_brute_force(docs, monkeypatch):
    """Groups of many similar texts, within one squad and over several."""
    monkeypatch.setattr(jaccard, "SQUAD", 8)
    rnd = random.Random(11)
    vocab = ["".join(rnd.choices("abcdefghij", k=4)) for _ in range(500)]
    texts = near_copies(6, n=60)
    for size, length in ((40, 150), (12, 150), (3, 104)):
        base = rnd.choices(vocab, k=length)
        for _ in range(size):
            w = list(base)
            for _ in range(rnd.choice([1, 1, 2])):
                w[rnd.randrange(length)] = rnd.choice(vocab)
            texts.append(" ".join(w))
    texts += [texts[-1], texts[-20]]
    sets = []
    for t in texts:
        w = t.translate(SMALL).split()
        sets.append(frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)]))
    different = set(sets)
    want = [sum(a != b and 5 * len(a & b) >= 4 * len(a | b) for b in different) for a in sets]
    assert max(want) > 16
    df = docs(*texts)
    got = {r.doc_id: r.n_links for r in jaccard.link_sets(df.unionByName(df.filter("doc_id % 7 = 0")), "doc_id", "text").collect()}
    assert got == dict(enumerate(want))


def test_links_of_shared_ids_null_ids_and_empty_tables(spark, docs):
    """Two texts of one id join what each reaches; also where the id is the least of both classes, and where one text is empty."""
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    near = lambda t: t.replace("30", "zz")
    rows = [(5, base[0]), (5, base[1]), (6, near(base[0])), (7, near(base[1])), (7, near(base[1])), (9, base[2]), (9, None), (8, near(base[2])), (10, "alone"), (None, base[0]), (None, "zz"), (11, None)]
    got = jaccard.link_sets(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in got) == sorted([(5, 5, 56), (5, 5, 56), (6, 5, 56), (7, 5, 56), (7, 5, 56), (9, 8, 56), (9, 8, 0), (8, 8, 56), (10, 10, 1), (0, 0, 56), (0, 0, 1), (11, 11, 0)])
    assert jaccard.link_sets(docs("a").filter(F.lit(False)), "doc_id", "text").count() == 0


def test_blocks_of_signatures():
    """Blocks hold each signature's distinct members once, whatever the batches; those without a full one or of one member are left out."""
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    rows = sorted({(int(s), int(a), bool(rnd.random() < 0.4)) for s in range(40) for a in rnd.integers(0, 60, int(rnd.integers(1, 5)))} | {(50, a, a == 7) for a in range(3000)} | {(60, a, True) for a in range(1024)} | {(61, a, True) for a in range(1025)}, key=lambda r: (r[0], r[1], not r[2]))
    want = {}
    for s, a, w in rows:
        want.setdefault(s, {}).setdefault(a, w)
    want = {s: m for s, m in want.items() if len(m) > 1 and (any(m.values()) or len(m) > jaccard.BLOCK)}
    for size in (1, 7, 700, 10_000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*((s, w, a) for s, a, w in rows[k : k + size]), strict=True)], names=["sig", "whole", "a"]) for k in range(0, len(rows), size)]
        got, blocks = {}, {}
        for b in jaccard.groups(iter(batches)):
            for r in b.to_pylist():
                assert 0 < len(r["members"]) <= jaccard.BLOCK
                blocks.setdefault(r["sig"], []).append((r["block"], r["hot"]))
                got.setdefault(r["sig"], {}).update(zip(r["members"], r["wholes"], strict=True))
        assert got == want
        assert all([k for k, _ in sorted(x)] == list(range(len(x))) and {h for _, h in x} == {len(x) > 1} for x in blocks.values())


def test_bitmaps_allow_every_link():
    """Pairs over and under the similarity, in tasks of one block and of two, cut by batches at any place: all links are allowed, unlike sizes and far pairs aren't."""
    import numpy as np
    import pyarrow as pa

    rnd, rows, links = np.random.default_rng(5), [], set()
    for task in range(30):
        n = int(rnd.choice([3, 30, 33, 200, 3000]))
        base = rnd.integers(0, 1 << 62, n).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[int(rnd.integers(0, n // 5 + 1)) :], rnd.integers(0, 1 << 62, int(rnd.integers(0, n // 6 + 1))).astype(np.uint64)])) for _ in range(6)]
        two = task % 2
        for k, s in enumerate(sets):
            rows.append((task, 0, two, bool(two and k > 2), task * 10 + k, True, len(s), jaccard.bitmap(s)))
            for m in range(k):
                both = len(np.intersect1d(s, sets[m]))
                if 5 * both >= 4 * (len(s) + len(sets[m]) - both) and (not two or (k > 2) != (m > 2)):
                    links.add((task * 10 + m, task * 10 + k))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
    for size in (1, 4, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + size], strict=True), kinds, strict=True)], names=list("abcdefgh")) for k in range(0, len(rows), size)]
        got = {p for b in jaccard.whole_tasks(iter(batches), 3) for x, y in jaccard.allowed(b, 4, 5) for p in zip(x.tolist(), y.tolist(), strict=True)}
        assert links <= got and len(got) < len(links) + 0.5 * 15 * 30 and all(x // 10 == y // 10 for x, y in got)


def test_signatures_cover_every_link():
    """Any two sets within the similarity share a signature, one of them full, whatever is common."""
    import numpy as np

    rnd, schemes = np.random.default_rng(7), jaccard.Schemes(jaccard.SIMILARITY, [64, 80, 320, 1280], 10_000)
    for _ in range(400):
        n = int(rnd.integers(1, 80))
        a = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
        drop, add = (int(rnd.integers(0, max(1, len(a) // 5) + 1)) for _ in range(2))
        b = np.unique(np.concatenate([a[min(drop, len(a) - 1) :], rnd.integers(0, 1 << 62, add).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both * 5 < 4 * (len(a) + len(b) - both):
            continue
        common = {int(x): int(rnd.integers(1, 5)) for x in np.union1d(a, b) if rnd.random() < rnd.choice([0, 0.3, 0.8, 1])}
        level = lambda s: np.array([common.get(int(x), 0) for x in s])  # noqa: E731, B023
        sa, sb = ([(int(x), w) for xs, w in schemes.signatures(s, level(s)) for x in xs] for s in (a, b))
        fa, fb = {x for x, w in sa if w}, {x for x, w in sb if w}
        assert fa & {x for x, _ in sb} or fb & {x for x, _ in sa}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_components_of_random_paths_and_trees(spark, seed):
    """Each graph alone, against union-find, as other graphs keep the loop going; in the first a node comes to hang from two roots."""
    rnd, edges = random.Random(seed), [(1, 5), (5, 3), (3, 4), (4, 2)]
    if seed:
        ids = rnd.sample(range(100), 8)
        edges = [(ids[i], ids[i - 1 if seed % 2 else rnd.randrange(i)]) for i in range(1, 8)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    rows = components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert sorted((r.id, r.component) for r in rows) == sorted((x, find(x)) for x in parent)


def metadata():
    return [F.col("n_chars"), shards.text_place(F.col("source")), F.col("doc_id")]


def test_shards(docs):
    rnd = random.Random(1)
    texts = ["x" * int(rnd.paretovariate(1.2) * 20) for _ in range(600)] + ["copy of a text"] * 40 + [None, ""]
    got = shards.shard_documents(docs(*texts), "doc_id", "text", metadata(), shards=6).collect()
    size, of_text, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        assert r["size"] == len((texts[r.doc_id] or "").encode()) + 8
        size[r.shard] += r["size"]
        of_text[texts[r.doc_id] or ""].add(r.shard)
        slots[r.shard].append(r.slot)
    assert len(got) == len(texts) and set(size) <= set(range(6))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for t, s in of_text.items() if texts.count(t) * (len(t) + 8) < sum(size.values()) / 6)


def test_shards_split_a_giant_group_and_take_nothing(docs):
    df = docs(*["same"] * 500, *(f"t{i}" for i in range(100)))
    size = Counter()
    for r in shards.shard_documents(df, "doc_id", "text", metadata(), shards=4).collect():
        size[r.shard] += r["size"]
    assert len(size) == 4 and max(size.values()) < 1.2 * sum(size.values()) / 4
    assert shards.shard_documents(df.filter(F.lit(False)), "doc_id", "text", metadata()).count() == 0


def test_warc_round_trip(spark):
    pages = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/\r\nX", ""), (5, "http://a/5", "x" * 200_000), (6, "http://a/6", "a\r\n\r\nWARC-Type: fake\r\n")]
    df = spark.createDataFrame([(*p, "own") for p in pages], "page_id long, url string, html string, digest string")
    payloads, headers = warc.write_archive(df, "page_id", "url", "html")
    assert spark.read.parquet(payloads).count() == 4
    archive = warc.read_archive(spark, payloads, headers)
    got = {r.id: r for r in archive.collect()}
    for i, _, html in pages:
        body = (html or "").encode()
        assert bytes(got[i].payload) == body and got[i].payload_bytes == len(body)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    for r in warc.records(archive).collect():
        record = bytes(r.record)
        head, _, rest = record.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and len(rest) == n + 4 and rest.endswith(b"\r\n\r\n")
        if got[r.id].record_type == "response":
            assert rest[:n].partition(b"\r\n\r\n")[2] == bytes(got[r.id].payload)
    assert warc.read_archive(spark, *warc.write_archive(df.filter(F.lit(False)), "page_id", "url", "html")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version, on documents with planted cases."""
    rnd = random.Random(9)
    vocab = ["".join(rnd.choices("bcdfghjk", k=4)) for _ in range(400)]
    text = lambda n: " ".join(rnd.choices(vocab, k=n))
    bench = [(i, text(14)) for i in range(3)]
    base = [text(80) for _ in range(60)]
    toxic = [f"{text(20)} idiot moron scum {text(10)} stupid loser" for _ in range(60)]
    near = base[5].split()
    near[40] = "zz"
    texts = base + toxic + [base[3], base[3], " ".join(near), text(10) + " " + bench[1][1] + " " + text(5)]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 120)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "bpe"]
    left = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    want = set(range(60)) - {3}  # copies: the largest id stays
    want |= {121}
    assert left == want


def test_pipeline_stages_go_by_row(spark, docs):
    """Rows that share an id, repeated rows, null ids and texts, clashing names and an empty table, in the stages that drop copies."""
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    near = base[0].replace("30", "zz")
    rows = [(5, "A"), (5, base[1]), (9, base[1]), (9, base[1]), (None, "B"), (None, "B"), (None, base[2]), (7, base[2]), (1, None), (2, ""), (3, base[0]), (4, near), (4, "C"), (6, None)]
    df = spark.createDataFrame([(*r, "own", "x", 1) for r in rows], "doc_id long, text string, digest string, _key string, stays int")
    left = corpus_pipeline.drop_copies(spark, df, "")
    assert left.columns == df.columns
    want = [(5, "A"), (9, base[1]), (None, "B"), (7, base[2]), (6, None), (3, base[0]), (4, near), (4, "C")]
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in left.collect()], key=key) == sorted(want, key=key)
    near_left = corpus_pipeline.drop_near_copies(spark, df, "")
    # base[1] and base[2] have equal sets too; a null id is in no group
    want = [(5, "A"), (5, base[1]), (None, "B"), (None, base[2]), (7, base[2]), (1, None), (2, ""), (3, base[0]), (4, "C"), (6, None)]
    assert sorted([(r.doc_id, r.text) for r in near_left.collect()], key=key) == sorted(want, key=key)
    none = docs("a").filter(F.lit(False))
    assert corpus_pipeline.drop_copies(spark, none, "").count() == corpus_pipeline.drop_near_copies(spark, none, "").count() == 0
    assert corpus_pipeline.encode(spark, none, "").count() == 0


def test_exact_dedup_keeps_one_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "a"), (None, "a"), (None, "b"), (1, "b"), (2, "c"), (2, "c"), (1, "c")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == sorted([(0, 0, 2, True), (0, 0, 2, False), (0, 1, 2, False), (1, 1, 2, True), (2, 2, 3, True), (2, 2, 3, False), (1, 2, 3, False)])


def test_tree_against_brute_force(spark):
    """Every leaf: cuts at the weighted median along the widest dimension, and units that settle make sizes nearly equal."""
    rnd = random.Random(4)
    rows = [(i, i * 7, 0, rnd.choice([10, 30, 200, 900]), rnd.randrange(1 << 30), rnd.randrange(1 << 36)) for i in range(700)]
    units = spark.createDataFrame(rows, "hash long, crc long, piece long, weight long, d0 long, d1 long")
    n = 6
    whole = sum(r[3] for r in rows)
    tree = shards.kd_tree(units, ["d0", "d1"], n, [whole / n] * n)
    spans = dict(enumerate(lo for lo, _ in tree.span))
    got = {r.hash: spans[r.n] for r in units.select("hash", tree.place(["d0", "d1"]).alias("n")).collect()}

    def split(part, lo, hi):
        if hi - lo == 1:
            return {r[0]: lo for r in part}
        widths = [max(r[d] for r in part) // shards.SPAN - min(r[d] for r in part) // shards.SPAN for d in (4, 5)]
        d = 4 + widths.index(max(widths))
        part, mid = sorted(part, key=lambda r: r[d]), (lo + hi) // 2
        left, k = sum(r[3] for r in part) * (mid - lo) / (hi - lo), 0
        while part[k][3] <= left:
            left -= part[k][3]
            k += 1
        k += left > part[k][3] / 2
        return split(part[:k], lo, mid) | split(part[k:], mid, hi)

    want = split(rows, 0, n)
    assert got == want
    leaf = units.drop("d0", "d1").join(spark.createDataFrame(list(want.items()), "hash long, shard int"), "hash")
    moved = shards.settle(leaf, n, dict.fromkeys(range(n), 0), 0.001 * whole / n)
    load = Counter()
    to = {k[0]: s for *k, s in moved}
    for r in rows:
        load[to.get(r[0], want[r[0]])] += r[3]
    assert len(to) < len(rows) / 10 and max(load.values()) < 1.02 * min(load.values())


def test_shards_are_near_equal_with_null_ids_metadata_and_repeated_rows(spark):
    rnd = random.Random(2)
    rows = [(i if i % 9 else None, "y" * rnd.randint(0, 400), None if i % 5 else f"s{i % 3}", None if i % 4 else i) for i in range(800)]
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, source string, n_chars long")
    got = shards.shard_documents(df, "doc_id", "text", metadata(), shards=5).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert len(got) == 850 and set(size) == set(range(5)) and max(size.values()) < 1.02 * min(size.values())
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(5))


def test_warc_contents_come_from_the_record_bytes(spark):
    pages = [(1, "u", "<p>é</p>"), (1, "u", "<p>é</p>"), (1, "v", "x"), (2, "u", "<p>é</p>"), (None, "w", "x"), (None, None, "only"), (4, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    written = warc.records(warc.read_archive(spark, *warc.write_archive(df, "page_id", "url", "html", date=F.lit("2024-05-06T07:08:09Z"))))
    for r in written.collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert b"\r\nWARC-Date: 2024-05-06T07:08:09Z\r\n" in head + b"\r\n" and rest.endswith(b"\r\n\r\n")
    ids = [re.search(rb"WARC-Record-ID: (\S+)", bytes(r.record))[1] for r in written.collect()]
    assert len(set(ids)) == len(pages) - 1  # but for the row that is repeated
    got = sorted((r.id or 0, r.payload_bytes, r.record_type, r.refers_to or 0, r.payload_digest == base64.b32encode(hashlib.sha1(b).digest()).decode()) for r in warc.contents(written).collect() for b in [{9: "<p>é</p>".encode(), 1: b"x", 4: b"only", 0: b""}[r.payload_bytes]])
    assert got == sorted([(1, 9, "revisit", 2, True), (1, 9, "revisit", 2, True), (1, 1, "response", 0, True), (2, 9, "response", 0, True), (0, 1, "revisit", 1, True), (0, 4, "response", 0, True), (4, 0, "response", 0, True)])
