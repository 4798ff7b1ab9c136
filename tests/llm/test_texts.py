"""Licences, secrets, BPE and the two classifiers."""

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import bpe, licenses, quality, secret_scan, toxicity
from loomwright.llm.queries import VOCABULARY

MIT = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)


def test_licenses(spark, docs):
    half = MIT.replace("Permission is hereby granted", "We hereby grant permission").replace(". ", ".\n")
    df = docs("x\nReleased under the MIT License.\ny", MIT, f"intro\n\n{half}\n\nend", "no licence at all", None, "", "MIT", "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "word " * 20_000)
    out = licenses.scan(df, "text")
    assert out.columns == [*df.columns, "licenses"]
    got = {r.doc_id: [x.license for x in r.licenses] for r in out.collect()}
    assert got == {0: ["MIT"], 1: ["MIT"], 2: ["MIT"], 3: [], 4: [], 5: [], 6: [], 7: ["Apache-2.0", "CC-BY-NC-4.0"], 8: []}
    assert licenses.scan(df.filter(F.lit(False)), "text").count() == 0


def test_licenses_inside_other_text(docs):
    """Over several paragraphs, within a line, wrapped, with CRLF and with blanks on the empty line; similar templates don't stand for each other."""
    cut = [MIT.index(" The above"), MIT.index(" THE SOFTWARE IS PROVIDED")]
    parts = [MIT[: cut[0]], MIT[cut[0] + 1 : cut[1]], MIT[cut[1] + 1 :]]
    other = " ".join(f"bar{k}" for k in range(90))
    read_me = lambda gap: gap.join(["About Foo", other, *parts, "Thanks to all. " + other[::-1]])
    wrapped = "Foo reads bars and writes them down. This work is licensed\r\nunder the GNU General Public License, version 2.\r\nIt has more to say " + "about bars " * 30
    texts = [read_me("\n\n"), read_me("\r\n\r\n"), read_me("\n \n"), "Foo is a small tool for bars. Released under the MIT License.", wrapped]
    texts += ["A line about bars, licensed under CC BY-SA 4.0. Then more. Licensed under the Apache License, Version 2.0, and so on and on.", "permission is granted to read this notice under the license " * 20]
    got = {r.doc_id: [x.license for x in r.licenses] for r in licenses.scan(docs(*texts), "text").collect()}
    assert got == {0: ["MIT"], 1: ["MIT"], 2: ["MIT"], 3: ["MIT"], 4: ["GPL-2.0-only"], 5: ["Apache-2.0", "CC-BY-SA-4.0"], 6: []}


def test_license_windows_lose_nothing():
    """The best window of one template, against all windows."""
    rnd = random.Random(9)
    for size in (3, 8, 25):
        for _ in range(60):
            template = " ".join(f"t{rnd.randrange(size)}" for _ in range(size + 1))
            m = licenses.Matcher([("x", template)], 0.8)
            text = " ".join(" ".join(template.split()[rnd.randrange(size) :]) if rnd.random() < 0.4 else f"{rnd.choice('tu')}{rnd.randrange(size)}" for _ in range(rnd.randrange(2, 3 * size)))
            text += " " + template.replace("t1", "u1") * rnd.randrange(2)
            pairs = list(zip(text.split(), text.split()[1:]))
            goal, most = m.sets[0], int(len(m.sets[0]) * 1.5 + 1e-9)
            best = max((licenses.dice(frozenset(pairs[p:q]), goal) for p in range(len(pairs)) for q in range(p + 1, min(p + most, len(pairs)) + 1)), default=0.0)
            raw = np.frombuffer(text.encode(), np.uint8)
            got = max((d for _, d, _ in m.windows(raw, np.array([0, len(raw)]))), default=0.0)
            assert got == (best if best >= 0.8 else 0.0)


def test_license_whole_texts(docs):
    """Whole licence files, found as a text, and inside others, whatever stands around them."""
    whole = {n: t for n, t in licenses.TEMPLATES if len(t) > 700}
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Zlib"} <= set(whole)
    names = sorted(whole)
    around = " ".join(f"bar{k} of the software" for k in range(300))
    texts = [whole[n] for n in names] + [f"{around}\n{whole[n].replace('software', 'programme', 3)} {around}" for n in names]
    got = {r.doc_id: {x.license: x.dice for x in r.licenses} for r in licenses.scan(docs(*texts), "text").collect()}
    for i, n in enumerate(names):
        assert got[i][n] == 1.0 and n in got[len(names) + i], n  # a notice inside it may give the coefficient
    assert "BSD-3-Clause" not in got[names.index("BSD-2-Clause")] and "BSD-2-Clause" not in got[names.index("BSD-3-Clause") + len(names)]


def test_license_pruning_loses_nothing():
    m, rnd = licenses.Matcher(licenses.TEMPLATES, 0.8), random.Random(5)
    for _ in range(300):
        w = rnd.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rnd.randint(0, 8)):
            w[rnd.randrange(len(w))] = rnd.choice(["foo", "the", "License"])
        text = " ".join(w)
        raw = np.frombuffer(text.encode(), np.uint8)
        best = max(licenses.dice(licenses.bigrams(text), s) for s in m.sets)
        found = m.best(text)
        assert (found[0] if found else 0) == (best if best >= 0.8 else 0)
        if found:
            assert len(m.candidates(raw, np.array([0, len(raw)]))) == 1


BASE = {
    "assign": (re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def secrets(text):
    out = []
    for k, (name, (p, g, n)) in enumerate(BASE.items()):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in p.finditer(text or "") if len(m[g]) >= n]
    return [s for *_, s in sorted(out)]


def spans(df):
    return {r.doc_id: [f"{f.kind}:{f.start}:{f.end}" for f in r.findings] for r in df.collect()}


def test_secrets_against_brute_force(docs):
    rnd = random.Random(2)
    parts = ["token = \"abcdef123\"", "secret=token:abcdefgh", "PASSWD: x", "api_key='k1.k2-k3'", "AKIA" + "A1" * 8, "AKIAAKIA" + "Z" * 9, "AKIA12", "deadbeef" * 3, "0" * 23, "é日🤦", "\n", " ", "'", "password=secret=longvalue", "Tokenſ=abcdefg", "KEY"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 9))) for _ in range(300)] + [None, "", "abc " * 50_000 + "token=abcdefg", "token=abcdefg"]
    found, ledger = secret_scan.secret_scan(docs(*texts), "doc_id", "text")
    got = spans(found)
    assert all(got[i] == secrets(t) for i, t in enumerate(texts)) and len(got) == len(texts)
    assert ledger.count() == 3 * len({t or "" for t in texts})


def test_ledger_scans_only_what_is_unseen(docs):
    one, two = docs("token=abcdefg", "deadbeef" * 3, "token=abcdefg"), docs("token=abcdefg", "AKIA" + "A" * 16, None)
    _, first = secret_scan.secret_scan(one, "doc_id", "text")
    found, fresh = secret_scan.secret_scan(two, "doc_id", "text", first)
    assert {r.blob for r in fresh.collect()}.isdisjoint({r.blob for r in first.collect()}) and fresh.count() == 6
    assert spans(found) == {0: ["assign:0:13"], 1: ["access:0:20"], 2: []}
    newer = [r._replace(version=2) if r.name == "hex" else r for r in secret_scan.RULES]
    _, again = secret_scan.secret_scan(one, "doc_id", "text", first, newer)
    assert {(r.rule, r.version) for r in again.collect()} == {("hex", 2)} and again.count() == 2


def test_bpe_equals_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    t, rnd = tokenizers.Tokenizer.from_file(VOCABULARY), random.Random(4)
    pool = [*"abcdefgh  \n\t'stdmlrve.,;!?0123456789éèñß日本🤦  \x1c\x85Ᲊ\U00010d40꟎", "<|endoftext|>", "  ", "aaaa", "'re", "\r\n"]
    texts = ["".join(rnd.choices(pool, k=rnd.randint(0, 80))) for _ in range(2000)] + [None, "", "a" * 3000, "ab" * 2000, " " * 999, "x" * 200_000]
    df = docs(*texts)
    out = bpe.decode(bpe.encode(df, "text", VOCABULARY), "_ids", VOCABULARY)
    assert out.columns == [*df.columns, "_ids", "decoded"]
    for r in out.collect():
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert r._ids == want and r.decoded == t.decode(want, skip_special_tokens=False) == (r.text or "")


def labelled(sf="sf0.1"):
    d = duckdb.sql(f"select doc_id, text, quality, toxic from '/root/testdata/{sf}/documents.parquet' join '/root/testdata/{sf}/labels.parquet' using (doc_id) order by doc_id").fetchall()
    held = np.array([zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in d])
    return [r[1] for r in d], np.array([r[2] for r in d], float), np.array([r[3] for r in d], float), held


@pytest.mark.parametrize("model, which, threshold, least", [(toxicity, 2, 0.3, 0.97), (quality, 1, 0.7, 0.98)])
def test_held_out_accuracy(model, which, threshold, least):
    import pyarrow as pa

    data = labelled()
    texts, y, held = data[0], data[which], data[3]
    m = model.train([t for t, h in zip(texts, held, strict=True) if not h], y[~held])
    p = 1 / (1 + np.exp(-model.logits(pa.array([t for t, h in zip(texts, held, strict=True) if h]), m)))
    assert ((p >= threshold) == y[held]).mean() >= least


@pytest.mark.parametrize("model", [toxicity, quality])
def test_classifier_cases(spark, docs, model):
    texts = ["you idiot moron scum"] * 12 + ["a fine plain day here"] * 12
    m = model.train(texts, np.array([1.0] * 12 + [0.0] * 12))
    df = docs(*texts, None, "", "...", "word " * 30_000)
    out = model.score(df, "text", m)
    assert out.columns == [*df.columns, "_score"]
    got = [r._score for r in out.orderBy("doc_id").collect()]
    assert min(got[:12]) > max(got[12:24]) and got[24] == got[25] and all(0 <= x <= 1 for x in got)
    assert model.score(df.filter(F.lit(False)), "text", m).count() == 0
    for none in (model.train([], np.array([])), model.train(["a"], np.array([1.0]))):
        assert 0 <= model.score(df, "text", none).first()._score <= 1


def test_misspelt_words_share_vectors():
    import pyarrow as pa

    words = "green tree river stone cloud house bread light".split()
    rnd = random.Random(1)
    texts = [" ".join(rnd.choices(words, k=12) + ["disgusting"] * (i % 2)) for i in range(200)]
    m = toxicity.train(texts, np.array([float(i % 2) for i in range(200)]))
    bad, good = toxicity.logits(pa.array(["stone disgustinng river", "stone cloud river"]), m)
    assert bad > good


def test_sample_is_bounded_and_leaves_the_held_out(spark, docs):
    df = docs(*(f"text {i}" for i in range(50)), None)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 1)], "doc_id long, toxic int")
    texts, y = toxicity.sample(df, "doc_id", "text", labels, "doc_id", "toxic", rows=20)
    ids = [int(t.split()[1]) for t in texts]
    assert len(ids) <= 20 and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)
    texts, _ = toxicity.sample(df, "doc_id", "text", labels, "doc_id", "toxic", most_bytes=30)
    assert sum(map(len, texts)) <= 30


def mixed(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) % 2**64
    return h ^ (h >> 31)


def hashed_bytes(b):
    """The polynomial hash of kernel.Words and of the n-grams, before mixing."""
    from loomwright.llm import kernel

    return sum((x + 1) * pow(kernel.BASE, k, 2**64) for k, x in enumerate(b)) % 2**64


def plain_bag(word):
    """Buckets of a word, in plain Python: itself, and its byte 3-, 4- and 5-grams with an end mark at either side."""
    out, n = [mixed(hashed_bytes(word))], len(word)
    for g in toxicity.GRAMS:
        for a in range(-1, n + 2 - g):
            b = a + g
            h = hashed_bytes(word[max(a, 0) : min(b, n)]) + g + (a < 0) * 0x632BE59BD9B4E019 + (b > n) * 0x8CB92BA72F3D8DD7
            out.append(mixed(h % 2**64))
    return [x % toxicity.BUCKETS for x in out]


def plain_words(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))


def test_toxicity_against_plain_python():
    """Features, training steps and scores, each text by itself; a text's score doesn't depend on those beside it."""
    import pyarrow as pa

    rnd = random.Random(8)
    vocab = ["Stone", "river", "idiot", "moron", "a", "été", "x9", "cloud"]
    texts = [" ".join(rnd.choices(vocab, k=rnd.randint(1, 12))) for _ in range(14)]
    y = [float("idiot" in t or "moron" in t) for t in texts]
    y[0], y[1] = 0.0, 1.0
    features = []
    for t in texts:
        f, words = {}, plain_words(t)
        for w in words:
            bag = plain_bag(w)
            for b in bag:
                f[b] = f.get(b, 0) + 1 / len(bag) / len(words)
        features.append(f)
    for f, (b, v) in zip(features, toxicity.texts_features(texts), strict=True):
        assert {k: pytest.approx(x, rel=1e-9) for k, x in f.items()} == dict(zip(b.tolist(), v.tolist(), strict=True))
    n, positive = len(y), sum(y)
    trust = {}
    for b in {b for f in features for b in f}:
        every, ones = sum(b in f for f in features), sum(t for f, t in zip(features, y, strict=True) if b in f)
        expected = every * positive / n
        spread = expected * (1 - positive / n) * (1 - every / n)
        chi = (ones - expected) ** 2 / spread if spread > 0 else 0
        trust[b] = min(1, max(toxicity.LEAST_TRUST, (chi / toxicity.CHI_SQUARE) ** 2))
    used, dims = sorted(trust), range(toxicity.DIMENSIONS)
    rng = np.random.default_rng(toxicity.SEED)
    e = dict(zip(used, rng.normal(0, 0.01, (len(used), len(dims))).tolist(), strict=True))
    soft, bias = rng.normal(0, 0.3, (len(dims), 2)).tolist(), [0.0, float(np.log((positive / n + 1e-3) / (1 - positive / n + 1e-3)))]
    moments = {}

    def adam(key, x, g, rate, t):
        m, v = moments.get(key, (0.0, 0.0))
        m, v = m + 0.1 * (g - m), v + 0.01 * (g * g - v)
        moments[key] = m, v
        return x - rate * (m / (1 - 0.9**t)) / ((v / (1 - 0.99**t)) ** 0.5 + 1e-8)

    for t in range(1, 5):
        ge, gs, gb = {b: [toxicity.DECAY * x for x in e[b]] for b in used}, [[toxicity.DECAY * x for x in row] for row in soft], [0.0, 0.0]
        for f, label in zip(features, y, strict=True):
            mean = [sum(e[b][d] * v * toxicity.SCALE * trust[b] for b, v in f.items()) for d in dims]
            z = [sum(mean[d] * soft[d][c] for d in dims) + bias[c] for c in (0, 1)]
            p = [np.exp(x - max(z)) for x in z]
            dz = [(p[c] / sum(p) - (label == c)) / n for c in (0, 1)]
            for c in (0, 1):
                gb[c] += dz[c]
                for d in dims:
                    gs[d][c] += mean[d] * dz[c]
            for b, v in f.items():
                for d in dims:
                    ge[b][d] += v * toxicity.SCALE * trust[b] * (dz[0] * soft[d][0] + dz[1] * soft[d][1])
        e = {b: [adam((b, d), e[b][d], ge[b][d], toxicity.RATE, t) for d in dims] for b in used}
        soft = [[adam(("s", d, c), soft[d][c], gs[d][c], toxicity.RATE / 4, t) for c in (0, 1)] for d in dims]
        bias = [adam(("b", c), bias[c], gb[c], toxicity.RATE, t) for c in (0, 1)]
    m = toxicity.train(texts, np.array(y), epochs=4)
    assert m.bias == pytest.approx(bias[1] - bias[0], rel=1e-4)
    for b in used:
        assert m.weight[b] == pytest.approx(toxicity.SCALE * trust[b] * sum(e[b][d] * (soft[d][1] - soft[d][0]) for d in dims), rel=1e-3, abs=1e-6)
    together = toxicity.logits(pa.array([*texts, None, "..."]), m).tolist()
    for t, z in zip(texts, together, strict=False):
        words = plain_words(t)
        assert z == pytest.approx(m.bias + sum(sum(m.weight[b] for b in plain_bag(w)) / len(plain_bag(w)) for w in words) / len(words), rel=1e-9)
        assert z == toxicity.logits(pa.array([t]), m)[0]
    assert together[-2:] == [m.bias] * 2


def test_quality_against_plain_python():
    """FTRL over the features of each text, in plain Python; scores as sparse dot products, whatever stands beside a text."""
    import pyarrow as pa

    rnd = random.Random(9)
    vocab = ["Stone", "RIVER", "a,", "!!", "été", "x9", "cloud.", "good"]
    texts = [" ".join(rnd.choices(vocab, k=rnd.randint(1, 15))) for _ in range(12)]
    y = [float(i % 3 > 0) for i in range(12)]
    rows = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        hashes, _, _ = quality.split(raw, np.array([0, len(raw)]))
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\s]+", t.encode())
        plain = []
        for w in tokens:
            if not re.match(rb"[0-9A-Za-z\x80-\xff]", w):
                plain.append(mixed(hashed_bytes(w)))
                continue
            big = len(re.findall(rb"[A-Z]", w))
            plain.append(mixed((mixed(hashed_bytes(w.lower())) + (2 if big > 1 and 2 * big >= len(w) else int(big > 0))) % 2**64))
        assert hashes.tolist() == plain
        b, v, _ = quality.features(raw, np.array([0, len(raw)]))
        ones = {}
        for h in plain:
            k = mixed((h + int(quality.ONE)) % 2**64 if (h + int(quality.ONE)) < 2**64 else (h + int(quality.ONE)) - 2**64)
            k = mixed(k) % quality.BUCKETS
            ones[k] = ones.get(k, 0) + 1
        got = dict(zip(b.tolist(), v.tolist(), strict=False))
        assert all(any(abs(x - (c / len(plain)) ** 0.5) < 1e-9 for x in v[b == k]) for k, c in ones.items())
        rows.append([*zip(b.tolist(), v.tolist(), strict=True), (quality.BUCKETS, 1.0)])
        assert got
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == quality.BUCKETS else quality.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * l1) / ((quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    rng = np.random.default_rng(quality.SEED)
    for _ in range(quality.EPOCHS):
        for r in rng.permutation(len(rows)):
            w = [weight(i) for i, _ in rows[r]]
            p = 1 / (1 + np.exp(-sum(a * x for a, (_, x) in zip(w, rows[r], strict=True))))
            fresh = {}
            for a, (i, x) in zip(w, rows[r], strict=True):
                g = (p - y[r]) * x
                fresh[i] = (z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA * a, n.get(i, 0.0) + g * g)
            for i, (a, b) in fresh.items():
                z[i], n[i] = a, b
    m = quality.train(texts, np.array(y))
    assert m.bias == pytest.approx(weight(quality.BUCKETS), rel=1e-9)
    assert all(m.weight[i] == pytest.approx(weight(i), rel=1e-9, abs=1e-12) for row in rows for i, _ in row[:-1])
    together = quality.logits(pa.array([*texts, None]), m)
    for k, t in enumerate(texts):
        assert together[k] == pytest.approx(m.bias + sum(m.weight[i] * x for i, x in rows[k][:-1]), rel=1e-9)
        assert together[k] == quality.logits(pa.array([t]), m)[0]
    assert together[-1] == m.bias


def test_secret_increments_scan_only_what_the_ledger_lacks(spark, monkeypatch):
    first = spark.createDataFrame([(1, "password = abcdef1"), (2, None), (None, "AKIA" + "A" * 16)], "doc_id long, text string")
    more = first.unionByName(spark.createDataFrame([(4, "token: zzzzzz9"), (5, "password = abcdef1")], "doc_id long, text string"))
    _, ledger = secret_scan.secret_scan(first, "doc_id", "text")
    assert ledger.count() == 9
    found, fresh = secret_scan.secret_scan(more, "doc_id", "text", ledger=ledger)
    assert {r.rule for r in fresh.collect()} == {"assign", "access", "hex"} and fresh.count() == 3
    whole, _ = secret_scan.secret_scan(more, "doc_id", "text")
    key = lambda r: str(r)
    assert sorted(found.collect(), key=key) == sorted(whole.collect(), key=key)
    newer = [secret_scan.RULES[0]._replace(version=2), *secret_scan.RULES[1:]]
    _, fresh = secret_scan.secret_scan(more, "doc_id", "text", ledger=ledger, rules=newer)
    assert sorted((r.rule, r.version) for r in fresh.collect()) == sorted([("assign", 2)] * 4 + [("access", 1), ("hex", 1)])
    assert secret_scan.secret_scan(first.filter("doc_id > 9"), "doc_id", "text", ledger=ledger)[0].count() == 0
