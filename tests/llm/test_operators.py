"""Each text operator on small fixtures: edge cases and brute force."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopweave.llm import decontaminate as DC, fingerprints as FP, interpolation_lm as LM, license_scan as LS, line_dedup as LD, links, packing as PK, pii_surrogates as PII, quality_fm as FM, secret_scan as SS, simhash_bktree as SH
from shopweave.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, root long, id string, node int"  # names that operators use inside must not clash


def table(spark, rows):
    return spark.createDataFrame([(d, t, 9, "x", 1) for d, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "of", "the", "and"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Nulls in id and text, empty and blank texts, ties, repeated rows, near copies, a very long text."""
    rng = random.Random(5)
    rows = [(i, "\n".join(prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 5)))) for i in range(40)]
    base = rows[3][1] + " " + prose(rng, 60)
    for i in range(40, 60):
        words = base.split(" ")
        words[rng.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words)))
    return rows + [(60, None), (61, ""), (62, " \n\t"), (None, base), (None, None), (3, rows[3][1]), (3, rows[3][1]), (63, "\n".join(prose(rng, 400) for _ in range(50))), (64, "Ünïcode ßtraße 中文 word " * 3), (65, "word")]


def text(rows):
    return [(d, t or "") for d, t in rows]


def union(n, pairs):
    top = list(range(n))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def lowest(ids, roots):
    low = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return [low.get(r) for r in roots]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(-50, 150), rng.randint(-50, 150)) for _ in range(120)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)]
    found = dict(links.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    top = union(400, [(a + 50, b + 50) for a, b in pairs])
    assert found == {x: top[x + 50] - 50 for p in pairs if p[0] != p[1] for x in p}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(spark, corpus):
    rows = text(corpus)
    occurrences = {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, x in enumerate(t.split("\n")):
            if x.strip(" "):
                occurrences.setdefault(x.strip(" "), []).append((d, t, p))
    names = sorted(occurrences)
    sets = [LD.shingle_set(x) for x in names]
    roots = union(len(names), [(i, j) for i in range(len(names)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    found = {(r.doc_id, r.text): r.n_removed for r in LD.dedup_lines(table(spark, corpus)).collect()}
    order = lambda o: (o[0] is not None, o[0] or 0)
    kept = {}
    for x, r in zip(names, roots, strict=True):
        kept[r] = min([*occurrences[x], *([kept[r]] if r in kept else [])], key=lambda o: (order(o), o[2]))
    stay = set(kept.values())
    want = {(d, "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or (d, t, p) in stay)) for d, t in rows}
    assert set(found) == want
    assert LD.dedup_lines(table(spark, [])).count() == 0
    dropped = LD.drop_repeated_lines(table(spark, [(1, "same line here"), (2, "same line here"), (3, ""), (4, None)]))
    assert sorted((r.doc_id, r.text) for r in dropped.select("doc_id", "text").collect() if r.text is not None) == [(1, "same line here"), (3, "")]
    assert dropped.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_licenses(spark):
    mit = LS.KNOWN[0][1]
    wrapped = "Copyright (c) 2020 Jane Doe\nAll rights reserved.\n\n" + re.sub(r"\s+", "\n", mit.upper())
    british = "# Licenced under the APACHE licence -- version 2.0"
    rows = [(1, wrapped), (2, f"prose\n{british}\nmore"), (3, None), (4, ""), (5, mit + " and more"), (None, british), (6, "© 2020"), (7, "MIT"), (7, "MIT")]
    found = sorted((r.doc_id or 0, r.line, r.license_id) for r in LS.licenses(table(spark, rows)).collect())
    assert found == [(0, 0, "Apache-2.0"), (0, 1, "Apache-2.0"), (1, 0, "MIT"), (2, 2, "Apache-2.0")]
    assert LS.licenses(table(spark, [])).count() == 0


LONG = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="the system has no licence texts")
def test_long_licenses(spark):
    """Whole licences, joined into one line, shouted and of British spelling; one with a word more is none."""
    texts = {n: Path("/usr/share/common-licenses", f).read_text() for f, n in LONG.items()}
    rows = [(k, t) for k, t in enumerate(texts.values())]
    rows += [(10 + k, "Copyright (C) 2020 Someone\n" + re.sub(r"\bLICENSE\b", "licence", t.upper()).replace("HTTP:", "https:")) for k, t in rows]
    rows += [(20 + k, t + " besides") for k, t in rows[: len(texts)]]
    want = [(k + more, n) for more in (0, 10) for k, n in enumerate(texts)]
    assert sorted((r.doc_id, r.license_id) for r in LS.licenses(table(spark, rows)).where("line = 0").collect()) == sorted(want)


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_layers():
    plain = 'token = "abcdef123456"'
    packed = base64.b64encode(gzip.compress(base64.b64encode(plain.encode()))).decode()
    cases = {
        f"q {packed} z": (2, 2 + len(packed)), f"u {quote(plain)} v": (2, 2 + len(quote(plain)) - 3), quote(quote(plain)): (0, len(quote(quote(plain))) - 5),
        "".join(f"\\u{ord(c):04x}" for c in plain): (0, 6 * len(plain) - 6), "&#116;oken=abcdef": (0, 17),
    }
    for t, (s, e) in cases.items():
        base, spans, layers = SS.scan(t)
        assert (s, 0, e) in spans and layers > 0, t
        assert set(base) <= set(spans) and base == base_spans(t)
    again = base64.b64encode(plain.encode()).decode()
    assert len(SS.scan(f"{again} {again}")[1]) == 2  # one secret at two places
    quine = base64.b64encode(zlib.compress(b"x" * 100000)).decode()
    assert SS.scan(quine)[2] == 1
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice(["password: ", "token=", "AKIA", "api_key", "secret='", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "f", " ", "=", "é", "%41"]) for _ in range(rng.randint(1, 12)))
        assert SS.base_spans(t) == base_spans(t)


def test_secret_rows(spark, corpus):
    rows = [*corpus, (70, "password: hunter2hunter"), (70, "password: hunter2hunter")]
    found = SS.find_secrets(table(spark, rows)).collect()
    assert len(found) == len(rows)
    hit = [r for r in found if r.doc_id == 70]
    assert [(r.n_assign, r.spans) for r in hit] == [(1, "assign:0:23")] * 2
    assert hit[0].base_sha256 == hashlib.sha256(b"assign:0:23").hexdigest()
    assert SS.find_secrets(table(spark, [])).count() == 0


def test_surrogates(spark, corpus):
    people = "Mail jane.doe@shop.example.com or JANE.DOE@shop.example.com, +1 (415) 555-0100 or 415-555-0100, 10.20.30.40, card 4111 1111 1111 1111 and 4111111111111111, Mrs. Smith and Anna Smith, г-н; Иван Петров и Анна Петрова."
    rows = [*corpus, (80, people), (81, "ask jane.doe@shop.example.com"), (82, "ask jane.dot@shop.example.com")]
    found = {(r.doc_id, i): r for i, r in enumerate(PII.pseudonymised(table(spark, rows), "k").collect())}
    assert len(found) == len(rows)
    by = {r.doc_id: r.text for r in found.values() if r.doc_id is not None and r.doc_id >= 80}
    assert not re.search(r"(?i)jane|415|10\.20|4111|Smith|Петров|Anna|Иван|Анна", by[80])
    mails = re.findall(r"[\w.]+@[\w.]+\.com", by[80])
    assert mails[0] == mails[1].lower() == re.findall(r"\S+@\S+", by[81])[0] and mails[1].split("@")[0].isupper()
    assert by[81] != by[82]
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4})", by[80])
    assert phone.groups()[:3] == phone.groups()[3:]
    cards = re.search(r"card ([\d ]{19}) and (\d{16})", by[80])
    assert cards[1].replace(" ", "") == cards[2]
    total = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(cards[2]))))
    assert total % 10 == 0
    names = re.search(r"Mrs\. (\w+) and (\w+) (\w+), г-н; (\w+) (\w+) и (\w+) (\w+)", by[80])
    assert names[1] == names[3] and names[2].endswith("na") and re.fullmatch("[А-Яа-я]+", names[4]) and names[6].endswith("на") and names[7].endswith("ова")
    clean = Counter(t or "" for d, t in corpus)
    assert Counter(r.text for r in found.values() if r.doc_id is None or r.doc_id < 80) == clean
    assert PII.pseudonymised(table(spark, []), "k").count() == 0


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"at 10.0.{i // 250}.{i % 250 + 1}") for i in range(3000)]
    found = PII.pseudonymised(table(spark, rows), "k2")
    assert found.select("text").distinct().count() == 3000


def test_quality(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40) if i % 3 else "BUY!! " * 30 + prose(rng, 5).upper()) for i in range(300)] + [(500, None), (501, ""), (None, "x"), (502, "word " * 30000), (7, "again")]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = FM.train(docs, labels)
    found = FM.score(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    out = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 300 and r.doc_id != 7]
    assert {r.doc_id for r in out} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1 and i != 7}
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in out]) >= 0.95
    assert FM.keep_good(docs, model).columns == docs.columns
    assert FM.score(table(spark, []), model).count() == 0
    assert FM.score(docs, FM.train(docs, labels.limit(0))).count() == len(rows)


def test_factorisation_identity():
    fm = FM.FactorisationMachine(50, 4, 1)
    rng = np.random.default_rng(0)
    fm.w = rng.standard_normal(50).astype(np.float32)
    i, x = np.array([3, 8, 20, 41]), np.array([0.5, 1, 2, 0.25], np.float32)
    pairs = sum(fm.v[a] @ fm.v[b] * p * q for k, (a, p) in enumerate(zip(i, x, strict=True)) for b, q in list(zip(i, x, strict=True))[k + 1 :])
    assert math.isclose(fm.margin(i, x), fm.w[i] @ x + pairs, rel_tol=1e-4)


def test_fingerprints(spark, corpus):
    rows = sorted(text(corpus), key=lambda r: (r[0] is None, -(r[0] or 0)))
    found = FP.fingerprints(table(spark, corpus)).collect()
    assert len(found) == len(rows)
    only = [(d, t) for d, t in rows if d is not None and d != 3]  # ids that are not repeated have one next
    following = {d: rows[rows.index((d, t)) + 1] for d, t in only}
    for r in found:
        if r.doc_id in following and following[r.doc_id][0] not in (None, 3):
            t = dict(only)[r.doc_id]
            assert r.n_chars == len(t)
            new = FP.edited(t, following[r.doc_id][1])
            assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            assert abs(r.near_edited - FP.jaccard(t, new)) < 0.2
    alike = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if FP.jaccard(rows[i][1], rows[j][1]) >= 0.8])
    want = Counter(zip([d for d, _ in rows], lowest([d for d, _ in rows], alike), strict=True))
    assert Counter((r.doc_id, r.component_id) for r in found) == want
    assert FP.fingerprints(table(spark, [])).count() == 0
    alone = FP.fingerprints(table(spark, [(1, "a b c d e f")])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()


def test_language_model(spark, corpus):
    found = LM.interpolated(table(spark, corpus), block_chars=500).collect()
    rows = text(corpus)
    assert len(found) == len(rows)
    tokens = [(d, t.encode().lower().split() + [b"\n"]) for d, t in rows]
    learn = [w for d, w in tokens if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(x for w in learn for x in w)
    n, v = sum(c.values()), len(c)
    base = sorted(round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6) for _, w in tokens)
    assert sorted(round(r.base_score, 6) for r in found) == base
    assert {r.train_tokens for r in found} == {n}
    assert Counter((r.doc_id, r.n_tokens, r.n_known) for r in found) == Counter((d, len(w), sum(c[x] > 0 for x in w)) for d, w in tokens)
    assert all(r.score < 0 for r in found)
    assert LM.interpolated(table(spark, [])).count() == 0


def test_mixture_weights_follow_the_counts():
    one = (3 * LM.LEVELS + LM.ZERO + 40) * LM.LEVELS + LM.ZERO  # the bigram says much more than the others
    mix = LM.weights(np.array([one]), np.array([1000.0]), np.array([1000 * 2.0**10]), np.array([1000.0]))
    assert mix[3, 0] > 0.95 and np.allclose(mix.sum(axis=1), 1)


def test_interpolation_is_a_distribution():
    """Over all words and an unseen one the probabilities after a context add up to 1."""
    counts = {b"a": {b"a": 3, b"b": 1}}
    word = np.array([5, 2, 0])
    pair = np.array([counts[b"a"][b"a"], counts[b"a"][b"b"], 0])
    two, one, zero = LM.estimates(pair, np.full(3, 4), word, 7, 2)
    assert math.isclose((0.5 * two + 0.3 * one + 0.2 * zero).sum(), 1.0)


def simhash(t):
    import xxhash

    words = t.encode().lower().split()
    rows = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in rows]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash(spark, corpus):
    rows = text(corpus)
    found = SH.near_duplicates(table(spark, corpus)).collect()
    codes = [simhash(t) for _, t in rows]
    roots = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 4])
    ids = [d for d, _ in rows]
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in found) == Counter(zip(ids, codes, lowest(ids, roots), strict=True))
    assert SH.near_duplicates(table(spark, [])).count() == 0
    rows = SH.fingerprints(table(spark, corpus))
    by_trees, by_blocks = ({(r["node"], r["root"]) for r in SH._labels(rows, 4, 3, sent).collect()} for sent in (SH.SENT, 0))
    assert by_trees == by_blocks
    small = SH.near_duplicates(table(spark, corpus), tree_codes=3).collect()  # shards cut into several trees
    assert Counter(map(tuple, small)) == Counter(map(tuple, found))


def test_bk_tree():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 2**63, 500, np.uint64) & np.uint64(0xFFFF))
    got = {(int(a), int(b)) for x, y in SH.BKTree(codes).near(codes, 4) for a, b in zip(x, y, strict=True)}
    assert got == {(int(a), int(b)) for a in codes for b in codes if int(a ^ b).bit_count() <= 4}


@pytest.mark.parametrize("blocks", [5, 6, 7, 9])
def test_linked_codes_agree_under_a_mask(blocks):
    rng = random.Random(blocks)
    masks = SH.block_masks(blocks, 4)
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rows = [*corpus, (90, "don't İx <|endoftext|> é ½ 12ab"), (91, "word " * 9000)]
    found = PK.pack(table(spark, rows).coalesce(1), tokenizer_path(), chunk_tokens=20000).collect()
    want = Counter()
    for d, t in text(rows):
        ids = whole.encode(t, add_special_tokens=False).ids + [2]
        want[d, len(ids)] += 1
    whole_docs = Counter((r.doc_id, r.doc_tokens) for r in found if r.start == 0)
    assert whole_docs == want
    for d in (3, 90, 91):
        ids = whole.encode(dict(text(rows))[d], add_special_tokens=False).ids + [2]
        pieces = sorted({(r.start, r.length, r.ids_crc32) for r in found if r.doc_id == d})
        for s, n, crc in pieces:
            assert crc == zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert PK.pack(table(spark, []), tokenizer_path()).count() == 0


def test_costs_are_balanced():
    lengths = np.random.default_rng(3).integers(1, 3000, 500)
    pieces = PK.assign(lengths)
    used, cost = Counter(), Counter()
    for _, _, n, seq, _ in pieces:
        used[seq] += n
        cost[seq] += PK.LINEAR * n + PK.QUADRATIC * n * n
    assert sum(used.values()) == lengths.sum() and len(used) == -(-lengths.sum() // 4096)
    assert max(cost.values()) < 1.6 * np.mean(list(cost.values()))


def brute_tiles(a, b, least):
    """Greedy string tiling by its definition: the longest unmarked match again and again."""
    free_a, free_b, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return total
        n, i, j = best
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False
        total += n


def test_tiling_equals_its_definition():
    rng = np.random.default_rng(7)
    for _ in range(60):
        a, b = rng.integers(1, 4, rng.integers(0, 25)).astype(np.int32), rng.integers(1, 4, rng.integers(0, 40)).astype(np.int32)
        found = DC.tiles(a, b, 3)
        for i, j, n in found:
            assert (a[i : i + n] == b[j : j + n]).all() and n >= 3
        marked = Counter(k for i, _, n in found for k in range(i, i + n))
        assert all(x == 1 for x in marked.values())
        assert sum(n for _, _, n in found) == brute_tiles(a, b, 3)


def test_decontamination(spark, corpus):
    rng = random.Random(8)
    item = [f"w{rng.randint(0, 500)}" for _ in range(40)]
    moved = item[20:] + ["filler"] * 3 + item[:20]
    rows = [*corpus, (100, "before " + " ".join(item).upper() + "! after"), (101, " ".join(moved)), (102, " ".join(item[:12])), (101, " ".join(moved))]
    tests = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (4, "short test")], "item_id long, text string")
    found = DC.contaminated(table(spark, rows), tests).collect()
    assert Counter((r.doc_id, r.item_id, round(r.coverage, 3)) for r in found) == Counter({(100, 1, 1.0): 2, (101, 1, 1.0): 4})
    blocks = DC.contaminated(table(spark, rows), tests, block_tokens=20)
    assert Counter(map(tuple, blocks.collect())) == Counter(map(tuple, found))
    kept = DC.decontaminate(table(spark, rows), tests)
    assert kept.count() == len(rows) - 3 and kept.columns == table(spark, []).columns
    assert DC.contaminated(table(spark, rows), tests.limit(0)).count() == 0
    assert DC.contaminated(table(spark, []), tests).count() == 0


def test_columns_of_other_types_stay_out(spark):
    docs = table(spark, [(1, "a b c d e")]).withColumn("bucket", F.lit("clash")).withColumn("fp", F.lit("clash"))
    assert SH.near_duplicates(docs).columns == ["doc_id", "fp", "component_id"]


def test_bk_tree_walks_inner_nodes(monkeypatch):
    """A tree of a shard has inner nodes, and edges outside the radius are not followed."""
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 2**63, 3000, np.uint64))
    compared, inner, near = [], [], SH.BKTree.near

    def counted(self, asked, radius):
        inner.append(self.leaf is None)
        compared.append(len(asked) * (1 if self.leaf is None else len(self.leaf)))
        return near(self, asked, radius)

    monkeypatch.setattr(SH.BKTree, "near", counted)
    flipped = codes ^ np.uint64(0b1011)
    got = {(int(a), int(b)) for x, y in SH.BKTree(codes).near(flipped, 4) for a, b in zip(x, y, strict=True)}
    assert got == {(int(a), int(b)) for a in flipped for b in codes[np.bitwise_count(codes ^ a) <= 4]}
    assert sum(inner) > 50 and sum(compared) < 0.8 * len(codes) ** 2


def test_shards_stay_small():
    assert SH.blocks_for(236_000, 4) == 5 and SH.blocks_for(10**9, 4) == 6
    assert 10**12 / 2.0 ** (64 * (SH.blocks_for(10**12, 4) - 4) // SH.blocks_for(10**12, 4)) <= SH.SHARD_CODES


def test_rolling_hashes():
    """Each window's hash is that of its words alone, wherever it stands and whatever its length."""
    rng = np.random.default_rng(9)
    ids = rng.integers(0, 6, 400).astype(np.int32)
    rolls = DC.Rolling(ids)
    assert len(rolls.sums) == len(ids) + 1  # one number for each word
    for n in (1, 2, 7, 399, 400, 401):
        hashes, seen = rolls.windows(n), {}
        assert len(hashes) == max(0, len(ids) - n + 1)
        for i, h in enumerate(hashes.tolist()):
            assert seen.setdefault(ids[i : i + n].tobytes(), h) == h
            assert n > 20 or DC.Rolling(ids[i : i + n]).windows(n)[0] == h
        assert len(set(seen.values())) == len(seen)


def test_long_text_tiles():
    """An item of 8,000 words in a text of 20,000 that holds it in two passages."""
    rng = np.random.default_rng(10)
    item = rng.integers(1, 50_000, 8000).astype(np.int32)
    text = np.concatenate([rng.integers(60_000, 90_000, 6000), item[3000:], rng.integers(60_000, 90_000, 6000), item[:3000]]).astype(np.int32)
    assert sorted(DC.tiles(item, text, 5)) == [(0, 17000, 3000), (3000, 6000, 5000)]


def test_scores_follow_their_definition(spark):
    """score against a direct calculation, with expectation-maximisation over every token by itself."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["red", "green", "blue", "sky", "sea"]) if rng.random() < 0.7 else prose(rng, 1) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    found = {r.doc_id: r.score for r in LM.interpolated(table(spark, rows), block_chars=800).collect()}
    tokens = {d: [b"\t", *t.encode().lower().split(), b"\n"] for d, t in rows}
    learn = [w for d, w in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    one = Counter(x for w in learn for x in w)
    two = Counter(p for w in learn for p in zip(w, w[1:], strict=False))
    n, v = sum(one.values()) - len(learn), len(one) - 1
    octave = lambda c: int(math.log2(max(c, 0) + 1))
    kept = [(octave(one[a] - 1), [(two[a, b] - 1) / (one[a] - 1) if one[a] > 1 else 0, (one[b] - 1) / (n - 1), 1 / (v + 1)]) for w in learn for a, b in zip(w, w[1:], strict=False)]
    mix = {k: [1 / 3] * 3 for k in range(LM.BUCKETS)}
    for _ in range(LM.ROUNDS):
        total = {k: [1e-3] * 3 for k in mix}
        for k, p in kept:
            part = [m * x for m, x in zip(mix[k], p, strict=True)]
            for i in range(3):
                total[k][i] += part[i] / sum(part)
        mix = {k: [x / sum(t) for x in t] for k, t in total.items()}
    for d, w in tokens.items():
        want = 0
        for a, b in zip(w, w[1:], strict=False):
            p = [two[a, b] / one[a] if one[a] else 0, one[b] / n, 1 / (v + 1)]
            want += math.log10(sum(m * x for m, x in zip(mix[octave(one[a])], p, strict=True)))
        assert math.isclose(found[d], want, rel_tol=0.01), (d, found[d], want)


def test_broadcast_trees_have_inner_nodes_on_real_codes():
    """Trees of the fingerprints of sf0.1: nearly all codes stand below inner nodes, and edges outside the radius are not followed."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()[:3000]]
    codes = np.unique(np.array([SH.fingerprint(t) for t in texts], np.uint64))
    trees = SH.forest(codes, 1024)
    assert len(trees) > 1 and sum(t.inner() for t in trees) > len(codes) / 40
    found = {(int(a), int(b)) for t in trees for x, y in t.near(codes, 4) for a, b in zip(x, y, strict=True)}
    want = {(int(a), int(b)) for a in codes for b in codes[np.bitwise_count(codes ^ a) <= 4]}
    assert found == want


def test_all_ids_are_packed_and_nothing_is_padded(spark, corpus):
    """Each document's ids against the whole tokenizer, piece by piece; sequences are full or a power of two."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rows = [(i, t) for i, (_, t) in enumerate(text([*corpus, (90, "don't İx <|endoftext|> é ½ 12ab"), (91, "word " * 9000), (92, "")]))]
    found = PK.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), tokenizer_path(), chunk_tokens=9000).collect()
    pieces = {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
    for d, t in rows:
        ids, at = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sizes = Counter()
    for r in found:
        sizes[r.sequence_id] += r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sizes.values())
