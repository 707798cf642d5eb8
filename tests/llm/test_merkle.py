"""The manifest against a plain tree built in Python."""

import zlib
from hashlib import sha256

import pytest

from shopweave.llm import common, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, g int, path string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """(top, [siblings before and after of each node, level by level])"""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            paths[k].append((run[: i % 3], run[i % 3 + 1 :]))
        nodes, at = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = own, *climb([leaf(r, r["text"]) for r in own])
    root, over = climb([trees[s][1] for s in order])
    out = []
    for s, up in zip(order, over, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            text, x = r["text"], leaf(r, r["text"])
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                x = leaf(r, text.replace("\n", ""))
            for before, after in path + up:
                x = digest(*before, x, *after)
            proof = digest(*[h for before, after in path + up for h in before + after])
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, proof, x, x == root))
    return sorted(out, key=str)


def row(doc_id, text, lang="en", source="a", n_chars=1):
    return {"doc_id": doc_id, "text": text, "lang": lang, "source": source, "n_chars": n_chars, "h": "mine", "g": 7, "path": "mine"}


CASES = {
    "one": [row(4, "a\nb")],
    "none": [],
    "many": [row(i, f"t{i}\n" * (i % 3), source=f"s{i % 5 * (i % 2)}") for i in range(60)] + [row(100 + i, "\n", source="hot") for i in range(82)],
    "odd": [
        row(None, "x"), row(None, "y\n"), row(None, "y\n"), row(1, None), row(2, ""), row(3, "é\n", None, None, None), row(4, "\n", "", ""), row(4, "b\n", "", ""), row(4, "b\n", "", ""),
        row(-5, "n\n", source="ä"), row(6, "n\r\n", source="Z"), row(8, "long\n" * 300000, source="Z"), row(9, "n", source="\U0001f600"), row(9, "n", source="ﬀ"),
    ],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_manifest_equals_a_plain_tree(spark, name):
    docs = spark.createDataFrame(CASES[name], SCHEMA)
    found = merkle.manifest(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == (plain(CASES[name]) if CASES[name] else [])


def test_other_fanouts_give_proofs_that_fold_to_the_root(spark):
    docs = spark.createDataFrame([row(i, str(i), source=f"s{i % 4}") for i in range(40)], SCHEMA)
    leaves = docs.select("doc_id", "source", merkle.leaf({"doc_id": docs.doc_id}).alias("h"))
    for fanout in (2, 5):
        found = merkle.proofs(common.grouped(leaves, "source", "doc_id"), fanout)
        rows = found.select("top.root", merkle.folded(found.h, found.path).alias("back")).collect()
        assert len(rows) == 40 and len({r["root"] for r in rows}) == 1 and all(r["root"] == r["back"] for r in rows)
