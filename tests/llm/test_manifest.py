"""Merkle trees and paths against trees made at once in lists."""

import hashlib
import random
from zlib import crc32

import duckdb
import pytest

from parlance.llm import manifest
from parlance.llm import queries as Q


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def climb(nodes):
    """(root, path of each node as steps) of a list of digests."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            first = at[k] // 3 * 3
            path.append(("".join(nodes[first : at[k]]), "".join(nodes[at[k] + 1 : first + 3])))
            at[k] //= 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(docs):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = {}
    for row in docs:
        leaf, changed = sha("".join(map(field, row))), None
        if row[0] is not None and crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
            changed = sha("".join(map(field, (*row[:4], row[4].replace("\n", "")))))
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf, changed or leaf))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([r[2] for r in sorted(sources[s])]) for s in order}
    root, up = climb([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, up):
        for (has, d, leaf, changed), path in zip(sorted(sources[s]), trees[s][1]):
            folded = changed
            for left, right in path + above:
                folded = sha(left + folded + right)
            out.append((d if has else None, leaf, trees[s][0], root, sha("".join(a + b for a, b in path + above)), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [2, 6])
def test_awkward_rows(spark, height):
    rng = random.Random(3)
    docs = [(i, rng.choice(["hot", "hot", "b", "é", "Z"]), rng.choice(["en", None]), i, rng.choice(["a\nb", "plain", "é\n\n", None, ""])) for i in range(260)]
    docs += [(5, "hot", "en", 5, "a\nb")] * 30 + [(None, "hot", None, None, f"x\n{i}") for i in range(40)] + [(None, None, None, None, None)] * 12
    docs += [(900, "", "en", 1, "lone\n"), (901, "one", "en", 1, "q" * 300_000 + "\n"), (-3, "hot", "en", 2**40, "\n")]
    schema = "doc_id long, source string, lang string, n_chars long, text string, key string, rank int"
    frame = spark.createDataFrame([(*d, "k", 1) for d in docs], schema).repartition(5)
    tampered = manifest.F.when(manifest.F.crc32(manifest.F.col("doc_id").cast("string").cast("binary")) % 2 == 0, manifest.F.replace("text", manifest.F.lit("\n"), manifest.F.lit(""))).otherwise(manifest.F.col("text"))
    got = manifest.check_tampered(frame, tampered, height).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs)
    assert 0 < sum(r.verified for r in got) < len(got)
    if height == 2:
        proofs = manifest.prove(frame, height).collect()
        assert len(proofs) == len(docs) and sum(r.source is None for r in proofs) == 12
        for r in proofs:
            path = list(zip(r.path[::2], r.path[1::2]))
            assert manifest.fold(r.leaf, path) == r.root and manifest.fold("0" * 64, path) != r.root
        assert manifest.prove(frame.limit(0)).count() == 0


def test_traversal_makes_every_path_with_few_nodes():
    for n in [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 100, 243, 700, 729]:
        leaves = [sha(str(i)) for i in range(n)]
        height = next(h for h in range(9) if 3**h >= n)
        root, paths = climb(list(leaves))
        assert [list(p) for p in manifest.traverse(leaves, height)] == paths
        assert manifest.block_root(leaves, height) == root


def test_stacks_stay_small(monkeypatch):
    held, made = [0], []
    real = manifest.Treehash.__init__
    monkeypatch.setattr(manifest.Treehash, "__init__", lambda self, *a: (real(self, *a), made.append(self))[0])
    for _ in manifest.traverse([str(i) for i in range(729)], 6):
        made[:] = [t for t in made if t.at < t.end or t.end == 729]
        held.append(sum(len(r) for t in made[-12:] for r in t.runs))
    assert max(held) <= 60  # of 729 leaves: some nodes for each of six levels


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = Q.op12_manifest(spark, sf)
    want = con.sql(Q.SQL["op12_manifest"]).select(*df.columns).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
