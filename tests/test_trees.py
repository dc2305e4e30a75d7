"""Tree sequence files, and counts kept up along them, against genotypes made site by site."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from strandloom.operators import genealogy
from strandloom.sources import contigs as C
from strandloom.sources import trees

LENGTH, SAMPLES = 5000, 6


def history(seed: int, moves: int = 120):
    """Edges of a forest in which nodes move below older ones, and mutations, some of them on one site or going back."""
    rng = random.Random(seed)
    last, edges = {}, []
    for left in sorted(rng.sample(range(LENGTH), moves)):
        child = rng.randrange(SAMPLES + 5)
        parent = rng.randrange(max(child + 1, SAMPLES), SAMPLES + 6)
        if child in last:
            start, old = last[child]
            edges.append((float(start), float(left), old, child))
        last[child] = (left, parent) if rng.random() < 0.9 else None
        if last[child] is None:
            del last[child]
    edges += [(float(start), float(LENGTH), parent, child) for child, (start, parent) in last.items()]
    muts = []
    for pos in sorted(rng.sample(range(LENGTH), 400)):
        for i, node in enumerate(rng.sample(range(SAMPLES + 6), rng.choice((1, 1, 2, 3)))):
            muts.append((pos + 0.5 * rng.randrange(2), i, node, rng.choice("TTGA"), "A"))
    return edges, muts


def genotypes(edges, muts):
    """(pos, node, allele) of every sample, by climbing to the first mutation above."""
    sites = {}
    for pos, _, node, state, _ in muts:
        sites.setdefault(pos, {})[node] = state
    out = []
    for pos, own in sites.items():
        parent = {c: p for left, right, p, c in edges if left <= pos < right}
        for sample in range(SAMPLES):
            node = sample
            while node is not None and node not in own:
                node = parent.get(node)
            out.append((pos, sample, own.get(node, "A")))
    return out


def frames(spark, edges, muts):
    return spark.createDataFrame(edges, "left double, right double, parent long, child long"), spark.createDataFrame(muts, "pos double, id long, node long, state string, ancestral string")


def shown(source, window):
    seen = source.observe(window)
    return {(r.sample, r.win): r.ob for r in seen.het.collect()}, {r.k: r.n_sites for r in seen.spectrum.collect()}


@pytest.mark.parametrize("span", [97, 1000, 1 << 20])
@pytest.mark.parametrize("masked", [False, True])
def test_edges_show_what_genotypes_show(spark, span, masked):
    edges, muts = history(span + masked)
    pairs = [(0, 1), (2, 3), (1, 4)]
    masks = spark.createDataFrame([(250, 1000), (4100, 4150)], "a long, b long") if masked else None
    codes = {"A": 0, "T": 1, "G": 2}
    rows = spark.createDataFrame([(p, n, codes[a]) for p, n, a in genotypes(edges, muts)], "pos double, node long, allele long")
    want = shown(C.PairsContig(rows, pairs, LENGTH, masks), 100)
    assert sum(v > 0 for v in want[0].values()) > 20 and len(want[1]) > 2
    assert shown(C.TreesContig(*frames(spark, edges, muts), pairs, LENGTH, masks, span=span), 100) == want


def test_neither_mutations_nor_edges_are_needed(spark):
    edges, muts = history(1)
    none = [x.limit(0) for x in frames(spark, edges, muts)]
    assert shown(C.TreesContig(frames(spark, edges, muts)[0], none[1], [(0, 1)], LENGTH), 1000) == ({("0", w): 0 for w in range(5)}, {})
    alone = spark.createDataFrame([(10.0, 0, 1, "T", "A"), (20.0, 0, 9, "T", "A")], none[1].schema)
    assert shown(C.TreesContig(none[0], alone, [(0, 1)], LENGTH), 1000)[1] == {1: 1}


def test_two_parents_at_once_are_an_error():
    forest = genealogy.Forest(4, np.eye(4, dtype=np.int64))
    forest.insert(2, 0)
    forest.insert(3, 0)
    with pytest.raises(ValueError, match="two parents"):
        forest.remove(2, 0)


@pytest.fixture
def stored(spark, tmp_path):
    edges, muts = history(7)
    rows = [("chr1", float(LENGTH), "edge", *map(float, e), None, None) for e in edges] + [("chr1", float(LENGTH), "mutation", m[0], float(m[2]), float(m[1]), None, m[3], m[4]) for m in muts]
    df = spark.createDataFrame(rows, "name string, length double, kind string, a double, b double, c double, d double, state string, ancestral string")
    (one,) = trees.write_files(df, str(tmp_path)).collect()
    return one.file, edges, muts


def test_file_reads_back(spark, stored):
    path, edges, muts = stored
    got = trees.edges_of(spark, path).drop("file").collect()
    assert sorted(map(tuple, got)) == sorted(edges)
    got = trees.mutations_of(spark, path).select("pos", "node", "state", "ancestral").collect()
    assert sorted(map(tuple, got)) == sorted((p, n, s, a) for p, _, n, s, a in muts)
    pairs = [(0, 5), (2, 3)]
    assert shown(C.contig(spark, path, pairs), 100) == shown(C.TreesContig(*frames(spark, edges, muts), pairs, LENGTH), 100)


def test_partitions_columns_and_ends(spark, stored, monkeypatch):
    path, edges, muts = stored
    rows = trees.read_table(spark, path, "edges", ["right", "id"], rows=10)
    assert rows.columns == ["right", "id"] and rows.rdd.getNumPartitions() == -(-len(edges) // 10)
    assert [r.id for r in rows.orderBy("id").collect()] == list(range(len(edges)))
    sites = sorted({m[0] for m in muts})
    for low, high in ((1000, 2000), (sites[3], sites[9]), (-5, 0), (9999, 10**9), (None, sites[5]), (sites[-2], None)):
        got = trees.read_table(spark, path, "sites", rows=50, low=low, high=high)
        assert [r.position for r in got.orderBy("position").collect()] == [x for x in sites if (low is None or low <= x) and (high is None or x < high)]
    reader = trees.TreesReader({"table": "sites", "path": path, "rows": "50", "low": str(sites[100]), "high": str(sites[160])}, trees.read_table(spark, path, "sites").schema)
    assert [(r.low, r.high) for r in reader.partitions()] == [(100, 150), (150, 160)]
    with pytest.raises(Exception, match="not sorted"):
        trees.read_table(spark, path, "edges", low=5).collect()


def test_only_wanted_bytes_are_read(stored):
    path, edges, _ = stored
    taken = []

    class Watched:
        def __init__(self, file):
            self.file = file

        def seek(self, at):
            self.at = at
            return self.file.seek(at)

        def read(self, n):
            taken.append(n)
            return self.file.read(n)

        def size(self):
            return self.file.size()

    with pa.OSFile(path) as file:
        arrays = trees.directory(Watched(file))
        taken.clear()
        trees.column_of(Watched(file), arrays, "edges", "parent", 5, 25)
    assert taken == [20 * 4]


def test_individuals_are_the_default(spark, tmp_path):
    arrays = {"sequence_length": np.array([50.0]), "nodes/time": np.zeros(5), "nodes/individual": np.array([1, 0, -1, 0, 1], "i4")}
    arrays |= {"edges/left": np.array([0.0]), "edges/right": np.array([50.0]), "edges/parent": np.array([2], "i4"), "edges/child": np.array([0], "i4")}
    text, ends = trees.ragged(["A", "CC"])
    arrays |= {"sites/position": np.array([3.0, 7.0]), "sites/ancestral_state": text, "sites/ancestral_state_offset": ends.astype("u8")}
    text, ends = trees.ragged(["T", "é"])
    arrays |= {"mutations/site": np.array([0, 1], "i4"), "mutations/node": np.array([2, 3], "i4"), "mutations/derived_state": text, "mutations/derived_state_offset": ends}
    (tmp_path / "a.trees").write_bytes(trees.encoded(arrays))
    source = C.contig(spark, str(tmp_path / "a.trees"))
    assert source.pairs == [(1, 3), (0, 4)] and source.shortest == 50
    assert shown(source, 10) == ({("0", 0): 1, ("1", 0): 1} | {(s, w): 0 for s in "01" for w in range(1, 5)}, {1: 2})
    assert [r.state for r in trees.mutations_of(spark, str(tmp_path / "a.trees")).orderBy("pos").collect()] == ["T", "é"]


def test_what_is_no_store(spark, tmp_path):
    (tmp_path / "a.trees").write_bytes(b"not a store" * 20)
    with pytest.raises(Exception, match="not a tree sequence file"):
        trees.edges_of(spark, str(tmp_path / "a.trees")).collect()
    (tmp_path / "b.trees").write_bytes(trees.encoded({"sequence_length": np.array([1.0])})[:-4])
    with pytest.raises(Exception, match="bytes of"):
        trees.read_table(spark, str(tmp_path / "b.trees"), "sequence").collect()
    for bad, message in ((lambda: C.contig(spark, "a.trees", [(0, 1)], "1:1-9"), "region"), (lambda: C.contig(spark, "a.vcf", ["A"]), "region"), (lambda: C.contig(spark, "a.tsz"), "no source"), (lambda: trees.read_table(spark, "a.trees", "edges", ["time"]), "no time")):
        with pytest.raises(ValueError, match=message):
            bad()


def written(spark, folder, files: int):
    """A folder of small files, each with a history of its own, and what is in them."""
    rows, edges, muts = [], [], []
    for i in range(files):
        own = history(i, moves=30)
        edges += [(f"c{i}", *e) for e in own[0]]
        muts += [(f"c{i}", m[0], m[2], m[3], m[4]) for m in own[1]]
        rows += [(f"c{i}", float(LENGTH), "edge", *map(float, e), None, None) for e in own[0]] + [(f"c{i}", float(LENGTH), "mutation", m[0], float(m[2]), float(m[1]), None, m[3], m[4]) for m in own[1]]
    df = spark.createDataFrame(rows, "name string, length double, kind string, a double, b double, c double, d double, state string, ancestral string")
    assert trees.write_files(df, folder).count() == files
    return sorted(edges), sorted(muts)


def test_small_files_go_together(spark, tmp_path, monkeypatch):
    """A folder's small files are few partitions, and are opened by the tasks that read them, mutations with their sites."""
    edges, muts = written(spark, str(tmp_path), 12)
    name = lambda path: path.rsplit("/", 1)[1].removesuffix(".trees")
    rows = trees.edges_of(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 1
    assert sorted((name(r.file), *r[1:]) for r in rows.collect()) == edges
    found = trees.mutations_of(spark, str(tmp_path))
    assert sorted((name(r.file), r.pos, r.node, r.state, r.ancestral) for r in found.collect()) == muts
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    sites = {m[:2] for m in muts if 1000 <= m[1] < 2000}
    got = trees.read_table(spark, str(tmp_path), "sites", ["file", "position"], low=1000, high=2000).collect()
    assert len(got) == len(sites) and {(name(r.file), r.position) for r in got} == sites
    few = trees.read_table(spark, str(tmp_path), "edges", ["id"], rows=10)
    assert few.rdd.getNumPartitions() > 12 and few.rdd.glom().map(len).max() == 10
    monkeypatch.setattr(trees, "directory", lambda file: pytest.fail("opened"))
    reader = trees.TreesReader({"table": "edges", "path": str(tmp_path)}, rows.schema)
    assert [len(x.paths) for x in reader.partitions()] == [12]
    monkeypatch.setattr(trees, "SMALL", max(p.stat().st_size for p in tmp_path.glob("*.trees")) * 3)
    shares = [x.paths for x in reader.partitions()]
    assert len(shares) > 3 and sorted(p for x in shares for p in x) == [p for p, _ in reader.files()]


def test_sites_of_mutations(tmp_path, monkeypatch):
    """Sites far apart, in any order, read a few at a time; a mutation without a site is an error."""
    text, ends = trees.ragged([str(i) for i in range(50)])
    of = lambda sites: {"sites/position": np.arange(50) * 2.0, "sites/ancestral_state": text, "sites/ancestral_state_offset": ends, "mutations/site": np.array(sites, "i4")}
    monkeypatch.setattr(trees, "BATCH", 4)
    for sites in ([], [0], [3, 3, 9, 40, 41, 49], [7, 2, 30, 2]):
        with pa.BufferReader(trees.encoded(of(sites))) as file:
            arrays = trees.directory(file)
            assert trees.of_sites(file, arrays, "position", 0, len(sites)).to_pylist() == [2.0 * x for x in sites]
            assert trees.of_sites(file, arrays, "ancestral_state", 0, len(sites)).to_pylist() == [str(x) for x in sites]
    with pa.BufferReader(trees.encoded(of([50]))) as file, pytest.raises(ValueError, match="none of 50"):
        trees.of_sites(file, trees.directory(file), "position", 0, 1)


def test_counts_of_many_sets_are_one_number():
    """More pairs than a machine word has bits for; an edge changes one integer for each node above."""
    edges, muts = history(11)
    pairs = [(i % SAMPLES, (i + 1 + i // SAMPLES) % SAMPLES) for i in range(60)]
    table = lambda names, rows: pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    got = genealogy.sweep(table(("left", "right", "parent", "child"), edges), table(("pos", "id", "node", "state", "ancestral"), muts), pairs)
    alleles = {}
    for pos, sample, allele in genotypes(edges, muts):
        alleles.setdefault(pos, {})[sample] = allele
    assert [(pos, sorted(counts), differ) for pos, counts, differ in got] == [
        (pos, sorted(list(own.values()).count(x) for x in set(own.values()) - {"A"}), [i for i, (a, b) in enumerate(pairs) if own[a] != own[b]]) for pos, own in sorted(alleles.items())
    ]
    weights = np.zeros((4, 61), np.int64)
    weights[0] = 1
    forest = genealogy.Forest(4, weights)
    forest.insert(2, 0)
    assert all(isinstance(x, int) for x in forest.below) and forest.below[2] == forest.below[0] == (1 << 61) - 1


def test_of_moves_at_one_place_the_oldest_counts(spark, tmp_path):
    """Moves are told apart by the window that finds the next ones, and need no aggregation of all of them."""
    from strandloom.sources import adapters as A

    rng = random.Random(2)
    rows = [(rng.randrange(60) * 5000, 26 * rng.randrange(3) + rng.randrange(3), rng.randrange(40), rng.choice("AN")) for _ in range(300)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(400_000,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    moves = {}
    for key, part, supp, flag in rows:
        low = max(part % 26 + 1, A.HAPLOIDS)
        of = moves.setdefault((flag, part % 26), {})
        of[key * 10] = max(of.get(key * 10, 0), low + supp % (A.LINEAGES - low))
    want = []
    for (flag, child), of in moves.items():
        places = sorted(of)
        want += [(flag, a, b, of[a], child) for a, b in zip(places, [*places[1:], 4_000_020], strict=True)]
    assert len(want) < len(rows)
    assert sorted(map(tuple, A.lineages(spark, str(tmp_path)).collect())) == sorted(want)
