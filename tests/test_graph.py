import hashlib
import random
from collections import Counter, defaultdict, deque

from pyspark.sql import functions as F

from tessera.operators import community, graph, retrieval
from tessera.operators.community import hierarchical_communities, sub_communities
from tessera.operators.components import connected_components


def find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: r["component"] for r in got} == find(edges)
    assert len(got) == len({x for e in edges for x in e})


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(None, 1)], "src long, dst long")).collect() == []


def queue_bfs(anchor, depth, near, cap):
    seen, out, work = {anchor}, [anchor], deque([(anchor, 0)])
    while work and len(out) < cap:
        v, d = work.popleft()
        if d == depth:
            continue
        for u in sorted(near[v], key=lambda u: (hashlib.md5(f"bfs{v}|{u}".encode()).hexdigest(), u)):
            if u not in seen and len(out) < cap:
                seen.add(u)
                out.append(u)
                work.append((u, d + 1))
    return out


def test_capped_bfs_is_a_queue(spark):
    rng = random.Random(3)
    edges = {tuple(sorted((f"n{rng.randrange(60)}", f"n{rng.randrange(60)}"))) for _ in range(150)} | {("hub", f"n{i}") for i in range(60)}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    anchors = [(v, "tail" if i % 2 else "head") for i, v in enumerate([*sorted(near)[1:12], "hub"])]
    for cap in (4, 9, 30):
        got = graph.capped_bfs(spark.createDataFrame(anchors, "node string, kind string"), spark.createDataFrame(sorted(edges), "src string, tgt string"), cap=cap).collect()
        by = defaultdict(list)
        for r in sorted(got, key=lambda r: (r["anchor"], r["rank"])):
            by[r["anchor"]].append(r["node"])
        for v, kind in anchors:
            assert by[v] == queue_bfs(v, 2 if kind == "tail" else 1, near, cap), (v, kind, cap)


def test_degrees_of_loops_and_parallel_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c")], "src string, tgt string")
    assert dict(graph.degrees(e).collect()) == {"a": 2, "b": 2, "c": 2}
    assert dict(graph.simple_degrees(e).collect()) == {"a": 1, "b": 1, "c": 2}


def test_upper_median(spark):
    d = spark.createDataFrame([(str(i), n) for i, n in enumerate([1, 1, 2, 9])], "node string, degree long")
    assert graph.degree_stats(d).first().asDict() == {"max_degree": 9, "min_degree": 1, "mean_degree": 3.25, "median_degree": 2, "nodes": 4}


def test_anchors_prefer_low_degrees_and_respect_the_budget(spark):
    of = spark.createDataFrame([(f"t{i}", 1 + i % 4) for i in range(200)] + [(f"h{i}", 50) for i in range(40)], "node string, degree long")
    drawn = Counter()
    for seed in range(6):
        got = graph.sample_anchors(of, 20, 0.75, f"s{seed}").collect()
        assert Counter(r["kind"] for r in got) == {"tail": 15, "head": 5}
        drawn.update(r["degree"] for r in got)
    assert drawn[1] > drawn[3]


def test_two_hops_and_equal_names(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, tgt string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "x"), ("a", "a"), ("z", "z")], "a string, b string")
    assert {(r["a"], r["b"]): r["hops"] for r in graph.connected_within_two(pairs, e).collect()} == {("a", "b"): 1, ("a", "c"): 2, ("a", "x"): None, ("a", "a"): 2, ("z", "z"): None}


def test_clusters_are_nested(spark):
    rng = random.Random(5)
    edges = [(f"{g}-{rng.randrange(12)}", f"{g}-{rng.randrange(12)}") for g in range(5) for _ in range(40)] + [(f"{g}-0", f"{g + 1}-0") for g in range(4)]
    got = hierarchical_communities(spark.createDataFrame([e for e in edges if e[0] != e[1]], "src string, tgt string"), 10).cache()
    per = got.groupBy("node", "level").count()
    assert per.agg(F.max("count")).first()[0] == 1
    top = got.where("level = 0")
    assert top.select("node").distinct().count() == len({x for e in edges if e[0] != e[1] for x in e})
    deeper = {r["child"] for r in sub_communities(got, any_deeper=True).collect()}
    assert {r["cluster"] for r in got.where("level > 0").select("cluster").distinct().collect()} <= deeper


def test_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([("a", "x", "p"), ("b", "y", "q")], "k string, u string, v string")
    new = spark.createDataFrame([("a", "z", None), ("c", "w", "r")], "k string, u string, v string")
    assert sorted(map(tuple, graph.upsert(old, new, ["k"]).collect())) == [("a", "z", "p"), ("b", "y", "q"), ("c", "w", "r")]


def _modularity(adj, label):
    twice = sum(sum(ws.values()) for ws in adj.values())
    inside, total = Counter(), Counter()
    for v, ws in adj.items():
        for u, w in ws.items():
            total[label[v]] += w
            inside[label[v]] += w * (label[u] == label[v])
    return sum(inside[c] / twice - (total[c] / twice) ** 2 for c in total)


def test_leiden_clusters_are_connected_and_as_good_as_planted_ones():
    for seed in range(12):
        rng = random.Random(seed)
        adj = defaultdict(dict)

        def link(a, b, adj=adj):
            if a != b:
                adj[a][b] = adj[b][a] = 1.0

        for g in range(8):
            for i in range(14):
                link((g, i), (g, (i + 1) % 14))
                for _ in range(3):
                    link((g, i), (g, rng.randrange(14)))
        for _ in range(30):
            link((rng.randrange(8), rng.randrange(14)), (rng.randrange(8), rng.randrange(14)))
        label = community._clusters(dict(adj))
        assert _modularity(adj, label) >= _modularity(adj, {v: v[0] for v in adj}) - 0.005
        for c in set(label.values()):
            own = {v for v in label if label[v] == c}
            seen, work = {c}, [c]
            while work:
                for u in adj[work.pop()]:
                    if u in own and u not in seen:
                        seen.add(u)
                        work.append(u)
            assert seen == own and c == min(own)


def test_leiden_parts_what_is_not_connected():
    # a hub moves away and leaves two halves of its old cluster without a link
    rng = random.Random(1)
    for _ in range(30):
        adj = defaultdict(dict)
        for _ in range(60):
            a, b = rng.randrange(25), rng.randrange(25)
            if a != b:
                adj[a][b] = adj[b][a] = rng.random()
        label = community._clusters(dict(adj))
        for c in set(label.values()):
            own = {v for v in label if label[v] == c}
            seen, work = {c}, [c]
            while work:
                for u in adj[work.pop()]:
                    if u in own and u not in seen:
                        seen.add(u)
                        work.append(u)
            assert seen == own


def test_approximate_search_finds_the_nearest(spark, data):
    e = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).cache()
    hits = total = 0
    for q in e.where("id % 400 = 7").collect():
        near = {r["id"] for r in retrieval.vector_topk(e, list(q["vector"]), 20, None).collect()}
        hits += len(near & {r["id"] for r in retrieval.lsh_topk(e, list(q["vector"]), 20).collect()})
        total += len(near)
    assert hits >= 0.9 * total
