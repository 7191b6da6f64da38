"""Merged sketches of folders against exact counts."""

from weftgraph.operators import sketches as H

from helpers import node, nodes, rel, relations


def exact(rows, links, here, there):
    files = {n[2]: n[6] or "." for n in rows}
    out = {}
    for link in links:
        if link[4] != "calls" or link[5] is None or link[6] is None or link[here] not in files:
            continue
        path = files[link[here]]
        parts = [] if path == "." else path.split("/")
        for k in range(len(parts) + 1):
            out.setdefault("/".join(parts[:k]) or ".", []).append(link[there])
    return out


def test_folders_merge_what_their_files_have(spark):
    rows = [node(f"f{i}", path=["a/b/x.py", "a/b/y.py", "a/z.py", "q.py", None][i % 5]) for i in range(40)]
    rows += rows[:3]
    links = [rel(f"r{i}", f"f{i * 7 % 40}", f"f{i * i % 23}") for i in range(400)]
    links += [rel("n1", None, "f1"), rel("n2", "f1", None), rel("n3", "f1", "gone"),
              rel("n4", "gone", "f1"), rel("n5", "f1", "f2", type="imports")] + links[:9]
    got = {r.path: r for r in H.folder_sketch_rollup(nodes(spark, rows), relations(spark, links)).collect()}
    into, out = exact(rows, links, 6, 5), exact(rows, links, 5, 6)
    assert got.keys() == into.keys() | out.keys()
    for path, r in got.items():
        a, b = into.get(path, []), out.get(path, [])
        assert (r.calls_in, r.calls_out) == (len(a), len(b))
        # Sketches of so few values are exact.
        assert (r.callers, r.callees) == (len(set(a)), len(set(b)))
        assert r.depth == (0 if path == "." else path.count("/") + 1)
    counted = {r.path: r.exact for r in H.exact_rollup(nodes(spark, rows), relations(spark, links),
                                                        "callers").collect()}
    assert counted == {p: len(set(a)) for p, a in into.items()}


def test_estimates_keep_to_the_stated_error(spark):
    from pyspark.sql import functions as F

    rows = nodes(spark, [node(f"t{i}", path=f"d{i % 2}/e{i % 4}/f{i}.py") for i in range(8)])
    n = F.col("id")
    links = spark.range(60_000).select(
        F.lit("p1").alias("project_id"), F.lit("s1").alias("snapshot_id"), F.lit("calls").alias("type"),
        F.concat(F.lit("s"), (n % 30_000).cast("string")).alias("source_id"),
        F.concat(F.lit("t"), (n % 8).cast("string")).alias("target_id"))
    got = H.folder_sketch_rollup(rows, links).join(
        H.exact_rollup(rows, links, "callers"), ["project_id", "snapshot_id", "path"])
    seen = got.select("path", "callers", "exact", H.within(F.col("callers"), F.col("exact")).alias("ok"))
    seen = seen.collect()
    assert len(seen) == 8 + 4 + 2 + 1 and all(r.ok for r in seen)
    assert max(r.exact for r in seen) == 30_000


def test_empty_graph(spark):
    assert H.folder_sketch_rollup(nodes(spark, []), relations(spark, [])).collect() == []
