from kmerloom import queries


def test_every_contig_can_be_linked(spark, tmp_path):
    rows = [(7 + 3 * i, "tag") for i in range(100)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, i + 1) for i in range(300)], "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    contigs = spark.createDataFrame(rows, "id long, seq string")
    links = queries._contig_links(spark, str(tmp_path), contigs).collect()
    assert {r.src for r in links} == {r.dst for r in links} == {i for i, _ in rows}
    assert all(r.support == 3 and r.src != r.dst for r in links)
    # scaffolds of the query hold contigs beyond the fortieth
    assert queries.queries()["scaffolds"](spark, str(tmp_path)).count() < 60


def test_links_in_tasks_and_on_the_driver_choose_alike(spark):
    import random

    from kmerloom.operators import resolve

    rng = random.Random(4)
    names = [f"{'ACGT'[i % 4]}{'ACGT'[i // 4 % 4]}{'ACGT'[i // 16]}" * 4 for i in range(60)]
    contigs = spark.createDataFrame([(i, s, 2.0, 3) for i, s in enumerate(names)], "id long, sequence string, mean_coverage double, kmers_count long")
    found = {}
    for _ in range(90):
        u = rng.randrange(60)
        v = min(59, u + rng.randint(1, 3))
        if u != v:
            found[u, v] = found[v, u] = rng.randint(1, 9)
    src = spark.createDataFrame([(u, v, n) for (u, v), n in found.items()], "src long, dst long, support long")
    both = src.filter("src < dst AND support >= 3").toDF("u", "v", "support")
    for make in (lambda n: resolve.build_scaffolds(contigs, src, gap=3, local_links=n), lambda n: resolve.linked_scaffolds(contigs, both, gap=3, local_links=n)):
        here, there = (sorted(r.sequence for r in make(n).collect()) for n in (1000, 0))
        assert here == there
        assert len(here) < 60
    chains = resolve.scaffold_order(list(range(60)), [(u, v, n) for (u, v), n in found.items()])
    want = sorted("NNN".join(names[i] for i in c) for c in chains)
    assert sorted(r.sequence for r in resolve.build_scaffolds(contigs, src, gap=3).collect()) == want
