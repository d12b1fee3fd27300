"""Components of links: what they are, and that few links do not take rounds of shuffles."""

import random


def brute(links):
    label = {x: x for pair in links for x in pair}
    while True:
        new = dict(label)
        for a, b in links:
            low = min(new[a], new[b])
            new[a] = new[b] = low
        if new == label:
            return {n: r for n, r in label.items() if n != r}
        label = new


def test_components(spark, monkeypatch):
    from reelgrid.llm import blocks, components

    written, kept = [], blocks.kept
    monkeypatch.setattr(blocks, "kept", lambda df, name: written.append(name) or kept(df, name))
    chain = [(k, k + 1) for k in range(300)]
    found = components.components(spark.createDataFrame(chain, "a long, b long").repartition(1)).collect()
    assert {r["node"]: r["root"] for r in found} == brute(chain)
    assert len(found) == 300 and len(written) == 1
    assert not components.components(spark.createDataFrame([(4, 4)], "a long, b long")).collect()


def test_components_over_many_tasks(spark):
    """Links that no task holds together: each node has one row all the same."""
    from reelgrid.llm.components import components

    rng = random.Random(7)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2000)] + [(5000 + k, 5001 + k) for k in range(200)] + [(9000, 9001 + k) for k in range(400)] * 2
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for kind, name in (("long", int), ("string", lambda x: f"{x:05d}")):
            own = [(name(a), name(b)) for a, b in links]
            found = components(spark.createDataFrame(own, f"a {kind}, b {kind}")).collect()
            assert len(found) == len({r["node"] for r in found})
            assert {r["node"]: r["root"] for r in found} == brute([x for x in own if x[0] != x[1]])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_few_links_of_many_tasks_take_no_rounds(spark, monkeypatch):
    """A table of few links is settled at once, even if each link lies in a task of its own."""
    from reelgrid.llm import blocks, components

    written, kept = [], blocks.kept
    monkeypatch.setattr(blocks, "kept", lambda df, name: written.append(name) or kept(df, name))
    chain = [(k, k + 1) for k in range(60)]
    found = components.components(spark.createDataFrame(chain, "a long, b long").repartition(60)).collect()
    assert {r["node"]: r["root"] for r in found} == brute(chain)
    assert len(found) == 60 and len(written) == 1


def test_rounds_of_more_links_than_a_task_holds(spark, monkeypatch):
    from reelgrid.llm import components

    monkeypatch.setattr(components, "HELD", 50)
    rng = random.Random(11)
    links = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(2000 + k, 2001 + k) for k in range(100)]
    found = components.components(spark.createDataFrame(links, "a long, b long").repartition(40)).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["root"] for r in found} == brute([x for x in links if x[0] != x[1]])


def test_a_task_thins_as_it_goes(monkeypatch):
    import pyarrow as pa

    from reelgrid.llm import components

    sizes, spanning = [], components.spanning
    monkeypatch.setattr(components, "HELD", 100)
    monkeypatch.setattr(components, "spanning", lambda a, b: sizes.append(len(a)) or spanning(a, b))
    batches = [pa.record_batch({"u": [k % 10 + 1] * 30, "v": [0] * 30}) for k in range(100)]
    out = pa.Table.from_batches(components._thinned(iter(batches)))
    assert sorted(out.column("u").to_pylist()) == list(range(1, 11)) and set(out.column("v").to_pylist()) == {0}
    assert max(sizes) <= 100 + 30 + 10
    assert not list(components._thinned(iter([])))
