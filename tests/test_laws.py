"""Edge rows, golden values and laws."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidefold.functions import hashing as H
from tidefold.operators import causal as C
from tidefold.operators import lattice as L
from tidefold.operators import ledger as G
from tidefold.operators import placement as P
from tidefold.operators import sequence as Q
from tidefold.operators import sketches as K
from tidefold.operators import speculation as X
from tidefold.plans import draft as D
from tidefold.sources import archive as A


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_murmur3_known_values_and_vector_form():
    assert H.murmur3_32(b"", 0) == 0 and H.murmur3_32(b"", 1) == 0x514E28B7 and H.murmur3_32(b"test", 0) == 0xBA6BD213 and H.murmur3_32(b"Hello, world!", 0) == 0xC0363E43
    data = [bytes(range(n)) for n in range(10)] + ["é𝒳".encode()]
    for seed in (0, 1, 42):
        assert H.murmur3_many(data, seed).tolist() == [H.murmur3_32(d, seed) for d in data]


def test_fnv_and_java_hash():
    assert H.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert H.java_hash("hello") == 99162322


def test_lww_ties_and_tombstones(spark):
    w = spark.createDataFrame([("a", 1, "x", "old"), ("a", 2, "x", None), ("b", 2, "x", "1"), ("b", 2, "y", "2"), ("c", 1, "x", None), ("c", 2, "x", "v")], "k string, ts long, origin string, value string")
    assert rows(L.lww(w, ["k"])) == [("a", None), ("b", "2"), ("c", "v")]
    assert rows(L.lww_map(L.piece(w, w), ["k"])) == [("b", "2"), ("c", "v")]


def test_causal_merge_keeps_concurrent_adds(spark):
    facts = spark.createDataFrame([("A", "x", "r1", 1), ("A", "y", "r1", 2), ("B", "x", "r1", 1), ("B", "z", "r2", 1), ("A", "w", "r2", 5)], "state_id string, key string, replica string, seq long")
    vv = spark.createDataFrame([("A", "r1", 3), ("B", "r1", 2), ("B", "r2", 1)], "state_id string, replica string, upto long")
    cloud = spark.createDataFrame([("A", "r2", 5)], "state_id string, replica string, seq long")
    # y was seen by both and is held by one: removed; z and w were seen by one only: kept
    assert rows(C.or_set(facts, vv, cloud, "key")) == [("w",), ("x",), ("z",)]


def test_version_vectors(spark):
    v = spark.createDataFrame([("p", "a", 3), ("p", "b", 2), ("q", "a", 5)], "peer string, replica string, upto long")
    assert rows(L.vv_floor(v, [], "peer", 2)) == [("a", 3)]
    assert rows(L.vv_ceil(v, [])) == [("a", 5), ("b", 2)]
    d = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 4)], "replica string, seq long")
    assert rows(C.contiguous(d)) == [("b", 2)]


def test_count_min_takes_the_maximum(spark):
    a = spark.createDataFrame([("i",)] * 5, "item string")
    b = spark.createDataFrame([("i",)] * 3, "item string")
    cells = K.cms_merge(L.piece(K.cms_cells(a, [], "item", 512, 5), K.cms_cells(b, [], "item", 512, 5)), [])
    assert rows(K.cms_estimate(cells, a.distinct(), "item", 512, 5)) == [("i", 5)]


def test_hll_is_close(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("v"))
    est = K.hll_estimate(K.hll_registers(df, [], "v"), []).first()["estimate"]
    assert abs(est - 5000) < 150


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    bits, hashes = K.bloom_size(1000, 0.01)
    words = K.bloom_words(spark.range(1000), [], "id", bits, hashes)
    inside = K.bloom_contains(words, spark.range(1000), "id", bits, hashes).filter("contains").count()
    outside = K.bloom_contains(words, spark.range(5000, 6000), "id", bits, hashes).filter("contains").count()
    assert inside == 1000 and outside <= 30


def test_ddsketch_quantiles_within_alpha(spark):
    rnd = random.Random(5)
    values = sorted([10 ** rnd.uniform(-3, 6) for _ in range(500)] + [-(10 ** rnd.uniform(-3, 3)) for _ in range(100)] + [0.0] * 10)
    cells = K.dd_cells(spark.createDataFrame([(v,) for v in values], "v double"), [], "v")
    for q, got in rows(K.dd_quantiles(cells, [], [0.0, 0.1, 0.5, 0.9, 1.0])):
        real = values[int(q * (len(values) - 1))]
        assert abs(got - real) <= 0.0100001 * abs(real) + 1e-12


def test_histogram_is_upper_inclusive(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (2.0,), (9.0,)], "v double")
    assert [(b, n) for b, n, _ in rows(K.histogram(df, [], "v", [1.0, 2.0]))] == [(0, 1), (1, 2), (2, 1)]


def test_ring_owner_against_a_sorted_ring(spark):
    peers = spark.createDataFrame([(f"p{i}",) for i in range(5)], "peer string")
    tasks = spark.createDataFrame([(f"t{i}",) for i in range(300)], "task string")
    points = P.ring_points(peers, 20)
    ring = sorted((r["position"], r["peer"]) for r in points.collect())
    for task, peer in rows(P.owners(tasks, points)):
        p = H.ring_position(task)
        assert peer == next((b for a, b in ring if a >= p), ring[0][1])


def test_ring_owners_broadcast_no_points(spark):
    # the planner sees few peers and not their points, so a join could send every point through the driver
    peers = spark.range(40).selectExpr("'p' || id AS peer")
    tasks = spark.range(9).selectExpr("'t' || id AS task")
    plan = P.owners(tasks, P.ring_points(peers))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "BroadcastHashJoin" not in plan and "SortMergeJoin" not in plan


def test_ring_successor_takes_over_what_a_gone_peer_held(spark):
    points = spark.createDataFrame([(H.ring_position("t3"), "on the task"), (H.ring_position("t3") + 1, "behind it"), (5, "low")], "position long, peer string")
    ring = sorted((r["position"], r["peer"]) for r in points.collect())
    tasks = spark.createDataFrame([(f"t{i}",) for i in range(50)] * 2, "task string")  # a task asked twice has one owner
    for gone in (None, "on the task", "low"):
        left = [(a, b) for a, b in ring if b != gone]
        got = P.owners(tasks, points.filter(F.col("peer") != (gone or "")))
        assert rows(got) == sorted((t, next((b for a, b in left if a >= H.ring_position(t)), left[0][1])) for t in (f"t{i}" for i in range(50)))
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_affinity_negation_of_missing_attribute(spark):
    caps = spark.createDataFrame([("a", ["gpu"], {"z": "1"})], "peer string, tokens array<string>, attrs map<string,string>")
    peers = spark.createDataFrame([("a",), ("b",)], "peer string")
    assert rows(P.eligible(peers, caps, ~P.attr("z", "1"))) == [("b",)]
    assert rows(P.eligible(peers, caps, P.has("gpu") & P.ANYWHERE)) == [("a",)]


def test_rga_concurrent_inserts_deletes_and_long_chains():
    op = lambda k, i, a=None, v=None: {"kind": k, "id": i, "after": a, "value": v}
    ops = [op("insert", (1, "a", 1), None, "A"), op("insert", (2, "a", 2), (1, "a", 1), "B"), op("insert", (2, "b", 1), (1, "a", 1), "C"), op("remove", (1, "a", 1))]
    for _ in range(5):
        random.shuffle(ops)
        assert [(v, s) for _, v, s in Q.rga_order(ops)] == [("A", False), ("C", True), ("B", True)]
    assert [v for _, v, _ in Q.rga_order([*ops, op("compact", (1, "a", 1))])] == ["C", "B"]
    chain = [op("insert", (i, "a", i), (i - 1, "a", i - 1) if i > 1 else None, str(i)) for i in range(1, 10_001)]
    assert [v for _, v, _ in Q.rga_order(chain)] == [str(i) for i in range(1, 10_001)]


def test_rga_orders_runs_as_it_orders_elements(spark, monkeypatch):
    rng, ops = random.Random(3), []
    for d in range(6):
        ids = [None]
        for i in range(1, 60):
            ids.append((i, rng.choice("ab"), i))
            ops.append((f"d{d}", "insert", ids[-1], ids[-2] if rng.random() < 0.8 else rng.choice(ids[:-1]), str(i)))
        ops += [(*op[:1], kind, op[2], op[3] if kind == "compact" else None, None) for op in list(ops) if op[0] == f"d{d}" for kind in ("remove", "compact") if rng.random() < 0.08]
    ops += [("chain", "insert", (i, "a", i), (i - 1, "a", i - 1) if i > 1 else None, str(i)) for i in range(1, 500)]
    none = (None, None, None)
    df = spark.createDataFrame([(d, k, *i, *(a or none), v) for d, k, i, a, v in ops], "doc string, kind string, lamport long, replica string, seq long, after_lamport long, after_replica string, after_seq long, value string")
    want = []
    for d in sorted({op[0] for op in ops}):
        want += [(d, pos, v, s) for pos, (_, v, s) in enumerate(Q.rga_order([{"kind": k, "id": i, "after": a, "value": v} for e, k, i, a, v in ops if e == d]))]
    assert sorted(map(tuple, Q.rga_materialize(df).collect())) == want
    held = []
    monkeypatch.setattr(Q, "together", lambda rows, key: held.append(rows) or rows.repartition(key).sortWithinPartitions(key))
    Q.rga_materialize(df)
    assert held[0].filter("doc = 'chain'").count() == 1  # the whole chain is one row of what a document's function holds


def test_tree_moves_skip_cycles():
    moves = [(1, "a", 1, "A", "root", "v"), (2, "a", 2, "B", "root", "v"), (3, "a", 3, "A", "B", "v"), (3, "b", 1, "B", "A", "v"), (4, "b", 2, "A", "A", "v")]
    random.shuffle(moves)
    assert {k: m[4] for k, m in Q.replay_moves(moves).items()} == {"A": "B", "B": "root"}


def test_scheduler_ties_caps_and_overflow():
    e = lambda i, s=0, w=1, o=0: G.Edge(i, Fraction(w), Fraction(s), o, 10, 5)
    assert G.pick([e("b"), e("a")], 3, None, 100) == ("a", 3)
    assert G.pick([e("a"), e("b", w=2)], 3, None, 100) == ("b", 3)
    assert G.pick([e("a")], 3, None, 0) is None and G.pick([e("a", o=10)], 3, None, 5) is None
    assert G.pick([e("a", o=4)], 3, 5, 100) == ("a", 1)
    with pytest.raises(OverflowError):
        G.checked(Fraction(1, (1 << 63) + 1))


def test_draft_rewrites_keep_operations(spark):
    r = D.Registry()
    r.source("s", lambda: spark.range(10).withColumn("x", F.col("id")))
    r.map("m", lambda df: df.withColumn("y", F.col("x") + 1), {"y"})
    r.filter("f", F.col("x") > 3, {"x"})
    r.filter("g", F.col("y") > 6, {"y"})
    r.barrier("b", lambda df: df.distinct())
    d = D.Draft.shuttle("s").embroider("b").map("m").filter("f").filter("g")
    o = D.optimized(d, r)
    assert o.operations() == d.operations() and [n.kind for n in o.nodes] == ["source", "filter", "map", "filter", "barrier"]
    assert rows(r.lower(o)[0]) == rows(r.lower(d)[0])
    assert D.cost(o, {"s": 1000}, {"f": 0.05, "g": 1}).volume == 50 and D.cost(d, {"s": 1000}, {"f": 0.05}).volume == 1000
    with pytest.raises(ValueError):
        r.source("s", lambda: None)


def test_lattice_laws(spark):
    rnd = random.Random(1)
    make = lambda: spark.createDataFrame([(f"k{rnd.randint(0, 2)}", f"r{rnd.randint(0, 2)}", rnd.randint(1, 9)) for _ in range(8)], "k string, replica string, count long")
    a, b, c = make(), make(), make()
    want = rows(L.gcounter(L.piece(a, b, c), ["k"]))
    assert want == rows(L.gcounter(L.piece(c, b, a, a), ["k"]))
    assert want == rows(L.gcounter(L.piece(L.per_replica_max(L.piece(a, b), ["k"]), c), ["k"]))


def test_relocation_moves_what_was_charged_and_only_once(spark):
    finals = spark.createDataFrame([("t", "s1", "a", 10, 1, 3, 1), ("t", "s2", "a", 4, 0, 6, 0), ("t", "s1", "b", 2, 2, 0, 0)], "live string, edge string, replica string, issued long, returned long, leaf long, rollup long")
    kinds = ("issued", "returned", "leaf", "rollup")
    base = spark.createDataFrame([(r["edge"], r["replica"], k, r[k]) for r in finals.collect() for k in kinds], "edge string, replica string, kind string, amount long")
    none = spark.createDataFrame([], "path string")
    patch = G.relocation_patch(finals, base, none)
    after = L.piece(base, patch)
    total = {r["edge"]: tuple(r[k] for k in kinds) for r in G.edge_totals(after).collect()}
    assert total["t"] == (13, 0, 9, 1)
    assert all(a - b == 0 and leaf == rollup == 0 for e, (a, b, leaf, rollup) in total.items() if e != "t")
    assert rows(G.relocation_outcomes(finals, after, none)) == [("t", "nothing", None)]
    assert G.relocation_patch(finals, after, none).count() == 0
    assert rows(G.relocation_outcomes(finals, base, spark.createDataFrame([("s2",)], "path string"))) == [("t", "refused", "transfers")]
    assert G.relocation_outcomes(finals.limit(0), base, none).count() == 0


def test_joiners_are_seated_and_clamped(spark):
    schema = "parent string, edge string, weight_num long, weight_den long, issued long, outstanding long, target long, seated boolean, was_demanding boolean, offset_num long, offset_den long"
    children = spark.createDataFrame([
        ("p", "runs", 2, 1, 20, 0, 5, True, True, 0, 1), ("p", "idle", 1, 1, 99, 0, 0, True, True, 0, 1), ("p", "wakes", 1, 2, 1, 0, 5, True, False, 1, 3), ("p", "carried", 1, 1, 0, 0, 5, True, False, 50, 1),
        ("p", "unseen", 1, 1, 0, 0, 5, False, None, 0, 1), ("p", "ahead", 1, 1, 40, 0, 0, False, None, 0, 1), ("q", "only", 1, 1, 3, 0, 5, True, False, 1, 2), ("q", "born", 3, 1, 0, 0, 5, False, None, 0, 1),
    ], schema)
    assert rows(G.fronts(children)) == [("p", 10, 1)]
    got = {r[1]: r[2:] for r in rows(G.settle_joiners(children))}
    assert got == {
        "runs": (None, None, 0, 1), "idle": (None, None, 0, 1), "wakes": (None, None, 8, 1), "carried": (None, None, 50, 1),
        "unseen": (10, 1, 0, 1), "ahead": (40, 1, 0, 1), "only": (None, None, 1, 2), "born": (0, 1, 0, 1),
    }
    assert {r[1]: r[4:] for r in rows(G.settle_joiners(children, sleeper_credit=2))}["wakes"] == (4, 1)
    assert G.settle_joiners(children.limit(0)).count() == 0


def test_window_drop_steps_over_compacted_and_keeps_gaps(spark):
    ident = "doc long, lamport long, replica string, seq long"
    ops = spark.createDataFrame([(1, s, r, s, "insert") for s in (1, 2, 4, 6) for r in "ab"] + [(1, 3, "a", 3, "compact")], ident + ", kind string")
    dropped = spark.createDataFrame([(1, s, "a", s) for s in (1, 2, 4, 6)] + [(1, 1, "b", 1), (1, 9, "b", 9)], ident)
    assert rows(Q.drop_window(ops, dropped, "a", spark.createDataFrame([], "doc long, upto long"))) == [(1, "compact", 1, "b", 1), (1, "compact", 6, "a", 6), (1, "floor", None, "a", 4)]
    assert Q.drop_window(ops, dropped.limit(0), "a", spark.createDataFrame([], "doc long, upto long")).count() == 0


def test_archive_append_adds_to_what_is_there(spark, tmp_path):
    frames = spark.createDataFrame([(i, i + 1) for i in range(6)], "offset long, end_offset long")
    A.append(frames.filter("offset < 4"), str(tmp_path / "log"))
    A.append(frames.filter("offset >= 4"), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert [tuple(r) for r in A.replay(log).collect()] == [(i, i + 1) for i in range(6)]
    assert rows(A.verdict(log)) == [(None, 6, 0)] and rows(A.verdict(log.filter("offset <> 2"))) == [(2, 6, 1)]


def test_sequence_edits(spark):
    schema = "doc long, kind string, lamport long, replica string, seq long, after_lamport long, after_replica string, after_seq long, value string"
    chain = [(1, "insert", i, "a", i, i - 1 or None, "a" if i > 1 else None, i - 1 or None, "abcd"[i - 1]) for i in range(1, 5)]
    ops = spark.createDataFrame([*chain, (1, "remove", 2, "a", 2, None, None, None, None)], schema)
    text = lambda df: "".join(r.value for r in Q.rga_materialize(df).filter("visible").orderBy("pos").collect())
    put = lambda i, v: ops.unionByName(Q.insert_at(ops, spark.createDataFrame([(1, i, v)], "doc long, index long, value string"), "b"))
    assert [text(put(i, "x")) for i in range(4)] == ["xacd", "axcd", "acxd", "acdx"]
    with pytest.raises(Exception, match="beyond"):
        put(4, "x").collect()
    run = spark.createDataFrame([(1, 4, "a", 4, list("xyz")), (2, None, None, None, list("q"))], "doc long, after_lamport long, after_replica string, after_seq long, values array<string>")
    made = Q.insert_all_after(ops, run, "a")
    assert [tuple(r)[:8] for r in made.orderBy("doc", "lamport").collect()] == [(1, "insert", 5, "a", 5, 4, "a", 4), (1, "insert", 6, "a", 6, 5, "a", 5), (1, "insert", 7, "a", 7, 6, "a", 6), (2, "insert", 1, "a", 1, None, None, None)]
    assert text(ops.unionByName(made).filter("doc = 1")) == "acdxyz"
    at = lambda i: rows(Q.remove_at(ops, spark.createDataFrame([(1, i)], "doc long, index long")))
    assert at(1) == [(1, "remove", 3, "a", 3)] and at(3) == [] and at(-1) == []
    first = lambda n: rows(Q.remove_first(ops, spark.createDataFrame([(1, n)], "doc long, count long")))
    assert [r[4] for r in first(2)] == [1, 3] and first(0) == []
    for doc, n in ((1, 4), (9, 1)):  # more than there are, and a document without elements
        with pytest.raises(Exception, match="beyond"):
            Q.remove_first(ops, spark.createDataFrame([(doc, n)], "doc long, count long")).collect()


def test_speculation(spark):
    add = lambda state, action: state + (action,)
    s = X.Session((), add)
    for event in [("propose", "a"), ("propose", "b"), ("commit", "z", "other", 1), ("commit", "a", "me", 1)]:
        s.take(*event)
    assert (s.sure, s.shown, list(s.pending)) == (("z", "a"), ("z", "a", "b"), ["b"])
    s.take("commit", "z", "other", 1)  # a duplicate changes no state
    s.take("propose", "c")
    s.take("fail", None)
    assert (s.sure, s.shown, s.confirmed) == (("z", "a"), ("z", "a", "b"), 3)
    s.take("commit", "b", "me", 1)  # a duplicate with a pending twin drops the twin
    assert (s.sure, s.shown, list(s.pending)) == (("z", "a"), ("z", "a"), [])
    s.take("propose", "d")
    s.take("reset", ("r",))
    assert (s.sure, s.shown, list(s.pending)) == (("r",), ("r",), [])
    events = spark.createDataFrame([(1, 2, "commit", "m", 1, 5), (1, 1, "propose", None, None, 5), (2, 1, "propose", None, None, 7)], "session long, idx long, kind string, client string, request long, action long")
    assert rows(X.speculate(events, 0, lambda a, b: a + b)) == [(1, 5, 5, 0, 1), (2, 0, 7, 1, 0)]
    assert X.speculate(events.limit(0), 0, lambda a, b: a + b).count() == 0


def test_commits_of_others_do_not_replay_what_is_pending():
    calls = []
    s = X.Session(0, lambda a, b: calls.append(b) or a + b)
    for i in range(300):
        s.take("propose", i)
        s.take("commit", -1, "other", i)
    assert (s.sure, s.shown, len(s.pending)) == (-300, sum(range(300)) - 300, 300) and len(calls) <= 3 * 300
    s.take("fail", None)
    s.take("propose", 7)
    assert s.shown == sum(range(299)) - 300 + 7


def test_turns_of_many_installs_need_no_list_of_them(spark):
    from tidefold.operators import stamps as S

    rng = random.Random(5)
    log = [(i * i * 1000 - 10**6, rng.choice(["install", "entry", "entry", "entry", "internal"]), rng.choice([None, 1, 2, 3]), rng.randrange(9), "x") for i in range(500)]
    want, served = [], {}
    for idx, kind, client, request, action in log:
        if kind == "install":
            served = {}
            want.append((idx, "Reset", action, True))
        elif kind == "entry":
            applied = client is None or request > served.get(client, -1)
            if client is not None:
                served[client] = max(request, served.get(client, -1))
            want.append((idx, "Committed", action, applied))
    got = S.turn_events(spark.createDataFrame(log, "idx long, kind string, client long, request_id long, action string").repartition(5))
    assert [tuple(r) for r in got.collect()] == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_spending_rolls_up_any_depth_and_a_cycle_is_an_error(spark):
    for depth in (1, 20, 100):
        edges = spark.createDataFrame([(f"e{i}", f"g{i}", f"g{i + 1}") for i in range(depth)], "edge string, parent string, child string")
        spends = spark.createDataFrame([(f"g{depth}", "r", 3)], "grp string, replica string, amount long")
        got = {r["edge"]: (r["kind"], r["amount"]) for r in G.spend_rollup(spends, edges).collect()}
        assert got == {f"e{i}": ("leaf" if i == depth - 1 else "rollup", 3) for i in range(depth)}
    ring = spark.createDataFrame([("a", "x", "y"), ("b", "y", "x")], "edge string, parent string, child string")
    with pytest.raises(ValueError, match="cycle"):
        G.lineage(ring)


def test_holdings_of_a_forest_need_a_root(spark):
    edges = spark.createDataFrame([("a", "x", "y"), ("b", "p", "q")], "edge string, parent string, child string")
    minted = spark.createDataFrame([("m", "r", 10)], "id string, holder string, amount long")
    counters = spark.createDataFrame([("a", "r", "issued", 4)], "edge string, replica string, kind string, amount long")
    none = spark.createDataFrame([], "path string, sender string, receiver string, amount long")
    with pytest.raises(ValueError, match="several roots"):
        G.holdings(minted, edges, counters, none)
    got = {r["grp"]: r["held"] for r in G.holdings(minted, edges, counters, none, root="x").collect()}
    assert got == {"x": 6, "y": 4}


def test_virtual_service_is_reduced_and_exact(spark):
    rows = [(6, 4, 9), (0, 3, 7), (1 << 40, 1 << 41, (1 << 40) - 1), (-6, 3, 2), (2**62, 2**61, 5)]
    edges = spark.createDataFrame([(f"e{i}", w, d) for i, (_, w, d) in enumerate(rows)], "edge string, weight_num long, weight_den long")
    counters = spark.createDataFrame([(f"e{i}", "r", "issued" if n >= 0 else "returned", abs(n)) for i, (n, _, _) in enumerate(rows)], "edge string, replica string, kind string, amount long")
    got = {r["edge"]: Fraction(r["num"], r["den"]) for r in G.virtual_service(edges, counters).collect()}
    assert got == {f"e{i}": Fraction(n * d, w) for i, (n, w, d) in enumerate(rows)}


MOVE = "tree string, ts long, replica string, seq long, node string, new_parent string, value string"


def test_tree_compaction_keeps_every_parent(spark):
    # plain: the first reparent of x is superseded by a stable one
    plain = [("p", 1, "a", 1, "x", "root", "X"), ("p", 2, "a", 2, "y", "root", "Y"), ("p", 3, "b", 1, "x", "y", None), ("p", 4, "c", 1, "x", "root", None)]
    # cyclic: without b's reparent of y to the root, y's creation under x would make x under y a cycle
    cyclic = [("q", 1, "a", 1, "y", "x", "Y"), ("q", 2, "b", 1, "y", "root", None), ("q", 3, "c", 1, "x", "y", "X"), ("q", 4, "c", 2, "y", "z", None)]
    moves = spark.createDataFrame(plain + cyclic, MOVE)
    whole = spark.createDataFrame([("a", 9), ("b", 9), ("c", 9)], "replica string, upto long")
    dropped = Q.tree_compactable(moves, whole, whole, whole)
    assert rows(dropped) == [("p", "b", 1)]
    kept = Q.tree_compact(moves, dropped)
    assert kept.count() == 7 and rows(Q.tree_compact(kept, dropped)) == rows(kept)
    assert rows(Q.tree_replay(kept)) == rows(Q.tree_replay(moves))
    # the winner is not stable yet, or the frontier is not delivered: nothing goes
    part = spark.createDataFrame([("a", 9), ("b", 9)], "replica string, upto long")
    assert rows(Q.tree_compactable(moves, part, whole, whole)) == [] and rows(Q.tree_compactable(moves, whole, whole, part)) == []


def test_tree_compaction_sees_whole_trees_when_a_join_turns_to_a_broadcast(spark):
    # joins are planned by a shuffle and broadcast at run time, which leaves the other side's rows where they lie
    moves = [m for i in range(8) for m in ((f"t{i}", 1, "a", 1, "x", "root", "X"), (f"t{i}", 3, "b", 1, "x", "y", None), (f"t{i}", 4, "c", 1, "x", "root", None))]
    held = spark.createDataFrame(moves, MOVE)
    whole = spark.createDataFrame([(f"t{i}", r, 9) for i in range(8) for r in "abc"], "tree string, replica string, upto long")
    spread = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    coming = spark.createDataFrame([("t7", "d", 1)], "tree string, replica string, upto long")  # an op of t7 that has not come
    try:
        for k, v in spread.items():
            spark.conf.set(k, v)
        got = Q.tree_compactable(held.repartition(8, "ts"), whole, whole.unionByName(coming), whole)
        assert rows(got) == [(f"t{i}", "b", 1) for i in range(7)]
    finally:
        for k in spread:
            spark.conf.unset(k)


def test_tree_predicates_over_unknown_parents(spark):
    placed = spark.createDataFrame([("t", "a", "root"), ("t", "b", "a"), ("t", "c", "lost"), ("t", "d", "c")], "tree string, node string, parent string")
    spans = Q.tree_spans(placed, "root")
    assert {r["node"]: (r["parent"], r["rooted"]) for r in spans.collect()} == {"root": (None, True), "a": ("root", True), "b": ("a", True), "lost": (None, False), "c": ("lost", False), "d": ("c", False)}
    pairs = [("t", "root", "b"), ("t", "a", "b"), ("t", "b", "a"), ("t", "b", "b"), ("t", "lost", "d"), ("t", "root", "d"), ("t", "nobody", "a")]
    got = Q.is_ancestor(spans, spark.createDataFrame(pairs, "tree string, ancestor string, descendant string"))
    assert {r["ancestor"] + r["descendant"] for r in got.filter("above").collect()} == {"rootb", "ab", "lostd"} and got.count() == 7


OP = "doc int, kind string, lamport long, replica string, seq long, after_lamport long, after_replica string, after_seq long, value string"


def test_merge_under_a_floor_is_a_law(spark):
    log = lambda *r: spark.createDataFrame(list(r), OP)
    ins = lambda n, after: (1, "insert", n, "r", n, after, "r" if after else None, after, str(n))
    a, b = log(ins(1, None), ins(2, 1)), log(ins(2, 1), ins(3, 2), (1, "remove", 2, "r", 2, None, None, None, None))
    floors = spark.createDataFrame([(1, "r", 1), (1, "s", 7)], "doc int, replica string, upto long")
    ab, ba = Q.oplog_merge(a, b, floors=floors), Q.oplog_merge(b, a, floors=floors)
    assert rows(ab) == rows(ba) == rows(Q.oplog_merge(ab, a, floors=floors))
    # the floored head is gone, and what came after it hangs from the document's head
    assert [r["value"] for r in Q.rga_materialize(ab).orderBy("pos").collect()] == ["2", "3"]
    cut = spark.createDataFrame([("r", 9)], "replica string, upto long")
    late = spark.createDataFrame([("s", 1)], "replica string, upto long")
    last = Q.oplog_merge(a, log((1, "remove", 2, "r", 2, None, None, None, None)))
    assert [r["after_seq"] for r in Q.compactable(last, cut, cut, cut).collect()] == [1]
    assert Q.compactable(last, cut, late, cut).count() == 0


def test_json_reads_stop_at_leaves_and_removed_paths(spark):
    edits = [(1, "a", "object", 1), (1, "a/b", "object", 1), (1, "a/b/c", "leaf", 1), (1, "x", "leaf", 1), (1, "x/y", "leaf", 1), (1, "z", "remove", 2), (1, "z", "leaf", 1)]
    paths = Q.json_paths(spark.createDataFrame([(d, p, k, ts, "o", "v") for d, p, k, ts in edits], "doc int, path string, kind string, ts long, origin string, value string"))
    assert [(r["at"], r["keys"]) for r in Q.json_keys(paths).orderBy("at").collect()] == [("", ["a", "x"]), ("a", ["b"]), ("a/b", ["c"])]


def test_rationals_are_exact_and_raise_beyond_64_bits(spark):
    from tidefold.functions import rational as R

    draw = random.Random(5)
    made = [(draw.randint(-m, m), draw.choice((-1, 1)) * draw.randint(1, m), draw.randint(1, m), draw.randint(1, m)) for m in (9, 10**5, 10**9) for _ in range(40)]
    made += [(2**62, 1, 2**62 - 1, 1), (0, 5, 1, 7), (-(2**62), 1, -(2**62), 1)]
    df = spark.createDataFrame(made, "a long, b long, c long, d long").select("*", R.rational(F.col("a"), F.col("b")).alias("x"), R.rational(F.col("c"), F.col("d")).alias("y"))
    x, y = F.col("x"), F.col("y")
    got = df.filter("a > -4611686018427387904").select("a", "b", "c", "d", R.plus(x, y).alias("s"), R.minus(x, y).alias("m"), R.compared(x, y).alias("k"), R.ceiling(x).alias("e"), R.greatest(x, y).alias("g")).collect()
    for r in got:
        p, q = Fraction(r.a, r.b), Fraction(r.c, r.d)
        assert [(v.num, v.den) for v in (r.s, r.m, r.g)] == [(v.numerator, v.denominator) for v in (p + q, p - q, max(p, q))]
        assert (r.k, r.e) == ((p > q) - (p < q), -(-p.numerator // p.denominator))
    for r in df.filter("abs(a) <= 100000 and abs(c) <= 100000 and d < 100000 and abs(b) < 100000").select("a", "b", "c", "d", R.times(x, y).alias("p"), R.over(x, y).alias("q")).collect():
        p, q = Fraction(r.a, r.b), Fraction(r.c, r.d)
        assert [(v.num, v.den) for v in (r.p, r.q)] == [(v.numerator, v.denominator) for v in (p * q, p / q)]
    with pytest.raises(Exception, match="64 bits"):
        df.filter("a = 4611686018427387904").select(R.plus(x, R.plus(y, y)).alias("z")).collect()
    none = spark.sql("select cast(null as bigint) a, 1L b").select(R.rational(F.col("a"), F.col("b")).alias("x"))
    assert none.select(R.plus(F.col("x"), F.col("x")).alias("s")).first()["s"] is None


def test_causal_stamps_follow_the_frontier(spark):
    from tidefold.operators import stamps as S

    log = [("a", 1, "tick", None, None), ("a", 2, "observe", "b", 4), ("a", 3, "observe", "b", 4), ("a", 4, "tick", None, None), ("a", 5, "clear", None, None), ("a", 6, "tick", None, None), ("a", 7, "observe", "b", 9), ("a", 8, "clear", None, None), ("a", 9, "observe", "c", 1), ("b", 1, "observe", "a", 1)]
    df = spark.createDataFrame(log, "replica string, idx long, kind string, from_replica string, from_seq long")
    assert [(r.idx, r.seq, [tuple(d) for d in r.predecessors]) for r in S.causal_stamps(df).orderBy("idx").collect()] == [(1, 1, []), (4, 2, [("a", 1), ("b", 4)]), (6, 3, [])]
    assert {r.replica: [tuple(d) for d in r.frontier] for r in S.causal_frontier(df).collect()} == {"a": [("c", 1)], "b": [("a", 1)]}
    assert [tuple(d) for d in S.causal_frontier(df.filter("replica = 'a' and idx <= 4")).first().frontier] == [("a", 2)]


def test_pairing_verdicts(spark):
    from tidefold.operators import stamps as S

    sessions = spark.createDataFrame([("paired", 0), ("late", 0), ("empty", 0), ("open", 95)], "session string, armed long")
    rosters = spark.createDataFrame([("paired", 3, 1), ("paired", 5, 2), ("paired", 7, 1), ("late", 4, 1), ("late", 10, 2)], "session string, at long, members long")
    got = {r.session: (r.event, r.at, r.observed) for r in S.pairing(sessions, rosters, 2, 10, 100).collect()}
    assert got == {"paired": ("Paired", 5, None), "late": ("NeverPaired", 10, 1), "empty": ("NeverPaired", 10, 0)}
    with pytest.raises(ValueError):
        S.pairing(sessions, rosters, 1, 10, 100)


def test_view_sizes():
    assert [P.view_size(n) for n in (0, 1, 7, 8, 100, 10**6)] == [4, 4, 4, 5, 7, 16]
